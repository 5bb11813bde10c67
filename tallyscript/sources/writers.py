"""Writers of alignments: rows of operations, JSON columns and JSON files."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_ops(ops: Column) -> Column:
    """An alignment as JSON text, missing sides included."""
    return F.to_json(ops, {"ignoreNullFields": "false"})


def op_rows(alignments: DataFrame) -> DataFrame:
    """(ex_id, op, and the operation's fields): a row per operation."""
    return alignments.select("ex_id", F.posexplode("ops").alias("op", "o")).select("ex_id", "op", "o.*")


def write_json(alignments: DataFrame, path: str, allow_overwrite: bool = False) -> None:
    """A folder of JSON Lines, an alignment per line, written by all executors."""
    alignments.write.mode("overwrite" if allow_overwrite else "errorifexists").option("ignoreNullFields", "false").json(path)


def target(path: str | Path, allow_overwrite: bool) -> Path:
    """A file's path after the checks that every single-file writer makes: parents are made, folders refused."""
    path = Path(path)
    if path.is_dir():
        raise ValueError(f"{path} is a folder")
    if path.exists() and not allow_overwrite:
        raise FileExistsError(f"{path} exists; allow_overwrite=True replaces it")
    path.parent.mkdir(parents=True, exist_ok=True)
    return path


def write_one_json(alignments: DataFrame, ex_id: int, path: str | Path, allow_overwrite: bool = False) -> None:
    """One example's alignment as a JSON file on the driver; only that example is aligned."""
    path = target(path, allow_overwrite)
    row = alignments.where(F.col("ex_id") == ex_id).first()
    if row is None:
        raise ValueError(f"there is no example {ex_id}")
    path.write_text(json.dumps([o.asDict() for o in row["ops"]], ensure_ascii=False, indent=2), encoding="utf-8")
