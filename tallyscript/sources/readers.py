"""Readers: pairs from DataFrames, CSV, JSON Lines and Parquet; terms from files."""

from __future__ import annotations

import ast
import atexit
import re
import shutil
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.evaluation import EvalSet

_LIST = r"(?s)^\s*\[.*\]\s*$"


def _literal_lists():
    from pyspark.sql.pandas.functions import arrow_udf

    def read(text: str | None) -> list[str] | None:
        try:
            value = ast.literal_eval(text.strip()) if text is not None else None
        except (ValueError, SyntaxError):
            return None
        return [str(x) for x in value] if isinstance(value, list) else None

    @arrow_udf("array<string>")
    def lists(texts: pa.Array) -> pa.Array:
        return pa.array([read(t) for t in texts.to_pylist()], pa.list_(pa.string()))

    return lists


def term_column(df: DataFrame, name: str) -> Column:
    """A key-term column as array<string>: lists stay; a string column holds list literals in all rows, or plain terms.

    Which of these a string column is takes one aggregate over it. Other types are refused.
    """
    kind = df.schema[name].dataType
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StringType, T.NullType)):
        return F.col(name).cast("array<string>")
    if not isinstance(kind, T.StringType):
        raise ValueError(f"key-term column '{name}' must hold strings or lists of strings, not {kind.simpleString()}")
    lists = df.agg(F.bool_and(F.col(name).rlike(_LIST))).first()[0]
    if lists:
        return _literal_lists()(F.col(name))
    return F.when(F.col(name).isNotNull(), F.array(name))


def _numbered(df: DataFrame, name: str) -> DataFrame:
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        base = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if base is None:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise RuntimeError("rows without an id column are numbered in a checkpoint; spark.checkpoint.dir must name a folder that all executors share")
            base = tempfile.mkdtemp(prefix="tallyscript-")
            atexit.register(shutil.rmtree, base, True)
        context.setCheckpointDir(base)
    return df.withColumn(name, F.monotonically_increasing_id()).checkpoint()


def from_dataframe(df: DataFrame, ref_col: str = "ref", hyp_col: str = "hyp", key_term_cols: list[str] | None = None, id_col: str | None = None, **options) -> EvalSet:
    """Pairs of any DataFrame. Without `id_col` rows are numbered once and kept, numbers and all, as a checkpoint: numbers
    that are given again on each run would differ if the rows came in another order."""
    for c in (ref_col, hyp_col, *(key_term_cols or [])):
        if c not in df.columns:
            raise ValueError(f"there is no column '{c}'; there are: {', '.join(df.columns)}")
    terms = F.lit(None).cast("map<string,array<string>>")
    names = list(key_term_cols or [])
    if names:
        entries = F.array(*(F.struct(F.lit(n), F.array_distinct(F.coalesce(term_column(df, n), F.array().cast("array<string>")))) for n in names))
        terms = F.map_from_entries(F.filter(entries, lambda e: F.size(e["col2"]) > 0))
    if not id_col:
        id_col = "ex_id"
        while id_col.lower() in {c.lower() for c in df.columns}:
            id_col += "_"
        df = _numbered(df, id_col)
    pairs = df.select(F.col(id_col).cast("long").alias("ex_id"), F.col(ref_col).cast("string").alias("ref"), F.col(hyp_col).cast("string").alias("hyp"), terms.alias("key_terms"))
    return EvalSet(pairs, names=frozenset(names), **options)


def from_pandas(spark: SparkSession, pdf, **kwargs) -> EvalSet:
    """Pairs of a pandas DataFrame, which stays as it is; rows are numbered from 0."""
    import pandas as pd

    if not isinstance(pdf, pd.DataFrame):
        raise TypeError(f"a pandas DataFrame is needed, not {type(pdf).__name__}")
    return from_dataframe(spark.createDataFrame(pdf.reset_index(drop=True).rename_axis("_row").reset_index()), id_col="_row", **kwargs)


_EVALSET = ("ref_col", "hyp_col", "key_term_cols", "id_col", "config", "language", "nulls")


def _read(spark: SparkSession, fmt: str, path: str, given: dict, **defaults) -> EvalSet:
    own = {k: given.pop(k) for k in _EVALSET if k in given}
    return from_dataframe(spark.read.options(**{**defaults, **given}).format(fmt).load(path), **own)


def from_csv(spark: SparkSession, path: str, **kwargs) -> EvalSet:
    """A CSV file with a header; further arguments are options of Spark's reader."""
    return _read(spark, "csv", path, kwargs, header=True, quote='"', escape='"', multiLine=True)


def from_jsonl(spark: SparkSession, path: str, **kwargs) -> EvalSet:
    return _read(spark, "json", path, kwargs)


def from_parquet(spark: SparkSession, path: str, **kwargs) -> EvalSet:
    return _read(spark, "parquet", path, kwargs)


def from_dataset(*_args, **_kwargs) -> EvalSet:
    raise NotImplementedError("datasets of other libraries aren't read; pass a DataFrame to from_dataframe")


def read_terms(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(vocab, term): a term per line of a text file. Lines aren't stripped. Empty ones are terms without a token, which
    occur nowhere; one that ends the file isn't a line."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        raise FileNotFoundError(path)
    return spark.read.text(path).select(F.lit(name).alias("vocab"), F.col("value").alias("term")).distinct()
