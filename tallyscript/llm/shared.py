"""What the operators share: places in the shared folder, connected components, small helpers."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Local folders that this driver made because the session names none; removed when it ends.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A new place in the folder that all executors share.

    The folder is ``spark.checkpoint.dir``. Where the session leaves it unset, a temporary one is made if the master is
    local, as in tests; on a cluster, whose machines have temporary folders of their own, that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            path = tempfile.mkdtemp(prefix="tallyscript-")
            atexit.register(shutil.rmtree, path, True)
            _own[app] = f"file://{path}"
        base = _own[app]
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read from there: its lineage ends, lost executors cost nothing."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Removes the files of a `stored` table that nothing reads any more."""
    spark = df.sparkSession
    files = df.inputFiles()
    if files:
        folder = files[0].rsplit("/", 1)[0]
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def beside(df: DataFrame, *names: str) -> DataFrame:
    """`df` with room for new columns of these names: a column that has one of them gets `_input` behind its own name."""
    taken = {c.lower() for c in [*df.columns, *names]}
    out = []
    for c in df.columns:
        new = c
        if c.lower() in {n.lower() for n in names}:
            while new.lower() in taken:
                new += "_input"
            taken.add(new.lower())
        out.append(new)
    return df.toDF(*out) if out != df.columns else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_batches(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that a batch of long texts stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def local_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For the nodes 0 to n - 1 joined by the edges (a, b): the smallest node of each one's component."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        low = np.minimum(ra, rb)
        new = root.copy()
        np.minimum.at(new, ra, low)
        np.minimum.at(new, rb, low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == root).all():
            break
        root = new
    return root


def _forests(batches: Iterator[pa.RecordBatch], most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) as those of forests with the same components, of up to `most` edges each: (node, smaller node)."""

    def forest() -> pa.RecordBatch:
        nodes, at = np.unique(np.concatenate((*left, *right)), return_inverse=True)
        root = local_roots(at[: len(at) // 2], at[len(at) // 2 :], len(nodes))
        own = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[root[own]])], ["u", "v"])

    left, right, n = [], [], 0
    for b in batches:
        left.append(b.column(0).to_numpy(zero_copy_only=False))
        right.append(b.column(1).to_numpy(zero_copy_only=False))
        n += b.num_rows
        if n >= most:
            yield forest()
            left, right, n = [], [], 0
    if n:
        yield forest()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a long, b long): one row (node, component) per node
    that has an edge to another node, `component` being the component's smallest node.

    Alternating large-star and small-star rounds, each written to the shared folder; a round needs two
    shuffles on the node, and adaptive execution splits the partition of a node with very many edges.
    The number of rounds grows with the logarithm of a component's size. Empty input gives an empty table.
    """
    spark = edges.sparkSession
    now = stored(edges.where("a <> b").select("a", "b").mapInArrow(_forests, "u long, v long").distinct())
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(small_low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small_low.withColumnRenamed("m", "v"))
            .distinct()
        )
        after = stored(small)
        new = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        dropped(now)
        now = after
        if new == mark:
            break
        mark = new
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component").distinct())
