"""Bounded samples of labelled documents, for the classifiers.

The bound is a parameter of each classifier. Rows are chosen by a hash, so a sample is the same on every run, and rows
that are equal in all that the hash reads count once: an id or a text that very many rows have is one row of a sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """Whether a row belongs to the fold that no classifier learns from; a null id does not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def sampled(rows: DataFrame, bound: int, seed: int) -> DataFrame:
    """About `bound` of the rows (all that differ, if there are no more), by a hash of all their columns."""
    n = rows.count()
    share = F.pmod(F.xxhash64(F.lit(seed), *rows.columns), F.lit(1 << 30)) / float(1 << 30)
    return (rows if n <= bound else rows.where(share < bound / n)).distinct()


def learnable(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, label) of the rows that may be learnt from: labelled 0 or 1, and not held out. A repeated id counts once."""
    rows = labels.select("doc_id", F.col(column).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    return rows.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))


def with_texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The chosen (doc_id, label), a bounded sample, so it may be broadcast, with their documents' texts; of rows that
    repeat a doc_id the least text counts."""
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
