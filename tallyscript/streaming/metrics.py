"""Error rates over streams of pairs: the row expressions are stateless, so only the sums are state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.distance import token_distance
from ..plans.config import PipelineKey, Pipelines, load_config, strings
from ..plans.registry import ratio


def word_errors(pairs: DataFrame, pipelines: Pipelines | None = None, key: PipelineKey = PipelineKey()) -> DataFrame:
    """The rows of a (streaming) DataFrame with ref and hyp, and num_edits and ref_length besides."""
    pipelines = pipelines or Pipelines.of(load_config())
    ref, hyp = (strings(pipelines, key, F.col(c)) for c in ("ref", "hyp"))
    return pairs.withColumns({"_ref": ref, "_hyp": hyp}).withColumns({"num_edits": token_distance(F.col("_ref"), F.col("_hyp")), "ref_length": F.size("_ref").cast("long")}).drop("_ref", "_hyp")


def running_wer(pairs: DataFrame, by: list[str] | None = None, **options) -> DataFrame:
    """num_edits, ref_length and value so far, of all rows or by columns; for output modes complete and update."""
    rows = word_errors(pairs, **options)
    out = rows.groupBy(*(by or [])).agg(F.sum("num_edits").alias("num_edits"), F.sum("ref_length").alias("ref_length"))
    return out.withColumn("value", ratio(F.col("num_edits"), F.col("ref_length"), F.col("num_edits").cast("double")))


def windowed_wer(pairs: DataFrame, time: str, length: str, late: str = "10 minutes", slide: str | None = None, **options) -> DataFrame:
    """The same by windows of event time; rows later than the watermark are left out."""
    rows = word_errors(pairs.withWatermark(time, late), **options)
    out = rows.groupBy(F.window(time, length, slide)).agg(F.sum("num_edits").alias("num_edits"), F.sum("ref_length").alias("ref_length"))
    return out.withColumn("value", ratio(F.col("num_edits"), F.col("ref_length"), F.col("num_edits").cast("double")))
