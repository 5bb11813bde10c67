"""The training-data pipeline over `documents`: five stages, each over all that the one before it kept.

Each stage is a function of (spark, docs, sf_dir); run() writes what a stage gives as Parquet and reads it again for
the next, so a lost executor costs no more than the stage at work. The labels of the two classifiers are those of
the table `labels` in sf_dir.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscript.llm import jaccard, packing, pii, quality, toxicity
from tallyscript.llm.shared import stored
from tallyscript.llm.tables import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose likeliest grade is above 0."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.grades(model, F.col("text"))["grade"] == 0)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose quality score is below `quality.KEEP`."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.scores(model, F.col("text")) >= quality.KEEP)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones, that with the smallest doc_id."""
    return jaccard.distinct_documents(docs)


def redact_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by placeholders and n_chars as the texts are then."""
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("ngram_jaccard", drop_near_copies),
    ("pii", redact_personal),
    ("packing", pack_sequences),
]

#: The classifiers, the shingle hashes and the tokenizer have no SQL; the tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
