"""Toxicity (operator 4): cumulative-link ordinal regression over sparse word features.

Grades are 0 (not toxic) to 3 (severe). One weight vector w is shared by all thresholds:
P(grade >= k) = sigmoid(w.x - theta_k) with theta_1 < theta_2 < theta_3, and the expected severity is the sum of the
three. A document's x is the set of its words, each counted once, however long the text.

Labels say only toxic or not. A toxic training row's grade is 1, 2 or 3 as it holds at most one, two or three, or
more of the *marked* words, those whose log odds of being in a toxic text are `MARKED` standard errors above zero.
Features are the words that are `FEATURE` standard errors above it.

The model is fitted on the driver from at most about `SAMPLE` labelled rows, none of the held-out fold. Their words are
counted on the executors; the driver gets the `MOST_FEATURES` likeliest features at most, and for each row which of them
it has. All documents are scored, whole. Null and empty texts have no features: severity is what the thresholds alone
give. Without training rows of both kinds severity is 0 and nothing is rejected. Repeated rows and ids give a row each.
Columns of the input that have a result's name stay, with `_input` behind it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labelled import learnable, sampled, with_texts
from .shared import beside, dropped, stored, text_batches

SAMPLE = 16_000
GRADES = 3
FEATURE, MARKED = 3.0, 4.5
MOST_FEATURES = 4096
L2 = 1e-4
STEPS = 400
_WORD = re.compile(r"[^\W\d_]+")
_KEPT = 1 << 19


def words(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def word_id(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) - (1 << 63)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in text_batches(batches):
        ids = [[word_id(w) for w in sorted(words(t))] for t in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(1), pa.array(ids, pa.list_(pa.int64()))], ["label", "words"])


def _known(vocabulary: np.ndarray):
    """Rows (label, words) with the numbers of those words that the sorted vocabulary has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for words_ in b.column(1).to_pylist():
                ids = np.array(words_, np.int64)
                at = np.searchsorted(vocabulary, ids)
                there = at < len(vocabulary)
                out.append(at[there][vocabulary[at[there]] == ids[there]].tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int32()))], ["label", "features"])

    return run


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    """Weights by word id and the thresholds between the grades."""

    weights: dict[int, float]
    thresholds: tuple[float, ...]

    def at_least(self, z: float) -> list[float]:
        """P(grade >= 1), P(grade >= 2), ... for a document whose weights sum to z."""
        return [float(_sigmoid(np.float64(z - t))) for t in self.thresholds]


def fit_ordinal(starts: np.ndarray, columns: np.ndarray, grade: np.ndarray, width: int, *, grades: int = GRADES, l2: float = L2, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of the penalised maximum likelihood, by Adam over the whole sample.

    Row i has the columns columns[starts[i]:starts[i + 1]]. Thresholds are a first one plus exponentials, so they
    stay in order.
    """
    n = len(grade)
    row = np.repeat(np.arange(n), np.diff(starts))
    share = np.array([max((grade >= k).mean(), 0.5 / n) for k in range(1, grades + 1)])
    logit = -np.log(share / (1 - np.minimum(share, 1 - 0.5 / n)))
    params = np.concatenate((np.zeros(width), [logit[0]], np.log(np.maximum(np.diff(logit), 0.1))))
    m, v = np.zeros_like(params), np.zeros_like(params)
    at = np.arange(n)
    for step in range(1, steps + 1):
        w, first, gaps = params[:width], params[width], np.exp(params[width + 1 :])
        theta = first + np.concatenate(([0.0], np.cumsum(gaps)))
        z = np.bincount(row, w[columns], n)
        above = np.concatenate((np.ones((n, 1)), _sigmoid(z[:, None] - theta[None, :]), np.zeros((n, 1))), axis=1)
        p = np.maximum(above[at, grade] - above[at, grade + 1], 1e-12)
        slope = above * (1 - above)
        # d(-log p): the two thresholds that enclose the grade pull in opposite directions.
        low, high = slope[at, grade] / p / n, slope[at, grade + 1] / p / n
        dz = high - low
        dt = np.zeros(grades)
        np.add.at(dt, grade[grade > 0] - 1, low[grade > 0])
        np.add.at(dt, grade[grade < grades], -high[grade < grades])
        g = np.concatenate((np.bincount(columns, dz[row], width) + l2 * w, [dt.sum()], gaps * np.cumsum(dt[::-1])[::-1][1:]))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        params = params - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return params[:width], params[width] + np.concatenate(([0.0], np.cumsum(np.exp(params[width + 1 :]))))


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> Model | None:
    """The model of labels (doc_id, toxic), or None where there is nothing to learn from."""
    chosen = sampled(learnable(labels, "toxic"), sample, 4)
    rows = stored(with_texts(docs, chosen).select("text", "label").mapInArrow(_features, "label int, words array<long>"))
    n1, n0 = (int(x or 0) for x in rows.agg(F.sum("label"), F.sum(1 - F.col("label"))).first())
    if not n1 or not n0:
        dropped(rows)
        return None
    counted = rows.select("label", F.explode("words").alias("word")).groupBy("word").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))
    odds = F.log((F.col("toxic") + 0.5) / (n1 + 1)) - F.log((F.col("clean") + 0.5) / (n0 + 1))
    above = odds / F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    best = counted.select("word", above.alias("above")).where(F.col("above") >= FEATURE).orderBy(F.desc("above"), "word").limit(MOST_FEATURES).toArrow()
    vocabulary = np.sort(best["word"].to_numpy())
    marked = np.isin(vocabulary, best["word"].to_numpy()[best["above"].to_numpy() >= MARKED])
    table = rows.mapInArrow(_known(vocabulary), "label int, features array<int>").toArrow()
    dropped(rows)
    label = table["label"].to_numpy()
    lists = table["features"].combine_chunks()
    starts, column = lists.offsets.to_numpy().astype(np.int64), lists.flatten().to_numpy()
    row = np.repeat(np.arange(len(label)), np.diff(starts))
    n_marked = np.bincount(row, marked[column], len(label)).astype(int)
    grade = np.where(label == 0, 0, np.where(n_marked <= 1, 1, np.where(n_marked <= 3, 2, 3)))
    w, theta = fit_ordinal(starts, column, grade, len(vocabulary))
    return Model(dict(zip(vocabulary.tolist(), w.tolist(), strict=True)), tuple(theta.tolist()))


def _scorer(model: Model):
    class Weights(dict):
        """Word to weight, as far as the words are remembered."""

        def __missing__(self, word: str) -> float:
            if len(self) >= _KEPT:
                self.clear()
            value = self[word] = model.weights.get(word_id(word), 0.0)
            return value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = Weights().__getitem__
        for b in text_batches(batches):
            z = [sum(x for x in map(weight, words(t)) if x) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(z, pa.float64())], ["z"])

    return run


def grades(model: Model | None, text: Column) -> Column:
    """struct<severity, grade> of a text."""
    if model is None:
        return F.struct(F.lit(0.0).alias("severity"), F.lit(0).alias("grade"))
    from pyspark.sql.pandas.functions import arrow_udf

    score = _scorer(model)
    thresholds = model.thresholds

    @arrow_udf("struct<severity:double,grade:int>")
    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            z = np.concatenate([b.column(0).to_numpy() for b in score(iter([pa.RecordBatch.from_arrays([column], ["text"])]))] or [np.empty(0)])
            above = _sigmoid(z[:, None] - np.array(thresholds)[None, :])
            yield pa.StructArray.from_arrays([pa.array(above.sum(1)), pa.array((above >= 0.5).sum(1).astype(np.int32))], ["severity", "grade"])

    return scored(text)


def severity(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of docs with severity (0 to GRADES), grade (the largest k with P(grade >= k) >= 1/2) and rejected (grade > 0)."""
    docs = beside(docs, "severity", "grade", "rejected")
    made = grades(model, F.col(text_col))
    out = docs.select(F.struct(F.col("*")).alias("row"), made.alias("made"))
    return out.select("row.*", "made.severity", "made.grade", (F.col("made.grade") > 0).alias("rejected"))


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, severity, grade and rejected of every document, by a model of the labels."""
    return severity(docs.select("doc_id", "text"), fit(docs, labels)).select("doc_id", "severity", "grade", "rejected")
