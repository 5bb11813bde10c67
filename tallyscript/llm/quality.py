"""Quality classifier (operator 7): positive-unlabelled learning with the non-negative unbiased risk.

* Trusted positives are training rows labelled 1. The unlabelled sample is drawn from all documents that aren't
  held out, whatever their label: the learner never sees a negative label.
* The class prior pi is estimated from these two samples alone: a first classifier tells positives from unlabelled
  texts, and over all thresholds of its score (fitted on one half of both samples, read on the other, and the reverse)
  the share of unlabelled texts above is at least pi times that of positives above. The least ratio of the two, with
  a margin for the error of both shares, bounds pi from above (best bin estimation); the mean of the halves is taken,
  times `PRIOR_MARGIN`, as the risk of overfitting starts where pi exceeds the truth.
* The risk is pi R+(f, 1) + max(0, Ru(f, 0) - pi R+(f, 0)) with the sigmoid loss; where the second term falls below
  zero, its gradient is turned round. f is linear in the text statistics below, each cut into quantile bins.
* The score is sigmoid(f): 0 to 1, higher for likelier quality 1. Features are of the text alone.

At most about `POSITIVES` and `UNLABELLED` rows are learnt from; all documents are scored, whole. Null and empty
texts have zero statistics and get their score as any text. Without positives or unlabelled rows every score is
0.5. Repeated rows and ids give a row each.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, learnable, sampled, with_texts
from .shared import beside, text_batches

POSITIVES = UNLABELLED = 8_000
PRIOR_MARGIN = 0.97
#: Where the statistics are cut: sixteenths, and finer at both ends, as bad texts are rare and lie there.
CUTS = (0.002, 0.005, 0.01, 0.02, 0.04, *(i / 16 for i in range(1, 16)), 0.96, 0.98, 0.99, 0.995, 0.998)
BINS = len(CUTS) + 1
STEPS = 400
L2 = 1e-4
KEEP = 0.3
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]+")
_LETTERS = re.compile(r"[^\W\d_]+")
_DIGITS = re.compile(r"[0-9]+")
STATISTICS = (
    "log_words", "word_length", "upper", "letters", "pipes", "exclamations", "symbols", "full_stops", "commas",
    "distinct_words", "top_word", "runs", "lines", "repeated_lines", "digits", "line_ends", "distinct_bigrams", "long_words",
)


def statistics(text: str | None) -> list[float]:
    """What a text looks like, in numbers that don't depend on its language."""
    words = text.split() if text else []
    n, m = len(text or ""), len(words)
    if not m:
        return [0.0] * len(STATISTICS)
    counts = Counter(words)
    lines = text.split("\n")
    full = [x for x in lines if x]
    pairs = list(zip(words, words[1:]))
    length = lambda pattern: sum(map(len, pattern.findall(text)))
    count = text.count
    return [
        math.log1p(m),
        n / m,
        length(_UPPER) / n,
        length(_LETTERS) / n,
        count("|") / m,
        count("!") / m,
        sum(map(count, "%$#&*")) / m,
        count(".") / m,
        count(",") / m,
        len(counts) / m,
        max(counts.values()) / m,
        sum(a == b for a, b in pairs) / m,
        len(lines) / m,
        1 - len(set(lines)) / len(lines),
        length(_DIGITS) / n,
        sum(x[-1] in ".!?:" for x in full) / max(1, len(full)),
        len(set(pairs)) / m,
        sum(len(w) > 12 for w in words) / m,
    ]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def non_negative_risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float, *, steps: int = STEPS, l2: float = L2) -> np.ndarray:
    """Weights of the linear f that minimises the non-negative risk; the rows are column numbers of their features."""
    width = int(max(positive.max(), unlabelled.max())) + 1
    w = np.zeros(width)
    m, v = np.zeros(width), np.zeros(width)
    for step in range(1, steps + 1):
        p, u = _sigmoid(w[positive].sum(1)), _sigmoid(w[unlabelled].sum(1))
        negative = u.mean() - prior * p.mean()
        dp, du = p * (1 - p) / len(p), u * (1 - u) / len(u)
        cp, cu = (-2 * prior * dp, du) if negative >= 0 else (prior * dp, -du)
        g = l2 * w
        for part, c in ((positive, cp), (unlabelled, cu)):
            g = g + np.bincount(part.ravel(), np.repeat(c, part.shape[1]), width)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def separating(positive: np.ndarray, unlabelled: np.ndarray, width: int, *, steps: int = 200, l2: float = 1e-3) -> np.ndarray:
    """Weights of the linear logistic regression of positives against unlabelled rows, both weighing the same."""
    w, m, v = np.zeros(width), np.zeros(width), np.zeros(width)
    for step in range(1, steps + 1):
        p, u = _sigmoid(w[positive].sum(1)), _sigmoid(w[unlabelled].sum(1))
        g = l2 * w
        for part, c in ((positive, (p - 1) / len(p)), (unlabelled, u / len(u))):
            g = g + np.bincount(part.ravel(), np.repeat(c, part.shape[1]), width)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def prior_of(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among unlabelled rows, estimated from the features of both samples."""
    width = int(max(positive.max(), unlabelled.max())) + 1
    found = []
    for half in (0, 1):
        w = separating(positive[half::2], unlabelled[half::2], width)
        p, u = (np.sort(w[x[1 - half :: 2]].sum(1)) for x in (positive, unlabelled))
        if not len(p) or not len(u):
            continue
        cuts = np.unique(np.concatenate((p, u)))
        above_p, above_u = (1 - np.searchsorted(x, cuts, side="left") / len(x) for x in (p, u))
        slack = np.sqrt(np.log(40.0) / 2) * (1 / np.sqrt(len(p)) + 1 / np.sqrt(len(u)))
        good = above_p > 0
        at = np.argmin((above_u[good] + slack) / above_p[good])
        found.append(min(1.0, above_u[good][at] / above_p[good][at]))
    return float(np.mean(found)) if found else 0.5


@dataclass
class Model:
    edges: list[np.ndarray]
    weights: np.ndarray
    prior: float

    def columns(self, x: np.ndarray) -> np.ndarray:
        """The features of rows of statistics: one bin of each, and a constant."""
        at = [np.full(len(x), j * (BINS + 1)) + np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)]
        return np.stack([*at, np.full(len(x), len(self.edges) * (BINS + 1))], axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.weights[self.columns(x)].sum(1))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in text_batches(batches):
        x = [statistics(t) for t in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64()))], ["x"])


def _matrix(docs: DataFrame) -> np.ndarray:
    table = docs.select("text").mapInArrow(_measure, "x array<double>").toArrow()
    return table["x"].combine_chunks().flatten().to_numpy().reshape(-1, len(STATISTICS))


def fit(docs: DataFrame, labels: DataFrame, *, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model | None:
    """The model of labels (doc_id, quality), or None where there is nothing to learn from."""
    train = learnable(labels, "quality")
    if not train.where("label = 1").head(1):
        return None
    p = _matrix(with_texts(docs, sampled(train.where("label = 1"), positives, 71)))
    every = docs.select("doc_id", "text").where(~held_out(F.col("doc_id")))
    u = _matrix(sampled(every, unlabelled, 72))
    if not len(p) or not len(u):
        return None
    both = np.concatenate((p, u))
    edges = [np.unique(np.quantile(both[:, j], CUTS)) for j in range(both.shape[1])]
    model = Model(edges, np.zeros(0), 0.0)
    model.weights = np.zeros(len(edges) * (BINS + 1) + 1)
    positive, unlabelled_ = model.columns(p), model.columns(u)
    model.prior = PRIOR_MARGIN * prior_of(positive, unlabelled_)
    w = non_negative_risk(positive, unlabelled_, model.prior)
    model.weights[: len(w)] = w
    return model


def score_column(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of docs with a column `score`; one that is there becomes `score_input`."""
    docs = beside(docs, "score")
    return docs.withColumn("score", scores(model, F.col(text_col)))


def scores(model: Model | None, text: Column) -> Column:
    """The score of a text."""
    if model is None:
        return F.lit(0.5)
    from pyspark.sql.pandas.functions import arrow_udf

    @arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        x = np.array([statistics(t) for t in texts.to_pylist()]).reshape(-1, len(STATISTICS))
        return pa.array(model.scores(x))

    return scored(text)


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, by a model of the labels."""
    out = score_column(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))
