"""Embedding near-duplicates (operator 8): sorted projection passes, verified in windows, united across passes.

* Equal vectors with equal labels are one class with a multiplicity, so copies cost one comparison.
* A class has a print of 256 random-hyperplane bits. Each pass orders the classes of a label lexicographically by
  the print, read from another place on, so the hashes that count first are new ones; after `PASSES` passes, all bits
  are shuffled. A label of more classes has more passes (`passes_for`), so that a pair's chance to be missed stays.
* Rows carry their vectors. Each class is held against its `WINDOW` predecessors: where the Hamming distance of the
  prints allows for a link (a pair at the threshold lies nearly five standard deviations inside the bound), the cosine
  is computed in double precision. A window doubles, up to `WIDEST` times `WINDOW`, while at least the share `DENSE` of
  its last half are links, so the work follows the number of links in groups that are larger than the window.
* Pairs on both sides of a partition's border are compared by a second, small job over the `WINDOW` rows at its ends.
* The verified pairs of all passes, each once, give the links; their connected components are the groups. A pair that
  no pass brings into a window is missed (recall is measured in the tests); none is reported that isn't a link.

Vectors that are null, zero or hold null or non-finite components, or that have no label, link with nothing. Rows
that repeat a vec_id, or have none, are vectors of their own and give a row each; the component_id is the smallest id
that isn't null. Vectors of different lengths never link, and may be mixed. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import components, dropped, shuffle_partitions, stored
from .vectors import matrices, stacked

BITS = 256
PASSES = 12
WINDOW = 64
WIDEST = 16
DENSE = 0.25
#: The share of pairs at the threshold that the passes may miss, were their orders independent.
MISS = 0.001
_SEEN = 1 << 18


def bound(threshold: float) -> int:
    """The Hamming distance of prints below which nearly all pairs of at least this cosine lie."""
    p = float(np.arccos(np.clip(threshold, -1, 1)) / np.pi)
    return int(np.ceil(BITS * p + 4.9 * np.sqrt(BITS * p * (1 - p))))


def passes_for(classes: Column, threshold: float, least: int, window: int) -> Column:
    """How many passes a label of so many classes needs for its pairs at the threshold.

    A bit agrees for such a pair with the chance 1 - angle / pi. The pair comes within the window about when it agrees
    in as many first bits as leave `window` classes together, so a pass misses it with the chance 1 - agree ** bits.
    """
    agree = 1 - float(np.arccos(np.clip(threshold, -1, 1)) / np.pi)
    if not 0 < agree < 1:
        return F.lit(least)
    found = F.pow(F.lit(agree), F.log2(classes / F.lit(float(window))))
    needed = F.ceil(F.lit(float(np.log(MISS))) / F.log1p(-found)).cast("int")
    return F.when(classes <= window + 1, F.lit(least)).otherwise(F.greatest(F.lit(least), needed))


def bit_order(k: int, passes: int) -> np.ndarray:
    """The order in which pass k reads the bits: each `passes` passes begin at places of their own in one order of all."""
    turn, place = divmod(k, passes)
    bits = np.random.default_rng([20_241, turn]).permutation(BITS) if turn else np.arange(BITS)
    return np.roll(bits, -place * (BITS // passes))


def planes(width: int) -> np.ndarray:
    return np.random.default_rng(20_241).standard_normal((width, BITS))


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, vector) with hi and lo, the 128-bit hash of label and vector, and the width, print and vector of
    those that the task meets for the first time; all null for unusable rows."""
    known: dict[int, np.ndarray] = {}
    seen: set[tuple[int, int]] = set()
    for b in batches:
        n = b.num_rows
        hi, lo, width, bits, vector = ([None] * n for _ in range(5))
        labels = b.column(1).to_pylist()
        for rows, v in matrices(b.column(2)):
            p = known.setdefault(v.shape[1], planes(v.shape[1]))
            prints = np.packbits(v @ p > 0, axis=1)
            for i, x, own in zip(rows.tolist(), v + 0.0, prints, strict=True):
                if labels[i] is None:
                    continue
                data = x.tobytes()
                d = xxhash.xxh3_128_digest(data + labels[i].encode("utf-8", "surrogatepass"))
                key = int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)
                hi[i], lo[i], width[i] = *key, v.shape[1]
                if key not in seen:
                    if len(seen) >= _SEEN:
                        seen.clear()
                    seen.add(key)
                    bits[i], vector[i] = own.tobytes(), data
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), *(pa.array(x, pa.int64()) for x in (hi, lo, width)), pa.array(bits, pa.binary()), pa.array(vector, pa.binary())],
            ["vec_id", "label", "hi", "lo", "width", "bits", "vector"],
        )


_ROW = ["pass", "label", "width", "turned", "node", "vector"]


def _turned(least: int):
    """A row per class and pass: the print in that pass's order of bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders: list[np.ndarray] = []
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                label, width, bits, node, vector = (part.column(i) for i in range(5))
                wanted = part.column(5).to_numpy(zero_copy_only=False)
                bits = np.unpackbits(np.frombuffer(b"".join(bits.to_pylist()), np.uint8).reshape(len(wanted), -1), axis=1)
                orders += [bit_order(k, least) for k in range(len(orders), wanted.max())]
                for k in range(wanted.max()):
                    rows = np.flatnonzero(wanted > k)
                    turned = np.packbits(bits[rows][:, orders[k]], axis=1)
                    i = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), k, np.int32)), label.take(i), width.take(i), pa.array([x.tobytes() for x in turned], pa.binary()), node.take(i), vector.take(i)], _ROW)

    return run


class Rows:
    """Neighbouring rows of a pass's order."""

    def __init__(self, rows: list[tuple]) -> None:
        self.rows = rows
        self.group = np.array([0, *np.cumsum([x[:3] != y[:3] for x, y in zip(rows, rows[1:])])])
        self.words = np.frombuffer(b"".join(r[3] for r in rows), np.uint64).reshape(len(rows), -1)
        self.node = np.array([r[4] for r in rows], np.int64)
        self.v = stacked([r[5] for r in rows])
        self.square = (self.v * self.v).sum(1)

    def links(self, start: int, window: int, widest: int, most: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """The links between each row from `start` on and those before it, within its window."""
        a, b = [self.node[:0]], [self.node[:0]]
        active = np.arange(start, len(self.rows))
        low, high = 1, window
        while len(active) and low <= widest:
            hits = np.zeros(len(self.rows), np.int32)
            going = active
            for off in range(low, high + 1):
                going = going[going >= off]
                going = going[self.group[going] == self.group[going - off]]
                if not len(going):
                    break
                x = going[np.bitwise_count(self.words[going] ^ self.words[going - off]).sum(1) <= most]
                if len(x):
                    cosine = np.einsum("ij,ij->i", self.v[x], self.v[x - off]) / np.sqrt(self.square[x] * self.square[x - off])
                    x = x[(cosine >= threshold) & (self.node[x] != self.node[x - off])]
                    a.append(self.node[x])
                    b.append(self.node[x - off])
                    hits[x] += 1
            active = active[hits[active] >= DENSE * (high + 1 - low)]
            low, high = high + 1, min(2 * high, widest)
        x, y = np.concatenate(a), np.concatenate(b)
        pair = np.unique(np.stack((np.minimum(x, y), np.maximum(x, y))), axis=1)
        return pair[0], pair[1]


_OUT = pa.schema(
    [("a", pa.int64()), ("b", pa.int64()), ("border", pa.int64()), ("place", pa.int64()), ("pass", pa.int32()), ("label", pa.string()), ("width", pa.int64()), ("turned", pa.binary()), ("node", pa.int64()), ("vector", pa.binary())]
)
_OUT_DDL = "a long, b long, border long, place long, pass int, label string, width long, turned binary, node long, vector binary"


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *(pa.nulls(len(a), f.type) for f in list(_OUT)[2:])], schema=_OUT)


def _windows(window: int, widest: int, most: int, threshold: float):
    """Rows in order to their links (a, b), and the rows at both ends with the number of the border they lie at; their
    places count from it, those before it being negative."""

    def ends(rows: list[tuple], border: int, first: int) -> pa.RecordBatch:
        full = [(None, None, border, first + i, *r) for i, r in enumerate(rows)]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in full], f.type) for i, f in enumerate(_OUT)], schema=_OUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        kept: list[tuple] = []
        seen = 0
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                new = list(zip(*(c.to_pylist() for c in b.slice(at, 4096).columns), strict=True))
                if seen < window:
                    yield ends(new[: window - seen], part - 1, seen)
                seen += len(new)
                rows = Rows(kept + new)
                yield _pairs(*rows.links(len(kept), window, widest, most, threshold))
                kept = rows.rows[-widest:]
        if kept:
            last = kept[-window:]
            yield ends(last, part, -len(last))

    return run


def _borders(window: int, most: int, threshold: float):
    """The ends of partitions ordered by border and place: the links within a window that lie on both sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def found() -> pa.RecordBatch:
            after = next((i for i, r in enumerate(held) if r[1] >= 0), len(held))
            none = np.empty(0, np.int64)
            a, b = Rows([r[2:] for r in held]).links(after, window, window, most, threshold) if 0 < after < len(held) else (none, none)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and held[0][0] != r[0]:
                    yield found()
                    held.clear()
                held.append(r)
        if held:
            yield found()

    return run


def _links(classes: DataFrame, passes: int, window: int, widest: int, threshold: float, parts: int | None) -> DataFrame:
    """(a, b), a < b, of all links found between classes, each once; stored."""
    spark = classes.sparkSession
    wanted = classes.groupBy("label").count().select("label", passes_for(F.col("count"), threshold, passes, window).alias("passes"))
    rows = classes.join(wanted, "label").select("label", "width", "bits", "node", "vector", "passes")
    turned = rows.mapInArrow(_turned(passes), "pass int, label string, width long, turned binary, node long, vector binary")
    # Partitions are longer than a window, so that a window spans one border at most.
    parts = parts or max(1, min(shuffle_partitions(spark), passes * classes.count() // (16 * window)))
    order = ("pass", "label", "width", "turned", "node")
    ordered = turned.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    whole = stored(ordered.mapInArrow(_windows(window, widest, bound(threshold), threshold), _OUT_DDL))
    inside = whole.where("a is not null").select("a", "b")
    ends = whole.where("border is not null").select("border", "place", *_ROW)
    over = ends.repartition("border").sortWithinPartitions("border", "place").mapInArrow(_borders(window, bound(threshold), threshold), "a long, b long")
    out = stored(inside.unionByName(over).distinct())
    dropped(whole)
    return out


def near_duplicates(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, passes: int = PASSES, window: int = WINDOW, widest: int | None = None, parts: int | None = None
) -> DataFrame:
    """A row per vector: vec_id, n_links, component_id (the smallest id reachable) and kept.

    `passes` is the least number of passes; labels with many classes have more. Labels are compared as strings. `parts`
    is the number of partitions of the sorted rows, by default as many as the session's shuffles have."""
    columns = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    prints = stored(columns.mapInArrow(_prints, "vec_id long, label string, hi long, lo long, width long, bits binary, vector binary"))
    first = lambda c: F.first(c, ignorenulls=True).alias(c)
    classes = prints.where("hi is not null").groupBy("hi", "lo").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult"), first("label"), first("width"), first("bits"), first("vector"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()))
    links = _links(classes, passes, window, widest or WIDEST * window, threshold, parts)
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    added = both.join(classes.select(F.col("node").alias("b"), "mult"), "b").groupBy("a").agg(F.sum("mult").alias("added")).withColumnRenamed("a", "node")
    groups = components(links).select("node", "component")
    known = classes.select("hi", "lo", "node", "rep", "mult").join(added, "node", "left").join(groups, "node", "left")
    known = known.select("hi", "lo", "rep", (F.col("mult") - 1 + F.coalesce("added", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component"))
    least = known.groupBy("component").agg(F.min("rep").alias("component_id"))
    known = known.join(least, "component").select("hi", "lo", "n_links", "component_id")
    out = prints.select("vec_id", "hi", "lo").join(known, ["hi", "lo"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.equal_null(F.col("vec_id"), component).alias("kept"))
