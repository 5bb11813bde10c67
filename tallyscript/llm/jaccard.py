"""N-gram Jaccard join (operator 9): exact self-join of documents by the Jaccard similarity of their word shingles.

Jaccard distance is a metric on finite sets, so pivots, Voronoi regions and the triangle inequality find all pairs
within the radius r = 1 - threshold:

* **Point location.** Unrelated texts are all at distance 1 of one another, so distances to a few sampled documents say
  nothing about most sets: each would lie in a tie between all regions. Sets are therefore told which pivots may be
  near by the parts of them that lie in hash classes: |A delta B| of a linked pair is at most D, so of D + 1 + j classes
  at least j + 1 hold equal parts. A set that shares no part with another has no link and is done. Classes that hold
  hardly anything are left out where a set has at most j of them, so unrelated texts don't meet in an empty part. Sizes
  of linked sets differ at most by the factor t; size bands overlap by that window.
* **Pivots.** Among the sets that share a part, the one of smallest print is a candidate. A set asks the candidate it
  shares most parts with, and the one that this leads to in a few steps of the same kind, so that a family has few
  pivots: the latter is its home pivot if their Jaccard distance is at most `COVER`, else the former if that one's is,
  else the set is a pivot itself.
* **Voronoi regions.** A pivot's region holds the sets whose home it is, up to the covering radius R of the farthest.
  Let x and y be linked and x's home be p. Then x and y share a part, so y learns of p from it, and by the triangle
  inequality d(y, p) <= R + r: sets within that window are replicated into the region, others are not.
* **Recursion.** A region of more than `region_rows` sets is cut into Voronoi regions of its own pivots; members whose
  distance to one is within 2 r of that to their nearest one are replicated there. Regions join recursively while that
  leaves fewer pairs; one whose texts are all near one another is compared in pairs of blocks of bounded size, each
  set being sent as its difference from the region's pivot, as |A delta B| is that of the differences.
* **Verification** is exact, on whole sets of 64-bit shingle hashes, in integers. A linked pair counts in the region of
  the smaller of its two home pivots alone. Sets are told apart by 128-bit prints.

Copies: equal sets are one class with a multiplicity, so they cost one comparison. Only the texts of sets that share a part
are shuffled, one for each class, and a few others that the sieve lets pass.

Nulls and empty texts have an empty set, link with nothing and are their own component. Rows that repeat a
doc_id are documents of their own and give a row each; so are rows without a doc_id, which link as any others do: the
component_id is the smallest id that isn't null, or null if there is none. Further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, dropped, local_roots, shuffle_partitions, stored, text_batches

_U = np.uint64
_MULS = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_VOCABULARY = 1 << 20
#: How far a set may be from its home pivot.
COVER = 0.5
#: Parts of fewer shingles are light.
LIGHT = 3
#: How many members of a pivot a task compares with it.
SALT_ROWS = 4096
#: A region whose own regions hold more than this share of its pairs doesn't shrink.
SHRINK = 0.5
#: The sieve of texts has at most two to this power words of 64 bits.
SIEVE_BITS = 20


class _Words(dict):
    """Word to 64-bit hash; forgets all when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _VOCABULARY:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = _Words()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _MULS[5]
    x = (x ^ (x >> _U(27))) * _MULS[6]
    return x ^ (x >> _U(31))


def shingles(text: str | None, k: int = 5) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's k-word shingles.

    Words are runs of characters other than ASCII white space, after A-Z are lower-cased; a text of fewer
    than k words, but one at least, has one shingle, the whole sequence.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, _U)
    h = np.fromiter(map(_words.__getitem__, words), _U, len(words))
    width = min(k, len(h))
    last = len(h) - width + 1
    s = np.full(last, _U(width), _U)
    for i in range(width):
        s = _mixed(s * _MULS[0] + h[i : i + last]) if width > 7 else s + h[i : i + last] * _MULS[i]
    s = _mixed(s)
    s.sort()
    return s[np.concatenate(([True], s[1:] != s[:-1]))]


class Bands:
    """Size bands: band k holds the set sizes from lows[k] to lows[k + 1] - 1."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den, self.lows, self.differ = num, den, [1], []

    def of(self, n: int) -> list[tuple[int, int]]:
        """(band, by how many shingles linked sets of it may differ) for each band that a set of n shingles belongs to."""
        while self.lows[-1] <= n:
            low = self.lows[-1]
            high = max(low + 1, low * self.den * self.den // (self.num * self.num))
            most = high - 1
            both = most + most * self.den // self.num
            self.lows.append(high)
            self.differ.append(both * (self.den - self.num) // (self.den + self.num))
        k = int(np.searchsorted(self.lows, n, side="right")) - 1
        found = [(k, self.differ[k])]
        if k and n * self.num <= (self.lows[k] - 1) * self.den:
            found.append((k - 1, self.differ[k - 1]))
        return found


def signatures(s: np.ndarray, bands: Bands) -> np.ndarray:
    """A key for each part of the set s, equal for equal parts of the same class and band."""
    keys = []
    for band, differ in bands.of(len(s)):
        spare = (differ + 1) // 8
        m = differ + 1 + spare
        sums = np.zeros(m, _U)
        own = (s % _U(m)).astype(np.int64)
        np.add.at(sums, own, _mixed(s + _MULS[1]))
        made = _mixed(sums + _MULS[2] * np.arange(m, dtype=_U) + _MULS[3] * np.array([band + 1], _U))
        heavy = np.bincount(own, minlength=m) >= LIGHT
        # Of spare + 1 equal parts at least one is heavy, unless both sets have more than `spare` light ones.
        keys.append(made[heavy] if m - heavy.sum() <= spare else made)
    return np.concatenate(keys) if keys else np.empty(0, _U)


def _print(s: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)])
    flat = np.concatenate(rows).view(np.int64) if rows else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def _scan(num: int, den: int, k: int):
    """Rows (doc_id, rid, text) to (doc_id, rid, n, hi, lo, keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(num, den), set()
        none = np.empty(0, _U)
        for b in text_batches(batches):
            sizes, high, low, keys = [], [], [], []
            for text in b.column(2).to_pylist():
                s = shingles(text, k)
                sizes.append(len(s))
                hi, lo = _print(s) if len(s) else (None, None)
                high.append(hi)
                low.append(lo)
                # Copies inside a task send their parts once.
                new = bool(len(s)) and (hi, lo) not in seen
                if new:
                    if len(seen) >= _VOCABULARY:
                        seen.clear()
                    seen.add((hi, lo))
                keys.append(signatures(s, bands) if new else none)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), _lists(keys)], ["doc_id", "rid", "n", "hi", "lo", "keys"])

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, lo) in order, to (lo, first, times): the smallest lo of the key, for keys of several. The keys at a
    partition's ends may go on in the next one, so their smallest is named even if it is alone."""

    def made(lo: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
        pairs, times = np.unique(np.stack((lo, first)), axis=1, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0], pa.int64()), pa.array(pairs[1], pa.int64()), pa.array(times, pa.int64())], ["lo", "first", "times"])

    key_now = first_now = None
    for b in batches:
        if not b.num_rows:
            continue
        key, lo = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
        new = np.concatenate(([key[0] != key_now], key[1:] != key[:-1]))
        if key_now is None:
            yield made(lo[:1], lo[:1])
        at = np.flatnonzero(new)
        first = np.repeat(lo[at], np.diff(np.append(at, len(lo))))
        if not new[0]:
            upto = at[0] if len(at) else len(lo)
            first = np.concatenate((np.full(upto, first_now), first))
        key_now, first_now = key[-1], first[-1]
        other = lo != first
        if other.any():
            yield made(lo[other], first[other])
    if key_now is not None:
        yield made(np.array([first_now]), np.array([first_now]))


def _nominees(scan: DataFrame) -> DataFrame:
    """(lo, m) of the sets that share a part with another one: m shares most parts with it of those that are smallest
    for some part, or is null."""
    spark = scan.sparkSession
    rows = scan.select(F.explode("keys").alias("key"), "lo")
    rows = rows.repartitionByRange(shuffle_partitions(spark), "key", "lo").sortWithinPartitions("key", "lo")
    met = rows.mapInArrow(_met, "lo long, first long, times long")
    per = met.groupBy("lo", "first").agg(F.sum("times").alias("times"))
    both = stored(per)
    other = F.when(F.col("first") != F.col("lo"), F.struct((-F.col("times")).alias("less"), F.col("first")))
    mine = both.select("lo", other.alias("m"))
    out = stored(mine.unionByName(both.select(F.col("first").alias("lo"), F.lit(None).cast("struct<less:long,first:long>").alias("m"))).groupBy("lo").agg(F.min("m").alias("m")).select("lo", "m.first"))
    dropped(both)
    return out.withColumnRenamed("first", "m")


def _texts(docs: DataFrame, rids: DataFrame) -> DataFrame:
    """(rid, text), once each, of the rows of docs whose rid is among rids, and of a few others: those whose first bits and
    last six are also one's of rids. A table of the bits in use, of bounded size, goes to all tasks; other texts stay
    where they are."""
    bits = min(SIEVE_BITS, max(1, rids.count().bit_length()))
    word = F.shiftrightunsigned("rid", 64 - bits).alias("word")
    one = F.expr("shiftleft(1L, cast(rid & 63 as int))")
    sieve = rids.groupBy(word).agg(F.bit_or(one).alias("ones"))
    near = docs.select("rid", "text", word).join(F.broadcast(sieve), "word").where(F.col("ones").bitwiseAND(one) != 0)
    return near.groupBy("rid").agg(F.collect_set("text").alias("texts")).select("rid", F.explode("texts").alias("text"))


def _sets(k: int):
    """Rows (node, hi, lo, mult, asks, text) to (node, mult, asks, items); rows whose text has another print are dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches):
            hi, lo = (b.column(i).to_pylist() for i in (1, 2))
            keep, out = [], []
            for i, text in enumerate(b.column(5).to_pylist()):
                s = shingles(text, k)
                if len(s) and _print(s) == (hi[i], lo[i]):
                    keep.append(i)
                    out.append(s.tobytes())
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(at) for i in (0, 3, 4)), pa.array(out, pa.binary())], ["node", "mult", "asks", "items"])

    return run


def _keys(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(num, den)
        for b in text_batches(batches):
            keys = [signatures(np.frombuffer(x, _U), bands) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(keys)], ["node", "keys"])

    return run


def _far(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 1 - both / (len(a) + len(b) - both)


def _within(items: bool):
    """Rows (p, salt, x, reach, home, mult, items) in order, each pivot's own (x null) before its members: the members
    whose distance to the pivot is within their reach, with the set or, for lack of use, without."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = pivot = None
        for b in text_batches(batches):
            p, salt, x, reach = (b.column(i).to_pylist() for i in range(4))
            keep, far = [], []
            for i, data in enumerate(b.column(6).to_pylist()):
                s = np.frombuffer(data, _U)
                if x[i] is None:
                    now, pivot = (p[i], salt[i]), s
                elif now == (p[i], salt[i]):
                    d = _far(s, pivot)
                    if d <= reach[i] + 1e-9:
                        keep.append(i)
                        far.append(d)
            at = pa.array(keep, pa.int64())
            rest = (4, 5, 6) if items else (4, 5)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(2).take(at), pa.array(far, pa.float64()), *(b.column(i).take(at) for i in rest)], ["p", "node", "far", "home", "mult", "items"][: 3 + len(rest)])

    return run


def requests(pairs: DataFrame) -> DataFrame:
    """pairs (p, x, reach, home) of pivots and sets, as rows (node, p, salt, x, reach, home) for each set that a task needs:
    the members of a pivot are spread over as many tasks as they take, and the pivot (x null) goes to each of these."""
    salts = F.ceil(F.col("n") / SALT_ROWS).cast("int")
    n = pairs.groupBy("p").agg(F.count("*").alias("n")).withColumn("salts", salts).drop("n")
    own = n.select(
        F.col("p").alias("node"), "p", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("x"),
        F.lit(0.0).alias("reach"), F.lit(None).cast("long").alias("home"),
    )
    rows = pairs.join(n, "p").withColumn("salt", F.pmod(F.xxhash64("x"), F.col("salts")).cast("int"))
    return own.unionByName(rows.withColumn("node", F.col("x")).select(*own.columns))


def measured(asked: DataFrame, items: bool) -> DataFrame:
    """Requests with mult and items of their sets, as far as the distance is within the reach: p, node, far, home, mult and
    perhaps items."""
    rows = asked.select("p", "salt", "x", "reach", "home", "mult", "items").repartition("p", "salt").sortWithinPartitions("p", "salt", "x")
    return rows.mapInArrow(_within(items), "p long, node long, far double, home long, mult long" + (", items binary" if items else ""))


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """The matrix of intersection sizes of sorted sets of hashes.

    Items that lie in the same sets are one column with a weight, so near copies need few columns.
    """
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    starts = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
    tags = _mixed(np.arange(1, m + 1, dtype=_U) * _MULS[0])
    pattern = np.add.reduceat(tags[owner], starts)
    counts = np.diff(np.append(starts, len(flat)))
    shared = counts > 1
    kinds, at, weight = np.unique(pattern[shared], return_index=True, return_counts=True)
    total = np.zeros((m, m))
    starts, counts = starts[shared][at], counts[shared][at]
    step = max(1, 8_000_000 // m)
    for i in range(0, len(kinds), step):
        s, c = starts[i : i + step], counts[i : i + step]
        col = np.repeat(np.arange(len(s)), c)
        row = owner[np.repeat(s - np.concatenate(([0], np.cumsum(c)[:-1])), c) + np.arange(c.sum())]
        a = np.zeros((m, len(s)))
        a[row, col] = 1
        total += (a * weight[i : i + step]) @ a.T
    total[np.arange(m), np.arange(m)] = [len(s) for s in sets]
    return total.astype(np.int64)


def _linked(inter: np.ndarray, n: np.ndarray, num: int, den: int) -> np.ndarray:
    link = den * inter >= num * (n[:, None] + n[None, :] - inter)
    np.fill_diagonal(link, False)
    return link


def _verify(num: int, den: int):
    """Streams rows ordered by (path, pair) and compares the sets of each group once."""
    radius = 1 - num / den

    def in_window(rows: list[dict]) -> list[dict]:
        """Without what the triangle inequality keeps out of the region, whose pivot is one of the rows."""
        pivot = next((np.frombuffer(r["items"], _U) for r in rows if r["node"] == r["path"][-1]), None)
        if pivot is None or rows[0]["reach"] is None:
            return rows
        return [r for r in rows if _far(np.frombuffer(r["items"], _U), pivot) <= r["reach"] + radius + 1e-9]

    def group(rows: list[dict]) -> list[tuple[int, int, int]]:
        rows = list({r["node"]: r for r in rows}.values())
        if len(rows) > 2:
            rows = in_window(rows)
        if len(rows) < 2:
            return []
        sets = [np.frombuffer(r["items"], _U) for r in rows]
        inter = intersections(sets)
        n = np.array([r["size"] for r in rows])
        if rows[0]["reach"] is None:  # differences from the pivot
            d = np.array([len(s) for s in sets])
            inter = (n[:, None] + n[None, :] - (d[:, None] + d[None, :] - 2 * inter)) // 2
        link = _linked(inter, n, num, den)
        if not link.any():
            return []
        counted = link.copy()
        path = np.array(rows[0]["path"], np.int64)
        home = np.array([r["homes"] for r in rows], np.int64)
        counted &= (np.minimum(home[:, None, :], home[None, :, :]) == path).all(2)
        if len(set(rows[0]["pair"])) == 2:
            block = np.array([r["block"] for r in rows])
            counted &= block[:, None] != block[None, :]
        add = counted @ np.array([r["mult"] for r in rows], np.int64)
        root = local_roots(*np.nonzero(np.triu(link)), len(rows))
        return [(r["node"], int(x), rows[t]["node"]) for r, x, t, any_ in zip(rows, add, root, link.any(1), strict=True) if any_]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for b in text_batches(batches):
            out = []
            for r in b.to_pylist():
                if held and (held[0]["path"], held[0]["pair"]) != (r["path"], r["pair"]):
                    out += group(held)
                    held = []
                held.append(r)
            yield _found(out)
        yield _found(group(held) if held else [])

    return run


def _found(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["node", "added", "root"])


def _assign(num: int, den: int):
    """Cogroup of some members and the pivots of a region: a row for each region of theirs into which a member goes.

    If x and y are within the radius, y is no farther from x's nearest pivot than from its own nearest one and twice
    the radius more. A little is added for rounding.
    """
    radius = 1 - num / den

    def run(members: pa.Table, pivots: pa.Table) -> pa.Table:
        nodes = members["node"].to_pylist()
        sets = [np.frombuffer(x, _U) for x in members["items"].to_pylist()]
        ps = sorted({r["node"]: np.frombuffer(r["items"], _U) for r in pivots.to_pylist()}.items())
        out: list[tuple[int, int, int]] = []
        if nodes and ps:
            far = np.array([[_far(s, p) for _, p in ps] for s in sets])
            nearest = far.argmin(1)
            for i, node in enumerate(nodes):
                out += [(node, ps[j][0], ps[nearest[i]][0]) for j in np.flatnonzero(far[i] <= far[i, nearest[i]] + 2 * radius + 1e-9)]
        path = [members["path"][0].as_py()] * len(out) if out else []
        return pa.Table.from_arrays([pa.array(path, pa.list_(pa.int64())), *(pa.array([r[i] for r in out], pa.int64()) for i in range(3))], ["path", "node", "into", "home"])

    return run


def _differences(members: pa.Table, pivot: pa.Table) -> pa.Table:
    """Some members of a region, each set as its difference from the pivot's."""
    p = np.frombuffer(pivot["items"][0].as_py(), _U) if pivot.num_rows else np.empty(0, _U)
    items = [np.setxor1d(np.frombuffer(x, _U), p, assume_unique=True).tobytes() for x in members["items"].to_pylist()]
    names = ["path", "homes", "node", "mult", "size", "n"]
    return pa.Table.from_arrays([*(members[c].cast(f.type) for c, f in zip(names, _DIFFERENCES)), pa.array(items, pa.binary())], schema=_DIFFERENCES)


_DIFFERENCES = pa.schema([("path", pa.list_(pa.int64())), ("homes", pa.list_(pa.int64())), ("node", pa.int64()), ("mult", pa.int64()), ("size", pa.int64()), ("n", pa.int32()), ("items", pa.binary())])


def _recursion(sets: DataFrame, num: int, den: int, region_rows: int, pivots: int) -> list[DataFrame]:
    """Regions (path, homes, node, mult, size, items) of any size, as groups that can each be compared at once."""
    one = F.array(F.lit(0), F.lit(0))
    plain = lambda df: df.select("path", one.alias("pair"), F.lit(0).alias("block"), "homes", "node", "mult", "size", F.lit(2.0).alias("reach"), "items")
    ready: list[DataFrame] = []
    while True:
        big = stored(sets.groupBy("path").agg(F.count("*").alias("rows")).where(F.col("rows") > region_rows))
        if not big.head(1):
            return [*ready, plain(sets)]
        ready.append(plain(sets.join(big, "path", "left_anti")))
        last = F.element_at("path", -1)
        salts = F.ceil(F.col("rows") / region_rows).cast("int")
        rest = sets.join(big, "path").withColumn("salt", F.pmod(F.xxhash64("node"), salts).cast("int"))
        share = F.pmod(F.xxhash64("node", F.size("path")), F.lit(1 << 30)) / float(1 << 30)
        each = F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt")
        chosen = stored(rest.where((share * F.col("rows") < pivots) | (F.col("node") == last)).select("path", each, "node", "items"))
        into = rest.select("path", "salt", "node", "items").groupBy("path", "salt").cogroup(chosen.groupBy("path", "salt"))
        into = stored(into.applyInArrow(_assign(num, den), "path array<long>, node long, into long, home long"))
        work = into.groupBy("path", "into").agg(F.count("*").alias("k")).groupBy("path").agg(F.sum(F.col("k") * F.col("k")).alias("work"))
        cut = stored(big.join(work, "path", "left").select("path", "rows", (F.col("work") <= SHRINK * F.col("rows") * F.col("rows")).alias("shrinks")))
        # Regions whose own regions would hold nearly all pairs again are compared in blocks.
        n = F.ceil(F.col("rows") / (region_rows // 2)).cast("int")
        stuck = sets.join(cut.where(F.expr("shrinks is not true")).drop("shrinks"), "path").withColumn("n", n).withColumn("salt", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
        center = stuck.where(F.col("node") == last).select("path", F.explode(F.expr("sequence(0, n - 1)")).alias("salt"), "items")
        near = stuck.select("path", "homes", "node", "mult", "size", "n", "salt", "items").groupBy("path", "salt").cogroup(stored(center).groupBy("path", "salt"))
        near = stored(near.applyInArrow(_differences, "path array<long>, homes array<long>, node long, mult long, size long, n int, items binary"))
        near = near.withColumn("block", F.pmod(F.xxhash64("node"), F.col("n")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, n - 1)")))
        pair = F.array(F.least("block", "other"), F.greatest("block", "other")).alias("pair")
        ready.append(near.select("path", pair, "block", "homes", "node", "mult", "size", F.lit(None).cast("double").alias("reach"), "items"))
        go = into.join(cut.where("shrinks").select("path"), "path")
        if not go.head(1):
            return ready
        sets = stored(go.join(sets, ["path", "node"]).select(F.concat("path", F.array("into")).alias("path"), F.concat("homes", F.array("home")).alias("homes"), "node", "mult", "size", "items"))


def _joined(docs: DataFrame, k: int, num: int, den: int, region_rows: int, pivots: int) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, rid, text): what the scan says of each row, and of each set hi, lo, n_similar and component."""
    radius = 1 - num / den
    keyed = stored(docs.mapInArrow(_scan(num, den, k), "doc_id long, rid long, n long, hi long, lo long, keys array<long>"))
    nominees = _nominees(keyed)
    scan = stored(keyed.drop("keys"))
    dropped(keyed)
    classes = scan.where("n > 0").groupBy("hi", "lo").agg(F.min("rid").alias("rid"), F.count("*").alias("mult"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()))
    chosen = stored(classes.join(nominees.select("lo"), "lo", "left_semi").select("rid", "node", "hi", "lo", "mult"))

    # Which candidates a set asks to be its home pivot.
    ids = chosen.select("node", "lo")
    up = nominees.where("m is not null")
    chain = up.withColumn("top", F.col("m"))
    for _ in range(3):  # eight steps up, towards the smallest print of a family
        chain = chain.join(chain.select(F.col("lo").alias("top"), F.col("top").alias("next")), "top", "left").select("lo", "m", F.coalesce("next", "top").alias("top"))
    asked = chain.select("lo", F.explode(F.array_distinct(F.array("top", "m"))).alias("asked"), "top")
    asked = asked.join(ids.withColumnRenamed("node", "x"), "lo").select("x", F.col("asked").alias("lo"), (F.col("asked") != F.col("top")).alias("second")).join(ids.withColumnRenamed("node", "p"), "lo").where("x <> p")
    asked = stored(asked.select("p", "x", F.lit(COVER).alias("reach"), F.col("second").cast("long").alias("home")))
    asks = requests(asked).groupBy("node").agg(F.collect_list(F.struct("p", "salt", "x", "reach", "home")).alias("asks"))

    # The sets, each with what is asked of it.
    needed = chosen.join(asks, "node", "left").select("rid", "node", "hi", "lo", "mult", "asks")
    texts = _texts(docs, chosen.select("rid")).join(needed, "rid").select("node", "hi", "lo", "mult", "asks", "text")
    sets = stored(texts.mapInArrow(_sets(k), "node long, mult long, asks array<struct<p:long,salt:int,x:long,reach:double,home:long>>, items binary"))
    for done in (nominees, asked):
        dropped(done)

    # Each set's home pivot.
    found = measured(sets.select(F.inline("asks"), "mult", "items"), False).groupBy("node").agg(F.min(F.struct(F.col("home").alias("second"), "far", "p")).alias("best"))
    homes = ids.select("node").join(found, "node", "left")
    homes = stored(homes.select("node", F.coalesce("best.p", "node").alias("home"), F.coalesce("best.far", F.lit(0.0)).alias("far")))
    reach = homes.groupBy("home").agg(F.max("far").alias("reach"))
    sets = sets.drop("asks")

    # Which regions a set may belong to: the homes of all sets that it shares a part with.
    parts = stored(sets.select("node", "items").mapInArrow(_keys(num, den), "node long, keys array<long>").select("node", F.explode("keys").alias("key")).join(homes.select("node", "home"), "node"))
    there = parts.select("key", "home").distinct()
    met = stored(parts.select("key", "node").join(there, "key").select("node", "home").distinct())
    dropped(parts)
    counts = met.groupBy("home").agg(F.count("*").alias("rows")).where("rows > 1")
    visits = stored(met.join(counts, "home").join(reach, "home").join(homes.select("node", F.col("home").alias("own")), "node"))
    dropped(met)
    size = (F.octet_length("items") / 8).cast("long").alias("size")
    small = visits.where(F.col("rows") <= region_rows).join(sets, "node").select(
        F.array("home").alias("path"), F.array(F.lit(0), F.lit(0)).alias("pair"), F.lit(0).alias("block"), F.array("own").alias("homes"), "node", "mult", size, "reach", "items"
    )
    large = visits.where(F.col("rows") > region_rows)
    every = small
    if large.head(1):
        asked = requests(large.select(F.col("home").alias("p"), F.col("node").alias("x"), (F.col("reach") + radius).alias("reach"), F.col("own").alias("home")))
        near = measured(asked.join(sets, "node"), True)
        near = stored(near.select(F.array("p").alias("path"), F.array("home").alias("homes"), "node", "mult", size, "items"))
        for r in _recursion(near, num, den, region_rows, pivots):
            every = every.unionByName(r)
    every = every.repartition("path", "pair").sortWithinPartitions("path", "pair")
    links = stored(every.mapInArrow(_verify(num, den), "node long, added long, root long"))
    for done in (chosen, sets, homes, visits):
        dropped(done)
    added = links.groupBy("node").agg(F.sum("added").alias("added"))
    groups = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = classes.join(added, "node", "left").join(groups, "node", "left")
    known = known.select("hi", "lo", (F.col("mult") - 1 + F.coalesce("added", F.lit(0))).alias("n_similar"), F.coalesce("component", "node").alias("component"))
    return scan, stored(known)


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and a number of the row, which depends on these two alone."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("rid"), "text")


def similar(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, k: int = 5, num: int = 90, den: int = 100, region_rows: int = 384, pivots: int = 16
) -> DataFrame:
    """For each document: n_shingles, n_similar (other documents linked directly, copies included) and
    component_id (the smallest id reachable by links, itself included). Two documents link when
    den * intersection >= num * union. `region_rows` bounds what a task compares at once."""
    scan, known = _joined(_numbered(docs, id_col, text_col), k, num, den, region_rows, pivots)
    rows = scan.join(known, ["hi", "lo"], "left")
    first = rows.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    own = F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    return rows.join(first, "component", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("n_similar", F.lit(0)).cast("long").alias("n_similar"), own)


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, k: int = 5, num: int = 90, den: int = 100, region_rows: int = 384, pivots: int = 16) -> DataFrame:
    """One document of each component, that with the smallest id (a null one, if there is no other); all columns stay,
    and so do all rows without words, which have no component."""
    rid = "rid"
    while rid.lower() in {c.lower() for c in docs.columns}:
        rid += "_"
    scan, known = _joined(_numbered(docs, id_col, text_col), k, num, den, region_rows, pivots)
    rows = scan.join(known, ["hi", "lo"]).select("component", "doc_id", "rid")
    least = rows.groupBy("component").agg(F.min("doc_id").alias("least"))
    best = rows.join(least, "component").where(F.equal_null(F.col("doc_id"), F.col("least"))).groupBy("component").agg(F.min("rid").alias("kept"))
    fate = rows.groupBy("component", "rid").agg(F.count("*").alias("n")).join(best, "component").where("rid <> kept or n > 1")
    fate = stored(fate.select(F.col("rid").alias(rid), (F.col("rid") == F.col("kept")).alias("again")))
    marked = docs.withColumn(rid, F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)))
    kept = marked.join(fate.select(rid), rid, "left_anti").select(*docs.columns)
    again = fate.where("again").select(rid)
    if not again.head(1):
        return kept
    return kept.unionByName(marked.join(again, rid, "left_semi").dropDuplicates([rid]).select(*docs.columns))
