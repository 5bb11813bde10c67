"""Permutation index (operator 1): nearest neighbours by the order in which vectors see their pivots.

* `PIVOTS` pivots are the different vectors of smallest hash, so the sample is bounded and the same on every run, and
  a vector that many rows hold is one pivot at most: pivots that are equal would count several times in the footrule.
* A vector is represented by the list of its `NEAREST` nearest pivots, in order. Blocks of some `BLOCK` rows are indexed
  and stored once: a block posts each of its different vectors in the inverted files of the pivots of its list alone,
  with their places there. All rows are indexed; equal ones share a posting, which holds the smallest ids of them, as
  many as an answer can need.
* The lists of the queries are made and stored once. A query opens the files of the pivots in its own list, and no
  other; what they hold gives the footrule distance of lists of that length, a pivot that a list lacks having the
  place after its last: it is a constant less twice the sum of NEAREST - max(own place, posted place) over the shared
  pivots. The share `RERANK` of each block's different vectors that is nearest by it, with all that tie with the last
  of them, is reranked by the exact Euclidean distance in double precision.

The queries are a stated set; each task streams them in chunks past its stored blocks and keeps the k best per query and
block, so rows are never shuffled and the shuffle holds k rows per query and block. Since the reranked part is a share
of the vectors, recall doesn't fall as the table grows; its cost is linear in the rows for each query.

Vectors that are null, zero or hold null or non-finite components, and rows without an id, take no part, as query or
candidate. Ties in distance go to the smaller id. Rows that repeat an id are queries each and candidates each: only
the query's own row is left out. Vectors of different lengths have an index each. Fewer than k candidates give fewer
rows. Further columns are ignored, but for `is_query`, which may name any.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import shared_dir, stored
from .vectors import matrices

PIVOTS, NEAREST = 256, 64
RERANK = 0.1
BLOCK = 8192
QUERY_CHUNK = 2048


def lists(v: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """For each vector the numbers of its nearest pivots, in order."""
    d = (pivots**2).sum(1)[None, :] - 2 * (v @ pivots.T)
    nearest = min(nearest, len(pivots))
    some = np.sort(np.argpartition(d, nearest - 1, axis=1)[:, :nearest], axis=1)
    order = np.argsort(np.take_along_axis(d, some, 1), axis=1, kind="stable")
    return np.take_along_axis(some, order, 1).astype(np.uint8)


class Block:
    """The inverted files of a block of rows, and the ids of each of its different vectors."""

    PARTS = (("ids", np.int64), ("uids", np.int64), ("size", np.int32), ("v", np.float64), ("ends", np.int32), ("rows", np.uint16), ("places", np.uint8))

    @classmethod
    def made(cls, ids: np.ndarray, uids: np.ndarray, v: np.ndarray, pivots: np.ndarray, nearest: int, k: int) -> Block:
        own = cls()
        v = np.ascontiguousarray(v + 0.0)
        _, first, of = np.unique(v.view(np.dtype((np.void, v.itemsize * v.shape[1]))).ravel(), return_index=True, return_inverse=True)
        order = np.lexsort((uids, ids, of))
        size = np.bincount(of)
        kept = np.arange(len(ids)) - (np.cumsum(size) - size)[of[order]] <= k  # one of them may be the query's own row
        own.ids, own.uids = ids[order][kept], uids[order][kept]
        own.size = np.minimum(size, k + 1).astype(np.int32)
        own.v = v[first]
        listed = lists(own.v, pivots, nearest)
        pivot = listed.ravel()
        by = np.argsort(pivot, kind="stable")
        own.rows = np.repeat(np.arange(len(own.v), dtype=np.uint16), listed.shape[1])[by]
        own.places = np.tile(np.arange(listed.shape[1], dtype=np.uint8), len(own.v))[by]
        own.ends = np.concatenate(([0], np.cumsum(np.bincount(pivot, minlength=len(pivots))))).astype(np.int32)
        return own

    def stored(self) -> list[bytes]:
        return [np.ascontiguousarray(getattr(self, n), t).tobytes() for n, t in self.PARTS]

    @classmethod
    def read(cls, parts: list[bytes], width: int) -> Block:
        own = cls()
        for (name, kind), data in zip(cls.PARTS, parts, strict=True):
            setattr(own, name, np.frombuffer(data, kind))
        own.v = own.v.reshape(-1, width)
        return own

    def near(self, query: np.ndarray) -> np.ndarray:
        """What the files of the query's pivots say: for each vector by how much its footrule distance is below the largest, halved."""
        total = np.zeros(len(self.v), np.uint16)
        for place, p in enumerate(query.tolist()):
            a, b = self.ends[p], self.ends[p + 1]
            total[self.rows[a:b]] += (len(query) - np.maximum(self.places[a:b], place)).astype(np.uint16)
        return total

    def nearest(self, own: int, q: np.ndarray, query: np.ndarray, k: int, share: float) -> tuple[np.ndarray, np.ndarray, int]:
        """(ids, distances) of the k nearest rows found but the query's own, and how many vectors were compared."""
        n = max(3 * k, int(np.ceil(share * len(self.v))))
        if n < len(self.v):
            near = self.near(query)
            close = np.flatnonzero(near >= np.partition(near, len(near) - n)[len(near) - n])
        else:
            close = np.arange(len(self.v))
        compared = len(close)
        d = np.sqrt(((self.v[close] - q) ** 2).sum(1))
        if len(d) > k + 1:
            best = np.flatnonzero(d <= np.partition(d, k)[k])
            close, d = close[best], d[best]
        size = self.size[close].astype(np.int64)
        start = (np.cumsum(self.size, dtype=np.int64) - self.size)[close]
        at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
        d = np.repeat(d, size)
        other = self.uids[at] != own
        at, d = at[other], d[other]
        best = np.lexsort((self.uids[at], self.ids[at], d))[:k]
        return self.ids[at[best]], d[best], compared


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, vector, asked) to (id, asked, width, vector as bytes) of the usable ones."""
    for b in batches:
        for rows, v in matrices(b.column(1)):
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(2).take(at), pa.array(np.full(len(rows), v.shape[1], np.int32)), pa.array([x.tobytes() for x in v + 0.0], pa.binary())], ["id", "asked", "width", "vector"])


def _smallest(most: int):
    """Rows (width, vector) to (width, hash, vector): of each width the `most` different vectors of smallest hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[bytes, int]] = defaultdict(dict)
        for b in batches:
            for width, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = held[width]
                if data not in own:
                    own[data] = xxhash.xxh3_64_intdigest(data) - (1 << 63)
                    if len(own) >= 4 * most:
                        held[width] = dict(sorted(own.items(), key=lambda x: x[::-1])[:most])
        out = [(w, h, data) for w, own in held.items() for data, h in sorted(own.items(), key=lambda x: x[::-1])[:most]]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.binary()))], ["width", "hash", "vector"])

    return run


def _listed(pivots: dict[int, np.ndarray], nearest: int):
    """Rows (uid, id, width, vector) with their lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [lists(np.frombuffer(x)[None, :], pivots[w], nearest)[0].tobytes() for w, x in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], ["uid", "id", "width", "vector", "list"])

    return run


def _blocks(pivots: dict[int, np.ndarray], nearest: int, k: int, size: int):
    """Rows (uid, id, width, vector) to a row per block: its width and parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = defaultdict(list)

        def block(width: int) -> pa.RecordBatch:
            uid, id_, data = zip(*held.pop(width), strict=True)
            v = np.frombuffer(b"".join(data)).reshape(-1, width)
            parts = Block.made(np.array(id_, np.int64), np.array(uid, np.int64), v, pivots[width], nearest, k).stored()
            return pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), *(pa.array([x], pa.binary()) for x in parts)], ["width", *(n for n, _ in Block.PARTS)])

        for b in batches:
            for uid, id_, width, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held[width].append((uid, id_, data))
                if len(held[width]) >= size:
                    yield block(width)
        for width in list(held):
            yield block(width)

    return run


def _search(queries: str, k: int, share: float):
    def chunks(width: int) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(queries)
        yield from ds.dataset(path, filesystem=system, format="parquet").to_batches(batch_size=QUERY_CHUNK, columns=["uid", "id", "vector", "list"], filter=ds.field("width") == width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                width = b.column(0)[i].as_py()
                block = Block.read([c[i].as_py() for c in b.columns[1:]], width)
                for c in chunks(width):
                    out: list[list] = [[], [], [], [], []]
                    for uid, id_, data, own in zip(*(x.to_pylist() for x in c.columns), strict=True):
                        ids, d, compared = block.nearest(uid, np.frombuffer(data), np.frombuffer(own, np.uint8), k, share)
                        for column, x in zip(out, (np.full(len(ids), uid), np.full(len(ids), id_), ids, d, np.full(len(ids), compared)), strict=True):
                            column.append(x)
                    if out[0]:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["query", "query_id", "vec_id", "score", "compared"])

    return run


def search(
    vectors: DataFrame, is_query: str, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, pivots: int = PIVOTS, nearest: int = NEAREST, share: float = RERANK, block: int = BLOCK
) -> DataFrame:
    """The k nearest rows found for each row that `is_query` (a SQL condition) picks: query_id, rank, vec_id, score."""
    if not 1 <= pivots <= 256 or not 1 <= block <= 65536 or not 1 <= nearest <= 255:
        raise ValueError("from 1 to 256 pivots, 255 nearest ones and 65536 rows of a block: they are numbered in bytes")
    spark = vectors.sparkSession
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(F.expr(is_query), F.lit(False)).alias("asked"))
    base = stored(rows.mapInArrow(_usable, "id long, asked boolean, width int, vector binary").withColumn("uid", F.monotonically_increasing_id()))
    sample = base.select("width", "vector").mapInArrow(_smallest(pivots), "width int, hash long, vector binary").distinct()
    first = F.row_number().over(Window.partitionBy("width").orderBy("hash", "vector"))
    chosen: dict[int, list[np.ndarray]] = defaultdict(list)
    for r in sample.withColumn("place", first).where(F.col("place") <= pivots).orderBy("width", "place").collect():
        chosen[r["width"]].append(np.frombuffer(r["vector"]))
    by_width = {w: np.array(x) for w, x in chosen.items()}
    columns = ("uid", "id", "width", "vector")
    queries = shared_dir(spark)
    base.where("asked").select(*columns).mapInArrow(_listed(by_width, nearest), "uid long, id long, width int, vector binary, list binary").write.parquet(queries)
    index = stored(base.select(*columns).mapInArrow(_blocks(by_width, nearest, k, block), "width int, " + ", ".join(f"{n} binary" for n, _ in Block.PARTS)))
    best = index.mapInArrow(_search(queries, k, share), "query long, query_id long, vec_id long, score double, compared long")
    order = Window.partitionBy("query").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
