"""Best-fit packing (operator 3): token pieces into sequences of fixed capacity by large-item matching.

Pieces longer than a third of the capacity fit at most twice into a sequence: from the longest down, each is
matched with the longest other one that still fits. Shorter pieces then go, from the longest down, where they
leave the smallest gap (best fit), and open new sequences only when no gap takes them.

The plan depends on how many pieces there are of each length and on nothing else, and there are at most
`capacity` lengths. So the driver packs that histogram, whose size is bounded by the capacity whatever the
corpus: runs of equal sequences are one pattern with a multiplicity. Each piece then finds its place from its
rank among the pieces of its length. Ranks come from counts by (length, salt) and a row number inside each
salt, so a length that a third of all pieces have is spread over many tasks.

Nulls and empty texts are documents of one token (the end mark). Rows that repeat a doc_id are packed each.
"""

from __future__ import annotations

import base64
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import Chunks
from .shared import stored, text_batches

CAPACITY = 2048
RANK_ROWS = 200_000

_encoders: dict[tuple[str, str], object] = {}


def encoder(path: str):
    """A fast encoder for a byte-level vocabulary whose merges follow the ranks, kept by the worker process.

    `path` is the .tiktoken rank file; its ids are those that the tokenizers library gives for the .json file
    of the same vocabulary (the tests compare the two), but for added tokens, which `Ids` cuts out first.
    """
    import public_tokenizers
    import tiktoken

    key = (path, public_tokenizers.PATTERN)
    if key not in _encoders:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[key] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def added_tokens(path: str) -> dict[str, int]:
    """The added tokens of the .json file beside the .tiktoken file `path`, which are cut out of a text before all else."""
    with open(f"{os.path.splitext(path)[0]}.json", encoding="utf-8") as f:
        tokens = json.load(f)["added_tokens"]
    for t in tokens:
        if t["single_word"] or t["lstrip"] or t["rstrip"]:
            raise ValueError(f"the added token {t['content']!r} isn't plain")
    return {t["content"]: t["id"] for t in tokens}


class Ids:
    """Texts to ids as little-endian unsigned 32-bit bytes, kept by the worker process."""

    def __init__(self, path: str) -> None:
        self.encoder, self.chunks = encoder(path), Chunks(self.words)
        (self.line,) = self.encoder.encode_ordinary("\n")
        self.added = {t: i.to_bytes(4, "little") for t, i in added_tokens(path).items()}
        self.split = re.compile("|".join(["(?!)", *map(re.escape, sorted(self.added, key=len, reverse=True))]))

    def holds_added(self, text: str | None) -> bool:
        return bool(text) and any(t in text for t in self.added)

    def with_added(self, text: str) -> bytes:
        """The ids of a text that is cut at the added tokens, each part being a text of its own."""
        out, at = [], 0
        for m in self.split.finditer(text):
            out += [self.whole(text[at : m.start()]), self.added[m.group()]]
            at = m.end()
        return b"".join([*out, self.whole(text[at:])])

    def whole(self, text: str) -> bytes:
        return self.encoder.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()

    def words(self, words: list[str]) -> list[bytes]:
        """The words are encoded in one text with a line end after each, whose id then separates them."""
        plain = [w for w in words if "\n" not in w]
        ids = self.encoder.encode_to_numpy("".join(f" {w}\n" for w in plain), disallowed_special=()).astype("<u4", copy=False)
        ends = (4 * np.flatnonzero(ids == self.line)).tolist()
        data = ids.tobytes()
        starts = [0, *(e + 4 for e in ends)]
        of = {w: data[a:e] for w, a, e in zip(plain, starts, ends, strict=False)}
        return [of[w] if w in of else self.whole(" " + w) for w in words]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        out = []
        added = [self.holds_added(t) for t in texts]
        for text, apart, cut in zip(texts, added, self.chunks.of([None if x else t for t, x in zip(texts, added, strict=True)]), strict=True):
            if apart:
                out.append(self.with_added(text))
            else:
                out.append(b"" if not text else self.whole(text) if cut is None else self.whole(cut[0]) + b"".join(cut[1]))
        return out


_ids: dict[str, Ids] = {}


def pieces_of(data: bytes, capacity: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids; only the first piece may be short."""
    n = len(data) // 4
    to = n % capacity or min(n, capacity)
    at, piece = 0, 0
    while at < n:
        yield piece, at, to - at, zlib.crc32(data[4 * at : 4 * to])
        at, to, piece = to, to + capacity, piece + 1


def _cut(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _ids.get(path) or _ids.setdefault(path, Ids(path))
        end = end_id.to_bytes(4, "little")
        for b in text_batches(batches):
            out: list[list] = [[], [], [], [], []]
            for doc_id, data in zip(b.column(0).to_pylist(), ids.encode_all(b.column(1).to_pylist()), strict=True):
                for row in pieces_of(data + end, capacity):
                    out[0].append(doc_id)
                    for column, value in zip(out[1:], row, strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (multiplicity, [(length, times), ...] in order of place) that hold all pieces of the histogram."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    third = capacity // 3
    open_: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}  # by gap

    def put(gap: int, n: int, held: list[tuple[int, int]]) -> None:
        if n:
            open_.setdefault(gap, []).append((n, held))

    for length in range(capacity, third, -1):
        while left[length]:
            fit = min(length, capacity - length)
            mate = next((x for x in range(fit, third, -1) if left[x]), 0)
            if not mate:
                put(capacity - length, int(left[length]), [(length, 1)])
                left[length] = 0
            elif mate == length:
                pairs = int(left[length] // 2)
                put(capacity - 2 * length, pairs, [(length, 2)])
                left[length] -= 2 * pairs
                if left[length]:  # a single one: its mate is shorter, if there is any
                    left[length] = 0
                    other = next((x for x in range(min(length - 1, fit), third, -1) if left[x]), 0)
                    if other:
                        left[other] -= 1
                        put(capacity - length - other, 1, [(length, 1), (other, 1)])
                    else:
                        put(capacity - length, 1, [(length, 1)])
            else:
                n = int(min(left[length], left[mate]))
                left[length] -= n
                left[mate] -= n
                put(capacity - length - mate, n, [(length, 1), (mate, 1)])
    for length in range(third, 0, -1):
        while left[length]:
            gap = min((g for g in open_ if g >= length), default=0)
            if not gap:
                times = min(capacity // length, int(left[length]))
                n = int(left[length] // times)
                put(capacity - times * length, n, [(length, times)])
                left[length] -= n * times
                continue
            n, held = open_[gap].pop()
            if not open_[gap]:
                del open_[gap]
            # Best fit keeps filling the same gap while no smaller one takes the piece.
            times = min(gap // length, int(left[length]))
            used = min(n, int(left[length]) // times)
            left[length] -= used * times
            put(gap - times * length, used, [*held, (length, times)])
            put(gap, n - used, held)
    return [(n, held) for runs in open_.values() for n, held in runs]


def slots(patterns: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, dict[str, np.ndarray]]:
    """For each length, runs of ranks: from rank `rank` on, `times` pieces go into each of the sequences from
    `sequence` on, at the place `offset` and those that follow it."""
    by: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for n, held in patterns:
        offset = 0
        for length, times in held:
            rank = ranks.get(length, 0)
            by.setdefault(length, []).append((rank, sequence, offset, times))
            ranks[length] = rank + n * times
            offset += length * times
        sequence += n
    return {k: dict(zip(("rank", "sequence", "offset", "times"), np.array(v, np.int64).T, strict=True)) for k, v in by.items()}


def _place(table: dict[int, dict[str, np.ndarray]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = b.column("length").to_numpy(zero_copy_only=False)
            rank = b.column("rank").to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                rows = np.flatnonzero(length == x)
                t = table[int(x)]
                i = np.searchsorted(t["rank"], rank[rows], side="right") - 1
                turn, again = np.divmod(rank[rows] - t["rank"][i], t["times"][i])
                sequence[rows] = t["sequence"][i] + turn
                offset[rows] = t["offset"][i] + again * x
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return run


def assign(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`pieces` (doc_id, piece, start, length, ids_crc32; lengths from 1 to capacity), stored, with sequence_id and offset."""
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    table = slots(plan(counts, capacity))
    salts = max(1, -(-max(counts.values(), default=1) // RANK_ROWS))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    by = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = by.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).drop("n")
    inside = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece"))
    ranked = salted.withColumn("inside", inside).join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("inside") - 1)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    out = ranked.select("doc_id", F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", "rank")
    return out.mapInArrow(_place(table), schema)


def pack(docs: DataFrame, ranks_path: str, *, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Encodes the texts of docs (doc_id, text), ends each with `end_id`, cuts those that are longer than the
    capacity, and packs the pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = docs.select("doc_id", "text").mapInArrow(_cut(ranks_path, capacity, end_id), "doc_id long, piece long, start long, length long, ids_crc32 long")
    return assign(stored(cut), capacity)
