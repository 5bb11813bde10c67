"""Edit distances of strings and of token arrays.

The kernel keeps a whole column of the distance table in two integers, one bit a cell for steps up and one for steps
down (Myers 1999, Hyyrö 2003), so a column costs a few machine words whatever the texts' alphabet.
"""

from __future__ import annotations

from collections.abc import Hashable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column


def ends(a: Sequence[Hashable], b: Sequence[Hashable]) -> tuple[int, int]:
    """How many items the sequences share at their head, and at their tail after that."""
    least = min(len(a), len(b))
    head = 0
    while head < least and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < least - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    return head, tail


def masks(items: Sequence[Hashable]) -> dict[Hashable, int]:
    """For each item the bits of the places where it is."""
    places: dict[Hashable, list[int]] = {}
    for i, x in enumerate(items):
        places.setdefault(x, []).append(i)
    if len(items) <= 512:
        return {x: sum(1 << i for i in at) for x, at in places.items()}
    out = {}
    for x, at in places.items():
        bits = np.zeros(at[-1] // 8 + 1, np.uint8)
        np.bitwise_or.at(bits, np.array(at) >> 3, (1 << (np.array(at) & 7)).astype(np.uint8))
        out[x] = int.from_bytes(bits.tobytes(), "little")
    return out


def columns(found: dict[Hashable, int], n: int, b: Sequence[Hashable], up: int, down: int) -> Iterator[tuple[int, int, int]]:
    """For each item of b: (+1 steps, -1 steps) of the column of n cells after it, and the change of its last cell."""
    full, last = (1 << n) - 1, 1 << (n - 1)
    for x in b:
        same = found.get(x, 0)
        side = same | down
        across = (((same & up) + up) ^ up) | same
        more, less = down | (full & ~(across | up)), up & across
        change = 1 if more & last else -1 if less & last else 0
        more, less = more << 1 | 1, less << 1
        up, down = full & (less | ~(side | more)), full & more & side
        yield up, down, change


def distance(a: Sequence[Hashable], b: Sequence[Hashable]) -> int:
    """Levenshtein distance of two sequences."""
    head, tail = ends(a, b)
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if not a or not b:
        return len(a) + len(b)
    if len(a) > len(b):
        a, b = b, a
    return len(a) + sum(c for *_, c in columns(masks(a), len(a), b, (1 << len(a)) - 1, 0))


def distances(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """The distances of all of a from all of b, one cell of all tables at a time; for short strings."""
    la, lb = (np.array([len(x) for x in side], np.int64) for side in (a, b))
    ca, cb = (np.array([[*map(ord, x), *[-1 - k] * (n - len(x))] for x in side], np.int32).reshape(len(side), n) for k, side, n in ((0, a, la.max(initial=0)), (1, b, lb.max(initial=0))))
    row = [np.full((len(a), len(b)), j, np.int16) for j in range(cb.shape[1] + 1)]
    out = np.zeros((len(a), len(b)), np.int16)
    for i in range(ca.shape[1] + 1):
        if i:
            other = [ca[:, i - 1, None] != cb[None, :, j] for j in range(cb.shape[1])]
            new = [np.full((len(a), len(b)), i, np.int16)]
            for j in range(cb.shape[1]):
                new.append(np.minimum(np.minimum(row[j + 1], new[j]) + 1, row[j] + other[j]))
            row = new
        mine = la == i
        if mine.any():
            for j in np.unique(lb):
                out[np.ix_(mine, lb == j)] = row[j][np.ix_(mine, lb == j)]
    return out


def _measured():
    from pyspark.sql.pandas.functions import arrow_udf

    @arrow_udf("long")
    def measure(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else distance(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.int64())

    return measure


def char_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance in code points."""
    return _measured()(a, b)


def token_distance(ref: Column, hyp: Column) -> Column:
    """Levenshtein distance of two arrays of strings."""
    return _measured()(ref, hyp)
