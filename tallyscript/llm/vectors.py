"""What the vector operators share: reading lists of numbers as matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of the usable rows, their vectors as float64) for each length of vector there is. Usable: not null, not
    empty, not zero, without null or non-finite components."""
    if not len(column):
        return
    column = column.cast(pa.list_(pa.float64()))
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)  # nulls become NaN
    ends = np.cumsum(lengths)
    finite = np.isfinite(flat)
    bad = np.concatenate(([0], np.cumsum(~finite)))
    full = np.concatenate(([0], np.cumsum(flat != 0)))
    good = (bad[ends] == bad[ends - lengths]) & (full[ends] > full[ends - lengths])
    for width in np.unique(lengths[good]):
        rows = np.flatnonzero(good & (lengths == width))
        yield rows, flat[(ends - lengths)[rows][:, None] + np.arange(width)]


def stacked(data: list[bytes]) -> np.ndarray:
    """Vectors from their bytes as rows of one matrix, shorter ones being filled with zeros."""
    lengths = np.array([len(x) >> 3 for x in data], np.int64)
    if len(lengths) and (lengths == lengths[0]).all():
        return np.frombuffer(b"".join(data)).reshape(len(data), -1)
    out = np.zeros((len(data), lengths.max(initial=0)))
    for i, x in enumerate(data):
        out[i, : lengths[i]] = np.frombuffer(x)
    return out
