"""Groups of equal keys in partitions that are sorted by key, without one call a group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str], least_rows: int = 4096) -> Iterator[pa.Table]:
    """Tables of consecutive rows in which no run of equal keys is cut in two.

    The rows of the longest run must fit in memory; callers bound runs by salting.
    """
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= least_rows:
            t = pa.Table.from_batches(held).combine_chunks()
            at = last_start(t, keys)
            if at:
                yield t.slice(0, at)
                held, rows = t.slice(at).to_batches(), t.num_rows - at
            else:
                held = t.to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    """Positions at which a run of equal keys begins."""
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    for k in keys:
        v = t.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def last_start(t: pa.Table, keys: list[str]) -> int:
    return int(starts(t, keys)[-1])


def pairs_within(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs i < j of positions within each [begin, end), for short runs."""
    size = end - begin
    later = np.repeat(end, size) - np.arange(begin[0], end[-1]) - 1 if len(begin) else np.zeros(0, int)
    i = np.repeat(np.arange(begin[0], end[-1]), later) if len(begin) else later
    offset = np.arange(len(i)) - np.repeat(np.cumsum(later) - later, later)
    return i, i + 1 + offset


def least_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of each of n nodes the smallest node that links (i, j) reach."""
    label = np.arange(n)
    if len(i):
        while True:
            least = np.minimum(label[i], label[j])
            new = label.copy()
            np.minimum.at(new, i, least)
            np.minimum.at(new, j, least)
            np.minimum.at(new, label[i], least)
            np.minimum.at(new, label[j], least)
            new = new[new]
            if (new == label).all():
                break
            label = new
    return label
