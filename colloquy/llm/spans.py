"""Spans found in texts, and the digest columns that the queries derive from them."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

import pyarrow as pa

#: (kind, start, end): code points, end exclusive.
Span = tuple[str, int, int]


def join(spans: Iterable[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def digest(spans: Iterable[Span]) -> str:
    return hashlib.sha256(join(spans).encode()).hexdigest()


def within(spans: list[Span]) -> Callable[[int, int], bool]:
    """Whether a stretch lies inside one of the spans, which are ordered by start: one search a question."""
    first = [a for _, a, _ in spans]
    furthest = list(accumulate((b for *_, b in spans), max))
    return lambda a, b: bool((n := bisect_right(first, a)) and furthest[n - 1] >= b)


def scanner(find: Callable[[str], tuple[list[Span], list[Span]]], kinds: list[str], id_column: str = "doc_id", text_column: str = "text"):
    """A mapInArrow function: id, counts of base spans by kind, digest, list and number of spans.

    find gives the base spans and all spans of a text, each in the order wanted.
    """
    nothing = digest([])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[] for _ in kinds]
            shas, texts, total = [], [], []
            for value in batch.column(text_column):
                base, every = find(value.as_py() or "")
                for n, kind in zip(counts, kinds, strict=True):
                    n.append(sum(s[0] == kind for s in base) if base else 0)
                shas.append(digest(base) if base else nothing)
                texts.append(join(every) if every else "")
                total.append(len(every))
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_column), *(pa.array(n, pa.int64()) for n in counts), pa.array(shas, pa.string()), pa.array(texts, pa.string()), pa.array(total, pa.int64())],
                names=[id_column, *(f"n_{k}" for k in kinds), "base_sha256", "spans", "n_spans"],
            )

    return run
