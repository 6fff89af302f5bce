"""Operator 6: SimHash near-duplicates by tiled exact comparison.

Fingerprints are compared with numpy exclusive-or and bit counts, tile against
tile; tiles are runs of fingerprints ordered by population count, and a tile pair
whose population counts differ by more than the radius is skipped. So that the
tiles do not meet all against all, they are laid out inside cells: two fingerprints
within radius r agree wholly on m - r of m bit fields at least, so for each choice
of m - r fields the fingerprints that agree on them form a cell. Any linked pair
shares a cell, so no link is lost. m follows from the number of distinct
fingerprints alone; every m gives the same links.

Equal fingerprints are one node from the start, so copies never meet in a tile.
A large cell is cut into blocks, and each pair of blocks is a task of its own.

Defined cases: a null text counts as empty; no words give fingerprint zero, which
links like any other; fewer than four words give one shingle; repeated rows come
back as often as they came in; a text is read whole, whatever its length; a bit that exactly
half of the hashes have is 0; a null id is no candidate for a component's name, and a component
of null ids alone has a null name; an empty table gives an empty result; columns beside id and
text are never read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import cut, free_name, join_hot, prepare
from colloquy.llm.components import components
from colloquy.llm.sorted_runs import least_labels, starts, whole_runs

WORDS, SEED, RADIUS = 4, 42, 4
#: Fingerprints in a tile, and in a block of a large cell.
TILE, BLOCK = 256, 8192
#: Fingerprints a cell is meant to hold, from which the number of bit fields follows.
CELL = 512


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """The 64-bit SimHash of a text, unsigned."""
    import xxhash

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    if len(w) <= words:
        return xxhash.xxh64_intdigest(b" ".join(w), seed)
    buf = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    first = np.concatenate(([0], ends[: len(w) - words])).tolist()
    last = (ends[words - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(buf[a:b], seed) for a, b in zip(first, last, strict=True)), np.uint64, len(first))
    return from_hashes(h)


def from_hashes(h: np.ndarray) -> int:
    """Bit k is set if more than half of the hashes have it."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):
        ones += np.unpackbits(h[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, fp: a long with the fingerprint's bits."""
    prepare(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(v.as_py()) for v in b.column(text_column)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(id_column), pa.array(fp.view(np.int64))], names=[id_column, "fp"])

    return docs.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, fp long")


def fields(m: int) -> list[int]:
    """Masks of m bit fields that cover 64 bits."""
    edges = [round(64 * k / m) for k in range(m + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]


def cell_masks(n: int, radius: int) -> list[int]:
    """Masks of the choices of fields: the fewest fields whose cells are small enough on average."""
    for m in range(radius + 1, radius + 5):
        if n / 2 ** (64 * (m - radius) / m) <= CELL or m == radius + 4:
            f = fields(m)
            return [sum(c) for c in combinations(f, m - radius)]
    raise AssertionError


def close_pairs(a: np.ndarray, b: np.ndarray, same: bool, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of pairs within the radius; a and b are ordered by population count."""
    pa_, pb = np.bitwise_count(a).astype(np.int16), np.bitwise_count(b).astype(np.int16)
    for i in range(0, len(a), TILE):
        for j in range(i if same else 0, len(b), TILE):
            x, y = a[i : i + TILE], b[j : j + TILE]
            if pb[j] - pa_[min(i + TILE, len(a)) - 1] > radius:
                break  # later tiles of b have still larger counts
            if pa_[i] - pb[min(j + TILE, len(b)) - 1] > radius:
                continue
            p, q = np.nonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= radius)
            yield p + i, q + j


def links(distinct: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) whose components are those of all pairs within the radius.

    distinct: fp long, each once. In each comparison only links of each
    fingerprint to the least one it reaches there are kept.
    """
    masks = cell_masks(n, radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    cells = distinct.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in signed))).alias("choice", "part")).select("fp", F.xxhash64("choice", "part").alias("cell"))
    blocks = cells.groupBy("cell").agg(F.count("*").alias("size")).where("size > 1").select("cell", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = (
        cells.join(blocks, "cell")
        .withColumn("own", own)
        .select("cell", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select("cell", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), (F.col("own") <= F.col("other")).alias("left"), "fp")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_runs(batches, ["cell", "p", "q"]):
            s = starts(t, ["cell", "p", "q"])
            fp = t.column("fp").to_numpy().view(np.uint64)
            left, p, q = t.column("left").to_numpy(zero_copy_only=False), t.column("p").to_numpy(), t.column("q").to_numpy()
            out = []
            for a, b in zip(s, [*s[1:], len(fp)], strict=True):
                x = fp[a:b]
                x, of = np.unique(x), None  # a fingerprint comes once but for cells whose digests are equal
                x = x[np.argsort(np.bitwise_count(x), kind="stable")]
                if p[a] == q[a]:
                    sides = [(x, x, True)]
                    node = x
                else:
                    of = np.isin(x, fp[a:b][left[a:b]])
                    sides = [(x[of], x[~of], False)]
                    node = np.concatenate((x[of], x[~of]))
                shift = 0 if p[a] == q[a] else int(of.sum())
                label = np.arange(len(node))
                i, j = [], []
                pending = 0
                for k, m in close_pairs(*sides[0], radius):
                    i.append(k)
                    j.append(m + shift)
                    pending += len(k)
                    if pending > 1_000_000:
                        label = least_labels(len(node), np.concatenate([np.arange(len(node)), *i]), np.concatenate([label, *j]))
                        i, j, pending = [], [], 0
                if i:
                    label = least_labels(len(node), np.concatenate([np.arange(len(node)), *i]), np.concatenate([label, *j]))
                moved = np.flatnonzero(label != np.arange(len(node)))
                if len(moved):
                    out.append((node[moved], node[label[moved]]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).view(np.int64)) for c in zip(*out, strict=True)], names=["a", "b"])

    return dealt.repartition("cell", "p", "q").sortWithinPartitions("cell", "p", "q").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", radius: int = RADIUS) -> DataFrame:
    """id, fingerprint (16 hexadecimal digits), component_id."""
    prints = cut(fingerprints(docs, id_column, text_column))
    classes = cut(prints.groupBy("fp").agg(F.min(id_column).alias("least"), F.count("*").alias("n")))
    rows, distinct = classes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    reach = components(links(classes.select("fp"), distinct, radius))
    named = cut(classes.join(reach.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "n", "least", F.coalesce("component", "fp").alias("component")))
    names = cut(named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("of")))
    by_print = cut(join_hot(named.drop("least"), names, ["component"], "of", distinct).select("fp", "n", "component_id"))
    return join_hot(prints, by_print, ["fp"], "n", rows).select(id_column, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row of each component, with its columns: that of the smallest id (the first read, where ids repeat or are null).

    Rows are told apart by a number given while reading, so rows that share an id stay apart.
    All columns come back as they were, whatever their names.
    """
    prepare(docs.sparkSession)
    row = free_name(docs, "_row")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    key = F.struct(F.col(id_column).isNull().alias("none"), F.col(id_column).alias("id"), F.col(row).alias("row"))
    slim = numbered.select(key.alias("key"), F.col(text_column).alias("text"))
    prints = cut(fingerprints(slim, "key", "text"))
    classes_ = cut(prints.groupBy("fp").agg(F.min("key").alias("least")))
    reach = components(links(classes_.select("fp"), classes_.count(), radius))
    named = classes_.join(reach.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    kept = named.groupBy("component").agg(F.min("least").alias("least")).select(F.col("least.row").alias(row))
    return numbered.join(kept, row, "left_semi").drop(row)
