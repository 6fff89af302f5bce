"""Operator 2: approximate nearest neighbours with a hierarchical k-means tree.

The top of the tree is fitted on a sample of at most SAMPLE rows (those of least id digest) and
ends in cells of about an eighth of the rows, CELL at most; below, each cell has a tree of its own, which the executor that
holds the cell fits on at most SAMPLE of its rows, down to leaves of about a 64th of the rows, 8 at least and LEAF at most. So
tables of every size are searched through the tree, leaves stay small however large the table is, and no machine holds the whole tree. Every row is indexed in
the cell and leaf that a descent by nearest centre reaches; a cell of more than BLOCK rows is dealt
over blocks by id digest, each with a tree.

A query visits cells, and leaves in each of them, best bin first: a priority queue holds nodes by the
distance of their centres, the nearest is opened, leaves come out in order. How many of both to visit
is calibrated: CALIBRATION rows that the sample doesn't hold are answered by brute force over all rows, and
visits widen until the share of their true neighbours in visited leaves reaches TARGET, with the
fewest leaves in all. A query goes on beyond that until it has seen LEAF rows, and k besides one. Distances are Euclidean in double precision on the original vectors, ties go to
the smaller id.

Defined cases: vectors null, empty, zero or with null or non-finite components, and rows with a null id take no part, as query
or candidate; vectors are compared with those of their own length, one length after the other; rows that share a query's id
count as its own; a query id that comes repeatedly is answered once in each length, for the least of its vectors; repeated
candidates count each; fewer than k candidates are all returned, unless rows that share the query's id stand before
them; an empty table gives an empty result; columns beside
id and vector are read only by is_query, so others may have any name.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import cut, prepare
from colloquy.llm.sorted_runs import starts
from colloquy.llm.vectors import comparable, lengths, matrix

K, BRANCH, LEAF, SAMPLE, CALIBRATION, TARGET = 10, 8, 64, 16_384, 128, 0.96
#: Rows that a cell is meant to hold, and beyond which it is dealt over blocks; sampled rows that the top's leaves hold at least.
CELL, BLOCK, LEAST = 4096, 65_536, 8


@dataclass
class Tree:
    """centres of all nodes; children by node (none for a leaf); leaf number by node or -1."""

    centres: np.ndarray
    children: list[np.ndarray]
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def descend(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of x."""
        at = np.zeros(len(x), np.int64)
        open_ = np.arange(len(x))
        while len(open_):
            stay = []
            for node in np.unique(at[open_]):
                rows = open_[at[open_] == node]
                kids = self.children[node]
                if len(kids):
                    at[rows] = kids[squared(x[rows], self.centres[kids]).argmin(1)]
                    stay.append(rows)
            open_ = np.concatenate(stay) if stay else open_[:0]
        return self.leaf[at]

    def best_bins(self, q: np.ndarray, visits: int, sizes: np.ndarray | None = None, least: int = 0) -> list[int]:
        """The first leaves that a best-bin-first traversal reaches, and as many more as hold least rows, by their sizes."""
        d = squared(q[None], self.centres)[0]
        queue, out, rows = [(d[0], 0)], [], 0
        while queue and (len(out) < visits or sizes is not None and rows < least):
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                out.append(int(self.leaf[node]))
                rows += 0 if sizes is None else int(sizes[out[-1]])
            for kid in self.children[node]:
                heapq.heappush(queue, (d[kid], int(kid)))
        return out


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None], 0)


def split(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """The k-means cluster of each row."""
    centres = x[rng.choice(len(x), k, replace=False)]
    own = np.zeros(len(x), int)
    for _ in range(rounds):
        new = squared(x, centres).argmin(1)
        if (new == own).all() and _:
            break
        own = new
        for c in range(k):
            if (own == c).any():
                centres[c] = x[own == c].mean(0)
    return own


def fit(x: np.ndarray, branch: int = BRANCH, leaf: int = LEAF, seed: int = 11) -> Tree:
    rng = np.random.default_rng(seed)
    centres, children, number = [x.mean(0)], [np.zeros(0, np.int64)], [-1]
    work, leaves = [(0, np.arange(len(x)))], 0
    while work:
        node, rows = work.pop()
        own = split(x[rows], min(branch, len(rows)), rng) if len(rows) > leaf else np.zeros(len(rows), int)
        parts = [rows[own == c] for c in np.unique(own)]
        if len(parts) < 2:
            number[node] = leaves
            leaves += 1
            continue
        kids = np.arange(len(centres), len(centres) + len(parts))
        children[node] = kids
        for kid, part in zip(kids, parts, strict=True):
            centres.append(x[part].mean(0))
            children.append(np.zeros(0, np.int64))
            number.append(-1)
            work.append((int(kid), part))
    return Tree(np.array(centres), children, np.array(number))


def nearest(q: np.ndarray, q_id: np.ndarray, x: np.ndarray, x_id: np.ndarray, k: int, wanted: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(position of query, ids, distances, positions) of the k nearest rows; wanted: which rows a query may take."""
    step = max(1, 8_000_000 // max(1, len(x)))
    for at in range(0, len(q), step):
        d = squared(q[at : at + step], x)
        d[q_id[at : at + step, None] == x_id[None]] = np.inf
        if wanted is not None:
            d[~wanted[at : at + step]] = np.inf
        for r in range(len(d)):
            near = d[r]
            if len(near) > k:
                bound = np.partition(near, k - 1)[k - 1]
                rows = np.flatnonzero(near <= bound * (1 + 1e-9) + 1e-9 * (1 + np.abs(q[at + r]).max() ** 2)) if np.isfinite(bound) else np.flatnonzero(np.isfinite(near))
            else:
                rows = np.flatnonzero(np.isfinite(near))
            exact = np.sqrt(((x[rows] - q[at + r]) ** 2).sum(1))
            best = np.lexsort((x_id[rows], exact))[:k]
            yield at + r, x_id[rows[best]], exact[best], rows[best]


FOUND, NAMES = "query_id long, vec_id long, score double, cell long, leaf_rank long", ["query_id", "vec_id", "score"]


def nearest_of(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


class Part:
    """The rows of a block, ordered by leaf of the block's tree."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, leaf_rows: int) -> None:
        some = x if len(x) <= SAMPLE else x[np.sort(np.random.default_rng(len(x)).choice(len(x), SAMPLE, replace=False))]
        self.tree = fit(some, leaf=max(2, int(leaf_rows * len(some) / len(x))))
        leaf = np.concatenate([self.tree.descend(x[a : a + SAMPLE]) for a in range(0, len(x), SAMPLE)])
        order = np.argsort(leaf, kind="stable")
        self.x, self.ids, self.leaf = x[order], ids[order], leaf[order]
        self.first = np.searchsorted(self.leaf, np.arange(self.tree.leaves + 1))
        self.sizes = np.diff(self.first)

    def answers(self, q_id: np.ndarray, q: np.ndarray, k: int, visits: int | None, least: int) -> tuple[np.ndarray, ...]:
        """query ids, ids, distances and leaf ranks (0 unless all leaves are looked at) of the k nearest in visited leaves."""
        leaves, out = self.tree.leaves, []
        if visits is None or 4 * visits >= leaves:
            # Most rows are wanted: one product for all queries, the others left out.
            bins = [self.tree.best_bins(x, leaves if visits is None else visits, self.sizes, least) for x in q]
            wanted = None
            if visits is not None and visits < leaves:
                may = np.zeros((len(q), leaves), bool)
                for i, b in enumerate(bins):
                    may[i, b] = True
                wanted = may[:, self.leaf]
            for i, ids, score, rows in nearest(q, q_id, self.x, self.ids, k, wanted):
                rank = np.argsort(bins[i])[self.leaf[rows]] if visits is None else np.zeros(len(ids), np.int64)
                out.append((np.full(len(ids), q_id[i]), ids, score, rank))
        else:
            for i, x in enumerate(q):
                rows = np.concatenate([np.arange(self.first[b], self.first[b + 1]) for b in self.tree.best_bins(x, visits, self.sizes, least)])
                for _, ids, score, _ in nearest(x[None], q_id[i : i + 1], self.x[rows], self.ids[rows], k):
                    out.append((np.full(len(ids), q_id[i]), ids, score, np.zeros(len(ids), np.int64)))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))


def best_visits(cell: np.ndarray, leaf: np.ndarray, cells: int, leaves: int, target: float) -> tuple[int, int]:
    """The visits of cells and of leaves in each, widened by a quarter at a time, whose product is least
    of those that hold the target share of neighbours, which have these ranks."""

    def widened(most: int) -> list[int]:
        steps = [1]
        while steps[-1] < most:
            steps.append(min(most, max(steps[-1] + 1, steps[-1] * 5 // 4)))
        return steps

    if not len(cell):
        return cells, leaves
    fine = [(c * f, c, f) for c in widened(cells) for f in widened(leaves) if ((cell < c) & (leaf < f)).mean() >= target]
    return min(fine)[1:] if fine else (cells, leaves)


def search(vectors: DataFrame, is_query: Column, k: int = K, id_column: str = "vec_id", vector_column: str = "embedding", target: float = TARGET, sample: int = SAMPLE, cell: int = CELL, block: int = BLOCK, looked: dict | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: k nearest found for each row with is_query. looked: gets, by length of vectors, the
    visits of cells and leaves and how many there are."""
    prepare(vectors.sparkSession)
    found = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for d in lengths(vectors, vector_column):
        found = found.unionByName(of_length(vectors, is_query, k, id_column, vector_column, d, target, sample, cell, block, looked))
    return found


def of_length(vectors: DataFrame, is_query: Column, k: int, id_column: str, vector_column: str, d: int, target: float, sample: int, cell: int, block: int, looked: dict | None) -> DataFrame:
    """The same of the vectors of d components."""
    spark = vectors.sparkSession
    kind = "float" if vectors.schema[vector_column].dataType.elementType.typeName() == "float" else "double"
    rows = vectors.where(comparable(F.col(vector_column), d) & F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.transform(vector_column, lambda c: c.cast(kind)).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    drawn = rows.select("id", "v").orderBy(F.xxhash64("id"), "id", "v").limit(sample + CALIBRATION).toPandas()
    if not len(drawn):  # no row of this length has an id
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n = rows.count()
    leaf_rows = max(8, min(LEAF, n // 64))
    cell = max(4 * leaf_rows, min(cell, n // 8))
    x, x_id = np.array(drawn["v"].tolist(), dtype=np.float64).reshape(-1, d), drawn["id"].to_numpy()
    fitted = x[:sample]
    top_tree = fit(fitted, leaf=max(LEAST, int(len(fitted) * cell / n)))
    # Rows outside the sample; of a table that the sample holds whole, its last ones.
    probe_id, at = np.unique(x_id[-CALIBRATION:], return_index=True)
    probe = x[-CALIBRATION:][at]

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), b.column("asks"), pa.array(top_tree.descend(matrix(b.column("v"), d)).astype(np.int32))], names=["id", "v", "asks", "cell"])

    index = cut(rows.mapInArrow(indexed, f"id long, v array<{kind}>, asks boolean, cell int"))
    blocks, sizes = np.ones(top_tree.leaves, np.int64), np.zeros(top_tree.leaves, np.int64)  # SAMPLE / LEAST cells at most
    for c, size in index.groupBy("cell").count().collect():
        blocks[c], sizes[c] = -(-size // block), size
    per_cell = F.array(*(F.lit(int(b)) for b in blocks))
    data = index.select("cell", F.pmod(F.xxhash64("id"), F.get(per_cell, F.col("cell"))).cast("int").alias("block"), F.lit(0).alias("side"), "id", "v")
    layout = f"cell int, block int, side int, id long, v array<{kind}>"

    def routed(visits: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                row, cells, parts = [], [], []
                for i, q in enumerate(matrix(b.column("v"), d)):
                    for c in top_tree.best_bins(q, visits, sizes, k + 1):
                        for part in range(blocks[c]):
                            row.append(i)
                            cells.append(c)
                            parts.append(part)
                take = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(parts, pa.int32()), pa.array([1] * len(row), pa.int32()), b.column("id").take(take), b.column("v").take(take)], names=["cell", "block", "side", "id", "v"])

        return run

    def searched(visits: int | None, least: int):
        """Holds the rows of one block and its tree; its queries, sorted behind them, stream past. Without visits
        all leaves are looked at, and each row found comes with the rank of its leaf."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, held, part = None, [], None
            for batch in batches:
                t = pa.Table.from_batches([batch])
                begin = starts(t, ["cell", "block", "side"])
                for a, b in zip(begin, [*begin[1:], t.num_rows], strict=True):
                    some = t.slice(a, b - a).combine_chunks()
                    own, asking = (some.column("cell")[0].as_py(), some.column("block")[0].as_py()), some.column("side")[0].as_py()
                    v, ids = matrix(some.column("v"), d), some.column("id").to_numpy()
                    if own != key:
                        key, held, part = own, [], None
                    if not asking:
                        held.append((v, ids))
                    elif held:
                        part = part or Part(*(np.concatenate(c) for c in zip(*held, strict=True)), leaf_rows)
                        for at in range(0, len(v), 256):
                            out = part.answers(ids[at : at + 256], v[at : at + 256], k, visits, least)
                            if len(out[0]):
                                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*out[:3], np.full(len(out[0]), own[0], np.int64), out[3])], names=[*NAMES, "cell", "leaf_rank"])

        return run

    def met(queries: DataFrame, cells: int, leaves: int | None) -> DataFrame:
        both = data.unionByName(queries.select("id", "v").mapInArrow(routed(cells), layout))
        return both.repartition("cell", "block").sortWithinPartitions("cell", "block", "side", "id").mapInArrow(searched(leaves, max(k + 1, -(-LEAF // cells))), FOUND)

    probes = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(probe_id, probe, strict=True)], f"id long, v array<{kind}>")
    truth = nearest_of(met(probes, top_tree.leaves, None), k).toPandas()  # CALIBRATION x k rows
    order = {int(i): {c: r for r, c in enumerate(top_tree.best_bins(v, top_tree.leaves))} for i, v in zip(probe_id, probe, strict=True)}
    cell_rank = np.array([order[int(i)][int(c)] for i, c in zip(truth["query_id"], truth["cell"], strict=True)])
    leaf_rank = truth["leaf_rank"].to_numpy()
    visits = best_visits(cell_rank, leaf_rank, top_tree.leaves, int(leaf_rank.max(initial=0)) + 1, target)
    if looked is not None:
        looked[d] = {"rows": n, "cells": (visits[0], top_tree.leaves), "leaves": (visits[1], -(-cell // leaf_rows))}
    asked = index.where("asks").groupBy("id").agg(F.min("v").alias("v"))
    return nearest_of(met(asked, *visits), k).select("query_id", "rank", "vec_id", "score")
