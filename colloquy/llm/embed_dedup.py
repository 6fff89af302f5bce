"""Operator 3: near-duplicate embeddings by cross-polytope hashing.

Each of TABLES hash tables applies FOLDS pseudo-random rotations, each of three
rounds of random signs and a fast Hadamard transform, to the unit vector padded to
a power of two. The nearest of the +/- unit axes is the hash of a fold; a vector
goes into the bucket of its nearest axes and, multiprobe, into those where one
fold takes its next best axis. Pairs that share a bucket are verified by cosine in
double precision on the original vectors; no pair is linked unverified.

Equal vectors, told by all their components, are one node with a weight from the start. A pair that meets in several
buckets counts in the first of them only, so link counts need no list of pairs:
tasks return for each vector the weight of its links and one link to the least
vector it reaches. Large buckets are cut into blocks, each pair of blocks a group of its own.

Defined cases: vectors null, empty, zero or with null or non-finite components link with nothing and are their
own component; vectors are compared with those of their own length, one length after the other; repeated rows (equal id and vector) come back as often as they came in and count
as links of each other; a cosine at the threshold links; rows with a null id take part but name no
component; an empty table gives an empty result; columns beside id and vector are never read, so
others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import cut, join_hot, prepare
from colloquy.llm.components import components
from colloquy.llm.sorted_runs import least_labels, starts, whole_runs
from colloquy.llm.vectors import comparable, lengths, matrix, usable

THRESHOLD = 0.95
#: Of random pairs at cosine 0.95 in 64 dimensions, 3 folds in 12 tables find all of 6,000, 4 in 16 all of 20,000.
#: Buckets a table number (2 width)^folds: more folds for more vectors keep them small.
TABLES, FOLDS, PROBES, SEED = 12, 3, 4, 7
BLOCK = 2048
#: Products in one piece of a comparison.
PIECE = 4_000_000
#: Vectors that are rotated at once, few enough for a processor's cache.
ROWS = 512


def signs(d: int, seed: int = SEED, tables: int = TABLES, folds: int = FOLDS) -> np.ndarray:
    """tables x folds x 3 x d random signs."""
    return np.random.default_rng(seed).choice([-1.0, 1.0], size=(tables, folds, 3, d))


def hadamard(x: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of the columns, times the root of their length; both arrays are written over."""
    d, n = x.shape
    h = 1
    while h < d:
        y, out = x.reshape(d // (2 * h), 2, h, n), spare.reshape(d // (2 * h), 2, h, n)
        np.add(y[:, 0], y[:, 1], out=out[:, 0])
        np.subtract(y[:, 0], y[:, 1], out=out[:, 1])
        x, spare = spare, x
        h *= 2
    return x


def buckets(x: np.ndarray, flips: np.ndarray, probes: int = PROBES) -> np.ndarray:
    """n x tables x probes bucket numbers of unit vectors x; the first is the nearest axes' own."""
    out = np.empty((len(x), flips.shape[0], probes), np.int64)
    for at in range(0, len(x), ROWS):
        out[at : at + ROWS] = _buckets(x[at : at + ROWS], flips, probes)
    return out


def _buckets(x: np.ndarray, flips: np.ndarray, probes: int) -> np.ndarray:
    n, d = x.shape
    width = flips.shape[-1]
    padded = np.zeros((width, n))
    padded[:d] = x.T
    one, two = np.empty_like(padded), np.empty_like(padded)
    out = np.empty((n, flips.shape[0], probes), np.int64)
    for t, folds in enumerate(flips):
        best, second, loss = [], [], []
        for three in folds:
            y = padded
            for s in three:
                np.multiply(y, s[:, None], out=one)
                y = hadamard(one, two)
                if y is one:
                    one, two = two, one
            y = np.ascontiguousarray(y.T)
            size = np.abs(y)
            order = np.argpartition(-size, min(probes, width - 1), axis=1)[:, :probes] if width > probes else np.tile(np.arange(width), (n, 1))
            order = np.take_along_axis(order, np.argsort(-np.take_along_axis(size, order, 1), axis=1, kind="stable"), 1)
            value = np.take_along_axis(y, order, 1)
            best.append(2 * order[:, 0] + (value[:, 0] < 0))
            second.append(2 * order[:, 1:] + (value[:, 1:] < 0))
            loss.append(np.abs(value[:, :1]) - np.abs(value[:, 1:]))
        base = 2 * width
        key = sum(b * base**f for f, b in enumerate(best))
        out[:, t, 0] = key
        costs = np.concatenate(loss, axis=1)
        other = np.concatenate([key[:, None] + (s - b[:, None]) * base**f for f, (s, b) in enumerate(zip(second, best, strict=True))], axis=1)
        pick = np.argsort(costs, axis=1, kind="stable")[:, : probes - 1]
        if pick.shape[1]:
            out[:, t, 1:] = np.take_along_axis(other, pick, 1) if pick.shape[1] == probes - 1 else np.pad(np.take_along_axis(other, pick, 1), ((0, 0), (0, probes - 1 - pick.shape[1])), mode="edge")
        out[:, t] += t * base ** len(folds)
    return out


def met_before(codes: np.ndarray, i: np.ndarray, j: np.ndarray, bucket: np.ndarray, probes: int = PROBES) -> np.ndarray:
    """Whether rows i and j of codes share a bucket that is smaller than the one given.

    Buckets of different tables are never equal: tables are compared one by one, and pairs
    that are found out are not looked at again.
    """
    found = np.zeros(len(i), bool)
    rest = np.arange(len(i))
    for k in range(0, codes.shape[1], probes):
        mine, other = codes[i[rest], k : k + probes], codes[j[rest], k : k + probes]
        hit = ((mine[:, :, None] == other[:, None, :]) & (mine < bucket[rest, None])[:, :, None]).any((1, 2))
        found[rest[hit]] = True
        rest = rest[~hit]
    return found


def classes(vectors: DataFrame, id_column: str, vector_column: str, d: int) -> tuple[DataFrame, DataFrame]:
    """Comparable rows as (id, h, v), and their distinct vectors (node, h, v, least id, copies), node being a number of its own.

    h is a digest of v that comes before it in keys, so that sorting and joining seldom look at v.
    """
    kind = "float" if vectors.schema[vector_column].dataType.elementType.typeName() == "float" else "double"
    # Adding zero makes one of the two zeros.
    good = vectors.where(comparable(F.col(vector_column), d)).select(F.col(id_column).alias("id"), F.transform(vector_column, lambda x: x.cast(kind) + F.lit(0).cast(kind)).alias("v")).select("id", F.xxhash64("v").alias("h"), "v")
    grouped = cut(good.groupBy("h", "v").agg(F.min("id").alias("least"), F.count("*").alias("copies")))
    return good, cut(grouped.withColumn("node", F.monotonically_increasing_id()))


def links(nodes: DataFrame, d: int, threshold: float = THRESHOLD, tables: int = TABLES, folds: int = FOLDS) -> DataFrame:
    """(node, weight, other): the weight of a node's links found in one group, and the least node it reaches there."""
    width = 1 << (d - 1).bit_length()
    # Buckets and vectors travel as narrow as they can be.
    code = pa.int32() if tables * (2 * width) ** folds < 1 << 31 else pa.int64()
    name, vector = {pa.int32(): "int", pa.int64(): "long"}[code], nodes.schema["v"].dataType.simpleString()
    flips = signs(width, tables=tables, folds=folds)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = matrix(b.column("v"), d)
                x = x / np.abs(x).max(1, keepdims=True)
                found = buckets(x / np.linalg.norm(x, axis=1, keepdims=True), flips).reshape(b.num_rows, -1)
                codes = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * found.shape[1]), pa.array(found.ravel()).cast(code))
                yield pa.RecordBatch.from_arrays([b.column("node"), b.column("copies"), b.column("v"), codes], names=["node", "copies", "v", "codes"])

    keyed = cut(nodes.mapInArrow(hashed, f"node long, copies long, v {vector}, codes array<{name}>"))
    each = keyed.select("node", F.explode(F.array_distinct("codes")).alias("bucket"))
    full = cut(each.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1").select("bucket", "size", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")))
    dealt = (
        join_hot(each, full, ["bucket"], "size", full.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .select("bucket", "node", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select("bucket", "node", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), (F.col("own") <= F.col("other")).alias("left"))
        .join(keyed, "node")
    )

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["bucket", "p", "q"]
        for t in whole_runs(batches, keys):
            begin = starts(t, keys)
            end = np.append(begin[1:], t.num_rows)
            x = matrix(t.column("v"), d)
            x = x / np.abs(x).max(1, keepdims=True)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            width_ = len(t.column("codes")[0])
            codes = t.column("codes").combine_chunks().flatten().to_numpy().reshape(-1, width_)
            bucket, node, copies = t.column("bucket").to_numpy(), t.column("node").to_numpy(), t.column("copies").to_numpy()
            left, p, q = t.column("left").to_numpy(zero_copy_only=False), t.column("p").to_numpy(), t.column("q").to_numpy()
            weight = np.zeros(t.num_rows, np.int64)
            label = np.arange(t.num_rows)

            def settle(i, j, cos):
                ok = cos >= threshold
                i, j = i[ok], j[ok]
                if not len(i):
                    return i, j
                new = ~met_before(codes, i, j, bucket[i])
                np.add.at(weight, i[new], copies[j[new]])
                np.add.at(weight, j[new], copies[i[new]])
                return i[new], j[new]

            small = (end - begin) <= 64
            small &= p[begin] == q[begin]
            found_i, found_j = [], []
            size = (end - begin)[small]
            for k in np.unique(size):
                at = begin[small][size == k]
                upper = np.triu(np.ones((k, k), bool), 1)
                step = max(1, PIECE // max(1, k * max(k, d)))
                for c in range(0, len(at), step):
                    # One product a group, then the exact measure on what comes near.
                    rows = at[c : c + step, None] + np.arange(k)
                    some = x[rows]
                    g, u, v = np.nonzero((some @ some.transpose(0, 2, 1) >= threshold - 1e-9) & upper)
                    i, j = rows[g, u], rows[g, v]
                    f = settle(i, j, np.einsum("ij,ij->i", x[i], x[j]))
                    found_i.append(f[0])
                    found_j.append(f[1])
            for a, b in zip(begin[~small], end[~small], strict=True):
                same = p[a] == q[a]
                rows = np.arange(a, b)
                one, two = (rows, rows) if same else (rows[left[a:b]], rows[~left[a:b]])
                step = max(1, PIECE // max(1, len(two)))
                for c in range(0, len(one), step):
                    u, v = np.nonzero(x[one[c : c + step]] @ x[two].T >= threshold - 1e-9)
                    i, j = one[c : c + step][u], two[v]
                    if same:
                        i, j = i[i < j], j[i < j]
                    for e in range(0, len(i), PIECE // 16):
                        i_, j_ = i[e : e + PIECE // 16], j[e : e + PIECE // 16]
                        f = settle(i_, j_, np.einsum("ij,ij->i", x[i_], x[j_]))
                        label[:] = least_labels(t.num_rows, np.concatenate((np.arange(t.num_rows), f[0])), np.concatenate((label, f[1]))) if len(f[0]) else label
            if found_i:
                label = least_labels(t.num_rows, np.concatenate((np.arange(t.num_rows), *found_i)), np.concatenate((label, *found_j)))
            got = np.flatnonzero((weight > 0) | (label != np.arange(t.num_rows)))
            if len(got):
                yield pa.RecordBatch.from_arrays([pa.array(node[got]), pa.array(weight[got]), pa.array(node[label[got]])], names=["node", "weight", "other"])

    return dealt.repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q").mapInArrow(verified, "node long, weight long, other long")


def near_duplicates(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", threshold: float = THRESHOLD, tables: int = TABLES, folds: int = FOLDS) -> DataFrame:
    """id, n_links, component_id, kept."""
    prepare(vectors.sparkSession)
    found = vectors.where(~usable(F.col(vector_column))).select(id_column, F.lit(0).cast("long").alias("n_links"), F.col(id_column).alias("component_id"))
    for d in lengths(vectors, vector_column):
        found = found.unionByName(of_length(vectors, id_column, vector_column, d, threshold, tables, folds))
    return found.withColumn("kept", F.coalesce(F.col(id_column) == F.col("component_id"), F.lit(False)))


def of_length(vectors: DataFrame, id_column: str, vector_column: str, d: int, threshold: float, tables: int, folds: int) -> DataFrame:
    """id, n_links, component_id of the vectors of d components."""
    members, grouped = classes(vectors, id_column, vector_column, d)
    distinct, rows = grouped.agg(F.count("*"), F.sum("copies")).first()
    found = cut(links(grouped.select("node", "copies", "v"), d, threshold, tables, folds))
    weights = found.groupBy("node").agg(F.sum("weight").alias("weight"))
    reach = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = cut(grouped.select("node", "least", "copies").join(weights, "node", "left").join(reach, "node", "left").withColumn("component", F.coalesce("component", "node")))
    names = cut(named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("of")))
    known = join_hot(named, names, ["component"], "of", distinct).select("node", (F.col("copies") - 1 + F.coalesce("weight", F.lit(0))).alias("n_links"), "component_id")
    of_vector = cut(grouped.select("node", "h", "v", "copies").join(known, "node").drop("node"))
    return join_hot(members, of_vector, ["h", "v"], "copies", rows).select(F.col("id").alias(id_column), "n_links", "component_id")
