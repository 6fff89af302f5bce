"""Operator 12: hard negatives by one-dimensional distance keys.

Components are scaled and floored to integers; a row's score is its inner product with the anchor. One more
component, sqrt(M^2 - |x|^2) with M the greatest length, makes all rows equally long, so the highest scores are the
smallest Euclidean distances. Every row is stored by its nearest of a few pivots and its distance to that,
range-partitioned and sorted by (pivot, distance). A row whose key lies further than r from the anchor's own
distance to the pivot is further than r from the anchor: a search reads the keys within r on both sides of
each pivot's distance, and widens r (annuli already read are left out) until the worst of the best k found lies within r,
or until r passes the least score that may count. What lies outside is then certified not to matter; the result is exact.

First each anchor's positives are searched, then for each positive the negatives whose score is within its
window. Anchors are asked in batches of BATCH, broadcast to the stored rows, which stay where they are; of a round
only the best k of each task are shuffled, and only the k-th score of each search goes to the driver. A
batch reads what its radii reach, so work is batches times that.

Defined cases: rows with a null id or label, a null vector or one with null or non-finite components take no part; zero
vectors do; rows are compared with rows of equally many components, none included; rows that share the anchor's id are not its
candidates; a repeated anchor asks once, with its least (vector, label); repeated candidates count each; equal scores come by smaller
id; fewer than k candidates are all returned; an anchor without positives, or a positive of score below 0, has no rows; an
empty table gives an empty result; columns beside id and vector are read only by label and is_anchor, so others
may have any name. Vectors so long that scores reach 2^53 raise an error: doubles wouldn't be exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.ann import split, squared
from colloquy.llm.common import cut, fresh_path, prepare
from colloquy.llm.vectors import matrix

K, SCALE = 5, 256
#: Anchors of a batch, rows that pivots are fitted on, pivots, bytes of a stored partition and products held at once.
BATCH, SAMPLE, PIVOTS, PART, PRODUCTS = 16_384, 8_192, 64, 16_000_000, 4_000_000
#: Shares of the sampled keys that the radius of a round reaches; the last round reads all that may count.
WIDENING = (0.15, 0.5)
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def integers(v: Column, scale: int) -> Column:
    return F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("double"))


def taking_part(v: Column) -> Column:
    """Not null, and without null or non-finite components."""
    return F.coalesce(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def pivots_of(x: np.ndarray, most: int = PIVOTS, seed: int = 5) -> np.ndarray:
    k = min(most, max(1, len(x) // 64))
    own = split(x.copy(), k, np.random.default_rng(seed)) if k > 1 else np.zeros(len(x), int)
    return np.array([x[own == c].mean(0) for c in np.unique(own)])


class Space:
    """Rows of d components made equally long, and their keys."""

    def __init__(self, longest: float, pivots: np.ndarray) -> None:
        self.longest, self.pivots = longest, pivots  # the square of the greatest length

    def augmented(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(self.longest - (x * x).sum(1), 0))[:, None]])

    def keys(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest pivot of each row and its distance."""
        d = squared(self.augmented(x), self.pivots)
        own = d.argmin(1)
        return own, np.sqrt(d[np.arange(len(x)), own])

    def to_pivots(self, q: np.ndarray) -> np.ndarray:
        """Anchors' distances to the pivots; an anchor's own additional component is 0."""
        return np.sqrt(squared(np.hstack([q, np.zeros((len(q), 1))]), self.pivots))

    @property
    def slack(self) -> float:
        """More than what rounding can put between keys and distances."""
        return 1e-6 * (1 + self.longest**0.5)

    def distance(self, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        """How far a row of this score is from each anchor, at most."""
        return np.sqrt(np.maximum((q * q).sum(1) + self.longest - 2 * score, 0)) + self.slack


class Asks:
    """Searches: rows of anchors, the scores that count, whether candidates have the anchor's label, and annuli."""

    def __init__(self, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool) -> None:
        self.anchor, self.low, self.high, self.same = anchor, low, high, same
        self.number = np.arange(len(anchor))
        self.inner, self.outer = np.full(len(anchor), -1.0), np.zeros(len(anchor))

    def some(self, keep: np.ndarray) -> Asks:
        out = Asks(self.anchor[keep], self.low[keep], self.high[keep], self.same)
        out.number, out.inner, out.outer = self.number[keep], self.inner[keep], self.outer[keep]
        return out


def first_k(ask: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of each ask's k highest scores, smaller ids first among equals."""
    order = np.lexsort((ids, -score, ask))
    a = ask[order]
    begin = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, int)
    rank = np.arange(len(a)) - np.repeat(begin, np.diff(np.r_[begin, len(a)]))
    return order[rank < k]


def scan(space: Space, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, pivot: np.ndarray, key: np.ndarray, q: np.ndarray, q_id: np.ndarray, q_label: np.ndarray, asks: Asks, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ask, id, score) of each ask's best k among stored rows, sorted by pivot and key, within its annuli."""
    far = space.to_pivots(q)[asks.anchor]
    least = asks.low.copy()  # what a row must score to count, as far as k rows of this part say
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    begin = np.flatnonzero(np.r_[True, pivot[1:] != pivot[:-1]]) if len(pivot) else []
    for a, b in zip(begin, [*begin[1:], len(pivot)], strict=True):
        own, d = key[a:b], far[:, pivot[a]]
        lo, hi = a + np.searchsorted(own, d - asks.outer, "left"), a + np.searchsorted(own, d + asks.outer, "right")
        # Rows nearer than the nearest that may count are out as well.
        nearest = np.maximum(space.distance(q[asks.anchor], asks.high) - 2 * space.slack, 0) if np.isfinite(asks.high).all() else np.zeros(len(d))
        lo = np.maximum(lo, a + np.searchsorted(own, nearest - d, "left"))
        hit = np.flatnonzero(lo < hi)
        hit = hit[np.argsort(lo[hit], kind="stable")]
        step = max(1, PRODUCTS // (b - a))
        for at in range(0, len(hit), step):
            g = hit[at : at + step]
            first, last = lo[g].min(), hi[g].max()
            who, back = np.unique(asks.anchor[g], return_inverse=True)
            score = (q[who] @ x[first:last].T)[back]
            place = np.arange(first, last)
            fine = (place >= lo[g, None]) & (place < hi[g, None]) & (score >= least[g, None]) & (score <= asks.high[g, None])
            fine &= (key[first:last] < (d - asks.inner)[g, None]) | (key[first:last] > (d + asks.inner)[g, None])
            fine &= (labels[first:last] == q_label[asks.anchor[g], None]) == asks.same
            fine &= ids[first:last] != q_id[asks.anchor[g], None]
            many = np.flatnonzero(fine.sum(1) > 4 * k)
            if len(many):
                held = np.where(fine[many], score[many], -np.inf)
                fine[many] &= score[many] >= np.partition(held, -k, axis=1)[:, -k][:, None]
            r, c = np.nonzero(fine)
            s, i = score[r, c], ids[first + c]
            top = first_k(r, s, i, k)
            r, s, i = r[top], s[top], i[top]
            found.append((g[r], i, s))
            n = np.bincount(r, minlength=len(g))
            worst = np.full(len(g), np.inf)
            np.minimum.at(worst, r, s)
            least[g] = np.where(n >= k, np.maximum(least[g], worst), least[g])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    ask, i, s = (np.concatenate(c) for c in zip(*found, strict=True))
    top = first_k(ask, s, i, k)
    return asks.number[ask[top]], i[top], s[top]


def stored(rows: DataFrame, space: Space, d: int, n: int) -> DataFrame:
    """Rows (id, label, v) with pivot and key, in order of them, a range a partition."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                pivot, key = space.keys(matrix(b.column("v"), d))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pivot.astype(np.int32)), pa.array(key)], names=["id", "label", "v", "pivot", "key"])

    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-n * (d + 1) * 4 // PART))
    placed = rows.mapInArrow(keyed, "id long, label long, v array<int>, pivot int, key double")
    return cut(placed.repartitionByRange(parts, "pivot", "key", "id").sortWithinPartitions("pivot", "key", "id"))


def searched(index: DataFrame, space: Space, d: int, q: np.ndarray, q_id: np.ndarray, q_label: np.ndarray, asks: Asks, sample: tuple[np.ndarray, np.ndarray], k: int) -> DataFrame:
    """(ask, id, score, rank) of each ask's best k rows, widening the annuli until that is certain."""
    spark = index.sparkSession
    send = spark.sparkContext.broadcast
    reach = widening(space, q, sample)[:, asks.anchor]
    last = np.where(np.isfinite(asks.low), space.distance(q[asks.anchor], np.where(np.isfinite(asks.low), asks.low, 0)), np.inf)
    held = send((q, q_id, q_label))
    kept, need = None, last.copy()
    for radius in [*reach, np.full(len(last), np.inf)]:
        open_ = asks.inner < need
        if not open_.any():
            break
        asks.outer = np.minimum(radius, need)
        now = send(asks.some(open_ & (asks.outer > asks.inner)))

        def run(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            got = [b for b in batches if b.num_rows]
            if got:
                t = pa.Table.from_batches(got).combine_chunks()
                cols = [t.column(c).to_numpy() for c in ("id", "label", "pivot", "key")]
                ask, i, s = scan(space, matrix(t.column("v"), d), *cols, *held.value, now.value, k)
                yield pa.RecordBatch.from_arrays([pa.array(ask, pa.int32()), pa.array(i, pa.int64()), pa.array(s.astype(np.int64))], names=["ask", "id", "score"])

        new = index.mapInArrow(run, "ask int, id long, score long")
        both = new if kept is None else kept.drop("rank").unionByName(new)
        w = Window.partitionBy("ask").orderBy(F.desc("score"), "id")
        kept = cut(both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k))
        asks.inner = np.maximum(asks.inner, asks.outer)
        worst = kept.where(F.col("rank") == k).select("ask", "score").toPandas()  # a number for each search of the batch
        at = worst["ask"].to_numpy(np.int64)
        need[at] = np.minimum(last[at], space.distance(q[asks.anchor[at]], worst["score"].to_numpy(np.float64)))
    return kept if kept is not None else spark.createDataFrame([], "ask int, id long, score long, rank int")


def widening(space: Space, q: np.ndarray, sample: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """For each share and anchor the radius whose annuli hold that share of the sampled keys."""
    pivot, key = (c[:1024] for c in sample)
    parts = [np.quantile(np.abs(space.to_pivots(q[a : a + 1024])[:, pivot] - key), WIDENING, axis=1) for a in range(0, len(q), 1024)]
    return np.hstack(parts)


def mine(vectors: DataFrame, label: Column, is_anchor: Column, k: int = K, low: int = 80, high: int = 100, scale: int = SCALE, id_column: str = "vec_id", vector_column: str = "embedding", batch: int = BATCH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and both scores: for each anchor's k positives the k highest rows of
    another label whose score is low to high hundredths of the positive's. label: integers."""
    spark = vectors.sparkSession
    prepare(spark)
    v = F.col(vector_column)
    rows = vectors.where(F.col(id_column).isNotNull() & taking_part(v)).select(F.col(id_column).cast("long").alias("id"), label.cast("long").alias("label"), integers(v, scale).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("asks")).where("label is not null")
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(square).alias("longest")).collect()  # a row a length
    if any(s["longest"] >= 2.0**53 for s in sizes):
        raise ValueError("scores of 2^53 and more are not exact in doubles")
    path = fresh_path(spark, "hard-negatives")
    spark.createDataFrame([], RESULT).write.parquet(path)
    for d, n, longest in sorted(sizes):
        own = rows.where(F.size("v") == d).withColumn("v", F.col("v").cast("array<int>"))
        if not d:  # empty vectors score as a zero does
            own, d = own.withColumn("v", F.array(F.lit(0))), 1
        drawn = own.select("v").orderBy(F.xxhash64("id"), "id", "v").limit(SAMPLE).toPandas()
        x = np.array(drawn["v"].tolist(), dtype=np.float64).reshape(len(drawn), d)
        space = Space(longest, np.zeros((1, d + 1)))
        space.pivots = pivots_of(space.augmented(x))
        index = stored(own.select("id", "label", "v"), space, d, n)
        # A structure's least is that of its first field, then the next: one of the rows that share an id.
        anchors = cut(own.where("asks").groupBy("id").agg(F.min(F.struct("v", "label")).alias("a")).select("id", "a.v", "a.label"))
        batches = max(1, -(-anchors.count() // batch))
        for at in range(batches):
            a = anchors.where(F.pmod(F.xxhash64("id"), F.lit(batches)) == at).orderBy("id").toPandas()
            if not len(a):
                continue
            q, q_id, q_label = np.array(a["v"].tolist(), dtype=np.float64).reshape(len(a), d), a["id"].to_numpy(), a["label"].to_numpy()
            every = np.full(len(a), np.inf)
            positives = searched(index, space, d, q, q_id, q_label, Asks(np.arange(len(a)), -every, every, True), space.keys(x), k)
            scores = positives.select("ask", "rank", "score").orderBy("ask", "rank").toPandas()  # k numbers an anchor
            scores = scores[scores["score"] >= 0]
            p = scores["score"].to_numpy(np.int64)
            wanted = Asks(scores["ask"].to_numpy(np.int64), -(-low * p // 100) * 1.0, high * p // 100 * 1.0, False)
            negatives = searched(index, space, d, q, q_id, q_label, wanted, space.keys(x), k)
            named = spark.createDataFrame([(i, int(r.ask), int(r.rank), int(q_id[r.ask])) for i, r in enumerate(scores.itertuples())], "search int, ask int, rank int, anchor_id long")
            pairs = positives.join(F.broadcast(named), ["ask", "rank"]).select("search", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
            out = negatives.withColumnRenamed("ask", "search").join(pairs, "search").select("anchor_id", "positive_id", F.col("rank").cast("int"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
            out.write.mode("append").parquet(path)
    return spark.read.schema(RESULT).parquet(path)
