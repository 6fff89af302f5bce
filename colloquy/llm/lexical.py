"""Operator 13: ranked lexical search over a bit-sliced impact index.

Terms are runs of letters, digits and all characters beyond ASCII, A-Z lower-cased. Documents are
read once for the terms that are asked: each becomes its number of terms and the asked terms with their
counts. From these come the statistics (documents, terms, documents a term) over the whole table, and a second
pass builds the index where the documents lie: for each BLOCK documents and each term, impacts (integers) are
held as bitmaps, one a binary digit. A query adds its terms' bitmaps by carry-save steps, three numbers to two, and
one ripple of carries; the best documents are found from the most significant slice down: documents with the
digit go ahead as long as there are at least as many as wanted, the others wait. Each task keeps the best of its blocks,
so k rows a query and task are shuffled.

Items are asked in batches of about ITEM_CHARS characters of distinct text, each of which reads the documents
once; what is broadcast is bounded by that. Scores are 64-bit integers.

Defined cases: null and empty texts have no terms, as items and as documents; a term that an item repeats counts as
often; items of equal text are answered once and each gets the rows; documents of equal id count each; of equal
scores the smaller id comes first, a null id last; a null item id is an id; a text is read whole, whatever its
length; empty tables give an empty result; only ids and texts are read, so other columns may have any name.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import cut, join_hot, prepare

K, BLOCK, ITEM_CHARS = 20, 16_384, 4_000_000
#: Bytes of bitmaps that a block keeps for terms that come again.
HELD = 64_000_000
#: What separates terms, as blanks; A-Z as a-z; bytes of characters beyond ASCII stay.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def impacts(weights: np.ndarray, tf: np.ndarray, n: np.ndarray, documents: int, total: int) -> np.ndarray:
    m = 75 + 25 * n * documents // total
    return weights * (1_000_000_000 * tf // (1000 * tf + 12 * m))


def sliced(positions: np.ndarray, values: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps of values at positions, one a binary digit, least first."""
    width = int(values.max()).bit_length()
    digits = ((values[None] >> np.arange(width)[:, None]) & 1).astype(np.uint8)
    flat = np.zeros((width, words * 64), np.uint8)
    flat[:, positions] = digits
    return np.packbits(flat, axis=1, bitorder="little").view(np.uint64)


def added(numbers: list[tuple[np.ndarray, int]], width: int, words: int) -> np.ndarray:
    """The sum of bit-sliced numbers, each moved up by some slices, which fits into width slices."""
    queue = []
    for slices, up in numbers:
        wide = np.zeros((width, words), np.uint64)
        wide[up : up + len(slices)] = slices
        queue.append(wide)
    while len(queue) > 2:
        a, b, c = queue.pop(), queue.pop(), queue.pop()
        half = a ^ b
        a &= b
        b = half & c
        half ^= c
        a |= b
        carry = np.empty_like(a)
        carry[0] = 0
        carry[1:] = a[:-1]
        queue += [carry, half]
    if len(queue) == 2:
        a, b = queue
        carry = np.zeros(words, np.uint64)
        for i in range(width):
            half = a[i] ^ b[i]
            both = a[i] & b[i]
            a[i] = half ^ carry
            carry = both | (half & carry)
        return a
    return queue[0] if queue else np.zeros((0, words), np.uint64)


def best(slices: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and values of the k highest values above 0, of equal values the first positions."""
    if not len(slices):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sure, open_ = np.zeros_like(slices[0]), np.bitwise_or.reduce(slices, axis=0)
    for s in slices[::-1]:
        ahead = sure | (open_ & s)
        n = int(np.bitwise_count(ahead).sum())
        if n > k:
            open_ = open_ & s
        else:
            sure, open_ = ahead, open_ & ~s
            if n == k:
                open_ = np.zeros_like(open_)
                break
    listed = lambda m: np.flatnonzero(np.unpackbits(m.view(np.uint8), bitorder="little"))
    first = listed(sure)
    found = np.concatenate([first, listed(open_)[: k - len(first)]])
    digits = (slices[:, found // 64] >> (found % 64).astype(np.uint64)) & np.uint64(1)
    values = (digits.astype(np.int64) << np.arange(len(slices))[:, None]).sum(0)
    order = np.lexsort((found, -values))
    return found[order], values[order]


class Block:
    """The index of some documents, in the order of their ids."""

    def __init__(self, n: np.ndarray, rows: np.ndarray, term: np.ndarray, tf: np.ndarray, weights: np.ndarray, documents: int, total: int) -> None:
        """rows, term, tf: the postings, by row."""
        self.words = -(-len(n) // 64)
        value = impacts(weights[term], tf, n[rows], documents, total)
        order = np.argsort(term, kind="stable")
        self.rows, self.value, term = rows[order], value[order], term[order]
        names, first = np.unique(term, return_index=True)
        self.at = {int(t): (int(a), int(b)) for t, a, b in zip(names, first, [*first[1:], len(term)], strict=True)}
        self.held: dict[int, np.ndarray] = {}
        self.bytes = 0

    def slices(self, term: int) -> np.ndarray:
        if term not in self.held:
            a, b = self.at[term]
            made = sliced(self.rows[a:b], self.value[a:b], self.words)
            if self.bytes + made.nbytes > HELD:
                self.held.clear()
                self.bytes = 0
            self.held[term] = made
            self.bytes += made.nbytes
        return self.held[term]

    def search(self, asked: list[tuple[int, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
        """asked: terms, each with how often it counts."""
        numbers, most = [], 0
        for term, times in asked:
            if term in self.at and len(s := self.slices(term)):
                a, b = self.at[term]
                most += int(self.value[a:b].max()) * times
                numbers += [(s, up) for up in range(times.bit_length()) if times >> up & 1]
        return best(added(numbers, most.bit_length(), self.words), k)


def postings(docs: DataFrame, vocabulary, id_column: str, text_column: str) -> DataFrame:
    """id, n (terms), terms (numbers in the broadcast vocabulary) and their counts, for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value
        size = len(number) + 1
        for b in batches:
            sizes, keys = [], []
            for i, text in enumerate(b.column("text").cast(pa.binary()).to_pylist()):
                found = terms(text) if text else []
                sizes.append(len(found))
                own = np.fromiter(filter(None, map(number.get, found)), np.int64)
                keys.append(own + i * size)
            key, tf = np.unique(np.concatenate(keys), return_counts=True) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            row, term = key // size, key % size - 1
            offsets = pa.array(np.searchsorted(row, np.arange(b.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v, pa.int32())) for v in (term, tf)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(sizes, pa.int64()), *lists], names=["id", "n", "terms", "tf"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(run, f"id {kind}, n long, terms array<int>, tf array<int>")


def holding(index: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each of the terms; a task sends one row a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size, np.int64)
        for b in batches:
            n += np.bincount(b.column("terms").flatten().to_numpy(), minlength=size)
        t = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), pa.array(n[t])], names=["term", "n"])

    counted = index.mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size, np.int64)
    out[counted["term"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
    return out


def searcher(queries, weights, documents: int, total: int, k: int, block: int):
    """A mapInArrow function over postings: (item, id, score) of each item's best k in the task. queries, weights: broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, kept = queries.value, {}

        def look(held: list[pa.RecordBatch]) -> None:
            t = pa.Table.from_batches(held).combine_chunks()
            t = t.take(pc.sort_indices(t.column("id"), null_placement="at_end")).combine_chunks()
            lists = [t.column(c).combine_chunks() for c in ("terms", "tf")]
            rows = np.repeat(np.arange(t.num_rows), pc.list_value_length(lists[0]).to_numpy())
            own = Block(t.column("n").to_numpy(), rows, *(v.flatten().to_numpy().astype(np.int64) for v in lists), weights.value, documents, total)
            for item, need in asked:
                at, score = own.search(need, k)
                if len(at):
                    now = [*kept.get(item, []), (t.column("id").take(pa.array(at)).combine_chunks(), score)]
                    kept[item] = now if sum(len(s) for _, s in now) < 8 * k else [least(now)]

        def least(now: list) -> tuple:
            ids, score = pa.concat_arrays([i for i, _ in now]), np.concatenate([s for _, s in now])
            t = pa.table({"s": score, "i": ids})
            top = pc.sort_indices(t, sort_keys=[("s", "descending"), ("i", "ascending")], null_placement="at_end")[:k]
            return ids.take(top), score[top.to_numpy()]

        held, n = [], 0
        for b in batches:
            while b.num_rows:
                part = b.slice(0, block - n)
                held.append(part)
                n, b = n + part.num_rows, b.slice(part.num_rows)
                if n == block:
                    look(held)
                    held, n = [], 0
        if n:
            look(held)
        for item, now in kept.items():
            ids, score = least(now)
            yield pa.RecordBatch.from_arrays([pa.array([item] * len(score), pa.int32()), ids, pa.array(score, pa.int64())], names=["item", "id", "score"])

    return run


def search(items: DataFrame, docs: DataFrame, k: int = K, item_id: str = "item_id", item_text: str = "text", doc_id: str = "doc_id", doc_text: str = "text", block: int = BLOCK, item_chars: int = ITEM_CHARS) -> DataFrame:
    """item id, rank (from 1), doc id, score: each item's k documents of highest score above 0."""
    spark = docs.sparkSession
    prepare(spark)
    text = F.coalesce(F.col(item_text).cast("string"), F.lit(""))
    rows = items.select(F.col(item_id).alias("_item"), F.sha2(text, 256).alias("key"), text.alias("text"))
    asked = rows.groupBy("key").agg(F.first("text").alias("text"), F.count("*").alias("n"))
    asked = cut(asked)
    total_items, chars = asked.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.length("text") + 1), F.lit(0))).first()
    batches = max(1, -(-chars // item_chars))
    kind = docs.schema[doc_id].dataType.simpleString()
    found = spark.createDataFrame([], f"key string, id {kind}, score long")
    for batch in range(batches):
        some = asked.where(F.pmod(F.xxhash64("key"), F.lit(batches)) == batch).select("key", "text").toPandas()
        need = [Counter(terms(t.encode())) for t in some["text"]]
        number = {t: i + 1 for i, t in enumerate(sorted(set().union(*need)))}
        if not number:
            continue
        index = cut(postings(docs, spark.sparkContext.broadcast(number), doc_id, doc_text))
        documents, total = index.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        weights = np.array([weight(documents, int(n)) for n in holding(index, len(number))], np.int64)
        send = spark.sparkContext.broadcast
        queries = [(i, [(number[t] - 1, times) for t, times in c.items()]) for i, c in enumerate(need) if c]
        got = index.where("size(terms) > 0").mapInArrow(searcher(send(queries), send(weights), documents, total, k, block), f"item int, id {kind}, score long")
        keys = spark.createDataFrame([(i, key) for i, key in enumerate(some["key"])], "item int, key string")
        found = found.unionByName(got.join(F.broadcast(keys), "item").select("key", "id", "score"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("id")))).where(F.col("rank") <= k)
    lists = ranked.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("best"))  # k rows a key
    each = join_hot(rows.select("_item", "key"), asked.select("key", "n").join(lists, "key"), ["key"], "n", total_items)
    return each.select("_item", F.explode("best").alias("b")).select(F.col("_item").alias(item_id), F.col("b.rank").cast("int").alias("rank"), F.col("b.id").alias(doc_id), F.col("b.score").alias("score"))
