"""Operator 5: token counts with a digest cache.

A text's digest (of its normalised content: null is empty, nothing else may change,
for it would change the count) is joined to the counts that the cache holds for the
tokenizer's digest. Only distinct misses are encoded, and appended to the cache. The
cache is a folder with one partition a tokenizer, so that only its counts are read.

Texts are read beside a bitmap of fixed size that tells the missed digests, so that only
missed texts are shuffled (and one in many others, where digests share a bit). Copies of a missed
text are dropped in each task before texts are shuffled, and again behind the shuffle, so neither repeated rows nor null ids are encoded twice and no digest
is hot. The join that brings counts back carries no text and broadcasts the hot digests.

Defined cases: a null text counts as empty and has no tokens; equal texts are encoded
once, repeated rows come back as often as they came in; a special string inside a text
counts as the library does by default; a text is counted whole, whatever its length; a row
with a null id is counted like others; a count at the limit isn't over it; an empty table gives an
empty result; columns beside id and text are never read, so others may have any name.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import cut, exists, fresh_path, join_hot, prepare
from colloquy.operators.substrings import bitmap

LIMIT = 512
CACHE = "digest string, n_tokens long, tokenizer string"
#: Characters whose classes two libraries may see differently, and white space too long for the stack of one of them.
BEYOND, BLANK = re.compile("[^\x00-\u024f]"), re.compile(r"(?<!\s)\s{10000}")
#: Digests that a task remembers while it drops copies; what it forgets is dropped behind the shuffle.
REMEMBERED = 200_000

_loaded: dict[str, Callable[[list[str]], list[int]]] = {}


def tokenizer_digest(path: str) -> str:
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


class Counter:
    """Counts of a byte-level BPE file.

    The same vocabulary runs in tiktoken, which merges faster, for texts of Latin
    characters without endless white space; others go to the library itself.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = iter(range(256, 512))
        byte = {chr(b) if b in plain else chr(next(rest)): b for b in range(256)}
        ranks = {bytes(map(byte.__getitem__, t)): i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t not in special}
        self.encode = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special).encode

    def counts(self, texts: list[str]) -> list[int]:
        encode, whole = self.encode, self.tokenizer.encode
        return [len(whole(t, add_special_tokens=False).ids) if BEYOND.search(t) or BLANK.search(t) else len(encode(t, allowed_special="all")) for t in texts]


def counter(path: str):
    """The worker's counter for a tokenizer file; sentencepiece for .model."""
    if path not in _loaded:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _loaded[path] = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            _loaded[path] = Counter(path).counts
    return _loaded[path]


def read_cache(spark, path: str, version: str) -> DataFrame:
    """(digest as bytes, n_tokens) of a tokenizer; a folder that isn't there yet is an empty cache."""
    held = spark.read.schema(CACHE).parquet(path) if exists(spark, path) else spark.createDataFrame([], CACHE)
    return held.where(F.col("tokenizer") == version).select(F.unhex("digest").alias("digest"), "n_tokens")


def digest_of(text: Column) -> Column:
    """The digest's 32 bytes; the cache holds it in hexadecimal."""
    return F.unhex(F.sha2(text, 256))


def unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows whose digest (binary, the first column) the task hasn't met."""
    seen: set[bytes] = set()
    for b in batches:
        keep = []
        for d in b.column(0).to_pylist():
            keep.append(d not in seen)
            if len(seen) >= REMEMBERED:
                seen.clear()
            seen.add(d)
        yield b.filter(pa.array(keep, pa.bool_()))


def missing_texts(docs: DataFrame, misses: DataFrame, text_column: str) -> DataFrame:
    """(key, text) of the rows that may be misses (digest, as bytes), copies in a task dropped: what is shuffled."""
    key = lambda c: F.xxhash64(c).alias("h")
    missed = docs.sparkSession.sparkContext.broadcast(bitmap(misses.select(key(F.col("digest")))))
    text = F.coalesce(text_column, F.lit(""))

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = missed.value
        for b in batches:
            low = b.column("h").to_numpy().view(np.uint64) & np.uint64(64 * len(words) - 1)
            hit = (words[low >> np.uint64(6)] >> (low & np.uint64(63))) & np.uint64(1)
            yield b.select(["key", "text"]).filter(pa.array(hit.astype(bool)))

    own = docs.select(digest_of(text).alias("key"), text.alias("text")).withColumn("h", key("key"))
    return own.mapInArrow(lambda batches: unseen(wanted(batches)), "key binary, text string")


def encode_misses(docs: DataFrame, misses: DataFrame, path: str, text_column: str) -> DataFrame:
    """(digest, n_tokens) for each missing digest, its text encoded once."""
    texts = missing_texts(docs, misses, text_column)
    # Dealt by digest whatever join is chosen, so that copies from all tasks meet.
    wanted = texts.repartition("key").join(misses.select(F.col("digest").alias("key")), "key", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for b in unseen(batches):
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(count(part.column("text").to_pylist()), pa.int64())], names=["key", "n_tokens"])

    # A task that forgot digests, or ran twice, may give a count again; it's the same.
    counted = wanted.mapInArrow(run, "key binary, n_tokens long").groupBy("key").agg(F.max("n_tokens").alias("n_tokens"))
    return counted.select(F.lower(F.hex("key")).alias("digest"), "n_tokens")


def keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """id, digest and n_bytes of each row."""
    text = F.coalesce(text_column, F.lit(""))
    return docs.select(F.col(id_column).alias("id"), digest_of(text).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))


def fill(docs: DataFrame, digests: DataFrame, path: str, cache: str, text_column: str = "text") -> None:
    """Encode the texts of digests (digest, each once) that the cache lacks, and append their counts to it."""
    version = tokenizer_digest(path)
    misses = cut(digests.select("digest").join(read_cache(docs.sparkSession, cache, version).select("digest"), "digest", "left_anti"))
    new = encode_misses(docs, misses, path, text_column).withColumn("tokenizer", F.lit(version))
    new.write.mode("append").partitionBy("tokenizer").parquet(cache)


def fill_from(docs: DataFrame, path: str, cache: str, text_column: str = "text") -> None:
    """Encode the distinct texts of a batch that the cache lacks."""
    prepare(docs.sparkSession)
    fill(docs, docs.select(digest_of(F.coalesce(text_column, F.lit(""))).alias("digest")).distinct(), path, cache, text_column)


def token_counts(docs: DataFrame, path: str, cache: str | None = None, id_column: str = "doc_id", text_column: str = "text", limit: int = LIMIT) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit. cache: a folder that all machines share and that stays; without, a new one for this session."""
    spark = docs.sparkSession
    prepare(spark)
    cache = cache or fresh_path(spark, "token-counts")
    rows = cut(keyed(docs, id_column, text_column))
    digests = cut(rows.groupBy("digest").agg(F.count("*").alias("n")))
    fill(docs, digests, path, cache, text_column)
    total = digests.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    stored = read_cache(spark, cache, tokenizer_digest(path)).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    found = cut(digests.join(stored, "digest"))
    return join_hot(rows, found, ["digest"], "n", total).select(F.col("id").alias(id_column), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
