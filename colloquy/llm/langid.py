"""Operator 8: language identification by multilingual mixture inference.

Letter trigrams of all learned documents give each language a conditional model. A
document is a mixture of languages: the trigrams of each word give its likelihood in each
language, expectation-maximisation estimates the proportions, and the language set is
the one of largest likelihood less a penalty for each language beyond the first. The
prediction is the language of largest proportion in that set, the score its proportion.

Defined cases: null texts and texts without a letter are ``und`` with score 0; rows with a null
language teach nothing; rows with a null id count as those of empty id text; without anything
learned every text is ``und``; ties go to the language that sorts first; repeated rows are predicted
one by one; texts are read whole, whatever their length; an empty table gives an empty result; columns
beside id, text and language are never read, so others may have any name.

The model takes SIZE**3 floats a language on the driver and in each worker: languages are few, documents many.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import crc_bucket, prepare

#: Letter classes: 0 for all that is no letter, a to z, then the rest dealt over the others.
SIZE = 64
ROUNDS, PENALTY = 10, 4.0
#: Characters of texts that are worked on at once.
PIECE = 400_000


def letter_table() -> np.ndarray:
    """Letter class of a code point below 0x3000; beyond, the point's remainder picks one."""
    table = np.zeros(0x3000, np.int32)
    for p in range(0x3000):
        c = chr(p).lower()[0]
        if chr(p).isalpha():
            table[p] = ord(c) - 96 if "a" <= c <= "z" else 27 + ord(c) % (SIZE - 27)
    return table


TABLE = letter_table()


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    c = TABLE[np.minimum(points, len(TABLE) - 1)]
    far = points >= len(TABLE)
    if far.any():
        letter = np.fromiter((chr(p).isalpha() for p in points[far]), bool, int(far.sum()))
        c[far] = np.where(letter, 27 + points[far] % (SIZE - 27), 0)
    return c


def trigrams(c: np.ndarray) -> np.ndarray:
    return (c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:]


def pieces(values: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about PIECE characters: (first position, texts)."""
    at, held, size = 0, [], 0
    for i, v in enumerate(values):
        held.append(v or "")
        size += len(held[-1])
        if size >= PIECE:
            yield at, held
            at, held, size = i + 1, [], 0
    if held:
        yield at, held


def learn(docs: DataFrame, text_column: str = "text", lang_column: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order and SIZE**3 x languages log probabilities of a letter after two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            langs = b.column(lang_column).to_pylist()
            for at, texts in pieces(b.column(text_column).to_pylist()):
                by: dict[str, list[str]] = {}
                for lang, t in zip(langs[at : at + len(texts)], texts, strict=True):
                    by.setdefault(lang, []).append(t)
                for lang, some in by.items():
                    n = np.bincount(trigrams(classes("  ".join(["", *some, ""]))), minlength=SIZE**3)
                    total[lang] = total[lang] + n if lang in total else n
        for lang, n in total.items():
            got = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(got), pa.string()), pa.array(got), pa.array(n[got])], names=["lang", "tri", "n"])

    counted = docs.where(F.col(lang_column).isNotNull()).select(text_column, lang_column).mapInArrow(run, "lang string, tri long, n long").groupBy("lang", "tri").agg(F.sum("n").alias("n"))
    rows = counted.toPandas()  # SIZE**3 rows a language at most
    langs = sorted(rows["lang"].unique())
    model = np.zeros((SIZE**3, len(langs)), np.float32)
    for k, lang in enumerate(langs):
        c = np.zeros(SIZE**3)
        own = rows[rows["lang"] == lang]
        c[own["tri"].to_numpy(dtype=np.int64)] = own["n"].to_numpy()
        c = c.reshape(SIZE, SIZE, SIZE)
        p = (c.sum((0, 1)) + 1) / (c.sum() + SIZE)
        two = c.sum(0)
        p = (two + p) / (two.sum(1, keepdims=True) + 1)
        model[:, k] = np.log((c + p[None]) / (c.sum(2, keepdims=True) + 1)).ravel()
    return langs, model


def mixture(like: np.ndarray, doc: np.ndarray, first: np.ndarray, size: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the allowed languages in each document and its log likelihood, from word likelihoods."""
    share = allowed / allowed.sum(1, keepdims=True)
    for _ in range(ROUNDS):
        r = like * share[doc]
        r /= r.sum(1, keepdims=True)
        share = np.add.reduceat(r, first, axis=0) / size[:, None]
    return share, np.add.reduceat(np.log((like * share[doc]).sum(1)), first)


def infer(texts: list[str], model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(language number or -1, score) of each text."""
    lang, score = np.full(len(texts), -1), np.zeros(len(texts))
    # A text ends in a point that stands for nothing else, so words keep their document.
    parts = [classes(t) for t in texts]
    length = np.array([len(p) + 2 for p in parts])
    flat = np.concatenate([x for p in parts for x in (np.zeros(2, np.int32), p)] + [np.zeros(2, np.int32)])
    of = np.repeat(np.arange(len(texts)), length)
    begin = np.flatnonzero((flat[1:] > 0) & (flat[:-1] == 0)) + 1
    if not len(begin) or not model.shape[1]:
        return lang, score
    end = np.flatnonzero((flat[1:] == 0) & (flat[:-1] > 0)) + 1
    # The trigram that ends at each position; a word's are those of its letters and of its end.
    logp = model[trigrams(flat)]
    edges = np.column_stack((begin - 2, end - 1)).ravel()
    word = np.add.reduceat(logp, np.minimum(edges, len(logp) - 1), axis=0)[::2].astype(np.float64)
    doc_of = of[begin]
    seen, first, size = np.unique(doc_of, return_index=True, return_counts=True)
    doc = np.repeat(np.arange(len(seen)), size)
    top = word.max(1, keepdims=True)
    like = np.maximum(np.exp(word - top), 1e-12)
    n, k = len(seen), model.shape[1]
    sums = np.add.reduceat(np.log(like), first, axis=0)
    # The best language alone.
    share = np.zeros((n, k))
    best = sums.argmax(1)
    share[np.arange(n), best] = 1
    fit = sums[np.arange(n), best]
    open_ = np.arange(n)
    for m in range(2, k + 1):
        # Sets grow by the language that, added to the set of m - 1, has most of the words it explains best.
        rows = np.isin(doc, open_)
        at = np.cumsum(np.isin(np.arange(n), open_)) - 1
        d, l_ = at[doc[rows]], like[rows]
        f = np.searchsorted(d, np.arange(len(open_)))
        s = size[open_]
        full, _ = mixture(l_, d, f, s, np.ones((len(open_), k)))
        full[share[open_] > 0] = np.inf
        order = np.argsort(-full, axis=1, kind="stable")[:, :m]
        may = np.zeros((len(open_), k))
        np.put_along_axis(may, order, 1.0, 1)
        new, value = mixture(l_, d, f, s, may)
        better = value - PENALTY * (1 + np.log(s)) > fit[open_]
        won = open_[better]
        share[won], fit[won] = new[better], value[better]
        open_ = won
        if not len(open_):
            break
    lang[seen] = share.argmax(1)
    score[seen] = share.max(1)
    return lang, np.clip(score, 0, 1)


def predict(docs: DataFrame, langs: list[str], model: np.ndarray, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, lang_pred, score."""
    prepare(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)  # SIZE**3 floats a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*langs, "und"]
        for b in batches:
            for at, texts in pieces(b.column(text_column).to_pylist()):
                lang, score = infer(texts, sent.value)
                yield pa.RecordBatch.from_arrays([b.column(id_column).slice(at, len(texts)), pa.array([names[k] for k in lang], pa.string()), pa.array(score)], names=[id_column, "lang_pred", "score"])

    return docs.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, lang_pred string, score double")


def identify(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """id, held_out, lang_pred, score; learned from rows that are not held out."""
    prepare(docs.sparkSession)
    held_out = crc_bucket(F.col(id_column), 4) == 2
    langs, model = learn(docs.where(~held_out), text_column, lang_column)
    return predict(docs, langs, model, id_column, text_column).select(id_column, held_out.alias("held_out"), "lang_pred", "score")
