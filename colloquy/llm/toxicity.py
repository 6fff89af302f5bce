"""Operator 4: toxicity of restored text.

A noisy channel disguises words by look-alike characters, separators and repeated
letters. Each suspicious token becomes a lattice of what its characters may stand for; a
Viterbi decode under a character trigram model of the whole corpus picks the reading, and
the restored text is scored. Tokens whose lattice has one path are their own reading.

The score comes from words and word beginnings that are commoner in toxic documents:
document frequencies by label give each a lower confidence bound of its log odds, and a
logistic regression on a document's three strongest words and its length gives the score.
The classifier is fitted on SAMPLE labelled rows of each label at most (those of least id digest),
each weighing as many labels as it stands for, so that the share of toxic ones is that of all labels;
its features are all that LEAST_DOCS toxic documents of the sample hold, or more, and that a lower bound on their lift speaks for.
The character model counts every document.

Defined cases: a null or empty text has no words and gets the score that the regression gives
to a text without evidence; a text is read whole, in time that grows with its length alone; without
labels of both kinds every score is the smoothed share of toxic ones, at most 0.49 without a toxic label;
rows with a null id are scored and never learned from; repeated rows are scored one by one, and of the rows
of one labelled id the text of least digest is learned; several labels of an id count as the largest; of
equally likely readings the decode keeps the first it meets, and of features of equal bound the first by code points;
an empty table gives an empty result; columns beside id and text are never read, so others may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from heapq import nlargest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import crc_bucket, cut, prepare

SAMPLE, LEAST_DOCS = 10_000, 3
PREFIXES = (4, 5, 6)
#: What a worker remembers: words, and the longest of them. Other words are read again.
REMEMBERED, LONGEST = 400_000, 64

#: Letters of the model: the boundary first; anything else folds to the last.
LETTERS = " abcdefghijklmnopqrstuvwxyzàâáäçéèêëíîïñóôöúûüùßœ*"
SIZE = len(LETTERS)
OTHER = SIZE - 1
# What a character may stand for in disguise.
STANDS_FOR = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
SEPARATORS = "._-*~"
_SYMBOLS = re.escape("".join(STANDS_FOR))
#: Log probabilities of the channel: a substitution, a dropped separator, a repeated letter.
SUBSTITUTED, DROPPED, REPEATED = -1.0, -0.5, -1.0

SUSPICIOUS = re.compile(rf"[^\W\d_][{_SYMBOLS}]+[^\W\d_]|^[{_SYMBOLS}]+[^\W\d_]{{2}}|[^\W\d_]{{2}}[0-9@$](?:[.,;:!?]*)$|[^\W\d_][{re.escape(SEPARATORS)}]+[^\W\d_][{re.escape(SEPARATORS)}]+[^\W\d_]|([^\W\d_])\1\1", re.IGNORECASE)
SPACED = re.compile(rf"(?<!\S)[^\W_](?: [^\W_]){{2,}}(?!\S)|(?<!\S)[\w{_SYMBOLS}](?: [\w{_SYMBOLS}]){{3,}}(?!\S)")
#: What each match of SPACED holds; quick to look for.
ALONE = re.compile(r" \S \S(?!\S)")
#: A lower-cased word of letters alone, but for these at its end, is suspicious by a letter three times in a row only.
ENDS = ".,;:?!&#*\"')"
TRIPLE = re.compile(r"(.)\1\1")
#: From the first word character to the last.
CORE = re.compile(r"\w(?:.*\w)?", re.DOTALL)


def codes(text: str, table: np.ndarray) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return table[np.minimum(points, len(table) - 1)]


def letter_table() -> np.ndarray:
    """Model letter of a code point; the last entry stands for all beyond."""
    table = np.zeros(0x2001, np.int32)
    for p in range(0x2000):
        c = chr(p)
        if c.isalpha():
            table[p] = LETTERS.find(c.lower()[0], 1)
            if table[p] < 0:
                table[p] = OTHER
    table[-1] = OTHER
    return table


def trigram_counts(docs: DataFrame, text_column: str = "text") -> np.ndarray:
    """SIZE**3 counts over all texts."""
    table = letter_table()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE**3, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 200):
                texts = b.column(text_column).slice(at, 200).to_pylist()
                c = codes("  ".join(["", *(t for t in texts if t), ""]), table)
                tri = (c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:]
                total += np.bincount(tri, minlength=len(total))
        got = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(got), pa.array(total[got])], names=["tri", "n"])

    counted = docs.select(text_column).mapInArrow(run, "tri long, n long").groupBy("tri").agg(F.sum("n").alias("n"))
    out = np.zeros(SIZE**3)
    for tri, n in counted.collect():  # SIZE**3 rows at most
        out[tri] = n
    return out


def language_model(counts: np.ndarray, mass: float = 2.0) -> np.ndarray:
    """SIZE x SIZE x SIZE log probabilities of a letter after two, backing off to one and none."""
    c = counts.reshape(SIZE, SIZE, SIZE)
    p = (c.sum((0, 1)) + 1) / (c.sum() + SIZE)
    two = c.sum(0)
    p = (two + mass * p) / (two.sum(1, keepdims=True) + mass)
    p = (c + mass * p[None]) / (c.sum(2, keepdims=True) + mass)
    return np.log(p).astype(np.float32)


def lattice(token: str) -> Iterator[list[tuple[str, float]]]:
    """For each run of equal characters the readings and their channel log probabilities."""
    for m in re.finditer(r"(.)\1*", token, re.DOTALL):
        c, n = m.group(1), len(m.group())
        if c.isalpha():
            yield [(c * n, 0.0)] if n < 3 else [(c, REPEATED), (c * 2, REPEATED)]
        elif c in STANDS_FOR:
            yield [(x * k, SUBSTITUTED * k) for x in STANDS_FOR[c] for k in {1, min(n, 2)}]
        else:
            yield [("", DROPPED)]


def written(node: tuple | None) -> str:
    """The text of a path: readings linked from the last one back."""
    parts = []
    while node:
        node, reading = node
        parts.append(reading)
    return "".join(reversed(parts))


def decode(token: str, model) -> str:
    """The likeliest reading of a token, lower-cased, from boundary to boundary.

    model: log probabilities by two letters and the next, as nested lists or an array. A state is the last two letters; it holds its best path as a chain of readings, which
    paths share, so that time and memory grow with the token's length alone.
    """
    index = LETTERS.find
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for choices in lattice(token):
        new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, path) in states.items():
            for reading, cost in choices:
                s, x, y = score + cost, a, b
                for c in reading:
                    k = index(c, 1)
                    k = OTHER if k < 0 else k
                    s += model[x][y][k]
                    x, y = y, k
                if (x, y) not in new or new[x, y][0] < s:
                    new[x, y] = (s, (path, reading))
        states = new
    if not token:
        return token
    return written(max(((s + model[a][b][0], n, path) for n, ((a, b), (s, path)) in enumerate(states.items())), key=lambda x: (x[0], -x[1]))[2])


class Known(dict):
    """What words give; those that are not remembered are read."""

    def __init__(self, read: Callable[[str], int]):
        super().__init__()
        self.read = read

    def __missing__(self, word: str) -> int:
        got = self.read(word)
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = got
        return got


@dataclass
class Scorer:
    """Restores and scores texts in a worker; remembers words."""

    model: np.ndarray
    #: feature -> (toxic, other) documents of the sample
    features: dict[str, tuple[int, int]] = field(default_factory=dict)
    n1: int = 0
    n0: int = 0
    weights: np.ndarray | None = None
    means: np.ndarray | None = None
    scales: np.ndarray | None = None
    constant: float = 0.0
    #: The rank of a word's strongest feature, 0 for none.
    known: Known | None = None
    #: Distinct counts of features, by rising odds: the first, of rank 0, stand for none.
    counts: list[tuple[int, int] | None] = field(default_factory=list)
    ranks: dict[str, int] = field(default_factory=dict)
    #: counts to take away -> the odds of each rank
    bounds: dict[tuple[int, int], list[float]] = field(default_factory=dict)
    #: The model as nested lists, which single values are read from faster.
    table: list | None = None

    def decoded(self, token: str) -> str:
        if self.table is None:
            self.table = self.model.tolist()
        return decode(token, self.table)

    def read_word(self, word: str) -> str:
        """The word without punctuation at its ends, restored if it is suspicious."""
        word = word.lower()
        stem = word.rstrip(ENDS)
        if stem.isalpha() and not TRIPLE.search(stem):
            return stem
        if SUSPICIOUS.search(word):
            plain = word.rstrip(".,;:?!")
            return self.decoded(plain or word)
        core = CORE.search(word)
        return core.group() if core else ""

    def restore(self, text: str) -> str:
        text = SPACED.sub(lambda m: self.decoded(m.group().lower().replace(" ", "")), text)
        return " ".join(self.read_word(w) if SUSPICIOUS.search(w) else w for w in text.split(" "))

    def words(self, text: str) -> set[str]:
        """Distinct words as written, and readings of letters spaced out."""
        found = set(text.split())
        if ALONE.search(text):
            for m in SPACED.finditer(text):
                found.add(self.decoded(m.group().lower().replace(" ", "")))
        return found

    def odds(self, n: tuple[int, int], less: tuple[int, int] = (0, 0)) -> float:
        """A lower bound of the log odds that a feature speaks for the label."""
        a, b = n[0] - less[0] + 0.5, n[1] - less[1] + 0.5
        return float(np.log(a / (self.n1 + 1)) - np.log(b / (self.n0 + 1)) - np.sqrt(1 / a + 1 / b))

    def ranked(self, less: tuple[int, int] = (0, 0)) -> list[float]:
        """The odds of each rank, worked out once for all texts."""
        if self.known is None:
            odds = {n: self.odds(n) for n in set(self.features.values())}
            self.counts = [None, *sorted((n for n, o in odds.items() if o > 0), key=lambda n: (odds[n], n))]
            rank = {n: k for k, n in enumerate(self.counts)}
            self.ranks = {f: rank[n] for f, n in self.features.items() if n in rank}
            self.known = Known(self.word)
        if less not in self.bounds:
            with np.errstate(invalid="ignore", divide="ignore"):  # of features that no document of this label holds
                self.bounds[less] = [0.0, *(self.odds(n, less) for n in self.counts[1:])]
        return self.bounds[less]

    def word(self, written: str) -> int:
        """The rank of the word's strongest feature, 0 for none."""
        ranks = self.ranks
        return max([ranks.get(f, 0) for f in features_of(self.read_word(written))], default=0)

    def evidence(self, text: str, less: tuple[int, int] = (0, 0)) -> list[float]:
        """The three largest log odds of different features, and the length."""
        words, bounds = self.words(text), self.ranked(less)
        found = set(map(self.known.__getitem__, words)) - {0}
        if less == (0, 0):  # ranks go by the odds
            odds = [bounds[n] for n in nlargest(3, found)]
        else:
            odds = nlargest(3, [bounds[n] for n in found])
        odds = [max(0.0, o) for o in odds] + [0.0] * (3 - len(odds))
        return [*odds, float(np.log1p(len(words)))]

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return self.constant
        x = (np.array(self.evidence(text or "")) - self.means) / self.scales
        return float(1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -30, 30))))


def features_of(word: str) -> list[str]:
    return [word, *["^" + word[:k] for k in PREFIXES if len(word) > k]] if word else []


def logistic(x: np.ndarray, y: np.ndarray, each: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights, the constant first, by Newton's method; each: how many rows a row stands for."""
    a = np.column_stack((np.ones(len(x)), x))
    w = np.zeros(a.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (each * p * (1 - p) + 1e-9)[:, None]).T @ a + penalty, a.T @ (each * (y - p)) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> Scorer:
    """Learn from labels (id, label); rows to hold out are to be left out of labels."""
    prepare(docs.sparkSession)
    scorer = Scorer(language_model(trigram_counts(docs, text_column)))
    each = labels.where(F.col(id_column).isNotNull() & F.col(label_column).isNotNull()).groupBy(F.col(id_column).alias("id")).agg(F.max(F.col(label_column)).cast("int").alias("y"))
    whole = {y: n for y, n in each.where("y in (0, 1)").groupBy("y").count().collect()}
    stands_for = [max(1.0, whole.get(y, 0) / sample) for y in (0, 1)]
    digest = F.xxhash64("id")
    chosen = each.where("y = 1").orderBy(digest, "id").limit(sample).unionByName(each.where("y = 0").orderBy(digest, "id").limit(sample))
    chosen = F.broadcast(cut(chosen))  # twice the sample at most
    learned = docs.select(F.col(id_column).alias("id"), F.coalesce(text_column, F.lit("")).alias("text")).join(chosen, "id")
    # One text an id, so that no id brings more rows than the sample has.
    learned = cut(learned.groupBy("id").agg(F.max("y").alias("y"), F.min(F.struct(F.xxhash64("text").alias("digest"), "text")).alias("least")).select("y", F.col("least.text").alias("text")))

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 100):
                part = b.slice(at, 100)
                f, y = [], []
                for text, label in zip(part.column("text").to_pylist(), part.column("y").to_pylist(), strict=True):
                    own = {x for w in scorer.words(text) for x in features_of(scorer.read_word(w))}
                    f += own
                    y += [label] * len(own)
                yield pa.RecordBatch.from_arrays([pa.array(f, pa.string()), pa.array(y, pa.int32())], names=["f", "y"])

    n = {y: n for y, n in learned.groupBy("y").count().collect()}
    scorer.n1, scorer.n0 = n.get(1, 0), n.get(0, 0)
    all0, all1 = scorer.n0 * stands_for[0], scorer.n1 * stands_for[1]
    scorer.constant = (all1 + 0.5) / (all1 + all0 + 1) if scorer.n1 else min(0.49, 0.5 / (all0 + 1))
    if not (scorer.n1 and scorer.n0):
        return scorer
    counts = learned.select("text", "y").mapInArrow(seen, "f string, y int").groupBy("f").agg(F.sum("y").cast("int").alias("a"), F.sum(F.lit(1) - F.col("y")).cast("int").alias("b"))
    lift = F.log((F.col("a") + 0.5) / (scorer.n1 + 1)) - F.log((F.col("b") + 0.5) / (scorer.n0 + 1)) - F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    best = counts.where(F.col("a") >= LEAST_DOCS).withColumn("lift", lift).where("lift > 0").select("f", "a", "b")
    scorer.features = {r["f"]: (r["a"], r["b"]) for r in best.collect()}

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # A learned document's own count is taken away, so it is scored as a new one.
            rows = [scorer.evidence(t, (1, 0) if y else (0, 1)) for t, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(rows, pa.list_(pa.float64()))], names=["y", "x"])

    seen_rows = learned.select("text", "y").mapInArrow(evidence, "y int, x array<double>").toPandas()
    x, y = np.array(seen_rows["x"].tolist()), seen_rows["y"].to_numpy(dtype=float)
    # Any order of rows gives the same fit.
    order = np.lexsort((*x.T, y))
    x, y = x[order], y[order]
    # Stands for the share of labels in the whole, as each label was sampled for itself.
    weight = np.where(y == 1, stands_for[1], stands_for[0])
    scorer.means = np.average(x, 0, weight)
    scorer.scales = np.maximum(np.sqrt(np.average((x - scorer.means) ** 2, 0, weight)), 1e-6)
    scorer.weights = logistic((x - scorer.means) / scorer.scales, y, weight)
    return scorer


_workers: dict[str, Scorer] = {}


def held(spark, scorer: Scorer):
    """A function that gives a worker's own copy of the scorer, with what it remembers."""
    import uuid

    name, sent = uuid.uuid4().hex, spark.sparkContext.broadcast(scorer)  # as large as the words of the labelled sample, and SIZE**3

    def get() -> Scorer:
        if name not in _workers:
            _workers.clear()
            _workers[name] = sent.value
        return _workers[name]

    return get


def scores(docs: DataFrame, scorer: Scorer, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, score."""
    kind = docs.schema[id_column].dataType.simpleString()
    get = held(docs.sparkSession, scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = get()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(id_column), pa.array([s.score(t.as_py()) for t in b.column(text_column)], pa.float64())], names=[id_column, "score"])

    return docs.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, score double")


def clean(docs: DataFrame, scorer: Scorer, text_column: str = "text", least: float = 0.5) -> DataFrame:
    """The rows that are not toxic, with their columns."""
    get = held(docs.sparkSession, scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = get()
        for b in batches:
            yield b.filter(pa.array([s.score(t.as_py()) < least for t in b.column(text_column)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def train_rows(labels: DataFrame, id_column: str = "doc_id", modulus: int = 5) -> DataFrame:
    """Labels of ids that are not held out."""
    return labels.where(crc_bucket(F.col(id_column), modulus) != 0)


def toxicity(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, held_out, score, predicted."""
    scorer = fit(docs, train_rows(labels, id_column), id_column=id_column, text_column=text_column)
    return scores(docs, scorer, id_column, text_column).select(id_column, (crc_bucket(F.col(id_column), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
