"""JN09, FLT05: which texts hold which strings, by an index of grams that works in any script.

A string of at least G + W - 1 characters holds a run of W neighbouring grams of G characters, and so does each text that holds
the string: both have the least hash of that run. So a text gives, for each run, only its least hash, a
string gives its own, and it suffices to look for one of these: the one that fewest texts have. Shorter strings have tiers of
their own, with shorter grams and runs, down to the string itself. Texts send only hashes that a bitmap of fixed size
allows; what meets is verified in the text. Texts move once, to the strings that they may hold. That is for more than PASSES
times IN_PLACE characters of strings; fewer are looked for where the texts lie (`needles`), so that neither texts nor pairs move.

Defined cases: empty and null strings are held by nothing, null texts hold nothing; equal strings are looked for once and each
gets the texts; texts that share an id are told together; white space counts; empty tables give an empty result.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.operators import needles
from colloquy.operators.storage import cut

#: Tiers (least characters of a string, characters of a gram, grams of a run), the longest first.
TIERS = [(32, 12, 21), (12, 6, 7), (4, 4, 1), (3, 3, 1), (2, 2, 1), (1, 1, 1)]
#: Bits of the bitmap of wanted hashes (8 MB), hashes of a string that are compared, and characters that are hashed at once.
BITS, KEYS, AT_ONCE = 26, 32, 1_000_000
#: Characters of strings that are looked for at once where the texts lie, and how often texts are read for that at most; beyond, only strings of under BRIEF characters,
#: which very many texts hold, are looked for there. Quotations, or ids that texts share, that are broadcast at most.
IN_PLACE, PASSES, BRIEF, OWNERS = 24_000_000, 8, 4, 4_000_000


def hashed(tiers: list[tuple[int, int, int]]) -> Callable:
    """A function: texts -> for each of the tiers (row, hash) arrays of the least hashes of all runs. Numbers of tiers are part of the hashes."""
    numbers = [(TIERS.index(t) + 1, *t[1:]) for t in tiers]

    def run(texts: list[str]) -> Iterator:
        import numpy as np

        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes)
        row = np.repeat(np.arange(len(texts)), sizes)
        for number, g, w in numbers:
            n = len(codes) - g + 1
            if n - w + 1 <= 0:
                yield np.zeros(0, np.int64), np.zeros(0, np.uint64)
                continue
            h = np.full(n, number, np.uint64)
            for k in range(g):
                h *= np.uint64(0x9E3779B97F4A7C15)
                h += codes[k : k + n]
            h ^= h >> np.uint64(31)
            h *= np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
            least, width = h, 1
            while width < w:  # of width neighbours, by doubling
                step = min(width, w - width)
                least = np.minimum(least[: len(least) - step], least[step:])
                width += step
            at = np.arange(len(least))
            fine = at + g + w - 1 <= ends[row[: len(at)]]  # the run lies in one text
            fine[1:] &= (least[1:] != least[:-1]) | ~fine[:-1] | (row[1 : len(at)] != row[: len(at) - 1])
            at = at[fine]
            yield row[at], least[at]

    return run


def keys_of(strings: DataFrame) -> DataFrame:
    """(n, h): for each string (n, quote) the KEYS least of its hashes in the tier of its length."""
    parts = [(t, hashed([t])) for t in TIERS]
    keys = KEYS

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            own, texts = b.column("n").to_numpy(), b.column("quote").to_pylist()
            sizes = np.array([len(t) for t in texts], np.int64)
            most = np.iinfo(np.int64).max
            for (least, _, _), made in parts:
                which = np.flatnonzero((sizes >= least) & (sizes < most))
                most = least
                for at in range(0, len(which), 1024):
                    some = which[at : at + 1024]
                    for row, h in made([texts[i] for i in some]):
                        order = np.lexsort((h, row))
                        row, h = row[order], h[order]
                        new = np.r_[True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])][: len(row)]
                        row, h = row[new], h[new]
                        begin = np.searchsorted(row, np.arange(len(some)))
                        few = np.arange(len(row)) - begin[row] < keys
                        yield pa.RecordBatch.from_arrays([pa.array(own[some[row[few]]]), pa.array(h[few].view(np.int64))], names=["n", "h"])

    return strings.mapInArrow(run, "n long, h long")


def bitmap(keys: DataFrame):
    """The wanted hashes as 2^BITS bits, in 64-bit words; of a size that doesn't grow."""
    import numpy as np

    low = F.col("h").bitwiseAND(2**BITS - 1)
    words = keys.select(F.shiftright(low, 6).cast("int").alias("at"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("word")).toPandas()
    out = np.zeros(2 ** (BITS - 6), np.int64)
    out[words["at"].to_numpy()] = words["word"].to_numpy()
    return out.view(np.uint64)


def found_in(texts: DataFrame, tiers: list[tuple[int, int, int]], wanted) -> DataFrame:
    """(text_id, h): the wanted hashes of each text, each once in a row. wanted: the broadcast bitmap."""
    made, bits, at_once = hashed(tiers), BITS, AT_ONCE
    kind = texts.schema["text_id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        words = wanted.value
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            begin, size = 0, 0
            for i, t in enumerate(texts):
                size += len(t)
                if size < at_once and i + 1 < len(texts):
                    continue
                rows, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
                for row, h in made(texts[begin : i + 1]):
                    low = h & np.uint64(2**bits - 1)
                    hit = ((words[low >> np.uint64(6)] >> (low & np.uint64(63))) & np.uint64(1)).astype(bool)
                    rows.append(row[hit] + begin)
                    hashes.append(h[hit])
                row, h = np.concatenate(rows), np.concatenate(hashes)
                order = np.lexsort((h, row))
                row, h = row[order], h[order]
                new = np.r_[True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])][: len(row)]
                yield pa.RecordBatch.from_arrays([b.column("text_id").take(pa.array(row[new])), pa.array(h[new].view(np.int64))], names=["text_id", "h"])
                begin, size = i + 1, 0

    return texts.select("text_id", "text").mapInArrow(run, f"text_id {kind}, h long")


_automata: dict[str, object] = {}


def matcher(needles) -> Callable[[Iterator], Iterator]:
    """A mapInArrow function over (text_id, _t): (text_id, _q) for each needle that a text holds."""

    name = uuid.uuid4().hex

    def run(batches: Iterator) -> Iterator:
        import ahocorasick
        import pyarrow as pa

        if name not in _automata:  # a worker builds it once
            _automata.clear()
            built = ahocorasick.Automaton()
            for n in needles.value:
                built.add_word(n, n)
            built.make_automaton()
            _automata[name] = built
        automaton = _automata[name]
        for b in batches:
            hits = [sorted({n for _, n in automaton.iter(x)}) if x else [] for x in b.column("_t").to_pylist()]
            row = pa.array([i for i, h in enumerate(hits) for _ in h], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("text_id").take(row), pa.array([n for h in hits for n in h], pa.string())], names=["text_id", "_q"])

    return run


def held(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """(quote_id, text_id), each pair once, of quotes (quote_id, quote) and the texts (text_id, text) that hold them."""
    quotes = quotes.select("quote_id", "quote").where("quote <> ''")
    strings = cut(quotes.groupBy("quote").agg(F.count("*").alias("copies")).withColumn("n", F.monotonically_increasing_id()))
    owners = quotes.join(strings, "quote").select("n", "quote_id")
    size = F.length("quote")
    total, short, many = (x or 0 for x in strings.agg(F.sum(size), F.sum(F.when(size < BRIEF, size)), F.sum("copies")).first())
    strings = strings.select("n", "quote")
    if total <= PASSES * IN_PLACE:
        true = in_place(strings, texts, total)
    elif short <= IN_PLACE:
        true = in_place(strings.where(size < BRIEF), texts, short).unionByName(listed(indexed(strings.where(size >= BRIEF), texts)))
    else:
        true = listed(indexed(strings, texts))
    # Lists travel, and become rows last: the quotations of a string repeat the same texts, which files keep in few bytes.
    return true.join(F.broadcast(owners) if many <= OWNERS else owners.hint("merge"), "n").select("quote_id", F.explode("ids").alias("text_id"))


def listed(pairs: DataFrame) -> DataFrame:
    """(n, ids), each pair once, of pairs (n, text_id)."""
    return pairs.select("n", "text_id").distinct().select("n", F.array("text_id").alias("ids"))


def in_place(strings: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """(n, ids), each pair once, of strings (n, quote) with so many characters: texts stay where they are and are read once for each IN_PLACE characters."""
    texts = texts.select("text_id", "text")
    shared = cut(texts.groupBy("text_id").count().where("count > 1").select(F.col("text_id").alias("_id")))
    count, same = shared.count(), F.col("text_id").eqNullSafe(F.col("_id"))
    # Only texts that share an id can give a pair twice, so other pairs aren't shuffled.
    if not count:
        parts = [(texts, False)]
    elif count <= OWNERS:
        parts = [(texts.join(F.broadcast(shared), same, "left_anti"), False), (texts.join(F.broadcast(shared), same, "left_semi"), True)]
    else:
        parts = [(texts, True)]
    schema = f"n long, ids array<{texts.schema['text_id'].dataType.simpleString()}>"
    times, found = max(1, -(-size // max(1, IN_PLACE))), []
    for k in range(times):
        some = strings if times == 1 else strings.where(F.pmod(F.xxhash64("quote"), F.lit(times)) == k)
        rows = some.select("n", "quote").toArrow()
        known = texts.sparkSession.sparkContext.broadcast(needles.table(rows.column("quote").to_pylist(), rows.column("n").to_numpy()))
        for part, again in parts:
            lists = part.mapInArrow(needles.finder(known, AT_ONCE), schema)
            found.append(listed(lists.select("n", F.explode("ids").alias("text_id"))) if again else lists)
    return functools.reduce(DataFrame.unionByName, found)


def indexed(strings: DataFrame, texts: DataFrame) -> DataFrame:
    """(n, text_id) of strings (n, quote) by the index."""
    spark = texts.sparkSession
    keys = keys_of(strings)  # made anew when asked for: checkpoints of keys and hits took 532 MB for 98 MB of documents
    classes = strings.select(F.array_max(F.array(*(F.when(F.length("quote") >= t[0], t[0]).otherwise(0) for t in TIERS))).alias("least")).distinct()
    used = {r["least"] for r in classes.collect()}  # one number a tier
    hits = lambda wanted: found_in(texts, [t for t in TIERS if t[0] in used], spark.sparkContext.broadcast(bitmap(wanted)))
    seen = hits(keys).groupBy("h").agg(F.count("*").alias("texts"))
    # A key that no text has tells that no text holds the string.
    rated = keys.join(seen, "h", "left").fillna(0, ["texts"]).groupBy("n").agg(F.min(F.struct("texts", "h")).alias("k"))
    rarest = cut(rated.where("k.texts > 0").select("n", F.col("k.h").alias("h")))
    # Texts are read again for the rarest keys only, so the other hits are counted and never stored; texts stream past the pairs, unsorted.
    pairs = rarest.join(hits(rarest), "h").select("n", "text_id").join(strings, "n")
    true = pairs.hint("shuffle_hash").join(texts.select("text_id", "text"), "text_id").where(F.contains("text", "quote"))
    return true.select("n", "text_id")
