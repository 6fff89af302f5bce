"""Very long texts, naive recounts of what the methods compute, ties, repeated rows and clashing columns."""

import math
import random
import re
import time
import zlib
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from colloquy.llm import ann, common, embed_dedup, langid, mixing, packing, pii, secret_scan, simhash, token_counts, toxicity

N = 300_000
LONG = {
    "equal": "1" + "a" * N, "spaces": "the point" + " " * N + "token", "hyphens": "a1" + "-" * N + "+", "signs": "ab" + "!?" * N + "b", "key": "ssh-rsa " + "A" * 500 + "Bc9/" * 200,
    "addresses": "jane dot doe at mail dot example dot com, " * (N // 40), "boxes": (" " * 1000 + "[dot") * 300, "digits": "4111 1111 1111 1111 " * (N // 20), "ats": "a at " * (N // 5), "letters": "a b " * (N // 8), "lines": "x\n" * N, "script": "日本語 dot " * (N // 8),
}


def quick(f, *a, least=8.0):
    began = time.time()
    got = f(*a)
    assert time.time() - began < least
    return got


@pytest.mark.parametrize("name", LONG)
def test_long_texts_take_linear_time(name):
    """Far below what a quadratic pass takes, on a busy machine too."""
    text = LONG[name]
    base, every = quick(secret_scan.find, text)
    assert set(base) <= set(every)
    quick(secret_scan.redacted, text)
    base, every = quick(pii.find, text)
    assert set(base) <= set(every)
    scorer = toxicity.Scorer(toxicity.language_model(np.ones(toxicity.SIZE**3)))
    quick(scorer.restore, text)
    quick(scorer.evidence, text)
    counter = token_counts.counter(public_tokenizers.path("byte_bpe_50k.json"))
    encoder = packing.encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert counter.__self__.tokenizer.encode(text, add_special_tokens=False).ids.__len__() == counter([text])[0]
    assert encoder.encode([text])[0].tolist() == [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 1]
    quick(simhash.fingerprint, text)
    quick(langid.infer, [text], np.zeros((langid.SIZE**3, 2), np.float32))


def test_a_million_spaces():
    counter = token_counts.counter(public_tokenizers.path("byte_bpe_50k.json"))
    text = "a" + " " * 1_000_000 + "b"
    assert counter([text]) == [len(counter.__self__.tokenizer.encode(text, add_special_tokens=False).ids)]


def test_entropy_is_that_of_a_naive_recount():
    rng = random.Random(4)
    for _ in range(3000):
        s = "".join(rng.choice(rng.choice(["ab", "abc123", "aAbBcC019+/", "0123456789abcdef", "XYZQWE-_="])) for _ in range(rng.randint(0, 70)))
        s += s[:1] * rng.choice([0, 0, 25])
        n = min(secret_scan.WINDOW, len(s))
        least = secret_scan.THRESHOLDS[secret_scan.character_class(s)] * (math.log2(n) if n else 0) / math.log2(secret_scan.WINDOW) - 1e-9
        covered = set()
        for a in range(len(s) - n + 1):
            w = s[a : a + n]
            if w and -sum(w.count(c) / len(w) * math.log2(w.count(c) / len(w)) for c in set(w)) >= least:
                covered |= set(range(a, a + len(w)))
        # What lies between or beside covered characters and is shorter than a window goes with them.
        for run in [[-1, *sorted(covered), len(s)]] if covered else []:
            for a, b in zip(run, run[1:], strict=False):
                covered |= set(range(a + 1, b)) if b - a - 1 < n else set()
        assert {i for a, b in secret_scan.hot_stretches(s) for i in range(a, b)} == covered


BASE62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def test_no_part_of_a_key_is_left():
    """Keys with a base span inside go whole: hexadecimal, access and assignment parts."""
    rng = random.Random(9)
    draw = lambda n, of=BASE62: "".join(rng.choice(of) for _ in range(n))
    for _ in range(1000):
        for key in (draw(30) + draw(16, "0123456789abcdef") + draw(30), draw(10) + "AKIA" + draw(16, BASE62[:26]) + draw(25), draw(25) + "token=" + draw(25), "AKIA" + draw(16, BASE62[:26]) + draw(20)):
            assert secret_scan.redacted(f"( {key} )") == "( [SECRET] )"


@pytest.mark.parametrize("n", [12, 13, 16, 19, 24])
def test_short_keys_are_found(n):
    rng = random.Random(n)
    keys = ["".join(rng.choice(BASE62) for _ in range(n)) for _ in range(2000)]
    assert sum(secret_scan.redacted(f"key {k}.") != "key [SECRET]." for k in keys) < 0.03 * len(keys)
    for words in ("internationally", "Donaudampfschiff", "getElementById", "2024-01-02T10", "z" * 19, "xyzxyzxyzxyz", "well-known-path", "1234567890123"):
        assert secret_scan.find(words)[1] == []


def test_decode_is_the_best_of_all_paths():
    rng = random.Random(5)
    model = toxicity.language_model(np.random.default_rng(6).integers(0, 60, toxicity.SIZE**3).astype(float)).astype(float)

    def value(reading, cost):
        x = y = 0
        for c in reading:
            k = toxicity.LETTERS.find(c, 1)
            k = toxicity.OTHER if k < 0 else k
            cost += model[x, y, k]
            x, y = y, k
        return cost + model[x, y, 0]

    for _ in range(500):
        token = "".join(rng.choice("abe1034$@-.é") * rng.choice([1, 1, 1, 3]) for _ in range(rng.randint(1, 7)))
        paths = [("".join(r for r, _ in p), sum(c for _, c in p)) for p in product(*toxicity.lattice(token))]
        assert value(*max(paths, key=lambda p: value(*p))) == pytest.approx(max(value(r, c) for r, c in paths if r == toxicity.decode(token, model)))


def test_mixture_is_that_of_plain_expectation_maximisation():
    rng = np.random.default_rng(7)
    like, size = rng.random((40, 3)) ** 4, np.array([10, 25, 5])
    first, doc = np.array([0, 10, 35]), np.repeat(np.arange(3), size)
    allowed = np.array([[1, 1, 1], [1, 0, 1], [0, 1, 0]], float)
    share, value = langid.mixture(like, doc, first, size, allowed)
    for d in range(3):
        rows, p = like[doc == d], allowed[d] / allowed[d].sum()
        for _ in range(langid.ROUNDS):
            r = np.array([[w[k] * p[k] for k in range(3)] for w in rows])
            p = (r / r.sum(1, keepdims=True)).mean(0)
        assert share[d] == pytest.approx(p) and value[d] == pytest.approx(sum(math.log(sum(w[k] * p[k] for k in range(3))) for w in rows))


def test_language_sets_grow_by_penalised_likelihood():
    """Against a plain search over one document's words."""
    rng = np.random.default_rng(8)
    model = np.log(rng.dirichlet(np.ones(langid.SIZE) * 0.05, langid.SIZE**2).reshape(-1, 1).repeat(3, 1) * rng.random((langid.SIZE**3, 3)) + 1e-6).astype(np.float32)
    words = ["alpha", "beta", "gamma", "delta", "rho", "sigma", "tau"]
    for n in (1, 3, 8, 30):
        text = "  ".join(rng.choice(words, n))
        like = []
        for w in text.split("  "):
            c = [0, 0, *langid.classes(w).tolist(), 0]
            like.append(sum(model[(a * langid.SIZE + b) * langid.SIZE + x].astype(float) for a, b, x in zip(c, c[1:], c[2:], strict=False)))
        like = np.maximum(np.exp(np.array(like) - np.max(like, 1, keepdims=True)), 1e-12)
        best, fit = np.eye(3)[np.log(like).sum(0).argmax()], np.log(like).sum(0).max()
        one, size = np.zeros(n, int), np.array([n])
        for m in (2, 3):
            full = langid.mixture(like, one, np.array([0]), size, np.ones((1, 3)))[0][0]
            full[best > 0] = np.inf
            may = np.zeros((1, 3))
            may[0, np.argsort(-full, kind="stable")[:m]] = 1
            share, value = langid.mixture(like, one, np.array([0]), size, may)
            if value[0] - langid.PENALTY * (1 + math.log(n)) <= fit:
                break
            best, fit = share[0], value[0] - langid.PENALTY * (1 + math.log(n))
        lang, score = langid.infer([text], model)
        assert lang[0] == best.argmax() and score[0] == pytest.approx(best.max(), abs=1e-5)


def test_packing_of_every_character():
    """All code points of the first two planes, and some of the others."""
    encoder = packing.encoder(public_tokenizers.path("word_bpe_49k.json"))
    points = [p for p in [*range(0x20000), *range(0x20000, 0x110000, 97)] if not 0xD800 <= p < 0xE000]
    for at in range(0, len(points), 20_000):
        texts = [f"a{chr(p)}b {chr(p)}'s 1{chr(p)}" for p in points[at : at + 20_000]]
        want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [x.tolist()[:-1] for x in encoder.encode(texts)] == want


def test_hot_keys_join_as_others(spark):
    rows = [(0, n) for n in range(5000)] + [(n % 700, n) for n in range(3000)]
    left = spark.createDataFrame(rows, "k int, x int")
    right = left.groupBy("k").agg(F.count("*").alias("n"), F.max("x").alias("top")).where("k <> 5")
    got = common.join_hot(left, right, ["k"], "n", len(rows))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, left.join(right.drop("n"), "k").collect()))


def test_no_local_folder_stands_in_on_a_cluster():
    class Conf:
        def get(self, *a):
            return None

    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        common.shared_dir(Session())


VECTORS = "vec_id long, embedding array<float>, id string, v int, cell int, node long, copies int"


def vector_rows(spark, values):
    return spark.createDataFrame([(i, None if v is None else [float(c) for c in v], "x", 1, 2, 3, 4) for i, v in values], VECTORS)


def test_vectors_are_compared_within_their_length(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(60, 8))
    values = [*enumerate(x), (60, x[0] * 2), (61, x[0][:5]), (62, x[0][:5]), (None, x[1]), (1, x[1]), (63, None)]
    df = vector_rows(spark, values)
    rows = embed_dedup.near_duplicates(df).collect()
    by = {}
    for r in rows:
        by.setdefault(r["vec_id"], []).append((r["n_links"], r["component_id"], r["kept"]))
    assert len(rows) == len(values) and by[61] == [(1, 61, True)] and by[62] == [(1, 61, False)] and by[63] == [(0, 63, True)] and by[60] == [(1, 0, False)] and by[0] == [(1, 0, True)]
    assert by[1] == [(2, 1, True)] * 2 and by[None] == [(2, 1, False)]
    found = ann.search(df, (F.col("vec_id") % 10 == 0) | (F.col("vec_id") > 60)).collect()
    assert {r["query_id"] for r in found} == {0, 10, 20, 30, 40, 50, 60, 61, 62} and not {r["vec_id"] for r in found if r["query_id"] <= 60} & {61, 62, 63}
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] > 60] == [(61, 1, 62, 0.0), (62, 1, 61, 0.0)]
    none = embed_dedup.near_duplicates(vector_rows(spark, [(None, None), (1, None)])).collect()
    assert {(r["vec_id"], r["kept"]) for r in none} == {(None, False), (1, True)}


def test_neighbours_at_ties_and_of_repeated_queries(spark):
    """Equal distances go to the smaller id across the cut; of a repeated query's vectors the least one asks."""
    values = [(0, (0, 1)), *((n, (3, 1) if n % 2 else (-3, 1)) for n in range(1, 30)), (100, (9, 9)), (100, (8, 9))]
    df = vector_rows(spark, values)
    rows = ann.search(df, F.col("vec_id").isin(0, 100)).collect()
    got = {q: [(r["rank"], r["vec_id"], r["score"]) for r in sorted(rows, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (0, 100)}
    assert got[0] == [(n, n, 3.0) for n in range(1, 11)]
    want = sorted((math.dist(v, (8, 9)), i) for i, v in values if i != 100)[:10]
    assert [i for _, i, _ in got[100]] == [i for _, i in want] and [s for *_, s in got[100]] == pytest.approx([s for s, _ in want])


@pytest.mark.parametrize("n", [500, 2000])
def test_small_tables_are_searched_through_the_tree(spark, n):
    """With production settings, fewer leaves than all are visited, and recall holds; rows without a near neighbour at all."""
    x = np.random.default_rng(n).normal(size=(n, 16))
    looked: dict = {}
    rows = ann.search(vector_rows(spark, enumerate(x)), F.col("vec_id") % 20 == 0, looked=looked).collect()
    x = x.astype(np.float32).astype(float)
    hit = 0
    for q in range(0, n, 20):
        far = ((x - x[q]) ** 2).sum(1)
        far[q] = np.inf
        own = [r["vec_id"] for r in rows if r["query_id"] == q]
        assert len(own) == 10
        hit += len(set(own) & set(np.argsort(far)[:10].tolist()))
    assert hit / (n // 20 * 10) >= 0.9
    (cells, of), (leaves, all_) = looked[16]["cells"], looked[16]["leaves"]
    assert of >= 4 and cells * leaves < of * all_


def test_neighbours_through_many_cells_and_blocks(spark):
    rng = np.random.default_rng(10)
    centres = rng.normal(size=(30, 12)) * 4
    x = np.concatenate([c + rng.normal(size=(60, 12)) for c in centres] + [np.tile(centres[0], (150, 1))]).astype(np.float32)
    df = vector_rows(spark, enumerate(x))
    rows = ann.search(df, F.col("vec_id") % 40 == 0, sample=512, cell=128, block=64).collect()
    d, hit, total = x.astype(float), 0, 0
    for q in range(0, len(x), 40):
        far = np.sqrt(((d - d[q]) ** 2).sum(1))
        far[q] = np.inf
        true = np.lexsort((np.arange(len(x)), far))[:10]
        own = {r["vec_id"]: r["score"] for r in rows if r["query_id"] == q}
        assert all(s == pytest.approx(far[i]) for i, s in own.items())
        # Among the many equal vectors any that is as near counts.
        hit += sum(far[i] <= far[true[-1]] + 1e-9 for i in own)
        total += 10
    assert hit / total >= 0.9
    repeat = ann.search(df, F.col("vec_id") % 40 == 0, sample=512, cell=128, block=64).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, repeat))


def test_cache_encodes_each_text_once(spark, tmp_path, monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    cache = str(tmp_path / "cache")
    rows = [(None, "same text")] * 40 + [(1, "same text")] * 40 + [(2, "other"), (3, None), (4, ""), (5, "x " * 600)]
    schema = "doc_id long, text string, digest string, n long, key string, n_tokens long"
    docs = spark.createDataFrame([(i, t, "a", 1, "b", 2) for i, t in rows], schema).repartition(8)
    token_counts.fill_from(docs.where("doc_id = 2"), path, cache)
    stored = lambda: spark.read.parquet(cache)
    assert stored().count() == 1 and stored().columns == ["digest", "n_tokens", "tokenizer"]
    got = token_counts.token_counts(docs, path, cache).collect()
    assert len(got) == len(rows) and stored().count() == 4  # the hit wasn't encoded again, each miss once
    assert {(r["doc_id"], r["n_tokens"], r["over_limit"]) for r in got} == {(i, token_counts.counter(path)([t or ""])[0], i == 5) for i, t in rows}
    # Over a full cache no text is shuffled, and of a new one only that.
    digest = token_counts.digest_of(F.coalesce("text", F.lit(""))).alias("digest")
    misses = lambda d: d.select(digest).distinct().join(stored().select(F.unhex("digest").alias("digest")), "digest", "left_anti")
    assert token_counts.missing_texts(docs, misses(docs), "text").count() == 0
    more = docs.unionByName(docs.where("doc_id = 5").withColumn("text", F.lit("new")))
    assert [r["text"] for r in token_counts.missing_texts(more, misses(more), "text").collect()] == ["new"]
    other = public_tokenizers.path("piece_bpe_32k.model")
    assert {(r["doc_id"], r["n_tokens"]) for r in token_counts.token_counts(docs, other, cache).collect()} == {(i, token_counts.counter(other)([t or ""])[0]) for i, t in rows}
    assert stored().select("tokenizer").distinct().count() == 2


WIDE = "doc_id long, text string, lang string, source string, id long, y int, f string, score double, held_out string, `class` int, tri long, n long, key string, fp long"


def wide(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "c", 0.5, "d", 5, 6, 7, "e", 8) for r in rows], WIDE)


def test_learned_operators_on_awkward_rows(spark):
    """Clashing names, repeated and null ids, long and empty texts for toxicity and languages."""
    rows = [(i, "you idiot " + "green stone river " * 5 if i % 3 == 0 else "green stone river " * 6, "en" if i % 2 else "de", "s") for i in range(60)]
    rows += [(0, "a second text of the same id", "en", "s"), (None, "no id", None, None), (70, None, "en", "s"), (71, "", None, "s"), (72, "word " * 100_000, "en", "s"), (72, "word " * 100_000, "en", "s")]
    docs = wide(spark, rows)
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(60)] + [(0, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert sorted(map(str, got)) == sorted(map(str, toxicity.toxicity(docs, labels).collect()))
    langs = langid.identify(docs).collect()
    assert len(langs) == len(rows) and {r["lang_pred"] for r in langs if r["doc_id"] in (70, 71)} == {"und"}
    held = lambda i, m: zlib.crc32(str("" if i is None else i).encode()) % m
    assert all(r["held_out"] == (held(r["doc_id"], 4) == 2) for r in langs) and all(r["held_out"] == (held(r["doc_id"], 5) == 0) for r in got)
    tie = langid.identify(wide(spark, [(1, "alpha", "b", "s"), (1, "alpha", "a", "s"), (3, "alpha", None, "s")])).collect()
    assert {r["lang_pred"] for r in tie} == {"a"}  # equal models: the first by name


def test_mixing_of_many_sources(spark, monkeypatch):
    """Beyond the broadcast, hot sources and the null one included, the mix is the same."""
    rows = [(i, "word " * (i % 7), "en", None if i % 11 == 0 else "hot" if i % 3 == 0 else f"s{i % 90}") for i in range(600)]
    docs = wide(spark, rows)
    plain, copies = sorted(map(str, mixing.mix(docs).collect())), sorted(map(str, mixing.mixed(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 3)
    assert sorted(map(str, mixing.mix(docs).collect())) == plain and sorted(map(str, mixing.mixed(docs).collect())) == copies


def test_pipeline_stages_on_awkward_rows(spark, tmp_path):
    import corpus_pipeline

    folder = str(tmp_path / "sf")
    spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(folder + "/labels.parquet")
    rows = [(1, "a b c d e", "en", "s"), (1, "a b c d e", "en", "s"), (2, "you idiot now", None, None), (None, None, None, None), (3, "", "en", "t"), (4, "1" + "a" * 100_000 + " ghp_aB3dE5fG7hI9jK1lM3nO5pQ7rS9", "en", "t"), (5, "ssh-rsa " + "A" * 40, "de", "t")]
    for docs in (wide(spark, rows), wide(spark, rows[:0])):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, folder)
            found = out.collect()
            if name != "packing":
                assert out.columns == docs.columns, name
            if name in ("toxicity", "simhash_near_dedup", "secret_scan"):
                assert len(found) <= docs.count() and (name != "secret_scan" or len(found) == docs.count())
            if not docs.head(1):
                assert not found
            elif name == "simhash_near_dedup":
                assert sorted(str(r["doc_id"]) for r in found) == ["1", "2", "3", "4", "5"]  # the empty texts are one group
            elif name == "secret_scan":
                assert not any("ghp_" in (r["text"] or "") for r in found) and {r["id"] for r in found} == {1}
            elif name == "packing":
                assert len({r["sequence_id"] for r in found}) == len(found) and sum(r["start"] == 0 for r in found) == len(rows)
    docs = wide(spark, rows)
    docs.write.parquet(folder + "/documents.parquet")
    assert corpus_pipeline.run(spark, folder).count() > 0


def slow_addresses(text):
    """Said addresses by walking over words from each at, both ways, atom by atom."""
    tokens = [(m.group(), m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9-]+|\s+|.", text)]
    word = lambda i: tokens[i][0] if 0 <= i < len(tokens) else ""
    atom = lambda i: bool(re.fullmatch("[A-Za-z0-9-]+", word(i)))
    said_dot = lambda i, step: word(i).isspace() and word(i + step).lower() in pii.DOT_WORDS.split("|") and word(i + 2 * step).isspace()

    def walk(i, step):
        labels, dots = [word(i)], []
        while True:
            far = 2 if word(i + step) == "." else 4 if said_dot(i + step, step) else 0
            if not far or not atom(i + far * step):
                return i, labels, dots
            dots.append(far == 4)
            i += far * step
            labels.append(word(i))

    found, done = [], 0
    for i, (t, start, _) in enumerate(tokens):
        if t.lower() not in pii.AT_WORDS.split("|") or not word(i - 1).isspace() or not word(i + 1).isspace() or start < done or not atom(i + 2):
            continue
        end, labels, dots = walk(i + 2, 1)
        last = labels[-1]
        if not dots or not re.fullmatch("[A-Za-z]{2,}", last) or (not dots[-1] and (last[0].isupper() and last[1:].islower() or len(labels) == 2 and last.lower() in pii.FILE_ENDINGS)):
            continue
        if atom(i - 2) and tokens[i - 2][1] >= done:
            j = i - 2
            while True:
                far = 2 if word(j - 1) == "." else 4 if said_dot(j - 1, -1) else 0
                if not far or not atom(j - far) or tokens[j - far][1] < done:
                    break
                j -= far
            found.append(("email", tokens[j][1], tokens[end][2]))
            done = tokens[end][2]
    return found


def test_said_addresses_of_any_length_equal_a_slow_walk():
    rng = random.Random(11)
    words = ["at", "dot", "jane", "x", "mail", "com", "org", "Then", "md", "5", "punkt", "me", "chez", "no"]
    some = 0
    for _ in range(6000):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", ".", "  ", " at ", " dot ", ", ", "\n"]) for _ in range(rng.randint(2, 18)))
        want = slow_addresses(text)
        assert pii.find(text)[1] == want, text
        some += len(want)
    assert some > 1500
    for n in (1, 5, 6, 40):
        local, domain = (" dot ".join(f"a{i}" for i in range(n)), ".".join(f"b{i}" for i in range(n)) + ".com")
        text = f"write to {local} at {domain}, please"
        assert pii.find(text)[1] == [("email", 9, len(text) - 8)]


def test_no_addresses_and_digits_with_letters():
    for text in ("meet at 10.30", "look at readme.md", "back at no.5", "arrived at Berlin.Then left", "is at 4.2 bar", "call O and l"):
        assert pii.find(text)[1] == [], text
    assert pii.find("pay 4l11 1111 1111 1111 now")[1] == [("card", 4, 23)]
    assert pii.find("call +49 l7O 123456O!")[1] == [("phone", 5, 20)]
    assert pii.find("pay 4l11 1111 1111 1112 now")[1] == []


def marked_scorer():
    features = {"idiot": (30, 1), "^idio": (40, 2), "^idioti": (20, 0), "moron": (30, 1), "^moro": (9, 3), "stone": (1, 50), "é": (3, 0)}
    return toxicity.Scorer(toxicity.language_model(np.random.default_rng(6).integers(0, 60, toxicity.SIZE**3).astype(float)), features=features, n1=100, n0=100)


def test_a_new_word_costs_no_new_odds(monkeypatch):
    """Odds are worked out once for each feature, as corpora bring new words without end."""
    plain, calls = toxicity.Scorer.odds, []
    monkeypatch.setattr(toxicity.Scorer, "odds", lambda self, *a: calls.append(a) or plain(self, *a))
    scorer = marked_scorer()
    for i in range(20):
        scorer.evidence(" ".join("idio" + a + b + c for a, b, c in product("abcdefghij", "klmnop", "abcdefghijklmnopqrst"[i])))
    assert len(calls) <= 2 * len(scorer.features)


def test_evidence_is_that_of_a_plain_recount(monkeypatch):
    """Plain words, spaced letters and ranks are short cuts; words are forgotten beyond a bound."""
    monkeypatch.setattr(toxicity, "REMEMBERED", 50)
    scorer, rng = marked_scorer(), random.Random(12)

    def read(word):
        word = word.lower()
        if toxicity.SUSPICIOUS.search(word):
            return scorer.decoded(word.rstrip(".,;:?!") or word)
        core = toxicity.CORE.search(word)
        return core.group() if core else ""

    def evidence(text, less):
        words = set(text.split()) | {scorer.decoded(m.group().lower().replace(" ", "")) for m in toxicity.SPACED.finditer(text)}
        best = [max(((scorer.odds(scorer.features[f]), scorer.features[f]) for f in toxicity.features_of(read(w)) if f in scorer.features), default=(0, None)) for w in words]
        odds = sorted((scorer.odds(n, less) for n in {n for o, n in best if o > 0}), reverse=True)[:3]
        return [*(max(0.0, o) for o in odds), *[0.0] * (3 - len(odds)), float(np.log1p(len(words)))]

    parts = ["idiot", "1d10t", "IDIOTIC", "moron", "moronic", "stone", "i d i o t", "m o r", "é", "ÉÉÉ", "idioooot", "a b", "x" * 70, "idiotie" * 20]
    ends = [*toxicity.ENDS, "$", "@", "0", "(", "¡", "_", "...", "!!1", "»", "İ", "ſſſ", "&&&", "", ""]
    for i in range(1500):
        drawn = [rng.choice(ends) * rng.choice([0, 0, 1]) + rng.choice([*parts, "".join(rng.choice("abé1$.-* iİ") for _ in range(rng.randint(1, 9)))]) + rng.choice(ends) for _ in range(rng.randint(0, 8))]
        text, less = rng.choice(" \n\x85").join(drawn), rng.choice([(0, 0), (1, 0)])
        assert scorer.evidence(text, less) == evidence(text, less), text
        assert all(scorer.read_word(w) == read(w) for w in text.split()), text
    assert len(scorer.known) <= 50 and max(map(len, scorer.known)) <= toxicity.LONGEST
