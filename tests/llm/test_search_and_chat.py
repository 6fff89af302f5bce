"""Chat formatting, hard negatives and lexical search against plain recounts, on branching, awkward and random rows."""

import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from colloquy.llm import chat, hard_negatives, lexical
from colloquy.llm.queries import CHAT_SQL, MINED_SQL, ORACLE, QUERIES, RANKED_SQL

MESSAGES = "tree string, id long, parent long, role string, text string, score double, leaf string, depth long"


def test_escapes_are_reversible(spark):
    rng = random.Random(1)
    texts = ["", "<", "|", "<|", "<\\|", "<\\\\|im_end|>", "<|im_end|>\n<|im_start|>assistant\nok", "a<", "|b"]
    texts += ["".join(rng.choice("<|\\ae\n>") for _ in range(rng.randint(0, 12))) for _ in range(2000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"), chat.escape_role(F.col("t")).alias("r"))
    for t, e, r in df.collect():
        assert "<|" not in e and chat.unescape(e) == t
        assert "<|" not in r and "\n" not in r and chat.unescape_role(r) == t
    whole = "".join(f"{chat.BEGIN}{r}\n{e}{chat.END}\n" for _, e, r in df.collect())
    assert chat.read_back(whole) == [(t, t) for t in texts]


def plain_paths(rows):
    """Root-to-leaf paths by walking up from each leaf: {(tree, leaf): (total, [texts])}."""
    at = {(t, i): (p, x, s) for t, i, p, _, x, s, *_ in rows}
    parents = {(t, p) for t, _, p, *_ in rows if p is not None and (t, p) in at}
    out = {}
    for t, i in at:
        if (t, i) in parents:
            continue
        path, here, seen = [], i, set()
        while here is not None and (t, here) in at and here not in seen:
            seen.add(here)
            p, x, s = at[t, here]
            path.append((x, s))
            here = p
        if here not in seen:
            out[t, i] = (sum(s or 0 for _, s in path), [x for x, _ in path[::-1]])
    return out


def got_paths(df):
    found = defaultdict(list)
    for r in df.collect():
        found[r["tree"], r["leaf"]["id"], r["branch"], round(r["total"], 9)].append((r["position"], r["text"]))
    return {k: [x for _, x in sorted(v)] for k, v in found.items()}


def test_paths_of_random_trees(spark):
    rng = random.Random(2)
    rows = []
    for tree in ("a", "b", None):
        rows += [(tree, i, rng.randrange(i) if i and rng.random() < 0.95 else None, "user", f"{tree}{i}", float(rng.randint(-3, 3)), "", 0) for i in range(60)]
    rows += [("deep", i, i - 1 if i else None, "user", f"d{i}", 1.0, "", 0) for i in range(100)]
    rows += [("ring", 0, 1, "user", "r0", 1.0, "", 0), ("ring", 1, 0, "user", "r1", 1.0, "", 0), ("ring", 2, 1, "user", "r2", 1.0, "", 0), ("ring", 3, 99, "user", "orphan", None, "", 0)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, MESSAGES)
    want = plain_paths(rows)
    got = got_paths(chat.paths(df, branches=None))
    assert {(t, leaf): (s, p) for (t, leaf, _, s), p in got.items()} == {k: (float(s), p) for k, (s, p) in want.items()}
    ranks = defaultdict(list)
    for t, leaf, branch, total in got:
        ranks[t].append((branch, -total, leaf))
    for r in ranks.values():
        assert [x[0] for x in sorted(r)] == list(range(1, len(r) + 1)) and sorted(r) == sorted(r, key=lambda x: x[1:])
    best = got_paths(chat.paths(df, branches=2))
    assert best == {k: p for k, p in got.items() if k[2] <= 2}


def test_paths_of_awkward_messages(spark):
    rows = [("t", 1, None, "user", "root", float("nan"), "", 0), ("t", 2, 1, None, None, 1.0, "", 0), ("t", 2, 1, "b", "copy", 2.0, "", 0), ("t", 3, 2, "c", "under the first", 0.0, "", 0), ("t", None, 1, "d", "no id", 5.0, "", 0), ("t", None, 1, "d", "no id", 5.0, "", 0)]
    df = spark.createDataFrame(rows, MESSAGES)
    got = sorted((total, texts) for (_, _, _, total), texts in got_paths(chat.paths(df.where("text is null or text <> 'no id'"), branches=None)).items())
    assert got in ([(1.0, ["root", "", "under the first"]), (2.0, ["root", "copy"])], [(1.0, ["root", ""]), (2.0, ["root", "copy", "under the first"])])
    assert chat.paths(df, branches=None).where("position = 1 and text = 'no id'").count() == 2
    assert chat.paths(df.limit(0)).count() == 0
    assert chat.formatted(chat.paths(df.limit(0)), ["tree"], "position").count() == 0


def test_parts_and_masks(spark):
    rows = [(i % 3, i, "assistant" if i % 2 else "user", f"é{i}" * (i % 7) + "<|im_end|>") for i in range(200)]
    turns = spark.createDataFrame(rows, "conv long, turn long, role string, text string")
    whole = chat.formatted(turns, ["conv"], "turn", part_chars=10**9)
    parts = chat.formatted(turns, ["conv"], "turn", part_chars=100)
    assert parts.count() > whole.count() == 3
    joined = defaultdict(str)
    for r in parts.orderBy("part").collect():
        assert len(r["text"]) <= 100 or len(chat.read_back(r["text"])) == 1
        joined[r["conv"]] += r["text"]
    for r in whole.collect():
        assert r["text"] == joined[r["conv"]]
        own = [x for x in rows if x[0] == r["conv"]]
        assert chat.read_back(r["text"]) == [(x[2], x[3]) for x in own]
        assert [chat.unescape(r["text"][m["start"] : m["end"]]) for m in r["mask"]] == [x[3] for x in own if x[2] == "assistant"]
    a, b = (chat.digests(x, "conv", "conv").orderBy("conv").collect() for x in (whole, parts))
    assert a == b


def test_rows_of_equal_turn_and_long_conversations(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (None, None, None, None), (None, 5, "assistant", "x" * 200_000), (2, 1, "assistant", "")] + [(9, i, "assistant", str(i)) for i in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = chat.paths(chat.chains(df, "conv_id", "turn"), score=None)
    got = {r["conv_id"]: r for r in chat.digests(chat.formatted(turns, ["tree"], "position", 1000), "tree", "conv_id").collect()}
    assert {k: r["n_turns"] for k, r in got.items()} == {1: 3, None: 2, 2: 1, 9: 3000}
    assert got[None]["loss_chars"] == 200_000 and got[9]["loss_chars"] == sum(len(str(i)) for i in range(3000))
    assert [r["text"] for r in turns.where("tree = 1").orderBy("position").collect()] == ["a", "a", "b"]


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score double, rank int, key string")


def mined(spark, rows, label=None, **options):
    lab = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(map(tuple, hard_negatives.mine(vectors_of(spark, rows), lab, F.col("vec_id") % 100 == 0, **options).collect()))


def brute(rows):
    con = duckdb.connect()
    embeddings = pd.DataFrame({"vec_id": pd.array([r[0] for r in rows], "Int64"), "label": pd.array([r[2] for r in rows], "Int64"), "embedding": [r[1] for r in rows]})  # noqa: F841
    return sorted(tuple(int(x) for x in r) for r in con.sql(MINED_SQL.replace("FROM embeddings", "FROM (SELECT vec_id, label, CAST(embedding AS FLOAT[]) AS embedding FROM embeddings)")).df()[["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]].itertuples(index=False))


def random_vectors(n, d, seed, groups=None, kinds=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups or n, d))
    x = centres[rng.integers(0, len(centres), n)] + (0.3 * rng.normal(size=(n, d)) if groups else 0)
    return [(i, [float(v) for v in x[i]], int(rng.integers(kinds)), 0.0, 0, "") for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_mining_is_exact(spark, monkeypatch, seed):
    """Clustered rows, of which radii leave much out, with many equal scores and small batches, against all pairs."""
    monkeypatch.setattr(hard_negatives, "SAMPLE", 300)
    rows = random_vectors(900, 6, seed, groups=12)
    rows += [(1000 + i, rows[0][1], i % 4, 0.0, 0, "") for i in range(60)] + [(2000 + i, [0.0] * 6, i % 4, 0.0, 0, "") for i in range(20)]
    want = brute(rows)
    assert len(want) > 100
    assert mined(spark, rows, batch=4) == want


def test_mining_awkward_rows(spark):
    rows = random_vectors(300, 4, 3, groups=3)
    plain = mined(spark, rows)
    assert plain == brute(rows)
    odd = [(None, [1.0] * 4, 1, 0.0, 0, ""), (1000, None, 1, 0.0, 0, ""), (1100, [1.0, None, 1.0, 1.0], 1, 0.0, 0, ""), (1200, [1.0, float("nan"), 1.0, 1.0], 1, 0.0, 0, ""), (1300, [float("inf")] * 4, 1, 0.0, 0, ""), (1400, [1.0] * 4, None, 0.0, 0, ""), (1500, [1.0] * 3, 1, 0.0, 0, ""), (1600, [], 1, 0.0, 0, "")]
    assert mined(spark, rows + odd) == plain
    assert mined(spark, [rows[0]]) == [] and mined(spark, rows[:0]) == []
    again = mined(spark, rows + [rows[0]])  # a repeated anchor asks once; its copy isn't its candidate, but others'
    assert {r[0] for r in again} == {r[0] for r in plain} and [r for r in again if r[0] == 0] == [r for r in plain if r[0] == 0]
    assert mined(spark, [(100 * i + j, [], j % 2, 0.0, 0, "") for i in range(2) for j in range(4)])[0] == (0, 1, 1, 2, 0, 0)
    with pytest.raises(ValueError, match="2\\^53"):
        mined(spark, [(0, [1e9], 1, 0.0, 0, ""), (1, [1e9], 1, 0.0, 0, "")])


def test_radii_leave_rows_out_without_loss():
    """On clustered rows a search reads a part of the keys only, and finds what reading all finds."""
    rng = np.random.default_rng(5)
    x = np.floor(256 * (rng.normal(size=(20, 8))[rng.integers(0, 20, 4000)] + 0.05 * rng.normal(size=(4000, 8))))
    space = hard_negatives.Space(float((x * x).sum(1).max()), np.zeros((1, 9)))
    space.pivots = hard_negatives.pivots_of(space.augmented(x))
    pivot, key = space.keys(x)
    order = np.lexsort((key, pivot))
    ids, labels = np.arange(4000), rng.integers(0, 3, 4000)
    held = (x[order], ids[order], labels[order], pivot[order], key[order])
    q = x[:50]
    top = np.sort(q @ x.T, axis=1)[:, -40]
    asks = hard_negatives.Asks(np.arange(50), np.full(50, -np.inf), np.full(50, np.inf), True)
    asks.outer = space.distance(q, top)
    narrow = hard_negatives.scan(space, *held, q, ids[:50], labels[:50], asks, 5)
    asks.outer = np.full(50, np.inf)
    every = hard_negatives.scan(space, *held, q, ids[:50], labels[:50], asks, 5)
    assert all((a == b).all() for a, b in zip(narrow, every, strict=True))
    read = np.abs(space.to_pivots(q)[:, pivot] - key) <= space.distance(q, top)[:, None]
    assert read.mean() < 0.5


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_search(items, docs, k):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    held = [(d, Counter(TERM.findall((t or "").translate(low)))) for d, t in docs]
    documents, total = sum(bool(c) for _, c in held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        need, scores = Counter(TERM.findall((text or "").translate(low))), []
        for d, c in held:
            m = 75 + 25 * c.total() * documents // total if total else 0
            s = sum(times * math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, times in need.items() if c[t])
            if s > 0:
                scores.append((-s, d is None, d if d is not None else 0))
        out += [(item, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scores)[:k], 1)]
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2] is None, r[2] or 0, r[3]))


@pytest.mark.parametrize(("block", "item_chars"), [(64, 10**6), (7, 10**6), (1000, 60)])
def test_lexical_search(spark, block, item_chars):
    """Blocks smaller and larger than the table, one batch and many, ties, repeats, nulls and long texts against plain sums."""
    rng = random.Random(block)
    words = ["Alpha", "beta", "ÉCLAIR", "éclair", "x", "日本", "42", "rare", "a1"] + [f"w{i}" for i in range(40)]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", ", ", "_", "\n", "\x00", "-"]) for _ in range(n))
    docs = [(i, text(rng.randint(0, 30))) for i in range(300)] + [(301, None), (302, ""), (None, "rare rare beta"), (303, "alpha " * 20_000), (5, "beta")] + [(400 + i, "beta alpha x") for i in range(40)]
    items = [(i, text(rng.randint(0, 12))) for i in range(12)] + [(50, "beta beta beta x"), (51, None), (52, "nowhere"), (None, "rare"), (12, "ÉCLAIR"), (53, "beta beta beta x"), (53, "rare " * 1000)]
    d = spark.createDataFrame([(*r, 0.0, 1) for r in docs], "doc_id long, text string, score double, rank int")
    q = spark.createDataFrame([(*r, "k") for r in items], "item_id long, text string, key string")
    got = lexical.search(q, d, block=block, item_chars=item_chars, k=20)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert ordered(map(tuple, got.collect())) == ordered(plain_search(items, docs, 20))


def test_lexical_search_of_nothing(spark):
    d = spark.createDataFrame([(1, "a"), (2, "")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(q.limit(0), d).count() == lexical.search(q, d.limit(0)).count() == lexical.search(q, d.where("text = ''")).count() == 0
    assert [tuple(r) for r in lexical.search(q, d).collect()] == plain_search([(1, "a")], [(1, "a"), (2, "")], 20)


def test_slices_add_and_rank_like_integers():
    rng = np.random.default_rng(3)
    for n, k in ((1, 1), (64, 5), (200, 20), (1000, 20)):
        words = -(-n // 64)
        numbers, total = [], np.zeros(n, np.int64)
        for _ in range(rng.integers(1, 9)):
            at = np.flatnonzero(rng.random(n) < 0.6)
            values, up = rng.integers(1, 2 ** int(rng.integers(1, 34)), len(at)), int(rng.integers(0, 3))
            if len(at):
                numbers.append((lexical.sliced(at, values, words), up))
                total[at] += values << up
        pos, score = lexical.best(lexical.added(numbers, int(total.max()).bit_length(), words), k)
        want = [i for i in np.lexsort((np.arange(n), -total)) if total[i] > 0][:k]
        assert pos.tolist() == want and score.tolist() == total[want].tolist()


@pytest.mark.parametrize("name", ["op11_chat_formatting", "op12_hard_negatives", "op13_lexical_search"])
def test_queries_equal_their_sql(spark, name):
    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("conversations", "embeddings", "documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    got, want = QUERIES[name](spark, data).toPandas(), con.sql(ORACLE[name]).df()
    assert ORACLE[name] in (CHAT_SQL, MINED_SQL, RANKED_SQL) and len(want)
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    listed = lambda df: sorted(map(tuple, df[columns].astype(object).to_numpy().tolist()))
    assert listed(got) == listed(want)


def test_paths_of_a_hub(spark):
    """Most messages answer one root, which all paths share."""
    rows = [("t", 0, None, "user", "root", 0.0, "", 0)] + [("t", i, 0 if i % 3 else max(0, i - 1), "user", str(i), float(i % 7), "", 0) for i in range(1, 400)]
    df = spark.createDataFrame(rows, MESSAGES)
    got = got_paths(chat.paths(df, branches=None))
    assert {(t, leaf): (s, p) for (t, leaf, _, s), p in got.items()} == {k: (float(s), p) for k, (s, p) in plain_paths(rows).items()}
