"""The index of substrings against looking into every text."""

import random

from pyspark.sql import functions as F

from colloquy.operators import lines, needles, substrings


def test_strings_of_all_lengths_and_scripts(spark, monkeypatch):
    rng = random.Random(3)
    common = "".join(rng.choice("你好我是在的了 ab") for _ in range(40))
    texts = ["".join(rng.choice("你好我是在的了不有人這中大來上國個到說們 abc😀") for _ in range(rng.choice([0, 3, 40, 400]))) + (common if i % 3 == 0 else "") for i in range(200)]
    texts += [None, "", "a" * 5000, "你" * 3000 + common]
    quotes = [common, common[:31], common[3:], "", None, "a", "aa", "a" * 33, "a" * 5001, "沒有這句話在任何地方出現過" * 3, "你你", "😀"]
    for _ in range(300):
        t = rng.choice(texts) or "x"
        a, n = rng.randint(0, len(t)), rng.randint(1, 80)
        quotes.append(t[a : a + n] + ("不對" if rng.random() < 0.2 else ""))
    want = {(i, j) for i, q in enumerate(quotes) if q for j, t in enumerate(texts) if t and q in t}
    q, t = spark.createDataFrame(list(enumerate(quotes)), "quote_id long, quote string"), spark.createDataFrame(list(enumerate(texts)), "text_id long, text string").repartition(3)
    for at_once, keys in ((10**6, 32), (50, 1)):
        monkeypatch.setattr(substrings, "AT_ONCE", at_once)
        monkeypatch.setattr(substrings, "KEYS", keys)
        got = [tuple(r) for r in substrings.held(q, t).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert substrings.held(q.limit(0), t).count() == substrings.held(q, t.limit(0)).count() == 0


def test_runs_of_equal_strings_share_their_least_hash():
    """What the index rests on: a text that holds a string has all of the string's hashes, wherever texts are cut."""
    rng = random.Random(4)
    for tier in substrings.TIERS:
        made = substrings.hashed([tier])
        for _ in range(100):
            s = "".join(rng.choice("ab字") for _ in range(tier[0] + rng.randint(0, 40)))
            t = "".join(rng.choice("ab字") for _ in range(rng.randint(0, 50)))
            (_, own), (row, h) = next(made([s])), next(made([t, t + s + t, "", s]))
            assert len(own) and set(own) <= set(h[row == 1]) and set(own) == set(h[row == 3])


def test_many_quotations_go_through_the_index(spark, monkeypatch):
    """Squashed white space, on both ways."""
    q = spark.createDataFrame([(1, "b  c"), (2, " x "), (3, "nope"), (4, " ")], "quote_id long, quote string")
    t = spark.createDataFrame([(1, "a b\nc d"), (2, "x"), (3, None)], "text_id long, text string")
    few = {tuple(r) for r in lines.traced(q, t).collect()}
    monkeypatch.setattr(lines, "AUTOMATON", 3)
    assert few == {tuple(r) for r in lines.traced(q, t).collect()} == {(1, 1), (2, 2)}
    assert lines.traced(q.where(F.lit(False)), t).count() == 0


def test_what_is_stored_grows_with_the_strings_only(spark, monkeypatch):
    """Neither keys nor hits are checkpointed; short strings in place and by the index give the same."""
    stored, cut = [], substrings.cut
    monkeypatch.setattr(substrings, "cut", lambda df: [d := cut(df), stored.append(d.count())][0])
    texts = [f"{i} 的會議紀錄全文，第{i % 7}號決議付款條件三十天內完成交付並且驗收" for i in range(60)]
    quotes = ["的", "議付", texts[5][:30], texts[9], "沒有"]
    q, t = spark.createDataFrame(list(enumerate(quotes)), "quote_id long, quote string"), spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0])], "text_id long, text string")
    want = sorted((i, j) for i, x in enumerate(quotes) for j, y in enumerate(texts) if x in y)
    for most in (10**6, 0):
        monkeypatch.setattr(substrings, "IN_PLACE", most)
        assert sorted(tuple(r) for r in substrings.held(q, t).collect()) == want
    assert sum(stored) <= 4 * len(quotes)


def test_texts_and_pairs_stay_where_they_are(spark, monkeypatch):
    """Long strings too are found in place, in one pass or many, whatever ids texts share; no text and no pair is shuffled."""
    texts = [f"{i} 的會議紀錄全文，第{i % 7}號決議付款條件三十天內完成交付並且驗收" for i in range(60)]
    quotes = ["的", "議付", texts[5][:30], texts[9], "沒有", "付款條件三十天內", "付款條件三十天內", "全文，第3號"]
    q, t = spark.createDataFrame(list(enumerate(quotes)), "quote_id long, quote string"), spark.createDataFrame(list(enumerate(texts)), "text_id long, text string")
    want = sorted((i, j) for i, x in enumerate(quotes) for j, y in enumerate(texts) if x in y)
    found = substrings.held(q, t)
    assert "hashpartitioning(text_id" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in found.collect()) == want
    monkeypatch.setattr(substrings, "indexed", None)
    monkeypatch.setattr(substrings, "IN_PLACE", 30)
    shared = t.unionByName(spark.createDataFrame([(0, texts[0]), (1, "沒有 的")], t.schema))
    for owners in (10**6, 1, 0):  # ids that are shared, broadcast or not; quotations likewise
        monkeypatch.setattr(substrings, "OWNERS", owners)
        assert sorted(tuple(r) for r in substrings.held(q, shared).collect()) == sorted([*want, (4, 1)])


def test_strings_found_in_place_are_those_that_texts_hold(monkeypatch):
    """All lengths, in pieces, with hashes that agree by chance."""
    rng, mixed = random.Random(5), needles.mixed
    for trial in range(200):
        monkeypatch.setattr(needles, "PIECE", rng.choice([1, 7, 2_000_000]))
        monkeypatch.setattr(needles, "ONE_BY_ONE", rng.choice([0, 3, 256]))
        monkeypatch.setattr(needles, "mixed", mixed if trial % 4 else lambda a, b: mixed(a, b) & 7)
        few = rng.choice(["ab", "你好😀a", "a", "abcdefgh 天地"])
        texts = ["".join(rng.choice(few) for _ in range(rng.choice([0, 1, 3, 20, 200]))) for _ in range(rng.randint(1, 12))]
        some = [rng.choice(texts)[rng.randint(0, 30) :][: rng.randint(1, 90)] + "b" * (rng.random() < 0.2) for _ in range(rng.randint(0, 40))]
        strings = sorted({x for x in some if x})
        string, text = needles.find(needles.table(strings, range(len(strings))), texts)
        assert list(zip(string.tolist(), text.tolist())) == [(i, j) for i, x in enumerate(strings) for j, t in enumerate(texts) if x in t]
