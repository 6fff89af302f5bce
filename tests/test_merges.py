"""Golden cases of merges, schema checks, quotations and reports."""

import json

import pytest
from pyspark.sql import functions as F

from colloquy.operators import evidence, jobs, lines, review, schema
from colloquy.sources import files


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}").select("i", f(F.col("x")).alias("y")).collect()
    return [r["y"] for r in sorted(rows)]


def test_headers(spark):
    want = {
        "**── 王總 ──**": ("王總", None, None, ""), "**── 王總 ──** `[00:01:02 – 00:02:03]`": ("王總", "00:01:02", "00:02:03", ""), "**── A * B ──** [01:02]": ("A * B", "01:02", None, ""),
        "**[00:10] 王總**": ("王總", "00:10", None, ""), "**王總** [00:01:02]": ("王總", "00:01:02", None, ""), "[00:01] 王總：你好": ("王總", "00:01", None, "你好"), "`[00:01:02 - 00:01:05]`　王總: a: b": ("王總", "00:01:02", "00:01:05", "a: b"),
        "**粗體標題**": None, "[00:01] no colon": None, "[v2] x：y": None, "**── x ──** tail": None, "plain": None, "": None, "[00:01] " + "長" * 30 + "：x": None,
    }
    got = column(spark, list(want), lines.match_header)
    assert [tuple(g) if g else None for g in got] == list(want.values())


def test_stamps(spark):
    want = {
        "- 檔案丟進去就更新[00:53:48]。": "- 檔案丟進去就更新。", "他說「純粹就是一個意見」[00:03:05]。": "他說「純粹就是一個意見」。", "形式是醫生對談[00:02:53]–[00:03:04]。": "形式是醫生對談。", "之後會 benefit 大家[00:06:35]、[00:11:11]。": "之後會 benefit 大家。",
        "關鍵主張 `[00:12:01]` 在此": "關鍵主張 在此", "先看看[12:34]": "先看看", "這點稍後補充（[00:41:02]）": "這點稍後補充", "| 1 | 測手寫辨識度[00:01:54] | 未指派 |": "| 1 | 測手寫辨識度 | 未指派 |",
    }
    kept = ["見 [附件一](./annex.md) 的說明", "工項 [待補] 由誰負責尚未確定", "版本 [v2] 已經送出", "預算是 12:34 這個比例", "## 二、議題討論"]
    df = spark.createDataFrame([(1, n, x) for n, x in enumerate([*want, *kept, "a[00:00:01] b[00:00:02] c[00:00:03]"])], "j int, line_no int, line string")
    got = sorted(lines.strip_stamps(df, "j").select("line_no", "line", "removed").collect())
    assert [r["line"] for r in got[:-1]] == [*want.values(), *kept] and [r["removed"] for r in got] == [1] * len(want) + [0] * len(kept) + [3]


def test_heading_limits(spark):
    want = {"## 一、本次會議重點（3 句以內）": "## 一、本次會議重點", "### 3. 報價調整（Jim 提出）": None, "## 二、議題討論（續）": None, "#### a（3-5 條）": "#### a", "# x (最多 5 點) y": "# x y", "控制在（3 句以內）": None, "####### a（3-5 條）": None}
    df = spark.createDataFrame([(n, x) for n, x in enumerate(want)], "line_no int, line string")
    assert [r["line"] for r in sorted(lines.strip_heading_limits(df).select("line_no", "line").collect())] == [v or k for k, v in want.items()]


def test_quotation_lines(spark):
    want = {"> [00:12:01] 王總：「原文」": "原文", "> 「原文」 ": "原文", "> 王：x「原文」": None, "> 王總:「a「b」c」": "a「b」c", "「x」": None, "> [x]「y」": None, "> 王總：「」": None, ">[00:01]「z」": "z", "> " + "長" * 25 + "：「x」": None}
    assert column(spark, list(want), lines.quoted) == list(want.values())


@pytest.mark.parametrize("most", [10**6, 20])
def test_traced(spark, monkeypatch, most):
    """Quotations of any length and script, by one automaton and, beyond what it holds, by the index."""
    monkeypatch.setattr(lines, "AUTOMATON", most)
    quotes = ["會議結論", "brown", " ", "brown  fox", "zzz", "one two three four five six", "", None, "two\nthree", "quick brown fox jumps over it"]
    texts = ["今天會議結論如下", "quick brown\nfox", None, "xone two three four five sixy", "a quick  brown fox jumps over it all", ""]
    got = lines.traced(spark.createDataFrame(list(enumerate(quotes)), "quote_id int, quote string"), spark.createDataFrame(list(enumerate(texts)), "text_id int, text string"))
    plain = lambda x: " ".join((x or "").split())
    assert sorted(map(tuple, got.collect())) == sorted((i, j) for i, q in enumerate(quotes) for j, t in enumerate(texts) if plain(q) and plain(q) in plain(t))


def test_autofix(spark):
    note = "# t\n> 王：「說過 的話」\n> 王：「沒說過」\n> 不是引文\n们「沒說過」"
    r = review.autofix(spark.createDataFrame([(1, note, "前面 說過 的話 後面"), (2, note, "")], "j int, text string, hay string"), "j", {"们": "們"}).orderBy("j").collect()
    assert r[0]["text"] == "# t\n> 王：「說過 的話」\n> 不是引文\n們「沒說過」" and r[0]["quotes_removed"] == 1 and r[0]["converted"] and r[1]["quotes_removed"] == 0


def test_names(spark):
    cases = [("王", ["王總", "李"], "", ("王總", True)), ("王總經理", ["李", "王總"], "", ("王總", True)), ("張", ["王總"], "", ("張", False)), (" ", ["王總"], "", (evidence.UNKNOWN, False)), ("x", [], "講者1", ("講者1", True)), (None, None, None, (evidence.UNKNOWN, False))]
    df = spark.createDataFrame([(n, *c[:3]) for n, c in enumerate(cases)], "n int, name string, roster array<string>, own string")
    who, known = evidence.named(F.col("name"), F.col("roster"), F.col("own"))
    assert [(r[1], r[2]) for r in sorted(df.select("n", who, known).collect())] == [c[3] for c in cases]


def test_schema(spark):
    deep = schema.record(a=schema.listed(schema.Schema(options=(schema.TEXT, schema.record(b=schema.WHOLE)))))
    docs = ['{"a": ["x", {"b": 1}, {"b": 2.5}, 3]}', '{"a": [], "c": 1}', "null", "{", None, '{"a": null}']
    got = column(spark, docs, lambda c: schema.problems(c, deep))
    assert [[(p["path"], p["problem"], p["found"]) for p in g] if g is not None else None for g in got] == [
        [("$.a[2]", "alternatives", "object"), ("$.a[3]", "alternatives", "integer")], [("$.c", "extra", None)], [("$", "kind", "null")], [("$", "json", None)], None, [("$.a", "kind", "null")],
    ]
    good = {"decisions": [], "actions": [], "risks": [], "numbers": ["1"], "meeting": {"x": [1]}}
    assert column(spark, [json.dumps(good)], lambda c: schema.problems(c, schema.ACTION_ITEMS)) == [[]]


def test_first_object(spark):
    want = {'{"a":1} x {"b":2}': '{"a":1}', 'x {"s": "a\\"}{", "k": {"z": 7}} }': '{"s": "a\\"}{", "k": {"z": 7}}', '{"q": "open }': None, "none": None, '{"a": {"b": 1}': None, "}{}": "{}", '{"long": "' + "x\\n" * 20_000 + '"} tail': '{"long": "' + "x\\n" * 20_000 + '"}'}
    assert column(spark, list(want), files.first_object) == list(want.values())


def test_windows(spark):
    text = "a\r\nb\rc\nd\n"
    got = [column(spark, [text], lambda c, o=o, n=n: jobs.read_window(c, F.lit(o), F.lit(n), chars=4))[0] for o, n in ((-3, 2), (2, 0), (3, 9), (9, 1), (None, None))]
    assert [(r["body"], r["first"], r["last"], r["total"], r["truncated"], r["remaining"]) for r in got] == [("a\nb", 1, 2, 4, False, 2), ("b", 2, 2, 4, False, 2), ("c\nd", 3, 4, 4, False, 0), ("", 9, 8, 4, False, 0), ("a\nb\n", 1, 4, 4, True, 0)]


def test_sections(spark):
    d = spark.createDataFrame([(1, "intro\n## client — a\nx\n```\n## no\n```\n## 通用禁則\nban\n## team — b\ny"), (2, "## other\nz"), (3, None)], "j int, text string")
    got = {r["j"]: r["fragment"] for r in jobs.fragment(d, "j", [F.lit("client —"), F.lit("通用禁則")]).collect()}
    assert got == {1: "## client — a\nx\n```\n## no\n```\n## 通用禁則\nban", 2: "## other\nz", 3: None}


def test_export_names(spark):
    names = ["a.md", "a.md", "a_2.md", "a.md", "b", "b", "a_2.md"]
    d = spark.createDataFrame([(1, n, x) for n, x in enumerate(names)], "j int, o int, name string")
    assert [r["export_name"] for r in jobs.export_names(d, "j", "o", "name").orderBy("o").collect()] == ["a.md", "a_2.md", "a_2_2.md", "a_3.md", "b", "b_2", "a_2_3.md"]


def test_evidence_drops(spark):
    """A failed chunk, turns of another chunk, a number that isn't said, a point without a topic."""
    reply = {"topics": [{"topic_id": "a", "label": " ", "turns": [0, 5], "status": "odd", "status_turn": 5}], "points": [{"turn": 1, "speaker": "x", "gist": "g", "topic_id": "zz"}, {"turn": 0, "speaker": "x", "gist": "h", "topic_id": "a"}, {"turn": 9, "speaker": "", "gist": "", "topic_id": "a"}],
             "numbers": [{"turn": 0, "literal": "50%", "means": ""}, {"turn": 0, "literal": "3", "means": ""}, {"turn": 0, "literal": "3", "means": ""}], "actions": [{"turn": 1, "what": "", "owner": "", "due": ""}], "unclear": []}
    replies = spark.createDataFrame([(1, 0, json.dumps(reply)), (1, 1, None)], "job_id int, chunk int, r string").select("job_id", "chunk", F.from_json("r", evidence.EVIDENCE).alias("reply"))
    owned = spark.createDataFrame([(1, 0, 0, "s", "3 things"), (1, 0, 1, "", "more"), (1, 1, 5, "s", "later")], "job_id int, chunk int, index long, speaker string, text string")
    m = evidence.merge_evidence(replies, owned)
    t = m["topics"].first()
    assert (t["topic_id"], t["label"], t["turns"], t["status"], t["status_turn"], t["speakers"], t["source_chars"]) == ("T01", evidence.UNNAMED, [0], "pending", None, ["s"], 8)
    assert {(r["turn"], r["gist"], r["topic_id"]) for r in m["points"].collect()} == {(0, "h", "T01")}
    assert [(r["literal"], r["topic_id"]) for r in m["numbers"].collect()] == [("3", "T01")] and m["actions"].count() == 0
    assert {r["reason"]: r["n"] for r in m["dropped"].collect()} == {"chunk_failed": 1, "point_no_topic": 1, "point_out_of_range": 1, "number_not_in_its_turn": 1, "action_out_of_range": 1}


def test_lists_in_order(spark):
    rows = [("a", "2024-01-02", 5, 10, False, "done"), ("b", "2024-01-02", 9, 30, True, "awaiting_answers"), ("c", None, 7, 20, False, "error"), ("d", "2024-01-03", 1, None, False, "writing")]
    d = spark.createDataFrame(rows, "job string, date string, updated_at long, bytes long, needs_user boolean, state string")
    names = lambda sort: "".join(r["job"] for r in jobs.ordered(d, sort).collect())
    assert [names(s) for s in ("new", "old", "big", "attention")] == ["dbac", "cabd", "bcad", "bcda"]
    scored = spark.createDataFrame([("x", 0.5), ("a", 0.5), ("z", 0.9)], "job string, score double")
    assert [r["job"] for r in review.evaluate(scored).collect()] == ["z", "a", "x"]


def test_agent_files(spark, tmp_path):
    for job, text in (("j1", 'ok: {"a": 1} {"b": 2}'), ("j2", "none")):
        (tmp_path / job).mkdir()
        (tmp_path / job / "r.json").write_text(text)
    got = files.agent_json(spark, str(tmp_path / "*/r.json")).select("job_id", F.try_variant_get("value", "$.a", "int").alias("a")).collect()
    assert {r["job_id"]: r["a"] for r in got} == {"j1": 1, "j2": None}
