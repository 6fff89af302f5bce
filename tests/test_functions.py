"""Golden values of text functions and operators that SQL can't express."""

import random
import re

from pyspark.sql import functions as F

from colloquy.functions import text as T
from colloquy.operators import intervals, lines, review, turns


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_similarity(spark):
    sim = lambda a, b: one(spark, T.label_similarity(F.lit(a), F.lit(b)))
    assert abs(sim("付款條件", "付款條件討論") - 0.6) < 1e-9 and sim("報價金額", "交期安排") < 0.5 and sim("報價、付款", "報價付款") == 1.0 and sim("", "x") == 0.0


def test_stamps(spark):
    assert [one(spark, T.parse_stamp(F.lit(x))) for x in ("01:02:03", "02:03", "x:1", None, "1")] == [3723.0, 123.0, None, None, None]
    assert [one(spark, T.hhmmss(F.lit(x).cast("double"))) for x in (3723.9, -5.0, 360000.0)] == ["01:02:03", "00:00:00", "100:00:00"]


def test_scale(spark):
    assert [round(one(spark, T.scale_past_bar(F.lit(v), 0.30, 0.70)), 6) for v in (0.30, 0.15, 1.80, 0.0)] == [0.7, 0.35, 1.0, 0.0]


def test_absurd(spark):
    assert [one(spark, T.is_absurd(F.lit(a).cast("int"), F.lit(b).cast("int"))) for a, b in ((112, 2), (9, 4), (4, 4), (4, None))] == [True, True, False, False]


def test_substitute_guards_digits(spark):
    pairs = F.array(F.struct(F.lit("講者1").alias("find"), F.lit("王$1").alias("put")))
    assert one(spark, T.substitute(F.lit("講者1 講者11 講者1"), pairs)) == "王$1 講者11 王$1"


def test_quotations(spark):
    note = "> [00:01:02] 王：這是一段很長的引文內容啊\n短「名」\n「這也是一段很長的引文內容」"
    assert one(spark, T.quotations(F.lit(note))) == ["這也是一段很長的引文內容", "這是一段很長的引文內容啊"]


def test_scrub(spark):
    df = spark.createDataFrame([(1, "a [00:12:34] b\n```\n[00:12:34]\n```\n（[12:34]） c。\nx [00:02:53]–[00:03:04] 。")], "job long, text string")
    got = lines.rejoin(lines.strip_stamps(lines.lines(df), "job"), "job").first()["text"]
    assert got == "a b\n```\n[00:12:34]\n```\n c。\nx。"


def test_disclaimers(spark):
    df = spark.createDataFrame([(1, "t\n> 講者對應為推測\n> more\nbody\n> kept「聲紋分群」")], "job long, text string")
    got = lines.rejoin(lines.strip_runs(lines.lines(df), "job", ["講者對應為推測"], ["聲紋分群"]), "job").first()["text"]
    assert got == "t\nbody\n> kept「聲紋分群」"


def test_cluster(spark):
    rows = [(1, 0, "付款條件", [8, 9], "pending", 9), (1, 1, "付款條件討論", [10, 11], "decided", 11), (2, 0, "付款條件", [1], "pending", 1), (2, 1, "付款條件", [9], "pending", 9)]
    t = spark.createDataFrame(rows, "job_id long, chunk long, label string, turns array<long>, status string, status_turn long")
    got = sorted((r["job_id"], r["topic_id"], r["turns"], r["status"], r["label"]) for r in turns.cluster_topics(t).collect())
    assert got == [(1, "T01", [8, 9, 10, 11], "decided", "付款條件討論"), (2, "T01", [1], "pending", "付款條件"), (2, "T02", [9], "pending", "付款條件")]


def test_excerpt(spark):
    rows = [(1, "短句。", "x"), (2, "甲乙丙丁。付款條件三十天。" + "無關的句子很長很長。" * 4, "付款條件"), (3, "長" * 100, "x")]
    got = {r["k"]: r["excerpt"] for r in lines.excerpts(spark.createDataFrame(rows, "k long, text string, focus string"), ["k"], 20).collect()}
    assert got[1] == "短句。" and "付款條件" in got[2] and len(got[2]) <= 20 and got[2] in rows[1][1] and got[3] == "長" * 20


def test_excerpts_are_the_best_of_all_runs(spark):
    """Texts of short, long, empty and Greek sentences against looking at every run; rows aren't multiplied by their runs."""
    rng, limit, noise = random.Random(5), 24, " 。，！？!?.,-'"
    word = lambda: "".join(rng.choice("abAΣİςß會議😀 ,-。!?") for _ in range(rng.choice([0, 3, 30, 90])))
    rows = [(i, word(), word() if i % 5 else None) for i in range(300)] + [(300, None, "x"), (301, "a。" * 40, "a"), (302, "!" * 50, ""), (303, "長" * 30 + "。短。", "長")]

    def grams(x):
        x = "".join(c.lower()[0] for c in x or "" if c not in noise)
        return {x} if len(x) == 1 else {x[i : i + 2] for i in range(len(x) - 1)}

    def best(text, focus):
        t, y = " ".join(text.split()), grams(focus)
        if len(t) <= limit:
            return t
        one = re.findall("[^。！？!?]*[。！？!?]|[^。！？!?]+", t)
        runs = [("".join(one[a:e]), -a) for a in range(len(one)) for e in range(a + 1, len(one) + 1) if sum(map(len, one[a:e])) <= limit]
        ranked = [(len(grams(w) & y) / len(grams(w) | y) if grams(w) and y else 0.0, len(w), a, w) for w, a in runs]
        return max(ranked)[3].strip(" ") if ranked else one[0][:limit]

    d = lines.excerpts(spark.createDataFrame(rows, "k long, text string, focus string"), ["k"], limit)
    assert {r["k"]: r["excerpt"] for r in d.collect()} == {k: best(t, f) for k, t, f in rows if t is not None}
    assert "Generate" not in d._jdf.queryExecution().optimizedPlan().toString()


def test_candidates(spark):
    s = spark.createDataFrame([(1, i, s, float(i), i + 1.0) for i, s in enumerate([0, 1, 0, 2])], "job long, i int, s int, a double, b double")
    r = intervals.segment_stats(s, "job", "i", "s", "a", "b").first()
    assert (r["num_speakers"], r["switches"], r["singletons"]) == (3, 3, 2)


def test_overlap_ties_and_gaps(spark):
    p = spark.createDataFrame([(1, 1, 0.0, 2.0), (1, 2, 50.0, 51.0)], "job long, probe int, start double, end double")
    g = spark.createDataFrame([(1, 0, -1.0, 1.0, 7), (1, 1, 1.0, 9.0, 8)], "job long, i int, start double, end double, speaker int")
    assert {(r["probe"], r["speaker"]) for r in intervals.dominant_overlap(p, g, "job", 5.0).collect()} == {(1, 7), (2, None)}


def test_answers(spark):
    rows = [("own", "a", "g"), ("", "a", "g"), ("", review.OTHER, "g"), (None, None, "g")]
    v, c = review.resolve_answer(F.col("x"), F.col("y"), F.col("z"))
    assert [tuple(r) for r in spark.createDataFrame(rows, "x string, y string, z string").select(v, c).collect()] == [("own", True), ("a", True), ("g", False), ("g", False)]


def test_chinese_index(spark):
    assert [one(spark, T.chinese_index(F.lit(n))) for n in (1, 9, 10, 12, 20, 45)] == ["一", "九", "十", "十二", "二十", "四十五"]


def test_message(spark):
    s = F.lit
    assert one(spark, T.message(s("error"), s(""), s(" boom "), F.array(s("/x/a.md"), s("b.pdf")), s("j1"), s(""))) == "⚠️ **失敗**\n狀態：失敗\n\nboom\n\n📎 附件：a.md、b.pdf\n\nJob: `j1`"
    assert one(spark, T.message(s("done"), s("T"), s(""), F.array().cast("array<string>"), s(""), s("u"))) == "✅ **T**\n\n🔗 u"


def test_patch_and_answers(spark):
    m = F.create_map(F.lit("title"), F.lit("a"), F.lit("_orig"), F.lit("o"))
    assert one(spark, T.patch(m, F.create_map(F.lit("title"), F.lit("b"), F.lit("evil"), F.lit("x")), ["title"])) == {"title": "b", "_orig": "o"}
    df = spark.createDataFrame([({"q1": ("a", None), "q2": None}, [("x", None), (" ", "y")])], "c map<string,struct<choice:string,custom:string>>, f array<struct<find:string,put:string>>")
    c, f = T.clean_answers(F.col("c"), F.col("f"))
    r = df.select(c.alias("c"), f.alias("f")).first()
    assert {k: tuple(v) for k, v in r["c"].items()} == {"q1": ("a", "")} and [tuple(x) for x in r["f"]] == [("x", "")]


def test_reply_text(spark):
    for payload, want in (
        ('{"output_text": " a "}', "a"),
        ('{"output": [{"type": "x"}, {"type": "message", "content": [{"text": "p"}, {"text": ""}, {"text": "q"}]}]}', "p\nq"),
        ('{"choices": [{"message": {"content": "[1]"}}]}', "[1]"),
        ('{"choices": [{"message": {"content": null, "reasoning_content": "r"}}]}', "r"),
        ("not json", ""),
        (None, ""),
    ):
        assert one(spark, T.reply_text(F.lit(payload).cast("string"))) == want


def test_settings(tmp_path):
    import hmac

    from colloquy.sources import config

    defaults = {"notify": {"mode": "log"}, "agent": {"api": {"url": "u", "key": ""}}}
    file = tmp_path / "c.json"
    file.write_text('{"agent": {"api": {"key": "k"}}, "notify": {"enabled": true, "bin": "b"}}')
    got = config.load(str(file), defaults)
    assert got["agent"]["api"] == {"url": "u", "key": "k"} and got["notify"]["mode"] == "command" and got["notify"]["command"] == "b send --to telegram {message}"
    file.write_text("{broken")
    assert config.load(str(file), defaults) == defaults
    assert config.sign("k", b"x") == "sha256=" + hmac.new(b"k", b"x", "sha256").hexdigest()
    for bad in ("../x", "", "a/../../x"):
        try:
            config.inside(str(tmp_path), bad)
            raise AssertionError(bad)
        except ValueError:
            pass


EMPTY = "job string, file string, text string, hay string, topics array<struct<id:string,label:string>>, numbers array<struct<literal:string,text:string>>, actions string"


def found(spark, **changes):
    text = "# T\n\n## 一、重點\n\n### 1. 付款條件\n\n> 王：「這是一段原文」\n"
    row = {"job": "j", "file": "n.md", "text": text, "hay": "前文 這是一段原文 後文", "topics": [("T01", "付款條件討論")], "numbers": [("30", "共 30 天")], "actions": "{}"} | changes
    df = spark.createDataFrame([tuple(row.values())], EMPTY)
    return sorted((r["kind"], r["severity"], r["evidence"]) for r in review.findings(df, ["重點"], {"们": "們"}).collect())


def test_findings(spark):
    """A clean note has none; each fault injected gives its finding."""
    text = "# T\n\n## 一、重點\n\n### 1. 付款條件\n\n> 王：「這是一段原文」\n"
    assert found(spark) == []
    assert found(spark, text=text.replace("原文", "假文")) == [("quote", "error", "這是一段假文")]
    assert found(spark, text=text + "我们") == [("simplified", "warn", None)]
    assert found(spark, text=text.replace("## 一、重點", "## 一、別的")) == [("skeleton", "error", "重點")]
    assert found(spark, topics=[("T01", "付款條件討論"), ("T02", "交期安排")]) == [("topic_count", "error", "T02")]
    assert found(spark, numbers=[("31", "共 30 天"), ("7", None)]) == [("number", "error", "31"), ("number", "error", "7")]
    assert found(spark, actions="{oops") == [("schema", "error", "invalid")] and found(spark, actions=None) == [("schema", "error", "missing")]
    assert found(spark, text=None) == [("skeleton", "error", "missing")]


def test_bullets_are_topped_up(spark):
    from colloquy.operators import render

    topic = "struct<turns:array<long>,discussion:array<struct<turn:long,speaker:string,point:string>>,points:array<struct<turn:long,speaker:string,gist:string>>>"
    rows = [((([1, 2, 3], [(1, "王", "王：一")], [(1, "王", "x"), (2, "李", "二"), (2, "李", "again"), (3, "", "三"), (4, "趙", "四")])),), (([1], [], []),), (([1], [(1, "王", "一")], []),)]
    got = [r[0] for r in spark.createDataFrame(rows, f"t {topic}").coalesce(1).select(render.bullets(F.col("t"))).collect()]
    assert got == [["  - 王：一", "  - 李：二", "  - 三"], ["  - （音檔不清楚，本議題無法整理出具體討論內容）"], ["  - 王：一", "  - 本議題僅一次發言。"]]


def test_file_sinks(spark, tmp_path):
    from colloquy.sources import files

    m = spark.createDataFrame([("hello", "2024-01-02 03:04:05", "done", "", "offline")], "message string, at string, event string, mode string, reason string").withColumn("at", F.to_timestamp("at"))
    for _ in range(2):
        files.park(m, str(tmp_path / "log"))
    got = [r["value"] for r in spark.read.text(str(tmp_path / "log")).collect()]
    assert sorted(got) == sorted(["=== 2024-01-02 03:04:05 | event=done | mode=- | offline ===", "hello", ""] * 2)
    (tmp_path / "names").mkdir()
    for n in ("b.md", "a.json"):
        (tmp_path / "names" / n).write_text("x")
    assert [r["name"] for r in files.names(spark, str(tmp_path / "names")).collect()] == ["a.json", "b.md"]


def test_script_trie_equals_a_naive_scan(spark):
    """Overlapping phrases, the longest at each place, outputs not read again; a large table."""
    import random

    rng = random.Random(1)
    for n in (3, 40, 20_000):
        letters = "你好嗎我們是abc"
        table = {"".join(rng.choice(letters) for _ in range(rng.randint(1 if n < 100 else 4, 7))): "".join(rng.choice(letters) for _ in range(rng.randint(0, 4))) for _ in range(n)}
        texts = ["".join(rng.choice(letters + "x。") for _ in range(rng.randint(0, 200))) for _ in range(60)] + [None, ""]

        def naive(t):
            out, i = "", 0
            while i < len(t):
                k = next((k for k in range(7, 0, -1) if t[i : i + k] in table and i + k <= len(t)), 0)
                out, i = out + (table[t[i : i + k]] if k else t[i]), i + (k or 1)
            return out

        got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.map_script(F.col("t"), {"嗎": "吗"}, table).alias("x")).orderBy("i").collect()
        assert [r["x"] for r in got] == [t if t is None else naive(t.replace("嗎", "吗")) for t in texts]


def test_names_quotations_and_reports(spark):
    def one(c):
        return spark.range(1).select(c.alias("x")).first()["x"]

    assert [one(T.slug(F.lit(x))) for x in (" a/b:c  d ", "", "...", "ＡＢ　Ｃ", "x" * 50, "a--b", "會 議")] == ["a-b-c-d", "會議", "會議", "AB-C", "x" * 40, "a--b", "會-議"]
    kinds = [one(T.report_type(F.lit(a), F.lit(n))) for a, n in ((" Client ", 0), ("PARTNER", 5), ("x", 3), (None, 2))]
    assert kinds == ["advisory", "advisory", "action", "record"] and all(one(T.report_reason(F.lit(k))) for k in kinds)
    note = "他說「這句話剛好有十個字喔」和「太短」\n> [00:01] 王：「引號裡面的話也要十個字」\n>   李: plain words are quoted\n> [x] short\n「「這句話剛好有十個字喔」"
    assert one(T.quotations(F.lit(note))) == ["這句話剛好有十個字喔", "引號裡面的話也要十個字", "plain words are quoted"]
    assert one(T.query_tokens(F.lit("見 API/v2: 預算 a 會 __x.y- 預算 ab"))) == ["預算", "apiv2", "xy"]
    assert one(T.roster(F.lit("王、李 張/王\n陳，"))) == ["王", "李", "張", "陳"]
    assert [tuple(one(c) for c in T.speaker_guess(F.lit(v))) for v in ("王（主席）", "王", "王（）", " 王 （ a（b） ） ", "（x）")] == [("王", "主席"), ("王", None), ("王（）", None), ("王", "a（b）"), ("", "x")]
    assert one(T.sentences(F.lit("a。b？！c"))) == ["a。", "b？", "！", "c"] and one(T.sentences(F.lit(""))) == []
