"""Queries over rendered notes and what is checked in them; they join those of the catalog.

Conversations give the evidence: each two turns are a topic, some turns are actions,
numbers or unclear.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.functions import text as T
from colloquy.operators import render, review, similar, turns
from colloquy.plans.catalog import CARDS, CHUNKS, cards, conversation_turns, packed, query, table

STAMP_SQL = """printf('%02d:%02d:%02d', "index" * 35 // 3600, "index" * 35 % 3600 // 60, "index" * 35 % 60)"""
SQUASH_SQL = r"trim(regexp_replace({}, '[\s\x{{3000}}]+', ' ', 'g'))"


def digest(c: Column) -> Column:
    return F.md5(c.cast("binary")).alias("digest")


def evidence(spark: SparkSession, sf: str) -> DataFrame:
    t = conversation_turns(spark, sf).withColumn("text", F.translate("text", "\n", " "))
    i, x, who = F.col("index"), F.col("text"), F.col("speaker")
    o = F.floor(i / 2)
    no = lambda s: F.array().cast(f"array<struct<{s}>>")
    point = F.struct(i.alias("turn"), who.alias("speaker"), x.alias("point"))
    some = lambda test, *fields: F.collect_list(F.when(test, F.struct(i.cast("long").alias("turn"), *fields)))
    topic = t.groupBy("job_id", o.alias("o")).agg(
        F.min_by(x, i).alias("label"), F.max_by(who, i).alias("last"), F.array_sort(F.collect_list("index")).alias("turns"), F.array(F.min(point)).alias("first"),
        F.array_sort(F.collect_list(F.struct(i.alias("turn"), who.alias("speaker"), x.alias("gist")))).alias("points"), F.min_by(F.concat(F.lit("> "), who, F.lit("：「"), x, F.lit("」")), i).alias("quote"),
        some(i % 3 == 0, x.alias("what"), who.alias("owner"), F.when(i % 2 == 0, render.UNDATED).otherwise(F.concat(F.lit("day-"), i)).alias("due")).alias("actions"),
        some(i % 4 == 1, (i + 10).cast("string").alias("literal"), F.lit("").alias("means")).alias("numbers"), some(i % 5 == 4, x.alias("why")).alias("unclear"),
    )
    o, even = F.col("o"), F.col("o") % 2 == 0
    status = F.when(o % 3 == 0, "decided").when(o % 3 == 1, "pending").otherwise("parked")
    made = F.struct(
        "o", F.format_string("T%02d", o + 1).alias("id"), "label", F.lit(None).cast("string").alias("heading"), status.alias("status"), F.when(even, F.col("last")).otherwise("").alias("basis"), "turns",
        F.when(even, F.col("first")).otherwise(no("turn:long,speaker:string,point:string")).alias("discussion"), "points", F.when(even, F.array().cast("array<string>")).otherwise(F.array("quote")).alias("quotes"),
    )
    whole = lambda c: F.array_sort(F.flatten(F.collect_list(c))).alias(c)
    return topic.groupBy("job_id").agg(F.array_sort(F.collect_list(made)).alias("topics"), whole("actions"), whole("numbers"), whole("unclear"))


TOPICS = """WITH t AS (SELECT conv_id AS job_id, turn AS i, role, translate(coalesce(text, ''), chr(10), ' ') AS t FROM conversations),
p AS (SELECT job_id, i // 2 AS o, count(*) AS n, arg_min(t, i) AS label, arg_min(role, i) AS r1, arg_min(t, i) AS t1, arg_max(role, i) AS r2, arg_max(t, i) AS t2 FROM t GROUP BY ALL),
s AS (SELECT *, o % 2 = 0 AS even, row_number() OVER (PARTITION BY job_id ORDER BY o) AS k, CASE o % 3 WHEN 0 THEN '已決議' WHEN 1 THEN '待定' ELSE '保留' END AS st FROM p) """


def _document(stem: str, body: list[str]) -> str:
    heads = [f"'## {n}、{render.HEADINGS[k]}'" for n, k in zip("一二三四五六七", render.SKELETONS[stem], strict=False)]
    parts = " || ".join(f"{h} || chr(10) || chr(10) || {b} || chr(10) || chr(10)" for h, b in zip(heads, body, strict=True))
    return f"""SELECT job_id, '{stem}' AS stem, '# job ' || job_id || ' {render.TITLES[stem]}' || chr(10) || chr(10) || {parts} AS x FROM j"""


_COL = {
    "highlights": "hl", "topics": "tp", "decisions": "'| # | 決議 | 依據／理由 |' || chr(10) || '|---|---|---|' || chr(10) || coalesce(dc, '| — | 本次會議未產生明確決議 | 所有議題均未拍板 |')",
    "actions": "'| # | 事項 | 負責人 | 期限 | 狀態 |' || chr(10) || '|---|---|---|---|---|' || chr(10) || coalesce(ac, '| — | 本次會議未產生待辦事項 | — | — | — |')", "numbers": "coalesce(nu, '- 未討論')", "quotes": "coalesce(qu, '- 未討論')",
    "open": "coalesce(nullif(concat_ws(chr(10), op, un), ''), '- 本次會議沒有懸而未決的事項。')", "next": "coalesce(nx, '- 未討論')",
}
DOCUMENTS = TOPICS + """, x AS (SELECT *, row_number() OVER (PARTITION BY job_id, i % 3 = 0 ORDER BY i) AS ka, row_number() OVER (PARTITION BY job_id, i % 3 = 0 AND i % 2 = 1 ORDER BY i) AS kd, row_number() OVER (PARTITION BY job_id, i % 5 = 4 ORDER BY i) AS ku, CASE WHEN i % 2 = 0 THEN '未定' ELSE 'day-' || i END AS due, trim(translate(t, '|', '／')) AS what FROM t),
d AS (SELECT *, row_number() OVER (PARTITION BY job_id, o % 3 = 0 ORDER BY o) AS kd FROM s),
a AS (SELECT job_id, string_agg('- ' || label, chr(10) ORDER BY o) AS hl,
 string_agg(concat_ws(chr(10), '### ' || k || '. ' || label, '', '- **討論內容**：', '  - ' || r1 || '：' || CASE WHEN even THEN trim(t1) ELSE t1 END, CASE WHEN n = 2 THEN '  - ' || r2 || '：' || t2 ELSE '  - 本議題僅一次發言。' END, '- **結論**：' || st || CASE WHEN even THEN '——' || r2 ELSE '' END, CASE WHEN NOT even THEN chr(10) || '> ' || r1 || '：「' || t1 || '」' END, ''), chr(10) ORDER BY o) AS tp,
 string_agg('| ' || kd || ' | ' || label || ' | ' || CASE WHEN even THEN r2 ELSE '會中明確拍板' END || ' |', chr(10) ORDER BY o) FILTER (o % 3 = 0) AS dc,
 string_agg('- ' || label || '——' || st || CASE WHEN even THEN '；' || r2 ELSE '' END, chr(10) ORDER BY o) FILTER (o % 3 <> 0) AS op,
 string_agg('> ' || r1 || '：「' || t1 || '」' || chr(10), chr(10) ORDER BY o) FILTER (NOT even) AS qu FROM d GROUP BY 1),
b AS (SELECT job_id, string_agg('| ' || ka || ' | ' || what || ' | ' || role || ' | ' || due || ' | 未開始 |', chr(10) ORDER BY i) FILTER (i % 3 = 0) AS ac,
 string_agg('- **' || (i + 10) || '** — （未說明用途）', chr(10) ORDER BY i) FILTER (i % 4 = 1) AS nu, string_agg('- （音檔不清楚）' || t, chr(10) ORDER BY i) FILTER (i % 5 = 4 AND ku <= 5) AS un,
 string_agg('- ' || due || '：' || what || '（' || role || '）', chr(10) ORDER BY i) FILTER (i % 3 = 0 AND i % 2 = 1 AND kd <= 5) AS nx FROM x GROUP BY 1), j AS (SELECT * FROM a JOIN b USING (job_id)) """
STEMS = ("note_self", "note_interview")


@query(DOCUMENTS + ", q AS (" + " UNION ALL ".join(_document(s, [_COL[k] for k in render.SKELETONS[s]]) for s in STEMS) + ") SELECT job_id, stem, md5(rtrim(x, ' ' || chr(10)) || chr(10)) AS digest FROM q")
def note_document(spark, sf):
    """SNK05, SNK06, FLT08, FN09, FN10, FN11, TOP06, TOP07: two kinds of note of each job."""
    made = F.array(*(F.struct(F.lit(s).alias("stem"), render.document(s, F.concat(F.lit("job "), F.col("job_id")), F.transform("topics", lambda t: t["label"])).alias("text")) for s in STEMS))
    return evidence(spark, sf).select("job_id", F.inline(made)).select("job_id", "stem", digest(F.col("text")))


@query(TOPICS + """, a AS (SELECT job_id, string_agg(label || '=' || CASE WHEN even THEN r2 ELSE '會中明確拍板' END, ';' ORDER BY o) FILTER (o % 3 = 0) AS decisions FROM s GROUP BY 1),
b AS (SELECT job_id, string_agg(t || '@' || role, ';' ORDER BY i) FILTER (i % 3 = 0) AS actions, string_agg('turn ' || i, ';' ORDER BY i) FILTER (i % 5 = 4) AS risks, string_agg(CAST(i + 10 AS VARCHAR), ';' ORDER BY i) FILTER (i % 4 = 1) AS numbers FROM t GROUP BY 1)
SELECT job_id, coalesce(decisions, '') AS decisions, coalesce(actions, '') AS actions, coalesce(risks, '') AS risks, coalesce(numbers, '') AS numbers FROM a JOIN b USING (job_id)""")
def action_items(spark, sf):
    """SNK07: written as JSON and read back."""
    shape = "decisions array<struct<decision:string,basis:string>>, actions array<struct<item:string,responsible:string>>, risks array<struct<source:string>>, numbers array<string>"
    b = evidence(spark, sf).select("job_id", F.from_json(F.to_json(render.action_items()), shape).alias("b")).select("job_id", "b.*")
    joined = lambda c, f: F.array_join(F.transform(c, f), ";").alias(c)
    return b.select("job_id", joined("decisions", lambda d: F.concat(d["decision"], F.lit("="), d["basis"])), joined("actions", lambda a: F.concat(a["item"], F.lit("@"), a["responsible"])), joined("risks", lambda r: r["source"]), F.array_join("numbers", ";").alias("numbers"))


@query("""WITH c AS (SELECT conv_id AS job_id, count(DISTINCT turn // 2) AS topics, count(*) FILTER (turn % 3 = 0) AS actions FROM conversations GROUP BY 1)
SELECT job_id, md5(concat_ws(chr(10), '# 檔案清單 — job ' || job_id, '', '- **對象**：—', '- **日期**：2024', '- **議題數**：' || topics, '- **待辦數**：' || actions, '', '## 交付文件', '', '| 檔案 | 內容 | 讀者 |', '|---|---|---|', '| `note_self.md` | 內部覆盤 | 僅限我方——嚴禁外傳 |', '| `other.md` | 會議文件 | 內部 |', '| `action_items.json` | 決議／待辦／風險／關鍵數字（結構化） | 內部 |', '')) AS digest FROM c""")
def index_document(spark, sf):
    """SNK08."""
    e = evidence(spark, sf)
    return e.select("job_id", digest(render.index_document(["note_self", "other"], F.concat(F.lit("job "), F.col("job_id")), F.lit(""), F.lit("2024"))))


@query(f"""SELECT conv_id AS job_id, turn AS "index", md5('#' || turn || ' [' || s || '] ' || role || '：' || {SQUASH_SQL.format("coalesce(text, '')")}) AS line, md5('**[' || s || '] ' || role || '**' || chr(10) || chr(10) || regexp_replace(coalesce(text, ''), '^[\\s\\x{{3000}}]+', '') || chr(10)) AS block FROM (SELECT *, {STAMP_SQL.replace('"index"', 'turn')} AS s FROM conversations)""")
def rendered_turns(spark, sf):
    """SNK11: every turn gets a leading stamp, which rendering takes away."""
    t = conversation_turns(spark, sf)
    stamp, x = T.hhmmss(F.col("index") * 35.0), F.concat(F.lit("`[00:06]` "), F.col("text"))
    return t.select("job_id", "index", F.md5(render.turn_line(F.col("index"), stamp, F.col("speaker"), x).cast("binary")).alias("line"), F.md5(render.turn_block(stamp, F.col("speaker"), x).cast("binary")).alias("block"))


@query(CHUNKS + f""", z AS (SELECT *, {STAMP_SQL} AS s, '**[' || {STAMP_SQL} || '] ' || role || '**' || chr(10) || chr(10) || text || chr(10) AS block FROM c), b AS (SELECT job_id, chunk, min(p) AS b FROM c GROUP BY ALL),
v AS (SELECT b.job_id, b.chunk, string_agg(block, chr(10) ORDER BY z.p) AS x FROM b JOIN z ON z.job_id = b.job_id AND z.p < b.b AND z.p >= b.b - 2 GROUP BY ALL),
o AS (SELECT job_id, chunk, string_agg(block, chr(10) ORDER BY p) AS x, printf('<!-- chunk %02d · %s–%s · %d 段 · %d 字 -->', min(chunk), min(s), max(s), count(*), CAST(sum(n) AS BIGINT)) AS h FROM z GROUP BY ALL)
SELECT o.job_id, o.chunk, md5(rtrim(h || chr(10) || CASE WHEN v.x IS NULL THEN '' ELSE '### 上文（僅供理解，**不要**重複整理，不要寫進輸出）' || chr(10) || chr(10) || v.x || chr(10) || '### 本段（**只**整理這一段）' || chr(10) || chr(10) END || o.x, ' ' || chr(10)) || chr(10)) AS digest FROM o LEFT JOIN v ON v.job_id = o.job_id AND v.chunk = o.chunk""")
def chunk_texts(spark, sf):
    """SNK11."""
    t = turns.overlap_context(packed(spark, sf), "job_id", "index", 2).withColumn("stamp", T.hhmmss(F.col("index") * 35.0))
    t = t.withColumn("block", render.turn_block(F.col("stamp"), F.col("speaker"), F.col("text"))).withColumn("n", F.length("text"))
    return render.chunk_text(t, "job_id", "index", "block", "stamp", "n").select("job_id", "chunk", digest(F.col("text")))


@query("""WITH j AS (SELECT conv_id AS job_id, count(*) AS n, list(DISTINCT role ORDER BY role) AS r, string_agg(coalesce(text, ''), chr(10) ORDER BY turn) AS body FROM conversations GROUP BY 1)
SELECT job_id, md5('# 逐字稿（定稿）：job ' || job_id || chr(10) || chr(10) || '- **對象**：—' || chr(10) || '- **長度**：' || printf('%02d:%02d:%02d', n * 35 // 3600, n * 35 % 3600 // 60, n * 35 % 60) || chr(10) || chr(10) || '**講者對應（使用者確認）**' || chr(10) || chr(10) || '- ' || r[1] || ' = A' || chr(10)
 || CASE WHEN len(r) > 1 THEN chr(10) || '**講者對應（系統推測，未經確認）**' || chr(10) || chr(10) || '- ' || r[2] || ' ≈ B' || chr(10) ELSE '' END || chr(10) || '---' || chr(10) || trim(body, ' ' || chr(10)) || chr(10)
 || CASE WHEN n % 2 = 0 THEN concat_ws(chr(10), '', '---', '', '## 修正對照表', '', '| 原文（ASR） | 修正後 | 依據 |', '|---|---|---|', '| x | y | 上下文判讀 |') ELSE '' END || chr(10)) AS digest FROM j""")
def clean_transcript(spark, sf):
    """SNK03."""
    rows = F.array_sort(F.collect_list(F.struct("index", "text")))
    j = conversation_turns(spark, sf).groupBy("job_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("speaker")).alias("r"), F.array_join(F.transform(rows, lambda x: x["text"]), "\n").alias("body"))
    named = lambda at, name: F.transform(F.slice("r", at, 1), lambda s: F.struct(s.alias("label"), F.lit(name).alias("name")))
    fixes = F.filter(F.array(F.struct(F.lit("x").alias("find"), F.lit("y").alias("put"), F.lit("").alias("note"))), lambda f: F.col("n") % 2 == 0)
    facts = {"對象": F.lit("—"), "長度": T.hhmmss(F.col("n") * 35.0)}
    return j.select("job_id", digest(render.clean_transcript(F.concat(F.lit("job "), F.col("job_id")), facts, named(1, "A"), named(2, "B"), F.col("body"), fixes)))


BUNDLE = """WITH t AS (SELECT conv_id AS job_id, turn AS i, role, trim(coalesce(text, '')) AS x, CASE turn % 4 WHEN 0 THEN '已決議' WHEN 1 THEN '未定' WHEN 2 THEN 'Confirmed' ELSE '' END AS st FROM conversations) """


def bundle_source(spark, sf):
    i, x = F.col("index"), F.trim("text")
    status = F.when(i % 4 == 0, "已決議").when(i % 4 == 1, "未定").when(i % 4 == 2, "Confirmed").otherwise("")
    rows = lambda *fields: F.array_sort(F.collect_list(F.struct(i.alias("i"), *fields)))
    return conversation_turns(spark, sf).groupBy("job_id").agg(rows(x.alias("decision"), F.lit(" ").alias("basis"), status.alias("status")).alias("decisions"), rows(x.alias("item"), F.col("speaker").alias("owner"), status.alias("due"), F.lit("").alias("status")).alias("actions"), rows(x.alias("risk")).alias("risks"))


@query(BUNDLE + """, k AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY i) AS k FROM t), s AS (SELECT job_id, string_agg(x, '；' ORDER BY i) FILTER (k <= 3 AND x <> '') AS a, string_agg(x, '；' ORDER BY i) FILTER (k <= 2 AND x <> '') AS r FROM k GROUP BY 1)
SELECT job_id, left(x, 28) AS title, coalesce(nullif(st, ''), x) AS summary, 0.82::DOUBLE AS confidence FROM k WHERE k <= 2 AND x <> '' UNION ALL SELECT job_id, '待辦與推進節點', a, 0.79::DOUBLE FROM s WHERE a IS NOT NULL UNION ALL SELECT job_id, '主要風險與前置限制', r, 0.77::DOUBLE FROM s WHERE r IS NOT NULL""")
def bundle_topics(spark, sf):
    """SNK15."""
    b = bundle_source(spark, sf)
    return b.select("job_id", F.inline(render.bundle_topics(F.col("decisions"), F.col("actions"), F.col("risks"))))


@query(BUNDLE + """SELECT job_id, x AS summary, CASE WHEN i % 2 = 0 THEN 0.84::DOUBLE ELSE 0.68::DOUBLE END AS confidence, CASE WHEN i % 2 = 0 THEN 'confirmed' WHEN i % 4 = 1 THEN 'uncertain' ELSE 'proposed' END AS status FROM t WHERE x <> ''""")
def bundle_decisions(spark, sf):
    """SNK16."""
    return bundle_source(spark, sf).select("job_id", F.inline(render.bundle_decisions(F.col("decisions"))))


@query(BUNDLE + """SELECT job_id, x AS action, nullif(role, '') AS "ownerCandidate", nullif(st, '') AS "dueCandidate", NULL::VARCHAR AS "dependencyCandidate", CASE WHEN role <> '' AND st NOT IN ('', '未定') THEN 0.86::DOUBLE ELSE 0.73::DOUBLE END AS confidence FROM t WHERE x <> ''""")
def bundle_actions(spark, sf):
    """SNK17."""
    return bundle_source(spark, sf).select("job_id", F.inline(render.bundle_actions(F.col("actions"))))


@query("""WITH f AS (SELECT conv_id AS job_id, turn, ['source.wav', 'transcript.md', 'source.mp3', 'questions.json', 'other.txt'][turn % 5 + 1] AS n FROM conversations), k AS (SELECT job_id, CASE n WHEN 'transcript.md' THEN 1 WHEN 'questions.json' THEN 3 WHEN 'other.txt' THEN NULL ELSE 0 END AS ordinal, min(job_id || '/' || n) AS path FROM f GROUP BY ALL)
SELECT job_id, ordinal::BIGINT AS ordinal, ['audio', 'transcript_raw', '', 'diarization'][ordinal + 1] AS kind, path FROM k WHERE ordinal IS NOT NULL UNION ALL SELECT job_id, turn + 4, 'notes', job_id || '/note' || turn || '.md' FROM f WHERE turn < 2""")
def bundle_artifacts(spark, sf):
    """SNK19."""
    t = conversation_turns(spark, sf)
    name = F.get(F.array(*map(F.lit, ("source.wav", "transcript.md", "source.mp3", "questions.json", "other.txt"))), (F.col("index") % 5).cast("int"))
    files = t.select("job_id", F.concat_ws("/", F.col("job_id").cast("string"), name).alias("path"))
    delivered = t.where("index < 2").select("job_id", F.col("index").alias("ordinal"), F.concat(F.col("job_id"), F.lit("/note"), F.col("index"), F.lit(".md")).alias("path"))
    return render.bundle_artifacts(files, "job_id", delivered)


@query("""SELECT o_orderkey, printf('%2d', CAST(r AS BIGINT)) || '  ' || rpad(o_orderpriority, 38, ' ') || '  ' || CASE WHEN o_orderstatus = 'F' THEN 'E' ELSE '-' END || ' ' || printf('%6.3f', o_orderkey % 1000 / 1000.0::DOUBLE) || '  0.500' || printf(' %6d', CAST(r AS BIGINT)) || printf(' %4d', 3) || '/5     ' || printf('%5d', 6) || ' ' || lpad(printf('%,d', CAST(o_orderkey * 1000 AS BIGINT)), CAST(greatest(8, length(printf('%,d', CAST(o_orderkey * 1000 AS BIGINT)))) AS INTEGER), ' ') || ' ' || lpad(printf('%,d', CAST(o_custkey * 100 AS BIGINT)), CAST(greatest(8, length(printf('%,d', CAST(o_custkey * 100 AS BIGINT)))) AS INTEGER), ' ') AS line
 FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders)""")
def score_table(spark, sf):
    """SNK20: orders stand in for notes, customers for their jobs."""
    o = table(spark, sf, "orders").withColumn("r", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    m = {"score": F.col("o_orderkey") % 1000 / 1000.0, "ratio": F.lit(0.5), "topics": F.col("r"), "traceable": F.lit(3), "quotes": F.lit(5), "present": F.lit(6), "note_chars": F.col("o_orderkey") * 1000, "source_chars": F.col("o_custkey") * 100}
    return o.select("o_orderkey", render.score_line(F.col("r"), F.col("o_orderpriority"), F.col("o_orderstatus") == "F", m).alias("line"))


@query(CHUNKS + """, b AS (SELECT job_id, chunk, min(p) AS b, max(p) AS e, min("index") AS f, max("index") AS l FROM c GROUP BY ALL), r AS (SELECT *, unnest([f - 1, l, f]) AS ref, unnest([0, 1, 2]) AS nth FROM b)
SELECT r.job_id, r.chunk, r.nth::BIGINT AS nth, r.ref AS "index", left(c.text, 400) AS excerpt FROM r JOIN c ON c.job_id = r.job_id AND c."index" = r.ref AND c.p BETWEEN r.b - 2 AND r.e WHERE r.nth < 2""")
def hydrated_evidence(spark, sf):
    """JN13: each chunk asks about the turn before it, its last and its first turn; the third reference is beyond the limit."""
    placed = turns.overlap_context(packed(spark, sf), "job_id", "index", 2).withColumn("stamp", T.hhmmss(F.col("index") * 35.0))
    asked = packed(spark, sf).groupBy("job_id", "chunk").agg(F.min("index").alias("f"), F.max("index").alias("l")).select("job_id", "chunk", F.lit("q").alias("id"), F.array(F.col("f") - 1, "l", "f").alias("refs"))
    return review.hydrate(asked, placed, ["job_id", "chunk"]).select("job_id", "chunk", F.col("nth").cast("long"), "index", "excerpt")


@query(CARDS + """, m AS (SELECT user_id, key, count(*) AS n, min(pos) AS guess FROM r GROUP BY ALL) SELECT user_id, key, 'g' || guess || '|以上皆非／我來補充' AS options FROM m WHERE n >= 2 AND NOT EXISTS (SELECT 1 FROM k WHERE k.user_id = m.user_id AND k.type = 'speaker' AND k.key = m.key)""")
def speaker_cards(spark, sf):
    """GRP11, TOP02."""
    e = table(spark, sf, "events").select("user_id", "event_id", F.get_json_object("props", "$.k").alias("label"))
    labels = e.groupBy("user_id", "label").agg(F.count("*").alias("mentions"), F.concat(F.lit("g"), F.min("event_id")).alias("guess"))
    made = review.speaker_cards(cards(spark, sf), labels, "user_id")
    return made.select("user_id", "key", F.array_join(review.final_options(F.col("options"), F.col("best_guess")), "|").alias("options"))


@query(CARDS + """, s AS (SELECT user_id, type, key, list(option ORDER BY seen) AS o FROM o GROUP BY ALL) SELECT user_id, type, key, array_to_string(list_concat(CASE WHEN list_contains(o, 'mine') THEN o[1:5] ELSE list_concat(['mine'], o)[1:5] END, ['以上皆非／我來補充']), '|') AS options FROM s""")
def card_options(spark, sf):
    """TOP02."""
    return cards(spark, sf).select("user_id", "type", "key", F.array_join(review.final_options(F.col("options"), F.lit("mine")), "|").alias("options"))


@query(CHUNKS + """, r AS (SELECT *, CASE WHEN chunk % 3 = 2 THEN NULL WHEN "index" % 2 = 0 THEN 'topics' ELSE 'risks' END AS kind FROM c)
SELECT job_id, coalesce(string_agg(CAST("index" AS VARCHAR), ',' ORDER BY chunk, "index") FILTER (kind = 'topics'), '') AS topics, coalesce(string_agg(CAST("index" AS VARCHAR), ',' ORDER BY chunk, "index") FILTER (kind = 'risks'), '') AS risks, coalesce(array_to_string(list_sort(list(DISTINCT chunk) FILTER (kind IS NULL)), ','), '') AS missing FROM r GROUP BY 1""")
def materials_bundle(spark, sf):
    """AGG18, SET02."""
    p = packed(spark, sf).withColumn("kind", F.when(F.col("chunk") % 3 == 2, None).when(F.col("index") % 2 == 0, "topics").otherwise("risks"))
    b = review.bundle(p.select("job_id", "chunk", F.col("index").alias("pos"), "kind", F.col("index").cast("string").alias("item")), "job_id", ["topics", "risks"])
    return b.select("job_id", F.array_join("topics", ",").alias("topics"), F.array_join("risks", ",").alias("risks"), F.array_join(F.col("missing").cast("array<string>"), ",").alias("missing"))


@query("""SELECT conv_id AS job_id, count(*) FILTER (role = 'assistant') AS files, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS produced_chars, count(*) FILTER (role = 'assistant' AND length(text) < 200) AS stage_failures, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS source_chars,
 CASE WHEN coalesce(sum(length(text)), 0) = 0 THEN 0 ELSE round(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::DOUBLE / sum(length(text)), 3) END AS ratio FROM conversations GROUP BY 1""")
def run_report(spark, sf):
    """AGG19, FN31: what the assistant wrote stands in for documents."""
    t = conversation_turns(spark, sf).withColumn("chars", F.length("text").cast("long"))
    made = t.where("speaker = 'assistant'").withColumn("failed", F.col("chars") < 200)
    return review.run_report(made, t.groupBy("job_id").agg(F.sum("chars").alias("source_chars")), "job_id")


_GRAMS = r"""SELECT *, list_distinct(list_transform(range(1, length(a)), lambda i: substr(a, i, 2))) AS s FROM (SELECT *, lower(regexp_replace({}, '[\s\x{{3000}}。，、；：！？「」『』（）()\[\]【】·・.,!?;:''"-]+', '', 'g')) AS a FROM conversations)"""
ALIKE = f"""WITH t AS ({_GRAMS.format("text")}), u AS ({_GRAMS.format("CASE WHEN turn % 2 = 0 THEN text ELSE string_split(text, ' ')[1] END")}),
b AS (SELECT t.conv_id AS job, t.turn, max(len(list_intersect(t.s, u.s)) / (len(t.s) + len(u.s) - len(list_intersect(t.s, u.s)))) AS best FROM t JOIN u USING (conv_id) GROUP BY ALL) """


@query(ALIKE + "SELECT job AS job_id, turn FROM b WHERE best < 0.5")
def missing_topics(spark, sf):
    """JN10: topics are whole turns, titles whole turns or their first words."""
    t = conversation_turns(spark, sf)
    title = F.when(F.col("index") % 2 == 0, F.col("text")).otherwise(F.get(F.split("text", " "), F.lit(0)))
    left = similar.unmatched(t.select("job_id", F.col("index").alias("id"), F.col("text").alias("label")), t.select("job_id", title.alias("label")), "job_id")
    return left.select("job_id", F.col("id").alias("turn"))


_CHECKED = [render.HEADINGS[k] for k in ("highlights", "topics", "open", "next")]


@query(f"""WITH j AS (SELECT DISTINCT conv_id AS job FROM conversations), s(stem) AS (VALUES {", ".join(f"('{x}')" for x in STEMS)}), h(h) AS (VALUES {", ".join(f"('{x}')" for x in _CHECKED)})
SELECT job, 'quote' AS kind, 'error' AS severity, stem || '.md' AS file, '完全沒說過的話' AS evidence FROM j, s WHERE job % 6 = 1 UNION ALL SELECT job, 'skeleton', 'error', stem || '.md', 'missing' FROM j, s WHERE job % 6 = 2
UNION ALL SELECT job, 'simplified', 'warn', stem || '.md', NULL FROM j, s WHERE job % 6 = 3 UNION ALL SELECT job, 'number', 'error', NULL, 'never' FROM j WHERE job % 6 = 4 UNION ALL SELECT job, 'skeleton', 'error', stem || '.md', h FROM j, s, h WHERE job % 6 = 5
UNION ALL SELECT job, 'schema', 'error', 'action_items.json', 'invalid' FROM j WHERE job % 8 = 1""")
def note_findings(spark, sf):
    """VAL02: rendered notes with faults put in: a quotation that nobody said, a note that is missing, another script, a wrong number, no chapters, broken JSON."""
    hay = conversation_turns(spark, sf).groupBy("job_id").agg(T.squash(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", F.translate("text", "\n", " ").alias("text")))), lambda x: x["text"]), "\n")).alias("hay"))
    job = F.col("job_id")
    fault = lambda text: F.when(job % 6 == 1, F.concat(text, F.lit("> 某：「完全沒說過的話」\n"))).when(job % 6 == 3, F.concat(text, F.lit("们\n"))).when(job % 6 == 5, F.regexp_replace(text, "(?m)^## ", "")).when(job % 6 != 2, text)
    texts = F.array(*(F.struct(F.lit(s + ".md").alias("file"), fault(render.document(s, F.lit(""), F.transform("topics", lambda t: t["label"]))).alias("text")) for s in STEMS))
    facts = F.transform("numbers", lambda n: F.struct(n["literal"].alias("literal"), n["literal"].alias("text")))
    facts = F.when(job % 6 == 4, F.concat(facts, F.array(F.struct(F.lit("never").alias("literal"), F.lit("said 12").alias("text"))))).otherwise(facts)
    items = F.when(job % 8 != 1, F.to_json(render.action_items())).otherwise("{broken")
    notes = evidence(spark, sf).join(hay, "job_id").select(job.alias("job"), "hay", F.transform("topics", lambda t: F.struct(t["id"].alias("id"), t["label"].alias("label"))).alias("topics"), facts.alias("numbers"), items.alias("actions"), F.inline(texts))
    return review.findings(notes, _CHECKED, {"们": "們"})


@query(r"""SELECT page_id, url, n <> '' AND NOT regexp_matches(n, '[/\\]') AND NOT contains(n, '..') AND NOT starts_with(n, '.') AS safe FROM (SELECT *, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN array_extract(string_split(url, '/'), -1) ELSE '..' END AS n FROM pages)""")
def safe_names(spark, sf):
    """VAL05."""
    name = F.when(F.col("page_id") % 3 == 0, F.col("url")).when(F.col("page_id") % 3 == 1, F.element_at(F.split("url", "/"), -1)).otherwise("..")
    return table(spark, sf, "pages").select("page_id", "url", T.is_safe_name(name).alias("safe"))


@query("""SELECT event_id, event_type = 'error' AS refused_stage, value > 50 AND event_id % 2 = 0 AND event_type <> 'error' AS refused_running FROM events""")
def rerun_guard(spark, sf):
    """FLT17."""
    e = table(spark, sf, "events")
    p = T.rerun_problem(F.when(F.col("event_type") == "error", "x").otherwise("scan"), F.when(F.col("value") > 50, "writing").otherwise("done"), F.col("event_id") % 2 == 1)
    return e.select("event_id", F.coalesce(p == "stage", F.lit(False)).alias("refused_stage"), F.coalesce(p == "running", F.lit(False)).alias("refused_running"))


@query("""SELECT event_id, rtrim(event_type || chr(10), chr(10)) || chr(10) || chr(10) || 'more' AS text, CASE WHEN event_id % 3 = 0 THEN 'append' WHEN event_id % 3 = 1 THEN 'invalid' END AS problem FROM events""")
def guarded_writes(spark, sf):
    """SNK13."""
    e, n = table(spark, sf, "events"), F.col("event_id") % 3
    name, content = F.when(n < 2, "a.json").otherwise("a.md"), F.when(n == 0, F.col("props")).otherwise("{x")
    return e.select("event_id", T.appended(F.concat("event_type", F.lit("\n")), F.lit("\nmore")).alias("text"), T.write_problem(name, content, n != 1).alias("problem"))


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'c' WHEN 'view' THEN 'p' || chr(10) || 'q' WHEN 'error' THEN 'r' ELSE '' END AS reply FROM events""")
def reply_texts(spark, sf):
    """FN40."""
    t = F.col("event_type")
    said = lambda content: F.lit('{"choices": [{"message": {"content": ' + content + "}}]}")
    payload = F.when(t == "click", said('" c "')).when(t == "view", said('[{"text": "p"}, {"text": "q"}]')).when(t == "error", said('"", "reasoning_content": " r"')).otherwise("{}")
    return table(spark, sf, "events").select("event_id", T.reply_text(payload).alias("reply"))


@query("""SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'general' END AS kind, event_id % 3 <> 0 OR event_id % 2 = 1 AS want_note, event_id % 2 = 0 AS want_transcript, CASE event_id % 3 WHEN 0 THEN 'md,docx' ELSE 'md,pdf' END AS formats FROM events""")
def output_plan(spark, sf):
    """FN29."""
    n = F.col("event_id")
    chosen = F.when(n % 3 == 0, F.array(F.lit("docx"), F.lit("md"), F.lit("zip")))
    o = table(spark, sf, "events").select("event_id", T.outputs(F.col("event_type"), n % 3 != 0, n % 2 == 0, chosen, ["click", "view"]).alias("o"))
    return o.select("event_id", "o.kind", "o.want_note", "o.want_transcript", F.array_join("o.formats", ",").alias("formats"))
