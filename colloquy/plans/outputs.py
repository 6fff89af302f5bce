"""Queries over sections beside topics, names and signatures of files, quotations of notes and the order of scored notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.functions import text as T
from colloquy.operators import scans, sections
from colloquy.plans.catalog import conversation_turns, query, table


SECTIONS = """WITH t AS (SELECT conv_id AS job_id, 'T' || lpad(CAST(turn AS VARCHAR), 2, '0') AS topic_id, coalesce(text, '') AS x, length(coalesce(text, '')) AS n, turn FROM conversations),
s AS (SELECT job_id, topic_id, left(x, 40) AS heading, n % 5 = 0 AS failed, n FROM t WHERE n % 7 > 0 UNION ALL SELECT job_id, 'X' || turn, left(x, 40), false, n FROM t WHERE n % 11 = 0),
r AS (SELECT job_id, topic_id, '新 ' || left(x, 40) AS heading, n % 2 = 0 AS failed FROM t WHERE n % 5 = 0),
w AS (SELECT s.job_id, s.topic_id, coalesce(r.heading, s.heading) AS heading, CASE WHEN r.job_id IS NULL THEN s.failed ELSE r.failed END AS failed, r.job_id IS NOT NULL AS renewed FROM s LEFT JOIN r ON s.job_id = r.job_id AND s.topic_id = r.topic_id) """


@query(SECTIONS + """SELECT coalesce(t.job_id, w.job_id) AS job_id, coalesce(t.topic_id, w.topic_id) AS topic_id, w.heading, w.renewed, CASE WHEN t.job_id IS NULL THEN 'unknown' WHEN w.job_id IS NULL THEN 'missing' WHEN w.failed THEN 'failed' ELSE 'written' END AS reason FROM t FULL JOIN w ON t.job_id = w.job_id AND t.topic_id = w.topic_id""")
def section_topics(spark, sf):
    """JN05: topics and sections of each job, with sections that nobody wrote or asked for; those that failed are taken anew, and some fail again."""
    t = conversation_turns(spark, sf).withColumn("n", F.length("text"))
    topic, head = F.format_string("T%02d", "index"), F.substr("text", F.lit(1), F.lit(40))
    topics = t.select("job_id", topic.alias("topic_id"))
    first = t.where("n % 7 > 0").select("job_id", topic.alias("topic_id"), head.alias("heading"), (F.col("n") % 5 == 0).alias("failed"))
    extra = t.where("n % 11 = 0").select("job_id", F.concat(F.lit("X"), F.col("index")).alias("topic_id"), head.alias("heading"), F.lit(False).alias("failed"))
    written = first.unionByName(extra)
    asked = sections.to_redo(sections.with_topics(topics, written, "job_id"), "job_id")
    again = t.select("job_id", topic.alias("topic_id"), F.concat(F.lit("新 "), head).alias("heading"), (F.col("n") % 2 == 0).alias("failed")).join(asked, ["job_id", "topic_id"], "left_semi")
    return sections.with_topics(topics, sections.renewed(written, again, "job_id"), "job_id").select("job_id", "topic_id", "heading", "renewed", "reason")


@query(r"""SELECT page_id, coalesce(nullif(left(trim(regexp_replace(trim(coalesce(url, '')), '[\\/:*?"<>|\s]+', '-', 'g'), '-.'), 40), ''), '會議') AS slug FROM pages""")
def slugs(spark, sf):
    """FN24: folder names from addresses."""
    return table(spark, sf, "pages").select("page_id", T.slug(F.col("url")).alias("slug"))


@query("""WITH k AS (SELECT event_id, CASE WHEN lower(trim(t)) IN ('client', 'partner') THEN 'advisory' WHEN n >= 3 THEN 'action' ELSE 'record' END AS kind FROM (SELECT event_id, CASE event_type WHEN 'click' THEN ' Client' WHEN 'view' THEN 'PARTNER ' ELSE event_type END AS t, CAST(value AS BIGINT) % 5 AS n FROM events))
SELECT event_id, kind, CASE kind WHEN 'advisory' THEN '客戶／合作型會議，較適合先進 advisory review flow。' WHEN 'action' THEN '待辦項目明確且數量較多，適合 action report 起手。' ELSE '目前資訊較中性，先以 meeting record 承接。' END AS reason FROM k""")
def report_kinds(spark, sf):
    """FN32: kinds of reports and why, meeting types being in any case and with blanks."""
    e = table(spark, sf, "events")
    kind = F.when(F.col("event_type") == "click", " Client").when(F.col("event_type") == "view", "PARTNER ").otherwise(F.col("event_type"))
    own = e.select("event_id", T.report_type(kind, F.rint("value").cast("long") % 5).alias("kind"))
    return own.withColumn("reason", T.report_reason(F.col("kind")))


@query("""WITH t AS (SELECT conv_id AS job_id, turn, role, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS x FROM conversations),
q AS (SELECT job_id, turn + CASE WHEN turn % 3 = 1 THEN 0 ELSE 1000 END AS o, x AS q FROM t WHERE turn % 3 < 2 AND length(x) >= 10), f AS (SELECT job_id, q, min(o) AS o FROM q GROUP BY ALL)
SELECT t.job_id, any_value(n) AS n, any_value(digest) AS digest FROM (SELECT DISTINCT job_id FROM t) t JOIN (SELECT job_id, count(*) AS n, md5(string_agg(q, '|' ORDER BY o)) AS digest FROM f GROUP BY 1) USING (job_id) GROUP BY 1""")
def note_quotations(spark, sf):
    """FN26: quotations in notes that quote turns inline, as blocks with stamp and speaker, or not at all."""
    t = conversation_turns(spark, sf).withColumn("x", F.trim(F.regexp_replace("text", r"\s+", " ")))
    line = F.when(F.col("index") % 3 == 0, F.concat(F.lit("> [00:01] "), "speaker", F.lit("："), "x")).when(F.col("index") % 3 == 1, F.concat(F.lit("他說「"), "x", F.lit("」了"))).otherwise(F.concat(F.lit("- "), F.col("x")))
    notes = t.groupBy("job_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", line.alias("line")))), lambda r: r["line"]), "\n").alias("note"))
    q = notes.select("job_id", T.quotations(F.col("note")).alias("q")).where(F.size("q") > 0)
    return q.select("job_id", F.size("q").cast("long").alias("n"), F.md5(F.array_join("q", "|").cast("binary")).alias("digest"))


KEY = "colloquy"


INNER, OUTER = (p.encode("latin-1").hex() for p in T.pads(KEY))


@query(f"SELECT item_id, 'sha256=' || sha256(unhex('{OUTER}') || unhex(sha256(unhex('{INNER}') || encode(text)))) AS signature FROM benchmark")
def signed_bodies(spark, sf):
    """FN35: signatures of bodies, in the JVM."""
    return table(spark, sf, "benchmark").select("item_id", T.signature(KEY, F.col("text")).alias("signature"))


@query("""SELECT doc_id, length(text) % 97 AS score, row_number() OVER (ORDER BY length(text) % 97 DESC, doc_id) AS rank FROM documents WHERE text IS NOT NULL""")
def evaluated_notes(spark, sf):
    """TOP04: scored notes in order, equal ones by name, ranked without a window over all rows in one task."""
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", (F.length("text") % 97).cast("long").alias("score"))
    return scans.numbered(d.withColumn("_all", F.lit(0)), "_all", -F.col("score"), "rank", [F.col("doc_id")], rows=64).drop("_all")


@query("""SELECT event_id, event_type AS title, CASE WHEN event_id % 3 = 0 THEN upper(event_type) ELSE 'c' || user_id END AS client, CASE WHEN event_id % 2 = 0 THEN 'new' END AS date,
 CAST(2 + CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS INT) AS n, CASE WHEN event_id % 5 = 0 THEN 0 ELSE 1 END AS answers, CASE WHEN value > 50 THEN 1 ELSE 0 END AS fixes FROM events""")
def patched_meta(spark, sf):
    """FN38, FN39: meta data with the allowed keys of a patch put over it, answers without null cards and blank finds."""
    e = table(spark, sf, "events")
    i, some = F.col("event_id"), lambda test, k, v: F.when(test, F.create_map(F.lit(k), v)).otherwise(F.create_map().cast("map<string,string>"))
    meta = F.create_map(F.lit("title"), F.col("event_type"), F.lit("client"), F.concat(F.lit("c"), F.col("user_id")))
    body = F.map_concat(some(i % 3 == 0, "client", F.upper("event_type")), some(i % 2 == 0, "date", F.lit("new")), F.create_map(F.lit("secret"), F.col("props")))
    cards = F.create_map(F.lit("q01"), F.when(i % 5 > 0, F.struct(F.col("event_type").alias("choice"), F.lit(None).cast("string").alias("custom"))))
    fixes = F.array(F.struct(F.when(F.col("value") > 50, "x").otherwise(" ").alias("find"), F.col("props").alias("put")))
    kept, clean = T.clean_answers(cards, fixes)
    new = e.select(i, T.patch(meta, body, ["title", "client", "date"]).alias("m"), F.size(kept).alias("answers"), F.size(clean).alias("fixes"))
    return new.select("event_id", F.col("m.title").alias("title"), F.col("m.client").alias("client"), F.col("m.date").alias("date"), F.size("m").alias("n"), "answers", "fixes")
