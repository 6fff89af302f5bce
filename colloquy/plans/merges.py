"""Queries that fold replies of chunk readers, check documents, and report on jobs.

Conversations are jobs, four turns a chunk; replies are written from the turns with faults on purpose:
turns of other chunks, numbers that aren't said, replacements that change nothing, readers that fail.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators import evidence
from colloquy.plans.catalog import conversation_turns, query

SIZE, LONGEST = 4, 600
WORD = r"^\S+"


def owned(spark: SparkSession, sf: str) -> DataFrame:
    t = conversation_turns(spark, sf).withColumn("index", F.col("index").cast("long"))
    return t.withColumn("chunk", F.floor(F.col("index") / SIZE)).withColumn("word", F.regexp_extract("text", WORD, 0))


def in_order(c: Column, by: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(by.alias("k"), c.alias("x")))), lambda r: r["x"])


def evidence_replies(spark: SparkSession, sf: str) -> DataFrame:
    """Replies as JSON, parsed back: what the readers of chunks say."""
    t, i, c = owned(spark, sf), F.col("index"), F.col("chunk")
    first = c * SIZE
    text = lambda *parts: F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))
    stray = F.lit(999999).cast("long")
    a = F.struct(
        F.lit("a").alias("topic_id"), F.substring(F.md5(F.floor(c / 2).cast("string").cast("binary")), 1, 12).alias("label"),
        F.when(c % 5 == 4, F.array(stray)).otherwise(F.array(first, first + 1, first + 3, stray)).alias("turns"), F.when(c % 3 == 0, "decided").when(c % 3 == 1, "pending").otherwise("weird").alias("status"), (first + 1).alias("status_turn"),
    )
    b = F.struct(F.lit("b").alias("topic_id"), F.substring(F.md5(text("b", c).cast("binary")), 1, 12).alias("label"), F.array(first + 2).alias("turns"), F.lit("parked").alias("status"), F.lit(None).cast("long").alias("status_turn"))
    point = lambda turn, topic: F.struct(turn.alias("turn"), F.lit("x").alias("speaker"), text("g", turn).alias("gist"), topic.alias("topic_id"))
    number = F.struct(i.alias("turn"), F.when(i % 2 == 0, F.col("word")).otherwise("never said").alias("literal"), F.lit("m").alias("means"))
    action = lambda mark: F.struct(i.alias("turn"), text("Do ", mark, F.floor(i / 4)).alias("what"), F.when(i % 4 == 1, "ann").otherwise("").alias("owner"), F.lit("").alias("due"))
    lists = t.groupBy("job_id", "chunk").agg(
        in_order(point(i, F.when(i % 3 == 0, "a").otherwise("zz")), i).alias("points"), F.flatten(in_order(F.array(number, number), i)).alias("numbers"),
        F.flatten(in_order(F.when(i % 2 == 1, F.array(action(""), action("- "))).otherwise(F.array().cast("array<struct<turn:bigint,what:string,owner:string,due:string>>")), i)).alias("actions"),
        F.filter(in_order(F.when(i % 4 == 3, F.struct(i.alias("turn"), F.lit(" y ").alias("why"))), i), lambda x: x.isNotNull()).alias("unclear"),
    )
    reply = F.struct(F.array(a, b).alias("topics"), F.concat(F.array(point(first - 1, F.lit("a"))), "points").alias("points"), "numbers", "actions", "unclear")
    return lists.select("job_id", "chunk", F.from_json(F.when(c % 6 != 5, F.to_json(reply)), evidence.EVIDENCE).alias("reply"))


def merged(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return evidence.merge_evidence(evidence_replies(spark, sf), owned(spark, sf), most=LONGEST)


# Turns with their chunk; alive: topic a of a chunk; one row a group of topics; its pieces; the final topics.
MERGE = f"""WITH o AS (SELECT conv_id AS job_id, CAST(turn AS BIGINT) AS i, turn // {SIZE} AS c, role, coalesce(text, '') AS text, regexp_extract(coalesce(text, ''), '^\\S+') AS word FROM conversations),
k AS (SELECT job_id, c, count(*) AS n FROM o GROUP BY ALL), ok AS (SELECT * FROM k WHERE c % 6 <> 5),
a AS (SELECT job_id, c, CASE WHEN c % 2 = 1 AND EXISTS (SELECT 1 FROM ok p WHERE p.job_id = ok.job_id AND p.c = ok.c - 1 AND p.c % 5 <> 4) THEN c - 1 ELSE c END AS g, CASE WHEN c % 3 = 0 THEN 'decided' ELSE 'pending' END AS s, CASE WHEN n > 1 THEN c * {SIZE} + 1 END AS st FROM ok WHERE c % 5 <> 4),
ag AS (SELECT job_id, g, substr(md5(CAST(g // 2 AS VARCHAR)), 1, 12) AS label, CASE WHEN count(*) = 1 OR arg_max(s, c) <> 'pending' OR arg_min(s, c) = 'pending' THEN arg_max(s, c) ELSE arg_min(s, c) END AS s,
  CASE WHEN count(*) = 1 OR arg_max(s, c) <> 'pending' OR arg_min(s, c) = 'pending' THEN list(st ORDER BY c)[-1] ELSE list(st ORDER BY c)[1] END AS st FROM a GROUP BY ALL),
m AS (SELECT o.job_id, o.i, o.role, o.text, a.g * {SIZE} AS h FROM o JOIN a ON o.job_id = a.job_id AND o.c = a.c WHERE o.i % {SIZE} <> 2
  UNION ALL SELECT o.job_id, o.i, o.role, o.text, o.i FROM o JOIN ok ON o.job_id = ok.job_id AND o.c = ok.c WHERE o.i % {SIZE} = 2),
z AS (SELECT *, sum(length(text)) OVER w AS chars, count(*) OVER w AS n, row_number() OVER (PARTITION BY job_id, h ORDER BY i) - 1 AS nth FROM m WINDOW w AS (PARTITION BY job_id, h)),
y AS (SELECT *, CASE WHEN chars > {LONGEST} AND n >= 2 THEN greatest(2, ceil(chars / {LONGEST})) ELSE 1 END AS parts FROM z), x AS (SELECT *, CAST(floor(nth / ceil(n / parts)) AS BIGINT) AS part FROM y),
f AS (SELECT job_id, h, part, list(i ORDER BY i) AS turns, list_sort(list(DISTINCT role)) AS speakers, CAST(sum(length(text)) AS BIGINT) AS source_chars FROM x GROUP BY ALL),
t AS (SELECT f.*, printf('T%02d', row_number() OVER (PARTITION BY f.job_id ORDER BY h, part)) AS topic_id, count(*) OVER (PARTITION BY f.job_id, h) = 1 AS whole,
  coalesce(ag.label, substr(md5('b' || (h // {SIZE})), 1, 12)) AS l0, coalesce(ag.s, 'parked') AS s0, ag.st AS st0 FROM f LEFT JOIN ag ON ag.job_id = f.job_id AND ag.g * {SIZE} = h) """


@query(MERGE + """SELECT job_id, topic_id, CASE WHEN part = 0 THEN l0 ELSE l0 || '（續 ' || (part + 1) || '）' END AS label, array_to_string(turns, ',') AS turns, CASE WHEN whole OR coalesce(list_contains(turns, st0), false) THEN s0 ELSE 'pending' END AS status,
 CASE WHEN whole OR list_contains(turns, st0) THEN st0 END AS status_turn, array_to_string(speakers, ',') AS speakers, source_chars FROM t""")
def evidence_topics(spark, sf):
    """RW05, GRP06, GRP07, SET01, JN11, AGG11, FLT03: topics of all chunks, rejoined and cut."""
    t = merged(spark, sf)["topics"]
    return t.withColumn("turns", F.array_join(F.transform("turns", lambda x: x.cast("string")), ",")).withColumn("speakers", F.array_join("speakers", ","))


# A point by topic a's id whose turn isn't one of its turns: it comes to the topic if that is whole.
@query(MERGE + f""", e AS (SELECT job_id, topic_id, unnest(turns) AS i FROM t), p AS (SELECT o.job_id, o.i, o.c, o.role, i % 3 = 0 AND i % {SIZE} = 2 AND c % 5 <> 4 AS by_id FROM o JOIN ok USING (job_id, c)),
h AS (SELECT p.job_id, p.i, p.role, e.topic_id FROM p JOIN e USING (job_id, i) WHERE NOT by_id UNION ALL SELECT p.job_id, p.i, p.role, t.topic_id FROM p JOIN a ON a.job_id = p.job_id AND a.c = p.c JOIN t ON t.job_id = p.job_id AND t.h = a.g * {SIZE} AND t.whole WHERE by_id)
SELECT job_id, i AS turn, role AS speaker, true AS speaker_verified, 'g' || i AS gist, topic_id FROM h""")
def evidence_points(spark, sf):
    """JN03, JN02, FN12: points with the topic that they come to."""
    return merged(spark, sf)["points"].select("job_id", "turn", "speaker", "speaker_verified", "gist", "topic_id")


@query(MERGE + """SELECT job_id, reason, count(*) AS n FROM (SELECT job_id, 'chunk_failed' AS reason FROM k WHERE c % 6 = 5 UNION ALL SELECT job_id, 'point_out_of_range' FROM ok
 UNION ALL SELECT job_id, 'topic_no_valid_turns' FROM ok WHERE c % 5 = 4 UNION ALL SELECT job_id, 'topic_no_valid_turns' FROM ok WHERE n < 3
 UNION ALL SELECT o.job_id, 'point_no_topic' FROM o JOIN ok USING (job_id, c) WHERE c % 5 = 4 AND o.i % 4 <> 2
 UNION ALL SELECT o.job_id, CASE WHEN word = '' AND i % 2 = 0 THEN 'number_out_of_range' ELSE 'number_not_in_its_turn' END FROM o JOIN ok USING (job_id, c), range(2) WHERE i % 2 = 1 AND NOT contains(text, 'never said') OR word = '' AND i % 2 = 0) GROUP BY ALL""")
def evidence_dropped(spark, sf):
    """AGG10, FLT03, FLT04: how many elements each reason drops."""
    return merged(spark, sf)["dropped"]


@query(MERGE + """SELECT o.job_id, i AS turn, 'Do ' || (i // 4) AS what, CASE WHEN i % 4 = 1 THEN 'ann' ELSE '未指派' END AS owner, '未定' AS due FROM o JOIN ok USING (job_id, c) WHERE i % 2 = 1""")
def evidence_actions(spark, sf):
    """GRP10, FN12: actions, the same wording on a turn once."""
    return merged(spark, sf)["actions"]


@query(MERGE + """, e AS (SELECT job_id, topic_id, unnest(turns) AS i FROM t) SELECT o.job_id, i AS turn, word AS literal, 'm' AS means, topic_id FROM o JOIN ok USING (job_id, c) LEFT JOIN e USING (job_id, i) WHERE i % 2 = 0 AND word <> ''
UNION ALL SELECT o.job_id, i, 'never said', 'm', topic_id FROM o JOIN ok USING (job_id, c) LEFT JOIN e USING (job_id, i) WHERE i % 2 = 1 AND contains(text, 'never said')""")
def evidence_numbers(spark, sf):
    """FLT04, GRP09, JN04: numbers that stand in their turn, once, with the first topic that holds it."""
    return merged(spark, sf)["numbers"]


KINDS = ("speaker", "term", "bogus", "unclear", "conflict", "undecided")


def scan_replies(spark: SparkSession, sf: str) -> DataFrame:
    t, i = owned(spark, sf), F.col("index")
    text = lambda *parts: F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))
    replacement = F.struct(F.when(i % 7 == 0, "简体全文").otherwise(F.col("word")).alias("find"), F.when(i % 5 == 0, F.col("word")).otherwise(F.concat("word", F.lit("!"))).alias("replace"), text("n", i).alias("note"))
    speaker = F.struct("speaker", F.when(i % 3 == 0, "").otherwise(text("g", i)).alias("guess"), F.when(i % 4 == 0, "high").otherwise("low").alias("confidence"), F.lit("").alias("why"))
    speaker = F.struct(speaker["speaker"].alias("label"), speaker["guess"].alias("guess"), speaker["confidence"].alias("confidence"), speaker["why"].alias("why"))
    kind = F.get(F.array(*map(F.lit, KINDS)), (i % len(KINDS)).cast("int"))
    question = F.struct(kind.alias("type"), text("k", i % 5).alias("key"), F.lit("?").alias("question"), F.array(text("o", i % 2), F.lit(" "), F.lit("same")).alias("options"), F.when(i % 2 == 0, text("b", i % 3)).otherwise("").alias("best_guess"))
    lists = t.groupBy("job_id", "chunk").agg(in_order(replacement, i).alias("replacements"), in_order(speaker, i).alias("speakers"), in_order(question, i).alias("questions"), in_order(F.col("text"), i).alias("texts"))
    reply = F.struct(F.when(F.col("chunk") % 2 == 0, F.concat(F.lit(" "), F.array_join("texts", " "))).otherwise("").alias("draft"), "replacements", "speakers", "questions")
    return lists.select("job_id", "chunk", F.from_json(F.when(F.col("chunk") % 3 != 2, F.to_json(reply)), evidence.SCAN).alias("reply"))


def scanned(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    raw = owned(spark, sf).groupBy("job_id", "chunk").agg(F.array_join(in_order(F.concat(F.lit("**"), "speaker", F.lit("**\n"), "text"), F.col("index")), "\n\n").alias("raw"))
    return evidence.merge_scans(scan_replies(spark, sf), raw)


SCANS = f"""WITH o AS (SELECT conv_id AS job_id, CAST(turn AS BIGINT) AS i, turn // {SIZE} AS c, role, coalesce(text, '') AS text, regexp_extract(coalesce(text, ''), '^\\S+') AS word FROM conversations), ok AS (SELECT * FROM o WHERE c % 3 <> 2),
raw AS (SELECT job_id, c, string_agg('**' || role || '**' || chr(10) || text, chr(10) || chr(10) ORDER BY i) AS raw, string_agg(text, ' ' ORDER BY i) AS plain FROM o GROUP BY ALL),
d AS (SELECT job_id, c, trim(CASE WHEN c % 3 <> 2 AND c % 2 = 0 AND trim(plain) <> '' THEN plain ELSE raw END) AS part FROM raw),
j AS (SELECT job_id, coalesce(string_agg(part, chr(10) || chr(10) ORDER BY c) FILTER (part <> ''), '') || chr(10) AS draft FROM d GROUP BY 1) """


@query(SCANS + """SELECT job_id, md5(draft) AS digest, coalesce((SELECT string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FROM raw WHERE raw.job_id = j.job_id AND c % 3 = 2), '') AS failed FROM j""")
def scan_drafts(spark, sf):
    """RW04: the draft of all chunks, raw turns standing in for failed ones."""
    d = scanned(spark, sf)["drafts"]
    return d.select("job_id", F.md5(F.col("draft").cast("binary")).alias("digest"), F.array_join(F.transform("failed", lambda c: c.cast("string")), ",").alias("failed"))


@query(SCANS + """, r AS (SELECT job_id, i, CASE WHEN i % 7 = 0 THEN '简体全文' ELSE word END AS find, CASE WHEN i % 5 = 0 THEN word ELSE word || '!' END AS "replace" FROM ok),
q AS (SELECT job_id, find, "replace", min(i) AS i FROM r WHERE find <> '' AND "replace" <> '' AND find <> "replace" GROUP BY ALL)
SELECT q.job_id, find, "replace", 'n' || i AS note FROM q JOIN j USING (job_id) WHERE contains(draft, find) OR EXISTS (SELECT 1 FROM raw WHERE raw.job_id = q.job_id AND contains(raw.raw, find))""")
def scan_replacements(spark, sf):
    """FLT05, FLT06, GRP08: replacements that change something which was said."""
    return scanned(spark, sf)["replacements"].select("job_id", "find", "replace", "note")


@query(SCANS + """, s AS (SELECT job_id, role AS label, count(*) AS mentions, min(i) AS seen, coalesce(arg_min('g' || i, ((i % 4 <> 0)::INT, i)) FILTER (i % 3 <> 0), '') AS guess, coalesce(min((i % 4 <> 0)::INT) FILTER (i % 3 <> 0) = 0, false) AS sure FROM ok GROUP BY ALL)
SELECT job_id, label, mentions, guess, CASE WHEN sure THEN 'high' ELSE 'low' END AS confidence, CAST(row_number() OVER (PARTITION BY job_id ORDER BY mentions DESC, seen) AS INT) AS rank FROM s""")
def scan_speakers(spark, sf):
    """AGG12, TOP13: speakers by mentions, with the guess of highest confidence."""
    return scanned(spark, sf)["speakers"]


@query(SCANS + f""", q AS (SELECT job_id, c, i, ['speaker', 'term', 'bogus', 'unclear', 'conflict', 'undecided'][i % 6 + 1] AS type, 'k' || (i % 5) AS key, 'o' || (i % 2) AS o, CASE WHEN i % 2 = 0 THEN 'b' || (i % 3) ELSE '' END AS b FROM ok),
u AS (SELECT job_id, type, key, o AS opt, (i, 0) AS p FROM q UNION ALL SELECT job_id, type, key, 'same', (i, 1) FROM q),
v AS (SELECT job_id, type, key, opt, min(p) AS p FROM u WHERE type <> 'bogus' GROUP BY ALL), w AS (SELECT job_id, type, key, list(opt ORDER BY p) AS opts FROM v GROUP BY ALL),
g AS (SELECT job_id, type, key, arg_min(b, i) AS b, list_sort(list(DISTINCT c)) AS chunks FROM q WHERE type <> 'bogus' GROUP BY ALL),
s AS (SELECT job_id, role, count(*) AS n, coalesce(arg_min('g' || i, ((i % 4 <> 0)::INT, i)) FILTER (i % 3 <> 0), '') AS guess FROM ok GROUP BY ALL HAVING count(*) >= 2),
al AS (SELECT job_id, type, key, opts, b, chunks FROM w JOIN g USING (job_id, type, key) UNION ALL SELECT job_id, 'speaker', role, CASE WHEN guess <> '' THEN [guess] ELSE [] END, guess, [] FROM s WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.job_id = s.job_id AND g.type = 'speaker' AND g.key = s.role)),
r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY list_position(['speaker', 'term', 'unclear', 'conflict', 'undecided'], type), -len(chunks), key) AS rank FROM al)
SELECT job_id, printf('q%02d', rank) AS id, type, key, array_to_string(list_transform(chunks, lambda x: CAST(x AS VARCHAR)), ',') AS chunks, array_to_string(list_concat((CASE WHEN b <> '' AND NOT list_contains(opts, b) THEN list_concat([b], opts) ELSE opts END)[1:5], ['以上皆非／我來補充']), '|') AS options,
 CASE WHEN b <> '' THEN b ELSE coalesce(opts[1], '') END AS best_guess FROM r WHERE rank <= 8""")
def scan_cards(spark, sf):
    """RW04, AGG13, GRP11, TOP01, TOP02, FLT07: the questions that are asked."""
    c = scanned(spark, sf)["cards"]
    return c.select("job_id", "id", "type", "key", F.array_join(F.transform("chunks", lambda x: x.cast("string")), ",").alias("chunks"), F.array_join("options", "|").alias("options"), "best_guess")
