"""Queries in which one job holds half of all rows, so that it is cut into segments and blocks; ROWS and BLOCK are small enough
to cut it at every scale of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.operators import lines, turns
from colloquy.plans.catalog import BUDGET, conversation_turns, query, table, transcripts

ROWS, BLOCK = 64, 32


def one_job(c):
    return F.when(c % 2 == 0, F.lit(-1).cast("long")).otherwise(c)


@query(f"""WITH RECURSIVE t AS (SELECT CASE WHEN conv_id % 2 = 0 THEN -1 ELSE conv_id END AS job_id, conv_id * 1000 + turn AS "index", length(coalesce(text, '')) AS n, row_number() OVER (PARTITION BY CASE WHEN conv_id % 2 = 0 THEN -1 ELSE conv_id END ORDER BY conv_id, turn) AS p FROM conversations),
w AS (SELECT job_id, p, "index", n, n AS used, CAST(0 AS BIGINT) AS chunk FROM t WHERE p = 1
  UNION ALL SELECT t.job_id, t.p, t."index", t.n, CASE WHEN w.used + t.n > {BUDGET} THEN t.n ELSE w.used + t.n END, CASE WHEN w.used + t.n > {BUDGET} THEN w.chunk + 1 ELSE w.chunk END FROM w JOIN t ON t.job_id = w.job_id AND t.p = w.p + 1)
SELECT job_id, chunk, count(*) AS turns, CAST(sum(n) AS BIGINT) AS chars, min("index") AS first_turn, max("index") AS last_turn FROM w GROUP BY ALL""")
def giant_job_chunks(spark, sf):
    """GRP04, SRC05, AGG16: half of all turns are one job, packed by doubled jumps between blocks."""
    t = conversation_turns(spark, sf).select(one_job(F.col("job_id")).alias("job_id"), (F.col("job_id") * 1000 + F.col("index")).alias("index"), F.length("text").alias("n"))
    return turns.chunk_rollup(turns.pack(t, "job_id", "index", F.col("n"), BUDGET, ROWS, BLOCK), "job_id", "index", F.col("n"))


HALF = "SELECT CASE WHEN event_id % 2 = 0 THEN -1 ELSE user_id END AS job_id, * FROM events"


def half_events(spark, sf):
    return table(spark, sf, "events").withColumn("job_id", F.when(F.col("event_id") % 2 == 0, F.lit(-1).cast("long")).otherwise(F.col("user_id")))


@query(f"""WITH f AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR lag(event_id) OVER w IS NULL THEN 1 ELSE 0 END AS n FROM ({HALF}) WINDOW w AS (PARTITION BY job_id ORDER BY ts)),
g AS (SELECT *, CAST(sum(n) OVER (PARTITION BY job_id ORDER BY ts) - 1 AS BIGINT) AS island FROM f)
SELECT job_id, island, event_type, count(*) AS segments, min(event_id) AS first_id, max(event_id) AS last_id FROM g GROUP BY ALL""")
def giant_job_islands(spark, sf):
    """GRP03, WIN01, WIN03: runs across the segments of a job."""
    g = turns.islands(half_events(spark, sf), "job_id", "ts", F.col("event_type"), rows=ROWS)
    return g.groupBy("job_id", "island", "event_type").agg(F.count("*").alias("segments"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query(f"""SELECT event_id, coalesce(last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY job_id ORDER BY ts), 0.0) AS known FROM ({HALF})""")
def giant_job_carry(spark, sf):
    """WIN02: values carried over the segments of a job."""
    e = half_events(spark, sf).withColumn("v", F.when(F.col("event_type") == "purchase", F.col("value")))
    return turns.carry_forward(e, "job_id", "ts", "v", "known", F.lit(0.0), rows=ROWS).select("event_id", "known")


@query(r"""WITH l AS (SELECT CASE WHEN doc_id % 2 = 0 THEN -1 ELSE doc_id END AS job_id, doc_id, unnest(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) AS line, generate_subscripts(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), 1) - 1 AS i FROM documents WHERE text IS NOT NULL),
f AS (SELECT *, length(line) % 5 = 0 AS is_fence FROM l), g AS (SELECT *, sum(CAST(is_fence AS INT)) OVER (PARTITION BY job_id ORDER BY doc_id, i) AS n FROM f)
SELECT job_id, doc_id, count(*) AS lines, count(*) FILTER (is_fence) AS fences, count(*) FILTER (n % 2 = 1 AND NOT is_fence) AS inside FROM g GROUP BY ALL""")
def giant_job_fences(spark, sf):
    """WIN04: lines of many documents as one job, those of a length divisible by five being fences."""
    d = lines.lines(table(spark, sf, "documents").where("text is not null").select("doc_id", "text"))
    line = F.when(F.length("line") % 5 == 0, F.lit("```")).otherwise(F.concat(F.lit("."), F.col("line")))
    own = d.select(one_job(F.col("doc_id")).alias("job_id"), "doc_id", (F.col("doc_id") * 1_000_000 + F.col("line_no")).alias("line_no"), line.alias("line"))
    at = lines.fenced(own, "job_id", ROWS)
    return at.groupBy("job_id", "doc_id").agg(F.count("*").alias("lines"), F.count_if("is_fence").alias("fences"), F.count_if("in_fence").alias("inside"))


@query("""WITH t AS (SELECT CASE WHEN conv_id % 2 = 0 THEN -1 ELSE conv_id END AS job_id, row_number() OVER (PARTITION BY CASE WHEN conv_id % 2 = 0 THEN -1 ELSE conv_id END ORDER BY conv_id, turn) AS "index", role AS speaker, turn * 35.0::DOUBLE AS t_start, CASE WHEN turn % 2 = 1 THEN turn * 35.0::DOUBLE + 30 END AS t_end FROM conversations)
SELECT * FROM t UNION ALL SELECT DISTINCT job_id, 0, '', 0.0::DOUBLE, NULL::DOUBLE FROM t""")
def giant_job_turns(spark, sf):
    """SRC03, SRC04: transcripts line by line, half of all in one job; headings amid a job belong to the turn before."""
    each = lines.lines(transcripts(spark, sf))
    own = each.select(one_job(F.col("job_id")).alias("job_id"), (F.col("job_id") * 1_000_000 + F.col("line_no")).alias("line_no"), "line")
    return lines.parse_lines(own, "job_id", ROWS).select("job_id", F.col("index").cast("long").alias("index"), "speaker", "t_start", "t_end")
