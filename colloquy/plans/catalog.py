"""Named queries over the driver's tables, each beside its DuckDB form.

The adapters give the tables their roles: conversations are turns, events are speaker
segments and state changes, documents are notes, benchmark items are quotations.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.functions import text as T
from colloquy.operators import intervals, lines, review, substrings, turns

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

BUDGET = 1500


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def conversation_turns(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    return c.select(F.col("conv_id").alias("job_id"), F.col("turn").alias("index"), F.col("role").alias("speaker"), F.coalesce("text", F.lit("")).alias("text"))


def packed(spark: SparkSession, sf: str) -> DataFrame:
    return turns.pack(conversation_turns(spark, sf), "job_id", "index", F.length("text"), BUDGET)


# Chunks by a recursive walk over each job's turns.
CHUNKS = f"""WITH RECURSIVE t AS (SELECT conv_id AS job_id, turn AS "index", role, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations),
w AS (SELECT job_id, p, "index", n AS used, CAST(0 AS BIGINT) AS chunk FROM t WHERE p = 1
  UNION ALL SELECT t.job_id, t.p, t."index", CASE WHEN w.used + t.n > {BUDGET} THEN t.n ELSE w.used + t.n END, CASE WHEN w.used + t.n > {BUDGET} THEN w.chunk + 1 ELSE w.chunk END FROM w JOIN t ON t.job_id = w.job_id AND t.p = w.p + 1),
c AS (SELECT t.*, w.chunk FROM t JOIN w USING (job_id, p)) """


@query(CHUNKS + """SELECT job_id, chunk, count(*) AS turns, CAST(sum(n) AS BIGINT) AS chars, min("index") AS first_turn, max("index") AS last_turn FROM c GROUP BY ALL""")
def turn_chunks(spark, sf):
    """GRP04, AGG16, SRC05, SNK21."""
    sizes = conversation_turns(spark, sf).select("job_id", "index", F.length("text").alias("n"))
    return turns.chunk_rollup(turns.pack(sizes, "job_id", "index", F.col("n"), BUDGET), "job_id", "index", F.col("n"))


@query(CHUNKS + """, b AS (SELECT job_id, chunk, min(p) AS b FROM c GROUP BY ALL)
SELECT job_id, chunk, "index", false AS is_overlap FROM c UNION ALL
SELECT c.job_id, b.chunk, c."index", true FROM b JOIN c ON c.job_id = b.job_id AND c.p < b.b AND c.p >= b.b - 2""")
def chunk_overlap_context(spark, sf):
    """GRP05, WIN05."""
    return turns.overlap_context(packed(spark, sf), "job_id", "index", 2).select("job_id", "chunk", "index", "is_overlap")


@query("""SELECT conv_id AS job_id, count(*) AS turns, string_agg(coalesce(text, ''), '' ORDER BY turn) AS joined FROM conversations GROUP BY 1""")
def chunk_reassembly_check(spark, sf):
    """Own turns of all chunks in order give the input again."""
    own = turns.overlap_context(packed(spark, sf), "job_id", "index", 2).where(~F.col("is_overlap"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("chunk", "index", "text"))), lambda x: x["text"])
    return own.groupBy("job_id").agg(F.count("*").alias("turns"), F.array_join(ordered, "").alias("joined"))


def event_rows(spark, sf):
    e = table(spark, sf, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    end = F.coalesce(F.lead(us).over(w), us)
    return e.select("user_id", "event_id", "ts", "event_type", "value", "props", (us / 1e6).alias("start"), (end / 1e6).alias("end"), ((end - us) / 1e6).alias("dur"))


EVENTS = """WITH e AS (SELECT *, epoch_us(ts) / 1e6 AS start, epoch_us(coalesce(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts)) / 1e6 AS "end",
 (epoch_us(coalesce(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts)) - epoch_us(ts)) / 1e6 AS dur FROM events) """


@query("""WITH f AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR lag(event_id) OVER w IS NULL THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY ts) - 1 AS BIGINT) AS island FROM f)
SELECT user_id, island, event_type, count(*) AS segments, min(event_id) AS first_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts) AS ids FROM g GROUP BY ALL""")
def turn_merge_islands(spark, sf):
    """GRP03, WIN01, WIN03, SNK10."""
    g = turns.islands(table(spark, sf, "events"), "user_id", "ts", F.col("event_type"))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id"))), lambda x: x["event_id"].cast("string"))
    return g.groupBy("user_id", "island", "event_type").agg(F.count("*").alias("segments"), F.min("event_id").alias("first_id"), F.array_join(ids, ",").alias("ids"))


@query(EVENTS + """, f AS (SELECT *, row_number() OVER w AS p, CASE WHEN row_number() OVER w = 1 OR dur >= 3600 THEN event_type END AS kept FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
b AS (SELECT *, last_value(kept IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bef FROM f),
g AS (SELECT *, CAST(sum(CASE WHEN p = 1 OR (dur >= 3600 AND event_type <> bef) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) - 1 AS BIGINT) AS piece FROM b)
SELECT user_id, event_id, piece, first_value(event_type) OVER (PARTITION BY user_id, piece ORDER BY ts) AS piece_speaker FROM g""")
def absorb_short_runs(spark, sf):
    """GRP01, GRP02."""
    return turns.absorb_short(event_rows(spark, sf), "user_id", "ts", "event_type", "dur", 3600.0).select("user_id", "event_id", "piece", "piece_speaker")


STATS = EVENTS + """, r AS (SELECT user_id, event_type AS s, start AS a, "end" AS b, "end" - start AS d, CASE WHEN lag(event_id) OVER w IS NOT NULL AND event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS sw FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
m AS (SELECT user_id, max(b) - min(a) AS span, count(DISTINCT s) AS num_speakers, count(*) AS num_segments, CAST(sum(sw) AS BIGINT) AS switches, count(*) FILTER (d <= 3600) AS short, count(*) FILTER (d <= 7200) AS brief, median(d) AS med FROM r GROUP BY 1),
g AS (SELECT user_id, count(*) FILTER (n = 1) AS singletons FROM (SELECT user_id, s, count(*) AS n FROM r GROUP BY ALL) GROUP BY 1),
st AS (SELECT user_id, round(span, 3) AS span, num_speakers, num_segments, switches, short, brief, round(med, 3) AS median, singletons, CASE WHEN span > 0 THEN round(num_segments / (span / 86400), 3) ELSE 0 END AS segments_per_min,
 CASE WHEN span > 0 THEN round(switches / (span / 86400), 3) ELSE 0 END AS switches_per_min, round(short / num_segments, 3) AS short_ratio FROM m JOIN g USING (user_id)) """


def user_stats(spark, sf):
    s = intervals.segment_stats(event_rows(spark, sf), "user_id", "ts", "event_type", "start", "end", 3600, 7200, 86400)
    return s.withColumn("span", F.round("span", 3)).withColumn("median", F.round("median", 3))


@query(STATS + "SELECT * FROM st")
def segment_stats(spark, sf):
    """AGG01-03, WIN01."""
    return user_stats(spark, sf)


ABSURD = "(num_speakers > greatest(2 * k, k + 3))"
SCORED = STATS + f""", c AS (SELECT *, user_id % 10 AS job, round(abs(num_speakers - k) * CASE WHEN num_speakers >= k THEN 300 ELSE 180 END + CASE WHEN {ABSURD} THEN 5000 ELSE 0 END
 + singletons * 90 + segments_per_min * 6 + switches_per_min * 5 + short_ratio * 120 - least(median, 8) * 3, 3) AS score FROM (SELECT *, 2 AS k FROM st)) """


@query(SCORED + """SELECT job, user_id, score, num_speakers FROM c QUALIFY row_number() OVER (PARTITION BY job ORDER BY score, CASE WHEN num_speakers <> k THEN 1 ELSE 0 END, singletons, switches_per_min, user_id) = 1""")
def candidate_score_best(spark, sf):
    """AGG04, TOP03."""
    c = user_stats(spark, sf).withColumn("job", F.col("user_id") % 10).withColumn("score", intervals.score(F.lit(2)))
    return intervals.best_candidate(c, "job", F.lit(2), "user_id").select("job", "user_id", "score", "num_speakers")


@query(STATS + f"""SELECT user_id, {ABSURD} AS absurd, CASE WHEN num_speakers = k THEN false WHEN {ABSURD} THEN true ELSE (user_id % 2 = 0 OR abs(num_speakers - k) >= 2) END AS again FROM (SELECT *, user_id % 4 + 1 AS k FROM st)""")
def fallback_flag(spark, sf):
    """FN30, FN36, JN14."""
    s = user_stats(spark, sf).withColumn("k", F.col("user_id") % 4 + 1)
    return s.select("user_id", T.is_absurd(F.col("num_speakers"), F.col("k")).alias("absurd"), T.should_run_fallback(F.col("num_speakers"), F.col("k"), F.col("user_id") % 2 == 0).alias("again"))


@query("""WITH j AS (SELECT DISTINCT user_id, CAST(user_id % 9 AS INT) AS k FROM events), t AS (SELECT user_id, 0 AS o, 'mono' AS channel, greatest(1, least(8, k)) AS clusters FROM j WHERE k > 0 UNION ALL SELECT user_id, 1, 'mono', greatest(1, least(8, k + 1)) FROM j WHERE k > 0
 UNION ALL SELECT user_id, 2, 'left', greatest(1, least(8, k)) FROM j WHERE k > 0 AND user_id % 2 = 0 UNION ALL SELECT user_id, 3, 'right', greatest(1, least(8, k)) FROM j WHERE k > 0 AND user_id % 2 = 0),
d AS (SELECT user_id, channel, clusters, min(o) AS o FROM t GROUP BY ALL) SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY o) - 1 AS INT) AS ordinal, channel, clusters, channel || '-k' || clusters AS candidate_id FROM d""")
def fallback_plan(spark, sf):
    """GRP12."""
    j = table(spark, sf, "events").select("user_id").distinct().withColumn("k", (F.col("user_id") % 9).cast("int")).withColumn("stereo", F.col("user_id") % 2 == 0)
    return intervals.fallback_plan(j, "k", "stereo").select("user_id", F.col("ordinal").cast("int"), "channel", "clusters", "candidate_id")


@query("""WITH p AS (SELECT user_id, event_id AS probe, epoch_us(ts) / 1e6 AS s, epoch_us(ts) / 1e6 + 86400 AS e FROM events WHERE event_type = 'click'),
g AS (SELECT user_id, event_id AS i, epoch_us(ts) / 1e6 AS s, epoch_us(ts) / 1e6 + 43200 AS e, event_id % 4 AS speaker FROM events WHERE event_type <> 'click'),
o AS (SELECT p.user_id, p.probe, g.speaker, least(p.e, g.e) - greatest(p.s, g.s) AS ov, g.i FROM p JOIN g ON p.user_id = g.user_id AND g.s < p.e AND g.e > p.s),
b AS (SELECT * FROM o WHERE ov > 0 QUALIFY row_number() OVER (PARTITION BY user_id, probe ORDER BY ov DESC, i) = 1)
SELECT p.user_id, p.probe, b.speaker, round(b.ov, 3) AS overlap FROM p LEFT JOIN b ON p.user_id = b.user_id AND p.probe = b.probe""")
def dominant_overlap(spark, sf):
    """JN01."""
    e = table(spark, sf, "events").withColumn("start", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    p = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("probe"), "start", (F.col("start") + 86400).alias("end"))
    g = e.where("event_type <> 'click'").select("user_id", F.col("event_id").alias("i"), "start", (F.col("start") + 43200).alias("end"), (F.col("event_id") % 4).alias("speaker"))
    return intervals.dominant_overlap(p, g, "user_id", 86400.0).select("user_id", "probe", "speaker", F.round("overlap", 3).alias("overlap"))


@query("""SELECT event_id, coalesce(last_value(CASE WHEN event_type <> 'click' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts), 0.0) AS known FROM events""")
def carry_forward_time(spark, sf):
    """WIN02."""
    e = table(spark, sf, "events").withColumn("v", F.when(F.col("event_type") != "click", F.col("value")))
    return turns.carry_forward(e, "user_id", "ts", "v", "known", F.lit(0.0)).select("event_id", "known")


def transcripts(spark, sf):
    """Transcripts written from the conversations, in two header forms, with a preamble."""
    t = conversation_turns(spark, sf)
    stamp = T.hhmmss(F.col("index") * 35.0)
    head = F.when(F.col("index") % 2 == 0, F.format_string("**%s** [%s]", "speaker", stamp)).otherwise(F.format_string("**── %s ──** `[%s – %s]`", F.col("speaker"), stamp, T.hhmmss(F.col("index") * 35.0 + 30)))
    block = F.concat(head, F.lit("\n"), F.trim(F.col("text")), F.lit("\n"))
    body = F.transform(F.array_sort(F.collect_list(F.struct("index", block.alias("b")))), lambda x: x["b"])
    return t.groupBy("job_id").agg(F.concat(F.lit("# Title\r\n\r\n"), F.array_join(body, "\n")).alias("text"))


@query("""SELECT conv_id AS job_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS "index", role AS speaker, turn * 35.0::DOUBLE AS t_start, CASE WHEN turn % 2 = 1 THEN turn * 35.0::DOUBLE + 30 END AS t_end, length(trim(text)) AS chars, md5(trim(text)) AS digest FROM conversations
UNION ALL SELECT DISTINCT conv_id, 0, '', 0.0::DOUBLE, NULL::DOUBLE, 7, md5('# Title') FROM conversations""")
def header_blocks(spark, sf):
    """SRC03, SRC04, SRC13, FN01, WIN02-03, FLT01: transcripts parsed back into the turns they were written from."""
    p = lines.parse_transcript(transcripts(spark, sf), "job_id")
    return p.select("job_id", F.col("index").cast("long").alias("index"), "speaker", "t_start", "t_end", F.length("text").cast("long").alias("chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query("""SELECT event_id, printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) AS stamp, s::DOUBLE AS back FROM (SELECT event_id, CAST(floor(value * 400) AS BIGINT) AS s FROM events)""")
def stamp_roundtrip(spark, sf):
    """FN01, FN02."""
    stamp = T.hhmmss(F.floor(F.col("value") * 400).cast("double"))
    return table(spark, sf, "events").select("event_id", stamp.alias("stamp"), T.parse_stamp(stamp).alias("back"))


@query(r"""SELECT doc_id, md5(trim(regexp_replace(text, '[\s\x{3000}]+', ' ', 'g'))) AS digest FROM documents""")
def squash_text(spark, sf):
    """FN03, FLT02."""
    return table(spark, sf, "documents").select("doc_id", F.md5(T.squash(F.col("text")).cast("binary")).alias("digest"))


NOISE_SQL = r"""'[\s\x{3000}。，、；：！？「」『』（）()\[\]【】·・.,!?;:''"-]+'"""


@query(f"""SELECT doc_id, md5(lower(regexp_replace(text, {NOISE_SQL}, '', 'g'))) AS digest FROM documents""")
def normalize_label(spark, sf):
    """FN04."""
    return table(spark, sf, "documents").select("doc_id", F.md5(T.normalize_label(F.col("text")).cast("binary")).alias("digest"))


@query(f"""WITH n AS (SELECT p_partkey, p_name, p_type, lower(regexp_replace(p_name, {NOISE_SQL}, '', 'g')) AS a FROM (SELECT p_name, p_type, min(p_partkey) AS p_partkey FROM part GROUP BY ALL)),
g AS (SELECT *, list_distinct(list_transform(range(1, length(a)), lambda i: substr(a, i, 2))) AS s FROM n)
SELECT x.p_partkey AS a, y.p_partkey AS b, round(len(list_intersect(x.s, y.s)) / (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s))), 6) AS sim FROM g x JOIN g y ON x.p_type = y.p_type AND x.p_partkey < y.p_partkey WHERE len(list_intersect(x.s, y.s)) > 0""")
def bigram_jaccard_pairs(spark, sf):
    """FN05, FN06: pairs that share a bigram within a type, by an inverted index."""
    n = table(spark, sf, "part").groupBy("p_name", "p_type").agg(F.min("p_partkey").alias("id"))
    g = n.select("id", "p_type", T.bigrams(T.normalize_label(F.col("p_name"))).alias("s"))
    e = g.select("id", "p_type", F.size("s").alias("n"), F.explode("s").alias("g"))
    f = e.select("p_type", "g", F.col("id").alias("b"), F.col("n").alias("m"))
    both = e.join(f, ["p_type", "g"]).where("id < b").groupBy("id", "b", "n", "m").agg(F.count("*").alias("k"))
    return both.select(F.col("id").alias("a"), "b", F.round(F.col("k") / (F.col("n") + F.col("m") - F.col("k")), 6).alias("sim"))


def _grams(label: str) -> str:
    """SQL of the distinct bigrams of a label."""
    plain = f"lower(regexp_replace({label}, {NOISE_SQL}, '', 'g'))"
    return f"CASE WHEN length({plain}) = 1 THEN [{plain}] ELSE list_distinct(list_transform(range(1, length({plain})), lambda i: substr({plain}, i, 2))) END"


@query(rf"""WITH t AS (SELECT conv_id AS job_id, turn AS "index", trim(regexp_replace(translate(coalesce(text, ''), '.', '。'), '[\s\x{{3000}}]+', ' ', 'g')) AS t, translate(coalesce(text, ''), '.', '。') AS raw FROM conversations), o AS (SELECT job_id, arg_min(raw, "index") AS focus FROM t GROUP BY 1),
s AS (SELECT job_id, "index", t, unnest(regexp_extract_all(t, '[^。！？!?]*[。！？!?]|[^。！？!?]+')) AS one, generate_subscripts(regexp_extract_all(t, '[^。！？!?]*[。！？!?]|[^。！？!?]+'), 1) AS i FROM t WHERE length(t) > 160),
e AS (SELECT *, CAST(sum(length(one)) OVER (PARTITION BY job_id, "index" ORDER BY i) AS BIGINT) AS e FROM s), w AS (SELECT a.job_id, a."index", a.i, substr(a.t, a.e - length(a.one) + 1, b.e - a.e + length(a.one)) AS win FROM e a JOIN e b ON a.job_id = b.job_id AND a."index" = b."index" AND b.i >= a.i AND b.e - a.e + length(a.one) <= 160),
g AS (SELECT w.*, {_grams("win")} AS x, {_grams("focus")} AS y FROM w JOIN o USING (job_id)), k AS (SELECT *, CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0 ELSE len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))) END AS sim FROM g),
b AS (SELECT job_id, "index", trim(win) AS best FROM k QUALIFY row_number() OVER (PARTITION BY job_id, "index" ORDER BY sim DESC, length(win) DESC, i) = 1)
SELECT t.job_id, t."index", CASE WHEN length(t.t) <= 160 THEN t.t ELSE coalesce(b.best, left(t.t, CAST(least(f.e, 160) AS BIGINT))) END AS excerpt FROM t LEFT JOIN b ON b.job_id = t.job_id AND b."index" = t."index" LEFT JOIN e f ON f.job_id = t.job_id AND f."index" = t."index" AND f.i = 1""")
def excerpt_windows(spark, sf):
    """FN07: the excerpt of each turn that is nearest to the job's first turn."""
    t = conversation_turns(spark, sf).withColumn("text", F.translate("text", ".", "。"))
    focus = t.groupBy("job_id").agg(F.min_by("text", "index").alias("focus"))
    return lines.excerpts(t.join(focus, "job_id"), ["job_id", "index"])


@query(r"""SELECT conv_id AS job_id, turn AS "index", '> ' || CASE WHEN turn % 2 = 0 THEN '[00:00:07] ' ELSE '' END || CASE WHEN turn % 3 = 0 THEN '未知講者' ELSE role END || '：「' || CASE WHEN length(t) <= 160 THEN t ELSE left(t, 160) END || '」' AS line FROM (SELECT *, trim(regexp_replace(replace(coalesce(text, ''), '。', ' '), '[\s\x{3000}!?！？]+', ' ', 'g')) AS t FROM conversations)""")
def rendered_quotes(spark, sf):
    """FN08: quotations with a stamp or none, cut from turns of one sentence that begin with a stamp."""
    t = conversation_turns(spark, sf)
    plain = F.trim(F.regexp_replace(F.replace(F.col("text"), F.lit("。"), F.lit(" ")), r"[\s\x{3000}!?！？]+", " "))
    marked = t.withColumn("text", lines.without_stamp(F.concat(F.lit("`[00:06]` "), plain))).withColumn("focus", F.lit(""))
    cut = lines.excerpts(marked, ["job_id", "index"]).join(t.select("job_id", "index", "speaker"), ["job_id", "index"])
    who = F.when(F.col("index") % 3 != 0, F.col("speaker")).otherwise("")
    return cut.select("job_id", "index", lines.render_quote(F.when(F.col("index") % 2 == 0, "00:00:07"), who, F.col("excerpt")).alias("line"))


PAIRS = """WITH q AS (SELECT item_id, trim(regexp_replace(text, '[\\s\\x{3000}]+', ' ', 'g')) AS q FROM benchmark), t AS (SELECT doc_id, trim(regexp_replace(text, '[\\s\\x{3000}]+', ' ', 'g')) AS t FROM documents) """


@query(PAIRS + "SELECT item_id, doc_id FROM q JOIN t ON contains(t, q)")
def quote_traceability(spark, sf):
    """JN09."""
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("text_id"), "text")
    return lines.traced(q, d).select(F.col("quote_id").alias("item_id"), F.col("text_id").alias("doc_id"))


LATIN, IDEOGRAPHS = "abcdefghijklmnopqrstuvwxyz \n\r\t", "天地玄黃宇宙洪荒日月盈昃辰宿列張寒來暑往秋收冬藏閏餘"


@query("""WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'abcdefghijklmnopqrstuvwxyz ' || chr(10) || chr(13) || chr(9), '天地玄黃宇宙洪荒日月盈昃辰宿列張寒來暑往秋收冬藏閏餘') AS t FROM documents),
q AS (SELECT doc_id AS quote_id, substr(t, 1 + doc_id % 50, 1 + doc_id * 7 % 70) AS q FROM t) SELECT quote_id, doc_id FROM q JOIN t ON q <> '' AND contains(t, q)""")
def ideograph_quotations(spark, sf):
    """JN09, FLT05: a quotation from each document, of 1 to 70 characters of a script without spaces, in all documents, by the index of substrings."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("text_id"), F.translate(F.coalesce("text", F.lit("")), LATIN, IDEOGRAPHS).alias("text"))
    i = F.col("text_id")
    q = d.select(i.alias("quote_id"), F.substr("text", (1 + i % 50).cast("int"), (1 + i * 7 % 70).cast("int")).alias("quote"))
    return substrings.held(q, d).select("quote_id", F.col("text_id").alias("doc_id"))


@query(PAIRS + "SELECT item_id FROM q WHERE NOT EXISTS (SELECT 1 FROM t WHERE contains(t, q))")
def untraceable_quotes(spark, sf):
    """JN09 anti."""
    found = quote_traceability(spark, sf).select("item_id").distinct()
    return table(spark, sf, "benchmark").join(found, "item_id", "left_anti").select("item_id")


@query("""WITH l AS (SELECT doc_id, regexp_extract_all(text, '[0-9]{2,}') AS l FROM documents), n AS (SELECT doc_id, unnest(l) AS literal, generate_subscripts(l, 1) - 1 AS pos FROM l), c AS (SELECT DISTINCT doc_id + pos % 2 AS claimed, literal FROM n)
SELECT claimed, literal, coalesce(contains(text, literal), false) AS kept FROM c LEFT JOIN documents ON doc_id = claimed""")
def number_provenance(spark, sf):
    """FLT04, GRP09: each second number of a document is claimed for the next one, which may not hold it."""
    d = table(spark, sf, "documents")
    n = d.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("[0-9]{2,}"), F.lit(0))).alias("pos", "literal"))
    claims = n.select((F.col("doc_id") + F.col("pos") % 2).alias("claimed"), "literal").distinct()
    own = claims.join(d.select(F.col("doc_id").alias("claimed"), T.squash(F.col("text")).alias("hay")), "claimed", "left")
    return own.select("claimed", "literal", F.coalesce(F.contains("hay", T.squash(F.col("literal"))), F.lit(False)).alias("kept"))


@query(r"""WITH s AS (SELECT conv_id, 'seg-' || (turn + 1) AS id, regexp_replace(lower(text), '[^0-9a-z\x{4e00}-\x{9fff}]+', '', 'g') AS hay FROM conversations),
q AS (SELECT conv_id, list_filter(list_transform(regexp_extract_all(text, '[a-zA-Z0-9][a-zA-Z0-9_./:-]{2,}'), lambda x: regexp_replace(lower(x), '[^0-9a-z]+', '', 'g')), lambda x: length(x) >= 2) AS l FROM conversations WHERE turn = 0),
u AS (SELECT conv_id, unnest(l) AS token, generate_subscripts(l, 1) AS o FROM q), d AS (SELECT conv_id, token, min(o) AS o FROM u GROUP BY ALL), f AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY o) <= 24),
h AS (SELECT conv_id, id, CAST(sum(least(length(token), 8)) AS BIGINT) AS score FROM f JOIN s USING (conv_id) WHERE contains(hay, token) GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, id) AS INT) AS rank FROM h QUALIFY rank <= 3)
SELECT conv_id AS job_id, id, score, rank FROM r UNION ALL SELECT conv_id, min(id), 0, 1 FROM s WHERE conv_id IN (SELECT conv_id FROM q) AND conv_id NOT IN (SELECT conv_id FROM r) GROUP BY 1""")
def token_evidence_top3(spark, sf):
    """FN14, FN15, JN08, TOP05."""
    t = conversation_turns(spark, sf)
    q = t.where("index = 0").select("job_id", F.lit(1).alias("query_id"), F.col("text").alias("query"))
    s = t.select("job_id", F.concat(F.lit("seg-"), F.col("index") + 1).alias("id"), "text")
    return review.evidence_top(q, s, "job_id").select("job_id", "id", "score", "rank")


TYPE_OF = "CASE event_type WHEN 'click' THEN 'speaker' WHEN 'view' THEN 'term' WHEN 'purchase' THEN 'unclear' WHEN 'signup' THEN 'conflict' END"
CARDS = f"""WITH r AS (SELECT user_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS chunk, event_id AS pos, {TYPE_OF} AS type, json_extract_string(props, '$.k') AS key, event_type || '-' || CAST(event_id % 7 AS VARCHAR) AS option FROM events),
o AS (SELECT user_id, type, key, option, min((chunk, pos)) AS seen FROM r WHERE type IS NOT NULL GROUP BY ALL),
c AS (SELECT user_id, type, key, string_agg(option, '|' ORDER BY seen) AS options FROM o GROUP BY ALL),
k AS (SELECT user_id, type, key, count(DISTINCT chunk) AS chunks FROM r WHERE type IS NOT NULL GROUP BY ALL) """


def cards(spark, sf):
    e = table(spark, sf, "events")
    kind = F.when(F.col("event_type") == "click", "speaker").when(F.col("event_type") == "view", "term").when(F.col("event_type") == "purchase", "unclear").when(F.col("event_type") == "signup", "conflict")
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000)
    r = e.select("user_id", day.alias("chunk"), F.col("event_id").alias("pos"), kind.alias("type"), F.get_json_object("props", "$.k").alias("key"), F.concat_ws("-", "event_type", (F.col("event_id") % 7).cast("string")).alias("option"))
    return review.merge_cards(r.withColumn("best_guess", F.col("option")), "user_id")


@query(CARDS + """SELECT user_id, type, key, options, chunks FROM c JOIN k USING (user_id, type, key)""")
def card_rollup(spark, sf):
    """AGG13, FLT07."""
    return cards(spark, sf).select("user_id", "type", "key", F.array_join("options", "|").alias("options"), F.size("chunks").cast("long").alias("chunks"))


@query(CARDS + """SELECT user_id, printf('q%02d', rank) AS id, type, key, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY list_position(['speaker', 'term', 'unclear', 'conflict', 'undecided'], type), -chunks, key) AS INT) AS rank FROM k) WHERE rank <= 8""")
def question_rank_topk(spark, sf):
    """TOP01, WIN06."""
    return review.rank_cards(cards(spark, sf), "user_id").select("user_id", "id", "type", "key", "rank")


@query("""SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts) = 1""")
def keyed_dedup_first(spark, sf):
    """GRP08-10."""
    return turns.keep_first(table(spark, sf, "events"), [F.col("user_id"), F.col("event_type")], [F.col("ts")]).select("user_id", "event_type", "event_id", "value")


@query("""SELECT user_id, event_type, count(*) AS mentions, arg_min(guess, (CASE WHEN value > 100 THEN 0 ELSE 1 END, event_id)) FILTER (guess <> '') AS guess FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'g' || event_id END AS guess FROM events) GROUP BY ALL""")
def precedence_best_guess(spark, sf):
    """AGG12."""
    e = table(spark, sf, "events").withColumn("guess", F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit("g"), F.col("event_id")))).withColumn("confidence", F.when(F.col("value") > 100, "high").otherwise("low"))
    return review.best_guess(e.withColumn("chunk", F.lit(0)).withColumn("pos", F.col("event_id")), ["user_id", "event_type"])


@query("""SELECT doc_id, coalesce(CASE WHEN quality = 0 THEN 'own' END, CASE WHEN toxic = 1 THEN 'picked' END, lang) AS value, coalesce(quality = 0, false) OR coalesce(toxic = 1, false) AS confirmed FROM documents LEFT JOIN labels USING (doc_id)""")
def answer_resolution(spark, sf):
    """JN06, JN05, SRC07."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    value, confirmed = review.resolve_answer(F.when(F.col("quality") == 0, "own"), F.when(F.col("toxic") == 1, "picked"), F.col("lang"))
    return d.select("doc_id", value.alias("value"), F.coalesce(confirmed, F.lit(False)).alias("confirmed"))


@query("""SELECT conv_id AS job_id, turn AS "index", md5(replace(replace(replace(text, 'tion', 'TION$1'), 'the', 'x\\y'), 'on', 'TI')) AS digest FROM conversations""")
def substitution_fold(spark, sf):
    """RW01."""
    pairs = F.array(*(F.struct(F.lit(a).alias("find"), F.lit(b).alias("put")) for a, b in (("on", "TI"), ("tion", "TION$1"), ("the", r"x\y"))))
    return conversation_turns(spark, sf).select("job_id", "index", F.md5(T.substitute(F.col("text"), pairs).cast("binary")).alias("digest"))


@query("""WITH t AS (SELECT conv_id, turn, sum(length(text)) OVER w AS total, count(*) OVER w AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS nth FROM conversations WINDOW w AS (PARTITION BY conv_id)),
p AS (SELECT *, CASE WHEN total > 3000 AND n >= 2 THEN greatest(2, ceil(total / 3000)) ELSE 1 END AS parts FROM t) SELECT conv_id AS job_id, turn AS "index", CAST(floor(nth / ceil(n / parts)) AS BIGINT) AS part FROM p""")
def topic_split_oversized(spark, sf):
    """GRP07, WIN08."""
    return turns.split_oversized(conversation_turns(spark, sf), ["job_id"], "index", F.length("text"), 3000).select("job_id", "index", "part")


# Chunks that share the language of their conversation have much alike; a walk over each job's chunks joins them.
@query(CHUNKS + f""", tp AS (SELECT job_id, chunk, arg_min(text, "index") AS label, list("index" ORDER BY "index") AS turns, max("index") AS st, CASE WHEN chunk % 2 = 0 THEN 'pending' ELSE 'decided' END AS status FROM c GROUP BY ALL), gm AS (SELECT *, {_grams("label")} AS g FROM tp),
r AS (SELECT job_id, chunk, 1 AS grp, label, g, status, st FROM gm WHERE chunk = 0 UNION ALL SELECT n.job_id, n.chunk, r.grp + 1 - s.same, CASE WHEN s.same = 1 AND length(n.label) <= length(r.label) THEN r.label ELSE n.label END, CASE WHEN s.same = 1 AND length(n.label) <= length(r.label) THEN r.g ELSE n.g END,
 CASE WHEN s.same = 1 AND n.status = 'pending' AND r.status <> 'pending' THEN r.status ELSE n.status END, CASE WHEN s.same = 1 AND n.status = 'pending' AND r.status <> 'pending' THEN r.st ELSE n.st END
 FROM r JOIN gm n ON n.job_id = r.job_id AND n.chunk = r.chunk + 1, LATERAL (SELECT CASE WHEN len(n.g) > 0 AND len(r.g) > 0 AND 2 * len(list_intersect(n.g, r.g)) >= len(n.g) + len(r.g) - len(list_intersect(n.g, r.g)) THEN 1 ELSE 0 END AS same) s)
SELECT r.job_id, printf('T%02d', grp) AS topic_id, arg_max(r.label, r.chunk) AS label, array_to_string(flatten(list(tp.turns ORDER BY r.chunk)), ',') AS turns, arg_max(r.status, r.chunk) AS status, arg_max(r.st, r.chunk) AS status_turn FROM r JOIN tp ON tp.job_id = r.job_id AND tp.chunk = r.chunk GROUP BY r.job_id, grp""")
def topic_cluster(spark, sf):
    """GRP06, SET01, JN11: each chunk of a job is a topic labelled by its first turn."""
    p = packed(spark, sf)
    t = p.groupBy("job_id", "chunk").agg(F.min_by("text", "index").alias("label"), F.array_sort(F.collect_list("index")).alias("turns"), F.max("index").alias("status_turn"))
    made = turns.cluster_topics(t.withColumn("status", F.when(F.col("chunk") % 2 == 0, "pending").otherwise("decided")))
    return made.select("job_id", "topic_id", "label", F.array_join(F.transform("turns", lambda x: x.cast("string")), ",").alias("turns"), "status", "status_turn")


@query("""SELECT lang AS job_id, count(*) AS total, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels)) AS dropped FROM documents GROUP BY 1""")
def dropped_histogram(spark, sf):
    """FLT03."""
    d = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("job_id"))
    return review.dropped(d, table(spark, sf, "labels"), ["doc_id"], "job_id")


def note_measures(spark, sf):
    """Notes are documents, the source is twice their length; marks of prose stand in for sections and topics."""
    d = table(spark, sf, "documents")
    t = F.coalesce("text", F.lit(""))
    return d.select("doc_id", (F.length(t) * 2 + 500).alias("source_chars"), F.length(t).alias("note_chars"), F.regexp_count(t, F.lit("[|]")).alias("quotes"), F.regexp_count(t, F.lit("[|] [a-z]")).alias("traceable"), F.least(F.regexp_count(t, F.lit(r"\.\n")), F.lit(6)).alias("present"), F.regexp_count(t, F.lit(r"\n")).alias("topics"), F.regexp_count(t, F.lit("!!")).alias("simplified"), F.regexp_count(t, F.lit("[*]{3}")).alias("stamps"))


def _scale(v: str, bar: str, full: str) -> str:
    return f"CASE WHEN {v} <= 0 THEN 0.0::DOUBLE WHEN {v} < {bar} THEN 0.7::DOUBLE * ({v} / {bar}) ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.7::DOUBLE + 0.3::DOUBLE * ({v} - {bar}) / ({full} - {bar}))) END"


_N = lambda p: f"CAST(len(regexp_extract_all(t, '{p}')) AS DOUBLE)"
MEASURES = f"""WITH m AS (SELECT doc_id, CAST(length(t) * 2 + 500 AS DOUBLE) AS src, CAST(length(t) AS DOUBLE) AS n, {_N('[|]')} AS quotes, {_N('[|] [a-z]')} AS tr, least({_N(chr(92) + '.' + chr(92) + 'n')}, 6) AS present, {_N(chr(92) + 'n')} AS topics, {_N('!!')} AS simp, {_N('[*]{3}')} AS stamps FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
s AS (SELECT *, {_scale('(n / src)', '0.3::DOUBLE', '0.7::DOUBLE')} AS coverage, CASE WHEN quotes > 0 THEN tr / quotes * (0.6::DOUBLE + 0.4::DOUBLE * ({_scale('(tr / src)', '(4 / 10000.0::DOUBLE)', '(20 / 10000.0::DOUBLE)')})) ELSE 0.0::DOUBLE END AS grounding, present / 6 AS structure,
 {_scale('(topics / src)', '(5 / 21000.0::DOUBLE)', '(18 / 21000.0::DOUBLE)')} AS depth, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - simp / 50 - stamps / 20)) AS cleanliness FROM m) """
TOTAL = "coverage * 0.30::DOUBLE + grounding * 0.25::DOUBLE + structure * 0.15::DOUBLE + depth * 0.20::DOUBLE + cleanliness * 0.10::DOUBLE"


@query(MEASURES + f"SELECT doc_id, round(coverage, 3) AS coverage, round(grounding, 3) AS grounding, round(structure, 3) AS structure, round(depth, 3) AS depth, round(cleanliness, 3) AS cleanliness, round({TOTAL}, 3) AS score FROM s")
def note_scores(spark, sf):
    """AGG05-07, FN28."""
    s = review.note_scores(note_measures(spark, sf))
    return s.select("doc_id", "coverage", "grounding", "structure", "depth", "cleanliness", "score")


@query(MEASURES + f""", r AS (SELECT doc_id, round({TOTAL}, 3) AS score FROM s), o AS (SELECT score AS own FROM r WHERE doc_id = 0)
SELECT own, count(*) FILTER (score >= own) + 1 AS rank, round(min(score) - own, 3) AS gap, count(*) FILTER (score < own) = 0 AS is_last FROM r, o WHERE doc_id <> 0 GROUP BY own""")
def score_separation(spark, sf):
    """AGG09, WIN07."""
    s = review.note_scores(note_measures(spark, sf)).select(F.col("doc_id").alias("job"), "score")
    return review.separation(s, 0).select("own", "rank", F.round("gap", 3).alias("gap"), "is_last")


@query(f"""SELECT doc_id, round({_scale('(n_chars / 10000.0::DOUBLE)', '0.3::DOUBLE', '0.7::DOUBLE')}, 6) AS scaled, n_chars < least(greatest(CAST(floor(n_chars * 1.5 * 0.15) AS BIGINT), 2000), 15000) AS thin FROM documents""")
def coverage_ratio_scale(spark, sf):
    """FN28, FN43, FLT14."""
    n = F.col("n_chars")
    return table(spark, sf, "documents").select("doc_id", F.round(T.scale_past_bar(n / 10000.0, 0.3, 0.7), 6).alias("scaled"), (n < T.thin_floor(n * 1.5)).alias("thin"))


@query("""SELECT a.lang AS job, a.source AS file, round(a.s, 3) AS after, round(b.s, 3) AS before, round(round(a.s, 3) - round(b.s, 3), 3) AS lift FROM (SELECT lang, source, sum(n_chars) / 1000 AS s FROM documents WHERE doc_id // 20 % 2 = 0 GROUP BY ALL) a JOIN (SELECT lang, source, sum(n_chars) / 1000 AS s FROM documents WHERE doc_id // 20 % 2 = 1 GROUP BY ALL) b USING (lang, source)""")
def backup_lift(spark, sf):
    """JN12, FLT15."""
    d = table(spark, sf, "documents").withColumn("file", F.concat("source", F.when(F.floor(F.col("doc_id") / 20) % 2 == 1, ".pre_evidence.md").otherwise("")))
    s = d.groupBy(F.col("lang").alias("job"), "file").agg(F.round(F.sum("n_chars") / 1000, 3).alias("score"))
    return review.lift(s, "job", "file", "score", ".pre_evidence.md").select("job", "file", "after", "before", F.round("lift", 3).alias("lift"))


LINES = """WITH l AS (SELECT doc_id, unnest(string_split(x, chr(10))) AS line, generate_subscripts(string_split(x, chr(10)), 1) - 1 AS no FROM (SELECT doc_id, coalesce(text, '') AS x FROM documents)) """


_PIECES = {0: ("見[00:01:02]。", "見。", 1, 0), 1: ("`[00:12:01]` 在此", " 在此", 1, 0), 2: ("```", "```", 0, 0), 3: ("[00:00:01] inside", "[00:00:01] inside", 0, 0), 4: ("```", "```", 0, 0), 5: ("補充（[00:41:02]）", "補充", 1, 0), 6: ("## 重點（3 句以內）", "## 重點", 0, 1), 7: ("[12:34]–[12:40]、[13:00] x", " x", 1, 0), 8: ("(最多5點) [v2] 12:34", "(最多5點) [v2] 12:34", 0, 0), 9: ("# a（Jim 提出）", "# a（Jim 提出）", 0, 0)}


def _piece(k: int) -> str:
    return "CASE no % 10 " + " ".join(f"WHEN {n} THEN " + (f"'{v[k]}'" if k < 2 else str(v[k])) for n, v in _PIECES.items()) + " END"


@query(LINES + f"""SELECT doc_id, no AS line_no, CASE WHEN no % 10 IN (2, 4, 6, 9) THEN {_piece(1)} ELSE rtrim(CASE WHEN {_piece(2)} > 0 THEN regexp_replace({_piece(1)} || ' ' || line, '[ \\t]{{2,}}', ' ', 'g') ELSE {_piece(1)} || ' ' || line END, CASE WHEN {_piece(2)} > 0 THEN ' ' ELSE '' END) END AS line, CAST({_piece(2)} AS INT) AS removed, CAST({_piece(3)} AS INT) AS limits FROM (SELECT doc_id, no, translate(line, '[]（）()。，、；：！？」』】`', '') AS line FROM l)""")
def line_scrub(spark, sf):
    """FN20, FN22, FN23, WIN04: lines of documents with stamps in several forms, in fences and out, and headings with limits."""
    l_ = lines.lines(table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    plain = F.translate("line", "[]（）()。，、；：！？」』】`", "")
    n = F.col("line_no") % 10
    first = F.get(F.array(*(F.lit(v[0]) for v in _PIECES.values())), n.cast("int"))
    marked = l_.withColumn("line", F.when(n.isin(2, 4, 6, 9), first).otherwise(F.concat(first, F.lit(" "), plain)))
    clean = lines.strip_heading_limits(lines.strip_stamps(marked, "doc_id"))
    return clean.select("doc_id", F.col("line_no").cast("long"), "line", F.col("removed").cast("int"), F.col("limits").cast("int"))


@query(LINES + """, q AS (SELECT *, contains(line, '|') AS q FROM l), f AS (SELECT *, CASE WHEN q IS DISTINCT FROM lag(q) OVER (PARTITION BY doc_id ORDER BY no) THEN 1 ELSE 0 END AS n FROM q),
r AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY no) AS run FROM f), b AS (SELECT *, bool_or(q AND contains(line, 'the')) OVER (PARTITION BY doc_id, run) AS bad FROM r)
SELECT doc_id, count(*) AS kept, CAST(sum(length(line)) AS BIGINT) AS chars FROM b WHERE NOT (q AND bad) GROUP BY 1""")
def blockquote_run_removal(spark, sf):
    """FN21: runs of table lines stand in for quotations."""
    l_ = lines.lines(table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    return lines.strip_runs(l_, "doc_id", ["the"], quote=lambda x: F.contains(x, F.lit("|"))).groupBy("doc_id").agg(F.count("*").alias("kept"), F.sum(F.length("line")).alias("chars"))


@query("""SELECT user_id, event_id, event_type, back FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS INT) AS back FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events) WHERE p IS NULL OR p <> event_type) WHERE back <= 40""")
def job_state_history(spark, sf):
    """STR01, STR02, TOP12."""
    return review.state_history(table(spark, sf, "events"), "user_id", "ts", "event_type").select("user_id", "event_id", "event_type", "back")


@query("""SELECT user_id, event_id, epoch_us(n) - epoch_us(ts) AS gap_us FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events) WHERE epoch_us(n) - epoch_us(ts) > 28800000000""")
def idle_gaps(spark, sf):
    """STR03."""
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return review.idle_gaps(e, "user_id", "ts", 28_800).select("user_id", "event_id", "gap_us")


@query("""SELECT user_id, count(*) AS cards, count(*) FILTER (value > 100) AS answered, greatest(0, count(*) - count(*) FILTER (value > 100)) AS open, arg_max(event_type, ts) AS state FROM events GROUP BY 1""")
def job_summary(spark, sf):
    """AGG14, STR02."""
    return table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("cards"), F.count_if(F.col("value") > 100).alias("answered"), F.greatest(F.lit(0), F.count("*") - F.count_if(F.col("value") > 100)).alias("open"), F.max_by("event_type", "ts").alias("state"))


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 WHEN 'P' THEN 2 ELSE 3 END AS attention FROM orders WHERE contains(lower(o_orderpriority), 'high')""")
def job_list_filter(spark, sf):
    """FLT09, TOP10: the attention rank of a list."""
    o = table(spark, sf, "orders").where(F.contains(F.lower("o_orderpriority"), F.lit("high")))
    s = F.col("o_orderstatus")
    return o.select("o_orderkey", F.when(s == "O", 0).when(s == "F", 1).when(s == "P", 2).otherwise(3).alias("attention"))


@query("""WITH f AS (SELECT doc_id, source || '.' || ['md', 'pdf', 'docx', 'tmp'][doc_id % 4 + 1] AS name, ['md', 'pdf', 'docx', 'tmp'][doc_id % 4 + 1] AS fmt, source FROM documents) SELECT doc_id, name, list_position(['md', 'pdf', 'docx'], fmt) - 1 AS fmt_rank, count(*) FILTER (fmt = 'md') OVER (PARTITION BY source) > 0 AS has_md FROM f WHERE fmt <> 'tmp'""")
def deliverable_allowlist(spark, sf):
    """FLT10, SET03."""
    kinds = F.array(*map(F.lit, ("md", "pdf", "docx")))
    d = table(spark, sf, "documents").withColumn("fmt", F.get(F.array(*map(F.lit, ("md", "pdf", "docx", "tmp"))), (F.col("doc_id") % 4).cast("int")))
    f = d.withColumn("name", F.concat_ws(".", "source", "fmt")).where(F.array_contains(kinds, F.col("fmt")))
    has = f.groupBy("source").agg((F.count_if(F.col("fmt") == "md") > 0).alias("has_md"))
    return f.join(has, "source").select("doc_id", "name", (F.array_position(kinds, F.col("fmt")) - 1).cast("int").alias("fmt_rank"), "has_md")


@query("""SELECT conv_id AS job_id, 'seg-' || (turn + 1) AS id, '講者' || (CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 3 END) AS label, turn * 35000 AS "startMs", turn * 35000 + 30250 AS "endMs" FROM conversations""")
def bundle_segments(spark, sf):
    """SNK14."""
    t = conversation_turns(spark, sf)
    number = F.when(F.col("speaker") == "system", 1).when(F.col("speaker") == "user", 2).otherwise(3)
    ms = lambda s: F.round(s * 1000).cast("long")
    place = F.row_number().over(Window.partitionBy("job_id").orderBy("index"))
    return t.select("job_id", F.concat(F.lit("seg-"), place).alias("id"), F.concat(F.lit("講者"), number).alias("label"), ms(F.col("index") * 35.0).alias("startMs"), ms(F.col("index") * 35.0 + 30.25).alias("endMs"))


@query(LINES + """SELECT doc_id, no AS line_no, line FROM l QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY no DESC) <= 3""")
def tail_lines(spark, sf):
    """SRC10."""
    t = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    d = table(spark, sf, "documents").select("doc_id", t.alias("t"))
    return d.select("doc_id", F.posexplode("t").alias("line_no", "line"), F.size("t").alias("n")).where("line_no >= n - 3").select("doc_id", F.col("line_no").cast("long"), "line")


@query("""SELECT user_id, arg_max(event_id, ts) AS latest, CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) AS bytes FROM events GROUP BY 1""")
def latest_job(spark, sf):
    """SRC15, AGG15."""
    return table(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_id", "ts").alias("latest"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("bytes"))


@query("""SELECT doc_id, coalesce(CASE WHEN l.quality = 1 THEN 'clean' END, CASE WHEN l.doc_id IS NOT NULL THEN 'draft' END, 'raw') AS used FROM documents d LEFT JOIN labels l USING (doc_id)""")
def best_source(spark, sf):
    """SRC06, SRC07."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels").withColumn("has", F.lit(True)), "doc_id", "left")
    return d.select("doc_id", F.coalesce(F.when(F.col("quality") == 1, "clean"), F.when(F.col("has"), "draft"), F.lit("raw")).alias("used"))


@query("""SELECT user_id, string_agg(v, '+' ORDER BY day) AS payload, count(*) AS parts FROM (SELECT user_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, arg_max(event_type, ts) AS v FROM events GROUP BY ALL) GROUP BY 1""")
def part_reassembly(spark, sf):
    """SRC09, STR05: the last arrival of each part, joined in order."""
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000)
    parts = table(spark, sf, "events").groupBy("user_id", day.alias("day")).agg(F.max_by("event_type", "ts").alias("v"))
    return parts.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("day", "v"))), lambda x: x["v"]), "+").alias("payload"), F.count("*").alias("parts"))


@query("""SELECT doc_id, CASE WHEN contains(lower(text), 'tion') OR contains(lower(text), 'heit') THEN 'high' WHEN contains(lower(text), 'que') THEN 'medium' ELSE 'low' END AS severity FROM documents""")
def severity_levels(spark, sf):
    """FN17."""
    return table(spark, sf, "documents").select("doc_id", T.keyword_level(F.col("text"), [("high", ["tion", "heit"]), ("medium", ["que"])], "low").alias("severity"))


@query("""SELECT doc_id, md5(replace(replace(replace(translate(text, 'é', 'e'), 'tion', chr(1)), 'on', 'tion'), chr(1), 'ON')) AS digest FROM documents""")
def script_map(spark, sf):
    """FN16: a character map, then phrases in one pass."""
    return table(spark, sf, "documents").select("doc_id", F.md5(T.map_script(F.col("text"), {"é": "e"}, {"tion": "ON", "on": "tion"}).cast("binary")).alias("digest"))


@query(r"""SELECT doc_id, array_to_string(list_transform(list_filter(list_zip(l, range(1, len(l) + 1)), lambda x: list_position(l, x[1]) = x[2]), lambda x: x[1]), '|') AS names FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[、,，/／\s]+'), lambda x: x <> '') AS l FROM documents)""")
def roster_names(spark, sf):
    """FN13."""
    return table(spark, sf, "documents").select("doc_id", F.array_join(T.roster(F.col("text")), "|").alias("names"))


@query("""SELECT conv_id AS job_id, CAST(count(DISTINCT role) AS BIGINT) AS speakers, array_to_string(list_sort(list(DISTINCT role)), ',') AS roles, CAST(sum(length(text)) AS BIGINT) AS source_chars, arg_max(turn, (length(text), -turn)) AS longest FROM conversations GROUP BY 1""")
def topic_rollup(spark, sf):
    """AGG11, TOP06."""
    return conversation_turns(spark, sf).groupBy("job_id").agg(F.countDistinct("speaker").alias("speakers"), F.array_join(F.array_sort(F.collect_set("speaker")), ",").alias("roles"), F.sum(F.length("text")).alias("source_chars"), F.max_by("index", F.struct(F.length("text").alias("n"), (-F.col("index")).alias("i"))).alias("longest"))


@query("""SELECT user_id, array_to_string(list_sort(list_filter(['click', 'signup', 'view', 'other'], lambda x: NOT list_contains(l, x))), ',') AS missing FROM (SELECT user_id, list(DISTINCT event_type) AS l FROM events GROUP BY 1)""")
def allowlist_difference(spark, sf):
    """SET03."""
    want = F.array(*map(F.lit, ("click", "signup", "view", "other")))
    return table(spark, sf, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.array_except(want, F.collect_set("event_type"))), ",").alias("missing"))


@query("""SELECT user_id, event_id FROM events WHERE event_type = 'error' OR (event_type = 'click' AND user_id % 2 = 0) OR (event_type = 'view' AND user_id % 3 = 0)""")
def event_subscription(spark, sf):
    """FLT12."""
    t, u = F.col("event_type"), F.col("user_id")
    return table(spark, sf, "events").where((t == "error") | ((t == "click") & (u % 2 == 0)) | ((t == "view") & (u % 3 == 0))).select("user_id", "event_id")


@query("""SELECT t.conv_id AS job_id, CAST(n.turn AS BIGINT) AS turn, min(t.o) AS topic FROM (SELECT conv_id, turn // 2 AS o, turn FROM conversations UNION ALL SELECT conv_id, turn // 3, turn FROM conversations) t JOIN conversations n ON n.conv_id = t.conv_id AND n.turn = t.turn GROUP BY ALL""")
def number_topic(spark, sf):
    """JN04: each turn's first topic in order."""
    t = conversation_turns(spark, sf)
    topics = t.select("job_id", F.floor(F.col("index") / 2).alias("o"), "index").unionByName(t.select("job_id", F.floor(F.col("index") / 3).alias("o"), "index"))
    return t.join(topics, ["job_id", "index"]).groupBy("job_id", F.col("index").alias("turn")).agg(F.min("o").alias("topic"))
