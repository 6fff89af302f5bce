"""Queries that check documents and report on files, models and bundles; adapters write the inputs with faults on purpose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions import text as T
from colloquy.operators import evidence, jobs, lines, review, schema
from colloquy.plans.catalog import conversation_turns, query, table
from colloquy.plans.merges import in_order
from colloquy.sources import files


def pick(n: Column, *values: str) -> Column:
    """The value at n modulo their number."""
    return F.get(F.array(*map(F.lit, values)), F.pmod(n, F.lit(len(values))).cast("int"))


def sql_pick(n: str, *values: str) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][({n}) % {len(values)} + 1]"


# Documents, one a kind of fault, and their problems.
_S = '"heading": "h", "discussion": [{"turn": 1, "point": "p"}], "status": "decided", "basis": "b", "quote_turns": [1, 2]'
SECTIONS = [
    ("{" + _S + "}", []),
    ("{" + _S.replace("decided", "later") + "}", [("$.status", "value", "later")]),
    ("{" + _S.replace("[1, 2]", '[1, true, "x", null, 2.5]') + "}", [("$.quote_turns[1]", "kind", "boolean"), ("$.quote_turns[2]", "kind", "string"), ("$.quote_turns[3]", "kind", "null"), ("$.quote_turns[4]", "kind", "number")]),
    ("{" + _S.replace(', "basis": "b"', "") + "}", [("$.basis", "missing", None)]),
    ("{" + _S + ', "extra": 1}', [("$.extra", "extra", None)]),
    ("{" + _S.replace('{"turn": 1, "point": "p"}', '{"turn": "1"}, 7') + "}", [("$.discussion[0].point", "missing", None), ("$.discussion[0].turn", "kind", "string"), ("$.discussion[1]", "kind", "integer")]),
    ("[1]", [("$", "kind", "array")]),
    ("{" + _S.replace('[{"turn": 1, "point": "p"}]', "{}") + "}", [("$.discussion", "kind", "object")]),
    ("{" + _S, [("$", "json", None)]),
]
EVIDENCES = [
    ('{"topics": [{"topic_id": "a", "label": "l", "turns": [1], "status": "pending", "status_turn": null, "speakers": []}], "points": [], "numbers": [], "actions": [], "unclear": []}', []),
    ('{"topics": [{"topic_id": "a", "label": "l", "turns": [], "status": "x", "status_turn": "1", "speakers": [2]}], "points": [], "numbers": [{}], "unclear": []}',
     [("$.topics[0].status", "value", "x"), ("$.topics[0].status_turn", "kind", "string"), ("$.topics[0].speakers[0]", "kind", "integer"), ("$.numbers[0].turn", "missing", None), ("$.numbers[0].literal", "missing", None), ("$.numbers[0].means", "missing", None), ("$.actions", "missing", None)]),
]
SCANS = [('{"replacements": [], "speakers": [{"label": "a", "guess": "b", "confidence": "sure", "why": ""}], "questions": [{"type": "odd", "key": "k", "question": "q", "options": ["o", 1], "best_guess": "", "evidence_turns": [1]}]}',
          [("$.speakers[0].confidence", "value", "sure"), ("$.questions[0].type", "value", "odd"), ("$.questions[0].options[1]", "kind", "integer")])]
OVERVIEWS = [('{"highlights": ["a", "b"]}', []), ('{"highlights": "a"}', [("$.highlights", "kind", "string")])]
ITEMS = [('{"meeting": {"any": 1}, "decisions": [], "actions": [{"item": "i", "responsible": "r", "deadline": null, "status": "s"}], "risks": [], "numbers": []}', [("$.actions[0].deadline", "kind", "null")])]
DOCUMENTS = [(s, d, p) for s, rows in (("SECTION", SECTIONS), ("EVIDENCE", EVIDENCES), ("SCAN", SCANS), ("OVERVIEW", OVERVIEWS), ("ACTION_ITEMS", ITEMS)) for d, p in rows]
_PROBLEMS = ", ".join(f"({n}, '{path}', '{kind}', {found if found is None else repr(found)})".replace("None", "NULL") for n, (_, _, ps) in enumerate(DOCUMENTS) for path, kind, found in ps)
PROBLEMS = f"""WITH p(n, path, problem, found) AS (VALUES {_PROBLEMS}), f AS (SELECT event_id, path, problem, found FROM events JOIN p ON event_id % {len(DOCUMENTS)} = n) """


def checked(spark: SparkSession, sf: str) -> DataFrame:
    """Events as documents, each checked against the schema of its kind."""
    n, kinds = F.col("event_id") % len(DOCUMENTS), list(dict.fromkeys(s for s, *_ in DOCUMENTS))
    e = table(spark, sf, "events").select("event_id", pick(F.col("event_id"), *(d for _, d, _ in DOCUMENTS)).alias("doc"), pick(n, *(s for s, *_ in DOCUMENTS)).alias("kind"))
    return e.select("event_id", F.coalesce(*(schema.problems(F.when(F.col("kind") == k, F.col("doc")), getattr(schema, k)) for k in kinds)).alias("problems"))


@query(PROBLEMS + "SELECT * FROM f")
def schema_problems(spark, sf):
    """VAL01, VAL04: every kind of problem in documents of five schemas."""
    return checked(spark, sf).select("event_id", F.inline("problems"))


@query(PROBLEMS + """, e AS (SELECT e.event_id, count(f.path) AS n, count(f.path) FILTER (problem <> 'value') AS errors FROM events e LEFT JOIN f USING (event_id) GROUP BY 1)
SELECT event_id, errors::INT AS errors, (n - errors)::INT AS warnings, least(n, 2)::INT AS shown, greatest(n - 2, 0)::INT AS others FROM e""")
def schema_report(spark, sf):
    """VAL03: counts by severity and the first findings; unknown values are warnings here."""
    rows = F.transform("problems", lambda p: F.struct(F.when(p["problem"] == "value", "warn").otherwise("error").alias("severity"), p["path"].alias("path")))
    r = checked(spark, sf).select("event_id", schema.report(rows, 2).alias("r"))
    return r.select("event_id", "r.errors", "r.warnings", F.size("r.first").alias("shown"), "r.others")


_LOOSE = ["{k}", "so: ```json\n{k}\n``` ok", "```json\n{k}\n```", '{"a": "}", "k": 5} and {"k": 6}', 'x {"s": "a\\"}{", "k": 7} }', '{"k": 8', "[1, 2]", '{"q": "never closed }', "no object"]
_VALUE = "CASE event_id % 9 WHEN 0 THEN k WHEN 1 THEN k WHEN 2 THEN k WHEN 3 THEN 5 WHEN 4 THEN 7 END"


@query(f"""SELECT event_id, {_VALUE} AS k FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""")
def loose_json(spark, sf):
    """SRC02: the object of replies that are fenced, wrapped in prose, doubled, cut or none."""
    e = table(spark, sf, "events")
    text = F.replace(pick(F.col("event_id"), *_LOOSE), F.lit("{k}"), F.col("props"))
    return e.select("event_id", F.try_variant_get(files.loads_loose(text), "$.k", "bigint").alias("k"))


SHORT = r"""WITH s AS (SELECT item_id, trim(regexp_replace(text, '[\s\x{3000}]+', ' ', 'g')) AS x FROM benchmark), q AS (SELECT item_id * 4 AS quote_id, string_split(x, ' ')[1] AS q FROM s UNION ALL SELECT item_id * 4 + 1, string_split(x, ' ')[2] || ' ' || string_split(x, ' ')[3] FROM s UNION ALL SELECT item_id * 4 + 2, '第' || item_id % 5 || '號決議' FROM s UNION ALL SELECT item_id * 4 + 3, x FROM s),
t AS (SELECT doc_id, trim(regexp_replace(coalesce(text, '') || CASE WHEN doc_id % 3 = 0 THEN '会前第' || doc_id % 7 || '號決議。' ELSE '' END, '[\s\x{3000}]+', ' ', 'g')) AS t FROM documents) """


@query(SHORT + "SELECT quote_id, doc_id FROM q JOIN t ON contains(t, q)")
def short_quotes(spark, sf):
    """JN09: quotations of one word, two words, no spaces and whole passages, in all documents."""
    s = table(spark, sf, "benchmark").select("item_id", F.split(T.squash(F.col("text")), " ").alias("w"), "text")
    i, w = F.col("item_id"), lambda n: F.get("w", F.lit(n))
    quotes = F.array(w(0), F.concat_ws(" ", w(1), w(2)), F.concat(F.lit("第"), i % 5, F.lit("號決議")), F.col("text"))
    q = s.select(i, F.posexplode(quotes).alias("k", "quote")).select((i * 4 + F.col("k")).alias("quote_id"), "quote")
    d = table(spark, sf, "documents")
    mark = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("会前第"), F.col("doc_id") % 7, F.lit("號決議。"))).otherwise("")
    found = lines.traced(q, d.select(F.col("doc_id").alias("text_id"), F.concat(F.coalesce("text", F.lit("")), mark).alias("text")))
    return found.select("quote_id", F.col("text_id").alias("doc_id"))


NOTES = r"""WITH t AS (SELECT conv_id AS job_id, turn, role, trim(regexp_replace(coalesce(text, ''), '[\s\x{3000}]+', ' ', 'g')) AS x FROM conversations), h AS (SELECT job_id, trim(regexp_replace(string_agg(x, ' ' ORDER BY turn), '[\s\x{3000}]+', ' ', 'g')) AS hay FROM t GROUP BY 1),
q AS (SELECT *, CASE turn % 4 WHEN 0 THEN x WHEN 1 THEN reverse(x) || '。' WHEN 2 THEN string_split(x, ' ')[1] ELSE '我们決定了' END AS q FROM t),
l AS (SELECT job_id, turn * 2 AS o, '### ' || turn || '. 第 ' || turn || ' 題' AS line, NULL AS q FROM q UNION ALL SELECT job_id, turn * 2 + 1, '> ' || CASE WHEN turn % 2 = 0 THEN '[00:00:0' || turn % 10 || '] ' ELSE '' END || role || '：「' || q || '」', CASE WHEN trim(q) <> '' THEN trim(q) END FROM q) """


def quoted_notes(spark: SparkSession, sf: str) -> DataFrame:
    """A note a job: a heading and a quotation a turn, whole, reversed, of one word or in another script; and what was said."""
    t = conversation_turns(spark, sf).withColumn("x", T.squash(F.col("text")))
    i, x = F.col("index"), F.col("x")
    quote = F.when(i % 4 == 0, x).when(i % 4 == 1, F.concat(F.reverse(x), F.lit("。"))).when(i % 4 == 2, F.get(F.split(x, " "), F.lit(0))).otherwise("我们決定了")
    stamp = F.when(i % 2 == 0, F.concat(F.lit("[00:00:0"), i % 10, F.lit("] "))).otherwise("")
    rows = F.concat(F.lit("### "), i, F.lit(". 第 "), i, F.lit(" 題\n> "), stamp, "speaker", F.lit("：「"), quote, F.lit("」"))
    return t.groupBy("job_id").agg(F.array_join(in_order(rows, i), "\n").alias("text"), T.squash(F.array_join(in_order(x, i), " ")).alias("hay"))


@query(NOTES + """, k AS (SELECT l.*, q IS NOT NULL AND hay <> '' AND NOT contains(hay, q) AS bad FROM l JOIN h USING (job_id)), n AS (SELECT job_id, string_agg(line, chr(10) ORDER BY o) FILTER (NOT bad) AS body, count(*) FILTER (bad) AS gone FROM k GROUP BY 1)
SELECT job_id, gone AS quotes_removed, contains(body, '们') AS converted, md5(replace(body, '们', '們')) AS digest FROM n""")
def note_autofix(spark, sf):
    """RW06, JN09, FN27: quotations that nobody said go, the script is converted."""
    n = review.autofix(quoted_notes(spark, sf), "job_id", {"们": "們"})
    return n.select("job_id", "quotes_removed", "converted", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(NOTES + "SELECT job_id, o + 1 AS line_no, q AS quote FROM l WHERE q IS NOT NULL")
def quotation_lines(spark, sf):
    """FN27: numbered lines that quote."""
    return lines.quote_lines(quoted_notes(spark, sf), "job_id").withColumn("line_no", F.col("line_no").cast("long"))


_FILES = ("note_general.md", "note_general.pdf", "notes.md", "transcript.md", "transcript_clean.md", "transcript_draft.md", "source.wav", "source.md.txt", "meta.json", "action_items.json", "INDEX.md", "a.md.txt", "evidence.json", "delivery.json", "note_x.docx", "note_x.txt", "state.json")


@query(f"""WITH f AS (SELECT conv_id AS job_id, {sql_pick("turn * 5", *_FILES)} AS name, length(coalesce(text, '')) AS bytes FROM conversations),
g AS (SELECT *, (starts_with(name, 'note_') AND (ends_with(name, '.md') OR ends_with(name, '.pdf') OR ends_with(name, '.docx')) OR name IN ('transcript_clean.md', 'transcript_draft.md', 'action_items.json', 'INDEX.md', 'delivery.json') OR ends_with(name, '.md.txt')) AND NOT starts_with(name, 'source.') AS gone FROM f)
SELECT job_id, coalesce(string_agg(DISTINCT name, ',' ORDER BY name) FILTER (gone), '') AS names, count(*) FILTER (gone) AS count, CAST(coalesce(sum(bytes) FILTER (gone), 0) AS BIGINT) AS freed, CAST(sum(bytes) AS BIGINT) AS total FROM g GROUP BY 1""")
def cleanup_plan(spark, sf):
    """FLT11, SET04, AGG15."""
    f = conversation_turns(spark, sf).select("job_id", pick(F.col("index") * 5, *_FILES).alias("name"), F.length("text").alias("bytes"))
    return jobs.cleanup(f, "job_id").withColumn("names", F.array_join("names", ","))


@query("""WITH s(s, stem) AS (VALUES (0, 'note_general'), (1, 'transcript_clean'), (2, 'note_self')), f(f, fmt) AS (VALUES (0, 'md'), (1, 'pdf'), (2, 'docx')), j AS (SELECT DISTINCT conv_id AS job_id FROM conversations),
e AS (SELECT job_id, s, f, stem, fmt, (job_id + s) % 3 <> 0 OR job_id % 5 = 0 AS has, (job_id + s + f) % 4 <> 0 OR job_id % 5 = 0 AS fine FROM j, s, f)
SELECT job_id, coalesce(string_agg(stem || '.' || fmt, ',' ORDER BY s, f) FILTER (has AND (f = 0 OR fine)), '') AS delivery, coalesce(string_agg(stem || '.md', ',' ORDER BY s) FILTER (NOT has AND f = 0), '') AS missing,
 coalesce(string_agg(stem || '.' || fmt || ': no room', ',' ORDER BY s, f) FILTER (has AND f > 0 AND NOT fine), '') AS failed, bool_and(has AND (f = 0 OR fine)) AS ok FROM e GROUP BY 1""")
def finish_report(spark, sf):
    """AGG17, SET07: what each job delivers, lacks and fails at."""
    names = [(0, "note_general"), (1, "transcript_clean"), (2, "note_self")]
    j = conversation_turns(spark, sf).select("job_id").distinct()
    grid = F.array(*(F.struct(F.lit(s).alias("s"), F.lit(n).alias("stem"), F.lit(f).alias("f"), F.lit(t).alias("fmt")) for s, n in names for f, t in enumerate(("md", "pdf", "docx"))))
    plan = j.select("job_id", F.inline(grid))
    even = F.col("job_id") % 5 == 0
    there = plan.where(((F.col("job_id") + F.col("s")) % 3 != 0) | even).select("job_id", F.concat("stem", F.lit(".md")).alias("name")).distinct()
    made = plan.where("f > 0").select("job_id", "stem", "fmt", (((F.col("job_id") + F.col("s") + F.col("f")) % 4 != 0) | even).alias("ok"), F.lit("no room").alias("info"))
    r = jobs.finish(plan, there, made, "job_id")
    return r.select("job_id", *(F.array_join(c, ",").alias(c) for c in ("delivery", "missing", "failed")), "ok")


MODELS = """WITH m AS (SELECT p_partkey % 10 AS machine, p_partkey AS i, CASE WHEN p_size % 5 = 0 THEN 'embedding' ELSE 'llm' END AS type, 'm' || p_partkey AS key, CASE WHEN p_size % 7 = 0 THEN 'm' || p_partkey ELSE p_name END AS display_name, CASE WHEN p_size % 2 = 0 THEN 'gguf' ELSE 'mlx' END AS format, p_size * 1000 AS context, p_size % 3 = 0 AS tools,
  CASE WHEN p_size % 4 = 0 THEN ['m' || p_partkey || ':1', 'm' || p_partkey] WHEN p_size % 4 = 1 THEN ['m' || p_partkey] ELSE [] END AS instances FROM part WHERE p_size % 5 <> 0),
a AS (SELECT user_id, user_id % 10 AS machine FROM (SELECT user_id, arg_max(event_type, ts) AS s FROM events GROUP BY 1) WHERE user_id % 2 = 0 AND s IN ('purchase', 'signup')) """


def model_lists(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    size, key = F.col("p_size"), F.concat(F.lit("m"), F.col("p_partkey"))
    one, none = lambda i: F.struct(i.alias("id")), F.array().cast("array<struct<id:string>>")
    made = F.struct(
        F.when(size % 5 == 0, "embedding").when(size % 5 == 1, "llm").alias("type"), F.concat(F.lit(" "), key).alias("key"), F.when(size % 7 == 0, "").otherwise(F.col("p_name")).alias("display_name"), F.when(size % 2 == 0, "gguf").otherwise("mlx").alias("format"), (size * 1000).alias("max_context_length"),
        F.struct((size % 3 == 0).alias("trained_for_tool_use")).alias("capabilities"), F.when(size % 4 == 0, F.array(one(F.concat(key, F.lit(":1"))), one(F.lit("")), one(key))).when(size % 4 == 1, F.array(one(F.lit(None).cast("string")))).otherwise(none).alias("loaded_instances"),
    )
    lists = p.groupBy((F.col("p_partkey") % 10).alias("machine")).agg(in_order(made, F.col("p_partkey")).alias("models"))
    return jobs.models(lists.select("machine", F.to_json(F.struct("models")).alias("payload")), "machine")


@query(MODELS + "SELECT machine, key, display_name, format, context::BIGINT AS context, tools, array_to_string(instances, ',') AS instances FROM m")
def model_list(spark, sf):
    """SRC17, SET08: models of each machine's list, parsed and defaulted."""
    return model_lists(spark, sf).select("machine", "key", "display_name", "format", "context", "tools", F.array_join("instances", ",").alias("instances"))


@query(MODELS + """SELECT machine, key, CAST(row_number() OVER (PARTITION BY machine ORDER BY format = 'gguf', len(instances) = 0, context DESC, i) AS INT) AS rank FROM m WHERE tools AND context >= 10000 AND i <> machine QUALIFY rank <= 3""")
def model_alternatives(spark, sf):
    """FLT13, TOP08: up to three models that would do instead."""
    return jobs.alternatives(model_lists(spark, sf), "machine", True, 10_000, F.concat(F.lit("m"), F.col("machine"))).select("machine", "key", "rank")


def working(spark: SparkSession, sf: str) -> DataFrame:
    last = table(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_type", "ts").alias("s"))
    states = last.select("user_id", F.when(F.col("s") == "purchase", "scanning").when(F.col("s") == "signup", "writing").otherwise("done").alias("state"))
    meta = last.select("user_id", F.when(F.col("user_id") % 2 == 0, "private").otherwise("general").alias("preset"))
    return jobs.active_jobs(meta, states, "user_id").withColumn("machine", F.col("user_id") % 10)


@query(MODELS + "SELECT user_id, machine FROM a")
def active_private_jobs(spark, sf):
    """FLT16."""
    return working(spark, sf).select("user_id", "machine")


@query(MODELS + """, s AS (SELECT machine, list(i ORDER BY i)[1] AS i, 'm' || list(i ORDER BY i)[1] AS model FROM m WHERE len(instances) > 0 GROUP BY 1), l AS (SELECT machine, unnest(instances) AS id, m.i, key FROM m),
g AS (SELECT machine, count(*) AS available FROM m GROUP BY 1), n AS (SELECT machine, count(DISTINCT id) AS loaded FROM l GROUP BY 1), j AS (SELECT machine, count(*) AS active FROM a GROUP BY 1)
SELECT g.machine, available, n.loaded::INT AS loaded, 1::INT AS selected, (n.loaded - 1)::INT AS foreign, coalesce(active, 0) AS active, coalesce(active, 0) = 0 AS can_unload FROM g JOIN n USING (machine) JOIN s USING (machine) LEFT JOIN j USING (machine)""")
def model_status(spark, sf):
    """AGG21, SET06: each machine's first loaded model is the one selected."""
    listed = model_lists(spark, sf)
    selected = listed.where(F.size("instances") > 0).groupBy("machine").agg(F.min_by("key", "pos").alias("model"))
    s = jobs.model_status(listed, selected, working(spark, sf), "machine")
    return s.select("machine", "available", *(F.size(c).alias(c) for c in ("loaded", "selected", "foreign")), "active", "can_unload")


@query(r"""WITH b AS (SELECT conv_id AS job_id, turn, role, '## ' || role || ' — ' || turn || chr(10) || trim(regexp_replace(coalesce(text, ''), '[\s\x{3000}]+', ' ', 'g')) || CASE WHEN turn % 2 = 1 THEN chr(10) || '  ```' || chr(10) || '## inside' || chr(10) || '```' ELSE '' END AS b FROM conversations),
w AS (SELECT job_id, 'intro' || chr(10) || string_agg(b, chr(10) ORDER BY turn) || CASE WHEN job_id % 5 = 0 THEN '' ELSE chr(10) || '## ban list' || chr(10) || 'none  ' END AS whole, string_agg(regexp_replace(b, '\s+$', ''), chr(10) ORDER BY turn) FILTER (role = 'user') AS own FROM b GROUP BY 1)
SELECT job_id, md5(CASE WHEN job_id % 5 = 0 THEN whole ELSE coalesce(own || chr(10), '') || '## ban list' || chr(10) || 'none' END) AS digest FROM w""")
def spec_fragments(spark, sf):
    """SRC12, WIN04: sections by prefix, headings in fences apart; without any the whole text."""
    t, i = conversation_turns(spark, sf), F.col("index")
    rows = F.concat(F.lit("## "), "speaker", F.lit(" — "), i, F.lit("\n"), T.squash(F.col("text")), F.when(i % 2 == 1, "\n  ```\n## inside\n```").otherwise(""))
    ban = F.when(F.col("job_id") % 5 == 0, "").otherwise("\n## ban list\nnone  ")
    d = t.groupBy("job_id").agg(F.array_join(in_order(rows, i), "\n").alias("body")).select("job_id", F.concat(F.lit("intro\n"), "body", ban).alias("text"))
    wanted = F.when(F.col("job_id") % 5 == 0, "tool —").otherwise("user —")
    return jobs.fragment(d, "job_id", [wanted, F.lit("ban list")]).select("job_id", F.md5(F.col("fragment").cast("binary")).alias("digest"))


@query("""WITH l AS (SELECT doc_id, string_split(rtrim_one, chr(10)) AS l, greatest(1, doc_id % 7 - 2) AS f, greatest(1, doc_id % 5 * 2 - 1) AS n FROM (SELECT doc_id, CASE WHEN ends_with(t, chr(10)) THEN left(t, length(t) - 1) ELSE t END AS rtrim_one FROM (SELECT doc_id, replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM documents)) WHERE rtrim_one <> ''),
b AS (SELECT *, array_to_string(l[f:f + n - 1], chr(10)) AS body, greatest(0, least(len(l), f + n - 1) - f + 1) AS got FROM l)
SELECT doc_id, md5(left(body, 2000)) AS digest, CAST(f - 1 + got AS BIGINT) AS last, CAST(len(l) AS BIGINT) AS total, length(body) > 2000 AS truncated, CAST(greatest(len(l) - (f - 1 + got), 0) AS BIGINT) AS remaining FROM b""")
def windowed_read(spark, sf):
    """SRC11: windows of lines with their limits, cut at 2,000 characters here."""
    d = table(spark, sf, "documents").where(~F.coalesce("text", F.lit("")).isin("", "\n"))
    n = F.col("doc_id")
    r = d.select("doc_id", jobs.read_window(F.col("text"), (n % 7 - 2).cast("int"), (n % 5 * 2 - 1).cast("int"), chars=2000).alias("r"))
    return r.select("doc_id", F.md5(F.col("r.body").cast("binary")).alias("digest"), *(F.col(f"r.{c}").cast("long").alias(c) for c in ("last", "total")), "r.truncated", F.col("r.remaining").cast("long").alias("remaining"))


@query("""WITH c AS (SELECT event_id, 0 AS pos, 'c1' AS id, 'read' AS name, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, NULL AS error FROM events UNION ALL SELECT event_id, 1, 'call_1', 'write', event_id % 3, NULL FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, 2, 'call_2', '', NULL, '{bad' FROM events WHERE event_id % 4 = 0) SELECT * FROM c""")
def tool_calls(spark, sf):
    """FN41: calls whose arguments are text, an object or broken."""
    n = F.col("event_id")
    second = F.when(n % 2 == 0, F.concat(F.lit(', {"function": {"name": "write", "arguments": {"k": '), n % 3, F.lit("}}}"))).otherwise("")
    third = F.when(n % 4 == 0, ', {"id": "", "function": {"arguments": "{bad"}}').otherwise("")
    first = F.concat(F.lit('{"tool_calls": [{"id": "c1", "function": {"name": "read", "arguments": "'), F.replace(F.col("props"), F.lit('"'), F.lit('\\"')), F.lit('"}}'))
    e = table(spark, sf, "events").select("event_id", F.posexplode(jobs.tool_calls(F.concat(first, second, third, F.lit("]}")))).alias("pos", "c"))
    return e.select("event_id", "pos", "c.id", "c.name", F.try_variant_get("c.args", "$.k", "bigint").alias("k"), "c.error")


_BODIES = ('{"error": {"message": " a "}}', '{"error": " b"}', '{"message": "c"}', "plain ", '{"error": {"code": 1}}')


@query(f"""SELECT event_id, CASE event_id % 6 WHEN 0 THEN '推論服務回應 HTTP 500（model=m）：' || d WHEN 1 THEN '無法連線到推論服務 ?：' || d WHEN 2 THEN '推論服務回傳的內容不是合法 JSON（model=?）：' || d WHEN 3 THEN '推論服務回傳空白內容（model=m）：' || d WHEN 4 THEN '' ELSE d END AS line
 FROM (SELECT event_id, {sql_pick("event_id", "a", "b", "c", "plain", _BODIES[4])} AS d FROM events)""")
def api_errors(spark, sf):
    """FN42: errors in one line, from replies of several shapes."""
    n = F.col("event_id")
    kind = F.when(n % 6 == 4, None).otherwise(pick(n, "http_error", "unreachable", "not_json", "empty", "", "other"))
    detail = jobs.error_message(pick(n, *_BODIES))
    return table(spark, sf, "events").select("event_id", jobs.describe_error(kind, F.when(n % 6 != 2, "m"), F.lit(500), F.lit(None).cast("string"), detail).alias("line"))


@query("""SELECT doc_id, len(regexp_extract_all(text, '[éü]'))::INT AS n FROM documents WHERE text IS NOT NULL""")
def script_differences(spark, sf):
    """AGG08: places at which a converted text differs; accents stand in for another script."""
    d = table(spark, sf, "documents").where("text is not null")
    return d.select("doc_id", jobs.differing(F.col("text"), T.map_script(F.col("text"), {"é": "e", "ü": "u"}, {})).alias("n"))


@query("""SELECT conv_id AS job_id, count(*) FILTER (turn % 3 = 0) AS decided, count(*) FILTER (turn % 4 = 0) AS pending, count(*) FILTER (turn % 5 = 0) AS stamps, count(*) FILTER (turn % 2 = 0) AS topics FROM conversations GROUP BY 1""")
def note_literals(spark, sf):
    """AGG20, SNK06: counts of the marks of a note."""
    t, i = conversation_turns(spark, sf), F.col("index")
    mark = lambda n, what: F.when(i % n == 0, what).otherwise("")
    row = F.concat(F.when(i % 2 == 0, F.concat(F.lit("### "), i, F.lit(". "))).otherwise("#### "), F.lit("題 "), mark(3, "已決議"), mark(4, "（待定）"), mark(5, " [00:01:02]"))
    n = t.groupBy("job_id").agg(F.array_join(in_order(row, i), "\n").alias("text"))
    return n.select("job_id", *(c.cast("long").alias(k) for k, c in review.literals(F.col("text")).items()))


@query("""WITH RECURSIVE f AS (SELECT conv_id AS job_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p, role || CASE WHEN turn % 4 = 3 THEN '_2' ELSE '' END AS s FROM conversations),
r AS (SELECT job_id, turn, p, s || '.md' AS n, [s || '.md'] AS seen FROM f WHERE p = 1 UNION ALL
 SELECT f.job_id, f.turn, f.p, c.n, list_append(r.seen, c.n) FROM r JOIN f ON f.job_id = r.job_id AND f.p = r.p + 1, LATERAL (SELECT CASE WHEN list_contains(r.seen, f.s || '.md') THEN list_filter(list_transform(range(2, len(r.seen) + 3), lambda k: f.s || '_' || k || '.md'), lambda x: NOT list_contains(r.seen, x))[1] ELSE f.s || '.md' END AS n) c)
SELECT job_id, turn AS "index", n AS export_name FROM r""")
def export_names(spark, sf):
    """GRP14: names of a job's files made unlike, where one of them may look like a numbered one."""
    t = conversation_turns(spark, sf).select("job_id", "index", F.concat("speaker", F.when(F.col("index") % 4 == 3, "_2").otherwise(""), F.lit(".md")).alias("name"))
    return jobs.export_names(t, "job_id", "index", "name")


@query("""WITH s AS (SELECT conv_id AS job_id, turn AS i, CASE role WHEN 'system' THEN 2 WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 END AS n, turn % 5 = 4 AS lost FROM conversations), f AS (SELECT job_id, n, min(i) AS i FROM s WHERE NOT lost AND n IS NOT NULL GROUP BY ALL UNION ALL SELECT job_id, NULL, i FROM s WHERE lost OR n IS NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY i) AS ordinal FROM f)
SELECT job_id, ordinal::INT AS ordinal, CASE WHEN n IS NULL THEN 'spk-unknown-' || ordinal ELSE 'spk-' || (n + 1) END AS id, CASE WHEN n IS NULL THEN '未知講者' ELSE '講者' || (n + 1) END AS label, CASE WHEN n = 0 THEN '王總' WHEN n = 1 THEN 'ann' END AS name, CASE WHEN n = 0 THEN '客戶' WHEN n = 1 THEN 'high' END AS hint FROM o""")
def speaker_registry(spark, sf):
    """GRP13, JN07, FN18: speakers in order of their first word, with guessed names and roles."""
    segments, guesses = spoken(spark, sf)
    return jobs.speakers(segments, guesses, "job_id").select("job_id", "ordinal", "id", "label", F.col("displayName").alias("name"), F.col("roleHint").alias("hint"))


def spoken(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    t = conversation_turns(spark, sf)
    who = F.when(F.col("speaker") == "system", 2).when(F.col("speaker") == "user", 0).when(F.col("speaker") == "assistant", 1)
    start = F.col("index") * 35.0
    segments = t.select("job_id", F.col("index").alias("i"), F.when(F.col("index") % 5 != 4, who).alias("speaker"), start.alias("start"), (start + 30.25).alias("end"), F.col("text"))
    guess = F.inline(F.array(F.struct(F.lit("講者1").alias("label"), F.lit("王總（客戶）").alias("guess"), F.lit("low").alias("confidence")), F.struct(F.lit(" 講者2 ").alias("label"), F.lit("ann").alias("guess"), F.lit("high").alias("confidence")), F.struct(F.lit("講者3").alias("label"), F.lit("").alias("guess"), F.lit("high").alias("confidence"))))
    return segments, t.select("job_id").distinct().select("job_id", guess)


@query("""SELECT o_orderkey, left(trim(o_orderpriority), 60) AS label, coalesce(nullif(CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'do it' END, ''), CASE WHEN o_orderkey % 2 = 0 THEN '需要 ' || o_orderkey END, CASE WHEN o_orderkey % 5 = 0 THEN 'critical bob' END, trim(o_orderpriority)) AS detail,
 CASE WHEN o_orderkey % 3 <> 0 THEN 'low' WHEN o_orderkey % 2 = 0 THEN 'medium' WHEN o_orderkey % 5 = 0 THEN 'high' ELSE 'low' END AS severity FROM orders""")
def risk_rows(spark, sf):
    """SNK18, FN17: risks with the detail that is there and a severity read from the words."""
    o, n = table(spark, sf, "orders"), F.col("o_orderkey")
    r = o.select("o_orderkey", F.lit(0).alias("pos"), F.col("o_orderpriority").alias("label"), F.when(n % 3 == 0, " ").otherwise("do it").alias("mitigation"), F.when(n % 2 == 0, F.concat(F.lit("需要 "), n)).alias("detail"), F.when(n % 5 == 0, "critical bob").otherwise("").alias("raised_by"))
    return jobs.risks(r, "o_orderkey").drop("pos")


@query("""WITH s AS (SELECT conv_id AS job_id, turn AS i, CASE WHEN turn % 5 <> 4 THEN CASE role WHEN 'system' THEN 2 WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 END END AS n, coalesce(text, '') AS text FROM conversations),
f AS (SELECT job_id, n, min(i) AS i FROM s WHERE n IS NOT NULL GROUP BY ALL UNION ALL SELECT job_id, NULL, i FROM s WHERE n IS NULL)
SELECT s.job_id, 'Job ' || s.job_id AS title, CASE WHEN s.job_id % 2 = 0 THEN 'acme' END AS client, CASE s.job_id % 3 WHEN 0 THEN 'zh' WHEN 1 THEN 'en' ELSE 'unknown' END AS language, CASE WHEN s.job_id % 4 = 0 THEN 'private' ELSE 'standard' END AS sensitivity, (SELECT count(*) FROM f WHERE f.job_id = s.job_id) AS speakers, count(*) AS segments,
 md5(string_agg('seg-' || (i + 1) || coalesce('spk-' || (n + 1), 'spk-unknown') || i * 35000 || '-' || (i * 35000 + 30250) || text, ',' ORDER BY i)) AS digest, CASE WHEN s.job_id % 2 = 0 THEN 'late' END AS risk, 1::BIGINT AS decisions FROM s GROUP BY s.job_id""")
def bundle_documents(spark, sf):
    """SNK09, SNK14: the nested document of each job, read back."""
    segments, guesses = spoken(spark, sf)
    n = F.col("job_id")
    decision = F.array(F.struct(F.lit("d").alias("summary"), F.lit(0.5).alias("confidence"), F.lit("proposed").alias("status")))
    j = segments.select("job_id").distinct().select(
        "job_id", F.concat(F.lit(" Job "), n).alias("title"), F.when(n % 2 == 0, "acme").otherwise(" ").alias("client"), pick(n, "private", "x", "", "x").alias("preset"), pick(n, "ZH", "en ", "fr").alias("language"), F.lit(0).alias("minutes"), F.lit(2).alias("expected"),
        F.lit("raw").alias("raw"), F.lit("").alias("cleaned"), F.lit("s").alias("summary"), decision.alias("decisions"), F.array().cast("array<struct<action:string>>").alias("actions"), F.array().cast("array<struct<title:string>>").alias("topics"),
    )
    r = j.where(n % 2 == 0).select("job_id", F.lit(0).alias("pos"), F.lit("late").alias("label"), *(F.lit("").alias(c) for c in ("mitigation", "detail", "raised_by")))
    shape = "bundle struct<bundleId:string>, meeting struct<title:string,client:string,language:string,sensitivity:string,speakersDetected:long,durationMinutes:int>, speakers array<struct<id:string>>, transcript struct<rawText:string,cleanedText:string,segments:array<struct<id:string,speakerId:string,startMs:long,endMs:long,text:string>>>, extracted struct<decisions:array<struct<summary:string>>,risks:array<struct<label:string>>>"
    b = jobs.bundle(j, segments, guesses, r, "job_id").select("job_id", F.from_json("document", shape).alias("b")).where(F.col("b.meeting.durationMinutes").isNull() & (F.col("b.transcript.cleanedText") == "raw") & (F.col("b.bundle.bundleId") == n.cast("string")))
    said = F.transform("b.transcript.segments", lambda s: F.concat(s["id"], s["speakerId"], s["startMs"].cast("string"), F.lit("-"), s["endMs"].cast("string"), s["text"]))
    return b.select("job_id", "b.meeting.title", "b.meeting.client", "b.meeting.language", "b.meeting.sensitivity", F.col("b.meeting.speakersDetected").alias("speakers"), F.size(said).cast("long").alias("segments"), F.md5(F.array_join(said, ",").cast("binary")).alias("digest"), F.get("b.extracted.risks", F.lit(0))["label"].alias("risk"), F.size("b.extracted.decisions").cast("long").alias("decisions"))


ANSWERS = """WITH c AS (SELECT user_id AS job_id, event_id, 'q' || event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rank, CASE event_type WHEN 'click' THEN 'speaker' WHEN 'view' THEN 'term' ELSE 'unclear' END AS type, event_type || event_id AS key, CASE WHEN event_id % 4 = 0 THEN '' ELSE 'g' || event_id END AS guess, CASE event_id % 3 WHEN 0 THEN 'own' || event_id WHEN 1 THEN 'pick' || event_id END AS told FROM events),
v AS (SELECT *, coalesce(told, guess) AS value, told IS NOT NULL AS sure FROM c WHERE coalesce(told, guess) <> '') """


def answered(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Events as cards and answers; every job has replacements of the scan and of the user, which overlap."""
    e, n = table(spark, sf, "events").withColumnRenamed("user_id", "job_id"), F.col("event_id")
    text = lambda a, b: F.concat(F.lit(a), b)
    kind = F.when(F.col("event_type") == "click", "speaker").when(F.col("event_type") == "view", "term").otherwise("unclear")
    rank = F.row_number().over(evidence.Window.partitionBy("job_id").orderBy("event_id"))
    cards = e.select("job_id", "event_id", text("q", n).alias("id"), rank.alias("rank"), kind.alias("type"), F.concat("event_type", n).alias("key"), text("? ", n).alias("question"), F.when(n % 4 == 0, " ").otherwise(text("g", n)).alias("best_guess"))
    told = e.where(n % 3 < 2).select("job_id", text("q", n).alias("id"), F.when(n % 3 == 1, text("pick", n)).otherwise(review.OTHER).alias("choice"), F.when(n % 3 == 0, text("own", n)).otherwise(" ").alias("custom"))
    fixes = lambda find, put: e.select("job_id", n.alias("pos"), find.alias("find"), put.alias("replace"), F.lit("n").alias("note"))
    scanned = fixes(F.concat("event_type", F.lit("!")), F.lit("x")).dropDuplicates(["job_id", "find"])
    own = fixes(F.when(n % 2 == 0, F.concat("event_type", F.lit("! "))).otherwise(" "), F.lit("x")).unionByName(fixes(text("u", n % 3), F.lit("y")))
    return evidence.resolve(cards, told, scanned, own)


@query(ANSWERS + """, f AS (SELECT job_id, string_agg(key || '=' || value, ',' ORDER BY rank) FILTER (type = 'speaker' AND sure) AS names, string_agg(key || '=' || value, ',' ORDER BY rank) FILTER (type = 'speaker' AND NOT sure) AS guesses, string_agg('- ? ' || event_id || ' → **' || value || '**', chr(10) ORDER BY rank) FILTER (sure) AS y, string_agg('- ? ' || event_id || ' → **' || value || '**', chr(10) ORDER BY rank) FILTER (NOT sure) AS g FROM v GROUP BY 1)
SELECT job_id, coalesce(names, '') AS names, coalesce(guesses, '') AS guesses, md5('{title}' || chr(10) || coalesce(chr(10) || '{sure}' || chr(10) || chr(10) || y || chr(10), '') || CASE WHEN names IS NOT NULL THEN chr(10) || '{names}' || chr(10) ELSE '' END || coalesce(chr(10) || '{guessed}' || chr(10) || chr(10) || g || chr(10), '') || CASE WHEN job_id % 2 = 0 THEN chr(10) || '{skipped}' || chr(10) ELSE '' END) AS digest FROM f""".format(**evidence.BLOCK))
def resolved_facts(spark, sf):
    """RW02, RW03, JN06: maps of speakers and the block of confirmed facts."""
    facts, _ = answered(spark, sf)
    show = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    block = evidence.confirmed_block(F.col("confirmed"), F.col("guessed"), F.size("speaker_map") > 0, F.col("job_id") % 2 == 0)
    return facts.select("job_id", show("speaker_map").alias("names"), show("speaker_guess").alias("guesses"), F.md5(block.cast("binary")).alias("digest"))


@query(ANSWERS + """, r AS (SELECT job_id, event_type || '!' AS find, 'x' AS "replace", 'n' AS note, 0 AS origin FROM (SELECT DISTINCT user_id AS job_id, event_type FROM events) UNION ALL SELECT job_id, key, value, '使用者確認', 1 FROM v WHERE type = 'term' AND sure UNION ALL SELECT DISTINCT user_id, 'u' || event_id % 3, 'y', '使用者指定', 2 FROM events) SELECT job_id, find, "replace", note FROM r""")
def replacement_union(spark, sf):
    """SET05, FLT06: replacements of the scan, of confirmed terms and of the user, each pair once."""
    return answered(spark, sf)[1].select("job_id", "find", "replace", "note")


@query("""SELECT doc_id, 'T ' || doc_id AS title, chr(10) || 'p ' || source || chr(10) || '> q' AS body, 'p ' || source AS first, source || ' of ' || coalesce(lang, '') AS filled, left(source || '_a_b_' || doc_id, 10) AS name, CASE WHEN doc_id % 3 = 0 THEN 'advisory' WHEN doc_id % 5 >= 3 THEN 'action' ELSE 'record' END AS kind,
 CASE WHEN doc_id % 7 = 0 THEN 'error' WHEN doc_id % 2 = 0 THEN 'done' WHEN doc_id % 3 = 0 AND doc_id % 5 = 0 THEN 'awaiting_answers' ELSE 'transcribing' END AS state, coalesce(CASE WHEN doc_id % 3 = 0 THEN 'clean' END, 'raw') AS used, CASE WHEN doc_id % 2 = 0 THEN source END AS guess_role FROM documents WHERE source IS NOT NULL""")
def text_functions(spark, sf):
    """FN18, FN19, FN25, FN32, FN34, FN37, SRC06: titles, first paragraphs, file names, templates and states of documents."""
    n, source = F.col("doc_id"), F.col("source")
    note = F.concat(F.lit("# T "), n, F.lit("\n"), F.lit("\np "), source, F.lit("\n> q"))
    title, body = T.strip_leading_h1(note)
    role = T.speaker_guess(F.when(n % 2 == 0, F.concat(F.lit("x（"), source, F.lit("）"))).otherwise("x"))[1]
    return table(spark, sf, "documents").where("source is not null").select(
        "doc_id", title.alias("title"), F.concat(F.lit("\n"), F.ltrim(body, F.lit("\n"))).alias("body"), T.first_paragraph(F.concat(F.lit("# h\n- l\n> q\n\n "), F.ltrim(body, F.lit("\n")))).alias("first"),
        T.fill(F.lit("{{A}} of {{B}}"), {"A": source, "B": F.coalesce("lang", F.lit(""))}).alias("filled"), T.filename_part(F.concat(source, F.lit('/a:?"b<>'), n), 10).alias("name"),
        T.report_type(F.when(n % 3 == 0, "client").otherwise("team"), n % 5).alias("kind"), review.infer_state(n % 7 == 0, n % 2 == 0, n % 3 == 0, n % 5 == 0).alias("state"),
        files.first_existing(F.when(n % 3 == 0, "clean"), F.lit("raw")).alias("used"), role.alias("guess_role"),
    )


@query(r"""WITH j AS (SELECT conv_id AS job_id, count(*) AS n, trim(regexp_replace(string_agg(trim(coalesce(text, '')), ' ' ORDER BY turn), '[\s\x{3000}]+', ' ', 'g')) AS said, arg_min(trim(coalesce(text, '')), turn) AS first, arg_min(role, turn) AS who FROM conversations GROUP BY 1)
SELECT job_id, md5(CASE WHEN job_id % 3 > 0 AND n >= 2 THEN said ELSE trim(regexp_replace('# Title **' || who || '** [00:00:00] ' || first, '[\s\x{3000}]+', ' ', 'g')) END) AS digest, CASE WHEN job_id % 3 > 0 AND n >= 2 THEN 'turns' ELSE 'raw' END AS source FROM j WHERE job_id % 3 = 0 OR n >= 2""")
def spoken_texts(spark, sf):
    """SRC13: transcripts of several turns, and of one, which count as raw."""
    t = conversation_turns(spark, sf)
    n = F.count("*").over(evidence.Window.partitionBy("job_id"))
    some = t.withColumn("n", n).where((F.col("job_id") % 3 == 0) & (F.col("index") == 0) | (F.col("job_id") % 3 > 0) & (F.col("n") >= 2))
    block = F.concat(F.lit("**"), "speaker", F.lit("** ["), T.hhmmss(F.col("index") * 35.0), F.lit("]\n"), F.trim(F.col("text")), F.lit("\n"))
    d = some.groupBy("job_id").agg(F.concat(F.lit("# Title\n"), F.array_join(in_order(block, F.col("index")), "\n")).alias("text"))
    return lines.spoken(d, "job_id").select("job_id", F.md5(F.col("said").cast("binary")).alias("digest"), "source")


_SCRUBBED = "## 重點（3 句以內）\n見[00:01:02]。\n\n> 講者對應為推測\n> 其他\n\n> 他說「聲紋分群」\n結尾"


def _clean(kind: str) -> tuple[str, int]:
    stamps, words = kind in lines.STAMPED, kind in lines.EXPLAINED
    rows = ["## 重點", "見[00:01:02]。" if stamps else "見。", "", *([] if not words else ["> 講者對應為推測", "> 其他"]), "", "> 他說「聲紋分群」", "結尾"]
    return "\n".join(rows), 1 + (not stamps) + 2 * (not words)


@query("SELECT doc_id, CASE doc_id % 3 " + " ".join(f"WHEN {k} THEN md5('{_clean(s)[0]}' || chr(10) || doc_id)" for k, s in enumerate(("transcript_clean", "note_interview", "note_general"))) + " END AS digest, CASE doc_id % 3 " + " ".join(f"WHEN {k} THEN {_clean(s)[1]}" for k, s in enumerate(("transcript_clean", "note_interview", "note_general"))) + "::BIGINT END AS removed FROM documents")
def note_scrub(spark, sf):
    """FN23, FN21: what each kind of note loses."""
    n = F.col("doc_id")
    d = table(spark, sf, "documents").select("doc_id", pick(n, "transcript_clean", "note_interview", "note_general").alias("kind"), F.concat(F.lit(_SCRUBBED + "\n"), n).alias("text"))
    return lines.scrub(d, "doc_id").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), "removed")


_DELIVERED = ("transcript_clean.md", "note_general.pdf", "email_draft.md", "note_self.docx", "note_general.md", "transcript.json", "note_self.md", "note_client.txt", "INDEX.md", "transcript_clean.pdf")


@query(f"""WITH f AS (SELECT DISTINCT conv_id AS job_id, {sql_pick("turn * 3 + conv_id", *_DELIVERED)} AS name FROM conversations), g AS (SELECT *, split_part(name, '.', 1) AS stem, split_part(name, '.', 2) AS fmt, CASE job_id % 3 WHEN 0 THEN ['pdf'] WHEN 1 THEN ['md', 'docx'] ELSE ['md', 'pdf', 'docx', 'txt'] END AS w FROM f),
k AS (SELECT *, list_contains(w, fmt) AS asked, list_position(['transcript_clean', 'note_general', 'note_client', 'note_self', 'note_partner', 'note_interview', 'email_draft'], stem) AS o FROM g WHERE stem NOT IN ('transcript', 'INDEX')), m AS (SELECT *, bool_or(asked) OVER (PARTITION BY job_id, stem) AS hit FROM k)
SELECT job_id, name, CAST(row_number() OVER (PARTITION BY job_id ORDER BY o, list_position(['md', 'pdf', 'docx', 'json', 'txt'], fmt)) AS INT) AS place FROM m WHERE asked OR (NOT hit AND fmt = 'md')""")
def deliverable_order(spark, sf):
    """TOP11, FLT10: deliverables of each job in order, in the formats that it wants."""
    f = conversation_turns(spark, sf).select("job_id", pick(F.col("index") * 3 + F.col("job_id"), *_DELIVERED).alias("name")).distinct()
    n = F.col("job_id") % 3
    wanted = F.when(n == 0, F.array(F.lit("pdf"))).when(n == 1, F.array(F.lit("md"), F.lit("docx"))).otherwise(F.array().cast("array<string>"))
    return jobs.deliverables(f, wanted, "job_id").select("job_id", "name", "place")


_WRITER = [('{"files": {"note_a.md": "x", "action_items.json": {}, "INDEX.md": "i", "agent_report.json": "{}"}}', None), ('{"files": {"note_a.md": "x", "evil.sh": "", "b.md": ""}}', "unknown: b.md, evil.sh"), ('{"files": {"note_a.md": "x", "INDEX.md": "i", "agent_report.json": {}}}', "missing: action_items.json"),
           ('{"files": {"note_a.md": 1, "action_items.json": {}, "INDEX.md": "i", "agent_report.json": {}}}', "wrong: note_a.md"), ('{"files": {"note_a.md": "x", "action_items.json": "{oops", "INDEX.md": "i", "agent_report.json": {}}}', "wrong: action_items.json"), ('{"files": []}', "no files")]


@query("SELECT event_id, CASE event_id % 6 " + " ".join(f"WHEN {k} THEN '{p}'" for k, (_, p) in enumerate(_WRITER) if p) + " END AS problem FROM events")
def writer_replies(spark, sf):
    """SNK12, SET07: replies with files that weren't asked for, that are missing or of the wrong kind."""
    e = table(spark, sf, "events")
    reply = files.loads_loose(F.concat(F.lit("here: "), pick(F.col("event_id"), *(r for r, _ in _WRITER))))
    return e.select("event_id", jobs.writer_problem(reply, F.array(F.lit("note_a"), F.lit("transcript_clean"))).alias("problem"))


@query("""SELECT doc_id, left('acme_(' || source || ')', 24) || '_' || CASE WHEN doc_id % 2 = 0 THEN 'a_b' ELSE '未命名會議' END || '_2024-01-0' || doc_id % 9 || '_note.md' AS name, 'a' || chr(10) || '* * *' || chr(10) || '--' || chr(10) || '- - -' || chr(10) || '* * *' AS rules FROM documents WHERE source IS NOT NULL""")
def display_names(spark, sf):
    """FN24, FN25: names for readers, of full-width and forbidden characters; rules without front matter."""
    n = F.col("doc_id")
    client = F.concat(F.lit("ａｃｍｅ：（"), F.col("source"), F.lit("）"))
    title = F.when(n % 2 == 0, ' a?*  "b". ').otherwise(" ..- ")
    d = table(spark, sf, "documents").where("source is not null")
    return d.select("doc_id", T.display_name(F.lit("note.md"), client, title, F.concat(F.lit("2024-01-0"), n % 9)).alias("name"), T.plain_rules(F.lit("a\n---\n--\n- - -\n-----  ")).alias("rules"))


@query("""SELECT user_id, CASE WHEN user_id % 7 = 0 THEN 'error' ELSE arg_max(event_type, ts) END AS state, CASE WHEN user_id % 7 = 0 THEN CAST(user_id AS VARCHAR) ELSE 't' || user_id END AS title, CASE WHEN user_id % 7 <> 0 THEN count(*) END AS bytes, CASE WHEN user_id % 7 = 0 THEN 'unreadable' END AS error FROM events GROUP BY 1""")
def job_listing(spark, sf):
    """SRC14, TOP09: a row a job, broken ones too, the newest first."""
    e = table(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_type", "ts").alias("state"), F.count("*").alias("bytes"), F.max("ts").cast("string").alias("date"))
    text = F.to_json(F.struct("state", F.concat(F.lit("t"), "user_id").alias("title"), "bytes", "date"))
    rows = jobs.listing(e.select("user_id", F.when(F.col("user_id") % 7 == 0, F.substring(text, 1, 20)).otherwise(text).alias("summary")), "user_id", "state string, title string, bytes long, date string")
    return jobs.ordered(rows.withColumn("updated_at", F.lit(0)).withColumn("needs_user", F.lit(False)), "new").select("user_id", "state", "title", "bytes", "error")
