"""Reports on jobs, their files, their models and their bundles."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.text import keyword_level, once, speaker_guess
from colloquy.operators.evidence import blank_as
from colloquy.operators.lines import FENCES, lines

# Files that a job makes and that may be removed, files that must stay, states in which a job works, words of severity.
OUTPUTS = ("note_*.md", "note_*.pdf", "note_*.docx", "transcript_clean.*", "transcript_draft.md", "action_items.json", "email_draft.md", "INDEX.md", "delivery.json", "agent_report.json", "*.md.txt")
PROTECTED = ("source.*", "meta.json", "status.json", "state.json", "transcript.md", "transcript.json", "transcript.txt", "questions.json", "answers.json", "evidence.json")
ACTIVE = ("scanning", "writing")
SEVERITIES = [("high", ["高", "critical", "重大", "立即", "勒索", "資安", "風險", "無法"]), ("medium", ["中", "待", "依賴", "未定", "需要"])]


def matches(name: Column, globs: tuple[str, ...]) -> Column:
    """Whether a name fits one of the patterns, * standing for any characters."""
    return F.regexp_like(name, F.lit("^(?:" + "|".join(".*".join(map(re.escape, g.split("*"))) for g in globs) + ")$"))


def cleanup(files: DataFrame, job: str) -> DataFrame:
    """FLT11, SET04, AGG15: of files (job, name, bytes) what may be removed: names in order, their number and bytes, and the bytes of all."""
    gone = matches(F.col("name"), OUTPUTS) & ~matches(F.col("name"), PROTECTED)
    return files.groupBy(job).agg(F.array_sort(F.collect_set(F.when(gone, F.col("name")))).alias("names"), F.count_if(gone).alias("count"), F.coalesce(F.sum(F.when(gone, F.col("bytes"))), F.lit(0)).alias("freed"), F.sum("bytes").alias("total"))


def finish(plan: DataFrame, files: DataFrame, converted: DataFrame, job: str) -> DataFrame:
    """AGG17: what a job delivers of its plan (job, s, stem, f, fmt), given its files (job, name) and conversions (job, stem, fmt, ok, info).

    A stem without its md is missing, once, and not converted; a conversion that isn't there has failed.
    """
    there = files.select(job, F.regexp_extract("name", r"^(.*)\.md$", 1).alias("stem")).where("stem <> ''").distinct().withColumn("there", F.lit(True))
    each = plan.join(there, [job, "stem"], "left").join(converted, [job, "stem", "fmt"], "left")
    has, is_md = F.coalesce("there", F.lit(False)), F.col("fmt") == "md"
    done = has & (is_md | F.coalesce("ok", F.lit(False)))
    order = lambda test, c: F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("s", "f", c.alias("x"))))), lambda r: r["x"])
    name = F.concat("stem", F.lit("."), "fmt")
    out = each.groupBy(job).agg(
        order(done, name).alias("delivery"), F.array_distinct(order(~has, F.concat("stem", F.lit(".md")))).alias("missing"),
        order(has & ~done, F.concat(name, F.lit(": "), F.coalesce("info", F.lit("")))).alias("failed"),
    )
    return out.withColumn("ok", (F.size("missing") == 0) & (F.size("failed") == 0))


MODELS = (
    "struct<models:array<struct<type:string,key:string,display_name:string,publisher:string,format:string,max_context_length:long,"
    "capabilities:struct<vision:boolean,trained_for_tool_use:boolean>,loaded_instances:array<struct<id:string>>>>>"
)


def models(payloads: DataFrame, machine: str, payload: str = "payload") -> DataFrame:
    """SRC17: the language models of each machine's list, with defaults, in order; instances are ids, the key standing for a blank one (SET08)."""
    rows = payloads.select(machine, F.posexplode(F.from_json(payload, MODELS)["models"]).alias("pos", "m")).where(F.coalesce("m.type", F.lit("llm")) == "llm")
    key, yes = F.trim(F.coalesce("m.key", F.lit(""))), lambda c: F.coalesce(c, F.lit(False))
    ids = F.array_distinct(F.filter(F.transform(F.coalesce("m.loaded_instances", F.array().cast("array<struct<id:string>>")), lambda i: blank_as(F.coalesce(i["id"], F.lit("")), key)), lambda i: i != ""))
    return rows.select(
        machine, "pos", key.alias("key"), blank_as(F.coalesce("m.display_name", F.lit("")), key).alias("display_name"), F.coalesce("m.format", F.lit("")).alias("format"),
        F.coalesce("m.max_context_length", F.lit(0)).cast("long").alias("context"), yes(F.col("m.capabilities.trained_for_tool_use")).alias("tools"), yes(F.col("m.capabilities.vision")).alias("vision"), ids.alias("instances"),
    )


def alternatives(listed: DataFrame, machine: str, tools: bool, context: int, exclude: Column, most: int = 3) -> DataFrame:
    """FLT13, TOP08: the models that would do, another format before gguf, loaded before not, then the widest context."""
    fit = listed.where((F.col("key") != exclude) & (F.col("context") >= context) & (F.col("tools") if tools else F.lit(True)))
    w = Window.partitionBy(machine).orderBy(F.col("format") == "gguf", F.size("instances") == 0, F.desc("context"), "pos")
    return fit.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def active_jobs(meta: DataFrame, states: DataFrame, job: str) -> DataFrame:
    """FLT16: private jobs (preset) in a state of work."""
    return meta.where(F.coalesce("preset", F.lit("general")) == "private").join(states.where(F.col("state").isin(*ACTIVE)), job)


def model_status(listed: DataFrame, selected: DataFrame, active: DataFrame, machine: str) -> DataFrame:
    """AGG21, SET06: per machine its loaded, selected and foreign instances, and whether the selected (machine, model) may be unloaded, as no job (machine) works."""
    joined = listed.join(selected, machine)
    ids = lambda test: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("pos", "instances")))), lambda r: r["instances"])))
    own = joined.groupBy(machine).agg(F.count("*").alias("available"), ids(F.lit(True)).alias("loaded"), ids(F.col("key") == F.col("model")).alias("by_key"), F.first("model").alias("model"))
    mine = F.when(F.array_contains("loaded", F.col("model")), F.filter("loaded", lambda i: i == F.col("model"))).otherwise(F.col("by_key"))
    jobs = active.groupBy(machine).agg(F.count("*").alias("active"))
    out = own.withColumn("selected", mine).join(jobs, machine, "left").withColumn("active", F.coalesce("active", F.lit(0)))
    return out.select(machine, "available", "loaded", "selected", F.array_except("loaded", "selected").alias("foreign"), "active", ((F.size("selected") > 0) & (F.col("active") == 0)).alias("can_unload"))


def sections(texts: DataFrame, job: str, text: str = "text") -> DataFrame:
    """Sections (job, section, title, body) of documents: second-level headings outside fences begin them, what stands before the first is left out."""
    w = Window.partitionBy(job).orderBy("line_no")
    plain = lines(texts.select(job, text), text)
    fence = F.ltrim(F.col("line")).substr(1, 3) == FENCES[0]
    at = plain.withColumn("_in", (F.sum(fence.cast("int")).over(w) % 2 == 1))
    at = at.withColumn("_head", ~F.col("_in") & F.startswith("line", F.lit("## "))).withColumn("section", F.sum(F.col("_head").cast("int")).over(w)).where("section > 0")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda r: r["line"]), "\n")
    return at.groupBy(job, "section").agg(F.trim(F.substr(F.min_by("line", "line_no"), F.lit(4))).alias("title"), F.regexp_replace(body, r"^\s+|\s+$", "").alias("body"))


def fragment(texts: DataFrame, job: str, prefixes: list[Column], text: str = "text") -> DataFrame:
    """SRC12: of each document the sections whose title begins with one of the prefixes, by prefix, then place; without any the whole text.

    Of sections of equal title the last counts, in the place of the first.
    """
    named = sections(texts, job, text).groupBy(job, "title").agg(F.min("section").alias("section"), F.max_by("body", "section").alias("body")).join(texts.select(job, *(p.alias(f"_p{k}") for k, p in enumerate(prefixes))), job)
    which = F.coalesce(*(F.when(F.startswith("title", F.col(f"_p{k}")), k) for k in range(len(prefixes))))
    found = named.withColumn("p", which).where("p is not null").groupBy(job).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "section", "body"))), lambda r: r["body"]), "\n").alias("found"))
    own = F.nullif(F.regexp_replace("found", r"^\s+|\s+$", ""), F.lit(""))
    return texts.select(job, text).join(found, job, "left").select(job, F.coalesce(own, F.col(text)).alias("fragment"))


def read_window(text: Column, offset: Column, limit: Column, most: int = 3000, chars: int = 60_000) -> Column:
    """SRC11: lines from offset (from 1) on, limit of them but 1 to most, cut at chars: body, first, last, total, truncated, remaining."""
    rows = F.split(F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), "\n", -1)
    rows = F.when(F.element_at(rows, -1) == "", F.slice(rows, 1, F.size(rows) - 1)).otherwise(rows)
    start, n = F.greatest(F.coalesce(offset, F.lit(1)), F.lit(1)), F.greatest(F.lit(1), F.least(F.lit(most), F.coalesce(limit, F.lit(most))))
    part = F.slice(rows, start, n)
    body, last = F.array_join(part, "\n"), start - 1 + F.size(part)
    return F.struct(F.substring(body, 1, chars).alias("body"), start.alias("first"), last.alias("last"), F.size(rows).alias("total"), (F.length(body) > chars).alias("truncated"), F.greatest(F.size(rows) - last, F.lit(0)).alias("remaining"))


def tool_calls(message: Column) -> Column:
    """FN41: calls (id, name, args as VARIANT, error) of a reply; arguments may be an object or its text."""
    calls = F.from_json(message, "struct<tool_calls:array<struct<id:string,function:struct<name:string,arguments:string>>>>")["tool_calls"]
    given = lambda c: F.coalesce(F.nullif(c["function"]["arguments"], F.lit("")), F.lit("{}"))
    return F.transform(calls, lambda c, i: F.struct(
        F.coalesce(F.nullif(c["id"], F.lit("")), F.concat(F.lit("call_"), i.cast("string"))).alias("id"), F.coalesce(c["function"]["name"], F.lit("")).alias("name"),
        F.try_parse_json(given(c)).alias("args"), F.when(F.try_parse_json(given(c)).isNull(), F.substring(given(c), 1, 200)).alias("error"),
    ))


def error_message(body: Column) -> Column:
    """FN42: what an error reply says: its error's message, its error, its message, else itself."""
    at = lambda path: F.nullif(F.trim(F.get_json_object(body, path)), F.lit(""))
    return F.coalesce(at("$.error.message"), F.when(~F.startswith(F.coalesce(at("$.error"), F.lit("{")), F.lit("{")), at("$.error")), at("$.message"), F.trim(body))


def describe_error(kind: Column, model: Column, code: Column, url: Column, detail: Column) -> Column:
    """FN42: an error in one line; a long detail is cut."""
    d = F.trim(F.coalesce(detail, F.lit("")))
    d = F.when(F.length(d) > 600, F.concat(F.substring(d, 1, 600), F.lit("…"))).otherwise(d)
    m, u = F.coalesce(model, F.lit("?")), F.coalesce(url, F.lit("?"))
    # Fixed values.
    return (
        F.when(kind == "http_error", F.concat(F.lit("推論服務回應 HTTP "), code.cast("string"), F.lit("（model="), m, F.lit("）："), blank_as(d, "無錯誤內容")))
        .when(kind == "unreachable", F.concat(F.lit("無法連線到推論服務 "), u, F.lit("："), d)).when(kind == "not_json", F.concat(F.lit("推論服務回傳的內容不是合法 JSON（model="), m, F.lit("）："), d))
        .when(kind == "empty", F.concat(F.lit("推論服務回傳空白內容（model="), m, F.lit("）："), d)).when(kind.isNull(), "").otherwise(blank_as(d, "未知的 API 失敗"))
    )


def differing(a: Column, b: Column) -> Column:
    """AGG08: at how many places two texts differ, up to the end of the shorter."""
    return F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x.isNotNull() & y.isNotNull() & (x != y)), lambda x: x))


def export_names(files: DataFrame, job: str, order: str, name: str) -> DataFrame:
    """GRP14: names that are unlike within a job: a name that is taken gets _2, _3, the first that is free, before its ending."""
    stem, ending = (F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", g) for g in (1, 2))
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), stem.alias("stem"), ending.alias("end"))))

    def step(seen: Column, f: Column) -> Column:
        numbers = F.sequence(F.lit(2), F.size(seen) + 2)
        free = F.filter(F.transform(numbers, lambda n: F.concat(f["stem"], F.lit("_"), n.cast("string"), f["end"])), lambda x: ~F.array_contains(seen, x))
        plain = F.concat(f["stem"], f["end"])
        return F.array_append(seen, F.when(F.array_contains(seen, plain), F.get(free, F.lit(0))).otherwise(plain))

    named = files.groupBy(job).agg(rows.alias("rows")).withColumn("names", F.aggregate("rows", F.array().cast("array<string>"), step))
    return named.select(job, F.inline(F.zip_with("rows", "names", lambda r, n: F.struct(r["o"].alias(order), n.alias("export_name")))))


def speakers(segments: DataFrame, guesses: DataFrame, job: str) -> DataFrame:
    """GRP13, JN07: the speakers of segments (job, i, speaker number or null) in order of their first word, with guessed names (job, label, guess, confidence).

    Speaker 0 is 講者1. A segment without a speaker is a speaker of its own, numbered by those before it, as ids must not be shared.
    """
    known = F.coalesce(F.col("speaker") >= 0, F.lit(False))
    first = segments.where(known).groupBy(job, F.col("speaker").alias("n")).agg(F.min("i").alias("i")).unionByName(segments.where(~known).select(job, F.lit(None).cast("int").alias("n"), "i"))
    order = F.row_number().over(Window.partitionBy(job).orderBy("i"))
    named, role = speaker_guess(F.col("guess"))
    told = guesses.where((F.trim("label") != "") & (F.trim("guess") != "")).select(job, F.trim("label").alias("label"), named.alias("displayName"), F.coalesce(role, F.nullif(F.trim("confidence"), F.lit(""))).alias("roleHint"))
    rows = first.withColumn("ordinal", order).select(job, "ordinal", "n", F.when(F.col("n").isNull(), F.concat(F.lit("spk-unknown-"), "ordinal")).otherwise(F.concat(F.lit("spk-"), F.col("n") + 1)).alias("id"), F.when(F.col("n").isNull(), "未知講者").otherwise(F.concat(F.lit("講者"), F.col("n") + 1)).alias("label"))
    return rows.join(told, [job, "label"], "left")


def risks(rows: DataFrame, job: str) -> DataFrame:
    """SNK18: risks (job, pos, label, mitigation, detail, raised_by) with a detail, the first that isn't blank, and a severity read from both."""
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    label = F.trim("label")
    detail = F.coalesce(text("mitigation"), text("detail"), text("raised_by"), label)
    return rows.where(label != "").select(job, "pos", F.substring(label, 1, 60).alias("label"), detail.alias("detail"), keyword_level(F.concat_ws(" ", label, detail), SEVERITIES, "low").alias("severity"))


def bundle(jobs: DataFrame, segments: DataFrame, guesses: DataFrame, risk_rows: DataFrame, job: str, version: str = "1") -> DataFrame:
    """SNK09: one nested JSON document a job that has segments; absent fields are left out.

    jobs: (job, title, client, preset, language, minutes, expected, raw, cleaned, summary) with arrays decisions, actions and topics as
    the bundle's own structs; segments: (job, i, speaker, start, end, text).
    """
    ordered = lambda by, *fields: F.transform(F.array_sort(F.collect_list(F.struct(F.col(by).alias("_o"), F.struct(*fields).alias("x")))), lambda r: r["x"])
    who = speakers(segments, guesses, job)
    told = who.groupBy(job).agg(ordered("ordinal", "id", "label", "displayName", "roleHint").alias("speakers"))
    ms = lambda c: F.round(F.col(c) * 1000).cast("long")
    ids = who.where(F.col("n").isNotNull()).select(job, F.col("n").alias("speaker"), F.col("id").alias("speakerId"))
    said = segments.join(ids, [job, "speaker"], "left").withColumn("startMs", ms("start")).withColumn("endMs", ms("end")).withColumn("id", F.concat(F.lit("seg-"), F.col("i") + 1))
    said = said.groupBy(job).agg(ordered("i", "id", F.coalesce("speakerId", F.lit("spk-unknown")).alias("speakerId"), "startMs", "endMs", "text").alias("segments"))
    dangers = risks(risk_rows, job).groupBy(job).agg(ordered("pos", "label", "detail", "severity").alias("risks"))
    full = jobs.join(said, job).join(told, job).join(dangers, job, "left")
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    language = F.lower(F.trim("language"))
    document = F.struct(
        F.struct(F.col(job).cast("string").alias("bundleId"), F.lit(version).alias("exportVersion")).alias("bundle"),
        F.struct(
            F.coalesce(text("title"), F.col(job).cast("string")).alias("title"), text("client").alias("client"), F.when(language.isin("zh", "en", "mixed"), language).otherwise("unknown").alias("language"),
            F.when(F.lower(F.trim("preset")) == "private", "private").otherwise("standard").alias("sensitivity"), F.nullif(F.col("minutes"), F.lit(0)).alias("durationMinutes"), F.col("expected").alias("participantsExpected"), F.size("speakers").alias("speakersDetected"),
        ).alias("meeting"),
        F.col("speakers"), F.struct(F.col("raw").alias("rawText"), blank_as(F.col("cleaned"), F.col("raw")).alias("cleanedText"), F.col("segments")).alias("transcript"),
        F.struct(F.col("summary"), F.col("topics"), F.col("decisions"), F.col("actions"), F.coalesce("risks", F.array().cast("array<struct<label:string,detail:string,severity:string>>")).alias("risks")).alias("extracted"),
    )
    return full.select(job, F.to_json(document).alias("document"))


# Deliverables in order, formats in order, what a writer always returns.
DELIVERABLES = ("transcript_clean", "note_general", "note_client", "note_self", "note_partner", "note_interview", "email_draft")
FORMATS = ("md", "pdf", "docx", "json", "txt")
ALWAYS = ("action_items.json", "INDEX.md", "agent_report.json")


def deliverables(files: DataFrame, wanted: Column, job: str) -> DataFrame:
    """FLT10, TOP11: of files (job, name) the deliverables in the formats wanted (all if empty), md standing in for a stem of which none is; with their place."""
    fmt = F.regexp_extract("name", r"\.([^.]*)$", 1)
    at = lambda c, values, other: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, values)), c), F.lit(0)) - 1, F.lit(other))
    known = files.withColumn("fmt", fmt).withColumn("stem", F.regexp_extract("name", r"^(.*)\.[^.]*$", 1)).where(F.col("stem").isin(*DELIVERABLES))
    asked = known.withColumn("_asked", (F.size(wanted) == 0) | F.array_contains(wanted, F.col("fmt")))
    some = F.max("_asked").over(Window.partitionBy(job, "stem"))
    kept = asked.withColumn("_some", some).where(F.col("_asked") | (~F.col("_some") & (F.col("fmt") == "md")))
    w = Window.partitionBy(job).orderBy(at(F.col("stem"), DELIVERABLES, 99), at(F.col("fmt"), FORMATS, 9), "name")
    return kept.withColumn("place", F.row_number().over(w)).drop("_asked", "_some")


def writer_problem(reply: Column, stems: Column) -> Column:
    """SNK12: why a writer's reply, an object as VARIANT, is refused, or null: files that nobody asked for, files that are missing, content of the wrong kind."""
    allowed = F.concat(F.transform(F.filter(stems, lambda s: s != "transcript_clean"), lambda s: F.concat(s, F.lit(".md"))), F.array(*map(F.lit, ALWAYS)))

    def problem(held: Column) -> Column:
        unknown, lacking = F.array_sort(F.array_except(F.map_keys(held), allowed)), F.array_except(allowed, F.map_keys(held))
        text = lambda e: F.startswith(F.schema_of_variant(e["value"]), F.lit("STRING"))
        wrong = lambda e: F.when(F.endswith(e["key"], F.lit(".md")), ~text(e)).otherwise(text(e) & F.try_parse_json(F.try_variant_get(e["value"], "$", "string")).isNull())
        bad = F.array_min(F.transform(F.filter(F.map_entries(held), wrong), lambda e: e["key"]))
        return (
            F.when(held.isNull(), "no files").when(F.size(unknown) > 0, F.concat(F.lit("unknown: "), F.array_join(unknown, ", "))).when(F.size(lacking) > 0, F.concat(F.lit("missing: "), F.get(lacking, F.lit(0))))
            .when(bad.isNotNull(), F.concat(F.lit("wrong: "), bad))
        )

    return once(F.try_variant_get(reply, "$.files", "map<string,variant>"), problem)


def listing(texts: DataFrame, job: str, fields: str, text: str = "summary") -> DataFrame:
    """SRC14: a row a job of its summary (JSON of fields); one that can't be read is a row in state error that says so."""
    broken = F.try_parse_json(text).isNull()
    row = F.from_json(F.when(~broken, F.col(text)), fields)
    names = [f.split()[0] for f in fields.split(",")]
    read = texts.select(job, broken.alias("_broken"), row.alias("_row"))
    own = {"state": F.lit("error"), "title": F.col(job).cast("string")}
    return read.select(job, *(F.when(F.col("_broken"), own[n]).otherwise(F.col(f"_row.{n}")).alias(n) if n in own else F.col(f"_row.{n}").alias(n) for n in names), F.when(F.col("_broken"), "unreadable").alias("error"))


def ordered(rows: DataFrame, sort: str = "new") -> DataFrame:
    """TOP09, TOP10: jobs (date, updated_at, bytes, needs_user, state) by a sort of the list: new, old, big or attention; a sort over ranges, no task holds all."""
    date, at = F.coalesce("date", F.lit("")), F.coalesce("updated_at", F.lit(0))
    newest = [date.desc(), at.desc()]
    rank = F.when(F.col("needs_user"), 0).when(F.col("state") == "error", 1).when(F.col("state").isin("transcribing", *ACTIVE), 2).otherwise(3)
    return rows.orderBy(*{"new": newest, "old": [date.asc(), at.asc()], "big": [F.coalesce("bytes", F.lit(0)).desc()], "attention": [rank, *newest]}[sort])
