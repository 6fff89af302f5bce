"""Documents rendered from evidence.

Evidence is one row a job with arrays of topics, actions, numbers and unclear turns.
A document is then an expression over its row: rendering shuffles nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.text import SPACE, STAMP, cell, chinese_index, squash, strip_speaker_prefix

# Fixed values of the documents.
SKELETONS = {
    "note_general": ["highlights", "topics", "decisions", "actions", "open", "next"],
    "note_client": ["highlights", "topics", "decisions", "actions", "open", "next"],
    "note_self": ["highlights", "topics", "decisions", "actions", "numbers", "open", "next"],
    "note_partner": ["highlights", "topics", "decisions", "actions", "open", "next"],
    "note_interview": ["highlights", "topics", "quotes", "open", "next"],
}
HEADINGS = {
    "highlights": "本次會議重點", "topics": "議題討論", "decisions": "決議事項", "actions": "待辦事項",
    "numbers": "關鍵數字", "quotes": "重點語錄", "open": "未解決事項與待確認", "next": "下次會議",
}
TITLES = {"note_general": "會議記錄", "note_client": "會議記錄", "note_self": "內部覆盤", "note_partner": "夥伴補課摘要", "note_interview": "訪談紀要"}
# What documents say where nothing is known, and their sentences.
SAYS = {
    "speaker": "未知講者",
    "basis": "會中明確拍板",
    "begun": "未開始",
    "purpose": "（未說明用途）",
    "settled": "- 本次會議沒有懸而未決的事項。",
    "unclear": "- （音檔不清楚）",
    "title": "未命名會議",
    "conclusion": "- **結論**：",
    "silent": "- 未討論",
    "fixed": "上下文判讀",
    "files": "# 檔案清單 — ",
    "clean": "# 逐字稿（定稿）：",
}
STATUS = {"decided": "已決議", "pending": "待定", "parked": "保留"}
KINDS = {
    "transcript_clean": ("定稿逐字稿（已校訂）", "內部；經確認後可供客戶查核"),
    "note_general": ("會議記錄：重點、議題討論、決議、待辦", "全體與會者"),
    "note_client": ("會議記錄（客戶版）", "客戶"),
    "note_self": ("內部覆盤", "僅限我方——嚴禁外傳"),
    "note_partner": ("夥伴補課摘要", "我方未出席夥伴"),
    "note_interview": ("訪談紀要（含重點語錄）", "研究用途"),
}
UNDATED = "未定"

#: What the renderers expect, one row a job.
EVIDENCE = """topics array<struct<id:string,label:string,heading:string,status:string,basis:string,turns:array<long>,
 discussion:array<struct<turn:long,speaker:string,point:string>>,points:array<struct<turn:long,speaker:string,gist:string>>,quotes:array<string>>>,
 actions array<struct<turn:long,what:string,owner:string,due:string>>, numbers array<struct<turn:long,literal:string,means:string>>, unclear array<struct<turn:long,why:string>>"""


def strings(*lines: str | Column) -> Column:
    """An array of literal lines and line expressions."""
    return F.array(*(x if isinstance(x, Column) else F.lit(x) for x in lines)).cast("array<string>")


def or_else(rows: Column, *empty: str) -> Column:
    return F.when(F.size(rows) > 0, rows).otherwise(strings(*empty))


def blank(text: Column) -> Column:
    """Trimmed text; null where nothing is left."""
    return F.nullif(F.trim(text), F.lit(""))


def headed(topic: Column) -> Column:
    return F.coalesce(blank(topic["heading"]), topic["label"])


def turn_line(index: Column, stamp: Column, speaker: Column, text: Column) -> Column:
    """SNK11: a turn as one line under its number, without a leading stamp."""
    who = F.coalesce(blank(speaker), F.lit(SAYS["speaker"]))
    return F.concat(F.lit("#"), index.cast("string"), F.lit(" ["), stamp, F.lit("] "), who, F.lit("："), squash(unstamped(text)))


def unstamped(text: Column) -> Column:
    return F.regexp_replace(text, rf"^\s*`?\[\s*{STAMP}\s*\]`?{SPACE}*", "")


def turn_block(stamp: Column, speaker: Column, text: Column) -> Column:
    """SNK11: a turn as a header and its text."""
    return F.concat(F.lit("**["), stamp, F.lit("] "), F.coalesce(blank(speaker), F.lit(SAYS["speaker"])), F.lit("**\n\n"), unstamped(text), F.lit("\n"))


def chunk_text(turns: DataFrame, job: str, order: str, block: str, stamp: str, chars: str) -> DataFrame:
    """SNK11: a text a chunk under a header; turns of the chunk before (is_overlap) stand fenced off above its own."""
    own = ~F.col("is_overlap")
    blocks = lambda test: F.transform(F.array_sort(F.collect_list(F.when(test, F.struct(order, block)))), lambda x: x[block])
    mine = lambda c: F.when(own, F.col(c))
    head = F.format_string("<!-- chunk %02d · %s–%s · %d 段 · %d 字 -->", "chunk", "_from", "_to", F.size("_own"), "_chars")
    fenced = F.concat(strings("### 上文（僅供理解，**不要**重複整理，不要寫進輸出）", ""), F.col("_before"), strings("### 本段（**只**整理這一段）", ""))
    lines = F.concat(strings(head), F.when(F.size("_before") > 0, fenced).otherwise(strings()), F.col("_own"))
    grouped = turns.groupBy(job, "chunk").agg(blocks(own).alias("_own"), blocks(~own).alias("_before"), F.min(mine(stamp)).alias("_from"), F.max(mine(stamp)).alias("_to"), F.sum(mine(chars)).alias("_chars"))
    return grouped.select(job, "chunk", F.concat(F.trim(F.array_join(lines, "\n"), F.lit(" \n")), F.lit("\n")).alias("text"))


def bullets(topic: Column) -> Column:
    """SNK06, TOP07: what was said on a topic; fewer than three bullets are topped up from unused points in order."""
    line = lambda who, what: F.when(F.length(who) > 0, F.concat(F.lit("  - "), who, F.lit("："), strip_speaker_prefix(what, who))).otherwise(F.concat(F.lit("  - "), what))
    said = F.filter(topic["discussion"], lambda d: F.trim(d["point"]) != "")
    used = F.transform(said, lambda d: d["turn"])
    spare = F.filter(topic["points"], lambda p: (p["gist"] != "") & ~F.coalesce(F.array_contains(used, p["turn"]), F.lit(False)))
    # One point a turn: the first.
    turns = F.transform(spare, lambda p: p["turn"])
    once = F.filter(spare, lambda p, i: F.array_position(turns, p["turn"]) == i + 1)
    rows = F.transform(said, lambda d: line(F.coalesce(d["speaker"], F.lit("")), F.trim(d["point"])))
    rows = F.concat(rows, F.slice(F.transform(once, lambda p: line(F.coalesce(p["speaker"], F.lit("")), p["gist"])), 1, F.greatest(F.lit(0), 3 - F.size(rows))))
    lone = (F.size(rows) == 1) & (F.size(topic["turns"]) <= 2)
    return F.when(lone, F.concat(rows, strings("  - 本議題僅一次發言。"))).otherwise(or_else(rows, "  - （音檔不清楚，本議題無法整理出具體討論內容）"))


def status_label(status: Column) -> Column:
    out = F
    for name, label in STATUS.items():
        out = out.when(status == name, F.lit(label))
    return out.otherwise(status)


def topic_lines(topic: Column, number: Column) -> Column:
    """SNK06: heading, bullets, conclusion and at most two quotations of a topic."""
    basis = blank(topic["basis"])
    end = F.concat(F.lit(SAYS["conclusion"]), status_label(topic["status"]), F.coalesce(F.concat(F.lit("——"), basis), F.lit("")))
    quotes = F.slice(topic["quotes"], 1, 2)
    quoted = F.when(F.size(quotes) > 0, F.concat(strings(""), quotes)).otherwise(strings())
    return F.concat(strings(F.concat(F.lit("### "), number.cast("string"), F.lit(". "), headed(topic)), "", "- **討論內容**："), bullets(topic), strings(end), quoted, strings(""))


def row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def numbered(items: Column, line) -> Column:
    return F.transform(items, lambda x, i: line(x, (i + 1).cast("string")))


def section(key: str, highlights: Column) -> Column:
    """The lines of one section; where it has nothing to tell, it says so. FLT08: decided, pending or parked topics, dated actions."""
    topics, actions, numbers, unclear = (F.col(c) for c in ("topics", "actions", "numbers", "unclear"))
    if key == "highlights":
        return or_else(F.transform(highlights, lambda h: F.concat(F.lit("- "), h)), "- （本次會議未整理出重點）")
    if key == "topics":
        return or_else(F.flatten(F.transform(topics, lambda t, i: topic_lines(t, i + 1))), "（逐字稿中未辨識出可整理的議題。）")
    if key == "decisions":
        decided = F.filter(topics, lambda t: t["status"] == "decided")
        rows = numbered(decided, lambda t, n: row(n, headed(t), cell(F.coalesce(blank(t["basis"]), F.lit(SAYS["basis"])))))
        return F.concat(strings("| # | 決議 | 依據／理由 |", "|---|---|---|"), or_else(rows, "| — | 本次會議未產生明確決議 | 所有議題均未拍板 |"))
    if key == "actions":
        rows = numbered(actions, lambda a, n: row(n, cell(a["what"]), a["owner"], a["due"], F.lit(SAYS["begun"])))
        return F.concat(strings("| # | 事項 | 負責人 | 期限 | 狀態 |", "|---|---|---|---|---|"), or_else(rows, "| — | 本次會議未產生待辦事項 | — | — | — |"))
    if key == "numbers":
        return or_else(F.transform(numbers, lambda n: F.concat(F.lit("- **"), n["literal"], F.lit("** — "), F.coalesce(blank(n["means"]), F.lit(SAYS["purpose"])))), SAYS["silent"])
    if key == "quotes":
        return or_else(F.flatten(F.transform(topics, lambda t: F.flatten(F.transform(F.slice(t["quotes"], 1, 2), lambda q: F.array(q, F.lit("")))))), SAYS["silent"])
    if key == "open":
        waiting = F.filter(topics, lambda t: t["status"].isin("pending", "parked"))
        asked = F.transform(waiting, lambda t: F.concat(F.lit("- "), headed(t), F.lit("——"), status_label(t["status"]), F.coalesce(F.concat(F.lit("；"), cell(blank(t["basis"]))), F.lit(""))))
        return or_else(F.concat(asked, F.transform(F.slice(unclear, 1, 5), lambda u: F.concat(F.lit(SAYS["unclear"]), u["why"]))), SAYS["settled"])
    dated = F.slice(F.filter(actions, lambda a: a["due"] != UNDATED), 1, 5)
    return or_else(F.transform(dated, lambda a: F.concat(F.lit("- "), a["due"], F.lit("："), cell(a["what"]), F.lit("（"), a["owner"], F.lit("）"))), SAYS["silent"])


def document(stem: str, title: Column, highlights: Column) -> Column:
    """SNK05, FN09: a document of a kind over a row of EVIDENCE; unknown kinds are general notes."""
    parts = [strings(F.concat(F.lit("# "), F.coalesce(blank(title), F.lit(SAYS["title"])), F.lit(" " + TITLES.get(stem, "會議記錄"))), "")]
    for n, key in enumerate(SKELETONS.get(stem, SKELETONS["note_general"]), 1):
        parts += [strings(F.concat(F.lit("## "), chinese_index(F.lit(n)), F.lit("、" + HEADINGS[key])), ""), section(key, highlights), strings("")]
    return F.concat(F.rtrim(F.array_join(F.concat(*parts), "\n"), F.lit(" \n")), F.lit("\n"))


def action_items() -> Column:
    """SNK07: decisions, actions, risks and numbers of a row of EVIDENCE as one struct for to_json."""
    decided = F.filter("topics", lambda t: t["status"] == "decided")
    return F.struct(
        F.transform(decided, lambda t: F.struct(headed(t).alias("decision"), F.coalesce(blank(t["basis"]), F.lit(SAYS["basis"])).alias("basis"))).alias("decisions"),
        F.transform("actions", lambda a: F.struct(a["what"].alias("item"), a["owner"].alias("responsible"), a["due"].alias("deadline"), F.lit(SAYS["begun"]).alias("status"))).alias("actions"),
        F.transform("unclear", lambda u: F.struct(u["why"].alias("risk"), F.concat(F.lit("turn "), u["turn"].cast("string")).alias("source"))).alias("risks"),
        F.transform("numbers", lambda n: n["literal"]).alias("numbers"),
    )


def index_document(stems: list[str], title: Column, client: Column, date: Column) -> Column:
    """SNK08: the list of deliverables with the counts of topics and actions."""
    fact = lambda name, v: F.concat(F.lit(f"- **{name}**："), v)
    dash = F.lit("—")
    head = strings(F.concat(F.lit(SAYS["files"]), F.coalesce(blank(title), F.lit(SAYS["title"]))), "", fact("對象", F.coalesce(blank(client), dash)), fact("日期", F.coalesce(blank(date), dash)), fact("議題數", F.size("topics").cast("string")), fact("待辦數", F.size("actions").cast("string")), "", "## 交付文件", "", "| 檔案 | 內容 | 讀者 |", "|---|---|---|")
    files = ["| `{}.md` | {} | {} |".format(s, *KINDS.get(s, ("會議文件", "內部"))) for s in stems]
    return F.concat(F.array_join(F.concat(head, strings(*files, "| `action_items.json` | 決議／待辦／風險／關鍵數字（結構化） | 內部 |")), "\n"), F.lit("\n"))


def clean_transcript(title: Column, facts: dict[str, Column], confirmed: Column, guessed: Column, body: Column, fixes: Column) -> Column:
    """SNK03: header, confirmed and guessed names, body, table of corrections.

    confirmed and guessed: arrays of (label, name); fixes: of (find, put, note).
    """
    none = strings()
    rows = lambda pairs, sign: F.transform(pairs, lambda p: F.concat(F.lit("- "), p["label"], F.lit(sign), p["name"]))
    names = lambda pairs, head, sign: F.when(F.size(pairs) > 0, F.concat(strings("", head, ""), rows(pairs, sign))).otherwise(none)
    head = F.concat(strings(F.concat(F.lit(SAYS["clean"]), title), "", *(F.concat(F.lit(f"- **{k}**："), v) for k, v in facts.items())), names(confirmed, "**講者對應（使用者確認）**", " = "), names(guessed, "**講者對應（系統推測，未經確認）**", " ≈ "), strings("", "---", ""))
    table = F.transform(fixes, lambda f: row(f["find"], f["put"], F.coalesce(blank(f["note"]), F.lit(SAYS["fixed"]))))
    tail = F.when(F.size(fixes) > 0, F.concat(strings("", "---", "", "## 修正對照表", "", "| 原文（ASR） | 修正後 | 依據 |", "|---|---|---|"), table)).otherwise(none)
    return F.concat(F.array_join(head, "\n"), F.trim(body, F.lit(" \n")), F.lit("\n"), F.array_join(tail, "\n"), F.lit("\n"))


def bundle_topics(decisions: Column, actions: Column, risks: Column) -> Column:
    """SNK15: at most four topics (title, summary, confidence) of arrays of decisions (decision, basis, status), actions (item) and risks (risk).

    What supports a topic is found by `review.evidence_top` over its title and summary.
    """
    entry = lambda title, summary, sure: F.struct(title.alias("title"), summary.alias("summary"), F.lit(sure).cast("double").alias("confidence"))
    named = F.filter(F.slice(decisions, 1, 2), lambda d: F.trim(d["decision"]) != "")
    first = F.transform(named, lambda d: entry(F.substring(F.trim(d["decision"]), 1, 28), F.coalesce(blank(d["basis"]), blank(d["status"]), F.trim(d["decision"])), 0.82))

    def joined(items: Column, field: str, most: int, title: str, sure: float) -> Column:
        text = F.array_join(F.filter(F.transform(F.slice(items, 1, most), lambda x: F.trim(x[field])), lambda x: x != ""), "；")
        return F.filter(F.array(entry(F.lit(title), text, sure)), lambda e: e["summary"] != "")

    return F.slice(F.concat(first, joined(actions, "item", 3, "待辦與推進節點", 0.79), joined(risks, "risk", 2, "主要風險與前置限制", 0.77)), 1, 4)


def bundle_decisions(decisions: Column) -> Column:
    """SNK16: decisions with a status read from their words."""
    named = F.filter(decisions, lambda d: F.trim(d["decision"]) != "")
    words = lambda d: F.coalesce(d["status"], F.lit(""))
    status = lambda d: F.when(F.contains(words(d), F.lit("已決議")) | F.contains(F.lower(words(d)), F.lit("confirmed")), "confirmed").when(F.contains(words(d), F.lit(UNDATED)), "uncertain").otherwise("proposed")
    return F.transform(named, lambda d: F.struct(F.trim(d["decision"]).alias("summary"), F.when(status(d) == "confirmed", 0.84).otherwise(0.68).alias("confidence"), status(d).alias("status")))


def bundle_actions(actions: Column) -> Column:
    """SNK17: actions (item, owner, due, status); blank fields are null, which to_json leaves out."""
    named = F.filter(actions, lambda a: F.trim(a["item"]) != "")
    sure = lambda a: F.when(blank(a["owner"]).isNotNull() & blank(a["due"]).isNotNull() & (F.trim(a["due"]) != UNDATED), 0.86).otherwise(0.73)
    return F.transform(named, lambda a: F.struct(F.trim(a["item"]).alias("action"), blank(a["owner"]).alias("ownerCandidate"), blank(a["due"]).alias("dueCandidate"), blank(a["status"]).alias("dependencyCandidate"), sure(a).alias("confidence")))


def bundle_artifacts(files: DataFrame, job: str, delivered: DataFrame) -> DataFrame:
    """SNK19: first source file, transcripts and questions that exist, then deliveries (ordinal, path); with their ordinal."""
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.when(name.rlike(r"^source\."), F.lit("audio"))
    for file, what in (("transcript.md", "transcript_raw"), ("transcript_clean.md", "transcript_cleaned"), ("questions.json", "diarization")):
        kind = kind.when(name == file, what)
    order = F.array_position(F.array(*map(F.lit, ("audio", "transcript_raw", "transcript_cleaned", "diarization"))), F.col("kind"))
    found = files.withColumn("kind", kind).where("kind is not null").groupBy(job, "kind").agg(F.min("path").alias("path"))
    notes = delivered.where(F.col("path") != "").select(job, (F.col("ordinal") + 4).cast("long").alias("ordinal"), F.lit("notes").alias("kind"), "path")
    return found.select(job, (order - 1).cast("long").alias("ordinal"), "kind", "path").unionByName(notes)


def score_line(rank: Column, job: Column, is_evidence: Column, m: dict[str, Column]) -> Column:
    """SNK20: a row of the fixed-width score table."""
    ints = {k: m[k].cast("long") for k in ("topics", "traceable", "quotes", "present", "note_chars", "source_chars")}
    return F.format_string("%2d  %-38s %2s %6.3f %6.3f %6d %4d/%-5d %5d %,8d %,8d", rank, job, F.when(is_evidence, "E").otherwise("-"), m["score"], m["ratio"], *ints.values())
