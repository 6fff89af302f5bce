"""Folding what readers of chunks reply into one document a job: evidence, scans and answers.

Replies are rows of one chunk each, with a parsed reply or null where the reader failed. Every
element becomes a row with its place in the reply; what refers to a turn that the chunk doesn't
own is dropped and counted by reason. Joins are by job and turn; nothing but the rejoining of
topics runs outside the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.text import normalize_label, squash
from colloquy.operators import review, turns
from colloquy.operators.schema import STATUSES

# Fixed values of the documents.
UNKNOWN, UNASSIGNED, UNDATED, UNNAMED = "未知講者", "未指派", "未定", "未命名議題"

EVIDENCE = (
    "struct<topics:array<struct<topic_id:string,label:string,turns:array<long>,status:string,status_turn:long>>,points:array<struct<turn:long,speaker:string,gist:string,topic_id:string>>,"
    "numbers:array<struct<turn:long,literal:string,means:string>>,actions:array<struct<turn:long,what:string,owner:string,due:string>>,unclear:array<struct<turn:long,why:string>>>"
)
SCAN = (
    "struct<draft:string,replacements:array<struct<find:string,replace:string,note:string>>,speakers:array<struct<label:string,guess:string,confidence:string,why:string>>,"
    "questions:array<struct<type:string,key:string,question:string,options:array<string>,best_guess:string>>>"
)


def blank_as(c: Column, other: str | Column) -> Column:
    """The trimmed text, or another where it is blank."""
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(other) if isinstance(other, str) else other)


def named(name: Column, roster: Column, own: Column) -> tuple[Column, Column]:
    """FN12: a speaker's name and whether it is known: the turn's own label, else the first of the roster that holds the name or is held by it."""
    own, name = F.nullif(own, F.lit("")), F.nullif(F.trim(name), F.lit(""))
    known = F.get(F.filter(roster, lambda r: (r != "") & (F.contains(r, name) | F.contains(name, r))), F.lit(0))
    return F.coalesce(own, known, name, F.lit(UNKNOWN)), F.coalesce(own, F.when(name.isNotNull(), known)).isNotNull()


def elements(replies: DataFrame, job: str, kind: str) -> DataFrame:
    """One row an element of a list of the replies: job, chunk, pos and its fields."""
    return replies.select(job, "chunk", F.posexplode(f"reply.{kind}").alias("pos", "_e")).select(job, "chunk", "pos", "_e.*")


def merge_evidence(replies: DataFrame, owned: DataFrame, job: str = "job_id", roster: Column | None = None, most: int = 6000) -> dict[str, DataFrame]:
    """RW05: replies (job, chunk, reply as EVIDENCE) over the turns that chunks own (job, chunk, index, speaker, text).

    topics, points (with their topic), numbers (with their topic, or null), actions, unclear, and dropped
    (job, reason, n), AGG10. FLT03: a turn of another chunk is no turn.
    """
    roster = F.array().cast("array<string>") if roster is None else roster
    own = owned.select(job, "chunk", F.col("index").alias("turn"), F.col("speaker").alias("said_by"), "text")
    at = [job, "chunk", "turn"]
    # The reasons that rows are dropped for, chunk_failed and those behind keep().
    lost: list[DataFrame] = [replies.where(F.col("reply").isNull()).select(job, F.lit("chunk_failed").alias("reason"))]

    def keep(rows: DataFrame, reason: str, test: Column) -> DataFrame:
        test = F.coalesce(test, F.lit(False))
        lost.append(rows.where(~test).select(job, F.lit(reason).alias("reason")))
        return rows.where(test)

    found = elements(replies, job, "topics")
    valid = found.select(job, "chunk", "pos", F.explode("turns").alias("turn")).join(own.select(*at), at).groupBy(job, "chunk", "pos").agg(F.array_sort(F.collect_set("turn")).alias("own_turns"))
    settled = own.select(job, "chunk", F.col("turn").alias("status_turn"), F.col("turn").alias("settles"))
    topics = keep(found.join(valid, [job, "chunk", "pos"], "left"), "topic_no_valid_turns", F.col("own_turns").isNotNull()).join(settled, [job, "chunk", "status_turn"], "left")
    topics = topics.select(
        job, "chunk", "pos", "topic_id", blank_as(F.col("label"), UNNAMED).alias("label"), F.col("own_turns").alias("turns"),
        F.when(F.col("status").isin(*STATUSES), F.col("status")).otherwise("pending").alias("status"), F.col("settles").alias("status_turn"),
    )

    # JN03: a point's topic by the chunk's own id, the last topic that has it, else the chunk's first topic that holds the turn.
    points = keep(elements(replies, job, "points").join(own.drop("text"), at, "left"), "point_out_of_range", F.col("said_by").isNotNull())
    by_id = topics.groupBy(job, "chunk", "topic_id").agg(F.max("pos").alias("by_id"))
    by_turn = topics.select(job, "chunk", "pos", F.explode("turns").alias("turn")).groupBy(*at).agg(F.min("pos").alias("by_turn"))
    placed = points.join(by_id, [job, "chunk", "topic_id"], "left").join(by_turn, at, "left").withColumn("topic_pos", F.coalesce("by_id", "by_turn"))
    placed = keep(placed, "point_no_topic", F.col("topic_pos").isNotNull())
    who, known = named(F.col("speaker"), roster, F.col("said_by"))
    placed = placed.select(job, "chunk", "pos", "turn", who.alias("speaker"), known.alias("speaker_verified"), F.trim("gist").alias("gist"), "topic_pos")

    # FLT04: a number's literal must stand in its turn.
    numbers = elements(replies, job, "numbers").withColumn("literal", F.trim("literal")).join(own, at, "left")
    numbers = keep(numbers, "number_out_of_range", F.col("said_by").isNotNull() & (F.col("literal") != ""))
    numbers = keep(numbers, "number_not_in_its_turn", F.contains(squash(F.col("text")), squash(F.col("literal"))))
    numbers = turns.keep_first(numbers, [F.col(job), F.col("turn"), F.col("literal")], [F.col("chunk"), F.col("pos")]).select(job, "turn", "literal", F.trim("means").alias("means"))

    owner = named(F.col("owner"), roster, F.lit(""))[0]
    actions = elements(replies, job, "actions").withColumn("what", F.trim("what")).join(own, at, "left")
    actions = keep(actions, "action_out_of_range", F.col("said_by").isNotNull() & (F.col("what") != ""))
    actions = turns.keep_first(actions, [F.col(job), F.col("turn"), normalize_label(F.col("what"))], [F.col("chunk"), F.col("pos")])
    actions = actions.select(job, "turn", "what", F.when(owner == UNKNOWN, UNASSIGNED).otherwise(owner).alias("owner"), blank_as(F.col("due"), UNDATED).alias("due"))
    unclear = keep(elements(replies, job, "unclear").join(own, at, "left"), "unclear_out_of_range", F.col("said_by").isNotNull()).select(job, "turn", F.trim("why").alias("why"))

    final, of_part = pieces(turns.cluster_topics(topics, job), own, job, most)
    points = placed.join(of_part, (placed[job] == of_part["_job"]) & (placed["chunk"] == of_part["_chunk"]) & (placed["topic_pos"] == of_part["_pos"]) & (of_part["_whole"] | (placed["turn"] == of_part["_turn"]))).select(*(placed[c] for c in (job, "chunk", "pos", "turn", "speaker", "speaker_verified", "gist")), "topic_id")
    # JN04: a number goes to the first topic that holds its turn.
    homes = final.select(job, "topic_id", F.explode("turns").alias("turn")).groupBy(job, "turn").agg(F.min("topic_id").alias("topic_id"))
    dropped = reduce(DataFrame.unionByName, lost).groupBy(job, "reason").agg(F.count("*").alias("n"))
    return {"topics": final, "points": points, "numbers": numbers.join(homes, [job, "turn"], "left"), "actions": actions, "unclear": unclear, "dropped": dropped}


def pieces(grouped: DataFrame, own: DataFrame, job: str, most: int) -> tuple[DataFrame, DataFrame]:
    """GRP07, AGG11: topics cut where their text is longer than most, numbered in order, with speakers and characters;
    and for each part of a topic the final topics that its points go to, by turn unless the topic is whole."""
    each = grouped.select(job, F.col("topic_id").alias("group"), "label", "status", "status_turn", F.explode("turns").alias("turn")).join(own.select(job, "turn", "said_by", "text"), [job, "turn"])
    cut = turns.split_oversized(each, [job, "group"], "turn", F.length("text"), most)
    rows = cut.groupBy(job, "group", "part").agg(
        F.min("label").alias("label"), F.min("status").alias("status"), F.min("status_turn").alias("status_turn"), F.array_sort(F.collect_list("turn")).alias("turns"),
        F.array_sort(F.collect_set(F.when(F.col("said_by") != "", F.col("said_by")))).alias("speakers"), F.sum(F.length("text")).alias("source_chars"),
    )
    parts = F.count("*").over(Window.partitionBy(job, "group"))
    number = F.row_number().over(Window.partitionBy(job).orderBy("group", "part"))
    rows = rows.withColumn("whole", parts == 1).withColumn("topic_id", F.format_string("T%02d", number))
    settles = F.col("whole") | F.array_contains("turns", F.col("status_turn"))
    final = rows.select(
        job, "topic_id", F.when(F.col("part") == 0, F.col("label")).otherwise(F.format_string("%s（續 %d）", "label", F.col("part") + 1)).alias("label"), "turns",
        F.when(settles, F.col("status")).otherwise("pending").alias("status"), F.when(settles, F.col("status_turn")).alias("status_turn"), "speakers", "source_chars",
    )
    members = grouped.select(F.col(job).alias("_job"), F.col("topic_id").alias("_group"), F.explode("parts").alias("p")).select("_job", "_group", F.col("p.chunk").alias("_chunk"), F.col("p.pos").alias("_pos"))
    turn = F.explode(F.when(F.col("whole"), F.array(F.lit(None).cast("long"))).otherwise(F.col("turns")))
    homes = rows.select(F.col(job).alias("_j"), F.col("group").alias("_g"), "topic_id", F.col("whole").alias("_whole"), turn.alias("_turn"))
    return final, members.join(homes, (members["_job"] == homes["_j"]) & (members["_group"] == homes["_g"])).drop("_j", "_g", "_group")


def merge_scans(replies: DataFrame, chunks: DataFrame, job: str = "job_id", most: int = 8, drafts: bool = False) -> dict[str, DataFrame]:
    """RW04: replies (job, chunk, reply as SCAN) over chunks (job, chunk, raw: the rendered own turns).

    drafts (job, draft, failed), replacements (FLT05, FLT06: named in the draft or the raw text, first come), speakers by
    mentions (AGG12, TOP13) and ranked cards (AGG13, GRP11, TOP01, TOP02). A chunk without a reply gives its raw turns to
    the draft; with drafts, a reply without a draft counts as failed too.
    """
    both = chunks.join(replies, [job, "chunk"], "left")
    text = F.nullif(F.trim("reply.draft"), F.lit(""))
    failed = F.col("reply").isNull() | (text.isNull() if drafts else F.lit(False))
    ordered = lambda c, test=None: F.transform(F.array_sort(F.collect_list(F.struct("chunk", c.alias("x")) if test is None else F.when(test, F.struct("chunk", c.alias("x"))))), lambda r: r["x"])
    parts = both.groupBy(job).agg(ordered(F.trim(F.coalesce(text, F.col("raw")))).alias("parts"), ordered(F.col("chunk"), failed).alias("failed"), ordered(F.col("raw")).alias("raws"))
    joined = F.concat(F.array_join(F.filter("parts", lambda p: p != ""), "\n\n"), F.lit("\n"))
    draft = parts.select(job, joined.alias("draft"), "failed", F.concat(F.array_join("raws", "\n\n"), joined).alias("_hay"))

    named_pairs = elements(replies, job, "replacements").select(job, "chunk", "pos", F.trim("find").alias("find"), F.trim("replace").alias("replace"), F.coalesce("note", F.lit("")).alias("note"))
    real = named_pairs.where((F.col("find") != "") & (F.col("replace") != "") & (F.col("find") != F.col("replace")))
    first = turns.keep_first(real, [F.col(c) for c in (job, "find", "replace")], [F.col("chunk"), F.col("pos")])
    kept = first.join(draft.select(job, "_hay"), job).where(F.contains("_hay", "find")).select(job, "chunk", "pos", "find", "replace", "note")

    said = elements(replies, job, "speakers").withColumn("label", F.trim("label")).where("label <> ''").withColumn("guess", F.coalesce(F.trim("guess"), F.lit(""))).withColumn("at", F.struct("chunk", "pos"))
    sure = F.when(F.col("guess") != "", F.struct(F.when(F.col("confidence") == "high", 0).otherwise(1).alias("c"), F.col("at").alias("at")))
    speakers = said.groupBy(job, "label").agg(F.count("*").alias("mentions"), F.min("at").alias("seen"), F.coalesce(F.min_by("guess", sure), F.lit("")).alias("guess"), F.when(F.min(sure)["c"] == 0, "high").otherwise("low").alias("confidence"))
    rank = F.row_number().over(Window.partitionBy(job).orderBy(F.desc("mentions"), "seen"))

    asked = elements(replies, job, "questions").withColumn("key", blank_as(F.col("key"), F.trim("question")))
    rows = asked.select(job, "chunk", F.col("pos").alias("q"), "type", "key", "best_guess", F.posexplode_outer(F.filter(F.transform("options", lambda o: F.trim(o)), lambda o: o != "")).alias("nth", "option"))
    cards = review.merge_cards(rows.withColumn("pos", F.struct("q", "nth")), job)
    lone = review.speaker_cards(cards, speakers.select(job, "label", "mentions", "guess"), job)
    shape = cards.select(job, "type", "key", "options", F.transform("chunks", lambda c: c.cast("bigint")).alias("chunks"), F.coalesce(F.trim("best_guess"), F.lit("")).alias("best_guess"))
    ranked = review.rank_cards(shape.unionByName(lone), job, most)
    guess = F.when(F.col("best_guess") != "", F.col("best_guess")).otherwise(F.coalesce(F.get(F.filter("options", lambda o: o != review.OTHER), F.lit(0)), F.lit("")))
    cards = ranked.select(job, "id", "rank", "type", "key", "chunks", review.final_options(F.col("options"), F.col("best_guess")).alias("options"), guess.alias("best_guess"))
    return {"drafts": draft.drop("_hay"), "replacements": kept, "speakers": speakers.withColumn("rank", rank).drop("seen"), "cards": cards}


def resolve(cards: DataFrame, answers: DataFrame, scanned: DataFrame, own: DataFrame, job: str = "job_id") -> tuple[DataFrame, DataFrame]:
    """RW02, SET05: what answers settle.

    cards (job, id, rank, type, key, question, best_guess), answers (job, id, choice, custom), scanned and own replacements
    (job, pos, find, replace, note). Gives one row a job with maps of confirmed and guessed speakers and lists of confirmed
    and guessed lines; and the replacements of scan, confirmed terms and user in that order, each pair once.
    """
    value, sure = review.resolve_answer(F.col("custom"), F.col("choice"), F.trim("best_guess"))
    told = cards.join(answers, [job, "id"], "left").withColumn("value", value).withColumn("sure", F.coalesce(sure, F.lit(False))).where("value <> ''")
    ordered = lambda test, c: F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("rank", c.alias("x"))))), lambda r: r["x"])
    speaker, sure = F.col("type") == "speaker", F.col("sure")
    line = F.concat("question", F.lit(" → **"), "value", F.lit("**"))
    pair = F.struct("key", "value")
    facts = told.groupBy(job).agg(
        F.map_from_entries(ordered(speaker & sure, pair)).alias("speaker_map"), F.map_from_entries(ordered(speaker & ~sure, pair)).alias("speaker_guess"),
        ordered(sure, line).alias("confirmed"), ordered(~sure, line).alias("guessed"),
    )
    terms = told.where((F.col("type") == "term") & sure & (F.col("key") != F.col("value"))).select(job, F.col("rank").alias("pos"), F.col("key").alias("find"), F.col("value").alias("replace"), F.lit("使用者確認").alias("note"))
    user = own.where((F.trim("find") != "") & (F.trim("replace") != "") & (F.trim("find") != F.trim("replace"))).select(job, "pos", F.trim("find").alias("find"), F.trim("replace").alias("replace"), F.lit("使用者指定").alias("note"))
    three = [scanned.select(job, "pos", "find", "replace", "note"), terms, user]
    union = reduce(DataFrame.unionByName, (d.withColumn("origin", F.lit(k)) for k, d in enumerate(three)))
    return facts, turns.keep_first(union, [F.col(c) for c in (job, "find", "replace")], [F.col("origin"), F.col("pos")])


# Fixed values of the block of confirmed facts.
BLOCK = {
    "title": "## 已確認事實（優先於逐字稿字面）",
    "sure": "**使用者已確認——這些一律照辦，不要再推測：**",
    "names": "**逐字稿中的講者標籤已由 Python 直接換成真實姓名**，所以你讀到的姓名是確定的，可以直接使用。",
    "guessed": "**以下是系統推測、使用者尚未確認**——可以採用，但不要把推測寫成既成事實，也**不要在文件裡加註明**：把「講者對應為推測」寫進 `agent_report.json` 的`uncertain`，文件裡判不出來的句子不指派給特定人（寫「會中有人提出」）：",
    "skipped": "> ⚠️ 使用者選擇「跳過問題」，以上全部是系統推測。同樣不要在文件裡註明這件事——寫進 `agent_report.json` 的 `uncertain`。",
    "none": "（本次沒有需要確認的事項。）",
}


def confirmed_block(confirmed: Column, guessed: Column, has_names: Column, skipped: Column) -> Column:
    """RW03: the facts as a section; parts without content are left out."""
    none, gap = F.array().cast("array<string>"), F.lit("")
    bullets = lambda lines: F.transform(lines, lambda x: F.concat(F.lit("- "), x))
    part = lambda test, *rows: F.when(test, F.concat(*rows)).otherwise(none)
    say = lambda key: F.array(F.lit(BLOCK[key]), gap)
    sure, open_ = F.size(confirmed) > 0, F.size(guessed) > 0
    rows = F.concat(
        say("title"), part(sure, say("sure"), bullets(confirmed), F.array(gap)), part(has_names, say("names")),
        part(open_, say("guessed"), bullets(guessed), F.array(gap)), part(skipped, say("skipped")), part(~sure & ~open_, say("none")),
    )
    return F.array_join(rows, "\n")
