"""Line operators over texts: blocks, fences, scrubbing, quotations and their provenance."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.text import ENDINGS, NOISE, STAMP, hhmmss, parse_stamp, squash
from colloquy.operators import storage, substrings
from colloquy.operators.scans import ROWS, Scan

#: What may stand around the parts of a header.
PAD = " \t\u3000"
#: Longest name before a colon.
NAME = 24
FENCES = ("```", "~~~")
# Fixed values of the scrub: marks that join stamps, signs that stand without a blank before them,
# pairs of quotation marks, and the words of a limit in a heading.
JOINERS = "–—~至,、，/-"
CLOSERS = "。，、；：！？）」』】"
QUOTED = ["「」", "『』", "“”", '""']
UNITS = "條項點句字個則"
BOUNDS = ["以內", "以内", "以下", "至少", "最多", "最少", "至多", "不超過", "不多於", "不少於"]
#: Stands for a stamp while a line is worked on; a character of the private use area.
HOLE = "\ue000"


def _bare(c: Column, around: str = PAD) -> Column:
    return F.trim(c, F.lit(around))


def _from(c: Column, start: Column | int, n: Column | int | None = None) -> Column:
    """From a position (from 1) on, or n characters."""
    at = F.lit(start) if isinstance(start, int) else start
    return F.substr(c, at) if n is None else F.substr(c, at, F.lit(n) if isinstance(n, int) else n)


def stamp_range(c: Column) -> Column:
    """Start and end of a text that is one stamp, or two joined by a dash, in brackets; null if it is anything else."""
    inner = _bare(c, PAD + "`")
    boxed = F.startswith(inner, F.lit("[")) & F.endswith(inner, F.lit("]"))
    parts = F.transform(F.split(_from(inner, 2, F.length(inner) - 2), "[–—~-]"), lambda p: _bare(p))
    fine = boxed & (F.size(parts) <= 2) & F.forall(parts, lambda p: F.coalesce(F.regexp_like(p, F.lit(f"^{STAMP}$")), F.lit(False)))
    return F.when(fine, F.struct(F.get(parts, F.lit(0)).alias("ts"), F.get(parts, F.lit(1)).alias("te")))


def match_header(line: Column) -> Column:
    """SRC04: speaker, start, end and rest of a header line; null if it is none.

    A header is bold with a ruled name, bold with the stamps first, bold with the stamps
    behind, or plain stamps before a name and a colon; only a ruled name needs no stamps.
    """
    none = F.lit("").alias("rest")
    head = lambda who, at, rest=none: F.struct(_bare(who).alias("speaker"), at["ts"].alias("ts"), at["te"].alias("te"), rest)
    bold = F.split(line, r"\*\*", 3)
    is_bold, inner, tail = F.startswith(line, F.lit("**")) & (F.size(bold) == 3), _bare(F.get(bold, F.lit(1))), _bare(F.get(bold, F.lit(2)))
    after, rule = stamp_range(tail), "──"
    ruled = is_bold & F.startswith(inner, F.lit(rule)) & F.endswith(inner, F.lit(rule)) & (F.length(inner) >= 4) & ((tail == "") | after.isNotNull())
    # Stamps at the beginning of a text end at its first closing bracket, or at the tick behind it.
    closed = lambda c: F.instr(c, "]") + F.when(F.startswith(c, F.lit("`")), 1).otherwise(0)
    first, second = closed(inner), closed(line)
    within, before = stamp_range(_from(inner, 1, first)), stamp_range(_from(line, 1, second))
    said = F.ltrim(_from(line, second + 1), F.lit(PAD))
    colon = F.instr(F.translate(said, "：", ":"), ":")
    # Most lines are no headers, which their first character tells.
    may = F.substr(F.ltrim(line, F.lit(PAD)), F.lit(1), F.lit(1)).isin("*", "[", "`")
    found = (
        F.when(ruled, head(_from(inner, 3, F.length(inner) - 4), F.coalesce(after, F.struct(F.lit(None).cast("string").alias("ts"), F.lit(None).cast("string").alias("te")))))
        .when(is_bold & (tail == "") & within.isNotNull(), head(_from(inner, first + 1), within))
        .when(is_bold & after.isNotNull() & ~F.regexp_like(inner, F.lit(r"[\[\]]")), head(inner, after))
        .when(before.isNotNull() & colon.between(1, NAME + 1), head(_from(said, 1, colon - 1), before, _bare(_from(said, colon + 1)).alias("rest")))
    )
    return F.when(may, found)


def lines(df: DataFrame, text: str = "text") -> DataFrame:
    """One row a line with its number from 0."""
    plain = F.replace(F.replace(F.col(text), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return df.select("*", F.posexplode(F.split(plain, "\n", -1)).alias("line_no", "line")).drop(text)


def parse_transcript(df: DataFrame, job: str, text: str = "text") -> DataFrame:
    """SRC03: turns (job, index, t_start, t_end, stamp, speaker, text, raw, is_preamble, chars) of transcripts, each a text."""
    return parse_lines(lines(df.select(job, text), text), job, None)


def parse_lines(df: DataFrame, job: str, rows: int | None = ROWS) -> DataFrame:
    """SRC03: the same of transcripts that come line by line (job, line_no, line), however long they are."""
    each = df.select(job, "line_no", "line").withColumn("head", match_header(F.col("line")))
    scan = Scan(each, job, "line_no", rows=rows).running(F.col("head").isNotNull().cast("long"), "block")
    block = storage.cut(scan.rows()) if scan.cut else scan.rows()  # headers are looked for once, whatever the passes behind
    body = F.when(F.col("head").isNull(), F.col("line")).when(F.col("head.rest") != "", F.col("head.rest"))
    ordered = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct("line_no", c.alias("x"))))), lambda x: x["x"]), "\n")
    edge = lambda c: F.trim(c, F.lit("\n"))
    turns = block.groupBy(job, "block").agg(F.max_by("head", F.when(F.col("head").isNotNull(), F.col("line_no"))).alias("head"), edge(ordered(F.col("line"))).alias("raw"), edge(ordered(body)).alias("body"))
    turns = turns.where((F.col("block") > 0) | (squash(F.col("raw")) != ""))
    inline = F.nullif(F.regexp_extract("body", rf"\[\s*({STAMP})\s*\]", 1), F.lit(""))
    own = F.when(F.col("block") == 0, F.lit(0.0)).otherwise(F.coalesce(parse_stamp(F.col("head.ts")), parse_stamp(inline)))
    known = Scan(turns.withColumn("_own", own), job, "block", rows=rows).last_known(F.col("_own"), "_known").running(F.lit(1).cast("int"), "_n").rows().withColumn("t_start", F.coalesce("_known", F.lit(0.0)))
    trimmed = F.regexp_replace("body", r"^[\s\x{3000}]+|[\s\x{3000}]+$", "")
    return known.select(
        job, (F.col("_n") - 1).cast("int").alias("index"), "t_start", parse_stamp(F.col("head.te")).alias("t_end"), hhmmss(F.col("t_start")).alias("stamp"),
        F.coalesce("head.speaker", F.lit("")).alias("speaker"), F.when(F.col("block") == 0, F.col("raw")).otherwise(trimmed).alias("text"), "raw", (F.col("block") == 0).alias("is_preamble"), F.length("raw").alias("chars"),
    )


def fenced(df: DataFrame, job: str, rows: int | None = None) -> DataFrame:
    """WIN04: lines with is_fence and in_fence (a fence line itself is out of what it opens). rows: as in Scan; the lines of one text are few."""
    flag = F.ltrim(F.col("line")).substr(1, 3).isin(*FENCES)
    marked = Scan(df.withColumn("is_fence", flag), job, "line_no", rows=rows).running(F.col("is_fence").cast("int"), "_fences").rows()
    return marked.withColumn("in_fence", (F.col("_fences") % 2 == 1) & ~F.col("is_fence")).drop("_fences")


def strip_stamps(df: DataFrame, job: str, only: Column | None = None) -> DataFrame:
    """FN20: lines (those of only) without inline stamps and the holes they leave, outside fences; removed counts runs.

    Each stamp becomes a mark, with the ticks and parentheses at it, marks that are joined become one, and marks go.
    """
    at = fenced(df, job)
    marked = F.regexp_replace("line", rf"\[{STAMP}\]", HOLE)
    for left, right in (("`", "`"), ("[（(]", "[)）]")):
        marked = F.regexp_replace(marked, f"{left}?{HOLE}{right}?", HOLE)
    marked = F.regexp_replace(marked, rf"{HOLE}(?:\s*[{JOINERS}]\s*{HOLE})+", HOLE)
    touch = ~F.col("is_fence") & ~F.col("in_fence") & F.contains(marked, F.lit(HOLE)) & (F.lit(True) if only is None else only)
    # Parentheses left empty, blanks that meet, and blanks before a sign that closes.
    clean = F.regexp_replace(F.replace(marked, F.lit(HOLE), F.lit("")), r"[（(]\s*[)）]", "")
    clean = F.regexp_replace(clean, r"[ \t]{2,}", " ")
    for sign in CLOSERS:
        clean = F.replace(F.replace(clean, F.lit(" " + sign), F.lit(sign)), F.lit("\t" + sign), F.lit(sign))
    return at.withColumn("removed", F.when(touch, F.length(marked) - F.length(F.replace(marked, F.lit(HOLE), F.lit("")))).otherwise(0)).withColumn("line", F.when(touch, F.rtrim(clean)).otherwise(F.col("line")))


def is_quoted(line: Column) -> Column:
    """A line of a quotation block: a mark behind three blanks at most."""
    return F.startswith(F.ltrim(line), F.lit(">")) & (F.length(line) - F.length(F.ltrim(line)) <= 3)


def strip_runs(df: DataFrame, job: str, banned: list[str], unquoted: list[str] = [], quote: Callable[[Column], Column] = is_quoted, only: Column | None = None) -> DataFrame:  # noqa: B006
    """FN21: without the whole runs of quoted lines (of those of only) that hold a banned term, outside fences; terms in unquoted count outside quotation marks."""
    at = fenced(df, job)
    w = Window.partitionBy(job).orderBy("line_no")
    is_quote = quote(F.col("line")) & ~F.col("in_fence") & ~F.col("is_fence") & (F.lit(True) if only is None else only)
    bare = F.col("line")
    for a, b in QUOTED:
        bare = F.regexp_replace(bare, f"{a}[^{b}]*{b}", "")
    hit = F.lit(False)
    for term in banned:
        hit = hit | F.col("line").contains(term)
    for term in unquoted:
        hit = hit | bare.contains(term)
    runs = at.withColumn("_q", is_quote).withColumn("_new", (~F.col("_q").eqNullSafe(F.lag("_q").over(w))).cast("int")).withColumn("_run", F.sum("_new").over(w))
    bad = F.max((F.col("_q") & hit).cast("int")).over(Window.partitionBy(job, "_run"))
    return runs.withColumn("_bad", bad).where(~(F.col("_q") & (F.col("_bad") == 1))).drop("_q", "_new", "_run", "_bad")


def heading_level(line: Column) -> Column:
    """1 to 6 for a heading line, else 0."""
    plain = F.ltrim(line)
    hashes = F.length(plain) - F.length(F.ltrim(plain, F.lit("#")))
    return F.when(hashes.between(1, 6) & F.substr(plain, hashes + 1, F.lit(1)).isin(" ", "\t") & (F.length(line) - F.length(plain) <= 3), hashes).otherwise(0)


def states_limit(inside: Column) -> Column:
    """Whether words in parentheses only state how much is wanted: a bound with a number, or a range of units."""
    plain = F.regexp_replace(inside, r"\s+", "")
    number = F.regexp_replace(plain, f"[0-9]+[{UNITS}]?", "#")
    return number.isin(*(f"#{b}" for b in BOUNDS[:3]), *(f"{b}#" for b in BOUNDS[3:])) | F.regexp_like(plain, F.lit(f"^[0-9]+[-–~至][0-9]+[{UNITS}]$"))


def strip_heading_limits(df: DataFrame) -> DataFrame:
    """FN22: heading lines without parentheses that state a limit, outside fences where lines tell them; limits counts them."""
    line = F.col("line")
    groups = F.filter(F.regexp_extract_all(line, F.lit(r"[（(][^（）()]*[)）]"), F.lit(0)), lambda g: states_limit(_from(g, 2, F.length(g) - 2)))
    clean = F.aggregate(groups, line, lambda t, g: F.replace(t, g, F.lit("")))
    open_ = ~(F.col("in_fence") | F.col("is_fence")) if "in_fence" in df.columns else F.lit(True)
    touch = (heading_level(line) > 0) & open_ & (F.size(groups) > 0)
    return df.withColumn("limits", F.when(touch, F.size(groups)).otherwise(0)).withColumn("line", F.when(touch, F.rtrim(F.regexp_replace(clean, r"[ \t]{2,}", " "))).otherwise(line))


def quoted(line: Column) -> Column:
    """FN27: what a quotation line holds between its marks, `> [stamp] name：「text」`, stamp and name being optional; null for others."""
    plain = F.regexp_replace(line, r"^[\s\x{3000}]+|[\s\x{3000}]+$", "")
    at = F.instr(plain, "「")
    lead = _bare(F.regexp_replace(_bare(_from(plain, 2, at - 2)), r"^\[[0-9:]+\]", ""))
    named = F.endswith(F.translate(lead, "：", ":"), F.lit(":")) & (F.instr(F.translate(lead, "：", ":"), ":") == F.length(lead)) & (F.length(lead) <= NAME + 1)
    fine = F.startswith(plain, F.lit(">")) & (at > 0) & F.endswith(plain, F.lit("」")) & ((lead == "") | named) & (F.length(plain) > at + 1)
    return F.when(fine, F.trim(_from(plain, at + 1, F.length(plain) - at - 1)))


# Kinds of note that keep their stamps, and their words on how they were made; those words, at any place and outside quotation marks.
STAMPED, EXPLAINED = ("transcript_clean", "note_interview"), ("transcript_clean",)
EXPLAINS = ["講者對應為推測", "講者對應係推測", "講者對應仍為推測", "逐句歸屬", "未經使用者確認"]
EXPLAINS_UNQUOTED = ["聲紋分群", "聲紋群", "講者標籤", "speaker 標籤", "speaker標籤", "依內容推斷", "依內容推測"]


def scrub(notes: DataFrame, job: str, kind: str = "kind", text: str = "text") -> DataFrame:
    """FN23: notes (job, kind, text) without stamps, disclaimers and heading limits, as far as their kind goes without them; removed counts stamps, lines and limits."""
    own = lines(notes.select(job, kind, text), text)
    before = own.groupBy(job).agg(F.count("*").alias("_n"))
    stamps = strip_stamps(own, job, ~F.col(kind).isin(*STAMPED)).drop("is_fence", "in_fence")
    runs = strip_runs(stamps, job, EXPLAINS, EXPLAINS_UNQUOTED, only=~F.col(kind).isin(*EXPLAINED))
    clean = strip_heading_limits(runs)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"])
    out = clean.groupBy(job).agg(F.array_join(ordered, "\n").alias("text"), F.sum(F.col("removed") + F.col("limits")).alias("_r"), F.count("*").alias("_m"))
    return before.join(out, job, "left").select(job, F.coalesce("text", F.lit("")).alias("text"), (F.coalesce("_r", F.lit(0)) + F.col("_n") - F.coalesce("_m", F.lit(0))).alias("removed"))


def spoken(transcripts: DataFrame, job: str, text: str = "text") -> DataFrame:
    """SRC13: what is said in transcripts (job, text), squashed, and how it was got: by turns if there are two or more, else the whole file."""
    said = parse_transcript(transcripts, job, text).where("not is_preamble")
    joined = said.groupBy(job).agg(F.count("*").alias("n"), squash(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", "text"))), lambda t: t["text"]), " ")).alias("said"))
    enough = F.coalesce(F.col("n") >= 2, F.lit(False))
    return transcripts.select(job, text).join(joined, job, "left").select(job, F.when(enough, F.col("said")).otherwise(squash(F.col(text))).alias("said"), F.when(enough, "turns").otherwise("raw").alias("source"))


def rejoin(df: DataFrame, job: str) -> DataFrame:
    """Lines back to one text a job."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"])
    return df.groupBy(job).agg(F.array_join(ordered, "\n").alias("text"))


def without_stamp(text: Column) -> Column:
    """A turn's text without the stamp that it begins with."""
    return F.regexp_replace(text, rf"^[\s`]*\[\s*{STAMP}\s*\][\s`\x{{3000}}]*", "")


def render_quote(stamp: Column, speaker: Column, text: Column) -> Column:
    """FN08: a quotation line, with its stamp unless that is null."""
    who = F.coalesce(F.nullif(speaker, F.lit("")), F.lit("未知講者"))
    return F.concat(F.lit("> "), F.coalesce(F.concat(F.lit("["), stamp, F.lit("] ")), F.lit("")), who, F.lit("：「"), text, F.lit("」"))


def quote_lines(notes: DataFrame, job: str, text: str = "text") -> DataFrame:
    """FN27: (job, line_no from 1, quote) of the lines of notes that quote."""
    return notes.select(job, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).select(job, (F.col("line_no") + 1).alias("line_no"), quoted(F.col("line")).alias("quote")).where("quote is not null")


#: Characters of distinct quotations that one automaton holds, about 100 bytes each; beyond, quotations and texts meet in an index.
AUTOMATON = 1_000_000


def traced(quotes: DataFrame, texts: DataFrame, job: str | None = None) -> DataFrame:
    """JN09, FLT05: (quote_id, text_id) of quotes (quote_id, quote) and the texts (text_id, text) that hold them, white space squashed.

    With a job both sides meet by job, which is kept. Without, texts stay where they are and run through an automaton of all
    quotes, whatever their length or script, if these have AUTOMATON characters at most; else they meet in an index of
    substrings. Blank quotes are traced to nothing.
    """
    q = quotes.withColumn("_q", squash(F.col("quote"))).where(F.col("_q") != "")
    t = texts.withColumn("_t", squash(F.col("text")))
    if job:
        return q.join(t, job).where(F.contains("_t", "_q")).drop("_q", "_t")
    q, t = q.select("quote_id", "_q"), t.select("text_id", "_t")
    needles = q.select("_q").distinct().withColumn("_n", F.length("_q"))
    if (needles.agg(F.sum("_n")).first()[0] or 0) > AUTOMATON:
        return substrings.held(q.withColumnRenamed("_q", "quote"), t.withColumnRenamed("_t", "text"))
    some = texts.sparkSession.sparkContext.broadcast([r["_q"] for r in needles.select("_q").collect()])  # AUTOMATON characters at most
    schema = f"text_id {texts.schema['text_id'].dataType.simpleString()}, _q string"
    return q.join(t.mapInArrow(substrings.matcher(some), schema), "_q").select("quote_id", "text_id")


def excerpts(df: DataFrame, keys: list[str], limit: int = 160) -> DataFrame:
    """FN07: of each text (keys, text, focus) the whole, squashed, if it fits; else the run of sentences nearest to the focus.

    Only runs that fit are looked at: from each sentence on, those that end within the limit; without one it is the first
    sentence, cut. Bigrams are of lower-case characters, each by itself. Null texts give no row.
    """
    t = df.select(*keys, squash(F.col("text")).alias("t"), "focus").where("t is not null")
    return t.select(*keys, F.arrow_udf(nearest(limit), "string")("t", "focus").alias("excerpt"))


def nearest(limit: int) -> Callable:
    """A function: (texts, focuses) -> excerpts. A run's bigrams are those of the run that is a sentence shorter and its last sentence's."""
    noise, ending = NOISE.replace(r"\x{3000}", "\u3000"), f"[{ENDINGS}]"

    def run(texts, focuses):
        import re

        import pyarrow as pa

        noises, endings = re.compile(noise, re.ASCII), re.compile(ending)

        def bare(text: str) -> str:
            return noises.sub("", text).replace("Σ", "σ").replace("İ", "i").lower()

        def excerpt(t: str, near: set[str]) -> str:
            ends = [m.end() for m in endings.finditer(t)]
            if not ends or ends[-1] < len(t):
                ends.append(len(t))
            begins = [0, *ends[:-1]]
            parts = [bare(t[b:e]) for b, e in zip(begins, ends)]
            at = [0]
            for x in parts:
                at.append(at[-1] + len(x))
            low = "".join(parts)
            pairs = [low[i : i + 2] for i in range(len(low) - 1)]
            best = None
            for a, begin in enumerate(begins):
                seen, both = set(), set()
                for e in range(a, len(ends)):
                    if ends[e] - begin > limit:
                        break
                    new = pairs[max(at[a], at[e] - 1) : max(at[e + 1] - 1, 0)]
                    seen.update(new)
                    both.update(near.intersection(new))
                    own, common = len(seen), len(both)
                    if at[e + 1] - at[a] == 1:
                        own, common = 1, int(low[at[a]] in near)
                    sim = common / (own + len(near) - common) if own and near else 0.0
                    best = max(best or (-1.0,), (sim, ends[e] - begin, -a))
            if best is None:
                return t[: min(ends[0], limit)]
            return t[begins[-best[2]] : begins[-best[2]] + best[1]].strip(" ")

        out, last, near = [], None, set()
        for t, focus in zip(texts.to_pylist(), focuses.to_pylist()):
            if len(t) > limit:
                if focus != last:
                    last, low = focus, bare(focus or "")
                    near = {low} if len(low) == 1 else {low[i : i + 2] for i in range(len(low) - 1)}
                t = excerpt(t, near)
            out.append(t)
        return pa.array(out, pa.string())

    return run
