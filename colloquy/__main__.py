"""Command line: chunk transcripts, check and repair notes, list and run the named queries.

    python -m colloquy chunk FOLDER --max-chars 6000 --overlap 2 [--out PATH]
    python -m colloquy verify TRANSCRIPTS NOTES [--fix PATH]
    python -m colloquy evaluate TRANSCRIPTS NOTES [--worst JOB] [--out PATH]
    python -m colloquy export TRANSCRIPTS BUNDLES
    python -m colloquy jobs ARCHIVE [--out PATH]
    python -m colloquy state STATES [JOB [--set STATE] [--note TEXT]]
    python -m colloquy queries
    python -m colloquy run QUERY TABLES [--out PATH]

TRANSCRIPTS and NOTES are folders with one folder a job. Results go to the screen as JSON lines, or to a path as Parquet. BUNDLES and
STATES are tables by versions: an export replaces the bundles, a state that is set is added to the states.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.functions import text as T
from colloquy.functions.text import squash
from colloquy.operators import jobs, lines, render, review, turns
from colloquy.sources import files, versions
from colloquy.streaming.jobs import STATES


def chunked(spark: SparkSession, folder: str, budget: int, overlap: int) -> DataFrame:
    """Chunks of each transcript: (job_id, chunk, own turns, context turns, characters)."""
    parsed = lines.parse_transcript(files.transcripts(spark, folder), "job_id").where("not is_preamble")
    packed = turns.pack(parsed, "job_id", "index", F.col("chars"), budget)
    placed = turns.overlap_context(packed, "job_id", "index", overlap)
    own = ~F.col("is_overlap")
    return placed.groupBy("job_id", "chunk").agg(F.count_if(own).alias("turns"), F.count_if("is_overlap").alias("context"), F.sum(F.when(own, F.col("chars"))).alias("chars"), F.min(F.when(own, F.col("stamp"))).alias("begins"))


def checked(spark: SparkSession, transcripts: str, notes: str) -> DataFrame:
    """Notes (job_id, text) with what was said in their job."""
    said = lines.parse_transcript(files.transcripts(spark, transcripts), "job_id").where("not is_preamble")
    hay = said.groupBy("job_id").agg(squash(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", "text"))), lambda t: t["text"]), " ")).alias("hay"))
    return files.transcripts(spark, notes).join(hay, "job_id", "left").withColumn("hay", F.coalesce("hay", F.lit("")))


def scored(spark: SparkSession, transcripts: str, notes: str) -> DataFrame:
    """AGG05-07, TOP04: notes with their scores, the best first."""
    text, hay = F.col("text"), F.col("hay")
    quotes, rows = T.quotations(text), F.split("text", "\n")
    counts = review.literals(text)
    has = lambda h: F.exists(review.chapter_titles(rows), lambda p: F.contains(p, F.lit(h))).cast("int")
    present = sum((has(render.HEADINGS[k]) for k in render.SKELETONS["note_general"]), F.lit(0))
    m = checked(spark, transcripts, notes).select(
        F.col("job_id").alias("job"), F.length("hay").alias("source_chars"), F.length(squash(text)).alias("note_chars"), F.size(quotes).alias("quotes"), F.size(F.filter(quotes, lambda q: F.contains(hay, squash(q)))).alias("traceable"),
        present.alias("present"), counts["topics"].alias("topics"), F.lit(0).alias("simplified"), counts["stamps"].alias("stamps"),
    )
    return review.evaluate(review.note_scores(m))


def exported(spark: SparkSession, transcripts: str) -> DataFrame:
    """SNK09: a bundle a job, of what its transcript says; speakers are numbered as they begin to speak."""
    said = lines.parse_transcript(files.transcripts(spark, transcripts), "job_id").where("not is_preamble")
    first = said.groupBy("job_id", F.col("speaker").alias("name")).agg(F.min("index").alias("first"))
    who = first.select("job_id", "name", (F.row_number().over(Window.partitionBy("job_id").orderBy("first")) - 1).alias("speaker"))
    spoken = said.withColumnRenamed("speaker", "name").join(who, ["job_id", "name"])
    segments = spoken.select("job_id", F.col("index").cast("long").alias("i"), "speaker", F.col("t_start").alias("start"), F.coalesce("t_end", "t_start").alias("end"), "text")
    joined = segments.groupBy("job_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda r: r["text"]), "\n").alias("raw"))
    none = lambda kind: F.lit(None).cast(kind)
    jobs_ = joined.select("job_id", F.col("job_id").alias("title"), none("string").alias("client"), none("string").alias("preset"), none("string").alias("language"), none("long").alias("minutes"), none("long").alias("expected"), "raw", none("string").alias("cleaned"), none("string").alias("summary"), *(F.array().cast("array<string>").alias(c) for c in ("decisions", "actions", "topics")))
    guesses = who.select("job_id", F.concat(F.lit("講者"), F.col("speaker") + 1).alias("label"), F.col("name").alias("guess"), F.lit("").alias("confidence"))
    risks = spark.createDataFrame([], "job_id string, pos long, label string, mitigation string, detail string, raised_by string")
    return jobs.bundle(jobs_, segments, guesses, risks, "job_id")


#: A job's state at a time, and what was said about it.
STATE = "job_id string, ts timestamp, state string, note string"


def states(spark: SparkSession, path: str) -> DataFrame:
    return versions.read(spark, path) if versions.folders(spark, path) else spark.createDataFrame([], STATE)


def show(df: DataFrame, out: str | None) -> None:
    if out:
        df.write.parquet(out)
    else:
        for row in df.toJSON().toLocalIterator():
            print(row)


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="colloquy", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="what", required=True)
    c = sub.add_parser("chunk")
    c.add_argument("folder")
    c.add_argument("--max-chars", type=int, default=6000)
    c.add_argument("--overlap", type=int, default=2)
    v = sub.add_parser("verify")
    v.add_argument("transcripts")
    v.add_argument("notes")
    v.add_argument("--fix")
    e = sub.add_parser("evaluate")
    e.add_argument("transcripts")
    e.add_argument("notes")
    e.add_argument("--worst")
    x = sub.add_parser("export")
    x.add_argument("transcripts")
    x.add_argument("bundles")
    j = sub.add_parser("jobs")
    j.add_argument("archive")
    t = sub.add_parser("state")
    t.add_argument("states")
    t.add_argument("job", nargs="?")
    t.add_argument("--set", dest="new", choices=STATES)
    t.add_argument("--note", default="")
    sub.add_parser("queries")
    r = sub.add_parser("run")
    r.add_argument("query")
    r.add_argument("tables")
    for s in (c, r, e, j):
        s.add_argument("--out")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("colloquy").getOrCreate()
    if a.what == "chunk":
        show(chunked(spark, a.folder, a.max_chars, a.overlap).orderBy("job_id", "chunk"), a.out)
    elif a.what == "verify":
        notes = checked(spark, a.transcripts, a.notes)
        quotes = lines.quote_lines(notes.withColumn("job", F.struct("job_id", "hay")), "job")
        show(quotes.where(~F.contains("job.hay", squash(F.col("quote")))).select("job.job_id", "line_no", "quote"), None)
        if a.fix:
            review.autofix(notes, "job_id", {}).write.parquet(a.fix)
    elif a.what == "evaluate":
        rows = scored(spark, a.transcripts, a.notes)
        show(rows, a.out)
        if a.worst:
            show(review.separation(rows, a.worst), None)
    elif a.what == "export":
        versions.replace(exported(spark, a.transcripts), a.bundles)
    elif a.what == "jobs":
        show(jobs.ordered(files.archive(spark, a.archive, "state string, title string, date string").withColumn("needs_user", F.col("state") == "awaiting_answers")), a.out)
    elif a.what == "state":
        if a.job and a.new:
            new = spark.createDataFrame([(a.job, a.new, a.note)], "job_id string, state string, note string").select("job_id", F.current_timestamp().alias("ts"), "state", "note")
            versions.add(new, a.states)
        held = states(spark, a.states).where(F.lit(True) if a.job is None else F.col("job_id") == a.job)
        show(review.state_history(held, "job_id", "ts", "state").orderBy("job_id", "back"), None)
    else:
        from colloquy.plans import catalog, giants, merges, notes, outputs, reports  # noqa: F401  these add their queries to the catalog

        if a.what == "queries":
            print("\n".join(sorted(catalog.QUERIES)))
        else:
            show(catalog.QUERIES[a.query](spark, a.tables), a.out)


if __name__ == "__main__":
    main()
