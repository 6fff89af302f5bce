"""Interval joins and statistics of speaker segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.text import is_absurd


def dominant_overlap(probes: DataFrame, segments: DataFrame, job: str, width: float) -> DataFrame:
    """JN01: for each probe (job, probe, start, end) the speaker of the one segment (job, i, start, end, speaker) it overlaps most.

    The first segment wins ties; without overlap the speaker is null. Both sides are dealt
    into buckets of the given width, so a long job is a join on (job, bucket), not all against all.
    """
    bucket = lambda a, b: F.explode(F.sequence(F.floor(a / width), F.greatest(F.floor(a / width), F.floor(b / width))))
    p = probes.select(job, "probe", F.col("start").alias("ps"), F.col("end").alias("pe"), bucket(F.col("start"), F.col("end")).alias("bucket"))
    s = segments.select(job, "i", F.col("start").alias("ss"), F.col("end").alias("se"), "speaker", bucket(F.col("start"), F.col("end")).alias("bucket"))
    overlap = F.least("pe", "se") - F.greatest("ps", "ss")
    met = p.join(s, [job, "bucket"]).where((F.col("ss") < F.col("pe")) & (F.col("se") > F.col("ps"))).withColumn("overlap", overlap).where("overlap > 0")
    best = met.groupBy(job, "probe").agg(F.max_by(F.struct("speaker", "overlap"), F.struct(F.col("overlap"), (-F.col("i")).alias("i"))).alias("best"))
    return probes.join(best, [job, "probe"], "left").select(probes["*"], F.col("best.speaker").alias("speaker"), F.col("best.overlap").alias("overlap"))


def segment_stats(segments: DataFrame, job: str, order: str, speaker: str, start: str, end: str, short: float = 0.6, brief: float = 1.0, minute: float = 60.0) -> DataFrame:
    """AGG01-03: span, speakers, segments, switches, short ones, single-segment speakers, median and rates."""
    w = Window.partitionBy(job).orderBy(order)
    size = F.col(end) - F.col(start)
    rows = segments.select(job, F.col(speaker).alias("s"), F.col(start).alias("a"), F.col(end).alias("b"), size.alias("d"), F.lag(speaker).over(w).alias("p"), F.lag(F.lit(1)).over(w).alias("has"))
    main = rows.groupBy(job).agg(
        (F.max("b") - F.min("a")).alias("span"),
        F.countDistinct("s").alias("num_speakers"),
        F.count("*").alias("num_segments"),
        F.count_if(F.col("has").isNotNull() & ~F.col("s").eqNullSafe(F.col("p"))).alias("switches"),
        F.count_if(F.col("d") <= short).alias("short"),
        F.count_if(F.col("d") <= brief).alias("brief"),
        F.percentile("d", F.lit(0.5)).alias("median"),
    )
    single = rows.groupBy(job, "s").agg(F.count("*").alias("n")).groupBy(job).agg(F.count_if(F.col("n") == 1).alias("singletons"))
    rate = lambda c: F.round(F.coalesce(F.try_divide(F.col(c), F.col("span") / minute), F.lit(0.0)), 3)
    return main.join(single, job).withColumn("segments_per_min", rate("num_segments")).withColumn("switches_per_min", rate("switches")).withColumn("short_ratio", F.round(F.col("short") / F.col("num_segments"), 3))


def score(expected: Column) -> Column:
    """AGG04: the penalty of statistics against the expected number of speakers; smaller is better."""
    n = F.col("num_speakers")
    off = F.abs(n - expected) * F.when(n >= expected, 300).otherwise(180) + F.when(is_absurd(n, expected), 5000).otherwise(0)
    penalty = F.when(expected > 0, off).otherwise(0)
    return F.round(penalty + F.col("singletons") * 90 + F.col("segments_per_min") * 6 + F.col("switches_per_min") * 5 + F.col("short_ratio") * 120 - F.least("median", F.lit(8.0)) * 3, 3)


def best_candidate(candidates: DataFrame, job: str, expected: Column, ordinal: str) -> DataFrame:
    """TOP03: the candidate of least score; exact counts, fewer singletons, fewer switches and the first win ties."""
    exact = F.when((expected > 0) & (F.col("num_speakers") != expected), 1).otherwise(0)
    w = Window.partitionBy(job).orderBy("score", exact, "singletons", "switches_per_min", ordinal)
    return candidates.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def fallback_plan(jobs: DataFrame, expected: str, stereo: str, most: int = 8) -> DataFrame:
    """GRP12: what to try again: mono with the expected number of clusters and one more, on stereo each side too."""
    one = lambda channel, n: F.struct(F.lit(channel).alias("channel"), F.greatest(F.lit(1), F.least(F.lit(most), n)).alias("clusters"))
    e = F.col(expected)
    tries = F.concat(F.array(one("mono", e), one("mono", e + 1)), F.when(F.col(stereo), F.array(one("left", e), one("right", e))).otherwise(F.array().cast("array<struct<channel:string,clusters:int>>")))
    plan = jobs.where(e > 0).select("*", F.posexplode(F.array_distinct(tries)).alias("ordinal", "try"))
    return plan.select("*", "try.channel", "try.clusters", F.concat_ws("-k", "try.channel", F.col("try.clusters").cast("string")).alias("candidate_id")).drop("try")
