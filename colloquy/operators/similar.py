"""JN10, JN11, FN06: pairs of labels whose bigrams agree to a share, without comparing all with all.

Bigrams are put in one order, rare ones first. Labels x and y of Jaccard similarity t or more share a bigram among the first
|x| - ceil(t |x|) + 1 of x and the first |y| - ceil(t |y|) + 1 of y, and neither is shorter than t times the other. So labels
meet by job and one of their first, rare, bigrams; only lengths that may agree go on; each pair is verified once, on its whole
sets. How rare bigrams are is counted over both sides; the COMMON most frequent ones are ranked and broadcast, the others come
before them, so that what is broadcast is bounded.

Defined cases: labels are compared as FN06 says, without case, punctuation and white space; an empty or null label is similar
to none; a null job is a job; rows that share a job and an id are rows of their own; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.text import bigrams, jaccard, normalize_label
from colloquy.operators.storage import cut

COMMON = 4096


def _sets(df: DataFrame, job: str) -> DataFrame:
    """(n, job, id, grams) with a number a row."""
    grams = bigrams(normalize_label(F.coalesce("label", F.lit(""))))
    return df.select(F.struct(F.col(job).alias("v")).alias("job"), "id", grams.alias("grams")).where(F.size("grams") > 0).withColumn("n", F.monotonically_increasing_id())


def _first(sets: DataFrame, often: DataFrame, least: float) -> DataFrame:
    """(job, n, size, gram) for the first bigrams of each row."""
    each = sets.select("job", "n", F.size("grams").alias("size"), F.explode("grams").alias("gram"))
    ranked = each.join(F.broadcast(often), "gram", "left").groupBy("job", "n", "size").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("rank", F.lit(0)).alias("rank"), F.xxhash64("gram").alias("h"), "gram"))).alias("ordered"))
    return ranked.select("job", "n", "size", F.explode(F.slice("ordered", F.lit(1), F.col("size") - _needed(F.col("size"), least) + 1)).alias("g")).select("job", "n", "size", F.col("g.gram").alias("gram"))


def _needed(size: Column, least: float) -> Column:
    """ceil(least * size), never too much by a rounding."""
    return F.greatest(F.ceil(size * least - 1e-9), F.lit(1)).cast("int")


def similar(left: DataFrame, right: DataFrame, job: str, least: float = 0.5) -> DataFrame:
    """(job, a, b, similarity) for rows (job, id, label) of both sides in one job whose similarity is least (above 0) or more."""
    x, y = cut(_sets(left, job)), cut(_sets(right, job))
    counts = x.select(F.explode("grams").alias("gram")).unionAll(y.select(F.explode("grams").alias("gram"))).groupBy("gram").agg(F.count("*").alias("rank"))
    often = counts.orderBy(F.desc("rank"), "gram").limit(COMMON)
    a, b = (_first(s, often, least).select("job", F.col("n").alias(n), F.col("size").alias(f"{n}_size"), "gram") for s, n in ((x, "x"), (y, "y")))
    fits = (F.col("x_size") >= _needed(F.col("y_size"), least)) & (F.col("y_size") >= _needed(F.col("x_size"), least))
    met = a.join(b, ["job", "gram"]).where(fits).select("x", "y").distinct()
    whole = met.join(x.select(F.col("n").alias("x"), "job", F.col("id").alias("a"), F.col("grams").alias("s")), "x").join(y.select(F.col("n").alias("y"), F.col("id").alias("b"), F.col("grams").alias("t")), "y")
    found = whole.withColumn("similarity", jaccard(F.col("s"), F.col("t"))).where(F.col("similarity") >= least)
    return found.select(F.col("job.v").alias(job), "a", "b", "similarity")


def unmatched(topics: DataFrame, titles: DataFrame, job: str, least: float = 0.5) -> DataFrame:
    """JN10: topics (job, id, label) to which no title (job, label) of the job is similar."""
    found = similar(topics, titles.withColumn("id", F.lit(0)), job, least).select(F.col(job).alias("_job"), F.col("a").alias("_id")).distinct()
    return topics.join(found, F.col(job).eqNullSafe(F.col("_job")) & F.col("id").eqNullSafe(F.col("_id")), "left_anti")
