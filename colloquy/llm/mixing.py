"""Operator 10: mixing sources to target weights, by DataFrame functions alone.

Words are summed by source, each source gets a target and so a repetition rate, and a
document is emitted floor(rate) times plus one copy drawn by a seeded hash with
probability equal to the rate's fraction.

Sources in order of code points (null last) weigh WEIGHTS in turn. A target is the
source's share of all words, but MOST times its own words at most; what is above is
shared again by weight. With targets min(MOST * size, level * weight) that is one level, found by
ordering sources by MOST * size / weight. Of SEEDS hash seeds a source uses the one whose draw
comes nearest to its target, from sums taken in one aggregation.

Defined cases: a null or empty text has no words and is emitted like others; a text is measured
whole, whatever its length; the null source is a source; sources without words have target 0 and emit
nothing; of seeds that come equally near the smallest is used; repeated rows with the same id and text are
drawn alike; a null id draws by its text; an empty table gives an empty result; the mix's other columns
come back as they were, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import WORD, cut, free_name, join_hot

WEIGHTS, MOST, SEEDS = (5, 2, 1), 3, 16
#: Rows up to which the table of sources is broadcast; beyond it is joined by shuffle.
BROADCAST_ROWS = 10_000


def size(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def digest(text: Column) -> Column:
    """The text digest that enters the draw; null counts as empty."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def draw(seed: Column | int, key: Column, text_digest: Column) -> Column:
    """A number in [0, 1) from 52 bits of the digest of a seed, a document's id and its text digest."""
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    bits = F.substring(F.md5(F.concat_ws(":", seed.cast("string"), F.coalesce(key.cast("string"), F.lit("")), text_digest).cast("binary")), 1, 13)
    return F.conv(bits, 16, 10).cast("long") / F.lit(float(1 << 52))


def targets(sums: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target, rate, from sums (source, source_size), and its column rows, if it has one.

    The windows run over sources, one row each, never over documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sums.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(most)))
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    # The level if this source and those of larger ratio are the ones not stopped.
    s = s.withColumn("level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))
    s = s.withColumn("level", F.first(fits, ignorenulls=True).over(whole))
    s = s.withColumn("target", F.least("most", F.coalesce(F.col("level") * F.col("weight"), "most")))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    return s.select("source", "source_size", "target", rate.alias("rate"), *(["rows"] if "rows" in sums.columns else []))


def by_source(rows: DataFrame, sources: DataFrame, source_column: str, n: int, total: int) -> DataFrame:
    """rows with the columns of their source, from a table of n sources (source, rows, ...); total rows.

    A small table is broadcast; of a larger one only the sources that many rows have, so no task holds a hot source.
    """
    if n <= BROADCAST_ROWS:
        small = F.broadcast(sources.drop("rows"))
        return rows.join(small, rows[source_column].eqNullSafe(small["source"])).drop(small["source"])
    name, none = free_name(rows, "_name"), free_name(rows, "_none")
    keyed = lambda df, c: df.withColumn(name, F.coalesce(c, F.lit(""))).withColumn(none, c.isNull())
    return join_hot(keyed(rows, F.col(source_column)), keyed(sources, F.col("source")).drop("source"), [name, none], "rows", total).drop(name, none)


def copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """id, size, source_size, target, copies, key (the draw's text digest), source, rate and seed, one row a document."""
    slim = cut(docs.select(F.col(id_column).alias("id"), F.col(source_column).alias("source"), size(F.col(text_column)).alias("size"), digest(F.col(text_column)).alias("key")))
    sums = cut(slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")))
    goal = cut(targets(sums))
    n, total = sums.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
    rated = by_source(slim, goal, "source", n, total)
    extra = lambda seed: draw(seed, F.col("id"), F.col("key")) < F.col("rate") - F.floor("rate")
    count = lambda seed: (F.floor("rate") + extra(seed).cast("int")).cast("long")
    tried = rated.groupBy("source").agg(F.count("*").alias("rows"), F.min("target").alias("goal"), *(F.sum(F.col("size") * count(k)).alias(f"s{k}") for k in range(SEEDS)))
    off = F.array(*(F.struct(F.abs(F.col(f"s{k}") - F.col("goal")).alias("off"), F.lit(k).alias("seed")) for k in range(SEEDS)))
    seeds = cut(tried.select("source", "rows", F.array_min(off)["seed"].alias("seed")))
    drawn = by_source(rated, seeds.withColumnRenamed("source", "of").select(F.col("of").alias("source"), "rows", "seed"), "source", n, total)
    return drawn.select("id", "size", "source_size", "target", "key", count(F.col("seed")).alias("copies"), "source", "rate", "seed")


def mixed(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """The documents, each as often as the mix takes it; columns as they came."""
    plan = copies(docs, id_column, text_column, source_column)
    rate, seed, copy = (free_name(docs, c) for c in ("_rate", "_seed", "_copy"))
    rates = cut(plan.groupBy("source").agg(F.max("rate").alias(rate), F.max("seed").alias(seed), F.count("*").alias("rows")))
    n, total = rates.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
    joined = by_source(docs, rates, source_column, n, total)
    times = F.floor(rate) + (draw(F.col(seed), F.col(id_column), digest(F.col(text_column))) < F.col(rate) - F.floor(rate)).cast("int")
    each = F.explode(F.sequence(F.lit(1), F.least(times, F.lit(MOST)).cast("int")))
    return joined.where(times > 0).withColumn(copy, each).drop(rate, seed, copy)


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """id, size, source_size, target, taken."""
    return copies(docs, id_column, text_column, source_column).select(F.col("id").alias(id_column), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
