"""JN05: written sections beside the topics they are about, and only failed ones written anew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Why a row is as it is: both sides are there, the section failed, nobody wrote one, nobody asked for one.
REASONS = ("written", "failed", "missing", "unknown")


def renewed(sections: DataFrame, redone: DataFrame, job: str) -> DataFrame:
    """Sections (job, topic_id, heading, body, failed) with those of redone in place of theirs; redone ones that stand for none count for nothing.

    Of several redone sections of one topic the one that didn't fail, then the one of the least heading, counts.
    """
    fields = [c for c in sections.columns if c not in (job, "topic_id")]
    best = redone.groupBy(F.col(job).alias("_job"), F.col("topic_id").alias("_topic")).agg(F.min(F.struct(F.coalesce("failed", F.lit(True)).alias("f"), "heading", F.struct(*fields).alias("new")))["new"].alias("_new"))
    own = F.col(job).eqNullSafe(F.col("_job")) & F.col("topic_id").eqNullSafe(F.col("_topic"))
    put = lambda c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c)
    return sections.join(best, own, "left").select(*(put(c) if c in fields else F.col(c) for c in sections.columns), F.col("_new").isNotNull().alias("renewed"))


def with_topics(topics: DataFrame, sections: DataFrame, job: str) -> DataFrame:
    """Topics (job, topic_id, ...) and sections, full outer, with the reason of each row; a topic that comes twice, or has two sections, gives a row each."""
    a = topics.withColumn("_asked", F.lit(True))
    b = sections.select(F.col(job).alias("_job"), F.col("topic_id").alias("_topic"), *(c for c in sections.columns if c not in (job, "topic_id"))).withColumn("_written", F.lit(True))
    both = a.join(b, F.col(job).eqNullSafe(F.col("_job")) & F.col("topic_id").eqNullSafe(F.col("_topic")), "full_outer")
    reason = F.when(F.col("_asked").isNull(), "unknown").when(F.col("_written").isNull(), "missing").when(F.coalesce("failed", F.lit(True)), "failed").otherwise("written")
    key = lambda c, d: F.when(F.col("_asked").isNull(), F.col(d)).otherwise(F.col(c)).alias(c)
    rest = [c for c in (*topics.columns, *sections.columns) if c not in (job, "topic_id")]
    return both.select(key(job, "_job"), key("topic_id", "_topic"), *rest, reason.alias("reason"))


def to_redo(joined: DataFrame, job: str) -> DataFrame:
    """(job, topic_id) of the sections that are to be written anew: those that failed."""
    return joined.where("reason = 'failed'").select(job, "topic_id").distinct()
