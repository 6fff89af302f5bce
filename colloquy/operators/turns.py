"""Ordered grouping over turns: islands, packing under a budget, overlap context, splitting.

Every function works on a table of many jobs; a job is the unit of partitioning unless it is larger than a task may
be, which scans and packing cut; order is an explicit column, and nothing is gathered but a job's own rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.text import NOISE
from colloquy.operators.packing import pack  # noqa: F401  belongs to the turns
from colloquy.operators.scans import ROWS, Scan


def by(job: str, order: str) -> Window:
    return Window.partitionBy(job).orderBy(order)


def islands(df: DataFrame, job: str, order: str, key: Column, name: str = "island", rows: int | None = ROWS) -> DataFrame:
    """GRP03, WIN01, WIN03: runs of equal keys (null equals null), numbered from 0, in jobs of any size."""
    scan = Scan(df, job, order, rows=rows).previous(key, "_before")
    new = (F.col("_before").isNull() | ~key.eqNullSafe(F.col("_before.v"))).cast("long")
    return scan.running(new, "_run").rows().withColumn(name, F.col("_run") - 1).drop("_before", "_run")


def absorb_short(runs: DataFrame, job: str, order: str, key: str, duration: str, least: float) -> DataFrame:
    """GRP01: runs shorter than least join the run before them, as do runs of the speaker it has; the first never joins.

    runs: one row a run in order. Adds piece (from 0) and speaker of the piece.
    """
    w = by(job, order)
    first = F.lag(F.lit(1)).over(w).isNull()
    none = F.coalesce(F.col(key).cast("string"), F.lit("\x00"))
    # Window functions don't nest: flags first, then what looks back over them.
    flagged = runs.withColumn("_first", first).withColumn("_kept", F.when(F.col("_first") | (F.col(duration) >= least), none))
    before = F.last("_kept", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = flagged.withColumn("_before", before).withColumn("_start", F.col("_first") | ((F.col(duration) >= least) & (none != F.col("_before"))))
    pieces = starts.withColumn("piece", (F.sum(F.col("_start").cast("int")).over(w) - 1).cast("long"))
    own = F.first(key).over(Window.partitionBy(job, "piece").orderBy(order))
    return pieces.withColumn("piece_speaker", own).drop("_first", "_kept", "_before", "_start")


def chunk_rollup(packed: DataFrame, job: str, order: str, size: Column) -> DataFrame:
    """AGG16: turns, characters and range of each chunk."""
    return packed.groupBy(job, "chunk").agg(F.count("*").alias("turns"), F.sum(size).cast("long").alias("chars"), F.min(order).alias("first_turn"), F.max(order).alias("last_turn"))


def overlap_context(packed: DataFrame, job: str, order: str, k: int) -> DataFrame:
    """GRP05, WIN05: each chunk's turns with the k before it, flagged is_overlap."""
    position = F.row_number().over(by(job, order))
    placed = packed.withColumn("_p", position)
    begin = placed.groupBy(F.col(job).alias("_job"), F.col("chunk").alias("_chunk")).agg(F.min("_p").alias("_b"))
    context = placed.join(begin, (F.col(job) == F.col("_job")) & (F.col("_p") < F.col("_b")) & (F.col("_p") >= F.col("_b") - k)).withColumn("chunk", F.col("_chunk")).drop("_job", "_chunk", "_b", "_p").withColumn("is_overlap", F.lit(True))
    return placed.drop("_p").withColumn("is_overlap", F.lit(False)).unionByName(context)


def split_oversized(turns: DataFrame, group: list[str], order: str, size: Column, most: int) -> DataFrame:
    """GRP07, WIN08: a group above the size is cut into parts of equal numbers of turns."""
    w = Window.partitionBy(*group)
    total, n = F.sum(size).over(w), F.count("*").over(w)
    parts = F.when((total > most) & (n >= 2), F.greatest(F.lit(2), F.ceil(total / most))).otherwise(1)
    at = F.row_number().over(w.orderBy(order)) - 1
    return turns.withColumn("_per", F.ceil(n / parts)).withColumn("part", F.floor(at / F.col("_per")).cast("long")).drop("_per")


def keep_first(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """GRP08-10: the first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def carry_forward(df: DataFrame, job: str, order: str, column: str, name: str, start: Column, rows: int | None = ROWS) -> DataFrame:
    """WIN02: the last known value, start before any, in jobs of any size."""
    return Scan(df, job, order, rows=rows).last_known(F.col(column), name).rows().withColumn(name, F.coalesce(name, start))


def cluster_topics(topics: DataFrame, job: str = "job_id", least: float = 0.5) -> DataFrame:
    """GRP06: rejoins topics (job, chunk, label, turns, status, status_turn) that a chunk border cut.

    A topic joins the first open one whose last chunk is the one before its own, whose turns it
    adjoins and whose label is similar (JN11). The order decides, so a job is folded as a whole, but only
    the groups of the chunk before are looked at. Adds topic_id and parts, the (chunk, pos) of what was joined;
    pos is a column of topics or 0.
    """
    import re

    kind = topics.schema[job].dataType.simpleString()
    noise = NOISE.replace(r"\x{3000}", "\u3000")
    topics = topics if "pos" in topics.columns else topics.withColumn("pos", F.lit(0))

    def grams(label: str) -> set[str]:
        t = re.sub(noise, "", label or "").lower()
        return {t[i : i + 2] for i in range(max(1, len(t) - 1))} if t else set()

    def run(pdf):
        import pandas as pd

        groups: list[dict] = []
        last: dict[int, list[dict]] = {}  # groups by the chunk that they end in
        for r in sorted(pdf.to_dict("records"), key=lambda r: (r["chunk"], min(r["turns"]), r["label"], r["pos"])):
            turns, own = {int(x) for x in r["turns"]}, grams(r["label"])
            near = (g for g in last.get(r["chunk"] - 1, []) if min(turns) <= g["to"] + 1 and own and g["grams"] and len(own & g["grams"]) >= least * len(own | g["grams"]))
            home = min(near, key=lambda g: g["n"], default=None)
            if home is None:
                home = dict(r, n=len(groups), turns=turns, to=max(turns), grams=own, parts=[])
                groups.append(home)
            else:
                last[home["chunk"]].remove(home)
                home["turns"] |= turns
                home["to"], home["chunk"] = max(home["to"], *turns), r["chunk"]
                if r["status"] != "pending" or home["status"] == "pending":
                    home["status"], home["status_turn"] = r["status"], r["status_turn"]
                if len(r["label"]) > len(home["label"]):
                    home["label"], home["grams"] = r["label"], own
            home["parts"].append({"chunk": int(r["chunk"]), "pos": int(r["pos"])})
            last.setdefault(home["chunk"], []).append(home)
        groups.sort(key=lambda g: min(g["turns"]))
        rows = [{job: g[job], "topic_id": f"T{n:02d}", "label": g["label"], "turns": sorted(g["turns"]), "status": g["status"], "status_turn": g["status_turn"], "parts": g["parts"]} for n, g in enumerate(groups, 1)]
        out = pd.DataFrame(rows)
        out["status_turn"] = out["status_turn"].astype("Int64")
        return out

    return topics.groupBy(job).applyInPandas(run, f"`{job}` {kind}, topic_id string, label string, turns array<long>, status string, status_turn long, parts array<struct<chunk:long,pos:long>>")
