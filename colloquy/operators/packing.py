"""Packing of ordered turns under a budget, for jobs of any size.

Which turn opens a chunk depends on the one that opened the chunk before, so a job is a chain. Jobs that a task can
walk are walked: rows stream past in order, and all that is held is the chunk's size so far. A job of over a
thousandth of all rows (and over ROWS) isn't walked. Prefix sums say for each turn where the next chunk would open if
one opened here; in blocks of BLOCK turns these pointers are followed to the last one inside. So a block is left from
few places, the place behind each of them is found by the block's sums, and these jumps from block to block are doubled: after k
rounds the first 2^k jumps of the chain are known. Each block then has its one entry and is walked by itself.

Defined cases: a turn is never split, one above the budget stands alone, a null size is 0; a null job is a job; an empty table
gives an empty result; other columns come back as they were.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from colloquy.operators.scans import ROWS, SHARE, Scan, same
from colloquy.operators.storage import cut

BLOCK = 65_536


def pack(turns: DataFrame, job: str, order: str, size: Column, budget: int, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """GRP04, SRC05: turns with chunk (from 0 in each job), greedy under the budget."""
    sized = turns.withColumn("_size", F.coalesce(size.cast("long"), F.lit(0)))
    counts = turns.groupBy(job).agg(F.count("*").alias("_n"))
    total, most = counts.agg(F.sum("_n"), F.max("_n")).first()
    least = max(rows, int((total or 0) * SHARE))
    if (most or 0) <= least:
        return walked(sized, job, order, budget)
    large = F.broadcast(counts.where(F.col("_n") > least).select(F.col(job).alias("_job")))  # the inverse of SHARE at most
    own = same([F.col(job)], [F.col("_job")])
    few, many = sized.join(large, own, "left_semi"), sized.join(large, own, "left_anti")
    return walked(many, job, order, budget).unionByName(doubled(few, job, order, budget, rows, block))


def walked(turns: DataFrame, job: str, order: str, budget: int) -> DataFrame:
    """Jobs in order, each in one task: one shuffle, and Python sees no column but job and size."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own, used, chunk = [], 0, -1
        for b in batches:
            if not b.num_rows:
                continue
            out = []
            for key, n in zip(b.column(job).to_pylist(), b.column("_size").to_pylist(), strict=True):
                if [key] != own:
                    own, used, chunk = [key], n, 0
                elif used + n > budget:
                    used, chunk = n, chunk + 1
                else:
                    used += n
                out.append(chunk)
            keep = [c for c in b.schema.names if c != "_size"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(out, pa.int64())], names=[*keep, "chunk"])

    schema = StructType([f for f in turns.schema.fields if f.name != "_size"] + [StructField("chunk", LongType())])
    return turns.repartition(job).sortWithinPartitions(job, order, "_size").mapInArrow(run, schema)


def doubled(turns: DataFrame, job: str, order: str, budget: int, rows: int, block: int) -> DataFrame:
    """Large jobs: prefix sums, pointers within blocks, doubled jumps between blocks."""
    scan = Scan(turns, job, order, [F.col("_size")], rows).running(F.lit(1).cast("long"), "_p").running(F.col("_size"), "_sum")
    wide = cut(scan.rows().withColumn("_block", F.floor((F.col("_p") - 1) / block).cast("long")))
    boxed = F.struct(F.col(job).alias("v"))  # structures are equal where their nulls are
    narrow = wide.select(boxed.alias("job"), "_block", "_p", "_size", "_sum")
    kind = narrow.schema["job"].dataType.simpleString()

    def ordered(t):
        """Positions, sums before and with each turn of a block, and the turn in it that opens the next chunk (its end: none)."""
        import numpy as np

        t = t.sort_by("_p")
        p, size, total = (t.column(c).to_numpy() for c in ("_p", "_size", "_sum"))
        begin = np.arange(len(p))
        return p, total - size, total, np.maximum(np.searchsorted(total, total - size + budget, "right"), begin + 1)

    def last(after):
        """The last opening in the block on the way from each turn."""
        import numpy as np

        at = np.where(after < len(after), after, np.arange(len(after)))
        while True:
            further = at[at]
            if (further == at).all():
                return at
            at = further

    def made(key, columns, names):
        import pyarrow as pa

        types = [pa.int64() if n != "job" else key.type for n in names]
        return pa.table([pa.array([key.as_py()] * len(columns[0]), key.type), *(pa.array(c, t) for c, t in zip(columns, types[1:], strict=True))], names=names)

    def leaving(key, t):
        """The places that a block can be left from, with the sum that a chunk which opens there can't reach."""
        import numpy as np

        p, before, _, after = ordered(t)
        at = np.unique(last(after))
        return made(key[0], [p[at], before[at] + budget], ["job", "place", "most"])

    def entering(key, t, asked):
        """For each place whose next chunk opens in this block: where, and the place that the block is left from then."""
        import numpy as np

        p, _, total, after = ordered(t)
        j = np.searchsorted(total, asked.column("most").to_numpy(), "right")
        return made(key[0], [asked.column("place").to_numpy(), p[j], p[last(after)[j]]], ["job", "place", "entry", "then"])

    def beginning(key, t):
        """The place that a job's first block is left from."""
        p, _, _, after = ordered(t)
        return made(key[0], [p[last(after)[:1]]], ["job", "place"])

    def opened(key, t, entries):
        """The turns of a block that open chunks: those reached from its entry."""
        p, _, _, after = ordered(t)
        at, found = (int((entries.column("entry")[0].as_py() - p[0])), []) if entries.num_rows else (len(p), [])
        while at < len(p):
            found.append(int(p[at]))
            at = int(after[at])
        return made(key[0], [found], ["job", "_p"])

    by_block = narrow.groupBy("job", "_block")
    places = cut(by_block.applyInArrow(leaving, f"job {kind}, place long, most long"))
    # The block in which a place's next chunk opens is the first behind it whose sum is above: blocks and places in order of sums.
    sums = by_block.agg(F.max("_sum").alias("sum"))
    blocks = sums.select("job", F.col("sum").alias("o"), F.lit(1).alias("is_block"), F.col("_block").alias("b"), F.lit(None).cast("long").alias("place"))
    asked = places.select("job", F.col("most").alias("o"), F.lit(0).alias("is_block"), F.lit(None).cast("long").alias("b"), "place")
    # Downwards: a place comes behind the blocks above its sum, of which the last one seen is the first; of equal sums blocks come later, higher ones first.
    both = Scan(blocks.unionByName(asked).withColumn("down", -F.col("o")), "job", "down", [F.col("is_block"), -F.coalesce("b", F.lit(0)), F.col("place")], rows).last_known(F.col("b"), "above").rows()
    # A single turn above the budget is followed by its neighbour, which may lie in the next block.
    beside = F.floor((F.col("place") - 1) / block).cast("long") + 1
    targets = both.where("is_block = 0 and above is not null").select("job", "place", F.col("o").alias("most"), F.greatest("above", beside).alias("_block"))
    ends = sums.groupBy("job").agg(F.max("_block").alias("_end"))
    targets = targets.join(ends, "job").where("_block <= _end").select(F.col("job").alias("of"), "_block", "place", "most")
    jumps = cut(by_block.cogroup(targets.groupBy("of", "_block")).applyInArrow(entering, f"job {kind}, place long, entry long, then long"))
    first = narrow.where("_block = 0").groupBy("job", "_block").applyInArrow(beginning, f"job {kind}, place long")
    reached, far = cut(first), jumps.select("job", "place", "then")
    n = reached.count()
    while True:
        step = reached.join(far, ["job", "place"]).select("job", F.col("then").alias("place"))
        reached = cut(reached.unionByName(step).distinct())
        now = reached.count()
        if now == n:
            break
        n = now
        far = cut(far.join(far.select("job", F.col("place").alias("then"), F.col("then").alias("_next")), ["job", "then"]).select("job", "place", F.col("_next").alias("then")))
    entries = jumps.join(reached, ["job", "place"], "left_semi").select("job", "entry").unionByName(narrow.where("_p = 1").select("job", F.col("_p").alias("entry")))
    entries = entries.select(F.col("job").alias("of"), "entry", F.floor((F.col("entry") - 1) / block).cast("long").alias("_block"))
    starts = by_block.cogroup(entries.groupBy("of", "_block")).applyInArrow(opened, f"job {kind}, _p long").withColumn("_new", F.lit(1).cast("long"))
    marked = wide.join(starts.withColumnRenamed("job", "_job").withColumnRenamed("_p", "_at"), (boxed == F.col("_job")) & (F.col("_p") == F.col("_at")), "left")
    kept = [c for c in turns.columns if c != "_size"]
    numbered = Scan(marked.drop("_job", "_at"), job, "_p", rows=rows).running(F.col("_new"), "chunk").rows()
    return numbered.select(*kept, (F.col("chunk") - 1).alias("chunk"))
