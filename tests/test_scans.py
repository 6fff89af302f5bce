"""Scans and packing of jobs that are cut into segments and blocks, against windows and plain walks."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from colloquy.operators import packing, scans


@pytest.fixture(scope="module")
def skewed(spark):
    """Half of the rows are one job, a sixth has no job, orders repeat and are null now and then."""
    rng = random.Random(7)
    rows = [(rng.choice([-1] * 6 + [None] * 2 + list(range(40)) * 1) if i % 2 else -1, None if rng.random() < 0.01 else rng.randint(0, 900), i, rng.choice([None, rng.randint(-5, 9)]), rng.choice("ab")) for i in range(3000)]
    return spark.createDataFrame(rows, "job long, at long, id long, v long, key string").cache()


@pytest.mark.parametrize("rows", [40, 10**6])
def test_scans_equal_windows(skewed, rows):
    scan = scans.Scan(skewed, "job", "at", [F.col("id")], rows)
    assert scan.cut == (rows == 40)
    got = scan.running(F.col("v"), "sum").previous(F.col("key"), "before").last_known(F.col("v"), "known").rows()
    w = Window.partitionBy("job").orderBy("at", "id")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = skewed.withColumn("sum", F.sum(F.coalesce("v", F.lit(0))).over(upto)).withColumn("before", F.lag(F.struct(F.col("key").alias("v"))).over(w)).withColumn("known", F.last("v", ignorenulls=True).over(upto))
    assert got.columns == want.columns and got.count() == want.count()
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_segments_bound_a_task(skewed):
    cut = scans.Scan(skewed, "job", "at", [F.col("id")], 100).df
    sizes = {r["_seg"]: r["count"] for r in cut.where("job = -1").groupBy("_seg").count().collect()}
    assert len(sizes) > 10 and max(sizes.values()) <= 150
    assert cut.where("job >= 0 and _seg is not null").count() == 0


def test_scans_of_nothing(spark, skewed):
    none = skewed.limit(0)
    assert scans.numbered(none, "job", "at", "n").count() == 0
    assert scans.numbered(skewed.select("job", "at"), [], "at", "n").agg(F.max("n")).first()[0] == 3000


def greedy(rows, budget):
    out, own, used, chunk = {}, object(), 0, 0
    for job, at, n in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        n = n or 0
        if job != own:
            own, used, chunk = job, n, 0
        elif used + n > budget:
            used, chunk = n, chunk + 1
        else:
            used += n
        out[job, at] = chunk
    return out


@pytest.mark.parametrize(("block", "budget", "most"), [(7, 50, 40), (64, 300, 40), (5, 400, 20), (16, 3, 9), (8, 0, 3), (10, 10**6, 50)])
def test_long_jobs_are_packed_as_short_ones(spark, block, budget, most):
    """Chunks within a block, over several, turns above the budget and empty ones, in blocks that are left from many places."""
    rng = random.Random(block)
    rows = [(job, i * 3, rng.choice([0, 0, None, rng.randint(0, most), rng.randint(0, most), 2 * budget + 1 if rng.random() < 0.05 else 1])) for job, n in ((None, 300), (-1, 500), (1, 20), (2, 1)) for i in range(n)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "job long, at long, n long, chunk_of string").repartition(5)
    want = greedy(rows, budget)
    for limit in (100, 10**6):
        got = packing.pack(df, "job", "at", F.col("n"), budget, rows=limit, block=block)
        assert got.columns == ["job", "at", "n", "chunk_of", "chunk"]
        assert {(r["job"], r["at"]): r["chunk"] for r in got.collect()} == want
    assert packing.pack(df.limit(0), "job", "at", F.col("n"), budget).count() == 0
