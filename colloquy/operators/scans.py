"""Running values over ordered jobs of any size: a scan in two passes.

A window runs a job in one task. Here a job that holds over a thousandth of all rows (and over ROWS of them)
is cut at quantiles of its order into segments; windows run by (job, segment), each segment is summed up in
one row, a small window over these gives what each segment takes over from those before it, and that is added
by broadcast. Other jobs are one segment and take nothing over, so the plan for them is the window's own.

Defined cases: a null job is a job; rows of null order come first; rows of equal order stay in one segment and
are ordered by the other columns given, beyond which their order is open, as in a window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a window may well hold in one task, and segments that a job is cut into at most: the square of STEP.
ROWS, STEP = 1_000_000, 32
#: Jobs above this share of all rows are cut; there are fewer than its inverse of them, so what is broadcast is bounded.
SHARE = 1 / 1000


def same(a: list[Column], b: list[Column]) -> Column:
    """Equality by column, null being equal to null."""
    return reduce(lambda x, y: x & y, (p.eqNullSafe(q) for p, q in zip(a, b, strict=True)))


class Scan:
    """Rows under a scan by job and order (numeric or a time), then by other columns; each method adds a column to `df`.

    rows: what a job may hold uncut; None where jobs are known to be small, so that they aren't counted.
    """

    def __init__(self, df: DataFrame, job: str | list[str], order: Column | str, then: list[Column] | None = None, rows: int | None = ROWS) -> None:
        self.job = [job] if isinstance(job, str) else job
        self.order, self.then = F.col(order) if isinstance(order, str) else order, list(then or [])
        self.cut, self.df = False, df
        if rows is None:
            return
        sizes = df.groupBy(*self.job).agg(F.count("*").alias("_n"))
        total, most = sizes.agg(F.sum("_n"), F.max("_n")).first()
        least = max(rows, int((total or 0) * SHARE))
        if (most or 0) > least:
            self.cut = True
            df = self._segmented(df, sizes.where(F.col("_n") > least), min(STEP * STEP, -(-most // least) * 2))
        self.df = df

    def _segmented(self, df: DataFrame, large: DataFrame, n: int) -> DataFrame:
        """_seg: the segment of a row in a large job, null in others."""
        keys = [f"_k{i}" for i in range(len(self.job))]
        large = F.broadcast(large.select(*(F.col(c).alias(k) for c, k in zip(self.job, keys, strict=True))))
        own = same([F.col(c) for c in self.job], [F.col(k) for k in keys])
        bounds = F.percentile_approx("_o", [i / n for i in range(1, n)], F.lit(100 * n))
        at = df.withColumn("_o", self.order).join(large, own).groupBy(*keys).agg(bounds.alias("_b"))
        # Every STEP-th bound first, then those behind it: few comparisons a row.
        steps = F.array(*(F.get("_b", F.lit(i)) for i in range(STEP - 1, n - 1, STEP))) if n > STEP else F.slice("_b", 1, 0)
        below = lambda b: F.size(F.filter(b, lambda x: x <= self.order))
        placed = df.join(F.broadcast(at.withColumn("_c", steps)), own, "left")
        coarse = placed.withColumn("_c", below(F.col("_c")))
        return coarse.withColumn("_seg", F.when(F.col("_b").isNotNull(), F.col("_c") * STEP + below(F.slice("_b", F.col("_c") * STEP + 1, STEP)))).drop(*keys, "_b", "_c")

    @property
    def window(self) -> Window:
        return Window.partitionBy(*self.job, *(["_seg"] if self.cut else [])).orderBy(self.order, *self.then)

    def _taken_over(self, summary: Column, carry) -> DataFrame:
        """The rows with _carry: carry(_sum) over the segments before, of which summary makes one row each; null in the first."""
        keys = [f"_k{i}" for i in range(len(self.job))]
        sums = self.df.where(F.col("_seg").isNotNull()).groupBy(*self.job, "_seg").agg(summary.alias("_sum"))
        before = Window.partitionBy(*self.job).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
        taken = sums.select(*(F.col(c).alias(k) for c, k in zip(self.job, keys, strict=True)), F.col("_seg").alias("_s"), carry(F.col("_sum")).over(before).alias("_carry"))
        own = same([F.col(c) for c in self.job], [F.col(k) for k in keys]) & (F.col("_seg") == F.col("_s"))
        return self.df.join(F.broadcast(taken), own, "left").drop(*keys, "_s")

    def running(self, value: Column, name: str) -> Scan:
        """The sum of value (null counts as nothing) up to and with the row."""
        local = F.sum(F.coalesce(value, F.lit(0))).over(self.window.rowsBetween(Window.unboundedPreceding, 0))
        if self.cut:
            self.df = self._taken_over(F.sum(F.coalesce(value, F.lit(0))), F.sum).withColumn(name, local + F.coalesce("_carry", F.lit(0))).drop("_carry")
        else:
            self.df = self.df.withColumn(name, local)
        return self

    def previous(self, value: Column, name: str) -> Scan:
        """A structure with the value of the row before, as column v; null in a job's first row."""
        boxed = F.struct(value.alias("v"))
        local = F.lag(boxed).over(self.window)
        if self.cut:
            place = F.struct(self.order.alias("o"), *(c.alias(f"t{i}") for i, c in enumerate(self.then)))
            self.df = self._taken_over(F.max_by(boxed, place), F.last).withColumn(name, F.coalesce(local, F.col("_carry"))).drop("_carry")
        else:
            self.df = self.df.withColumn(name, local)
        return self

    def last_known(self, value: Column, name: str) -> Scan:
        """The last value that isn't null, up to and with the row; null before any."""
        local = F.last(value, ignorenulls=True).over(self.window.rowsBetween(Window.unboundedPreceding, 0))
        if self.cut:
            place = F.when(value.isNotNull(), F.struct(self.order.alias("o"), *(c.alias(f"t{i}") for i, c in enumerate(self.then))))
            self.df = self._taken_over(F.max_by(value, place), lambda c: F.last(c, ignorenulls=True)).withColumn(name, F.coalesce(local, F.col("_carry"))).drop("_carry")
        else:
            self.df = self.df.withColumn(name, local)
        return self

    def rows(self) -> DataFrame:
        return self.df.drop("_seg")


def numbered(df: DataFrame, job: str | list[str], order: Column | str, name: str, then: list[Column] | None = None, rows: int = ROWS) -> DataFrame:
    """Rows numbered from 1 in each job (long), whatever its size."""
    return Scan(df, job, order, then, rows).running(F.lit(1).cast("long"), name).rows()
