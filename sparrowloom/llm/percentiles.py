"""Percentiles per group over any number of values, exactly, by bisection.

For every group, column and percentile an interval of values is kept that holds
the target rank. Each pass counts the rows below up to FANOUT - 1 midpoints of
the interval (so many bisections at once), and the interval becomes the actual
minimum and maximum of the part with the target; it is resolved when these are
equal, or as close as ``tolerance`` asks. Only counts, minima and maxima are
exchanged, so partitions and days combine by adding, and a group that holds a
third of all rows is counted where its rows lie. Rows outside every interval
leave the working set.

The percentile p of n values is the value of rank max(1, ceil(p n)). Null and NaN
are no values; zeros, infinities and negative numbers are. Groups without any
value give no row; a null group key is a group. Ties need no care: equal values
are never separated.

:func:`grid_counts` and :func:`from_grid` do the same on a fixed grid of
midpoints: counts of separate days or partitions are kept, added later and
bisected with a relative error of at most 2 ** (1 / GRID) - 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import BROADCAST_ROWS, small_or_none, stage

#: Parts of an interval in one pass.
FANOUT = 256
#: Fixed midpoints per power of two; 32 give a relative error of at most 2.2 %.
GRID = 32
PERMILLES = (500, 900, 950, 990)


def _long(df: DataFrame, groups: list[str], values: dict[str, Column]) -> DataFrame:
    """Rows (group columns, metric, v) of all values, -0.0 as 0.0."""
    wide = df.select(*groups, F.array(*(F.struct(F.lit(name).alias("metric"), (c.cast("double") + F.lit(0.0)).alias("v")) for name, c in values.items())).alias("pairs"))
    return wide.select(*groups, F.inline("pairs")).where("v is not null and not isnan(v)")


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond


def percentiles(df: DataFrame, groups: list[str], values: dict[str, Column], permilles=PERMILLES, tolerance: float = 0.0, passes: int = 80) -> DataFrame:
    """``groups, metric, permille, value, n``. ``values`` maps names to columns of
    ``df``. With ``tolerance`` > 0 the value is at most so much too large, relative
    to the largest in its interval."""
    if any(not 0 < p <= 1000 for p in permilles):
        raise ValueError("permilles lie in 1..1000")
    keys = [*groups, "metric"]
    work = stage(_long(df, groups, values), "values")
    whole = work.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    asked = F.explode(F.array(*(F.lit(int(p)) for p in permilles))).alias("permille")
    state = whole.select(*keys, asked, F.col("n").alias("all"), "n", "lo", "hi")
    state = state.withColumn("rank", F.greatest(F.lit(1), F.expr("(all * permille + 999) div 1000")))  # counted from 1 inside the interval
    state = stage(state, "state")
    size, done = None, []
    wide_open = F.col("hi") - F.col("lo")
    closed = (F.col("lo") == F.col("hi")) | ((wide_open < float("inf")) & (wide_open <= F.lit(tolerance) * F.abs("hi")))
    for _ in range(passes):
        done.append(state.where(closed).select(*keys, "permille", F.col("hi").alias("value"), F.col("all").alias("n")))
        open_ = state.where(~closed)
        intervals = open_.select(*keys, "lo", "hi", "n").distinct()
        left, rows = open_.select(F.count("*")).first()[0], intervals.agg(F.sum("n")).first()[0]
        if not left:
            out = done[0]
            for part in done[1:]:
                out = out.union(part)
            return out
        few = small_or_none(intervals, BROADCAST_ROWS)
        side = few if few is not None else intervals
        inside = work.join(side, _same(work, side, keys) & (work["v"] >= side["lo"]) & (work["v"] <= side["hi"])).select(*(work[k] for k in keys), work["v"], side["lo"], side["hi"], side["n"])
        if size is None or rows < size / 2:
            # overlapping intervals repeat a row, so each is listed once in the next working set
            work_next = inside.select(*keys, "v", "lo", "hi", "n")
            inside, size = stage(work_next, "inside"), rows
            work = inside.select(*keys, "v") if _disjoint(intervals, keys) else work
        part = _part(F.col("v"), F.col("lo"), F.col("hi"), F.col("n"))
        counted = inside.groupBy(*keys, "lo", "hi", part.alias("part")).agg(F.count("*").alias("c"), F.min("v").alias("new_lo"), F.max("v").alias("new_hi"))
        up = Window.partitionBy(*keys, "lo", "hi").orderBy("part")
        counted = stage(counted.withColumn("upto", F.sum("c").over(up)), "counted")
        few = small_or_none(counted, BROADCAST_ROWS)
        side = few if few is not None else counted
        hit = _same(open_, side, [*keys, "lo", "hi"]) & (open_["rank"] <= side["upto"]) & (open_["rank"] > side["upto"] - side["c"])
        state = open_.join(side, hit).select(
            *(open_[k] for k in keys), open_["permille"], open_["all"], side["c"].alias("n"), side["new_lo"].alias("lo"), side["new_hi"].alias("hi"), (open_["rank"] - side["upto"] + side["c"]).alias("rank")
        )
        state = stage(state, "state")
    raise RuntimeError("bisection did not end")


def _disjoint(intervals: DataFrame, keys: list[str]) -> bool:
    """Whether no two intervals of a key share a value, so that survivors are listed once."""
    before = Window.partitionBy(*keys).orderBy("lo", "hi")
    return intervals.withColumn("was", F.lag("hi").over(before)).where("was >= lo").limit(1).count() == 0


def _part(v: Column, lo: Column, hi: Column, n: Column) -> Column:
    """Number of the part of [lo, hi] that holds v. Not falling in v, the smallest and the largest value always apart."""
    parts = F.least(F.lit(FANOUT), F.greatest(F.lit(2), n)).cast("double")
    # halves first, so that the width of the widest interval is still a number
    share = (v / 2 - lo / 2) / (hi / 2 - lo / 2)
    inner = F.greatest(F.lit(0.0), F.least(parts - 1, F.floor(share * parts).cast("double")))
    infinite = (F.abs(lo) == float("inf")) | (F.abs(hi) == float("inf"))
    by_end = F.when(v == lo, 0.0).when(v == hi, 2.0).otherwise(1.0)
    return F.when(v >= hi, F.when(infinite, 2.0).otherwise(parts)).when(infinite, by_end).otherwise(inner).cast("int")


# counts on a fixed grid, which add up


def grid_counts(df: DataFrame, groups: list[str], values: dict[str, Column]) -> DataFrame:
    """``groups, metric, cell, c``: how many values lie in each cell of the fixed grid. Rows of several results of this function may be added."""
    v = F.col("v")
    size = F.greatest(F.abs(v), F.lit(2.0**-1000))
    cell = F.when(v == 0, 0).otherwise((F.signum(v) * (F.ceil(F.log2(F.least(size, F.lit(2.0**1000))) * GRID) + 1001 * GRID)).cast("int"))
    return _long(df, groups, values).groupBy(*groups, "metric", cell.alias("cell")).agg(F.count("*").alias("c"))


def from_grid(counts: DataFrame, groups: list[str], permilles=PERMILLES) -> DataFrame:
    """Percentiles of added grid counts: ``groups, metric, permille, value, n``; the
    value is the upper bound of the cell that holds the target rank."""
    keys = [*groups, "metric"]
    total = counts.groupBy(*keys, "cell").agg(F.sum("c").alias("c"))
    # at most 2 * 2001 * GRID + 1 cells a group, so a group is never too large for a task
    total = total.withColumn("upto", F.sum("c").over(Window.partitionBy(*keys).orderBy("cell"))).withColumn("n", F.sum("c").over(Window.partitionBy(*keys)))
    rows = total.select(*keys, "cell", "c", "upto", "n", F.explode(F.array(*(F.lit(int(p)) for p in permilles))).alias("permille"))
    rank = F.greatest(F.lit(1), F.expr("(n * permille + 999) div 1000"))
    cell = F.col("cell")
    upper = F.when(cell == 0, 0.0).when(cell > 0, F.pow(F.lit(2.0), (cell - 1001 * GRID) / GRID)).otherwise(-F.pow(F.lit(2.0), (-cell - 1001 * GRID - 1) / GRID))
    return rows.where((rank <= F.col("upto")) & (rank > F.col("upto") - F.col("c"))).select(*keys, "permille", upper.alias("value"), "n")


TIMINGS = ("total", "llm_api_time", "rag_retrieval_time", "plugin_execution_time", "db_query_time", "time_to_first_token", "time_to_last_token", "queue_time")


def response_timings(responses: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """The responses, each once, with their day, and their timings as columns."""
    once = responses.select("id", "agent_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), *(F.col(f"timings.{t}").alias(t) for t in TIMINGS)).dropDuplicates(["id"])
    return once, {t: F.col(t) for t in TIMINGS}
