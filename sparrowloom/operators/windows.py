"""Operators whose result depends on the order of rows: sampling, tails, caches, budgets over calendar periods."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import ranked

PERIODS = ("hour", "day", "week", "month")


def period_start(ts: Column, period: str) -> Column:
    """Start of the hour, day, week (from Sunday) or month, UTC."""
    if period not in PERIODS:
        raise ValueError(f"no period {period}")
    if period == "week":
        return F.date_trunc("day", ts) - F.make_interval(days=F.dayofweek(ts) - 1)
    return F.date_trunc(period, ts)


def next_reset(ts: Column, period: str) -> Column:
    """When the period of a time ends."""
    length = {"hour": {"hours": F.lit(1)}, "day": {"days": F.lit(1)}, "week": {"days": F.lit(7)}, "month": {"months": F.lit(1)}}[period]
    return period_start(ts, period) + F.make_interval(**length)


def usage(log: DataFrame, key: str, period: str = "day") -> DataFrame:
    """Adds to rows of (key, ts, seq, tokens) what the key had used in the period, tokens and requests, before and after each row."""
    w = Window.partitionBy(key, period_start(F.col("ts"), period)).orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = log.withColumns({"used_after": F.sum("tokens").over(w), "requests_after": F.count("*").over(w)})
    return rows.withColumns({"used_before": F.col("used_after") - F.col("tokens"), "resets_at": next_reset(F.col("ts"), period)})


def status(log: DataFrame, key: str, limit: int, period: str = "day", warn_at: float = 0.8, on_limit: str = "reject") -> DataFrame:
    """Adds to each row, as it stood before it, whether the budget was used up, what was left, the percentage, and the
    decision: ``on_limit`` (reject, fallback or warn) once it is used up, else ``warn`` the first time the key reaches ``warn_at``, else ``pass``."""
    rows = usage(log, key, period).withColumns({"exceeded": F.col("used_before") >= limit, "left_over": F.greatest(F.lit(0), limit - F.col("used_before")), "percent": F.col("used_before") / limit * 100})
    # the first row at the threshold: none before it had reached it
    reached = F.col("percent") >= warn_at * 100
    before = F.max(reached).over(Window.partitionBy(key).orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("warned", reached & ~F.coalesce(before, F.lit(False)))
    return rows.withColumn("decision", F.when(F.col("exceeded"), on_limit).when(F.col("warned"), "warn").otherwise("pass"))


def every_nth(df: DataFrame, n: int, *order) -> DataFrame:
    """Every n-th row in the order of all rows."""
    return ranked(df, *order, name="_rank").where(F.col("_rank") % n == 0).drop("_rank")


def last_n(messages: DataFrame, n: int, key: str = "thread_id", order: str = "seq") -> DataFrame:
    """The last ``n`` rows of every key, all for 0; Spark keeps only ``n`` rows a key before the shuffle."""
    if not n:
        return messages
    return messages.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(F.col("_k") <= n).drop("_k")


def tail(values: Column, n: int) -> Column:
    """The last ``n`` elements of an array."""
    return F.slice(values, F.greatest(F.size(values) - n + 1, F.lit(1)), F.lit(n))


def _windows(key: str, length: int, strict: bool):
    """Windows that a key's first row after the last window opens. ``strict``: a row at the very end still belongs to the
    window. Of a batch only the openings are looped over; the rows between them are found by bisection."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, start, count = None, 0, 0
        for batch in batches:
            times, keys = batch["ts_ms"].values, batch[key].values
            place, opened = np.empty(len(batch), np.int64), np.empty(len(batch), np.int64)
            edges = np.flatnonzero(keys[1:] != keys[:-1]) + 1 if len(keys) else []
            for a, b in zip([0, *edges], [*edges, len(keys)]):
                at = a
                while at < b:
                    if keys[at] != now or (times[at] > start + length if strict else times[at] >= start + length):
                        now, start, count = keys[at], times[at], 0
                    to = a + int(np.searchsorted(times[a:b], start + length, side="right" if strict else "left"))
                    to = max(to, at + 1)
                    place[at:to], opened[at:to] = count + 1 + np.arange(to - at), start
                    count += to - at
                    at = to
            yield batch.assign(used=place, opened_ms=opened)

    return run


def anchored(log: DataFrame, key: str, length_ms: int, strict: bool = True) -> DataFrame:
    """Adds to rows of (key, ts_ms, seq) the start of their window and their number in it. A row depends on all earlier ones of
    its key, so a key is read in order by one task, as a stream: rows are sorted within partitions, and only the open window is kept."""
    rows = log.repartition(key).sortWithinPartitions(key, "ts_ms", "seq")
    return rows.mapInPandas(_windows(key, length_ms, strict), log.schema.add("used", "long").add("opened_ms", "long"))


def rate_limit(log: DataFrame, key: str, limit: int, window_ms: int) -> DataFrame:
    """Adds used, allowed, remaining, the end of the window and the seconds to wait; refused requests count, too."""
    rows = anchored(log, key, window_ms).withColumn("reset_ms", F.col("opened_ms") + window_ms).drop("opened_ms")
    wait = F.when(F.col("used") > limit, F.ceil((F.col("reset_ms") - F.col("ts_ms")) / 1000)).otherwise(0)
    return rows.withColumns({"allowed": F.col("used") <= limit, "remaining": F.greatest(F.lit(0), limit - F.col("used")), "retry_after": wait.cast("bigint")})


def cache(log: DataFrame, key: str, ttl_ms: int) -> DataFrame:
    """Adds ``hit``: whether a cache without a bound would have answered. An entry lives ``ttl_ms`` from the miss that made it; hits do not renew it."""
    return anchored(log, key, ttl_ms, strict=False).withColumn("hit", F.col("used") > 1).drop("used", "opened_ms")


def section_headers(df: DataFrame, section: str, order: str, key: str) -> DataFrame:
    """Adds ``header``: the section where it differs from that of the row before, else null."""
    before = F.lag(section).over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("header", F.when(before.isNull() | (before != F.col(section)), F.col(section)))
