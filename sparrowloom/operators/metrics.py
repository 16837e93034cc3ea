"""Metrics over request and response logs. Each function takes a log in which every
delivery stands once and returns a small DataFrame; null measures are left out of
means, and zeros, too, where ``skip_zero`` says so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import stage
from .percentiles import nearest_rank

#: USD per 1000 tokens, input and output. Fixed values.
PRICES = {
    "gpt-4o": (0.005, 0.015),
    "gpt-4o-mini": (0.00015, 0.0006),
    "gpt-4-turbo": (0.01, 0.03),
    "gpt-4": (0.03, 0.06),
    "gpt-3.5-turbo": (0.0005, 0.0015),
    "claude-3-5-sonnet-20241022": (0.003, 0.015),
    "claude-3-opus-20240229": (0.015, 0.075),
    "claude-3-sonnet-20240229": (0.003, 0.015),
    "claude-3-haiku-20240307": (0.00025, 0.00125),
    "gemini-2.0-flash-exp": (0.0, 0.0),
    "gemini-1.5-pro": (0.00125, 0.005),
    "gemini-1.5-flash": (0.000075, 0.0003),
}

LATENCY_BOUNDS = (100, 500, 1000, 5000)


def number(c: str) -> Column:
    """The measure, with NaN as null."""
    return F.when(~F.isnan(c), F.col(c))


def skip_zero(c: str) -> Column:
    return F.nullif(number(c), F.lit(0.0))


def histogram(value: Column, bounds: tuple[int, ...], name: str) -> list[Column]:
    """Counts of the values below each bound and from the last one on."""
    low = [None, *bounds]
    return [F.count_if(((value >= a) if a is not None else F.lit(True)) & ((value < b) if b is not None else F.lit(True))).alias(f"{name}_{i}") for i, (a, b) in enumerate(zip(low, [*bounds, None]))]


def performance(responses: DataFrame) -> DataFrame:
    """One row: count, mean, nearest-rank percentiles, extremes, component means, latency histogram; zeros if there are no rows."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    parts = ("llm_api_time", "rag_retrieval_time", "plugin_execution_time", "db_query_time", "time_to_first_token", "time_to_last_token")
    means = [zero(F.avg(f"m_{p}")).alias(f"avg_{p}") for p in parts]
    flat = stage(responses.select(number("timings.total").alias("total"), *(skip_zero(f"timings.{p}").alias(f"m_{p}") for p in parts)), "timings")
    one = flat.agg(F.count("*").alias("n"), zero(F.avg("total")).alias("avg_total"), zero(F.min("total")).alias("min_total"), zero(F.max("total")).alias("max_total"), *means, *histogram(F.col("total"), LATENCY_BOUNDS, "bucket"))
    ranks = nearest_rank(flat, "total", (500, 950, 990), 0.0)
    return one.crossJoin(ranks.select(*(F.col(f"p{p}0").alias(f"p{p}") for p in (50, 95, 99))))  # a row each


def priced(responses: DataFrame) -> DataFrame:
    """Adds ``cost`` from the price list, which is a dimension of twelve rows; unknown models cost nothing."""
    prices = responses.sparkSession.createDataFrame([(m, i, o) for m, (i, o) in PRICES.items()], "model string, price_in double, price_out double")
    tokens = lambda c: F.coalesce(F.col(f"tokens.{c}"), F.lit(0)) / 1000
    cost = F.coalesce(tokens("prompt_tokens") * F.col("price_in") + tokens("completion_tokens") * F.col("price_out"), F.lit(0.0))
    return responses.join(F.broadcast(prices), "model", "left").withColumn("cost", cost).drop("price_in", "price_out")


def cost_by(responses: DataFrame, key: Column, name: str) -> DataFrame:
    total = F.sum(F.coalesce("tokens.total_tokens", F.lit(0)))
    return priced(responses).groupBy(key.alias(name)).agg(F.round(F.sum("cost"), 6).alias("cost"), total.alias("tokens"), F.count("*").alias("n"))


def bucket(ts: str, unit: str) -> Column:
    """Start of the hour, day or week (from Sunday) in the session's time zone, UTC."""
    day = F.date_trunc("day", ts)
    if unit == "week":
        return F.expr(f"date_trunc('day', {ts}) - make_interval(0, 0, 0, dayofweek({ts}) - 1)")
    return F.date_trunc(unit, ts) if unit != "day" else day


def time_series(responses: DataFrame, unit: str) -> DataFrame:
    rows = responses.withColumn("bucket", bucket("ts", unit)).groupBy("bucket")
    return rows.agg(F.count("*").alias("n"), F.round(F.avg(number("timings.total")), 6).alias("latency"), F.coalesce(F.sum("tokens.total_tokens"), F.lit(0)).alias("tokens"), F.count_if(~F.col("success")).alias("errors"))
