"""Conditions, projections, counts and correlations over request, response and error logs. Bounds are inclusive at
both ends; an option that is None asks for nothing, and 0 means 0."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def condition(agent: str | None = None, start: str | None = None, end: str | None = None, thread: str | None = None, user: str | None = None) -> Column:
    """Conjunction of what is asked for, over agent_id, thread_id, user_id and ts; it reaches the scan."""
    parts = [F.col(c) == v for c, v in (("agent_id", agent), ("thread_id", thread), ("user_id", user)) if v is not None]
    parts += [F.col("ts") >= F.lit(start).cast("timestamp")] if start is not None else []
    parts += [F.col("ts") <= F.lit(end).cast("timestamp")] if end is not None else []
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def page(df: DataFrame, *order: Column, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Rows from ``offset`` on, ``limit`` of them, in the given order (which has to tell all rows apart)."""
    rows = df.orderBy(*order).offset(offset)
    return rows if limit is None else rows.limit(limit)


def failures(responses: DataFrame) -> DataFrame:
    """The log of errors: one row per failed response that names its error."""
    return responses.where("not success and error_type is not null").select("id", "agent_id", "thread_id", "ts", "error_type", F.lit("llm").alias("component"))


def request_rows(messages: DataFrame) -> DataFrame:
    """Requests as they are stored: the text is dropped, its length kept."""
    return messages.where("role = 'user'").select(F.col("message_id").alias("id"), "agent_id", "thread_id", "user_id", "ts", F.coalesce(F.length("content"), F.lit(0)).cast("bigint").alias("message_length"))


def basic_responses(responses: DataFrame) -> DataFrame:
    """Responses of which only the number of tokens is known: all of them count as completion, and the call as a success."""
    used = F.coalesce("tokens.total_tokens", F.lit(0)).cast("bigint")
    return responses.select("id", F.lit(0).cast("bigint").alias("prompt_tokens"), used.alias("completion_tokens"), used.alias("total_tokens"), F.lit(True).alias("success"))


def requests_with_answers(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Every response with its request: ms between them and the length asked; 0 where there is none."""
    asked = requests.select(F.col("id").alias("request_id"), F.col("ts").alias("asked"), F.col("message_length").alias("asked_length"))
    both = responses.select("id", "request_id", "ts").join(asked, "request_id", "left")
    return both.select("id", F.coalesce(F.unix_millis("ts") - F.unix_millis("asked"), F.lit(0)).alias("ms"), F.coalesce("asked_length", F.lit(0)).alias("asked_length"))


def preceding_request(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """As-of join: each response of a thread with the latest request of the thread not after it. One sort of both logs
    by thread and time; equal times: requests first, of these the largest id."""
    a = requests.where("thread_id is not null").select("thread_id", "ts", F.lit(0).alias("kind"), "id")
    b = responses.where("thread_id is not null").select("thread_id", "ts", F.lit(1).alias("kind"), "id")
    w = Window.partitionBy("thread_id").orderBy("ts", "kind", "id").rowsBetween(Window.unboundedPreceding, 0)
    both = a.union(b).withColumn("request_id", F.last(F.when(F.col("kind") == 0, F.col("id")), ignorenulls=True).over(w))
    return both.where("kind = 1").select("id", "thread_id", "request_id")


def thread_stats(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Per thread over both logs: messages, first and last time, and the agent of the first message (of equal times the smallest id)."""
    both = requests.select("thread_id", "agent_id", "ts", "id").union(responses.select("thread_id", "agent_id", "ts", "id")).where("thread_id is not null")
    return both.groupBy("thread_id").agg(F.count("*").alias("messages"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.min(F.struct("ts", "id", "agent_id"))["agent_id"].alias("agent_id"))


def sessions(requests: DataFrame) -> DataFrame:
    """The times of each user's requests as rows, numbered from 1: a user with very many is sorted, never gathered."""
    w = Window.partitionBy("user_id").orderBy("ts", "id")
    return requests.where("user_id is not null").select("user_id", "id", "ts", F.row_number().over(w).cast("bigint").alias("position"))


def counts(**logs: DataFrame) -> DataFrame:
    """One row: the rows of each log."""
    parts = [df.agg(F.count("*").alias(name)) for name, df in logs.items()]
    return reduce(lambda a, b: a.crossJoin(b), parts)  # rows of one aggregate each


def error_summary(errors: DataFrame, responses: DataFrame) -> DataFrame:
    """One row: errors by type and component, timeouts, rate limits, and the shares over all responses (0 and 1 without any)."""
    kinds = errors.groupBy("error_type").agg(F.count("*").alias("n")).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "error_type", F.col("n").cast("string")))), ";").alias("by_type"))  # a type a row
    names = ("llm", "rag", "plugin", "storage", "other")
    part = F.when(F.col("component").isin(*names[:-1]), F.col("component")).otherwise("other")
    one = errors.agg(F.count("*").alias("errors"), *(F.count_if(part == c).alias(f"component_{c}") for c in names), F.count_if(F.col("error_type") == "timeout").alias("timeouts"), F.count_if(F.col("error_type") == "rate_limit").alias("rate_limits"))
    both = one.crossJoin(kinds).crossJoin(responses.agg(F.count("*").alias("responses")))
    rate = F.coalesce(F.try_divide("errors", "responses"), F.lit(0.0))
    return both.withColumns({"error_rate": rate, "success_rate": F.lit(1.0) - rate})


def conversation_summary(requests: DataFrame) -> DataFrame:
    """One row: threads, messages, mean length and duration of threads, threads of one message, users that came back, and lengths
    of what was asked with their buckets; all 0 if no request has a thread."""
    threads = requests.where("thread_id is not null").groupBy("thread_id").agg(F.count("*").alias("size"), (F.unix_millis(F.max("ts")) - F.unix_millis(F.min("ts"))).alias("ms"))
    a = threads.agg(F.count("*").alias("threads"), F.sum("size").alias("in_threads"), F.avg("ms").alias("ms"), F.count_if(F.col("size") == 1).alias("single"))
    users = requests.where("user_id is not null").groupBy("user_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("users"), F.count_if(F.col("n") > 1).alias("back"))
    bounds = [0, 50, 200, 500, None]
    within = lambda lo, hi: (F.col("message_length") >= lo) & (F.lit(True) if hi is None else F.col("message_length") < hi)
    c = requests.agg(F.count("*").alias("messages"), F.avg("message_length").alias("length"), *(F.count_if(within(lo, hi)).alias(f"length_{i}") for i, (lo, hi) in enumerate(zip(bounds, bounds[1:]))))
    one = a.crossJoin(users).crossJoin(c)
    none = F.col("threads") == 0
    zero = lambda x: F.when(none, 0.0).otherwise(F.coalesce(x, F.lit(0.0)))
    return one.select(
        "threads", F.when(none, 0).otherwise(F.col("messages")).alias("messages"), zero(F.try_divide("in_threads", "threads")).alias("messages_per_thread"), zero(F.col("ms")).alias("avg_ms"),
        zero(F.try_divide("single", "threads")).alias("abandonment"), zero(F.try_divide("back", "users")).alias("return_rate"), zero(F.col("length")).alias("avg_length"), *(F.when(none, 0).otherwise(F.col(f"length_{i}")).alias(f"length_{i}") for i in range(4)),
    )


def summary(requests: DataFrame, responses: DataFrame, errors: DataFrame) -> DataFrame:
    """One row: rows of each log, distinct threads and users, oldest and newest time of a request."""
    one = requests.agg(F.count("*").alias("requests"), F.count_distinct("thread_id").alias("threads"), F.count_distinct("user_id").alias("users"), F.min("ts").alias("oldest"), F.max("ts").alias("newest"))
    return one.crossJoin(counts(responses=responses, errors=errors))
