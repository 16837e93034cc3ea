"""Queries over the request and response logs and the vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import metrics
from ..registry import query
from ..runtime import latest, table

R = "(SELECT DISTINCT ON (id) * FROM responses)"
Q = "(SELECT DISTINCT ON (id) * FROM requests)"
T = "CASE WHEN NOT isnan(timings.total) THEN timings.total END"


def _responses(spark, d):
    return latest(table(spark, d, "responses"), "id")


def _requests(spark, d):
    return latest(table(spark, d, "requests"), "id")


def _mean0(c: str) -> str:
    return f"coalesce(avg(CASE WHEN NOT isnan({c}) AND {c} <> 0 THEN {c} END), 0.0)"


def _hist(value: str, bounds: tuple[int, ...], name: str) -> str:
    edges = [None, *bounds, None]
    conds = [" AND ".join(([f"{value} >= {a}"] if a is not None else []) + ([f"{value} < {b}"] if b is not None else [])) for a, b in zip(edges, edges[1:])]
    return ", ".join(f"count(*) FILTER (WHERE {c}) AS {name}_{i}" for i, c in enumerate(conds))


_PARTS = ("llm_api_time", "rag_retrieval_time", "plugin_execution_time", "db_query_time", "time_to_first_token", "time_to_last_token")
_PRICES = ", ".join(f"('{m}', {i}, {o})" for m, (i, o) in metrics.PRICES.items())
_COST = f"""SELECT r.*, coalesce(coalesce(tokens.prompt_tokens, 0) / 1000.0 * p.i + coalesce(tokens.completion_tokens, 0) / 1000.0 * p.o, 0.0) AS cost
    FROM {R} r LEFT JOIN (SELECT m, CAST(i AS DOUBLE) AS i, CAST(o AS DOUBLE) AS o FROM (VALUES {_PRICES}) AS v(m, i, o)) p ON r.model = p.m"""
_SUMS = "round(sum(cost), 6) AS cost, CAST(sum(coalesce(tokens.total_tokens, 0)) AS BIGINT) AS tokens, count(*) AS n"

query("agg_performance", f"""SELECT count(*) AS n, coalesce(avg(t), 0.0) AS avg_total, {", ".join(f"coalesce(quantile_disc(t, {p}), 0.0) AS p{int(p * 100)}" for p in (0.5, 0.95, 0.99))},
    coalesce(min(t), 0.0) AS min_total, coalesce(max(t), 0.0) AS max_total, {", ".join(f"{_mean0('timings.' + p)} AS avg_{p}" for p in _PARTS)}, {_hist("t", metrics.LATENCY_BOUNDS, "bucket")} FROM (SELECT *, {T} AS t FROM {R})""")(lambda s, d: metrics.performance(_responses(s, d)))
query("agg_cost_by_model", f"SELECT coalesce(model, 'unknown') AS model, {_SUMS} FROM ({_COST}) GROUP BY ALL")(lambda s, d: metrics.cost_by(_responses(s, d), F.coalesce("model", F.lit("unknown")), "model"))
query("agg_cost_by_agent", f"SELECT agent_id, {_SUMS} FROM ({_COST}) GROUP BY ALL")(lambda s, d: metrics.cost_by(_responses(s, d), F.col("agent_id"), "agent_id"))
query("agg_cost_daily", f"SELECT strftime(ts, '%Y-%m-%d') AS day, {_SUMS} FROM ({_COST}) GROUP BY ALL")(lambda s, d: metrics.cost_by(_responses(s, d), F.date_format("ts", "yyyy-MM-dd"), "day"))
query("join_model_cost", f"SELECT id, model, round(cost, 9) AS cost FROM ({_COST})")(lambda s, d: metrics.priced(_responses(s, d)).select("id", "model", F.round("cost", 9).alias("cost")))
for _unit, _key, _sql in (("hour", "agg_time_series_hour", "date_trunc('hour', ts)"), ("day", "agg_time_series", "date_trunc('day', ts)"), ("week", "agg_time_series_week", "date_trunc('day', ts) - to_days(CAST(dayofweek(ts) AS INTEGER))")):
    query(_key, f"""SELECT strftime({_sql}, '%Y-%m-%d %H') AS bucket, count(*) AS n, round(avg({T}), 6) AS latency, CAST(coalesce(sum(tokens.total_tokens), 0) AS BIGINT) AS tokens, count(*) FILTER (WHERE NOT success) AS errors FROM {R} GROUP BY ALL""")(
        lambda s, d, u=_unit: metrics.time_series(_responses(s, d), u).withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd HH"))
    )


@query("topk_default", """SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 9) AS score FROM embeddings
    ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) DESC, vec_id LIMIT 5""")
def topk_default(s, d):
    e = table(s, d, "embeddings")
    one = e.where("vec_id = 0").limit(1).select(F.col("embedding").alias("asked"))  # one row
    scored = e.crossJoin(F.broadcast(one)).select("vec_id", vectors.cosine(F.col("embedding"), F.col("asked")).alias("score"))
    return scored.orderBy(F.desc("score"), "vec_id").limit(5).select("vec_id", F.round("score", 9).alias("score"))
