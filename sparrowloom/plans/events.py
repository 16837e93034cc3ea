"""Queries over the logs: conditions, correlations, summaries, and what depends on order."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import moderation, texts
from ..operators import logs, metrics, percentiles, windows
from ..registry import query
from ..runtime import ranked, table
from .tables import C, E, G, K, M, Q, R, rows, sql

c = F.col
FROM, TO = "2025-03-01 00:00:00", "2025-09-30 23:59:59"
_RANGE = f"ts >= TIMESTAMP '{FROM}' AND ts <= TIMESTAMP '{TO}'"
_AT = lambda name: F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)
_at = lambda name: f"strftime({name}, '%Y-%m-%d %H:%M:%S') AS {name}"


def R_(s, d, where=None, columns=("request_id", "agent_id", "thread_id", "user_id", "ts", "response_length", "timings", "tokens", "rag", "success", "error_type", "model")):
    return rows(s, d, "responses", where, list(columns))


def Q_(s, d, where=None):
    return rows(s, d, "requests", where, ["agent_id", "thread_id", "user_id", "ts", "message_length", "model"])


def E_(s, d, where="not success and error_type is not null"):
    return logs.failures(R_(s, d, where, ["agent_id", "thread_id", "ts", "error_type", "success"]))


# conditions and scans

_FAILED = f"(SELECT * FROM {E})"
query("filter_log", f"SELECT id, agent_id, response_length FROM {sql('responses', f'agent_id = {chr(39)}agt-0017{chr(39)} AND {_RANGE}')}")(lambda s, d: R_(s, d, logs.condition("agt-0017", FROM, TO), ["agent_id", "response_length"]))
query("filter_log_requests", f"SELECT id, agent_id, message_length FROM {sql('requests', f'agent_id = {chr(39)}agt-0017{chr(39)} AND {_RANGE}')}")(lambda s, d: Q_(s, d, logs.condition("agt-0017", FROM, TO)).select("id", "agent_id", "message_length"))
query("filter_log_errors", f"SELECT id, agent_id, error_type, component FROM {E} WHERE {_RANGE}")(lambda s, d: E_(s, d, logs.condition(None, FROM, TO) & F.expr("not success and error_type is not null")).select("id", "agent_id", "error_type", "component"))
for _name in ("filter_query_options", "filter_pushdown_builder"):
    query(_name, f"SELECT id, thread_id, {_at('ts')} FROM (SELECT * FROM {Q} WHERE agent_id = 'agt-0017' AND {_RANGE} ORDER BY ts DESC, id LIMIT 20 OFFSET 5)")(
        lambda s, d: logs.page(Q_(s, d, logs.condition("agt-0017", FROM, TO)), F.desc("ts"), c("id"), offset=5, limit=20).select("id", "thread_id", _AT("ts"))
    )
query("src_requests_scan", f"SELECT id, agent_id, thread_id, user_id, message_length, model FROM (SELECT * FROM {Q} WHERE {_RANGE} ORDER BY ts DESC, id LIMIT 500 OFFSET 100)")(lambda s, d: logs.page(Q_(s, d, logs.condition(None, FROM, TO)), F.desc("ts"), c("id"), offset=100, limit=500).select("id", "agent_id", "thread_id", "user_id", "message_length", "model"))
query("src_responses_scan", f"SELECT id, request_id, agent_id, success, error_type FROM (SELECT * FROM {R} WHERE {_RANGE} ORDER BY ts DESC, id LIMIT 500 OFFSET 100)")(lambda s, d: logs.page(R_(s, d, logs.condition(None, FROM, TO)), F.desc("ts"), c("id"), offset=100, limit=500).select("id", "request_id", "agent_id", "success", "error_type"))
query("src_errors_scan", f"SELECT id, agent_id, error_type, component FROM (SELECT * FROM {E} ORDER BY ts DESC, id LIMIT 100 OFFSET 10)")(lambda s, d: logs.page(E_(s, d), F.desc("ts"), c("id"), offset=10, limit=100).select("id", "agent_id", "error_type", "component"))
for _name in ("src_mem_scan", "limit_offset"):
    query(_name, f"SELECT id, agent_id FROM (SELECT * FROM {Q} ORDER BY id LIMIT 50 OFFSET 20)")(lambda s, d: logs.page(Q_(s, d), c("id"), offset=20, limit=50).select("id", "agent_id"))
query("agg_counts_storage", f"SELECT count(*) AS n FROM {Q} WHERE {_RANGE}")(lambda s, d: Q_(s, d, logs.condition(None, FROM, TO)).agg(F.count("*").alias("n")))
query("agg_counts_mem", f"SELECT count(*) AS n FROM (SELECT id FROM {Q} WHERE {_RANGE} LIMIT 700 OFFSET 100)")(lambda s, d: Q_(s, d, logs.condition(None, FROM, TO)).offset(100).limit(700).agg(F.count("*").alias("n")))
query("agg_mem_stats", f"SELECT * FROM (SELECT count(*) AS requests FROM {Q}), (SELECT count(*) AS responses FROM {R}), (SELECT count(*) AS errors FROM {E})")(lambda s, d: logs.counts(requests=Q_(s, d), responses=R_(s, d, None, []), errors=E_(s, d)))
query("filter_docs_facets", f"SELECT id, lower(doc_type) AS doc_type FROM {C} WHERE lower(doc_type) = 'blog' AND contains(lower(title), 'how to')")(lambda s, d: rows(s, d, "cms_documents", "lower(doc_type) = 'blog' and contains(lower(title), 'how to')", ["doc_type", "title"]).select("id", F.lower("doc_type").alias("doc_type")))
query("filter_support_facets", f"SELECT id, lower(trim(category)) AS category, status FROM {K} WHERE lower(trim(category)) = 'billing' AND status IN ('resolved', 'closed') AND list_has_any(tags, ['summary', 'workflow', 'template', 'ledger', 'queue', 'policy'])")(
    lambda s, d: rows(s, d, "support_tickets", (F.lower(F.trim("category")) == "billing") & c("status").isin("resolved", "closed") & F.arrays_overlap("tags", F.array(*(F.lit(t) for t in ("summary", "workflow", "template", "ledger", "queue", "policy")))), ["category", "status", "tags"]).select("id", F.lower(F.trim("category")).alias("category"), "status")
)
query("set_intersect_tags", f"SELECT id, CAST(len(list_intersect(tags, ['summary', 'workflow', 'template', 'ledger'])) AS BIGINT) AS common FROM {K} WHERE list_has_any(tags, ['summary', 'workflow', 'template', 'ledger'])")(
    lambda s, d: rows(s, d, "support_tickets", F.arrays_overlap("tags", F.array(*(F.lit(t) for t in ("summary", "workflow", "template", "ledger")))), ["tags"]).select("id", F.size(F.array_intersect("tags", F.array(*(F.lit(t) for t in ("summary", "workflow", "template", "ledger"))))).cast("bigint").alias("common"))
)
query("filter_age", f"SELECT id FROM {K} WHERE created_at >= TIMESTAMP '2025-10-01' - INTERVAL 120 DAY")(lambda s, d: rows(s, d, "support_tickets", F.expr("created_at >= timestamp '2025-10-01' - interval 120 days"), ["created_at"]).select("id"))
query("filter_event_type", "SELECT event_id, event_type FROM events WHERE list_contains(['error', 'click'], event_type)")(lambda s, d: table(s, d, "events").where(F.array_contains(F.array(F.lit("error"), F.lit("click")), c("event_type"))).select("event_id", "event_type"))
query("filter_stock", f"SELECT id FROM {R} WHERE rag.cache_hit IS DISTINCT FROM FALSE")(lambda s, d: R_(s, d, "rag.cache_hit IS DISTINCT FROM false", ["rag"]).select("id"))

# projections

query("proj_request_row", f"SELECT message_id AS id, agent_id, thread_id, user_id, {_at('ts')}, CAST(coalesce(length(content), 0) AS BIGINT) AS message_length FROM {M} WHERE role = 'user'")(lambda s, d: logs.request_rows(rows(s, d, "thread_messages", "role = 'user'", ["agent_id", "thread_id", "user_id", "role", "ts", "content"])).withColumn("ts", _AT("ts")))
query("met_basic_request", f"SELECT message_id AS id, CAST(coalesce(length(content), 0) AS BIGINT) AS message_length FROM {M} WHERE role = 'user'")(lambda s, d: logs.request_rows(rows(s, d, "thread_messages", "role = 'user'", ["agent_id", "thread_id", "user_id", "role", "ts", "content"])).select("id", "message_length"))
query("proj_error_row", f"SELECT id, agent_id, thread_id, error_type, component FROM {E}")(lambda s, d: E_(s, d).select("id", "agent_id", "thread_id", "error_type", "component"))
query("proj_response_row", f"SELECT id, agent_id, success, error_type, CASE WHEN NOT success AND error_type IS NOT NULL THEN 'llm' END AS component FROM {R}")(lambda s, d: R_(s, d, None, ["agent_id", "success", "error_type"]).select("id", "agent_id", "success", "error_type", F.when(~c("success") & c("error_type").isNotNull(), "llm").alias("component")))
query("proj_basic_response", f"SELECT id, CAST(0 AS BIGINT) AS prompt_tokens, coalesce(tokens.total_tokens, 0) AS completion_tokens, coalesce(tokens.total_tokens, 0) AS total_tokens, TRUE AS success FROM {R}")(lambda s, d: logs.basic_responses(R_(s, d, None, ["tokens"])))
query("proj_message_pair", f"SELECT message_id, role, content FROM {M}")(lambda s, d: rows(s, d, "thread_messages", None, ["role", "content"]).select("message_id", "role", "content"))
query("proj_text_parts", f"SELECT id, concat_ws(' ', nullif(subject, ''), nullif(description, '')) AS text FROM {K}")(
    lambda s, d: rows(s, d, "support_tickets", None, ["subject", "description"]).select("id", F.array_join(F.filter(F.array("subject", "description"), lambda t: t.isNotNull() & (t != "")), " ").alias("text"))
)
query("proj_webhook_payload", f"SELECT message_id, CASE WHEN length(content) > 80 THEN substring(content, 1, 80) || '...' ELSE content END AS text, '{{\"event\":\"' || CASE role WHEN 'user' THEN 'request' ELSE 'response' END || '\",\"seq\":' || seq || '}}' AS payload FROM {M} WHERE role <> 'system'")(
    lambda s, d: rows(s, d, "thread_messages", "role <> 'system'", ["role", "seq", "content"]).select("message_id", texts.truncated(c("content"), 80).alias("text"), F.to_json(F.struct(F.when(c("role") == "user", "request").otherwise("response").alias("event"), "seq")).alias("payload"))
)

# correlations

query("join_req_res", f"SELECT r.id, coalesce(epoch_ms(r.ts) - epoch_ms(q.ts), 0) AS ms, coalesce(q.message_length, 0) AS asked_length FROM {R} r LEFT JOIN {Q} q ON q.id = r.request_id")(lambda s, d: logs.requests_with_answers(Q_(s, d), R_(s, d, None, ["request_id", "ts"])))
query("join_asof_response", f"SELECT r.id, r.thread_id, max_by(q.id, (q.ts, q.id)) AS request_id FROM (SELECT * FROM {R} WHERE thread_id IS NOT NULL) r LEFT JOIN {Q} q ON q.thread_id = r.thread_id AND q.ts <= r.ts GROUP BY r.id, r.thread_id")(
    lambda s, d: logs.preceding_request(Q_(s, d), R_(s, d, None, ["thread_id", "ts"]))
)
query("join_semi_ids", f"SELECT q.id FROM {Q} q WHERE EXISTS (SELECT 1 FROM {R} r WHERE r.request_id = q.id AND NOT r.success)")(lambda s, d: Q_(s, d).select("id").join(R_(s, d, "not success", ["request_id", "success"]).select(c("request_id").alias("id")), "id", "left_semi"))
query("join_index_fetch", f"SELECT thread_id, {_at('ts')} FROM (SELECT thread_id, max(ts) AS ts FROM {M} WHERE user_id IN (SELECT user_id FROM {Q} WHERE agent_id = 'agt-0017') AND thread_id IS NOT NULL GROUP BY thread_id)")(
    lambda s, d: rows(s, d, "thread_messages", "thread_id is not null", ["thread_id", "user_id", "ts"]).join(Q_(s, d, c("agent_id") == "agt-0017").select("user_id"), "user_id", "left_semi").groupBy("thread_id").agg(F.max("ts").alias("ts")).select("thread_id", _AT("ts"))
)
query("join_index_fetch_agents", "SELECT agent_id, organization_id FROM agents WHERE organization_id IN ('ten-001', 'ten-002', 'ten-010')")(lambda s, d: table(s, d, "agents").where(c("organization_id").isin("ten-001", "ten-002", "ten-010")).select("agent_id", "organization_id"))
query("join_cascade_delete", f"SELECT thread_id, count(*) AS n FROM {M} WHERE thread_id IS NOT NULL AND agent_id NOT IN (SELECT agent_id FROM agents WHERE organization_id = 'ten-010') GROUP BY thread_id")(
    lambda s, d: rows(s, d, "thread_messages", "thread_id is not null", ["thread_id", "agent_id"]).where("agent_id is not null").join(table(s, d, "agents").where("organization_id = 'ten-010'").select("agent_id"), "agent_id", "left_anti").groupBy("thread_id").agg(F.count("*").alias("n"))
)
query("set_except_keys", f"SELECT id FROM {Q} EXCEPT SELECT request_id FROM {R}")(lambda s, d: Q_(s, d).select("id").exceptAll(R_(s, d, "request_id is not null", ["request_id"]).select(c("request_id").alias("id")).distinct()))

# summaries

_RAG = ("vector_search_time", "embedding_time", "avg_similarity_score", "context_length")
_skip = lambda x: f"coalesce(avg(CASE WHEN {x} <> 0 AND NOT isnan(CAST({x} AS DOUBLE)) THEN CAST({x} AS DOUBLE) END), 0.0)"


def _rag(s, d, where=None):
    on = R_(s, d, F.expr("rag.enabled") if where is None else where & F.expr("rag.enabled"), ["rag", "timings", "success"])
    skip = lambda x: F.coalesce(F.avg(F.nullif(F.when(~F.isnan(c(x).cast("double")), c(x).cast("double")), F.lit(0.0))), F.lit(0.0))
    known = F.count("rag.cache_hit")
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return on.agg(F.count("*").alias("n"), F.coalesce(F.avg("rag.documents_retrieved"), F.lit(0.0)).alias("avg_documents"), *(skip(f"rag.{x}").alias(f"avg_{x}") for x in _RAG), skip("timings.rag_retrieval_time").alias("avg_rag_retrieval_time"), skip("timings.total").alias("avg_total"),
                  rate(F.count_if("rag.cache_hit"), known).alias("hit_rate"), rate(F.count_if(~c("rag.cache_hit")), known).alias("miss_rate"), rate(F.count_if("success"), F.count("*")).alias("success_rate"))


def _rag_sql(where: str) -> str:
    return f"""SELECT count(*) AS n, coalesce(avg(rag.documents_retrieved), 0.0) AS avg_documents, {', '.join(f'{_skip("rag." + x)} AS avg_{x}' for x in _RAG)}, {_skip('timings.rag_retrieval_time')} AS avg_rag_retrieval_time, {_skip('timings.total')} AS avg_total,
        coalesce(count(*) FILTER (WHERE rag.cache_hit) / nullif(count(rag.cache_hit), 0), 0.0) AS hit_rate, coalesce(count(*) FILTER (WHERE NOT rag.cache_hit) / nullif(count(rag.cache_hit), 0), 0.0) AS miss_rate,
        coalesce(count(*) FILTER (WHERE success) / nullif(count(*), 0), 0.0) AS success_rate FROM {R} WHERE rag.enabled AND {where}"""


query("agg_rag", _rag_sql("TRUE"))(_rag)
query("met_rag_api", _rag_sql(_RANGE))(lambda s, d: _rag(s, d, logs.condition(None, FROM, TO)))
_NONE = "agent_id = 'no such agent'"
query("met_empty", _rag_sql(_NONE))(lambda s, d: _rag(s, d, F.expr(_NONE)))

_CONV = """WITH q AS (SELECT * FROM {q}), t AS (SELECT count(*) AS threads, sum(size) AS inside, avg(ms) AS ms, count(*) FILTER (WHERE size = 1) AS single FROM (SELECT count(*) AS size, epoch_ms(max(ts)) - epoch_ms(min(ts)) AS ms FROM q WHERE thread_id IS NOT NULL GROUP BY thread_id)),
    u AS (SELECT count(*) AS users, count(*) FILTER (WHERE n > 1) AS back FROM (SELECT count(*) AS n FROM q WHERE user_id IS NOT NULL GROUP BY user_id)),
    l AS (SELECT count(*) AS messages, avg(message_length) AS len, count(*) FILTER (WHERE message_length >= 0 AND message_length < 50) AS length_0, count(*) FILTER (WHERE message_length >= 50 AND message_length < 200) AS length_1, count(*) FILTER (WHERE message_length >= 200 AND message_length < 500) AS length_2, count(*) FILTER (WHERE message_length >= 500) AS length_3 FROM q)
    SELECT threads, messages, inside / threads AS messages_per_thread, CAST(ms AS DOUBLE) AS avg_ms, single / threads AS abandonment, back / users AS return_rate, len AS avg_length, length_0, length_1, length_2, length_3 FROM t, u, l"""
query("agg_conversation", _CONV.format(q=Q))(lambda s, d: logs.conversation_summary(Q_(s, d)))
query("met_conversation_api", _CONV.format(q=f"(SELECT * FROM {Q} WHERE {_RANGE})"))(lambda s, d: logs.conversation_summary(Q_(s, d, logs.condition(None, FROM, TO))))

_ERR = """WITH e AS (SELECT * FROM {e}), r AS (SELECT count(*) AS responses FROM {r}), k AS (SELECT string_agg(error_type || ':' || n, ';' ORDER BY error_type || ':' || n) AS by_type FROM (SELECT error_type, count(*) AS n FROM e GROUP BY error_type)),
    o AS (SELECT count(*) AS errors, count(*) FILTER (WHERE component = 'llm') AS component_llm, count(*) FILTER (WHERE component = 'rag') AS component_rag, count(*) FILTER (WHERE component = 'plugin') AS component_plugin, count(*) FILTER (WHERE component = 'storage') AS component_storage,
        count(*) FILTER (WHERE component NOT IN ('llm', 'rag', 'plugin', 'storage')) AS component_other, count(*) FILTER (WHERE error_type = 'timeout') AS timeouts, count(*) FILTER (WHERE error_type = 'rate_limit') AS rate_limits FROM e)
    SELECT *, coalesce(errors / nullif(responses, 0), 0.0) AS error_rate, 1.0 - coalesce(errors / nullif(responses, 0), 0.0) AS success_rate FROM o, k, r"""
query("agg_errors", _ERR.format(e=E, r=R))(lambda s, d: logs.error_summary(E_(s, d), R_(s, d, None, [])))
query("met_error_api", _ERR.format(e=f"(SELECT * FROM {E} WHERE {_RANGE})", r=f"(SELECT * FROM {R} WHERE {_RANGE})"))(lambda s, d: logs.error_summary(E_(s, d, logs.condition(None, FROM, TO) & F.expr("not success and error_type is not null")), R_(s, d, logs.condition(None, FROM, TO), ["ts"])))
query("agg_thread_stats", f"SELECT thread_id, count(*) AS messages, {_at('min(ts)').split(' AS ')[0]} AS first_at, {_at('max(ts)').split(' AS ')[0]} AS last_at, min_by(agent_id, (ts, id)) AS agent_id FROM (SELECT id, thread_id, agent_id, ts FROM {Q} UNION ALL SELECT id, thread_id, agent_id, ts FROM {R}) WHERE thread_id IS NOT NULL GROUP BY thread_id")(
    lambda s, d: logs.thread_stats(Q_(s, d), R_(s, d, None, ["thread_id", "agent_id", "ts"])).withColumns({k: _AT(k) for k in ("first_at", "last_at")})
)
query("agg_user_sessions", f"SELECT user_id, id, {_at('ts')}, row_number() OVER (PARTITION BY user_id ORDER BY ts, id) AS position FROM {Q} WHERE user_id IS NOT NULL")(lambda s, d: logs.sessions(Q_(s, d, "user_id is not null")).withColumn("ts", _AT("ts")))
query("agg_summary", f"SELECT count(*) AS requests, count(DISTINCT thread_id) AS threads, count(DISTINCT user_id) AS users, {_at('min(ts)').split(' AS ')[0]} AS oldest, {_at('max(ts)').split(' AS ')[0]} AS newest, (SELECT count(*) FROM {R}) AS responses, (SELECT count(*) FROM {E}) AS errors FROM {Q}")(
    lambda s, d: logs.summary(Q_(s, d), R_(s, d, None, []), E_(s, d)).withColumns({k: _AT(k) for k in ("oldest", "newest")})
)
query("agg_console_stats", f"SELECT (SELECT count(*) FROM {Q}) AS requests, count(*) AS responses, (SELECT count(*) FROM {E}) AS errors, CAST(floor(avg(CASE WHEN NOT isnan(timings.total) THEN timings.total END) + 0.5) AS BIGINT) AS latency, CAST(floor(avg(tokens.total_tokens) + 0.5) AS BIGINT) AS tokens FROM {R}")(
    lambda s, d: R_(s, d, None, ["timings", "tokens"]).agg(F.count("*").alias("responses"), F.floor(F.avg(metrics.number("timings.total")) + 0.5).alias("latency"), F.floor(F.avg("tokens.total_tokens") + 0.5).alias("tokens")).crossJoin(logs.counts(requests=Q_(s, d), errors=E_(s, d)))
)
query("agg_mean", f"SELECT agent_id, coalesce(avg(message_length), 0.0) AS mean FROM {Q} GROUP BY agent_id")(lambda s, d: Q_(s, d).groupBy("agent_id").agg(F.coalesce(F.avg("message_length"), F.lit(0.0)).alias("mean")))
_T = "CASE WHEN NOT isnan(timings.total) THEN timings.total END"
query("agg_percentile", f"SELECT quantile_disc(t, 0.5) AS p500, quantile_disc(t, 0.75) AS p750, quantile_disc(t, 0.9) AS p900, quantile_disc(t, 0.95) AS p950, quantile_disc(t, 0.99) AS p990 FROM (SELECT {_T} AS t FROM {R})")(lambda s, d: percentiles.nearest_rank(R_(s, d, None, ["timings"]).select(metrics.number("timings.total").alias("v")), "v", (500, 750, 900, 950, 990)))
query("met_perf_api", f"SELECT count(*) AS n, coalesce(avg(t), 0.0) AS avg_total, coalesce(min(t), 0.0) AS min_total, coalesce(max(t), 0.0) AS max_total, coalesce(quantile_disc(t, 0.95), 0.0) AS p95 FROM (SELECT *, {_T} AS t FROM {R} WHERE agent_id = 'agt-0017' AND {_RANGE})")(
    lambda s, d: metrics.performance(R_(s, d, logs.condition("agt-0017", FROM, TO), ["timings"])).select("n", "avg_total", "min_total", "max_total", "p95")
)
query("agg_ingest_result", f"SELECT count(content) AS indexed, count(*) FILTER (WHERE content IS NULL) AS failed, coalesce(string_agg(CASE WHEN content IS NULL THEN id END, ',' ORDER BY id), '') AS failures FROM {C}")(
    lambda s, d: rows(s, d, "cms_documents", None, ["content"]).agg(F.count("content").alias("indexed"), F.count_if(c("content").isNull()).alias("failed"), F.array_join(F.slice(F.array_sort(F.collect_list(F.when(c("content").isNull(), c("id")))), 1, 1000), ",").alias("failures"))
)

# order


def _log(s, d):
    return R_(s, d, None, ["agent_id", "ts", "tokens"]).select("id", "agent_id", "ts", c("id").alias("seq"), F.coalesce("tokens.total_tokens", F.lit(0)).alias("tokens"))


_STARTS = {"hour": "date_trunc('hour', ts)", "day": "date_trunc('day', ts)", "week": "date_trunc('day', ts) - to_days(CAST(dayofweek(ts) AS INTEGER))", "month": "date_trunc('month', ts)"}


def _usage_sql(period: str) -> str:
    return f"""(SELECT id, agent_id, ts, '{period}' AS period, CAST(sum(t) OVER w AS BIGINT) AS used_after, CAST(sum(t) OVER w - t AS BIGINT) AS used_before, count(*) OVER w AS requests_after
        FROM (SELECT *, coalesce(tokens.total_tokens, 0) AS t FROM {R}) WINDOW w AS (PARTITION BY agent_id, {_STARTS[period]} ORDER BY ts, id ROWS UNBOUNDED PRECEDING))"""


def _usage(s, d):
    parts = [windows.usage(_log(s, d), "agent_id", p).select("id", "agent_id", F.lit(p).alias("period"), "used_after", "used_before", "requests_after") for p in windows.PERIODS]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


query("win_budget_usage", " UNION ALL ".join(f"SELECT id, agent_id, period, used_after, used_before, requests_after FROM {_usage_sql(p)}" for p in windows.PERIODS))(_usage)
_STATUS = f"(SELECT *, used_before >= 20000 AS exceeded, greatest(0, 20000 - used_before) AS left_over, used_before / CAST(20000 AS DOUBLE) * 100 AS percent FROM {_usage_sql('day')})"
query("win_budget_status", f"SELECT id, exceeded, left_over, round(percent, 6) AS percent FROM {_STATUS}")(lambda s, d: windows.status(_log(s, d), "agent_id", 20_000).select("id", "exceeded", "left_over", F.round("percent", 6).alias("percent")))
_WARN = f"(SELECT *, percent >= 80 AND NOT coalesce(bool_or(percent >= 80) OVER (PARTITION BY agent_id ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS warned FROM {_STATUS})"
query("win_budget_warning", f"SELECT id, agent_id FROM {_WARN} WHERE warned")(lambda s, d: windows.status(_log(s, d), "agent_id", 20_000).where("warned").select("id", "agent_id"))
query("win_budget_enforce", f"SELECT id, CASE WHEN exceeded THEN 'reject' WHEN warned THEN 'warn' ELSE 'pass' END AS decision FROM {_WARN}")(lambda s, d: windows.status(_log(s, d), "agent_id", 20_000).select("id", "decision"))
query("st_budget_state", f"SELECT agent_id, strftime({_STARTS['month']}, '%Y-%m-%d') AS month, CAST(sum(coalesce(tokens.total_tokens, 0)) AS BIGINT) AS used, count(*) AS requests FROM {R} GROUP BY ALL")(
    lambda s, d: _log(s, d).groupBy("agent_id", F.date_format(windows.period_start(c("ts"), "month"), "yyyy-MM-dd").alias("month")).agg(F.sum("tokens").alias("used"), F.count("*").alias("requests"))
)
query("pol_budget_after", f"SELECT id, CASE WHEN coalesce(tokens.total_tokens, 0) > 0 THEN tokens.total_tokens ELSE CAST(ceil(response_length / 4.0) AS BIGINT) END AS tokens FROM {R} WHERE response_length IS NOT NULL")(
    lambda s, d: R_(s, d, "response_length is not null", ["tokens", "response_length"]).select("id", F.coalesce(F.nullif("tokens.total_tokens", F.lit(0).cast("bigint")), F.ceil(c("response_length") / 4)).alias("tokens"))
)
query("fn_next_reset", f"SELECT id, strftime({_STARTS['hour']} + INTERVAL 1 HOUR, '%Y-%m-%d %H') AS hour_end, strftime({_STARTS['day']} + INTERVAL 1 DAY, '%Y-%m-%d') AS day_end, strftime({_STARTS['week']} + INTERVAL 7 DAY, '%Y-%m-%d') AS week_end, strftime({_STARTS['month']} + INTERVAL 1 MONTH, '%Y-%m-%d') AS month_end FROM {Q}")(
    lambda s, d: Q_(s, d).select("id", *(F.date_format(windows.next_reset(c("ts"), p), "yyyy-MM-dd HH" if p == "hour" else "yyyy-MM-dd").alias(f"{p}_end") for p in windows.PERIODS))
)
query("fn_time_bucket", f"SELECT id, strftime({_STARTS['hour']}, '%Y-%m-%d %H') AS hour, strftime({_STARTS['day']}, '%Y-%m-%d') AS day, strftime({_STARTS['week']}, '%Y-%m-%d') AS week FROM {Q}")(
    lambda s, d: Q_(s, d).select("id", *(F.date_format(windows.period_start(c("ts"), p), "yyyy-MM-dd HH" if p == "hour" else "yyyy-MM-dd").alias(p) for p in ("hour", "day", "week")))
)
query("st_tumbling", f"SELECT strftime({_STARTS['hour']}, '%Y-%m-%d %H') AS hour, count(*) AS n FROM {Q} GROUP BY ALL")(lambda s, d: Q_(s, d).groupBy(F.date_format(F.window("ts", "1 hour").start, "yyyy-MM-dd HH").alias("hour")).agg(F.count("*").alias("n")))

_LIMIT = f"""WITH RECURSIVE o AS (SELECT id, user_key, t, row_number() OVER (PARTITION BY user_key ORDER BY t, id) AS k FROM (SELECT id, coalesce(user_id, 'anonymous') AS user_key, epoch_ms(ts) AS t FROM {Q})),
    w AS (SELECT id, user_key, t, k, t + 86400000 AS reset, 1 AS used FROM o WHERE k = 1
    UNION ALL SELECT o.id, o.user_key, o.t, o.k, CASE WHEN o.t > w.reset THEN o.t + 86400000 ELSE w.reset END, CASE WHEN o.t > w.reset THEN 1 ELSE w.used + 1 END FROM w JOIN o ON o.user_key = w.user_key AND o.k = w.k + 1)"""


def _limited(s, d):
    log = Q_(s, d).select("id", F.coalesce("user_id", F.lit("anonymous")).alias("user_key"), F.unix_millis("ts").alias("ts_ms"), c("id").alias("seq"))
    return windows.rate_limit(log, "user_key", 3, 86_400_000)


query("win_rate_limit", f"{_LIMIT} SELECT id, user_key, CAST(used AS BIGINT) AS used, used <= 3 AS allowed, CAST(greatest(0, 3 - used) AS BIGINT) AS remaining, CAST(reset AS BIGINT) AS reset_ms, CAST(CASE WHEN used > 3 THEN ceil((reset - t) / 1000.0) ELSE 0 END AS BIGINT) AS retry_after FROM w")(
    lambda s, d: _limited(s, d).select("id", "user_key", "used", "allowed", "remaining", "reset_ms", "retry_after")
)
query("win_rate_usage", f"{_LIMIT} SELECT user_key, CAST(max_by(used, (t, id)) AS BIGINT) AS used, max_by(used, (t, id)) < 3 AS allowed FROM w GROUP BY user_key")(
    lambda s, d: _limited(s, d).groupBy("user_key").agg(F.max_by("used", F.struct("ts_ms", "id")).alias("used")).withColumn("allowed", c("used") < 3)
)
query("pol_rate_enforce", f"{_LIMIT} SELECT id, CASE WHEN used > 3 THEN 'reject' ELSE 'annotate' END AS decision FROM w")(lambda s, d: _limited(s, d).select("id", F.when(c("allowed"), "annotate").otherwise("reject").alias("decision")))
query("pol_rate_headers", f"{_LIMIT} SELECT id, '3;' || CAST(greatest(0, 3 - used) AS BIGINT) || ';' || CAST(reset AS BIGINT) AS header FROM w")(lambda s, d: _limited(s, d).select("id", F.concat_ws(";", F.lit("3"), c("remaining").cast("string"), c("reset_ms").cast("string")).alias("header")))
_CACHE = f"""WITH RECURSIVE o AS (SELECT id, model, t, row_number() OVER (PARTITION BY model ORDER BY t, id) AS k FROM (SELECT id, coalesce(model, '-') || ':' || agent_id AS model, epoch_ms(ts) AS t FROM {Q})),
    w AS (SELECT id, model, t, k, t AS made, FALSE AS hit FROM o WHERE k = 1
    UNION ALL SELECT o.id, o.model, o.t, o.k, CASE WHEN o.t - w.made >= 3600000 THEN o.t ELSE w.made END, o.t - w.made < 3600000 FROM w JOIN o ON o.model = w.model AND o.k = w.k + 1)"""


def _cached(s, d):
    return windows.cache(Q_(s, d).select("id", F.concat(F.coalesce("model", F.lit("-")), F.lit(":"), "agent_id").alias("key"), F.unix_millis("ts").alias("ts_ms"), c("id").alias("seq")), "key", 3_600_000)


for _name in ("win_cache_ttl", "win_cache_ttl_attrs", "win_cache_ttl_cms"):
    query(_name, f"{_CACHE} SELECT id, hit FROM w")(lambda s, d: _cached(s, d).select("id", "hit"))
query("agg_cache_stats", f"{_CACHE} SELECT count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses, printf('%.2f', count(*) FILTER (WHERE hit) / count(*)) AS rate FROM w")(lambda s, d: _cached(s, d).agg(F.count_if("hit").alias("hits"), F.count_if(~c("hit")).alias("misses"), F.printf(F.lit("%.2f"), F.try_divide(F.count_if("hit"), F.count("*"))).alias("rate")))
query("agg_cache_stats_cms", f"{_CACHE} SELECT count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses, printf('%.3f', count(*) FILTER (WHERE hit) / count(*)) AS rate FROM w")(lambda s, d: _cached(s, d).agg(F.count_if("hit").alias("hits"), F.count_if(~c("hit")).alias("misses"), F.printf(F.lit("%.3f"), F.try_divide(F.count_if("hit"), F.count("*"))).alias("rate")))
query("win_sample_every_n", f"SELECT id FROM (SELECT id, row_number() OVER (ORDER BY ts, id) AS k FROM {R}) WHERE k % 10 = 0")(lambda s, d: windows.every_nth(R_(s, d, None, ["ts"]), 10, "ts", "id").select("id"))
query("win_last_n_messages", f"SELECT message_id, thread_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY seq DESC) AS k FROM {M}) WHERE k <= 7")(lambda s, d: windows.last_n(rows(s, d, "thread_messages", None, ["thread_id", "seq"]), 7).select("message_id", "thread_id", "seq"))
query("win_recent_errors", f"SELECT id, agent_id, error_type FROM (SELECT * FROM {E} ORDER BY ts DESC, id LIMIT 10)")(lambda s, d: logs.page(E_(s, d), F.desc("ts"), c("id"), limit=10).select("id", "agent_id", "error_type"))
query("win_recent_history", f"SELECT id, coalesce(array_to_string(list_transform(messages[greatest(len(messages) - 4, 1):], lambda m: coalesce(m.role, '') || ': ' || coalesce(m.content, '')), chr(10)), '') AS text FROM {K}")(
    lambda s, d: rows(s, d, "support_tickets", None, ["messages"]).select("id", F.coalesce(F.array_join(F.transform(windows.tail(c("messages"), 5), lambda m: F.concat(F.coalesce(m["role"], F.lit("")), F.lit(": "), F.coalesce(m["content"], F.lit("")))), "\n"), F.lit("")).alias("text"))
)
query("win_chunk_position", f"SELECT id, agent_id, row_number() OVER (PARTITION BY agent_id ORDER BY created_at, id) - 1 AS position FROM {G}")(
    lambda s, d: rows(s, d, "rag_documents", None, ["agent_id", "created_at"]).withColumn("position", (F.row_number().over(Window.partitionBy("agent_id").orderBy("created_at", "id")) - 1).cast("bigint")).select("id", "agent_id", "position")
)
query("win_section_header", f"SELECT message_id, CASE WHEN lag(role) OVER w IS DISTINCT FROM role THEN role END AS header FROM {M} WHERE thread_id IS NOT NULL AND role IS NOT NULL WINDOW w AS (PARTITION BY thread_id ORDER BY seq)")(
    lambda s, d: windows.section_headers(rows(s, d, "thread_messages", "thread_id is not null and role is not null", ["thread_id", "seq", "role"]), "role", "seq", "thread_id").select("message_id", "header")
)
for _name in ("sort_updated_desc",):
    query(_name, f"SELECT id, row_number() OVER (ORDER BY updated_at DESC NULLS LAST, id) AS rank FROM {C}")(lambda s, d: ranked(rows(s, d, "cms_documents", None, ["updated_at"]), F.desc_nulls_last("updated_at"), F.asc("id")).select("id", "rank"))
query("sort_plugin_priority", "SELECT agent_id, row_number() OVER (ORDER BY coalesce(length(model), 100), agent_id) AS rank FROM agents")(lambda s, d: ranked(table(s, d, "agents").withColumn("priority", F.coalesce(F.length("model"), F.lit(100))), F.asc("priority"), F.asc("agent_id")).select("agent_id", "rank"))

# alerts

_TRIGGER = f"(SELECT id, timings.total AS latency, error_type, row_number() OVER (ORDER BY ts, id) AS k FROM {R})"


def _triggered(s, d):
    r = ranked(R_(s, d, None, ["ts", "timings", "error_type"]), "ts", "id", name="k")
    return r.select("id", moderation.trigger(metrics.number("timings.total"), c("error_type"), c("k"), 3000.0, ["time", "valid"], 50).alias("trigger")).where("trigger is not null")


for _name in ("fn_trigger_priority", "fn_trigger_priority_discord", "alert_after_slack", "alert_after_discord"):
    query(_name, f"SELECT * FROM (SELECT id, CASE WHEN k % 50 = 0 THEN 'sampling' WHEN contains(lower(error_type), 'time') OR contains(lower(error_type), 'valid') THEN 'keyword' WHEN NOT isnan(latency) AND latency > 3000 THEN 'long_response' END AS trigger FROM {_TRIGGER}) WHERE trigger IS NOT NULL")(_triggered)
for _name in ("fn_keyword_match", "alert_before_discord"):
    query(_name, f"SELECT message_id FROM {M} WHERE contains(lower(content), 'invoice') OR contains(lower(content), 'refund')")(lambda s, d: rows(s, d, "thread_messages", moderation.keywords(c("content"), ["Invoice", "refund"]), ["content"]).select("message_id"))
for _name in ("alert_error_slack", "alert_error_discord", "alert_error_webhook"):
    query(_name, f"SELECT id, '{{\"type\":\"error\",\"error\":\"' || error_type || '\",\"agent\":\"' || agent_id || '\"}}' AS payload FROM {E}")(lambda s, d: E_(s, d).select("id", F.to_json(F.struct(F.lit("error").alias("type"), c("error_type").alias("error"), c("agent_id").alias("agent"))).alias("payload")))
query("alert_before_webhook", f"SELECT id, '{{\"event\":\"request\",\"length\":' || coalesce(message_length, 0) || '}}' AS payload FROM {Q}")(lambda s, d: Q_(s, d).select("id", F.to_json(F.struct(F.lit("request").alias("event"), F.coalesce("message_length", F.lit(0)).alias("length"))).alias("payload")))
_KEYS = {"user": ("user_id", "anonymous"), "thread": ("thread_id", "unknown"), "agent": ("agent_id", "unknown")}
for _name in ("fn_bucket_key", "fn_budget_key"):
    query(_name, f"SELECT id, {', '.join(f'{chr(39)}{k}:{chr(39)} || coalesce(nullif({col}, {chr(39) * 2}), {chr(39)}{none}{chr(39)}) AS {k}_key' for k, (col, none) in _KEYS.items())}, 'global' AS global_key FROM {Q}")(
        lambda s, d: Q_(s, d).select("id", *(F.concat(F.lit(f"{k}:"), F.coalesce(F.nullif(c(col), F.lit("")), F.lit(none))).alias(f"{k}_key") for k, (col, none) in _KEYS.items()), F.lit("global").alias("global_key"))
    )
for _name, _cut in (("met_console_request", 100), ("met_console_response", 150)):
    query(_name, f"SELECT message_id, strftime(ts, '%H:%M:%S') || ' ' || substring(coalesce(agent_id, '-'), 1, 8) || ' ' || CASE WHEN length(t) > {_cut} THEN substring(t, 1, {_cut - 3}) || '...' ELSE t END AS line FROM (SELECT *, regexp_replace(replace(content, chr(10), ' '), '^{texts.BLANK}+|{texts.BLANK}+$', '', 'g') AS t FROM {M} WHERE content IS NOT NULL)")(
        lambda s, d, n=_cut: rows(s, d, "thread_messages", "content is not null", ["agent_id", "ts", "content"]).select("message_id", F.concat_ws(" ", F.date_format("ts", "HH:mm:ss"), F.substring(F.coalesce("agent_id", F.lit("-")), 1, 8), texts.truncated_line(c("content"), n)).alias("line"))
    )
query("met_console_error", f"SELECT id, substring(agent_id, 1, 8) || ' ' || error_type AS line FROM {E}")(lambda s, d: E_(s, d).select("id", F.concat_ws(" ", F.substring("agent_id", 1, 8), "error_type").alias("line")))
