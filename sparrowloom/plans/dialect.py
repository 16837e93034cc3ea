"""Queries that Spark SQL states in the words that DuckDB takes, too, but for a few functions.

``{R}``, ``{Q}``, ``{M}``, ``{K}``, ``{C}`` and ``{G}`` stand for the responses, requests, messages,
tickets, CMS and retrieval documents with every delivery once."""

from __future__ import annotations

from ..registry import query
from ..runtime import latest, table

_VIEWS = {"R": ("responses", "id"), "Q": ("requests", "id"), "M": ("thread_messages", "message_id"), "K": ("support_tickets", "id"), "C": ("cms_documents", "id"), "G": ("rag_documents", "id")}
_PLAIN = ("agents", "documents", "orders", "events")


def _add(name: str, sql: str, duck: str | None = None) -> None:
    """Registers a statement; ``duck`` where DuckDB words it otherwise."""
    oracle = (duck or sql).format_map({k: f"(SELECT DISTINCT ON ({key}) * FROM {t})" for k, (t, key) in _VIEWS.items()} | {t: t for t in _PLAIN})

    def run(spark, d):
        frames = {k: latest(table(spark, d, t), key) for k, (t, key) in _VIEWS.items() if "{" + k + "}" in sql}
        frames |= {t: table(spark, d, t) for t in _PLAIN if "{" + t + "}" in sql}
        return spark.sql(sql, **frames)

    query(name, oracle)(run)


_add("agg_default_stats", "SELECT agent_id, count(*) AS n FROM {G} GROUP BY agent_id")
_add("join_thread_agent", "SELECT q.id, q.agent_id, a.agent_name FROM {Q} q JOIN {agents} a ON q.agent_id = a.agent_id")
_add("join_anti_existing", "SELECT q.id FROM {Q} q LEFT ANTI JOIN {R} r ON r.request_id = q.id", "SELECT id FROM {Q} q WHERE NOT EXISTS (SELECT 1 FROM {R} r WHERE r.request_id = q.id)")
_add("sort_agents_desc", "SELECT agent_id, organization_id FROM {agents} ORDER BY created_at DESC, agent_id LIMIT 50")
_add("set_union_all", "SELECT id, 'rag' AS kind FROM {G} UNION ALL SELECT id, 'cms' AS kind FROM {C}")
_add("set_distinct", "SELECT DISTINCT provider, model FROM {R}")
_add("fn_estimate_tokens", "SELECT id, CAST(ceil(length(content) / 4.0) AS BIGINT) AS tokens FROM {G} WHERE content IS NOT NULL")
_add("fn_latency_band", "SELECT id, CASE WHEN timings.total < 500 THEN 'green' WHEN timings.total < 2000 THEN 'yellow' ELSE 'red' END AS band FROM {R} WHERE timings.total IS NOT NULL")
_add("fn_truncate_ellipsis", "SELECT message_id, CASE WHEN length(content) > 100 THEN concat(substring(content, 1, 100), '...') ELSE content END AS text FROM {M} WHERE content IS NOT NULL")
_add("fn_url_to_id", "SELECT id, substring(regexp_replace(regexp_replace(regexp_replace(url, '^https?://', ''), '[^a-zA-Z0-9]+', '-'), '^-|-$', ''), 1, 100) AS page FROM {C} WHERE url IS NOT NULL", "SELECT id, substring(regexp_replace(regexp_replace(regexp_replace(url, '^https?://', ''), '[^a-zA-Z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 1, 100) AS page FROM {C} WHERE url IS NOT NULL")

_MAIL = "[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+[.][a-zA-Z][a-zA-Z]+"
_SPACE = "[ \t\n\r]+"
_add("fn_clean_text", f"SELECT id, trim(regexp_replace(content, '{_SPACE}', ' ')) AS text FROM {{C}} WHERE content IS NOT NULL", f"SELECT id, trim(regexp_replace(content, '{_SPACE}', ' ', 'g')) AS text FROM {{C}} WHERE content IS NOT NULL")
_add("fn_time_of_day", "SELECT id, date_format(ts, 'HH:mm:ss.SSS') AS at FROM {Q}", "SELECT id, strftime(ts, '%H:%M:%S.%g') AS at FROM {Q}")
