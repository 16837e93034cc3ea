"""The tables as SQL and as DataFrames, every delivery once."""

from __future__ import annotations

from ..runtime import once

_KEYS = {"thread_messages": "message_id"}


def sql(name: str, where: str = "TRUE") -> str:
    return f"(SELECT DISTINCT ON ({_KEYS.get(name, 'id')}) * FROM {name} WHERE {where})"


R, Q, M, K, C, G = (sql(t) for t in ("responses", "requests", "thread_messages", "support_tickets", "cms_documents", "rag_documents"))
#: Failed responses as the log of errors.
E = f"(SELECT id, agent_id, thread_id, ts, error_type, 'llm' AS component FROM {sql('responses', 'NOT success AND error_type IS NOT NULL')})"


def rows(spark, sf_dir, name, where=None, columns=None):
    return once(spark, sf_dir, name, _KEYS.get(name, "id"), where, columns)
