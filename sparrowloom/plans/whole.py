"""Nine queries in both dialects, under the survey's names and under these with ``_whole``, as they were called
while the names stood for a smaller job. Positions
count code points. Null texts give no row. Failed responses are the log of errors; articles and
FAQs among the support documents are the CMS documents of these types.
"""

from __future__ import annotations

from .dialect import _add

_PII = {
    "email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "phone": r"(?:\+?1?[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}",
    "ssn": r"\b[0-9]{3}[-\s]?[0-9]{2}[-\s]?[0-9]{4}\b",
    "credit_card": r"\b(?:[0-9]{4}[-\s]?){3}[0-9]{4}\b",
}
_PROFANITY = ("damn", "hell", "ass", "shit", "fuck", "bitch", "bastard")
_TOPICS = ("password",)
#: Blanks as JavaScript's trim and \s take them.
_BLANK = r"[\s\x0B\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


class _Words:
    """The words in which the two dialects differ; patterns come with braces doubled for the formatters."""

    def __init__(self, duck: bool):
        self.duck = duck

    def re(self, pattern: str) -> str:
        doubled = pattern.replace("{", "{{").replace("}", "}}").replace("'", r"\x27")
        return f"'{doubled}'" if self.duck else f"r'{doubled}'"

    def replace(self, text: str, pattern: str, to: str) -> str:
        return f"regexp_replace({text}, {self.re(pattern)}, {to}" + (", 'g')" if self.duck else ")")

    def all(self, text: str, pattern: str) -> str:
        return f"regexp_extract_all({text}, {self.re(pattern)}" + (")" if self.duck else ", 0)")

    def gaps(self, text: str, pattern: str) -> str:
        return f"string_split_regex({text}, {self.re(pattern)})" if self.duck else f"split({text}, {self.re(pattern)}, -1)"

    def has(self, text: str, pattern: str) -> str:
        return f"{'regexp_matches' if self.duck else 'regexp_like'}({text}, {self.re(pattern)})"


def _both(name: str, make) -> None:
    """Under the survey's name, and under the one it had when that name stood for less."""
    for n in (name, f"{name}_whole"):
        _add(n, make(_Words(False)), make(_Words(True)))


def _one(name: str, sql: str) -> None:
    for n in (name, f"{name}_whole"):
        _add(n, sql)


def _masked(w: _Words, text: str) -> str:
    for pattern in _PII.values():
        text = w.replace(text, pattern, "'[REDACTED]'")
    return text


def _detect(w: _Words) -> str:
    found = " UNION ALL ".join(f"SELECT id, '{k}' AS sub_type, {w.all('description', p)} AS m, {w.gaps('description', p)} AS g FROM {{K}} WHERE description IS NOT NULL" for k, p in _PII.items())
    if w.duck:
        at = f"SELECT id, sub_type, m[i] AS text, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS INTEGER) AS start FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM ({found}))"
    else:
        at = f"SELECT id, sub_type, element_at(m, i) AS text, aggregate(slice(g, 1, i), 0, (a, x) -> a + length(x)) + aggregate(slice(m, 1, i - 1), 0, (a, x) -> a + length(x)) AS start FROM (SELECT *, explode(sequence(1, size(m))) AS i FROM ({found}) WHERE size(m) > 0)"
    return f"SELECT id, sub_type, text, start, CAST(start + length(text) AS INTEGER) AS stop FROM ({at})"


def _verdict(w: _Words) -> str:
    """Default personal data and profanity are masked, topics block; a blocked text has no moderated form."""
    tokens = f"regexp_split_to_array(content, {w.re(_BLANK + '+')})" if w.duck else f"split(content, {w.re(_BLANK + '+')}, -1)"
    words = f"list_transform({tokens}, lambda t: {w.replace('lower(t)', '[^a-z]', chr(39) * 2)})" if w.duck else f"transform({tokens}, t -> {w.replace('lower(t)', '[^a-z]', chr(39) * 2)})"
    has = "list_contains" if w.duck else "array_contains"
    pii = " OR ".join(w.has("content", p) for p in _PII.values())
    topic = " OR ".join(f"contains(lower(content), '{t}')" for t in _TOPICS)
    profane = " OR ".join(f"{has}(w, '{p}')" for p in _PROFANITY)
    inner = f"SELECT message_id, {words} AS w, {pii} AS pii, {topic} AS topic, {_masked(w, 'content')} AS text FROM {{M}} WHERE content IS NOT NULL"
    for p in _PROFANITY:
        masked = w.replace("text", rf"(?i)\b{p}\b", f"'{'*' * len(p)}'")
        inner = f"SELECT message_id, w, pii, topic, CASE WHEN {has}(w, '{p}') THEN {masked} ELSE text END AS text FROM ({inner})"
    return f"SELECT message_id, NOT (pii OR topic OR {profane}) AS passed, topic AS blocked, CASE WHEN topic THEN NULL ELSE text END AS moderated_text FROM ({inner})"


def _strip(w: _Words) -> str:
    text = "content"
    for pattern, to in ((r"(?i)<script[^>]*>[\s\S]*?</script>", "''"), (r"(?i)<style[^>]*>[\s\S]*?</style>", "''"), ("<[^>]+>", "' '"), ("&nbsp;", "' '"), ("&amp;", "'&'"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "chr(39)"), (_BLANK + "+", "' '")):
        text = w.replace(text, pattern, to)
    return f"SELECT id, trim({text}) AS text FROM {{C}} WHERE content IS NOT NULL"


def _chunks(w: _Words) -> str:
    starts = "CAST(unnest(range(0, length(content), 800)) AS INTEGER)" if w.duck else "explode(sequence(0, length(content) - 1, 800))"
    trimmed = w.replace("substring(content, start + 1, 1000)", f"^{_BLANK}+|{_BLANK}+$".replace("$", r"\z"), "''")
    return f"SELECT * FROM (SELECT id, start, {trimmed} AS chunk FROM (SELECT id, content, {starts} AS start FROM {{G}} WHERE length(content) > 0)) WHERE length(chunk) > 0"


_SUPPORT = "SELECT id, agent_id, 'ticket' AS kind, status FROM {K} UNION ALL SELECT id, agent_id, lower(doc_type) AS kind, NULL AS status FROM {C} WHERE lower(doc_type) IN ('faq', 'article')"

_both("fn_pii_detect", _detect)
_both("fn_pii_mask", lambda w: f"SELECT id, {_masked(w, 'description')} AS text FROM {{K}} WHERE description IS NOT NULL")
_both("fn_moderation_verdict", _verdict)
_both("fn_strip_html", _strip)
_both("fn_chunk_fixed", _chunks)
_one("fn_support_boost", f"SELECT id, kind, CAST(CASE WHEN kind = 'faq' THEN 1.3 WHEN kind = 'ticket' AND status = 'resolved' THEN 1.2 ELSE 1.0 END AS DOUBLE) AS boost FROM ({_SUPPORT})")
_one("sink_delete_older", " UNION ALL ".join(f"SELECT '{name}' AS log, count_if(ts < TIMESTAMP '2025-06-01 00:00:00') AS deleted, count_if(ts >= TIMESTAMP '2025-06-01 00:00:00') AS kept FROM {rows}" for name, rows in (("requests", "{Q}"), ("responses", "{R}"), ("errors", "{R} WHERE NOT success"))))
_one("agg_support_stats", f"SELECT agent_id, count(*) AS documents, {', '.join(f'count_if(kind = {k!r}) AS {k}s' for k in ('ticket', 'faq', 'article'))}, {', '.join(f'count_if(kind = {chr(39)}ticket{chr(39)} AND status = {s!r}) AS {s}' for s in ('open', 'pending', 'resolved', 'closed'))} FROM ({_SUPPORT}) GROUP BY agent_id")
_one(
    "agg_mongo_rollup",
    """SELECT coalesce(q.agent_id, r.agent_id) AS agent_id, coalesce(q.n, 0) AS requests, coalesce(r.n, 0) AS responses, coalesce(r.errors, 0) AS errors,
    coalesce(r.latency, 0) AS avg_latency, coalesce(r.tokens, 0) AS tokens, coalesce(r.errors / CAST(r.n AS DOUBLE), 0) AS error_rate
    FROM (SELECT agent_id, count(*) AS n FROM {Q} GROUP BY agent_id) q FULL JOIN
    (SELECT agent_id, count(*) AS n, count_if(NOT success) AS errors, avg(CASE WHEN NOT isnan(timings.total) THEN timings.total END) AS latency, CAST(sum(coalesce(tokens.total_tokens, 0)) AS BIGINT) AS tokens FROM {R} GROUP BY agent_id) r
    ON q.agent_id IS NOT DISTINCT FROM r.agent_id""",
)
