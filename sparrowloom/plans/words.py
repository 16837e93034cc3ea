"""Moderation and text functions over the tables of texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import moderation, texts
from ..registry import query
from ..runtime import table
from .tables import C, G, K, M, rows

c = F.col
_WORDS = ("damn", "hell", "ass", "invoice", "template")
_TOPICS = {"Password": "block", "currency": "flag", "invoice": "flag"}
_TOKENS = r"list_transform(regexp_split_to_array(content, '[\s\x0B\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+'), lambda t: regexp_replace(lower(t), '[^a-z]', '', 'g'))"
_FOUND = f"list_filter({list(_WORDS)}, lambda p: list_contains({_TOKENS}, p))"


def _said(s, d):
    return rows(s, d, "thread_messages", "content is not null", ["content"])


def _stars(text: str, words) -> str:
    for w in words:
        text = f"CASE WHEN list_contains(f, '{w}') THEN regexp_replace({text}, '(?i)\\b{w}\\b', '{'*' * len(w)}', 'g') ELSE {text} END"
    return text


query("fn_profanity", f"SELECT message_id, array_to_string(f, ',') AS words, {_stars('content', _WORDS[3:])} AS text FROM (SELECT message_id, content, {_FOUND} AS f FROM {M} WHERE content IS NOT NULL)")(
    lambda s, d: _said(s, d).select("message_id", F.array_join(moderation.profane(c("content"), _WORDS), ",").alias("words"), moderation.without_profanity(c("content"), _WORDS[3:]).alias("text"))
)
query("set_profanity_words", f"SELECT unnest({sorted(moderation.word_list(moderation.PROFANITY, ['Foo', 'hell'], ['HELL', 'none']))}) AS word")(lambda s, d: s.createDataFrame([(w,) for w in moderation.word_list(moderation.PROFANITY, ["Foo", "hell"], ["HELL", "none"])], "word string"))
query("fn_blocked_topics", f"SELECT message_id, t AS topic, CAST(strpos(lower(content), lower(t)) - 1 AS BIGINT) AS start, CASE t WHEN 'Password' THEN 'block' ELSE 'flag' END AS action FROM (SELECT message_id, content, unnest({list(_TOPICS)}) AS t FROM {M}) WHERE contains(lower(content), lower(t))")(
    lambda s, d: _said(s, d).select("message_id", F.inline(moderation.topics(c("content"), _TOPICS))).withColumn("start", c("start").cast("bigint"))
)
_PII = moderation.PII
_HITS = " + ".join(f"len(regexp_extract_all(content, '{_PII[t]}'))" for t in moderation.DEFAULT)
_TOPIC_N = " + ".join(f"CAST(contains(lower(content), '{t.lower()}') AS INTEGER)" for t in _TOPICS)
_VERDICT = f"(SELECT message_id, role, content, CAST({_HITS} + len({_FOUND.replace(str(list(_WORDS)), str(list(moderation.PROFANITY)))}) + {_TOPIC_N} AS BIGINT) AS violations, contains(lower(content), 'password') AS blocked FROM {M} WHERE content IS NOT NULL)"


def _judged(s, d):
    v = moderation.verdict(c("content"), _TOPICS)
    return rows(s, d, "thread_messages", "content is not null", ["content", "role"]).select("message_id", "role", v.alias("v"))


for _name in ("pol_moderate", "pol_check"):
    query(_name, f"SELECT message_id, violations = 0 AS passed, violations, blocked FROM {_VERDICT}")(lambda s, d: _judged(s, d).select("message_id", c("v.passed").alias("passed"), c("v.violations").cast("bigint").alias("violations"), c("v.blocked").alias("blocked")))
for _name, _role in (("fn_moderate_input", "user"), ("fn_moderate_output", "assistant")):
    query(_name, f"SELECT message_id, CASE WHEN blocked THEN 'block' WHEN violations > 0 THEN 'mask' ELSE 'pass' END AS decision FROM {_VERDICT} WHERE role = '{_role}'")(
        lambda s, d, r=_role: _judged(s, d).where(c("role") == r).select("message_id", F.when(c("v.blocked"), "block").when(~c("v.passed"), "mask").otherwise("pass").alias("decision"))
    )
query("udf_pii_patterns", f"SELECT message_id, CAST(len(regexp_extract_all(content, '[A-Z]{{2,4}}-[0-9]{{4}}')) AS BIGINT) AS codes, regexp_replace(content, '[A-Z]{{2,4}}-[0-9]{{4}}', '[CODE]', 'g') AS text FROM {M} WHERE content IS NOT NULL")(
    lambda s, d: _said(s, d).select("message_id", F.size(moderation.pii(c("content"), (), {"code": "[A-Z]{2,4}-[0-9]{4}"})).cast("bigint").alias("codes"), moderation.masked(c("content"), (), {"code": "[A-Z]{2,4}-[0-9]{4}"}, "[CODE]").alias("text"))
)
query("fn_field_label", f"SELECT DISTINCT CASE k WHEN 'docType' THEN 'Doc Type' WHEN 'title' THEN 'Title' ELSE 'Long Field Name' END AS label FROM (SELECT unnest(['docType', 'title', 'longFieldName']) AS k FROM {C})")(
    lambda s, d: rows(s, d, "cms_documents", None, []).select(F.explode(F.array(F.lit("docType"), F.lit("title"), F.lit("longFieldName"))).alias("k")).select(texts.field_label(c("k")).alias("label")).distinct()
)
query("fn_field_value", f"SELECT id, array_to_string(tags, ', ') AS tags, '{{\"status\":\"' || status || '\"}}' AS shape FROM {K} WHERE status IS NOT NULL AND tags IS NOT NULL")(
    lambda s, d: rows(s, d, "support_tickets", "status is not null and tags is not null", ["status", "tags"]).select("id", F.array_join("tags", ", ").alias("tags"), F.to_json(F.struct("status")).alias("shape"))
)
query("fn_truncate_console", f"SELECT id, CASE WHEN length(t) > 40 THEN substring(t, 1, 37) || '...' ELSE t END AS line FROM (SELECT id, trim(replace(title, chr(10), ' ')) AS t FROM {C} WHERE title IS NOT NULL)")(lambda s, d: rows(s, d, "cms_documents", "title is not null", ["title"]).select("id", texts.truncated_line(c("title"), 40).alias("line")))
query("fn_product_embed_text", f"SELECT id, coalesce(content, '') || coalesce('. color: ' || metadata['color'], '') || coalesce('. material: ' || metadata['material'], '') AS text FROM {G}")(
    lambda s, d: rows(s, d, "rag_documents", None, ["content", "metadata"]).select("id", F.concat(F.coalesce("content", F.lit("")), *(F.coalesce(F.concat(F.lit(f". {k}: "), c("metadata")[k]), F.lit("")) for k in ("color", "material"))).alias("text"))
)
query("fn_ctx_docs", f"SELECT thread_id, string_agg(CASE WHEN prev IS DISTINCT FROM role THEN chr(10) || '## ' || role || chr(10) || chr(10) || chr(10) ELSE '' END || coalesce(content, ''), chr(10) || chr(10) ORDER BY seq, message_id) AS context FROM (SELECT *, lag(role) OVER (PARTITION BY thread_id ORDER BY seq, message_id) AS prev FROM {M} WHERE thread_id IS NOT NULL AND role IS NOT NULL) GROUP BY thread_id")(
    lambda s, d: _thread_context(s, d)
)


def _thread_context(s, d):
    from pyspark.sql import Window

    m = rows(s, d, "thread_messages", "thread_id is not null and role is not null", ["thread_id", "seq", "role", "content"])
    prev = F.lag("role").over(Window.partitionBy("thread_id").orderBy("seq", "message_id"))
    head = F.when(prev.isNull() | (prev != c("role")), F.concat(F.lit("\n## "), "role", F.lit("\n\n\n"))).otherwise("")
    part = m.withColumn("part", F.concat(head, F.coalesce("content", F.lit(""))))
    return part.groupBy("thread_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "message_id", "part"))), lambda x: x["part"]), "\n\n").alias("context"))


_ALERT = "'{\"text\":\"' || status || ' ' || id || '\",\"color\":' || CASE status WHEN 'open' THEN 15548997 ELSE 5763719 END || '}'"
for _name in ("fn_alert_slack", "fn_alert_discord"):
    query(_name, f"SELECT id, {_ALERT} AS payload FROM {K} WHERE status IS NOT NULL")(lambda s, d: rows(s, d, "support_tickets", "status is not null", ["status"]).select("id", F.to_json(F.struct(F.concat_ws(" ", "status", "id").alias("text"), F.when(c("status") == "open", 15548997).otherwise(5763719).alias("color"))).alias("payload")))
