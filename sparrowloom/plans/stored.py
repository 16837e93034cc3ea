"""Writes and the entity store. The batch of a write is the later half of the table by time, its keys and changes are rules over
the ids, so that the SQL can say what has to come out."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import texts
from ..operators import logs, store, windows
from ..registry import query
from ..runtime import latest, table
from .events import E_, Q_, R_
from .tables import C, E, G, K, M, Q, R, rows

c = F.col
_NO = "CAST(regexp_extract(id, '[0-9]+$') AS BIGINT)"
_no = lambda: F.regexp_extract("id", "[0-9]+$", 0).cast("bigint")
_NOW = "strftime(TIMESTAMP '2026-01-01', '%Y-%m-%d')"
_now = lambda: F.lit("2026-01-01").cast("timestamp")
_day = lambda x: F.date_format(x, "yyyy-MM-dd").alias(x)


def _cms(s, d):
    return rows(s, d, "cms_documents", None, ["tenant_id", "agent_id", "doc_type", "title", "content", "created_at", "updated_at"])


def _scoped(df):
    """The key of a document: tenant, id and agent, or shared."""
    return df.withColumn("agent_id", F.coalesce("agent_id", F.lit("shared")))


# upserts: documents with an even number are there, those divisible by 3 arrive

_UPSERT = f"""SELECT tenant_id, id, coalesce(agent_id, 'shared') AS agent_id, CASE WHEN no % 3 = 0 THEN coalesce(lower(doc_type), CASE WHEN no % 2 = 0 THEN doc_type END, 'content') ELSE doc_type END AS doc_type,
    CASE WHEN no % 2 = 0 THEN strftime(created_at, '%Y-%m-%d') ELSE {_NOW} END AS created_at, CASE WHEN no % 3 = 0 THEN {_NOW} ELSE strftime(updated_at, '%Y-%m-%d') END AS updated_at FROM (SELECT *, {_NO} AS no FROM {C}) WHERE no % 2 = 0 OR no % 3 = 0"""


def _upserted(s, d):
    docs = _scoped(_cms(s, d)).withColumn("no", _no()).select("tenant_id", "id", "agent_id", "doc_type", "created_at", "updated_at", "no")
    old, new = docs.where("no % 2 = 0").drop("no"), docs.where("no % 3 = 0").select("tenant_id", "id", "agent_id", F.lower("doc_type").alias("doc_type"))
    out = store.upsert(old, new, ["tenant_id", "id", "agent_id"], _now())
    return out.withColumn("doc_type", F.when(_no() % 3 == 0, F.coalesce("doc_type", F.lit("content"))).otherwise(c("doc_type"))).withColumns({x: _day(x) for x in ("created_at", "updated_at")})


query("sink_upsert_cms", _UPSERT)(_upserted)


def _halves(s, d, name="rag_documents"):
    docs = rows(s, d, name, None, ["agent_id", "content"]).withColumn("no", _no())
    return docs.where("no % 2 = 0").select("id", "agent_id", "content"), docs.where("no % 3 = 0").select("id", "agent_id", F.upper("content").alias("content"))


_G = f"(SELECT *, {_NO} AS no FROM {G})"
_REPLACED = f"SELECT id, agent_id, CASE WHEN no % 3 = 0 THEN upper(content) ELSE content END AS content FROM {_G} WHERE no % 2 = 0 OR no % 3 = 0"
for _name in ("sink_upsert_product", "join_upsert_full"):
    query(_name, _REPLACED)(lambda s, d: store.replace(*_halves(s, d), ["id"]))
for _name in ("sink_upsert_default",):
    query(_name, f"SELECT id, agent_id, CASE WHEN no % 2 = 0 THEN content ELSE upper(content) END AS content FROM {_G} WHERE no % 2 = 0 OR no % 3 = 0")(lambda s, d: store.insert_new(*_halves(s, d), ["id"]))
query("sink_append_mem", f"SELECT count(*) AS n FROM (SELECT id FROM {_G} WHERE no % 2 = 0 UNION ALL SELECT id FROM {_G} WHERE no % 3 = 0)")(lambda s, d: _halves(s, d)[0].unionByName(_halves(s, d)[1]).agg(F.count("*").alias("n")))
query("sink_append_log")(lambda s, d: _written(s, E_(s, d)))
query("sink_export", f"SELECT id, agent_id, error_type FROM {E}")(lambda s, d: _written(s, E_(s, d).select("id", "agent_id", "error_type")))


def _written(s, df):
    from uuid import uuid4

    from ..runtime import shared_dir

    path = f"{shared_dir(s)}/stored-{uuid4().hex}"
    store.replace_table(df, path)
    return store.read_table(s, path)


# updates

for _name, _set in (("sink_update_cms", "lower"), ("sink_update_default", "upper")):
    query(_name, f"SELECT id, CASE WHEN no % 5 = 0 THEN coalesce({_set}(content), content) ELSE content END AS content, doc_type, CASE WHEN no % 5 = 0 THEN {_NOW} ELSE strftime(updated_at, '%Y-%m-%d') END AS updated_at FROM (SELECT *, {_NO} AS no FROM {C})")(
        lambda s, d, f=getattr(F, _set): store.update(_cms(s, d).select("id", "content", "doc_type", "updated_at"), _cms(s, d).where(_no() % 5 == 0).select("id", f("content").alias("content")), "id", _now()).withColumn("updated_at", _day("updated_at"))
    )
query("sink_update_support", f"SELECT id, CASE WHEN no % 4 = 0 THEN 'closed' ELSE status END AS status, priority FROM (SELECT *, {_NO} AS no FROM {K})")(
    lambda s, d: store.update(rows(s, d, "support_tickets", None, ["status", "priority"]), rows(s, d, "support_tickets", _no() % 4 == 0, []).select("id", F.lit("closed").alias("status"), F.lit(None).cast("string").alias("priority")), "id")
)
query("sink_update_product", f"SELECT id, CASE WHEN no % 7 = 0 THEN 'new' ELSE metadata['color'] END AS color, metadata['item'] AS item FROM {_G}")(
    lambda s, d: rows(s, d, "rag_documents", None, ["metadata"]).withColumn("metadata", F.when(_no() % 7 == 0, F.map_concat(F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, v: k != "color"), F.create_map(F.lit("color"), F.lit("new")))).otherwise(c("metadata"))).select("id", c("metadata")["color"].alias("color"), c("metadata")["item"].alias("item"))
)

# deletions

for _name, _tab, _sql in (("sink_delete_cms", "cms_documents", C), ("sink_delete_product", "rag_documents", G), ("sink_delete_default", "rag_documents", G), ("sink_delete_support", "support_tickets", K)):
    query(_name, f"SELECT id FROM {_sql} WHERE {_NO} % 6 <> 0")(lambda s, d, t=_tab: store.delete(rows(s, d, t, None, []), rows(s, d, t, _no() % 6 == 0, []), ["id"]))
for _name, _tab, _sql in (("ret_clear_agent_default", "rag_documents", G), ("ret_clear_agent_support", "support_tickets", K), ("ent_clear_agent_docs", "rag_documents", G)):
    query(_name, f"SELECT id FROM {_sql} WHERE agent_id <> 'agt-0017'")(lambda s, d, t=_tab: rows(s, d, t, "agent_id <> 'agt-0017'", ["agent_id"]).select("id"))
for _name in ("sink_clear", "ret_clear_all", "ent_clear_mem"):
    query(_name, f"SELECT count(*) AS n FROM {G} WHERE FALSE")(lambda s, d: rows(s, d, "rag_documents", None, []).limit(0).agg(F.count("*").alias("n")))
_CUT = "TIMESTAMP '2025-06-01 00:00:00'"
_cut = lambda: F.lit("2025-06-01 00:00:00").cast("timestamp")
for _name, _strict, _op in (("sink_delete_older_mem", False, "<"), ("sink_retention", True, "<=")):
    query(_name, " UNION ALL ".join(f"SELECT '{n}' AS log, count(*) FILTER (WHERE ts {_op} {_CUT}) AS deleted, count(*) FILTER (WHERE NOT coalesce(ts {_op} {_CUT}, FALSE)) AS kept FROM {t}" for n, t in (("requests", Q), ("responses", R), ("errors", E))))(
        lambda s, d, x=_strict: store.deleted_and_kept(Q_(s, d), _cut(), x).select(F.lit("requests").alias("log"), "*").union(store.deleted_and_kept(R_(s, d, None, ["ts"]), _cut(), x).select(F.lit("responses").alias("log"), "*")).union(store.deleted_and_kept(E_(s, d), _cut(), x).select(F.lit("errors").alias("log"), "*"))
    )


def _changes(s, d):
    docs = rows(s, d, "rag_documents", None, ["agent_id", "content"]).withColumn("no", _no())
    old = docs.where("no % 2 = 0").select("id", "content")
    ops = [docs.where(f"no % {n} = 0").select(F.lit(i).alias("seq"), F.lit(op).alias("op"), "id", F.concat(F.lit(f"{op} "), "id").alias("content")) for i, (op, n) in enumerate((("insert", 3), ("update", 5), ("delete", 7)))]
    return old, ops[0].union(ops[1]).union(ops[2])


_AFTER = f"""SELECT id, CASE WHEN no % 5 = 0 AND no % 2 = 0 THEN 'update ' || id WHEN no % 3 = 0 AND no % 5 <> 0 THEN 'insert ' || id ELSE content END AS content FROM {_G} WHERE no % 7 <> 0 AND (no % 2 = 0 OR no % 3 = 0 AND no % 5 <> 0)"""
for _name in ("sink_bulk", "sink_bulk_cms"):
    query(_name, _AFTER)(lambda s, d: store.apply_changes(*_changes(s, d), "id")[0])
query("orc_delete_fanout", f"SELECT sum(n) AS deleted FROM (SELECT count(*) AS n FROM {G} WHERE {_NO} % 6 = 0 UNION ALL SELECT count(*) FROM {C} WHERE {_NO} % 6 = 0)".replace("sum(n)", "CAST(sum(n) AS BIGINT)"))(
    lambda s, d: rows(s, d, "rag_documents", _no() % 6 == 0, []).select("id").union(rows(s, d, "cms_documents", _no() % 6 == 0, []).select("id")).agg(F.count("*").alias("deleted"))
)

# chunks

_PARAGRAPH = "paragraph"


def _chunked(s, d):
    docs = rows(s, d, "rag_documents", None, ["agent_id", "content", "created_at"])
    return docs.select("id", "agent_id", "created_at", F.posexplode(texts.slices(c("content"), 500, 100)).alias("pos", "chunk"))


_CHUNKS = f"""(SELECT id, agent_id, created_at, row_number() OVER (PARTITION BY id ORDER BY start) - 1 AS pos, chunk FROM (SELECT id, agent_id, created_at, start, trim(substring(content, CAST(start AS INTEGER) + 1, 500), e' \\t\\n\\r') AS chunk
    FROM (SELECT *, unnest(range(0, length(content), 400)) AS start FROM {G} WHERE length(content) > 0)) WHERE length(chunk) > 0)"""
query("sink_ingest_chunks", f"SELECT id || '-chunk-' || pos AS chunk_id, length(chunk) AS length FROM {_CHUNKS}")(lambda s, d: _chunked(s, d).select(F.concat_ws("-chunk-", "id", c("pos").cast("string")).alias("chunk_id"), F.length("chunk").cast("bigint").alias("length")))
query("sink_delete_chunks", f"SELECT count(*) AS deleted FROM {_CHUNKS} WHERE {_NO} % 6 = 0")(lambda s, d: _chunked(s, d).where(_no() % 6 == 0).agg(F.count("*").alias("deleted")))
query("sink_update_chunks", f"SELECT id, count(*) AS chunks, max(length(chunk)) AS longest FROM {_CHUNKS} GROUP BY id")(
    lambda s, d: store.delete(_chunked(s, d), rows(s, d, "rag_documents", _no() % 6 == 0, []), ["id"]).select("id", "chunk").union(
        rows(s, d, "rag_documents", _no() % 6 == 0, ["content"]).select("id", F.explode(texts.slices(F.lower("content"), 500, 100)))
    ).groupBy("id").agg(F.count("*").alias("chunks"), F.max(F.length("chunk")).cast("bigint").alias("longest"))
)
_fixture = lambda: F.concat(F.lit("# "), F.coalesce("title", F.lit("T")), F.lit("\n\n"), F.coalesce("content", F.lit("")), F.lit("\n```sql\nSELECT 1\n```\n"))
query("fn_chunk_markdown")(lambda s, d: texts.chunk_markdown(_cms(s, d).select("id", _fixture().alias("t")), "id", "t"))
query("agg_chunk_stats")(lambda s, d: texts.chunk_markdown(_cms(s, d).select("id", _fixture().alias("t")), "id", "t").groupBy("type").agg(F.count("*").alias("n")))
query("fn_chunk_paragraph")(lambda s, d: table(s, d, "documents").select("doc_id", F.posexplode(texts.paragraphs(c("text"))).alias("pos", "chunk")))
query("fn_chunk_sentence")(lambda s, d: table(s, d, "documents").select("doc_id", F.posexplode(texts.sentences(c("text"))).alias("pos", "chunk")))

# support texts

_TICKET = f"""SELECT id, concat_ws(chr(10), 'Subject: ' || nullif(subject, ''), 'Issue: ' || nullif(description, ''), 'Resolution: ' || nullif(resolution, ''), 'Category: ' || nullif(category, '')) AS text FROM {K}"""


def _ticket_text(s, d):
    line = lambda label, x: F.when(c(x) != "", F.concat(F.lit(f"{label}: "), x))
    return rows(s, d, "support_tickets", None, ["subject", "description", "resolution", "category"]).select("id", F.concat_ws("\n", line("Subject", "subject"), line("Issue", "description"), line("Resolution", "resolution"), line("Category", "category")).alias("text"))


for _name in ("sink_upsert_support", "ret_ingest_tickets"):
    query(_name, _TICKET)(_ticket_text)
query("ret_ingest_faqs", f"SELECT id, title || chr(10) || content AS text FROM {C} WHERE title IS NOT NULL AND content IS NOT NULL")(lambda s, d: rows(s, d, "cms_documents", "title is not null and content is not null", ["title", "content"]).select("id", F.concat("title", F.lit("\n"), "content").alias("text")))

# entities

_THREADS = f"(SELECT thread_id AS id, min_by(agent_id, seq) AS agent_id, min_by(user_id, seq) AS user_id, min(ts) AS created_at, max(ts) AS updated_at, count(*) AS messages FROM {M} WHERE thread_id IS NOT NULL GROUP BY thread_id)"


def _messages(s, d, where="thread_id is not null"):
    return rows(s, d, "thread_messages", where, ["thread_id", "seq", "agent_id", "user_id", "role", "content", "ts"])


def _threads(s, d):
    first = lambda x: F.min(F.struct("seq", "message_id", x))[x].alias(x)
    return _messages(s, d).groupBy(c("thread_id").alias("id")).agg(first("agent_id"), first("user_id"), F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"), F.count("*").alias("messages"))


for _name in ("ent_create_agent", "ent_create_agent_mongo", "ent_create_agent_redis"):
    query(_name, "SELECT agent_id, agent_name FROM agents UNION ALL SELECT agent_id || '-copy' AS agent_id, agent_name FROM agents WHERE provider IS NOT NULL")(lambda s, d: table(s, d, "agents").select("agent_id", "agent_name").union(table(s, d, "agents").where("provider is not null").select(F.concat("agent_id", F.lit("-copy")), "agent_name")))
for _name in ("ent_get_agent", "ent_get_agent_mem", "ent_get_agent_redis"):
    query(_name, "SELECT agent_id, agent_name, provider, model FROM agents WHERE agent_id = 'agt-0017'")(lambda s, d: table(s, d, "agents").where("agent_id = 'agt-0017'").select("agent_id", "agent_name", "provider", "model"))
for _name in ("ent_update_agent", "ent_update_agent_mem", "ent_update_agent_redis"):
    query(_name, "SELECT agent_id, CASE WHEN organization_id = 'ten-010' THEN 'renamed' ELSE agent_name END AS agent_name, model FROM agents")(
        lambda s, d: store.update(table(s, d, "agents").select("agent_id", "agent_name", "model"), table(s, d, "agents").where("organization_id = 'ten-010'").select("agent_id", F.lit("renamed").alias("agent_name"), F.lit(None).cast("string").alias("model")), "agent_id")
    )
for _name in ("ent_list_agents_mongo",):
    query(_name, "SELECT agent_id FROM agents WHERE organization_id = 'ten-010'")(lambda s, d: table(s, d, "agents").where("organization_id = 'ten-010'").select("agent_id"))
query("ent_delete_agent_redis", f"SELECT agent_id, count(*) AS messages FROM {M} WHERE agent_id <> 'agt-0017' GROUP BY agent_id")(lambda s, d: _messages(s, d, "agent_id <> 'agt-0017'").groupBy("agent_id").agg(F.count("*").alias("messages")))
_THREAD_ROWS = f"SELECT id, strftime(created_at, '%Y-%m-%d') AS created_at, strftime(updated_at, '%Y-%m-%d') AS updated_at, messages FROM {_THREADS}"
_days = lambda df: df.select("id", _day("created_at"), _day("updated_at"), "messages")
for _name in ("ent_create_thread", "ent_create_thread_mongo"):
    query(_name, f"SELECT id, messages FROM {_THREADS} UNION ALL SELECT id || '-new' AS id, CAST(0 AS BIGINT) AS messages FROM {_THREADS} WHERE messages = 1")(lambda s, d: _threads(s, d).select("id", "messages").union(_threads(s, d).where("messages = 1").select(F.concat("id", F.lit("-new")), F.lit(0).cast("bigint"))))
for _name in ("ent_get_thread", "ent_get_thread_mem", "ent_get_thread_redis"):
    query(_name, f"{_THREAD_ROWS} WHERE id = 'thr-000000146'")(lambda s, d: _days(_threads(s, d).where("id = 'thr-000000146'")))
for _name in ("ent_update_thread", "ent_update_thread_mem", "ent_update_thread_redis"):
    query(_name, f"SELECT id, CASE WHEN messages > 5 THEN {_NOW} ELSE strftime(updated_at, '%Y-%m-%d') END AS updated_at FROM {_THREADS}")(lambda s, d: store.update(_threads(s, d).select("id", "updated_at"), _threads(s, d).where("messages > 5").select("id"), "id", _now()).withColumn("updated_at", _day("updated_at")))
for _name in ("ent_delete_thread", "ent_delete_thread_mem", "ent_delete_thread_mongo"):
    query(_name, f"SELECT id, messages FROM {_THREADS} WHERE messages >= 3")(lambda s, d: store.delete(_threads(s, d), _threads(s, d).where("messages < 3"), ["id"]).select("id", "messages"))
query("ent_list_threads_mongo", f"SELECT id, messages FROM (SELECT * FROM {_THREADS} WHERE agent_id = 'agt-0017' ORDER BY updated_at DESC, id LIMIT 100)")(lambda s, d: _threads(s, d).where("agent_id = 'agt-0017'").orderBy(F.desc("updated_at"), "id").limit(100).select("id", "messages"))


def _added(s, d):
    old = _messages(s, d)
    ends = old.groupBy("thread_id").agg(F.max("seq").alias("seq"), F.max("ts").alias("ts"))
    new = ends.select(F.concat("thread_id", F.lit("-m")).alias("message_id"), "thread_id", F.lit(None).cast("bigint").alias("seq"), F.lit(None).cast("string").alias("agent_id"), F.lit(None).cast("string").alias("user_id"), F.lit("user").alias("role"), F.lit("More").alias("content"), "ts")
    strange = new.limit(1).withColumns({"thread_id": F.lit("none"), "message_id": F.lit("none-m")})
    return store.add_messages(old, new.drop("seq").union(strange.drop("seq")))


for _name in ("ent_add_message", "ent_add_message_redis", "ent_add_message_mongo"):
    query(_name, f"SELECT thread_id, count(*) + 1 AS messages, max(seq) + 1 AS last_seq FROM {M} WHERE thread_id IS NOT NULL GROUP BY thread_id")(lambda s, d: _added(s, d).groupBy("thread_id").agg(F.count("*").alias("messages"), F.max("seq").alias("last_seq")))
for _name in ("ent_get_messages_mongo", "ent_get_messages_redis"):
    query(_name, f"SELECT message_id, thread_id, role, content FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY seq DESC) AS k FROM {M} WHERE thread_id IS NOT NULL) WHERE k <= 5")(lambda s, d: windows.last_n(_messages(s, d), 5).select("message_id", "thread_id", "role", "content"))
for _name in ("ent_context_mem", "ent_context_mongo", "ent_context_redis"):
    query(_name, f"SELECT thread_id, seq, role, content FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY seq DESC) AS k FROM {M} WHERE thread_id IS NOT NULL AND role <> 'system') WHERE k <= 20")(lambda s, d: store.context(_messages(s, d)))
_TYPES = {"thread_id": "string", "role": "string", "content": "string", "seq": "bigint", "ts": "timestamp"}


def _encoded(s, d):
    return store.encode_hash(_messages(s, d).withColumnRenamed("message_id", "id"), list(_TYPES))


query("ent_encode_redis", " UNION ALL ".join(f"SELECT message_id AS id, '{x}' AS field, CAST({x} AS VARCHAR) AS value FROM {M} WHERE thread_id IS NOT NULL AND {x} IS NOT NULL" for x in _TYPES if x != "ts"))(lambda s, d: _encoded(s, d).where("field <> 'ts'"))
for _name in ("ent_decode_redis", "ent_decode_redis_agent", "ent_decode_mongo_thread"):
    query(_name, f"SELECT message_id AS id, thread_id, role, content, seq, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM {M} WHERE thread_id IS NOT NULL")(lambda s, d: store.decode_hash(_encoded(s, d), _TYPES).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")))
query("ent_decode_mongo_agent", "SELECT agent_id AS id, agent_name, provider FROM agents")(lambda s, d: store.decode_hash(store.encode_hash(table(s, d, "agents").withColumnRenamed("agent_id", "id"), ["agent_name", "provider"]), {"agent_name": "string", "provider": "string"}))
query("ent_redis_key", f"SELECT DISTINCT concat_ws(':', 'app', 'thread', thread_id) AS key FROM {M} WHERE thread_id IS NOT NULL")(lambda s, d: _messages(s, d).select(F.concat_ws(":", F.lit("app"), F.lit("thread"), "thread_id").alias("key")).distinct())
for _name in ("agg_storage_stats", "agg_storage_stats_redis"):
    query(_name, f"SELECT (SELECT count(*) FROM agents) AS agents, count(*) AS threads, CAST(sum(messages) AS BIGINT) AS messages FROM {_THREADS}")(lambda s, d: _threads(s, d).agg(F.count("*").alias("threads"), F.sum("messages").alias("messages")).crossJoin(table(s, d, "agents").agg(F.count("*").alias("agents"))))
query("st_token_stream", f"SELECT thread_id, string_agg(coalesce(content, ''), '' ORDER BY seq, message_id) AS text FROM {M} WHERE thread_id IS NOT NULL AND role = 'assistant' GROUP BY thread_id")(
    lambda s, d: _messages(s, d, "thread_id is not null and role = 'assistant'").groupBy("thread_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "message_id", F.coalesce("content", F.lit("")).alias("t")))), lambda x: x["t"]), "").alias("text"))
)
