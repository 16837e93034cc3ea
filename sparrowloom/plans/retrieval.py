"""Retrieval over the vectors: every document whose number is divisible by 20 asks all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval
from ..registry import query
from .tables import rows

_NO = "CAST(regexp_extract(id, '[0-9]+$') AS BIGINT)"
_USABLE = "embedding IS NOT NULL AND len(embedding) = 64 AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x)))"
_COS = "round(coalesce(CASE WHEN list_sum(list_transform(q.v, lambda x: x * x)) = 0 OR list_sum(list_transform(d.v, lambda x: x * x)) = 0 THEN 0 ELSE list_cosine_similarity(q.v, d.v) END, 0), 9)"


def _asked(df):
    return df.where(F.regexp_extract("id", "[0-9]+$", 0).cast("bigint") % 20 == 0)


def _sql(table: str, scope: str | None = None, floor: float = -1.0, k: int = 5, where: str = "TRUE", keep: str = "agent_id") -> str:
    """``query_id, id, score, rank`` and the columns ``keep`` of the document."""
    same = f"AND q.{scope} IS NOT DISTINCT FROM d.{scope}" if scope else ""
    return f"""(WITH docs AS (SELECT DISTINCT ON (id) *, CAST(embedding AS DOUBLE[]) AS v FROM {table} WHERE {_USABLE}),
        pairs AS (SELECT q.id AS query_id, d.id AS id, {_COS} AS score, {', '.join(f'd.{c}' for c in keep.split(', '))} FROM (SELECT * FROM docs WHERE {_NO} % 20 = 0) q JOIN (SELECT * FROM docs WHERE {where}) d ON TRUE {same})
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM pairs WHERE score >= {floor} QUALIFY rank <= {k})"""


def _out(df, *more):
    return df.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"), *more)


_SHOWN = "query_id, id, round(score, 6) AS score, CAST(rank AS BIGINT) AS rank"


def _rag(s, d):
    return rows(s, d, "rag_documents", columns=["agent_id", "embedding", "content", "created_at"])


def _cms(s, d):
    return rows(s, d, "cms_documents", columns=["tenant_id", "agent_id", "doc_type", "title", "url", "content", "embedding", "created_at"])


query("filter_tenant_scope", f"SELECT {_SHOWN} FROM {_sql('rag_documents', 'agent_id')}")(lambda s, d: _out(retrieval.top_k(_rag(s, d), _asked(_rag(s, d)), 5, scope="agent_id")))
query("join_query_docs", f"SELECT {_SHOWN} FROM {_sql('rag_documents')}")(lambda s, d: _out(retrieval.top_k(_rag(s, d), _asked(_rag(s, d)), 5)))
query("topk_docs", f"SELECT {_SHOWN} FROM {_sql('rag_documents', None, 0.7, 5, 'length(content) > 200')}")(lambda s, d: _out(retrieval.top_k(_rag(s, d).where("length(content) > 200"), _asked(_rag(s, d)), 5, floor=0.7)))
query("topk_vector_atlas", f"SELECT {_SHOWN} FROM {_sql('cms_documents', 'tenant_id', -1.0, 10)}")(lambda s, d: _out(retrieval.top_k(_cms(s, d), _asked(_cms(s, d)), 10, scope="tenant_id")))

_BOOSTS, _NOW = {"blog": 1.1, "article": 1.2}, "2026-01-01 00:00:00"
_TYPE = "CASE lower(doc_type) WHEN 'blog' THEN CAST(1.1 AS DOUBLE) WHEN 'article' THEN CAST(1.2 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END"
_AGE = f"((epoch_ms(TIMESTAMP '{_NOW}') - epoch_ms(created_at)) / CAST(86400000 AS DOUBLE))"
_FRESH = f"coalesce(1 + CAST(0.2 AS DOUBLE) * greatest(0, 1 - {_AGE} / 90), 1)"


def _raw_cms(s, d):
    """Twice as many as are wanted, of which those below 0.3 are left out, with what the boosts need."""
    docs = _cms(s, d)
    found = retrieval.top_k(docs, _asked(docs), 20).where("score >= 0.3")
    return found.join(docs.select("id", F.lower("doc_type").alias("doc_type"), "title", "url", "content", "created_at"), "id")


_RAW = f"(SELECT * FROM {_sql('cms_documents', None, -1.0, 20, 'TRUE', 'doc_type, title, url, content, created_at')} WHERE score >= 0.3)"
_now = lambda: F.lit(_NOW).cast("timestamp")
query("fn_type_boost", f"SELECT query_id, id, round(score * {_TYPE}, 6) AS score FROM {_RAW}")(lambda s, d: _raw_cms(s, d).select("query_id", "id", F.round(retrieval.type_boost(F.col("score"), F.col("doc_type"), _BOOSTS), 6).alias("score")))
query("fn_recency_boost", f"SELECT query_id, id, round(score * {_FRESH}, 6) AS score FROM {_RAW}")(lambda s, d: _raw_cms(s, d).select("query_id", "id", F.round(retrieval.recency_boost(F.col("score"), F.col("created_at"), _now(), 90.0), 6).alias("score")))


def _boosted(s, d):
    score = retrieval.recency_boost(retrieval.type_boost(F.col("score"), F.col("doc_type"), _BOOSTS), F.col("created_at"), _now(), 90.0)
    return retrieval.again(_raw_cms(s, d).withColumn("score", score), 10)


_BOOSTED = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM (SELECT * EXCLUDE (score, rank), score * {_TYPE} * {_FRESH} AS score FROM {_RAW})) WHERE rank <= 10)"
query("topk_cms", f"SELECT {_SHOWN} FROM {_BOOSTED}")(lambda s, d: _out(_boosted(s, d)))
query("fn_rerank_blend", f"SELECT query_id, id, round(0.5 * score + 0.5 * coalesce(length(title) / CAST(100 AS DOUBLE), 0), 6) AS score FROM {_RAW}")(
    lambda s, d: _raw_cms(s, d).select("query_id", "id", F.round(retrieval.blend(F.col("score"), F.length("title") / F.lit(100.0)), 6).alias("score"))
)
query("limit_prefix", f"SELECT {_SHOWN} FROM {_BOOSTED} WHERE rank <= 3")(lambda s, d: _out(_boosted(s, d).where("rank <= 3")))
query("agg_result_type_counts", f"SELECT query_id, lower(doc_type) AS doc_type, count(*) AS n FROM {_BOOSTED} GROUP BY ALL")(lambda s, d: _boosted(s, d).groupBy("query_id", "doc_type").agg(F.count("*").alias("n")))
query("agg_avg_score", f"SELECT query_id, round(coalesce(avg(score), 0), 6) AS score FROM {_BOOSTED} GROUP BY ALL")(lambda s, d: _boosted(s, d).groupBy("query_id").agg(F.round(F.coalesce(F.avg("score"), F.lit(0.0)), 6).alias("score")))
query("agg_distinct_types", f"SELECT query_id, string_agg(DISTINCT lower(doc_type), ',' ORDER BY lower(doc_type)) AS types FROM {_BOOSTED} GROUP BY ALL")(lambda s, d: _boosted(s, d).groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_set("doc_type")), ",").alias("types")))
query("fn_ctx_default", f"SELECT query_id, string_agg('[' || rank || '] ' || coalesce(content, ''), chr(10) || chr(10) ORDER BY rank) AS context FROM {_BOOSTED} GROUP BY ALL")(lambda s, d: retrieval.numbered_context(_boosted(s, d)))


def _sections(s, d):
    """A block per document: title or type, type, address, content; the header first."""
    head = F.coalesce(F.nullif("title", F.lit("")), F.concat("doc_type", F.lit(" ("), "id", F.lit(")")))
    line = lambda label, c: F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.concat(F.lit(f"**{label}:** "), c))
    block = F.concat_ws("\n", F.concat(F.lit("### "), head), line("Type", "doc_type"), line("URL", "url"), F.lit(""), F.coalesce("content", F.lit("")), F.lit(""))
    made = _boosted(s, d).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("t")))).alias("b"))
    return made.select("query_id", F.concat(F.lit("## Relevant Content\n\n"), F.array_join(F.transform("b", lambda x: x["t"]), "\n")).alias("context"))


query("fn_ctx_cms", f"""SELECT query_id, '## Relevant Content' || chr(10) || chr(10) || string_agg(concat_ws(chr(10), '### ' || coalesce(nullif(title, ''), lower(doc_type) || ' (' || id || ')'), '**Type:** ' || nullif(lower(doc_type), ''),
    '**URL:** ' || nullif(url, ''), '', coalesce(content, ''), ''), chr(10) ORDER BY rank) AS context FROM {_BOOSTED} GROUP BY ALL""")(_sections)

_MISS = "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"
for _name in ("fn_cosine", "fn_cosine_docs", "fn_cosine_support"):

    @query(_name, f"SELECT a.vec_id AS vec_id, round(list_cosine_similarity(a.v, b.v), 9) AS score FROM ({_MISS}) a JOIN ({_MISS}) b ON b.vec_id = a.vec_id + 1")
    def _cosine(s, d):
        from ..functions import vectors
        from ..runtime import table

        e = table(s, d, "embeddings")
        nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
        return e.join(nxt, "vec_id").select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("other")), 9).alias("score"))
