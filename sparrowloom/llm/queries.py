"""Queries of the training-data operators and their SQL, by name."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..runtime import latest, stage, table
from . import answers, leakage, markup, near_duplicates, packing, percentiles, personal_data, residue, splitting, vector_neighbours

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


# 1. near-duplicate records


@_query("p1_found")
def p1_found(spark, sf_dir):
    texts = near_duplicates.ticket_texts(table(spark, sf_dir, "support_tickets"))
    return near_duplicates.similar_pairs(texts, 3, 0.6).withColumnsRenamed({"a": "ticket_a", "b": "ticket_b"})


@_query("p1_members")
def p1_members(spark, sf_dir):
    """The class of equal texts of every record, with the parameters of p1_found."""
    return near_duplicates.members(near_duplicates.ticket_texts(table(spark, sf_dir, "support_tickets")), 3, 0.6)


@_query("p1_groups")
def p1_groups(spark, sf_dir):
    return near_duplicates.groups(near_duplicates.ticket_texts(table(spark, sf_dir, "support_tickets")))


# 4. most similar vectors

_VECTOR_TABLES = ("rag_documents", "cms_documents")


@_query("p4_found")
def p4_found(spark, sf_dir):
    parts = [vector_neighbours.similar_documents(table(spark, sf_dir, t)).select(F.lit(t).alias("source_table"), "id_a", "id_b") for t in _VECTOR_TABLES]
    return parts[0].union(parts[1])


@_query("p4_neighbours")
def p4_neighbours(spark, sf_dir):
    parts = [vector_neighbours.neighbours(table(spark, sf_dir, t)).select(F.lit(t).alias("source_table"), "id", "rank", "neighbour", "similarity") for t in _VECTOR_TABLES]
    return parts[0].union(parts[1])


# 5. percentiles


def _timings_sql(groups: str, days: bool) -> str:
    day = ", strftime(ts, '%Y-%m-%d') AS day" if days else ""
    parts = " UNION ALL ".join(f"SELECT {groups}, '{t}' AS metric, {t} AS v FROM once" for t in percentiles.TIMINGS)

    asked = ", ".join(f"({p})" for p in percentiles.PERMILLES)
    return f"""
        WITH one AS (SELECT DISTINCT ON (id) * FROM responses),
        once AS (SELECT agent_id{day}, {", ".join(f"timings.{t} AS {t}" for t in percentiles.TIMINGS)} FROM one),
        vals AS (SELECT * FROM ({parts}) WHERE v IS NOT NULL AND NOT isnan(v)),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY {groups}, metric ORDER BY v) AS r, count(*) OVER (PARTITION BY {groups}, metric) AS n FROM vals)
        SELECT {groups}, metric, CAST(permille AS INTEGER) AS permille, v AS value, n
        FROM ranked JOIN (VALUES {asked}) AS p(permille) ON r = greatest(1, (n * permille + 999) // 1000)
    """


@_query("p5_percentiles", _timings_sql("agent_id", False))
def p5_percentiles(spark, sf_dir):
    once, values = percentiles.response_timings(table(spark, sf_dir, "responses"))
    return percentiles.percentiles(once, ["agent_id"], values)


@_query("p5_daily", _timings_sql("agent_id, day", True))
def p5_daily(spark, sf_dir):
    once, values = percentiles.response_timings(table(spark, sf_dir, "responses"))
    return percentiles.percentiles(once, ["agent_id", "day"], values)


@_query("p5_combined")
def p5_combined(spark, sf_dir):
    """Percentiles per agent out of the kept counts of single days."""
    once, values = percentiles.response_timings(table(spark, sf_dir, "responses"))
    return percentiles.from_grid(stage(percentiles.grid_counts(once, ["agent_id", "day"], values), "day_counts"), ["agent_id"])


# 3. splitting

_CONTENT_TABLES = ("cms_documents", "rag_documents")


@_query("p3_found", " UNION ALL ".join(f"""
        SELECT DISTINCT '{t}' AS source_table, id AS record_id,
               CASE WHEN regexp_matches(content, '[^ \\t\\n\\r]{{1000}}[^ \\t\\n\\r]') THEN 'forced' ELSE 'natural' END AS cut_kind
        FROM {t} WHERE length(content) > 1000
    """ for t in _CONTENT_TABLES))
def p3_found(spark, sf_dir):
    parts = [splitting.cut_kinds(table(spark, sf_dir, t)).select(F.lit(t).alias("source_table"), "record_id", "cut_kind") for t in _CONTENT_TABLES]
    return parts[0].union(parts[1])


@_query("p3_pieces")
def p3_pieces(spark, sf_dir):
    parts = [splitting.pieces(latest(table(spark, sf_dir, t).select("id", "content"), "id")).select(F.lit(t).alias("source_table"), "*") for t in _CONTENT_TABLES]
    return parts[0].union(parts[1])


# 8. packing

CAPACITY = 2048


def _packed(spark, sf_dir):
    return packing.pack(stage(packing.token_counts(table(spark, sf_dir, "documents"), "doc_id", "text"), "token_counts"), CAPACITY)


@_query("p8_packed")
def p8_packed(spark, sf_dir):
    return _packed(spark, sf_dir).withColumnRenamed("item_id", "doc_id")


@_query("p8_fill")
def p8_fill(spark, sf_dir):
    """How full the containers are."""
    used = _packed(spark, sf_dir).groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("pieces"))
    return used.agg(F.count("*").alias("containers"), F.sum("pieces").alias("pieces"), F.sum("used").alias("tokens"), (F.sum("used") / (F.count("*") * CAPACITY)).alias("fill"), F.max("used").alias("fullest"))


# 9. leakage

_RUNS = """
    {k} AS (SELECT {i}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM {t} WHERE text IS NOT NULL),
    {k}_runs AS (SELECT DISTINCT {i}, array_to_string(w[n:n + 9], ' ') AS run FROM (SELECT {i}, w, unnest(range(1, len(w) - 8)) AS n FROM {k} WHERE len(w) >= 10))
"""


@_query("p9_found", f"WITH {_RUNS.format(k='d', i='doc_id', t='documents')}, {_RUNS.format(k='e', i='item_id', t='eval_items')} SELECT DISTINCT doc_id, item_id FROM d_runs JOIN e_runs USING (run)")
def p9_found(spark, sf_dir):
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


@_query("p9_report")
def p9_report(spark, sf_dir):
    """How many documents hold each leaked item, and how much of it at most."""
    found = leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return found.groupBy("item_id").agg(F.count("*").alias("documents"), F.max("words").alias("longest_run"), F.max("item_share").alias("largest_share"))


# 10. residue


@_query("p10_found")
def p10_found(spark, sf_dir):
    return residue.classify(table(spark, sf_dir, "documents"))


@_query("p10_kept")
def p10_kept(spark, sf_dir):
    return residue.kept(table(spark, sf_dir, "documents")).select("doc_id", "source", "doc_type")


# 7. defective answers


@_query("p7_found")
def p7_found(spark, sf_dir):
    return answers.defects(table(spark, sf_dir, "thread_messages"))


@_query("p7_labels")
def p7_labels(spark, sf_dir):
    return answers.labels(table(spark, sf_dir, "thread_messages"))


# 6. personal information


def _personal(spark, sf_dir, clean):
    texts = personal_data.texts_of(table(spark, sf_dir, "support_tickets"), table(spark, sf_dir, "thread_messages"))
    return personal_data.apply(texts, table(spark, sf_dir, "name_lexicon"), clean)


@_query("p6_found")
def p6_found(spark, sf_dir):
    return _personal(spark, sf_dir, False).select("source_table", "record_id", "pii_type").distinct()


@_query("p6_sanitised")
def p6_sanitised(spark, sf_dir):
    return _personal(spark, sf_dir, True).dropDuplicates(["source_table", "record_id"])


# 2. markup


@_query("p2_found")
def p2_found(spark, sf_dir):
    found = markup.convert(table(spark, sf_dir, "cms_documents"))
    return found.select(F.col("record_id").alias("cms_id"), F.explode("kinds").alias("markup_kind")).distinct()


@_query("p2_clean")
def p2_clean(spark, sf_dir):
    return markup.convert(table(spark, sf_dir, "cms_documents")).select(F.col("record_id").alias("cms_id"), "text").dropDuplicates(["cms_id"])
