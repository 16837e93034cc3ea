"""Retrieval: the most similar documents of each of a set of queries, with thresholds, facets and boosts.

Queries go over all documents in blocks: a block of at most BLOCK query vectors is handed to the workers, each batch of
documents gives its best for every query, and the lists are merged. Neither side is ever joined row by row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import ranked, stage

#: Query vectors of one pass over the documents.
BLOCK = 4096


def _score(ids: np.ndarray, vectors: np.ndarray, scopes: np.ndarray | None, k: int, floor: float):
    """Per batch of documents the best ``k`` for each query; norms of zero give 0."""
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch["vector"].values).astype(np.float64)
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            own = batch["id"].values
            order = np.argsort(own, kind="stable")  # of equal scores the smaller id
            x, own = x[order], own[order]
            scope = batch["scope"].values[order] if scopes is not None else None
            for at in range(0, len(ids), 256):
                s = np.round(unit[at : at + 256] @ x.T, 9)
                if scopes is not None:
                    s[scopes[at : at + 256, None] != scope[None, :]] = -9
                best = np.argsort(-s, axis=1, kind="stable")[:, :k]
                sims = np.take_along_axis(s, best, 1)
                r, c = np.nonzero(sims >= max(floor, -1.5))
                yield pd.DataFrame({"query_id": ids[at + r], "id": own[best[r, c]], "score": sims[r, c]})

    return run


def top_k(docs: DataFrame, queries: DataFrame, k: int, vector: str = "embedding", id_col: str = "id", scope: str | None = None, floor: float = -1.0) -> DataFrame:
    """``query_id, id, score, rank``: the ``k`` most similar documents of every query with a cosine of at least ``floor``; with
    ``scope`` only those with the query's value of it. Ties go to the smaller id. Null vectors and ones with nulls, NaN or another
    length than most have no score. ``queries`` and ``docs`` have ``id_col``, ``vector`` and ``scope``."""
    usable = lambda df: df.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x)))
    scoped = F.col(scope).cast("string") if scope else F.lit(None).cast("string")
    asked = usable(queries).select(F.col(id_col).alias("id"), F.col(vector).alias("vector"), scoped.alias("scope"))
    size = asked.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    kind = docs.schema[id_col].dataType.simpleString()
    shape = f"query_id {kind}, id {kind}, score double"
    if size is None:
        return docs.sparkSession.createDataFrame([], shape + ", rank int")
    asked = asked.where(F.size("vector") == size["n"])
    rows = usable(docs).where(F.size(vector) == size["n"]).select(F.col(id_col).alias("id"), F.col(vector).alias("vector"), scoped.alias("scope"))

    def scored(block: pd.DataFrame) -> DataFrame:
        run = _score(block["id"].values, np.stack(block["vector"].values).astype(np.float64), block["scope"].values if scope else None, k, floor)
        return rows.mapInPandas(run, shape)

    few = asked.limit(BLOCK + 1).toPandas()  # BLOCK + 1 rows at most
    if len(few) <= BLOCK:
        out = scored(few)
    else:
        asked, out = ranked(asked, "id", name="n"), None
        for at in range(0, asked.count(), BLOCK):
            part = stage(scored(asked.where((F.col("n") > at) & (F.col("n") <= at + BLOCK)).toPandas()), "scored")
            out = part if out is None else out.union(part)
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def again(scored: DataFrame, k: int) -> DataFrame:
    """Ranks anew after the scores have changed, and keeps ``k`` a query."""
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return scored.drop("rank").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def type_boost(score: Column, kind: Column, boosts: dict[str, float]) -> Column:
    """The score times the boost of its type, 1 where there is none."""
    out = F.lit(1.0)
    for name, x in boosts.items():
        out = F.when(kind == name, F.lit(float(x))).otherwise(out)
    return score * out


def recency_boost(score: Column, at: Column, now: Column, decay_days: float, most: float = 1.2) -> Column:
    """The score times up to ``most`` for new documents, falling to 1 over ``decay_days``; without a date unchanged, dates to come exceed ``most``."""
    age = (F.unix_millis(now) - F.unix_millis(at)) / 86_400_000.0
    fresh = F.greatest(F.lit(0.0), 1.0 - age / decay_days)
    return F.coalesce(score * (1.0 + (most - 1.0) * fresh), score)


def blend(score: Column, other: Column) -> Column:
    """Half of each; a missing second score counts as 0."""
    return 0.5 * score + 0.5 * F.coalesce(other, F.lit(0.0))


def numbered_context(ranked_docs: DataFrame, content: str = "content") -> DataFrame:
    """``query_id, context``: ``[rank] content`` of a query's documents, apart by blank lines; ``k`` documents a query at most are gathered."""
    line = F.struct("rank", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce(F.col(content), F.lit(""))).alias("t"))
    return ranked_docs.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["t"]), "\n\n").alias("context"))
