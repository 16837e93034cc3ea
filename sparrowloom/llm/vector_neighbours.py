"""The k most similar vectors of a collection for every vector of it.

Vectors are put into shards of about SHARD_ROWS by centroids fitted on a bounded
sample; each shard gets a small-world graph (:mod:`.hnsw`), in which its own
vectors, and those of other shards that lie almost as near, look for their
neighbours; the results of the shards are merged.

* Sample: at most ``SAMPLE`` vectors, those of the smallest hash of the id. All
  vectors are indexed and all are queries.
* Shards: the sample is clustered into fine cells, and the most similar cells are
  merged as long as a shard stays within its size, so that a topic is rarely cut.
  A shard that holds more than twice SHARD_ROWS all the same is split by hash and
  searched in all its splits.
* Equal vectors are one class, indexed once, and expanded at the end; of a class
  only the k + 1 first ids are ever needed.

Usable are vectors of exactly ``dim`` finite numbers that are not all zero; rows
with others, or with a null id, get no neighbours and are none. Ties in the
similarity go to the smaller id. Recall against brute force is measured in the
tests (0.9 at least).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import stage
from .hnsw import Graph

SHARD_ROWS = 8000
SAMPLE = 200_000
#: A vector is also searched for in the shards whose centroid is at most so much less similar than the nearest one.
MARGIN = 0.10
#: Shards a vector is searched for in, at most.
PROBES = 3


def _unit(raw: np.ndarray) -> np.ndarray:
    # in double, so that long and short vectors keep their direction
    wide = raw.astype(np.float64)
    wide /= np.abs(wide).max(axis=1, keepdims=True)
    return wide / np.sqrt((wide * wide).sum(axis=1, keepdims=True))


def fit_shards(sample: np.ndarray, shards: int, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of fine cells and the shard of each cell."""
    n = len(sample)
    cells = int(min(max(4 * shards, 32), max(1, n // 20)))
    if shards <= 1 or cells <= 1:
        return sample[:1].copy(), np.zeros(1, np.int64)
    rng = np.random.RandomState(7)
    # spread starts: of a few random vectors the one least like the chosen ones
    start = [int(rng.randint(n))]
    best = sample @ sample[start[0]]
    for _ in range(cells - 1):
        tried = rng.randint(n, size=8)
        pick = int(tried[np.argmin(best[tried])])
        start.append(pick)
        np.maximum(best, sample @ sample[pick], out=best)
    centres = sample[start].copy()
    for _ in range(rounds):
        own = np.concatenate([(sample[i : i + 20_000] @ centres.T).argmax(1) for i in range(0, n, 20_000)])
        sums = np.zeros_like(centres, dtype=np.float64)
        np.add.at(sums, own, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-12), centres).astype(np.float32)
    share = np.bincount(own, minlength=cells) / n
    limit = max(1.5 / shards, 1e-9)
    return centres, merge_cells(centres, share, limit)


def merge_cells(centres: np.ndarray, share: np.ndarray, limit: float) -> np.ndarray:
    """Number of the shard of each cell: the two most similar cells whose shares together stay
    within ``limit`` are merged, until there are none such. Every cell knows its best partner,
    and a merger asks anew only for the cells whose partner it was: time and memory grow
    with the square of the cells, and with the cells."""
    cells = len(centres)
    label, share, alive = np.arange(cells), share.astype(np.float64).copy(), np.ones(cells, bool)
    sums = centres.astype(np.float64) * share[:, None]
    unit = centres.astype(np.float32).copy()
    best, partner = np.full(cells, -9.0), np.zeros(cells, np.int64)

    def ask(rows: np.ndarray) -> None:
        for at in range(0, len(rows), 1000):
            r = rows[at : at + 1000]
            like = unit[r] @ unit.T
            like[:, ~alive] = -9
            like[share[r][:, None] + share[None, :] > limit] = -9
            like[np.arange(len(r)), r] = -9
            partner[r] = like.argmax(axis=1)
            best[r] = like[np.arange(len(r)), partner[r]]

    ask(np.arange(cells))
    while True:
        a = int(best.argmax())
        if best[a] <= -9:
            break
        b = int(partner[a])
        label[label == b] = a
        sums[a] += sums[b]
        share[a] += share[b]
        alive[b], best[b] = False, -9
        unit[a] = sums[a] / max(np.linalg.norm(sums[a]), 1e-12)
        stale = np.flatnonzero(alive & ((partner == a) | (partner == b)) & (best > -9))
        ask(np.union1d(stale, [a]))
        # others may now like the merged cell best
        like = unit @ unit[a]
        better = alive & (like > best) & (share + share[a] <= limit)
        better[a] = False
        best[better], partner[better] = like[better], a
    return np.unique(label, return_inverse=True)[1]


def _route(centres: np.ndarray, label: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shards = int(label.max()) + 1
        for batch in batches:
            if not len(batch):
                continue
            x = _unit(np.array(batch["vector"].tolist(), np.float32)).astype(np.float32)
            like = np.full((len(x), shards), -9, np.float32)
            s = x @ centres.T
            for c, shard in enumerate(label):
                np.maximum(like[:, shard], s[:, c], out=like[:, shard])
            order = np.argsort(-like, axis=1, kind="stable")[:, :PROBES]
            near = np.take_along_axis(like, order, 1)
            data = np.array([v.tobytes() for v in x], object)
            for j in range(order.shape[1]):
                here = near[:, j] >= near[:, 0] - MARGIN if j else np.ones(len(x), bool)
                yield pd.DataFrame({"shard": order[here, j], "id": batch["id"][here].values, "h": batch["h"][here].values, "home": j == 0, "vector": data[here]})

    return run


def _search(k: int, m: int, ef: int, floor: float):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(frame["vector"]), np.float32).reshape(len(frame), -1)
        home = frame["home"].values
        ids = frame["id"].values
        inside, visitors = np.flatnonzero(home), np.flatnonzero(~home)
        out = []
        if len(inside):
            graph = Graph(x[inside], frame["h"].values[inside].astype(np.int64).view(np.uint64), m, ef)
            for rows, (found, sims) in ((inside, graph.neighbours(k, ef)), (visitors, graph.search(x[visitors], k, ef))):
                r, c = np.nonzero((found >= 0) & (sims >= floor - 1e-4))
                a, b = rows[r], inside[found[r, c]]
                exact = np.einsum("nd,nd->n", x[a].astype(np.float64), x[b].astype(np.float64))
                keep = exact >= floor - 1e-7
                out.append(pd.DataFrame({"id": ids[a[keep]], "neighbour": ids[b[keep]], "similarity": exact[keep]}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"id": [], "neighbour": [], "similarity": []})

    return run


def one_a_task(routed: DataFrame) -> DataFrame:
    """The rows by shard, each shard in a task of its own: column ``slot`` is a number that
    hashes into a partition that no other shard has. Shards, not rows, come to the driver."""
    spark = routed.sparkSession
    shards = [r["shard"] for r in routed.select("shard").distinct().collect()]
    if len(shards) <= 1:
        return routed.withColumn("slot", F.lit(0).cast("bigint")).repartition(1)
    n, slots, span = len(shards), {}, 0
    while len(slots) < n:
        span = max(64, 16 * n, 2 * span)
        rows = spark.range(span).groupBy(F.expr(f"pmod(hash(id), {n})").alias("at")).agg(F.min("id").alias("id")).collect()
        slots = {r["at"]: r["id"] for r in rows}
    named = spark.createDataFrame([(int(s), int(slots[i])) for i, s in enumerate(sorted(shards))], "shard int, slot bigint")
    return routed.join(F.broadcast(named), "shard").repartition(n, "slot")


def usable(vector: str, dim: int):
    """Condition: exactly ``dim`` numbers, finite, not all zero."""
    v = F.col(vector)
    high, low = F.array_max(v), F.array_min(v)
    return (F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull()) & ~F.isnan(high) & (high < float("inf")) & (low > float("-inf")) & ((high != 0) | (low != 0))


def neighbours(df: DataFrame, k: int = 10, id_col: str = "id", vector_col: str = "embedding", dim: int = 64, m: int = 14, ef: int = 32, floor: float = -1.0) -> DataFrame:
    """Rows ``(id, neighbour, similarity, rank)``: up to ``k`` most similar others of
    every usable vector, those below ``floor`` left out. Rows of one id are taken
    as copies of one delivery."""
    if not k >= 1:
        raise ValueError("k must be at least 1")
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(vector_col).alias("vector")).where(F.col("id").isNotNull() & usable("vector", dim))
    classes = stage(rows.groupBy("vector").agg(F.min("id").alias("id"), (F.min("id") != F.max("id")).alias("copied")), "classes")
    n = classes.count()
    shards = max(1, -(-n // SHARD_ROWS))
    reps = classes.select("id", F.xxhash64("id").alias("h"), "vector")
    take = int(min(SAMPLE, max(4000, 400 * shards)))
    sample = reps.select("h", "vector").orderBy("h").limit(take).toPandas()["vector"] if shards > 1 else []
    seen = _unit(np.array(list(sample), np.float32)).astype(np.float32) if len(sample) else np.eye(1, dim, dtype=np.float32)
    centres, label = fit_shards(seen, shards)
    routed = reps.mapInPandas(_route(centres, label), "shard int, id string, h bigint, home boolean, vector binary")
    if shards > 1:
        routed = stage(routed, "routed")
        sizes = {r["shard"]: -(-r["count"] // (2 * SHARD_ROWS)) for r in routed.where("home").groupBy("shard").count().collect()}  # a row per shard
        if max(sizes.values()) > 1:
            splits = F.create_map(*(F.lit(x) for pair in sizes.items() for x in pair))[F.col("shard")]
            own = F.pmod("h", splits).cast("int")
            spread = routed.withColumn("split", F.explode(F.sequence(F.lit(0), F.coalesce(splits, F.lit(1)) - 1))).withColumn("home", F.col("home") & (F.col("split") == own))
            routed = spread.withColumn("shard", F.col("shard") * 100_000 + F.col("split")).drop("split")
            shards = sum(sizes.values())
    found = one_a_task(routed).groupBy("slot").applyInPandas(_search(k, m, ef, floor), "id string, neighbour string, similarity double")
    # classes of equal vectors stand by their members, of which k + 1 are enough to fill any list
    first = Window.partitionBy("rep").orderBy("id")
    copied = classes.where("copied").select(F.col("id").alias("rep"), "vector")
    member = rows.join(copied, "vector").select("rep", "id").distinct()
    member = stage(member, "members")
    listed = stage(member.withColumn("at", F.row_number().over(first)).where(F.col("at") <= k + 1).drop("at"), "listed")
    a, b = member.select(F.col("rep").alias("id"), F.col("id").alias("own")), listed.select(F.col("rep").alias("neighbour"), F.col("id").alias("other"))
    found = found.join(b, "neighbour", "left").join(a, "id", "left").select(F.coalesce("own", "id").alias("id"), F.coalesce("other", "neighbour").alias("neighbour"), "similarity")
    same = member.join(listed.withColumnRenamed("id", "neighbour"), "rep").where("id <> neighbour").select("id", "neighbour", F.lit(1.0).alias("similarity"))
    best = Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour")
    # a neighbour met in two shards is met with the same similarity
    merged = found.union(same).groupBy("id", "neighbour").agg(F.max("similarity").alias("similarity"))
    return merged.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def similar_documents(df: DataFrame, k: int = 10, threshold: float = 0.9) -> DataFrame:
    """Pairs ``(id_a, id_b)``, smaller id first, of which one is among the ``k``
    nearest of the other with a similarity of at least ``threshold``."""
    near = neighbours(df, k, floor=threshold).where(F.col("similarity") >= threshold)
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
