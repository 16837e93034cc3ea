"""Filling containers of fixed capacity with items, by shortest-pack-first.

Only the histogram of item lengths, at most ``capacity`` rows, comes to the
driver. Lengths are placed from the longest to the shortest; each step adds one
item of the length to as many as possible of the open containers with the most
room. The containers of one state are a range of numbers, so a step says: the
items of this length with ranks a to b lie in the containers from c on. Items
find their container by rank in these steps. An item longer than the capacity is
split into full pieces and a rest; no other item is split. Items of length 0
(null or empty texts) take no room and get no container.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import join_checked, stage


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int]]:
    """Steps ``(length, first rank, number of items, first container)``."""
    heap: list[tuple[int, int, int]] = []  # (-room, first container, number of containers)
    steps, opened = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            if heap and -heap[0][0] >= length:
                room, first, count = heapq.heappop(heap)
                room = -room
                take = min(left, count)
                if take < count:
                    heapq.heappush(heap, (-room, first + take, count - take))
            else:
                room, first, take = capacity, opened, left
                opened += take
            steps.append((length, rank, take, first))
            rank, left = rank + take, left - take
            if room > length:
                # a container with room for another item of this length may take it in this round
                heapq.heappush(heap, (-(room - length), first, take))
    return steps


def _assign(steps: list[tuple[int, int, int, int]]):
    by: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    table = np.array(steps, np.int64).reshape(-1, 4)
    for length in np.unique(table[:, 0]):
        part = table[table[:, 0] == length]
        by[int(length)] = (part[:, 1], part[:, 3])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = np.zeros(len(batch), np.int64)
            lengths, ranks = batch["n_tokens"].values, batch["rank"].values
            for length in np.unique(lengths):
                here = lengths == length
                starts, firsts = by[int(length)]
                i = np.searchsorted(starts, ranks[here], side="right") - 1
                out[here] = firsts[i] + ranks[here] - starts[i]
            yield batch.drop(columns="rank").assign(container_id=out)

    return run


def pack(items: DataFrame, capacity: int) -> DataFrame:
    """``items``: ``item_id`` (unique) and ``length``. Result: ``item_id, piece,
    token_start, n_tokens, container_id`` of every piece."""
    if capacity < 1:
        raise ValueError("the capacity must be at least 1")
    cap = F.lit(int(capacity))
    parts = items.where("item_id is not null and length > 0").select("item_id", "length", F.explode(F.sequence(F.lit(0), F.expr(f"cast((length - 1) div {int(capacity)} as int)"))).alias("piece"))
    start = (F.col("piece") * cap).cast("bigint")
    parts = parts.select("item_id", "piece", start.alias("token_start"), F.least(cap, F.col("length") - start).cast("int").alias("n_tokens"))
    n = parts.count()
    # the items of a length are ranked in slices, so that a length that a third of the items has is no single task
    slices = max(64, n // 50_000)
    sliced = parts.withColumn("slice", F.pmod(F.xxhash64("item_id"), F.lit(slices)).cast("int"))
    counts = stage(sliced.groupBy("n_tokens", "slice").agg(F.count("*").alias("c")), "counts")
    histogram = {r["n_tokens"]: r["c"] for r in counts.groupBy("n_tokens").agg(F.sum("c").alias("c")).collect()}  # at most ``capacity`` rows
    before = counts.withColumn("before", F.sum("c").over(Window.partitionBy("n_tokens").orderBy("slice")) - F.col("c")).drop("c")
    inner = F.row_number().over(Window.partitionBy("n_tokens", "slice").orderBy("item_id", "piece")) - 1
    ranked = join_checked(sliced.withColumn("inner", inner), before, ["n_tokens", "slice"])
    ranked = ranked.select("item_id", "piece", "token_start", "n_tokens", (F.col("inner") + F.col("before")).alias("rank"))
    kind = items.schema["item_id"].dataType.simpleString()
    return ranked.mapInPandas(_assign(plan(histogram, int(capacity))), f"item_id {kind}, piece int, token_start bigint, n_tokens int, container_id bigint")


def default_tokenizer() -> str:
    """File of the byte-level BPE ranks of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("counted", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Long texts are handed to the tokenizer in parts of about so many characters.
PART = 20_000


def presplit(text: str) -> Iterator[str]:
    """The text in parts, cut only where the tokenizer itself cuts before it merges, so that the parts have the tokens of the whole."""
    if len(text) <= PART:
        yield text
        return
    import public_tokenizers
    import regex

    start = 0
    for m in regex.finditer(public_tokenizers.PATTERN, text):
        if m.start() - start >= PART:
            yield text[start : m.start()]
            start = m.start()
    yield text[start:]


def token_counts(df: DataFrame, id_col: str, text_col: str, path: str | None = None) -> DataFrame:
    """``item_id, length``: the number of tokens of every text (0 for null and empty ones)."""
    path = path or default_tokenizer()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(path)
        for batch in batches:
            lengths = [sum(len(encoder.encode_ordinary(part)) for part in presplit(t)) if t else 0 for t in batch["text"]]
            yield pd.DataFrame({"item_id": batch["item_id"], "length": np.array(lengths, np.int64)})

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).mapInPandas(run, f"item_id {kind}, length bigint")
