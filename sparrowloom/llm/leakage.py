"""Evaluation passages in training texts, by winnowed fingerprints.

Of every window of WINDOW hashes of K consecutive words the smallest is kept (the
last of equal ones). A span of K + WINDOW - 1 words that two texts share holds a
whole window, so both keep its smallest hash: every shared span of that length is
met by the join of the fingerprints. Each meeting is then extended to both sides
over the words; what is shorter than ``least`` words is dropped.

Null and short texts have no fingerprints. Only meetings, never texts, are
joined by key; an item's passage that stands in very many documents is a skewed
key of that join only if the items are too many to be broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import join_checked, stage
from .text import WordHasher, grams, words

K, WINDOW = 5, 6


def winnow(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of the kept hashes."""
    n = len(hashes)
    if n < window:
        return np.empty(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(hashes, window)[:, ::-1]
    return np.unique(np.arange(n - window + 1) + window - 1 - view.argmin(axis=1))


def _fingerprints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hasher = WordHasher()
    for batch in batches:
        keys, prints, places = [], [], []
        for key, text in zip(batch["key"], batch["text"]):
            h = grams(hasher(words(text)), K)
            at = winnow(h)
            keys.append(np.full(len(at), key))
            prints.append(h[at].view(np.int64))
            places.append(at)
        if keys:
            yield pd.DataFrame({"key": np.concatenate(keys), "print": np.concatenate(prints), "at": np.concatenate(places)})


def _extend(least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = WordHasher()
        item_words: dict = {}
        for batch in batches:
            rows, last, doc = [], None, None
            for doc_id, item_id, text, item_text, hits in zip(batch["doc_id"], batch["item_id"], batch["text"], batch["item_text"], batch["hits"]):
                if doc_id != last:
                    doc, last = hasher(words(text)), doc_id
                if item_id not in item_words:
                    if len(item_words) > 2000:
                        item_words.clear()
                    item_words[item_id] = hasher(words(item_text))
                item = item_words[item_id]
                best, start = 0, 0
                for hit in hits:
                    d, i = hit["doc_at"], hit["item_at"]
                    back = 0
                    while d - back > 0 and i - back > 0 and doc[d - back - 1] == item[i - back - 1]:
                        back += 1
                    on = 0
                    while d + on < len(doc) and i + on < len(item) and doc[d + on] == item[i + on]:
                        on += 1
                    if back + on > best:
                        best, start = back + on, d - back
                if best >= least:
                    rows.append((doc_id, item_id, best, start, best / max(1, len(item))))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "words", "doc_word", "item_share"])

    return run


def leaks(documents: DataFrame, items: DataFrame, least: int = 10) -> DataFrame:
    """``doc_id, item_id, words, doc_word, item_share``: the longest run of words that a
    document (doc_id, text) and an item (item_id, text) share, where it has at least
    ``least`` words; ``doc_word`` is its first word in the document."""
    if least < K + WINDOW - 1:
        raise ValueError(f"runs shorter than {K + WINDOW - 1} words are not guaranteed to be met")
    made = "key bigint, print bigint, at int"
    docs = documents.select(F.col("doc_id").cast("bigint").alias("key"), "text").where("key is not null and text is not null")
    tests = items.select(F.col("item_id").cast("bigint").alias("key"), "text").where("key is not null and text is not null")
    item_prints = stage(tests.mapInPandas(_fingerprints, made).select("print", F.col("key").alias("item_id"), F.col("at").alias("item_at")), "item_prints")
    doc_prints = docs.mapInPandas(_fingerprints, made).select("print", F.col("key").alias("doc_id"), F.col("at").alias("doc_at"))
    met = join_checked(doc_prints, item_prints, "print")
    hits = stage(met.groupBy("doc_id", "item_id").agg(F.collect_list(F.struct("doc_at", "item_at")).alias("hits")), "hits")
    item_texts = tests.select(F.col("key").alias("item_id"), F.col("text").alias("item_text"))
    both = join_checked(hits.join(docs.select(F.col("key").alias("doc_id"), "text"), "doc_id"), item_texts, "item_id", rows=5000)
    found = both.select("doc_id", "item_id", "text", "item_text", "hits").mapInPandas(_extend(least), "doc_id bigint, item_id bigint, words int, doc_word int, item_share double")
    # ids that are given to several texts count once, with their longest run
    best = F.max_by(F.struct("words", "doc_word", "item_share"), "words").alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.*")
