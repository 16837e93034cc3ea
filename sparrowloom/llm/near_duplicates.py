"""Near-duplicate records by a generalised pigeonhole over MinHash codes.

A text is the set of its runs of ``k`` consecutive words, coded by SLOTS minimum
hashes. Two texts of Jaccard similarity J agree in each slot with probability J,
so their codes lie at a Hamming distance of about SLOTS * (1 - J).

1. *Correlated bits together.* The bits of a slot change as one; slots whose
   agreements are correlated (measured on a bounded sample of SAMPLE records)
   are grouped into the same one of PARTS partitions.
2. *Unequal thresholds.* Every record gets a threshold per partition: -1 (not
   probed), 0 (all slots equal) or 1 (all but one equal), chosen by dynamic
   programming so that sum(threshold + 1) = PARTS at the lowest estimated number
   of candidates. The counts of full keys are exact, over all records; those of
   one-off keys are estimated from the sample. By the pigeonhole principle all
   pairs within PARTS - 1 differing slots are met; of pairs at J = 0.6, which
   may lie further apart, 99.9 % are met, of those at 0.8 all but 1e-9.
3. *Probe and verify.* Keys with many records (footers, templates) are salted,
   candidates must pass the size bound and a 128-bit sketch (5 sigma), and are
   then verified on the whole shingle sets.

Records with the same set are one class from the start, so groups of copies cost
nothing. Null texts and texts of fewer than ``k`` words have no shingles and are
similar to nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import join_checked, stage
from .components import components
from .text import KeyBits, WordHasher, grams, mix, words

PARTS, WIDTH = 32, 3
SLOTS = PARTS * WIDTH
SKETCH = 128
#: Records of the sample on which slots are grouped and one-off keys are estimated.
SAMPLE = 2000
#: Records share a key this often before the thresholds of a record are reconsidered.
BUSY = 64
#: Rows of one salt of a key.
SALT_ROWS = 1000
#: Classes of copies up to this size are written as all their pairs, larger ones as pairs with their first record.
ALL_PAIRS = 200

_rng = np.random.RandomState(20240607)
_MUL = (_rng.randint(0, 2**62, SKETCH, dtype=np.int64).astype(np.uint64) << np.uint64(2)) | np.uint64(1)
_ADD = _rng.randint(0, 2**62, SKETCH, dtype=np.int64).astype(np.uint64)


def codes(sets: np.ndarray) -> np.ndarray:
    """The SKETCH minimum hashes of one set of shingle hashes, which are mixed already: odd
    multiples and sums permute them, and the high bits decide the minimum."""
    low = None
    for at in range(0, len(sets), 2048):  # long texts in blocks, so that memory stays bounded
        part = (sets[at : at + 2048, None] * _MUL[None, :] + _ADD[None, :]).min(axis=0)
        low = part if low is None else np.minimum(low, part)
    return low


def record_key(field: str, key: str) -> int:
    """8 bytes that stand for a record in joins. Records that share them are both verified, under their ids."""
    return int(np.uint64(xxhash.xxh64_intdigest(f"{field}\t{key}")).astype(np.int64))


_SETS = "field_name string, id string, rec bigint, field bigint, n int, set_hash binary, s1 bigint, s2 bigint, slots binary, shingles array<bigint>"


def shingle_rows(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = WordHasher()
        for batch in batches:
            rows, lows = [], []
            for field, key, text in zip(batch["field_name"], batch["id"], batch["text"]):
                sets = np.unique(grams(hasher(words(text)), k))
                if len(sets):
                    lows.append(codes(sets))
                    rows.append((field, key, record_key(field, key), xxhash.xxh64_intdigest(field) >> 1, len(sets), xxhash.xxh3_128_digest(sets.tobytes()), sets.view(np.int64)))
            if not rows:
                continue
            made = pd.DataFrame(rows, columns=["field_name", "id", "rec", "field", "n", "set_hash", "shingles"])
            low = np.stack(lows)
            bits = np.packbits(((mix(low) >> np.uint64(40)) & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64)
            slots = mix(low[:, :SLOTS]).astype(np.uint32)
            yield made.assign(s1=bits[:, 0], s2=bits[:, 1], slots=[x.tobytes() for x in slots])[_SETS_COLUMNS]

    return run


_SETS_COLUMNS = [c.split()[0] for c in _SETS.split(", ")]


def group_slots(sample: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Partitions of correlated slots, and per partition the share of record pairs
    that agree in all slots but one. ``sample``: uint32, records x SLOTS."""
    n = len(sample)
    left, right = [], []
    for j in range(SLOTS):
        order = np.argsort(sample[:, j], kind="stable")
        same = np.flatnonzero(sample[order[1:], j] == sample[order[:-1], j])[:500]
        left.append(order[same])
        right.append(order[same + 1])
    left, right = np.concatenate(left), np.concatenate(right)
    if len(left) < 50:
        return np.arange(SLOTS).reshape(PARTS, WIDTH), np.zeros(PARTS)
    agree = (sample[left] == sample[right]).astype(np.float64)
    with np.errstate(all="ignore"):
        corr = np.nan_to_num(np.corrcoef(agree.T))
    np.fill_diagonal(corr, -9)
    free, parts = np.ones(SLOTS, bool), []
    for _ in range(PARTS):
        masked = np.where(free[:, None] & free[None, :], corr, -9)
        chosen = list(np.unravel_index(np.argmax(masked), masked.shape)) if WIDTH > 1 else [int(np.argmax(free))]
        while len(chosen) < WIDTH:
            score = corr[chosen].sum(axis=0)
            score[~free] = -99
            score[chosen] = -99
            chosen.append(int(np.argmax(score)))
        free[chosen] = False
        parts.append(sorted(int(x) for x in chosen))
    parts = np.array(parts)
    one_off = np.zeros(PARTS)
    for p, slots in enumerate(parts):
        for out in range(WIDTH):
            kept = np.delete(slots, out)
            key = np.zeros(n, np.uint64)
            for s in kept:
                key = mix(key + sample[:, s])
            counts = np.unique(key, return_counts=True)[1].astype(np.float64)
            one_off[p] += (counts * (counts - 1)).sum() / max(1, n * (n - 1))
    return parts, one_off


def allocate(cost0: np.ndarray, cost1: np.ndarray) -> np.ndarray:
    """Thresholds in {-1, 0, 1} per record (rows) and partition (columns) with
    sum(threshold + 1) = PARTS and the lowest sum of costs."""
    n, parts = cost0.shape
    best = np.full((n, parts + 1), np.inf)
    best[:, 0] = 0
    choice = np.zeros((parts, n, parts + 1), np.int8)
    for p in range(parts):
        options = np.stack([best, np.full_like(best, np.inf), np.full_like(best, np.inf)])
        options[1, :, 1:] = best[:, :-1] + cost0[:, p, None]
        options[2, :, 2:] = best[:, :-2] + cost1[:, p, None]
        # equal costs: the plain threshold 0 first
        order = np.argmin(options[[1, 0, 2]], axis=0)
        choice[p] = np.array([0, -1, 1], np.int8)[order]
        best = options.min(axis=0)
    out, at, rows = np.zeros((n, parts), np.int8), np.full(n, parts), np.arange(n)
    for p in reversed(range(parts)):
        out[:, p] = choice[p, rows, at]
        at = at - (out[:, p].astype(int) + 1)
    return out


def _keys(slots: np.ndarray, chosen: np.ndarray, tag: int, field: np.ndarray) -> np.ndarray:
    key = mix(field + np.uint64(tag))
    for s in chosen:
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + slots[:, s])
    return key.view(np.int64)


def _slots(batch: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(batch["slots"]), np.uint32).reshape(len(batch), SLOTS).astype(np.uint64)


_POST = "rec bigint, n int, s1 bigint, s2 bigint, part int, key bigint"


def _postings(parts: np.ndarray, one_off: bool, wanted: KeyBits | None = None, bare: bool = False):
    """Rows of full keys, or of one-off keys of the partitions in column ``tau`` (all without
    it); with ``wanted`` only those that may be among its keys; ``bare``: the keys alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            slots, field = _slots(batch), batch["field"].values.astype(np.uint64)
            at, part, keys = [], [], []
            tau = np.stack(batch["tau"].values) if "tau" in batch else None
            for p, chosen in enumerate(parts):
                here = np.arange(len(batch)) if tau is None else np.flatnonzero(tau[:, p] == 1)
                for out in range(WIDTH) if one_off else (None,):
                    key = _keys(slots[here], chosen if out is None else np.delete(chosen, out), p if out is None else 1000 + p * WIDTH + out, field[here])
                    kept = slice(None) if wanted is None else wanted.maybe(key)
                    at.append(here[kept])
                    keys.append(key[kept])
                    part.append(np.full(len(at[-1]), p, np.int32))
            keys, at = np.concatenate(keys), np.concatenate(at)
            if bare:
                yield pd.DataFrame({"key": keys})
            else:
                yield pd.DataFrame({c: batch[c].values[at] for c in ("rec", "n", "s1", "s2")} | {"part": np.concatenate(part), "key": keys})

    return run


def _thresholds(one_off: np.ndarray, records: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            cost0 = np.zeros((len(batch), PARTS))
            for i, pairs in enumerate(batch["counts"]):
                for x in pairs:
                    cost0[i, x["part"]] = x["rows"] - 1
            tau = allocate(cost0, cost0 + 1e-3 + one_off[None, :] * records)
            yield pd.DataFrame({"rec": batch["rec"], "tau": [list(map(int, t)) for t in tau]})

    return run


def _probe(probes: DataFrame, index: DataFrame, threshold: float) -> DataFrame:
    """Candidate pairs of records with a key in common; ``index`` and ``probes`` know the ``rows`` of their keys."""
    p = (1 + threshold) / 2
    far = int(SKETCH * (1 - p) + 5 * (SKETCH * p * (1 - p)) ** 0.5)
    salts = F.ceil(F.col("rows") / SALT_ROWS).cast("int")
    x = probes.select("key", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), *(F.col(c).alias(f"x_{c}") for c in ("rec", "n", "s1", "s2")))
    y = index.select("key", F.pmod(F.xxhash64("rec"), salts).cast("int").alias("salt"), *(F.col(c).alias(f"y_{c}") for c in ("rec", "n", "s1", "s2")))
    near = F.bit_count(F.col("x_s1").bitwiseXOR(F.col("y_s1"))) + F.bit_count(F.col("x_s2").bitwiseXOR(F.col("y_s2"))) <= far
    sized = F.least("x_n", "y_n") >= threshold * F.greatest("x_n", "y_n")
    return x.join(y, ["key", "salt"]).where((F.col("x_rec") != F.col("y_rec")) & sized & near).select(F.least("x_rec", "y_rec").alias("a"), F.greatest("x_rec", "y_rec").alias("b"))


def classes_and_links(texts: DataFrame, k: int = 5, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """``texts``: field_name, id, text; ids unique within a field. Returns

    * members ``(field_name, rep, id)``: every record that has shingles, with the
      smallest id among the records of the same shingle set;
    * links ``(field_name, a, b, common, total)`` between the representatives of
      different sets whose similarity common / total is at least ``threshold``.
    """
    given = texts.select("field_name", "id", "text").where("id is not null and field_name is not null and length(text) > 0")
    sets = stage(given.mapInPandas(shingle_rows(k), _SETS), "sets")
    first = sets.groupBy("field_name", "set_hash").agg(F.min("id").alias("rep"), F.count("*").alias("size"))
    first = stage(first, "first")
    copies = stage(join_checked(sets.select("field_name", "set_hash", "id", "rec"), first.where("size > 1").drop("size"), ["field_name", "set_hash"]), "copies")
    members = first.where("size = 1").select("field_name", "rep", F.col("rep").alias("id")).union(copies.select("field_name", "rep", "id"))
    reps = join_checked(sets.drop("set_hash"), copies.where("rep <> id").select("field_name", "id"), ["field_name", "id"], "left_anti")

    # the sample is the SAMPLE records of the smallest hash: the same whatever the partitioning
    sample = reps.select("slots").orderBy(F.xxhash64("rec"), "id").limit(SAMPLE).collect()
    parts, one_off = group_slots(np.frombuffer(b"".join(r[0] for r in sample), np.uint32).reshape(-1, SLOTS).astype(np.uint64))

    light = stage(reps.select("rec", "field", "n", "s1", "s2", "slots"), "light")
    # keys of a single record need no probe: first only the keys are counted, then the rows of shared ones are made
    counts = stage(light.mapInPandas(_postings(parts, False, bare=True), "key bigint").groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1"), "counts")
    posts = light.mapInPandas(_postings(parts, False, KeyBits(counts, "key")), _POST)
    shared = stage(posts.join(counts, "key"), "shared")

    busy = shared.groupBy("rec").agg(F.max("rows").alias("most"), F.collect_list(F.struct("part", "rows")).alias("counts")).where(F.col("most") > BUSY)
    records = light.count()
    tau = stage(busy.select("rec", "counts").mapInPandas(_thresholds(one_off, records), "rec bigint, tau array<int>"), "tau")
    probes = shared.join(tau, "rec", "left").where("tau is null or tau[part] >= 0")
    found = _probe(probes, shared, threshold)
    wide = tau.where("array_max(tau) = 1")
    if wide.limit(1).count():
        asked = stage(light.join(wide, "rec").mapInPandas(_postings(parts, True), _POST), "asked")
        # of all records only the one-off keys that some record asks for
        keys = asked.select("key").distinct()
        index = light.mapInPandas(_postings(parts, True, KeyBits(keys, "key")), _POST)
        index = stage(index.join(keys, "key", "left_semi"), "index")
        rows = index.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1")
        found = found.union(_probe(asked.join(rows, "key"), index.join(rows, "key"), threshold))

    pairs = stage(found.distinct(), "pairs")
    body = reps.select("rec", "field_name", "id", "n", "shingles")
    x = body.select(F.col("rec").alias("a"), "field_name", F.col("id").alias("a_id"), F.col("n").alias("an"), F.col("shingles").alias("ax"))
    y = body.select(F.col("rec").alias("b"), "field_name", F.col("id").alias("b_id"), F.col("n").alias("bn"), F.col("shingles").alias("bx"))
    both = pairs.join(x, "a").join(y, ["b", "field_name"])
    common = F.size(F.array_intersect("ax", "bx"))
    links = both.select("field_name", F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"), common.alias("common"), (F.col("an") + F.col("bn")).alias("sum"))
    links = links.where(F.col("common") >= F.lit(threshold) * (F.col("sum") - F.col("common")) - 1e-9)
    return members, stage(links.select("field_name", "a", "b", "common", (F.col("sum") - F.col("common")).alias("total")), "links")


def similar_pairs(texts: DataFrame, k: int, threshold: float) -> DataFrame:
    """All pairs ``(field_name, a, b)`` of different records with a similarity of at
    least ``threshold``, the smaller id first. Copies: within a class, and between
    two linked classes, all pairs are written if they are at most ALL_PAIRS squared
    / 2 (or ALL_PAIRS ** 2); of larger classes each member is paired with the
    representative, to which all others are equal; :func:`members` has the classes."""
    members, links = classes_and_links(texts, k, threshold)
    sizes = members.groupBy("field_name", "rep").agg(F.count("*").alias("size"))
    copied = stage(members.join(sizes.where("size > 1"), ["field_name", "rep"]), "copied")
    x, y = copied.alias("x"), copied.alias("y")
    within = x.where(F.col("size") <= ALL_PAIRS).join(y, (F.col("x.field_name") == F.col("y.field_name")) & (F.col("x.rep") == F.col("y.rep")) & (F.col("x.id") < F.col("y.id")))
    within = within.select("x.field_name", F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    star = copied.where(F.col("size") > ALL_PAIRS).where("id <> rep").select("field_name", F.col("rep").alias("a"), F.col("id").alias("b"))

    def side(name: str) -> DataFrame:
        # classes beyond the limit stand for themselves by their representative
        listed = copied.where((F.col("size") <= ALL_PAIRS) | (F.col("id") == F.col("rep")))
        return listed.select("field_name", F.col("rep").alias(name), F.col("id").alias(f"{name}_id"))

    across = links.select("field_name", "a", "b").join(side("a"), ["field_name", "a"], "left").join(side("b"), ["field_name", "b"], "left")
    p, q = F.coalesce("a_id", "a"), F.coalesce("b_id", "b")
    across = across.select("field_name", F.least(p, q).alias("a"), F.greatest(p, q).alias("b"))
    return across.union(within).union(star)


def members(texts: DataFrame, k: int, threshold: float) -> DataFrame:
    """``field_name, rep, id``: the class of every record that has shingles, named by its
    smallest id. Together with the pairs of the representatives this is the whole relation."""
    return classes_and_links(texts, k, threshold)[0]


def groups(texts: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row per record that has shingles: ``field_name, id, class_id`` (the
    records of one shingle set), ``group_id`` (connected by links) and ``n_links``
    (classes linked to the record's class, plus copies of the record)."""
    members, links = classes_and_links(texts, k, threshold)
    node = lambda c: F.concat_ws("\t", "field_name", c)
    parts = components(links.select(node("a").alias("a"), node("b").alias("b")))
    ends = links.select("field_name", F.col("a").alias("rep")).union(links.select("field_name", F.col("b")))
    degree = ends.groupBy("field_name", "rep").agg(F.count("*").alias("linked"))
    sizes = members.groupBy("field_name", "rep").agg(F.count("*").alias("size"))
    reps = sizes.join(degree, ["field_name", "rep"], "left").withColumn("node", node("rep")).join(parts, "node", "left")
    reps = reps.select("field_name", "rep", (F.coalesce("linked", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce(F.element_at(F.split("component", "\t"), 2), F.col("rep")).alias("group_id"))
    return members.join(reps, ["field_name", "rep"]).select("field_name", "id", F.col("rep").alias("class_id"), "group_id", "n_links")


def ticket_texts(tickets: DataFrame) -> DataFrame:
    """description and resolution of each ticket as rows ``field_name, id, text``; a
    ticket delivered twice counts once."""
    once = tickets.select("id", "description", "resolution").dropDuplicates(["id"])
    pairs = F.array(*(F.struct(F.lit(c).alias("field_name"), F.col(c).alias("text")) for c in ("description", "resolution")))
    return once.select("id", F.inline(pairs)).select("field_name", "id", "text")
