"""Guards that must lose nothing, evidence that must decide rows, cutoffs on labelled pairs."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparrowloom.llm import answers, literals, markup, near_duplicates, packing, personal_data, residue, vector_neighbours
from sparrowloom.llm.text import KeyBits

DATA = "/root/testdata/sf0.001"
ODD = [
    "ann.lee ( at) example.org", "ann.lee { at } example.org", "ann at\texample dot org", "ANN (AT) EXAMPLE.ORG", "x%40y.de", "Lindenstraße\n12", "Lindenstraße 12", "callemayor 12", "Calle Mayor 7",
    "idcard 12AB34", "ID-card: X1234567", "carnét de conducir 12 345", "cédulas 1.234.567", "Reiſepass C01X00T47", "passnr. 12345", "İd card 123 45", "The site is down for work.", "The service is closed for work", "Request failed 12",
]


@pytest.mark.parametrize("pattern,text", [(r"(?:ab|cd)+x", "ABx"), (r"a{0,2}bcd", "bcd"), (r"(?i:strasse|weg)\s\d", "Weg 1"), (r"[kl]ook", "LOOK"), (r"foo(?=bar)", "foobar"), (r"(?:a|b?)", "")])
def test_required_literals_stand_in_every_match(pattern, text):
    p = re.compile(pattern, re.I)
    assert p.search(text) and all(any(x in literals.folded(text) for x in s) for s in literals.required(p))
    assert "x" in literals.Screen({"x": p}).names(text)


def test_guards_of_personal_data_lose_nothing(monkeypatch):
    texts = pd.read_parquet(f"{DATA}/support_tickets.parquet").description.dropna().tolist() + ODD

    class Open:
        def search(self, _):
            return True

        def names(self, _):
            return {"es"}

    guarded = [personal_data.shaped(t) for t in texts]
    for name in ("_STEMS", "_SIX", "_ANY_DIGIT"):
        monkeypatch.setattr(personal_data, name, Open())
    for name in ("_mailish", "_cued"):
        monkeypatch.setattr(personal_data, name, lambda *_: True)
    monkeypatch.setattr(personal_data, "_from", lambda expression, text, *_: list(expression.finditer(text)))
    monkeypatch.setattr(personal_data, "_german", lambda text, _: [m.span() for m in personal_data._DE.finditer(text)])
    free = [personal_data.shaped(t) for t in texts]
    # identity numbers have digits and addresses a number by their own expressions
    assert guarded == free
    assert {k for t in ODD[:5] for _, _, k in personal_data.shaped(t)} == {"email"} and all(personal_data.shaped(t) for t in ODD[5:7])


def test_screens_of_residue_lose_nothing():
    for text in pd.read_parquet(f"{DATA}/documents.parquet").text.dropna().tolist() + ODD:
        assert [k for _, k, _ in residue.seeds(text)] == [residue.seed_kind(u) for _, u in residue.units_of(text)]
        assert residue.has_field(text) == (residue._FIELD.search(residue._CODE.sub(" ", text)) is not None)
    assert residue.seed_kind(ODD[-3]) == residue.seed_kind(ODD[-2]) == 2


def test_repeated_responses_decide_residue(spark):
    rows = [(i, "Page not found. Please try again later.\nThe owl has left this burrow.", f"h{i % 4}", "guide") for i in range(6)]
    rows += [(50, "The owl has left some feathers.", "h9", "faq"), (51, "How owls live\n\nOwls hunt at night. The owl sleeps by day and its owner counts the mice.", "h9", "faq")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, doc_type string")
    found = lambda **k: {r.doc_id for r in residue.classify(df, **k).collect()}
    assert found() >= {*range(6), 50} and 51 not in found() and found(duplicates=False) == set()


def test_title_against_body(spark):
    say = "Access denied. Try again later. The page was not found. Sign in again. "
    rows = [(1, "Login trouble\n" + say * 3 + "Our login desk calls you.", "h", "faq"), (2, "Whoops\n" + say * 3 + "Our login desk calls you.", "h", "faq")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, doc_type string")
    assert {r.doc_id for r in residue.classify(df).collect()} == {2} and {r.doc_id for r in residue.classify(df, titles=False).collect()} == {1, 2}


def test_marks_by_join_give_the_rows_of_marks_by_set(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert {tuple(r) for r in residue.classify(df).collect()} == {tuple(r) for r in residue.classify(df, most_marks=0).collect()}


def test_tokens_of_long_texts_are_those_of_the_whole():
    encoder = packing._encoder(packing.default_tokenizer())
    for text in ("Two  words,\n\n and   more 123's " * 1500, "x" * 24_000 + "   y", "日本語 のテキスト。" * 4000):
        assert sum(len(encoder.encode_ordinary(p)) for p in packing.presplit(text)) == len(encoder.encode_ordinary(text))


def test_recall_over_shards_and_a_forced_split(spark, monkeypatch):
    rng = np.random.RandomState(4)
    x = (rng.randn(12, 64)[np.minimum(rng.randint(0, 24, 3000), 11)] + 0.7 * rng.randn(3000, 64)).astype(np.float32)  # half of all in one topic
    df = spark.createDataFrame([(f"{i:05d}", v.tolist()) for i, v in enumerate(x)], "id string, embedding array<float>")
    monkeypatch.setattr(vector_neighbours, "SHARD_ROWS", 400)
    found = {r.id: set(r.n) for r in vector_neighbours.neighbours(df).groupBy("id").agg(F.collect_list("neighbour").alias("n")).collect()}
    unit = vector_neighbours._unit(x)
    s = unit @ unit.T
    np.fill_diagonal(s, -9)
    hits = [len({f"{j:05d}" for j in np.argsort(-s[i])[:10]} & found.get(f"{i:05d}", set())) / 10 for i in range(3000)]
    assert np.mean(hits) >= 0.9 and np.mean(np.array(hits) < 0.5) < 0.05


def test_cells_merge_within_the_limit():
    rng = np.random.RandomState(1)
    c = rng.randn(60, 8).astype(np.float32)
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    share = rng.dirichlet(np.ones(60))
    label = vector_neighbours.merge_cells(c, share, 0.2)
    sums = np.bincount(label, share)
    assert sums.max() <= max(0.2, share.max()) + 1e-9 and np.sort(sums)[:2].sum() > 0.2


def test_key_bits_pass_all_keys(spark):
    keys = [0, -1, 5, 2**62, -(2**63)]
    bits = KeyBits(spark.createDataFrame([(k,) for k in keys], "k bigint"), "k", 18)
    assert bits.maybe(np.array(keys)).all() and not bits.maybe(np.arange(1000, 2000)).any()
    assert not KeyBits(spark.createDataFrame([], "k bigint"), "k", 18).maybe(np.array(keys)).any()


def test_busy_keys_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BUSY", 2)
    monkeypatch.setattr(near_duplicates, "SALT_ROWS", 7)
    rng = np.random.RandomState(5)
    foot = "this footer stands under all of the tickets of the shop and says nothing at all about them".split()
    texts = []
    for i in range(40):
        base = [f"w{x}" for x in rng.randint(0, 500, 30)]
        for _ in range(2):
            w = list(base)
            w[rng.randint(30)] = "edit"
            texts.append(" ".join(w + foot))
    df = spark.createDataFrame([("d", f"{i:03d}", t) for i, t in enumerate(texts)], "field_name string, id string, text string")
    got = {(r.a, r.b) for r in near_duplicates.similar_pairs(df, 3, 0.6).select("a", "b").collect()}
    sets = [{tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for t in texts]
    want = {(f"{i:03d}", f"{j:03d}") for i in range(80) for j in range(i + 1, 80) if len(sets[i] & sets[j]) >= 0.6 * len(sets[i] | sets[j])}
    assert got == want and want
    assert near_duplicates.members(df, 3, 0.6).count() == 80


def test_tag_paths_decide_what_is_kept():
    texts = pd.read_parquet("/root/testdata/sf0.01/cms_documents.parquet").content.dropna().drop_duplicates()
    pages = [t for t in texts if "<nav" in t]
    with_ratio = [markup.clean(t) for t in pages]
    share, markup.SHARE = markup.SHARE, 0.0
    try:
        without = [markup.clean(t) for t in pages]
    finally:
        markup.SHARE = share
    assert pages and sum(len(a) < len(b) for a, b in zip(with_ratio, without)) >= 0.8 * len(pages)


@pytest.fixture(scope="module")
def judged(spark):
    """Patterns of the pairs of sf0.01 and of corrupted copies of sound ones, with the posterior of each."""
    messages = spark.read.parquet("/root/testdata/sf0.01/thread_messages.parquet").select("thread_id", "seq", "role", "content")
    pairs = answers.pairs(messages).toPandas().sort_values(["thread_id", "seq"])
    sound = pairs[pairs.answer.str.match(r"(?s).{120,}[.]\s*\Z", na=False) & pairs.question.str.len().gt(60)].reset_index(drop=True)
    lang = [answers.language(t) for t in sound.question]
    refusals = {"en": "I am sorry, but I cannot help with this request.", "de": "Dabei kann ich leider nicht helfen.", "es": "Lo siento, no puedo ayudar con eso.", "fr": "Désolé, je ne peux pas vous aider."}
    rows, truth = [], {}
    for i, r in enumerate(sound.itertuples()):
        kind, answer = ("sound", *answers.DEFECTS)[i % 6], r.answer
        if kind == "empty":
            answer = (None, "  ", "n/a", "​")[i // 6 % 4]
        elif kind == "copied_question":
            answer = r.question
        elif kind == "refusal":
            answer = refusals.get(lang[i], refusals["en"])
        elif kind == "truncated":
            answer = answer[: len(answer) * 2 // 3].rstrip(" .")
        elif kind == "other_language":
            j = next((j for j in range(i + 1, len(sound)) if lang[j] and lang[i] and lang[j] != lang[i] and answers.language(sound.answer[j]) == lang[j]), None)
            if j is None:
                continue
            answer = sound.answer[j]
        truth[f"c{i}"] = kind
        rows += [(f"c{i}", 0, "user", r.question), (f"c{i}", 1, "assistant", answer)]
    both = messages.union(spark.createDataFrame(rows, messages.schema))
    got = answers.patterns(both).toPandas()
    fits = {d: answers.fit(got[got.defect_type == d].pattern.value_counts().to_dict()) for d in answers.DEFECTS}
    got["posterior"] = [fits[d][p] for d, p in zip(got.defect_type, got.pattern)]
    return got, truth


def test_cutoffs_hold_on_corrupted_pairs(judged):
    got, truth = judged
    for d in answers.DEFECTS:
        mine = got[(got.defect_type == d) & got.thread_id.isin(truth)]
        flagged = {t for t, p, x in zip(mine.thread_id, mine.pattern, mine.posterior) if x >= answers.CUTOFFS[d] and "1" in p}
        real = {t for t, k in truth.items() if k == d}
        kept = {t for t, k in truth.items() if k == "sound"}
        assert len(flagged & real) >= 0.9 * len(real) > 0, (d, len(flagged & real), len(real))
        assert len(flagged & kept) <= 0.02 * len(kept), (d, len(flagged & kept), len(kept))


def test_the_label_model_overrules_majorities(judged):
    got, truth = judged
    plain = got[~got.thread_id.isin(truth)]
    majority = plain.pattern.str.count("1") > plain.pattern.str.count("0")
    model = (plain.posterior >= plain.defect_type.map(answers.CUTOFFS)) & plain.pattern.str.contains("1")
    assert (majority != model).mean() > 0.001


def test_spelling_tells_languages_without_stop_words(spark):
    spelling = answers.spelling_of(spark.read.parquet("/root/testdata/sf0.01/thread_messages.parquet"))
    assert spelling.guess(["bestellung lieferung rechnung zahlung".split(), "customers ordering shipments payments".split(), ["x"], []]) == [1, 0, None, None]
