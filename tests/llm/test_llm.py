import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparrowloom.llm import answers, leakage, markup, near_duplicates, packing, percentiles, personal_data, queries, residue, splitting, text, vector_neighbours
from sparrowloom.llm.hnsw import Graph

LOREM = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix potions near an old stone bridge before dawn breaks over misty hills"


def test_similar_pairs_with_nulls_copies_and_short_texts(spark):
    rows = [("d", "1", LOREM), ("d", "2", LOREM.upper()), ("d", "3", LOREM.replace("wizards", "witches")), ("d", "4", "too short"), ("d", "5", None), ("d", "6", ""), ("e", "1", LOREM)]
    df = spark.createDataFrame(rows, "field_name string, id string, text string")
    got = {tuple(r) for r in near_duplicates.similar_pairs(df, 3, 0.6).select("field_name", "a", "b").collect()}
    assert got == {("d", "1", "2"), ("d", "1", "3"), ("d", "2", "3")}
    groups = {r.id: r.group_id for r in near_duplicates.groups(df.where("field_name = 'd'"), 3, 0.6).collect()}
    assert set(groups) == {"1", "2", "3"} and len(set(groups.values())) == 1


def test_similar_pairs_of_nothing(spark):
    assert near_duplicates.similar_pairs(spark.createDataFrame([], "field_name string, id string, text string"), 3, 0.6).count() == 0


def test_thresholds_keep_the_pigeonhole_sum():
    cost = np.random.RandomState(1).randint(0, 500, (20, near_duplicates.PARTS)).astype(float)
    tau = near_duplicates.allocate(cost, cost + 10)
    assert ((tau + 1).sum(axis=1) == near_duplicates.PARTS).all()


def test_graph_recall():
    rng = np.random.RandomState(0)
    x = rng.randn(20, 64)[rng.randint(20, size=2000)] + 0.6 * rng.randn(2000, 64)
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    found, _ = Graph(x, rng.randint(0, 2**62, 2000).astype(np.uint64), 14, 32).neighbours(10, 32)
    s = x @ x.T
    np.fill_diagonal(s, -9)
    true = np.argsort(-s, axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(found, true)]) >= 0.9


def test_neighbours_skip_unusable_vectors_and_expand_copies(spark):
    unit = lambda i: [1.0 if j == i else 0.01 for j in range(64)]
    rows = [("a", unit(0)), ("b", unit(0)), ("c", unit(1)), ("z", [0.0] * 64), ("n", [float("nan")] * 64), ("s", [1.0]), ("x", None), ("a", unit(0))]
    got = vector_neighbours.neighbours(spark.createDataFrame(rows, "id string, embedding array<float>"), 2).collect()
    assert {(r.id, r.neighbour) for r in got if r.rank == 1 and r.id in "ab"} == {("a", "b"), ("b", "a")}
    assert {r.id for r in got} == {"a", "b", "c"}


def test_percentiles_are_exact(spark):
    rows = [("g", float(v)) for v in (5, 1, 1, 9, 1e9, -3)] + [("h", None), ("h", float("nan")), (None, 2.0), ("i", float("inf")), ("i", 1.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {(r.g, r.permille): r.value for r in percentiles.percentiles(df, ["g"], {"v": F.col("v")}, (1, 500, 1000)).collect()}
    assert got == {("g", 1): -3, ("g", 500): 1, ("g", 1000): 1e9, (None, 1): 2, (None, 500): 2, (None, 1000): 2, ("i", 1): 1, ("i", 500): 1, ("i", 1000): float("inf")}


def test_grid_counts_add_up_within_bound(spark):
    v = np.random.RandomState(3).lognormal(5, 2, 3000)
    df = spark.createDataFrame([("g", int(i % 7), float(x)) for i, x in enumerate(v)], "g string, day int, v double")
    got = {r.permille: r.value for r in percentiles.from_grid(percentiles.grid_counts(df, ["g", "day"], {"v": F.col("v")}), ["g"]).collect()}
    for p, value in got.items():
        exact = np.sort(v)[max(1, -(-3000 * p // 1000)) - 1]
        assert exact <= value * (1 + 1e-9) <= exact * 2 ** (1 / 32) * (1 + 1e-6)


@pytest.mark.parametrize("body", ["x" * 2500, "word " * 600, "# A\n\n" + "One sentence here. " * 90 + "\n\n# B\n\n" + "- item\n" * 200, "ab" * 450 + " " + "c" * 999 + " d", "é️" * 900, " " * 3000])
def test_pieces_lose_nothing(body):
    made = splitting.split(body)
    assert all(b - a <= 1000 for a, b, _, _ in made)
    assert "".join(body[a + s : b] for a, b, s, _ in made) == body
    assert any(p[3] == "forced" for p in made) == bool(re.search(r"[^ \t\r\n]{1001}", body))


@pytest.mark.parametrize("body", ["漢字仮名。" * 300, "<li>a</li><br>" * 100, "word " * 100 + "</p>x" * 300])
def test_cuts_at_signs_of_an_unbroken_run_are_forced(body):
    made = splitting.split(body)
    assert "forced" in {p[3] for p in made} and "".join(body[a + s : b] for a, b, s, _ in made) == body
    assert all(body[a + s - 1] in "。>" for a, _, s, _ in made[-1:])


def test_every_long_shared_span_is_met(spark):
    w = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(["x", *w[20:30], "y"])), (2, " ".join(w[20:29])), (3, None)], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, " ".join(w)), (8, None)], "item_id bigint, text string")
    assert [(r.doc_id, r.item_id, r.words) for r in leakage.leaks(docs, items).collect()] == [(1, 7, 10)]


def test_packing_fits_and_places_all(spark):
    rows = [(i, int(n)) for i, n in enumerate(np.random.RandomState(2).randint(0, 260, 400))] + [(1000, None)]
    got = packing.pack(spark.createDataFrame(rows, "item_id bigint, length bigint"), 100).collect()
    used: dict = {}
    for r in got:
        used[r.container_id] = used.get(r.container_id, 0) + r.n_tokens
    assert max(used.values()) <= 100 and sum(used.values()) == sum(n or 0 for _, n in rows)


@pytest.mark.parametrize("content,expected", [("a < b and 5 > 3, C:\\temp\\new, $5 and $7, snake_case_name, 6 * 4 * 3", []), ("&lt;p&gt;x", ["html"]), ("## Head\n\ntext", ["markdown"]), ("a '''bold''' word", ["wiki"]), ("so $x^2$ holds", ["latex"]), ("50 \\% of", ["latex"]), ("```\n<b>\n```", ["markdown"]), ("", [])])
def test_notations(content, expected):
    assert markup.kinds(content) == expected


def test_clean_keeps_structure():
    assert markup.clean("plain * text") == "plain * text" and markup.clean(None) is None
    out = markup.clean("<h2>Title</h2><p>One &amp; two.</p><ul><li>a</li></ul><pre>x = 1\n  y</pre>")
    assert "## Title" in out and "One & two." in out and "- a" in out and "x = 1\n  y" in out and "<" not in out


PROSE = "<p>The ledger is closed on Friday, but the audit goes on: two reports are still open, and one is late.</p>"


@pytest.mark.parametrize("furniture", ["<nav><ul><li>Home<li>Shop<li>Help</ul></nav>", "<div><div>Home</div><div>Shop</div><div>Help</div></div>", "<section><h3>Home</h3><ul><li><a href='/s'>Shop</a></li><li>Help</li></ul></section>"])
def test_clean_drops_furniture_whatever_its_tags(furniture):
    out = markup.clean(f"{furniture}<div>{PROSE * 8}<h2>Next</h2><ul><li>Red</li><li>Blue</li></ul><table><tr><td>1</td><td>2</td></tr></table><p>Yes, <b>do</b> it.</p></div>")
    assert not {"Home", "Shop", "Help"} & set(out.split()) and out.startswith("The ledger")
    assert all(x in out for x in ("## Next", "- Red", "- Blue", "| 1", "| 2", "Yes, do it."))


def test_clean_keeps_short_contents_of_one_kind():
    assert markup.clean("<ul><li>a<li>b</ul>").split() == ["-", "a", "-", "b"]
    assert "x = 1" in markup.clean(f"<nav><pre>x = 1</pre></nav>{PROSE * 3}") and "$y^2$" in markup.clean(f"<div>$y^2$</div>{PROSE * 3}")
    assert "Short" in markup.clean(f"Short<br>line{PROSE * 3}")


def test_found_notations_come_from_the_conversion(spark):
    found = queries.QUERIES["p2_found"](spark, "/root/testdata/sf0.001")
    assert "MapInPandas run(" in (plan := found._jdf.queryExecution().toString()) and re.search(r"MapInPandas run\([^\n]*\[record_id#\d+, kinds#\d+, text#\d+\]", plan)
    once = spark.read.parquet("/root/testdata/sf0.001/cms_documents.parquet").select("id", "content").distinct().collect()
    assert {tuple(r) for r in found.collect()} == {(r.id, k) for r in once for k in markup.converted(r.content)[1]}
    assert markup.converted("<p>One *two*</p>") == ("One two", ["html", "markdown"]) and markup.converted(None) == (None, [])


@pytest.mark.parametrize("answer,defect", [(None, "empty"), ("​", "empty"), ("N/A", "empty"), ("Sorry, I can't help with that request.", "refusal"), ("How do I reset the widget for the night shift team?", "copied_question"), ("First open the panel and then", "truncated"), ("Yes.", None), ("I can't reproduce this, but here is what helps. Open the panel and wait for the next sync.", None)])
def test_answer_votes(answer, defect):
    got = answers.votes("How do I reset the widget for the night shift team?", answer)
    ones = {d for d, v in zip(answers.DEFECTS, got) if "1" in v and v.count("1") >= v.count("0")}
    assert (defect in ones) if defect else not ones


def test_items_in_text():
    know = personal_data.Knowledge({"talia"}, {"velova"})
    kinds = {k for _, _, k in personal_data.items("Talia Velova, a.b@example.org, +44 20 7946 0380, SSN 666-92-4545, 12 Kiln Lane.", know)}
    assert kinds == set(personal_data.TYPES)
    assert not personal_data.items("Order 482-85-4064, Request id 123.456.7890, @quill/agent@2.3.7, ask @ops", know)
    assert personal_data.sanitise("Mail a.b@example.org now", know) == "Mail [EMAIL] now" and personal_data.sanitise(None, know) is None


def test_template_fields():
    assert residue.has_field("Dear {{first_name}},") and not residue.has_field("Write `{{name}}` and [optional] {\"a\": 1}")


def test_residue_of_nulls(spark):
    df = spark.createDataFrame([(1, None, "h"), (2, " ", "h"), (3, "Access denied.", None), (None, "Access denied.", "h")], "doc_id bigint, text string, source string")
    assert [(r.doc_id, r.residue_kind) for r in residue.classify(df).collect()] == [(3, "error_page")]


def test_long_units_count_as_filler_too(spark):
    latin = "vexilo quandor mirabus telentis orvam selquit drusca fendolis pramet hovicta limbrae zondur kelvatis urmena brosquil".split()
    rows = [(i, "Lorem ipsum " + " ".join(latin) + ".", f"h{i}") for i in range(5)] + [(9, " ".join(latin[::-1] * 4), "h9"), (10, "the steady ledger of our weekend crew " * 10, "h10")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    assert {(r.doc_id, r.residue_kind) for r in residue.classify(df).collect()} == {(i, "filler") for i in (0, 1, 2, 3, 4, 9)}


def test_words():
    assert text.words("A_b, C-3d") == ["a", "b", "c", "3d"] and text.words(None) == []
