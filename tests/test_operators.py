"""Nulls, ties, repeated and empty rows of the core operators, against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparrowloom import runtime
from sparrowloom.functions import moderation, texts
from sparrowloom.operators import logs, percentiles, retrieval, store, windows
from sparrowloom.sources import records, web


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


def test_latest_keeps_null_keys_and_first_filters_reach_the_scan(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (None, "b", 1), (None, "b", 1), (2, "c", 1)], "id int, v string, ingested_at int")
    assert sorted(str(r) for r in runtime.latest(df, "id").collect()) == sorted(["Row(id=1, v='a')", "Row(id=2, v='c')", "Row(id=None, v='b')", "Row(id=None, v='b')"])
    df.write.parquet(str(tmp_path / "t.parquet"))
    plan = runtime.once(spark, str(tmp_path), "t", "id", F.col("v") == "a")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(v,a)" in plan


def test_broadcasts_are_bounded_by_rows_and_bytes(spark):
    df = spark.range(100).select(F.repeat(F.lit("x"), 1000).alias("t"))
    assert runtime.small_or_none(df) is not None and runtime.small_or_none(df, rows=99) is None and runtime.small_or_none(df, size=50_000) is None


@pytest.mark.parametrize("n", [0, 1, 250])
def test_ranks_over_all_rows(spark, n):
    values = [random.Random(n).randrange(40) for _ in range(n)]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v int, id int").repartition(5)
    got = [(r.v, r.id) for r in runtime.ranked(df, "v", "id").orderBy("rank").collect()]
    assert got == sorted((v, i) for i, v in enumerate(values))


@pytest.mark.parametrize("values", [[], [5.0], [1.0] * 9, [float(x) for x in range(100, 1001, 100)], [-1e300, 0.0, 3.5, 1e300], [1.0, math.inf, -math.inf, 2.0], [1.0 + i * 2**-52 for i in range(5000)]])
def test_nearest_rank(spark, values):
    df = spark.createDataFrame([(v,) for v in [*values, None, math.nan]], "v double")
    got = percentiles.nearest_rank(df, "v", (1, 500, 950, 1000)).first()
    want = [sorted(values)[max(1, -(-len(values) * p // 1000)) - 1] if values else None for p in (1, 500, 950, 1000)]
    assert list(got) == want


@pytest.mark.parametrize("strict", [True, False])
def test_windows_from_a_first_row(spark, strict):
    r = random.Random(7)
    log = [(f"k{r.randrange(4)}", r.randrange(5000), i) for i in range(600)] + [("k0", 77, 1000 + i) for i in range(50)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = {x.seq: (x.opened_ms, x.used) for x in windows.anchored(spark.createDataFrame(log, "k string, ts_ms bigint, seq bigint"), "k", 300, strict).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    state, want = {}, {}
    for k, t, i in sorted(log):
        start, n = state.get(k, (None, 0))
        if start is None or (t > start + 300 if strict else t >= start + 300):
            start, n = t, 0
        state[k] = start, n + 1
        want[i] = start, n + 1
    assert got == want


def test_rate_limits_tell_when_to_come_back(spark):
    log = spark.createDataFrame([("u", t, i) for i, t in enumerate([0, 10, 20, 1000, 1001])], "k string, ts_ms bigint, seq bigint")
    rows = {r.seq: (r.allowed, r.remaining, r.reset_ms, r.retry_after) for r in windows.rate_limit(log, "k", 2, 1000).collect()}
    assert rows == {0: (True, 1, 1000, 0), 1: (True, 0, 1000, 0), 2: (False, 0, 1000, 1), 3: (False, 0, 1000, 0), 4: (True, 1, 2001, 0)}


def test_budgets_by_week_begin_on_sunday(spark):
    df = spark.createDataFrame([("2025-03-01 23:00:00", 5, 1), ("2025-03-02 00:00:00", 7, 2), ("2025-03-08 23:59:59", 1, 3)], "t string, tokens bigint, seq int").select("tokens", "seq", F.col("t").cast("timestamp").alias("ts"), F.lit("k").alias("k"))
    assert [r.used_before for r in windows.usage(df, "k", "week").orderBy("seq").collect()] == [0, 0, 7]
    assert [str(r.resets_at) for r in windows.usage(df, "k", "month").orderBy("seq").collect()] == ["2025-04-01 00:00:00"] * 3
    s = windows.status(df, "k", 10, "month", 0.5).orderBy("seq").collect()
    assert [(r.left_over, r.exceeded, r.decision) for r in s] == [(10, False, "pass"), (5, False, "warn"), (0, True, "reject")]


def test_chunks(spark):
    text = "\n\n".join(["x" * 50] * 3)
    assert one(spark, lambda c: texts.paragraphs(c, 100), text) == ["x" * 50 + "\n\n" + "x" * 50, "x" * 50]
    assert one(spark, lambda c: texts.slices(c, 50, 10), "y" * 150) == ["y" * 50, "y" * 50, "y" * 50, "y" * 30]
    assert one(spark, lambda c: texts.sentences(c, 10), "One. Two! Three? Four") == ["One. Two!", "Three? Four"]
    assert one(spark, lambda c: texts.paragraphs(c), None) is None and one(spark, lambda c: texts.slices(c), "") == [] and one(spark, lambda c: texts.paragraphs(c), " \n\n ") == []
    with pytest.raises(ValueError):
        texts.slices(F.col("x"), 10, 10)


def test_markdown_chunks():
    got = texts.markdown_chunks("intro\n# One\ntext\n```sql\nSELECT 1\n# no heading\n```\nafter\n```\nopen", title="Doc")
    assert got == [("intro", "text", "Doc", None), ("One", "heading", "One", None), ("text", "text", "One", None), ("SELECT 1\n# no heading", "code", "One", "sql"), ("after", "text", "One", None), ("open", "code", "One", None)]
    assert [c[0] for c in texts.markdown_chunks("a" * 8 + "\n" + "b" * 8, most=8)] == ["a" * 8, "b" * 8] and texts.markdown_chunks("") == []


@pytest.mark.parametrize("line,cells", [('a,"b, c",d', ["a", "b, c", "d"]), ('"say ""hi""", x ', ["say hi", "x"]), ("", [""]), (",", ["", ""])])
def test_csv_cells(spark, line, cells):
    assert one(spark, records.csv_cells, line) == cells


def test_documents_of_payloads(spark):
    rows = [('[{"id":"1","content":"a","k":2},{"content":""}]',), ('{"id":"x"}',), (None,), ("no json",), ("[]",)]
    got = [(r.id, r.content, dict(r.metadata)) for r in records.json_documents(spark.createDataFrame(rows, "p string"), "p", {"kind": "k"}).collect()]
    assert got[0] == ("1", "a", {"kind": "2", "type": "content"}) and got[1][0] == "doc-1" and got[1][1] == '{"content":""}' and got[2][0] == "x"
    csv = spark.createDataFrame([("id,t\n1,x\n2\n",), ("id,t",), (None,), ("",)], "p string")
    assert [(r.id, r.metadata["t"]) for r in records.csv_documents(csv, "p", {"t": "t"}).collect()] == [("1", "x"), ("2", "")]
    xml = spark.createDataFrame([("<item><id> 7 </id><b>1</b><b>2</b></item><ITEM></ITEM>",), (None,)], "p string")
    assert [(r.id, r.metadata["b"]) for r in records.xml_documents(xml, "p", {"b": "b"}).collect()] == [("7", "2"), ("doc-1", None)]
    with pytest.raises(Exception, match="no array"):
        spark.createDataFrame([('{"a":1}',)], "p string").select(records.dollar_items(F.col("p"), "$.a[*]")).collect()


def test_pages_without_furniture():
    title, text = web.page_text("<html><head><title>T</title><script>x</script></head><body><div class='menu big'>M</div><p>out</p><main>In  <b>side</b><nav>n</nav></main><footer>f</footer></body></html>")
    assert (title, text) == ("T", "In side") and web.page_text("<body>only <i>body</i></body>") == ("", "only body") and web.page_text("") == ("", "")


def test_feeds_and_sitemaps(spark):
    feed = '<rss><item><title><![CDATA[ A & B ]]></title><content>c</content></item></rss>'
    r = web.feed_items(spark.createDataFrame([(feed,), (None,), ("",)], "x string"), "x").collect()
    assert [(i.title, i.content, i.link, i.categories) for i in r] == [("A & B", "c", None, [])]
    assert one(spark, web.sitemap_urls, "<url><loc> http://a </loc></url><url><loc>ftp://b</loc></url>") == ["http://a"] and one(spark, web.sitemap_urls, None) is None


def test_top_k_with_ties_and_unusable_vectors(spark):
    rows = [("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("c", [0.0, 1.0]), ("z", [0.0, 0.0]), ("n", None), ("s", [1.0]), ("q", [float("nan"), 1.0])]
    df = spark.createDataFrame(rows, "id string, embedding array<double>")
    got = [(r.query_id, r.id, r.rank) for r in retrieval.top_k(df, df.where("id = 'b'"), 3).orderBy("rank").collect()]
    assert got == [("b", "a", 1), ("b", "b", 2), ("b", "c", 3)]
    assert retrieval.top_k(df.limit(0), df, 3).count() == 0 and retrieval.top_k(df, df.limit(0), 3).count() == 0
    rng = np.random.RandomState(1)
    x = rng.randn(300, 8)
    many = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, embedding array<double>").repartition(4)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    found = {(r.query_id, r.rank): r.id for r in retrieval.top_k(many, many.where("id % 20 = 0"), 5).collect()}
    assert all(found[i, k + 1] == j for i in range(0, 300, 20) for k, j in enumerate(np.argsort(-np.round(u @ u[i], 9), kind="stable")[:5]))


def test_top_k_in_blocks(spark, monkeypatch):
    rng = np.random.RandomState(2)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.randn(50, 4))], "id int, embedding array<double>")
    whole = {tuple(r) for r in retrieval.top_k(df, df, 3).collect()}
    monkeypatch.setattr(retrieval, "BLOCK", 20)
    assert {tuple(r) for r in retrieval.top_k(df, df, 3).collect()} == whole and len(whole) == 150


def test_boosts(spark):
    row = spark.sql("SELECT 1D AS s, 'faq' AS k, timestamp '2025-01-11' AS at").select(
        retrieval.type_boost(F.col("s"), F.col("k"), {"faq": 1.3}).alias("a"), retrieval.recency_boost(F.col("s"), F.lit("2025-01-01").cast("timestamp"), F.col("at"), 20.0).alias("b"),
        retrieval.recency_boost(F.col("s"), F.lit(None).cast("timestamp"), F.col("at"), 20.0).alias("c"), retrieval.blend(F.col("s"), F.lit(None).cast("double")).alias("d")).first()
    assert tuple(row) == (1.3, 1.1, 1.0, 0.5)


def test_writes(spark, tmp_path):
    t = spark.createDataFrame([("1", "a", 1, 1), ("2", "b", 1, 1)], "id string, v string, created_at int, updated_at int")
    new = spark.createDataFrame([("2", None), ("3", "n")], "id string, v string")
    assert {tuple(r) for r in store.upsert(t, new, ["id"], F.lit(9)).collect()} == {("1", "a", 1, 1), ("2", "b", 1, 9), ("3", "n", 9, 9)}
    plain = t.select("id", "v")
    assert {tuple(r) for r in store.replace(plain, new, ["id"]).collect()} == {("1", "a"), ("2", None), ("3", "n")}
    assert {tuple(r) for r in store.insert_new(plain, new, ["id"]).collect()} == {("1", "a"), ("2", "b"), ("3", "n")}
    assert {tuple(r) for r in store.delete(plain, new, ["id"]).collect()} == {("1", "a")}
    assert {tuple(r) for r in store.update(plain, new, "id").collect()} == {("1", "a"), ("2", "b")}
    log = spark.createDataFrame([(1, "insert", "3", "c"), (2, "update", "3", "d"), (3, "delete", "1", None), (4, "update", "2", "u"), (5, "update", "9", "x")], "seq int, op string, id string, v string")
    after, counted = store.apply_changes(plain, log, "id")
    assert {tuple(r) for r in after.collect()} == {("2", "u")} and tuple(counted.first()) == (1, 3, 1)
    store.replace_table(plain, str(tmp_path / "t"))
    store.replace_table(plain.limit(0), str(tmp_path / "t"))
    assert store.read_table(spark, str(tmp_path / "t")).count() == 0
    none = plain.limit(0)
    assert store.replace(none, none, ["id"]).count() == 0 and store.apply_changes(none, log.limit(0), "id")[0].count() == 0


def test_hashes_round_trip(spark):
    df = spark.sql("SELECT '1' AS id, array('a', null) AS tags, 5L AS n, CAST(null AS string) AS s UNION ALL SELECT '2', null, null, 'x'")
    back = store.decode_hash(store.encode_hash(df, ["tags", "n", "s"]), {"tags": "array<string>", "n": "bigint", "s": "string"})
    assert {str(r) for r in back.collect()} == {str(r) for r in df.collect()}


def test_summaries_of_nothing(spark):
    q = spark.createDataFrame([], "id string, thread_id string, user_id string, agent_id string, ts timestamp, message_length bigint")
    assert set(logs.conversation_summary(q).first()) == {0}
    e = spark.createDataFrame([], "id string, error_type string, component string")
    row = logs.error_summary(e, q).first()
    assert row.error_rate == 0 and row.success_rate == 1 and row.by_type == ""


def test_asof_takes_the_latest_request(spark):
    q = spark.sql("SELECT 'q1' AS id, 't' AS thread_id, timestamp '2025-01-01' AS ts UNION ALL SELECT 'q2', 't', timestamp '2025-01-02' UNION ALL SELECT 'q3', null, timestamp '2025-01-02'")
    r = spark.sql("SELECT 'r1' AS id, 't' AS thread_id, timestamp '2025-01-02' AS ts UNION ALL SELECT 'r0', 't', timestamp '2024-01-02' UNION ALL SELECT 'r9', null, timestamp '2025-01-02'")
    assert {tuple(x) for x in logs.preceding_request(q, r).select("id", "request_id").collect()} == {("r1", "q2"), ("r0", None)}


def test_moderation(spark):
    row = spark.createDataFrame([("Damn! Mail a@b.org, 123-45-6789 about the Password",)], "x string").select(moderation.pii(F.col("x")).alias("p"), moderation.verdict(F.col("x"), {"password": "block"}).alias("v"), moderation.verdict(F.col("x"), {"password": "flag"}).alias("w")).first()
    assert [(s.sub_type, s.text, s.start, s.stop) for s in row.p] == [("email", "a@b.org", 11, 18), ("ssn", "123-45-6789", 20, 31)]
    assert row.v.blocked and row.v.moderated_text is None and row.v.violations == 4 and row.w.moderated_text == "****! Mail [REDACTED], [REDACTED] about the Password"
    assert moderation.word_list(("a", "a"), ["B"], ["A"]) == ["a", "b"]


def test_triggers_the_last_one_named_wins(spark):
    df = spark.createDataFrame([(5000.0, "help", 10), (5000.0, "help", 3), (5000.0, "x", 3), (3000.0, "x", 3), (None, None, 3)], "l double, t string, k int")
    assert [r[0] for r in df.select(moderation.trigger(F.col("l"), F.col("t"), F.col("k"), 3000.0, ["HELP"], 5)).collect()] == ["sampling", "keyword", "long_response", None, None]
