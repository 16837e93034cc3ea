import duckdb
import pytest
from pyspark.sql import functions as F

from sparrowloom import registry
from sparrowloom.functions import vectors
from sparrowloom.operators import metrics, windows

DATA = "/root/testdata/sf0.001"
TIMINGS = "struct<total:double,llm_api_time:double,rag_retrieval_time:double,plugin_execution_time:double,db_query_time:double,time_to_first_token:double,time_to_last_token:double,queue_time:double>"


def responses(spark, totals):
    rows = [(str(i), (t, None, None, None, None, None, None, None)) for i, t in enumerate(totals)]
    return spark.createDataFrame(rows, f"id string, timings {TIMINGS}")


def test_performance_of_known_latencies(spark):
    row = metrics.performance(responses(spark, [float(x) for x in range(100, 1001, 100)])).first()
    assert (row.avg_total, row.p50, row.p95, row.min_total, row.max_total) == (550, 500, 1000, 100, 1000)
    assert [row[f"bucket_{i}"] for i in range(5)] == [0, 4, 5, 1, 0]


def test_performance_of_nothing_is_zero(spark):
    row = metrics.performance(responses(spark, [])).first()
    assert row.n == 0 and row.p95 == 0 and row.avg_total == 0


def test_rate_limit_counts_refused_requests_and_starts_anew(spark):
    log = spark.createDataFrame([("u", t, i) for i, t in enumerate([0, 10, 20, 30, 1001, 1002])] + [("v", 5, 9)], "k string, ts_ms bigint, seq bigint")
    rows = {(r.k, r.seq): (r.used, r.allowed, r.remaining) for r in windows.rate_limit(log, "k", 3, 1000).collect()}
    assert rows["u", 2] == (3, True, 0) and rows["u", 3] == (4, False, 0) and rows["u", 4] == (1, True, 2) and rows["v", 9] == (1, True, 2)


def test_cosine_edges(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0, 0.0]), ([1.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, None, None]


@pytest.mark.parametrize("name", ["agg_performance", "agg_cost_by_model", "join_anti_existing", "win_rate_limit", "topk_default"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in ("responses", "requests", "embeddings", "agents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = registry.queries()[name](spark, DATA).toPandas()
    want = con.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    norm = lambda df: sorted(tuple(f"{x:.6g}" if isinstance(x, float) else str(x) for x in r) for r in df[sorted(df.columns)].values.tolist())
    assert norm(got) == norm(want)
