import duckdb
import pytest
from test_core import DATA

from sparrowloom import registry

TABLES = ("responses", "requests", "support_tickets", "thread_messages", "cms_documents", "rag_documents")
NAMES = [f"{n}_whole" for n in ("fn_pii_detect", "fn_pii_mask", "fn_moderation_verdict", "fn_strip_html", "fn_chunk_fixed", "fn_support_boost", "sink_delete_older", "agg_support_stats", "agg_mongo_rollup")]


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = registry.queries()[name](spark, DATA)
    want = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    norm = lambda rows: sorted(tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in r) for r in rows)
    assert norm(got.select(columns).collect()) == norm(want.fetchall())


@pytest.fixture
def made(spark, tmp_path):
    def make(name, table, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{table}.parquet"))
        return [tuple(r) for r in registry.queries()[name](spark, str(tmp_path)).collect()]

    return make


def test_all_default_types_with_offsets(made):
    found = made("fn_pii_detect_whole", "support_tickets", [("1", "a@b.org, 415-555-0199 or 123-45-6789; 4111-1111-1111-1111, c@d.org"), ("2", None)], "id string, description string")
    assert sorted(found, key=lambda r: r[3]) == [("1", "email", "a@b.org", 0, 7), ("1", "phone", " 415-555-0199", 8, 21), ("1", "ssn", "123-45-6789", 25, 36), ("1", "credit_card", "4111-1111-1111-1111", 38, 57), ("1", "email", "c@d.org", 59, 66)]


def test_all_default_types_are_masked(made):
    assert made("fn_pii_mask_whole", "support_tickets", [("1", "a@b.org 123-45-6789; 4111-1111-1111-1111")], "id string, description string") == [("1", "[REDACTED] [REDACTED]; [REDACTED]")]


def test_verdicts(made):
    rows = [("1", "fine"), ("2", "What the Hell, a@b.org"), ("3", "my Password, damn"), ("4", "shell 123-45-6789")]
    got = made("fn_moderation_verdict_whole", "thread_messages", rows, "message_id string, content string")
    assert sorted(got) == [("1", True, False, "fine"), ("2", False, False, "What the ****, [REDACTED]"), ("3", False, True, None), ("4", False, False, "shell [REDACTED]")]


def test_scripts_and_entities_go(made):
    assert made("fn_strip_html_whole", "cms_documents", [("1", "<SCRIPT x>a<b\n</script><style>p{}</style><p>x &amp; y&#39;s&nbsp;&lt;</p>")], "id string, content string") == [("1", "x & y's <")]


def test_chunks_are_trimmed_and_blank_ones_dropped(made):
    rows = [("1", " a" + " " * 1900 + "b\n"), ("2", " \n")]
    assert sorted(made("fn_chunk_fixed_whole", "rag_documents", rows, "id string, content string")) == [("1", 0, "a"), ("1", 1600, "b")]
