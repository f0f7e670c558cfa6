import textwrap
import zlib

import compare
import pytest

from folio.plans import catalog


@pytest.fixture(scope="module")
def db(data):
    return compare.connect(data)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, data, db, name):
    if name not in catalog.ORACLE_SQL:
        pytest.skip("tested against plain Python")
    assert not compare.differences(catalog.QUERIES[name](spark, data), db, catalog.ORACLE_SQL[name])


def test_python_backed_queries(spark, data):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    lines = {}
    for r in catalog.QUERIES["wrapped_lines"](spark, data).orderBy("doc_id", "line").collect():
        lines.setdefault(r["doc_id"], []).append(r["line_text"])
    assert lines == {k: v for k, t in texts.items() if (v := textwrap.wrap(t or "", 80))}
    for r in catalog.QUERIES["recompressed"](spark, data).collect():
        raw = texts[r["doc_id"]].encode()
        assert (r["bytes_before"], r["bytes_after"]) == (len(raw), min(len(raw), len(zlib.compress(raw))))
    assert {r["doc_id"]: r["text"] for r in catalog.QUERIES["flate_round_trip"](spark, data).collect()} == {k: t or "" for k, t in texts.items()}
    spoken = catalog.QUERIES["sentence_split"](spark, data).collect()
    assert all(texts[r["doc_id"]][r["start"] : r["start"] + r["length"]].strip() for r in spoken)
    assert {r["doc_id"] for r in spoken} == {k for k, t in texts.items() if t and any(c.isalnum() for c in t)}


def test_entry(spark, data):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["doc_id", "matches", "snippet"]


def test_scans_read_only_what_they_need(spark, data):
    plan = catalog.QUERIES["comment_filter"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(role), EqualTo(role,user)" in plan.replace("IsNotNull(text), ", "")
    plan = catalog.QUERIES["portfolio_pivot"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "value" not in plan.partition("ReadSchema")[2].partition("\n")[0]


def test_both_ways_of_a_round_trip_share_a_process(spark, data):
    plan = catalog.QUERIES["flate_round_trip"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EvalPython") == 1
