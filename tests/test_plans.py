"""Plan checks: built-in expressions only, no Cartesian products, pruned
scans, partial aggregation, and oracle parity of every registered query."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from vetrina.plans import registry

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["mine_2", "match_queries", "match_price", "attach_facts", "keyword_search", "fill_slots", "triples",
                                  "metrics_slices", "html_to_text", "label_tagger"])
def test_no_python_no_cartesian(spark, name):
    p = plan(queries()[name](spark, SF))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_scan_is_pruned(spark):
    p = plan(queries()["capacity"](spark, SF))
    assert "ReadSchema: struct<p_partkey:bigint,p_name:string,p_size:int>" in p


def test_last_wins_is_partial(spark):
    p = plan(queries()["latest_by_key"](spark, SF))
    assert "partial_max_by" in p


def test_entry_smoke(spark):
    df = entry(spark)
    assert df.columns == ["query_id", "id"]
    assert df.count() >= 0


@pytest.mark.skipif(not os.path.exists(SF), reason="test tables absent")
def test_every_query_matches_its_oracle(spark):
    from tests.oracle_check import compare

    res = compare(spark, SF, list(registry.QUERIES), verbose=False)
    bad = {k: v for k, v in res.items() if v[0] not in ("ok", "rows-only")}
    assert not bad
    assert set(registry.ORACLES) == set(registry.QUERIES) and set(oracle_sql()) >= set(registry.QUERIES)


def test_lexicon_join_is_broadcast(spark):
    p = plan(queries()["label_tagger"](spark, SF))
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p


def test_one_extraction_and_one_driving_join(spark):
    p = plan(queries()["attach_facts"](spark, SF))
    assert "regexp_extract_all" not in p  # pages were extracted once, before
    p = plan(queries()["match_queries"](spark, SF))
    assert p.count("product(") <= 4 and "part.parquet" in p  # one chain of checks, and the id mapping
