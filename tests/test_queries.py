"""Every registered query against its SQL; those without SQL give rows with a stable schema."""

import pytest

import __spark_entry__ as entry
from almanac.plans import registry
from tests.oracle import check

NAMES = sorted(registry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, small, name):
    query, sql = registry.queries()[name], registry.oracle_sql().get(name)
    if sql:
        check(spark, small, query, sql)
    else:
        assert query(spark, small).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(registry.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_reach_the_scan(spark, small):
    plan = registry.queries()["season_totals"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in plan
    assert "o_orderpriority" not in plan


def test_greedy_terms_returns_every_term(spark, tmp_path):
    from almanac.plans import stateful

    spark.createDataFrame([(1, "the and der de la les le de la the"), (2, "none"), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["n_terms"], r["terms"]) for r in stateful.greedy_terms(spark, str(tmp_path)).collect()}
    assert got[1] == (7, "A,F,G,E,D,G,B") and got[2] == (0, "")
