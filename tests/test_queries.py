import pytest

from tests.conftest import same
from tierstone.plans import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, duck, name):
    same(registry.queries()[name](spark, sf_dir), duck, registry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert registry.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_plans_push_down_and_prune(spark, sf_dir):
    plan = registry.queries()["q41_counters_by_hour"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<" in plan and "Python" not in plan
    lookup = registry.queries()["q02_bucket"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "l_shipdate" not in lookup and "Exchange" not in lookup


def test_bodies_of_ranges_are_whole(spark, sf_dir):
    found = registry.queries()
    want = {r["key"]: r["body_len"] for r in found["q18_status"](spark, sf_dir).where("status = 206").collect()}
    for name in ("q20_ranged_bytes", "q20_ranged_bytes_whole"):
        got = {r["key"]: r["body"] for r in found[name](spark, sf_dir).collect()}
        assert {k: len(b) // 2 for k, b in got.items()} == want and max(want.values()) > 64
