"""Every registered query against its SQL over the smallest tables, where these are at hand."""

import math
import os
import re

import pytest

import __spark_entry__
from parley import plans

SF = os.environ.get("PARLEY_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF)
    rows = df.collect()
    if name not in plans.ORACLES:
        assert rows
        return
    cursor = duck.execute(plans.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(repr([plain(r[names.index(c)]) for c in sorted(names)]) for r in cursor.fetchall())
    assert sorted(repr([plain(r[c]) for c in sorted(names)]) for r in rows) == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_plans_push_down(spark):
    plan = __spark_entry__.queries()["status_counts"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_custkey:bigint,o_orderstatus:string,o_totalprice:double>" in plan
    plan = __spark_entry__.queries()["tasks_with_messages"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,P)" in plan


def test_time_ranges_reach_the_scan(spark):
    """Half-open ranges and cursors are filters on the stored time, which the scan takes."""
    found = __spark_entry__.queries()
    for name in ("archive_range_scan", "sharded_chat_scan", "local_day_range", "feed_page"):
        plan = found[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        pushed = re.findall(r"PushedFilters: \[([^\]]*)", plan)
        assert any("ts," in x and "Than" in x for x in pushed), (name, pushed)
    near = found["context_neighbours"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert near.count("Exchange hashpartitioning(chat_id") == 1 and "Join" not in near
