"""What the order lines carry through the shuffles: few and narrow rows, the same results."""

from __future__ import annotations

import re
from types import SimpleNamespace

import pytest

from skillscope.sources import bindings as b


@pytest.fixture()
def shuffled(spark):
    """All joins shuffle, as on large tables."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _tables(spark):
    lines = [(1, 7, "A", 50.0, 10.5), (1, 8, "A", 49.0, 9.9), (1, 7, "A", None, 3.2), (2, 8, "N", 48.0, 20.1),
             (2, 9, "N", 47.0, 1.7), (3, 7, "R", 60.0, 5.5), (3, 7, "X", 50.0, 0.1), (3, 9, None, 50.0, 0.2),
             (4, 8, "R", float("nan"), 8.8), (9, 7, "A", 50.0, 1.0), (None, 7, "A", 50.0, 1.0), (5, None, "A", 12.0, 2.0)]
    orders = [(1, 10), (1, 10), (2, 10), (3, 11), (4, 22), (5, 23), (None, 10)]
    return SimpleNamespace(
        lineitem=spark.createDataFrame(
            lines, "l_orderkey long, l_partkey long, l_returnflag string, l_quantity double, l_extendedprice double"),
        orders=spark.createDataFrame(orders, "o_orderkey long, o_custkey long"),
        part=spark.createDataFrame([(7, "a"), (7, "a"), (8, "a"), (9, "b"), (10, None)], "p_partkey long, p_name string"),
        customer=spark.createDataFrame([(10,), (11,), (22,), (23,)], "c_custkey long"))


def test_kernel_tags_meet_their_orders_last(shuffled):
    t = _tables(shuffled)
    tags = shuffled.createDataFrame([(1, "a"), (2, "b")], "TagId long, Name string")
    out = b.kernel_tags(t, tags)
    assert sorted(map(tuple, out.collect())) == [(1, 1), (2, 1), (2, 2), (3, 1), (3, 2), (4, 1)]
    joined = out.join(t.orders.select("o_orderkey"), out.KernelId == t.orders.o_orderkey)
    exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*?), \d+\)", _plan(joined))
    assert not [e for e in exchanges if "TagId" in e]
    # orders twice, the lines by part and by order, the parts by name and by key, the tags: each once
    assert len(exchanges) == 7, exchanges


def test_achievement_lines_are_shuffled_as_one_code(shuffled):
    out = b.user_achievements(_tables(shuffled))
    got = [(r.UserId, r.AchievementType, r.TotalGold, r.TotalSilver, r.TotalBronze, r.HighestRanking) for r in out.collect()]
    names = ("Competitions", "Discussion", "Scripts")
    want = {(u, n): (u, n, 0, 0, 0, None) for u in (10, 11, 22, 23) for n in names}
    want[10, "Competitions"] = (10, "Competitions", 2, 2, 0, 3)
    want[10, "Discussion"] = (10, "Discussion", 0, 0, 1, 1)
    want[11, "Scripts"] = (None, "Scripts", 0, 0, 0, 5)     # 60 is no medal, but a rank
    want[22, "Scripts"] = (None, "Scripts", 0, 0, 0, 8)
    assert sorted(got, key=str) == sorted(want.values(), key=str)
    before_lines = _plan(out).split("hashpartitioning(l_orderkey")[0]
    assert "l_returnflag" not in before_lines and "l_quantity" not in before_lines

