import math
import random

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from skillscope.operators import ranking
from skillscope.operators.ranking import RankSpec, average_rank_pct, ordinal, percent_rank, rank_columns


def _vals(df, col, key="id"):
    return {r[key]: r[col] for r in df.collect()}


def test_ties_average_pct(spark):
    df = spark.createDataFrame([(1, "t", 1), (2, "t", 1), (3, "t", 3), (4, "t", 5)], "id int, tag string, c long")
    out = _vals(average_rank_pct(df, "c", "p", partition_by=["tag"]), "p")
    assert out == {1: 0.375, 2: 0.375, 3: 0.75, 4: 1.0}
    down = _vals(average_rank_pct(df, "c", "p", partition_by=["tag"], descending=True), "p")
    assert down == {1: 0.875, 2: 0.875, 3: 0.5, 4: 0.25}


def test_nulls_descending(spark):
    df = spark.createDataFrame([(1, 9), (2, 5), (3, 1), (4, None)], "id int, r long")
    literal = _vals(percent_rank(df, "r", "p", descending=True), "p")         # nulls last (reference)
    assert literal == pytest.approx({1: 0.0, 2: 1 / 3, 3: 2 / 3, 4: 1.0})
    rebuilt = _vals(percent_rank(df, "r", "p", descending=True, nulls_first=True), "p")  # null rank scores 0
    assert rebuilt == pytest.approx({1: 1 / 3, 2: 2 / 3, 3: 1.0, 4: 0.0})
    assert _vals(ordinal(df, "r", "o", descending=True), "o") == {1: 1, 2: 2, 3: 3, 4: None}


def test_one_row_and_no_rows(spark):
    df = spark.createDataFrame([(1, 7.5)], "id int, v double")
    assert _vals(percent_rank(df, "v", "p"), "p") == {1: 0.0}
    assert percent_rank(df.limit(0), "v", "p").count() == 0


def test_null_keys_are_a_group(spark):
    df = spark.createDataFrame([(1, None, 1), (2, None, 2), (3, "a", 5), (4, "a", 5)], "id int, k string, v long")
    assert _vals(percent_rank(df, "v", "p", partition_by=["k"]), "p") == {1: 0.0, 2: 1.0, 3: 0.0, 4: 0.0}


def test_nan_sorts_as_in_spark(spark):
    df = spark.createDataFrame([(1, 1.0), (2, math.nan), (3, None), (4, math.inf), (5, math.nan)], "id int, v double")
    for descending in (False, True):
        o = F.col("v").desc() if descending else F.col("v").asc()
        want = _vals(df.select("id", F.percent_rank().over(Window.orderBy(o)).alias("p")), "p")
        assert _vals(percent_rank(df, "v", "p", descending=descending), "p") == want


@pytest.mark.parametrize("cuts", [255, 7])
def test_equals_plain_windows_on_random_rows(spark, monkeypatch, cuts):
    monkeypatch.setattr(ranking, "CUTS", cuts)
    rnd = random.Random(5)
    rows = []
    for i in range(3000):
        key = rnd.choice(["a", "a", "a", "b", "c", None])           # one hot key, one null key
        v = None if rnd.random() < 0.05 else rnd.choice([0, 0, 0, 1, 2, 3, rnd.randint(0, 400)])
        rows.append((i, key, v, float(rnd.randint(0, 50)), "w%d" % rnd.randint(0, 900)))
    df = spark.createDataFrame(rows, "id int, k string, v long, d double, s string")
    got = rank_columns(df, [RankSpec("v", "p_asc"), RankSpec("v", "p_desc", "percent", True),
                            RankSpec("d", "p_avg", "average_pct"), RankSpec("d", "o", "ordinal"),
                            RankSpec("s", "p_text", "percent", True)], partition_by=["k"])
    assert got.columns == df.columns + ["p_asc", "p_desc", "p_avg", "o", "p_text"]
    w = Window.partitionBy("k")
    ref = df.select(
        "id",
        F.percent_rank().over(w.orderBy(F.col("v").asc_nulls_first())).alias("p_asc"),
        F.percent_rank().over(w.orderBy(F.col("v").desc_nulls_last())).alias("p_desc"),
        F.percent_rank().over(w.orderBy(F.col("s").desc())).alias("p_text"),
        F.rank().over(w.orderBy("d")).cast("long").alias("o"))
    g = {r["id"]: r for r in got.collect()}
    assert len(g) == len(rows)
    for r in ref.collect():
        for c in ("p_asc", "p_desc", "p_text", "o"):
            assert g[r["id"]][c] == pytest.approx(r[c])
    pdf = pd.DataFrame(rows, columns=["id", "k", "v", "d", "s"])
    pdf["p_avg"] = pdf.groupby("k", dropna=False)["d"].rank(pct=True)
    for _, r in pdf.iterrows():
        assert g[r["id"]]["p_avg"] == pytest.approx(r["p_avg"])


def test_rows_never_meet_in_one_task(spark):
    """Single-partition exchanges carry the bounded sample of values only, and no job runs while the plan is built."""
    df = spark.range(0, 5000).withColumn("v", (F.col("id") * 7919) % 1000)
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None) or [])
    lines = percent_rank(df, "v", "p")._jdf.queryExecution().executedPlan().toString().split("\n")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None) or []) == before
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            assert "partial_collect_list" in lines[i + 1] and any("TakeOrdered" in x for x in lines[i + 2:i + 5]), lines[i:]


def test_strings_and_structs(spark):
    df = spark.createDataFrame([("b", 1), ("a", 1), ("c", 2)], "Name string, n int")
    assert {r["Name"]: r["o"] for r in ordinal(df, "Name", "o").collect()} == {"a": 1, "b": 2, "c": 3}
    pairs = df.withColumn("x", F.struct((-F.col("n")).alias("n"), "Name"))
    assert {r["Name"]: r["o"] for r in ordinal(pairs, "x", "o").collect()} == {"c": 1, "a": 2, "b": 3}


def test_a_hot_value_weighs_one_row(spark):
    """A value held by a third of all rows, and null, are one row of the histogram, and buckets hold few values."""
    n = 30000
    df = spark.range(n).withColumn("v", F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 3 == 1, F.col("id")))
    got = percent_rank(df, "v", "p")
    want = df.select("id", F.percent_rank().over(Window.orderBy("v")).alias("p"))
    assert got.join(want.withColumnRenamed("p", "q"), "id").filter("p <> q").isEmpty()
    hist = ranking.value_histogram(df, ["v"], [], "bigint")
    assert sorted(r["n"] for r in hist.collect())[-2:] == [n // 3, n // 3] and hist.count() == n // 3 + 2
    sizes = ranking.bucketed(hist, []).groupBy("b").count().collect()
    assert len(sizes) > 200 and max(r["count"] for r in sizes) < n // 3 // 50


def test_a_hot_string_neither_fills_the_sample_nor_a_bucket(spark):
    """Strings: one held by half of the rows, in its own and in a key that is hot as well."""
    n = 20000
    df = spark.range(n).select("id", F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("s"), "id")).alias("s"),
                               F.when(F.col("id") % 5 > 0, "k").alias("k"))
    got = rank_columns(df, [RankSpec("s", "p"), RankSpec("s", "o", "ordinal", True)], ["k"])
    w = Window.partitionBy("k")
    want = df.select("id", F.percent_rank().over(w.orderBy("s")).alias("q"), F.rank().over(w.orderBy(F.desc("s"))).alias("r"))
    assert got.join(want, "id").filter("p = q AND o = r").count() == n
    sizes = ranking.bucketed(ranking.value_histogram(df, ["s"], ["k"], "string"), ["k"]).groupBy("b").count().collect()
    assert len(sizes) > 200 and max(r["count"] for r in sizes) < n // 2 // 50


def test_two_columns_and_clashing_names(spark):
    df = spark.createDataFrame([(1, 5, 1.5), (2, 5, None), (3, 7, 0.5)], "p int, n long, v double")
    got = rank_columns(df, [RankSpec("p", "a"), RankSpec("n", "b"), RankSpec("v", "c", "average_pct")]).orderBy("p").collect()
    assert [tuple(r) for r in got] == [(1, 5, 1.5, 0.0, 0.0, 1.0), (2, 5, None, 0.5, 0.0, None), (3, 7, 0.5, 1.0, 1.0, 0.5)]


@pytest.mark.parametrize("stored", [False, True])
def test_rows_of_hot_values_are_dealt_among_tasks(spark, stored):
    """A column where one value holds 80 of 100 rows and the others are distinct, next to one of two values: equal to
    plain windows, and no task of the joins gets the rows of the hot value."""
    n = 20000
    df = spark.range(n).select("id", F.when(F.col("id") % 5 > 0, 7).otherwise(F.col("id") + 100).alias("v"),
                               F.when(F.col("id") % 10 > 0, F.col("id") % 2).alias("few"))
    specs = [RankSpec("v", "p"), RankSpec("few", "q", "percent", True), RankSpec("v", "a", "average_pct")]
    got = (ranking.rank_stored if stored else rank_columns)(df, specs)
    w = df.select("id", F.percent_rank().over(Window.orderBy("v")).alias("p2"),
                  F.percent_rank().over(Window.orderBy(F.desc("few"))).alias("q2"))
    assert got.join(w, "id").filter("p = p2 AND q = q2 AND a IS NOT NULL").count() == n
    # the partitions in which the joins leave the rows, with partitions as they are planned
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        one = (ranking.rank_stored if stored else rank_columns)(df, specs[:1])
        sizes = one.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(r["count"] for r in sizes) == n and max(r["count"] for r in sizes) < n // 4


def test_ranks_of_no_rows_are_stored(spark):
    df = spark.createDataFrame([], "id int, k string, v long")
    assert ranking.rank_stored(df, [RankSpec("v", "p"), RankSpec("v", "o", "ordinal", True)], ["k"]).collect() == []
