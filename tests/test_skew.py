"""Hot-key forms equal the plain ones."""

import random
import statistics

import pytest
from pyspark.sql import Window, functions as F

from orbitframe.operators.rangejoin import overlap_self_join
from orbitframe.operators.skew import daily_stats, neighbours, robust_stats, running_sum, slice_of


def series(spark, seed, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = 0 if rng.random() < 0.4 else rng.randrange(1, 8)
        value = rng.choice([0.0, 1.5, -2.0, rng.gauss(0, 50), rng.expovariate(0.01)])
        rows.append((key, i, rng.randrange(0, 400) * 86_400_000_000 // 4, value))
    return rows, spark.createDataFrame(rows, ["k", "id", "us", "v"])


@pytest.mark.parametrize("cuts", [(4096, 4096), (1, 3), (2, 1)])
@pytest.mark.parametrize("parts", [1, 5])
def test_robust_stats(spark, cuts, parts):
    rows, df = series(spark, 3)
    got = {r["k"]: (r["n"], r["median"], r["mad"]) for r in robust_stats(
        df.repartition(parts), ["k"], F.col("v"), *cuts).collect()}
    assert set(got) == {r[0] for r in rows}
    for k, (n, median, mad) in got.items():
        values = [r[3] for r in rows if r[0] == k]
        centre = statistics.median(values)
        assert n == len(values) and median == pytest.approx(centre)
        assert mad == pytest.approx(statistics.median(abs(v - centre) for v in values))


def test_median_of_equal_values(spark):
    df = spark.createDataFrame([(1, 0.0)] * 50 + [(1, 3.0)], ["k", "v"])
    row = robust_stats(df, ["k"], F.col("v")).first()
    assert (row["n"], row["median"], row["mad"]) == (51, 0.0, 0.0)


def test_median_of_a_hot_key_in_a_narrow_range(spark):
    rng = random.Random(11)
    values = [1000.0 + rng.random() * 1e-3 for _ in range(3001)]
    df = spark.createDataFrame([(1, v) for v in values] + [(2, 5.0), (2, 9.0), (3, None), (None, 1.0)],
                               "k int, v double")
    got = {r["k"]: r for r in robust_stats(df, ["k"], F.col("v")).collect()}
    centre = statistics.median(values)
    assert set(got) == {1, 2} and got[1]["n"] == 3001 and got[1]["median"] == centre
    assert got[1]["mad"] == statistics.median(abs(v - centre) for v in values)
    assert (got[2]["median"], got[2]["mad"]) == (7.0, 2.0)


def test_building_a_median_starts_no_job(spark):
    df = spark.range(100).selectExpr("id % 3 AS k", "CAST(id AS DOUBLE) AS v")
    spark.sparkContext.setJobGroup("medians", "plan only")
    try:
        robust_stats(df, ["k"], F.col("v"))
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("medians")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_daily_stats_equal_robust_stats(spark):
    _, df = series(spark, 9)
    pick = lambda d: sorted((r["k"], r["n"], r["median"], round(r["mad"], 9)) for r in d.collect())
    assert pick(daily_stats(df, ["k"], F.col("v"))) == pick(robust_stats(df, ["k"], F.col("v")))


def test_running_sum_equals_window(spark):
    _, df = series(spark, 5)
    keyed = df.withColumn("s", slice_of(F.col("us"), 3 * 86_400_000_000))
    got = running_sum(keyed, ["k"], "s", ["us", "id"], F.col("id"), "total")
    w = Window.partitionBy("k").orderBy("us", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("total", F.sum("id").over(w))
    pick = lambda d: sorted((r["id"], r["total"]) for r in d.select("id", "total").collect())
    assert pick(got) == pick(want)


def test_neighbours_across_slices(spark):
    _, df = series(spark, 7)
    df = df.dropDuplicates(["k", "us"])
    got = neighbours(df, ["k"], "us", 2.0, ["id", "us"], slice_days=2.0, after=True)
    w = Window.partitionBy("k").orderBy("us")
    want = df.withColumns({"p": F.lag("us").over(w), "n": F.lead("us").over(w)})
    near = lambda a, b: a is not None and abs(a - b) <= 2 * 86_400_000_000
    found = {r["id"]: r for r in got.collect()}
    assert len(found) == df.count()
    for r in want.collect():
        row = found[r["id"]]
        if near(r["p"], r["us"]):
            assert row["prev"]["us"] == r["p"]
        if near(r["n"], r["us"]):
            assert row["next"]["us"] == r["n"]


@pytest.mark.parametrize("budget", [4_000_000, 50])
def test_overlap_join_equals_brute_force(spark, budget):
    rng = random.Random(1)
    rows = []
    for i in range(250):
        low = 35700.0 + rng.randrange(3) if i % 3 == 0 else rng.uniform(-60, 40000)
        length = rng.choice([0.0, 1.0, 100.0, 900.0, 40000.0, 250000.0])
        rows.append((i, low, low + length))
    df = spark.createDataFrame(rows, ["id", "lo", "hi"])
    got = overlap_self_join(df, "id", "lo", "hi", [], 100.0, pairs_per_task=budget,
                            starts_per_task=budget)
    pairs = [tuple(sorted((r["a_id"], r["b_id"]))) for r in got.collect()]
    want = {(a[0], b[0]) for a in rows for b in rows
            if a[0] < b[0] and a[1] <= b[2] and b[1] <= a[2]}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


@pytest.mark.parametrize("threshold, most", [("10m", 3), ("-1", 9)])
def test_medians_need_few_exchanges(spark, threshold, most):
    """Where brackets are sent to all tasks only sketches and counts are exchanged."""
    df = spark.range(1000).selectExpr("id % 3 AS k", "CAST(id * id % 97 AS DOUBLE) AS v")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        plan = robust_stats(df, ["k"], F.col("v"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    # counted as planned, before equal exchanges are shared
    print(plan.count("Exchange hashpartitioning"), plan.count("Window"))
    assert plan.count("Exchange hashpartitioning") <= 2 * most and "Window" not in plan


def test_an_emptied_bracket_is_an_error(spark, monkeypatch):
    """A bracket that missed the middle would not go unseen."""
    from orbitframe.operators import skew

    df = spark.createDataFrame([(1, float(i)) for i in range(50)], ["k", "v"])
    real = skew._brackets
    monkeypatch.setattr(skew, "_brackets", lambda *a: real(*a).withColumns(
        {"lo": F.lit(40.0), "hi": F.lit(41.0)}))
    with pytest.raises(Exception, match="quantile sketch"):
        robust_stats(df, ["k"], F.col("v")).collect()


@pytest.mark.parametrize("n", [1, 2, 3, 19, 20, 21, 199, 2002, 30_001])
def test_medians_at_many_sizes(spark, n):
    rng = random.Random(n)
    values = [rng.choice([0.0, -0.0, 5.0, rng.gauss(0, 1)]) for _ in range(n)]
    df = spark.createDataFrame([(1, v) for v in values], ["k", "v"]).repartition(3)
    centre = statistics.median(values)
    row = robust_stats(df, ["k"], F.col("v"), 20_000, 20_000).first()
    assert (row["n"], row["median"]) == (n, centre)
    assert row["mad"] == statistics.median(abs(v - centre) for v in values)
