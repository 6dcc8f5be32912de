"""Breakups, decay, proximity, graph and anomaly ranking."""

import duckdb
import pytest
from pyspark.sql import functions as F

from orbitframe.operators import anomaly, breakup, catalog, decay, proximity

SATCAT = ("norad_id long, intl_desig string, name string, object_type string, "
          "inclination double, perigee_km double, apogee_km double")


def cohort(spark, debris, parent=(1, "PAY"), prefix="2031-044"):
    """A parent and debris given as (norad_id, inclination)."""
    rows = [(parent[0], prefix + "A", "MOTHER", parent[1], 64.9, 905.0, 948.0)]
    rows += [(i, prefix + "X", f"PIECE {i}", "DEB", incl, 890.0, 960.0) for i, incl in debris]
    return spark.createDataFrame(rows, SATCAT)


def test_cloud_in_one_plane(spark):
    cat = cohort(spark, [(71_000 + 3 * i, 64.9 - (i % 2) * .3) for i in range(120)])
    found = breakup.launch_breakups(cat)
    row = found.first()
    assert (row["n_fragments"], row["parent_norad_id"], row["confidence"]) == (120, 1, "high")
    assert breakup.breakup_fragments(cat, found).count() == 120


def test_scattered_planes_are_low_confidence(spark):
    fan = [(71_000 + i, incl) for i, incl in enumerate([3., 19., 28., 41., 55., 63., 77., 86., 99., 112., 140.])]
    assert breakup.launch_breakups(cohort(spark, fan)).first()["confidence"] == "low"


def test_items_lost_over_years_and_unmeasured_ones(spark):
    years = cohort(spark, [(9_000 * (k + 1) ** 2, 30.0) for k in range(12)])
    assert breakup.launch_breakups(years).count() == 0
    unmeasured = cohort(spark, [(71_000 + i, 30.0 if i % 2 else None) for i in range(18)])
    assert breakup.launch_breakups(unmeasured).count() == 0  # nine of the eighteen have a plane


def test_rows_without_a_designator_are_no_launch(spark):
    blank = spark.createDataFrame(
        [(i, "", f"DEB {i}", "DEB", 74.0, 610.0, 655.0) for i in range(3000, 3040)], SATCAT)
    assert breakup.launch_breakups(blank).count() == 0


def test_delta_needs_three_new_fragments(spark):
    cat = cohort(spark, [(71_000 + i, 64.9) for i in range(33)])
    new = lambda *ids: spark.createDataFrame([(i,) for i in ids], ["norad_id"])
    assert breakup.breakups_from_delta(new(1, 71_004, 71_030), cat).count() == 0
    assert breakup.breakups_from_delta(new(71_004, 71_030, 71_031), cat).first()["n_fragments"] == 33


def test_labelled_launches(spark):
    cat = cohort(spark, [(71_000 + i, 64.9) for i in range(33)]).union(
        cohort(spark, [], parent=(7, "PAY"), prefix="2032-150"))
    labels = spark.createDataFrame([("broken", "positive", 1), ("whole", "control", 7),
                                    ("unknown", "positive", 404)], ["key", "expected", "norad_id"])
    got = {r["key"]: (r["found"], r["passed"], r["launch_prefix"])
           for r in breakup.evaluate_labelled_events(labels, cat).collect()}
    assert got == {"broken": (True, True, "2031-044"), "whole": (False, True, "2032-150"),
                   "unknown": (False, False, None)}


def test_snapshot_delta(spark, day):
    rows = [(day(0), 1), (day(0), 2), (day(1), 2), (day(1), 3)]
    snaps = spark.createDataFrame(rows, ["snapshot_at", "norad_id"])
    assert [r[0] for r in catalog.snapshot_delta(snaps).collect()] == [3]
    assert catalog.snapshot_delta(snaps.where(F.col("snapshot_at") == F.lit(day(0)))).count() == 0


# ---------------------------------------------------------------- decay
def predict(spark, day, values, step=5):
    rows = [(1, day(i * step), float(v)) for i, v in enumerate(values)]
    return decay.predict_decay(spark.createDataFrame(
        rows, ["norad_id", "epoch", "perigee_km"]), slice_days=20).collect()


def test_decay_outcomes(spark, day):
    linear = predict(spark, day, [610 - 3 * i for i in range(13)])[0]
    assert linear["model"] == "linear" and linear["decay_rate"] == pytest.approx(0.6)
    assert linear["days_to_reentry"] == pytest.approx((574 - 100) / 0.6)
    fast = predict(spark, day, [350 - 15 * (1.12 ** i - 1) for i in range(18)])[0]
    assert fast["model"] == "exponential-atmosphere" and fast["accelerating"]
    assert fast["days_to_reentry"] < fast["linear_days"]
    assert 20 <= fast["scale_height_km"] <= 90
    high = predict(spark, day, [2100 - 4 * i for i in range(9)])[0]
    assert high["outcome"] == "too_high" and high["reentry_at"] is None
    flat = predict(spark, day, [655.5] * 7)[0]
    assert flat["outcome"] == "stable" and flat["fit_r2"] == 0
    low = predict(spark, day, [99 + 2 * (7 - i) for i in range(8)])[0]
    assert low["outcome"] == "imminent" and low["days_to_reentry"] == 0
    assert predict(spark, day, [300, 250, 200, 150, 110]) == []


# ---------------------------------------------------------------- proximity
def samples(spark, day, close, n=40, range_km=40.0, speed=0.001):
    rows = [(1, 2, day(i / 4), range_km if i in close else 5000.0, speed) for i in range(n)]
    return spark.createDataFrame(rows, ["actor", "target", "t", "range_km", "speed_kms"])


@pytest.mark.parametrize("close, speed, label, episodes, days", [
    ([], .001, "none", 0, 0.0), ([5], 2.0, "none", 0, 0.0), ([5], .001, "possible", 1, 0.0),
    (range(10, 30), .001, "likely", 1, 19 / 4),
    ([3, 4, 5, 6, 20, 21, 22, 23], .001, "possible", 2, 1.5)])
def test_episodes(spark, day, close, speed, label, episodes, days):
    row = proximity.rpo_summary(samples(spark, day, set(close), speed=speed), slice_days=1).first()
    assert (row["label"], row["n_episodes"]) == (label, episodes)
    assert row["total_close_days"] == pytest.approx(days)


def test_too_few_samples(spark, day):
    assert proximity.rpo_summary(samples(spark, day, {1}, n=19)).count() == 0


def test_runs_span_holes_unless_asked(spark, day):
    df = samples(spark, day, set(range(0, 30)), n=30).where(
        (F.col("t") < F.lit(day(2))) | (F.col("t") > F.lit(day(6))))
    assert proximity.proximity_episodes(df).count() == 1
    assert proximity.proximity_episodes(df, max_hole_days=1.0).count() == 2


def test_lineage_is_tri_state(spark):
    cat = spark.createDataFrame([(1, "2033-008A"), (2, "2033-008QB"), (3, "2033-009A"), (4, "")],
                                ["norad_id", "intl_desig"])
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (1, 9)], ["actor", "target"])
    got = {r["target"]: r["same_launch_lineage"]
           for r in proximity.same_launch_lineage(pairs, cat).collect()}
    assert got == {2: True, 3: False, 4: None, 9: None}


def edges(spark, day, rows):
    return spark.createDataFrame(
        [(a, t, label, day(s), day(s + 5)) for a, t, label, s in rows],
        ["actor", "target", "label", "start_at", "end_at"])


def test_serial_inspectors(spark, day):
    e = edges(spark, day, [
        (1, 10, "likely", 0), (1, 10, "likely", 30), (2, 10, "likely", 0), (2, 11, "possible", 9),
        (3, 3, "likely", 0), (3, 12, "likely", 0), (4, 10, "none", 0), (4, 11, "none", 0),
        *[(5, k, "likely", 0) for k in range(20, 25)]])
    assets = spark.createDataFrame([(10,), (11,)], ["norad_id"])
    rows = proximity.serial_inspectors(e, assets).collect()
    assert [(r["actor"], r["distinct_targets"], r["asset_targets"], r["confidence"])
            for r in rows] == [(2, 2, 2, "medium"), (5, 5, 0, "high")]
    nodes = {r["norad_id"]: r["is_asset"] for r in proximity.interaction_nodes(
        proximity.interaction_edges(e), assets).collect()}
    assert nodes[10] and not nodes[5] and 4 not in nodes


def test_edges_in_window(spark, day):
    e = edges(spark, day, [(1, 2, "likely", 0), (1, 3, "likely", 150)])
    got = proximity.edges_in_window(e, day(5), day(30)).collect()
    assert [r["target"] for r in got] == [2]


def test_known_targets(spark, day):
    events = spark.createDataFrame(
        [("b", "rpo", [1, 5], [7, 8]), ("a", "rpo", [1], [9, 8]), ("c", "routine", [2], [8])],
        ["key", "event_type", "actor_norad", "target_norad"])
    held = spark.createDataFrame([(8,), (7,)], ["norad_id"])
    got = {r["actor"]: r["target"] for r in proximity.known_targets(events, held).collect()}
    assert got == {1: 8, 5: 7}


# ---------------------------------------------------------------- anomaly
def population(spark, n=60):
    rows = [(i, 500.0 + i % 7, 490.0 + i % 5, 71.0 + (i % 4) * .1, 94.5 + (i % 3) * .1) for i in range(n)]
    rows.append((999, 520.0, 495.0, 140.0, 94.6))
    return spark.createDataFrame(
        rows, ["norad_id", "apogee_km", "perigee_km", "inclination", "period_min"])


def test_outlier_ranks_first_for_any_partitioning(spark):
    results = []
    for parts in (1, 6):
        df = population(spark).repartition(parts)
        model = anomaly.fit_anomaly_model(df, trees=50)
        top = model.top_anomalies(df, 5).collect()
        assert top[0]["norad_id"] == 999 and top[0]["top_feature"] == "inclination"
        assert top[0]["score"] == 1.0 and top[0]["is_outlier"]
        results.append([(r["norad_id"], round(r["score"], 9)) for r in top])
    assert results[0] == results[1]
    newcomers = spark.createDataFrame([(5000, 505.0, 495.0, 139.0, 94.5),
                                       (5001, 503.0, 492.0, 71.1, 94.6)], df.columns)
    odd, usual = [r["score"] for r in model.scores(newcomers).orderBy("norad_id").collect()]
    assert odd > usual + 0.2


def test_thresholds_between_neighbouring_doubles(spark):
    """A threshold that is rounded to the highest value leaves one side without rows, as in the SQL."""
    from orbitframe import constants as K
    from orbitframe.plans.orbit_queries import _FOREST

    rows = [(i, 1.0 + (i * 7 % 300) * 2.0 ** -52, float(i % 3), 0.0, 0.0, 0.0) for i in range(700)]
    scaled = spark.createDataFrame(rows, ["norad_id", *anomaly._X])
    nodes = anomaly._tree_samples(scaled, len(rows), K.FOREST_TREES, K.FOREST_SAMPLE, 42).groupBy(
        "tree").applyInPandas(anomaly._grow_tree, anomaly._NODES).toPandas()
    assert (nodes["size"] == 0).any()
    leaves = nodes[nodes["feature"] < 0].groupby("tree")["size"].sum()
    assert len(leaves) == K.FOREST_TREES and (leaves == K.FOREST_SAMPLE).all()
    raw = anomaly._forest_score(nodes, K.FOREST_SAMPLE)(F.struct(*anomaly._X))
    got = {r["norad_id"]: r["raw"] for r in scaled.select("norad_id", raw.alias("raw")).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE z (norad_id BIGINT, xs DOUBLE[])")
    con.executemany("INSERT INTO z VALUES (?, ?)", [(i, list(xs)) for i, *xs in rows])
    want = con.execute(f"WITH {_FOREST[_FOREST.index('hands AS'):]} SELECT norad_id, raw FROM raw").fetchall()
    assert got == pytest.approx(dict(want), rel=1e-12)


def test_small_population_is_refused(spark):
    with pytest.raises(ValueError):
        anomaly.fit_anomaly_model(population(spark, 10))


def test_a_watch_cycle_reads_each_table_twice_at_most(spark, tmp_path):
    """What several steps read is landed, so the plans stay small."""
    from orbitframe import schemas
    from orbitframe.operators import watch

    tables = {"before": schemas.OBJECT_STATE, "now": schemas.OBJECT_STATE, "list": schemas.WATCH_LIST,
              "snapshots": schemas.SNAPSHOTS, "satcat": schemas.SATCAT}
    read = {}
    for name, schema in tables.items():
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / name))
        read[name] = spark.read.parquet(str(tmp_path / name))
    cycle = watch.watch_cycle(read["before"], read["now"], read["list"], read["snapshots"],
                              read["satcat"], 1, "2024-01-01")
    for part in ("findings", "cycle", "states"):
        plan = cycle[part]._jdf.queryExecution().executedPlan().toString()
        assert all(plan.count(f"{tmp_path}/{name}]") <= 2 for name in tables)
        assert plan.count("FileScan") <= (5 if part == "states" else 1)
    delta = catalog.snapshot_delta(read["snapshots"])._jdf.queryExecution().executedPlan().toString()
    assert delta.count("FileScan") == 2
