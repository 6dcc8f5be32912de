"""Screening, closest approach and probability."""

import math
import random
from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitframe import constants as K
from orbitframe.operators import conjunction as cj, score

ELEMENTS = ("norad_id long, epoch timestamp, incl_deg double, raan_deg double, ecc double, "
            "argp_deg double, mean_anom_deg double, revs_per_day double")
BANDS = ["norad_id", "perigee_km", "apogee_km", "incl_deg", "raan_deg"]


def bands(spark, rows):
    return spark.createDataFrame([tuple([i, *map(float, r)]) for i, *r in rows], BANDS)


def test_altitude_bands(spark):
    df = bands(spark, [(1, 400, 400, 0, 0), (2, 35786, 35786, 0, 0)])
    assert cj.altitude_overlap_pairs(df).count() == 0
    df = bands(spark, [(2, 450, 550, 0, 0), (1, 400, 500, 0, 0), (3, 650, 700, 0, 0)])
    assert sorted(map(tuple, cj.altitude_overlap_pairs(df).collect())) == [(1, 2), (2, 3)]


def test_plane_angle(spark):
    df = bands(spark, [(1, 500, 510, 98, 0), (2, 505, 515, 98, 0), (3, 500, 505, 98, 90)])
    rows = cj.screened_pairs(df).collect()
    assert [(r["norad_a"], r["norad_b"]) for r in rows] == [(1, 2)]
    assert rows[0]["plane_angle_deg"] < 1e-5 and rows[0]["altitude_overlap_km"] == 5


def test_dense_shell_with_small_tasks(spark):
    df = bands(spark, [(k, 35786, 35786, .01 * k, .1 * k) for k in range(600)])
    whole = cj.screened_pairs(df)
    cut = cj.screened_pairs(df, pairs_per_task=2_000)
    assert whole.count() == cut.count() == 600 * 599 // 2
    summary = cj.screening_summary(df).first()
    assert (summary["n_objects"], summary["n_candidates"]) == (600, 600 * 599 // 2)


@pytest.mark.parametrize("angle", [0.25, 2.0, 5.0])
def test_the_grid_of_normals_loses_no_pair(spark, angle):
    rng = random.Random(int(angle * 4))
    rows = [(k, 500 + rng.random() * 40, 560, rng.choice([0, 1, 53, 90, 179, rng.uniform(0, 180)]) + rng.random(),
             rng.choice([0, 10, rng.uniform(0, 360)]) + rng.random() * 4) for k in range(500)]
    near = sorted((r["norad_a"], r["norad_b"]) for r in cj.screened_pairs(
        bands(spark, rows), max_angle_deg=angle, pairs_per_task=5_000).collect())
    wide = cj.screened_pairs(bands(spark, rows), max_angle_deg=30).where(F.col("plane_angle_deg") <= angle)
    assert near == sorted((r["norad_a"], r["norad_b"]) for r in wide.collect()) and len(near) > 20
    best = [tuple(r) for r in cj.screen_conjunctions(bands(spark, rows), 300).collect()]
    assert best == [tuple(r) for r in cj.screened_pairs(bands(spark, rows)).orderBy(
        "plane_angle_deg", "norad_a", "norad_b").limit(300).collect()]


def encounter(spark, day):
    """Two circular orbits of one radius that meet at the node half a day in;
    each has a set half a day before and half a day after."""
    revs = 14.0
    rate = revs * 2 * math.pi / 86400
    k = 1.5 * K.J2 * (K.R_EARTH_KM / (K.MU_KM3_S2 / rate**2) ** (1 / 3))**2 * rate
    rows = []
    for norad_id, incl in ((1, 60.0), (2, 30.0)):
        ci, si = math.cos(math.radians(incl)), math.sin(math.radians(incl))
        for shift, ahead in ((0, 43200), (1, -43200)):
            rows.append((norad_id, day(shift), incl, math.degrees(k * ci * ahead) % 360, 0.0,
                         -math.degrees(k * (2 - 2.5 * si * si) * ahead) % 360,
                         -math.degrees(rate * ahead) % 360, revs))
    return spark.createDataFrame(rows, ELEMENTS)


def test_closest_approach_is_refined_to_a_second(spark, day):
    pairs = spark.createDataFrame([(1, 2)], ["actor", "target"])
    row = cj.closest_approach(pairs, encounter(spark, day)).first()
    assert row["min_range_km"] < 1.0
    half_period = 86400 / 14 / 2
    off = (row["tca"] - day(0.5).replace(tzinfo=None)).total_seconds()
    assert abs(off / half_period - round(off / half_period)) * half_period < 30


def test_probability_against_closed_form(spark, day):
    pairs = spark.createDataFrame([(1, 2)], ["actor", "target"])
    history = encounter(spark, day)
    cat = spark.createDataFrame([(1, None), (2, 5e5)], "norad_id long, rcs_m2 double")
    approach = cj.closest_approach(pairs, history)
    row = cj.collision_probability(pairs, history, cat, n_samples=50_000).first()
    radius = 0.005 + math.sqrt(5e5 / math.pi) / 1000
    assert row["hard_body_radius_km"] == pytest.approx(radius)
    s = cj.encounter_states(approach, history).first()
    basis = lambda p: ric([s[f"{p}r{c}"] for c in "xyz"], [s[f"{p}v{c}"] for c in "xyz"])
    total = np.zeros((3, 3))
    for who in "ab":
        m = basis(f"{who}_")
        sigma = np.diag([row[f"sigma_{who}_{x}_km"]**2 for x in "ric"])
        total += m.T @ sigma @ m
    mean = np.array([s[f"a_r{c}"] - s[f"b_r{c}"] for c in "xyz"])
    inverse, det = np.linalg.inv(total), np.linalg.det(total)
    axis = np.linspace(-radius, radius, 61)
    grid = np.stack(np.meshgrid(axis, axis, axis), -1).reshape(-1, 3)
    inside = grid[(grid**2).sum(1) < radius**2] - mean
    density = np.exp(-.5 * np.einsum("ij,jk,ik->i", inside, inverse, inside))
    want = density.sum() * (axis[1] - axis[0])**3 / math.sqrt((2 * math.pi)**3 * det)
    assert row["pc_estimate"] == pytest.approx(want, rel=0.02)
    assert row["pc_sampled"] == pytest.approx(want, rel=0.05)


def test_probability_over_many_decades(spark):
    """Quadrature against importance sampling, from near certainty to the smallest doubles."""
    rows = []
    for k in range(40):
        off = 0.02 * k * k
        rows.append((k, 1000 + k, off * 1.2, 7000.0, 1.0, 2.0, 0.1, 7.5, 0.2, 7000.0 + off,
                     1.0 - 0.6 * off, 2.0 + 0.3 * off, 0.2, 7.3, 1.9, 0.5 * (k % 3), 1.0 * (k % 2)))
    columns = ("actor long, target long, min_range_km double, a_rx double, a_ry double, a_rz double, "
               "a_vx double, a_vy double, a_vz double, b_rx double, b_ry double, b_rz double, "
               "b_vx double, b_vy double, b_vz double, age_a_days double, age_b_days double")
    met = spark.createDataFrame(rows, columns).withColumn("tca", F.lit("2024-01-01").cast("timestamp"))
    cat = spark.createDataFrame([(k, 10.0 ** (k % 6)) for k in range(40)], "norad_id long, rcs_m2 double")
    got = cj.pair_probability(met, cat, n_samples=20_000).collect()
    decades = set()
    for r in got:
        if r["pc_sampled"] > 1e-290:
            assert math.log10(r["pc_estimate"]) == pytest.approx(math.log10(r["pc_sampled"]), abs=0.02)
            decades.add(round(math.log10(r["pc_estimate"])))
    assert len(decades) > 10 and min(decades) < -100
    assert any(r["pc_estimate"] == 0 for r in got)
    one = met.where("actor = 0").withColumn("age_a_days", F.lit(None).cast("double"))
    assert cj.pair_probability(one, cat).first()["pc_estimate"] is None


def test_the_centre_of_a_regrid_moves(spark, day):
    """Points count within the span of the best one so far, as far as a chain of them leads."""
    pairs = spark.createDataFrame([(1, 2)], ["actor", "target"])
    history = encounter(spark, day)
    far = cj.closest_approach(pairs, history).first()
    start = spark.createDataFrame([(1, 2, far["tca"] - timedelta(seconds=900), 9e9)],
                                  "actor long, target long, tca timestamp, min_range_km double")
    for who, norad_id in (("a", 1), ("b", 2)):
        held = history.where((F.col("norad_id") == norad_id)).orderBy("epoch").limit(1)
        start = start.join(held.select(F.struct(*[c for c in held.columns if c != "norad_id"]).alias(who)))
    still = cj._refine(start, 600.0, 600.0).first()
    # from 1500 s before it on, steps of 600 s, each within the span of the one before
    assert abs((still["tca"] - far["tca"]).total_seconds()) <= 300


def ric(r, v):
    r, v = np.array(r), np.array(v)
    h = np.cross(r, v)
    big_r, big_c = r / np.linalg.norm(r), h / np.linalg.norm(h)
    return np.vstack([big_r, np.cross(big_c, big_r), big_c])


def test_nearest_asset_equals_brute_force(spark, day):
    rng = random.Random(9)
    make = lambda k, revs: (k, day(rng.random()), rng.uniform(0, 100), rng.uniform(0, 360),
                            rng.uniform(0, .01), rng.uniform(0, 360), rng.uniform(0, 360), revs)
    rows = [make(k, rng.choice([15.2, 14.2, 2.0, 1.0027])) for k in range(60)]
    objects = spark.createDataFrame(rows, ELEMENTS)
    assets = objects.where("norad_id < 25").withColumn("name", F.concat(
        F.lit("A"), F.col("norad_id").cast("string")))
    got = {r["norad_id"]: r for r in score.proximity_to_assets(
        objects, assets, day(2), rows_per_task=7).collect()}
    from orbitframe.operators.trajectory import with_states
    for o in rows:
        own = with_states(spark.createDataFrame([o], ELEMENTS), "epoch").first()
        if o[0] > 12:
            continue
        them = with_states(assets.withColumn("t", F.lit(o[1])), "t").collect()
        gaps = [(math.dist([own[f"r{c}"] for c in "xyz"], [a[f"r{c}"] for c in "xyz"]),
                 a["norad_id"]) for a in them if a["norad_id"] != o[0]]
        near, who = min(g for g in gaps if g[0] >= 2)
        row = got[o[0]]
        assert row["nearest_km"] == pytest.approx(near)
        assert (row["asset_id"], row["asset_name"]) == (who, f"A{who}")
        assert row["proximity_to_hva"] == pytest.approx(min(1, max(0, 1 - (near - 50) / 4950)))


def test_nearest_asset_far_out(spark, day):
    """Assets in high orbit only: the search ends in the last round."""
    rows = [(1, day(0), 10.0, 0.0, 0.0, 0.0, 0.0, 15.0), (2, day(0), 1.0, 0.0, 0.0, 0.0, 90.0, 1.0027),
            (3, day(0), 1.0, 0.0, 0.0, 0.0, 180.0, 1.0027), (4, day(0), 1.0, 0.0, 0.9, 0.0, 180.0, 0.01)]
    objects = spark.createDataFrame(rows, ELEMENTS)
    assets = objects.where("norad_id > 1").withColumn("name", F.lit("far"))
    got = {r["norad_id"]: r for r in score.proximity_to_assets(objects, assets, day(1)).collect()}
    assert got[1]["asset_id"] == 2 and 40_000 < got[1]["nearest_km"] < 43_000
    assert got[1]["proximity_to_hva"] == 0 and got[2]["asset_id"] == 3
    assert got[4]["nearest_km"] > 500_000
    why = {f["name"]: f["explanation"] for f in score.threat_scores(
        objects, *spark_tables(spark), score.proximity_to_assets(objects, assets, day(1))).select(
            score.factor_list(nearest=True).alias("f")).first()["f"]}
    assert "from far, the nearest" in why["proximity_to_hva"]


def spark_tables(spark):
    """Empty inputs of the score besides the nearest assets."""
    none = lambda columns: spark.createDataFrame([], columns)
    return (none("norad_id long"), none("norad_id long, dv_ms double"),
            none("norad_id long, label string"),
            none("norad_id long, primary string, special_tags array<string>"),
            none("norad_id long, country string, object_type string"))


def test_stale_sets_and_missing_assets_give_null(spark, day):
    row = (1, day(0), 10.0, 0.0, 0.0, 0.0, 0.0, 15.0)
    objects = spark.createDataFrame([row], ELEMENTS)
    assets = spark.createDataFrame([(2, *row[1:])], ELEMENTS).withColumn("name", F.lit("A"))
    value = lambda a, at: score.proximity_to_assets(objects, a, at).first()["proximity_to_hva"]
    assert value(assets, day(31)) is None
    assert value(assets.limit(0), day(1)) is None
    # the only asset is the same structure
    assert value(assets, day(1)) is None


def test_quadrature_runs_once_for_a_batch_of_rows(spark):
    """No node is interpreted row by row, and facts and messages read one column."""
    from orbitframe.operators import verify
    met = spark.range(2).selectExpr(
        "id AS actor", "id + 1 AS target", "timestamp'2024-01-01' AS tca", "1D AS min_range_km", "7000D AS a_rx",
        "1D AS a_ry", "2D AS a_rz", "0.1D AS a_vx", "7.5D AS a_vy", "0.2D AS a_vz", "7000.5D AS b_rx", "1D AS b_ry",
        "2D AS b_rz", "0.2D AS b_vx", "7.3D AS b_vy", "1.9D AS b_vz", "0D AS age_a_days", "1D AS age_b_days")
    cat = spark.createDataFrame([(0, 1.0)], "norad_id long, rcs_m2 double")
    facts = verify.facts_from_probability(cj.pair_probability(met, cat))
    plan = facts._jdf.queryExecution().executedPlan().toString()
    assert "lambdafunction" not in plan and plan.count("ArrowEvalPython") == 1
    assert facts.where("key = 'pc_estimate'").count() == 2


def test_grid_points_are_never_shuffled(spark, day):
    """Points become rows after the last exchange; a local grid needs none. Repeated pairs stay so."""
    from orbitframe.operators import trajectory as tr
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    pairs = spark.createDataFrame([(1, 2), (1, 2)], ["actor", "target"])
    aligned = tr.aligned_pairs(pairs, encounter(spark, day), 1.0)
    text = plan(aligned)
    assert "explode(sequence(_from" in text and text.index("explode(sequence(_from") < text.index("Exchange")
    assert aligned.count() == 50 and aligned.select("t").distinct().count() == 25
    best = spark.sql("""SELECT 1L AS actor, 2L AS target, timestamp'2024-01-01' AS tca, 9D AS min_range_km, s AS a,
        s AS b FROM (SELECT struct(timestamp'2024-01-01' AS epoch, 1D AS incl_deg, 1D AS raan_deg, 0D AS ecc,
        0D AS argp_deg, 0D AS mean_anom_deg, 14D AS revs_per_day) AS s)""")
    refined = cj._refine(best, 600.0, 3600.0)
    assert "Exchange" not in plan(refined) and refined.first()["min_range_km"] == 0


def test_rows_of_the_sieve_grow_with_the_input_only(spark, monkeypatch):
    """However many pairs a bucket holds, a row comes at most SPLITS times."""
    from orbitframe.operators import rangejoin
    monkeypatch.setattr(rangejoin, "SPLITS", 3)
    df = spark.range(60).selectExpr("id", "double(id) AS lo", "id + 90D AS hi")
    got = rangejoin.overlap_self_join(df, "id", "lo", "hi", [], 100.0, pairs_per_task=1)
    assert got.count() == 60 * 59 // 2
    assert "least(3," in got._jdf.queryExecution().optimizedPlan().toString()


def test_nearest_asset_sorts_no_pairs(spark, day):
    """Of assets equally near the smallest id is named; a repeated object keeps both its rows."""
    rows = [(1, day(0), 10.0, 0.0, 0.0, 0.0, 0.0, 15.0)] * 2 + [
        (k, day(0), 10.0, 0.0, 0.0, 0.0, 1.0, 15.0) for k in (9, 7, 8)]
    objects = spark.createDataFrame(rows, ELEMENTS)
    assets = objects.where("norad_id > 1").withColumn("name", F.lit("twin"))
    got = score.proximity_to_assets(objects, assets, day(1)).where("norad_id = 1").collect()
    assert [r["asset_id"] for r in got] == [7, 7]
    pool = spark.sql("SELECT 2L AS asset_id, 'x' AS asset_name, 1D AS _low, 9D AS _high").crossJoin(
        objects.limit(1).select(*[F.col(c).alias(f"el_{c}") for c in objects.columns[1:]]))
    base = objects.selectExpr("norad_id", "epoch AS t", "7000D AS rx", "0D AS ry", "0D AS rz", "7000D AS _radius")
    load = base.selectExpr("7000L AS _at", "1L AS _n")
    met = score._meet(base.selectExpr("*", "CAST(NULL AS double) AS _near"), pool, load, 0, None, 9)
    plan = met.groupBy("norad_id").agg(F.min("_gap"))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_checksum_of_a_line_is_plain_arithmetic(spark):
    from orbitframe.sources import sinks
    line = spark.createDataFrame([("1 25544U-98067A  -.5",), ("",), (None,)], "line string")
    got = line.select(sinks._with_checksum(F.col("line")).alias("c"))
    assert [r["c"] for r in got.collect()] == ["1 25544U-98067A  -.58", "0", None]
    assert "lambdafunction" not in got._jdf.queryExecution().executedPlan().toString()
