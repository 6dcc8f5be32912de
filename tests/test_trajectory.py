"""Motion, frames and alignment."""

import math
import random

import pytest
from pyspark.sql import functions as F

from orbitframe import constants as K
from orbitframe.operators import trajectory as tr

ELEMENTS = ("norad_id long, epoch timestamp, incl_deg double, raan_deg double, ecc double, "
            "argp_deg double, mean_anom_deg double, revs_per_day double")


def state(spark, row, at):
    return tr.propagate_at(spark.createDataFrame([row], ELEMENTS), F.lit(at)).first()


def test_two_body_geometry(spark, day):
    row = (1, day(0), 51.6, 40.0, 0.1, 30.0, 0.0, 12.0)
    s = state(spark, row, day(0))
    r = math.sqrt(s["rx"]**2 + s["ry"]**2 + s["rz"]**2)
    a = (K.MU_KM3_S2 / (12 * 2 * math.pi / 86400)**2) ** (1 / 3)
    assert r == pytest.approx(a * 0.9)
    v = math.sqrt(s["vx"]**2 + s["vy"]**2 + s["vz"]**2)
    assert v == pytest.approx(math.sqrt(K.MU_KM3_S2 * (2 / r - 1 / a)))
    h = (s["rx"] * s["vy"] - s["ry"] * s["vx"]) / (r * v)
    assert h == pytest.approx(math.cos(math.radians(51.6)), rel=1e-6)


@pytest.mark.parametrize("ecc, mean", [(0.0, 10.0), (0.3, 200.0), (0.74, 1.0), (0.74, 359.0),
                                       (0.9, 20.0), (0.95, 120.0)])
def test_kepler_equation_is_solved(spark, day, ecc, mean):
    s = state(spark, (1, day(0), 0.0, 0.0, ecc, 0.0, mean, 0.8), day(0))
    a = (K.MU_KM3_S2 / (0.8 * 2 * math.pi / 86400)**2) ** (1 / 3)
    e_anom = math.atan2(s["ry"] / (a * math.sqrt(1 - ecc**2)), s["rx"] / a + ecc)
    back = math.degrees(e_anom - ecc * math.sin(e_anom)) % 360
    assert back == pytest.approx(mean, abs=1e-7)


def test_node_drift_is_sun_synchronous(spark, day):
    rows = tr.with_states(spark.createDataFrame(
        [(1, day(0), 98.6, 0.0, 0.001, 0.0, 0.0, 14.27)], ELEMENTS).withColumn(
        "t", F.lit(day(10))), "t").first()
    h = (rows["ry"] * rows["vz"] - rows["rz"] * rows["vy"],
         rows["rz"] * rows["vx"] - rows["rx"] * rows["vz"])
    node = math.degrees(math.atan2(h[0], -h[1]))
    assert node == pytest.approx(9.86, abs=0.2)


def test_invalid_and_buried_objects_drop_out(spark, day):
    rows = [(1, day(0), 50.0, 0.0, 1.2, 0.0, 0.0, 15.0), (2, day(0), 50.0, 0.0, 0.5, 0.0, 0.0, 15.0),
            (3, day(0), 50.0, 0.0, 0.001, 0.0, 0.0, 15.0)]
    got = tr.propagate_at(spark.createDataFrame(rows, ELEMENTS), F.lit(day(0))).collect()
    assert [r["norad_id"] for r in got] == [3]


def test_grid_has_at_least_two_points(spark, day):
    df = spark.createDataFrame([(day(0), day(1)), (day(0), day(0.001))], ["s", "e"])
    sizes = [len(r[0]) for r in df.select(
        tr.grid_times(F.col("s"), F.col("e"), 6 * 3600)).collect()]
    assert sizes == [5, 2]


def test_ric_identities(spark):
    a = dict(a_rx=7000.0, a_ry=10.0, a_rz=-30.0, a_vx=0.1, a_vy=7.5, a_vz=0.4)
    columns = [*a, "b_rx", "b_ry", "b_rz", "b_vx", "b_vy", "b_vz"]
    same = [*a.values(), *a.values()]
    # same angular rate, one kilometre further out along the radius
    k = 1 + 1 / math.sqrt(7000**2 + 10**2 + 30**2)
    outward = [*a.values(), *[v * k for v in a.values()]]
    rel = tr.ric_relative(spark.createDataFrame([same, outward], columns)).collect()
    assert rel[0]["range_km"] == 0 and rel[0]["speed_kms"] == 0
    assert rel[1]["rho_r"] == pytest.approx(1) and abs(rel[1]["rho_i"]) < 1e-9
    radial_rate = (7000 * .1 + 10 * 7.5 - 30 * .4) / (7000**2 + 100 + 900)
    assert rel[1]["vel_i"] == pytest.approx(0, abs=1e-9)
    assert rel[1]["vel_r"] == pytest.approx(radial_rate, rel=1e-6)


def test_linear_relative_motion(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, .001, .002, .003), (0.,) * 6],
                               ["x", "y", "z", "vx", "vy", "vz"])
    start = tr.cw_propagate(df, F.lit(0.0011), F.lit(0.0)).first()
    assert [start[f"cw_{c}"] for c in ("x", "y", "z", "vx", "vy", "vz")] == pytest.approx(
        [1, 2, 3, .001, .002, .003])
    still = tr.cw_propagate(df, F.lit(0.0011), F.lit(5000.0)).collect()[1]
    assert all(still[f"cw_{c}"] == 0 for c in ("x", "y", "z", "vx", "vy", "vz"))


def test_nearest_epoch_ties_and_gap(spark, day):
    history = spark.createDataFrame([(1, day(0)), (1, day(2)), (1, day(20))], ["norad_id", "epoch"])
    grid = spark.createDataFrame([(1, day(1)), (1, day(1.01)), (1, day(5)), (1, day(5.01)),
                                  (1, day(17)), (2, day(0))], ["norad_id", "t"])
    got = {(r["norad_id"], r["t"]): r["nearest"] and r["nearest"]["epoch"]
           for r in tr.nearest_epoch_join(grid, history).collect()}
    values = list(dict(sorted(got.items())).values())
    naive = lambda n: day(n).replace(tzinfo=None)
    assert values == [naive(0), naive(2), naive(2), None, naive(20), None]


def test_nearest_epoch_equals_brute_force(spark, day):
    rng = random.Random(4)
    history = sorted({(k, round(rng.uniform(0, 90), 3)) for k in range(3) for _ in range(60)})
    grid = sorted({(k, round(rng.uniform(-5, 95), 3)) for k in range(3) for _ in range(80)})
    h = spark.createDataFrame([(k, day(t)) for k, t in history], ["norad_id", "epoch"])
    g = spark.createDataFrame([(k, day(t), t) for k, t in grid], ["norad_id", "t", "x"])
    got = {(r["norad_id"], r["x"]): r["nearest"] and r["nearest"]["epoch"]
           for r in tr.nearest_epoch_join(g, h).collect()}
    assert len(got) == len(grid)
    for k, t in grid:
        near = min(((abs(e - t), e) for kk, e in history if kk == k))
        want = day(near[1]).replace(tzinfo=None) if near[0] <= 3 else None
        assert got[(k, t)] == want


def test_ground_track(spark, day):
    grid = tr.ephemeris_grid(spark.createDataFrame(
        [(1, day(0), 51.6, 0.0, 0.0005, 0.0, 0.0, 15.5)], ELEMENTS),
        F.lit(day(0)), F.lit(day(0.2)), 60.0)
    rows = tr.ground_track(grid).collect()
    assert max(abs(r["lat_deg"]) for r in rows) == pytest.approx(51.7, abs=0.5)
    assert all(-180 <= r["lon_deg"] <= 180 and 380 < r["alt_km"] < 450 for r in rows)


def test_aligned_pairs_keep_only_covered_points(spark, day):
    row = lambda k, n, m: (k, day(n), 0.05, 0.0, 0.0001, 0.0, m, 1.0027)
    rows = [row(1, n, 10.0) for n in (0, 1, 2, 12)] + [row(2, n, 10.001) for n in (0, 1, 2, 12)]
    history = spark.createDataFrame(rows, ELEMENTS)
    pairs = spark.createDataFrame([(1, 2)], ["actor", "target"])
    got = tr.pair_samples(tr.aligned_pairs(pairs, history)).collect()
    days = sorted((r["t"] - day(0).replace(tzinfo=None)).total_seconds() / 86400 for r in got)
    assert days == [i / 4 for i in range(0, 21)] + [i / 4 for i in range(36, 49)]
    assert all(r["range_km"] < 5 for r in got)
