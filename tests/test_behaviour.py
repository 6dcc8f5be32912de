"""From synthetic element histories to manoeuvres, campaigns and shifts."""

import math
import random

import pytest

from orbitframe import constants as K
from orbitframe.operators import behaviour, maneuver, score

ELEMENTS = ("norad_id long, epoch timestamp, incl_deg double, raan_deg double, ecc double, "
            "argp_deg double, mean_anom_deg double, revs_per_day double")


def history(spark, day, n=15, burns=(), seed=1, jitter=1e-6, norad_id=1):
    """Daily sets advanced by their own secular rates; ``burns`` maps index to
    an in-track speed change in km/s."""
    rng = random.Random(seed)
    burns = dict(burns)
    a0, e, incl = 6778.0, 0.0005, 51.6
    mean, node, peri, rows = 10.0, 40.0, 30.0, []
    n0 = math.sqrt(K.MU_KM3_S2 / a0**3)
    for i in range(n):
        if i in burns:
            speed = math.sqrt(K.MU_KM3_S2 / a0)
            a0 = a0 + 2 * a0 * burns[i] / speed
            n0 = math.sqrt(K.MU_KM3_S2 / a0**3)
        noisy = n0 * (1 + rng.gauss(0, jitter))
        rows.append((norad_id, day(i), incl, node % 360, e, peri % 360, mean % 360,
                     noisy * 86400 / (2 * math.pi)))
        k = 1.5 * K.J2 * (K.R_EARTH_KM / (a0 * (1 - e * e)))**2 * n0
        ci, si = math.cos(math.radians(incl)), math.sin(math.radians(incl))
        node -= math.degrees(k * ci * 86400)
        peri += math.degrees(k * (2 - 2.5 * si * si) * 86400)
        mean += math.degrees(n0 * 86400)
    return spark.createDataFrame(rows, ELEMENTS)


def events(spark, day, rows):
    return spark.createDataFrame([(1, day(t), float(v)) for t, v in rows],
                                 ["norad_id", "epoch", "dv_ms"])


def detect(df):
    return maneuver.detect_maneuvers(maneuver.pair_residuals(df))


def test_quiet_history(spark, day):
    residuals = maneuver.pair_residuals(history(spark, day))
    assert residuals.count() == 14 and maneuver.noise_floor(residuals).count() == 1
    assert maneuver.detect_maneuvers(residuals).count() == 0


def test_single_burn(spark, day):
    rows = detect(history(spark, day, burns={8: 0.010})).collect()
    assert [r["epoch"] for r in rows] == [day(8).replace(tzinfo=None)]
    assert rows[0]["zscore"] > 5 and rows[0]["confidence"] == "high"


def test_thin_history(spark, day):
    residuals = maneuver.pair_residuals(history(spark, day, n=4))
    assert maneuver.noise_floor(residuals).count() == 0
    assert maneuver.detect_maneuvers(residuals).count() == 0


def test_routine_and_outsized_burns(spark, day):
    burns = {5: .010, 10: .011, 15: .0095, 20: .0105}
    camps = behaviour.campaigns(detect(history(spark, day, 25, burns)))
    labels = [r["label"] for r in behaviour.classify_campaigns(camps).collect()]
    assert labels == ["routine"] * 4
    burns[15] = .080
    marked = behaviour.classify_campaigns(behaviour.campaigns(
        detect(history(spark, day, 25, burns)))).orderBy("start_epoch")
    rows = marked.collect()
    assert [r["label"] for r in rows] == ["routine", "routine", "anomalous", "routine"]
    assert rows[2]["dv_z"] >= 3 and len(rows[2]["reasons"]) == 1
    assert score.anomalous_rate(marked).first()["anomalous_rate"] == 0.25


def test_campaigns_join_at_exactly_one_day(spark, day):
    rows = behaviour.campaigns(events(spark, day, [
        (0, 3), (1, 5), (2, 5), (3.1, 1), (9, 2)])).orderBy("start_epoch").collect()
    assert [(r["n_pulses"], r["peak_dv_ms"]) for r in rows] == [(3, 5), (1, 1), (1, 2)]
    assert rows[0]["peak_epoch"] == day(1).replace(tzinfo=None)


def test_no_baseline_below_three_campaigns(spark, day):
    camps = behaviour.campaigns(events(spark, day, [(0, 3), (5, 3)]))
    assert behaviour.campaign_baseline(camps).count() == 0
    assert behaviour.classify_campaigns(camps).count() == 0


def shift(spark, day, sizes, gaps):
    times = [sum(gaps[:i]) for i in range(len(sizes))]
    return behaviour.changepoints(behaviour.campaigns(
        events(spark, day, zip(times, sizes)))).collect()


def test_change_in_size(spark, day):
    rows = shift(spark, day, [1, 1.1, .9, 1, 10, 10.2, 9.8, 10.1], [20] * 7)
    assert len(rows) == 1 and rows[0]["metric"] == "burn size"
    assert rows[0]["direction"] == "increased" and rows[0]["before_mean"] == pytest.approx(1)
    assert rows[0]["epoch"] == day(80).replace(tzinfo=None)


def test_change_in_tempo(spark, day):
    rows = shift(spark, day, [1.0] * 8, [30, 30, 30, 5, 5, 5, 5])
    assert rows[0]["metric"] == "tempo" and rows[0]["direction"] == "decreased"
    # the first short gap ends at the fifth campaign
    assert rows[0]["epoch"] == day(95).replace(tzinfo=None)


def test_no_change(spark, day):
    assert shift(spark, day, [1, 1.2, .9, 1.1, 1, 1.05, .95], [20, 21, 19, 20, 20, 21]) == []
    assert shift(spark, day, [1, 1, 9, 9], [20] * 3) == []


def test_activity_is_zero_for_a_quiet_object_and_absent_without_floor(spark):
    floors = spark.createDataFrame([(1, 1.0), (2, 1.0)], ["norad_id", "floor_ms"])
    found = spark.createDataFrame([(2, 30.0), (3, 5.0)], ["norad_id", "dv_ms"])
    got = {r[0]: r[1] for r in score.maneuver_activity(floors, found).collect()}
    assert got == {1: 0.0, 2: 1.0}


def test_gaps_beyond_the_limit_are_not_bridged(spark, day):
    df = spark.createDataFrame([(1, day(n)) for n in (0, 4, 15, 25, 25.5)], ["norad_id", "epoch"])
    got = maneuver.consecutive_pairs(df, ["epoch"]).select("epoch", "gap_days").collect()
    assert sorted(r["gap_days"] for r in got) == [0.5, 4.0, 10.0]


def test_repartitioning_does_not_change_results(spark, day):
    df = history(spark, day, 25, {5: .01, 12: .02})
    keys = lambda d: sorted((r["epoch"], round(r["zscore"], 6)) for r in detect(d).collect())
    assert keys(df.repartition(1)) == keys(df.repartition(7, "epoch"))
