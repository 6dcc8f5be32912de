"""Ladders on hand-made orbits."""

import math

import pytest
from pyspark.sql import functions as F

from orbitframe import constants as K
from orbitframe.functions import orbits
from orbitframe.operators import elements as el

GEO = K.GEO_ALTITUDE_KM
COLUMNS = ["name", "perigee_km", "apogee_km", "incl_deg"]


def shaped(spark, rows):
    """Orbits from altitudes, with the derived element columns."""
    df = spark.createDataFrame([(n, float(p), float(a), float(i)) for n, p, a, i in rows], COLUMNS)
    sma = F.col("semi_major_km")
    return (
        df.withColumn("norad_id", F.monotonically_increasing_id())
        .withColumn("semi_major_km", (F.col("perigee_km") + F.col("apogee_km")) / 2 + K.R_EARTH_KM)
        .withColumns({"ecc": (F.col("apogee_km") - F.col("perigee_km")) / 2 / sma,
                      "period_min": 2 * math.pi * F.sqrt(sma * sma * sma / K.MU_KM3_S2) / 60}))


def by_name(df, column):
    return {r["name"]: r[column] for r in df.collect()}


def test_regime_ladder(spark):
    rows = [("leo", 400, 420, 51.6), ("meo", 20180, 20200, 55), ("geo", GEO - 5, GEO + 5, .05),
            ("graveyard", GEO + 300, GEO + 320, 5), ("decaying", 120, 160, 50),
            ("gto", 250, GEO, 7), ("molniya", 600, 39750, 63.4), ("tundra", 24000, 47572, 63.4),
            ("eccentric", 300, 60000, 45), ("other", 1000, 9000, 30)]
    got = by_name(el.classify_regime(shaped(spark, rows)), "primary")
    assert got == {"leo": "LEO", "meo": "MEO", "geo": "GEO", "graveyard": "GRAVEYARD",
                   "decaying": "DECAYING", "gto": "GTO", "molniya": "HEO", "tundra": "HEO",
                   "eccentric": "HEO", "other": "OTHER"}


def test_special_tags(spark):
    rows = [("sso", 795, 805, 98.6), ("same_altitude", 795, 805, 45), ("molniya", 600, 39750, 63.4),
            ("tundra", 24000, 47572, 63.4), ("retro", 900, 905, 120), ("polar", 900, 905, 90),
            ("equator", 900, 905, 2)]
    got = by_name(el.special_orbit_tags(shaped(spark, rows)), "special_tags")
    assert got["sso"] == ["SSO", "POLAR"] and got["same_altitude"] == []
    assert got["molniya"] == ["MOLNIYA"] and got["tundra"] == ["TUNDRA"]
    assert got["retro"] == ["RETROGRADE"] and got["polar"] == ["POLAR"]
    assert got["equator"] == ["EQUATORIAL"]


def test_sso_inclination_limits(spark):
    df = spark.createDataFrame([(7178.0, 0.0), (42164.0, 0.0)], ["a", "e"])
    low, high = [r[0] for r in df.select(
        orbits.required_sso_inclination(F.col("a"), F.col("e"))).collect()]
    assert 98 < low < 99 and high is None


@pytest.mark.parametrize("perigee, apogee, incl, status, compliant", [
    (GEO + 295, GEO + 300, 5, "COMPLIANT_GRAVEYARD", True),
    (GEO - 5, GEO + 5, .1, "OPERATIONAL_OR_ABANDONED_IN_PLACE", None),
    (GEO + 120, GEO + 140, 5, "NON_COMPLIANT_SHALLOW", False),
    (GEO - 5, GEO + 5, 45, "INCLINED_GEOSYNCHRONOUS", None),
    (GEO - 1000, GEO - 900, 5, "BELOW_GEO_DRIFT", False),
    (400, 420, 51, "NOT_GEO_BELT", None)])
def test_disposal(spark, perigee, apogee, incl, status, compliant):
    row = el.assess_disposal(el.classify_regime(shaped(
        spark, [("x", perigee, apogee, incl)]))).first()
    assert (row["disposal_status"], row["compliant"]) == (status, compliant)


def test_small_rules(spark):
    df = spark.createDataFrame([(None, 0.0, 0.035), (0.0, 30.0, 2.5), (1.4, -5.0, None),
                                (399.0, 1.0, 1.0)], "rcs double, age double, km double")
    rows = df.select(
        orbits.hard_body_radius_km(F.col("rcs")), orbits.modelled_sigma_km(F.col("age"), "i"),
        orbits.format_range(F.col("km"))).collect()
    assert [r[0] for r in rows[:2]] == [0.005, 0.005] and rows[2][0] == 0.001
    assert rows[3][0] == pytest.approx(math.sqrt(399 / math.pi) / 1000)
    assert [r[1] for r in rows] == pytest.approx([0.2, 4.7, 0.2, 0.35])
    assert [r[2] for r in rows] == ["35 m", "2.5 km", "n/a", "1.0 km"]


def test_mean_elements_of_a_published_orbit(spark):
    row = el.mean_elements(spark.createDataFrame(
        [(1, 15.5, 0.0005, 51.64)], ["norad_id", "revs_per_day", "ecc", "incl_deg"])).first()
    assert 400 < row["perigee_km"] < row["apogee_km"] < 430
    assert row["period_min"] == pytest.approx(1440 / 15.5) and row["regime"] == "LEO"
