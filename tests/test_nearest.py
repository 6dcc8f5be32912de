"""The search for the nearest asset through boxes."""

import random

import pytest
from pyspark.sql import functions as F

from orbitframe.operators import score
from orbitframe.operators.skew import even_blocks
from orbitframe.operators.trajectory import ELEMENTS, with_states

SCHEMA = ("norad_id long, epoch timestamp, incl_deg double, raan_deg double, ecc double, "
          "argp_deg double, mean_anom_deg double, revs_per_day double")


def orbits(rng, day, k, apart_days):
    return (k, day(rng.random() * apart_days), rng.uniform(0, 180), rng.uniform(0, 360),
            rng.choice([rng.uniform(0, .02), .3, .7, rng.uniform(.9, .985)]), rng.uniform(0, 360),
            rng.uniform(0, 360), rng.choice([15.2, 14.2, 2.0, 1.0027, 0.3]))


def brute_force(objects, assets):
    """All pairs in one join."""
    own = with_states(objects, "epoch").selectExpr("norad_id", "epoch AS t", "rx", "ry", "rz").where(
        "sqrt(rx * rx + ry * ry + rz * rz) >= 6378.137")
    pool = assets.select(F.col("norad_id").alias("asset_id"), F.col("name").alias("asset_name"),
                         *[F.col(c).alias(f"el_{c}") for c in ELEMENTS])
    met = score._gaps(own.join(pool, F.col("norad_id") != F.col("asset_id")))
    return {r["norad_id"]: tuple(r["b"]) for r in met.groupBy("norad_id").agg(
        F.min(F.struct("_gap", "asset_id", "asset_name")).alias("b")).collect()}


@pytest.mark.parametrize("apart_days", [0.0, 0.01, 3.0])
def test_the_search_equals_brute_force(spark, day, apart_days):
    """At one instant, within minutes and over days; eccentric, low, repeated and nameless orbits."""
    rng = random.Random(7)
    rows = [orbits(rng, day, k, apart_days) for k in range(400)]
    rows += [(1000 + k, *rows[k][1:]) for k in range(40)] + [rows[5], (None, *rows[6][1:])]
    objects = spark.createDataFrame(rows, SCHEMA)
    assets = objects.where("norad_id % 2 = 0 OR norad_id IS NULL").withColumn(
        "name", F.when(F.col("norad_id") % 5 > 0, F.concat(F.lit("A"), F.col("norad_id").cast("string"))))
    want = brute_force(objects, assets)
    got = score.proximity_to_assets(objects, assets, day(5), rows_per_task=300).collect()
    assert len(got) == len(rows) and len(want) > 350
    for r in got:
        near = want.get(r["norad_id"], (None, None, None))
        assert (r["nearest_km"], r["asset_id"], r["asset_name"]) == near


def test_the_search_leaves_about_one_pair_an_object(spark, day):
    """States of pairs are computed for the nearest ones only, not for all of a shell."""
    rng = random.Random(8)
    objects = spark.createDataFrame([orbits(rng, day, k, 0.0) for k in range(2000)], SCHEMA)
    base = with_states(objects, "epoch").selectExpr("norad_id", "epoch AS t", "rx", "ry", "rz")
    pool = objects.selectExpr("norad_id AS asset_id", "'x' AS asset_name", *[f"{c} AS el_{c}" for c in ELEMENTS])
    pairs = score._close_pairs(base, pool, 2000, 2000, 4_000)
    assert 1800 <= pairs.count() <= 2100


def test_blocks_of_objects_at_one_instant_are_even(spark):
    base = spark.range(4000).selectExpr(
        "id AS norad_id", "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, IF(id < 3000, 0, id)) AS t")
    sizes = [r["count"] for r in even_blocks(base, F.unix_micros("t"), 8, "norad_id").groupBy("block").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 800
