"""Counting the candidates of the sieve without building them."""

import random

import pytest
from pyspark.sql import functions as F

from orbitframe.operators import conjunction as cj

BANDS = "norad_id long, perigee_km double, apogee_km double, incl_deg double, raan_deg double"


def catalogue(spark, seed, n=3000):
    """Dense and scattered planes and bands, repeated and missing ids, rows without a plane or a band."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        low = rng.choice([500.0, 500.0 + rng.randrange(300), rng.uniform(200, 30000)])
        rows.append((rng.choice([k, k, k, k // 2, None]), low, low + rng.choice([0.0, 50.0, 4000.0, -150.0]),
                     rng.choice([0.0, 10.0, 40.0, 70.0, rng.uniform(0, 180)]), rng.choice(
                         [0.0, 30.0, 60.0, float(rng.randrange(360)), rng.uniform(-90, 400)])))
    odd = [(-1, None, 500.0, 1.0, 1.0), (-2, 500.0, 500.0, None, 1.0), (-3, 500.0, 500.0, float("nan"), 1.0),
           (-4, 500.0, 520.0, 1.0, float("nan")), (-5, 500.0, 520.0, 50.0, float("inf"))]
    return spark.createDataFrame(rows + odd + rows[:50], BANDS)


@pytest.mark.parametrize("angle, budget", [(30.0, 4_000_000), (30.0, 10_000), (0.0, 10_000), (5.0, 40_000), (180.0, 90_000)])
def test_the_count_equals_the_pairs(spark, angle, budget):
    df = catalogue(spark, int(angle))
    if angle <= cj.GRID_DEG:  # the grid of normals has no place for what is no number
        df = df.where("norad_id IS NULL OR norad_id >= -2")
    df = df.localCheckpoint()
    n = df.count()
    want = cj.screened_pairs(df, max_angle_deg=angle).count()
    got = cj.screening_summary(df, max_angle_deg=angle, pairs_per_task=budget).first()
    assert tuple(got) == (n, n * (n - 1) // 2, want) and want > 500


def test_no_pair_is_built_for_the_count(spark):
    """Groups of the count hold blocks of objects; what comes out is one number for each two blocks."""
    from orbitframe.operators import sieve
    df = catalogue(spark, 1, 500)
    assert "Join" not in cj.count_screened(df)._jdf.queryExecution().executedPlan().toString()
    rows = cj._with_normals(df, 50.0).dropna().selectExpr(
        "norad_id AS id", "_low AS low", "_high AS high", "incl_deg", "raan_deg", "_nx AS nx", "_ny AS ny",
        "_nz AS nz", "0 AS i", "0 AS j")
    out = sieve.counter(31.4)(rows.toArrow(), rows.toArrow())
    assert out.num_rows == 1 and out.column("n")[0].as_py() > 1000


def test_no_objects(spark):
    none = catalogue(spark, 1, 60).limit(0)
    assert tuple(cj.screening_summary(none).first()) == (0, 0, 0)
