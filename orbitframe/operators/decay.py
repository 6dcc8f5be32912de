"""Perigee trends and re-entry estimates."""

from pyspark.sql import DataFrame, functions as F

from orbitframe import constants as K
from orbitframe.functions.orbits import days_between
from orbitframe.operators.skew import DAY_US, running_sum, slice_of


def perigee_trend(series: DataFrame, min_points: int = K.MIN_DECAY_POINTS,
                  slice_days: float = 60.0, tie: list[str] = ()) -> DataFrame:
    """Line fits over each object's perigee history and over its two halves.

    ``series``: norad_id, epoch, perigee_km. The older half holds the first
    n div 2 points. Fits are partial aggregates; the position of a point is
    counted slice by slice.
    """
    span = series.groupBy("norad_id").agg(
        F.count("*").alias("n_points"), F.min("epoch").alias("_first")).where(
        F.col("n_points") >= min_points)
    keyed = series.withColumn("_slice", slice_of(
        F.unix_micros("epoch"), int(slice_days * DAY_US)))
    placed = running_sum(keyed, ["norad_id"], "_slice", ["epoch", *tie], F.lit(1), "_pos")
    rows = placed.join(span, "norad_id").withColumn(
        "_days", days_between(F.col("epoch"), F.col("_first")))
    older = F.col("_pos") <= F.floor(F.col("n_points") / 2)
    half = lambda cond, c: F.when(cond, F.col(c))
    slope = lambda cond: -F.regr_slope(half(cond, "perigee_km"), half(cond, "_days"))
    last = F.struct(F.col("epoch"), F.col("_pos"))
    return rows.groupBy("norad_id").agg(
        F.first("n_points").alias("n_points"), F.max("epoch").alias("latest_epoch"),
        F.max_by("perigee_km", last).alias("latest_perigee_km"),
        (-F.regr_slope("perigee_km", "_days")).alias("overall_rate"),
        F.coalesce(F.regr_r2("perigee_km", "_days"), F.lit(0.0)).alias("_r2"),
        (F.max("perigee_km") == F.min("perigee_km")).alias("_flat"),
        slope(older).alias("old_rate"), slope(~older).alias("new_rate"),
        F.avg(half(older, "perigee_km")).alias("old_alt_km"),
        F.avg(half(~older, "perigee_km")).alias("new_alt_km"),
    ).withColumn("fit_r2", F.when(F.col("_flat"), 0.0).otherwise(F.col("_r2"))).drop(
        "_r2", "_flat")


def predict_decay(series: DataFrame, **options) -> DataFrame:
    """Re-entry estimate per object; no date when there is no basis for one.

    Outcomes in order: too_high, stable, imminent, then an estimate that is
    exponential when the loss rate grows measurably, else linear.
    """
    trend = perigee_trend(series, **options)
    c = F.col
    outcome = (
        F.when(c("latest_perigee_km") > K.MAX_DECAY_PERIGEE_KM, "too_high")
        .when(c("overall_rate") < K.MIN_DECAY_RATE, "stable")
        .when(c("latest_perigee_km") <= K.REENTRY_KM, "imminent")
        .otherwise("estimated"))
    halves = c("n_points") >= 2 * K.MIN_DECAY_POINTS
    growing = halves & (c("new_rate") > K.ACCELERATION * F.greatest(c("old_rate"), F.lit(1e-6)))
    fits = growing & (c("new_alt_km") < c("old_alt_km")) & (c("new_rate") > c("old_rate")) & (
        c("old_rate") > 0)
    height = (c("old_alt_km") - c("new_alt_km")) / F.log(c("new_rate") / c("old_rate"))
    df = trend.withColumn("outcome", outcome)
    est = c("outcome") == "estimated"
    df = df.withColumns({
        "decay_rate": F.when(est & halves, F.greatest(c("new_rate"), F.lit(K.MIN_DECAY_RATE)))
        .otherwise(c("overall_rate")),
        "accelerating": F.when(est, growing).otherwise(c("outcome") == "imminent"),
        "scale_height_km": F.when(est & fits, F.greatest(
            F.lit(K.SCALE_HEIGHT_MIN_KM), F.least(F.lit(K.SCALE_HEIGHT_MAX_KM), height)))})
    drop = c("latest_perigee_km") - K.REENTRY_KM
    h = c("scale_height_km")
    df = df.withColumn("linear_days", F.when(est, drop / c("decay_rate")).when(
        c("outcome") == "imminent", 0.0))
    df = df.withColumns({
        "days_to_reentry": F.when(
            h.isNotNull(), h / c("decay_rate") * (1 - F.exp(-drop / h))).otherwise(c("linear_days")),
        "model": F.when(h.isNotNull(), "exponential-atmosphere").otherwise("linear")})
    return df.withColumn("reentry_at", F.timestamp_micros(
        (F.unix_micros("latest_epoch") + c("days_to_reentry") * 86400e6).cast("long"))).select(
        "norad_id", "n_points", "latest_epoch", "latest_perigee_km", "outcome", "decay_rate",
        "accelerating", "scale_height_km", "linear_days", "days_to_reentry", "reentry_at",
        "model", "fit_r2")
