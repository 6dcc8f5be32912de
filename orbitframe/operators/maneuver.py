"""Manoeuvre detection from consecutive element sets."""

from pyspark.sql import DataFrame, functions as F

from orbitframe import constants as K
from orbitframe.functions import orbits
from orbitframe.operators.skew import neighbours, robust_stats
from orbitframe.operators.trajectory import ELEMENTS, above_ground, ric_relative, with_states


def consecutive_pairs(history: DataFrame, columns: list[str],
                      max_gap_days: float = K.MAX_GAP_DAYS) -> DataFrame:
    """Each element set with its immediate predecessor as struct ``prev``.

    Only gaps in (0, max_gap_days] are kept; a dropped pair is not re-paired.
    """
    df = history.withColumn("_us", F.unix_micros("epoch"))
    df = neighbours(df, ["norad_id"], "_us", max_gap_days, columns)
    df = df.withColumn("gap_days", orbits.days_between(F.col("epoch"), F.col("prev.epoch")))
    return df.where((F.col("gap_days") > 0) & (F.col("gap_days") <= max_gap_days)).drop("_us")


def pair_residuals(history: DataFrame, max_gap_days: float = K.MAX_GAP_DAYS) -> DataFrame:
    """Actual minus predicted velocity at each later epoch, in the actual frame.

    The earlier set is propagated to the later epoch and compared with the
    later set's own state there.
    """
    pairs = consecutive_pairs(history.select("norad_id", *ELEMENTS), ELEMENTS, max_gap_days)
    states = with_states(with_states(pairs, "epoch", "", "a_"), "epoch", "prev.", "b_")
    rel = ric_relative(states.where(above_ground("a_") & above_ground("b_")))
    part = lambda axis: F.col(f"vel_{axis}") * F.lit(-1000.0)
    return rel.select(
        "norad_id", "epoch", "gap_days", (F.col("speed_kms") * 1000.0).alias("dv_ms"),
        part("r").alias("dv_r_ms"), part("i").alias("dv_i_ms"), part("c").alias("dv_c_ms"),
        F.col("range_km").alias("pos_err_km"))


def noise_floor(residuals: DataFrame, min_history: int = K.MIN_RESIDUALS) -> DataFrame:
    """Per object: median, MAD and sigma of the residual size."""
    stats = robust_stats(residuals, ["norad_id"], F.col("dv_ms"))
    return stats.where(F.col("n") >= min_history).select(
        "norad_id", F.col("n").alias("n_residuals"), F.col("median").alias("floor_ms"),
        F.col("mad").alias("mad_ms"),
        F.greatest(F.col("mad") * K.MAD_TO_SIGMA, F.lit(K.SIGMA_FLOOR)).alias("sigma_ms"))


def detect_maneuvers(residuals: DataFrame, z_flag: float = K.Z_FLAG,
                     min_history: int = K.MIN_RESIDUALS,
                     floors: DataFrame | None = None) -> DataFrame:
    """Residuals that stand out from the object's own noise floor.

    ``floors`` is the result of :func:`noise_floor` when it is already there.
    """
    floor = noise_floor(residuals, min_history) if floors is None else floors
    floor = floor.select("norad_id", "floor_ms", "sigma_ms")
    z = (F.col("dv_ms") - F.col("floor_ms")) / F.col("sigma_ms")
    confidence = F.when(F.col("zscore") >= K.Z_STRONG, "high").when(
        F.col("zscore") >= 2 * z_flag, "medium").otherwise("low")
    return (
        residuals.join(floor, "norad_id").withColumn("zscore", z)
        .where(F.col("zscore") >= z_flag)
        .withColumns({
            "confidence": confidence,
            "direction": orbits.burn_direction(
                F.col("dv_r_ms"), F.col("dv_i_ms"), F.col("dv_c_ms"))})
        .drop("sigma_ms")
    )
