"""Proximity episodes, pair assessments and the interaction graph."""

from pyspark.sql import DataFrame, functions as F

from orbitframe import constants as K
from orbitframe.functions.orbits import days_between
from orbitframe.operators.catalog import launch_prefix
from orbitframe.operators.skew import DAY_US, running_sum, slice_of

PAIR = ["actor", "target"]


def proximity_episodes(samples: DataFrame, close_km: float = K.CLOSE_RANGE_KM,
                       slow_kms: float = K.LOITER_SPEED_KMS, max_hole_days: float | None = None,
                       slice_days: float = 60.0, tie: list[str] = ()) -> DataFrame:
    """Runs of consecutive close-and-slow samples of each pair.

    Runs are told apart by how many other samples came before, a running count
    taken slice by slice. ``max_hole_days`` also ends a run at a data hole.
    """
    near = (F.col("range_km") < close_km) & (F.col("speed_kms") < slow_kms)
    keyed = samples.withColumns({
        "_near": near, "_slice": slice_of(F.unix_micros("t"), int(slice_days * DAY_US))})
    order = ["t", *tie]
    runs = running_sum(keyed, PAIR, "_slice", order, F.when(F.col("_near"), 0).otherwise(1), "_run")
    runs = runs.where("_near")
    if max_hole_days is None:
        grouped = runs.groupBy(*PAIR, "_run")
    else:
        hole = F.session_window("t", f"{int(max_hole_days * 86400)} seconds")
        grouped = runs.groupBy(*PAIR, "_run", hole.alias("_hole"))
    return grouped.agg(
        F.min("t").alias("start_at"), F.max("t").alias("end_at"),
        F.min("range_km").alias("min_range_km"), F.avg("speed_kms").alias("mean_speed_kms"),
        F.count("*").alias("n_samples"),
    ).withColumn("duration_days", days_between(F.col("end_at"), F.col("start_at"))).drop(
        "_run", "_hole")


def same_launch_lineage(pairs: DataFrame, satcat: DataFrame) -> DataFrame:
    """Whether both objects share a launch; NULL if either designator is missing."""
    prefix = launch_prefix(F.nullif(F.col("intl_desig"), F.lit("")))
    side = lambda who: satcat.select(F.col("norad_id").alias(who), prefix.alias(f"_{who}_p"))
    return pairs.join(side("actor"), "actor", "left").join(side("target"), "target", "left") \
        .withColumn("same_launch_lineage", F.col("_actor_p") == F.col("_target_p")) \
        .drop("_actor_p", "_target_p")


def rpo_summary(samples: DataFrame, satcat: DataFrame | None = None,
                min_samples: int = K.MIN_ALIGNED_SAMPLES, likely_days: float = K.LIKELY_DAYS,
                **episode_options) -> DataFrame:
    """One row per pair with enough samples: label, minimum range, coverage."""
    pairs = samples.groupBy(*PAIR).agg(
        F.count("*").alias("n_samples"), F.min("range_km").alias("min_range_km"),
        F.min("t").alias("coverage_start"), F.max("t").alias("coverage_end"),
    ).where(F.col("n_samples") >= min_samples)
    totals = proximity_episodes(samples, **episode_options).groupBy(*PAIR).agg(
        F.count("*").alias("n_episodes"), F.sum("duration_days").alias("total_close_days"))
    df = pairs.join(totals, PAIR, "left").withColumns({
        "n_episodes": F.coalesce("n_episodes", F.lit(0)),
        "total_close_days": F.coalesce("total_close_days", F.lit(0.0))})
    df = df.withColumn("label", F.when(F.col("total_close_days") >= likely_days, "likely").when(
        F.col("n_episodes") > 0, "possible").otherwise("none"))
    return df if satcat is None else same_launch_lineage(df, satcat)


def range_trace(samples: DataFrame) -> DataFrame:
    """Days since each pair's first sample, with the range."""
    first = samples.groupBy(*PAIR).agg(F.min("t").alias("_first"))
    return samples.join(first, PAIR).select(
        *PAIR, days_between(F.col("t"), F.col("_first")).alias("days"), "range_km")


def known_targets(events: DataFrame, history: DataFrame) -> DataFrame:
    """Per actor of a proximity event: its first listed target that has history.

    ``events`` may carry ``seq`` (listing order); without it the key orders.
    """
    order = "seq" if "seq" in events.columns else "key"
    listed = events.where(F.col("event_type") == "rpo").select(
        order, F.explode("actor_norad").alias("actor"), "target_norad").select(
        order, "actor", F.posexplode("target_norad").alias("_pos", "target"))
    held = history.select(F.col("norad_id").alias("target")).distinct()
    return listed.join(held, "target", "left_semi").groupBy("actor").agg(
        F.min_by("target", F.struct(order, "_pos")).alias("target"))


# ---------------------------------------------------------------- graph
def interaction_edges(assessments: DataFrame) -> DataFrame:
    """Assessments that show any interaction; parallel edges are kept."""
    return assessments.where(F.col("label") != "none")


def interaction_nodes(edges: DataFrame, assets: DataFrame) -> DataFrame:
    """Objects of the graph, flagged when they are high-value assets."""
    nodes = edges.select(F.col("actor").alias("norad_id")).union(
        edges.select("target")).distinct()
    flags = assets.select("norad_id").distinct().withColumn("_asset", F.lit(True))
    return nodes.join(flags, "norad_id", "left").select(
        "norad_id", F.coalesce("_asset", F.lit(False)).alias("is_asset"))


def edges_in_window(edges: DataFrame, start, end) -> DataFrame:
    """Edges whose coverage meets [start, end], both ends included."""
    return edges.where((F.col("start_at") <= F.lit(end).cast("timestamp"))
                       & (F.col("end_at") >= F.lit(start).cast("timestamp")))


def actor_targets(edges: DataFrame, assets: DataFrame) -> DataFrame:
    """Distinct targets of each actor (self-loops dropped), with the asset flag."""
    distinct = interaction_edges(edges).where(F.col("actor") != F.col("target")).select(
        *PAIR).distinct()
    flags = assets.select(F.col("norad_id").alias("target")).distinct().withColumn(
        "_asset", F.lit(True))
    return distinct.join(flags, "target", "left").select(
        *PAIR, F.coalesce("_asset", F.lit(False)).alias("is_asset"))


def serial_inspectors(edges: DataFrame, assets: DataFrame, min_targets: int = 2) -> DataFrame:
    """Actors that reached several different targets.

    The targets themselves are rows of :func:`actor_targets`.
    """
    n, m = F.col("distinct_targets"), F.col("asset_targets")
    return actor_targets(edges, assets).groupBy("actor").agg(
        F.count("*").alias("distinct_targets"), F.count_if("is_asset").alias("asset_targets"),
    ).where(n >= min_targets).withColumn(
        "confidence", F.when((m >= 3) | (n >= 5), "high").when((m >= 1) | (n >= 3), "medium")
        .otherwise("low")).orderBy(F.desc("asset_targets"), F.desc("distinct_targets"), "actor")
