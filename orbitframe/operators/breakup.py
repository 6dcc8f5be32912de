"""Fragmentation candidates from catalogue cohorts."""

from pyspark.sql import DataFrame, functions as F

from orbitframe import constants as K
from orbitframe.operators.catalog import launch_prefix
from orbitframe.operators.skew import robust_stats
from orbitframe.sources.landing import landed

_BODY = ["norad_id", "name", "intl_desig", "object_type", "inclination", "perigee_km", "apogee_km"]


def debris_rows(satcat: DataFrame) -> DataFrame:
    """Debris with a complete orbit and a designator, keyed by launch."""
    return satcat.where(
        (F.col("object_type") == "DEB") & F.col("inclination").isNotNull()
        & F.col("perigee_km").isNotNull() & F.col("apogee_km").isNotNull()
    ).withColumn("launch_prefix", launch_prefix(F.col("intl_desig"))).where(
        F.col("launch_prefix") != "")


def launch_parents(satcat: DataFrame) -> DataFrame:
    """Per launch: first payload, else first rocket body, in designator order."""
    bodies = satcat.where(F.col("object_type").isin("PAY", "R/B")).where(
        F.col("intl_desig") != "")
    rank = F.struct((F.col("object_type") != "PAY").alias("_late"), "intl_desig", "norad_id")
    return bodies.groupBy(launch_prefix(F.col("intl_desig")).alias("launch_prefix")).agg(
        F.min_by(F.struct("norad_id", "name"), rank).alias("_p")).select(
        "launch_prefix", F.col("_p.norad_id").alias("parent_norad_id"),
        F.col("_p.name").alias("parent_name"))


def launch_breakups(satcat: DataFrame, prefixes: DataFrame | None = None,
                    min_fragments: int = K.MIN_FRAGMENTS) -> DataFrame:
    """Launches whose debris looks like one event, one row per launch.

    The fragments themselves are rows of :func:`breakup_fragments`, not a list,
    so a launch of any size stays spread out. With ``prefixes`` the catalogue rows of these launches
    are landed, as every step reads them.
    """
    if prefixes is not None:
        wanted = prefixes.select("launch_prefix").distinct()
        satcat = landed(satcat.select(*_BODY).withColumn(
            "launch_prefix", launch_prefix(F.col("intl_desig"))).join(
                wanted, "launch_prefix", "left_semi").drop("launch_prefix"))
    debris = debris_rows(satcat)
    cloud = debris.groupBy("launch_prefix").agg(
        F.count("*").alias("n_fragments"), F.avg("inclination").alias("mean_inclination_deg"),
        F.stddev_pop("inclination").alias("incl_std_deg"),
        F.min("perigee_km").alias("perigee_min_km"), F.max("perigee_km").alias("perigee_max_km"),
        F.min("apogee_km").alias("apogee_min_km"), F.max("apogee_km").alias("apogee_max_km"),
    ).where(F.col("n_fragments") >= min_fragments)
    ids = robust_stats(debris, ["launch_prefix"], F.col("norad_id"))
    relative = F.when(F.col("median") > 0, F.col("mad") / F.col("median")).otherwise(F.lit(0.0))
    burst = ids.where(relative <= K.MAX_ID_RELATIVE_MAD).select("launch_prefix")
    std, n = F.col("incl_std_deg"), F.col("n_fragments")
    confidence = (
        F.when((n >= K.HIGH_FRAGMENTS) & (std < K.INCL_SPREAD_DEG), "high")
        .when(std < 2 * K.INCL_SPREAD_DEG, "medium").otherwise("low"))
    return (
        cloud.join(burst, "launch_prefix").join(launch_parents(satcat), "launch_prefix", "left")
        .withColumn("confidence", confidence)
    )


def breakup_fragments(satcat: DataFrame, breakups: DataFrame) -> DataFrame:
    """(launch_prefix, norad_id) of every fragment of the given candidates."""
    return debris_rows(satcat).join(
        breakups.select("launch_prefix"), "launch_prefix", "left_semi").select(
        "launch_prefix", "norad_id")


def breakups_from_delta(new_ids: DataFrame, satcat: DataFrame,
                        min_new: int = K.MIN_NEW_FRAGMENTS) -> DataFrame:
    """Launches with enough new debris, judged on their whole cohort."""
    fresh = satcat.where(
        (F.col("object_type") == "DEB") & F.col("intl_desig").isNotNull()
        & (F.col("intl_desig") != "")
    ).join(new_ids.select("norad_id").distinct(), "norad_id", "left_semi")
    triggered = fresh.groupBy(launch_prefix(F.col("intl_desig")).alias("launch_prefix")).agg(
        F.count("*").alias("_n")).where(F.col("_n") >= min_new)
    return launch_breakups(satcat, triggered)


def evaluate_labelled_events(labels: DataFrame, satcat: DataFrame) -> DataFrame:
    """Detector against labelled launches.

    ``labels``: key, expected ('positive' or 'control'), norad_id. A label whose
    object has no designator is unresolved: NULL prefix, nothing found.
    """
    own = satcat.select("norad_id", F.nullif(F.col("intl_desig"), F.lit("")).alias("_d"))
    keyed = labels.join(own, "norad_id", "left").withColumn(
        "launch_prefix", launch_prefix(F.col("_d"))).drop("_d")
    found = launch_breakups(satcat, keyed.where(F.col("launch_prefix").isNotNull()))
    return keyed.join(
        found.select("launch_prefix", "n_fragments", "confidence"), "launch_prefix", "left"
    ).withColumn("found", F.col("n_fragments").isNotNull()).withColumn(
        "passed", F.col("found") == (F.col("expected") == "positive"))
