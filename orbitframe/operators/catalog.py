"""Catalogue listings, rollups, snapshots and lookups."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from orbitframe import constants as K
from orbitframe.functions import orbits

ACTIVE = "decay_date IS NULL"


# ---------------------------------------------------------------- element sets
def history(element_sets: DataFrame, ids: DataFrame, start=None, end=None) -> DataFrame:
    """Element sets of the objects in ``ids`` inside [start, end), in time order."""
    df = element_sets
    if start is not None:
        df = df.where(F.col("epoch") >= F.lit(start).cast("timestamp"))
    if end is not None:
        df = df.where(F.col("epoch") < F.lit(end).cast("timestamp"))
    return df.join(ids.select("norad_id").distinct(), "norad_id", "left_semi").orderBy(
        "norad_id", "epoch")


def latest_per_object(element_sets: DataFrame) -> DataFrame:
    """Newest element set of each object."""
    rest = [c for c in element_sets.columns if c != "norad_id"]
    return element_sets.groupBy("norad_id").agg(
        F.max_by(F.struct(*rest), "epoch").alias("_last")).select("norad_id", "_last.*")


def current_objects(element_sets: DataFrame, source: str = "live") -> DataFrame:
    return element_sets.where(F.col("source") == source).groupBy("norad_id").agg(
        F.max("epoch").alias("latest_epoch"))


def archive_coverage(element_sets: DataFrame, ids: DataFrame, start, end) -> DataFrame:
    """Element sets per requested object in [start, end); zero when there are none."""
    inside = element_sets.where(
        (F.col("epoch") >= F.lit(start).cast("timestamp"))
        & (F.col("epoch") < F.lit(end).cast("timestamp")))
    counts = inside.groupBy("norad_id").agg(F.count("*").alias("_n"))
    return ids.select("norad_id").distinct().join(counts, "norad_id", "left").select(
        "norad_id", F.coalesce("_n", F.lit(0)).alias("n_sets"))


def with_catalog_names(element_sets: DataFrame, satcat: DataFrame) -> DataFrame:
    """One row per tracked object: name, number of sets, latest epoch."""
    counted = element_sets.groupBy("norad_id").agg(
        F.count("*").alias("n_sets"), F.max("epoch").alias("latest_epoch"))
    return counted.join(satcat.select("norad_id", "name"), "norad_id", "left").select(
        "norad_id",
        F.coalesce("name", F.concat(F.lit("NORAD "), F.col("norad_id").cast("string")))
        .alias("name"), "n_sets", "latest_epoch")


def featured_objects(element_sets: DataFrame, event_ids: DataFrame,
                     min_sets: int = K.FEATURED_MIN_SETS) -> DataFrame:
    """Objects with enough history, plus event objects that have any."""
    counted = element_sets.groupBy("norad_id").agg(F.count("*").alias("_n"))
    listed = event_ids.select("norad_id").distinct().withColumn("_listed", F.lit(True))
    return counted.join(listed, "norad_id", "left").where(
        (F.col("_n") >= min_sets) | F.col("_listed")).select("norad_id")


# ---------------------------------------------------------------- catalogue
def active_objects(satcat: DataFrame) -> DataFrame:
    return satcat.where(F.col("decay_date").isNull())


def satcat_lookup(satcat: DataFrame, ids: DataFrame) -> DataFrame:
    return satcat.join(ids.select("norad_id").distinct(), "norad_id", "left_semi")


def high_value_assets(element_sets: DataFrame, satcat: DataFrame,
                      exclude: int | None = None, source: str = "live") -> DataFrame:
    """Payloads that have an element set from the live source."""
    live = element_sets.where(F.col("source") == source).select("norad_id")
    pool = satcat.where(F.col("object_type") == "PAY").join(live, "norad_id", "left_semi")
    if exclude is not None:
        pool = pool.where(F.col("norad_id") != exclude)
    return pool.select("norad_id", "name")


def launch_prefix(designator: Column) -> Column:
    return F.substring(designator, 1, 8)


def launch_cohort(satcat: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Catalogue rows of the given launches (``prefixes.launch_prefix``)."""
    keyed = satcat.withColumn("launch_prefix", launch_prefix(F.col("intl_desig")))
    return keyed.join(prefixes.select("launch_prefix").distinct(), "launch_prefix", "left_semi")


def catalog_stats(satcat: DataFrame) -> DataFrame:
    active = F.col("decay_date").isNull()
    return satcat.agg(
        F.count("*").alias("total"), F.count_if(active).alias("active"),
        F.count_if(active & (F.col("object_type") == "PAY")).alias("payloads"),
        F.count_if(active & (F.col("object_type") == "DEB")).alias("debris"))


def country_rollup(satcat: DataFrame, n: int = 30) -> DataFrame:
    """Largest owners of active objects; ties by owner code."""
    known = active_objects(satcat).where(F.col("country").isNotNull() & (F.col("country") != ""))
    return known.groupBy("country").agg(
        F.count("*").alias("n_objects"),
        F.count_if(F.col("object_type") == "PAY").alias("n_payloads"),
        F.count_if(F.col("object_type") == "DEB").alias("n_debris"),
        F.count_if(orbits.band_predicate("GEO")).alias("n_geo"),
    ).orderBy(F.desc("n_objects"), "country").limit(n)


def top_countries(satcat: DataFrame, n: int = 20) -> DataFrame:
    known = active_objects(satcat).where(F.col("country").isNotNull())
    return known.groupBy("country").agg(F.count("*").alias("n_objects")).orderBy(
        F.desc("n_objects"), "country").limit(n)


def regime_band_filter(df: DataFrame, band: str) -> DataFrame:
    return df.where(orbits.band_predicate(band))


def satcat_regime(satcat: DataFrame) -> DataFrame:
    return satcat.withColumn("regime", orbits.satcat_regime(
        F.col("apogee_km"), F.col("perigee_km")))


def like_literal(text: str) -> str:
    """Escape LIKE wildcards typed by a user."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def catalog_search(satcat: DataFrame, text: str = "", regime: str = "", object_type: str = "",
                   country: str = "") -> DataFrame:
    """Active objects matching every given condition."""
    df = active_objects(satcat)
    if text.isdigit():
        df = df.where(F.col("norad_id") == int(text))
    elif text:
        df = df.where(F.col("name").ilike(f"%{like_literal(text)}%"))
    if regime in ("LEO", "MEO", "GEO", "HEO"):
        df = regime_band_filter(df, regime)
    if object_type in ("PAY", "DEB", "R/B", "UNK"):
        df = df.where(F.col("object_type") == object_type)
    if country:
        df = df.where(F.col("country") == country)
    return satcat_regime(df).select(
        "norad_id", "name", "country", "object_type", "apogee_km", "perigee_km",
        "inclination", "regime")


def page(df: DataFrame, number: int, per_page: int = K.PAGE_SIZE,
         order: tuple[str, ...] = ("norad_id",)) -> DataFrame:
    """One page of an ordered listing, pages counted from one."""
    return df.orderBy(*order).offset((max(1, number) - 1) * per_page).limit(per_page)


def page_count(df: DataFrame, per_page: int = K.PAGE_SIZE) -> DataFrame:
    return df.agg(F.count("*").alias("total")).select(
        "total", F.ceil(F.col("total") / per_page).cast("long").alias("pages"))


def map_objects(satcat: DataFrame) -> DataFrame:
    """Active payloads with a published orbit."""
    return satcat_regime(active_objects(satcat)).where(
        (F.col("object_type") == "PAY") & F.col("apogee_km").isNotNull()
        & F.col("perigee_km").isNotNull() & F.col("inclination").isNotNull())


def map_sample(objects: DataFrame, target: int = K.MAP_TARGET,
               ids_per_slice: int = 100_000) -> DataFrame:
    """Every step-th object by id, step = max(1, n div target).

    The running position is counted inside id ranges plus one offset per
    range, so no task sees all objects.
    """
    slices = objects.withColumn("_slice", F.floor(F.col("norad_id") / ids_per_slice))
    local = Window.partitionBy("_slice").orderBy("norad_id")
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    # one row per id range
    offsets = slices.groupBy("_slice").agg(F.count("*").alias("_n")).select(
        "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    step = objects.agg(F.greatest(F.lit(1), F.floor(F.count("*") / target))).scalar()
    return (
        slices.withColumn("_pos", F.row_number().over(local) - 1).join(offsets, "_slice")
        .where((F.col("_pos") + F.col("_offset")) % step == 0)
        .drop("_slice", "_pos", "_offset")
    )


# ---------------------------------------------------------------- snapshots
def snapshot_times(snapshots: DataFrame) -> DataFrame:
    return snapshots.select("snapshot_at").distinct().orderBy("snapshot_at")


def snapshot_delta(snapshots: DataFrame) -> DataFrame:
    """Objects of the latest snapshot that the one before did not have.

    With a single snapshot there is nothing to compare.
    """
    latest = snapshots.select("snapshot_at").distinct().agg(F.slice(F.sort_array(
        F.collect_list("snapshot_at"), asc=False), 1, 2).alias("_t")).where(F.size("_t") == 2)
    two = latest.select(F.posexplode("_t").alias("_nth", "snapshot_at"))
    seen = snapshots.join(F.broadcast(two), "snapshot_at").groupBy("norad_id").agg(
        F.max("_nth").alias("_oldest"))
    return seen.where("_oldest = 0").select("norad_id")


def union_ids(*tables: DataFrame) -> DataFrame:
    """Distinct objects over several tables."""
    first, *rest = [t.select("norad_id") for t in tables]
    for other in rest:
        first = first.union(other)
    return first.distinct()


def event_object_ids(events: DataFrame) -> DataFrame:
    """Every object named by a labelled event."""
    return events.select(F.explode(F.concat("actor_norad", "target_norad")).alias(
        "norad_id")).distinct()


# ---------------------------------------------------------------- orderings
URGENCY_RANK = {"priority": 3, "elevated": 2, "routine": 1}


def urgency_rank(column: Column) -> Column:
    ranks = [(column == name, F.lit(rank)) for name, rank in URGENCY_RANK.items()]
    return orbits.first_match(ranks)


def altitude_key() -> Column:
    return F.coalesce("apogee_km", F.lit(0.0)) + F.coalesce("perigee_km", F.lit(0.0))
