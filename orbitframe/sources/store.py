"""Parquet tables: append-if-new, keyed merges, snapshots, cycles."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from orbitframe import schemas

KEPT_ON_CONFLICT = ("intl_desig", "launch_date")


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The earliest row per key as a partial aggregate, so any number of copies
    of one row shrinks before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*").select(
        *df.columns)


def new_element_sets(existing: DataFrame, incoming: DataFrame,
                     order: tuple[str, ...] = ("source", "line1")) -> DataFrame:
    """Incoming sets whose (norad_id, epoch) is not stored yet, first arrival only."""
    keys = ["norad_id", "epoch"]
    return first_per_key(incoming, keys, list(order)).join(
        existing.select(*keys), keys, "left_anti")


def append_element_sets(existing: DataFrame, incoming: DataFrame,
                        order: tuple[str, ...] = ("source", "line1")) -> DataFrame:
    """The table after insert-or-ignore on (norad_id, epoch)."""
    return existing.unionByName(new_element_sets(existing, incoming, order).select(
        *existing.columns))


def ingest_counts(incoming: DataFrame, fresh: DataFrame, group: str = "file") -> DataFrame:
    """Fetched and new element sets per landed group."""
    fetched = incoming.groupBy(group).agg(F.count("*").alias("fetched"))
    added = fresh.groupBy(group).agg(F.count("*").alias("new"))
    return fetched.join(added, group, "left").select(
        group, "fetched", F.coalesce("new", F.lit(0)).alias("new"))


def upsert_satcat(existing: DataFrame, incoming: DataFrame,
                  kept: tuple[str, ...] = KEPT_ON_CONFLICT,
                  order: tuple[str, ...] = ("updated_at",)) -> DataFrame:
    """Keyed merge; the last incoming row per object wins, ``kept`` columns of
    an object already stored do not change."""
    rest = [c for c in existing.columns if c != "norad_id"]
    last = incoming.groupBy("norad_id").agg(
        F.max_by(F.struct(*rest), F.struct(*order)).alias("_new"))
    old = existing.select("norad_id", F.struct(*rest).alias("_old"))
    pick = lambda c: (
        F.when(F.col("_old").isNotNull() & F.lit(c in kept), F.col(f"_old.{c}"))
        .when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}")))
    return old.join(last, "norad_id", "full_outer").select(
        "norad_id", *[pick(c).alias(c) for c in rest])


def record_snapshot(snapshots: DataFrame, ids: DataFrame, at) -> DataFrame:
    """The snapshot table with the distinct ids at ``at`` added, if not there."""
    rows = ids.select(F.lit(at).cast("timestamp").alias("snapshot_at"), "norad_id").distinct()
    keys = ["snapshot_at", "norad_id"]
    return snapshots.unionByName(rows.join(snapshots, keys, "left_anti"))


# ---------------------------------------------------------------- files
def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read.option("mergeSchema", "true")
    return (reader.schema(schema) if schema is not None else reader).parquet(path)


def _month():
    return F.date_format("epoch", "yyyy-MM")


def epoch_months(sets: DataFrame) -> list[str]:
    """The months of the epochs, at most twelve for each year that element text can name."""
    return [r[0] for r in sets.select(_month()).distinct().collect() if r[0]]


def stored_element_sets(spark: SparkSession, path: str, months: list[str] | None = None) -> DataFrame:
    """Stored sets, of some months only if they are given; none where nothing is stored yet."""
    try:
        table = read_table(spark, path, schemas.ELEMENT_SETS)
        table.schema
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schemas.ELEMENT_SETS)
    if months is not None:
        table = table.where(F.col("epoch_month").cast("string").isin(months))
    return table.select(*schemas.ELEMENT_SETS.names)


def write_element_sets(df: DataFrame, path: str, mode: str = "append", buckets: int = 16) -> None:
    """Partitioned by month, some files of object buckets in each, sorted by object and time."""
    rows = df.withColumn("epoch_month", _month())
    rows.repartition("epoch_month", F.pmod(F.hash("norad_id"), F.lit(buckets))).sortWithinPartitions(
        "epoch_month", "norad_id", "epoch").write.mode(mode).partitionBy("epoch_month").parquet(path)


def ingest_groups(spark: SparkSession, incoming: DataFrame, path: str, snapshots: str | None = None,
                  at=None) -> DataFrame:
    """Append new sets of landed groups to the table at ``path``.

    Returns per-group counts. The new rows are written once and the counts
    come from two aggregates; nothing passes through the driver. With ``snapshots`` the objects of
    all groups together are recorded there as the snapshot of the instant ``at``; a repeated
    ingestion at that instant replaces it, one without sets records nothing.
    """
    keys = [f.name for f in schemas.ELEMENT_SETS.fields]
    existing = stored_element_sets(spark, path, epoch_months(incoming))
    fresh = new_element_sets(existing, incoming, ("file", "block", "seq")).persist()
    counts = ingest_counts(incoming, fresh).persist()
    counts.count()
    write_element_sets(fresh.select(*keys), path)
    fresh.unpersist()
    if snapshots is not None:
        write_snapshot(incoming, snapshots, at)
    return counts


def write_snapshot(ids: DataFrame, path: str, at) -> None:
    """The distinct objects of ``ids`` as the snapshot of the instant ``at``, in its own partition."""
    rows = ids.select("norad_id", F.lit(at).cast("timestamp").alias("snapshot_at")).distinct()
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "snapshot_at").parquet(path)


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.SNAPSHOTS).parquet(path)


def save_cycle(tables: dict[str, DataFrame], root: str) -> None:
    """Persist a watch cycle in a folder of its own per table.

    A repeated save replaces the folder, also where nothing is left to write. The tables must be
    derived from earlier cycles only, see ``before`` in :func:`load_states`.
    """
    cycle_id = tables["cycle"].first()["cycle_id"]
    for name in ("findings", "cycle", "states"):
        tables[name].drop("cycle_id").write.mode("overwrite").parquet(
            f"{root}/{name}/cycle_id={cycle_id}")


def load_states(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """States as of the newest saved cycle, or the newest one before ``before``."""
    states = spark.read.parquet(f"{root}/states")
    if before is not None:
        states = states.where(F.col("cycle_id") < before)
    return states.where(F.col("cycle_id") == states.agg(F.max("cycle_id")).scalar())
