"""Explicit table schemas (never inferred)."""

from pyspark.sql import types as T

ELEMENT_SETS = T.StructType([
    T.StructField("norad_id", T.LongType(), False),
    T.StructField("epoch", T.TimestampType(), False),
    T.StructField("line1", T.StringType()),
    T.StructField("line2", T.StringType()),
    T.StructField("incl_deg", T.DoubleType()),
    T.StructField("raan_deg", T.DoubleType()),
    T.StructField("ecc", T.DoubleType()),
    T.StructField("argp_deg", T.DoubleType()),
    T.StructField("mean_anom_deg", T.DoubleType()),
    T.StructField("revs_per_day", T.DoubleType()),
    T.StructField("source", T.StringType(), False),
])

SATCAT = T.StructType([
    T.StructField("norad_id", T.LongType(), False),
    T.StructField("intl_desig", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("launch_date", T.DateType()),
    T.StructField("decay_date", T.DateType()),
    T.StructField("object_type", T.StringType()),
    T.StructField("rcs_m2", T.DoubleType()),
    T.StructField("period_min", T.DoubleType()),
    T.StructField("inclination", T.DoubleType()),
    T.StructField("apogee_km", T.DoubleType()),
    T.StructField("perigee_km", T.DoubleType()),
    T.StructField("updated_at", T.TimestampType()),
])

SNAPSHOTS = T.StructType([
    T.StructField("snapshot_at", T.TimestampType(), False),
    T.StructField("norad_id", T.LongType(), False),
])

WATCH_LIST = T.StructType([
    T.StructField("norad_id", T.LongType(), False),
    T.StructField("added_at", T.TimestampType(), False),
    T.StructField("note", T.StringType()),
])

OBJECT_STATE = T.StructType([
    T.StructField("norad_id", T.LongType(), False),
    T.StructField("name", T.StringType()),
    T.StructField("threat_score", T.DoubleType()),
    T.StructField("threat_band", T.StringType()),
    T.StructField("last_maneuver_epoch", T.TimestampType()),
    T.StructField("n_maneuvers", T.LongType()),
    T.StructField("rpo_label", T.StringType()),
    T.StructField("rpo_min_range_km", T.DoubleType()),
    T.StructField("decay_reentry", T.TimestampType()),
    T.StructField("disposal_status", T.StringType()),
])

LABELLED_EVENTS = T.StructType([
    T.StructField("key", T.StringType(), False),
    T.StructField("event_type", T.StringType(), False),
    T.StructField("label", T.StringType(), False),
    T.StructField("window_start", T.DateType(), False),
    T.StructField("window_end", T.DateType(), False),
    T.StructField("actor_norad", T.ArrayType(T.LongType()), False),
    T.StructField("target_norad", T.ArrayType(T.LongType()), False),
])
