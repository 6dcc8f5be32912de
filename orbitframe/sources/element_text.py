"""Landing-zone readers: two-line element text and catalogue CSV."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from orbitframe import schemas

# fixed columns of the two-line format: name -> (line, first, length)
_FIELDS = {
    "norad_id": ("line1", 3, 5),
    "incl_deg": ("line2", 9, 8),
    "raan_deg": ("line2", 18, 8),
    "argp_deg": ("line2", 35, 8),
    "mean_anom_deg": ("line2", 44, 8),
    "revs_per_day": ("line2", 53, 11),
}


def decode_epoch(line1: str = "line1") -> Column:
    """Columns 19-32 (YYDDD.dddddddd) as a timestamp cut to milliseconds.

    Two-digit years from 57 on are 19YY.
    """
    yy = F.expr(f"try_cast(trim(substring({line1}, 19, 2)) AS int)")
    day = F.expr(f"try_cast(trim(substring({line1}, 21, 12)) AS double)")
    year = F.when(yy >= 57, yy + 1900).otherwise(yy + 2000)
    start = F.unix_micros(F.make_timestamp(year, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    micros = start + F.round((day - 1) * 86400e6).cast("long")
    return F.date_trunc("millisecond", F.timestamp_micros(micros))


def decode_elements(pairs: DataFrame) -> DataFrame:
    """(line1, line2, ...) to element rows; undecodable sets drop out."""
    number = lambda name, kind: F.expr("try_cast(trim(substring({}, {}, {})) AS {})".format(
        *_FIELDS[name], kind))
    ecc = F.expr("try_cast(concat('0.', trim(substring(line2, 27, 7))) AS double)")
    columns = {name: number(name, "double") for name in _FIELDS if name != "norad_id"}
    return pairs.withColumns({
        "norad_id": number("norad_id", "long"), "epoch": decode_epoch(), "ecc": ecc, **columns,
    }).where(F.col("norad_id").isNotNull() & F.col("epoch").isNotNull())


# records begin after this, so that a file of any size can be split
_RECORD_START = "\n1 "


def _pair_of_record(value: Column) -> Column:
    """(line1, line2) of one record, NULL line2 if the set is incomplete.

    A record is what follows the "1 " of a first line up to the next one; only
    the record that opens a file may still carry the "1 " or be a name line.
    Lines are trimmed on the right and blank ones skipped.
    """
    lines = F.filter(F.transform(F.split(value, r"\r\n|\n|\r"), lambda s: F.rtrim(s)),
                     lambda s: F.trim(s) != "")
    head, follower = F.get(lines, F.lit(0)), F.get(lines, F.lit(1))
    line1 = F.when(head.startswith("1 "), head).otherwise(F.concat(F.lit("1 "), head))
    return F.struct(line1.alias("line1"),
                    F.when(follower.startswith("2 "), follower).alias("line2"))


def element_rows(records: DataFrame, source: str) -> DataFrame:
    """Element rows of text records (columns value plus any others)."""
    others = [c for c in records.columns if c != "value"]
    pairs = records.select(*others, _pair_of_record(F.col("value")).alias("_p")).select(
        *others, "_p.*").where(F.col("line2").isNotNull()).withColumn("source", F.lit(source))
    return decode_elements(pairs).select(*schemas.ELEMENT_SETS.names, *others)


def read_element_text(spark: SparkSession, paths, source: str) -> DataFrame:
    """Element rows of landing-zone text files, with or without name lines.

    Files are split at first lines, so one huge archive file is read by many
    tasks. Adds file, block and seq: the order of arrival within a file.
    """
    records = spark.read.option("lineSep", _RECORD_START).text(paths).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"), "value")
    return element_rows(records, source)


def stream_element_text(spark: SparkSession, folder: str, source: str) -> DataFrame:
    """The same rows from files as they land in ``folder``."""
    records = spark.readStream.option("lineSep", _RECORD_START).text(folder).select(
        F.col("_metadata.file_path").alias("file"), "value")
    return element_rows(records, source)


# CSV header -> satcat column
_CSV = {
    "OBJECT_ID": "intl_desig", "OBJECT_NAME": "name", "OWNER": "country",
    "OBJECT_TYPE": "object_type",
}
_CSV_NUMBERS = {
    "RCS": "rcs_m2", "PERIOD": "period_min", "INCLINATION": "inclination",
    "APOGEE": "apogee_km", "PERIGEE": "perigee_km",
}


def read_satcat_csv(spark: SparkSession, path, columns: list[str] | None = None) -> DataFrame:
    """Catalogue rows of CSV files with a header; rows without a number drop out.

    Columns are matched by header name; numbers that do not parse become NULL.
    """
    raw = spark.read.csv(path, header=True, inferSchema=False, columnNameOfCorruptRecord="_bad")
    has = lambda c: F.col(c) if c in raw.columns else F.lit(None).cast("string")
    cast = lambda c, kind: has(c).try_cast(kind)
    return raw.select(
        cast("NORAD_CAT_ID", "long").alias("norad_id"),
        *[has(c).alias(name) for c, name in _CSV.items()],
        cast("LAUNCH_DATE", "date").alias("launch_date"),
        cast("DECAY_DATE", "date").alias("decay_date"),
        *[cast(c, "double").alias(name) for c, name in _CSV_NUMBERS.items()],
    ).where(F.col("norad_id").isNotNull()).select(
        *[c for c in schemas.SATCAT.names if c != "updated_at"])
