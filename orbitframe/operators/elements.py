"""Element ladders: mean elements, regimes, special orbits, disposal."""

from pyspark.sql import DataFrame, functions as F

from orbitframe import constants as K
from orbitframe.functions import orbits


def mean_elements(df: DataFrame) -> DataFrame:
    """Shape of the orbit from mean motion and eccentricity."""
    n, a, e = F.col("mean_motion_rad_s"), F.col("semi_major_km"), F.col("ecc")
    return (
        df.withColumn("mean_motion_rad_s", orbits.mean_motion_rad_s(F.col("revs_per_day")))
        .withColumn("semi_major_km", orbits.semi_major_km(n))
        .withColumns({
            "apogee_km": a * (1 + e) - K.R_EARTH_KM,
            "perigee_km": a * (1 - e) - K.R_EARTH_KM,
            "period_min": orbits.period_min(n)})
        .withColumn("regime", orbits.coarse_regime(
            F.col("apogee_km"), F.col("perigee_km"), F.col("incl_deg"), e))
    )


def coarse_regime(df: DataFrame) -> DataFrame:
    return df.withColumn("regime", orbits.coarse_regime(
        F.col("apogee_km"), F.col("perigee_km"), F.col("incl_deg"), F.col("ecc")))


def special_orbit_tags(df: DataFrame) -> DataFrame:
    return df.withColumn("special_tags", orbits.special_orbit_tags(
        F.col("semi_major_km"), F.col("ecc"), F.col("incl_deg"), F.col("apogee_km"),
        F.col("period_min")))


def classify_regime(df: DataFrame) -> DataFrame:
    """Physics-based regime with tags, a label and the deciding reason."""
    rules = orbits.regime_ladder(F.col("apogee_km"), F.col("perigee_km"), F.col("ecc"),
                                 F.col("incl_deg"), F.col("period_min"))
    primary = orbits.first_match([(cond, F.lit(name)) for name, cond, _ in rules])
    reason = orbits.first_match([(F.col("primary") == name, why) for name, _, why in rules])
    tags = F.array_join("special_tags", ", ")
    tagged = F.size("special_tags") > 0
    return special_orbit_tags(df).withColumn("primary", primary).withColumns({
        "label": F.when(tagged, F.concat("primary", F.lit(" ["), tags, F.lit("]")))
        .otherwise(F.col("primary")),
        "explanation": F.concat_ws("; ", reason, F.when(tagged, F.format_string(
            "inclination %.1f deg gives %s", F.col("incl_deg"), tags)))})


def assess_disposal(classified: DataFrame) -> DataFrame:
    """Geostationary-belt disposal status; compliance is NULL where it does not apply."""
    status = orbits.disposal_status(
        F.col("primary"), F.col("apogee_km"), F.col("perigee_km"), F.col("ecc"),
        F.col("incl_deg"), F.col("period_min"))
    verdict = orbits.first_match([
        (F.col("disposal_status") == name, F.lit(ok))
        for name, ok in orbits.DISPOSAL_COMPLIANT.items() if ok is not None])
    return (
        classified.withColumns({
            "disposal_status": status,
            "km_above_geo": F.col("perigee_km") - K.GEO_ALTITUDE_KM})
        .withColumn("compliant", verdict)
    )


def disposal_scan(elements: DataFrame) -> DataFrame:
    """Objects per disposal status."""
    return assess_disposal(classify_regime(elements)).groupBy("disposal_status").agg(
        F.count("*").alias("n_objects"))


def disposal_flagged(elements: DataFrame) -> DataFrame:
    """Non-compliant objects, deepest below the belt first."""
    broken = [name for name, ok in orbits.DISPOSAL_COMPLIANT.items() if ok is False]
    assessed = assess_disposal(classify_regime(elements))
    return assessed.where(F.col("disposal_status").isin(broken)).select(
        "norad_id", "disposal_status", "km_above_geo", "incl_deg").orderBy("km_above_geo")


def regime_counts(objects: DataFrame, column: str = "regime") -> DataFrame:
    return objects.groupBy(column).agg(F.count("*").alias("n_objects"))
