"""Everything known about each object, and the ranked board.

Two kinds of tables stand behind a dossier. What follows from an object's own element sets is one
row of the object table (:func:`object_table`), which is kept: new sets change the rows of their
objects only (:func:`refreshed`). What lies between objects, the nearest asset and the proximity
assessment, is derived from the latest sets. Dossiers and the board read these tables.
"""

from pyspark.sql import Column, DataFrame, functions as F

from orbitframe.operators import (
    actions, behaviour, catalog, decay, elements as el, maneuver, proximity, score, trajectory)
from orbitframe.sources.landing import landed


def object_table(element_sets: DataFrame, residuals: DataFrame | None = None) -> DataFrame:
    """One row for each object with element sets: all that follows from its own sets.

    Every step that is read more than once is landed, so no plan holds another step's shuffles.
    ``residuals`` is the result of :func:`maneuver.pair_residuals` when it is already there.
    """
    latest = landed(el.classify_regime(el.mean_elements(catalog.latest_per_object(element_sets))))
    residuals = landed(maneuver.pair_residuals(element_sets) if residuals is None else residuals)
    floors = landed(maneuver.noise_floor(residuals))
    flagged = landed(maneuver.detect_maneuvers(residuals, floors=floors))
    camps = landed(behaviour.campaigns(flagged))
    odd = F.col("label") == "anomalous"
    pattern = behaviour.classify_campaigns(camps).groupBy("norad_id").agg(
        *[F.first(c).alias(c) for c in ("n_campaigns", "typical_dv_ms", "dv_mad_ms",
                                        "typical_tempo_days", "tempo_mad_days")],
        F.count_if(odd).alias("n_anomalous"), F.avg(odd.cast("double")).alias("anomalous_rate"))
    change = behaviour.changepoints(camps).select("norad_id", F.struct(
        "metric", "direction", F.col("before_mean").alias("before"),
        F.col("after_mean").alias("after"),
        F.when(F.col("metric") == "burn size", "m/s").otherwise("days").alias("unit"),
        "epoch", "t_stat").alias("changepoint"))
    burns = flagged.groupBy("norad_id").agg(
        F.count("*").alias("n_maneuvers"), F.max("epoch").alias("last_maneuver_epoch"))
    perigees = el.mean_elements(element_sets).select("norad_id", "epoch", "perigee_km")
    fall = decay.predict_decay(perigees).where(F.col("reentry_at").isNotNull()).select(
        "norad_id", "latest_perigee_km", "decay_rate", "days_to_reentry",
        F.col("reentry_at").alias("decay_reentry"), F.col("model").alias("decay_model"))
    disposal = el.assess_disposal(latest.where(F.col("primary").isin("GEO", "GRAVEYARD"))).select(
        "norad_id", "disposal_status", "km_above_geo", "compliant")
    sensitivity = score.regime_sensitivity(latest).select("norad_id", "regime_sensitivity")
    counts = element_sets.groupBy("norad_id").agg(F.count("*").alias("n_sets"))
    table = latest.select(
        "norad_id", *trajectory.ELEMENTS, "perigee_km", "apogee_km", "period_min", "primary",
        "special_tags", "label", "explanation")
    for part in (counts, score.maneuver_activity(floors, flagged), burns, pattern, change, fall,
                 disposal, sensitivity):
        table = table.join(landed(part), "norad_id", "left")
    return landed(table.withColumn("n_maneuvers", F.coalesce("n_maneuvers", F.lit(0))))


def refreshed(table: DataFrame, element_sets: DataFrame, touched: DataFrame) -> DataFrame:
    """The object table after sets of the objects in ``touched`` arrived or went.

    Only these objects' histories are read again; the result equals a new :func:`object_table`.
    """
    ids = touched.select("norad_id").distinct()
    fresh = object_table(element_sets.join(ids, "norad_id", "left_semi"))
    return table.join(ids, "norad_id", "left_anti").unionByName(fresh)


def dossiers(element_sets: DataFrame, satcat: DataFrame, events: DataFrame, as_of,
             residuals: DataFrame | None = None, table: DataFrame | None = None) -> DataFrame:
    """One row for each object that is catalogued or has element sets.

    Sections that need data an object does not have are NULL; without element sets that is all but
    its name, and nothing is recommended. ``table`` is the object table when it is kept already.
    Nearly every step reads the element sets, so these are landed.
    """
    # targets that are listed first alike keep the order of the sets as they come
    targets = landed(proximity.known_targets(events, element_sets))
    element_sets = landed(element_sets)
    own = object_table(element_sets, residuals) if table is None else table
    assets = own.join(catalog.high_value_assets(element_sets, satcat), "norad_id")
    nearest = landed(score.proximity_to_assets(own, landed(assets), as_of))
    samples = landed(trajectory.pair_samples(trajectory.aligned_pairs(targets, element_sets)))
    met = landed(proximity.rpo_summary(samples, satcat).select(
        F.col("actor").alias("norad_id"), F.col("target").alias("rpo_target"),
        F.col("label").alias("rpo_label"), F.col("min_range_km").alias("rpo_min_range_km"),
        F.col("n_episodes").alias("rpo_episodes"),
        F.col("total_close_days").alias("rpo_close_days"), "same_launch_lineage"))
    has_sets = F.col("n_sets").isNotNull()
    names = score.attribution(satcat).select("norad_id", "name", "decay_date", "attribution")
    df = names.join(own, "norad_id", "full_outer").join(nearest, "norad_id", "left").join(
        met, "norad_id", "left")
    df = score.combine_factors(df.withColumn("attribution", F.when(has_sets, F.col("attribution"))))
    df = df.withColumns({
        "name": F.coalesce("name", F.concat(F.lit("NORAD "), F.col("norad_id").cast("string"))),
        "decayed": F.col("decay_date").isNotNull(), "has_sets": has_sets,
        "n_sets": F.coalesce("n_sets", F.lit(0)),
        "n_maneuvers": F.coalesce("n_maneuvers", F.lit(0)),
        "threat_score": F.col("score"), "threat_band": score.orbits.threat_band(F.col("score"))})
    df = actions.recommend_actions(df)
    known = F.col("has_sets")
    return actions.response_posture(df.withColumns({
        "actions": F.when(known, F.col("actions")).otherwise(F.slice("actions", 1, 0)),
        "top_action": F.when(known, F.col("top_action")),
        "top_urgency": F.when(known, F.col("top_urgency"))}))


def threat_board(dossier: DataFrame, featured: DataFrame) -> DataFrame:
    """Featured objects by score with their leading action."""
    return dossier.where(F.col("threat_score").isNotNull()).join(
        featured.select("norad_id"), "norad_id", "left_semi").select(
        "norad_id", "name", "threat_score", F.col("label").alias("regime"), "top_action",
        "top_urgency").orderBy(F.desc("threat_score"), "norad_id")


def _present(key: str, struct: Column) -> Column:
    return F.when(F.col(key).isNotNull(), struct)


def dossier_json(dossier: DataFrame) -> DataFrame:
    """(norad_id, document): the nested document of each object as JSON text.

    Absent sections are null, not left out.
    """
    c = F.col
    sets = lambda struct: F.when(c("has_sets"), struct)
    body = F.struct(
        "norad_id", "name", "decayed", F.date_format("decay_date", "yyyy-MM-dd").alias("decay_date"),
        c("has_sets").alias("has_tle"),
        sets(F.struct("primary", "special_tags", "label", "period_min")).alias("regime"),
        sets(F.struct("perigee_km", "apogee_km", c("incl_deg").alias("inclination_deg"),
                      c("ecc").alias("eccentricity"), "period_min")).alias("elements"),
        sets(F.struct(c("score").alias("score"), c("n_factors").alias("factors_available"),
                      F.lit(len(score.FACTORS)).alias("factors_total"),
                      score.factor_list(nearest=True).alias("factors"))).alias("threat"),
        "n_maneuvers",
        _present("rpo_label", F.struct(
            c("rpo_label").alias("label"), c("rpo_min_range_km").alias("min_range_km"),
            c("rpo_episodes").alias("n_episodes"), c("rpo_close_days").alias("total_close_days"),
            c("rpo_target").alias("target_norad"), "same_launch_lineage")).alias("rpo"),
        _present("decay_reentry", F.struct(
            c("latest_perigee_km").alias("perigee_km"),
            c("decay_rate").alias("decay_rate_km_per_day"),
            c("decay_reentry").alias("predicted_reentry"), "days_to_reentry",
            c("decay_model").alias("model"))).alias("decay"),
        _present("disposal_status", F.struct(
            c("disposal_status").alias("status"), "km_above_geo", "compliant")).alias("disposal"),
        "changepoint",
        F.transform("actions", lambda a: F.struct(
            a["title"].alias("title"), a["category"].alias("category"),
            a["urgency"].alias("urgency"), a["rationale"].alias("rationale"))).alias("mitigations"))
    return dossier.select("norad_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("document"))
