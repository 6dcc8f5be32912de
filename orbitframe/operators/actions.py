"""Recommended space-safety responses and the posture they add up to."""

from pyspark.sql import Column, DataFrame, functions as F

from orbitframe.functions.orbits import first_match, format_range
from orbitframe.operators.catalog import URGENCY_RANK, urgency_rank

# fixed values: action id -> category
CATEGORY = {
    "persistent_custody": "tracking",
    "elevate_cadence": "tracking",
    "confirm_deployment": "characterization",
    "notify_operator": "collision-avoidance",
    "characterize_unknown": "characterization",
    "maneuver_watchlist": "monitoring",
    "disposal_followup": "policy",
    "reentry_monitoring": "monitoring",
    "routine_custody": "tracking",
}
TITLE = {
    "persistent_custody": "Keep the object in continuous custody",
    "elevate_cadence": "Observe the object more often",
    "confirm_deployment": "Check for a deployment first",
    "notify_operator": "Inform the other operator and plan avoidance",
    "characterize_unknown": "Characterise the object",
    "maneuver_watchlist": "Watch for the next unusual manoeuvre",
    "disposal_followup": "Follow up on disposal",
    "reentry_monitoring": "Monitor the re-entry",
    "routine_custody": "Routine custody",
}
# category -> name and description of its public channel
CHANNEL = {
    "collision-avoidance": ("Conjunction messages", "conjunction data messages between operators and "
                            "screening providers"),
    "policy": ("Guidelines and registry", "debris-mitigation guidelines and the registration of space "
               "objects"),
    "characterization": ("Sensor network", "tasking of a sensor network"),
    "monitoring": ("Watch service", "standing watch items and re-entry campaigns"),
    "tracking": ("Catalogue service", "the cataloguing authority's tracking service"),
}


def _action(name: str, urgency: Column | str, why: Column) -> Column:
    level = F.lit(urgency) if isinstance(urgency, str) else urgency
    return F.struct(
        F.lit(name).alias("action_id"), F.lit(TITLE[name]).alias("title"),
        F.lit(CATEGORY[name]).alias("category"), level.alias("urgency"), why.alias("rationale"))


def recommend_actions(dossier: DataFrame) -> DataFrame:
    """Add the ranked ``actions`` array and the leading action.

    Reads maneuver_activity, anomalous_rate, proximity_to_hva, attribution,
    rpo_label, rpo_min_range_km, rpo_close_days, same_launch_lineage,
    disposal_status, compliant, km_above_geo, days_to_reentry, decay_rate.
    An action needs the values that justify it; routine custody is the floor.
    """
    c = F.col
    active, near = c("maneuver_activity"), c("proximity_to_hva")
    custody = F.coalesce((active >= 0.5) & (near >= 0.4), F.lit(False))
    meeting = c("rpo_label").isin("likely", "possible")
    sibling = F.coalesce(c("same_launch_lineage"), F.lit(False))
    days = c("days_to_reentry")
    pace = F.when(days < 30, "priority").when(days < 120, "elevated").otherwise("routine")
    text = F.format_string
    rules = [
        F.when(custody, _action("persistent_custody", "priority", text(
            "manoeuvres (%.2f) near a high-value asset (%.2f)", active, near))),
        F.when(~custody & (near >= 0.6), _action("elevate_cadence", "elevated", text(
            "near a high-value asset (%.2f)", near))),
        F.when(meeting & sibling, _action("confirm_deployment", "elevated", F.concat(
            F.lit("close approach at "), format_range(c("rpo_min_range_km")),
            F.lit(" between objects of one launch")))),
        F.when(meeting & ~sibling, _action("notify_operator", "priority", F.concat(
            F.lit("close approach at "), format_range(c("rpo_min_range_km")),
            text(", %.0f days close", c("rpo_close_days"))))),
        F.when(c("attribution") >= 0.5, _action("characterize_unknown", "elevated", F.lit(
            "owner or type is not catalogued"))),
        F.when(c("anomalous_rate") >= 0.3, _action("maneuver_watchlist", "elevated", text(
            "%.0f%% of campaigns leave the usual pattern", c("anomalous_rate") * 100))),
        F.when(~c("compliant"), _action("disposal_followup", "elevated", text(
            "%s at %+.0f km from the belt", c("disposal_status"), c("km_above_geo")))),
        F.when(days.isNotNull(), _action("reentry_monitoring", pace, text(
            "losing %.2f km a day, about %.0f days left", c("decay_rate"), days))),
    ]
    floor = F.array(_action("routine_custody", "routine", F.lit("no elevated indicator")))
    found = F.array_compact(F.array(*rules))
    # stable order: urgency first, rule order within it
    level = lambda name: F.filter("_found", lambda a: a["urgency"] == name)
    ranked = F.concat(*[level(name) for name in URGENCY_RANK])
    return (
        dossier.withColumn("_found", F.when(F.size(found) > 0, found).otherwise(floor))
        .withColumn("actions", ranked)
        .withColumns({"top_action": F.col("actions")[0]["action_id"],
                      "top_urgency": F.col("actions")[0]["urgency"]})
        .drop("_found")
    )


def response_posture(with_actions: DataFrame) -> DataFrame:
    """Overall level and the public coordination channels that apply."""
    categories = F.array_distinct(F.transform("actions", lambda a: a["category"]))
    channel = lambda k, i: first_match([(k == c, F.lit(text[i])) for c, text in CHANNEL.items()])
    rank = F.coalesce(F.array_max(F.transform("actions", lambda a: urgency_rank(a["urgency"]))),
                      F.lit(1))
    level = first_match([(rank == r, F.lit(name)) for name, r in URGENCY_RANK.items()])
    return with_actions.withColumns({
        "posture": level,
        "channels": F.transform(categories, lambda k: F.struct(
            k.alias("category"), channel(k, 0).alias("name"), channel(k, 1).alias("description")))})
