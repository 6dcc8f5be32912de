"""Watch cycles: state differences, population findings, persistence."""

from pyspark.sql import Column, DataFrame, functions as F

from orbitframe import constants as K
from orbitframe.functions.orbits import days_between, first_match, format_range
from orbitframe.operators.breakup import breakups_from_delta
from orbitframe.operators.catalog import snapshot_delta, urgency_rank
from orbitframe.sources.landing import landed

STATE = ["threat_score", "threat_band", "last_maneuver_epoch", "n_maneuvers", "rpo_label",
         "rpo_min_range_km", "decay_reentry", "disposal_status"]
_BANDS = ("low", "moderate", "high")


def object_states(dossiers: DataFrame) -> DataFrame:
    """The diffable columns of each object."""
    return dossiers.select("norad_id", "name", *STATE)


def _finding(kind: Column | str, level: Column | str, text: Column) -> Column:
    col = lambda v: F.lit(v) if isinstance(v, str) else v
    return F.struct(col(kind).alias("kind"), col(level).alias("significance"),
                    text.alias("summary"))


def finding_list(as_of: Column) -> Column:
    """Findings of one row holding structs ``prev`` and ``cur``; array column."""
    p, c = (lambda k: F.col(f"prev.{k}")), (lambda k: F.col(f"cur.{k}"))
    name = F.coalesce(c("name"), c("norad_id").cast("string"))
    say = lambda *parts: F.concat(name, F.lit(": "), *[
        F.lit(x) if isinstance(x, str) else x for x in parts])
    order = lambda band: first_match([(band == b, F.lit(i)) for i, b in enumerate(_BANDS)])
    day = lambda column: F.date_format(column, "yyyy-MM-dd")

    rose = order(c("threat_band")) > order(p("threat_band"))
    score = F.coalesce(F.format_string(" (score %.0f)", c("threat_score")), F.lit(""))
    band = F.when(
        c("threat_band") != p("threat_band"),
        _finding(F.when(rose, "threat_up").otherwise("threat_down"),
                 F.when(rose & (c("threat_band") == "high"), "priority").when(rose, "elevated")
                 .otherwise("routine"),
                 say("score band ", p("threat_band"), " to ", c("threat_band"),
                     F.when(c("threat_score").isNotNull(), score).otherwise(""))))

    count = lambda v: F.coalesce(v("n_maneuvers"), F.lit(0))
    burn = F.when(
        (c("last_maneuver_epoch") > p("last_maneuver_epoch")) & (count(c) > count(p)),
        _finding("new_maneuver", "elevated", say(
            (count(c) - count(p)).cast("string"), " more manoeuvres, last on ",
            day(c("last_maneuver_epoch")))))

    meets = c("rpo_label").isin("likely", "possible")
    met = F.coalesce(p("rpo_label").isin("likely", "possible"), F.lit(False))
    started = F.when(meets & ~met, _finding(
        "new_rpo", F.when(c("rpo_label") == "likely", "priority").otherwise("elevated"),
        say("proximity operations ", c("rpo_label"), ", closest ",
            format_range(c("rpo_min_range_km")))))
    closer = F.when(
        meets & met & (c("rpo_min_range_km") < p("rpo_min_range_km") * K.CLOSER_FRACTION),
        _finding("rpo_closer", "priority", say(
            "range ", format_range(p("rpo_min_range_km")), " to ",
            format_range(c("rpo_min_range_km")))))

    left = days_between(c("decay_reentry"), as_of)
    decay = F.when(
        c("decay_reentry").isNotNull() & p("decay_reentry").isNull(),
        _finding("new_decay", F.when(left < K.IMMINENT_DAYS, "priority").otherwise("elevated"),
                 say("re-entry predicted for ", day(c("decay_reentry")))))

    disposal = F.when(
        c("disposal_status") != p("disposal_status"),
        _finding("disposal_change",
                 F.when(c("disposal_status").isin("NON_COMPLIANT_SHALLOW", "BELOW_GEO_DRIFT"),
                        "elevated").otherwise("routine"),
                 say("disposal ", p("disposal_status"), " to ", c("disposal_status"))))
    return F.array_compact(F.array(band, burn, started, closer, decay, disposal))


def diff_states(previous: DataFrame, current: DataFrame, as_of: Column) -> DataFrame:
    """Findings between two state tables; an object seen first yields none."""
    pack = lambda df, alias: df.select("norad_id", F.struct("norad_id", "name", *STATE).alias(alias))
    both = pack(previous, "prev").join(pack(current, "cur"), "norad_id")
    return both.select("norad_id", F.posexplode(finding_list(as_of)).alias("seq", "f")).select(
        "norad_id", "seq", "f.*")


def population_findings(snapshots: DataFrame, satcat: DataFrame, **skew) -> DataFrame:
    """New debris clouds since the previous snapshot, as priority findings.

    The new objects are landed: several steps read them.
    """
    clouds = breakups_from_delta(landed(snapshot_delta(snapshots)), satcat, **skew)
    return clouds.select(
        F.col("parent_norad_id").alias("norad_id"), F.lit(0).alias("seq"),
        F.lit("fragmentation").alias("kind"), F.lit("priority").alias("significance"),
        F.format_string("launch %s: %d fragments, confidence %s", "launch_prefix",
                        "n_fragments", "confidence").alias("summary"))


def ranked(findings: DataFrame) -> DataFrame:
    """Most significant first."""
    return findings.orderBy(F.desc(urgency_rank(F.col("significance"))), "norad_id", "seq")


def merge_states(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Latest state per object: the new one where there is one."""
    kept = previous.join(current.select("norad_id"), "norad_id", "left_anti")
    return current.select("norad_id", "name", *STATE).unionByName(
        kept.select("norad_id", "name", *STATE))


def watch_cycle(previous: DataFrame, current: DataFrame, watch_list: DataFrame,
                snapshots: DataFrame, satcat: DataFrame, cycle_id: int, run_at,
                refreshed: bool = False) -> dict[str, DataFrame]:
    """One cycle: the tables to persist. The findings are landed, the others are lazy.

    ``states`` holds the latest state of every object ever watched (see :func:`orbitframe.sources.store.save_cycle`).
    """
    as_of = F.lit(run_at).cast("timestamp")
    watched = current.join(watch_list.select("norad_id"), "norad_id", "left_semi")
    findings = landed(diff_states(previous, watched, as_of).unionByName(
        population_findings(snapshots, satcat)).withColumn("cycle_id", F.lit(cycle_id).cast("long")))
    cycle = findings.agg(F.count("*").alias("n_findings")).select(
        F.lit(cycle_id).cast("long").alias("cycle_id"), as_of.alias("run_at"),
        F.lit(refreshed).alias("refreshed"), "n_findings")
    states = merge_states(previous, watched).withColumn("cycle_id", F.lit(cycle_id).cast("long"))
    return {"findings": ranked(findings), "cycle": cycle, "states": states}


def latest_cycles(cycles: DataFrame, n: int = 20) -> DataFrame:
    return cycles.orderBy(F.desc("cycle_id")).limit(n)


def cycle_findings(cycles: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings of the newest cycle."""
    last = cycles.agg(F.max("cycle_id")).scalar()
    return findings.where(F.col("cycle_id") == last)


def watchlist_changes(watch_list: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply a change table (norad_id, at, action, note) to the list.

    The last change per object wins; ``add`` to a listed object only updates
    its note, ``remove`` drops it. An object removed and added again within
    one batch starts a new entry.
    """
    order = F.struct("at", "action")
    last = changes.groupBy("norad_id").agg(
        F.max_by(F.struct("action", "at", "note"), order).alias("_c"),
        F.max(F.when(F.col("action") == "remove", F.col("at"))).alias("_removed"),
        )
    first_add = changes.join(last.select("norad_id", "_removed"), "norad_id").where(
        (F.col("action") == "add") & (F.col("_removed").isNull() | (F.col("at") > F.col("_removed")))
    ).groupBy("norad_id").agg(F.min("at").alias("_added"))
    df = watch_list.select("norad_id", F.col("added_at").alias("_old_at"),
                           F.col("note").alias("_old_note"), F.lit(True).alias("_listed"))
    df = df.join(last, "norad_id", "full_outer").join(first_add, "norad_id", "left")
    stays = F.col("_c").isNull()
    added = F.col("_c.action") == "add"
    fresh = F.col("_listed").isNull() | F.col("_removed").isNotNull()
    return df.where(stays | added).select(
        "norad_id",
        F.when(added & fresh, F.col("_added")).otherwise(F.col("_old_at")).alias("added_at"),
        F.when(added, F.col("_c.note")).otherwise(F.col("_old_note")).alias("note"))


def is_watched(ids: DataFrame, watch_list: DataFrame) -> DataFrame:
    marks = watch_list.select("norad_id").distinct().withColumn("_w", F.lit(True))
    return ids.join(marks, "norad_id", "left").withColumn(
        "watched", F.coalesce("_w", F.lit(False))).drop("_w")
