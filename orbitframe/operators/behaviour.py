"""Pattern of life: campaigns, baselines, deviations and change-points.

Campaigns of one object are more than ``gap_days`` apart, so an object has at
most one campaign per day of its recorded life. Windows over the campaigns of
one object are therefore bounded by time, whatever the number of element sets.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from orbitframe import constants as K
from orbitframe.functions import orbits
from orbitframe.operators.skew import array_stats


def campaigns(events: DataFrame, gap_days: float = K.CAMPAIGN_GAP_DAYS,
              tie: list[str] = ()) -> DataFrame:
    """Sessionise flagged events; an exact gap of ``gap_days`` still joins.

    Session windows merge inside map tasks before the shuffle. The peak is the
    largest burn, the first one on ties.
    """
    seconds = int(gap_days * 86400)
    peak = F.struct(F.col("dv_ms"), (-F.unix_micros("epoch")).alias("_t"),
                    *[(-F.col(c)).alias(f"_{c}") for c in tie])
    grouped = events.groupBy(
        "norad_id", F.session_window("epoch", f"{seconds} seconds").alias("_w")).agg(
        F.min("epoch").alias("start_epoch"), F.max("epoch").alias("end_epoch"),
        F.max("dv_ms").alias("peak_dv_ms"), F.max_by("epoch", peak).alias("peak_epoch"),
        F.count("*").alias("n_pulses"))
    return grouped.drop("_w")


def _in_order() -> Window:
    return Window.partitionBy("norad_id").orderBy("start_epoch")


def with_tempo(camps: DataFrame) -> DataFrame:
    """Days since the object's previous campaign (NULL for its first)."""
    return camps.withColumn("tempo_days", orbits.days_between(
        F.col("start_epoch"), F.lag("start_epoch").over(_in_order())))


_BASELINE = ["n_campaigns", "typical_dv_ms", "dv_mad_ms", "typical_tempo_days", "tempo_mad_days"]


def _histories(camps: DataFrame, min_campaigns: int) -> DataFrame:
    """One row for each object with enough campaigns: its baseline and, in ``_cs``, its campaigns."""
    rest = [c for c in camps.columns if c not in ("norad_id", "start_epoch")]
    one = camps.groupBy("norad_id").agg(F.array_sort(F.collect_list(
        F.struct("start_epoch", *rest))).alias("_cs")).where(F.size("_cs") >= min_campaigns)
    tempo = lambda c, i: F.when(i > 0, orbits.days_between(
        c["start_epoch"], F.get(F.col("_cs"), i - 1)["start_epoch"]))
    timed = one.withColumn("_cs", F.transform("_cs", lambda c, i: c.withField(
        "tempo_days", tempo(c, i))))
    burns = array_stats(timed, F.col("_cs.peak_dv_ms"), "n_campaigns", "typical_dv_ms", "dv_mad_ms")
    both = array_stats(burns, F.col("_cs.tempo_days"), "_n", "typical_tempo_days", "tempo_mad_days")
    return both.where((F.col("n_campaigns") >= min_campaigns) & (F.col("_n") > 0)).drop("_n")


def campaign_baseline(camps: DataFrame, min_campaigns: int = K.MIN_CAMPAIGNS) -> DataFrame:
    """Typical burn size and tempo of each object with enough campaigns."""
    return _histories(camps, min_campaigns).select("norad_id", *_BASELINE)


def _sigma(mad: str, typical: str) -> Column:
    return F.greatest(F.col(mad) * K.MAD_TO_SIGMA, F.col(typical) * K.RELATIVE_SIGMA,
                      F.lit(K.SIGMA_FLOOR))


def classify_campaigns(camps: DataFrame, min_campaigns: int = K.MIN_CAMPAIGNS) -> DataFrame:
    """Each campaign against the object's own baseline: routine or anomalous."""
    timed = _histories(camps, min_campaigns).select("norad_id", *_BASELINE, F.inline("_cs"))
    scored = timed.withColumns({
        "dv_z": (F.col("peak_dv_ms") - F.col("typical_dv_ms"))
        / _sigma("dv_mad_ms", "typical_dv_ms"),
        "tempo_z": (F.col("tempo_days") - F.col("typical_tempo_days"))
        / _sigma("tempo_mad_days", "typical_tempo_days")})
    odd_burn = F.abs("dv_z") >= K.Z_ANOMALOUS
    odd_tempo = F.coalesce(F.abs("tempo_z") >= K.Z_ANOMALOUS, F.lit(False))
    return scored.withColumns({
        "label": F.when(odd_burn | odd_tempo, "anomalous").otherwise("routine"),
        "reasons": F.array_compact(F.array(
            F.when(odd_burn, F.format_string(
                "burn of %.2f m/s, %+.1f sigma off", F.col("peak_dv_ms"), F.col("dv_z"))),
            F.when(odd_tempo, F.format_string(
                "%.1f days after the previous campaign, usually %.1f",
                F.col("tempo_days"), F.col("typical_tempo_days")))))})


def best_split(series: DataFrame, keys: list[str], order: str, value: str,
               min_side: int = K.MIN_SIDE) -> DataFrame:
    """Split of each series that maximises the pooled two-sample t.

    Columns: keys, k (rows before the split), t_stat, before_mean, after_mean,
    split_at (order value of the first row after it). First split on ties.
    """
    whole = Window.partitionBy(*keys)
    before = whole.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    # running sums of values shifted by the series mean: linear in the series
    # length and free of cancellation
    v = F.col("_x")
    rows = series.where(F.col(value).isNotNull()).withColumn("_mean", F.avg(value).over(whole))
    rows = rows.withColumn("_x", F.col(value) - F.col("_mean"))
    cut = rows.select(
        *keys, F.col(order).alias("split_at"), "_mean",
        F.count(v).over(before).alias("k"), F.sum(v).over(before).alias("_s"),
        F.sum(v * v).over(before).alias("_q"), F.count(v).over(whole).alias("_n"),
        F.sum(v).over(whole).alias("_ts"), F.sum(v * v).over(whole).alias("_tq"))
    cut = cut.withColumns({"m": F.col("_n") - F.col("k"), "_rs": F.col("_ts") - F.col("_s"),
                           "_rq": F.col("_tq") - F.col("_q")})
    cut = cut.where((F.col("k") >= min_side) & (F.col("m") >= min_side))
    scatter = lambda q, s, n: F.col(q) - F.col(s) * F.col(s) / F.col(n)
    pooled = (scatter("_q", "_s", "k") + scatter("_rq", "_rs", "m")) / (F.col("_n") - 2)
    cut = cut.withColumns({"before_mean": F.col("_mean") + F.col("_s") / F.col("k"),
                           "after_mean": F.col("_mean") + F.col("_rs") / F.col("m")})
    spread = F.sqrt(F.greatest(pooled, F.lit(K.VARIANCE_FLOOR))) * F.sqrt(
        1 / F.col("k") + 1 / F.col("m"))
    cut = cut.withColumn("t_stat", F.abs(F.col("before_mean") - F.col("after_mean")) / spread)
    body = F.struct("k", "t_stat", "before_mean", "after_mean", "split_at")
    return cut.groupBy(*keys).agg(
        F.max_by(body, F.struct(F.col("t_stat"), -F.col("k"))).alias("_b")).select(*keys, "_b.*")


def changepoints(camps: DataFrame, t_threshold: float = K.T_THRESHOLD) -> DataFrame:
    """The stronger of the burn-size and tempo shifts of each object.

    A tempo value belongs to the campaign that ends the gap, so its split
    points at that campaign. On equal strength burn size wins.
    """
    series = with_tempo(camps).select("norad_id", "start_epoch", F.inline(F.array(*[
        F.struct(F.lit(name).alias("metric"), F.lit(rank).alias("_rank"), F.col(column).alias("value"))
        for column, name, rank in (("peak_dv_ms", "burn size", 1), ("tempo_days", "tempo", 0))])))
    both = best_split(series, ["norad_id", "metric", "_rank"], "start_epoch", "value")
    body = F.struct("metric", "split_at", "before_mean", "after_mean", "t_stat")
    best = both.groupBy("norad_id").agg(
        F.max_by(body, F.struct("t_stat", "_rank")).alias("_b")).select("norad_id", "_b.*")
    return best.where(F.col("t_stat") >= t_threshold).select(
        "norad_id", F.col("split_at").alias("epoch"), "metric", "before_mean", "after_mean",
        F.when(F.col("after_mean") > F.col("before_mean"), "increased")
        .otherwise("decreased").alias("direction"), "t_stat")
