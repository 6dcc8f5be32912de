"""Report facts and the numeric verification of texts against them."""

from pyspark.sql import Column, DataFrame, functions as F

from orbitframe import constants as K

# (?U): digits, white space and word borders as Unicode defines them
_UNICODE = "(?U)"
# white space of Unicode (fixed values)
_BLANKS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
           "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
_UNSIGNED = r"\d+\.?\d*"
_SIGNED = r"-?\d+\.?\d*"


# ---------------------------------------------------------------- facts
def _fact(key, label, unit="", number: Column | None = None,
          text: Column | None = None) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    value = F.lit(None).cast("double") if number is None else number.cast("double")
    words = F.lit(None).cast("string") if text is None else text.cast("string")
    return F.struct(as_col(key).alias("key"), value.alias("num_value"), words.alias("str_value"),
                    F.lit(unit).alias("unit"), as_col(label).alias("label"))


def _long(df: DataFrame, report: str, facts: list[Column]) -> DataFrame:
    """Fact structs to rows; facts without any value are dropped."""
    rows = df.select(F.col(report).cast("string").alias("report_id"),
                     F.explode(F.array(*facts)).alias("f")).select("report_id", "f.*")
    return rows.where(F.col("num_value").isNotNull() | F.col("str_value").isNotNull())


def _iso(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def facts_from_maneuvers(events: DataFrame, report: str = "norad_id") -> DataFrame:
    """Size, direction, confidence and z of every event, keyed by its epoch.

    The event's own epoch numbers it, so no ordering over a whole object is
    needed.
    """
    stamp = _iso("epoch")
    key = lambda what: F.concat(F.lit("maneuver_"), stamp, F.lit(f"_{what}"))
    label = lambda what: F.concat(F.lit("manoeuvre "), stamp, F.lit(f" {what}"))
    return _long(events, report, [
        _fact(key("dv"), label("size"), " m/s", F.bround("dv_ms", 2)),
        _fact(key("direction"), label("direction"), text=F.col("direction")),
        _fact(key("confidence"), label("confidence"), text=F.col("confidence")),
        _fact(key("zscore"), label("z"), number=F.bround("zscore", 1))])


def facts_from_scores(scores: DataFrame, report: str = "norad_id") -> DataFrame:
    available = F.concat(F.col("n_factors").cast("string"), F.lit(f"/{len(K.FACTOR_WEIGHTS)}"))
    return _long(scores, report, [
        _fact("threat_score", "composite score", "/100", F.bround("score", 0)),
        _fact("threat_level", "score band", text=F.col("band")),
        _fact("threat_factors_available", "factors used", text=available),
        *[_fact(f"threat_factor_{f}", f"factor {f}", number=F.bround(f, 2))
          for f in K.FACTOR_WEIGHTS]])


def facts_from_proximity(summary: DataFrame, report: str = "actor") -> DataFrame:
    shared = F.when(F.col("same_launch_lineage"), F.lit("true"))
    return _long(summary, report, [
        _fact("rpo_label", "proximity label", text=F.col("label")),
        _fact("rpo_min_range", "minimum range", " km", F.bround("min_range_km", 3)),
        _fact("rpo_episodes", "close episodes", number=F.col("n_episodes")),
        _fact("rpo_total_close_days", "time close", " days", F.bround("total_close_days", 1)),
        _fact("rpo_coverage_start", "coverage start", text=_iso("coverage_start")),
        _fact("rpo_coverage_end", "coverage end", text=_iso("coverage_end")),
        _fact("rpo_same_launch", "same launch", text=shared)])


def facts_from_probability(pairs: DataFrame, report: str = "actor") -> DataFrame:
    return _long(pairs, report, [
        _fact("pc_estimate", "collision probability",
              text=F.format_string("%.2e", F.col("pc_estimate"))),
        _fact("pc_tca", "closest approach", text=F.date_format(
            "tca", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")),
        _fact("pc_min_range", "range at closest approach", " km", F.bround("min_range_km", 3)),
        _fact("pc_hard_body_radius", "summed radius", " m",
              F.bround(F.col("hard_body_radius_km") * 1000, 1))])


def facts_from_breakups(candidates: DataFrame, report: str = "launch_prefix") -> DataFrame:
    return _long(candidates, report, [
        _fact("breakup_n_fragments", "fragments", number=F.col("n_fragments")),
        _fact("breakup_confidence", "fragmentation confidence", text=F.col("confidence")),
        _fact("breakup_mean_inclination", "mean inclination", " deg",
              F.bround("mean_inclination_deg", 1))])


def facts_from_regimes(classified: DataFrame, report: str = "norad_id") -> DataFrame:
    base = _long(classified, report, [
        _fact("regime_primary", "regime", text=F.col("primary")),
        _fact("regime_period", "period", " min", F.bround("period_min", 0))])
    tags = classified.select(report, F.explode("special_tags").alias("_tag"))
    return base.unionByName(_long(tags, report, [
        _fact(F.concat(F.lit("regime_tag_"), F.lower("_tag")), "special orbit",
              text=F.col("_tag"))]))


def facts_from_decay(predictions: DataFrame, report: str = "norad_id") -> DataFrame:
    dated = F.col("days_to_reentry") > 0
    return _long(predictions, report, [
        _fact("decay_perigee", "perigee", " km", F.bround("latest_perigee_km", 0)),
        _fact("decay_rate", "perigee loss", " km/day", F.bround("decay_rate", 2)),
        _fact("decay_reentry_date", "re-entry date", text=F.when(dated, _iso("reentry_at"))),
        _fact("decay_days_to_reentry", "days left", " days",
              F.when(dated, F.bround("days_to_reentry", 0)))])


def facts_from_disposal(assessed: DataFrame, report: str = "norad_id") -> DataFrame:
    return _long(assessed, report, [
        _fact("disposal_status", "disposal status", text=F.col("disposal_status")),
        _fact("disposal_km_above_geo", "perigee from the belt", " km",
              F.bround("km_above_geo", 0))])


def facts_from_cycle(cycle: DataFrame, findings: DataFrame, report: str = "cycle_id") -> DataFrame:
    """Counts and finding texts of watch cycles; a quiet cycle has counts of zero.

    A finding without an object is keyed by the checksum of its text, so two of a kind differ.
    """
    counts = finding_counts(findings, report)
    joined = cycle.select(report, "run_at").join(counts, report, "left").fillna(
        0, ["n_findings", "priority", "elevated"])
    head = _long(joined, report, [
        _fact("cycle_run_at", "run time", text=_iso("run_at")),
        _fact("n_findings", "findings", number=F.col("n_findings")),
        _fact("n_priority", "priority findings", number=F.col("priority")),
        _fact("n_elevated", "elevated findings", number=F.col("elevated"))])
    body = _long(findings, report, [_fact(
        F.concat(F.lit("finding_"), F.col("kind"), F.lit("_"),
                 F.coalesce(F.col("norad_id").cast("string"), F.concat(
                     F.lit("population_"), F.crc32(F.col("summary").cast("binary"))))),
        F.concat(F.lit("finding, "), F.col("significance")), text=F.col("summary"))])
    return head.unionByName(body)


def finding_counts(findings: DataFrame, report: str = "cycle_id") -> DataFrame:
    """Findings per significance."""
    level = lambda name: F.count_if(F.col("significance") == name).alias(name)
    return findings.groupBy(report).agg(
        F.count("*").alias("n_findings"), level("priority"), level("elevated"), level("routine"))


# ---------------------------------------------------------------- pools
def fact_pools(facts: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Numbers a report may state: (report_id, pool, value).

    Measured values are ``tolerant``. Identifiers, numbers inside texts, units
    and object names (``names``: report_id, norad_id, name) are ``exact``.
    """
    numbers = facts.where(F.col("num_value").isNotNull()).select(
        "report_id", F.lit("tolerant").alias("pool"), F.col("num_value").alias("value"))
    found = lambda column, pattern: F.coalesce(
        F.regexp_extract_all(column, F.lit(pattern), 0), F.array().cast("array<string>"))
    inside = F.concat(found("str_value", _UNSIGNED), found("unit", _SIGNED))
    exact = facts.select("report_id", F.explode(inside).alias("_v"))
    if names is not None:
        own = F.concat(F.array(F.col("norad_id").cast("string")), found("name", _SIGNED))
        exact = exact.union(names.select("report_id", F.explode(own).alias("_v")))
    exact = exact.select("report_id", F.lit("exact").alias("pool"),
                         F.col("_v").cast("double").alias("value"))
    return numbers.union(exact).distinct()


# ---------------------------------------------------------------- texts
def split_sentences(texts: DataFrame) -> DataFrame:
    """(report_id, seq, sentence): cut after . ! ? followed by white space."""
    blank = F.lit(_BLANKS)
    parts = F.split(F.btrim("text", blank), _UNICODE + r"(?<=[.!?])\s+")
    return texts.select("report_id", F.posexplode(parts).alias("seq", "sentence")).select(
        "report_id", "seq", F.btrim("sentence", blank).alias("sentence")
    ).where(F.col("sentence") != "")


def number_strings(sentence: Column) -> Column:
    """Numbers of a sentence with identifiers and clock times masked out."""
    masked = F.regexp_replace(sentence, _UNICODE + K.IDENTIFIER_PATTERN, " ")
    masked = F.regexp_replace(masked, _UNICODE + K.CLOCK_PATTERN, " ")
    return F.regexp_extract_all(masked, F.lit(K.NUMBER_PATTERN), 0)


def numbers_in(sentences: DataFrame) -> DataFrame:
    """One row per number: (report_id, seq, pos, value).

    Only sentences with a digit go through the masking patterns.
    """
    return sentences.where(F.col("sentence").rlike("[0-9]")).select(
        "report_id", "seq", F.posexplode(number_strings(F.col("sentence"))).alias("pos", "_v")
    ).select("report_id", "seq", "pos", F.expr("try_cast(_v AS double)").alias("value")).where(
        F.col("value").isNotNull())


def _cell(value: Column) -> Column:
    """Non-decreasing integer cell: steps of 0.05 near zero, of 2 % beyond.

    Infinite values (numerals too large for a double) share the last cell.
    """
    size = F.abs(value)
    steps = F.when(size <= 2.5, F.floor(size / 0.05)).otherwise(
        F.lit(50) + F.floor(F.least(F.log(size / 2.5) / 0.02, F.lit(1e6))))
    return (F.signum(value) * steps).cast("long")


def unbacked_numbers(numbers: DataFrame, pools: DataFrame) -> DataFrame:
    """Numbers no pool backs: exact to 1e-9, measured within max(0.05, 2 %).

    Every pool value covers an interval of a few cells; a number looks only at
    its own cell and stops at the first hit (anti join), so pairs of numbers
    and facts are never written out.
    """
    tolerance = F.when(F.col("pool") == "exact", F.lit(1e-9)).otherwise(F.greatest(
        F.lit(K.ABSOLUTE_TOLERANCE), F.lit(K.RELATIVE_TOLERANCE) * F.abs(F.col("value"))))
    wide = tolerance * 1.0000001 + 1e-12
    spans = pools.withColumn("_tol", tolerance).select(
        F.col("report_id").alias("_report"), F.col("value").alias("_known"), "_tol", "pool",
        F.explode(F.sequence(_cell(F.col("value") - wide), _cell(F.col("value") + wide)))
        .alias("_known_cell"))
    keyed = numbers.withColumn("_number_cell", _cell(F.col("value")))
    off = F.abs(F.col("value") - F.col("_known"))
    close = F.when(F.col("pool") == "exact", off < F.col("_tol")).otherwise(off <= F.col("_tol"))
    return keyed.join(spans, (F.col("report_id") == F.col("_report"))
                      & (F.col("_number_cell") == F.col("_known_cell")) & close,
                      "left_anti").drop("_number_cell")


def verify_sentences(texts: DataFrame, pools: DataFrame) -> DataFrame:
    """Per sentence: how many numbers it states and how many are unbacked.

    A sentence counts its own numbers; only the unbacked ones are joined to it.
    """
    sentences = split_sentences(texts)
    key = ["report_id", "seq"]
    bad = unbacked_numbers(numbers_in(sentences), pools).groupBy(*key).agg(
        F.count("*").alias("n_unbacked"))
    stated = F.when(F.col("sentence").rlike("[0-9]"), F.size(F.filter(
        number_strings(F.col("sentence")),
        lambda n: n.try_cast("double").isNotNull())).cast("long")).otherwise(0)
    return sentences.join(bad, key, "left").select(
        *key, "sentence", stated.alias("n_numbers"),
        F.coalesce("n_unbacked", F.lit(0)).alias("n_unbacked"),
        F.col("n_unbacked").isNull().alias("grounded"))


def verify_texts(texts: DataFrame, pools: DataFrame) -> DataFrame:
    """Per report (one text each): sentences, ungrounded sentences and the verdict.

    Sentences are counted where they are cut; no sentence text is shuffled.
    """
    sentences = split_sentences(texts)
    total = sentences.groupBy("report_id").agg(F.count("*").alias("n_sentences"))
    bad = unbacked_numbers(numbers_in(sentences), pools).groupBy("report_id").agg(
        F.count_distinct("seq").alias("n_ungrounded"))
    return total.join(bad, "report_id", "left").fillna(0, ["n_ungrounded"]).withColumn(
        "all_grounded", F.col("n_ungrounded") == 0)


def clean_generated_text(texts: DataFrame) -> DataFrame:
    """Drop echoed bullet and header lines, join the rest with blanks."""
    lines = F.transform(F.split("text", r"\r\n|\n|\r"), lambda s: F.trim(s))
    kept = F.filter(lines, lambda s: (s != "") & ~s.startswith("-")
                    & ~F.lower(s).startswith("watch cycle findings"))
    return texts.withColumn("clean_text", F.array_join(kept, " "))
