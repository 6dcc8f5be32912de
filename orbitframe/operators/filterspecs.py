"""Catalogue filters as a table of requests, answered together."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from orbitframe import constants as K
from orbitframe.functions import orbits
from orbitframe.operators.catalog import altitude_key, satcat_regime
from orbitframe.sources.landing import landed

REGIMES = list(orbits.BANDS)
TYPES = ["PAY", "R/B", "DEB"]
SORTS = ["anomaly", "altitude_desc", "altitude_asc"]
_ANY = "*"


def _one_of(value: Column, allowed: list[str]) -> Column:
    return F.when(value.isin(*allowed), value)


def parse_filter_specs(requests: DataFrame) -> DataFrame:
    """(request_id, text) to validated specs.

    The outermost {...} of the text is read as JSON; of a repeated key the last value counts.
    Unknown keys are ignored, values outside the allowed sets become NULL, the limit is clamped.
    The JSON type of a value decides: ``decayed`` takes booleans and texts, bounds take numbers,
    numeric texts and booleans (1 or 0), the limit takes whole texts and cuts fractions off
    numbers, empty or zero owners and names are none. Text without a JSON object becomes a name
    search.
    """
    body = F.regexp_extract("text", r"(?s)\{.*\}", 0)
    df = requests.withColumn("_v", F.try_parse_json(F.when(body != "", body)))
    raw = lambda k: F.try_variant_get("_v", f"$.{k}", "string")
    kind = lambda k: F.schema_of_variant(F.try_variant_get("_v", f"$.{k}", "variant"))
    truth = lambda k: F.when(kind(k) == "BOOLEAN", F.try_variant_get("_v", f"$.{k}", "boolean"))
    number = lambda k: F.coalesce(truth(k).cast("double"), raw(k).try_cast("double"))
    isnt_number = lambda k: kind(k).isin("STRING", "BOOLEAN") | kind(k).rlike("^(OBJECT|ARRAY)<")
    nothing = lambda k: truth(k).eqNullSafe(F.lit(False)) | raw(k).isin("", "[]", "{}") | (
        ~isnt_number(k) & (number(k) == 0))
    text = lambda k: F.when(~F.coalesce(nothing(k), F.lit(True)), F.nullif(F.trim(
        F.when(truth(k), F.lit("True")).otherwise(raw(k))), F.lit("")))
    whole = F.when(kind("limit") == "STRING", F.when(
        raw("limit").rlike(r"^\s*[+-]?[0-9]+\s*$"), number("limit"))).otherwise(number("limit"))
    flag = F.when(kind("decayed") == "STRING", F.lower(F.trim(raw("decayed"))).isin("true", "yes", "1"))
    parsed = F.col("_v").isNotNull()
    return df.select(
        "request_id", parsed.alias("parsed"),
        _one_of(F.upper(raw("regime")), REGIMES).alias("regime"),
        _one_of(F.regexp_replace(F.upper(raw("object_type")), "RB", "R/B"), TYPES)
        .alias("object_type"),
        text("country").alias("country"),
        F.when(parsed, text("name_contains")).otherwise(F.col("text")).alias("name_contains"),
        F.coalesce(truth("decayed"), flag).alias("decayed"),
        number("min_inclination").alias("min_inclination"),
        number("max_inclination").alias("max_inclination"),
        _one_of(F.lower(raw("sort")), SORTS).alias("sort"),
        F.greatest(F.lit(1.0), F.least(F.lit(float(K.SPEC_MAX_LIMIT)), F.coalesce(
            whole, F.lit(float(K.SPEC_DEFAULT_LIMIT))))).cast("int").alias("limit"))


def _key(*parts: Column) -> Column:
    return F.concat_ws("|", *parts)


def _object_keys(objects: DataFrame) -> DataFrame:
    """Objects once for each combination of their own regime bands, type and owner with "any"."""
    some = lambda c: F.array(F.lit(_ANY), c)
    bands = F.concat(F.array(F.lit(_ANY)), F.array_compact(F.array(*[
        F.when(orbits.band_predicate(b), F.lit(b)) for b in REGIMES])))
    decayed = F.col("decay_date").isNotNull().cast("string")
    return (
        objects.withColumn("_band", F.explode(bands))
        .withColumn("_type", F.explode(some(F.coalesce("object_type", F.lit("")))))
        .withColumn("_owner", F.explode(some(F.upper(F.coalesce("country", F.lit(""))))))
        .withColumn("_key", _key(decayed, F.col("_band"), F.col("_type"), F.col("_owner")))
        .drop("_band", "_type", "_owner"))


def _request_key() -> Column:
    return _key(
        F.coalesce("decayed", F.lit(False)).cast("string"), F.coalesce("regime", F.lit(_ANY)),
        F.coalesce("object_type", F.lit(_ANY)), F.coalesce(F.upper("country"), F.lit(_ANY)))


def _fits(o: str, s: str) -> Column:
    """What the key does not say: name and inclination."""
    absent = lambda c: F.col(f"{s}.{c}").isNull()
    return (
        (absent("name_contains") | F.contains(F.upper(f"{o}.name"), F.upper(f"{s}.name_contains")))
        & (absent("min_inclination") | (F.col(f"{o}.inclination") >= F.col(f"{s}.min_inclination")))
        & (absent("max_inclination") | (F.col(f"{o}.inclination") <= F.col(f"{s}.max_inclination"))))


def matching_objects(catalog: DataFrame, specs: DataFrame) -> DataFrame:
    """Every (request, object) that satisfies the request.

    Each object is keyed by all the combinations of its own regime bands, type
    and owner with "any", so requests meet objects by equality instead of by a
    theta join; name and inclination are checked on the hits.
    """
    s, o = specs.select("*", _request_key().alias("_key")).alias("s"), _object_keys(
        satcat_regime(catalog)).alias("o")
    return o.join(s, F.col("o._key") == F.col("s._key")).where(_fits("o", "s")).select(
        "s.request_id", "s.sort", "s.limit", "o.norad_id", "o.name", "o.country",
        "o.object_type", "o.apogee_km", "o.perigee_km", "o.inclination",
        F.col("o.regime").alias("regime"))


def _order(sort: Column) -> Column:
    return (
        F.when(sort == "anomaly", -F.coalesce("anomaly", F.lit(-1.0)))
        .when(sort == "altitude_desc", -altitude_key())
        .when(sort == "altitude_asc", altitude_key())
        .otherwise(F.lit(0.0)))


def _first(df: DataFrame, by: list[str], bound: int, name: str) -> DataFrame:
    """The first ``bound`` objects of each ``by``, numbered; a constant bound is applied in map tasks."""
    w = Window.partitionBy(*by).orderBy("_order", "norad_id")
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= bound)


def _answers(objects: DataFrame, asked: DataFrame, depth: int) -> DataFrame:
    """The first ``_need`` objects of each different request: (_ask, rank, the object's columns).

    A round looks at the first ``depth`` objects of each key in the order asked for. Requests that
    found too few there, in a longer list, go on to a round SPEC_DEEPER times as deep, so matches
    are not all listed to be sorted; the last round looks at all objects.
    """
    lists, columns = ["_key", "_sort"], objects.columns
    n_objects, answers = objects.count(), None
    while True:
        whole = depth >= n_objects
        keyed = _object_keys(objects).join(asked.select(*lists).distinct(), "_key").withColumn(
            "_order", _order(F.col("_sort")))
        if not whole:
            keyed = landed(_first(keyed, lists, depth, "_place"))
        o, s = keyed.alias("o"), asked.alias("s")
        meet = (F.col("o._key") == F.col("s._key")) & (F.col("o._sort") == F.col("s._sort"))
        hits = o.join(s, meet).where(_fits("o", "s")).select(
            "s._ask", "s._need", "o._order", *[f"o.{c}" for c in columns])
        found = landed(_first(hits, ["_ask"], K.SPEC_MAX_LIMIT, "rank").where(
            F.col("rank") <= F.col("_need")).drop("_need"))
        if whole:
            return found if answers is None else answers.unionByName(found)
        longer = keyed.where(F.col("_place") == depth).select(*lists).distinct()
        short = found.groupBy("_ask").agg(F.count("*").alias("_found"))
        asked = landed(asked.join(longer, lists, "left_semi").join(short, "_ask", "left").where(
            F.coalesce("_found", F.lit(0)) < F.col("_need")).drop("_found"))
        done = found.join(asked.select("_ask"), "_ask", "left_anti")
        answers = done if answers is None else answers.unionByName(done)
        if asked.isEmpty():
            return answers
        depth *= K.SPEC_DEEPER


def apply_filter_specs(catalog: DataFrame, specs: DataFrame, anomaly: DataFrame | None = None,
                       depth: int = K.SPEC_DEPTH) -> DataFrame:
    """Answer all requests: sorted as asked, then cut at each one's limit.

    Requests that differ only in their id or limit are searched for once. ``anomaly`` gives
    (norad_id, score) for the anomaly order; missing scores sort last. Rows with the same
    request_id share one ranking.
    """
    objects = satcat_regime(catalog).select(
        "norad_id", "name", "country", "object_type", "apogee_km", "perigee_km", "inclination",
        "regime", "decay_date")
    if anomaly is None:
        objects = objects.withColumn("anomaly", F.lit(None).cast("double"))
    else:
        objects = objects.join(anomaly.select("norad_id", F.col("score").alias("anomaly")),
                               "norad_id", "left")
    alone = F.count("*").over(Window.partitionBy("request_id")) == 1
    same = ["_key", "_sort", "name_contains", "min_inclination", "max_inclination"]
    requests = landed(specs.select(
        "request_id", "limit", _request_key().alias("_key"),
        F.when(F.col("sort").isin(*SORTS), F.col("sort")).otherwise("").alias("_sort"),
        F.upper("name_contains").alias("name_contains"), "min_inclination", "max_inclination",
        alone.alias("_alone")))
    # rows that share an id are ranked together, so a row may push out what is over its own limit
    need = F.when(F.col("_alone"), F.least("limit", F.lit(K.SPEC_MAX_LIMIT))).otherwise(
        K.SPEC_MAX_LIMIT)
    asked = landed(requests.groupBy(*same).agg(F.max(F.coalesce(need, F.lit(0))).alias("_need"))
                   .withColumn("_ask", F.monotonically_increasing_id()))
    answers = _answers(landed(objects), asked, depth)
    r, a = requests.alias("r"), asked.alias("a")
    meet = F.lit(True)
    for c in same:
        meet &= F.col(f"r.{c}").eqNullSafe(F.col(f"a.{c}"))
    told = r.join(a, meet).select("a._ask", "r.request_id", "r.limit", "r._alone").join(
        answers, "_ask")
    ids = ["request_id", "norad_id"] if anomaly is None else ["norad_id", "request_id"]
    columns = [*ids, "name", "country", "object_type", "apogee_km", "perigee_km", "inclination",
               "regime", "anomaly", "rank", "limit"]
    together = _first(told.where(~F.col("_alone")), ["request_id"], K.SPEC_MAX_LIMIT, "rank")
    return told.where("_alone").select(*columns).union(together.select(*columns)).where(
        F.col("rank") <= F.col("limit")).drop("limit")


def describe_specs(specs: DataFrame) -> DataFrame:
    """Human-readable form of each spec."""
    c = F.col
    words = orbits.first_match([(c("object_type") == code, F.lit(word)) for code, word in (
        ("PAY", "payloads"), ("R/B", "rocket bodies"), ("DEB", "debris"))]).otherwise("objects")
    plain = lambda v: F.regexp_replace(v.cast("string"), r"\.0$", "")
    bounded = c("min_inclination").isNotNull() | c("max_inclination").isNotNull()
    order = orbits.first_match([(c("sort") == code, F.lit(word)) for code, word in (
        ("anomaly", ", most anomalous first"), ("altitude_desc", ", highest first"),
        ("altitude_asc", ", lowest first"))]).otherwise("")
    text = F.concat_ws(
        " ", words, F.concat(F.lit("in "), c("regime")),
        F.concat(F.lit("owned by "), F.upper("country")),
        F.concat(F.lit("named like "), c("name_contains")),
        F.when(bounded, F.concat(
            F.lit("inclination "), plain(F.coalesce("min_inclination", F.lit(0.0))), F.lit(" to "),
            plain(F.coalesce("max_inclination", F.lit(180.0))))),
        F.when(c("decayed"), F.lit("(decayed)")))
    return specs.withColumn("description", F.concat(
        text, order, F.lit(", top "), c("limit").cast("string")))
