"""Composite score from the factors that can be computed."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from orbitframe import constants as K
from orbitframe.functions import orbits, vectors as V
from orbitframe.operators import nearest
from orbitframe.operators.skew import even_blocks
from orbitframe.operators.trajectory import ELEMENTS, above_ground, with_states
from orbitframe.sources.landing import landed

FACTORS = list(K.FACTOR_WEIGHTS)
ASSET = {"asset_id": "long", "asset_name": "string", "nearest_km": "double"}


def anomalous_rate(classified: DataFrame) -> DataFrame:
    """Share of an object's campaigns that deviate from its own pattern."""
    odd = F.col("label") == "anomalous"
    return classified.groupBy("norad_id").agg(
        F.avg(odd.cast("double")).alias("anomalous_rate"),
        F.count_if(odd).alias("n_anomalous"), F.count("*").alias("n_campaigns"))


def maneuver_activity(floors: DataFrame, events: DataFrame) -> DataFrame:
    """Largest burn against the saturation size; zero for a quiet history.

    Objects without a noise floor get no row.
    """
    peak = events.groupBy("norad_id").agg(F.max("dv_ms").alias("_peak"))
    return floors.select("norad_id").join(peak, "norad_id", "left").select(
        "norad_id", F.least(F.lit(1.0), F.coalesce("_peak", F.lit(0.0))
                            / K.ACTIVITY_SATURATION_MS).alias("maneuver_activity"))


def _lookup(table: dict[str, float], key: Column, default: float) -> Column:
    pairs = [(key == name, F.lit(value)) for name, value in table.items()]
    return orbits.first_match(pairs).otherwise(F.lit(default))


def regime_sensitivity(classified: DataFrame) -> DataFrame:
    """Regime weight plus the largest special-orbit bump, capped at one."""
    base = _lookup(K.REGIME_WEIGHT, F.col("primary"), K.DEFAULT_REGIME_WEIGHT)
    bump = F.array_max(F.transform("special_tags", lambda t: _lookup(K.TAG_BUMP, t, 0.0)))
    return classified.withColumn("regime_sensitivity", F.least(
        F.lit(1.0), base + F.coalesce(bump, F.lit(0.0))))


def attribution(satcat: DataFrame) -> DataFrame:
    """0, 0.5 or 1 as owner and type are both, one or neither known."""
    known = lambda c: (F.col(c).isNotNull() & ~F.col(c).isin("", "UNK")).cast("int")
    return satcat.withColumn("attribution", F.lit(1.0) - (
        known("country") + known("object_type")) / F.lit(2.0))


def proximity_ramp(range_km: Column) -> Column:
    near, far = K.PROXIMITY_NEAR_KM, K.PROXIMITY_FAR_KM
    return F.when(range_km <= near, 1.0).when(range_km >= far, 0.0).otherwise(
        1.0 - (range_km - near) / (far - near))


_FARTHEST_KM = 500_000


def _shell(radius: Column, width: int | None) -> Column:
    """Number of the radius shell; all beyond the farthest radius share the last one."""
    inside = F.least(F.greatest(radius, F.lit(0.0)), F.lit(float(_FARTHEST_KM)))
    return (F.floor(inside / width) if width else F.lit(0)).cast("long")


#: an asset comes at most so many times a shell, however many objects that holds
_MOST_SALTS = 64


def _meet(objects: DataFrame, pool: DataFrame, load: DataFrame, met: int, reach: int | None,
          rows_per_task: int) -> DataFrame:
    """Objects with the distance ``_gap`` of each usable asset that may be as near as their ``_near``.

    The assets are those whose radius differs by ``met`` to ``reach``.
    """
    # at most one row a shell: a fixed number
    salts = F.broadcast(load.groupBy(_shell(F.col("_at"), reach).alias("shell")).agg(F.least(
        F.lit(_MOST_SALTS), F.ceil(F.sum("_n") / F.lit(rows_per_task)).cast("int")).alias("salts")))
    left = objects.withColumn("shell", _shell(F.col("_radius"), reach)).join(salts, "shell").withColumn(
        "salt", F.pmod(F.xxhash64("norad_id"), F.col("salts"))).drop("salts")
    far = reach or _FARTHEST_KM
    right = pool.withColumn("shell", F.explode(F.sequence(
        _shell(F.col("_low") - far, reach), _shell(F.col("_high") + far, reach)))).join(
            salts, "shell").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop(
                "salts")
    # two bodies are at least as far apart as their distances from the Earth's centre differ
    apart = F.greatest(F.col("_low") - F.col("_radius"), F.col("_radius") - F.col("_high"), F.lit(0.0))
    near = F.col("_near")
    on = ((left["shell"] == right["shell"]) & (left["salt"] == right["salt"])
          & (F.col("norad_id") != F.col("asset_id")) & (near.isNull() | (apart <= near)))
    on = on & (apart >= met) if met else on
    on = on & (apart <= far) if reach else on
    return _gaps(left.join(right, on).drop("shell", "salt")).select(
        "norad_id", "_near", "_gap", "asset_id", "asset_name")


def _gaps(pairs: DataFrame) -> DataFrame:
    """Pairs of an object and a usable asset with their distance ``_gap`` at ``t``."""
    gap = F.expr(V.norm(V.minus(V.cols("r"), V.cols("h_r"))))
    return with_states(pairs, "t", "el_", "h_").where(above_ground("h_")).withColumn("_gap", gap).where(
        F.col("_gap") >= K.SAME_STRUCTURE_KM)


#: assets that one task holds; times that an asset comes at most, however many objects there are
_ASSETS_PER_TASK, _MOST_BLOCKS = 250_000, 32


def _close_pairs(base: DataFrame, pool: DataFrame, n: int, m: int, rows_per_task: int) -> DataFrame:
    """Objects with the few assets that may be nearest; the last digits are left to the caller.

    Objects are cut into blocks by time, assets into parts; every block meets every part in one
    group, where the search goes through boxes of assets (:func:`nearest.finder`).
    """
    blocks = max(1, min(_MOST_BLOCKS, -(-4 * n // rows_per_task)))
    parts = max(1, -(-m // _ASSETS_PER_TASK))
    groups = ["block", "part"]
    left = even_blocks(base, F.unix_micros("t"), blocks, "norad_id").select(
        "norad_id", F.unix_micros("t").alias("us"), "rx", "ry", "rz", "block", F.explode(F.sequence(
            F.lit(0), F.lit(parts - 1))).alias("part"))
    right = pool.where(F.col("asset_id").isNotNull()).select(
        "asset_id", "asset_name", F.unix_micros("el_epoch").alias("el_epoch"),
        *[F.col(f"el_{c}").cast("double").alias(f"el_{c}") for c in ELEMENTS[1:]],
        F.pmod(F.xxhash64("asset_id", "el_epoch"), F.lit(parts)).cast("int").alias("part"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    # few keys: more partitions than groups keep them apart
    spread = lambda df: df.repartition(4 * blocks * parts, *groups).groupBy(*groups)
    return spread(left).cogroup(spread(right)).applyInArrow(nearest.finder(), nearest.PAIR).withColumns({
        "t": F.timestamp_micros("us"), "el_epoch": F.timestamp_micros("el_epoch")})


def _nearest(base: DataFrame, pool: DataFrame, rows_per_task: int) -> DataFrame:
    """(norad_id, _best): distance, id and name of the nearest asset.

    Few pairs are all compared; of many the search leaves about one an object.
    """
    base, pool = landed(base), landed(pool)
    n, m = base.count(), pool.count()
    if n * m <= 100 * rows_per_task:
        load = base.groupBy("_radius").agg(F.count("*").alias("_n")).withColumnRenamed("_radius", "_at")
        pairs = _meet(base.withColumn("_near", F.lit(None).cast("double")), pool, load, 0, None, rows_per_task)
    else:
        pairs = _gaps(_close_pairs(base, pool, n, m, rows_per_task))
    return pairs.groupBy("norad_id").agg(F.min(F.struct("_gap", "asset_id", "asset_name")).alias("_best"))


def proximity_to_assets(objects: DataFrame, assets: DataFrame, as_of,
                        max_age_days: float = K.PROXIMITY_MAX_AGE_DAYS,
                        rows_per_task: int = 20_000) -> DataFrame:
    """Nearest high-value asset of each object at the object's own epoch, at any distance.

    ``objects`` and ``assets`` hold one element set per object (assets also ``name``). Objects are
    searched for in blocks of time, through boxes of assets at their places then; positions at an
    object's own time are only computed for assets that may be its nearest. Beyond the far limit the
    factor is 0. Assets without a complete, closed orbit are none; without a usable one all is NULL,
    as it is for objects whose set is older than ``max_age_days`` at ``as_of``.
    """
    at = F.lit(as_of).cast("timestamp")
    fresh = F.abs(orbits.days_between(at, F.col("epoch"))) <= max_age_days
    base = with_states(objects.select("norad_id", *ELEMENTS), "epoch").withColumn(
        "_radius", F.expr(V.norm(V.cols("r")))).where(fresh & (F.col("_radius") >= K.R_EARTH_KM))
    base = base.select("norad_id", F.col("epoch").alias("t"), "rx", "ry", "rz", "_radius")
    n = orbits.mean_motion_rad_s(F.col("revs_per_day"))
    a = orbits.semi_major_km(n)
    whole = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in ELEMENTS])
    assets = assets.where(whole & (F.col("revs_per_day") > 0) & (F.col("ecc") >= 0) & (F.col("ecc") < 1))
    # a kilometre for rounding
    pool = assets.select(F.col("norad_id").alias("asset_id"), F.col("name").alias("asset_name"),
                         *[F.col(c).alias(f"el_{c}") for c in ELEMENTS],
                         (a * (1 - F.col("ecc")) - 1).alias("_low"),
                         (a * (1 + F.col("ecc")) + 1).alias("_high"))
    found = _nearest(base, pool, rows_per_task)
    known = found.select("norad_id", F.col("_best.asset_id"), F.col("_best.asset_name"),
                         F.col("_best._gap").alias("nearest_km"))
    ramp = F.when(F.col("nearest_km").isNotNull(), proximity_ramp(F.col("nearest_km")))
    return objects.select("norad_id").join(known, "norad_id", "left").withColumn(
        "proximity_to_hva", ramp)


def combine_factors(factors: DataFrame) -> DataFrame:
    """Weighted mean over the factors that are present, in 0..100."""
    present = {name: F.col(name).isNotNull() for name in FACTORS}
    total = lambda parts: reduce(lambda x, y: x + y, parts)
    weight = total([F.when(present[f], K.FACTOR_WEIGHTS[f]).otherwise(0.0) for f in FACTORS])
    value = total([F.coalesce(F.col(f) * K.FACTOR_WEIGHTS[f], F.lit(0.0)) for f in FACTORS])
    return factors.withColumns({
        "score": F.when(weight > 0, F.lit(100.0) * value / weight),
        "n_factors": total([present[f].cast("int") for f in FACTORS])})


def _explained(absent: str, *cases: tuple[Column, Column | str], otherwise: Column | str) -> Column:
    """The first case that holds; ``absent`` where the factor is NULL."""
    text = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.coalesce(*[F.when(c, text(v)) for c, v in cases], text(otherwise), F.lit(absent))


def factor_explanations(nearest: bool = False) -> dict[str, Column]:
    """Why each factor column has its value, or why it has none.

    ``nearest``: the rows also have ``asset_id``, ``asset_name`` and ``nearest_km``.
    """
    c, say = F.col, F.format_string
    named = [(c("proximity_to_hva").isNotNull() & c("nearest_km").isNotNull(), say(
        "about %.0f km from %s, the nearest high-value asset", c("nearest_km"),
        F.coalesce("asset_name", c("asset_id").cast("string"))))] if nearest else []
    when_known = lambda name, text: F.when(c(name).isNotNull(), text)
    return {
        "maneuver_activity": _explained(
            "too few element sets for a noise floor",
            (c("maneuver_activity") == 0, "no burn stands out from the noise floor"),
            (c("maneuver_activity") >= 1, F.lit(
                f"largest burn at least {K.ACTIVITY_SATURATION_MS:.0f} m/s")),
            otherwise=when_known("maneuver_activity", say(
                "largest burn %.1f m/s", c("maneuver_activity") * K.ACTIVITY_SATURATION_MS))),
        "anomalous_rate": _explained(
            "too few campaigns for a usual pattern",
            otherwise=when_known("anomalous_rate", say(
                "%.0f %% of campaigns leave the usual pattern", c("anomalous_rate") * 100))),
        "regime_sensitivity": _explained(
            "no orbit to classify",
            otherwise=when_known("regime_sensitivity", say(
                "weight of the orbit regime and its special tags, %.2f", c("regime_sensitivity")))),
        "proximity_to_hva": _explained(
            "no usable asset, or the object's element set is too old",
            *named,
            (c("proximity_to_hva") == 0, F.lit(
                f"no high-value asset within {K.PROXIMITY_FAR_KM:.0f} km")),
            (c("proximity_to_hva") >= 1, F.lit(
                f"a high-value asset within {K.PROXIMITY_NEAR_KM:.0f} km")),
            otherwise=when_known("proximity_to_hva", say(
                "nearest high-value asset at about %.0f km", F.lit(K.PROXIMITY_NEAR_KM)
                + (1 - c("proximity_to_hva")) * (K.PROXIMITY_FAR_KM - K.PROXIMITY_NEAR_KM)))),
        "attribution": _explained(
            "not in the catalogue",
            (c("attribution") == 0, "owner and type are known"),
            (c("attribution") >= 1, "neither owner nor type is known"),
            otherwise=when_known("attribution", F.lit("only one of owner and type is known"))),
    }


def factor_list(nearest: bool = False) -> Column:
    """Factor columns as an array of (name, value, weight, explanation)."""
    why = factor_explanations(nearest)
    return F.array(*[F.struct(
        F.lit(f).alias("name"), F.col(f).alias("value"), F.lit(K.FACTOR_WEIGHTS[f]).alias("weight"),
        why[f].alias("explanation")) for f in FACTORS])


def threat_scores(ids: DataFrame, floors: DataFrame, events: DataFrame, classified: DataFrame,
                  regimes: DataFrame, satcat: DataFrame,
                  proximity: DataFrame | None = None) -> DataFrame:
    """All factors and the composite score for every object in ``ids``.

    ``asset_id``, ``asset_name`` and ``nearest_km`` of ``proximity`` come along for the explanation.
    """
    pick = lambda df, name: df.select("norad_id", name, *(ASSET if name == "proximity_to_hva" else ()))
    df = ids.select("norad_id").distinct()
    sources = {
        "maneuver_activity": maneuver_activity(floors, events),
        "anomalous_rate": anomalous_rate(classified),
        "regime_sensitivity": regime_sensitivity(regimes),
        "proximity_to_hva": proximity,
        "attribution": attribution(satcat)}
    for name, table in sources.items():
        if table is None:
            df = df.withColumns({name: F.lit(None).cast("double"), **{
                c: F.lit(None).cast(kind) for c, kind in ASSET.items()}})
        else:
            df = df.join(pick(table, name), "norad_id", "left")
    scored = combine_factors(df)
    return scored.withColumn("band", orbits.threat_band(F.col("score")))
