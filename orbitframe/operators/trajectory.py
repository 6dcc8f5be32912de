"""Trajectories: analytic two-body motion with secular J2 rates.

The model is stated on purpose: node and perigee drift at their secular J2
rates and the anomaly advances at the published mean motion. It is not the
full general-perturbations theory; it needs nothing but the mean elements.
"""

import math

from pyspark.sql import Column, DataFrame, functions as F

from orbitframe import constants as K
from orbitframe.functions import orbits, vectors as V
from orbitframe.operators.skew import DAY_US, neighbours, slice_of

ELEMENTS = ["epoch", "incl_deg", "raan_deg", "ecc", "argp_deg", "mean_anom_deg", "revs_per_day"]


_NEWTON_STEPS = 6


def with_states(df: DataFrame, at: str, elements: str = "", out: str = "") -> DataFrame:
    """Add position (km) and velocity (km/s) columns at the time column ``at``.

    ``elements`` prefixes the element columns (``"a."`` reads a struct);
    outputs are ``<out>rx .. <out>vz``. Invalid elements give NULL.

    Every step is a projection of its own: each Newton step reads the previous
    value three times, which Spark keeps as one local variable of the generated
    code.
    """
    kept = [f"`{name}`" for name in df.columns]
    el = lambda name: f"{elements}{name}"
    two_pi, ready = orbits.TWO_PI, f"{el('ecc')} >= 0 AND {el('ecc')} < 1 AND {el('revs_per_day')} > 0"
    steps = [
        [f"{el('revs_per_day')} * {two_pi!r}D / 86400D AS _s_n",
         f"CASE WHEN {ready} THEN {el('ecc')} END AS _s_e",
         f"radians({el('incl_deg')}) AS _s_i",
         f"(unix_micros({at}) - unix_micros({el('epoch')})) / 1000000D AS _s_dt"],
        [f"pow({K.MU_KM3_S2!r}D / (_s_n * _s_n), 1D / 3D) AS _s_a"],
        ["_s_a * (1D - _s_e * _s_e) AS _s_p", "sqrt(1D - _s_e * _s_e) AS _s_b",
         "cos(_s_i) AS _s_ci", "sin(_s_i) AS _s_si"],
        [f"(1.5D * {K.J2!r}D * pow({K.R_EARTH_KM!r}D, 2D)) * _s_n / (_s_p * _s_p) AS _s_k"],
        [f"radians({el('raan_deg')}) - _s_k * _s_ci * _s_dt AS _s_node",
         f"radians({el('argp_deg')}) + _s_k * (2D - 2.5D * _s_si * _s_si) * _s_dt AS _s_peri",
         f"pmod(radians({el('mean_anom_deg')}) + _s_n * _s_dt, {two_pi!r}D) AS _s_m"],
        ["_s_m + _s_e * sin(_s_m) AS _s_k0", "cos(_s_node) AS _s_cn", "sin(_s_node) AS _s_sn",
         "cos(_s_peri) AS _s_cw", "sin(_s_peri) AS _s_sw"],
    ]
    for i in range(_NEWTON_STEPS):
        e = f"_s_k{i}"
        steps.append([f"{e} - ({e} - _s_e * sin({e}) - _s_m) / (1D - _s_e * cos({e})) "
                      f"AS _s_k{i + 1}"])
    anomaly = f"_s_k{_NEWTON_STEPS}"
    steps.append([f"cos({anomaly}) AS _s_ca", f"sin({anomaly}) AS _s_sa"])
    steps.append([
        "_s_a * (_s_ca - _s_e) AS _s_x", "_s_a * _s_b * _s_sa AS _s_y",
        "_s_n * _s_a / (1D - _s_e * _s_ca) AS _s_rate",
        # unit vectors to perigee and along the motion there
        "_s_cn * _s_cw - _s_sn * _s_sw * _s_ci AS _s_ux",
        "_s_sn * _s_cw + _s_cn * _s_sw * _s_ci AS _s_uy", "_s_sw * _s_si AS _s_uz",
        "-_s_cn * _s_sw - _s_sn * _s_cw * _s_ci AS _s_wx",
        "-_s_sn * _s_sw + _s_cn * _s_cw * _s_ci AS _s_wy", "_s_cw * _s_si AS _s_wz"])
    for step in steps:
        df = df.selectExpr("*", *step)
    state = {}
    for axis in "xyz":
        state[f"{out}r{axis}"] = f"_s_x * _s_u{axis} + _s_y * _s_w{axis}"
    for axis in "xyz":
        state[f"{out}v{axis}"] = (
            f"-_s_rate * _s_sa * _s_u{axis} + _s_rate * _s_b * _s_ca * _s_w{axis}")
    fields = ", ".join(f"{value} AS {name}" for name, value in state.items())
    # inline() keeps later filters from being pushed through, and copied over,
    # the whole chain of expressions above
    return df.selectExpr(*kept, f"inline(array(struct({fields})))")


def above_ground(prefix: str = "") -> Column:
    """True where the state under ``prefix`` lies outside the Earth."""
    return F.expr(f"{V.norm(V.cols(prefix + 'r'))} >= {K.R_EARTH_KM!r}")


def propagate_at(elements: DataFrame, at: Column) -> DataFrame:
    """State of every object at one instant or at its own time column.

    Objects with invalid elements, or inside the Earth at that time, drop out.
    """
    states = with_states(elements.withColumn("t", at), "t")
    return states.where(above_ground()).select(
        "norad_id", "t", "rx", "ry", "rz", "vx", "vy", "vz")


def grid_times(start: Column, end: Column, step_s: float) -> Column:
    """Times from start in fixed steps; always at least two points."""
    step = F.lit(int(step_s * 1_000_000))
    first = F.unix_micros(start)
    n = F.greatest(F.lit(2), F.floor((F.unix_micros(end) - first) / step) + 1)
    return F.transform(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1),
                       lambda i: F.timestamp_micros(first + i * step))


def ephemeris_grid(elements: DataFrame, start: Column, end: Column,
                   step_s: float = 60.0) -> DataFrame:
    """Catalogue x time grid of states, expanded inside each task."""
    grid = elements.withColumn("t", F.explode(grid_times(start, end, step_s)))
    return propagate_at(grid, F.col("t"))


def epoch_cells(history: DataFrame, max_gap_days: float = K.MAX_EPOCH_GAP_DAYS) -> DataFrame:
    """For each element set the time span in which it is the nearest one.

    ``owns`` is tested on doubled microseconds so that midpoints stay exact;
    a tie belongs to the earlier set.
    """
    reach = int(max_gap_days * DAY_US)
    with_t = history.withColumn("_us", F.unix_micros("epoch"))
    cells = neighbours(with_t, ["norad_id"], "_us", 2 * max_gap_days, ["_us"], after=True)
    return cells.select(
        *history.columns,
        F.greatest(F.coalesce(F.col("prev._us") + F.col("_us") + 1, F.col("_us") * 2 - 2 * reach),
                   F.col("_us") * 2 - 2 * reach).alias("_own_from"),
        F.least(F.coalesce(F.col("next._us") + F.col("_us"), F.col("_us") * 2 + 2 * reach),
                F.col("_us") * 2 + 2 * reach).alias("_own_to"))


def nearest_epoch_join(grid: DataFrame, history: DataFrame, id_col: str = "norad_id",
                       time_col: str = "t", out: str = "nearest", how: str = "left",
                       max_gap_days: float = K.MAX_EPOCH_GAP_DAYS,
                       bucket_days: float = 1.0) -> DataFrame:
    """Attach to every grid row the nearest-in-time element set of its object.

    A point-in-interval join: each element set owns a span of time, spans are
    cut into day buckets, and a grid row meets exactly one owner. NULL (or no
    row for ``how="inner"``) beyond the gap.
    """
    width = int(bucket_days * DAY_US)
    cells = epoch_cells(history, max_gap_days).withColumn("_bucket", F.explode(F.sequence(
        slice_of(F.col("_own_from") / 2, width), slice_of(F.col("_own_to") / 2, width))))
    owners = cells.select(
        F.col("norad_id").alias("_id"), "_bucket", "_own_from", "_own_to",
        F.struct(*history.columns).alias(out))
    keyed = grid.withColumn("_us", F.unix_micros(time_col)).withColumn(
        "_bucket", slice_of(F.col("_us"), width))
    match = (
        (keyed[id_col] == owners["_id"]) & (keyed["_bucket"] == owners["_bucket"])
        & (F.col("_us") * 2 >= F.col("_own_from")) & (F.col("_us") * 2 <= F.col("_own_to")))
    return keyed.join(owners, match, how).select(*grid.columns, out)


def history_span(history: DataFrame) -> DataFrame:
    return history.groupBy("norad_id").agg(
        F.min("epoch").alias("first_epoch"), F.max("epoch").alias("last_epoch"))


def _floor_div(value: str, by: int) -> str:
    """Whole quotient of two longs rounded down, exact at any size."""
    return f"(({value}) - pmod({value}, {by}L)) div {by}L"


def _first_at(value: str, by: int) -> str:
    """The smallest whole number whose ``by``-fold reaches ``value``."""
    return f"(-({_floor_div(f'-({value})', by)}))"


def pair_spans(pairs: DataFrame, history: DataFrame, step_s: float) -> DataFrame:
    """Where each pair's regular grid over its common coverage starts and ends.

    ``_start`` is its first instant in microseconds, ``_last`` the number of its last point (from 0;
    there are always two at least).
    """
    span = history_span(history)
    side = lambda who: span.select(
        F.col("norad_id").alias(who), F.unix_micros("first_epoch").alias(f"_{who}_first"),
        F.unix_micros("last_epoch").alias(f"_{who}_last"))
    both = pairs.join(side("actor"), "actor").join(side("target"), "target").withColumns({
        "_start": F.greatest("_actor_first", "_target_first"),
        "_end": F.least("_actor_last", "_target_last")})
    step = int(step_s * 1_000_000)
    return both.where(F.col("_end") > F.col("_start")).select(*pairs.columns, "_start", F.greatest(
        F.lit(1), F.floor((F.col("_end") - F.col("_start")) / F.lit(step))).cast("long").alias("_last"))


def aligned_runs(pairs: DataFrame, history: DataFrame, step_hours: float = K.PAIR_STEP_HOURS,
                 max_gap_days: float = K.MAX_EPOCH_GAP_DAYS) -> DataFrame:
    """Runs ``_from`` to ``_to`` of grid points of each pair over which its nearest sets stay the same.

    No grid point is shuffled: a pair meets the actor's sets, each with the points it owns, and these
    meet the target's sets in time slices as long as a set can reach; a point lies in one slice and
    has one owner on either side. ``a`` and ``b`` are the sets; point k is at _start + k steps.
    """
    step, width = int(step_hours * 3600 * 1_000_000), int(max_gap_days * DAY_US)
    slim = history.select("norad_id", *ELEMENTS)
    spans = pair_spans(pairs.select("actor", "target"), slim, step_hours * 3600.0)
    owners = lambda out: epoch_cells(slim, max_gap_days).select(
        F.col("norad_id").alias("_id"), "_own_from", "_own_to", F.struct(*ELEMENTS).alias(out))
    # ownership is tested on doubled microseconds
    reach = {"_lo": F.expr(_first_at("_own_from - 2 * _start", 2 * step)),
             "_hi": F.expr(_floor_div("_own_to - 2 * _start", 2 * step))}
    left = spans.join(owners("a"), F.col("actor") == F.col("_id")).withColumns(reach).withColumns({
        "_from": F.greatest("_lo", F.lit(0)), "_to": F.least("_hi", "_last")}).where("_from <= _to").select(
        "actor", "target", "_start", "_from", "_to", "a").withColumn("_slice", F.explode(F.sequence(
            F.expr(_floor_div(f"_start + _from * {step}L", width)),
            F.expr(_floor_div(f"_start + _to * {step}L", width)))))
    right = owners("b").withColumn("_cell", F.explode(F.sequence(
        F.expr(_floor_div("_own_from", 2 * width)), F.expr(_floor_div("_own_to", 2 * width)))))
    met = left.join(right, (F.col("target") == F.col("_id")) & (F.col("_slice") == F.col("_cell"))
                    & F.expr(f"_own_from <= 2 * (_start + _to * {step}L)")
                    & F.expr(f"_own_to >= 2 * (_start + _from * {step}L)")).withColumns(reach)
    return met.withColumns({
        "_from": F.greatest("_from", "_lo", F.expr(_first_at(f"_slice * {width}L - _start", step))),
        "_to": F.least("_to", "_hi", F.expr(_first_at(f"(_slice + 1) * {width}L - _start", step)) - 1),
    }).where("_from <= _to").select("actor", "target", "_start", "_from", "_to", "a", "b")


def aligned_pairs(pairs: DataFrame, history: DataFrame,
                  step_hours: float = K.PAIR_STEP_HOURS,
                  max_gap_days: float = K.MAX_EPOCH_GAP_DAYS) -> DataFrame:
    """States of both members of each (actor, target) on a common grid.

    A grid point stays only if both objects have an element set near enough.
    Columns: actor, target, t, a_* (actor state), b_* (target state).
    """
    step = int(step_hours * 3600 * 1_000_000)
    runs = aligned_runs(pairs, history, step_hours, max_gap_days)
    grid = runs.withColumn("_k", F.explode(F.sequence("_from", "_to"))).select(
        "actor", "target", F.timestamp_micros(F.col("_start") + F.col("_k") * step).alias("t"), "a", "b")
    states = with_states(with_states(grid, "t", "a.", "a_"), "t", "b.", "b_")
    return states.where(above_ground("a_") & above_ground("b_")).drop("a", "b")


def ric_relative(df: DataFrame, ref: str = "a_", other: str = "b_") -> DataFrame:
    """Motion of ``other`` in the rotating radial / in-track / cross-track
    frame of ``ref``: rho_r/i/c (km), vel_r/i/c (km/s), range_km, speed_kms."""
    kept = [f"`{name}`" for name in df.columns]
    r, v = V.cols(ref + "r"), V.cols(ref + "v")
    h, d, w, u = (V.cols(f"_{name}") for name in "hdwu")
    radial, along, normal = V.cols("_er"), V.cols("_ei"), V.cols("_ec")
    steps = [
        [*V.named(V.cross(r, v), "_h"), *V.named(V.minus(V.cols(other + "r"), r), "_d"),
         f"{V.norm(r)} AS _rn"],
        [*V.named(V.over(h, "(_rn * _rn)"), "_w"), *V.named(V.over(r, "_rn"), "_er"),
         *V.named(V.over(h, V.norm(h)), "_ec")],
        [*V.named(V.cross(normal, radial), "_ei"),
         *V.named(V.minus(V.minus(V.cols(other + "v"), v), V.cross(w, d)), "_u")],
    ]
    for step in steps:
        df = df.selectExpr("*", *step)
    axes = {"r": radial, "i": along, "c": normal}
    return df.selectExpr(
        *kept, *[f"{V.dot(axis, d)} AS rho_{k}" for k, axis in axes.items()],
        *[f"{V.dot(axis, u)} AS vel_{k}" for k, axis in axes.items()],
        f"{V.norm(d)} AS range_km", f"{V.norm(u)} AS speed_kms")


def pair_samples(aligned: DataFrame) -> DataFrame:
    """Range and relative speed of aligned pairs."""
    return ric_relative(aligned).select("actor", "target", "t", "range_km", "speed_kms")


def cw_propagate(df: DataFrame, n: Column, t: Column) -> DataFrame:
    """Linearised relative motion (x,y,z,vx,vy,vz) after ``t`` seconds around a
    circular orbit of mean motion ``n``; adds cw_x .. cw_vz."""
    df = df.withColumns({"_n": n, "_t": t})
    df = df.withColumns({"_s": F.sin(F.col("_n") * F.col("_t")),
                         "_c": F.cos(F.col("_n") * F.col("_t"))})
    x, y, z, vx, vy, vz, s, c, m, tt = (
        F.col(k) for k in ("x", "y", "z", "vx", "vy", "vz", "_s", "_c", "_n", "_t"))
    return df.withColumns({
        "cw_x": (4 - 3 * c) * x + s / m * vx + 2 * (1 - c) / m * vy,
        "cw_y": 6 * (s - m * tt) * x + y - 2 * (1 - c) / m * vx + (4 * s / m - 3 * tt) * vy,
        "cw_z": c * z + s / m * vz,
        "cw_vx": 3 * m * s * x + c * vx + 2 * s * vy,
        "cw_vy": -6 * m * (1 - c) * x - 2 * s * vx + (4 * c - 3) * vy,
        "cw_vz": c * vz - m * s * z,
    }).drop("_n", "_t", "_s", "_c")


# WGS84 ellipsoid (fixed values)
_FLATTENING = 1 / 298.257223563
_E2 = _FLATTENING * (2 - _FLATTENING)
_POLAR_KM = K.R_EARTH_KM * (1 - _FLATTENING)


def ground_track(states: DataFrame) -> DataFrame:
    """Sub-satellite latitude, longitude (deg) and height (km) of state rows."""
    days = F.unix_micros("t") / F.lit(86400e6) + F.lit(2440587.5 - 2451545.0)
    sidereal = F.radians(F.pmod(F.lit(280.46061837) + F.lit(360.98564736629) * days, F.lit(360.0)))
    df = states.withColumns({"_g": sidereal, "_q": F.sqrt(
        F.col("rx") * F.col("rx") + F.col("ry") * F.col("ry"))})
    q, z = F.col("_q"), F.col("rz")
    theta = F.atan2(z * K.R_EARTH_KM, q * _POLAR_KM)
    df = df.withColumn("_th", theta)
    ep2 = _E2 / (1 - _E2)
    sin_t, cos_t = F.sin("_th"), F.cos("_th")
    lat = F.atan2(z + F.lit(ep2 * _POLAR_KM) * sin_t * sin_t * sin_t,
                  q - F.lit(_E2 * K.R_EARTH_KM) * cos_t * cos_t * cos_t)
    df = df.withColumn("_lat", lat)
    normal = F.lit(K.R_EARTH_KM) / F.sqrt(1 - _E2 * F.sin("_lat") * F.sin("_lat"))
    height = q * F.cos("_lat") + z * F.sin("_lat") - F.lit(K.R_EARTH_KM) * F.lit(
        K.R_EARTH_KM) / normal
    lon = F.degrees(F.pmod(F.atan2("ry", "rx") - F.col("_g") + F.lit(math.pi),
                           F.lit(orbits.TWO_PI)) - F.lit(math.pi))
    return df.select("norad_id", "t", F.degrees("_lat").alias("lat_deg"),
                     lon.alias("lon_deg"), height.alias("alt_km"))
