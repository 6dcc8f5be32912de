"""Orbit ladders, trajectories and screening over whole tables."""

import math

from pyspark.sql import functions as F

from orbitframe import constants as K
from orbitframe.functions import orbits
from orbitframe.operators import anomaly, conjunction, elements as el, score, trajectory
from orbitframe.plans.adapters import oracle, view
from orbitframe.plans.compare import plain, r6
from orbitframe.plans.query import Query

COARSE = """CASE WHEN apogee_km < 2000 THEN 'LEO'
  WHEN perigee_km > 34000 AND apogee_km < 38000 AND ecc < 0.05 THEN 'GEO'
  WHEN perigee_km < 2000 AND apogee_km > 30000 THEN 'GTO/HEO'
  WHEN ecc > 0.5 AND incl_deg > 60 AND incl_deg < 70 THEN 'MOLNIYA'
  WHEN perigee_km >= 2000 AND apogee_km <= 34000 THEN 'MEO' ELSE 'OTHER' END"""

SSO = """(SELECT norad_id, CASE WHEN c BETWEEN -1 AND 1 THEN degrees(acos(c)) END AS sso_incl_deg
  FROM (SELECT norad_id, -1.99106e-7 / (1.5 * 1.08262668e-3
      * sqrt(398600.4418 / (semi_major_km * semi_major_km * semi_major_km))
      * pow(6378.137 / (semi_major_km * (1 - ecc * ecc)), 2)) AS c FROM elements) z)"""

# tags, regime and disposal in turn
LADDER = f"""
sso AS {SSO},
flags AS (
  SELECT e.*, coalesce(abs(incl_deg - sso_incl_deg) <= 1.5 AND apogee_km < 2000, false) AS is_sso,
    abs(incl_deg - 63.4) <= 2.5 AND ecc > 0.15 AS frozen,
    abs(period_min - 86164.0905 / 120) / (86164.0905 / 120) <= 0.05 AS half,
    abs(period_min - 86164.0905 / 60) / (86164.0905 / 60) <= 0.05 AS whole
  FROM elements e JOIN sso USING (norad_id)),
tagged AS (
  SELECT *, array_to_string(list_filter([
      CASE WHEN is_sso THEN 'SSO' END, CASE WHEN frozen AND half THEN 'MOLNIYA' END,
      CASE WHEN frozen AND NOT half AND whole THEN 'TUNDRA' END,
      CASE WHEN incl_deg > 90 AND NOT is_sso THEN 'RETROGRADE' END,
      CASE WHEN incl_deg BETWEEN 80 AND 100 THEN 'POLAR' END,
      CASE WHEN incl_deg NOT BETWEEN 80 AND 100 AND incl_deg <= 5 THEN 'EQUATORIAL' END],
      lambda x: x IS NOT NULL), ',') AS special_tags
  FROM flags),
classified AS (
  SELECT *, CASE WHEN perigee_km < 150 THEN 'DECAYING'
    WHEN perigee_km > 35936 AND ecc < 0.05 THEN 'GRAVEYARD'
    WHEN abs((apogee_km + perigee_km) / 2 - 35786) < 300 AND ecc < 0.02 AND incl_deg < 15
      THEN 'GEO'
    WHEN ecc >= 0.25 AND apogee_km > 20000 AND perigee_km < 2000
      AND abs(apogee_km - 35786) < 5000 AND incl_deg < 30 AND NOT (frozen AND (half OR whole))
      THEN 'GTO'
    WHEN ecc >= 0.25 AND apogee_km > 20000 THEN 'HEO'
    WHEN apogee_km < 2000 THEN 'LEO'
    WHEN perigee_km >= 2000 AND apogee_km <= 36086 THEN 'MEO' ELSE 'OTHER' END AS "primary"
  FROM tagged),
assessed AS (
  SELECT *, perigee_km - 35786 AS km_above_geo, CASE
    WHEN NOT ("primary" IN ('GEO', 'GRAVEYARD')
      OR (abs((apogee_km + perigee_km) / 2 - 35786) < 2000 AND ecc < 0.1)) THEN 'NOT_GEO_BELT'
    WHEN perigee_km >= 36021 AND ecc < 0.05 THEN 'COMPLIANT_GRAVEYARD'
    WHEN abs((apogee_km + perigee_km) / 2 - 35786) <= 100 AND incl_deg <= 15 AND ecc < 0.02
      THEN 'OPERATIONAL_OR_ABANDONED_IN_PLACE'
    WHEN abs(period_min - 86164.0905 / 60) / (86164.0905 / 60) < 0.03
      AND abs((apogee_km + perigee_km) / 2 - 35786) < 1500 AND incl_deg > 15
      THEN 'INCLINED_GEOSYNCHRONOUS'
    WHEN perigee_km > 35786 AND perigee_km - 35786 < 235 THEN 'NON_COMPLIANT_SHALLOW'
    ELSE 'BELOW_GEO_DRIFT' END AS disposal_status
  FROM classified)"""

COMPLIANT = """CASE WHEN disposal_status = 'COMPLIANT_GRAVEYARD' THEN 'true'
  WHEN disposal_status IN ('NON_COMPLIANT_SHALLOW', 'BELOW_GEO_DRIFT') THEN 'false' END"""


def state_ctes(source: str, seconds: str, name: str) -> str:
    """CTEs computing the state of ``source`` rows ``seconds`` after their epoch."""
    return f"""
{name}_1 AS (SELECT *, revs_per_day * 6.283185307179586e0 / 86400e0 AS n_, {seconds} AS dt_,
    radians(incl_deg) AS i_ FROM {source}),
{name}_2 AS (SELECT *, pow(398600.4418e0 / (n_ * n_), 1e0 / 3e0) AS a_ FROM {name}_1),
{name}_3 AS (SELECT *, a_ * (1e0 - ecc * ecc) AS p_ FROM {name}_2),
{name}_4 AS (SELECT *, (1.5e0 * 1.08262668e-3 * pow(6378.137e0, 2)) * n_ / (p_ * p_) AS k_
    FROM {name}_3),
{name}_5 AS (SELECT *, radians(raan_deg) - k_ * cos(i_) * dt_ AS node_,
    radians(argp_deg) + k_ * (2.0e0 - 2.5e0 * sin(i_) * sin(i_)) * dt_ AS peri_,
    (radians(mean_anom_deg) + n_ * dt_) % 6.283185307179586e0 AS m0_ FROM {name}_4),
{name}_6 AS (SELECT *, CASE WHEN m0_ < 0 THEN m0_ + 6.283185307179586e0 ELSE m0_ END AS m_
    FROM {name}_5),
{name}_7 AS (SELECT *, list_reduce([m_ + ecc * sin(m_), 0e0, 0e0, 0e0, 0e0, 0e0, 0e0, 0e0, 0e0],
    lambda e, z: e - (e - ecc * sin(e) - m_) / (1e0 - ecc * cos(e))) AS e_ FROM {name}_6),
{name}_8 AS (SELECT *, a_ * (cos(e_) - ecc) AS x_, a_ * sqrt(1e0 - ecc * ecc) * sin(e_) AS y_,
    -n_ * a_ / (1e0 - ecc * cos(e_)) * sin(e_) AS u_,
    n_ * a_ / (1e0 - ecc * cos(e_)) * sqrt(1e0 - ecc * ecc) * cos(e_) AS w_,
    cos(node_) * cos(peri_) - sin(node_) * sin(peri_) * cos(i_) AS px_,
    sin(node_) * cos(peri_) + cos(node_) * sin(peri_) * cos(i_) AS py_,
    sin(peri_) * sin(i_) AS pz_,
    -cos(node_) * sin(peri_) - sin(node_) * cos(peri_) * cos(i_) AS qx_,
    -sin(node_) * sin(peri_) + cos(node_) * cos(peri_) * cos(i_) AS qy_,
    cos(peri_) * sin(i_) AS qz_ FROM {name}_7),
{name} AS (SELECT *, x_ * px_ + y_ * qx_ AS rx, x_ * py_ + y_ * qy_ AS ry,
    x_ * pz_ + y_ * qz_ AS rz, u_ * px_ + w_ * qx_ AS vx, u_ * py_ + w_ * qy_ AS vy,
    u_ * pz_ + w_ * qz_ AS vz FROM {name}_8)"""


def _states(columns="rx ry rz vx vy vz") -> str:
    return ", ".join(r6(c, digits=4) for c in columns.split())


_OVERLAP = """least(a.apogee_km, b.apogee_km) - greatest(a.perigee_km, b.perigee_km)"""
_BANDS = """a.norad_id < b.norad_id AND a.perigee_km - 50 <= b.apogee_km + 50
    AND b.perigee_km - 50 <= a.apogee_km + 50"""
_ANGLE = """degrees(acos(greatest(-1.0, least(1.0, cos(radians(a.incl_deg))
    * cos(radians(b.incl_deg)) + sin(radians(a.incl_deg)) * sin(radians(b.incl_deg))
    * cos(radians(a.raan_deg - b.raan_deg))))))"""
SCREENED = f"""screened AS (
  SELECT a.norad_id AS norad_a, b.norad_id AS norad_b, {_OVERLAP} AS altitude_overlap_km,
    {_ANGLE} AS plane_angle_deg
  FROM elements a JOIN elements b ON {_BANDS} WHERE {_ANGLE} <= 30)"""

def ric_ctes(source: str, name: str) -> str:
    """CTEs with the motion of b around a of ``source`` rows in the rotating frame of a."""
    return f"""
{name}_a AS (SELECT *, a_ry * a_vz - a_rz * a_vy AS hx, a_rz * a_vx - a_rx * a_vz AS hy,
    a_rx * a_vy - a_ry * a_vx AS hz, a_rx * a_rx + a_ry * a_ry + a_rz * a_rz AS r2,
    b_rx - a_rx AS dx, b_ry - a_ry AS dy, b_rz - a_rz AS dz FROM {source}),
{name}_b AS (SELECT *, sqrt(hx * hx + hy * hy + hz * hz) AS hn, sqrt(r2) AS rn,
    (b_vx - a_vx) - (hy * dz - hz * dy) / r2 AS ux, (b_vy - a_vy) - (hz * dx - hx * dz) / r2 AS uy,
    (b_vz - a_vz) - (hx * dy - hy * dx) / r2 AS uz FROM {name}_a),
{name}_c AS (SELECT *, (hy * a_rz - hz * a_ry) / (hn * rn) AS ix,
    (hz * a_rx - hx * a_rz) / (hn * rn) AS iy, (hx * a_ry - hy * a_rx) / (hn * rn) AS iz
  FROM {name}_b),
{name} AS (SELECT *, (a_rx * dx + a_ry * dy + a_rz * dz) / rn AS rho_r, ix * dx + iy * dy + iz * dz AS rho_i,
    (hx * dx + hy * dy + hz * dz) / hn AS rho_c, (a_rx * ux + a_ry * uy + a_rz * uz) / rn AS vel_r,
    ix * ux + iy * uy + iz * uz AS vel_i, (hx * ux + hy * uy + hz * uz) / hn AS vel_c,
    sqrt(dx * dx + dy * dy + dz * dz) AS range_km, sqrt(ux * ux + uy * uy + uz * uz) AS speed_kms
  FROM {name}_c)"""


STATE = ["rx", "ry", "rz", "vx", "vy", "vz"]
SET = ["epoch_utc", "incl_deg", "raan_deg", "ecc", "argp_deg", "mean_anom_deg", "revs_per_day"]


def nearest_ctes(grid: str, who: str, name: str) -> str:
    """CTE ``name``: grid rows with the element set of ``who`` nearest in time, as plain columns."""
    return f"""
{name} AS (SELECT g.*, {', '.join(f'h.{c}' for c in SET)} FROM {grid} g
  JOIN history h ON h.norad_id = g.{who} AND abs(h.epoch_utc - g.t) <= 259200000
  QUALIFY row_number() OVER (PARTITION BY actor, target, t
    ORDER BY abs(h.epoch_utc - g.t), h.epoch_utc) = 1)"""


def aligned_ctes(step_ms: int) -> str:
    """CTE ``aligned``: states a_ and b_ of neighbouring pairs on their common grid."""
    side = lambda p: ", ".join(f"{c} AS {p}_{c}" for c in STATE)
    return f"""
span AS (SELECT norad_id, min(epoch_utc) AS t0, max(epoch_utc) AS t1 FROM history GROUP BY 1),
common AS (SELECT actor, target, greatest(a.t0, b.t0) AS t0, least(a.t1, b.t1) AS t1
  FROM neighbour_pairs p JOIN span a ON a.norad_id = actor JOIN span b ON b.norad_id = target),
grid AS (SELECT actor, target, unnest(range(t0, t0 + {step_ms} * greatest(
    2, (t1 - t0) // {step_ms} + 1), {step_ms})) AS t FROM common WHERE t1 > t0),
{nearest_ctes('grid', 'actor', 'near_a')}, {state_ctes('near_a', '(t - epoch_utc) / 1000e0', 'at_a')},
{nearest_ctes('grid', 'target', 'near_b')}, {state_ctes('near_b', '(t - epoch_utc) / 1000e0', 'at_b')},
aligned AS (SELECT * FROM (SELECT actor, target, t, {side('a')} FROM at_a) x
  JOIN (SELECT actor, target, t, {side('b')} FROM at_b) y USING (actor, target, t)
  WHERE a_rx * a_rx + a_ry * a_ry + a_rz * a_rz >= 6378.137e0 * 6378.137e0
    AND b_rx * b_rx + b_ry * b_ry + b_rz * b_rz >= 6378.137e0 * 6378.137e0)"""


_AT = "timestamp'2024-01-12 06:00:00'"
_AT_MS = 1705039200000


# nearest usable asset of every object at its own epoch: CTE ``best``
NEAREST = f"""{state_ctes('elements', '0e0', 'own')},
usable AS (SELECT norad_id, epoch_utc AS t, rx AS ox, ry AS oy, rz AS oz FROM own
  WHERE abs(1705276800000 - epoch_utc) <= 2592000000
    AND sqrt(rx * rx + ry * ry + rz * rz) >= 6378.137),
met AS (SELECT o.norad_id AS id, t, ox, oy, oz, a.name AS asset_name, e.* FROM usable o
  JOIN assets a ON a.norad_id <> o.norad_id JOIN elements e ON e.norad_id = a.norad_id),
{state_ctes('met', '(t - epoch_utc) / 1000e0', 'hit')},
gaps AS (SELECT id, norad_id AS asset_id, asset_name,
    sqrt(pow(rx - ox, 2) + pow(ry - oy, 2) + pow(rz - oz, 2)) AS gap FROM hit
  WHERE sqrt(rx * rx + ry * ry + rz * rz) >= 6378.137),
best AS (SELECT * FROM gaps WHERE gap >= 2
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY gap, asset_id) = 1)"""
RAMP = """(CASE WHEN gap <= 50 THEN 1.0 WHEN gap >= 5000 THEN 0.0
  WHEN gap IS NOT NULL THEN 1.0 - (gap - 50) / 4950 END)::DOUBLE"""
SENSITIVITY = """(least(1.0, CASE "primary" WHEN 'GEO' THEN 1.0 WHEN 'GRAVEYARD' THEN 0.9
    WHEN 'MEO' THEN 0.6 WHEN 'LEO' THEN 0.5 WHEN 'HEO' THEN 0.5 WHEN 'GTO' THEN 0.4 ELSE 0.3 END
  + CASE WHEN contains(special_tags, 'MOLNIYA') OR contains(special_tags, 'TUNDRA') THEN 0.2
    WHEN contains(special_tags, 'SSO') THEN 0.15 ELSE 0 END))::DOUBLE"""

_PATH = """CASE WHEN {0} > 2 THEN 2 * (ln({0} - 1) + 0.5772156649015329) - 2e0 * ({0} - 1) / {0}
  WHEN {0} = 2 THEN 1e0 ELSE 0e0 END"""
_TREES, _SAMPLE = K.FOREST_TREES, K.FOREST_SAMPLE
_LEVELS = math.ceil(math.log2(_SAMPLE))


def _draw(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, {anomaly._DRAW_DIGITS}) AS BIGINT)"


def _level(n: int) -> str:
    """CTEs of one level of all trees: its nodes, where its rows go, where its paths go."""
    return f"""
t{n} AS (SELECT tree, node, len(r) AS size, {n} < least({_LEVELS}, any_limit) AND len(f) > 0 AS split, f,
    lo, hi FROM (SELECT *, list_filter([1, 2, 3, 4, 5], lambda i: hi[i] > lo[i]) AS f FROM (
      SELECT tree, node, list(norad_id) AS r, any_value(lim) AS any_limit,
        [{', '.join(f'min(xs[{i}])' for i in range(1, 6))}] AS lo,
        [{', '.join(f'max(xs[{i}])' for i in range(1, 6))}] AS hi FROM s{n} GROUP BY tree, node) q) q),
n{n} AS (SELECT tree, node, size, CASE WHEN split THEN f[CAST({_draw("tree || ':' || node || ':f'")}
      % len(f) + 1 AS BIGINT)] END AS feature, lo, hi,
    {_draw("tree || ':' || node || ':t'")} / {anomaly._DRAWS}e0 AS share FROM t{n}),
d{n} AS (SELECT tree, node, size, feature, lo[feature] + (hi[feature] - lo[feature]) * share AS cut FROM n{n}),
s{n + 1} AS (SELECT s.* REPLACE (2 * s.node + (xs[feature] > cut)::INT AS node)
  FROM s{n} s JOIN d{n} USING (tree, node) WHERE feature IS NOT NULL),
w{n} AS (SELECT p.*, size, feature, cut FROM p{n} p JOIN d{n} USING (tree, node)),
p{n + 1} AS (SELECT norad_id, tree, 2 * node + (xs[feature] > cut)::INT AS node, xs FROM w{n}
  WHERE feature IS NOT NULL)"""


_FOREST = f"""
f AS (SELECT norad_id, log10(apogee_km + 1) AS x0, log10(perigee_km + 1) AS x1, inclination AS x2,
    (apogee_km - perigee_km) / (apogee_km + perigee_km + 2 * 6378.137) AS x3,
    coalesce(period_min, 0) AS x4
  FROM satcat WHERE decay_date IS NULL AND apogee_km > 0 AND perigee_km > 0 AND inclination IS NOT NULL),
z AS (SELECT norad_id, [{', '.join(
    f'(x{i} - avg(x{i}) OVER ()) / coalesce(nullif(stddev_pop(x{i}) OVER (), 0), 1)' for i in range(5))}] AS xs
  FROM f),
hands AS (SELECT greatest(1, count(*) // {2 * _SAMPLE}) AS h, count(*) AS n FROM z),
dealt AS (SELECT z.*, h * deal + {_draw("norad_id || ':' || deal || ':42'")} % h AS tree,
    {_draw("norad_id || ':' || deal || ':42:u'")} AS u
  FROM z, hands, (SELECT unnest(range({_TREES})) AS deal) WHERE deal < ceil({_TREES}e0 / h)),
chosen AS (SELECT norad_id, xs, tree FROM dealt WHERE tree < {_TREES}
  QUALIFY row_number() OVER (PARTITION BY tree ORDER BY u, norad_id) <= {_SAMPLE}),
s0 AS (SELECT *, 1 AS node, ceil(log2(greatest(count(*) OVER (PARTITION BY tree), 2))) AS lim FROM chosen),
p0 AS (SELECT norad_id, tree, 1 AS node, xs FROM z, (SELECT DISTINCT tree FROM chosen) q),
{', '.join(map(_level, range(_LEVELS + 1)))},
ends AS ({' UNION ALL '.join(
    f'SELECT norad_id, {n} + {_PATH.format("size")} AS path FROM w{n} WHERE feature IS NULL'
    for n in range(_LEVELS + 1))}),
raw AS (SELECT norad_id, pow(2, -sum(path) / ((SELECT count(DISTINCT tree) FROM chosen)
    * (SELECT {_PATH.format(f"least(n, {_SAMPLE})")} FROM hands))) AS raw FROM ends GROUP BY 1)"""


def _elements(s, d):
    return view(s, d, "elements")


QUERIES = {
    "mean_elements": Query(
        lambda s, d: plain(el.mean_elements(_elements(s, d).drop(
            "semi_major_km", "apogee_km", "perigee_km", "period_min")).select(
            "norad_id", "mean_motion_rad_s", "semi_major_km", "apogee_km", "perigee_km",
            "period_min"), digits=4),
        oracle(["elements"], f"""
            WITH a AS (SELECT norad_id, ecc, revs_per_day * 6.283185307179586e0 / 86400e0 AS n
                       FROM elements),
            b AS (SELECT *, pow(398600.4418e0 / (n * n), 1e0 / 3e0) AS sma FROM a)
            SELECT norad_id, {r6('n', 'mean_motion_rad_s', 4)}, {r6('sma', 'semi_major_km', 4)},
              {r6('sma * (1 + ecc) - 6378.137', 'apogee_km', 4)},
              {r6('sma * (1 - ecc) - 6378.137', 'perigee_km', 4)},
              {r6('6.283185307179586e0 / n / 60', 'period_min', 4)} FROM b""")),
    "coarse_regime": Query(
        lambda s, d: el.coarse_regime(_elements(s, d)).select("norad_id", "regime"),
        oracle(["elements"], f"SELECT norad_id, {COARSE} AS regime FROM elements")),
    "required_sso_inclination": Query(
        lambda s, d: plain(_elements(s, d).select("norad_id", orbits.required_sso_inclination(
            F.col("semi_major_km"), F.col("ecc")).alias("sso_incl_deg"))),
        oracle(["elements"], f"SELECT norad_id, {r6('sso_incl_deg')} FROM {SSO} t")),
    "special_orbit_tags": Query(
        lambda s, d: plain(el.special_orbit_tags(_elements(s, d)).select(
            "norad_id", "special_tags")),
        oracle(["elements"], f"WITH {LADDER} SELECT norad_id, special_tags FROM tagged")),
    "classify_regime": Query(
        lambda s, d: el.classify_regime(_elements(s, d)).select("norad_id", "primary", "label"),
        oracle(["elements"], f"""WITH {LADDER}
            SELECT norad_id, "primary", CASE WHEN special_tags = '' THEN "primary" ELSE
              "primary" || ' [' || replace(special_tags, ',', ', ') || ']' END AS label
            FROM classified""")),
    "assess_disposal": Query(
        lambda s, d: plain(el.assess_disposal(el.classify_regime(_elements(s, d))).select(
            "norad_id", "disposal_status", "km_above_geo", "compliant")),
        oracle(["elements"], f"""WITH {LADDER}
            SELECT norad_id, disposal_status, {r6('km_above_geo')}, {COMPLIANT} AS compliant
            FROM assessed""")),
    "disposal_scan": Query(
        lambda s, d: el.disposal_scan(_elements(s, d)),
        oracle(["elements"], f"""WITH {LADDER}
            SELECT disposal_status, count(*) AS n_objects FROM assessed GROUP BY 1""")),
    "disposal_flagged": Query(
        lambda s, d: plain(el.disposal_flagged(_elements(s, d))),
        oracle(["elements"], f"""WITH {LADDER}
            SELECT norad_id, disposal_status, {r6('km_above_geo')}, {r6('incl_deg')}
            FROM assessed WHERE {COMPLIANT} = 'false' ORDER BY km_above_geo""")),
    "regime_counts": Query(
        lambda s, d: el.regime_counts(el.coarse_regime(_elements(s, d))),
        oracle(["elements"], f"""SELECT {COARSE} AS regime, count(*) AS n_objects
            FROM elements GROUP BY 1""")),
    "regime_sensitivity": Query(
        lambda s, d: plain(score.regime_sensitivity(el.classify_regime(_elements(s, d))).select(
            "norad_id", "regime_sensitivity")),
        oracle(["elements"], f"""WITH {LADDER}
            SELECT norad_id, round({SENSITIVITY}, 6)
              AS regime_sensitivity FROM classified""")),
    "burn_direction": Query(
        lambda s, d: view(s, d, "residuals").select("event_id", orbits.burn_direction(
            F.col("dv_r_ms"), F.col("dv_i_ms"), F.col("dv_c_ms")).alias("direction")),
        oracle(["residuals"], """
            SELECT event_id, CASE
              WHEN abs(dv_r_ms) + abs(dv_i_ms) + abs(dv_c_ms) = 0 THEN 'mixed'
              WHEN abs(dv_i_ms) / (abs(dv_r_ms) + abs(dv_i_ms) + abs(dv_c_ms)) > 0.7
                THEN CASE WHEN dv_i_ms > 0 THEN 'prograde' ELSE 'retrograde' END
              WHEN abs(dv_c_ms) / (abs(dv_r_ms) + abs(dv_i_ms) + abs(dv_c_ms)) > 0.7
                THEN 'plane-change'
              WHEN abs(dv_r_ms) / (abs(dv_r_ms) + abs(dv_i_ms) + abs(dv_c_ms)) > 0.7
                THEN 'radial' ELSE 'mixed' END AS direction FROM residuals""")),
    "hard_body_radius": Query(
        lambda s, d: plain(view(s, d, "satcat").select("norad_id", orbits.hard_body_radius_km(
            F.col("rcs_m2")).alias("radius_km"))),
        oracle(["satcat"], """SELECT norad_id, round(CASE WHEN rcs_m2 IS NULL OR rcs_m2 <= 0
              THEN 0.005 ELSE greatest(sqrt(rcs_m2 / pi()) / 1000, 0.001) END::DOUBLE, 6)
              AS radius_km FROM satcat""")),
    "modelled_sigma": Query(
        lambda s, d: plain(view(s, d, "residuals").withColumn(
            "age_days", F.col("dv_ms") / 10 - 2).select("event_id", *[
                orbits.modelled_sigma_km(F.col("age_days"), x).alias(f"sigma_{x}_km")
                for x in "ric"])),
        oracle(["residuals"], """
            WITH a AS (SELECT event_id, greatest(dv_ms / 10 - 2, 0) AS age FROM residuals)
            SELECT event_id, round(0.10 + 0.02 * age, 6) + 0.0 AS sigma_r_km,
              round(0.20 + 0.15 * age, 6) + 0.0 AS sigma_i_km,
              round(0.10 + 0.01 * age, 6) + 0.0 AS sigma_c_km FROM a""")),
    "propagate_at": Query(
        lambda s, d: plain(trajectory.propagate_at(
            _elements(s, d), F.expr(_AT)).drop("t"), digits=4),
        oracle(["elements"], f"""WITH
            {state_ctes('elements', f'({_AT_MS} - epoch_utc) / 1000e0', 'st')}
            SELECT norad_id, {_states()} FROM st
            WHERE sqrt(rx * rx + ry * ry + rz * rz) >= 6378.137""")),
    "ephemeris_grid": Query(
        lambda s, d: plain(trajectory.ephemeris_grid(
            _elements(s, d), F.expr(_AT), F.expr(_AT) + F.expr("INTERVAL 1 HOUR"), 600.0)
            .select("norad_id", "t", "rx", "ry", "rz"), digits=4),
        oracle(["elements"], f"""
            WITH grid AS (SELECT e.*, t.t FROM elements e
              CROSS JOIN (SELECT {_AT_MS} + 600000 * i AS t FROM range(7) r(i)) t),
            {state_ctes('grid', '(t - epoch_utc) / 1000e0', 'st')}
            SELECT norad_id, t, {_states('rx ry rz')} FROM st
            WHERE sqrt(rx * rx + ry * ry + rz * rz) >= 6378.137""")),
    "ground_track": Query(
        lambda s, d: plain(trajectory.ground_track(trajectory.ephemeris_grid(
            _elements(s, d), F.expr(_AT), F.expr(_AT) + F.expr("INTERVAL 30 MINUTE"), 600.0)),
            digits=4),
        oracle(["elements"], f"""
            WITH grid AS (SELECT e.*, t.t FROM elements e
              CROSS JOIN (SELECT {_AT_MS} + 600000 * i AS t FROM range(4) r(i)) t),
            {state_ctes('grid', '(t - epoch_utc) / 1000e0', 'st')},
            turned AS (SELECT *, sqrt(rx * rx + ry * ry) AS q, 1 / 298.257223563e0 AS f,
                radians((280.46061837e0 + 360.98564736629e0 * (t / 86400000e0 - 10957.5e0)) % 360e0) AS g
              FROM st WHERE sqrt(rx * rx + ry * ry + rz * rz) >= 6378.137),
            shaped AS (SELECT *, f * (2 - f) AS e2, 6378.137e0 * (1 - f) AS b,
                atan2(rz * 6378.137e0, q * 6378.137e0 * (1 - f)) AS th FROM turned),
            placed AS (SELECT *, atan2(rz + e2 / (1 - e2) * b * pow(sin(th), 3),
                q - e2 * 6378.137e0 * pow(cos(th), 3)) AS lat,
                (atan2(ry, rx) - g + pi()) % (2 * pi()) AS turn FROM shaped)
            SELECT norad_id, t, {r6('degrees(lat)', 'lat_deg', 4)},
              {r6('degrees(CASE WHEN turn < 0 THEN turn + 2 * pi() ELSE turn END - pi())', 'lon_deg', 4)},
              {r6('q * cos(lat) + rz * sin(lat) - 6378.137e0 * sqrt(1 - e2 * sin(lat) * sin(lat))',
                  'alt_km', 4)}
            FROM placed""")),
    "nearest_epoch_join": Query(
        lambda s, d: plain(trajectory.nearest_epoch_join(
            view(s, d, "coarse_sets").select("norad_id", F.col("epoch").alias("t"))
            .distinct(), view(s, d, "element_sets").select("norad_id", "epoch", "event_id"), max_gap_days=1.0)
            .select("norad_id", "t", F.col("nearest.event_id").alias("event_id"))),
        oracle(["coarse_sets", "element_sets"], """
            WITH grid AS (SELECT DISTINCT norad_id, epoch_utc AS t FROM coarse_sets),
            held AS (SELECT norad_id, epoch_utc, event_id FROM element_sets)
            SELECT g.norad_id, g.t, first(h.event_id ORDER BY abs(h.epoch_utc - g.t),
                h.epoch_utc) AS event_id
            FROM grid g LEFT JOIN held h ON h.norad_id = g.norad_id
              AND abs(h.epoch_utc - g.t) <= 86400000 GROUP BY 1, 2""")),
    "ric_relative": Query(
        lambda s, d: plain(trajectory.ric_relative(view(s, d, "relative")).select(
            "norad_id", "rho_r", "rho_i", "rho_c", "vel_r", "vel_i", "vel_c", "range_km",
            "speed_kms"), digits=5),
        oracle(["relative"], f"""
            WITH {ric_ctes('relative', 'rel')}
            SELECT norad_id, {', '.join(r6(c, digits=5) for c in (
                'rho_r', 'rho_i', 'rho_c', 'vel_r', 'vel_i', 'vel_c', 'range_km', 'speed_kms'))}
            FROM rel""")),
    "cw_propagate": Query(
        lambda s, d: plain(trajectory.cw_propagate(_elements(s, d).select(
            "norad_id", F.expr("(norad_id % 13) * 0.1e0").alias("x"),
            F.expr("(norad_id % 7) * 0.2e0").alias("y"), F.expr("(norad_id % 5) * 0.3e0").alias("z"),
            F.expr("(norad_id % 3) * 1e-4").alias("vx"), F.expr("(norad_id % 4) * 1e-4").alias("vy"),
            F.expr("(norad_id % 6) * 1e-4").alias("vz"), "revs_per_day"),
            orbits.mean_motion_rad_s(F.col("revs_per_day")), F.lit(1800.0)).select(
            "norad_id", "cw_x", "cw_y", "cw_z", "cw_vx", "cw_vy", "cw_vz")),
        oracle(["elements"], f"""
            WITH a AS (SELECT norad_id, (norad_id % 13) * 0.1e0 AS x, (norad_id % 7) * 0.2e0 AS y,
                (norad_id % 5) * 0.3e0 AS z, (norad_id % 3) * 1e-4 AS vx,
                (norad_id % 4) * 1e-4 AS vy, (norad_id % 6) * 1e-4 AS vz,
                revs_per_day * 6.283185307179586e0 / 86400e0 AS n FROM elements),
            b AS (SELECT *, sin(n * 1800.0) AS s, cos(n * 1800.0) AS c FROM a)
            SELECT norad_id,
              {r6('(4 - 3 * c) * x + s / n * vx + 2 * (1 - c) / n * vy', 'cw_x')},
              {r6('6 * (s - n * 1800.0) * x + y + 2 * (c - 1) / n * vx + (4 * s - 3 * n * 1800.0) / n * vy', 'cw_y')},
              {r6('c * z + s / n * vz', 'cw_z')},
              {r6('3 * n * s * x + c * vx + 2 * s * vy', 'cw_vx')},
              {r6('6 * n * (c - 1) * x - 2 * s * vx + (4 * c - 3) * vy', 'cw_vy')},
              {r6('c * vz - n * s * z', 'cw_vz')} FROM b""")),
    "altitude_overlap_pairs": Query(
        lambda s, d: conjunction.altitude_overlap_pairs(_elements(s, d)),
        oracle(["elements"], f"""SELECT a.norad_id AS norad_a, b.norad_id AS norad_b
            FROM elements a JOIN elements b ON {_BANDS}""")),
    "plane_angle_filter": Query(
        lambda s, d: plain(conjunction.plane_angle_filter(
            view(s, d, "neighbour_pairs").select(
                F.col("actor").alias("norad_a"), F.col("target").alias("norad_b")),
            _elements(s, d))),
        oracle(["neighbour_pairs", "elements"], f"""
            SELECT actor AS norad_a, target AS norad_b, {r6(_OVERLAP, 'altitude_overlap_km')},
              {r6(_ANGLE, 'plane_angle_deg')} FROM neighbour_pairs p
            JOIN elements a ON a.norad_id = p.actor JOIN elements b ON b.norad_id = p.target
            WHERE {_ANGLE} <= 30""")),
    "screened_pairs": Query(
        lambda s, d: plain(conjunction.screened_pairs(_elements(s, d)), digits=4),
        oracle(["elements"], f"""WITH {SCREENED}
            SELECT norad_a, norad_b, {r6('altitude_overlap_km', digits=4)},
              {r6('plane_angle_deg', digits=4)} FROM screened""")),
    "screen_conjunctions": Query(
        lambda s, d: plain(conjunction.screen_conjunctions(
            _elements(s, d).withColumn("raan_deg", F.expr("raan_deg + norad_id * 1e-3")), 60),
            digits=4),
        oracle(["elements"], f"""
            WITH e2 AS (SELECT * REPLACE (raan_deg + norad_id * 1e-3 AS raan_deg) FROM elements),
            {SCREENED.replace('elements', 'e2')}
            SELECT norad_a, norad_b, {r6('altitude_overlap_km', digits=4)},
              {r6('plane_angle_deg', digits=4)} FROM screened
            ORDER BY screened.plane_angle_deg, norad_a, norad_b LIMIT 60""")),
    "screening_summary": Query(
        lambda s, d: plain(conjunction.screening_summary(_elements(s, d))),
        oracle(["elements"], f"""WITH {SCREENED}
            SELECT (SELECT count(*) FROM elements) AS n_objects,
              (SELECT count(*) * (count(*) - 1) // 2 FROM elements) AS n_pairs,
              (SELECT count(*) FROM screened) AS n_candidates""")),
    "anomaly_features": Query(
        lambda s, d: plain(anomaly.anomaly_features(view(s, d, "satcat").where(
            "decay_date IS NULL"))),
        oracle(["satcat"], f"""
            WITH f AS (SELECT norad_id, log10(apogee_km + 1) AS x0, log10(perigee_km + 1) AS x1,
                inclination AS x2, (apogee_km - perigee_km)
                  / (apogee_km + perigee_km + 2 * 6378.137) AS x3, coalesce(period_min, 0) AS x4
              FROM satcat WHERE decay_date IS NULL AND apogee_km > 0 AND perigee_km > 0
                AND inclination IS NOT NULL),
            z AS (SELECT norad_id, {', '.join(
                f'(x{i} - avg(x{i}) OVER ()) / coalesce(nullif(stddev_pop(x{i}) OVER (), 0), 1) AS x{i}'
                for i in range(5))} FROM f),
            t AS (SELECT *, list_position(list_transform([x0, x1, x2, x3, x4], lambda v: abs(v)),
                list_max(list_transform([x0, x1, x2, x3, x4], lambda v: abs(v)))) AS pos FROM z)
            SELECT norad_id, {', '.join(r6(f'x{i}') for i in range(5))},
              ['apogee (log)', 'perigee (log)', 'inclination', 'eccentricity', 'period'][pos]
                AS top_feature, {r6('[x0, x1, x2, x3, x4][pos]', 'top_feature_z')} FROM t""")),
    "anomaly_scores": Query(
        lambda s, d: plain(anomaly.fit_anomaly_model(
            view(s, d, "satcat").where("decay_date IS NULL")).scores()),
        oracle(["satcat"], f"""WITH {_FOREST}
            SELECT norad_id, {r6('CASE WHEN high > low THEN (raw - low) / (high - low) ELSE 0 END', 'score')},
              CAST(raw > 0.5 AS STRING) AS is_outlier,
              ['apogee (log)', 'perigee (log)', 'inclination', 'eccentricity', 'period'][pos]
                AS top_feature, {r6('xs[pos]', 'top_feature_z')}
            FROM (SELECT r.*, z.xs, list_position(list_transform(xs, lambda v: abs(v)),
                list_max(list_transform(xs, lambda v: abs(v)))) AS pos,
                min(raw) OVER () AS low, max(raw) OVER () AS high FROM raw r JOIN z USING (norad_id)) q""")),
    "proximity_to_assets": Query(
        lambda s, d: plain(score.proximity_to_assets(
            _elements(s, d), view(s, d, "assets").join(_elements(s, d).drop("name"), "norad_id"),
            "2024-01-15"), digits=4),
        oracle(["elements", "assets"], f"""
            WITH {NEAREST}
            SELECT e.norad_id, asset_id, asset_name, round(gap, 4) + 0.0 AS nearest_km,
              round({RAMP}, 4) + 0.0 AS proximity_to_hva
            FROM elements e LEFT JOIN best b ON b.id = e.norad_id""")),
}
