"""Residuals, manoeuvres, campaigns, change-points and decay."""

from pyspark.sql import functions as F

from orbitframe.operators import behaviour, decay, maneuver, score
from orbitframe.plans.adapters import oracle, view
from orbitframe.plans.compare import plain, r6
from orbitframe.plans.orbit_queries import SET, STATE, ric_ctes, state_ctes
from orbitframe.plans.query import Query

FLOORS = """
med AS (SELECT norad_id, count(*) AS n, median(dv_ms) AS m FROM residuals GROUP BY 1),
mads AS (SELECT norad_id, median(abs(dv_ms - m)) AS mad FROM residuals JOIN med USING (norad_id)
  GROUP BY 1),
floors AS (SELECT norad_id, n, m, mad, greatest(1.4826 * mad, 1e-3) AS sigma
  FROM med JOIN mads USING (norad_id) WHERE n >= 6)"""


def flagged(z: float) -> str:
    return FLOORS + f""",
flagged AS (SELECT r.*, m AS floor_ms, (dv_ms - m) / sigma AS zscore
  FROM residuals r JOIN floors USING (norad_id) WHERE (dv_ms - m) / sigma >= {z})"""


CAMPAIGNS = flagged(2.0) + """,
marks AS (SELECT *, CASE WHEN epoch_utc - lag(epoch_utc) OVER w <= 86400000 THEN 0 ELSE 1 END AS s
  FROM flagged WINDOW w AS (PARTITION BY norad_id ORDER BY epoch_utc, event_id)),
runs AS (SELECT *, sum(s) OVER (PARTITION BY norad_id ORDER BY epoch_utc, event_id) AS run
  FROM marks),
camps AS (SELECT norad_id, min(epoch_utc) AS start_epoch, max(epoch_utc) AS end_epoch,
    max(dv_ms) AS peak_dv_ms, first(epoch_utc ORDER BY dv_ms DESC, epoch_utc) AS peak_epoch,
    count(*) AS n_pulses FROM runs GROUP BY norad_id, run),
timed AS (SELECT *, (start_epoch - lag(start_epoch) OVER (PARTITION BY norad_id
    ORDER BY start_epoch)) / 86400000e0 AS tempo_days FROM camps)"""

BASELINE = CAMPAIGNS + """,
b1 AS (SELECT norad_id, count(*) AS n_campaigns, median(peak_dv_ms) AS typical_dv_ms,
    median(tempo_days) AS typical_tempo_days FROM timed GROUP BY 1 HAVING count(*) >= 3),
baseline AS (SELECT norad_id, any_value(n_campaigns) AS n_campaigns,
    any_value(typical_dv_ms) AS typical_dv_ms,
    any_value(typical_tempo_days) AS typical_tempo_days,
    median(abs(peak_dv_ms - typical_dv_ms)) AS dv_mad_ms,
    median(abs(tempo_days - typical_tempo_days)) AS tempo_mad_days
  FROM timed JOIN b1 USING (norad_id) GROUP BY 1)"""

CLASSIFIED = BASELINE + """,
scored AS (SELECT t.*, (peak_dv_ms - typical_dv_ms)
      / greatest(1.4826 * dv_mad_ms, 0.15 * typical_dv_ms, 1e-3) AS dv_z,
    (tempo_days - typical_tempo_days)
      / greatest(1.4826 * tempo_mad_days, 0.15 * typical_tempo_days, 1e-3) AS tempo_z
  FROM timed t JOIN baseline USING (norad_id)),
classified AS (SELECT *, CASE WHEN abs(dv_z) >= 3 OR coalesce(abs(tempo_z) >= 3, false)
    THEN 'anomalous' ELSE 'routine' END AS label FROM scored)"""


def split(value: str, name: str) -> str:
    """CTE ``name``: best split of ``value`` per object."""
    return f"""
{name}_w AS (SELECT norad_id, start_epoch,
    count({value}) OVER b AS k, count({value}) OVER a AS m, avg({value}) OVER b AS before_mean,
    avg({value}) OVER a AS after_mean, var_samp({value}) OVER b AS va,
    var_samp({value}) OVER a AS vb
  FROM timed WHERE {value} IS NOT NULL
  WINDOW b AS (PARTITION BY norad_id ORDER BY start_epoch
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    a AS (PARTITION BY norad_id ORDER BY start_epoch
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
{name}_t AS (SELECT *, abs(before_mean - after_mean) / (sqrt(greatest(
    ((k - 1) * va + (m - 1) * vb) / (k + m - 2), 1e-12)) * sqrt(1e0 / k + 1e0 / m)) AS t_stat
  FROM {name}_w WHERE k >= 3 AND m >= 3),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY norad_id
    ORDER BY t_stat DESC, k) AS pick FROM {name}_t) q WHERE pick = 1)"""


DECAY = """
span AS (SELECT norad_id, count(*) AS n_points, min(epoch_utc) AS t0, max(epoch_utc) AS t1
  FROM perigee_series GROUP BY 1 HAVING count(*) >= 6),
placed AS (SELECT p.*, n_points, t1, (epoch_utc - t0) / 86400000e0 AS days,
    row_number() OVER (PARTITION BY norad_id ORDER BY epoch_utc, event_id) AS pos
  FROM perigee_series p JOIN span USING (norad_id)),
trend AS (SELECT norad_id, any_value(n_points) AS n_points, any_value(t1) AS latest_epoch,
    arg_max(perigee_km, pos) AS latest_perigee_km, -regr_slope(perigee_km, days) AS overall_rate,
    regr_r2(perigee_km, days) AS fit_r2,
    -regr_slope(perigee_km, days) FILTER (pos <= n_points // 2) AS old_rate,
    -regr_slope(perigee_km, days) FILTER (pos > n_points // 2) AS new_rate,
    avg(perigee_km) FILTER (pos <= n_points // 2) AS old_alt_km,
    avg(perigee_km) FILTER (pos > n_points // 2) AS new_alt_km
  FROM placed GROUP BY 1)"""

DECAY_FULL = DECAY + """,
staged AS (SELECT *, CASE WHEN latest_perigee_km > 2000 THEN 'too_high'
    WHEN overall_rate < 0.02 THEN 'stable' WHEN latest_perigee_km <= 100 THEN 'imminent'
    ELSE 'estimated' END AS outcome,
    n_points >= 12 AND new_rate > 1.15 * greatest(old_rate, 1e-6) AS growing FROM trend),
rated AS (SELECT *, CASE WHEN outcome = 'estimated' AND n_points >= 12
      THEN greatest(new_rate, 0.02) ELSE overall_rate END AS decay_rate,
    CASE WHEN outcome = 'estimated' THEN growing ELSE outcome = 'imminent' END AS accelerating,
    CASE WHEN outcome = 'estimated' AND growing AND new_alt_km < old_alt_km
        AND new_rate > old_rate AND old_rate > 0
      THEN greatest(20, least(90, (old_alt_km - new_alt_km) / ln(new_rate / old_rate))) END AS h
  FROM staged),
dated AS (SELECT *, CASE WHEN outcome = 'estimated' THEN (latest_perigee_km - 100) / decay_rate
    WHEN outcome = 'imminent' THEN 0 END AS linear_days FROM rated),
predicted AS (SELECT *, CASE WHEN h IS NOT NULL
    THEN h / decay_rate * (1 - exp(-(latest_perigee_km - 100) / h)) ELSE linear_days END
    AS days_to_reentry,
    CASE WHEN h IS NOT NULL THEN 'exponential-atmosphere' ELSE 'linear' END AS model FROM dated)"""


def _residuals(s, d):
    return view(s, d, "residuals")


def _flagged(s, d, z=2.0):
    return maneuver.detect_maneuvers(_residuals(s, d), z_flag=z)


def _camps(s, d):
    return behaviour.campaigns(_flagged(s, d), tie=["event_id"])


def _series(s, d):
    return view(s, d, "perigee_series")


def split_query(column: str) -> Query:
    return Query(
        lambda s, d: plain(behaviour.best_split(
            behaviour.with_tempo(_camps(s, d)), ["norad_id"], "start_epoch", column)),
        oracle(["residuals"], f"""WITH {CAMPAIGNS}, {split(column, 'best')}
            SELECT norad_id, k, {r6('t_stat')}, {r6('before_mean')}, {r6('after_mean')},
              start_epoch AS split_at FROM best"""))


QUERIES = {
    "consecutive_pairs": Query(
        lambda s, d: plain(maneuver.consecutive_pairs(
            view(s, d, "element_sets"), ["epoch", "event_id"]).select(
            "norad_id", "event_id", F.col("prev.event_id").alias("prev_event_id"), "gap_days")),
        oracle(["element_sets"], f"""
            WITH p AS (SELECT norad_id, event_id, lag(event_id) OVER w AS prev_event_id,
                (epoch_utc - lag(epoch_utc) OVER w) / 86400000e0 AS gap_days FROM element_sets
              WINDOW w AS (PARTITION BY norad_id ORDER BY epoch_utc))
            SELECT norad_id, event_id, prev_event_id, {r6('gap_days')} FROM p
            WHERE gap_days > 0 AND gap_days <= 10""")),
    "pair_residuals": Query(
        lambda s, d: plain(maneuver.pair_residuals(view(s, d, "history")), digits=3),
        oracle(["history"], f"""
            WITH {state_ctes('history', '0e0', 'own')},
            held AS (SELECT norad_id, {', '.join(SET)},
                lead(epoch_utc) OVER (PARTITION BY norad_id ORDER BY epoch_utc) AS t FROM history),
            kept AS (SELECT * FROM held WHERE t - epoch_utc > 0 AND t - epoch_utc <= 864000000),
            {state_ctes('kept', '(t - epoch_utc) / 1000e0', 'told')},
            both_ AS (SELECT p.norad_id, p.t, (p.t - p.epoch_utc) / 86400000e0 AS gap_days,
                {', '.join(f'o.{c} AS a_{c}, p.{c} AS b_{c}' for c in STATE)}
              FROM told p JOIN own o ON o.norad_id = p.norad_id AND o.epoch_utc = p.t
              WHERE sqrt(o.rx * o.rx + o.ry * o.ry + o.rz * o.rz) >= 6378.137
                AND sqrt(p.rx * p.rx + p.ry * p.ry + p.rz * p.rz) >= 6378.137),
            {ric_ctes('both_', 'rel')}
            SELECT norad_id, t AS epoch, {r6('gap_days', digits=3)},
              {r6('1000 * speed_kms', 'dv_ms', 3)}, {r6('-1000 * vel_r', 'dv_r_ms', 3)},
              {r6('-1000 * vel_i', 'dv_i_ms', 3)}, {r6('-1000 * vel_c', 'dv_c_ms', 3)},
              {r6('range_km', 'pos_err_km', 3)} FROM rel""")),
    "noise_floor": Query(
        lambda s, d: plain(maneuver.noise_floor(_residuals(s, d))),
        oracle(["residuals"], f"""WITH {FLOORS}
            SELECT norad_id, n AS n_residuals, {r6('m', 'floor_ms')}, {r6('mad', 'mad_ms')},
              {r6('sigma', 'sigma_ms')} FROM floors""")),
    "detect_maneuvers": Query(
        lambda s, d: plain(_flagged(s, d, 5.0).select(
            "norad_id", "epoch", "event_id", "dv_ms", "floor_ms", "zscore", "confidence",
            "direction")),
        oracle(["residuals"], f"""WITH {flagged(5.0)}
            SELECT norad_id, epoch_utc AS epoch, event_id, {r6('dv_ms')}, {r6('floor_ms')},
              {r6('zscore')}, CASE WHEN zscore >= 12 THEN 'high' WHEN zscore >= 10 THEN 'medium'
                ELSE 'low' END AS confidence,
              CASE event_id % 7 WHEN 0 THEN 'prograde' WHEN 1 THEN 'retrograde'
                WHEN 2 THEN 'plane-change' WHEN 3 THEN 'radial' WHEN 6 THEN 'retrograde'
                ELSE 'mixed' END AS direction FROM flagged""")),
    "campaigns": Query(
        lambda s, d: plain(_camps(s, d)),
        oracle(["residuals"], f"""WITH {CAMPAIGNS}
            SELECT norad_id, start_epoch, end_epoch, {r6('peak_dv_ms')}, peak_epoch, n_pulses
            FROM camps""")),
    "campaign_baseline": Query(
        lambda s, d: plain(behaviour.campaign_baseline(_camps(s, d))),
        oracle(["residuals"], f"""WITH {BASELINE}
            SELECT norad_id, n_campaigns, {r6('typical_dv_ms')}, {r6('dv_mad_ms')},
              {r6('typical_tempo_days')}, {r6('tempo_mad_days')} FROM baseline""")),
    "classify_campaigns": Query(
        lambda s, d: plain(behaviour.classify_campaigns(_camps(s, d)).select(
            "norad_id", "start_epoch", "dv_z", "tempo_days", "tempo_z", "label",
            F.size("reasons").alias("n_reasons"))),
        oracle(["residuals"], f"""WITH {CLASSIFIED}
            SELECT norad_id, start_epoch, {r6('dv_z')}, {r6('tempo_days')}, {r6('tempo_z')},
              label, (abs(dv_z) >= 3)::INT + coalesce(abs(tempo_z) >= 3, false)::INT AS n_reasons
            FROM classified""")),
    "best_split_burn_size": split_query("peak_dv_ms"),
    "best_split_tempo": split_query("tempo_days"),
    "changepoints": Query(
        lambda s, d: plain(behaviour.changepoints(_camps(s, d), t_threshold=1.0)),
        oracle(["residuals"], f"""
            WITH {CAMPAIGNS}, {split('peak_dv_ms', 'burn')}, {split('tempo_days', 'pace')},
            both_ AS (SELECT *, 'burn size' AS metric, 1 AS r FROM burn
              UNION ALL SELECT *, 'tempo', 0 FROM pace),
            best AS (SELECT *, row_number() OVER (PARTITION BY norad_id
                ORDER BY t_stat DESC, r DESC) AS place FROM both_)
            SELECT norad_id, start_epoch AS epoch, metric, {r6('before_mean')},
              {r6('after_mean')}, CASE WHEN after_mean > before_mean THEN 'increased'
                ELSE 'decreased' END AS direction, {r6('t_stat')}
            FROM best WHERE place = 1 AND t_stat >= 1.0""")),
    "anomalous_rate": Query(
        lambda s, d: plain(score.anomalous_rate(behaviour.classify_campaigns(_camps(s, d)))),
        oracle(["residuals"], f"""WITH {CLASSIFIED}
            SELECT norad_id, round(avg((label = 'anomalous')::INT), 6) + 0.0 AS anomalous_rate,
              count(*) FILTER (label = 'anomalous') AS n_anomalous, count(*) AS n_campaigns
            FROM classified GROUP BY 1""")),
    "maneuver_activity": Query(
        lambda s, d: plain(score.maneuver_activity(
            maneuver.noise_floor(_residuals(s, d)), _flagged(s, d, 8.0))),
        oracle(["residuals"], f"""WITH {flagged(8.0)}
            SELECT f.norad_id, round(least(1.0, coalesce(max(e.dv_ms), 0) / 20.0), 6) + 0.0
              AS maneuver_activity
            FROM floors f LEFT JOIN flagged e USING (norad_id) GROUP BY 1""")),
    "perigee_trend": Query(
        lambda s, d: plain(decay.perigee_trend(_series(s, d), tie=["event_id"])),
        oracle(["perigee_series"], f"""WITH {DECAY}
            SELECT norad_id, n_points, latest_epoch, {r6('latest_perigee_km')},
              {r6('overall_rate')}, {r6('old_rate')}, {r6('new_rate')}, {r6('old_alt_km')},
              {r6('new_alt_km')}, {r6('fit_r2')} FROM trend""")),
    "predict_decay": Query(
        lambda s, d: plain(decay.predict_decay(_series(s, d), tie=["event_id"]).drop(
            "reentry_at"), digits=5),
        oracle(["perigee_series"], f"""WITH {DECAY_FULL}
            SELECT norad_id, n_points, latest_epoch, {r6('latest_perigee_km', digits=5)}, outcome,
              {r6('decay_rate', digits=5)}, CAST(accelerating AS STRING) AS accelerating,
              {r6('h', 'scale_height_km', 5)}, {r6('linear_days', digits=5)},
              {r6('days_to_reentry', digits=5)}, model, {r6('fit_r2', digits=5)}
            FROM predicted""")),
}
