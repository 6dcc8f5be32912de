"""Dossiers, their documents, object states and the board."""

from pyspark.sql import functions as F

from orbitframe.operators import catalog, dossier, watch
from orbitframe.plans import orbit_queries as O
from orbitframe.plans.adapters import oracle, view
from orbitframe.plans.behaviour_queries import CLASSIFIED, DECAY_FULL, split
from orbitframe.plans.catalog_queries import ACTIONS
from orbitframe.plans.compare import plain, r6
from orbitframe.plans.proximity_queries import EPISODES
from orbitframe.plans.query import Query

_AS_OF = "2024-01-26"
_AS_OF_MS = 1706227200000

RESIDUALS = f"""
{O.state_ctes('history', '0e0', 'self')},
held AS (SELECT norad_id, {', '.join(O.SET)},
    lead(epoch_utc) OVER (PARTITION BY norad_id ORDER BY epoch_utc) AS t FROM history),
kept AS (SELECT * FROM held WHERE t - epoch_utc > 0 AND t - epoch_utc <= 864000000),
{O.state_ctes('kept', '(t - epoch_utc) / 1000e0', 'told')},
meeting AS (SELECT p.norad_id, p.t, {', '.join(f'o.{c} AS a_{c}, p.{c} AS b_{c}' for c in O.STATE)}
  FROM told p JOIN self o ON o.norad_id = p.norad_id AND o.epoch_utc = p.t
  WHERE sqrt(o.rx * o.rx + o.ry * o.ry + o.rz * o.rz) >= 6378.137
    AND sqrt(p.rx * p.rx + p.ry * p.ry + p.rz * p.rz) >= 6378.137),
{O.ric_ctes('meeting', 'moved')},
residuals AS (SELECT norad_id, t AS epoch_utc, t AS event_id, 1000 * speed_kms AS dv_ms FROM moved)"""

MEAN = """6.283185307179586e0 / 86400e0 * revs_per_day"""
ORBITS = f"""
sized AS (SELECT h.*, pow(398600.4418e0 / ({MEAN} * {MEAN}), 1e0 / 3e0) AS semi_major_km FROM history h),
shaped AS (SELECT *, semi_major_km * (1 + ecc) - 6378.137 AS apogee_km,
    semi_major_km * (1 - ecc) - 6378.137 AS perigee_km,
    6.283185307179586e0 / ({MEAN}) / 60 AS period_min FROM sized),
newest AS (SELECT * FROM shaped
  QUALIFY row_number() OVER (PARTITION BY norad_id ORDER BY epoch_utc DESC) = 1),
perigee_series AS (SELECT norad_id, epoch_utc, epoch_utc AS event_id, perigee_km FROM shaped),
live_assets AS (SELECT norad_id, name FROM listed_objects WHERE object_type = 'PAY'
  AND norad_id IN (SELECT norad_id FROM history WHERE source = 'live')),
targets AS (SELECT actor, target FROM neighbour_pairs
  WHERE target IN (SELECT norad_id FROM history))"""

PAIRS = f"""{O.aligned_ctes(21_600_000).replace('neighbour_pairs', 'targets')},
{O.ric_ctes('aligned', 'rel')},
pair_samples AS (SELECT actor, target, t AS t_utc, t AS event_id, range_km, speed_kms FROM rel),
{EPISODES.replace('marks', 'near_marks')},
totals AS (SELECT actor, target, count(*) AS n_episodes, sum(duration_days) AS total_close_days
  FROM episodes GROUP BY ALL),
measured AS (SELECT actor, target, min(range_km) AS min_range_km FROM pair_samples
  GROUP BY ALL HAVING count(*) >= 20),
met_pairs AS (SELECT p.actor, p.target AS rpo_target, min_range_km AS rpo_min_range_km,
    coalesce(n_episodes, 0) AS rpo_episodes, coalesce(total_close_days, 0) AS rpo_close_days,
    CASE WHEN total_close_days >= 3 THEN 'likely' WHEN n_episodes > 0 THEN 'possible' ELSE 'none' END
      AS rpo_label, substr(nullif(a.intl_desig, ''), 1, 8) = substr(nullif(b.intl_desig, ''), 1, 8)
      AS same_launch_lineage
  FROM measured p LEFT JOIN totals USING (actor, target)
  LEFT JOIN listed_objects a ON a.norad_id = p.actor
  LEFT JOIN listed_objects b ON b.norad_id = p.target)"""

_BEHAVIOUR = CLASSIFIED.replace(">= 2.0", ">= 5.0").replace("classified", "judged").replace(
    "scored", "graded")
_NEAREST = O.NEAREST.replace("elements", "newest").replace("assets", "live_assets").replace(
    "1705276800000", str(_AS_OF_MS))

DOSSIER = f"""{RESIDUALS}, {ORBITS}, {_BEHAVIOUR}, {split('peak_dv_ms', 'burn')},
{split('tempo_days', 'pace')}, {O.LADDER.replace('elements', 'newest')},
{DECAY_FULL.replace('span', 'decay_span')}, {_NEAREST}, {PAIRS},
shifts AS (SELECT * FROM (SELECT *, 'burn size' AS metric, 'm/s' AS unit, 1 AS r FROM burn
    UNION ALL SELECT *, 'tempo', 'days', 0 FROM pace)
  QUALIFY row_number() OVER (PARTITION BY norad_id ORDER BY t_stat DESC, r DESC) = 1),
burns AS (SELECT norad_id, count(*) AS n_maneuvers, max(epoch_utc) AS last_maneuver_epoch,
    max(dv_ms) AS peak FROM flagged GROUP BY 1),
odd AS (SELECT norad_id, avg((label = 'anomalous')::INT) AS anomalous_rate FROM judged GROUP BY 1),
held_sets AS (SELECT norad_id, count(*) AS n_sets FROM history GROUP BY 1),
falls AS (SELECT norad_id, days_to_reentry, decay_rate, model, latest_perigee_km AS decay_perigee_km,
    CAST(floor(latest_epoch + days_to_reentry * 86400000e0) AS BIGINT) AS decay_reentry
  FROM predicted WHERE days_to_reentry IS NOT NULL),
dossier_rows AS (SELECT c.norad_id, coalesce(c.name, 'NORAD ' || c.norad_id) AS name,
    c.decay_date IS NOT NULL AS decayed, n_sets IS NOT NULL AS has_sets,
    coalesce(n_sets, 0) AS n_sets, a."primary", special_tags, a.perigee_km, a.apogee_km,
    CASE WHEN special_tags = '' THEN a."primary" ELSE
      a."primary" || ' [' || replace(special_tags, ',', ', ') || ']' END AS label,
    coalesce(n_maneuvers, 0) AS n_maneuvers, last_maneuver_epoch,
    CASE WHEN f.norad_id IS NOT NULL THEN least(1e0, coalesce(peak, 0) / 20e0) END AS maneuver_activity,
    anomalous_rate, CASE WHEN n_sets IS NOT NULL THEN {O.SENSITIVITY} END AS regime_sensitivity,
    gap AS nearest_km, asset_id, asset_name, {O.RAMP} AS proximity_to_hva,
    CASE WHEN n_sets IS NOT NULL THEN 1e0 - (coalesce(c.country NOT IN ('', 'UNK'), false)::INT
      + coalesce(c.object_type NOT IN ('', 'UNK'), false)::INT) / 2e0 END AS attribution,
    m.* EXCLUDE (actor), w.* EXCLUDE (norad_id),
    CASE WHEN a."primary" IN ('GEO', 'GRAVEYARD') THEN disposal_status END AS disposal_status,
    CASE WHEN a."primary" IN ('GEO', 'GRAVEYARD') THEN km_above_geo END AS km_above_geo,
    CASE WHEN a."primary" IN ('GEO', 'GRAVEYARD') THEN {O.COMPLIANT} END = 'true' AS compliant,
    metric, unit, before_mean, after_mean, s.t_stat
  FROM listed_objects c LEFT JOIN held_sets h USING (norad_id) LEFT JOIN assessed a USING (norad_id)
  LEFT JOIN burns b USING (norad_id) LEFT JOIN floors f USING (norad_id)
  LEFT JOIN odd o USING (norad_id) LEFT JOIN best g ON g.id = c.norad_id
  LEFT JOIN met_pairs m ON m.actor = c.norad_id LEFT JOIN falls w USING (norad_id)
  LEFT JOIN (SELECT * FROM shifts WHERE t_stat >= 2.5) s USING (norad_id)),
{ACTIONS},
weighed AS (SELECT norad_id, list_filter([(maneuver_activity, 0.2e0), (anomalous_rate, 0.3e0),
    (regime_sensitivity, 0.15e0), (proximity_to_hva, 0.25e0), (attribution, 0.1e0)],
    lambda x: x[1] IS NOT NULL) AS f FROM dossier_rows),
full_dossiers AS (SELECT d.*, CASE WHEN len(f) > 0 THEN round(100 * list_sum(list_transform(f,
      lambda x: x[1] * x[2])) / list_sum(list_transform(f, lambda x: x[2])), 3) + 0.0 END
      AS threat_score, len(f) AS n_factors,
    CASE WHEN has_sets THEN split_part(a[1], ':', 1) END AS top_action,
    CASE WHEN has_sets THEN split_part(a[1], ':', 2) END AS top_urgency,
    CASE WHEN has_sets THEN array_to_string(list_transform(a, lambda x: split_part(x, ':', 1)), ',')
      ELSE '' END AS action_list
  FROM dossier_rows d JOIN weighed USING (norad_id) JOIN sorted_ USING (norad_id)),
banded AS (SELECT *, CASE WHEN threat_score >= 67 THEN 'high' WHEN threat_score >= 34 THEN 'moderate'
    WHEN threat_score IS NOT NULL THEN 'low' END AS threat_band FROM full_dossiers)"""
VIEWS = ["history", "listed_objects", "neighbour_pairs"]


def _events(s, d):
    """Labelled proximity events between neighbouring objects."""
    return view(s, d, "neighbour_pairs").select(
        F.format_string("%012d", "actor").alias("key"), F.lit("rpo").alias("event_type"),
        F.array("actor").alias("actor_norad"), F.array("target").alias("target_norad"))


def dossiers(s, d):
    return dossier.dossiers(view(s, d, "history"), view(s, d, "listed_objects"), _events(s, d), _AS_OF)


def _sheet(s, d):
    """The dossiers; bands by the rounded score, as the SQL has them."""
    return dossiers(s, d).withColumn("threat_band", dossier.score.orbits.threat_band(
        F.round("threat_score", 3)))


def _facts_of_documents(s, d):
    """What the documents say, read back from their JSON."""
    documents = dossier.dossier_json(dossiers(s, d))
    at = lambda path: F.get_json_object("document", f"$.{path}")
    return documents.select(
        "norad_id", at("name").alias("name"), at("has_tle").alias("has_tle"),
        at("decayed").alias("decayed"), at("regime.label").alias("regime"),
        at("threat.factors_available").cast("long").alias("factors_available"),
        at("threat.factors[3].explanation").alias("nearest"),
        at("n_maneuvers").cast("long").alias("n_maneuvers"), at("rpo.label").alias("rpo_label"),
        at("rpo.target_norad").cast("long").alias("rpo_target"), at("decay.model").alias("decay_model"),
        at("disposal.status").alias("disposal"), at("changepoint.metric").alias("metric"),
        at("changepoint.unit").alias("unit"),
        F.array_join(F.json_object_keys("document"), ",").alias("keys"))


_KEYS = ("norad_id,name,decayed,decay_date,has_tle,regime,elements,threat,n_maneuvers,rpo,decay,"
         "disposal,changepoint,mitigations")

QUERIES = {
    "dossiers": Query(
        lambda s, d: plain(_sheet(s, d).select(
            "norad_id", "name", "decayed", "has_sets", "n_sets", "label", "perigee_km", "apogee_km",
            "threat_score", "n_factors", "threat_band", "asset_id", "asset_name", "n_maneuvers",
            "last_maneuver_epoch", "anomalous_rate", F.col("changepoint.metric").alias("metric"),
            F.col("changepoint.before").alias("before_mean"),
            F.col("changepoint.after").alias("after_mean"), "rpo_target", "rpo_label",
            "rpo_min_range_km", "rpo_episodes", "rpo_close_days", "same_launch_lineage",
            "decay_model", "days_to_reentry", "disposal_status", "km_above_geo", "compliant",
            "top_action", "top_urgency",
            F.array_join(F.transform("actions", lambda a: a["action_id"]), ",").alias("action_list"),
            "posture"), digits=3),
        oracle(VIEWS, f"""WITH {DOSSIER}
            SELECT norad_id, name, CAST(decayed AS STRING) AS decayed, CAST(has_sets AS STRING) AS has_sets,
              n_sets, label, {r6('perigee_km', digits=3)}, {r6('apogee_km', digits=3)}, threat_score,
              n_factors, threat_band, asset_id, asset_name, n_maneuvers, last_maneuver_epoch,
              {r6('anomalous_rate', digits=3)}, metric, {r6('before_mean', digits=3)},
              {r6('after_mean', digits=3)}, rpo_target, rpo_label, {r6('rpo_min_range_km', digits=3)},
              rpo_episodes, {r6('rpo_close_days', digits=3)},
              CAST(same_launch_lineage AS STRING) AS same_launch_lineage, model AS decay_model,
              {r6('days_to_reentry', digits=3)}, disposal_status, {r6('km_above_geo', digits=3)},
              CAST(compliant AS STRING) AS compliant, top_action, top_urgency, action_list,
              coalesce(top_urgency, 'routine') AS posture
            FROM banded""")),
    "dossier_json": Query(
        _facts_of_documents,
        oracle(VIEWS, f"""WITH {DOSSIER}
            SELECT norad_id, name, CAST(has_sets AS STRING) AS has_tle, CAST(decayed AS STRING) AS decayed,
              label AS regime, CASE WHEN has_sets THEN n_factors END AS factors_available,
              CASE WHEN nearest_km IS NOT NULL THEN 'about ' || printf('%.0f', nearest_km) || ' km from '
                  || coalesce(asset_name, CAST(asset_id AS STRING)) || ', the nearest high-value asset'
                WHEN has_sets THEN 'no usable asset, or the object''s element set is too old' END
                AS nearest,
              n_maneuvers, rpo_label, rpo_target, model AS decay_model, disposal_status AS disposal,
              metric, unit, '{_KEYS}' AS keys FROM banded""")),
    "object_states": Query(
        lambda s, d: plain(watch.object_states(_sheet(s, d)), digits=3),
        oracle(VIEWS, f"""WITH {DOSSIER}
            SELECT norad_id, name, threat_score, threat_band, last_maneuver_epoch, n_maneuvers,
              rpo_label, {r6('rpo_min_range_km', digits=3)}, decay_reentry, disposal_status
            FROM banded""")),
    "threat_board": Query(
        lambda s, d: plain(dossier.threat_board(_sheet(s, d), catalog.featured_objects(
            view(s, d, "history"), catalog.event_object_ids(_events(s, d)))), digits=3),
        oracle(VIEWS, f"""WITH {DOSSIER}
            SELECT norad_id, name, threat_score, label AS regime, top_action, top_urgency FROM banded
            WHERE threat_score IS NOT NULL AND (n_sets >= 8 OR has_sets AND norad_id IN (
              SELECT actor FROM neighbour_pairs UNION SELECT target FROM neighbour_pairs))""")),
}
