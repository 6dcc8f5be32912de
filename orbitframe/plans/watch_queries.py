"""State differences, watch cycles and scores."""

from pyspark.sql import functions as F

from orbitframe.operators import catalog, elements as el, maneuver, score, verify, watch
from orbitframe.functions import orbits
from orbitframe.plans import behaviour_queries as B, orbit_queries as O
from orbitframe.plans.behaviour_queries import CLASSIFIED
from orbitframe.plans.catalog_queries import BREAKUPS
from orbitframe.plans.adapters import oracle, view
from orbitframe.plans.compare import plain, r6
from orbitframe.plans.query import Query

_AS_OF = "2024-02-01"
_AS_OF_MS = 1706745600000

FINDINGS = f"""
p AS (SELECT * FROM states WHERE half = 0), c AS (SELECT * FROM states WHERE half = 1),
pairs AS (SELECT c.norad_id, p.threat_band AS pb, c.threat_band AS cb,
    CASE p.threat_band WHEN 'low' THEN 0 WHEN 'moderate' THEN 1 ELSE 2 END AS pr,
    CASE c.threat_band WHEN 'low' THEN 0 WHEN 'moderate' THEN 1 ELSE 2 END AS cr,
    p.last_maneuver_epoch_utc AS pe, c.last_maneuver_epoch_utc AS ce, p.n_maneuvers AS pn,
    c.n_maneuvers AS cn, p.rpo_label IN ('likely', 'possible') AS pm,
    c.rpo_label IN ('likely', 'possible') AS cm, c.rpo_label AS cl,
    p.rpo_min_range_km AS pk, c.rpo_min_range_km AS ck, p.decay_reentry_utc AS pd,
    c.decay_reentry_utc AS cd, p.disposal_status AS ps, c.disposal_status AS cs
  FROM p JOIN c USING (norad_id)),
findings AS (
  SELECT norad_id, CASE WHEN cr > pr THEN 'threat_up' ELSE 'threat_down' END AS kind,
    CASE WHEN cr > pr AND cb = 'high' THEN 'priority' WHEN cr > pr THEN 'elevated'
      ELSE 'routine' END AS significance FROM pairs WHERE pb <> cb
  UNION ALL SELECT norad_id, 'new_maneuver', 'elevated' FROM pairs WHERE ce > pe AND cn > pn
  UNION ALL SELECT norad_id, 'new_rpo', CASE cl WHEN 'likely' THEN 'priority' ELSE 'elevated' END
    FROM pairs WHERE cm AND NOT pm
  UNION ALL SELECT norad_id, 'rpo_closer', 'priority' FROM pairs
    WHERE cm AND pm AND ck < pk * 0.5
  UNION ALL SELECT norad_id, 'new_decay', CASE WHEN (cd - {_AS_OF_MS}) / 86400000e0 < 30
      THEN 'priority' ELSE 'elevated' END FROM pairs WHERE cd IS NOT NULL AND pd IS NULL
  UNION ALL SELECT norad_id, 'disposal_change', CASE WHEN cs IN ('NON_COMPLIANT_SHALLOW',
      'BELOW_GEO_DRIFT') THEN 'elevated' ELSE 'routine' END FROM pairs WHERE ps <> cs)"""


CLOUDS = f"""{BREAKUPS}, times AS (SELECT max(snapshot_at_utc) AS last,
    (SELECT max(snapshot_at_utc) FROM snapshots
     WHERE snapshot_at_utc < (SELECT max(snapshot_at_utc) FROM snapshots)) AS previous FROM snapshots),
fresh AS (SELECT norad_id FROM snapshots, times WHERE snapshot_at_utc = last
  EXCEPT SELECT norad_id FROM snapshots, times WHERE snapshot_at_utc = previous),
hit AS (SELECT substr(intl_desig, 1, 8) AS launch_prefix FROM satcat
  WHERE object_type = 'DEB' AND norad_id IN (SELECT norad_id FROM fresh)
  GROUP BY 1 HAVING count(*) >= 3),
fragmented AS (SELECT parent_norad_id AS norad_id, 'fragmentation' AS kind, 'priority' AS significance,
    'launch ' || launch_prefix || ': ' || n_fragments || ' fragments, confidence ' || confidence
      AS summary
  FROM breakups WHERE launch_prefix IN (SELECT launch_prefix FROM hit))"""
CYCLE = f"""{FINDINGS}, {CLOUDS},
cycle_findings AS (SELECT norad_id, kind, significance, CAST(NULL AS STRING) AS summary FROM findings
    WHERE norad_id IN (SELECT norad_id FROM watch_list)
  UNION ALL SELECT norad_id, kind, significance, summary FROM fragmented)"""


def _states(s, d, half):
    return view(s, d, "states").where(F.col("half") == half).drop("half")


def _findings(s, d):
    return watch.diff_states(_states(s, d, 0), _states(s, d, 1),
                             F.lit(_AS_OF).cast("timestamp"))


def _cycle(s, d):
    return watch.watch_cycle(
        _states(s, d, 0), _states(s, d, 1), view(s, d, "watch_list"), view(s, d, "snapshots"),
        view(s, d, "satcat"), 7, _AS_OF)


def _cycles_table(s, d):
    """A cycle per order month, findings from the orders in it."""
    return view(s, d, "snapshots").groupBy("snapshot_at").agg(
        F.count("*").alias("n_findings")).select(
        (F.unix_millis("snapshot_at") / 86400000).cast("long").alias("cycle_id"),
        F.col("snapshot_at").alias("run_at"), "n_findings")


def _cycle_rows(s, d):
    return view(s, d, "snapshots").select(
        (F.unix_millis("snapshot_at") / 86400000).cast("long").alias("cycle_id"), "norad_id")


def _threat_scores(s, d):
    residuals = view(s, d, "residuals")
    regimes = el.classify_regime(view(s, d, "elements"))
    flagged = B._flagged(s, d)
    return score.threat_scores(
        regimes, maneuver.noise_floor(residuals), flagged,
        B.behaviour.classify_campaigns(B._camps(s, d)), regimes, view(s, d, "satcat"),
        score.proximity_to_assets(view(s, d, "elements"), view(s, d, "assets").join(
            view(s, d, "elements").drop("name"), "norad_id"), "2024-01-15"))


def _cycle_facts(tables):
    """Facts of one cycle; the texts of findings on objects hold rounded numbers and stay out."""
    facts = verify.facts_from_cycle(tables["cycle"], tables["findings"])
    population = F.col("key").startswith("finding_fragmentation_")
    own = F.col("key").startswith("finding_") & ~population
    return plain(facts.select(
        "report_id", F.regexp_replace("key", "population_[0-9]+$", "population").alias("key"),
        "num_value", F.when(~own, F.col("str_value")).alias("str_value")))


QUERIES = {
    "diff_states": Query(
        lambda s, d: _findings(s, d).select("norad_id", "kind", "significance"),
        oracle(["states"], f"WITH {FINDINGS} SELECT * FROM findings")),
    "ranked_findings": Query(
        lambda s, d: watch.ranked(_findings(s, d)).select(
            "norad_id", "kind", catalog.urgency_rank(F.col("significance")).cast("long")
            .alias("rank")),
        oracle(["states"], f"""WITH {FINDINGS} SELECT norad_id, kind, CASE significance
            WHEN 'priority' THEN 3 WHEN 'elevated' THEN 2 ELSE 1 END AS rank FROM findings
            ORDER BY rank DESC, norad_id""")),
    "finding_counts": Query(
        lambda s, d: verify.finding_counts(_findings(s, d), "kind"),
        oracle(["states"], f"""WITH {FINDINGS} SELECT kind, count(*) AS n_findings,
            count(*) FILTER (significance = 'priority') AS priority,
            count(*) FILTER (significance = 'elevated') AS elevated,
            count(*) FILTER (significance = 'routine') AS routine FROM findings GROUP BY 1""")),
    "merge_states": Query(
        lambda s, d: plain(watch.merge_states(_states(s, d, 0), _states(s, d, 1)).select("norad_id", "n_maneuvers", "last_maneuver_epoch",
                                        "rpo_min_range_km")),
        oracle(["states"], f"""
            WITH fresh AS (SELECT * FROM states WHERE half = 1),
            all_ AS (SELECT * FROM fresh UNION ALL SELECT * FROM states s WHERE half = 0
              AND NOT EXISTS (SELECT 1 FROM fresh f WHERE f.norad_id = s.norad_id))
            SELECT norad_id, n_maneuvers, last_maneuver_epoch_utc AS last_maneuver_epoch,
              {r6('rpo_min_range_km')} FROM all_""")),
    "population_findings": Query(
        lambda s, d: plain(watch.population_findings(view(s, d, "snapshots"), view(s, d, "satcat"))),
        oracle(["satcat", "snapshots"], f"""WITH {CLOUDS}
            SELECT norad_id, 0 AS seq, kind, significance, summary FROM fragmented""")),
    "watch_cycle": Query(
        lambda s, d: plain(_cycle(s, d)["findings"].select(
            "cycle_id", "norad_id", "kind", "significance", F.when(
                F.col("kind") == "fragmentation", F.col("summary")).alias("summary"))),
        oracle(["states", "watch_list", "satcat", "snapshots"], f"""WITH {CYCLE}
            SELECT 7 AS cycle_id, norad_id, kind, significance, summary FROM cycle_findings""")),
    "facts_from_cycle": Query(
        lambda s, d: _cycle_facts(_cycle(s, d)),
        oracle(["states", "watch_list", "satcat", "snapshots"], f"""WITH {CYCLE}
            SELECT '7' AS report_id, 'cycle_run_at' AS key, CAST(NULL AS DOUBLE) AS num_value,
              '2024-02-01T00:00:00Z' AS str_value
            UNION ALL SELECT '7', 'n_findings', count(*), NULL FROM cycle_findings
            UNION ALL SELECT '7', 'n_priority', count(*), NULL FROM cycle_findings
              WHERE significance = 'priority'
            UNION ALL SELECT '7', 'n_elevated', count(*), NULL FROM cycle_findings
              WHERE significance = 'elevated'
            UNION ALL SELECT '7', 'finding_' || kind || '_' || coalesce(
                CAST(norad_id AS STRING), 'population'), NULL, summary FROM cycle_findings""")),
    "watchlist_changes": Query(
        lambda s, d: plain(watch.watchlist_changes(
            view(s, d, "watch_list"), view(s, d, "watch_changes"))),
        oracle(["watch_list", "watch_changes"], """
            WITH last AS (SELECT norad_id, arg_max(action, at_utc) AS action,
                arg_max(note, at_utc) AS note,
                max(at_utc) FILTER (action = 'remove') AS removed FROM watch_changes GROUP BY 1),
            added AS (SELECT c.norad_id, min(at_utc) AS at FROM watch_changes c
              JOIN last l USING (norad_id) WHERE c.action = 'add'
                AND (removed IS NULL OR at_utc > removed) GROUP BY 1)
            SELECT coalesce(w.norad_id, l.norad_id) AS norad_id,
              CASE WHEN l.action = 'add' AND (w.norad_id IS NULL OR removed IS NOT NULL)
                THEN a.at ELSE w.added_at_utc END AS added_at,
              CASE WHEN l.action = 'add' THEN l.note ELSE w.note END AS note
            FROM watch_list w FULL JOIN last l ON l.norad_id = w.norad_id
            LEFT JOIN added a ON a.norad_id = l.norad_id
            WHERE l.norad_id IS NULL OR l.action = 'add'""")),
    "is_watched": Query(
        lambda s, d: plain(watch.is_watched(
            view(s, d, "satcat").select("norad_id"), view(s, d, "watch_list"))),
        oracle(["satcat", "watch_list"], """SELECT norad_id, CAST(norad_id IN (
            SELECT norad_id FROM watch_list) AS STRING) AS watched FROM satcat""")),
    "latest_cycles": Query(
        lambda s, d: plain(watch.latest_cycles(_cycles_table(s, d))),
        oracle(["snapshots"], """SELECT snapshot_at_utc // 86400000 AS cycle_id,
            snapshot_at_utc AS run_at, count(*) AS n_findings FROM snapshots GROUP BY ALL
            ORDER BY 1 DESC LIMIT 20""")),
    "cycle_findings": Query(
        lambda s, d: watch.cycle_findings(_cycles_table(s, d), _cycle_rows(s, d)),
        oracle(["snapshots"], """SELECT snapshot_at_utc // 86400000 AS cycle_id, norad_id
            FROM snapshots WHERE snapshot_at_utc = (SELECT max(snapshot_at_utc)
              FROM snapshots)""")),
    "threat_scores": Query(
        lambda s, d: plain(_threat_scores(s, d).drop("nearest_km").withColumn(
            "band", orbits.threat_band(F.round("score", 6)))),
        oracle(["elements", "residuals", "satcat", "assets"], f"""
            WITH {O.NEAREST}, {O.LADDER}, {CLASSIFIED.replace('classified', 'judged').replace('scored', 'graded')},
            act AS (SELECT f.norad_id, least(1e0, coalesce(max(e.dv_ms), 0) / 20e0) AS maneuver_activity
              FROM floors f LEFT JOIN flagged e USING (norad_id) GROUP BY 1),
            odd AS (SELECT norad_id, avg((label = 'anomalous')::INT) AS anomalous_rate FROM judged
              GROUP BY 1),
            parts AS (SELECT c.norad_id, maneuver_activity, anomalous_rate,
                {O.SENSITIVITY} AS regime_sensitivity, {O.RAMP} AS proximity_to_hva,
                asset_id, asset_name,
                CASE WHEN s.norad_id IS NOT NULL THEN 1e0
                  - (coalesce(s.country NOT IN ('', 'UNK'), false)::INT
                    + coalesce(s.object_type NOT IN ('', 'UNK'), false)::INT) / 2e0 END AS attribution
              FROM classified c LEFT JOIN act USING (norad_id) LEFT JOIN odd USING (norad_id)
              LEFT JOIN best b ON b.id = c.norad_id LEFT JOIN satcat s ON s.norad_id = c.norad_id),
            w AS (SELECT *, list_filter([
                (maneuver_activity, 0.2e0), (anomalous_rate, 0.3e0), (regime_sensitivity, 0.15e0),
                (proximity_to_hva, 0.25e0), (attribution, 0.1e0)], lambda x: x[1] IS NOT NULL) AS f
              FROM parts),
            scored AS (SELECT *, round(100 * list_sum(list_transform(f, lambda x: x[1] * x[2]))
                / list_sum(list_transform(f, lambda x: x[2])), 6) AS score FROM w)
            SELECT norad_id, {', '.join(r6(f) for f in score.FACTORS)}, score + 0.0 AS score,
              asset_id, asset_name,
              len(f) AS n_factors, CASE WHEN score >= 67 THEN 'high' WHEN score >= 34 THEN 'moderate'
                WHEN score IS NOT NULL THEN 'low' END AS band FROM scored""")),
}
