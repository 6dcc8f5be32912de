"""Proximity episodes, pair summaries and the interaction graph."""

from pyspark.sql import functions as F

from orbitframe.functions import orbits
from orbitframe.operators import catalog, proximity, trajectory, verify
from orbitframe.plans.adapters import oracle, view
from orbitframe.plans.compare import plain, r6
from orbitframe.plans.orbit_queries import aligned_ctes, ric_ctes
from orbitframe.plans.query import Query

EPISODES = """
marks AS (SELECT *, range_km < 100 AND speed_kms < 0.05 AS near,
    row_number() OVER (PARTITION BY actor, target ORDER BY t_utc, event_id)
    - row_number() OVER (PARTITION BY actor, target, range_km < 100 AND speed_kms < 0.05
        ORDER BY t_utc, event_id) AS run FROM pair_samples),
episodes AS (SELECT actor, target, min(t_utc) AS start_at, max(t_utc) AS end_at,
    min(range_km) AS min_range_km, avg(speed_kms) AS mean_speed_kms, count(*) AS n_samples,
    (max(t_utc) - min(t_utc)) / 86400000e0 AS duration_days
  FROM marks WHERE near GROUP BY actor, target, run)"""

SERIAL = """
reached AS (SELECT DISTINCT actor, target FROM edges WHERE label <> 'none' AND actor <> target),
marked AS (SELECT r.*, target IN (SELECT norad_id FROM assets) AS is_asset FROM reached r)"""


def _samples(s, d):
    return view(s, d, "pair_samples")


def _edges(s, d):
    return view(s, d, "edges")


SUMMARY = f"""{EPISODES}, totals AS (SELECT actor, target, count(*) AS n_episodes,
    sum(duration_days) AS total_close_days FROM episodes GROUP BY ALL),
pairs AS (SELECT actor, target, count(*) AS n_samples, min(range_km) AS min_range_km,
    min(t_utc) AS coverage_start, max(t_utc) AS coverage_end
  FROM pair_samples GROUP BY ALL HAVING count(*) >= 20),
summary AS (SELECT p.actor, p.target, min_range_km, coverage_start, coverage_end,
    coalesce(n_episodes, 0) AS n_episodes, coalesce(total_close_days, 0) AS total_close_days,
    CASE WHEN total_close_days >= 1 THEN 'likely' WHEN n_episodes > 0 THEN 'possible'
      ELSE 'none' END AS label,
    substr(a.intl_desig, 1, 8) = substr(b.intl_desig, 1, 8) AS same_launch_lineage
  FROM pairs p LEFT JOIN totals USING (actor, target)
  LEFT JOIN satcat a ON a.norad_id = p.actor LEFT JOIN satcat b ON b.norad_id = p.target)"""


def _iso(column: str) -> str:
    return f"strftime(epoch_ms({column}), '%Y-%m-%dT%H:%M:%SZ')"


def _decimal(value: str, digits: int) -> str:
    """Text with fixed decimals, ties rounded up from the shortest form of the number."""
    return f"round(CAST(CAST({value} AS STRING) AS DECIMAL(30, 14)), {digits})::DECIMAL(20, {digits})"


QUERIES = {
    "format_range": Query(
        lambda s, d: _samples(s, d).select("event_id", orbits.format_range(
            F.when(F.col("event_id") % 50 > 0, F.col("range_km") / (1 + F.col("event_id") % 9 * 40))
        ).alias("text")),
        oracle(["pair_samples"], f"""
            WITH r AS (SELECT event_id, CASE WHEN event_id % 50 > 0
                THEN range_km / (1 + event_id % 9 * 40) END AS km FROM pair_samples)
            SELECT event_id, CASE WHEN km < 1 THEN {_decimal('km * 1000', 0)} || ' m'
              WHEN km IS NOT NULL THEN {_decimal('km', 1)} || ' km' ELSE 'n/a' END AS text FROM r""")),
    "facts_from_proximity": Query(
        lambda s, d: plain(verify.facts_from_proximity(proximity.rpo_summary(
            _samples(s, d), view(s, d, "satcat"), tie=["event_id"], likely_days=1.0)).select(
                "report_id", "key", "num_value", "str_value")),
        oracle(["pair_samples", "satcat"], f"""WITH {SUMMARY}
            SELECT CAST(actor AS STRING) AS report_id, f[1] AS key, f[2]::DOUBLE AS num_value,
              f[3] AS str_value FROM (SELECT actor, unnest([
                ('rpo_label', NULL, label), ('rpo_min_range', round_even(min_range_km, 3) + 0.0, NULL),
                ('rpo_episodes', n_episodes, NULL),
                ('rpo_total_close_days', round_even(total_close_days, 1) + 0.0, NULL),
                ('rpo_coverage_start', NULL, {_iso('coverage_start')}),
                ('rpo_coverage_end', NULL, {_iso('coverage_end')}),
                ('rpo_same_launch', NULL, CASE WHEN same_launch_lineage THEN 'true' END)]) AS f
              FROM summary) q WHERE f[2] IS NOT NULL OR f[3] IS NOT NULL""")),
    "aligned_pairs": Query(
        lambda s, d: plain(trajectory.pair_samples(trajectory.aligned_pairs(
            view(s, d, "neighbour_pairs"), view(s, d, "history"))), digits=3),
        oracle(["neighbour_pairs", "history"], f"""
            WITH {aligned_ctes(21_600_000)}, {ric_ctes('aligned', 'rel')}
            SELECT actor, target, t, {r6('range_km', digits=3)}, {r6('speed_kms', digits=3)}
            FROM rel""")),
    "proximity_episodes": Query(
        lambda s, d: plain(proximity.proximity_episodes(
            _samples(s, d), tie=["event_id"], slice_days=5)),
        oracle(["pair_samples"], f"""WITH {EPISODES}
            SELECT actor, target, start_at, end_at, {r6('min_range_km')}, {r6('mean_speed_kms')},
              n_samples, {r6('duration_days')} FROM episodes""")),
    "rpo_summary": Query(
        lambda s, d: plain(proximity.rpo_summary(
            _samples(s, d), view(s, d, "satcat"), tie=["event_id"], likely_days=1.0)),
        oracle(["pair_samples", "satcat"], f"""
            WITH {EPISODES}, totals AS (SELECT actor, target, count(*) AS n_episodes,
                sum(duration_days) AS total_close_days FROM episodes GROUP BY ALL),
            pairs AS (SELECT actor, target, count(*) AS n_samples, min(range_km) AS min_range_km,
                min(t_utc) AS coverage_start, max(t_utc) AS coverage_end
              FROM pair_samples GROUP BY ALL HAVING count(*) >= 20)
            SELECT p.actor, p.target, n_samples, {r6('min_range_km')}, coverage_start,
              coverage_end, coalesce(n_episodes, 0) AS n_episodes,
              {r6('coalesce(total_close_days, 0)', 'total_close_days')},
              CASE WHEN total_close_days >= 1 THEN 'likely' WHEN n_episodes > 0 THEN 'possible'
                ELSE 'none' END AS label,
              CAST(substr(a.intl_desig, 1, 8) = substr(b.intl_desig, 1, 8) AS STRING)
                AS same_launch_lineage
            FROM pairs p LEFT JOIN totals USING (actor, target)
            LEFT JOIN satcat a ON a.norad_id = p.actor LEFT JOIN satcat b
              ON b.norad_id = p.target""")),
    "range_trace": Query(
        lambda s, d: plain(proximity.range_trace(_samples(s, d))),
        oracle(["pair_samples"], f"""
            SELECT actor, target, round((t_utc - min(t_utc) OVER (PARTITION BY actor, target))
                / 86400000e0, 6) + 0.0 AS days, {r6('range_km')} FROM pair_samples""")),
    "same_launch_lineage": Query(
        lambda s, d: plain(proximity.same_launch_lineage(
            _edges(s, d).select("actor", "target", "l_orderkey", "l_linenumber"), view(s, d, "satcat"))),
        oracle(["edges", "satcat"], """
            SELECT actor, target, l_orderkey, l_linenumber,
              CAST(substr(a.intl_desig, 1, 8) = substr(b.intl_desig, 1, 8) AS STRING) AS same_launch_lineage
            FROM edges e LEFT JOIN satcat a ON a.norad_id = e.actor
            LEFT JOIN satcat b ON b.norad_id = e.target""")),
    "known_targets": Query(
        lambda s, d: proximity.known_targets(
            _edges(s, d).select(
                F.lit("rpo").alias("event_type"),
                F.format_string("%09d-%02d", "l_orderkey", "l_linenumber").alias("key"),
                F.array("actor").alias("actor_norad"),
                F.array("target", F.col("target") % 150).alias("target_norad")),
            view(s, d, "element_sets")),
        oracle(["edges", "element_sets"], """
            WITH listed AS (SELECT l_orderkey, l_linenumber, actor, 0 AS pos, target FROM edges
              UNION ALL SELECT l_orderkey, l_linenumber, actor, 1, target % 150 FROM edges)
            SELECT actor, first(target ORDER BY l_orderkey, l_linenumber, pos) AS target
            FROM listed WHERE target IN (SELECT norad_id FROM element_sets) GROUP BY 1""")),
    "interaction_edges": Query(
        lambda s, d: plain(proximity.interaction_edges(_edges(s, d))),
        oracle(["edges"], f"""SELECT actor, target, label, {r6('min_range_km')},
              start_at_utc AS start_at, end_at_utc AS end_at, l_orderkey, l_linenumber
            FROM edges WHERE label <> 'none'""")),
    "interaction_nodes": Query(
        lambda s, d: plain(proximity.interaction_nodes(
            proximity.interaction_edges(_edges(s, d)), view(s, d, "assets"))),
        oracle(["edges", "assets"], """
            WITH n AS (SELECT actor AS norad_id FROM edges WHERE label <> 'none'
              UNION SELECT target FROM edges WHERE label <> 'none')
            SELECT norad_id, CAST(norad_id IN (SELECT norad_id FROM assets) AS STRING)
              AS is_asset FROM n""")),
    "edges_in_window": Query(
        lambda s, d: plain(proximity.edges_in_window(
            _edges(s, d), "1998-01-01", "1998-06-30").select(
            "actor", "target", "start_at", "end_at", "l_orderkey", "l_linenumber")),
        oracle(["edges"], """
            SELECT actor, target, start_at_utc AS start_at, end_at_utc AS end_at, l_orderkey,
              l_linenumber FROM edges
            WHERE start_at_utc <= 899164800000 AND end_at_utc >= 883612800000""")),
    "actor_targets": Query(
        lambda s, d: plain(proximity.actor_targets(_edges(s, d), view(s, d, "assets"))),
        oracle(["edges", "assets"], f"""WITH {SERIAL}
            SELECT actor, target, CAST(is_asset AS STRING) AS is_asset FROM marked""")),
    "serial_inspectors": Query(
        lambda s, d: proximity.serial_inspectors(
            _edges(s, d), view(s, d, "assets")),
        oracle(["edges", "assets"], f"""
            WITH {SERIAL},
            sums AS (SELECT actor, count(*) AS distinct_targets,
              count(*) FILTER (is_asset) AS asset_targets FROM marked GROUP BY 1)
            SELECT *, CASE WHEN asset_targets >= 3 OR distinct_targets >= 5 THEN 'high'
              WHEN asset_targets >= 1 OR distinct_targets >= 3 THEN 'medium' ELSE 'low' END
              AS confidence
            FROM sums WHERE distinct_targets >= 2
            ORDER BY asset_targets DESC, distinct_targets DESC, actor""")),
    "interaction_assets": Query(
        lambda s, d: catalog.union_ids(
            view(s, d, "assets"), _edges(s, d).select(
                F.col("target").alias("norad_id"))),
        oracle(["assets", "edges"], """SELECT norad_id FROM assets UNION
            SELECT target FROM edges""")),
}
