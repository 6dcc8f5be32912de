"""Catalogue listings, merges, cohorts, breakups and snapshots."""

from pyspark.sql import functions as F

from orbitframe.functions import orbits
from orbitframe.operators import actions, breakup, catalog, filterspecs, score
from orbitframe.plans.adapters import oracle, view
from orbitframe.plans.compare import plain, r6
from orbitframe.plans.query import Query
from orbitframe.sources import store

SATCAT_BAND = """CASE WHEN apogee_km IS NULL OR perigee_km IS NULL THEN '—'
  WHEN apogee_km < 2000 THEN 'LEO' WHEN perigee_km >= 2000 AND apogee_km < 34000 THEN 'MEO'
  WHEN apogee_km BETWEEN 34000 AND 38000 AND perigee_km > 33000 THEN 'GEO'
  WHEN apogee_km > 35000 AND perigee_km < 2000 THEN 'HEO' ELSE 'OTHER' END"""

DEBRIS = """debris AS (
  SELECT *, substr(intl_desig, 1, 8) AS launch_prefix FROM satcat
  WHERE object_type = 'DEB' AND inclination IS NOT NULL AND perigee_km IS NOT NULL
    AND apogee_km IS NOT NULL AND intl_desig IS NOT NULL)"""

BREAKUPS = DEBRIS + """,
medians AS (SELECT launch_prefix, median(norad_id) AS mid FROM debris GROUP BY 1),
mads AS (SELECT launch_prefix, median(abs(norad_id - mid)) AS mad, any_value(mid) AS mid
  FROM debris JOIN medians USING (launch_prefix) GROUP BY 1),
clouds AS (
  SELECT launch_prefix, count(*) AS n_fragments, avg(inclination) AS mean_inclination_deg,
    stddev_pop(inclination) AS incl_std_deg, min(perigee_km) AS perigee_min_km,
    max(perigee_km) AS perigee_max_km, min(apogee_km) AS apogee_min_km,
    max(apogee_km) AS apogee_max_km
  FROM debris GROUP BY 1 HAVING count(*) >= 10),
parents AS (
  SELECT substr(intl_desig, 1, 8) AS launch_prefix,
    first(norad_id ORDER BY object_type <> 'PAY', intl_desig) AS parent_norad_id,
    first(name ORDER BY object_type <> 'PAY', intl_desig) AS parent_name
  FROM satcat WHERE object_type IN ('PAY', 'R/B') AND intl_desig IS NOT NULL GROUP BY 1),
breakups AS (
  SELECT c.*, parent_norad_id, parent_name,
    CASE WHEN n_fragments >= 100 AND incl_std_deg < 5 THEN 'high' WHEN incl_std_deg < 10
      THEN 'medium' ELSE 'low' END AS confidence
  FROM clouds c JOIN mads m USING (launch_prefix) LEFT JOIN parents USING (launch_prefix)
  WHERE CASE WHEN mid > 0 THEN mad / mid ELSE 0 END <= 0.08)"""
BREAKUP_COLUMNS = ", ".join(
    ["launch_prefix", "n_fragments", "parent_norad_id", "parent_name", "confidence"]
    + [r6(c) for c in ("mean_inclination_deg", "incl_std_deg", "perigee_min_km",
                       "perigee_max_km", "apogee_min_km", "apogee_max_km")])

SPECS = r"""
specs_raw AS (SELECT request_id, text, regexp_extract(text, '(?s)\{.*\}') AS body FROM requests),
specs_json AS (SELECT request_id, text, body <> '' AND json_valid(body) AS ok,
  CASE WHEN body <> '' AND json_valid(body) THEN body ELSE '{}' END AS j FROM specs_raw),
specs_text AS (SELECT request_id, text, ok, upper(json_extract_string(j, '$.regime')) AS regime,
    replace(upper(json_extract_string(j, '$.object_type')), 'RB', 'R/B') AS object_type,
    nullif(trim(json_extract_string(j, '$.country')), '') AS country,
    CASE WHEN ok THEN nullif(trim(json_extract_string(j, '$.name_contains')), '') ELSE text END
      AS name_contains,
    lower(trim(json_extract_string(j, '$.decayed'))) IN ('true', 'yes', '1') AS decayed,
    try_cast(json_extract_string(j, '$.min_inclination') AS DOUBLE) AS min_inclination,
    try_cast(json_extract_string(j, '$.max_inclination') AS DOUBLE) AS max_inclination,
    lower(json_extract_string(j, '$.sort')) AS sort,
    greatest(1, least(200, coalesce(try_cast(json_extract_string(j, '$.limit') AS BIGINT), 50)))
      AS "limit" FROM specs_json),
specs AS (SELECT request_id, ok AS parsed,
    CASE WHEN regime IN ('LEO', 'MEO', 'GEO', 'HEO', 'GRAVEYARD') THEN regime END AS regime,
    CASE WHEN object_type IN ('PAY', 'R/B', 'DEB') THEN object_type END AS object_type,
    country, name_contains, decayed, min_inclination, max_inclination,
    CASE WHEN sort IN ('anomaly', 'altitude_desc', 'altitude_asc') THEN sort END AS sort, "limit"
  FROM specs_text)"""


ACTIONS = """
found AS (SELECT norad_id, list_filter([
      CASE WHEN maneuver_activity >= 0.5 AND proximity_to_hva >= 0.4
        THEN 'persistent_custody:priority'
        WHEN proximity_to_hva >= 0.6 THEN 'elevate_cadence:elevated' END,
      CASE WHEN rpo_label IN ('likely', 'possible') THEN
        CASE WHEN coalesce(same_launch_lineage, false)
          THEN 'confirm_deployment:elevated' ELSE 'notify_operator:priority' END END,
      CASE WHEN attribution >= 0.5 THEN 'characterize_unknown:elevated' END,
      CASE WHEN anomalous_rate >= 0.3 THEN 'maneuver_watchlist:elevated' END,
      CASE WHEN compliant = false THEN 'disposal_followup:elevated' END,
      CASE WHEN days_to_reentry IS NOT NULL THEN 'reentry_monitoring:' ||
        CASE WHEN days_to_reentry < 30 THEN 'priority' WHEN days_to_reentry < 120
          THEN 'elevated' ELSE 'routine' END END],
      lambda x: x IS NOT NULL) AS a FROM dossier_rows),
  full_ AS (SELECT norad_id, CASE WHEN len(a) = 0 THEN ['routine_custody:routine']
      ELSE a END AS a FROM found),
  sorted_ AS (SELECT norad_id, list_concat(
      list_filter(a, lambda x: x LIKE '%:priority'),
      list_concat(list_filter(a, lambda x: x LIKE '%:elevated'),
        list_filter(a, lambda x: x LIKE '%:routine'))) AS a FROM full_)"""
_CATEGORY = "CASE " + " ".join(
    f"WHEN x LIKE '{name}:%' THEN '{kind}'" for name, kind in actions.CATEGORY.items()) + " END"


def _satcat(s, d):
    return view(s, d, "satcat")


def _sets(s, d, name="element_sets"):
    return view(s, d, name)


def _upsert(s, d):
    cat = _satcat(s, d)
    stored = cat.where("object_type <> 'PAY'")
    arriving = cat.where("object_type <> 'R/B'").withColumns({
        "name": F.concat(F.lit("NEW "), "name"), "intl_desig": F.lit("2099-001A"),
        "perigee_km": F.col("perigee_km") + 1,
        "decay_date": F.lit(None).cast("date")})
    return store.upsert_satcat(stored, arriving, order=("name",))


def _parsed(s, d):
    return filterspecs.parse_filter_specs(view(s, d, "requests"))


QUERIES = {
    "append_element_sets": Query(
        lambda s, d: plain(store.append_element_sets(
            _sets(s, d, "coarse_sets").where("source = 'archive'").groupBy(
                "norad_id", "epoch", "source").agg(F.min("event_id").alias("event_id")),
            _sets(s, d, "coarse_sets").where("source = 'live'").drop("line1"),
            ("event_id",))),
        oracle(["coarse_sets"], """
            WITH stored AS (SELECT norad_id, epoch_utc, source, min(event_id) AS event_id
                FROM coarse_sets WHERE source = 'archive' GROUP BY ALL),
            arriving AS (SELECT norad_id, epoch_utc, source, min(event_id) AS event_id
                FROM coarse_sets WHERE source = 'live' GROUP BY ALL)
            SELECT norad_id, epoch_utc AS epoch, source, event_id FROM stored
            UNION ALL SELECT norad_id, epoch_utc, source, event_id FROM arriving a
            WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.norad_id = a.norad_id
              AND s.epoch_utc = a.epoch_utc)""")),
    "ingest_counts": Query(
        lambda s, d: store.ingest_counts(
            _sets(s, d, "coarse_sets"), store.new_element_sets(
                _sets(s, d, "coarse_sets").where("source = 'archive'").select("norad_id", "epoch"),
                _sets(s, d, "coarse_sets"), ("event_id",)), "line1"),
        oracle(["coarse_sets"], """
            WITH fresh AS (SELECT norad_id, epoch_utc, first(line1 ORDER BY event_id) AS line1
                FROM coarse_sets c WHERE NOT EXISTS (SELECT 1 FROM coarse_sets a
                  WHERE a.source = 'archive' AND a.norad_id = c.norad_id
                    AND a.epoch_utc = c.epoch_utc) GROUP BY 1, 2)
            SELECT line1, count(*) AS fetched, coalesce((SELECT count(*) FROM fresh f
              WHERE f.line1 = c.line1), 0) AS "new" FROM coarse_sets c GROUP BY line1""")),
    "upsert_satcat": Query(
        lambda s, d: plain(_upsert(s, d)),
        oracle(["satcat"], f"""
            SELECT coalesce(o.norad_id, n.norad_id) AS norad_id,
              CASE WHEN o.norad_id IS NOT NULL THEN o.intl_desig ELSE '2099-001A' END AS intl_desig,
              CASE WHEN n.norad_id IS NOT NULL THEN 'NEW ' || n.name ELSE o.name END AS name,
              coalesce(n.country, o.country) AS country,
              CAST(coalesce(o.launch_date, n.launch_date) AS STRING) AS launch_date,
              CAST(CASE WHEN n.norad_id IS NULL THEN o.decay_date END AS STRING) AS decay_date,
              coalesce(n.object_type, o.object_type) AS object_type,
              {r6('coalesce(n.rcs_m2, o.rcs_m2)', 'rcs_m2')},
              {r6('coalesce(n.period_min, o.period_min)', 'period_min')},
              {r6('coalesce(n.inclination, o.inclination)', 'inclination')},
              {r6('coalesce(n.apogee_km, o.apogee_km)', 'apogee_km')},
              {r6('coalesce(n.perigee_km + 1, o.perigee_km)', 'perigee_km')}
            FROM (SELECT * FROM satcat WHERE object_type <> 'PAY') o
            FULL JOIN (SELECT * FROM satcat WHERE object_type <> 'R/B') n
              ON o.norad_id = n.norad_id""")),
    "history": Query(
        lambda s, d: plain(catalog.history(
            _sets(s, d), view(s, d, "assets"), "2024-01-05", "2024-01-20")),
        oracle(["element_sets", "assets"], """
            SELECT norad_id, epoch_utc AS epoch, event_id, source, line1 FROM element_sets
            WHERE norad_id IN (SELECT norad_id FROM assets) AND epoch_utc >= 1704412800000
              AND epoch_utc < 1705708800000 ORDER BY 1, 2""")),
    "latest_per_object": Query(
        lambda s, d: plain(catalog.latest_per_object(_sets(s, d))),
        oracle(["element_sets"], """
            SELECT norad_id, max(epoch_utc) AS epoch, arg_max(event_id, epoch_utc) AS event_id,
              arg_max(source, epoch_utc) AS source, arg_max(line1, epoch_utc) AS line1
            FROM element_sets GROUP BY 1""")),
    "current_objects": Query(
        lambda s, d: plain(catalog.current_objects(_sets(s, d))),
        oracle(["element_sets"], """SELECT norad_id, max(epoch_utc) AS latest_epoch
            FROM element_sets WHERE source = 'live' GROUP BY 1""")),
    "archive_coverage": Query(
        lambda s, d: catalog.archive_coverage(
            _sets(s, d), _satcat(s, d), "2024-01-05", "2024-01-20"),
        oracle(["element_sets", "satcat"], """
            SELECT c.norad_id, count(e.norad_id) AS n_sets FROM satcat c
            LEFT JOIN element_sets e ON e.norad_id = c.norad_id
              AND e.epoch_utc >= 1704412800000 AND e.epoch_utc < 1705708800000 GROUP BY 1""")),
    "with_catalog_names": Query(
        lambda s, d: plain(catalog.with_catalog_names(_sets(s, d), _satcat(s, d)).orderBy("name")),
        oracle(["element_sets", "satcat"], """
            SELECT e.norad_id, coalesce(c.name, 'NORAD ' || e.norad_id) AS name,
              count(*) AS n_sets, max(epoch_utc) AS latest_epoch
            FROM element_sets e LEFT JOIN satcat c ON c.norad_id = e.norad_id
            GROUP BY 1, 2 ORDER BY 2""")),
    "active_objects": Query(
        lambda s, d: catalog.active_objects(_satcat(s, d)).select("norad_id"),
        oracle(["satcat"], "SELECT norad_id FROM satcat WHERE decay_date IS NULL")),
    "satcat_lookup": Query(
        lambda s, d: plain(catalog.satcat_lookup(_satcat(s, d), _sets(s, d)).select(
            "norad_id", "name", "country", "object_type", "rcs_m2")),
        oracle(["satcat", "element_sets"], f"""
            SELECT norad_id, name, country, object_type, {r6('rcs_m2')} FROM satcat
            WHERE norad_id IN (SELECT norad_id FROM element_sets)""")),
    "high_value_assets": Query(
        lambda s, d: catalog.high_value_assets(view(s, d, "elements"), _satcat(s, d), exclude=3),
        oracle(["elements", "satcat"], """
            SELECT norad_id, name FROM satcat WHERE object_type = 'PAY' AND norad_id <> 3
              AND norad_id IN (SELECT norad_id FROM elements WHERE source = 'live')""")),
    "launch_cohort": Query(
        lambda s, d: catalog.launch_cohort(_satcat(s, d), _satcat(s, d).where(
            "country = 'UNK'").select(catalog.launch_prefix(F.col("intl_desig")).alias(
                "launch_prefix"))).select("norad_id", "launch_prefix", "intl_desig"),
        oracle(["satcat"], """
            SELECT norad_id, substr(intl_desig, 1, 8) AS launch_prefix, intl_desig FROM satcat
            WHERE substr(intl_desig, 1, 8) IN (SELECT substr(intl_desig, 1, 8) FROM satcat
              WHERE country = 'UNK')""")),
    "catalog_stats": Query(
        lambda s, d: catalog.catalog_stats(_satcat(s, d)),
        oracle(["satcat"], """
            SELECT count(*) AS total, count(*) FILTER (decay_date IS NULL) AS active,
              count(*) FILTER (decay_date IS NULL AND object_type = 'PAY') AS payloads,
              count(*) FILTER (decay_date IS NULL AND object_type = 'DEB') AS debris
            FROM satcat""")),
    "country_rollup": Query(
        lambda s, d: catalog.country_rollup(_satcat(s, d)),
        oracle(["satcat"], """
            SELECT country, count(*) AS n_objects,
              count(*) FILTER (object_type = 'PAY') AS n_payloads,
              count(*) FILTER (object_type = 'DEB') AS n_debris,
              count(*) FILTER (apogee_km BETWEEN 34000 AND 38000 AND perigee_km > 33000) AS n_geo
            FROM satcat WHERE decay_date IS NULL AND country <> '' GROUP BY 1
            ORDER BY 2 DESC, 1 LIMIT 30""")),
    "top_countries": Query(
        lambda s, d: catalog.top_countries(_satcat(s, d)),
        oracle(["satcat"], """
            SELECT country, count(*) AS n_objects FROM satcat
            WHERE decay_date IS NULL AND country IS NOT NULL GROUP BY 1
            ORDER BY 2 DESC, 1 LIMIT 20""")),
    "satcat_regime": Query(
        lambda s, d: catalog.satcat_regime(_satcat(s, d)).select("norad_id", "regime"),
        oracle(["satcat"], f"SELECT norad_id, {SATCAT_BAND} AS regime FROM satcat")),
    "regime_band_filter": Query(
        lambda s, d: _satcat(s, d).select("norad_id", *[
            F.coalesce(orbits.band_predicate(b), F.lit(False)).cast("string").alias(b.lower())
            for b in orbits.BANDS]),
        oracle(["satcat"], """
            SELECT norad_id, CAST(coalesce(apogee_km < 2000, false) AS STRING) AS leo,
              CAST(coalesce(perigee_km >= 2000 AND apogee_km < 34000, false) AS STRING) AS meo,
              CAST(coalesce(apogee_km BETWEEN 34000 AND 38000 AND perigee_km > 33000, false)
                AS STRING) AS geo,
              CAST(coalesce(apogee_km > 35000 AND perigee_km < 2000, false) AS STRING) AS heo,
              CAST(coalesce(perigee_km > 35936, false) AS STRING) AS graveyard FROM satcat""")),
    "catalog_search": Query(
        lambda s, d: plain(catalog.page(catalog.catalog_search(
            _satcat(s, d), "ring", "MEO", "DEB"), 1)),
        oracle(["satcat"], f"""
            SELECT norad_id, name, country, object_type, {r6('apogee_km')}, {r6('perigee_km')},
              {r6('inclination')}, {SATCAT_BAND} AS regime FROM satcat
            WHERE decay_date IS NULL AND name ILIKE '%ring%' AND object_type = 'DEB'
              AND perigee_km >= 2000 AND apogee_km < 34000 ORDER BY norad_id LIMIT 60""")),
    "catalog_page": Query(
        lambda s, d: catalog.page(catalog.catalog_search(_satcat(s, d)).select(
            "norad_id", "name"), 3),
        oracle(["satcat"], """SELECT norad_id, name FROM satcat WHERE decay_date IS NULL
            ORDER BY norad_id LIMIT 60 OFFSET 120""")),
    "page_count": Query(
        lambda s, d: catalog.page_count(catalog.catalog_search(_satcat(s, d))),
        oracle(["satcat"], """SELECT count(*) AS total, CAST(ceil(count(*) / 60.0) AS BIGINT)
            AS pages FROM satcat WHERE decay_date IS NULL""")),
    "map_sample": Query(
        lambda s, d: catalog.map_sample(catalog.map_objects(_satcat(s, d)), target=100).select(
            "norad_id", "name", "regime"),
        oracle(["satcat"], f"""
            WITH o AS (SELECT norad_id, name, {SATCAT_BAND} AS regime,
                row_number() OVER (ORDER BY norad_id) - 1 AS pos, count(*) OVER () AS n
              FROM satcat WHERE decay_date IS NULL AND object_type = 'PAY'
                AND apogee_km IS NOT NULL AND perigee_km IS NOT NULL
                AND inclination IS NOT NULL)
            SELECT norad_id, name, regime FROM o WHERE pos % greatest(1, n // 100) = 0""")),
    "map_regime_counts": Query(
        lambda s, d: catalog.map_sample(catalog.map_objects(_satcat(s, d)), target=100).groupBy(
            "regime").agg(F.count("*").alias("n_objects")),
        oracle(["satcat"], f"""
            WITH o AS (SELECT {SATCAT_BAND} AS regime,
                row_number() OVER (ORDER BY norad_id) - 1 AS pos, count(*) OVER () AS n
              FROM satcat WHERE decay_date IS NULL AND object_type = 'PAY'
                AND apogee_km IS NOT NULL AND perigee_km IS NOT NULL
                AND inclination IS NOT NULL)
            SELECT regime, count(*) AS n_objects FROM o
            WHERE pos % greatest(1, n // 100) = 0 GROUP BY 1""")),
    "attribution": Query(
        lambda s, d: plain(score.attribution(_satcat(s, d)).select("norad_id", "attribution")),
        oracle(["satcat"], """
            SELECT norad_id, round(1.0::DOUBLE - ((coalesce(country, '') NOT IN ('', 'UNK'))::INT
              + (coalesce(object_type, '') NOT IN ('', 'UNK'))::INT) / 2.0, 6) AS attribution
            FROM satcat""")),
    "launch_breakups": Query(
        lambda s, d: plain(breakup.launch_breakups(_satcat(s, d))),
        oracle(["satcat"], f"WITH {BREAKUPS} SELECT {BREAKUP_COLUMNS} FROM breakups")),
    "breakup_fragments": Query(
        lambda s, d: breakup.breakup_fragments(
            _satcat(s, d), breakup.launch_breakups(_satcat(s, d))),
        oracle(["satcat"], f"""WITH {BREAKUPS} SELECT launch_prefix, norad_id FROM debris
            WHERE launch_prefix IN (SELECT launch_prefix FROM breakups)""")),
    "breakups_from_delta": Query(
        lambda s, d: plain(breakup.breakups_from_delta(
            catalog.snapshot_delta(view(s, d, "snapshots")), _satcat(s, d))),
        oracle(["satcat", "snapshots"], f"""
            WITH {BREAKUPS}, times AS (SELECT max(snapshot_at_utc) AS last,
                (SELECT max(snapshot_at_utc) FROM snapshots
                 WHERE snapshot_at_utc < (SELECT max(snapshot_at_utc) FROM snapshots)) AS previous
              FROM snapshots),
            fresh AS (SELECT norad_id FROM snapshots, times WHERE snapshot_at_utc = last
              EXCEPT SELECT norad_id FROM snapshots, times WHERE snapshot_at_utc = previous),
            hit AS (SELECT substr(intl_desig, 1, 8) AS launch_prefix FROM satcat
              WHERE object_type = 'DEB' AND norad_id IN (SELECT norad_id FROM fresh)
              GROUP BY 1 HAVING count(*) >= 3)
            SELECT {BREAKUP_COLUMNS} FROM breakups
            WHERE launch_prefix IN (SELECT launch_prefix FROM hit)""")),
    "evaluate_labelled_events": Query(
        lambda s, d: plain(breakup.evaluate_labelled_events(_satcat(s, d).where(
            "object_type = 'PAY'").select("norad_id", F.when(
                F.col("country").isNull(), "control").otherwise("positive").alias("expected")),
            _satcat(s, d))),
        oracle(["satcat"], f"""
            WITH {BREAKUPS}, labels_ AS (SELECT norad_id,
                CASE WHEN country IS NULL THEN 'control' ELSE 'positive' END AS expected,
                substr(intl_desig, 1, 8) AS launch_prefix FROM satcat WHERE object_type = 'PAY')
            SELECT l.norad_id, expected, l.launch_prefix, n_fragments, confidence,
              CAST(n_fragments IS NOT NULL AS STRING) AS found,
              CAST((n_fragments IS NOT NULL) = (expected = 'positive') AS STRING) AS passed
            FROM labels_ l LEFT JOIN breakups b ON b.launch_prefix = l.launch_prefix""")),
    "snapshot_times": Query(
        lambda s, d: plain(catalog.snapshot_times(view(s, d, "snapshots"))),
        oracle(["snapshots"], """SELECT DISTINCT snapshot_at_utc AS snapshot_at FROM snapshots
            ORDER BY 1""")),
    "snapshot_delta": Query(
        lambda s, d: catalog.snapshot_delta(view(s, d, "snapshots")),
        oracle(["snapshots"], """
            WITH ranked AS (SELECT norad_id, dense_rank() OVER (ORDER BY snapshot_at_utc DESC) AS r
              FROM snapshots)
            SELECT norad_id FROM ranked WHERE r = 1
            EXCEPT SELECT norad_id FROM ranked WHERE r = 2""")),
    "record_snapshot": Query(
        lambda s, d: plain(store.record_snapshot(view(s, d, "snapshots"), catalog.active_objects(
            _satcat(s, d)), "2001-08-01")),
        oracle(["snapshots", "satcat"], """
            SELECT snapshot_at_utc AS snapshot_at, norad_id FROM snapshots
            UNION SELECT 996624000000, norad_id FROM satcat WHERE decay_date IS NULL""")),
    "union_ids": Query(
        lambda s, d: catalog.union_ids(_sets(s, d), view(s, d, "assets")),
        oracle(["element_sets", "assets"], """SELECT norad_id FROM element_sets
            UNION SELECT norad_id FROM assets""")),
    "featured_objects": Query(
        lambda s, d: catalog.featured_objects(_sets(s, d), view(s, d, "assets"), min_sets=65),
        oracle(["element_sets", "assets"], """
            SELECT norad_id FROM element_sets GROUP BY 1
            HAVING count(*) >= 65 OR norad_id IN (SELECT norad_id FROM assets)""")),
    "parse_filter_specs": Query(
        lambda s, d: plain(_parsed(s, d)),
        oracle(["requests"], f"""WITH {SPECS}
            SELECT request_id, CAST(parsed AS STRING) AS parsed, regime, object_type, country,
              name_contains, CAST(decayed AS STRING) AS decayed, {r6('min_inclination')},
              {r6('max_inclination')}, sort, "limit" FROM specs""")),
    "describe_specs": Query(
        lambda s, d: filterspecs.describe_specs(_parsed(s, d)).select("request_id", "description"),
        oracle(["requests"], f"""WITH {SPECS}
            SELECT request_id, concat_ws(' ',
                CASE object_type WHEN 'PAY' THEN 'payloads' WHEN 'R/B' THEN 'rocket bodies'
                  WHEN 'DEB' THEN 'debris' ELSE 'objects' END,
                'in ' || regime, 'owned by ' || upper(country), 'named like ' || name_contains,
                CASE WHEN min_inclination IS NOT NULL OR max_inclination IS NOT NULL THEN 'inclination '
                  || regexp_replace(CAST(coalesce(min_inclination, 0) AS STRING), '\\.0$', '') || ' to '
                  || regexp_replace(CAST(coalesce(max_inclination, 180) AS STRING), '\\.0$', '') END,
                CASE WHEN decayed THEN '(decayed)' END)
              || CASE sort WHEN 'anomaly' THEN ', most anomalous first' WHEN 'altitude_desc'
                THEN ', highest first' WHEN 'altitude_asc' THEN ', lowest first' ELSE '' END
              || ', top ' || CAST("limit" AS STRING) AS description FROM specs""")),
    "apply_filter_specs": Query(
        lambda s, d: plain(filterspecs.apply_filter_specs(
            _satcat(s, d), _parsed(s, d), view(s, d, "scores"))),
        oracle(["requests", "satcat", "scores"], f"""
            WITH {SPECS}, hits AS (
              SELECT p.request_id, p."limit", c.norad_id, c.name, c.country, c.object_type,
                c.apogee_km, c.perigee_km, c.inclination, {SATCAT_BAND} AS regime, score,
                row_number() OVER (PARTITION BY p.request_id ORDER BY CASE p.sort
                  WHEN 'anomaly' THEN -coalesce(score, -1)
                  WHEN 'altitude_desc' THEN -(coalesce(apogee_km, 0) + coalesce(perigee_km, 0))
                  WHEN 'altitude_asc' THEN coalesce(apogee_km, 0) + coalesce(perigee_km, 0)
                  ELSE 0 END, c.norad_id) AS rank
              FROM specs p JOIN satcat c ON
                (c.decay_date IS NOT NULL) = coalesce(p.decayed, false)
                AND (p.object_type IS NULL OR c.object_type = p.object_type)
                AND (p.country IS NULL OR upper(c.country) = upper(p.country))
                AND (p.name_contains IS NULL OR contains(upper(c.name), upper(p.name_contains)))
                AND (p.min_inclination IS NULL OR inclination >= p.min_inclination)
                AND (p.max_inclination IS NULL OR inclination <= p.max_inclination)
                AND CASE p.regime WHEN 'LEO' THEN apogee_km < 2000
                  WHEN 'MEO' THEN perigee_km >= 2000 AND apogee_km < 34000
                  WHEN 'GEO' THEN apogee_km BETWEEN 34000 AND 38000 AND perigee_km > 33000
                  WHEN 'HEO' THEN apogee_km > 35000 AND perigee_km < 2000
                  WHEN 'GRAVEYARD' THEN perigee_km > 35936 ELSE true END
              LEFT JOIN scores s ON s.norad_id = c.norad_id)
            SELECT request_id, norad_id, name, country, object_type, {r6('apogee_km')},
              {r6('perigee_km')}, {r6('inclination')}, regime, {r6('score', 'anomaly')}, rank
            FROM hits WHERE rank <= "limit" """)),
    "recommend_actions": Query(
        lambda s, d: actions.recommend_actions(view(s, d, "dossier_rows")).select(
            "norad_id", "top_action", "top_urgency", F.array_join(F.transform(
                "actions", lambda a: F.concat(a["action_id"], F.lit(":"), a["urgency"])), ",")
            .alias("action_list")),
        oracle(["dossier_rows"], f"""
            WITH {ACTIONS}
            SELECT norad_id, split_part(a[1], ':', 1) AS top_action,
              split_part(a[1], ':', 2) AS top_urgency, array_to_string(a, ',') AS action_list
            FROM sorted_""")),
    "response_posture": Query(
        lambda s, d: actions.response_posture(actions.recommend_actions(
            view(s, d, "dossier_rows"))).select("norad_id", "posture", F.array_join(F.transform(
                "channels", lambda c: c["category"]), ",").alias("categories")),
        oracle(["dossier_rows"], f"""
            WITH {ACTIONS}, kinds AS (SELECT norad_id, split_part(a[1], ':', 2) AS posture,
                list_transform(a, lambda x: {_CATEGORY}) AS k FROM sorted_)
            SELECT norad_id, posture, array_to_string(list_filter(k, lambda x, i:
                list_position(k, x) = i), ',') AS categories FROM kinds""")),
    "combine_factors": Query(
        lambda s, d: plain(score.combine_factors(view(s, d, "dossier_rows")).select(
            "norad_id", "score", "n_factors")),
        oracle(["dossier_rows"], """
            WITH w AS (SELECT norad_id, list_filter([
                (maneuver_activity, 0.2e0), (anomalous_rate, 0.3e0),
                (regime_sensitivity, 0.15e0), (proximity_to_hva, 0.25e0), (attribution, 0.1e0)],
                lambda x: x[1] IS NOT NULL) AS f FROM dossier_rows)
            SELECT norad_id, len(f) AS n_factors, CASE WHEN len(f) > 0 THEN round(100
              * list_sum(list_transform(f, lambda x: x[1] * x[2]))
              / list_sum(list_transform(f, lambda x: x[2])), 6) + 0.0 END AS score FROM w""")),
    "threat_band": Query(
        lambda s, d: score.combine_factors(view(s, d, "dossier_rows")).select(
            "norad_id", orbits.threat_band(F.round("score", 6)).alias("band")),
        oracle(["dossier_rows"], """
            WITH w AS (SELECT norad_id, list_filter([
                (maneuver_activity, 0.2e0), (anomalous_rate, 0.3e0),
                (regime_sensitivity, 0.15e0), (proximity_to_hva, 0.25e0), (attribution, 0.1e0)],
                lambda x: x[1] IS NOT NULL) AS f FROM dossier_rows),
            s AS (SELECT norad_id, round(100 * list_sum(list_transform(f, lambda x: x[1] * x[2]))
              / list_sum(list_transform(f, lambda x: x[2])), 6) AS score FROM w)
            SELECT norad_id, CASE WHEN score >= 67 THEN 'high' WHEN score >= 34 THEN 'moderate'
              WHEN score IS NOT NULL THEN 'low' END AS band FROM s""")),
}
