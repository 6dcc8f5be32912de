"""Views that turn the driver's tables into catalogue tables.

Each view is one SQL text valid in Spark and in the SQL oracle. ``@name``
stands for a table or another view, ``@ms(x)`` for epoch milliseconds,
``@each(...)`` for one row per value.
Columns ending in ``_utc`` hold milliseconds and become timestamps in Spark.
"""

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from orbitframe.session import prepare

DAY0_MS = 1704067200000  # 2024-01-01

VIEWS = {
    "residuals": """
        SELECT user_id AS norad_id, @ms(ts) AS epoch_utc, event_id, value AS dv_ms,
          value * CASE event_id % 7 WHEN 3 THEN 0.9e0 WHEN 4 THEN 0.4e0 WHEN 6 THEN 0.1e0
                  ELSE 0e0 END AS dv_r_ms,
          value * CASE event_id % 7 WHEN 0 THEN 0.9e0 WHEN 1 THEN -0.9e0 WHEN 2 THEN 0.1e0
                  WHEN 3 THEN 0.1e0 WHEN 4 THEN 0.4e0 WHEN 6 THEN -0.8e0 ELSE 0e0 END AS dv_i_ms,
          value * CASE event_id % 7 WHEN 0 THEN 0.1e0 WHEN 1 THEN 0.1e0 WHEN 2 THEN 0.9e0
                  WHEN 4 THEN 0.2e0 WHEN 6 THEN -0.1e0 ELSE 0e0 END AS dv_c_ms
        FROM @events""",
    "element_sets": """
        SELECT user_id AS norad_id, @ms(ts) AS epoch_utc, event_id,
          CASE WHEN event_id % 2 = 0 THEN 'live' ELSE 'archive' END AS source,
          event_type AS line1
        FROM @events""",
    "coarse_sets": """
        SELECT norad_id, epoch_utc - epoch_utc % 21600000 AS epoch_utc, event_id, source, line1
        FROM @element_sets""",
    "shapes": """
        SELECT p_partkey AS norad_id, p_name AS name,
          120e0 + 728e0 * (p_size - 1) + 60e0 * (p_partkey % 5) AS perigee_km,
          120e0 + 728e0 * (p_size - 1) + 60e0 * (p_partkey % 5)
            + (p_retailprice - 900e0) * CASE p_partkey % 6 WHEN 0 THEN 0e0 WHEN 1 THEN 1e0
              WHEN 2 THEN 5e0 WHEN 3 THEN 20e0 WHEN 4 THEN 300e0 ELSE 400e0 END AS apogee_km,
          CASE p_partkey % 12 WHEN 0 THEN 0.05e0 WHEN 1 THEN 3e0 WHEN 2 THEN 8e0
            WHEN 3 THEN 28.5e0 WHEN 4 THEN 45e0 WHEN 5 THEN 51.6e0 WHEN 6 THEN 63.2e0
            WHEN 7 THEN 74e0 WHEN 8 THEN 82.5e0 WHEN 9 THEN 97.9e0 WHEN 10 THEN 99.2e0
            ELSE 120e0 END + ((37 * p_partkey) % 100) * 0.01e0 AS incl_deg,
          CAST((53 * p_partkey) % 360 AS DOUBLE) AS raan_deg,
          CAST((71 * p_partkey) % 360 AS DOUBLE) AS argp_deg,
          CAST((97 * p_partkey) % 360 AS DOUBLE) AS mean_anom_deg,
          1704067200000 + (p_partkey % 10) * 86400000 AS epoch_utc
        FROM @part""",
    "elements": """
        SELECT s.*, 6378.137e0 + (apogee_km + perigee_km) / 2e0 AS semi_major_km,
          (apogee_km - perigee_km) / (2e0 * 6378.137e0 + apogee_km + perigee_km) AS ecc,
          86400e0 / 6.283185307179586e0 * sqrt(398600.4418e0 /
            ((6378.137e0 + (apogee_km + perigee_km) / 2e0)
             * (6378.137e0 + (apogee_km + perigee_km) / 2e0)
             * (6378.137e0 + (apogee_km + perigee_km) / 2e0))) AS revs_per_day,
          6.283185307179586e0 / 60e0 / sqrt(398600.4418e0 /
            ((6378.137e0 + (apogee_km + perigee_km) / 2e0)
             * (6378.137e0 + (apogee_km + perigee_km) / 2e0)
             * (6378.137e0 + (apogee_km + perigee_km) / 2e0))) AS period_min,
          CASE WHEN norad_id % 3 = 0 THEN 'live' ELSE 'archive' END AS source
        FROM @shapes s""",
    "satcat": """
        SELECT norad_id,
          CASE WHEN norad_id % 97 = 0 THEN NULL ELSE
            CAST(1960 + CAST(floor(norad_id / 200e0) AS BIGINT) % 60 AS STRING) || '-'
            || lpad(CAST(CAST(floor(norad_id / 200e0) AS BIGINT) % 1000 AS STRING), 3, '0')
            || 'P' || lpad(CAST(norad_id % 200 AS STRING), 3, '0') END AS intl_desig,
          CASE WHEN norad_id % 101 = 0 THEN NULL ELSE upper(name) END AS name,
          CASE WHEN norad_id % 17 = 0 THEN NULL WHEN norad_id % 19 = 0 THEN ''
            WHEN norad_id % 23 = 0 THEN 'UNK' ELSE p.p_brand END AS country,
          make_date(1960 + CAST(norad_id % 60 AS INT), 1 + CAST(norad_id % 12 AS INT), 1)
            AS launch_date,
          CASE WHEN norad_id % 11 = 0 THEN make_date(2020, 1 + CAST(norad_id % 12 AS INT), 1) END
            AS decay_date,
          CASE norad_id % 10 WHEN 0 THEN 'PAY' WHEN 1 THEN 'R/B' WHEN 2 THEN 'UNK'
            WHEN 3 THEN 'PAY' ELSE 'DEB' END AS object_type,
          CASE WHEN norad_id % 2 = 0 THEN NULL ELSE (norad_id % 400) / 10e0 END AS rcs_m2,
          CASE WHEN norad_id % 13 = 0 THEN NULL ELSE period_min END AS period_min,
          CASE WHEN norad_id % 13 = 0 THEN NULL ELSE
            CASE CAST(floor(norad_id / 200e0) AS BIGINT) % 3
              WHEN 0 THEN 82.5e0 + (norad_id % 5) * 0.1e0
              WHEN 1 THEN 20e0 + (norad_id % 10) * 8e0 ELSE incl_deg END END AS inclination,
          CASE WHEN norad_id % 13 = 0 THEN NULL ELSE apogee_km END AS apogee_km,
          CASE WHEN norad_id % 13 = 0 THEN NULL ELSE perigee_km END AS perigee_km
        FROM @elements e JOIN @part p ON p.p_partkey = e.norad_id""",
    "listed_objects": """
        SELECT norad_id, intl_desig, name, country, decay_date, object_type FROM @satcat
        UNION ALL SELECT 1000000 + s_suppkey, NULL, s_name, NULL,
          CASE WHEN s_suppkey % 3 = 0 THEN make_date(2021, 2, 3) END, 'UNK' FROM @supplier""",
    "perigee_series": """
        SELECT norad_id, epoch_utc, event_id, 0.001e0 * value + CASE norad_id % 6
            WHEN 0 THEN 500e0 - 2e0 * d WHEN 1 THEN 400e0 - 0.5e0 * d - 0.08e0 * d * d
            WHEN 2 THEN 800e0 WHEN 3 THEN 35567e0 - 0.1e0 * d WHEN 4 THEN 150e0 - 2e0 * d
            ELSE 300e0 - d - 0.05e0 * d * d END AS perigee_km
        FROM (SELECT user_id AS norad_id, @ms(ts) AS epoch_utc, event_id, value,
                (@ms(ts) - 1704067200000) / 86400000e0 AS d FROM @events) q""",
    "pair_samples": """
        SELECT user_id AS actor, 1000 + user_id % 5 AS target, @ms(ts) AS t_utc, event_id,
          value AS range_km, (event_id % 100) / 1000e0 AS speed_kms
        FROM @events""",
    "edges": """
        SELECT l_suppkey AS actor, l_partkey AS target,
          CASE l_returnflag WHEN 'A' THEN 'none' WHEN 'N' THEN 'possible' ELSE 'likely' END
            AS label,
          l_extendedprice / 1000e0 AS min_range_km, @ms(l_shipdate) AS start_at_utc,
          @ms(l_shipdate) + CAST(l_quantity AS BIGINT) * 86400000 AS end_at_utc,
          l_orderkey, l_linenumber
        FROM @lineitem""",
    "assets": "SELECT p_partkey AS norad_id, p_name AS name FROM @part WHERE p_size <= 10",
    "snapshots": """
        SELECT DISTINCT @ms(date_trunc('month', o_orderdate + INTERVAL '15' DAY))
            AS snapshot_at_utc,
          o_custkey AS norad_id
        FROM @orders""",
    "states": """
        SELECT norad_id, half, 'OBJ ' || CAST(norad_id AS STRING) AS name, threat_score,
          CASE WHEN threat_score >= 67 THEN 'high' WHEN threat_score >= 34 THEN 'moderate'
            ELSE 'low' END AS threat_band,
          last_maneuver_epoch_utc, n_maneuvers,
          CASE WHEN rpo_min_range_km < 0.4e0 THEN 'likely' WHEN rpo_min_range_km < 1.5e0
            THEN 'possible' ELSE 'none' END AS rpo_label, rpo_min_range_km,
          CASE WHEN half = 1 AND norad_id % 3 = 0 THEN
            1706745600000 + (norad_id % 60) * 86400000 END AS decay_reentry_utc,
          CASE (norad_id + half * n_maneuvers) % 4 WHEN 0 THEN 'COMPLIANT_GRAVEYARD'
            WHEN 1 THEN 'NON_COMPLIANT_SHALLOW' WHEN 2 THEN 'BELOW_GEO_DRIFT' END
            AS disposal_status
        FROM (SELECT user_id AS norad_id,
                CASE WHEN @ms(ts) < 1705363200000 THEN 0 ELSE 1 END AS half,
                max(value) / 4.9e0 + 5e0 AS threat_score, max(@ms(ts)) AS last_maneuver_epoch_utc,
                count(*) AS n_maneuvers, min(value) AS rpo_min_range_km
              FROM @events
              GROUP BY user_id, CASE WHEN @ms(ts) < 1705363200000 THEN 0 ELSE 1 END) q""",
    "texts": "SELECT CAST(doc_id AS STRING) AS report_id, text FROM @documents",
    "text_facts": """
        SELECT report_id, key,
          CASE key WHEN 'chars' THEN CAST(n_chars AS DOUBLE) WHEN 'grade'
            THEN CAST(quality AS DOUBLE) WHEN 'level' THEN 150e0 END AS num_value,
          CASE key WHEN 'place' THEN source || ' 2021-12-' || CAST(10 + doc_id % 18 AS STRING)
            END AS str_value,
          CASE key WHEN 'grade' THEN '/100' ELSE '' END AS unit, key AS label
        FROM (SELECT CAST(d.doc_id AS STRING) AS report_id, d.doc_id, n_chars, source, quality,
                @each('chars', 'grade', 'level', 'place') AS key
              FROM @documents d LEFT JOIN @labels l ON l.doc_id = d.doc_id) q
        WHERE key <> 'grade' OR quality IS NOT NULL""",
    "report_texts": """
        SELECT CAST(o_orderkey AS STRING) AS report_id,
          'OBJ-' || CAST(o_custkey AS STRING) || ' was seen at 09:06:30 UTC. It measured '
          || CAST(CAST(o_totalprice AS DECIMAL(14, 2)) AS STRING) || ' km over '
          || CAST(o_orderkey % 31 AS STRING) || ' days! Object COSMOS2543 gave -'
          || CAST(o_orderkey % 9 AS STRING) || '.5 m/s and '
          || CAST(o_custkey AS STRING) || ' returns. No number here? Mostly '
          || CAST(o_orderkey % 5 AS STRING) || ' of 5.' AS text
        FROM @orders""",
    "report_facts": """
        SELECT CAST(o_orderkey AS STRING) AS report_id, key,
          CASE key WHEN 'size' THEN o_totalprice * (1e0 + (o_orderkey % 7 - 3) * 0.011e0)
            WHEN 'days' THEN CAST(o_orderkey % 30 AS DOUBLE)
            WHEN 'burn' THEN -1e0 * (o_orderkey % 8) - 0.54e0 END AS num_value,
          CASE key WHEN 'share' THEN CAST(o_orderkey % 4 AS STRING) || '/5' END AS str_value,
          CASE key WHEN 'size' THEN ' km/100' ELSE '' END AS unit, key AS label
        FROM (SELECT o_orderkey, o_totalprice, @each('size', 'days', 'burn', 'share') AS key
              FROM @orders) q""",
    "report_names": """
        SELECT CAST(o_orderkey AS STRING) AS report_id, o_custkey AS norad_id,
          'Vanguard ' || CAST(o_orderkey % 3 AS STRING) AS name
        FROM @orders""",
    "requests": """
        SELECT s_suppkey AS request_id,
          CASE WHEN s_suppkey % 10 = 9 THEN 'ring' ELSE 'filter: {"regime": "'
          || CASE s_suppkey % 7 WHEN 0 THEN 'leo' WHEN 1 THEN 'MEO' WHEN 2 THEN 'GEO'
             WHEN 3 THEN 'HEO' WHEN 4 THEN 'GRAVEYARD' ELSE 'MARS' END
          || '", "object_type": "' || CASE s_suppkey % 5 WHEN 0 THEN 'PAY' WHEN 1 THEN 'rb'
             WHEN 2 THEN 'DEB' ELSE 'ROCK' END
          || '", "country": "' || CASE WHEN s_suppkey % 3 = 0 THEN ' brand#12 ' ELSE '' END
          || '", "name_contains": "' || CASE WHEN s_suppkey % 4 = 0 THEN 'red' ELSE '' END
          || '", "decayed": "' || CASE s_suppkey % 6 WHEN 0 THEN 'yes' ELSE 'no' END
          || '", "min_inclination": "' || CASE WHEN s_suppkey % 2 = 0 THEN '10.5' ELSE 'x' END
          || '", "sort": "' || CASE s_suppkey % 4 WHEN 0 THEN 'altitude_desc'
             WHEN 1 THEN 'ALTITUDE_ASC' WHEN 2 THEN 'anomaly' ELSE 'size' END
          || '", "limit": "' || CASE WHEN s_suppkey % 8 = 7 THEN 'many'
             ELSE CAST(s_suppkey * 3 AS STRING) END || '", "other": "1"}' END AS text
        FROM @supplier""",
    "relative": """
        SELECT a.norad_id, a.semi_major_km AS a_rx, (a.norad_id % 7) * 10e0 AS a_ry,
          (a.norad_id % 11) * 5e0 AS a_rz, (a.norad_id % 3) * 0.01e0 AS a_vx,
          7.5e0 - (a.norad_id % 13) * 0.1e0 AS a_vy, (a.norad_id % 5) * 0.2e0 AS a_vz,
          a.semi_major_km + (a.norad_id % 17) AS b_rx, (a.norad_id % 7) * 10e0 - 3e0 AS b_ry,
          (a.norad_id % 11) * 5e0 + 2e0 AS b_rz, (a.norad_id % 3) * 0.01e0 + 0.001e0 AS b_vx,
          7.49e0 - (a.norad_id % 13) * 0.1e0 AS b_vy, (a.norad_id % 5) * 0.2e0 - 0.01e0 AS b_vz
        FROM @elements a""",
    "dossier_rows": """
        SELECT norad_id,
          CASE WHEN norad_id % 4 = 0 THEN NULL ELSE (norad_id % 21) / 20e0 END
            AS maneuver_activity,
          CASE WHEN norad_id % 5 = 0 THEN NULL ELSE (norad_id % 11) / 10e0 END AS anomalous_rate,
          CASE WHEN norad_id % 7 = 0 THEN NULL ELSE (norad_id % 26) / 25e0 END
            AS proximity_to_hva,
          CASE WHEN norad_id % 9 = 0 THEN NULL ELSE (norad_id % 8) / 7e0 END
            AS regime_sensitivity,
          CASE WHEN norad_id % 3 = 0 THEN NULL ELSE (norad_id % 3) / 2e0 END AS attribution,
          CASE norad_id % 6 WHEN 0 THEN 'likely' WHEN 1 THEN 'possible' WHEN 2 THEN 'none' END
            AS rpo_label,
          0.3e0 + norad_id % 50 AS rpo_min_range_km, CAST(norad_id % 9 AS DOUBLE)
            AS rpo_close_days,
          CASE WHEN norad_id % 8 = 0 THEN NULL ELSE norad_id % 5 = 1 END AS same_launch_lineage,
          CASE norad_id % 13 WHEN 0 THEN 'COMPLIANT_GRAVEYARD' WHEN 1 THEN 'BELOW_GEO_DRIFT' END
            AS disposal_status,
          CASE norad_id % 13 WHEN 0 THEN 1 = 1 WHEN 1 THEN 1 = 0 END AS compliant,
          perigee_km - 35786e0 AS km_above_geo,
          CASE WHEN norad_id % 10 < 3 THEN CAST((norad_id * 7) % 200 AS DOUBLE) END
            AS days_to_reentry, 0.5e0 AS decay_rate
        FROM @elements""",
    "encounters": """
        SELECT norad_id AS actor, norad_id + 1 AS target, 1704067200000 + norad_id * 1000 AS tca_utc,
          a_rx, a_ry, a_rz, a_vx, a_vy, a_vz, a_rx + k AS b_rx, a_ry - 0.6e0 * k AS b_ry,
          a_rz + 0.3e0 * k AS b_rz, a_vx + 0.1e0 AS b_vx, a_vy - 0.3e0 AS b_vy, a_vz + 2e0 AS b_vz,
          sqrt(1.45e0 * k * k) AS min_range_km, (norad_id % 7) * 0.5e0 AS age_a_days,
          (norad_id % 4) * 0.75e0 AS age_b_days
        FROM (SELECT *, (norad_id % 23) * (norad_id % 23) * 0.02e0 AS k FROM @relative) q""",
    "scores": """
        SELECT norad_id, (norad_id % 97) / 97e0 AS score FROM @shapes WHERE norad_id % 3 <> 0""",
    "history": """
        SELECT norad_id, at_utc AS epoch_utc,
          incl_deg + 0.0001e0 * (seq % 5) + CASE WHEN seq % 37 = 0 THEN 0.06e0 ELSE 0e0 END
            AS incl_deg,
          raan_deg + degrees(-k * cos(radians(incl_deg))) * dt AS raan_deg, ecc,
          argp_deg + degrees(k * (2e0 - 2.5e0 * sin(radians(incl_deg)) * sin(radians(incl_deg))))
            * dt AS argp_deg,
          mean_anom_deg + (360e0 * revs_per_day * dt / 86400e0) % 360e0 AS mean_anom_deg,
          revs_per_day * (1e0 + ((seq % 11) - 5) * 1e-7) AS revs_per_day,
          CASE WHEN norad_id % 3 = 0 THEN 'live' ELSE 'archive' END AS source,
          'set' AS line1
        FROM (SELECT e.*, h.epoch_utc AS at_utc, h.seq,
                (h.epoch_utc - 1704067200000) / 1000e0 AS dt,
                1.5e0 * 1.08262668e-3 * 6378.137e0 * 6378.137e0 * revs_per_day
                  * 6.283185307179586e0 / 86400e0 / (semi_major_km * (1e0 - ecc * ecc)
                  * semi_major_km * (1e0 - ecc * ecc)) AS k
              FROM @elements e JOIN (
                SELECT l_partkey, 1704067200000 + CAST(floor(
                    (@ms(l_shipdate) - 788918400000) / 100e0) AS BIGINT) AS epoch_utc,
                  min(l_orderkey) AS seq
                FROM @lineitem GROUP BY l_partkey, 1704067200000 + CAST(floor(
                    (@ms(l_shipdate) - 788918400000) / 100e0) AS BIGINT)
              ) h ON h.l_partkey = e.norad_id) q""",
    "neighbour_pairs": """
        SELECT actor, target FROM (
          SELECT p_partkey AS actor, lead(p_partkey) OVER (
            PARTITION BY p_size, p_partkey % 5 ORDER BY p_partkey) AS target
          FROM @part) q
        WHERE target IS NOT NULL""",
    "watch_list": """
        SELECT c_custkey AS norad_id, 1704067200000 + c_custkey AS added_at_utc, c_name AS note
        FROM @customer WHERE c_nationkey < 12""",
    "watch_changes": """
        SELECT o_custkey AS norad_id, @ms(o_orderdate) + o_orderkey AS at_utc,
          CASE WHEN o_orderkey % 3 = 0 THEN 'remove' ELSE 'add' END AS action,
          o_orderpriority AS note
        FROM @orders""",
}

_MS = {"spark": r"unix_millis(CAST(\1 AS TIMESTAMP))", "sql": r"(epoch_us(\1) // 1000)"}
_EACH = {"spark": r"explode(array(\1))", "sql": r"unnest([\1])"}


def _render(text: str, dialect: str) -> str:
    # nested brackets one deep are enough for the views above
    text = re.sub(r"@each\(([^()]*)\)", _EACH[dialect], text)
    return re.sub(r"@ms\(((?:[^()]|\([^()]*\))*)\)", _MS[dialect], text)


def _needed(names: list[str]) -> list[str]:
    """Views in dependency order."""
    order: list[str] = []

    def visit(name):
        for used in re.findall(r"@(\w+)", VIEWS[name]):
            if used in VIEWS:
                visit(used)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    return order


def oracle(names: list[str], body: str) -> str:
    """SQL text for the oracle: the views as CTEs, then ``body``."""
    ctes = [f"{n} AS ({re.sub('@', '', _render(VIEWS[n], 'sql'))})" for n in _needed(names)]
    body = body.strip()
    if re.match(r"WITH\s", body):
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _whole(df: DataFrame) -> DataFrame:
    """The table, joined by merge if as a whole it is too large to be broadcast.

    Spark sizes a table by the share of its files that the columns read should have, so it would send
    the keys of millions of rows to the driver and all tasks, where they take many times as much.
    """
    most = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.hint("merge") if 0 < most < size else df


#: tables with a row an object, which views join by its key
_OBJECTS = {"part"}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame with timestamp columns."""
    used: set[str] = set()

    def expand(match):
        word = match.group(1)
        if word in VIEWS:
            return f"({text_of(word)})"
        used.add(word)
        return "{" + word + "}"

    def text_of(view_name: str) -> str:
        text = _render(VIEWS[view_name], "spark").replace("{", "{{").replace("}", "}}")
        return re.sub(r"@(\w+)", expand, text)

    text = text_of(name)
    tables = {t: table(spark, sf_dir, t) for t in used}
    df = spark.sql(text, **{t: _whole(df) if t in _OBJECTS else df for t, df in tables.items()})
    return df.select(*[
        F.timestamp_millis(c).alias(c[:-4]) if c.endswith("_utc") else F.col(c)
        for c in df.columns])
