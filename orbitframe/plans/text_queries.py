"""Report facts and verification of texts."""

from pyspark.sql import functions as F

from orbitframe.operators import breakup, elements as el, score, verify
from orbitframe.plans import behaviour_queries as B
from orbitframe.plans import catalog_queries as C
from orbitframe.plans import orbit_queries as O
from orbitframe.plans.adapters import oracle, view
from orbitframe.plans.compare import plain, r6
from orbitframe.plans.query import Query

_NUMBER = r"-?\d+\.?\d*(?:[eE][-+]?\d+)?"


def pools(facts: str, names: str | None = None) -> str:
    extra = "" if names is None else f"""
      UNION ALL SELECT report_id, unnest(list_concat([CAST(norad_id AS STRING)],
        regexp_extract_all(name, '-?\\d+\\.?\\d*'))) FROM {names}"""
    return f"""
exact_text AS (SELECT report_id, unnest(list_concat(
    coalesce(regexp_extract_all(str_value, '\\d+\\.?\\d*'), []),
    coalesce(regexp_extract_all(unit, '-?\\d+\\.?\\d*'), []))) AS v FROM {facts}{extra}),
pools AS (SELECT DISTINCT report_id, 'tolerant' AS pool, num_value AS value FROM {facts}
    WHERE num_value IS NOT NULL
  UNION SELECT DISTINCT report_id, 'exact', CAST(v AS DOUBLE) FROM exact_text)"""


def sentences(texts: str) -> str:
    return f"""
pieces AS (SELECT report_id, string_split(regexp_replace(trim(text), '([.!?])\\s+',
    '\\1' || chr(31), 'g'), chr(31)) AS parts FROM {texts}),
sentences AS (SELECT report_id, seq, sentence FROM (
    SELECT report_id, generate_subscripts(parts, 1) - 1 AS seq,
      regexp_replace(unnest(parts), '^\\s+|\\s+$', '', 'g') AS sentence FROM pieces) q
  WHERE sentence <> ''),
numbers AS (SELECT report_id, seq, pos, value FROM (
    SELECT report_id, seq, generate_subscripts(found, 1) - 1 AS pos,
      try_cast(unnest(found) AS DOUBLE) AS value FROM (
      SELECT report_id, seq, regexp_extract_all(regexp_replace(regexp_replace(sentence,
        '\\b[A-Za-z]+-?\\d+[A-Za-z]*\\b', ' ', 'g'), '\\b\\d{{1,2}}:\\d{{2}}(?::\\d{{2}})?\\b',
        ' ', 'g'), '{_NUMBER}') AS found FROM sentences) a) b WHERE value IS NOT NULL)"""


UNBACKED = """
unbacked AS (SELECT n.* FROM numbers n WHERE NOT EXISTS (SELECT 1 FROM pools p
  WHERE p.report_id = n.report_id AND CASE p.pool WHEN 'exact' THEN abs(n.value - p.value) < 1e-9
    ELSE abs(n.value - p.value) <= greatest(0.05, 0.02 * abs(p.value)) END)),
verdicts AS (SELECT s.report_id, s.seq, sentence,
    (SELECT count(*) FROM numbers n WHERE n.report_id = s.report_id AND n.seq = s.seq)
      AS n_numbers,
    (SELECT count(*) FROM unbacked u WHERE u.report_id = s.report_id AND u.seq = s.seq)
      AS n_unbacked FROM sentences s)"""

REPORT = f"{pools('report_facts', 'report_names')}, {sentences('report_texts')}, {UNBACKED}"
DOCUMENT = f"{pools('text_facts')}, {sentences('texts')}, {UNBACKED}"
_REPORT_VIEWS = ["report_facts", "report_names", "report_texts"]
_DOCUMENT_VIEWS = ["text_facts", "texts"]


def _report_pools(s, d):
    return verify.fact_pools(view(s, d, "report_facts"), view(s, d, "report_names"))


def _document_pools(s, d):
    return verify.fact_pools(view(s, d, "text_facts"))


def _fact_rows(*rows: tuple[str, str, str], source: str, report: str) -> str:
    """SQL: one SELECT per (key, numeric SQL, text SQL, unit)."""
    return "\nUNION ALL\n".join(
        f"SELECT CAST({report} AS STRING) AS report_id, '{key}' AS key, "
        f"{number} AS num_value, {text} AS str_value FROM {source} "
        f"WHERE ({number}) IS NOT NULL OR ({text}) IS NOT NULL" for key, number, text in rows)


def _facts(df):
    return plain(df.select("report_id", "key", "num_value", "str_value"))


# bround on exact-tie-free data equals round; ties are covered by unit tests

QUERIES = {
    "facts_from_regimes": Query(
        lambda s, d: _facts(verify.facts_from_regimes(
            el.classify_regime(view(s, d, "elements")))),
        oracle(["elements"], f"""WITH {O.LADDER}
            {_fact_rows(('regime_primary', 'CAST(NULL AS DOUBLE)', '"primary"'),
                        ('regime_period', 'round(period_min, 0)', 'CAST(NULL AS STRING)'),
                        source='classified', report='norad_id')}
            UNION ALL SELECT CAST(norad_id AS STRING), 'regime_tag_' || lower(tag), NULL, tag
            FROM (SELECT norad_id, unnest(string_split(special_tags, ',')) AS tag
              FROM classified WHERE special_tags <> '') q""")),
    "facts_from_disposal": Query(
        lambda s, d: _facts(verify.facts_from_disposal(el.assess_disposal(
            el.classify_regime(view(s, d, "elements"))))),
        oracle(["elements"], f"""WITH {O.LADDER}
            {_fact_rows(('disposal_status', 'CAST(NULL AS DOUBLE)', 'disposal_status'),
                        ('disposal_km_above_geo', 'round(km_above_geo, 0) + 0.0',
                         'CAST(NULL AS STRING)'), source='assessed', report='norad_id')}""")),
    "facts_from_breakups": Query(
        lambda s, d: _facts(verify.facts_from_breakups(
            breakup.launch_breakups(view(s, d, "satcat")))),
        oracle(["satcat"], f"""WITH {C.BREAKUPS}
            {_fact_rows(('breakup_n_fragments', 'CAST(n_fragments AS DOUBLE)',
                         'CAST(NULL AS STRING)'),
                        ('breakup_confidence', 'CAST(NULL AS DOUBLE)', 'confidence'),
                        ('breakup_mean_inclination', 'round(mean_inclination_deg, 1)',
                         'CAST(NULL AS STRING)'), source='breakups', report='launch_prefix')}""")),
    "facts_from_maneuvers": Query(
        lambda s, d: _facts(verify.facts_from_maneuvers(B._flagged(s, d, 5.0)).withColumn(
            "key", F.regexp_replace("key", "T.*Z", ""))),
        oracle(["residuals"], f"""WITH {B.flagged(5.0)}, named AS (SELECT *,
              'maneuver_' || strftime(epoch_ms(epoch_utc), '%Y-%m-%d') AS stem,
              CASE WHEN zscore >= 12 THEN 'high' WHEN zscore >= 10 THEN 'medium' ELSE 'low' END
                AS confidence, CASE event_id % 7 WHEN 0 THEN 'prograde' WHEN 1 THEN 'retrograde'
                WHEN 2 THEN 'plane-change' WHEN 3 THEN 'radial' WHEN 6 THEN 'retrograde'
                ELSE 'mixed' END AS direction FROM flagged)
            SELECT CAST(norad_id AS STRING) AS report_id, stem || '_dv' AS key,
              round(dv_ms, 2) AS num_value, NULL::STRING AS str_value FROM named
            UNION ALL SELECT CAST(norad_id AS STRING), stem || '_direction', NULL, direction
              FROM named
            UNION ALL SELECT CAST(norad_id AS STRING), stem || '_confidence', NULL, confidence
              FROM named
            UNION ALL SELECT CAST(norad_id AS STRING), stem || '_zscore', round(zscore, 1), NULL
              FROM named""")),
    "facts_from_scores": Query(lambda s, d: _facts(verify.facts_from_scores(
        score.combine_factors(view(s, d, "dossier_rows")).withColumn(
            "score", F.round("score", 6)).withColumn("band", C.orbits.threat_band(F.col("score"))))),
        oracle(["dossier_rows"], f"""
            WITH w AS (SELECT *, list_filter([
                (maneuver_activity, 0.2e0), (anomalous_rate, 0.3e0), (regime_sensitivity, 0.15e0),
                (proximity_to_hva, 0.25e0), (attribution, 0.1e0)], lambda x: x[1] IS NOT NULL) AS f
              FROM dossier_rows),
            scored AS (SELECT *, round(100 * list_sum(list_transform(f, lambda x: x[1] * x[2]))
                / list_sum(list_transform(f, lambda x: x[2])), 6) AS score FROM w),
            banded AS (SELECT *, CASE WHEN score >= 67 THEN 'high' WHEN score >= 34 THEN 'moderate'
                WHEN score IS NOT NULL THEN 'low' END AS band FROM scored)
            {_fact_rows(('threat_score', 'round_even(score, 0)', 'CAST(NULL AS STRING)'),
                        ('threat_level', 'CAST(NULL AS DOUBLE)', 'band'),
                        ('threat_factors_available', 'CAST(NULL AS DOUBLE)', "len(f) || '/5'"),
                        *((f'threat_factor_{x}', f'round_even({x}, 2)', 'CAST(NULL AS STRING)')
                          for x in score.FACTORS), source='banded', report='norad_id')}""")),
    "facts_from_decay": Query(lambda s, d: _facts(verify.facts_from_decay(
        B.decay.predict_decay(view(s, d, "perigee_series"), tie=["event_id"]))),
        oracle(["perigee_series"], f"""WITH {B.DECAY_FULL}
            {_fact_rows(('decay_perigee', 'round(latest_perigee_km, 0)', 'CAST(NULL AS STRING)'),
                        ('decay_rate', 'round(decay_rate, 2) + 0.0', 'CAST(NULL AS STRING)'),
                        ('decay_reentry_date', 'CAST(NULL AS DOUBLE)',
                         "CASE WHEN days_to_reentry > 0 THEN strftime(epoch_ms(latest_epoch + CAST(floor("
                         "days_to_reentry * 86400e3) AS BIGINT)), '%Y-%m-%dT%H:%M:%SZ') END"),
                        ('decay_days_to_reentry', 'CASE WHEN days_to_reentry > 0 THEN '
                         'round(days_to_reentry, 0) END', 'CAST(NULL AS STRING)'),
                        source='predicted', report='norad_id')}""")),
    "fact_pools": Query(
        lambda s, d: plain(_report_pools(s, d)),
        oracle(_REPORT_VIEWS, f"""WITH {pools('report_facts', 'report_names')}
            SELECT report_id, pool, {r6('value')} FROM pools""")),
    "split_sentences": Query(
        lambda s, d: verify.split_sentences(view(s, d, "texts")),
        oracle(["texts"], f"WITH {sentences('texts')} SELECT report_id, seq, sentence "
                          "FROM sentences")),
    "numbers_in": Query(
        lambda s, d: plain(verify.numbers_in(verify.split_sentences(view(s, d, "texts")))),
        oracle(["texts"], f"""WITH {sentences('texts')}
            SELECT report_id, seq, pos, {r6('value')} FROM numbers""")),
    "unbacked_numbers": Query(
        lambda s, d: plain(verify.unbacked_numbers(verify.numbers_in(
            verify.split_sentences(view(s, d, "report_texts"))), _report_pools(s, d))),
        oracle(_REPORT_VIEWS, f"""WITH {REPORT}
            SELECT report_id, seq, pos, {r6('value')} FROM unbacked""")),
    "verify_sentences": Query(
        lambda s, d: plain(verify.verify_sentences(
            view(s, d, "report_texts"), _report_pools(s, d))),
        oracle(_REPORT_VIEWS, f"""WITH {REPORT}
            SELECT report_id, seq, sentence, n_numbers, n_unbacked,
              CAST(n_unbacked = 0 AS STRING) AS grounded FROM verdicts""")),
    "verify_texts": Query(
        lambda s, d: plain(verify.verify_texts(view(s, d, "texts"), _document_pools(s, d))),
        oracle(_DOCUMENT_VIEWS, f"""WITH {DOCUMENT}
            SELECT report_id, count(*) AS n_sentences,
              count(*) FILTER (n_unbacked > 0) AS n_ungrounded,
              CAST(count(*) FILTER (n_unbacked > 0) = 0 AS STRING) AS all_grounded
            FROM verdicts GROUP BY 1""")),
    "clean_generated_text": Query(
        lambda s, d: verify.clean_generated_text(view(s, d, "texts")).select(
            "report_id", "clean_text"),
        oracle(["texts"], r"""
            WITH l AS (SELECT report_id, list_transform(string_split(replace(replace(text,
                chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)),
                lambda x: trim(x)) AS lines FROM texts)
            SELECT report_id, array_to_string(list_filter(lines, lambda x: x <> ''
              AND NOT starts_with(x, '-')
              AND NOT starts_with(lower(x), 'watch cycle findings')), ' ') AS clean_text
            FROM l""")),
}
