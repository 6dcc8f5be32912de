"""Scores, actions, text verification, filter specs and state differences."""


import pytest
from pyspark.sql import functions as F

from orbitframe import schemas
from orbitframe.functions.orbits import threat_band
from orbitframe.operators import actions, filterspecs, score, verify, watch

FACTORS = ", ".join(f"{f} double" for f in score.FACTORS)


def test_combine_factors(spark):
    full = dict.fromkeys(score.FACTORS)
    rows = [{**full, "maneuver_activity": 1.0}, full,
            {**full, "maneuver_activity": 1.0, "anomalous_rate": 0.0}]
    df = spark.createDataFrame([[r[f] for f in score.FACTORS] for r in rows], FACTORS)
    got = [(r["score"], r["n_factors"]) for r in score.combine_factors(df).collect()]
    assert got == [(100.0, 1), (None, 0), (pytest.approx(40.0), 2)]


def test_bands_and_attribution(spark):
    df = spark.createDataFrame([(67.0,), (66.9,), (34.0,), (0.0,), (None,)], "s double")
    assert [r[0] for r in df.select(threat_band(F.col("s"))).collect()] == [
        "high", "moderate", "moderate", "low", None]
    cat = spark.createDataFrame([(1, "US", "PAY"), (2, "UNK", "PAY"), (3, None, ""), (4, "", "UNK")],
                                ["norad_id", "country", "object_type"])
    assert [r["attribution"] for r in score.attribution(cat).collect()] == [0.0, 0.5, 1.0, 1.0]


def test_factors_are_explained(spark):
    df = spark.createDataFrame([[0.5, 0.25, 0.9, 0.0, None]], ", ".join(f"{f} double" for f in (
        "maneuver_activity", "anomalous_rate", "regime_sensitivity", "proximity_to_hva", "attribution")))
    why = {f["name"]: f["explanation"] for f in df.select(score.factor_list().alias("f")).first()["f"]}
    assert why["maneuver_activity"] == "largest burn 10.0 m/s"
    assert why["anomalous_rate"] == "25 % of campaigns leave the usual pattern"
    assert why["proximity_to_hva"] == "no high-value asset within 5000 km"
    assert why["attribution"] == "not in the catalogue" and "0.90" in why["regime_sensitivity"]


# ---------------------------------------------------------------- actions
DOSSIER = ("maneuver_activity double, anomalous_rate double, proximity_to_hva double, "
           "attribution double, rpo_label string, rpo_min_range_km double, rpo_close_days double, "
           "same_launch_lineage boolean, disposal_status string, compliant boolean, "
           "km_above_geo double, days_to_reentry double, decay_rate double")
NAMES = [c.split()[0] for c in DOSSIER.split(", ")]


@pytest.mark.parametrize("values, expected", [
    ({}, ["routine_custody"]),
    (dict(maneuver_activity=.5, proximity_to_hva=.4), ["persistent_custody"]),
    (dict(proximity_to_hva=.6), ["elevate_cadence"]),
    (dict(attribution=.5, rpo_label="likely", rpo_min_range_km=.036, rpo_close_days=4.0),
     ["notify_operator", "characterize_unknown"]),
    (dict(rpo_label="possible", same_launch_lineage=True, rpo_min_range_km=3.0),
     ["confirm_deployment"]),
    (dict(anomalous_rate=.3, compliant=False, disposal_status="X", km_above_geo=10.0,
          days_to_reentry=10.0, decay_rate=1.0),
     ["reentry_monitoring", "maneuver_watchlist", "disposal_followup"]),
    (dict(days_to_reentry=200.0, decay_rate=.1, attribution=1.0),
     ["characterize_unknown", "reentry_monitoring"])])
def test_actions(spark, values, expected):
    df = spark.createDataFrame([[values.get(n) for n in NAMES]], DOSSIER)
    row = actions.response_posture(actions.recommend_actions(df)).first()
    assert [a["action_id"] for a in row["actions"]] == expected
    assert row["posture"] == row["actions"][0]["urgency"]
    assert len({c["category"] for c in row["channels"]}) == len(row["channels"])


# ---------------------------------------------------------------- verification
def grounded(spark, text):
    facts = spark.createDataFrame(
        [("r", "drag", -7.4, None, " km/day"), ("r", "count", 640.0, None, ""),
         ("r", "margin", .8, None, " km/1000"), ("r", "window", None, "from 2030-08-19T21:00:00Z", ""),
         ("r", "share", None, "6/7", "")],
        "report_id string, key string, num_value double, str_value string, unit string")
    names = spark.createDataFrame([("r", 90417, "TESTBIRD 12")],
                                  "report_id string, norad_id long, name string")
    texts = spark.createDataFrame([("r", text)], ["report_id", "text"])
    rows = verify.verify_sentences(texts, verify.fact_pools(facts, names)).orderBy("seq").collect()
    return [(r["n_numbers"], r["grounded"]) for r in rows]


@pytest.mark.parametrize("text, expected", [
    ("It sinks by -7.5 km a day? That is 9 in 1000.", [(1, True), (2, False)]),
    ("Some 652 pieces, not 653.", [(2, False)]),                                   # 2 % of 640 is 12.8
    ("About 652 pieces.", [(1, True)]), ("About 653 pieces.", [(1, False)]),
    ("QX-77 passed at 23:59 and again at 04:15:30.", [(0, True)]),
    ("Since 19 August 2030, 6 in 7 looks at 90417 (TESTBIRD 12) agree.", [(6, True)]),
    ("A margin of 0.85 km held. Then 0.86 km.", [(1, True), (1, False)]),          # within 0.05
    ("No figure at all", [(0, True)]), ("\t\n ", [])])
def test_grounding(spark, text, expected):
    assert grounded(spark, text) == expected


def test_huge_numeral_is_unbacked(spark):
    assert grounded(spark, "A mass of 7e400 kg.") == [(1, False)]


def test_unicode_word_borders(spark):
    df = spark.createDataFrame([("r", 0, "üb34 oder KR-9 x")], ["report_id", "seq", "sentence"])
    assert [r["value"] for r in verify.numbers_in(df).collect()] == [34.0]


def test_half_even_rounding(spark):
    df = spark.createDataFrame([(1, "A", 2.5), (2, "A", 3.5)],
                               ["norad_id", "disposal_status", "km_above_geo"])
    got = [r["num_value"] for r in verify.facts_from_disposal(df).where(
        "num_value IS NOT NULL").orderBy("report_id").collect()]
    assert got == [2.0, 4.0]


def test_clean_text(spark):
    df = spark.createDataFrame([("r", "Watch cycle findings:\n- a 1\n\n Two things.\n- b\nDone.")],
                               ["report_id", "text"])
    assert verify.clean_generated_text(df).first()["clean_text"] == "Two things. Done."


# ---------------------------------------------------------------- filter specs
@pytest.mark.parametrize("text, expected", [
    ('{"regime": "geo", "object_type": "PAY", "country": "prc"}',
     dict(regime="GEO", object_type="PAY", country="prc", limit=50)),
    ('sure: {"object_type": "RB", "limit": 99999, "colour": 1} ok',
     dict(object_type="R/B", limit=200)),
    ('{"regime": "MARS", "sort": "size", "limit": "many", "min_inclination": "x"}',
     dict(regime=None, sort=None, limit=50, min_inclination=None)),
    ('{"decayed": "true", "limit": 0, "sort": "ANOMALY"}',
     dict(decayed=True, limit=1, sort="anomaly")),
    ('{"decayed": true, "max_inclination": 97.5}', dict(decayed=True, max_inclination=97.5)),
    ('{"decayed": 1, "limit": "3.7", "min_inclination": true, "max_inclination": "88"}',
     dict(decayed=None, limit=50, min_inclination=1.0, max_inclination=88.0)),
    ('{"limit": 7.9, "limit": 12.6, "country": 0, "name_contains": false, "decayed": "YES "}',
     dict(parsed=True, limit=12, country=None, name_contains=None, decayed=True)),
    ('{"limit": " 9 ", "country": 5, "name_contains": [], "min_inclination": [1], "regime": null}',
     dict(limit=9, country="5", name_contains=None, min_inclination=None, regime=None)),
    ("cosmos", dict(parsed=False, name_contains="cosmos", limit=50, decayed=None)),
    ("{not json}", dict(parsed=False, name_contains="{not json}"))])
def test_parse_specs(spark, text, expected):
    row = filterspecs.parse_filter_specs(spark.createDataFrame([(1, text)], ["request_id", "text"]))
    row = row.first().asDict()
    assert {k: row[k] for k in expected} == expected


def test_describe(spark):
    df = filterspecs.parse_filter_specs(spark.createDataFrame(
        [(1, '{"object_type":"DEB","regime":"LEO","min_inclination":97,"sort":"altitude_asc"}')],
        ["request_id", "text"]))
    assert filterspecs.describe_specs(df).first()["description"] == (
        "debris in LEO inclination 97 to 180, lowest first, top 50")


def test_filter_specs_list_few_of_the_matches(spark, monkeypatch):
    rows = [(i % 280 or None, f"{'RING' if i % 9 == 0 else 'BOLT'} {i}", ["US", "cn", None][i % 3],
             None if i % 11 else "2020-01-01", ["PAY", "DEB"][i % 2], 300.0 + 130.0 * (i % 31),
             300.0 + 100.0 * (i % 31), float(i % 100)) for i in range(300)]
    catalog = spark.createDataFrame(rows, "norad_id long, name string, country string, "
        "decay_date string, object_type string, apogee_km double, perigee_km double, inclination double")
    anomaly = spark.createDataFrame([(i, i % 7 / 7) for i in range(0, 280, 2)] + [(4, 0.9)],
                                    "norad_id long, score double")
    wishes = [
        {"limit": 3}, {"limit": 40, "sort": "altitude_desc"}, {"name_contains": "ring", "limit": 5},
        {"name_contains": "RING 27", "sort": "anomaly"}, {"regime": "LEO", "sort": "altitude_asc"},
        {"country": "CN", "object_type": "DEB", "min_inclination": 95.0, "sort": "anomaly"},
        {"decayed": True, "max_inclination": 10.0}, {"min_inclination": 400.0}]
    columns = ["regime", "object_type", "country", "name_contains", "decayed", "min_inclination",
               "max_inclination", "sort", "limit"]
    ids = [1, 2, 3, 4, 5, 6, 7, 8, 1, None, None] + list(range(9, 60))
    specs = spark.createDataFrame(
        [[i] + [{"limit": 50, **wishes[n % len(wishes)]}.get(c) for c in columns]
         for n, i in enumerate(ids)], "request_id int, regime string, object_type string, "
        "country string, name_contains string, decayed boolean, min_inclination double, "
        "max_inclination double, sort string, limit int")
    listed, first = [], filterspecs._first

    def counted(df, by, *rest):
        if by == ["_ask"]:
            listed.append(df.count())
        return first(df, by, *rest)

    monkeypatch.setattr(filterspecs, "_first", counted)
    got = filterspecs.apply_filter_specs(catalog, specs, anomaly, depth=8)
    matches = filterspecs.matching_objects(catalog, specs).join(anomaly, "norad_id", "left")
    order = {"anomaly": lambda r: -(-1.0 if r["score"] is None else r["score"]),
             "altitude_desc": lambda r: -(r["apogee_km"] + r["perigee_km"]),
             "altitude_asc": lambda r: r["apogee_km"] + r["perigee_km"]}
    groups = {}
    for r in matches.collect():
        groups.setdefault(r["request_id"], []).append(
            (order.get(r["sort"], lambda _: 0.0)(r), -1 if r["norad_id"] is None else r["norad_id"], r["limit"]))
    want = sorted((-1 if q is None else q, rank, norad) for q, group in groups.items()
                  for rank, (_, norad, limit) in enumerate(sorted(group), 1) if rank <= min(limit, 200))
    place = lambda v: -1 if v is None else v
    assert sorted((place(r["request_id"]), r["rank"], place(r["norad_id"])) for r in got.collect()) == want
    assert sum(listed) < matches.count() / 4


# ---------------------------------------------------------------- states
BASE = dict(norad_id=1, name="OBJ", threat_score=50.0, threat_band="moderate", n_maneuvers=3,
            rpo_label="none", rpo_min_range_km=None, decay_reentry=None,
            disposal_status="OPERATIONAL_OR_ABANDONED_IN_PLACE")


def findings(spark, day, before, after):
    make = lambda change: spark.createDataFrame([[{
        **BASE, "last_maneuver_epoch": day(0), **change}[c] for c in schemas.OBJECT_STATE.names]],
        schemas.OBJECT_STATE)
    previous = make(before) if before is not None else make({}).limit(0)
    rows = watch.diff_states(previous, make(after), F.lit(day(10))).collect()
    return [(r["kind"], r["significance"]) for r in rows]


@pytest.mark.parametrize("before, after, expected", [
    (None, {}, []), ({}, {}, []),
    ({}, dict(threat_band="high"), [("threat_up", "priority")]),
    (dict(threat_band="low"), {}, [("threat_up", "elevated")]),
    (dict(threat_band="high"), dict(threat_band="low"), [("threat_down", "routine")]),
    (dict(threat_band=None), {}, []),
    (dict(rpo_label=None), dict(rpo_label="likely", rpo_min_range_km=.5),
     [("new_rpo", "priority")]),
    (dict(rpo_label="possible", rpo_min_range_km=10.0),
     dict(rpo_label="likely", rpo_min_range_km=4.9), [("rpo_closer", "priority")]),
    (dict(rpo_label="possible", rpo_min_range_km=10.0),
     dict(rpo_label="possible", rpo_min_range_km=5.0), []),
    ({}, dict(disposal_status="BELOW_GEO_DRIFT"), [("disposal_change", "elevated")]),
    ({}, dict(disposal_status=None), [])])
def test_findings(spark, day, before, after, expected):
    assert findings(spark, day, before, after) == expected


def test_findings_with_dates(spark, day):
    more = dict(n_maneuvers=4, last_maneuver_epoch=day(5))
    assert findings(spark, day, {}, more) == [("new_maneuver", "elevated")]
    assert findings(spark, day, {}, dict(last_maneuver_epoch=day(5))) == []
    assert findings(spark, day, {}, dict(decay_reentry=day(20))) == [("new_decay", "priority")]
    assert findings(spark, day, {}, dict(decay_reentry=day(60))) == [("new_decay", "elevated")]


def test_watchlist(spark, day):
    listed = spark.createDataFrame([(1, day(0), "a"), (2, day(0), "b"), (3, day(0), "c")],
                                   schemas.WATCH_LIST)
    changes = spark.createDataFrame(
        [(1, day(1), "add", "new note"), (2, day(1), "remove", None), (4, day(1), "add", "d"),
         (4, day(2), "add", "e"), (5, day(1), "add", "x"), (5, day(2), "remove", None),
         (3, day(1), "remove", None), (3, day(2), "add", "again")],
        "norad_id long, at timestamp, action string, note string")
    naive = lambda n: day(n).replace(tzinfo=None)
    got = {r["norad_id"]: (r["added_at"], r["note"])
           for r in watch.watchlist_changes(listed, changes).collect()}
    assert got == {1: (naive(0), "new note"), 4: (naive(1), "e"), 3: (naive(2), "again")}
