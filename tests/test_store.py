"""Readers, tables, sinks and streams."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from orbitframe.sources.landing import landed
from orbitframe import schemas
from orbitframe.operators import behaviour, catalog, watch
from orbitframe.sources import element_text, sinks, store
from orbitframe.streaming import jobs


def two_lines(norad_id=25544, epoch="24001.50000000", incl=51.64, revs=15.5):
    line1 = f"1 {norad_id:05d}U 98067A   {epoch:14s}  .00016717  00000-0  10270-3 0  9005"
    line2 = (f"2 {norad_id:05d} {incl:8.4f} 247.4627 0006703 130.5360 325.0288 "
             f"{revs:11.8f}563537")
    return line1, line2


def write(folder, name, *parts):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(parts) + "\n")
    return str(folder)


def test_element_text(spark, tmp_path):
    l1, l2 = two_lines()
    other = two_lines(5, "57001.00000000", 34.2, 10.8)
    bad = two_lines(7)
    path = write(tmp_path / "in", "a.txt", "ISS (ZARYA)", l1 + "   ", "", l2, "junk", *other,
                 bad[0], "not a second line", "1 ABCDE" + l1[7:], l2, l1)
    path = write(tmp_path / "in", "b.txt", *two_lines(9, "56366.25000000"))
    rows = {r["norad_id"]: r for r in element_text.read_element_text(spark, path, "live").collect()}
    assert set(rows) == {25544, 5, 9}
    iss = rows[25544]
    assert iss["epoch"] == datetime(2024, 1, 1, 12) and iss["line1"] == l1 and iss["line2"] == l2
    assert (iss["incl_deg"], iss["raan_deg"], iss["ecc"]) == (51.64, 247.4627, 0.0006703)
    assert (iss["argp_deg"], iss["mean_anom_deg"], iss["revs_per_day"]) == (
        130.536, 325.0288, 15.5)
    assert rows[5]["epoch"] == datetime(1957, 1, 1)
    assert rows[9]["epoch"] == datetime(2056, 12, 31, 6)


def test_epoch_is_cut_to_milliseconds(spark):
    line1, _ = two_lines(epoch="24001.12345678")
    got = spark.createDataFrame([(line1,)], ["line1"]).select(element_text.decode_epoch()).first()[0]
    assert got == datetime(2024, 1, 1, 2, 57, 46, 665000)


def test_a_large_file_is_split(spark, tmp_path):
    lines = []
    for i in range(4000):
        lines += [f"OBJECT {i}", *two_lines(i + 1)]
    path = write(tmp_path / "big", "big.txt", *lines)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 40_000)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        df = element_text.read_element_text(spark, path, "live")
        assert df.rdd.getNumPartitions() > 4
        assert sorted(r[0] for r in df.select("norad_id").collect()) == list(range(1, 4001))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_satcat_csv(spark, tmp_path):
    path = write(
        tmp_path / "csv", "satcat.csv",
        "OBJECT_NAME,OBJECT_ID,NORAD_CAT_ID,OBJECT_TYPE,OWNER,LAUNCH_DATE,DECAY_DATE,PERIOD,"
        "INCLINATION,APOGEE,PERIGEE,RCS",
        "ISS,1998-067A,25544,PAY,ISS,1998-11-20,,92.9,51.6,421,418,399.1",
        "OLD,1960-001B,x1,DEB,US,,,,,,,", "GONE,1960-001C,7,DEB,US,1960-01-02,1961-01-01,n/a,,,,")
    rows = {r["norad_id"]: r for r in element_text.read_satcat_csv(spark, path).collect()}
    assert set(rows) == {25544, 7}
    assert rows[25544]["decay_date"] is None and rows[25544]["rcs_m2"] == 399.1
    assert rows[7]["period_min"] is None and str(rows[7]["decay_date"]) == "1961-01-01"


def test_ingest_groups_is_idempotent(spark, tmp_path, day):
    inbox, table = tmp_path / "inbox", str(tmp_path / "table")
    write(inbox, "a.txt", *two_lines(1), *two_lines(2))
    write(inbox, "b.txt", *two_lines(2), *two_lines(3), *two_lines(3))
    incoming = element_text.read_element_text(spark, str(inbox), "live")
    counts = {r["file"][-5:]: (r["fetched"], r["new"])
              for r in store.ingest_groups(spark, incoming, table).collect()}
    assert counts == {"a.txt": (2, 2), "b.txt": (3, 1)}
    shots = str(tmp_path / "snapshots")
    for _ in range(2):
        again = store.ingest_groups(spark, incoming, table, shots, day(0)).collect()
    store.ingest_groups(spark, incoming.where("norad_id < 3"), table, shots, day(1))
    assert sorted((r["snapshot_at"], r["norad_id"]) for r in store.read_snapshots(spark, shots).collect()) == [
        (day(0).replace(tzinfo=None), k) for k in (1, 2, 3)] + [
            (day(1).replace(tzinfo=None), k) for k in (1, 2)]
    assert {(r["fetched"], r["new"]) for r in again} == {(2, 0), (3, 0)}
    saved = store.read_table(spark, table, schemas.ELEMENT_SETS)
    assert sorted(r["norad_id"] for r in saved.collect()) == [1, 2, 3]
    ids = catalog.union_ids(saved)
    snaps = store.record_snapshot(spark.createDataFrame([], schemas.SNAPSHOTS), ids, "2024-01-01")
    assert store.record_snapshot(snaps, ids, "2024-01-01").count() == 3


def test_first_writer_wins(spark, day):
    columns = ["norad_id", "epoch", "source", "seq"]
    stored = spark.createDataFrame([(1, day(0), "archive", 0)], columns)
    arriving = spark.createDataFrame(
        [(1, day(0), "live", 1), (1, day(1), "live", 3), (1, day(1), "archive", 2)], columns)
    got = store.append_element_sets(stored, arriving, ("seq",)).collect()
    assert sorted((r["epoch"], r["seq"]) for r in got) == [
        (day(0).replace(tzinfo=None), 0), (day(1).replace(tzinfo=None), 2)]


def test_upsert_keeps_designator_and_launch(spark):
    cols = "norad_id long, intl_desig string, launch_date date, name string, updated_at long"
    d = lambda s: datetime.fromisoformat(s).date()
    old = spark.createDataFrame([(1, "A", d("2000-01-01"), "old", 1), (2, None, None, "kept", 1)], cols)
    new = spark.createDataFrame([(1, "B", d("2001-01-01"), "mid", 2), (1, "C", None, "new", 3),
                                 (3, "D", None, "added", 2)], cols)
    got = {r["norad_id"]: (r["intl_desig"], str(r["launch_date"]), r["name"])
           for r in store.upsert_satcat(old, new).collect()}
    assert got == {1: ("A", "2000-01-01", "new"), 2: (None, "None", "kept"),
                   3: ("D", "None", "added")}


def test_conjunction_message(spark, tmp_path, day):
    pairs = spark.createDataFrame(
        [(1, 2, day(0.5), 0.0354, 1.25e-4, 0.0171)],
        ["actor", "target", "tca", "min_range_km", "pc_estimate", "hard_body_radius_km"])
    cat = spark.createDataFrame([(1, "SAT A")], ["norad_id", "name"])
    messages = sinks.conjunction_messages(pairs, cat, day(1))
    lines = dict(line.split(" = ", 1) for line in messages.first()["message"].splitlines()
                 if " = " in line and not line.startswith("OBJECT"))
    assert lines["TCA"] == "2024-01-01T12:00:00.000000Z"
    assert lines["MISS_DISTANCE"] == "35.4 [m]" and lines["HARD_BODY_RADIUS"] == "17.1 [m]"
    assert lines["COLLISION_PROBABILITY"] == "1.250e-04"
    assert "OBJECT_NAME = SAT A" in messages.first()["message"]
    assert "OBJECT_NAME = 2" in messages.first()["message"]
    sinks.write_conjunction_messages(messages, str(tmp_path / "cdm"))
    assert "CCSDS_CDM_VERS" in spark.read.text(str(tmp_path / "cdm")).first()[0]


def test_dossier_documents(spark, tmp_path):
    from orbitframe.plans.dossier_queries import dossiers
    sheet = landed(dossiers(spark, "/root/testdata/sf0.001"))
    sinks.write_dossier_json(sheet, str(tmp_path / "docs"))
    docs = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "docs")).collect()]
    rows = {r["norad_id"]: r for r in sheet.collect()}
    assert {d["norad_id"] for d in docs} == set(rows)
    for doc in docs:
        row = rows[doc["norad_id"]]
        assert doc["has_tle"] == row["has_sets"]
        if not doc["has_tle"]:
            sections = ("regime", "elements", "threat", "rpo", "decay", "disposal", "changepoint")
            assert all(doc[part] is None for part in sections)
            assert doc["mitigations"] == [] and doc["n_maneuvers"] == 0
            continue
        assert doc["threat"]["score"] == pytest.approx(row["threat_score"])
        assert (doc["disposal"] is not None) == (row["disposal_status"] is not None)
        assert (doc["rpo"] is not None) == (row["rpo_label"] is not None)
        assert doc["mitigations"][0]["urgency"] == row["top_urgency"]
    assert any(d["rpo"] for d in docs) and not all(d["has_tle"] for d in docs)
    shift = F.struct(F.lit("tempo").alias("metric"), F.lit("increased").alias("direction"),
                     F.lit(1.0).alias("before"), F.lit(2.0).alias("after"), F.lit("days").alias("unit"),
                     F.lit("2024-01-01").cast("timestamp").alias("epoch"), F.lit(3.0).alias("t_stat"))
    told = json.loads(sinks.dossier_json(sheet.withColumn("changepoint", shift)).first()["document"])
    assert set(told["changepoint"]) == {"metric", "direction", "before", "after", "unit", "epoch", "t_stat"}


def test_the_object_table_is_kept_by_touched_objects(spark):
    """New sets of some objects: refreshing their rows equals a new table."""
    from orbitframe.operators import dossier
    from orbitframe.plans.adapters import view

    sets = landed(view(spark, "/root/testdata/sf0.001", "history").where("norad_id <= 60"))
    late = (F.col("norad_id") % 5 == 0) & (F.col("epoch") > "2024-01-12")
    before = dossier.object_table(sets.where(~late & (F.col("norad_id") != 7)))
    touched = sets.where(late | (F.col("norad_id") == 7)).select("norad_id")
    kept, anew = dossier.refreshed(before, sets, touched), dossier.object_table(sets)
    rows = lambda df: sorted(str(r) for r in df.select(*sorted(df.columns)).collect())
    assert rows(kept) == rows(anew) and before.count() == anew.count() - 1


def state_rows(spark, rows):
    return spark.createDataFrame(
        [(k, "OBJ", None, band, None, 0, None, None, None, None) for k, band in rows],
        schemas.OBJECT_STATE)


def test_saving_a_cycle_twice_changes_nothing(spark, tmp_path, day):
    root = str(tmp_path / "watch")
    listed = spark.createDataFrame([(1, day(0), "")], schemas.WATCH_LIST)
    snaps = spark.createDataFrame([], schemas.SNAPSHOTS)
    cat = spark.createDataFrame([], schemas.SATCAT)
    run = lambda prev, cur, cycle: store.save_cycle(watch.watch_cycle(
        prev, cur, listed, snaps, cat, cycle, day(cycle)), root)
    run(state_rows(spark, []), state_rows(spark, [(1, "low"), (2, "low")]), 1)
    for _ in range(2):
        run(store.load_states(spark, root, before=2),
            state_rows(spark, [(1, "high"), (2, "high")]), 2)
    cycles = spark.read.parquet(root + "/cycle")
    found = watch.cycle_findings(cycles, spark.read.parquet(root + "/findings")).collect()
    assert [(r["norad_id"], r["kind"]) for r in found] == [(1, "threat_up")]
    assert [r["n_findings"] for r in watch.latest_cycles(cycles).collect()] == [1, 0]
    assert [r["threat_band"] for r in store.load_states(spark, root).collect()] == ["high"]


# ---------------------------------------------------------------- streams
def test_stream_ingest(spark, tmp_path):
    inbox, table, mark = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "c")
    write(inbox, "a.txt", *two_lines(1), *two_lines(2), *two_lines(2))
    start = lambda: jobs.ingest_stream(
        element_text.stream_element_text(spark, str(inbox), "live"), table, mark)
    start().awaitTermination()
    write(inbox, "b.txt", *two_lines(2), *two_lines(3, "24002.50000000"))
    start().awaitTermination()
    got = store.read_table(spark, table, schemas.ELEMENT_SETS)
    assert sorted(r["norad_id"] for r in got.collect()) == [1, 2, 3]


def test_stream_ingest_keeps_late_sets_and_first_arrivals(spark, tmp_path):
    inbox, table, mark = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "c")
    start = lambda: jobs.ingest_stream(
        element_text.stream_element_text(spark, str(inbox), "live"), table, mark).awaitTermination()
    write(inbox, "a.txt", *two_lines(1, "56001.50000000"))
    start()
    write(inbox, "b.txt", *two_lines(2, "24001.50000000"), *two_lines(2, "24001.50000000"))
    start()
    write(inbox, "c.txt", *two_lines(3, "85001.50000000"), *two_lines(2, "24001.50000000"),
          *two_lines(2, "24200.50000000"))
    start()
    got = store.stored_element_sets(spark, table).collect()
    assert sorted((r["norad_id"], r["epoch"].year) for r in got) == [(1, 2056), (2, 2024), (2, 2024), (3, 1985)]
    plan = store.stored_element_sets(spark, table, ["2024-01"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "epoch_month" in plan.split("PartitionFilters")[1][:200]
    assert store.stored_element_sets(spark, table, ["2024-01"]).count() == 1


def test_a_repeated_save_drops_old_findings(spark, tmp_path):
    root = str(tmp_path / "watch")
    tables = lambda n: {
        "cycle": spark.createDataFrame([(1, n)], "cycle_id long, n_findings long"),
        "findings": spark.createDataFrame([(1, 5)] * n, "cycle_id long, norad_id long"),
        "states": spark.createDataFrame([(1, 5)], "cycle_id long, norad_id long")}
    for n in (2, 0):
        store.save_cycle(tables(n), root)
        assert spark.read.schema("cycle_id long, norad_id long").parquet(root + "/findings").count() == n


def test_stream_campaigns_equal_batch(spark, tmp_path, day):
    rows = [(k, day(t), float(v)) for k in range(3) for t, v in
            ((0, 1), (.5, 4), (3, 2), (10, 1), (10.2, 9), (40 + k, 1))]
    events = spark.createDataFrame(rows, ["norad_id", "epoch", "dv_ms"])
    events.write.parquet(str(tmp_path / "e"))
    stream = jobs.stream_campaigns(spark.readStream.schema(events.schema).parquet(
        str(tmp_path / "e")))
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "o")).option(
        "checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    key = lambda r: (r["norad_id"], r["start_epoch"], r["end_epoch"], r["peak_dv_ms"], r["n_pulses"])
    batch = {key(r) for r in behaviour.campaigns(events).collect()}
    got = {key(r) for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    assert got <= batch and len(got) == 9 and len(batch) == 12


def test_late_events_reopen_campaigns_or_are_handed_over(spark, tmp_path, day):
    """Events 3 and 400 days late: the changes fold to what the batch operator makes of all events."""
    folder, out, mark = str(tmp_path / "e"), str(tmp_path / "o"), str(tmp_path / "c")
    schema = "norad_id long, epoch timestamp, dv_ms double"
    landed_rows = []

    def land(rows):
        landed_rows.extend(rows)
        spark.createDataFrame(rows, schema).write.mode("append").parquet(folder)
        query = jobs.stream_campaigns(spark.readStream.schema(schema).parquet(folder)).writeStream.format(
            "parquet").option("path", out).option("checkpointLocation", mark).trigger(
                availableNow=True).start()
        query.awaitTermination()
        return spark.read.parquet(out)

    key = lambda r: tuple(r[c] for c in ("norad_id", "start_epoch", "end_epoch", "peak_dv_ms",
                                         "peak_epoch", "n_pulses"))
    rows = lambda k, *pairs: [(k, day(t), float(v)) for t, v in pairs]
    land(rows(1, (500, 1), (500.5, 4), (503, 2), (510, 1)) + rows(2, (500, 3), (520, 1)))
    # three days late: it joins two told campaigns, one start goes, and a new campaign appears
    changes = land(rows(1, (501.5, 9), (502.2, 9), (507, 1), (530, 1)))
    kinds = [(r["kind"], r["revision"]) for r in changes.where("norad_id = 1").orderBy("start_epoch").collect()]
    assert kinds.count(("withdrawn", 1)) == 1 and ("campaign", 2) in kinds or ("campaign", 3) in kinds
    merged = {key(r) for r in jobs.current_campaigns(changes).where("norad_id = 1").collect()}
    all_events = spark.createDataFrame(landed_rows, schema)
    batch = {key(r) for r in behaviour.campaigns(all_events).where("norad_id = 1").collect()}
    assert batch - merged == {key(r) for r in behaviour.campaigns(all_events).where(
        "norad_id = 1 AND start_epoch >= '2025-06-01'").collect()} and merged <= batch
    assert any(c[5] == 5 and c[3] == 9.0 and c[4] == day(501.5).replace(tzinfo=None) for c in merged)
    # 400 days late: counted, handed over, and derived by the batch operator
    changes = land(rows(1, (100, 7), (100.2, 8), (140, 1)) + rows(2, (540, 1)))
    late = {r["norad_id"]: (r["n_late"], r["oldest"]) for r in jobs.late_counts(changes).collect()}
    assert late == {1: (3, day(100).replace(tzinfo=None))}
    all_events = spark.createDataFrame(landed_rows, schema)
    final = {key(r) for r in jobs.settled(jobs.current_campaigns(changes), changes, all_events).collect()}
    batch = {key(r) for r in behaviour.campaigns(all_events).collect()}
    assert batch - final == {c for c in batch if c[0] == 2 and c[1] == day(540).replace(tzinfo=None)}
    assert final <= batch and len([c for c in final if c[0] == 1]) == 6


def test_stream_findings_and_replay(spark, tmp_path, day):
    folder, out, mark = str(tmp_path / "s"), str(tmp_path / "o"), str(tmp_path / "c")
    land = lambda rows, at: state_rows(spark, rows).withColumn(
        "cycle_at", F.lit(day(at))).write.mode("append").parquet(folder)

    def run():
        states = spark.readStream.schema(
            state_rows(spark, []).withColumn("cycle_at", F.lit(day(0))).schema).parquet(folder)
        query = jobs.stream_findings(states).writeStream.format("parquet").option(
            "path", out).option("checkpointLocation", mark).trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted((r["norad_id"], r["kind"]) for r in spark.read.parquet(out).collect())

    land([(1, "low"), (2, "moderate")], 0)
    assert run() == []
    land([(1, "high"), (2, "moderate")], 1)
    assert run() == [(1, "threat_up")]
    land([(1, "low"), (2, "low")], 1)
    assert run() == [(1, "threat_up")]
    land([(1, "high"), (2, "low")], 2)
    assert run() == [(1, "threat_up"), (2, "threat_down")]


def test_stream_findings_of_unordered_cycles(spark, tmp_path, day):
    """Several cycles of an object in one micro-batch, out of order and repeated; with a time to live."""
    folder, out, mark = str(tmp_path / "s"), str(tmp_path / "o"), str(tmp_path / "c")
    for at, band in ((2, "moderate"), (0, "low"), (1, "high"), (1, "high"), (2, "moderate")):
        state_rows(spark, [(1, band)]).withColumn("cycle_at", F.lit(day(at))).write.mode("append").parquet(folder)
    states = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
    jobs.stream_findings(states, keep_days=30).writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    got = [(r["cycle_at"].day, r["kind"]) for r in spark.read.parquet(out).orderBy("cycle_at").collect()]
    assert got == [(2, "threat_up"), (3, "threat_down")]
