"""Structured Streaming forms of ingestion, campaigns and findings."""

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from orbitframe import constants as K, schemas
from orbitframe.operators.behaviour import campaigns
from orbitframe.operators.watch import STATE, finding_list
from orbitframe.sources.store import (
    epoch_months, new_element_sets, stored_element_sets, write_element_sets)


def ingest_stream(rows: DataFrame, path: str, checkpoint: str,
                  arrival: tuple[str, ...] = ("file", "block", "seq"), **trigger) -> StreamingQuery:
    """Append landed sets to the table at ``path``, each (norad_id, epoch) once, however old.

    The first arrival wins: within a micro-batch by the ``arrival`` columns that the stream has,
    before that by what is stored. Only the months that a batch touches are read for that. A
    replayed batch finds its rows already stored.
    """
    order = tuple(c for c in arrival if c in rows.columns) or ("ingested_at", "source", "line1")

    def append(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        try:
            existing = stored_element_sets(batch.sparkSession, path, epoch_months(batch))
            write_element_sets(new_element_sets(existing, batch, order).select(
                *schemas.ELEMENT_SETS.names), path)
        finally:
            batch.unpersist()

    return rows.writeStream.foreachBatch(append).option(
        "checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


_DAY_US = 86_400_000_000
_CHANGES = ("norad_id long, kind string, revision long, start_epoch timestamp, end_epoch timestamp, "
            "peak_dv_ms double, peak_epoch timestamp, n_pulses long")


def _sessions(times: np.ndarray, sizes: np.ndarray, gap: int) -> list[list]:
    """[start, end, peak, peak time, pulses] of the runs without a longer gap."""
    order = np.argsort(times, kind="stable")
    times, sizes = times[order], sizes[order]
    cut = np.flatnonzero(np.diff(times) > gap) + 1
    out = []
    for t, v in zip(np.split(times, cut), np.split(sizes, cut)):
        top = int(np.argmax(v))
        out.append([int(t[0]), int(t[-1]), float(v[top]), int(t[top]), len(t)])
    return out


def _merged(campaigns: list[list], new: list, gap: int) -> tuple[list[list], list[list]]:
    """Campaigns with one more session in them, and those that it took in.

    A campaign is a session with its revision and whether that was told.
    """
    apart = [c for c in campaigns if c[1] + gap < new[0] or new[1] + gap < c[0]]
    taken = [c for c in campaigns if not (c[1] + gap < new[0] or new[1] + gap < c[0])]
    parts = [*taken, [*new, 0, False]]
    # the first of equal peaks counts
    top = min(parts, key=lambda c: (-c[2], c[3]))
    whole = [min(c[0] for c in parts), max(c[1] for c in parts), top[2], top[3],
             sum(c[4] for c in parts), max(c[5] for c in parts) + 1, False]
    return sorted([*apart, whole]), taken


def stream_campaigns(events: DataFrame, gap_days: float = K.CAMPAIGN_GAP_DAYS, settle_days: float = 2.0,
                     keep_days: float = 30.0) -> DataFrame:
    """Changes to the campaigns of a stream of flagged events, none of which is dropped.

    A ``campaign`` row tells a campaign once the object's newest event is ``settle_days`` and the
    gap past its end. An event that comes later reopens it: the campaign is told again under the
    next revision, and a start that it no longer has is ``withdrawn``. Campaigns of the last
    ``keep_days`` before an object's newest event are kept as its state, which time bounds. Events
    older than that are handed over as ``late`` rows, one for each run of them with its number of
    pulses, for :func:`settled`. A ``campaign`` table is what :func:`current_campaigns` makes of
    the changes.
    """
    gap, settle, keep = (int(d * _DAY_US) for d in (gap_days, settle_days, keep_days))
    names = [part.split()[0] for part in _CHANGES.split(", ")]

    def follow(key, batches: Iterator[pd.DataFrame], state: GroupState):
        held, newest = [], None
        if state.exists:
            text, newest = state.get
            held = json.loads(text)
        horizon = None if newest is None else newest - keep
        out = []
        tell = lambda kind, c, revision: out.append(
            (key[0], kind, revision, *(pd.Timestamp(c[i], unit="us") for i in (0, 1)), c[2],
             pd.Timestamp(c[3], unit="us"), c[4]))
        for rows in batches:
            times = rows["epoch"].to_numpy("datetime64[us]").astype(np.int64)
            sizes = rows["dv_ms"].to_numpy(float)
            late = times < horizon if horizon is not None else np.zeros(len(times), bool)
            for run in _sessions(times[late], sizes[late], gap) if late.any() else []:
                tell("late", run, 0)
            if late.all():
                continue
            for session in _sessions(times[~late], sizes[~late], gap):
                held, taken = _merged(held, session, gap)
                starts = {c[0] for c in held}
                for c in taken:
                    if c[0] not in starts and c[5] > 0:
                        tell("withdrawn", c, c[5])
            newest = max(int(times[~late].max()), newest if newest is not None else -(1 << 62))
        for c in held:
            if not c[6] and c[1] + gap + settle < newest:
                tell("campaign", c, c[5])
                c[6] = True
        held = [c for c in held if not c[6] or c[1] + gap >= newest - keep]
        if newest is not None:
            state.update((json.dumps(held), newest))
        yield pd.DataFrame(out, columns=names)

    return events.select("norad_id", "epoch", F.col("dv_ms").cast("double")).groupBy(
        "norad_id").applyInPandasWithState(
            follow, _CHANGES, "campaigns string, newest long", "append", GroupStateTimeout.NoTimeout)


def current_campaigns(changes: DataFrame) -> DataFrame:
    """The campaigns that hold after all changes."""
    body = ["end_epoch", "peak_dv_ms", "peak_epoch", "n_pulses"]
    last = changes.where("kind <> 'late'").groupBy("norad_id", "start_epoch").agg(F.max_by(
        F.struct("kind", *body), F.struct("revision", F.col("kind") == "withdrawn")).alias("_l"))
    return last.where("_l.kind = 'campaign'").select("norad_id", "start_epoch", *(f"_l.{c}" for c in body))


def late_counts(changes: DataFrame) -> DataFrame:
    """Events that came after their time, for each object."""
    return changes.where("kind = 'late'").groupBy("norad_id").agg(
        F.sum("n_pulses").alias("n_late"), F.min("start_epoch").alias("oldest"))


def settled(current: DataFrame, changes: DataFrame, events: DataFrame,
            gap_days: float = K.CAMPAIGN_GAP_DAYS) -> DataFrame:
    """Current campaigns where those of objects with late events are derived anew from ``events``.

    ``events`` is the table of all flagged events; only these objects' rows are read.
    """
    ids = late_counts(changes).select("norad_id")
    fresh = campaigns(events.join(ids, "norad_id", "left_semi"), gap_days).select(*current.columns)
    return current.join(ids, "norad_id", "left_anti").unionByName(fresh)


_FLAT = ["norad_id", "name", *STATE]


def with_previous_state(states: DataFrame, keep_days: float | None = None) -> DataFrame:
    """Pair each arriving object state with the one kept for that object.

    ``states`` needs ``cycle_at``. The last state per object lives in the state store, for
    ``keep_days`` without a new one if that is given (it goes with the next micro-batch that has rows);
    the first sight of an object sets the baseline and emits nothing, a cycle not newer than the kept
    one is ignored, so a replay does not alert again. Of a micro-batch one state for each new cycle of an object is held at a time, whatever
    repeats. Differences themselves are column expressions.
    """
    struct = F.struct(*_FLAT)
    packed = states.select("norad_id", "cycle_at", F.to_json(struct).alias("payload"))
    columns = ["norad_id", "cycle_at", "before", "now"]

    def remember(key, batches: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([], columns=columns)
            return
        kept = state.getOption
        at, payload = kept if kept is not None else (None, None)
        queued: dict[int, str] = {}
        for rows in batches:
            stamps = rows["cycle_at"].to_numpy("datetime64[us]").astype(np.int64).tolist()
            for stamp, text in zip(stamps, rows["payload"]):
                if at is None or stamp > at:
                    queued.setdefault(stamp, text)
        out = []
        for at in sorted(queued):
            if payload is not None:
                out.append((key[0], pd.Timestamp(at, unit="us"), payload, queued[at]))
            payload = queued[at]
        if at is not None:
            state.update((at, payload))
            if keep_days is not None:
                state.setTimeoutDuration(int(keep_days * 86_400_000))
        yield pd.DataFrame(out, columns=columns)

    timeout = GroupStateTimeout.NoTimeout if keep_days is None else GroupStateTimeout.ProcessingTimeTimeout
    paired = packed.groupBy("norad_id").applyInPandasWithState(
        remember, "norad_id long, cycle_at timestamp, before string, now string",
        "at long, payload string", "append", timeout)
    schema = schemas.OBJECT_STATE
    return paired.select("norad_id", "cycle_at", F.from_json("before", schema).alias("prev"),
                         F.from_json("now", schema).alias("cur"))


def stream_findings(states: DataFrame, keep_days: float | None = None) -> DataFrame:
    """Findings of a stream of object states."""
    pairs = with_previous_state(states, keep_days)
    return pairs.select("norad_id", "cycle_at", F.explode(
        finding_list(F.col("cycle_at"))).alias("f")).select("norad_id", "cycle_at", "f.*")
