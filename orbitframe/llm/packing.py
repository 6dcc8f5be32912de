"""Best-two-fit packing of token sequences.

Only lengths decide where pieces go, so the plan is made from the histogram of lengths (at most
``capacity`` numbers, whatever the size of the corpus). A bin is filled greedily with the longest
lengths that still fit; then its smallest member gives way to two unpacked lengths that fill the
widened gap more tightly. The filled bin is repeated as often as its lengths last: every step
uses up a length, so there are about capacity * ln(capacity) steps at most. Pieces then look up
their place by (length, rank within the length).
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from orbitframe.llm.common import batch, saved
from orbitframe.llm.tokens import ChunkEncoder

CAPACITY = 4096
END_ID = 1
_PIECES = pa.schema([
    ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
    ("ids_crc32", pa.int64()), ("task", pa.int32()), ("nth", pa.int64())])
_PIECES_DDL = ("doc_id long, piece int, start long, length long, ids_crc32 long, task int, "
               "nth long")


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY,
                 end_id: int = END_ID) -> DataFrame:
    """Documents as token ids plus an end id, cut where longer than ``capacity``.

    A null or empty text is the end id alone. ``task`` and ``nth`` (running number among the
    task's pieces of that length) hold only after the result is written.
    """
    def run(batches):
        encoder, task = ChunkEncoder(tokenizer_path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for rows in batches:
            out = {f.name: [] for f in _PIECES}
            found = encoder.encode([v or "" for v in rows.column(1).to_pylist()])
            for doc_id, ids in zip(rows.column(0).to_pylist(), found):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    cut = ids[start:start + capacity]
                    for name, value in zip(out, (doc_id, piece, start, len(cut),
                                                 zlib.crc32(cut.tobytes()), task, seen[len(cut)])):
                        out[name].append(value)
                    seen[len(cut)] += 1
            yield batch(_PIECES, **out)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, _PIECES_DDL)


class _Lengths:
    """Unpacked lengths with their counts, and the longest one that fits a gap."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts.copy()
        self._fit()

    def _fit(self) -> None:
        self.fit = np.maximum.accumulate(np.where(self.counts > 0, np.arange(len(self.counts)), 0))

    def take(self, length: int, n: int = 1) -> None:
        self.counts[length] -= n
        if not self.counts[length] or (n < 0 and self.counts[length] == -n):
            self._fit()

    def pair(self, gap: int, above: int) -> tuple[int, int] | None:
        """Two unpacked lengths whose sum is the largest in (above, gap]."""
        first = np.flatnonzero(self.counts[:gap])
        if not len(first):
            return None
        second = self.fit[gap - first]
        alone = (second == first) & (self.counts[first] < 2)
        second[alone] = self.fit[first[alone] - 1]
        sums = np.where(second > 0, first + second, 0)
        best = int(sums.argmax())
        return (int(first[best]), int(second[best])) if sums[best] > above else None


def best_two_fit(counts: np.ndarray) -> list[tuple[dict[int, int], int]]:
    """Bins for ``counts[length]`` pieces: ({length: how many in a bin}, number of such bins)."""
    capacity = len(counts) - 1
    left, plan = _Lengths(counts), []
    while left.fit[capacity]:
        members, gap = [], capacity
        while length := int(left.fit[gap]):
            members.append(length)
            gap -= length
            left.take(length)
        while gap:
            smallest = members[-1]
            two = left.pair(gap + smallest, smallest)
            if two is None:
                break
            left.take(smallest, -1)
            members.pop()
            for length in two:
                left.take(length)
                members.append(length)
            gap += smallest - sum(two)
            members.sort(reverse=True)
        bins = {length: members.count(length) for length in members}
        more = min(int(left.counts[length]) // n for length, n in bins.items())
        if more:
            for length, n in bins.items():
                left.take(length, n * more)
        plan.append((bins, 1 + more))
    return plan


def _places(plan) -> dict[str, np.ndarray]:
    """For each run of ranks of a length: its first rank, sequence, offset, pieces in a bin."""
    rows, used, sequence = [], {}, 0
    for bins, repeats in plan:
        offset = 0
        for length, n in bins.items():
            rank = used.get(length, 0)
            rows.append((length, rank, sequence, offset, n))
            used[length] = rank + n * repeats
            offset += length * n
        sequence += repeats
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "sequence", "offset", "n"), table.T))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` of ``token_pieces`` with sequence_id and offset, gapless from 0.

    Pieces of one length are interchangeable, so repeated rows and ties need no rule. No pieces
    give no rows.
    """
    pieces = saved(pieces)
    by_task = saved(pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")))
    counts = np.zeros(capacity + 1, np.int64)
    for row in by_task.groupBy("length").agg(F.sum("n")).collect():  # at most capacity rows
        counts[row[0]] = row[1]
    places = pieces.sparkSession.sparkContext.broadcast(_places(best_two_fit(counts)))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(
        Window.unboundedPreceding, -1)
    first = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = pieces.join(first, ["task", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("nth")).alias("rank"))
    schema = pa.schema([*list(_PIECES)[:5], ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches):
        runs = places.value
        keys = runs["length"] << 44 | runs["rank"]
        for rows in batches:
            length, rank = (rows.column(i).to_numpy() for i in (3, 5))
            at = np.searchsorted(keys, length << 44 | rank, side="right") - 1
            nth = rank - runs["rank"][at]
            n = runs["n"][at]
            yield pa.RecordBatch.from_arrays(
                [*rows.columns[:5], pa.array(runs["sequence"][at] + nth // n),
                 pa.array(runs["offset"][at] + nth % n * length)], schema=schema)

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, "
                                  "ids_crc32 long, sequence_id long, offset long")
