"""Removal of repeated byte strings by suffix arrays per shard and merging across shards.

Documents are packed into shards of a few MB. Two passes keep the work near the repeats:

* Anchors: of the hashed grams in every window of ``length`` bytes the least are anchors, so all
  occurrences of a string of that length carry the same anchor at the same place. Shards tell
  each other, by buckets of anchors, which of theirs occur elsewhere. Text without an anchor that
  occurs twice cannot hold a repeated string and is left out of what follows.
* Per shard, a suffix array of the rest (prefix doubling that only refines groups which are not
  yet apart, after Larsson and Sadakane) and the common prefixes of its neighbours give the strings
  of ``length`` bytes that come again, and the first of each. The round that tells neighbours apart
  bounds their common prefix; only bytes past that are compared.
* Across shards, only the surroundings of shared anchors are sent that hold a string which is
  the first of its shard. Each bucket of anchors merges the shards' sorted surroundings by binary
  search; equal ones meet there and the earliest stays. Where different surroundings of one anchor
  are left, a suffix array over them finds the strings that they share.

A repeat is removed wherever the same bytes also start earlier: in a smaller doc_id, or in the
same document. Null ids come last. Rows with the same doc_id are different documents in the order
of their shards. A null text is empty. Memory holds one shard or one bucket at a time.
"""

from __future__ import annotations

import hashlib
from math import ceil

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from orbitframe.llm.common import batch, release, saved

LENGTH = 100
GRAM = 48
SHARD_BYTES = 2 << 20
BUCKET_BYTES = 4 << 20
_BLOCK = 1 << 16
_ODD = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_SHARDS = pa.schema([("shard", pa.int64()), ("raw", pa.int64()), ("rest", pa.binary()),
                     ("sizes", pa.binary()), ("body", pa.binary())])
_SHARDS_DDL = "shard long, raw long, rest binary, sizes binary, body binary"
_ANCHORS = pa.schema([("bucket", pa.int64()), ("shard", pa.int64()), ("hashes", pa.binary())])
_ANCHORS_DDL = "bucket long, shard long, hashes binary"
_SENT = pa.schema([("bucket", pa.int64()), ("shard", pa.int64()), ("spans", pa.binary()),
                   ("numbers", pa.binary()), ("body", pa.binary())])
_SENT_DDL = "bucket long, shard long, spans binary, numbers binary, body binary"
_SPANS = pa.schema([("shard", pa.int64()), ("spans", pa.binary())])
_SPANS_DDL = "shard long, spans binary"
DIGESTS_DDL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
# columns of ``numbers``: what is known of each anchor's surroundings
_HASH, _ID, _ID_NULL, _DOC, _ANCHOR, _LEFT, _RIGHT = range(7)


def _packed(array: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(array).tobytes(), 1)


def _unpacked(data: bytes, kind: str = "<i8") -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind)


# -- shards -------------------------------------------------------------------------------------

def shards(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Documents packed into shards, written to the shared folder.

    ``rest`` holds all columns but the text as an Arrow stream, ``sizes`` the bytes of each text
    (-1: null), ``body`` the texts, compressed. Documents are in order of doc_id within a shard.
    """
    at = docs.columns.index("text")
    where = [i for i in range(len(docs.columns)) if i != at]
    id_at = where.index(docs.columns.index("doc_id"))

    def packed(shard: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        ids = rows.column(where[id_at]).combine_chunks()
        order = pa.compute.array_sort_indices(ids)
        rows = rows.take(order)
        values = rows.column(at).cast(pa.binary()).to_pylist()
        rest = rows.select(where)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rest.schema, options=pa.ipc.IpcWriteOptions(
                compression="zstd")) as writer:
            writer.write_table(rest)
        body = b"".join(v or b"" for v in values)
        return batch(_SHARDS, shard=[shard], raw=[len(body)], rest=[sink.getvalue().to_pybytes()],
                     sizes=[_packed(np.array([-1 if v is None else len(v) for v in values], "<i8"))],
                     body=[zstandard.compress(body, 3)])

    def run(batches):
        shard, held, size = TaskContext.get().partitionId() << 32, [], 0
        for rows in batches:
            lengths = pa.compute.binary_length(rows.column(at)).fill_null(0).to_numpy()
            filled = size + np.cumsum(lengths)
            start = 0
            for stop in [*(np.flatnonzero(np.diff(filled // shard_bytes)) + 1), rows.num_rows]:
                if stop > start:
                    held.append(rows.slice(start, stop - start))
                    size += int(lengths[start:stop].sum())
                if held and (stop < rows.num_rows or size >= shard_bytes):
                    yield packed(shard, held)
                    shard, held, size = shard + 1, [], 0
                start = stop
            held = [pa.RecordBatch.from_pylist(r.to_pylist(), r.schema) if r.num_rows < rows.num_rows
                    else r for r in held]  # do not hold on to a whole batch
        if held:
            yield packed(shard, held)

    typed = docs.withColumn("text", F.col("text").cast("string")).withColumn(
        "doc_id", F.col("doc_id").cast("long"))
    return saved(typed.mapInArrow(run, _SHARDS_DDL))


def _bounds(sizes: bytes) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.maximum(_unpacked(sizes), 0))])


# -- anchors ------------------------------------------------------------------------------------

def _byte_hashes() -> np.ndarray:
    x = np.arange(1, 257, dtype=np.uint64) * _ODD
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def _sliding(x: np.ndarray, width: int, step) -> np.ndarray:
    """``step`` (minimum or maximum) over each ``width`` neighbours."""
    have = 1
    while 2 * have <= width:
        x = step(x[:-have], x[have:])
        have *= 2
    return step(x[:len(x) - (width - have)], x[width - have:]) if width > have else x


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        piece, base, have = _byte_hashes()[data], _ODD, 1
        out, done = None, 0
        while have <= gram:
            if gram & have:
                if out is None:
                    out = piece
                else:  # the piece of ``have`` bytes that follows the ``done`` bytes
                    out = out[:len(piece) - done] * base + piece[done:]
                done += have
            if 2 * have > gram:
                break
            piece, base, have = piece[:-have] * base + piece[have:], base * base, 2 * have
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        return np.minimum(out ^ (out >> np.uint64(29)), _NONE - np.uint64(1))


def anchors(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Positions and hashes of the anchors of a shard's bytes; grams stay inside documents.

    Every string of ``length`` bytes holds an anchor whose place in it depends on it alone.
    """
    width = length - gram + 1
    found, hashes = [], []
    ends = np.repeat(bounds[1:], np.diff(bounds))
    for start in range(0, len(data), _BLOCK):
        a, b = max(0, start - width + 1), min(len(data), start + _BLOCK + length - 1)
        if b - a < gram:
            continue
        h = _gram_hashes(data[a:b], gram)
        at = np.arange(a, a + len(h))
        h[at + gram > ends[a:a + len(h)]] = _NONE
        padded = np.concatenate([np.full(width - 1, _NONE), h, np.full(width - 1, _NONE)])
        top = _sliding(_sliding(padded, width, np.minimum), width, np.maximum)
        own = np.flatnonzero((top == h) & (h != _NONE) & (at >= start) & (at < start + _BLOCK))
        found.append(at[own])
        hashes.append(h[own])
    return (np.concatenate(found or [np.empty(0, np.int64)]),
            np.concatenate(hashes or [np.empty(0, np.uint64)]))


def _by_bucket(buckets: np.ndarray):
    """(bucket, places) for each value."""
    order = np.argsort(buckets, kind="stable")
    cut = np.flatnonzero(np.diff(buckets[order])) + 1
    for places in np.split(order, cut):
        if len(places):
            yield int(buckets[places[0]]), places


def _anchor_rows(n_buckets: int, length: int, gram: int):
    def run(batches):
        for rows in batches:
            for shard, sizes, body in zip(*(rows.column(n).to_pylist() for n in ("shard", "sizes", "body"))):
                own = np.unique(anchors(_unpacked(body, np.uint8), _bounds(sizes), length, gram)[1])
                for bucket, places in _by_bucket(own % np.uint64(n_buckets)):
                    yield batch(_ANCHORS, bucket=[bucket], shard=[shard],
                                hashes=[own[places].astype("<u8").tobytes()])

    return run


def _shared(rows: pa.Table) -> pa.Table:
    """Of the anchors in a bucket those that two or more shards have, for each of them."""
    parts = [np.frombuffer(h, "<u8") for h in rows["hashes"].to_pylist()]
    hashes = np.concatenate(parts)
    owner = np.repeat(np.arange(len(parts)), list(map(len, parts)))
    order = np.argsort(hashes, kind="stable")
    sorted_hashes = hashes[order]
    again = np.zeros(len(order), bool)
    same = sorted_hashes[1:] == sorted_hashes[:-1]
    again[1:] |= same
    again[:-1] |= same
    keep = order[again]
    owners, shard_ids = owner[keep], rows["shard"].to_pylist()
    out = {"bucket": [], "shard": [], "hashes": []}
    for who, places in _by_bucket(owners):
        out["bucket"].append(rows["bucket"][0].as_py())
        out["shard"].append(shard_ids[who])
        out["hashes"].append(hashes[keep[places]].tobytes())
    return pa.table(out, schema=_ANCHORS)


# -- suffix arrays ------------------------------------------------------------------------------

def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one big-endian number."""
    x = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    for have in (1, 2, 4):
        x = (x[:-have] << np.uint64(8 * have)) | x[have:]
    return x[:len(data)]


def suffix_order(words: np.ndarray, depth: int, shared: np.ndarray | None = None) -> np.ndarray:
    """Positions in order of at least their first ``depth`` bytes.

    Ranks double their reach with every round; a round sorts only groups of equal rank. The round
    that tells a position from the one before it says how many bytes they have in common at least;
    ``shared``, if given, is filled with that for each place of the order.
    """
    n = len(words)
    order = np.argsort(words).astype(np.int32)
    key = words[order]
    fresh = np.concatenate([[True], key[1:] != key[:-1]])
    rank = np.empty(n + 1, np.int32)
    rank[order], rank[n] = np.maximum.accumulate(np.where(fresh, np.arange(n, dtype=np.int32), 0)), -1
    alone = fresh & np.concatenate([fresh[1:], [True]])
    slots, reach = np.flatnonzero(~alone), 8
    if shared is not None:
        shared[:] = np.where(fresh, 0, reach)
    while reach < depth and len(slots):
        at = order[slots]
        key = rank[at].astype(np.int64)
        key <<= 32
        key += rank[np.minimum(at + reach, n)]
        key += 1
        sort = np.argsort(key)
        at, key = at[sort], key[sort]
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        order[slots] = at
        rank[at] = slots[np.maximum.accumulate(np.where(fresh, np.arange(len(slots)), 0))]
        if shared is not None:
            shared[slots[~fresh]] = 2 * reach
        alone = fresh & np.concatenate([fresh[1:], [True]])
        slots, reach = slots[~alone], 2 * reach
    return order


def _zero_bytes(x: np.ndarray) -> np.ndarray:
    """Leading zero bytes of 64-bit numbers that are not zero."""
    top = (x & ~(x >> np.uint64(1))).astype(np.float64)  # never rounds up to the next power of two
    return (1086 - (top.view(np.int64) >> 52)) >> 3


def common_prefixes(words: np.ndarray, order: np.ndarray, cap: int,
                    shared: np.ndarray | None = None) -> np.ndarray:
    """Common prefix with the position before, for each place of ``order``, up to ``cap``.

    ``shared`` is what they have in common at least; from there on eight bytes are compared at a
    time. After ``suffix_order`` that is at most as many bytes again.
    """
    n = len(words)
    padded = np.concatenate([words, np.zeros(cap + 8, np.uint64)])
    p, j = order[1:], order[:-1]
    size = np.zeros(len(p), np.int32) if shared is None else np.minimum(shared[1:], cap)
    going = np.flatnonzero(size < cap)
    while len(going):
        done = size[going]
        x = padded[p[going] + done] ^ padded[j[going] + done]
        equal = x == 0
        apart = ~equal
        size[going[apart]] = done[apart] + _zero_bytes(x[apart])
        going, done = going[equal], done[equal] + 8
        size[going] = done
        going = going[done < cap]
    out = np.zeros(len(order), np.int32)
    out[1:] = np.minimum(size, np.minimum(cap, n - np.maximum(p, j)))
    return out


def repeated_starts(data: np.ndarray, ends: np.ndarray, places: np.ndarray, length: int):
    """Starts of strings of ``length`` bytes inside segments, and whether each comes earlier too.

    ``ends`` is the end of each position's segment, ``places`` a number for each position that is
    least for the string that counts as first; equal numbers are one and the same place.
    """
    whole = np.arange(len(data)) + length <= ends
    if not whole.any():
        return np.empty(0, np.int64), np.empty(0, bool)
    words = _words(data)
    shared = np.empty(len(words), np.int32)
    order = suffix_order(words, length, shared)
    kept = np.flatnonzero(whole[order])
    order = order[kept]
    shared = np.minimum.reduceat(shared[:kept[-1] + 1], np.append(0, kept[:-1] + 1))
    fresh = common_prefixes(words, order, length, shared) < length
    fresh[0] = True
    del words, shared, kept
    own, heads = places[order], np.flatnonzero(fresh)
    first = np.minimum.reduceat(own, heads)
    return order, own != np.repeat(first, np.diff(np.append(heads, len(own))))


# -- one shard ----------------------------------------------------------------------------------

def _cover(starts: np.ndarray, stops: np.ndarray, size: int) -> np.ndarray:
    """Which of ``size`` positions lie in one of the spans."""
    change = np.bincount(starts, minlength=size + 1)
    change -= np.bincount(stops, minlength=size + 1)
    return np.cumsum(change, out=change)[:size] > 0


def _runs(mask: np.ndarray, breaks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the runs of true; ``breaks`` are positions where a run ends anyway."""
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if breaks is not None and len(breaks):
        inner = breaks[(breaks > 0) & (breaks < len(mask))]
        inner = np.unique(inner[mask[inner] & mask[inner - 1]])
        starts, stops = np.sort(np.append(starts, inner)), np.sort(np.append(stops, inner))
    return starts, stops


def _shard_rows(n_buckets: int, length: int, gram: int):
    """What a shard finds by itself and what it sends to the buckets of its shared anchors."""
    def run(_, packed: pa.Table, known: pa.Table) -> pa.Table:
        if not packed.num_rows:
            return _SENT.empty_table()
        row = packed.to_pylist()[0]
        data, bounds = _unpacked(row["body"], np.uint8), _bounds(row["sizes"])
        at, hashes = anchors(data, bounds, length, gram)
        elsewhere = np.sort(np.concatenate(
            [np.empty(0, np.uint64), *(np.frombuffer(h, "<u8") for h in known["hashes"].to_pylist())]))
        sent = np.isin(hashes, elsewhere)
        values, counts = np.unique(hashes, return_counts=True)
        keep = sent | (counts[np.searchsorted(values, hashes)] > 1)
        at, hashes, sent = at[keep], hashes[keep], sent[keep]
        doc = np.searchsorted(bounds, at, side="right") - 1
        lefts = np.maximum(at + gram - length, bounds[doc])
        rights = np.minimum(at + length, bounds[doc + 1])
        inside = _cover(lefts, rights, len(data))
        starts, stops = _runs(inside, bounds)
        places = np.flatnonzero(inside)
        sizes = stops - starts
        ends = np.repeat(np.cumsum(sizes), sizes)
        order, again = repeated_starts(data[places], ends, places, length)
        found = places[order]
        removed = _cover(found[again], found[again] + length, len(data))
        first = np.zeros(len(data) + 1, np.int32)
        first[found[~again] + 1] = 1
        np.cumsum(first, out=first)
        out = {f.name: [] for f in _SENT}

        def put(bucket, spans, numbers=None, body=None):
            for name, value in zip(out, (bucket, row["shard"], spans, numbers, body)):
                out[name].append(value)

        a, b = _runs(removed, bounds)
        if len(a):
            owner = np.searchsorted(bounds, a, side="right") - 1
            put(hash(row["shard"]) % n_buckets,
                _packed(np.stack([owner, a - bounds[owner], b - bounds[owner]], 1).astype("<i8")))
        sent &= first[at + 1] > first[lefts]
        at, hashes, doc, lefts, rights = (x[sent] for x in (at, hashes, doc, lefts, rights))
        ids = pa.ipc.open_stream(row["rest"]).read_all()["doc_id"].combine_chunks()
        null = ids.is_null().to_numpy(zero_copy_only=False)
        ids = ids.fill_null(0).to_numpy()
        numbers = np.stack([hashes.view(np.int64), ids[doc], null[doc], doc, at - bounds[doc],
                            at - lefts, rights - at], 1).astype("<i8")
        for bucket, chosen in _by_bucket(hashes % np.uint64(n_buckets)):
            put(bucket, None, _packed(numbers[chosen]), zstandard.compress(
                b"".join(data[lefts[i]:rights[i]].tobytes() for i in chosen), 3))
        release()
        return pa.table(out, schema=_SENT)

    return run


# -- one bucket ---------------------------------------------------------------------------------

def _merged(keys: np.ndarray, runs: list[np.ndarray], places: np.ndarray):
    """Sorted runs merged by binary search; of equal keys the least place stays.

    Returns the places in ``keys`` that stay, sorted by key, and those that go.
    """
    gone = []
    while len(runs) > 1:
        merged = []
        for a, b in zip(runs[::2], runs[1::2]):
            if len(a) < len(b):
                a, b = b, a
            a = a.copy()
            at = np.searchsorted(keys[a], keys[b])
            same = at < len(a)
            same[same] = keys[a[at[same]]] == keys[b[same]]
            mine, theirs = a[at[same]], b[same]
            later = places[theirs] > places[mine]
            gone.append(np.where(later, theirs, mine))
            a[at[same]] = np.where(later, mine, theirs)
            merged.append(np.insert(a, at[~same], b[~same]))
        runs = merged + runs[len(runs) // 2 * 2:]
    return runs[0], np.concatenate(gone or [np.empty(0, np.int64)])


def _matrix(body: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """Each span of ``body`` as a row, padded with zeros."""
    out = np.zeros((len(starts), width), np.uint8)
    row = np.repeat(np.arange(len(starts)), sizes)
    column = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, column] = body[starts[row] + column]
    return out


def _strings(matrix: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(matrix).view(f"S{matrix.shape[1]}").ravel()


def _group_repeats(body, starts, numbers, places, length: int, limit: int):
    """(place in ``numbers``, offset) of strings around anchors that also occur at a lesser place.

    Whole groups of one anchor go into suffix arrays of up to ``limit`` bytes. A larger group is
    compared place by place instead: its strings are sorted for each distance from the anchor.
    """
    sizes = numbers[:, _LEFT] + numbers[:, _RIGHT]
    order = np.lexsort((places, numbers[:, _HASH]))
    hashes = numbers[order, _HASH]
    cut = np.flatnonzero(np.diff(hashes)) + 1
    chosen = []
    for group in np.split(order, cut):
        if len(group) < 2:
            continue
        if sizes[group].sum() > limit:
            left, right = numbers[group, _LEFT], numbers[group, _RIGHT]
            matrix = _matrix(body, starts[group], sizes[group], int(sizes[group].max()))
            for back in range(length):
                whole = np.flatnonzero((left >= back) & (right >= length - back))
                if len(whole) < 2:
                    continue
                window = np.arange(length) + (left[whole] - back)[:, None]
                text = _strings(matrix[whole[:, None], window])
                sort = np.argsort(text, kind="stable")  # places ascend within a group
                again = np.concatenate([[False], text[sort][1:] == text[sort][:-1]])
                yield group[whole[sort[again]]], (left[whole] - back)[sort[again]]
            continue
        chosen.append(group)
    held, size = [], 0
    for group in [*chosen, None]:
        if held and (group is None or size + sizes[group].sum() > limit):
            own = np.concatenate(held)
            spans = sizes[own]
            row = np.repeat(np.arange(len(own)), spans)
            offset = np.arange(len(row)) - np.repeat(np.cumsum(spans) - spans, spans)
            data = body[starts[own][row] + offset]
            where = places[own][row] - numbers[own, _LEFT][row] + offset
            found, again = repeated_starts(data, np.repeat(np.cumsum(spans), spans), where, length)
            yield own[row[found[again]]], offset[found[again]]
            held, size = [], 0
        if group is not None:
            held.append(group)
            size += int(sizes[group].sum())


def _bucket_rows(length: int, gram: int, limit: int):
    """Repeats across shards; what shards found by themselves passes through."""
    def run(rows: pa.Table) -> pa.Table:
        passed = [(r["shard"], r["spans"]) for r in rows.to_pylist() if r["spans"] is not None]
        sent = [r for r in rows.select(["shard", "numbers", "body"]).to_pylist() if r["numbers"] is not None]
        if len(sent) > 1:
            parts = [_unpacked(r["numbers"]).reshape(-1, 7) for r in sent]
            numbers = np.concatenate(parts)
            shard = np.repeat([r["shard"] for r in sent], list(map(len, parts)))
            body = np.concatenate([_unpacked(r["body"], np.uint8) for r in sent])
            sizes = numbers[:, _LEFT] + numbers[:, _RIGHT]
            starts = np.cumsum(sizes) - sizes
            who = np.stack([numbers[:, _ID_NULL], numbers[:, _ID], shard, numbers[:, _DOC]], 1)
            docs, rank = np.unique(who, axis=0, return_inverse=True)
            places = (rank.ravel().astype(np.int64) << 32) + numbers[:, _ANCHOR]
            head = np.stack([numbers[:, _HASH], numbers[:, _LEFT], sizes], 1).astype(">i8")
            keys = _strings(np.concatenate([
                head.view(np.uint8).reshape(len(head), 24),
                _matrix(body, starts, sizes, 2 * length - gram)], 1))
            runs, at = [], 0
            for part in parts:
                runs.append(at + np.argsort(keys[at:at + len(part)], kind="stable"))
                at += len(part)
            stay, gone = _merged(keys, runs, places)
            gone = gone[sizes[gone] >= length]
            again = [(gone, np.zeros(len(gone), np.int64), sizes[gone])]
            for row, offset in _group_repeats(body, starts[stay], numbers[stay], places[stay],
                                              length, limit):
                again.append((stay[row], offset, np.full(len(row), length)))
            row, offset, span = (np.concatenate(x) for x in zip(*again))
            begin = numbers[row, _ANCHOR] - numbers[row, _LEFT] + offset
            spans = np.stack([numbers[row, _DOC], begin, begin + span], 1).astype("<i8")
            for _, chosen in _by_bucket(shard[row]):
                passed.append((int(shard[row[chosen[0]]]), _packed(_joined(spans[chosen]))))
        release()
        return pa.table({"shard": [s for s, _ in passed], "spans": [b for _, b in passed]},
                        schema=_SPANS)

    return run


def _joined(spans: np.ndarray) -> np.ndarray:
    """(document, start, stop) with touching spans made one."""
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    reach = (spans[:, 0] << 40) + spans[:, 2]
    far = np.maximum.accumulate(reach)
    fresh = np.concatenate([[True], (spans[1:, 0] << 40) + spans[1:, 1] > far[:-1]])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(spans)) - 1
    return np.stack([spans[first, 0], spans[first, 1], far[last] & ((1 << 40) - 1)], 1).astype("<i8")


# -- results ------------------------------------------------------------------------------------

def _removed(packed: pa.Table, spans: pa.Table):
    """(row of the shard table, text bytes or None, starts, stops) for each document."""
    row = packed.to_pylist()[0]
    data, sizes, bounds = _unpacked(row["body"], np.uint8), _unpacked(row["sizes"]), _bounds(row["sizes"])
    found = np.concatenate([np.empty((0, 3), np.int64), *(
        _unpacked(s).reshape(-1, 3) for s in spans["spans"].to_pylist())])
    base = bounds[found[:, 0]]
    starts, stops = _runs(_cover(base + found[:, 1], base + found[:, 2], len(data)), bounds)
    first, last = np.searchsorted(starts, bounds[:-1]), np.searchsorted(starts, bounds[1:])
    rest = pa.ipc.open_stream(row["rest"]).read_all()
    texts = [None if n < 0 else data[a:a + n].tobytes() for a, n in zip(bounds, sizes)]
    return rest, texts, [(starts[a:b] - base, stops[a:b] - base)
                         for a, b, base in zip(first, last, bounds)]


def _digest_rows(_, packed: pa.Table, spans: pa.Table) -> pa.Table:
    out = {"doc_id": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
    if packed.num_rows:
        rest, texts, removed = _removed(packed, spans)
        out["doc_id"] = rest["doc_id"].to_pylist()
        for text, (starts, stops) in zip(texts, removed):
            text, digest, at = text or b"", hashlib.sha256(), 0
            for a, b in zip(starts, stops):
                digest.update(text[at:a])
                at = b
            digest.update(text[at:])
            for name, value in zip(list(out)[1:], (
                    len(text), int((stops - starts).sum()), len(starts), digest.hexdigest())):
                out[name].append(value)
    return pa.table(out, schema=pa.schema([
        ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
        ("n_spans", pa.int64()), ("kept_sha256", pa.string())]))


def _kept_text(text: bytes | None, starts, stops) -> str | None:
    """The text without the spans, each drawn in to whole characters."""
    if text is None:
        return None
    parts, at = [], 0
    inner = lambda i: i < len(text) and text[i] & 0xC0 == 0x80
    for a, b in zip(starts.tolist(), stops.tolist()):
        while a < b and inner(a):
            a += 1
        while b > a and inner(b):
            b -= 1
        parts.append(text[at:a])
        at = b
    return b"".join([*parts, text[at:]]).decode("utf-8", "replace")


def _text_rows(names: list[str]):
    def run(_, packed: pa.Table, spans: pa.Table) -> pa.Table:
        rest, texts, removed = _removed(packed, spans)
        kept = pa.array([_kept_text(t, *r) for t, r in zip(texts, removed)], pa.string())
        del texts, removed
        release()
        columns = iter(rest.columns)
        return pa.table([kept if n == "text" else next(columns) for n in names], names=names)

    return run


def _spans(packed: DataFrame, length: int, gram: int, bucket_bytes: int, limit: int) -> DataFrame:
    total = packed.agg(F.sum("raw")).first()[0] or 0
    parts = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_buckets = max(parts, ceil(total / bucket_bytes))
    shared = packed.select("shard", "sizes", "body").mapInArrow(
        _anchor_rows(n_buckets, length, gram), _ANCHORS_DDL).groupBy("bucket").applyInArrow(
            _shared, _ANCHORS_DDL)
    sent = packed.groupBy("shard").cogroup(shared.groupBy("shard")).applyInArrow(
        _shard_rows(n_buckets, length, gram), _SENT_DDL)
    return sent.groupBy("bucket").applyInArrow(_bucket_rows(length, gram, limit), _SPANS_DDL)


def repeat_digests(docs: DataFrame, length: int = LENGTH, shard_bytes: int = SHARD_BYTES,
                   bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row per row of ``docs``."""
    packed = shards(docs.select("doc_id", "text"), shard_bytes)
    spans = _spans(packed, length, length * GRAM // LENGTH, bucket_bytes, shard_bytes)
    return packed.groupBy("shard").cogroup(spans.groupBy("shard")).applyInArrow(
        _digest_rows, DIGESTS_DDL)


def without_repeats(docs: DataFrame, length: int = LENGTH, shard_bytes: int = SHARD_BYTES,
                    bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` with the repeats taken out of ``text``; all other columns stay as they are.

    Spans are drawn in to whole characters, so up to three bytes more stay at either end. A null
    text stays null.
    """
    typed = docs.withColumn("text", F.col("text").cast("string")).withColumn(
        "doc_id", F.col("doc_id").cast("long"))
    packed = shards(typed, shard_bytes)
    spans = _spans(packed, length, length * GRAM // LENGTH, bucket_bytes, shard_bytes)
    return packed.groupBy("shard").cogroup(spans.groupBy("shard")).applyInArrow(
        _text_rows(typed.columns), typed.schema)
