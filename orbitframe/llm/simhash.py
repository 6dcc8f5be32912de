"""Near-duplicate documents: 64-bit SimHash fingerprints linked by pigeonring filtering.

The 64 bits form a ring of four 16-bit segments. If two fingerprints differ in at most
three bits, then from some segment on every chain of 1, 2, 3 and 4 consecutive segments
differs in at most 0, 1, 2 and 3 bits (l * 3 / 4, rounded down). The first two links of the
chain are the join key: the segment itself and its successor with at most one bit flipped.
The third is tested on the joined rows, then the whole distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from orbitframe.llm.common import batch, discard, saved, scratch, texts

SEED = 42
MAX_BITS = 3
WORDS = 3
_FLUSH = 1 << 19
# byte -> its eight bits, each in a byte of its own (lowest bit first)
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1,
                        bitorder="little").copy().view("<u8").ravel()
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def _shingle_hashes(text: bytes, words: int, seed: int) -> Iterator[list[int]]:
    """Hashes of the word shingles, repeats included, in bounded pieces."""
    found = text.lower().split()  # of bytes: only A-Z, only ASCII white space
    line = b" ".join(found)
    if not found:
        return
    if len(found) <= words:
        yield [xxhash.xxh64_intdigest(line, seed)]
        return
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(found) - words + 1]
    ends = ends[words - 1:]
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(starts), _FLUSH):
        yield [digest(line[a:b], seed) for a, b in
               zip(starts[i:i + _FLUSH].tolist(), ends[i:i + _FLUSH].tolist())]


def _bit_counts(hashes: np.ndarray, sizes: list[int]) -> np.ndarray:
    """How often each bit is set, for consecutive runs of ``sizes`` hashes."""
    lengths = np.array(sizes)
    pieces = -(-lengths // 255)  # 255 ones fit in a byte
    first = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(lengths)), pieces)
    at = first[owner] + 255 * (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    octets = hashes.view(np.uint8).reshape(-1, 8)
    counts = np.empty((len(owner), 64), np.int64)
    for k in range(8):
        sums = np.add.reduceat(_SPREAD[octets[:, k]], at)
        counts[:, 8 * k:8 * k + 8] = sums[:, None].view(np.uint8)
    return np.add.reduceat(counts, np.cumsum(pieces) - pieces, axis=0)


def fingerprint_texts(values: list[bytes], words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """Unsigned fingerprints; a text without words has fingerprint zero."""
    counts = np.zeros((len(values), 64), np.int64)
    totals = np.zeros(len(values), np.int64)
    queue, owners, sizes, held = [], [], [], 0

    def flush():
        nonlocal held
        if queue:
            np.add.at(counts, owners, _bit_counts(
                np.concatenate(queue).astype("<u8", copy=False), sizes))
            queue.clear(), owners.clear(), sizes.clear()
            held = 0

    for i, value in enumerate(values):
        for piece in _shingle_hashes(value, words, seed):
            queue.append(np.array(piece, np.uint64))
            owners.append(i), sizes.append(len(piece))
            totals[i] += len(piece)
            held += len(piece)
            if held >= _FLUSH:
                flush()
    flush()
    bits = (2 * counts > totals[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").copy().view("<u8").ravel()


def simhash_fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long, one row per row of ``docs``.

    A null or empty text has fingerprint 0; a null doc_id is kept; other columns are ignored.
    """
    def run(batches):
        for rows in batches:
            prints = fingerprint_texts(list(texts(rows.column(1))), words, seed)
            yield batch(_SCHEMA, doc_id=rows.column(0), fp=prints.view(np.int64))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, fp long")


def _segment(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 16 * (i % 4)).bitwiseAND(F.lit(0xFFFF))


def linked_fingerprints(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs (a, b), a < b, of distinct values of column ``fp`` that differ in few bits.

    Every pair within ``max_bits`` (at most 3) is found; a pair may come up more than once.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError("the ring of four segments holds for at most three bits")
    fp = F.col("fp")
    masks = F.array(F.lit(0).cast("long"), *(F.lit(1 << j).cast("long") for j in range(16)))
    head = lambda i: F.shiftleft(_segment(fp, i), 16)
    built = prints.select(fp.alias("b"), F.explode(F.array(*(
        F.struct(F.lit(i).alias("i"), head(i).bitwiseOR(_segment(fp, i + 1)).alias("key"))
        for i in range(4)))).alias("k")).select("b", "k.i", "k.key")
    probes = prints.select(fp.alias("a"), F.explode(F.array(*(
        F.struct(F.lit(i).alias("i"), head(i).bitwiseOR(_segment(fp, i + 1)).alias("key"))
        for i in range(4)))).alias("k")).select(
            "a", "k.i", F.explode(F.transform(masks, lambda m: F.col("k.key").bitwiseXOR(m))).alias("key"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    after = lambda n: F.bit_count(F.element_at(
        F.array(*(_segment(differ, i + n) for i in range(4))), F.col("i") + 1))
    ring = after(1) + after(2) <= 2
    # both sides come many times larger from explode than Spark reckons, so neither may be broadcast
    return probes.join(built.hint("merge"), ["i", "key"]).where(
        (F.col("a") < F.col("b")) & ring & (F.bit_count(differ) <= max_bits)).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge: root is the smallest node that it reaches.

    Large-star and small-star rounds until the edges stay the same; each round is written to
    the shared folder. Minima are partial aggregates, so a hub with many edges is never one
    group in memory.
    """
    def state(e):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
                     .first())

    def least(links):
        """The smallest node among u and its neighbours v."""
        return links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))

    named = lambda e, a, b: e.select(F.col(a).alias("u"), F.col(b).alias("v"))
    proper = lambda e: e.where("a <> b").distinct()
    spark, folder = edges.sparkSession, scratch(edges.sparkSession)
    edges = saved(proper(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))), folder)
    before, now = None, state(edges)
    while now[0] and now != before:
        both = named(edges, "a", "b").unionByName(named(edges, "b", "a"))
        large = proper(both.join(least(both), "u").where("v > u").selectExpr("m a", "v b"))
        down = named(large, "b", "a")
        roots = least(down)
        last, folder = folder, scratch(spark)
        edges = saved(proper(down.join(roots, "u").selectExpr("m a", "v b").unionByName(
            roots.selectExpr("m a", "u b"))), folder)
        discard(spark, last)
        before, now = now, state(edges)
    return edges.selectExpr("b node", "a root").unionByName(
        edges.selectExpr("a node", "a root").distinct())


def near_duplicates(docs: DataFrame, words: int = WORDS, seed: int = SEED,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id) per row: the smallest doc_id reachable over links.

    Documents with the same fingerprint are one node, so copies never meet in pairs. Null ids
    take part but never name a component (null if it has no other). An empty table gives none.
    """
    prints = saved(simhash_fingerprints(docs, words, seed))
    nodes = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(linked_fingerprints(nodes, max_bits))
    grouped = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    names = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = grouped.join(names, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")
