"""Documents drawn so that they look like a target: hashed n-gram importance resampling.

A document's log importance is the sum over its n-grams of what their hash bucket gains: the log of
the bucket's share among the target's features over its share among the documents' own. The draw
takes the highest scores of log importance plus Gumbel noise, which is sampling without
replacement in proportion to importance.

The texts of a batch are joined with separator bytes that no word holds. One regex pass finds all
words, ``searchsorted`` in the offsets of the documents says whose each is, and n-grams whose
first and last word have different documents are masked before ``bincount``.

Null and empty texts have no words. Rows with equal ids are documents of their own. A document
without an id gets the noise of an empty id and comes last among equal scores. Empty tables give
an empty result (an empty target: every bucket has the smoothed share of none). Other columns are
left out, whatever their names. A text of any length is scored whole, in chunks of its words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from orbitframe.llm.common import batch, saved, texts

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: bytes.lower() maps A-Z only
SEPARATOR = b"\x00"
JOIN_BYTES = 1 << 20
CHUNK_WORDS = 1 << 17
BUCKETS = 10_000
MIN_WORDS = 20
SCALE = 1000
SEED = 2024
_COUNTS = pa.schema([("bucket", pa.int32()), ("count", pa.int64())])
_WEIGHTS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()),
                      ("weight", pa.int64())])


def joined(values: Iterator[bytes], limit: int = JOIN_BYTES) -> Iterator[tuple[bytes, np.ndarray]]:
    """Texts joined up to about ``limit`` bytes (a longer text alone), with where each begins."""
    parts, starts, at = [], [], 0
    for value in values:
        if parts and at + len(value) > limit:
            yield SEPARATOR.join(parts), np.array(starts, np.int64)
            parts, starts, at = [], [], 0
        parts.append(value.lower())
        starts.append(at)
        at += len(value) + 1
    if parts:
        yield SEPARATOR.join(parts), np.array(starts, np.int64)


def features(data: bytes, starts: np.ndarray, max_n: int, buckets: int
             ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document of each word, document of each feature, bucket of each feature), chunk by chunk."""
    found, carry = WORD.finditer(data), []
    while chunk := list(islice(found, CHUNK_WORDS)):
        spans = carry + chunk
        old = len(carry)
        words = [m.group() for m in spans]
        doc = np.searchsorted(starts, np.fromiter((m.start() for m in spans), np.int64, len(spans)),
                              "right") - 1
        owners, hashes = [doc[old:]], [np.fromiter(map(crc32, words), np.int64, len(words))]
        grams = hashes[0]
        hashes[0] = grams[old:]
        for n in range(2, max_n + 1):
            grams = np.fromiter((crc32(b" " + w, int(c)) for w, c in zip(words[n - 1:], grams)),
                                np.int64, max(len(words) - n + 1, 0))
            # n-grams that end in an earlier chunk were counted there
            fresh = slice(max(old - n + 1, 0), None)
            first, last = doc[:len(grams)][fresh], doc[n - 1:][fresh]
            whole = first == last
            owners.append(last[whole])
            hashes.append(grams[fresh][whole])
        yield doc[old:], np.concatenate(owners), np.concatenate(hashes) % buckets
        carry = spans[len(spans) - max_n + 1:] if max_n > 1 else []


def bucket_counts(table: DataFrame, max_n: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, count) of the features of all texts; every task adds up its own first."""
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for rows in batches:
            for data, starts in joined(texts(rows.column(0))):
                for _, _, hashed in features(data, starts, max_n, buckets):
                    total += np.bincount(hashed, minlength=buckets)
        used = np.flatnonzero(total)
        yield batch(_COUNTS, bucket=used, count=total[used])

    return table.select(F.col("text").cast("string")).mapInArrow(
        run, "bucket int, count long").groupBy("bucket").agg(F.sum("count").alias("count"))


def bucket_gains(docs: DataFrame, target: DataFrame, max_n: int = 1, buckets: int = BUCKETS
                 ) -> np.ndarray:
    """The gain of every bucket; ``buckets`` numbers, whatever the size of the tables."""
    share = lambda table, name: bucket_counts(table, max_n, buckets).withColumnRenamed("count", name)
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    counts = every.join(share(docs, "s"), "bucket", "left").join(
        share(target, "t"), "bucket", "left").na.fill(0, ["s", "t"]).toPandas()
    total = {name: float(counts[name].sum()) for name in ("s", "t")}
    counts = counts.sort_values("bucket")
    ratio = (counts["t"].to_numpy(float) + 1) * (total["s"] + buckets) / (
        (counts["s"].to_numpy(float) + 1) * (total["t"] + buckets))
    return np.floor(SCALE * np.log(ratio)).astype(np.int64)


def weights(docs: DataFrame, gains: np.ndarray, max_n: int = 1) -> DataFrame:
    """(doc_id, n_words, n_features, weight), one row for each row of ``docs``."""
    buckets = len(gains)

    def run(batches):
        for rows in batches:
            done = 0
            for data, starts in joined(texts(rows.column(1))):
                n = len(starts)
                out = np.zeros((3, n), np.int64)
                for word_doc, doc, hashed in features(data, starts, max_n, buckets):
                    out[0] += np.bincount(word_doc, minlength=n)
                    out[1] += np.bincount(doc, minlength=n)
                    np.add.at(out[2], doc, gains[hashed])
                yield batch(_WEIGHTS, doc_id=rows.column(0).slice(done, n), n_words=out[0],
                            n_features=out[1], weight=out[2])
                done += n

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(seed: int, scale: int = SCALE) -> Column:
    """Gumbel noise, in steps of 1/scale, from the hash of seed and doc_id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-scale * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, order: list[Column]) -> tuple[DataFrame, int]:
    """``rows`` with their place (from 1) in ``order``, and their number.

    Range partitions are numbered inside; what precedes a partition is a sum over one number a
    partition. No task sees more than its range.
    """
    placed = saved(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
        "_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    # one row a partition
    return placed.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(
        "rank", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop(
            "_at", "_part", "_before"), placed.count()


def resample(docs: DataFrame, target: DataFrame, max_n: int = 1, buckets: int = BUCKETS,
             percent: int = 10, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every document; rank is null if undrawn.

    Of the documents with ``min_words`` words, ``percent`` in a hundred (rounded down) are drawn.
    """
    scored = saved(weights(docs, bucket_gains(docs, target, max_n, buckets), max_n).withColumn(
        "score", F.col("weight") + gumbel(seed)))
    enough = F.col("n_words") >= min_words
    places, n = ranked(scored.where(enough), [F.desc("score"), F.asc_nulls_last("doc_id")])
    drawn = F.when(F.col("rank") <= percent * n // 100, F.col("rank"))
    return places.withColumn("rank", drawn).unionByName(
        scored.where(~enough).withColumn("rank", F.lit(None).cast("long")))
