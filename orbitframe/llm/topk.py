"""Exact top-k inner products by term-at-a-time accumulation over a grid of blocks.

Queries are dealt into blocks by a hash of their row, candidates also by their place, so that
equal rows and rows of one id spread; every (query block,
candidate block) is one cell, so no task holds more than one block of each. In a cell each
dimension has a posting list (the candidates where it is not zero and their weights); a query
scatters its weighted lists into a dense score array, and a partition selection keeps its best k.
The k best of all cells are merged per query.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from orbitframe.llm.common import batch, saved

SCALE = 256
BLOCK = 16_384
_ROWS = pa.schema([("vec_id", pa.int64()), ("weights", pa.binary())])
_HITS = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()),
                   ("score", pa.int64())])


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, weights): floor(scale * x) of each component, as packed 64-bit integers.

    Rows whose id or vector is null, or that hold a null or non-finite component, are left out;
    an empty vector stays and scores 0 everywhere. Other columns are ignored.
    """
    def run(batches):
        for rows in batches:
            ids, packed = [], []
            for vec_id, vector in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                if vec_id is None or vector is None or None in vector:
                    continue
                x = np.array(vector, np.float64)
                if np.isfinite(x).all():
                    ids.append(vec_id)
                    packed.append(np.floor(scale * x).astype("<i8").tobytes())
            yield batch(_ROWS, vec_id=ids, weights=packed)

    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")
                          ).mapInArrow(run, "vec_id long, weights binary")


def _matrix(weights: list[bytes], dims: int) -> np.ndarray:
    out = np.zeros((len(weights), dims), np.int64)
    for row, packed in zip(out, weights):
        row[:len(packed) // 8] = np.frombuffer(packed, "<i8")
    return out


def _best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id; ``ids`` are sorted."""
    first, last = np.searchsorted(ids, own), np.searchsorted(ids, own, side="right")
    at = np.arange(len(ids))
    if first < last:
        at = np.concatenate([at[:first], at[last:]])
    if len(at) > k:
        found = scores[at]
        bar = np.partition(found, len(found) - k)[len(found) - k]
        at = np.concatenate([at[found > bar], at[found == bar]])[:k]
    return at[np.lexsort((ids[at], -scores[at]))]


def _cell(k: int):
    def run(_, queries: pa.Table, candidates: pa.Table) -> pa.Table:
        if not queries.num_rows or not candidates.num_rows:
            return _HITS.empty_table()
        ids = candidates["vec_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        packed, asked = candidates["weights"].to_pylist(), queries["weights"].to_pylist()
        dims = max(map(len, packed + asked)) // 8
        columns = np.ascontiguousarray(_matrix(packed, dims)[order].T)
        postings = [(at if len(at := np.flatnonzero(column)) < len(ids) else slice(None),
                     column[at] if len(at) < len(ids) else column) for column in columns]
        out = {f.name: [] for f in _HITS}
        for row, query_id, terms in zip(queries["query_row"].to_pylist(),
                                        queries["vec_id"].to_pylist(), _matrix(asked, dims)):
            scores = np.zeros(len(ids), np.int64)
            for term in np.flatnonzero(terms):
                at, weights = postings[term]
                scores[at] += terms[term] * weights
            best = _best(scores, ids, query_id, k)
            out["query_row"] += [row] * len(best)
            out["query_id"] += [query_id] * len(best)
            out["vec_id"] += ids[best].tolist()
            out["score"] += scores[best].tolist()
        return pa.table(out, schema=_HITS)

    return run


def exact_top_k(queries: DataFrame, candidates: DataFrame, k: int = 5,
                block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query.

    Both sides come from ``integer_vectors``. Rows with the query's own id are no candidates.
    Ties go to the smaller vec_id. Repeated candidate rows are candidates each; repeated query
    rows (same id and vector) are one query, same ids with other vectors are queries each.
    Missing trailing components count as zero. Fewer than k candidates: all of them.
    """
    spark = queries.sparkSession
    queries = saved(queries.distinct().withColumn("query_row", F.xxhash64("vec_id", "weights")))
    # saved with the place: a repeated task deals each row to the same cell
    candidates = saved(candidates.withColumn("place", F.monotonically_increasing_id()))
    columns = max(ceil(candidates.count() / block), spark.sparkContext.defaultParallelism)
    rows = ceil(queries.count() / block) or 1
    cell = lambda row, column: (row * columns + column).cast("long").alias("cell")
    by = lambda salt, n: F.pmod(F.xxhash64("vec_id", "weights", F.lit(salt)), F.lit(n))
    asked = queries.withColumn("row", by(1, rows)).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("column")).select(
            cell(F.col("row"), F.col("column")), "query_row", "vec_id", "weights")
    held = candidates.withColumn("column", F.pmod(F.xxhash64("vec_id", "place"), F.lit(columns))).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("row")).select(
            cell(F.col("row"), F.col("column")), "vec_id", "weights")
    hits = asked.groupBy("cell").cogroup(held.groupBy("cell")).applyInArrow(
        _cell(k), "query_row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
