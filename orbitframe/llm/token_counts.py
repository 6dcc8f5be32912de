"""Token counts of documents in flat token files that have no index.

A flat file is one token id after another, with an end id after each document. It is cut into
blocks of whole ids; each block finds its end ids by one vectorised comparison. A running sum of
the ends and a running maximum of the last end, over the blocks of a file, give every block the
number of its first document and where that began, however many blocks it spans.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from orbitframe.llm.common import batch, saved
from orbitframe.llm.tokens import ChunkEncoder

END_ID = 49_407
WIDTH = 2
BLOCK_BYTES = 8 << 20
BLOCKS_PER_TASK = 8
_ROWS = pa.schema([("kind", pa.string()), ("nth", pa.int64()), ("value", pa.binary())])
_ENDS = pa.schema([("file", pa.string()), ("block", pa.int64()), ("ends", pa.list_(pa.int64())),
                   ("stop", pa.int64())])


def _end_mark(end_id: int, width: int) -> str:
    return end_id.to_bytes(width, "little").decode("latin-1")


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID,
                      width: int = WIDTH) -> None:
    """Write ``folder/kind=tokens`` (flat ids) and ``folder/kind=order`` (ids of the documents).

    A task's two files share their name. The files come from Spark's text writer, whose line end
    is the end id, so they are written wherever Spark can write. Strings of special tokens in a
    text are ordinary text: the end id stands only at ends. A null or empty text has no ids.
    """
    def run(batches):
        encoder, nth = ChunkEncoder(tokenizer_path, plain_specials=True), 0
        for rows in batches:
            ids = encoder.encode([v or "" for v in rows.column(1).to_pylist()])
            numbers = range(nth, nth := nth + rows.num_rows)
            yield batch(_ROWS, kind=["tokens"] * rows.num_rows, nth=numbers,
                        value=[x.astype(f"<u{width}").tobytes() for x in ids])
            yield batch(_ROWS, kind=["order"] * rows.num_rows, nth=numbers, value=[
                f"{n}:{'' if doc is None else doc}".encode()
                for n, doc in zip(numbers, rows.column(0).to_pylist())])

    docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "kind string, nth long, value binary").sortWithinPartitions("kind", "nth").select(
            "kind", F.col("value").cast("string").alias("value")).write.partitionBy("kind").option(
                "encoding", "ISO-8859-1").option("lineSep", _end_mark(end_id, width)).text(folder)


def file_blocks(spark: SparkSession, folder: str, width: int, block_bytes: int) -> DataFrame:
    """(file, block, start, stop): byte ranges of whole ids; a partial last id is left out."""
    files = spark.read.format("binaryFile").load(folder).select("path", "length")
    whole = F.floor(F.col("length") / width) * width
    step = block_bytes // width * width
    blocks = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(whole / step) - 1, F.lit(0))))
    return files.select("path", whole.alias("whole"), blocks.alias("block")).select(
        F.col("path").alias("file"), "block", (F.col("block") * step).alias("start"),
        F.least("whole", (F.col("block") + 1) * step).alias("stop")).where("stop > start")


def scan_ends(blocks: DataFrame, end_id: int, width: int) -> DataFrame:
    """(file, block, ends, stop): positions of end ids, counted in ids from the file's start.

    The number of tasks follows the number of blocks: the ranges themselves are a few bytes each,
    so a partition sized by them would hold any amount of tokens.
    """
    def run(batches):
        for rows in batches:
            for file, block, start, stop in zip(*(c.to_pylist() for c in rows.columns)):
                store, path = fs.FileSystem.from_uri(file)
                with store.open_input_file(path) as f:
                    ids = np.frombuffer(f.read_at(stop - start, start), f"<u{width}")
                ends = np.flatnonzero(ids == end_id) + start // width
                yield batch(_ENDS, file=[file], block=[block], ends=[ends], stop=[stop // width])

    n = blocks.count()
    tasks = max(ceil(n / BLOCKS_PER_TASK), min(n, blocks.sparkSession.sparkContext.defaultParallelism), 1)
    return blocks.repartition(tasks, "file", "block").mapInArrow(
        run, "file string, block long, ends array<long>, stop long")


def scan_token_files(spark: SparkSession, folder: str, end_id: int = END_ID, width: int = WIDTH,
                     block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, nth, start, n_tokens, ended): the documents of flat token files, in file order.

    Two end ids in a row are an empty document. Ids after the last end are a document with
    ``ended`` false. Files without ids have no rows. The scans over a file's blocks see two
    numbers a block; the positions themselves stay where they are.
    """
    found = saved(scan_ends(file_blocks(spark, folder, width, block_bytes), end_id, width))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1)
    last = F.element_at("ends", -1)
    stitched = found.select("file", "block", F.size("ends").alias("n_ends"),
                            F.when(F.size("ends") > 0, last).alias("last")).select(
        "file", "block", F.lead("block").over(Window.partitionBy("file").orderBy("block"))
        .isNull().alias("final"),
        F.coalesce(F.sum("n_ends").over(before), F.lit(0)).alias("first"),
        (F.coalesce(F.max("last").over(before), F.lit(-1)) + 1).alias("open")).join(
            found, ["file", "block"])
    whole = F.when(F.col("final") & (F.coalesce(F.try_element_at("ends", F.lit(-1)),
                                                F.col("open") - 1) + 1 < F.col("stop")),
                   F.concat("ends", F.array("stop"))).otherwise(F.col("ends"))
    docs = stitched.select("*", F.posexplode(whole).alias("i", "end"))
    start = F.when(F.col("i") == 0, F.col("open")).otherwise(F.element_at("ends", F.col("i")) + 1)
    return docs.select(
        "file", (F.col("first") + F.col("i")).alias("nth"), start.alias("start"),
        (F.col("end") - start).alias("n_tokens"),
        (F.col("i") < F.size("ends")).alias("ended"))


def written_order(spark: SparkSession, folder: str, end_id: int = END_ID,
                  width: int = WIDTH) -> DataFrame:
    """(name, nth, doc_id): which document stands where in ``write_token_files``' files."""
    lines = spark.read.option("encoding", "ISO-8859-1").option(
        "lineSep", _end_mark(end_id, width)).text(f"{folder}/kind=order")
    part = lambda i: F.split_part("value", F.lit(":"), F.lit(i))
    return lines.select(
        F.col("_metadata.file_name").alias("name"), part(1).cast("long").alias("nth"),
        F.nullif(part(2), F.lit("")).cast("long").alias("doc_id"))


def token_counts(docs: DataFrame, folder: str, tokenizer_path: str,
                 block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_tokens) per row of ``docs``: written flat to ``folder``, then scanned."""
    write_token_files(docs, folder, tokenizer_path)
    if docs.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").load(
            folder).where("path like '%kind=%'").isEmpty():
        return docs.sparkSession.createDataFrame([], "doc_id long, n_tokens long")
    found = scan_token_files(docs.sparkSession, f"{folder}/kind=tokens", block_bytes=block_bytes)
    name = F.element_at(F.split("file", "/"), -1)
    # a block's positions become many rows, so the planner's size of this side is too small to broadcast by
    return found.withColumn("name", name).hint("merge").join(
        written_order(docs.sparkSession, folder), ["name", "nth"]).select("doc_id", "n_tokens")
