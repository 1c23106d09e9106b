"""Token counts of documents in flat token files, found by their separators.

The files hold ids of fixed width and nothing else; a separator id ends every document. They are cut into
blocks, each block is searched with one vector comparison, and a prefix scan over the blocks of a file
carries the place of the last separator and the number of documents into the next block, so that a
document may span any number of blocks.

Defined results: an empty document counts no token; ids after the last separator of a file are a document
with ``closed`` false; a null text is an empty document; an empty file has no document; other columns are
ignored. A task holds one block, and one file while it is cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import work_path
from .common import written
from .subword import packed_ids, public_model

WIDTH = 2
SEPARATOR = 2  # the closing mark of the default vocabulary; encoding a text never yields it
BLOCK = 4 * 2**20
FILE_ROWS = 100_000


def write_token_files(docs: DataFrame, separator: int = SEPARATOR, model: str | None = None) -> str:
    """Writes the ids of every document, each followed by the separator, into flat files of 16-bit ids.

    Documents are bytes to Spark's text writer and the separator is its line end; the separator's two bytes
    must be ASCII. No shuffle: a task writes the documents that it reads, in their order.
    """
    path = work_path(docs.sparkSession, "tokens")
    end = separator.to_bytes(WIDTH, "little").decode("ascii")
    ids = packed_ids(docs, model or public_model()).select(F.col("ids").cast("string"))
    ids.write.option("lineSep", end).option("maxRecordsPerFile", FILE_ROWS).text(path)
    return path


def blocks_of(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """(file, block, data) of every block of every file below ``path``."""
    files = spark.read.format("binaryFile").load(path).filter("length > 0")
    number = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / block)))
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content", number.alias("block")).select(
        "file", "block", F.substring("content", (F.col("block") * block + 1).cast("int"), F.lit(block)).alias("data"))


def separators(blocks: DataFrame, separator: int = SEPARATOR, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """(file, block, ids, ends): the number of ids of a block and the places of its separators in the file."""
    per_block = block // width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                number = batch.column(1)[i].as_py()
                ids = np.frombuffer(batch.column(2)[i].as_buffer(), f"<u{width}")
                ends = np.flatnonzero(ids == separator) + number * per_block
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([len(ids)], pa.int64()),
                    pa.array([ends], pa.list_(pa.int64()))], names=["file", "block", "ids", "ends"])

    return blocks.mapInArrow(run, "file string, block long, ids long, ends array<bigint>")


def count_tokens(spark: SparkSession, path: str, separator: int = SEPARATOR, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """(file, document, start, n_tokens, closed) of every document, numbered from 0 within its file."""
    if block % width:
        raise ValueError("a block must hold whole ids")
    found = written(separators(blocks_of(spark, path, block), separator, width, block), "separators")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = found.select(
        "file", "block", "ids", "ends",
        F.coalesce(F.max(F.try_element_at("ends", F.lit(-1))).over(before) + 1, F.lit(0)).alias("open"),
        F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).alias("seen"))
    starts = F.concat(F.array("open"), F.transform("ends", lambda e: e + 1))
    closed = carried.select("file", "seen", F.posexplode(F.arrays_zip(
        F.slice(starts, F.lit(1), F.size("ends")).alias("start"), F.col("ends").alias("end"))).alias("i", "d")).select(
        "file", (F.col("seen") + F.col("i")).alias("document"), "d.start", (F.col("d.end") - F.col("d.start")).alias("n_tokens"),
        F.lit(True).alias("closed"))
    tails = found.groupBy("file").agg(
        F.sum("ids").alias("ids"), F.sum(F.size("ends")).cast("long").alias("document"),
        F.coalesce(F.max(F.try_element_at("ends", F.lit(-1))) + 1, F.lit(0)).alias("start")).filter("ids > start")
    return closed.unionByName(tails.select(
        "file", "document", "start", (F.col("ids") - F.col("start")).alias("n_tokens"), F.lit(False).alias("closed")))


def op9_token_counts(docs: DataFrame) -> DataFrame:
    return count_tokens(docs.sparkSession, write_token_files(docs))
