"""Line deduplication over levelled sorted runs of line hashes.

``LineLedger`` holds the first owner of every line key in runs: tables bucketed and sorted by the
key's hash. A new batch of documents is reduced to its own keys, merge-anti-joined with all runs,
and what is left becomes a new run of level 0. When a level has ``fanout`` runs they are merged into
one run of the next level, so a key is rewritten a logarithmic number of times.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased. Only keys of at
least ``min_chars`` code points count. A key is two 64-bit hashes of different seeds.

Defined results: a null or empty text is one empty line; a null ``doc_id`` counts as the largest id;
rows that share a ``doc_id`` are one document (each keeps its own text, none loses a line to the
other); an empty table gives an empty result; other columns pass through whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_path
from .common import WHITE, ascii_lower, hash128, known_id, shuffles_removed, written

MIN_CHARS = 10
BATCHES = 4
FANOUT = 3


class LineLedger:
    """Owners of line keys seen so far; the folder may lie anywhere that all executors see."""

    def __init__(self, spark: SparkSession, folder: str | None = None, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.folder = folder or work_path(spark, "line-runs")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]

    def _write(self, rows: DataFrame, level: int) -> str:
        name = f"line_run_{level}_{uuid.uuid4().hex[:12]}"
        with shuffles_removed(self.spark):
            (rows.select("h1", "h2", "owner").repartition(self.buckets, "h1", "h2").write
             .bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", f"{self.folder}/{name}").saveAsTable(name))
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        return name

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def _compact(self) -> None:
        for level in range(len(self.levels)):
            names = self.levels[level]
            if len(names) >= self.fanout:
                merged = self.spark.table(names[0])
                for name in names[1:]:
                    merged = merged.unionByName(self.spark.table(name))
                self._write(merged, level + 1)
                self.levels[level] = []

    def add(self, lines: DataFrame) -> DataFrame:
        """Takes a batch of (h1, h2, did) and returns the (h1, h2, owner) that no run had before.

        Batches must come in the order of their ids for the smallest id to own a key.
        """
        fresh = lines.groupBy("h1", "h2").agg(F.min("did").alias("owner"))
        for name in self.runs():
            fresh = fresh.join(self.spark.table(name), ["h1", "h2"], "left_anti")
        added = self.spark.table(self._write(fresh, 0))
        self._compact()
        return added

    def forget_names(self) -> None:
        """Drops the session's names of the runs; their files stay."""
        for name in self.spark.catalog.listTables(pattern="line_run_*"):
            if name.name in self.runs():
                self.spark.sql(f"DROP TABLE {name.name}")


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(did, text_hash, pos, h1, h2) of every line that can be a duplicate."""
    lines = docs.select(
        known_id().alias("did"), F.xxhash64("text").alias("text_hash"),
        F.posexplode(F.split(F.col("text"), "\n", -1)).alias("pos", "line"))
    keys = lines.select("did", "text_hash", "pos", ascii_lower(F.btrim("line", F.lit(WHITE))).alias("key"))
    return keys.filter(F.length("key") >= min_chars).select("did", "text_hash", "pos", *hash128(F.col("key")))


def dropped_lines(docs: DataFrame, batches: int = BATCHES, min_chars: int = MIN_CHARS) -> DataFrame:
    """(did, text_hash, gone): the places of the lines that a smaller id, or an earlier batch, holds."""
    spark = docs.sparkSession
    shares = [i / batches for i in range(1, batches)]
    cuts = docs.agg(F.percentile_approx(known_id(), shares, F.lit(10_000)).alias("c")).first()["c"] if shares else []
    number = F.lit(0)
    for cut in sorted(set(cuts or [])):
        number = number + (F.col("did") > cut).cast("int")
    lines = written(line_hashes(docs, min_chars).withColumn("batch", number), "lines", ("batch",))
    ledger, gone = LineLedger(spark), None
    for batch in range(len(set(cuts or [])) + 1):
        part = lines.filter(F.col("batch") == batch)
        owners = ledger.add(part.select("h1", "h2", "did")).withColumnRenamed("owner", "did")
        # The id is part of the join key, so that the rows of a very frequent line lie in many tasks.
        lost = part.join(owners, ["h1", "h2", "did"], "left_anti").select("did", "text_hash", "pos")
        gone = lost if gone is None else gone.unionByName(lost)
    return gone.groupBy("did", "text_hash").agg(F.collect_set("pos").alias("gone"))


def dedup_lines(docs: DataFrame, batches: int = BATCHES, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with ``text`` cut to the lines that stay, and ``__n_lines``, ``__n_dropped``."""
    gone = dropped_lines(docs.select("doc_id", "text"), batches, min_chars).select(
        F.col("did").alias("__did"), F.col("text_hash").alias("__hash"), F.col("gone").alias("__gone"))
    rows = docs.select(
        *[F.col(c) for c in docs.columns if c != "text"], known_id().alias("__did"), F.xxhash64("text").alias("__hash"),
        F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("__lines"))
    joined = rows.join(gone, ["__did", "__hash"], "left").withColumn(
        "__stay", F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.coalesce("__gone", F.array().cast("array<int>"))))
    kept = F.array_join(F.transform("__stay", lambda i: F.get(F.col("__lines"), i)), "\n")
    text = F.when(F.col("__gone").isNull(), F.array_join("__lines", "\n")).otherwise(kept)
    return joined.select(
        *[text.alias(c) if c == "text" else F.col(c) for c in docs.columns],
        F.size("__lines").cast("long").alias("__n_lines"),
        (F.size("__lines") - F.size("__stay")).cast("long").alias("__n_dropped"))


def op1_line_dedup(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs.select("doc_id", "text")).select(
        "doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"),
        F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
owners AS (
  SELECT key, MIN(doc_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING COUNT(DISTINCT doc_id) > 1),
marked AS (
  SELECT k.*, o.owner IS NOT NULL AND o.owner <> k.doc_id AS gone FROM keyed k LEFT JOIN owners o ON k.key = o.key)
SELECT doc_id, COUNT(*) AS n_lines, CAST(SUM(CAST(gone AS INT)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
