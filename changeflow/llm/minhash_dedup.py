"""MinHash near-duplicates by an inverted join of signature coordinates.

A signature has ``SIGNATURE`` coordinates. Two documents at the similarity bound agree in fewer than
``MATCHES`` of them once in a million times, so links need ``MATCHES`` collisions, and full sets decide.
Every coordinate and its value is a posting list. Values held by one document alone are skipped; of the
others a document posts all but its ``MATCHES - 1`` most frequent ones, in one order for all documents:
two documents with ``MATCHES`` collisions then still meet in a list (prefix filter), and the longest
lists, those of passages that many documents share, are left to documents that consist of them.

Defined results: a document without text or words has an empty set, stands alone and is kept; a null
``doc_id`` counts as the largest id, and its ``component_id`` is null if nothing smaller is reachable;
rows that repeat an id are judged by their own texts; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LAST_ID, known_id, written
from .similar import MinHash, bits_of, digest, link, lists, shingles, small_batches

SIGNATURE = 32
MATCHES = 11


def signatures(docs: DataFrame) -> DataFrame:
    """(did, n, node, coordinates) of every row; node and coordinates are null without words."""
    hashed = MinHash(SIGNATURE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            sets = [shingles((t.as_py() or "").encode()) for t in batch.column(1)]
            full = [i for i, s in enumerate(sets) if len(s)]
            rows = dict(zip(full, hashed([sets[i] for i in full]) if full else [], strict=True))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([digest(s) if len(s) else None for s in sets], pa.binary()),
                pa.array([rows.get(i) for i in range(len(sets))], pa.list_(pa.int64()))],
                names=["did", "n", "node", "coordinates"])

    return docs.select(known_id().alias("did"), "text").mapInArrow(
        run, "did long, n long, node binary, coordinates array<bigint>")


def full_sets(docs: DataFrame) -> DataFrame:
    """(node, shingles, bits) of every row of (did, text) with words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            sets = [s for t in batch.column("text") if len(s := shingles((t.as_py() or "").encode()))]
            if sets:
                yield pa.RecordBatch.from_arrays([
                    pa.array([digest(s) for s in sets], pa.binary()), lists(sets), lists([bits_of(s) for s in sets])], names=["node", "shingles", "bits"])

    return docs.select("text").mapInArrow(run, "node binary, shingles array<bigint>, bits array<bigint>")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(did, n, node, component_id) of every row."""
    rows = written(signatures(docs), "signatures")
    nodes = written(rows.filter("node IS NOT NULL").groupBy("node").agg(
        F.min("did").alias("did"), F.first("n").alias("n"), F.first("coordinates").alias("coordinates")), "nodes")
    values = nodes.select("node", "n", F.explode("coordinates").alias("key"))
    shared = values.groupBy("key").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    # Both shares of the prefix rule: values of one node alone come first in the order and need no list.
    own = values.join(shared, "key").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("held"))
    prefix = F.slice("held", F.lit(1), F.size("held") - (MATCHES - 1))
    posts = written(own.filter(F.size("held") >= MATCHES).select(
        "node", "n", F.aggregate("held", F.lit(0).cast("long"), lambda s, h: s + h["df"]).alias("weight"),
        F.explode(prefix).alias("p")).select(F.col("p.key").alias("key"), "node", "n", "weight"), "posts")
    wanted = written(posts.select("node").distinct().join(nodes.select("node", "did"), "node").select("did").distinct(), "wanted")
    texts = docs.select(known_id().alias("did"), "text").join(wanted, "did", "left_semi")
    sets = written(full_sets(texts).dropDuplicates(["node"]), "sets")

    def promising(pairs: DataFrame) -> DataFrame:
        held = nodes.select("node", "coordinates")
        return pairs.join(held.select(F.col("node").alias("a"), F.col("coordinates").alias("ca")), "a").join(
            held.select(F.col("node").alias("b"), F.col("coordinates").alias("cb")), "b").filter(
            F.size(F.array_intersect("ca", "cb")) >= MATCHES).select("a", "b")

    groups = link(posts, sets, promising).select(F.col("id").alias("node"), F.col("component_id").alias("part"))
    # The smallest id of a group, over its nodes and then over their copies.
    smallest = nodes.join(groups, "node", "left").select("node", "did", F.coalesce("part", "node").alias("part"))
    least = smallest.groupBy("part").agg(F.min("did").alias("component_id"))
    owner = written(smallest.join(least, "part").select("node", "component_id"), "owners")
    return rows.select("did", "n", "node").join(owner, "node", "left").select(
        "did", "n", "node", F.coalesce("component_id", "did").alias("component_id"))


def op5_minhash_dedup(docs: DataFrame) -> DataFrame:
    real = lambda c: F.when(F.col(c) < LAST_ID, F.col(c))
    return near_duplicates(docs.select("doc_id", "text")).select(
        real("did").alias("doc_id"), F.col("n").alias("n_shingles"), real("component_id").alias("component_id"),
        (F.col("did") == F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its group."""
    kept = near_duplicates(docs.select("doc_id", "text")).filter("did = component_id").select(F.col("did").alias("__did")).distinct()
    return docs.withColumn("__did", known_id()).join(kept, "__did", "left_semi").select(*docs.columns)


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [list_aggregate(w, 'string_agg', ' ')]
    ELSE [concat_ws(' ', w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]) for i in range(1, len(w) - 3)] END) AS s FROM words),
sizes AS (SELECT doc_id, COUNT(*) AS n FROM shingles GROUP BY doc_id),
meets AS (
  SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT m.a, m.b FROM meets m JOIN sizes x ON m.a = x.doc_id JOIN sizes y ON m.b = y.doc_id WHERE 100 * m.n >= 75 * (x.n + y.n - m.n)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, least(d.doc_id, coalesce(r.low, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(r.low, d.doc_id)) AS kept
FROM documents d LEFT JOIN sizes s ON d.doc_id = s.doc_id
LEFT JOIN (SELECT a, MIN(b) AS low FROM reach GROUP BY a) r ON d.doc_id = r.a
"""
