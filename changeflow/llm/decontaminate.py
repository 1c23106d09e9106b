"""Benchmark decontamination by a prefix-filtered set join of word shingles.

A benchmark item is cut into windows of ``WINDOW`` consecutive words (a shorter item is one window), and a
window is found in a document where all its words stand in a row. A window's set is its shingles of
``SHINGLE`` words (a shorter window is one shingle), ordered by rarity, which is counted over all documents.
Full containment needs every one of them, so the necessary prefix is the rarest shingle alone: each window
posts that one and meets the documents that hold it. The place of the shingle in the window fixes where the
window would begin in the document; it must lie, in its whole length, within one stretch of benchmark
shingles. What is left is verified word by word over a stretch of the window's own size.

Documents are read once. A bitmap of at most ``MAX_BITS`` bits tells which of their shingles may belong to the
benchmark; only maximal stretches of such words leave the scan, so clean text is never shuffled. The bitmap may
let others pass, never the reverse.

Defined results: words are runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased. A
null or empty text has no words. Rows that repeat a ``doc_id`` are judged by their own texts; rows that repeat
an ``item_id`` are one item with the windows of all of them. An item without an id marks words but is neither
counted nor listed. Without items, or items without words, no word is hit. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.skew import bounded, skew_join
from .common import table, written
from .similar import ODD, Remembered, small_batches

WINDOW = 10
SHINGLE = 5
MAX_BITS = 1 << 27
LEAST_BITS = 1 << 16

# Upper case to lower, and every ASCII character that is no letter or digit to a space.
_FOLD = bytes(c if c >= 0x80 else ord(chr(c).lower()) if chr(c).isalnum() else 0x20 for c in range(256))
_hashes = Remembered(xxhash.xxh3_64_intdigest)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def shingles_along(h: np.ndarray, size: int) -> np.ndarray:
    """One hash for every ``size`` words in a row; other sizes give other hashes for the same words."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = (out ^ h[k:n + k]) * ODD[k % len(ODD)]
        out ^= out >> np.uint64(31)
    return out


def windows(items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(item_id, words, size, shingles) of every window of every item; the words are joined by spaces."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            out = [[], [], [], []]
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                size = min(window, len(words))
                sets = shingles_along(hashes_of(words), min(shingle, size)) if size else ()
                per = size - min(shingle, size) + 1
                for i in range(len(words) - size + 1 if size else 0):
                    for column, value in zip(out, (item, b" ".join(words[i:i + size]).decode(), size, sets[i:i + per].view(np.int64)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([
                pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int32()),
                pa.array(out[3], pa.list_(pa.int64()))], names=["item_id", "words", "size", "shingles"])

    return items.select(F.col("item_id").cast("string"), "text").mapInArrow(
        run, "item_id string, words string, size int, shingles array<bigint>")


def bitmap(hashes: DataFrame, column: str, max_bits: int = MAX_BITS) -> bytes:
    """Bits for the upper bits of the hashes, about 64 bits a hash and ``max_bits`` at most."""
    n = hashes.agg(F.approx_count_distinct(column)).first()[0]
    bits = min(max_bits, max(LEAST_BITS, 1 << (64 * n).bit_length()))
    slots = hashes.select(F.shiftrightunsigned(column, 64 - bits.bit_length() + 1).alias("slot"))
    cells = slots.selectExpr("shiftright(slot, 3) AS cell", "shiftleft(1, CAST(slot % 8 AS INT)) AS bit").groupBy("cell").agg(
        F.bit_or("bit").cast("int").alias("bits")).toArrow()  # one row for every 8 bits at most
    out = np.zeros(bits // 8, np.uint8)
    out[cells.column("cell").to_numpy()] = cells.column("bits").to_numpy()
    return out.tobytes()


def stretches(docs: DataFrame, held: bytes, sizes: list[int]) -> DataFrame:
    """(row, doc_id, n_words, found) of every document; found is its maximal stretches of words in shingles whose bits are set.

    A stretch has the place of its first word, its words, and the place (in the document), size and hash of its shingles.
    """
    shared = docs.sparkSession.sparkContext.broadcast(held)
    found = pa.list_(pa.struct([
        ("start", pa.int64()), ("words", pa.list_(pa.string())),
        ("shingles", pa.list_(pa.struct([("at", pa.int64()), ("hash", pa.int64())])))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)
        shift = np.uint64(64 - (8 * len(bits)).bit_length() + 1)
        for batch in small_batches(batches):
            counts, rows = [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                counts.append(len(words))
                rows.append(stretches_of(words, bits, shift))
            yield pa.RecordBatch.from_arrays([
                batch.column("row"), batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(rows, found)],
                names=["row", "doc_id", "n_words", "found"])

    def stretches_of(words: list[bytes], bits: np.ndarray, shift: np.uint64) -> list[dict]:
        h, hits = hashes_of(words), []
        border = np.zeros(len(words) + 1, np.int64)
        for size in sizes:
            along = shingles_along(h, size)
            slot = along >> shift
            at = np.flatnonzero((bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1)
            if len(at):
                np.add.at(border, at, 1)
                np.add.at(border, at + size, -1)
                hits.append((at, along[at].view(np.int64)))
        if not hits:
            return []
        inside = np.diff(np.concatenate(([False], np.cumsum(border[:-1]) > 0, [False])).astype(np.int8))
        at, hashes = (np.concatenate(c) for c in zip(*hits, strict=True))
        order = np.argsort(at, kind="stable")
        at, hashes = at[order], hashes[order]
        out = []
        for start, stop in zip(np.flatnonzero(inside == 1), np.flatnonzero(inside == -1), strict=True):
            low, high = np.searchsorted(at, (start, stop))
            out.append({"start": start, "words": [w.decode() for w in words[start:stop]],
                        "shingles": [{"at": a, "hash": s} for a, s in zip(at[low:high], hashes[low:high], strict=True)]})
        return out

    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(
        run, f"row long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, "
             "found array<struct<start: bigint, words: array<string>, shingles: array<struct<at: bigint, hash: bigint>>>>")


def occurrences(read: DataFrame, units: DataFrame) -> DataFrame:
    """(row, start, stop, window) of every occurrence of a window in the stretches of ``read``.

    ``units`` is (window, words, size, shingles), one row for each different window.
    """
    found = read.select("row", F.explode("found").alias("s"))
    posts = found.select("row", F.col("s.start").alias("stretch"), (F.col("s.start") + F.size("s.words")).alias("stop"), F.explode("s.shingles").alias("p")).select(
        "row", "stretch", "stop", F.col("p.at").alias("at"), F.col("p.hash").alias("hash"))
    # Rarity: in how many documents a shingle is found; stretches of one document count once.
    df = posts.select("hash", "row").groupBy("hash").agg(F.count(F.lit(1)).alias("df"))
    tokens = units.select("window", F.posexplode("shingles").alias("place", "hash"))
    # A window with a shingle that no document holds is nowhere; the others post their rarest one.
    ranked = tokens.join(df, "hash", "left").groupBy("window").agg(
        F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "hash", "place")).alias("rarest")).filter("rarest.df > 0")
    prefix = ranked.select("window", "rarest.hash", "rarest.place").join(units.select("window", "words", "size"), "window")
    few = bounded(prefix)
    start = F.col("at") - F.col("place")
    met = posts.join(F.broadcast(few), "hash") if few is not None else skew_join(posts, prefix, ["hash"])
    placed = met.withColumn("start", start).filter((F.col("start") >= F.col("stretch")) & (F.col("start") + F.col("size") <= F.col("stop")))
    texts = found.select("row", F.col("s.start").alias("stretch"), F.col("s.words").alias("held"))
    same = F.array_join(F.slice("held", (F.col("start") - F.col("stretch") + 1).cast("int"), F.col("size")), " ") == F.col("words")
    return placed.select("row", "stretch", "start", "size", "window", "words").join(texts, ["row", "stretch"]).filter(same).select(
        "row", "start", (F.col("start") + F.col("size")).alias("stop"), "window")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(row, doc_id, n_words, n_hit, item_ids) of every document; item_ids are sorted as text, null where there are none.

    ``docs`` has doc_id and text, ``items`` item_id and text.
    """
    cut = written(windows(items.select("item_id", "text"), window, shingle), "windows")
    units = written(cut.groupBy("words", "size").agg(F.first("shingles").alias("shingles")).withColumn(
        "window", F.monotonically_increasing_id()), "units")
    sizes = sorted(r[0] for r in units.select(F.least("size", F.lit(shingle)).alias("k")).distinct().collect())  # at most ``shingle`` numbers
    held = bitmap(units.select(F.explode("shingles").alias("hash")), "hash")
    read = written(stretches(docs.select("doc_id", "text"), held, sizes), "stretches")
    hits = written(occurrences(read, units), "occurrences")
    # Words inside any occurrence: each one adds what lies beyond the furthest end before it.
    before = Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("stop").over(before), F.col("start"))
    n_hit = hits.groupBy("row", "start").agg(F.max("stop").alias("stop")).withColumn(
        "fresh", F.greatest(F.lit(0), F.col("stop") - F.greatest("start", reach))).groupBy("row").agg(F.sum("fresh").alias("n_hit"))
    # Copies and common passages hold the same windows, so items are looked up once for each different set of windows.
    sets = hits.groupBy("row").agg(F.array_sort(F.collect_set("window")).alias("windows"))
    named = written(n_hit.join(sets, "row").withColumn("set", F.sha2(F.array_join("windows", ","), 256)), "hits")
    owners = units.select("window", "words", "size").join(cut.select("item_id", "words", "size").distinct(), ["words", "size"]).select("window", "item_id")
    items_of = named.groupBy("set").agg(F.first("windows").alias("windows")).select("set", F.explode("windows").alias("window")).join(
        owners, "window").groupBy("set").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    per_row = named.select("row", "n_hit", "set").join(items_of, "set")
    return read.select("row", "doc_id", "n_words").join(per_row, "row", "left").select(
        "row", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), "item_ids")


def op11_decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    listed = F.coalesce("item_ids", F.array().cast("array<string>"))
    return contamination(docs, items).select(
        "doc_id", "n_words", F.col("n_hit").cast("long").alias("n_hit"), F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH folded AS (
  SELECT 'doc' AS kind, doc_id AS id, row_number() OVER () AS r, text FROM documents
  UNION ALL SELECT 'item', item_id, row_number() OVER (), text FROM benchmark),
words AS (
  SELECT kind, id, r, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM folded),
item_windows AS (
  SELECT DISTINCT id AS item_id, least(10, len(w)) AS size, unnest([array_to_string(w[i:i + least(10, len(w)) - 1], ' ')
    for i in range(1, len(w) - least(10, len(w)) + 2)]) AS win FROM words WHERE kind = 'item' AND len(w) > 0),
sizes AS (SELECT DISTINCT size FROM item_windows),
doc_windows AS (
  SELECT d.r, s.size, unnest([struct_pack(start := i, win := array_to_string(d.w[i:i + s.size - 1], ' ')) for i in range(1, len(d.w) - s.size + 2)]) AS u
  FROM words d, sizes s WHERE d.kind = 'doc' AND len(d.w) >= s.size),
hits AS (SELECT d.r, d.size, d.u.start AS start, i.item_id FROM doc_windows d JOIN item_windows i ON d.size = i.size AND d.u.win = i.win),
marked AS (
  SELECT r, COUNT(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(start, start + size)) AS place FROM hits) GROUP BY r),
items AS (
  SELECT r, COUNT(item_id) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY r)
SELECT w.id AS doc_id, len(w.w) AS n_words, coalesce(m.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(m.n_hit, 0) > 0 AS contaminated
FROM words w LEFT JOIN marked m ON w.r = m.r LEFT JOIN items i ON w.r = i.r WHERE w.kind = 'doc'
"""
