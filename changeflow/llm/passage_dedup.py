"""Passages repeated across documents: MinHash bands over paragraphs, exact check, removal by components.

Paragraphs are the lines of at least ``MIN_WORDS`` words. The signature of a paragraph is cut into bands;
``bands_for`` tunes their number so that two paragraphs at the similarity bound meet in a band with the
wanted probability. Colliding paragraphs are compared by their full shingle sets, linked ones form a
cluster, and a cluster that reaches over two documents or more loses all its paragraphs but those of the
document of smallest id.

Passages that begin or end inside a line, or reach over lines, are found word for word by windows cut from the words
of the whole text, whatever its lines, marks and script: of any ``SPACING`` runs of ``WINDOW`` words that begin one
after another, the one of smallest hash. The choice follows from the words alone, so any ``MIN_WORDS`` words that
two documents have in common hold a window that both have. A window that two documents or more hold stays in
the one of smallest id; windows of one document that overlap or touch and stay in the same document are one run. Of
a passage with changed words inside longer lines the stretches of ``MIN_WORDS`` equal words are found, not the rest.

Defined results: a null or empty text has no paragraph; a null ``doc_id`` counts as the largest id; a
repeat within one document alone is no finding; rows that share an id and a text repeat each other's
places and are one document; an empty table gives an empty result; other columns pass through
``remove_repeats`` whatever their names. ``remove_repeats`` also takes the words before and after a window, as far as
they agree word for word with the document of smallest id that has the same window.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LAST_ID, WHITE, known_id, written
from .similar import SIMILAR, WORDS, MinHash, bits_of, digest, link, lists, shingle_hashes, small_batches

MIN_WORDS = 40
WINDOW = 24
SPACING = MIN_WORDS - WINDOW + 1
ROWS = 2
RECALL = 0.9999
_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[list(WHITE.encode())] = True
_BYTES = np.random.default_rng(5).integers(0, 2**64, 256, np.uint64)
_BYTES[65:91] = _BYTES[97:123]  # A-Z as a-z
_BASE = 0x9E3779B97F4A7C15
_WORD = re.compile(f"[^{WHITE}]+")
_powers = [np.ones(1, np.uint64)] * 2


def bands_for(rows: int = ROWS, recall: float = RECALL, similar: float = SIMILAR / 100) -> int:
    """Fewest bands of ``rows`` coordinates that reach ``recall`` at the similarity bound."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similar**rows))


def _run_hashes(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of every ``values[first:last]`` that depends on the values alone, not on their place."""
    if len(_powers[0]) <= len(values):
        for i, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            _powers[i] = np.cumprod(np.append(np.uint64(1), np.full(2 * len(values), base, np.uint64)))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers[0][:len(values)], out=sums[1:])
    out = (sums[last] - sums[first]) * _powers[1][first]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ out >> np.uint64(29)


def _slid(of: np.ufunc, values: np.ndarray, width: int) -> np.ndarray:
    """``of`` (minimum or maximum) over every ``width`` values that follow one another."""
    size = 1
    while 2 * size <= width:
        values, size = of(values[:-size], values[size:]), 2 * size
    rest = width - size
    return of(values[:-rest], values[rest:]) if rest else values


class Words:
    """The words of a text: their hashes, and where they begin and end in code points."""

    def __init__(self, text: str):
        raw = text.encode()
        b = np.frombuffer(raw, np.uint8)
        white = np.ones(len(raw) + 2, bool)
        white[1:-1] = _IS_WHITE[b]
        points = np.zeros(len(raw) + 1, np.int64)
        np.cumsum((b & 0xC0) != 0x80, out=points[1:])
        begin, end = np.flatnonzero(white[:-2] & ~white[1:-1]), np.flatnonzero(~white[1:-1] & white[2:]) + 1
        self.hashes = _run_hashes(_BYTES[b], begin, end)
        self.begin, self.end = points[begin], points[end]
        self.breaks = np.concatenate([[-1], points[np.flatnonzero(b == 10)], points[-1:]])

    def lines(self) -> list[tuple[int, int, int]]:
        """(start, length, words) of the lines that are long enough."""
        counts = np.diff(np.searchsorted(self.begin, self.breaks))
        at = np.flatnonzero(counts >= MIN_WORDS)
        start = self.breaks[at] + 1
        return list(zip(start.tolist(), (self.breaks[at + 1] - start).tolist(), counts[at].tolist(), strict=True))

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(key, first word) of the windows; the key stands for all their words."""
        count = len(self.hashes) - WINDOW + 1
        if count < SPACING:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        first = np.arange(count)
        key = _run_hashes(self.hashes, first, first + WINDOW)
        least = np.zeros(count + SPACING - 1, np.uint64)
        least[SPACING - 1:count] = _slid(np.minimum, key, SPACING)
        at = np.flatnonzero(_slid(np.maximum, least, SPACING) == key)
        return key[at].view(np.int64), at

    def sets(self, spans: list[tuple[int, int]]) -> list[np.ndarray]:
        """``shingles`` of every (start, length); a span begins and ends with a word or with its line."""
        places = np.array(spans, np.int64).reshape(-1, 2)
        first, last = np.searchsorted(self.begin, places[:, 0]), np.searchsorted(self.begin, places.sum(1))
        every = shingle_hashes(self.hashes)
        out = []
        for i, j in zip(first.tolist(), last.tolist(), strict=True):
            if j - i < WORDS:
                out.append(shingle_hashes(self.hashes[i:j]) if j > i else np.empty(0, np.uint64))
                continue
            found = np.sort(every[i:j - WORDS + 1])
            out.append(np.unique(found) if (found[1:] == found[:-1]).any() else found)
        return out


def _band_keys(signature: np.ndarray) -> np.ndarray:
    odd = np.uint64(_BASE)
    keys = signature[:, ::ROWS].copy()
    for r in range(1, ROWS):
        keys = (keys * odd ^ (keys >> np.uint64(29))) + signature[:, r::ROWS]
    return keys * odd


_LINE = pa.struct([("start", pa.int32()), ("length", pa.int32()), ("n_words", pa.int32()), ("n", pa.int32()), ("node", pa.binary()),
                   ("bands", pa.list_(pa.int64()))])
UNITS = """did long, text_id long, windows array<struct<key: bigint, at: int, start: int, length: int>>,
  lines array<struct<start: int, length: int, n_words: int, n: int, node: binary, bands: array<bigint>>>"""


def units(docs: DataFrame) -> DataFrame:
    """(did, text_id, windows, lines) of every text that has any; a line has the name, size and bands of its set."""
    hashed = MinHash(bands_for() * ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 128):
            dids, texts, keys, ats, starts, lengths, counts, rows, sets = [], [], [], [], [], [], [], [], []
            for did, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = Words(text or "")
                key, at = words.windows()
                spans = words.lines()
                if not len(key) and not spans:
                    continue
                dids.append(did)
                texts.append(xxhash.xxh3_64_intdigest(text) - 2**63)
                keys.append(key)
                ats.append(at)
                starts.append(words.begin[at])
                lengths.append(words.end[at + WINDOW - 1] - words.begin[at])
                own = words.sets([s[:2] for s in spans])
                rows += [(*s, len(one), digest(one)) for s, one in zip(spans, own, strict=True)]
                sets += own
                counts.append(len(spans))
            if not dids:
                continue
            held = pa.StructArray.from_arrays(
                [pa.array(np.concatenate(c).astype(k)) for c, k in ((keys, np.int64), (ats, np.int32), (starts, np.int32), (lengths, np.int32))],
                ["key", "at", "start", "length"])
            bands = lists(_band_keys(hashed(sets).view(np.uint64))) if sets else pa.array([], pa.list_(pa.int64()))
            columns = [pa.array([r[c] for r in rows], _LINE[c].type) for c in range(5)]
            lines = pa.StructArray.from_arrays([*columns, bands], fields=list(_LINE))
            cut = lambda sizes: pa.array(np.cumsum([0, *sizes]), pa.int32())
            yield pa.RecordBatch.from_arrays([
                pa.array(dids, pa.int64()), pa.array(texts, pa.int64()), pa.ListArray.from_arrays(cut(map(len, keys)), held),
                pa.ListArray.from_arrays(cut(counts), lines)], names=["did", "text_id", "windows", "lines"])

    return docs.select(known_id().alias("did"), "text").mapInArrow(run, UNITS)


def _sets_at(batch: pa.RecordBatch) -> Iterator[tuple[bytes, np.ndarray]]:
    """(node, set) of the places (start, length, node) in the second column of a batch of (text, places)."""
    for text, places in zip(batch.column(0), batch.column(1), strict=True):
        places = places.as_py()
        for place, one in zip(places, Words(text.as_py() or "").sets([(p["start"], p["length"]) for p in places]), strict=True):
            if len(one) and digest(one) == place["node"]:  # another text may have the same id
                yield place["node"], one


def _sets_of(texts: DataFrame) -> DataFrame:
    """(node, shingles, bits) of the sets at the places of every (text, wanted)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 128):
            found = list(_sets_at(batch))
            if found:
                nodes, sets = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes, pa.binary()), lists(sets), lists([bits_of(s) for s in sets])], names=["node", "shingles", "bits"])

    return texts.select("text", "wanted").mapInArrow(run, "node binary, shingles array<bigint>, bits array<bigint>")


def repeated_lines(found: DataFrame, docs: DataFrame) -> DataFrame:
    """(did, start, length, n_words, component_id) of every long line of ``units`` whose cluster reaches over documents."""
    rows = found.select("did", F.explode("lines").alias("line")).select("did", "line.*")
    # A set is one node however many lines have it.
    nodes = written(rows.groupBy("node").agg(F.first("n").cast("long").alias("n"), F.first("bands").alias("bands")), "nodes")
    values = nodes.select("node", "n", F.explode(F.array_distinct("bands")).alias("key"))
    shared = values.groupBy("key").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    met = written(values.join(shared, "key"), "met")
    weight = met.groupBy("node").agg(F.sum("df").alias("weight"))
    posts = written(met.join(weight, "node").select("key", "node", "n", "weight"), "posts")
    places = rows.join(posts.select("node").distinct(), "node", "left_semi").groupBy("node").agg(
        F.min(F.struct("did", "start", "length")).alias("at"))
    wanted = written(places.groupBy(F.col("at.did").alias("did")).agg(
        F.collect_set(F.struct("at.start", "at.length", "node")).alias("wanted")), "wanted")
    texts = docs.select(known_id().alias("did"), "text").join(wanted, "did")
    sets = written(_sets_of(texts).dropDuplicates(["node"]), "sets")  # two rows of one id and text give a set twice
    groups = link(posts, sets).select(F.col("id").alias("node"), F.col("component_id").alias("part"))
    placed = rows.select("did", "start", "length", "n_words", "node").join(groups, "node", "left").withColumn(
        "part", F.coalesce("part", "node"))
    spans = placed.groupBy("part").agg(F.min("did").alias("component_id"), F.max("did").alias("last")).filter("component_id <> last")
    return placed.join(spans.select("part", "component_id"), "part").select("did", "start", "length", "n_words", "component_id")


def repeated_windows(found: DataFrame) -> DataFrame:
    """(did, text_id, key, at, start, length, component_id) of every window of ``units`` that two documents or more hold."""
    rows = found.select("did", "text_id", F.explode("windows").alias("w")).select("did", "text_id", "w.*")
    shared = rows.groupBy("key").agg(F.min("did").alias("component_id"), F.max("did").alias("last")).filter("component_id <> last")
    return rows.join(shared.select("key", "component_id"), "key")


def runs(held: DataFrame) -> DataFrame:
    """(did, start, length, n_words, component_id): windows that overlap or touch and stay in the same document, as one."""
    text = Window.partitionBy("did", "text_id").orderBy("at")
    begins = (F.col("component_id") != F.lag("component_id").over(text)) | (F.col("at") > F.lag("at").over(text) + WINDOW)
    cut = held.withColumn("begins", F.coalesce(begins, F.lit(True)).cast("int")).withColumn("part", F.sum("begins").over(text))
    return cut.groupBy("did", "text_id", "part").agg(
        F.min("start").alias("start"), F.max(F.col("start") + F.col("length")).alias("end"),
        (F.max("at") - F.min("at") + WINDOW).alias("n_words"), F.min("component_id").alias("component_id")).select(
        "did", "start", (F.col("end") - F.col("start")).alias("length"), "n_words", "component_id")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(did, kind, start, length, n_words, component_id, removed) of every repeated line and run."""
    found = written(units(docs), "units")
    rows = repeated_lines(found, docs).withColumn("kind", F.lit("line")).unionByName(
        runs(repeated_windows(found)).withColumn("kind", F.lit("run")))
    return rows.select("did", "kind", *[F.col(c).cast("long").alias(c) for c in ("start", "length", "n_words")], "component_id",
                       (F.col("did") != F.col("component_id")).alias("removed"))


def op6_passage_dedup(docs: DataFrame) -> DataFrame:
    real = lambda c: F.when(F.col(c) < LAST_ID, F.col(c)).alias(c)
    found = repeated_passages(docs.select("doc_id", "text"))
    return found.select(real("did").alias("doc_id"), "kind", "start", "length", "n_words", real("component_id"), "removed").distinct()


def without(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the (start, length) spans, which may overlap."""
    if text is None:
        return None
    kept, at = [], 0
    for start, length in sorted(spans):
        kept.append(text[at:max(at, start)])
        at = max(at, start + length)
    return "".join(kept) + text[at:]


def _words(text: str) -> tuple[list[str], list[int], list[int]]:
    """The words of a text, A-Z lower-cased, their starts and their ends."""
    found = list(_WORD.finditer(text))
    return [m.group().encode().lower() for m in found], [m.start() for m in found], [m.end() for m in found]


def maximal_runs(text: str, other: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, length) in ``text`` of the longest runs of equal words around each (start, length, start in ``other``)."""
    (a, starts, ends), (b, others, _) = _words(text), _words(other)
    out, done = [], {}
    for start, length, at in sorted(spans):
        first, last, i = bisect_left(starts, start), bisect_left(starts, start + length), bisect_left(others, at)
        shift = i - first
        if last <= done.get(shift, 0) or a[first:last] != b[i:i + last - first]:
            continue
        while first and first + shift and a[first - 1] == b[first + shift - 1]:
            first -= 1
        while last < len(a) and last + shift < len(b) and a[last] == b[last + shift]:
            last += 1
        done[shift] = last
        out.append((starts[first], ends[last - 1] - starts[first]))
    return out


def _extended(held: DataFrame, docs: DataFrame) -> DataFrame:
    """(did, start, length) of the maximal runs that documents have in common with the first that holds the same window."""
    own = held.filter("did = component_id").groupBy("key").agg(F.min("start").alias("own"))
    pairs = held.filter("did <> component_id").join(own, "key").groupBy("did", F.col("component_id").alias("owner")).agg(
        F.collect_set(F.struct("start", "length", F.col("own").alias("at"))).alias("spans"))
    texts = docs.select(known_id().alias("did"), "text")
    both = pairs.join(texts, "did").join(texts.select(F.col("did").alias("owner"), F.col("text").alias("other")), "owner")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 128):
            rows = [(did, *r) for did, text, other, spans in zip(*[c.to_pylist() for c in batch.columns], strict=True)
                    for r in maximal_runs(text or "", other or "", [(s["start"], s["length"], s["at"]) for s in spans])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], names=["did", "start", "length"])

    return both.select("did", "text", "other", "spans").mapInArrow(run, "did long, start long, length long")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` without the repeated paragraphs, except those of the first document of every cluster."""
    found = written(units(docs), "units")
    held = written(repeated_windows(found), "repeats")
    lines = repeated_lines(found, docs)
    removed = lines.unionByName(held.select(*lines.columns[:3], F.lit(WINDOW).alias("n_words"), "component_id")).filter(
        "did <> component_id").select("did", "start", "length")
    gone = removed.unionByName(_extended(held, docs)).groupBy(F.col("did").alias("__did")).agg(
        F.collect_set(F.struct("start", "length")).alias("__gone"))
    joined = docs.withColumn("__did", known_id()).join(gone, "__did", "left").select(*docs.columns, "__gone")
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                without(t.as_py(), [(g["start"], g["length"]) for g in gone.as_py() or []])
                for t, gone in zip(batch.column(place), batch.column(batch.num_columns - 1), strict=True)]
            columns = list(batch.columns)[:-1]
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return joined.mapInArrow(run, docs.schema)
