"""Ranked lexical search over a sharded inverted index by Block-Max MaxScore.

``index`` reads the documents once and writes shards of at most ``SHARD_DOCS`` documents and about ``SHARD_WORDS``
words. A list (shard, term) is a row: blocks of ``BLOCK`` postings, each compressed on its own, with a directory of
the last document, the offset and the impacts of every block. Impacts are the (tf, n) pairs of a block that no other
pair of it beats in both, so block maxima hold for whatever N and L are at the time of the search and a shard need
not be written anew as the collection grows.

``search`` brings the lists of the queries' terms together by (shard, pack of queries) and ranks each query in each
shard, one range of documents after the other. Lists are ordered by their global bounds; those whose bounds stay
below the threshold together are non-essential, so only documents of essential lists are candidates. On
non-essential lists, strongest first, block maxima reject candidates before a block is decompressed. The best ``k``
of all shards are merged. A document that could only tie with the threshold is kept, as ties go by id.

Defined results: terms are runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased. Documents
without terms count nowhere and are never found. Rows that repeat a ``doc_id`` are ranked each by its own text; a null
id is the largest and comes back as null. Equal score and id go by row. Rows that repeat an ``item_id`` (null is one
item too) are one query with the terms of all of them. An empty table on either side gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.skew import bounded, hot_hashes, skew_join
from .common import LAST_ID, known_id, table, written
from .decontaminate import words_of

SHARD_DOCS = 1 << 14
SHARD_WORDS = 1 << 22
BLOCK = 128
RANGE = 4096  # documents of a shard that are ranked at a time
PACK = 256  # queries that visit a shard together, on average
TOP = 10
FEW_TERMS = 1_000_000

# The constants of the score.
SCALE, TF_SCALE, LENGTH_SCALE, FLAT, SLOPE = 1_000_000_000, 1000, 8, 10, 90

_LISTS = pa.schema([
    ("shard", pa.int64()), ("term", pa.string()), ("df", pa.int64()), ("words", pa.int64()), ("lasts", pa.list_(pa.int32())),
    ("starts", pa.list_(pa.int32())), ("impact_at", pa.list_(pa.int32())), ("impact_tf", pa.list_(pa.int32())),
    ("impact_n", pa.list_(pa.int32())), ("data", pa.binary())])
_LISTS_SQL = ("shard long, term string, df long, words long, lasts array<int>, starts array<int>, impact_at array<int>, "
              "impact_tf array<int>, impact_n array<int>, data binary")
_WIDTHS = (np.uint8, np.uint16, np.uint32)


def _narrow(values: np.ndarray) -> tuple[int, bytes]:
    top = values.max()
    kind = 0 if top < 1 << 8 else 1 if top < 1 << 16 else 2
    return kind, values.astype(_WIDTHS[kind]).tobytes()


def compressed(docs: np.ndarray, tfs: np.ndarray) -> bytes:
    """A block: count, widths, gaps between documents, and frequencies less one."""
    gaps = np.diff(docs, prepend=0)
    (a, one), (b, two) = _narrow(gaps), _narrow(tfs - 1)
    return bytes((len(docs) - 1, a * 3 + b)) + one + two


def decompressed(data: memoryview, start: int) -> tuple[np.ndarray, np.ndarray]:
    n, widths = data[start] + 1, data[start + 1]
    one, two = _WIDTHS[widths // 3], _WIDTHS[widths % 3]
    gaps = np.frombuffer(data, one, n, start + 2)
    tfs = np.frombuffer(data, two, n, start + 2 + n * np.dtype(one).itemsize)
    return np.cumsum(gaps, dtype=np.int64), tfs.astype(np.int64) + 1


def impacts(tfs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of the postings that no other beats: longer documents only with a higher frequency."""
    order = np.lexsort((-tfs, lengths))
    top = np.maximum.accumulate(tfs[order])
    return order[np.concatenate(([True], top[1:] > top[:-1]))]


def list_row(shard: int, term: str, docs: np.ndarray, tfs: np.ndarray, lengths: np.ndarray) -> dict:
    lasts, starts, at, tf, n, parts, size = [], [], [0], [], [], [], 0
    for i in range(0, len(docs), BLOCK):
        d, t = docs[i:i + BLOCK], tfs[i:i + BLOCK]
        best = impacts(t, lengths[d])
        starts.append(size)
        lasts.append(int(d[-1]))
        parts.append(compressed(d, t))
        size += len(parts[-1])
        tf.extend(t[best].tolist())
        n.extend(lengths[d[best]].tolist())
        at.append(len(tf))
    return {"shard": shard, "term": term, "df": len(docs), "words": None, "lasts": lasts, "starts": starts, "impact_at": at,
            "impact_tf": tf, "impact_n": n, "data": b"".join(parts)}


def shard_rows(shard: int, ids: list[int], lengths: list[int], keys: list[np.ndarray], terms: Iterable[str]) -> Iterator[pa.RecordBatch]:
    """The rows of one shard: its documents (without a term), then its lists. A key is term number and document."""
    n = np.array(lengths, np.int64)
    rows = [{"shard": shard, "term": None, "df": len(ids), "words": int(n.sum()), "lasts": None, "starts": None, "impact_at": None,
             "impact_tf": None, "impact_n": None, "data": np.array(ids, np.int64).tobytes() + n.tobytes()}]
    held, tfs = np.unique(np.concatenate(keys), return_counts=True) if keys else (np.empty(0, np.int64),) * 2
    numbers, docs = held >> 32, held & 0xFFFFFFFF
    cuts = np.flatnonzero(np.diff(numbers, prepend=-1))
    names = list(terms)
    for low, high in zip(cuts, [*cuts[1:], len(held)], strict=False):
        rows.append(list_row(shard, names[numbers[low]], docs[low:high], tfs[low:high], n))
        if len(rows) >= 4096:
            yield pa.RecordBatch.from_pylist(rows, _LISTS)
            rows = []
    yield pa.RecordBatch.from_pylist(rows, _LISTS)


def index(docs: DataFrame, terms: DataFrame | None = None, shard_docs: int = SHARD_DOCS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The written index over ``docs`` (doc_id, text): one row for each shard and each of its lists.

    ``terms`` (term) may name all terms that will ever be asked for, which leaves out the lists of others; it is used
    where its size is below the bound of a broadcast.
    """
    few = bounded(terms, FEW_TERMS) if terms is not None else None
    wanted = None if few is None else frozenset(r[0].encode() for r in few.collect())
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only, shard = shared.value, None
        ids, lengths, keys, numbers, held = [], [], [], {}, 0
        for batch in batches:
            for row, did, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                words = words_of(text)
                if not words:
                    continue
                if shard is None:
                    shard = row  # the first row of a shard names it
                known = words if only is None else [w for w in words if w in only]
                if known:
                    # A word's number is the number of words met before it.
                    found = np.fromiter((numbers.setdefault(w, len(numbers)) for w in known), np.int64, len(known))
                    keys.append((found << 32) | len(ids))
                ids.append(did)
                lengths.append(len(words))
                held += len(words)
                if len(ids) >= shard_docs or held >= shard_words:
                    yield from shard_rows(shard, ids, lengths, keys, map(bytes.decode, numbers))
                    ids, lengths, keys, numbers, held, shard = [], [], [], {}, 0, None
        if ids:
            yield from shard_rows(shard, ids, lengths, keys, map(bytes.decode, numbers))

    rows = docs.select(F.monotonically_increasing_id().alias("row"), known_id().alias("did"), "text").mapInArrow(run, _LISTS_SQL)
    return written(rows, "lexical-index")


def term_rows(queries: DataFrame) -> DataFrame:
    """(item_id, term) of the different terms of every query of (item_id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(item, w.decode()) for item, text in zip(*[c.to_pylist() for c in batch.columns], strict=True) for w in dict.fromkeys(words_of(text))]
            yield pa.RecordBatch.from_arrays([
                pa.array([p[0] for p in pairs], batch.schema.field(0).type), pa.array([p[1] for p in pairs], pa.string())], names=["item_id", "term"])

    kind = queries.schema["item_id"].dataType.simpleString()
    return queries.select("item_id", "text").mapInArrow(run, f"item_id {kind}, term string").distinct()


class Posting:
    """One list of a shard as a search sees it: weights, block maxima, and its blocks once they are decompressed."""

    def __init__(self, weight: int, row: dict, length: np.ndarray, m_of):
        self.weight, self.data, self.starts = weight, memoryview(row["data"]), row["starts"]
        self.lasts = np.array(row["lasts"], np.int64)
        parts = parts_of(np.array(row["impact_tf"], np.int64), m_of(np.array(row["impact_n"], np.int64)))
        self.maxima = weight * np.maximum.reduceat(parts, np.array(row["impact_at"][:-1]))
        self.bound = int(self.maxima.max())
        self.length, self.m_of, self.open = length, m_of, {}

    def block(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of a block."""
        if i not in self.open:
            docs, tfs = decompressed(self.data, self.starts[i])
            self.open[i] = docs, self.weight * parts_of(tfs, self.m_of(self.length[docs]))
        return self.open[i]


def parts_of(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (SCALE * tf) // (TF_SCALE * tf + LENGTH_SCALE * m)


def best_of(lists: list[Posting], ids: np.ndarray, k: int = TOP, step: int = RANGE) -> list[tuple[int, int, int]]:
    """The (score, id, document) of the ``k`` best documents of a shard, best first."""
    lists = sorted(lists, key=lambda p: p.bound)
    sums = np.cumsum([0] + [p.bound for p in lists])
    top: list[tuple[int, int, int]] = []
    for low in range(0, len(ids), step):
        high = min(low + step, len(ids))
        floor = top[-1][0] if len(top) == k else 1
        # The longest run of weak lists that can't reach the threshold together.
        first = int(np.searchsorted(sums[1:], floor, side="left"))
        if first == len(lists):
            break
        score = np.zeros(high - low, np.int64)
        seen = np.zeros(high - low, bool)
        for p in lists[first:]:
            a, b = np.searchsorted(p.lasts, (low, high - 1))
            for i in range(a, min(b + 1, len(p.lasts))):
                docs, parts = p.block(i)
                x, y = np.searchsorted(docs, (low, high))
                score[docs[x:y] - low] += parts[x:y]
                seen[docs[x:y] - low] = True
        alive = np.flatnonzero(seen & (score + sums[first] >= floor))
        for j in range(first - 1, -1, -1):
            if not len(alive):
                break
            p = lists[j]
            at = np.searchsorted(p.lasts, alive + low)
            inside = at < len(p.lasts)
            limit = np.where(inside, p.maxima[np.minimum(at, len(p.lasts) - 1)], 0)
            held = score[alive] + limit + sums[j] >= floor
            alive, at, inside = alive[held], at[held], inside[held]
            for i in np.unique(at[inside]):
                docs, parts = p.block(i)
                mine = alive[at == i]
                place = np.minimum(np.searchsorted(docs, mine + low), len(docs) - 1)
                hit = docs[place] == mine + low
                score[mine[hit]] += parts[place[hit]]
        alive = alive[score[alive] >= floor]
        if len(alive) > k:
            # Those that tie with the k-th go on, as ids decide.
            cut = np.partition(score[alive], len(alive) - k)[len(alive) - k]
            alive = alive[score[alive] >= cut]
            alive = alive[np.lexsort((alive, ids[alive + low], -score[alive]))[:k]]
        top = sorted([*top, *((int(score[d]), int(ids[d + low]), int(d + low)) for d in alive)], key=lambda t: (-t[0], t[1], t[2]))[:k]
    return top


def search(held: DataFrame, terms: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score) of the ``k`` best documents of every query of ``terms`` (item_id, term)."""
    whole = held.filter("term IS NULL").agg(F.sum("df"), F.sum("words")).first()
    total, words = whole[0] or 0, whole[1] or 1
    item_kind = terms.schema["item_id"].dataType.simpleString()
    sizes = written(terms.select("item_id").distinct().withColumn("query", F.monotonically_increasing_id()), "queries")
    packs = sizes.withColumn("pack", F.pmod(F.xxhash64("query"), F.lit(-(-sizes.count() // PACK) or 1)))
    dfs = held.filter("term IS NOT NULL").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(total) + 2).cast("double") / (2 * F.col("df") + 1).cast("double")))
    asked = terms.withColumn("item_id", F.struct("item_id")).join(packs.select(F.struct("item_id").alias("item_id"), "query", "pack"), "item_id").join(
        dfs, "term").groupBy("pack", "term").agg(F.first(weight).alias("weight"), F.collect_list("query").alias("queries"))
    asked = written(asked, "asked")
    few = bounded(asked)
    lists = held.filter("term IS NOT NULL")
    met = lists.join(F.broadcast(few), "term") if few is not None else skew_join(lists, asked, ["term"], hot=hot_hashes(lists, ["term"]))
    visits = met.select("shard", "pack").distinct()
    columns = ["shard", "pack", "term", "weight", "queries", "lasts", "starts", "impact_at", "impact_tf", "impact_n", "data"]
    shards = held.filter("term IS NULL").join(visits, "shard").withColumns({
        "weight": F.lit(None).cast("long"), "queries": F.lit(None).cast("array<long>")})

    def m_of(n: np.ndarray) -> np.ndarray:
        return FLAT + (SLOPE * n * total) // words

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.to_pylist()
        both = np.frombuffer(next(r["data"] for r in rows if r["term"] is None), np.int64)
        ids, length = both[:len(both) // 2], both[len(both) // 2:]
        of: dict[int, list[Posting]] = {}
        for r in rows:
            if r["term"] is not None:
                posting = Posting(r["weight"], r, length, m_of)
                for q in r["queries"]:
                    of.setdefault(q, []).append(posting)
        found = [(q, rows[0]["shard"], *hit) for q, lists_ in of.items() for hit in best_of(lists_, ids, k)]
        columns_ = list(zip(*found, strict=True)) or [()] * 5
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query", "shard", "score", "did", "place"), columns_, strict=True)})

    best = met.select(*columns).unionByName(shards.select(*columns)).groupBy("shard", "pack").applyInArrow(
        run, "query long, shard long, score long, did long, place long")
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "did", "shard", "place")
    merged = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return merged.join(sizes.select("query", "item_id"), "query").select(
        F.col("item_id").cast(item_kind).alias("item_id"), "rank", F.when(F.col("did") < LAST_ID, F.col("did")).alias("doc_id"), "score")


def op13_lexical_search(docs: DataFrame, items: DataFrame) -> DataFrame:
    terms = written(term_rows(items), "query-terms")
    return search(index(docs, terms.select("term").distinct()), terms)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH words AS (
  SELECT kind, id, r, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM (SELECT 'doc' AS kind, doc_id AS id, row_number() OVER () AS r, text FROM documents
        UNION ALL SELECT 'item', item_id, row_number() OVER (), text FROM benchmark)),
sizes AS (SELECT CAST(COUNT(*) AS BIGINT) AS n_docs, CAST(SUM(len(w)) AS BIGINT) AS n_terms FROM words WHERE kind = 'doc' AND len(w) > 0),
asked AS (SELECT DISTINCT id AS item_id, unnest(w) AS term FROM words WHERE kind = 'item'),
held AS (
  SELECT r, id AS doc_id, n, term, CAST(COUNT(*) AS BIGINT) AS tf
  FROM (SELECT r, id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS term FROM words WHERE kind = 'doc') GROUP BY ALL),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * COUNT(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM held, sizes GROUP BY term, n_docs),
scores AS (
  SELECT a.item_id, h.r, h.doc_id, CAST(SUM(w.w * ((1000000000 * h.tf) // (1000 * h.tf + 8 * (100 - 90 + (90 * h.n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM asked a JOIN held h ON a.term = h.term JOIN weights w ON a.term = w.term, sizes GROUP BY a.item_id, h.r, h.doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, r) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10
"""
