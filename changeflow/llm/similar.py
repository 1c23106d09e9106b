"""What the near-duplicate operators share: shingle sets, signatures, exact checks and linking.

A node is a distinct set of shingles, named by the 128-bit digest of the set, so that exact copies are
one node from the start and a large group of copies costs one row. Words are runs without ASCII white
space, A-Z lower-cased; a shingle is five words, or the whole of a shorter text, kept as a 64-bit hash.

``link`` finds all links that matter for components among nodes that meet in posting lists, without
writing out the pairs of a list: first every member of a list is compared with one hub of the list;
then only members that lie in different components so far are compared with each other, by an exact
prefix filter over their full sets. Whatever the size of a group of near copies, its members meet in one
component in the first step, and no link between different components is left out by the second.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, written

WORDS = 5
SIMILAR = 75  # per cent
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_CACHED_WORDS = 200_000
_CHUNK = 1 << 17
BITS = 4096


class Remembered(dict):
    """A cache of what ``make`` gives for a key, of two generations of ``size`` keys at most."""

    def __init__(self, make: Callable, size: int = _CACHED_WORDS):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


_hashes = Remembered(xxhash.xxh3_64_intdigest)


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of every word of a text."""
    words = text.lower().split()
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def shingle_hashes(h: np.ndarray) -> np.ndarray:
    """The shingles along the words of a text, of which there must be one."""
    n = max(1, len(h) - WORDS + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(WORDS, len(h))):
        out += h[k:n + k] * ODD[k]
    out += np.uint64(len(h) if len(h) < WORDS else 0)
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(29)
    return out


def shingles(text: bytes) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    h = word_hashes(text)
    return np.unique(shingle_hashes(h)) if len(h) else np.empty(0, np.uint64)


def digest(shingle_set: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingle_set.tobytes())


def bits_of(shingle_set: np.ndarray) -> np.ndarray:
    """A bit for the place of every shingle, as 64-bit numbers."""
    held = np.zeros(BITS, np.uint8)
    held[shingle_set % np.uint64(BITS)] = 1
    return np.packbits(held).view(np.int64)


class MinHash:
    """``size`` independent minima of a set; a value is the coordinate in the upper and the minimum in the lower half."""

    def __init__(self, size: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.size = size
        self.a = rng.integers(1, 2**63, size, np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, size, np.uint64)

    def __call__(self, sets: list[np.ndarray]) -> np.ndarray:
        """One row per set, none of them empty."""
        out = np.empty((len(sets), self.size), np.int64)
        first = 0
        while first < len(sets):
            last, total = first, 0
            while last < len(sets) and (last == first or total + len(sets[last]) <= _CHUNK):
                total += len(sets[last])
                last += 1
            flat = np.concatenate(sets[first:last])
            starts = np.cumsum([0] + [len(s) for s in sets[first:last - 1]])
            for c in range(self.size):
                low = np.minimum.reduceat((flat * self.a[c] + self.b[c]) >> np.uint64(33), starts)
                out[first:last, c] = low.astype(np.int64) + (c << 32)
            first = last
        return out


def lists(values: Iterable[np.ndarray], kind=np.int64) -> pa.ListArray:
    values = list(values)
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.concatenate(values).view(kind) if values else np.empty(0, kind)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Slices of bounded length, so that what is derived from one batch stays small."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def similar_enough(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) whose full sets (node, shingles) reach the similarity."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").filter(
        100 * both >= SIMILAR * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def _could_be(n: Column, m: Column) -> Column:
    return 100 * F.least(n, m) >= SIMILAR * F.greatest(n, m)


def _bits_apart() -> Column:
    return F.aggregate(F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _unlinked(open_: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes of different ``part`` whose full sets may still reach the similarity.

    An exact prefix filter: the shingles of a node are put in one order for all nodes, the rarest first,
    and only so many are posted that a partner must share one of them. Where two nodes first meet, the
    shingles that are left bound what they can share, which ends most meetings in the join itself. A list
    within one part is not posted, and the largest part of a list meets the others only. Where ``sets`` has ``bits``,
    bits that differ are shingles that differ, and pairs with more of them than the bound allows end in the join too.
    """
    tokens = open_.join(sets.select("node", "shingles"), "node").select("node", "part", F.size("shingles").alias("n"), F.explode("shingles").alias("key"))
    shared = tokens.groupBy("key").agg(
        F.count(F.lit(1)).alias("df"), (F.min("part") != F.max("part")).alias("mixed")).filter("df > 1")
    held = tokens.join(shared, "key").groupBy("node", "part", "n").agg(
        F.array_sort(F.collect_list(F.struct("df", "key", "mixed"))).alias("held"))
    placed = held.select("node", "part", "n", F.posexplode("held").alias("i", "t"), (F.col("n") - F.size("held")).alias("alone"))
    needed = lambda n, m: F.ceil((n + m) * SIMILAR / (100 + SIMILAR))  # noqa: E731  shingles that two sets of these sizes must share
    left, smallest = F.col("n") - F.col("p"), F.ceil(F.col("n") * SIMILAR / 100)
    met = placed.select("node", "part", "n", (F.col("alone") + F.col("i")).alias("p"), F.col("t.key").alias("key"), "t.mixed").filter(
        F.col("mixed") & (left >= needed(F.col("n"), smallest)))
    # No partner of a list is smaller than its smallest set, which raises the bound for most.
    least = met.groupBy("key").agg(F.min("n").alias("least"))
    posts = written(met.join(least, "key").filter(left >= needed(F.col("n"), F.greatest(smallest, "least"))).select(
        "key", "node", "part", "n", "p"), "prefixes")
    parts = posts.groupBy("key", "part").agg(F.count(F.lit(1)).alias("rows"))
    main = parts.groupBy("key").agg(
        F.max(F.struct("rows", "part")).getField("part").alias("main"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    mixed = posts.join(main.select("key", "main"), "key")
    columns = ["node", "part", "n", "p"]
    if "bits" in sets.columns:
        mixed, columns = mixed.join(sets.select("node", "bits"), "node"), [*columns, "bits"]
    side = lambda s: [F.col(c).alias(f"{c}_{s}") for c in columns]
    others = mixed.filter("part <> main").select("key", *side("a"))
    every = mixed.select("key", "main", *side("b"))
    # The smaller set's own prefix is shorter: its partner has as many shingles at least.
    short = F.when(F.col("n_a") <= F.col("n_b"), F.struct(F.col("n_a").alias("n"), F.col("p_a").alias("p"))).otherwise(
        F.struct(F.col("n_b").alias("n"), F.col("p_b").alias("p")))
    return others.join(every, "key").filter(
        (F.col("part_a") != F.col("part_b")) & ((F.col("part_b") == F.col("main")) | (F.col("node_a") < F.col("node_b")))
        & _could_be(F.col("n_a"), F.col("n_b")) & (short["p"] <= short["n"] - F.ceil(short["n"] * 2 * SIMILAR / (100 + SIMILAR)))
        & (F.least(F.col("n_a") - F.col("p_a"), F.col("n_b") - F.col("p_b")) >= needed(F.col("n_a"), F.col("n_b")))
        & (_bits_apart() <= F.col("n_a") + F.col("n_b") - 2 * needed(F.col("n_a"), F.col("n_b")) if "bits" in columns else F.lit(True))
    ).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def link(posts: DataFrame, sets: DataFrame, promising=None) -> DataFrame:
    """(id, component_id) over the links among nodes that share a list.

    ``posts`` is (key, node, n, weight): the lists, the size of each node's set, and how frequent its
    values are; the weightiest node of a list is its hub. ``promising`` narrows the pairs with hubs
    before the full sets are compared; ``sets`` must hold every node of ``posts`` once.
    """
    hubs = posts.groupBy("key").agg(F.max(F.struct("weight", "node", "n")).alias("hub"))
    first = posts.join(hubs, "key").filter("node <> hub.node").filter(_could_be(F.col("n"), F.col("hub.n"))).select(
        F.col("node").alias("a"), F.col("hub.node").alias("b")).distinct()
    links = written(similar_enough(promising(first) if promising else first, sets), "hub-links")
    groups = components(links).withColumnRenamed("id", "node")
    placed = written(posts.join(groups, "node", "left").select("key", "node", F.coalesce("component_id", "node").alias("part")), "placed")
    mixed = placed.groupBy("key").agg((F.min("part") != F.max("part")).alias("mixed")).filter("mixed").select("key")
    open_ = written(placed.join(mixed, "key", "left_semi").select("node", "part").distinct(), "open")
    more = written(similar_enough(_unlinked(open_, sets), sets), "cross-links")
    return components(links.union(more))
