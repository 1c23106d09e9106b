"""The trie of conversation prefixes by vertical bitmaps.

Conversations are ordered by id and cut into blocks of ``BLOCK``, their turns into bands of ``BAND`` places, so
that a shard (block, band) holds a bounded number of turns however long or similar its conversations are. A
shard indexes (place, turn) to a bitset of its conversations. Depth first from each class of conversations that
enter the band with equal prefixes, the bitset of a node is intersected with the postings of the next place: the
non-empty ones are its children, their popcounts its members, and what no posting takes ends there.

A node is named by its depth and the sum of the hashes of its (place, turn) pairs, two 64-bit sums of different
seeds, so that shards name equal prefixes equally and without the turns of earlier bands. Nodes of all shards are
merged by name. Sums over subtrees need each node once: a node is owned by its smallest member, whose own nodes
are the end of its path, so suffix sums along the paths of the owners, added up by node, are the sums.

Defined results: turns are ordered by turn (null first), then role and text, so that ties and repeated rows
have one order; repeated rows are repeated turns. Null roles and texts are empty. Rows without ``conv_id`` belong
to no conversation and are left out. An empty table gives an empty result, without a root.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.skew import hot_hashes, row_numbers, skew_join
from .common import table, written

BLOCK = 1024
BAND = 64
STEM = 20  # conversations of one stem begin alike
SHARED = 4

_NODE = ("k1", "k2", "depth")
_SHARD = "k1 long, k2 long, depth long, p1 long, p2 long, n_words long, block long, members array<bigint>, ends array<bigint>"
_WRAP = (1 << 64) - 1


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv, place, h1, h2, n_words) of every turn in the order of its conversation, from 1."""
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return row_numbers(rows, ["conv"], ["turn", "role", "text"], "place").select(
        "conv", "place", F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(1), "role", "text").alias("h2"),
        F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_words"))


def rebuilt(turns: DataFrame, stem: int = STEM, shared: int = SHARED) -> DataFrame:
    """Every conversation c with the first h turns of c - c % stem in place of its own, h = crc32(c) % shared.

    Each conversation has a row of place 0 too, without a turn, so that none without turns gets lost.
    """
    convs = turns.select("conv").distinct().select(
        "conv", (F.col("conv") - F.col("conv") % stem).alias("base"),
        (F.crc32(F.col("conv").cast("string").cast("binary")) % shared).alias("h"))
    first = turns.filter(F.col("place") < shared).withColumnRenamed("conv", "base")
    begun = convs.join(first, "base").filter("place <= h").select("conv", "place", "h1", "h2", "n_words")
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % shared
    own = turns.filter(F.col("place") > h)
    # The own turns follow directly where the stem has fewer than h.
    held = begun.groupBy("conv").agg(F.count(F.lit(1)).alias("held"))
    lens = convs.join(held, "conv", "left").select("conv", (F.col("h") - F.coalesce("held", F.lit(0))).alias("gap"))
    moved = skew_join(own, lens.filter("gap > 0"), ["conv"], "left").select(
        "conv", (F.col("place") - F.coalesce("gap", F.lit(0))).alias("place"), "h1", "h2", "n_words")
    roots = convs.select("conv", F.lit(0).cast("long").alias("place"), F.lit(0).cast("long").alias("h1"),
                         F.lit(0).cast("long").alias("h2"), F.lit(0).cast("long").alias("n_words"))
    return begun.unionByName(moved).unionByName(roots)


def placed(turns: DataFrame, block: int = BLOCK, band: int = BAND) -> DataFrame:
    """Turns with the shard they belong to, the sums of the bands before, and what a turn adds to them.

    (block, band, conv, place, a1, a2, n_words, s1, s2, last): a turn adds a1 and a2, s1 and s2 are the sums where
    its band begins, and last is the place of the last turn of the conversation.
    """
    # Ranges in order, sorted within: the number that Spark gives rows grows with the id.
    ids = turns.select("conv").distinct().repartitionByRange("conv").sortWithinPartitions("conv").select(
        "conv", F.shiftright(F.monotonically_increasing_id(), block.bit_length() - 1).alias("block"))
    marked = turns.withColumns({
        "band": F.when(F.col("place") > 0, F.floor((F.col("place") - 1) / band)).otherwise(0).cast("long"),
        "a1": F.when(F.col("place") > 0, F.xxhash64("place", "h1", "h2")).otherwise(0),
        "a2": F.when(F.col("place") > 0, F.xxhash64(F.lit(1), "place", "h1", "h2")).otherwise(0)})
    # 64-bit sums that wrap around, of halves, as SQL sums raise on overflow.
    bands = marked.groupBy("conv", "band").agg(*_halves("a1"), *_halves("a2"), F.max("place").alias("last"))
    along = Window.partitionBy("conv").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    sums = bands.select("conv", "band", *[
        _joined(F.coalesce(F.sum(f"{c}_hi").over(along), F.lit(0)), F.coalesce(F.sum(f"{c}_lo").over(along), F.lit(0))).alias(f"s{i}")
        for i, c in ((1, "a1"), (2, "a2"))], F.max("last").over(Window.partitionBy("conv")).alias("last"))
    heads = sums.join(written(ids, "blocks"), "conv")
    return marked.join(heads, ["conv", "band"]).select(
        "block", "band", "conv", "place", "a1", "a2", "n_words", "s1", "s2", "last")


def _halves(name: str) -> list:
    high, low = F.shiftright(name, 32), F.col(name).bitwiseAND(F.lit(0xFFFFFFFF))
    return [F.sum(high).alias(f"{name}_hi"), F.sum(low).alias(f"{name}_lo")]


def _joined(high, low):
    """high * 2**32 + low, modulo 2**64."""
    carried = high + F.shiftright(low, 32)
    return F.shiftleft(carried, 32).bitwiseOR(low.bitwiseAND(F.lit(0xFFFFFFFF)))


def members_of(bits: int, convs: np.ndarray) -> np.ndarray:
    raw = np.frombuffer(bits.to_bytes((len(convs) + 7) // 8, "little"), np.uint8)
    return convs[np.flatnonzero(np.unpackbits(raw, bitorder="little")[:len(convs)])]


def _signed(column: tuple) -> pa.Array:
    return pa.array([None if v is None else v - (1 << 64) if v >> 63 else v for v in column], pa.int64())


def shard_nodes(rows: pa.Table, band: int = BAND) -> pa.Table:
    """The nodes of one shard, each with its members and those of them that end there, ascending.

    The node where a band begins belongs to the band before; the root belongs to the first.
    """
    conv, number = np.unique(rows.column("conv").to_numpy(), return_inverse=True)
    place, last, n_words = (rows.column(c).to_numpy().tolist() for c in ("place", "last", "n_words"))
    a1, a2, s1, s2 = (rows.column(c).to_numpy().view(np.uint64).tolist() for c in ("a1", "a2", "s1", "s2"))
    # The vertical index, and which turn a conversation has at a place.
    postings: dict[tuple, int] = defaultdict(int)
    turn_at: dict[tuple, tuple] = {}
    entering: dict[tuple, int] = defaultdict(int)
    ending: dict[int, int] = defaultdict(int)
    words: dict[tuple, int] = {}
    for i, c in enumerate(number.tolist()):
        bit = 1 << c
        entering[s1[i], s2[i]] |= bit
        ending[last[i]] |= bit
        if place[i]:
            turn = turn_at[c, place[i]] = place[i], a1[i], a2[i]
            postings[turn] |= bit
            words[turn] = n_words[i]
    start = rows.column("band")[0].as_py() * band
    out = []
    stack = [(bits, start, k1, k2, None, None, 0) for (k1, k2), bits in entering.items()]
    while stack:
        bits, depth, k1, k2, p1, p2, n = stack.pop()
        ends = bits & ending.get(depth, 0)
        if depth > start or not start:
            out.append((k1, k2, depth, p1, p2, n, bits, ends))
        # In the band's last node nothing is left to look up, in its first everything goes on.
        left = bits ^ ends if depth < start + band else 0
        while left:
            turn = turn_at[(left & -left).bit_length() - 1, depth + 1]
            child = left & postings[turn]
            left ^= child
            stack.append((child, depth + 1, (k1 + turn[1]) & _WRAP, (k2 + turn[2]) & _WRAP, k1, k2, words[turn]))
    k1, k2, depth, p1, p2, n, bits, ends = zip(*out, strict=True)
    ids = lambda sets: pa.array([members_of(b, conv) if b else [] for b in sets], pa.list_(pa.int64()))
    return pa.table({
        "k1": _signed(k1), "k2": _signed(k2), "depth": pa.array(depth, pa.int64()), "p1": _signed(p1), "p2": _signed(p2),
        "n_words": pa.array(n, pa.int64()), "block": pa.array([rows.column("block")[0].as_py()] * len(out), pa.int64()),
        "members": ids(bits), "ends": ids(ends)})


def end_digests(local: DataFrame) -> DataFrame:
    """(k1, k2, depth, ends_sha256) of the nodes where a conversation ends.

    The lists of a node's blocks follow each other in order and are hashed as they come, so none is held whole.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, done = None, None, []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) if done else [(), (), (), ()]
            done.clear()
            return pa.RecordBatch.from_arrays(
                [*[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())], names=[*_NODE, "ends_sha256"])

        for batch in batches:
            for *key, text in zip(*[batch.column(c).to_pylist() for c in (*_NODE, "text")], strict=True):
                if key != node:
                    if node is not None:
                        done.append((*node, state.hexdigest()))
                    node, state = key, hashlib.sha256(text.encode())
                else:
                    state.update(("," + text).encode())
            if done:
                yield flush()
        if node is not None:
            done.append((*node, state.hexdigest()))
        yield flush()

    lists = local.filter(F.size("ends") > 0).select(*_NODE, "block", F.array_join("ends", ",").alias("text"))
    return lists.repartition(*_NODE).sortWithinPartitions(*_NODE, "block").mapInArrow(
        run, "k1 long, k2 long, depth long, ends_sha256 string")


def subtree_sums(local: DataFrame, nodes: DataFrame, band: int = BAND) -> DataFrame:
    """(k1, k2, depth, n_leaves, saved_tokens) of every node; ``nodes`` has its owner (conv), saved and leaf."""
    paths = local.select(F.explode("members").alias("conv"), *_NODE)
    owned = nodes.select("conv", "depth", "saved", "leaf")
    along = paths.join(owned, ["conv", "depth"], "left").select(
        "conv", *_NODE, F.floor(F.col("depth") / band).alias("band"),
        F.coalesce("saved", F.lit(0)).alias("saved"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    # Suffix sums along a path: within its bands, and what the later bands hold in all.
    inside = Window.partitionBy("conv", "band").orderBy(F.col("depth").desc())
    later = Window.partitionBy("conv").orderBy(F.col("band").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rest = along.groupBy("conv", "band").agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf")).select(
        "conv", "band", F.sum("saved").over(later).alias("more_saved"), F.sum("leaf").over(later).alias("more_leaf"))
    sums = along.withColumns({"saved": F.sum("saved").over(inside), "leaf": F.sum("leaf").over(inside)}).join(
        rest.filter("more_leaf IS NOT NULL"), ["conv", "band"], "left")
    return sums.groupBy(*_NODE).agg(
        F.sum(F.col("leaf") + F.coalesce("more_leaf", F.lit(0))).alias("n_leaves"),
        F.sum(F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved_tokens"))


def prefix_trie(turns: DataFrame, block: int = BLOCK, band: int = BAND) -> DataFrame:
    """One row per node: its owner (conv, the smallest member), the parent's, counts, sums and the digest of its end list.

    ``turns`` is as ``rebuilt`` gives it. ``block`` is a power of two.
    """
    shards = written(placed(turns, block, band), "shards")
    local = written(shards.groupBy("block", "band").applyInArrow(lambda rows: shard_nodes(rows, band), _SHARD), "shard-nodes")
    merged = local.groupBy(*_NODE).agg(
        F.min(F.get("members", F.lit(0))).alias("conv"), F.sum(F.size("members").cast("long")).alias("n_convs"),
        F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.max("n_words").alias("n_words"))
    merged = written(merged, "nodes")
    children = merged.filter("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2"), (F.col("depth") - 1).alias("depth")).agg(
        F.count(F.lit(1)).alias("n_children"))
    nodes = written(merged.join(children, list(_NODE), "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))).withColumns({
        "saved": (F.col("n_convs") - 1) * F.col("n_words"), "leaf": (F.col("n_children") == 0).cast("long")}), "counted-nodes")
    sums = subtree_sums(local, nodes, band)
    full = nodes.join(sums, list(_NODE)).join(end_digests(local), list(_NODE), "left")
    above = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), (F.col("depth") + 1).alias("depth"), F.col("conv").alias("parent_conv"))
    return skew_join(full, above, ["p1", "p2", "depth"], "left", hot=hot_hashes(nodes, ["p1", "p2", "depth"])).select(
        "conv", "depth", "parent_conv", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def op12_prefix_trie(conversations: DataFrame) -> DataFrame:
    turns = written(turns_of(conversations), "turns")
    return prefix_trie(written(rebuilt(turns), "rebuilt-turns")).withColumnsRenamed({"conv": "conv_id", "parent_conv": "parent_conv_id"})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_prefix_trie(table(spark, sf_dir, "conversations"))


# The checksum byte by byte, each byte in eight steps; the polynomial is a fixed value.
_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
    lambda r, b: list_reduce([xor(r, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, i: xor(v >> 1, (v & 1) * 3988292384))), 4294967295)"""

SQL = f"""
WITH turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, c - c % 20 AS base, {_CRC32} % 4 AS h FROM (SELECT DISTINCT c FROM turns)),
parts AS (
  SELECT v.c, 0 AS part, t.place, t.role, t.text FROM convs v JOIN turns t ON t.c = v.base AND t.place <= v.h
  UNION ALL SELECT v.c, 1, t.place, t.role, t.text FROM convs v JOIN turns t ON t.c = v.c AND t.place > v.h),
rebuilt AS (SELECT c, role, text, row_number() OVER (PARTITION BY c ORDER BY part, place) AS place FROM parts),
paths AS (
  SELECT c, place AS depth, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n_words,
         list(struct_pack(r := role, t := text)) OVER (PARTITION BY c ORDER BY place) AS path FROM rebuilt
  UNION ALL SELECT c, 0, 0, [] FROM convs),
lens AS (SELECT c, MAX(depth) AS len FROM paths GROUP BY c),
nodes AS (
  SELECT path, p.depth, MIN(p.c) AS conv_id, COUNT(*) AS n_convs, MAX(n_words) AS n_words,
         coalesce(string_agg(CAST(p.c AS VARCHAR), ',' ORDER BY p.c) FILTER (WHERE p.depth = l.len), '') AS ends
  FROM paths p JOIN lens l ON p.c = l.c GROUP BY path, p.depth),
family AS (
  SELECT n.*, u.conv_id AS parent_conv_id, (SELECT COUNT(*) FROM nodes k WHERE k.depth = n.depth + 1 AND k.path[:n.depth] = n.path) AS n_children
  FROM nodes n LEFT JOIN nodes u ON u.depth = n.depth - 1 AND u.path = n.path[:n.depth - 1])
SELECT n.conv_id, n.depth, n.parent_conv_id, n.n_convs, n.n_children,
       (SELECT COUNT(*) FROM family k WHERE k.n_children = 0 AND k.depth >= n.depth AND k.path[:n.depth] = n.path) AS n_leaves,
       CAST((SELECT SUM((k.n_convs - 1) * k.n_words) FROM family k WHERE k.depth >= n.depth AND k.path[:n.depth] = n.path) AS BIGINT) AS saved_tokens,
       sha256(n.ends) AS ends_sha256
FROM family n
"""
