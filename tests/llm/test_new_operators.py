"""Decontamination, prefix tries and lexical search against brute force, and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from changeflow.llm import decontaminate, lexical_search, prefix_trie

CLASHES = ("row", "words", "hash", "start", "stop", "window", "size", "found", "conv", "place", "depth", "k1", "shard", "term", "query", "pack", "did")


def with_clashes(df):
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)])


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# Decontamination ------------------------------------------------------------------------------------------------

def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(text))


def marked(docs, items):
    out = []
    for did, text in docs:
        w, hit, ids = words(text), set(), set()
        for item, t in items:
            v = words(t)
            size = min(10, len(v))
            for i in range(len(v) - size + 1 if size else 0):
                for j in range(len(w) - size + 1):
                    if w[j:j + size] == v[i:i + size]:
                        hit |= set(range(j, j + size))
                        ids |= {str(item)} if item is not None else set()
        out.append((did, len(w), len(hit), len(ids), sha(",".join(sorted(ids))), bool(hit)))
    return out


def op11(spark, docs, items):
    rows = decontaminate.op11_decontaminate(
        with_clashes(spark.createDataFrame(docs, "doc_id long, text string")), with_clashes(spark.createDataFrame(items, "item_id long, text string")))
    return rows.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()


BENCH = "The Quick brown fox—jumps over the lazy dog and then it sleeps until morning, 24 hours later."
DOCS = [
    (1, BENCH), (1, "x " + BENCH.upper() + " y"), (2, None), (3, ""), (None, "quick brown fox—jumps over the lazy dog and then it"),
    (4, "quick brown fox—jumps over the lazy dog and"), (5, "one two"), (6, "a one  two, one-two! two one"), (7, " ".join(f"w{i}" for i in range(30_000)) + " " + BENCH),
    (8, "the quick brown fox jumps over the lazy dog and then it sleeps"), (9, "日本語 é É")]
ITEMS = [(10, BENCH), (11, BENCH), (9, "one two"), (9, "ONE-TWO two"), (None, "two one"), (12, None), (13, " .,"), (14, "日本語 é")]


def test_marked_words(spark):
    assert Counter(map(tuple, op11(spark, DOCS, ITEMS))) == Counter(marked(DOCS, ITEMS))


def test_marked_words_of_random_texts(spark):
    """Few different words, so that windows overlap, repeat and nearly match; items of 1 to 25 words."""
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    items = [(i, text(rng.choice((1, 3, 4, 5, 7, 9, 10, 11, 25)))) for i in range(30) if i] + [(99, text(12))]
    items = [(i, t) for i, t in items if len(t) > 12] + [(200, "a b")]
    docs = [(i, text(rng.randrange(60)) + " " + rng.choice(items)[1] + " " + text(rng.randrange(30))) for i in range(150)]
    assert Counter(map(tuple, op11(spark, docs, items))) == Counter(marked(docs, items))


def test_full_bitmap_only_lets_more_through(spark):
    docs, items = (spark.createDataFrame(rows, f"{name} long, text string") for rows, name in ((DOCS, "doc_id"), (ITEMS, "item_id")))
    units = decontaminate.windows(items).groupBy("words", "size").agg(F.first("shingles").alias("shingles")).withColumn("window", F.xxhash64("words"))
    read = lambda held: decontaminate.stretches(docs, held, [2, 5])
    found = [sorted(map(tuple, decontaminate.occurrences(read(held), units).collect())) for held in (
        b"\xff" * 8192, decontaminate.bitmap(units.select(F.explode("shingles").alias("hash")), "hash"))]
    assert found[0] == found[1] and found[0]


@pytest.mark.parametrize("docs,items", [([], ITEMS), (DOCS, []), ([], []), ([(None, None)] * 2, [(None, None)] * 2)])
def test_nothing_to_mark(spark, docs, items):
    assert Counter(map(tuple, op11(spark, docs, items))) == Counter(marked(docs, items))


# Prefix trie ----------------------------------------------------------------------------------------------------

def trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    kids = Counter(n[:-1] for n in members if n)
    leaves, saved = Counter(), Counter()
    for n, m in members.items():
        cost = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0
        for d in range(len(n) + 1):
            leaves[n[:d]] += n not in kids
            saved[n[:d]] += cost
    return Counter((m[0], len(n), members[n[:-1]][0] if n else None, len(m), kids[n], leaves[n], saved[n],
                    sha(",".join(str(c) for c in m if len(built[c]) == len(n)))) for n, m in members.items())


def nodes(df):
    return Counter(map(tuple, df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()))


def conversations(spark, rows):
    return with_clashes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))


def random_rows(seed, n=400, turns=9):
    rng = random.Random(seed)
    return [(c, rng.choice((t, t, t, None, t + 1)), rng.choice(("user", "user", None, "bot")), rng.choice(("hi there", "hi there", "a b  c", "", None, "é x")))
            for c in [*range(-30, n), 10**15, None] for t in range(rng.randrange(turns))]


@pytest.mark.parametrize("seed", [1, 2])
def test_trie(spark, seed):
    rows = random_rows(seed)
    assert nodes(prefix_trie.op12_prefix_trie(conversations(spark, rows))) == trie(rows)


def test_trie_of_long_and_copied_conversations(spark):
    """Bands and blocks are crossed: 300 turns, 1500 copies, and copies that end early."""
    long = [("user" if t % 2 else "bot", f"turn {t % 7} says {t}") for t in range(300)]
    rows = [(0, t, *long[t]) for t in range(300)] + [(1, t, *long[t]) for t in range(300)] + [(2, t, *long[t]) for t in range(128)]
    rows += [(3, t, *(long[t] if t < 200 else ("user", "other"))) for t in range(260)]
    rows += [(c, t, "user", f"same {t}") for c in range(100, 1600) for t in range(3)]
    want = trie(rows)
    assert nodes(prefix_trie.op12_prefix_trie(conversations(spark, rows))) == want
    turns = prefix_trie.rebuilt(prefix_trie.turns_of(conversations(spark, rows)))
    small = prefix_trie.prefix_trie(turns, block=64, band=16).withColumnsRenamed({"conv": "conv_id", "parent_conv": "parent_conv_id"})
    assert nodes(small) == want


def test_trie_with_one_turn_everywhere(spark):
    rows = [(c, 0, "user", "hello") for c in range(2000)] + [(c, 1, "bot", f"answer {c % 50}") for c in range(0, 2000, 2)]
    assert nodes(prefix_trie.op12_prefix_trie(conversations(spark, rows))) == trie(rows)


@pytest.mark.parametrize("rows", [[], [(None, None, None, None)] * 2, [(7, None, None, None)] * 3])
def test_small_tries(spark, rows):
    assert nodes(prefix_trie.op12_prefix_trie(conversations(spark, rows))) == trie(rows)


# Lexical search -------------------------------------------------------------------------------------------------

def ranked(docs, items, k=10):
    bags = [(LAST if d is None else d, i, Counter(words(t))) for i, (d, t) in enumerate(docs)]
    bags = [b for b in bags if b[2]]
    total, length = len(bags), sum(sum(b.values()) for _, _, b in bags)
    df = Counter(t for *_, b in bags for t in b)
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(words(text))
    out = Counter()
    for item, terms in asked.items():
        found = []
        for did, i, bag in bags:
            m = 10 + (90 * sum(bag.values()) * total) // length
            score = sum(int(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 8 * m)) for t in terms if bag[t])
            if score > 0:
                found.append((-score, did, i))
        for rank, (score, did, _) in enumerate(sorted(found)[:k], 1):
            out[item, rank, None if did == LAST else did, -score] += 1
    return out


LAST = 2**63 - 1


def op13(spark, docs, items):
    rows = lexical_search.op13_lexical_search(
        with_clashes(spark.createDataFrame(docs, "doc_id long, text string")), with_clashes(spark.createDataFrame(items, "item_id long, text string")))
    return Counter(tuple(r) for r in rows.select("item_id", "rank", "doc_id", "score").collect())


def zipf_docs(seed, n, size):
    rng = np.random.default_rng(seed)
    return [(int(i), " ".join(f"W{w}" for w in rng.zipf(1.3, rng.integers(1, size)) if w < 5000)) for i in rng.permutation(n)]


def test_best_documents(spark):
    docs = zipf_docs(1, 600, 80) + [(3, "w1 w2 w3"), (3, "w1 w2 w3"), (None, "w1 w2 w40"), (700, None), (701, "..."), (702, "w7 " * 20_000)]
    items = [(i, t) for i, t in zipf_docs(2, 30, 25)] + [(1, "w7 é"), (None, "w40 w41"), (50, None), (51, "nowhere"), (52, "w1 w1 w1")]
    assert op13(spark, docs, items) == ranked(docs, items)


@pytest.mark.parametrize("shard_docs", [1, 100, 5000])
def test_shards_and_ranges(spark, monkeypatch, shard_docs):
    """Many blocks, many ranges, thresholds that leave lists non-essential; the whole vocabulary is indexed."""
    docs, items = zipf_docs(3, 900, 60), zipf_docs(4, 20, 12)
    docs += [(d + 1000, t) for d, t in docs[:300]]  # ties of score
    held = lexical_search.index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), shard_docs=shard_docs)
    terms = lexical_search.term_rows(spark.createDataFrame(items, "item_id long, text string"))
    got = Counter(tuple(r) for r in lexical_search.search(held, terms, k=5).select("item_id", "rank", "doc_id", "score").collect())
    assert got == ranked(docs, items, 5)


def test_ranges_are_pruned():
    """With small ranges the same best documents come out, and blocks stay closed."""
    rng = np.random.default_rng(5)
    n = rng.integers(5, 300, 20_000)
    m_of = lambda x: 10 + (90 * x * 20_000) // int(n.sum())
    make = lambda df, w: lexical_search.Posting(w, lexical_search.list_row(
        0, "t", np.sort(rng.choice(20_000, df, False)), rng.integers(1, 4, df), n), n, m_of)
    lists = [make(df, w) for df, w in ((15_000, 40), (9_000, 300), (2_000, 2500), (60, 6000), (15, 8000))]
    ids = rng.permutation(20_000)
    whole = lexical_search.best_of(lists, ids, 10, step=20_000)
    opened = [len(p.open) for p in lists]
    for p in lists:
        p.open.clear()
    assert lexical_search.best_of(lists, ids, 10, step=512) == whole
    assert len(lists[0].open) < opened[0] // 2 and len(lists[1].open) < opened[1]


@pytest.mark.parametrize("size,top", [(1, 3), (127, 300), (128, 70_000), (129, 5)])
def test_blocks(size, top):
    rng = np.random.default_rng(size)
    docs, tfs = np.sort(rng.choice(1 << 20, size, False)), rng.integers(1, top, size)
    row = lexical_search.list_row(0, "t", docs, tfs, np.ones(1 << 20, np.int64))
    back = [lexical_search.decompressed(memoryview(row["data"]), s) for s in row["starts"]]
    assert np.array_equal(np.concatenate([b[0] for b in back]), docs) and np.array_equal(np.concatenate([b[1] for b in back]), tfs)


@pytest.mark.parametrize("docs,items", [([], [(1, "a")]), ([(1, "a")], []), ([], []), ([(None, None)] * 2, [(None, None)])])
def test_nothing_to_find(spark, docs, items):
    assert op13(spark, docs, items) == Counter()
