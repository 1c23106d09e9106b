"""Registered queries against their SQL, or against a brute-force version where SQL can't express them."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from changeflow.llm import language_id, minhash_dedup, packing, passage_dedup, quality, queries, subword
from tests.oracle import compare, connect


LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.fixture(scope="module")
def docs(sf):
    return {r[0]: r[1:] for r in connect(sf).execute("SELECT doc_id, text, lang FROM documents").fetchall()}


def sets_of(texts):
    out = {}
    for d, t in texts.items():
        w = (t or "").encode().lower().split()
        out[d] = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    return out


def smallest_reachable(ids, links):
    least = {i: i for i in ids}

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        least[b] = a
    return {i: find(i) for i in ids}


def near(texts):
    sets = sets_of(texts)
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:] if sets[a] and sets[b]
             and 100 * (both := len(sets[a] & sets[b])) >= 75 * (len(sets[a]) + len(sets[b]) - both)]
    return sets, smallest_reachable(ids, links)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, sf, name):
    ok, note = compare(queries.QUERIES[name](spark, sf), connect(sf), queries.ORACLES[name])
    assert ok, note


def test_language_of_held_out_texts(spark, sf, docs):
    rows = queries.QUERIES["op3_language_id"](spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == docs[r["doc_id"]][1] for r in held) >= 0.97 * len(held)


def check_packing(rows, texts):
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(packing.public_byte_bpe()[0])
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(pieces) == set(texts)
    total = 0
    for d, text in texts.items():
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        own = sorted(pieces[d], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        assert [r["start"] for r in own] == np.cumsum([0] + [r["length"] for r in own[:-1]]).tolist()
        assert sum(r["length"] for r in own) == len(ids) and all(r["length"] == 2048 for r in own[1:])
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"]:r["start"] + r["length"]].tobytes()) for r in own)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    bound = packing.lower_bound(np.array([r["length"] for r in rows]))
    assert len(sequences) <= np.ceil(bound - 1e-9) + 1
    return total


def test_packing(spark, sf, docs):
    rows = queries.QUERIES["op4_best_fit_packing"](spark, sf).collect()
    check_packing(rows, {d: t for d, (t, _) in docs.items()})


def test_near_duplicates(spark, sf, docs):
    sets, least = near({d: t for d, (t, _) in docs.items()})
    rows = queries.QUERIES["op5_minhash_dedup"](spark, sf).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows} == {
        d: (len(sets[d]), least[d], least[d] == d) for d in docs}


def test_passages(spark, sf, docs):
    """Long lines against every other one that shares a shingle, runs against every 40 words that two documents share."""
    ws = {d: re.findall("[^ \\t-\\r]+", (t or "").translate(LOWER)) for d, (t, _) in docs.items()}
    rows = [r.asDict() for r in queries.QUERIES["op6_passage_dedup"](spark, sf).collect()]
    lines = {}
    for d, (t, _) in docs.items():
        at = 0
        for line in (t or "").split("\n"):
            if (n := len(re.findall("[^ \\t-\\r]+", line))) >= 40:
                lines[d, at, len(line)] = n
            at += len(line) + 1
    sets = sets_of({u: docs[u[0]][0][u[1]:u[1] + u[2]] for u in lines})
    index, pairs = defaultdict(list), Counter()
    for u, s in sets.items():
        for x in s:
            pairs.update((v, u) for v in index[x])
            index[x].append(u)
    links = [(a, b) for (a, b), both in pairs.items() if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both)]
    groups = defaultdict(list)
    for u, part in smallest_reachable(lines, links).items():
        groups[part].append(u)
    want = {(*u, lines[u], part[0], u[0] != part[0]) for part, us in groups.items() if len({u[0] for u in us}) > 1 for u in us}
    columns = ("doc_id", "start", "length", "n_words", "component_id", "removed")
    assert {tuple(r[c] for c in columns) for r in rows if r["kind"] == "line"} == want and len(want) > 20

    held = defaultdict(dict)  # every 24 words: the places in each document
    for d, w in ws.items():
        for i in range(len(w) - 23):
            held[tuple(w[i:i + 24])].setdefault(d, i)
    covered = defaultdict(set)
    for r in rows:
        if r["kind"] == "run":
            d, t = r["doc_id"], docs[r["doc_id"]][0]
            first, n = len(re.findall("[^ \\t-\\r]+", t[:r["start"]])), r["n_words"]
            assert re.findall("[^ \\t-\\r]+", t[r["start"]:r["start"] + r["length"]].translate(LOWER)) == ws[d][first:first + n]
            # Both ends of a run are windows whose first holder is the named document.
            for i in (first, first + n - 24):
                at = held[tuple(ws[d][i:i + 24])]
                assert min(at) == r["component_id"] and len(at) > 1
            assert r["removed"] == (r["component_id"] != d)
            covered[d].update(range(first, first + n - 23))
    shared = defaultdict(set)
    for d, w in ws.items():
        for i in range(len(w) - 39):
            shared[tuple(w[i:i + 40])].add(d)
    found = 0
    for d, w in ws.items():
        for i in range(len(w) - 39):
            if len(shared[tuple(w[i:i + 40])]) > 1:
                assert covered[d] & set(range(i, i + 17))
                found += 1
    assert found > 1000


def brute_vectors(rows):
    unit = {}
    for vec_id, values, label in rows:
        v = np.array(values, np.float64)
        unit[vec_id] = (v / np.linalg.norm(v), label)
    ids = sorted(unit)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:] if unit[a][1] == unit[b][1] and unit[a][0] @ unit[b][0] >= 0.98]
    count = Counter(x for pair in links for x in pair)
    least = smallest_reachable(ids, links)
    return {i: (count[i], least[i], least[i] == i) for i in ids}


def test_vectors(spark, sf):
    rows = connect(sf).execute("SELECT vec_id, embedding, label FROM embeddings").fetchall()
    got = queries.QUERIES["op8_vector_dedup"](spark, sf).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == brute_vectors(rows)


def test_token_counts(spark, sf, docs):
    own = subword.MergeModel(subword.public_model())
    rows = queries.QUERIES["op9_token_counts"](spark, sf).collect()
    assert Counter(r["n_tokens"] for r in rows) == Counter(len(own.library.encode(t or "")) for t, _ in docs.values())
    assert all(r["closed"] for r in rows)


def test_subword(spark, sf, docs):
    own = subword.MergeModel(subword.public_model()).library
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for d, (t, _) in docs.items():
        ids = own.encode(t or "")
        want[d] = (len(ids), sha(",".join(map(str, ids))), sha(own.decode(ids)))
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.QUERIES["op10_sentencepiece"](spark, sf).collect()}
    assert got == want


def test_pipeline_against_brute_force(spark, sf, docs):
    texts = {}
    for d, (t, _) in docs.items():
        measures, cleaned = quality.measure(t)
        if measures["kept"]:
            texts[d] = cleaned
    strip = " \t\n\x0b\x0c\r"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(strip).translate(lower)
    owner = {}
    for d in sorted(texts):
        for line in texts[d].split("\n"):
            owner.setdefault(key(line), d)
    texts = {d: "\n".join(x for x in t.split("\n") if len(key(x)) < 10 or owner[key(x)] == d) for d, t in texts.items()}
    least = near(texts)[1]
    texts = {d: t for d, t in texts.items() if least[d] == d}
    import re
    assign = r"((?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?)([A-Za-z0-9+/_.=-]{12,})"
    for d, t in texts.items():
        t = re.sub(assign, r"\1[REDACTED]", t, flags=re.ASCII | re.IGNORECASE)
        t = re.sub(r"AKIA[A-Z0-9]{14,}|[0-9a-f]{16,}", "[REDACTED]", t)
        texts[d] = t
    rows = corpus_pipeline.run(spark, sf).collect()
    check_packing(rows, texts)


def test_pipeline_stages(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "minhash_dedup", "secret_scan", "best_fit_packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.dtypes == docs.dtypes, name


def test_signature_parameters():
    from math import comb
    miss = sum(comb(minhash_dedup.SIGNATURE, i) * 0.75**i * 0.25**(minhash_dedup.SIGNATURE - i) for i in range(minhash_dedup.MATCHES))
    assert miss < 2e-6


def test_model_size_is_bounded(spark, sf):
    found = language_id.samples(spark.read.parquet(f"{sf}/documents.parquet"))
    assert all(len(t) <= language_id.SLOTS and max(map(len, t)) <= language_id.SAMPLE for t in found.values())
