"""Near-duplicate vectors by hierarchical navigable small-world graphs, one per shard.

Equal vectors of a label become one node. The nodes of a label are dealt over shards of bounded size; a
shard's graph has levels of ever fewer nodes, and on each level a node points to near ones that are nearer
to it than to each other. Every node queries every shard of its label: from the top level it walks
down, keeps a beam of the nearest nodes on the lowest level, and follows the graph from the beam through
all nodes near the bound, so that a large group is found whole. The answers of a sample of queries
are audited against all nodes of the shard; beams widen until the audit passes, at the end to the whole
shard. Cosines are verified in double precision, links count in both directions, and components are
their union.

Defined results: a vector that is null, zero or holds a null or non-finite component, or whose label
is null, links with nothing; vectors of different length don't compare; equal vectors link and
count each other; rows that share a ``vec_id`` and a vector are rows of their own with equal results;
a null ``vec_id`` counts as the largest id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LAST_ID, components, known_id, written

BOUND = 0.98
SHARD = 8192
NEIGHBOURS = 24
FANOUT = 16  # a level has about this many times the nodes of the next one
BEAM = 32
MARGIN = 0.03
AUDIT, AUDIT_RECALL = 64, 0.99
_BLOCK = 256


def _choose(vectors: np.ndarray, which: np.ndarray, candidates: np.ndarray, keep: int) -> np.ndarray:
    """Of each row's candidates, nearest first, those nearer to it than to the ones chosen before; -1 for none."""
    out = np.full((len(which), keep), -1, np.int32)
    taken = np.zeros(len(which), np.int64)
    for column in range(candidates.shape[1]):
        c = candidates[:, column]
        to_self = np.einsum("md,md->m", vectors[which], vectors[np.maximum(c, 0)])
        to_taken = np.einsum("md,mkd->mk", vectors[np.maximum(c, 0)], vectors[np.maximum(out, 0)])
        to_taken[out < 0] = -2
        fits = (c >= 0) & (taken < keep) & (to_self > to_taken.max(1))
        rows = np.flatnonzero(fits)
        out[rows, taken[rows]] = c[rows]
        taken[rows] += 1
    # The places left go to the nearest of the others, so that the members of a dense group stay connected.
    chosen = (candidates[:, :, None] == out[:, None, :]).any(2) | (candidates < 0)
    order = np.argsort(chosen, axis=1, kind="stable")
    rest = np.take_along_axis(np.where(chosen, -1, candidates), order, 1)
    columns = np.arange(keep)[None, :]
    spare = columns - taken[:, None]
    fill = np.take_along_axis(rest, np.clip(spare, 0, rest.shape[1] - 1), 1)
    return np.where(columns < taken[:, None], out, np.where(spare < rest.shape[1], fill, -1)).astype(np.int32)


class Graph:
    """Levels of a shard: for each, its nodes and their neighbours (indices into ``vectors``)."""

    def __init__(self, vectors: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.vectors, self.levels = vectors, levels

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = 1) -> Graph:
        height = np.random.default_rng(seed).geometric(1 - 1 / FANOUT, len(vectors)) - 1
        levels, upper = [], None
        for level in range(int(height.max()), -1, -1):
            nodes = np.flatnonzero(height >= level)
            found = []
            for i in range(0, len(nodes), 1024):
                which = nodes[i:i + 1024]
                near = [cls._nearest(vectors, which, nodes, NEIGHBOURS + 8)]
                if upper is not None:  # ways out of a dense group
                    near.append(cls._nearest(vectors, which, upper, 8))
                candidates = np.concatenate(near, axis=1)
                cosines = np.einsum("md,mkd->mk", vectors[which], vectors[np.maximum(candidates, 0)])
                cosines[candidates < 0] = -2
                candidates = np.take_along_axis(candidates, np.argsort(-cosines, axis=1, kind="stable"), 1)
                chosen = _choose(vectors, which, candidates, NEIGHBOURS)
                found.append(chosen)
            levels.append((nodes, cls._both_ways(len(vectors), nodes, np.concatenate(found))))
            upper = nodes
        return cls(vectors, levels[::-1])

    @staticmethod
    def _nearest(vectors: np.ndarray, which: np.ndarray, among: np.ndarray, k: int) -> np.ndarray:
        cosines = vectors[which] @ vectors[among].T
        cosines[which[:, None] == among[None, :]] = -2
        k = min(k, len(among))
        best = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        out = among[best].astype(np.int32)
        out[np.take_along_axis(cosines, best, 1) <= -2] = -1
        return out

    @staticmethod
    def _both_ways(total: int, nodes: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        """Rows of neighbours for all vectors: the chosen ones, then up to as many that chose the row."""
        out = np.full((total, 2 * NEIGHBOURS), -1, np.int32)
        out[nodes, :NEIGHBOURS] = chosen
        source, target = np.repeat(nodes, chosen.shape[1]), chosen.ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        place = np.arange(len(target)) - np.searchsorted(target, target, "left")
        fits = place < NEIGHBOURS
        out[target[fits], NEIGHBOURS + place[fits]] = source[fits]
        return out

    def pack(self) -> bytes:
        import io
        held = {"vectors": self.vectors}
        for i, (nodes, neighbours) in enumerate(self.levels):
            held[f"nodes{i}"], held[f"neighbours{i}"] = nodes.astype(np.int32), neighbours[nodes]
        out = io.BytesIO()
        np.savez(out, **held)
        return out.getvalue()

    @classmethod
    def unpack(cls, raw: bytes) -> Graph:
        import io
        held = np.load(io.BytesIO(raw))
        vectors, levels = held["vectors"], []
        while f"nodes{len(levels)}" in held:
            nodes = held[f"nodes{len(levels)}"].astype(np.int64)
            neighbours = np.full((len(vectors), 2 * NEIGHBOURS), -1, np.int32)
            neighbours[nodes] = held[f"neighbours{len(levels)}"]
            levels.append((nodes, neighbours))
        return cls(vectors, levels)

    def search(self, queries: np.ndarray, beam: int, bound: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs of cosine near the bound or above."""
        found = [self._search(queries[i:i + _BLOCK], min(beam, len(self.vectors)), bound) for i in range(0, len(queries), _BLOCK)]
        return (np.concatenate([q + i * _BLOCK for i, (q, _) in enumerate(found)]) if found else np.empty(0, np.int64),
                np.concatenate([n for _, n in found]) if found else np.empty(0, np.int64))

    def _search(self, queries: np.ndarray, beam: int, bound: float) -> tuple[np.ndarray, np.ndarray]:
        vectors, m = self.vectors, len(queries)
        at = np.full(m, self.levels[-1][0][0])
        cosine = queries @ vectors[at[0]]
        for _, neighbours in self.levels[:0:-1]:
            moving = np.arange(m)
            while len(moving):
                near = neighbours[at[moving]]
                c = np.einsum("md,mkd->mk", queries[moving], vectors[np.maximum(near, 0)])
                c[near < 0] = -2
                best = c.argmax(1)
                value = c[np.arange(len(moving)), best]
                better = value > cosine[moving] + 1e-7
                rows = moving[better]
                at[rows], cosine[rows] = near[better, best[better]], value[better]
                moving = rows
        neighbours = self.levels[0][1]
        ids = np.full((m, beam), -1, np.int64)
        cosines = np.full((m, beam), -2, np.float32)
        open_ = np.zeros((m, beam), bool)
        ids[:, 0], cosines[:, 0], open_[:, 0] = at, cosine, True
        visited = np.zeros((m, len(vectors)), bool)
        visited[np.arange(m), at] = True
        active, wide = np.arange(m), min(4, beam)
        while len(active):
            waiting = np.where(open_[active], cosines[active], -3)
            pick = np.argpartition(-waiting, wide - 1, axis=1)[:, :wide]
            chosen = np.take_along_axis(waiting, pick, 1) > -3
            open_[active[:, None], pick] = False
            from_ids = np.take_along_axis(ids[active], pick, 1)
            near = neighbours[np.maximum(from_ids, 0)].astype(np.int64)
            near[~chosen] = -1
            near = np.sort(near.reshape(len(active), -1), axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            new = (near >= 0) & ~visited[active[:, None], np.maximum(near, 0)]
            rows, columns = np.nonzero(new)
            visited[active[rows], near[rows, columns]] = True
            c = np.full(near.shape, -2, np.float32)
            c[rows, columns] = np.einsum("pd,pd->p", queries[active[rows]], vectors[near[rows, columns]])
            all_c = np.concatenate([cosines[active], c], axis=1)
            best = np.argpartition(-all_c, beam - 1, axis=1)[:, :beam]
            cosines[active] = np.take_along_axis(all_c, best, 1)
            ids[active] = np.take_along_axis(np.concatenate([ids[active], np.where(new, near, -1)], axis=1), best, 1)
            open_[active] = np.take_along_axis(np.concatenate([open_[active], new], axis=1), best, 1)
            active = active[open_[active].any(1)]
        # From the beam on through everything near the bound: as wide as the group is.
        row, place = np.nonzero((cosines >= bound - MARGIN) & (ids >= 0))
        node = ids[row, place]
        hits = [(row, node)]
        reached = np.zeros((m, len(vectors)), bool)
        reached[row, node] = True
        while len(row):
            near = neighbours[node].astype(np.int64)
            r = np.repeat(row, near.shape[1])
            n = near.ravel()
            r, n = r[n >= 0], n[n >= 0]
            fresh = ~reached[r, n]
            pair = np.unique(r[fresh] * len(vectors) + n[fresh])
            r, n = pair // len(vectors), pair % len(vectors)
            reached[r, n] = True
            good = np.concatenate([
                np.einsum("pd,pd->p", queries[r[i:i + 65536]], vectors[n[i:i + 65536]]) for i in range(0, len(r), 65536)
            ]) >= bound - MARGIN if len(r) else np.empty(0, bool)
            row, node = r[good], n[good]
            hits.append((row, node))
        return np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits])


def audited_search(graph: Graph, exact: np.ndarray, queries: np.ndarray, bound: float = BOUND) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) with a cosine of at least ``bound`` in double precision.

    A spread sample of the queries is compared with all vectors; beams double until enough of what it holds is found.
    """
    unit = queries.astype(np.float32)
    sample = np.unique(np.linspace(0, len(queries) - 1, min(AUDIT, len(queries))).astype(np.int64))
    truth = (queries[sample] @ exact.T >= bound).sum()
    beam = BEAM
    while True:
        if beam >= len(exact):
            return _scan(queries, exact, bound)
        q, n = graph.search(unit, beam, bound)
        true = np.concatenate([
            np.einsum("pd,pd->p", queries[q[i:i + 65536]], exact[n[i:i + 65536]]) for i in range(0, len(q), 65536)]) >= bound \
            if len(q) else np.empty(0, bool)
        q, n = q[true], n[true]
        if np.isin(q, sample).sum() >= AUDIT_RECALL * truth:
            return q, n
        beam *= 4


def _scan(queries: np.ndarray, exact: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """A beam as wide as the shard."""
    found = [np.nonzero(queries[i:i + _BLOCK] @ exact.T >= bound) for i in range(0, len(queries), _BLOCK)]
    return np.concatenate([q + i * _BLOCK for i, (q, _) in enumerate(found)]), np.concatenate([n for _, n in found])


def _unit(column: pd.Series) -> np.ndarray:
    exact = np.stack([np.asarray(v, np.float64) for v in column])
    exact /= np.abs(exact).max(1, keepdims=True)  # neither very large nor very small components overflow
    return exact / np.linalg.norm(exact, axis=1, keepdims=True)


def _index(rows: pd.DataFrame) -> pd.DataFrame:
    exact = _unit(rows["embedding"])
    return pd.DataFrame({
        "space": [rows["space"].iloc[0]], "shard": [rows["shard"].iloc[0]], "nodes": [rows["node"].tolist()],
        "exact": [exact.tobytes()], "graph": [Graph.build(exact.astype(np.float32)).pack()]})


def _query(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row: the nodes and vectors of one shard, and the graph of another one of the same space."""
    for batch in batches:
        for i in range(batch.num_rows):
            get = lambda name, i=i: batch.column(batch.schema.get_field_index(name))[i].as_py()
            graph, mine, theirs = Graph.unpack(get("graph")), np.array(get("nodes")), np.array(get("other_nodes"))
            queries = np.frombuffer(get("exact")).reshape(len(mine), -1)
            exact = np.frombuffer(get("other_exact")).reshape(len(theirs), -1)
            q, n = audited_search(graph, exact, queries)
            a, b = mine[q], theirs[n]
            other = a != b
            for k in range(0, int(other.sum()), 100_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a[other][k:k + 100_000], pa.string()), pa.array(b[other][k:k + 100_000], pa.string())], names=["a", "b"])


def vector_links(vectors: DataFrame, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """(vec_id, node) of every row, the node null where it links with nothing; (a, b) of linked nodes, both ways."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(
        "embedding", lambda x: x != 0)
    values = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))  # a negative zero is zero
    rows = written(vectors.select(
        known_id("vec_id").alias("vec_id"), F.when(F.coalesce(fine, F.lit(False)) & F.col("label").isNotNull(), F.concat_ws(
            ":", F.hex(F.xxhash64("label", values)), F.hex(F.xxhash64(F.lit(1), "label", values)))).alias("node"),
        F.concat_ws(":", F.col("label").cast("string"), F.size("embedding")).alias("space"), values.alias("embedding")), "vectors")
    nodes = rows.filter("node IS NOT NULL").groupBy("node").agg(
        F.first("space").alias("space"), F.first("embedding").alias("embedding"))
    nodes = written(nodes, "vector-nodes")
    shards = nodes.groupBy("space").agg(F.ceil(F.count(F.lit(1)) / shard).cast("long").alias("shards"))
    dealt = nodes.join(shards, "space").select(
        "node", "space", "embedding", F.pmod(F.xxhash64("node"), F.col("shards")).alias("shard"))
    index = written(dealt.groupBy("space", "shard").applyInPandas(
        _index, "space string, shard long, nodes array<string>, exact binary, graph binary"), "graphs")
    other = index.select("space", F.col("nodes").alias("other_nodes"), F.col("exact").alias("other_exact"), "graph")
    pairs = index.select("space", "shard", "nodes", "exact").join(other, "space")
    found = written(pairs.select("nodes", "exact", "other_nodes", "other_exact", "graph").mapInArrow(
        _query, "a string, b string"), "found")
    links = written(found.union(found.select("b", "a")).distinct(), "vector-links")
    return rows.select("vec_id", "node"), links


def op8_vector_dedup(vectors: DataFrame) -> DataFrame:
    rows, links = vector_links(vectors)
    copies = rows.filter("node IS NOT NULL").groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))
    copies = written(copies, "copies")
    linked = links.join(copies, links["b"] == copies["node"]).groupBy("a").agg(F.sum("copies").alias("others"))
    groups = components(links)
    placed = copies.join(linked, copies["node"] == linked["a"], "left").join(
        groups, copies["node"] == groups["id"], "left").select(
        "node", "least", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component_id", "node").alias("part"))
    placed = written(placed, "placed-vectors")
    first = placed.groupBy("part").agg(F.min("least").alias("component_id"))
    out = placed.join(first, "part").select("node", "n_links", "component_id")
    real = lambda c: F.when(F.col(c) < LAST_ID, F.col(c)).alias(c)
    joined = rows.join(out, "node", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return joined.select(real("vec_id"), "n_links", real("component_id"), (F.col("vec_id") == F.col("component_id")).alias("kept"))
