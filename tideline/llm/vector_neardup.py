"""Near-duplicate vectors through hierarchical navigable small-world graphs, one per shard.

Vectors of one label (and length) are dealt by a hash of the id to as many shards as keep each near ``SHARD_BYTES``. A task per
shard builds its graph: levels are drawn from a hash of the id, the upper layers are built first, and vectors enter a
layer in batches that search it in step (one numpy operation serves the whole batch), keeping diverse neighbours. Graphs
are rows of a table in the shared folder. Every vector then queries every shard of its label, in blocks: a beam descends
to the base layer, and whatever lies above the threshold there is followed to its own neighbours, so a large group of
copies is found whole however narrow the beam. Each block audits itself: exact answers of up to ``AUDITED`` queries are
compared with those found; below ``RECALL`` the beam doubles, and past the shard's size the block is compared exactly.

Cosines of found pairs are verified in double precision. A block returns link counts and a spanning forest of its links,
never the pairs: what moves is linear in rows. Forests of all blocks are united by ``connected_components``.

Defined results: vectors that are null, zero, or hold null or non-finite components, and rows with a null label or id, link
with nothing and are components of their own. Vectors of different lengths don't link. Rows that repeat an id within a
label count as one vector (the first in byte order). Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import io
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tideline.operators.graph import connected_components
from tideline.session import scratch_folder

SHARD_BYTES = 16 << 20
BLOCK = 4096
LINKS = 16
BEAM = 64
BATCH = 512
EXPANDED = 4
AUDITED = 256
RECALL = 0.99
SLACK = 1e-4


class Graph:
    """Layers of links over unit vectors; ``layers[l]`` is (nodes, links by position in nodes, padded with -1)."""

    def __init__(self, ids: np.ndarray, unit: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]):
        self.ids, self.unit, self.layers = ids, unit, layers
        self.single = unit.astype(np.float32)
        # Links of the base layer in both directions, so that a vector whose links back were pruned is still met.
        base = layers[0][1]
        a, k = np.nonzero(base >= 0)
        both = np.unique(np.concatenate([a * len(ids) + base[a, k], base[a, k] * len(ids) + a]))
        self.edges, self.begin = both % len(ids), np.searchsorted(both, np.arange(len(ids) + 1) * len(ids))

    def pack(self) -> bytes:
        out = io.BytesIO()
        arrays = {"ids": self.ids, "unit": self.unit}
        for k, (nodes, links) in enumerate(self.layers):
            arrays |= {f"n{k}": nodes, f"l{k}": links}
        np.savez(out, **arrays)
        return out.getvalue()

    @classmethod
    def unpack(cls, raw: bytes) -> Graph:
        with np.load(io.BytesIO(raw)) as f:
            return cls(f["ids"], f["unit"], [(f[f"n{k}"], f[f"l{k}"]) for k in range((len(f.files) - 2) // 2)])

    def entries(self, queries: np.ndarray) -> np.ndarray:
        """For each query a base-layer node to begin at: greedy descent through the upper layers."""
        at = np.zeros(len(queries), np.int64)
        for depth in range(len(self.layers) - 1, 0, -1):
            nodes, links = self.layers[depth]
            if depth < len(self.layers) - 1:
                at = np.searchsorted(nodes, at)
            found, _ = beam_search(self.single[nodes], links, queries, at[:, None], 4)
            at = nodes[found[:, 0]]
        return at

    def similar(self, queries: np.ndarray, threshold: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, node) with a cosine of at least ``threshold``, as far as a beam of that width leads."""
        base, single = self.layers[0][1], queries.astype(np.float32)
        low = np.float32(threshold - SLACK)
        rows, nodes = [], []
        for first in range(0, len(queries), BATCH):
            some = single[first : first + BATCH]
            found, score = beam_search(self.single, base, some, self.entries(some)[:, None], beam)
            q, k = np.nonzero((score >= low) & (found >= 0))
            node = found[q, k]
            seen = np.zeros((len(some), len(self.ids)), bool)  # anew: the beam has let go of close vectors it had seen
            seen[q, node] = True
            while len(q):
                rows.append(q + first)
                nodes.append(node)
                next_q, next_node = [], []
                for cut in range(0, len(q), 1 << 14):
                    own = node[cut : cut + (1 << 14)]
                    count = self.begin[own + 1] - self.begin[own]
                    source = np.repeat(q[cut : cut + (1 << 14)], count)
                    near = self.edges[np.arange(count.sum()) + np.repeat(self.begin[own] - np.cumsum(count) + count, count)]
                    fresh = ~seen[source, near]
                    pairs = np.unique(source[fresh] * len(self.ids) + near[fresh])
                    source, near = pairs // len(self.ids), pairs % len(self.ids)
                    seen[source, near] = True
                    close = np.concatenate([np.einsum("ij,ij->i", some[source[i : i + 8192]], self.single[near[i : i + 8192]]) >= low for i in range(0, len(source), 8192)] or [np.zeros(0, bool)])
                    next_q.append(source[close])
                    next_node.append(near[close])
                q, node = np.concatenate(next_q), np.concatenate(next_node)
        row, node = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, nodes))
        return self._verified(queries, row, node, threshold)

    def exact(self, queries: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """All pairs, by comparing every query with every vector in blocks."""
        rows, nodes = [], []
        for first in range(0, len(queries), 256):
            q, node = np.nonzero(queries[first : first + 256].astype(np.float32) @ self.single.T >= np.float32(threshold - SLACK))
            rows.append(q + first)
            nodes.append(node)
        row, node = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, nodes))
        return self._verified(queries, row, node, threshold)

    def _verified(self, queries: np.ndarray, row: np.ndarray, node: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        good = [np.einsum("ij,ij->i", queries[row[i : i + 65536]], self.unit[node[i : i + 65536]]) >= threshold for i in range(0, len(row), 65536)]
        keep = np.concatenate(good) if good else np.zeros(0, bool)
        return row[keep], node[keep]


def beam_search(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Beam search of all queries in step: (nodes, scores) sorted by score, -1 for none."""
    n, rows = len(queries), np.arange(len(queries))[:, None]
    seen = np.zeros((n, len(vectors)), bool)
    found = np.full((n, beam), -1, np.int64)
    score = np.full((n, beam), -2, np.float32)
    open_ = np.zeros((n, beam), bool)
    found[:, : start.shape[1]] = start
    score[:, : start.shape[1]] = np.einsum("bkd,bd->bk", vectors[start], queries)
    open_[:, : start.shape[1]] = True
    seen[rows, start] = True
    while True:
        live = np.flatnonzero(open_.any(1))
        if not len(live):
            return found, score
        at = np.arange(len(live))[:, None]
        wanted = np.where(open_[live], score[live], -3)
        best = np.argsort(-wanted, 1)[:, :EXPANDED]
        picked = np.where(wanted[at, best] > -3, found[live[:, None], best], -1)
        open_[live[:, None], best] = False
        near = np.where(picked[:, :, None] >= 0, links[picked], -1).reshape(len(live), -1)
        near = np.sort(near, 1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[(near >= 0) & seen[live[:, None], near]] = -1
        q, k = np.nonzero(near >= 0)
        fresh = np.full(near.shape, -2, np.float32)
        fresh[q, k] = np.einsum("ij,ij->i", vectors[near[q, k]], queries[live[q]])
        seen[live[q], near[q, k]] = True
        all_score = np.concatenate([score[live], fresh], 1)
        all_found = np.concatenate([found[live], near], 1)
        all_open = np.concatenate([open_[live], near >= 0], 1)
        order = np.argsort(-all_score, 1, kind="stable")[:, :beam]
        score[live], found[live], open_[live] = all_score[at, order], all_found[at, order], all_open[at, order]


def _diverse(vectors: np.ndarray, own: np.ndarray, candidates: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
    """Of candidates sorted by score (padded with -1), those closer to the vector than to any kept before; then the nearest rest."""
    n, width = candidates.shape
    near = vectors[np.maximum(candidates, 0)]
    between = np.matmul(near, near.transpose(0, 2, 1))
    kept, count = np.zeros((n, width), bool), np.zeros(n, np.int64)
    for k in range(width):
        closest = np.where(kept[:, :k], between[:, k, :k], -2).max(1) if k else np.full(n, -2, np.float32)
        kept[:, k] = (candidates[:, k] >= 0) & (candidates[:, k] != own) & (score[:, k] > closest) & (count < most)
        count += kept[:, k]
    rank = np.where(kept, 0, 1) * width + np.arange(width)
    rank[(candidates < 0) | (candidates == own[:, None])] = 3 * width
    order = np.argsort(rank, 1)[:, :most]
    at = np.arange(n)[:, None]
    return np.where(rank[at, order] < 3 * width, candidates[at, order], -1)


def _layer(vectors: np.ndarray, order: np.ndarray, entry_of) -> np.ndarray:
    """Links of one layer; vectors enter in ``order``. ``entry_of(positions)`` gives a node entered before, or None at first."""
    n, most = len(vectors), 2 * LINKS
    links = np.full((n, most), -1, np.int64)
    done = min(n, BATCH)
    first = order[:done]
    score = vectors[first] @ vectors[first].T
    best = np.argsort(-score, 1)[:, : 3 * LINKS]
    chosen = _diverse(vectors, first, first[best], np.take_along_axis(score, best, 1), LINKS)
    links[first, : chosen.shape[1]] = chosen
    _return_links(vectors, links, first, chosen)
    while done < n:
        some = order[done : done + BATCH]
        start = entry_of(some, order[0])
        found, score = beam_search(vectors, links, vectors[some], start[:, None], BEAM)
        mutual = vectors[some] @ vectors[some].T  # vectors of one batch see each other too
        best = np.argsort(-mutual, 1)[:, : 2 * LINKS]
        found = np.concatenate([found, some[best]], 1)
        score = np.concatenate([score, np.take_along_axis(mutual, best, 1)], 1)
        rank = np.argsort(-score, 1, kind="stable")[:, : 3 * LINKS]
        chosen = _diverse(vectors, some, np.take_along_axis(found, rank, 1), np.take_along_axis(score, rank, 1), LINKS)
        links[some, : chosen.shape[1]] = chosen
        _return_links(vectors, links, some, chosen)
        done += len(some)
    return links


def _return_links(vectors: np.ndarray, links: np.ndarray, some: np.ndarray, chosen: np.ndarray) -> None:
    """Links back from the chosen neighbours; full lists keep diverse ones."""
    most = links.shape[1]
    q, k = np.nonzero(chosen >= 0)
    source, target = chosen[q, k], some[q]
    order = np.argsort(source, kind="stable")
    source, target = source[order], target[order]
    nodes, begin, count = np.unique(source, return_index=True, return_counts=True)
    for cut in range(0, len(nodes), 2048):
        own, b, c = nodes[cut : cut + 2048], begin[cut : cut + 2048], count[cut : cut + 2048]
        width = int(c.max())
        back = np.where(np.arange(width) < c[:, None], target[np.minimum(b[:, None] + np.arange(width), len(target) - 1)], -1)
        for part in range(0, width, most):  # a hub gets its new links in turns, so that no list is wider than three times most
            both = np.sort(np.concatenate([links[own], back[:, part : part + most]], 1), 1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            score = np.where(both >= 0, np.einsum("nkd,nd->nk", vectors[np.maximum(both, 0)], vectors[own]), -2)
            rank = np.argsort(-score, 1, kind="stable")
            both, score = np.take_along_axis(both, rank, 1), np.take_along_axis(score, rank, 1)
            crowded = (both >= 0).sum(1) > most
            links[own] = both[:, :most]
            if crowded.any():
                links[own[crowded]] = _diverse(vectors, own[crowded], both[crowded], score[crowded], most)


def build(ids: np.ndarray, vectors: np.ndarray) -> Graph:
    """A graph over vectors with at least one finite non-zero component each."""
    order = np.lexsort((*vectors.T[::-1], ids))
    ids, vectors = ids[order], vectors[order]
    first = np.concatenate([[True], ids[1:] != ids[:-1]])
    ids, vectors = ids[first], vectors[first]
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    draw = np.array([zlib.crc32(str(i).encode()) for i in ids]) / 2**32
    level = np.floor(-np.log(np.maximum(draw, 1e-12)) / np.log(LINKS)).astype(np.int64)
    single, built = unit.astype(np.float32), []
    top = max((d for d in range(1, 12) if (level >= d).any()), default=0)
    for depth in range(top, -1, -1):
        nodes = np.flatnonzero(level >= depth)
        if built:
            upper = Graph(ids, unit, [(nodes, np.zeros((0, 0), np.int64)), *built[::-1]])
            above = np.searchsorted(nodes, upper.layers[1][0])

            def entry_of(some: np.ndarray, start: int, upper=upper, nodes=nodes) -> np.ndarray:
                return np.searchsorted(nodes, upper.entries(single[nodes[some]]))

            rest = np.setdiff1d(np.arange(len(nodes)), above)
            entered = np.concatenate([above, rest])
            # While the upper layer's own nodes enter, not all entry points are there yet: begin at the first node.
            def careful(some: np.ndarray, start: int, find=entry_of, n_above=len(above), place=np.argsort(entered)) -> np.ndarray:
                return find(some, start) if place[some[0]] >= n_above else np.full(len(some), start)

            built.append((nodes, _layer(single[nodes], entered, careful)))
        else:
            built.append((nodes, _layer(single[nodes], np.arange(len(nodes)), lambda some, start: np.full(len(some), start))))
    return Graph(ids, unit, built[::-1])


def _roots(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node of their component) of the links left-right."""
    nodes, both = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = both[: len(left)], both[len(left) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(root, before):
            return nodes, nodes[root]


def linked(graph: Graph, ids: np.ndarray, vectors: np.ndarray, threshold: float, beam: int = BEAM) -> tuple[pd.DataFrame, int]:
    """(vec_id, n_links, root) of a block of queries against one graph, and the beam that passed the audit."""
    order = np.lexsort((*vectors.T[::-1], ids))
    ids, vectors = ids[order], vectors[order]
    first = np.concatenate([[True], ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, bool)
    ids, unit = ids[first], (vectors / np.linalg.norm(vectors, axis=1, keepdims=True))[first]
    row, node = graph.similar(unit, threshold, min(beam, len(graph.ids)))
    while True:
        # Audit: half of the sample at random, half among queries that have found something.
        draw = np.argsort([zlib.crc32(f"a{i}".encode()) for i in ids])
        hit = np.isin(draw, np.unique(row))
        sample = np.unique(np.concatenate([draw[: AUDITED // 2], draw[hit][: AUDITED // 2]]))
        true = len(graph.exact(unit[sample], threshold)[0])
        if np.isin(row, sample).sum() >= RECALL * true:
            break
        beam *= 2
        row, node = graph.exact(unit, threshold) if beam >= len(graph.ids) else graph.similar(unit, threshold, beam)
    other = ids[row] != graph.ids[node]
    row, node = row[other], node[other]
    nodes, root = _roots(ids[row], graph.ids[node])
    count = dict(zip(*np.unique(ids[row], return_counts=True), strict=True))
    return pd.DataFrame({"vec_id": nodes, "n_links": [int(count.get(i, 0)) for i in nodes], "root": root}), beam


def components(vectors: DataFrame, threshold: float = 0.98, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", shard_bytes: int = SHARD_BYTES, block: int = BLOCK) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"), F.col(label).alias("label"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    good = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).filter(finite).withColumn("d", F.size("v"))
    counts = good.groupBy("label", "d").count().select(
        "label", "d", F.ceil(F.col("count") * F.col("d") * 8 / shard_bytes).cast("int").alias("shards"), F.ceil(F.col("count") / block).cast("int").alias("blocks")
    )
    dealt = good.join(counts, ["label", "d"]).select(
        "vec_id", "v", "label", "d", "shards", "blocks",
        F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("shards")).cast("int").alias("shard"), F.pmod(F.xxhash64("vec_id", F.lit(2)), F.col("blocks")).cast("int").alias("block"),
    )

    def graph_of(some: pd.DataFrame) -> pd.DataFrame:
        made = build(some["vec_id"].to_numpy(), np.stack(some["v"].to_numpy()))
        return some[["label", "d", "shard", "blocks"]].head(1).assign(graph=[made.pack()])

    kind = dict(good.dtypes)["label"]
    folder = scratch_folder(spark, "vector-graphs")
    schema = f"label {kind}, d int, shard int, blocks int, graph binary"
    dealt.groupBy("label", "d", "shard").applyInPandas(graph_of, schema).write.mode("overwrite").parquet(folder)
    graphs = spark.read.schema(schema).parquet(folder).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asked = dealt.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))

    def ask(queries: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(shard):
            return pd.DataFrame({"vec_id": [], "n_links": [], "root": []}).astype("int64")
        found, _ = linked(Graph.unpack(shard["graph"].iloc[0]), queries["vec_id"].to_numpy(), np.stack(queries["v"].to_numpy()), threshold)
        return found.astype("int64")

    keys = ["label", "d", "shard", "block"]
    answers = asked.select("vec_id", "v", *keys).groupBy(*keys).cogroup(graphs.select(*keys, "graph").groupBy(*keys)).applyInPandas(ask, "vec_id bigint, n_links bigint, root bigint")
    answers.write.mode("overwrite").parquet(f"{folder}-links")
    found = spark.read.schema("vec_id bigint, n_links bigint, root bigint").parquet(f"{folder}-links")
    n_links = found.groupBy("vec_id").agg(F.sum("n_links").alias("n_links"))
    united = connected_components(found, "vec_id", "root").withColumnRenamed("member", "vec_id")
    return (
        rows.select("vec_id").join(n_links, "vec_id", "left").join(united, "vec_id", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )
