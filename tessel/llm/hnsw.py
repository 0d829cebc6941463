"""Embedding near-duplicates: hierarchical navigable small-world graphs per shard.

Distinct vectors hash into shards; each shard's graph is built in one task (bounded rows) and
kept as a written table.  Every vector is then searched in every shard, in blocks.  A search's
beam widens where all of it is above the threshold, and for the whole block while an audit (queries
compared with every vector of the shard) finds less than ``AUDIT_RECALL`` of a query's true links
on average; at the widest the shard is scanned.  An audit judges ``AUDIT_QUERIES`` queries that
have links, itself left out: queries of the block, drawn until there are enough or
``AUDIT_MOST`` were drawn, then queries planted at the threshold's distance from vectors of the
shard, so it does not run empty where a shard holds few links.  Queries whose beams filled up to
the scan are exact and not judged.  A block with too few to judge is scanned.  Hits are confirmed by cosine in double
precision on the original vectors.  A task returns link counts per query and a spanning forest
of its links (at most one link per vector it saw), never all pairs of a crowd; the forests'
union is contracted to components.

Defined cases: vectors that are null, zero or hold null or non-finite components link with
nothing and keep their own id; vectors of different lengths never link; equal vectors are one
node with a count, so copies cost nothing and link with each other; vectors that
share their smallest vec_id are one node; a null vec_id gets a null component and
stays; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, prepare
from .components import components

COSINE = 0.9
#: At least this many shards; more where a shard would hold more than SHARD_ROWS vectors.
SHARDS, SHARD_ROWS = 8, 200_000
#: Queries of one search task.
BLOCK_ROWS = 32_768
LINKS = 16  # of a node in the upper layers; twice as many in the lowest
BUILD_BEAM, BEAM, WIDEST = 48, 32, 1024
AUDIT_QUERIES, AUDIT_RECALL = 48, 0.99
#: Most queries of a block, and most planted ones, that an audit draws.
AUDIT_MOST = 1024


def usable(vector: Column) -> Column:
    """Not null, every component finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(vectors: pa.Array) -> np.ndarray:
    """Rows of a list column of one length, in double precision."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one (scaled first, so very large or small rows keep their direction)."""
    x = x / np.abs(x).max(1, keepdims=True)
    return (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float32)


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of the rows of ``x`` and ``y`` in double precision."""
    # Rows are scaled by powers of two: squares of very large or small ones stay finite, and no digit changes.
    x, y = (np.ldexp(z, -np.frexp(np.abs(z).max(1, keepdims=True))[1]) for z in (x, y))
    return (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))


class Graph:
    """A navigable small-world graph over unit vectors, built and searched in batches.

    ``layers[l]`` holds the neighbours (node numbers, -1: none) of every node in layer l; nodes
    are stored by descending level, so layer l has the first ``sizes[l]`` nodes.
    """

    def __init__(self, x: np.ndarray, layers: list[np.ndarray], sizes: list[int]):
        self.x, self.layers, self.sizes = x, layers, sizes

    def beam(self, q: np.ndarray, layer: int, start: np.ndarray, width: int, limit: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search of one layer for all queries at once: (nodes, similarities), best
        first, -1 where fewer were met.  ``start`` (queries x entries) seeds the beams."""
        x, links, m = self.x, self.layers[layer], len(q)
        limit = self.sizes[layer] if limit is None else limit
        seen = np.zeros((m, limit + 1), bool)  # the last column takes the -1
        seen[:, limit] = True
        ids = np.full((m, width), -1, np.int64)
        sims = np.full((m, width), -np.inf, np.float32)
        done = np.ones((m, width), bool)
        fresh = np.sort(np.where(start < limit, start, -1), axis=1)
        fresh[:, 1:][fresh[:, 1:] == fresh[:, :-1]] = -1
        act = np.arange(m)
        step = max(1, min(4, width // 4))
        while True:
            r = act[:, None]
            seen[r, fresh] = True
            seen[:, limit] = True
            found = np.where(fresh >= 0, np.einsum("qkd,qd->qk", x[fresh], q[act]), -np.inf).astype(np.float32)
            all_ids = np.concatenate([ids[act], fresh], axis=1)
            all_sims = np.concatenate([sims[act], found], axis=1)
            all_done = np.concatenate([done[act], fresh < 0], axis=1)
            order = np.argsort(-all_sims, axis=1, kind="stable")[:, :width]
            ids[act], sims[act], done[act] = (np.take_along_axis(v, order, 1) for v in (all_ids, all_sims, all_done))
            act = act[~done[act].all(axis=1)]
            if not len(act):
                return ids, sims
            pick = np.argsort(done[act], axis=1, kind="stable")[:, :step]  # best not yet expanded
            nodes = np.where(np.take_along_axis(done[act], pick, 1), -1, np.take_along_axis(ids[act], pick, 1))
            done[act[:, None], pick] = True
            fresh = np.where(nodes[:, :, None] >= 0, links[nodes], -1).reshape(len(act), -1)
            fresh = np.where(fresh < limit, fresh, -1)
            fresh[seen[act[:, None], fresh]] = -1
            fresh = np.sort(fresh, axis=1)
            fresh[:, 1:][fresh[:, 1:] == fresh[:, :-1]] = -1
            fresh = -np.sort(-fresh, axis=1)
            fresh = fresh[:, :max(1, int((fresh >= 0).sum(1).max()))]

    def descend(self, q: np.ndarray, to_layer: int, width: int, limit: int | None = None) -> np.ndarray:
        """Entry nodes for ``to_layer``: greedy through the layers above it."""
        at = np.zeros((len(q), 1), np.int64)
        for layer in range(len(self.layers) - 1, to_layer, -1):
            at, _ = self.beam(q, layer, at, width, None if limit is None else min(limit, self.sizes[layer]))
            at = at[:, :2]
        return at

    def search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        return self.beam(q, 0, self.descend(q, 0, 4), width)


def _spread(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Neighbour choice of many nodes at once: candidates, best first, are taken if nearer to the
    node than to every one taken; the best of the rest fill free places."""
    m, k = ids.shape
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    taken = np.zeros((m, k), bool)
    worst = np.full((m, k), -np.inf, np.float32)  # nearest taken one, for each candidate
    v = x[ids]
    for c in range(k):
        ok = (ids[:, c] >= 0) & (sims[:, c] > worst[:, c]) & (taken.sum(1) < most)
        taken[:, c] = ok
        rows = np.flatnonzero(ok)
        if len(rows):
            worst[rows] = np.maximum(worst[rows], np.einsum("qkd,qd->qk", v[rows], v[rows, c]))
    rank = np.where(taken, 0, np.where(ids >= 0, 1, 2))
    pick = np.argsort(rank, axis=1, kind="stable")[:, :most]
    out = np.take_along_axis(ids, pick, 1)
    if out.shape[1] < most:
        out = np.concatenate([out, np.full((m, most - out.shape[1]), -1, np.int64)], axis=1)
    return out


def build(x: np.ndarray, seed: int = 7) -> Graph:
    """A graph over the unit vectors ``x``; row order is kept.  Returned with its node order."""
    n = len(x)
    rng = np.random.default_rng(seed)
    level = np.minimum((-np.log(rng.random(n) + 1e-300) / np.log(LINKS)).astype(np.int64), 8)
    sizes = [int((level >= k).sum()) for k in range(int(level.max(initial=0)) + 1)]
    order = np.lexsort((rng.random(n), -level))
    x = x[order]
    layers = [np.full((s, 2 * LINKS if k == 0 else LINKS), -1, np.int64) for k, s in enumerate(sizes)]
    graph = Graph(x, layers, sizes)
    most_rows = max(16, min(512, 24_000_000 // max(n, 1)))  # bounds the visited marks
    a = 1
    while a < n:  # nodes [0, a) are in; a batch at most doubles them
        b = min(n, a + min(a, most_rows))
        q, new = x[a:b], np.arange(a, b)
        for layer in range(len(layers) - 1, -1, -1):
            own = new[new < sizes[layer]]
            if not len(own):
                continue
            most, qq = layers[layer].shape[1], x[own]
            ids, sims = graph.beam(qq, layer, graph.descend(qq, layer, 4, a), BUILD_BEAM, min(a, sizes[layer]))
            near = qq @ qq.T
            np.fill_diagonal(near, -np.inf)
            near = np.where(np.tri(len(own), k=-1, dtype=bool), near, -np.inf)  # earlier ones of the batch
            k = min(BUILD_BEAM, len(own))
            side = np.argpartition(-near, k - 1, axis=1)[:, :k]
            side_sims = np.take_along_axis(near, side, 1)
            ids = np.concatenate([ids, np.where(np.isfinite(side_sims), own[side], -1)], axis=1)
            sims = np.concatenate([sims, side_sims], axis=1)
            chosen = _spread(x, ids, sims, LINKS)
            layers[layer][own, :LINKS] = chosen
            _link_back(x, layers[layer], own, chosen)
        a = b
    graph.order = order
    return graph


def _link_back(x: np.ndarray, links: np.ndarray, own: np.ndarray, chosen: np.ndarray) -> None:
    """Add the reverse links; a node with too many keeps a spread choice of them."""
    src = np.repeat(own, chosen.shape[1])
    dst = chosen.ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    order = np.argsort(dst, kind="stable")
    src, dst = src[order], dst[order]
    nodes, first, count = np.unique(dst, return_index=True, return_counts=True)
    most = links.shape[1]
    for a in range(0, len(nodes), 256):
        group, width = nodes[a:a + 256], int(count[a:a + 256].max())
        place = np.arange(width)[None, :]
        added = np.where(place < count[a:a + 256, None], src[np.minimum(first[a:a + 256, None] + place, len(src) - 1)], -1)
        both = np.concatenate([links[group], added], axis=1)
        sims = np.where(both >= 0, np.einsum("qkd,qd->qk", x[both], x[group]), -np.inf).astype(np.float32)
        room = (both >= 0).sum(1).max() <= most
        if room:
            links[group] = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)[:, :most]
        else:
            links[group] = _spread(x, both, sims, most)


def _scan(graph: Graph, q: np.ndarray, least: float):
    """All nodes of similarity ``least`` or more, by comparing with every vector."""
    qi, ni = [], []
    for a in range(0, len(q), 256):
        i, j = np.nonzero(q[a:a + 256] @ graph.x.T >= least)
        qi.append(i + a)
        ni.append(j)
    return (np.concatenate(qi), np.concatenate(ni)) if qi else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _planted(graph: Graph, at: np.ndarray, threshold: float, rng) -> np.ndarray:
    """Unit vectors of a cosine just above ``threshold`` to the nodes ``at``, in random directions."""
    x = graph.x[at].astype(np.float64)
    side = rng.standard_normal(x.shape)
    side -= (side * x).sum(1, keepdims=True) * x
    side /= np.maximum(np.sqrt((side * side).sum(1, keepdims=True)), 1e-12)
    c = min(1.0, threshold + 1e-3)
    return unit(c * x + np.sqrt(1 - c * c) * side)


def _links_of(graph: Graph, q: np.ndarray, least: float, own: np.ndarray) -> list[np.ndarray]:
    """Every node each query links to but itself (``own``: its node or -1)."""
    qi, ni = _scan(graph, q, least)
    keep = ni != own[qi]
    return np.split(ni[keep], np.searchsorted(qi[keep], np.arange(1, len(q))))


def audit_queries(graph: Graph, q: np.ndarray, threshold: float, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict, bool]:
    """Rows of ``q`` to judge and planted queries after them, the true links of each by its number
    (planted ones count on from ``len(q)``), and whether there are enough of them.  A query counts
    if it has links, but fewer than fill the widest beam."""
    least, rng = threshold - 1e-4, np.random.default_rng(11)
    truth, enough = {}, 0
    planted = np.zeros((0, q.shape[1]), np.float32)
    for plant in (False, True):
        order = rng.permutation(len(graph.x) if plant else len(q))[:AUDIT_MOST]
        for a in range(0, len(order), AUDIT_QUERIES):
            if enough >= AUDIT_QUERIES:
                break
            draw = order[a:a + AUDIT_QUERIES]
            if plant:
                part, self_, number = _planted(graph, draw, threshold, rng), np.full(len(draw), -1), len(q) + len(planted) + np.arange(len(draw))
                planted = np.concatenate([planted, part])
            else:
                part, self_, number = q[draw], own[draw], draw
            for i, links in zip(number.tolist(), _links_of(graph, part, least, self_)):
                if len(links):
                    truth[i] = links
                    enough += len(links) < WIDEST // 4
    return np.array([i for i in truth if i < len(q)], np.int64), planted, truth, enough >= AUDIT_QUERIES


def _search_all(graph: Graph, q: np.ndarray, least: float, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, node) pairs of beams from ``width`` on, and the queries that ended in the scan."""
    qi, ni, rest, beam = [], [], np.arange(len(q)), width
    while len(rest):
        if beam >= min(WIDEST, len(graph.x)):
            i, j = _scan(graph, q[rest], least)
            qi.append(rest[i])
            ni.append(j)
            break
        wider = []
        chunk = max(16, min(512, 24_000_000 // len(graph.x)))
        for a in range(0, len(rest), chunk):
            part = rest[a:a + chunk]
            ids, sims = graph.search(q[part], beam)
            full = sims[:, -1] >= least
            wider.append(part[full])
            i, j = np.nonzero((sims >= least) & ~full[:, None])
            qi.append(part[i])
            ni.append(ids[i, j])
        rest, beam = np.concatenate(wider), beam * 4
    qi, ni = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (qi, ni))
    return qi, ni, rest


def audit_recall(truth: dict, qi: np.ndarray, ni: np.ndarray, scanned: np.ndarray) -> float:
    """Mean share of a query's true links that were found, over queries not scanned."""
    exact, order = set(scanned.tolist()), np.argsort(qi, kind="stable")
    qi, ni = qi[order], ni[order]
    found = []
    for i, links in truth.items():
        if i not in exact:
            a, b = np.searchsorted(qi, [i, i + 1])
            found.append(np.isin(links, ni[a:b]).mean())
    return float(np.mean(found)) if found else 1.0


def range_search(graph: Graph, q: np.ndarray, threshold: float = COSINE, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) pairs of approximate similarity near ``threshold`` or more; audited.  ``own``
    is each query's own node, -1 for none."""
    least = threshold - 1e-4
    if not len(q):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    own = np.full(len(q), -1) if own is None else own
    judged, planted, truth, enough = audit_queries(graph, q, threshold, own)
    if not enough:
        return _scan(graph, q, least)
    both = np.concatenate([q[judged], planted])
    number = np.concatenate([judged, len(q) + np.arange(len(planted))])
    width = BEAM
    while width < min(WIDEST, len(graph.x)):  # the audit's queries alone, until it passes
        qi, ni, scanned = _search_all(graph, both, least, width)
        if audit_recall(truth, number[qi], ni, number[scanned]) >= AUDIT_RECALL:
            break
        width *= 4
    return _search_all(graph, q, least, width)[:2]


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links: each node with the smallest node of its component."""
    nodes, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = code[:len(a)], code[len(a):]
    root = np.arange(len(nodes))
    while len(u):
        low = np.minimum(root[u], root[v])
        before = root.copy()
        np.minimum.at(root, root[u], low)
        np.minimum.at(root, root[v], low)
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(before, root):
            break
    return nodes, nodes[root]


GRAPH = "dim int, shard int, ids array<long>, weights array<long>, vectors array<double>, links binary, sizes array<int>"


def build_shard(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """One shard's graph as one row: ids, weights and vectors in node order, links per layer."""
    pdf = pdf.sort_values("node")
    x = np.array(pdf["vector"].tolist(), np.float64)
    graph = build(unit(x))
    order = graph.order
    links = np.concatenate([layer.astype(np.int32).ravel() for layer in graph.layers])
    return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], "ids": [pdf["node"].to_numpy()[order]], "weights": [pdf["weight"].to_numpy()[order]],
                         "vectors": [x[order].ravel()], "links": [links.tobytes()], "sizes": [np.array(graph.sizes, np.int32)]})


def _load(row) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray]:
    ids = np.asarray(row["ids"], np.int64)
    x = np.asarray(row["vectors"], np.float64).reshape(len(ids), -1)
    links, layers, at = np.frombuffer(row["links"], np.int32).astype(np.int64), [], 0
    sizes = [int(s) for s in row["sizes"]]
    for k, s in enumerate(sizes):
        wide = 2 * LINKS if k == 0 else LINKS
        layers.append(links[at:at + s * wide].reshape(s, wide))
        at += s * wide
    return Graph(unit(x), layers, sizes), ids, np.asarray(row["weights"], np.int64), x


FOUND = "node long, n long, root long"


def search_block(queries: pd.DataFrame, graph: pd.DataFrame) -> pd.DataFrame:
    """Link counts of a block's queries in one shard (``root`` null), and the links' forest."""
    out = pd.DataFrame({"node": pd.Series(dtype="int64"), "n": pd.Series(dtype="Int64"), "root": pd.Series(dtype="Int64")})
    if not len(queries) or not len(graph):
        return out
    g, ids, weights, x = _load(graph.iloc[0])
    q = np.array(queries["vector"].tolist(), np.float64)
    node = queries["node"].to_numpy(np.int64)
    by = np.argsort(ids, kind="stable")
    at = by[np.minimum(np.searchsorted(ids, node, sorter=by), len(ids) - 1)]
    qi, ni = range_search(g, unit(q), own=np.where(ids[at] == node, at, -1))
    keep = np.zeros(len(qi), bool)
    for a in range(0, len(qi), 100_000):
        keep[a:a + 100_000] = cosine(q[qi[a:a + 100_000]], x[ni[a:a + 100_000]]) >= COSINE
    keep &= node[qi] != ids[ni]
    qi, ni = qi[keep], ni[keep]
    count = np.bincount(qi, weights[ni], len(q)).astype(np.int64)
    some = np.flatnonzero(count)
    a, b = _forest(node[qi], ids[ni])
    a, b = a[a != b], b[a != b]
    return pd.concat([pd.DataFrame({"node": node[some], "n": pd.array(count[some], "Int64"), "root": pd.array([None] * len(some), "Int64")}),
                      pd.DataFrame({"node": a, "n": pd.array([None] * len(a), "Int64"), "root": pd.array(b, "Int64")})])


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per row: ``vec_id, n_links, component_id, kept``."""
    spark = rows.sparkSession
    prepare(spark)
    base = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    base = base.withColumn("ok", F.col("vec_id").isNotNull() & usable(F.col("vector")))
    real = base.where("ok").select("vec_id", "vector")
    # Equal vectors: one node with a count.
    nodes = real.groupBy("vector").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("weight"))
    nodes = materialize(nodes.withColumn("dim", F.size("vector")), "vectors")
    n = nodes.count()
    shards = max(SHARDS, -(-n // SHARD_ROWS))
    blocks = max(1, -(-n // BLOCK_ROWS))
    place = lambda seed, k: F.pmod(F.xxhash64("vector", F.lit(seed)), F.lit(k)).cast("int")
    graphs = materialize(nodes.withColumn("shard", place(1, shards)).groupBy("dim", "shard").applyInPandas(build_shard, GRAPH), "graphs")
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    queries = nodes.select("dim", "node", "vector", place(2, blocks).alias("block")).withColumn("shard", each(shards))
    targets = graphs.withColumn("block", each(blocks))
    found = (queries.groupBy("dim", "shard", "block").cogroup(targets.groupBy("dim", "shard", "block")).applyInPandas(search_block, FOUND))
    found = materialize(found, "embedding-links")
    counts = found.where("root is null").groupBy("node").agg(F.sum("n").alias("n"))
    links = found.where("root is not null").select(F.col("node").alias("a"), F.col("root").alias("b"))
    comp = components(links).withColumnRenamed("component", "least")
    each_node = (nodes.select("vector", "node", "weight").join(counts, "node", "left").join(comp, "node", "left")
                 .select("vector", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("least", "node").alias("component_id")))
    placed = real.join(each_node, "vector").select("vec_id", "n_links", "component_id")
    alone = base.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return placed.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
