"""Operator 12: approximate nearest neighbours by hierarchical navigable small worlds, one a shard.

Vectors are dealt at random into shards of bounded size, and each shard becomes a layered graph in
flat arrays: the nodes stand in order of descending level, so that each layer is a leading part of
them, with one array of neighbours. A node is a different vector with the ids of all rows that
have it, so that copies, however many, crowd out nobody. Nodes are inserted in batches: a beam
search over the layers finds candidates for a whole batch at once, the batch's own nearest are
added, and of these each node links to those that are nearer to it than to a link chosen before
(then to the nearest left). Links go both ways; a full list is thinned by the same rule.

Graphs and queries are written as segments (``segments``). A task takes one segment of queries
through some shards, a beam search each; what the beam holds is scored again in double precision
on the original vectors, and the best of all shards of the task are its result. The best of all
tasks are taken by a window.

Rows with a null id, a null, empty or zero vector, or a null or non-finite component take no part.
Rows of one vec_id count once: the least vector. Vectors of different lengths are never compared.
Ties go to the smaller vec_id. A query without candidates has no rows, and an empty table gives
none. Other columns are ignored. Vectors are scaled by powers of two first, so that very large and
very small components neither overflow nor vanish.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import common, segments

#: Vectors of a shard and queries of a segment at most; queries searched at a time.
SHARD, QUERIES, BLOCK = 1 << 14, 1 << 12, 256
#: Links of a node in upper layers and in the lowest, and what a full list of links is thinned to, as a share.
LINKS, BASE_LINKS, THINNED = 16, 32, 0.75
#: Beams while building, while searching and in upper layers; nodes that a search expands at a time; nodes inserted at a time.
BUILD_BEAM, BEAM, UPPER_BEAM, EXPAND, BATCH = 64, 256, 16, 4, 256
NEAREST = 5


def beam(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, similarities), best first, of up to width nodes found for each query; -1 where there are fewer. entry: different nodes for each query, -1 for none."""
    n, k = len(q), entry.shape[1]
    width = max(width, k)
    seen = np.zeros((n, len(links) + 1), bool)  # the last column is for missing links
    seen[:, -1] = True
    ids, sim, done = np.full((n, width), -1), np.full((n, width), -np.inf, np.float32), np.ones((n, width), bool)
    ids[:, :k] = entry
    sim[:, :k] = np.where(entry < 0, -np.inf, np.einsum("akd,ad->ak", x[entry], q))
    done[:, :k] = entry < 0
    np.put_along_axis(seen, entry, True, 1)
    live = np.arange(n)
    step = min(EXPAND, width)
    while True:
        open_ = np.where(done[live], -np.inf, sim[live])
        live, open_ = live[(some := open_.max(1) > -np.inf)], open_[some]
        if not len(live):
            break
        at = np.argpartition(-open_, step - 1, axis=1)[:, :step] if step < width else np.argsort(-open_, axis=1)
        real = np.take_along_axis(open_, at, 1) > -np.inf
        mine = done[live]
        np.put_along_axis(mine, at, True, 1)
        near = np.where(real[:, :, None], links[np.take_along_axis(ids[live], at, 1)], -1)
        for j in range(step):  # one list after another, as two may hold the same node
            part = near[:, j]
            part[seen[live[:, None], part]] = -1
            seen[live[:, None], part] = True
        near = near.reshape(len(live), -1)
        s = np.where(near < 0, -np.inf, np.einsum("akd,ad->ak", x[near], q[live])).astype(np.float32)
        s, i, d = np.concatenate([sim[live], s], 1), np.concatenate([ids[live], near], 1), np.concatenate([mine, near < 0], 1)
        top = np.argpartition(-s, width - 1, axis=1)[:, :width]
        sim[live], ids[live], done[live] = (np.take_along_axis(v, top, 1) for v in (s, i, d))
    order = np.argsort(-sim, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sim, order, 1)


def choose(x: np.ndarray, ids: np.ndarray, sim: np.ndarray, m: int) -> np.ndarray:
    """Up to m of each row's candidates (best first, -1 for none): those nearer to the row's node than to one chosen before, then the nearest left."""
    v = x[ids]
    pair = v @ v.transpose(0, 2, 1)
    chosen, nearest, n = np.zeros(ids.shape, bool), np.full(ids.shape, -np.inf, np.float32), np.zeros(len(ids), np.int64)
    for c in range(ids.shape[1]):
        ok = (ids[:, c] >= 0) & (n < m) & (sim[:, c] > nearest[:, c])
        chosen[:, c] = ok
        n += ok
        nearest = np.where(ok[:, None], np.maximum(nearest, pair[:, c]), nearest)
    order = np.argsort(np.where(chosen, 0, 1) + np.where(ids < 0, 2, 0), axis=1, kind="stable")[:, :m]
    out = np.take_along_axis(ids, order, 1)
    return np.pad(out, ((0, 0), (0, m - out.shape[1])), constant_values=-1)


def _link_back(x: np.ndarray, links: np.ndarray, source: np.ndarray, target: np.ndarray) -> None:
    """Adds links target -> source, a few for each target at a time; full lists are thinned."""
    m = links.shape[1]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    nth = np.arange(len(target)) - np.searchsorted(target, target)
    few = max(1, m - int(m * THINNED))
    for start in range(0, int(nth.max(initial=-1)) + 1, few):
        now = (nth >= start) & (nth < start + few)
        nodes, own = np.unique(target[now], return_inverse=True)
        new = np.full((len(nodes), few), -1)
        new[own, nth[now] - start] = source[now]
        have = (links[nodes] >= 0).sum(1)
        more = (new >= 0).sum(1)
        fits = have + more <= m
        for i in range(few):
            row = np.flatnonzero(fits & (i < more))
            links[nodes[row], have[row] + i] = new[row, i]
        full = np.flatnonzero(~fits)
        for at in range(0, len(full), 1024):
            row = full[at : at + 1024]
            cand = np.concatenate([links[nodes[row]], new[row]], 1)
            sim = np.where(cand < 0, -np.inf, np.einsum("akd,ad->ak", x[cand], x[nodes[row]]))
            best = np.argsort(-sim, axis=1, kind="stable")
            kept = choose(x, np.take_along_axis(cand, best, 1), np.take_along_axis(sim, best, 1), int(m * THINNED))
            links[nodes[row]] = np.pad(kept, ((0, 0), (0, m - kept.shape[1])), constant_values=-1)


def build(x: np.ndarray, level: np.ndarray) -> list[np.ndarray]:
    """Neighbour arrays of the layers, lowest first; x: unit vectors in order of descending level."""
    sizes = [int((level >= k).sum()) for k in range(int(level.max(initial=0)) + 1)]
    layers = [np.full((n, BASE_LINKS if k == 0 else LINKS), -1) for k, n in enumerate(sizes)]
    for first in range(0, len(x), BATCH):
        last = min(len(x), first + BATCH)
        q, entry = x[first:last], np.zeros((last - first, 1), np.int64)
        for k in range(len(layers) - 1, -1, -1):
            old, end = min(first, sizes[k]), min(last, sizes[k])
            ids, sim = np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0), np.float32)
            if old:
                ids, sim = beam(x, layers[k], q, entry, BUILD_BEAM if end > first else UPPER_BEAM)
                entry = ids[:, :UPPER_BEAM]
            if end <= first:
                continue
            own = q[: end - first]
            across = own @ own.T
            np.fill_diagonal(across, -np.inf)
            some = np.argsort(-across, axis=1, kind="stable")[:, : LINKS if old else BUILD_BEAM][:, : max(0, len(own) - 1)]
            ids = np.concatenate([ids[: len(own)], some + first], 1)
            sim = np.concatenate([sim[: len(own)], np.take_along_axis(across, some, 1)], 1)
            best = np.argsort(-sim, axis=1, kind="stable")[:, :BUILD_BEAM]
            links = choose(x, np.take_along_axis(ids, best, 1), np.take_along_axis(sim, best, 1), LINKS) if ids.shape[1] else np.full((len(own), LINKS), -1)
            layers[k][first:end, :LINKS] = links
            row, col = np.nonzero(links >= 0)
            target, source = links[row, col], row + first
            mutual = (layers[k][target] == source[:, None]).any(1)
            _link_back(x, layers[k], source[~mutual], target[~mutual])
    return layers


def search(x: np.ndarray, layers: list[np.ndarray], q: np.ndarray, width: int) -> np.ndarray:
    """Nodes found for each unit query, -1 where there are fewer."""
    entry = np.zeros((len(q), 1), np.int64)
    for links in layers[:0:-1]:
        entry = beam(x, links, q, entry, UPPER_BEAM)[0]
    return beam(x, layers[0], q, entry, width)[0]


def scaled(table: pa.Table):
    """For each length of vectors: ids and vectors, these scaled by a power of two each so that the largest component is about 1."""
    v, size = segments.matrix(table.column("vector"))
    ids, first = table.column("vec_id").to_numpy(), np.cumsum(size) - size
    for d in np.unique(size):
        own = np.flatnonzero(size == d)
        own = own[np.argsort(ids[own], kind="stable")]
        m = v[first[own][:, None] + np.arange(d)]
        yield ids[own], np.ldexp(m, -np.frexp(np.abs(m).max(1))[1][:, None])


def norms(v: np.ndarray) -> np.ndarray:
    return np.sqrt((v * v).sum(1))


def pack_graph(table: pa.Table) -> dict[str, np.ndarray]:
    """Graphs of the vectors of each length: vectors, layers, and the ids of each node, one after another, ascending."""
    out: dict[str, np.ndarray] = {}
    for g, (ids, v) in enumerate(scaled(table)):
        _, first, node = np.unique(np.ascontiguousarray(v).view(np.dtype((np.void, v.itemsize * v.shape[1]))).ravel(), return_index=True, return_inverse=True)
        u = (common.mix64(ids[first].astype(np.uint64)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        level = np.minimum(-np.log(1 - u) / np.log(LINKS), 8).astype(np.int64)
        order = np.lexsort((ids[first], -level))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        vectors = v[first[order]]
        owner = place[node]
        by = np.argsort(owner, kind="stable")  # ids ascend within a node, as they do in the table
        layers = build((vectors / norms(vectors)[:, None]).astype(np.float32), level[order])
        out |= {f"{g}.vectors": vectors, f"{g}.ids": ids[by], f"{g}.cut": np.searchsorted(owner[by], np.arange(len(order) + 1))}
        out |= {f"{g}.layer{k}": links.astype(np.int32) for k, links in enumerate(layers)}
    return out


def pack_queries(table: pa.Table) -> dict[str, np.ndarray]:
    return {f"{g}.{k}": a for g, (ids, v) in enumerate(scaled(table)) for k, a in (("ids", ids), ("vectors", v))}


def _found(graph: dict, g: str, q: np.ndarray, own: np.ndarray, k: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, vec_id, cosine) of the k best candidates or more for each query, from one graph."""
    v, ids, cut = graph[f"{g}.vectors"], graph[f"{g}.ids"], graph[f"{g}.cut"]
    layers = [graph[f"{g}.layer{i}"] for i in range(sum(name.startswith(f"{g}.layer") for name in graph))]
    length, unit = norms(v), (v / norms(v)[:, None]).astype(np.float32)
    parts = []
    for at in range(0, len(q), BLOCK):
        block = q[at : at + BLOCK]
        nodes = search(unit, layers, (block / norms(block)[:, None]).astype(np.float32), max(width, k + 1))
        row, col = np.nonzero(nodes >= 0)
        node = nodes[row, col]
        # products are summed along rows of one length each, so that copies in any shard get the very same score
        score = (block[row] * v[node]).sum(1) / (norms(block)[row] * length[node])
        best = np.lexsort((node, -score, row))
        row, node, score = row[best], node[best], score[best]
        kept = np.arange(len(row)) - np.searchsorted(row, row) <= k  # one more than k nodes, as one may be the query alone
        tied = score >= score[np.minimum(np.searchsorted(row, row) + k, np.searchsorted(row, row, "right") - 1)]
        row, node, score = (a[kept | tied] for a in (row, node, score))
        n = np.minimum(cut[node + 1] - cut[node], k + 1)  # the smallest ids of each node are enough
        pick = np.repeat(cut[node], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        row, score, vec = np.repeat(row, n) + at, np.repeat(score, n), ids[pick]
        other = vec != own[row]
        parts.append((row[other], vec[other], score[other]))
    return tuple(np.concatenate(p) for p in zip(*parts))


def searcher(k: int, width: int):
    def run(queries: dict, graphs):
        state: dict[int, list] = {}
        groups = [(g, queries[f"{g}.ids"], queries[f"{g}.vectors"]) for g in range(len(queries) // 2)]
        for graph in graphs:
            sizes = {graph[name].shape[1]: name.split(".")[0] for name in graph if name.endswith(".vectors")}
            for g, own, q in groups:
                if q.shape[1] not in sizes:
                    continue
                found = _found(graph, sizes[q.shape[1]], q, own, k, width)
                found = [np.concatenate(p) for p in zip(state[g], found)] if g in state else found
                order = np.lexsort((found[1], -found[2], found[0]))
                row = found[0][order]
                order = order[np.arange(len(row)) - np.searchsorted(row, row) < k]
                state[g] = [a[order] for a in found]
        for g, own, _ in groups:
            if g in state:
                row, vec, score = state[g]
                yield pa.RecordBatch.from_arrays([pa.array(own[row]), pa.array(vec), pa.array(score)], ["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, queries: Column | None = None, k: int = NEAREST, width: int = BEAM, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each query the k rows of the largest cosine that are found, itself left out.

    queries: which rows are queries (by their id alone, ``vec_id``); those divisible by 50 unless given.
    """
    queries = F.col("vec_id") % 50 == 0 if queries is None else queries
    bin_: list[str] = []
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.filter(F.col("vec_id").isNotNull() & segments.usable(F.col("vector")) & F.exists("vector", lambda x: x != 0))
    rows = common.settle(rows.groupBy("vec_id").agg(F.min("vector").alias("vector")), "vectors", bin_)
    spark = rows.sparkSession
    shards, blocks = (common.scratch(spark, name) for name in ("graphs", "queries"))
    graphs = segments.write(segments.dealt(rows, SHARD), shards, pack_graph, SHARD)
    asked = segments.write(segments.dealt(rows.filter(queries), QUERIES), blocks, pack_queries, QUERIES)
    bin_ += [folder for folder, names in ((shards, graphs), (blocks, asked)) if names]
    found = segments.tiles(spark, (blocks, asked), (shards, graphs), searcher(k, width), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return common.final(out.select("query_id", "rank", "vec_id", "score"), "nearest", bin_)
