"""Approximate nearest neighbours by largest inner product, with a robust-pruned directed graph per shard.

Rows are dealt evenly to shards of a bounded number of rows. Inside a shard equal vectors are one node, which keeps its
smallest ids, as many as an answer could need. An added coordinate makes the largest inner product the least distance.
Nodes are inserted in batches: a greedy beam search over the graph so far proposes neighbours, and relaxed pruning keeps an
edge only if no kept neighbour is clearly nearer to its end, so kept edges are diverse. Back edges are pruned the same way.
Searches start from far-apart entry nodes and run as a beam; every query searches every shard, and the best of all shards
are the answer. The graph is a written table; a search streams queries past one shard at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quellspan.session import written

SHARD_ROWS, LEAST_SHARDS = 65_536, 12
DEGREE, BUILD_BEAM, RELAX = 48, 96, 1.2
ENTRIES, SEARCH_BEAM = 64, 160
BATCH = 256

INDEX = "dim int, shard int, node int, vec array<double>, ids array<long>, rows array<long>, near array<int>, entry boolean"


# ---- one shard ----------------------------------------------------------------------------------------------------------


def lifted(x: np.ndarray) -> np.ndarray:
    """Vectors with one coordinate more, so that all have the same length."""
    norms = (x * x).sum(1)
    return np.column_stack([x, np.sqrt(np.maximum(norms.max(initial=0) - norms, 0))]).astype(np.float32)


def far_apart(x: np.ndarray, most: int) -> np.ndarray:
    """Positions picked one after the other, each the farthest from those before it."""
    picked, far = [], np.full(len(x), np.inf)
    at = int(np.argmin(((x - x.mean(0)) ** 2).sum(1))) if len(x) else 0
    while len(picked) < min(most, len(x)) and far[at] > 0:
        picked.append(at)
        far = np.minimum(far, ((x - x[at]) ** 2).sum(1))
        at = int(np.argmax(far))
    return np.array(picked, np.int64)


def beam_search(x: np.ndarray, graph: np.ndarray, entries: np.ndarray, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (-1: none) and squared distances of the nodes in each query's final beam, nearest first."""
    n, m = len(x), len(queries)
    seen = np.zeros((m, n + 1), bool)
    seen[:, n] = True
    seen[:, entries] = True
    norms = (x * x).sum(1)
    ids = np.tile(entries, (m, 1))
    dist = norms[entries][None, :] - 2 * queries @ x[entries].T
    width = max(beam, ids.shape[1])
    ids = np.pad(ids, ((0, 0), (0, width - ids.shape[1])), constant_values=n)
    dist = np.pad(dist, ((0, 0), (0, width - dist.shape[1])), constant_values=np.inf)
    order = np.argsort(dist, axis=1, kind="stable")[:, :beam]
    ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
    done = ids == n
    live = np.arange(m)
    while True:
        todo = ~done[live]
        going = todo.any(1)
        live, todo = live[going], todo[going]
        if not len(live):
            break
        at = todo.argmax(1)
        done[live, at] = True
        near = graph[ids[live, at]]
        new = ~seen[live[:, None], near]
        seen[live[:, None], near] = True
        # what is new, each query's packed to the left
        width = int(new.sum(1).max(initial=0))
        if not width:
            continue
        left = np.argsort(~new, axis=1, kind="stable")[:, :width]
        near = np.where(np.take_along_axis(new, left, 1), np.take_along_axis(near, left, 1), n)
        own = np.minimum(near, n - 1)
        d = norms[own] - 2 * np.matmul(x[own], queries[live][:, :, None])[:, :, 0]
        d[near == n] = np.inf
        both = np.concatenate([dist[live], d], 1)
        order = np.argsort(both, axis=1, kind="stable")[:, :beam]
        ids[live] = np.take_along_axis(np.concatenate([ids[live], near], 1), order, 1)
        dist[live] = np.take_along_axis(both, order, 1)
        done[live] = np.take_along_axis(np.concatenate([done[live], near == n], 1), order, 1)
    return np.where(ids == n, -1, ids), dist


def robust_prune(x: np.ndarray, points: np.ndarray, found: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """Up to ``degree`` neighbours (padded with len(x)) per point from its row of ``found`` (-1: none).

    The nearest candidate left is kept; every other whose distance to it, times ``relax``, is no larger than its distance to
    the point falls out; and so on. Rows with fewer kept than allowed are filled with the nearest of those that fell out.
    """
    n = len(x)
    found = np.sort(np.where((found < 0) | (found == points[:, None]), n, found), axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = n
    own = np.minimum(found, n - 1)
    c = x[own]
    to_point = ((c - x[points][:, None, :]) ** 2).sum(2)
    to_point[found == n] = np.inf
    order = np.argsort(to_point, axis=1, kind="stable")
    found, to_point = np.take_along_axis(found, order, 1), np.take_along_axis(to_point, order, 1)
    c = np.take_along_axis(c, order[:, :, None], 1)
    norms = (c * c).sum(2)
    between = norms[:, :, None] + norms[:, None, :] - 2 * np.matmul(c, c.transpose(0, 2, 1))
    covered = relax * relax * np.maximum(between, 0) <= to_point[:, None, :]
    alive = found < n
    kept = np.zeros_like(alive)
    every = np.arange(len(points))
    for _ in range(min(degree, found.shape[1])):
        at = alive.argmax(1)
        any_left = alive[every, at]
        if not any_left.any():
            break
        kept[every[any_left], at[any_left]] = True
        alive &= ~(covered[every, at] & any_left[:, None])
        alive[every, at] = False
    room = degree - kept.sum(1)
    spare = (found < n) & ~kept
    kept |= spare & (np.cumsum(spare, 1) <= room[:, None])
    order = np.argsort(~kept, axis=1, kind="stable")[:, :degree]
    out = np.full((len(points), degree), n)
    out[:, : order.shape[1]] = np.where(np.take_along_axis(kept, order, 1), np.take_along_axis(found, order, 1), n)
    return out


def build_graph(x: np.ndarray, degree: int, beam: int, relax: float) -> tuple[np.ndarray, np.ndarray]:
    """The neighbours of each of n nodes, padded with n, and the entry nodes."""
    n = len(x)
    graph = np.full((n + 1, degree), n, np.int64)
    entries = far_apart(x, ENTRIES)
    rest = np.setdiff1d(np.random.default_rng(n).permutation(n), entries, assume_unique=True)
    rest = np.random.default_rng(n + 1).permutation(rest)
    if len(entries) > 1:
        graph[entries] = robust_prune(x, entries, np.tile(entries, (len(entries), 1)), degree, relax)
    at = 0
    while at < len(rest):
        new = rest[at : at + min(BATCH, max(16, (at + len(entries)) // 8))]
        at += len(new)
        found, _ = beam_search(x, graph, entries, x[new], beam)
        graph[new] = robust_prune(x, new, found, degree, relax)
        a, b = np.repeat(new, degree), graph[new].ravel()
        a, b = a[b < n], b[b < n]
        order = np.argsort(b, kind="stable")
        targets, start, count = np.unique(b[order], return_index=True, return_counts=True)
        wide = int(count.max(initial=0))
        back = np.full((len(targets), wide), -1)
        back[np.repeat(np.arange(len(targets)), count), np.arange(len(order)) - np.repeat(start, count)] = a[order]
        for i in range(0, len(targets), BATCH):
            t = targets[i : i + BATCH]
            graph[t] = robust_prune(x, t, np.concatenate([np.where(graph[t] == n, -1, graph[t]), back[i : i + BATCH]], 1), degree, relax)
    return graph, entries


# ---- tables -------------------------------------------------------------------------------------------------------------


def valid(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(id, vec, dim)`` of the rows whose vector has components, all finite and not all zero."""
    vec = F.col(vec_col).cast("array<double>")
    bad = F.exists(vec, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return df.select(F.col(id_col).alias("id"), vec.alias("vec"), F.size(vec).alias("dim")).where(F.col("id").isNotNull() & (F.col("dim") > 0) & ~bad & F.exists("vec", lambda v: v != 0))


def _matrix(column, n: int) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column]).to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1)


def build_index(rows: DataFrame, answers: int, shards: int, degree: int = DEGREE, beam: int = BUILD_BEAM, relax: float = RELAX) -> DataFrame:
    """The graph of ``rows(row, id, vec, dim)`` as a table, a row per node. ``answers``: how many equal ids a node keeps, less one."""

    def graph_of(dim, shard, parts):
        rows_, ids = (np.concatenate([p.column(i).to_numpy(zero_copy_only=False) for p in parts]) for i in (2, 3))
        vec = _matrix([p.column(4) for p in parts], len(ids))
        x, which = np.unique(vec, axis=0, return_inverse=True)
        order = np.lexsort((rows_, ids, which.ravel()))
        edges = np.searchsorted(which.ravel()[order], np.arange(len(x) + 1))
        members = [order[a : min(b, a + answers + 1)] for a, b in zip(edges[:-1], edges[1:])]
        graph, entries = build_graph(lifted(x), degree, beam, relax)
        starts = np.isin(np.arange(len(x)), entries)
        for a in range(0, len(x), 4096):
            b = min(a + 4096, len(x))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([dim] * (b - a), pa.int32()),
                    pa.array([shard] * (b - a), pa.int32()),
                    pa.array(np.arange(a, b), pa.int32()),
                    pa.array(list(x[a:b]), pa.list_(pa.float64())),
                    pa.array([ids[m] for m in members[a:b]], pa.list_(pa.int64())),
                    pa.array([rows_[m] for m in members[a:b]], pa.list_(pa.int64())),
                    pa.array([g[g < len(x)] for g in graph[a:b]], pa.list_(pa.int32())),
                    pa.array(starts[a:b]),
                ],
                ["dim", "shard", "node", "vec", "ids", "rows", "near", "entry"],
            )

    def run(batches):
        for (dim, shard), parts in _runs(batches):
            yield from graph_of(dim, shard, list(parts))

    dealt = rows.select("dim", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard"), "row", "id", "vec")
    return dealt.repartitionByRange(shards, "dim", "shard").sortWithinPartitions("dim", "shard").mapInArrow(run, INDEX)


def _runs(batches):
    """``((dim, shard), pieces)`` for each run of rows of one shard; pieces is a list for all but the last run of a batch."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        dim, shard = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        edges = [0, *(np.flatnonzero((dim[1:] != dim[:-1]) | (shard[1:] != shard[:-1])) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:]):
            own = (int(dim[a]), int(shard[a]))
            if held and own != key:
                yield key, held
                held = []
            key = own
            held.append(batch.slice(a, b - a))
    if held:
        yield key, held


class _Shard:
    """The nodes of one shard, gathered from index rows."""

    def __init__(self, parts):
        n = sum(p.num_rows for p in parts)
        node = np.concatenate([p.column(3).to_numpy(zero_copy_only=False) for p in parts])
        order = np.argsort(node)
        self.vec = _matrix([p.column(4) for p in parts], n)[order]
        self.ids, self.rows, near = ([x for p in parts for x in p.column(i).to_pylist()] for i in (5, 6, 7))
        self.ids, self.rows = [self.ids[i] for i in order], [self.rows[i] for i in order]
        self.graph = np.full((n + 1, max(map(len, near), default=1) or 1), n, np.int64)
        for to, i in enumerate(order.tolist()):
            self.graph[to, : len(near[i])] = near[i]
        self.entries = np.flatnonzero(np.concatenate([p.column(8).to_numpy(zero_copy_only=False) for p in parts])[order])
        self.x = lifted(self.vec)

    def answer(self, q_row, q_id, q_vec, answers, beam):
        """``(q_row, q_id, id, score)`` rows: the best of this shard for each query."""
        out = []
        for a in range(0, len(q_vec), BATCH):
            v = q_vec[a : a + BATCH]
            found, _ = beam_search(self.x, self.graph, self.entries, np.column_stack([v, np.zeros(len(v))]).astype(np.float32), max(beam, answers + 1))
            for k in range(len(v)):
                nodes = found[k][found[k] >= 0]
                score = self.vec[nodes] @ v[k]
                order = np.argsort(-score, kind="stable")
                rows = [(float(score[i]), d) for i in order.tolist() for d, r in zip(self.ids[nodes[i]], self.rows[nodes[i]]) if r != q_row[a + k]]
                rows.sort(key=lambda t: (-t[0], t[1]))
                out += [(int(q_row[a + k]), int(q_id[a + k]), d, s) for s, d in rows[:answers]]
        return out


def search(index: DataFrame, queries: DataFrame, answers: int, shards: int, beam: int = SEARCH_BEAM) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the best ``answers`` rows for each of ``queries(row, id, vec, dim)``, its own row aside."""
    none = lambda kind: F.lit(None).cast(kind)
    nodes = index.select("dim", "shard", F.lit(0).alias("kind"), F.col("node").cast("long").alias("at"), "vec", "ids", "rows", "near", "entry")
    asked = queries.select("dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), F.col("row").alias("at"), "vec", F.array("id").alias("ids"), none("array<long>").alias("rows"), none("array<int>").alias("near"), none("boolean").alias("entry"))

    def run(batches):
        key, parts, shard = None, [], None
        for batch in batches:
            for own, pieces in _runs([batch]):
                if own != key:
                    key, parts, shard = own, [], None
                for piece in pieces:
                    kind = piece.column(2).to_numpy(zero_copy_only=False)
                    cut = int((kind == 0).sum())
                    if cut:
                        parts.append(piece.slice(0, cut))
                    if cut < piece.num_rows and parts:
                        shard = shard or _Shard(parts)
                        q = piece.slice(cut)
                        ids = q.column(5).flatten().to_numpy(zero_copy_only=False)
                        rows = shard.answer(q.column(3).to_numpy(zero_copy_only=False), ids, _matrix([q.column(4)], q.num_rows), answers, beam)
                        if rows:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.float64()))], ["q_row", "query_id", "vec_id", "score"])

    met = nodes.unionByName(asked).repartitionByRange(shards, "dim", "shard").sortWithinPartitions("dim", "shard", "kind", "at")
    found = met.mapInArrow(run, "q_row long, query_id long, vec_id long, score double")
    best = Window.partitionBy("q_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= answers).select("query_id", "rank", "vec_id", "score")


def nearest(df: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", answers: int = 20, beam: int = SEARCH_BEAM) -> DataFrame:
    """For every row where ``is_query`` (a condition on ``id``) holds, its ``answers`` nearest rows among all others.

    Vectors that are null, empty, zero or hold a null or non-finite component take no part, and neither do rows without id.
    Only vectors of as many components are compared. Repeated rows are rows of their own: each can be an answer for the other.
    """
    rows = written(valid(df, id_col, vec_col).withColumn("row", F.monotonically_increasing_id()), "vectors")
    shards = max(LEAST_SHARDS, -(-rows.count() // SHARD_ROWS))
    index = written(build_index(rows, answers, shards), "vectors-graph")
    return search(index, rows.where(is_query), answers, shards, beam)
