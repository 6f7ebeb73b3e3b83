"""Proximity graphs over clouds, one per bounded part of a neighbourhood: greedy beam search, robust pruning, batched insertion."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions.quantize import lloyd
from .search import PAIRS, _pairs


class Shard:
    """The clouds of a shard with the distances a graph needs."""

    def __init__(self, flat: np.ndarray, off: np.ndarray, metric: str, measure: Any = None):
        self.flat, self.off, self.metric = flat, off, metric
        self.measure = measure

    def __len__(self) -> int:
        return len(self.off) - 1

    def to(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Distances from cloud ``q`` to the shard's ``rows``."""
        sizes = self.off[rows + 1] - self.off[rows]
        at = np.repeat(self.off[rows] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        block = self.measure(q, self.flat[at]) if self.measure else K.pair_distances(q, self.flat[at], self.metric)
        return K.reduce_chamfer(block, np.array([0, len(q)]), np.concatenate([[0], np.cumsum(sizes)]))[0]

    def cloud(self, i: int) -> np.ndarray:
        return self.flat[self.off[i] : self.off[i + 1]]


def beam_search(shard: Shard, graph: list[np.ndarray], q: np.ndarray, beam: int, start: int = 0) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Nodes and distances of the final frontier, ascending, and the nodes visited."""
    nodes, dist = np.array([start]), shard.to(q, np.array([start]))
    seen, visited = {start}, []
    done: set[int] = set()
    while True:
        todo = [int(n) for n in nodes if int(n) not in done]
        if not todo:
            return nodes, dist, visited
        p = todo[0]
        done.add(p)
        visited.append(p)
        new = np.array([x for x in graph[p].tolist() if x not in seen], np.int64)
        if len(new):
            seen.update(new.tolist())
            d = shard.to(q, new)
            if len(nodes) >= beam:
                ok = d < dist[-1]
                new, d = new[ok], d[ok]
            nodes, dist = np.concatenate([nodes, new]), np.concatenate([dist, d])
            order = np.lexsort((nodes, dist))[:beam]
            nodes, dist = nodes[order], dist[order]


def robust_prune(shard: Shard, p: int, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """At most ``degree`` neighbours: nearest first, each hiding those that it is (alpha times) nearer to than ``p`` is."""
    candidates = np.unique(candidates[candidates != p])
    if not len(candidates):
        return candidates
    d = shard.to(shard.cloud(p), candidates)
    order = np.lexsort((candidates, d))
    candidates, d = candidates[order], d[order]
    alive, out = np.ones(len(candidates), bool), []
    for i in range(len(candidates)):
        if not alive[i]:
            continue
        out.append(int(candidates[i]))
        if len(out) == degree:
            break
        rest = np.flatnonzero(alive[i + 1 :]) + i + 1
        if len(rest):
            between = shard.to(shard.cloud(int(candidates[i])), candidates[rest])
            # IP distances are negative: alpha scales towards "farther" either way.
            alive[rest[np.where(between >= 0, alpha * between, between / alpha) <= d[rest]]] = False
    return np.array(out, np.int64)


def _search_prune(shard: Shard, graph: list[np.ndarray], p: int, degree: int, beam: int, alpha: float) -> np.ndarray:
    _, _, visited = beam_search(shard, graph, shard.cloud(p), beam)
    return robust_prune(shard, p, np.concatenate([graph[p], np.array(visited, np.int64)]), degree, alpha)


def build_graph(shard: Shard, degree: int, beam: int, alpha: float, two_pass: bool = False) -> list[np.ndarray]:
    """Batched insertion; neighbours end sorted by distance.

    Batches double up to a fiftieth of the nodes. All of a batch search the graph as it was, then their edges and the
    reverse ones are added together and what overflows is pruned. With ``two_pass`` all nodes go in once with alpha 1,
    then again with ``alpha``.
    """
    n = len(shard)
    graph: list[np.ndarray] = [np.zeros(0, np.int64) for _ in range(n)]
    for turn, a in enumerate([1.0, alpha] if two_pass else [alpha]):
        done = 0 if turn else 1
        while done < n:
            batch = range(done, min(n, done + max(1, min(max(1, done), -(-n // 50)))))
            fresh = {p: _search_prune(shard, graph, p, degree, beam, a) for p in batch}
            back: dict[int, list[int]] = {}
            for p, out in fresh.items():
                graph[p] = out
                for x in out.tolist():
                    back.setdefault(x, []).append(p)
            for x, more in back.items():
                both = np.unique(np.append(graph[x], more))
                graph[x] = both if len(both) <= degree else robust_prune(shard, x, both, degree, a)
            done = batch[-1] + 1
    for p in range(n):
        if len(graph[p]):
            d = shard.to(shard.cloud(p), graph[p])
            graph[p] = graph[p][np.lexsort((graph[p], d))]
    return graph


GRAPH = "cell int, part int, pos int, cloud_id long, vectors array<array<float>>, neighbors array<int>"
#: Clouds whose means the cells are found from, the most cells, and queries of one pass.
ROUTE_POOL, MAX_CELLS, PASS_QUERIES = 20_000, 1024, 100_000


def _cells(clouds: DataFrame, metric: str, n: int, seed: int) -> np.ndarray:
    """Centers of ``n`` cells of cloud means, from a bounded hash sample."""
    rows = clouds.orderBy(F.xxhash64(F.lit(seed), F.col("cloud_id")), "cloud_id").limit(ROUTE_POOL).select("vectors").collect()
    means = np.array([np.mean(r.vectors, 0) for r in rows], np.float64)
    return lloyd(means, n, 10, seed, None, metric == "ip")[0]


def nearest_cells(rows: DataFrame, id_col: str, centers: np.ndarray, metric: str, top: int) -> DataFrame:
    """(id, cell, vectors): the ``top`` cells nearest to each cloud's mean."""
    sent = rows.sparkSession.sparkContext.broadcast(centers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, off = K.ragged(batch.column(1))
            full = np.flatnonzero(np.diff(off))
            if not len(full):
                continue
            means = np.add.reduceat(flat, off[full], axis=0) / np.diff(off)[full, None]
            near = np.argsort(K.pair_distances(means, sent.value, metric), axis=1, kind="stable")[:, :top]
            at = pa.array(np.repeat(full, near.shape[1]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(near.ravel(), pa.int32()), batch.column(1).take(at)], names=[id_col, "cell", "vectors"])

    return rows.select(F.col(id_col).cast("long").alias(id_col), "vectors").mapInArrow(run, f"{id_col} long, cell int, vectors array<array<float>>")


def build_graphs(clouds: DataFrame, metric: str, degree: int, beam: int, alpha: float, shard_rows: int, two_pass: bool = False, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """graph(cell, part, pos, cloud_id, vectors, neighbors), one graph per part, and routes(cell, center, parts).

    Cells are neighbourhoods of cloud means, about ``shard_rows`` clouds each and at most MAX_CELLS; a cell of more than
    twice as many is dealt out to parts by id.
    """
    wanted = min(MAX_CELLS, max(1, -(-clouds.count() // shard_rows)))
    centers = _cells(clouds, metric, wanted, seed)
    placed = nearest_cells(clouds, "cloud_id", centers, metric, 1)
    sizes = {r.cell: r["count"] for r in placed.groupBy("cell").count().collect()}
    spark = clouds.sparkSession
    routes = spark.createDataFrame([(c, centers[c].tolist(), -(-n // (2 * shard_rows))) for c, n in sorted(sizes.items())], "cell int, center array<double>, parts int")

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("cloud_id")
        flat, off = K.ragged(group["vectors"])
        graph = build_graph(Shard(flat, off, metric), degree, beam, alpha, two_pass)
        return pa.table({"cell": group["cell"], "part": group["part"], "pos": pa.array(np.arange(len(graph)), pa.int32()), "cloud_id": group["cloud_id"], "vectors": group["vectors"], "neighbors": pa.array([g.astype(np.int32) for g in graph], pa.list_(pa.int32()))})

    keyed = placed.join(F.broadcast(routes.select("cell", "parts")), "cell").select("cell", F.pmod(F.xxhash64("cloud_id"), F.col("parts")).cast("int").alias("part"), "cloud_id", "vectors")
    return keyed.groupBy("cell", "part").applyInArrow(run, GRAPH), routes


def search_graphs(queries: DataFrame, graph: DataFrame, routes: DataFrame, k: int, beam: int, metric: str, scorer: Any = None, cells: int = 8) -> DataFrame:
    """(query_id, cloud_id, distance): up to ``k`` per query and part, by beam search in the graphs of the ``cells`` cells nearest to the query's mean."""
    spark, out = graph.sparkSession, None
    known = routes.orderBy("cell").collect()  # at most MAX_CELLS
    if not known:
        return spark.createDataFrame([], PAIRS)
    centers = np.array([r.center for r in known])
    at = F.array(*[F.lit(r.cell) for r in known])
    asked = nearest_cells(queries.filter("query_id is not null and size(vectors) > 0"), "query_id", centers, metric, cells)
    asked = asked.withColumn("cell", F.get(at, F.col("cell"))).join(F.broadcast(routes.select("cell", "parts")), "cell")
    asked = asked.select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "query_id", "vectors")
    passes = max(1, -(-queries.count() // PASS_QUERIES))
    for n in range(passes):
        some = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == n) if passes > 1 else asked
        part = graph.groupBy("cell", "part").cogroup(some.groupBy("cell", "part")).applyInArrow(_walker(k, beam, metric, scorer), PAIRS)
        out = part if out is None else out.unionByName(part)
    return out


def _walker(k: int, beam: int, metric: str, scorer: Any) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(group: pa.Table, asked: pa.Table) -> pa.Table:
        none = np.zeros(0, np.int64)
        rows: list[tuple] = [(none, none, np.zeros(0))]
        if group.num_rows and asked.num_rows:
            group = group.sort_by("pos")
            flat, off = K.ragged(group["vectors"])
            shard = Shard(flat, off, metric, scorer.scorer(metric) if scorer else None)
            edges = [np.asarray(x, np.int64) for x in group["neighbors"].to_pylist()]
            ids, qid, (qv, qo) = group["cloud_id"].to_numpy(), asked["query_id"].to_numpy(), K.ragged(asked["vectors"])
            for i, (a, b) in enumerate(zip(qo[:-1], qo[1:])):
                n, d, _ = beam_search(shard, edges, qv[a:b], max(k, beam))
                rows.append((np.full(min(k, len(n)), qid[i]), ids[n[:k]], d[:k]))
        q, c, s = (np.concatenate([r[j] for r in rows]) for j in range(3))
        return pa.Table.from_batches([_pairs(q, c, s)])

    return run


def hop(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    """One step of every frontier(query_id, node_id) along edges(node_id, neighbor): the distinct nodes reached.

    Repeated edges and repeated places of a query are dropped before they meet, since a node that has many of both would
    multiply them.
    """
    return frontier.select("query_id", "node_id").distinct().join(edges.select("node_id", "neighbor").distinct(), "node_id").select("query_id", F.col("neighbor").alias("node_id")).distinct()


def edges_of(graph: DataFrame) -> DataFrame:
    """(node_id, neighbor) in cloud ids."""
    g = graph.select("cell", "part", "cloud_id", F.explode("neighbors").alias("pos"))
    return g.join(graph.select("cell", "part", "pos", F.col("cloud_id").alias("neighbor")), ["cell", "part", "pos"]).select(F.col("cloud_id").alias("node_id"), "neighbor")


