"""Clustering of clouds: Lloyd rounds over whole clouds, one job per round for all nodes of a level together.

Centers are a table. They meet the clouds in blocks of a checked size, so neither the driver nor an executor ever holds more
than one block, whatever the number of nodes or the children of one.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions.quantize import lloyd, make
from . import search

#: Largest block of centers that is broadcast.
CENTER_BYTES = 128 << 20
#: Vectors that meet the centers in one product.
STEP = 4096
#: Vectors per inner center that a cluster's center cloud is formed from, at most (a hash sample of its clouds).
MPPC = 256

CENTERS = "node_id long, child int, vectors array<array<float>>"
PLACED = "node_id long, cloud_id long, child int, distance double, vectors array<array<float>>"
#: node -> flat vectors, offsets, children
Centers = dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def persisted(df: DataFrame) -> DataFrame:
    """Cuts the lineage of an iterative build in the session's checkpoint folder, if there is one."""
    return df.checkpoint() if df.sparkSession.conf.get("spark.checkpoint.dir", None) else df.cache()


def centers_of(rows: DataFrame) -> Centers:
    """Center clouds (node_id, child, vectors) as arrays per node; bounded by the caller."""
    found: dict[int, list] = {}
    key = (F.col("node_id") * (1 << 31) + F.col("child")).alias("key")  # children are not negative
    for blocks in search.packed(rows.select(key, "vectors"), "key", 0):
        for ids, flat, off in blocks:
            for i, (a, b) in zip(ids.tolist(), zip(off[:-1], off[1:])):
                found.setdefault(i >> 31, []).append((i & ((1 << 31) - 1), flat[a:b]))
    out = {}
    for n, cs in found.items():
        cs.sort(key=lambda c: c[0])
        out[n] = np.concatenate([c for _, c in cs]), np.concatenate([[0], np.cumsum([len(c) for _, c in cs])]), np.array([i for i, _ in cs], np.int32)
    return out


def center_blocks(centers: DataFrame) -> list[tuple[int, int, int, int]]:
    """(first node, its first child, last node, its last child) of blocks of at most CENTER_BYTES (or one center)."""
    size = F.size("vectors") * F.size(F.get("vectors", F.lit(0))) * 8
    total = centers.agg(F.sum(size.cast("long"))).first()[0] or 0
    key = F.struct("node_id", "child")
    if total <= CENTER_BYTES:
        r = centers.agg(F.min(key).alias("a"), F.max(key).alias("b")).first()
        return [(*r.a, *r.b)] if r.a is not None else []
    # Running bytes need an order over all centers, of which only sizes travel; a block starts where another CENTER_BYTES are full.
    w = Window.orderBy("node_id", "child").rowsBetween(Window.unboundedPreceding, -1)
    sized = centers.select("node_id", "child", size.cast("long").alias("n"))
    block = F.floor((F.coalesce(F.sum("n").over(w), F.lit(0)) + F.col("n")) / F.lit(max(1, CENTER_BYTES)))
    marked = sized.withColumn("block", block).groupBy("block").agg(F.min(key).alias("a"), F.max(key).alias("b"))
    return [(*r.a, *r.b) for r in marked.orderBy("block").collect()]


def assign(clouds: DataFrame, centers: DataFrame, metric: str = "ip", top: int = 1, scorer: Any = None) -> DataFrame:
    """(node_id, cloud_id, child, distance, vectors): the ``top`` nearest centers of its node for each cloud, as rows.

    ``clouds(node_id, cloud_id, vectors)``, ``centers(node_id, child, vectors)``. Distances run from the cloud to the center,
    ties go to the smaller child. Nodes whose centers fill several blocks are ranked across them.
    """
    blocks = center_blocks(centers)
    out = None
    for n0, c0, n1, c1 in blocks:
        inside = ((F.col("node_id") > n0) | ((F.col("node_id") == n0) & (F.col("child") >= c0))) & ((F.col("node_id") < n1) | ((F.col("node_id") == n1) & (F.col("child") <= c1)))
        part = _assign_block(clouds.filter(F.col("node_id").between(n0, n1)) if len(blocks) > 1 else clouds, centers_of(centers.filter(inside)), metric, top, scorer)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return clouds.sparkSession.createDataFrame([], PLACED)
    split = sorted({a[2] for a, b in zip(blocks, blocks[1:]) if a[2] == b[0]})
    if not split:
        return out
    own = F.col("node_id").isin(split)
    rank = F.row_number().over(Window.partitionBy("node_id", "cloud_id").orderBy("distance", "child"))
    return out.filter(~own).unionByName(out.filter(own).withColumn("_r", rank).filter(F.col("_r") <= top).drop("_r"))


def _assign_block(clouds: DataFrame, centers: Centers, metric: str, top: int, scorer: Any) -> DataFrame:
    sent = clouds.sparkSession.sparkContext.broadcast(centers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            flat, off = K.ragged(whole.column(2))
            nodes = whole.column(0).to_numpy()
            for node in np.unique(nodes).tolist():
                if node not in sent.value:
                    continue
                cv, co, child = sent.value[node]
                mine = np.flatnonzero(nodes == node)
                begin = 0
                while begin < len(mine):
                    sizes = np.cumsum(off[mine[begin:] + 1] - off[mine[begin:]])
                    rows = mine[begin : begin + max(1, int(np.searchsorted(sizes, STEP, "right")))]
                    begin += len(rows)
                    part = np.concatenate([flat[off[i] : off[i + 1]] for i in rows])
                    po = np.concatenate([[0], np.cumsum(off[rows + 1] - off[rows])])
                    d = K.chamfer(part, po, cv, co, metric, scorer)
                    r, c, s = K.top_k(d, np.arange(d.shape[1]), top)
                    at = pa.array(rows[r])
                    yield pa.RecordBatch.from_arrays([whole.column(0).take(at), whole.column(1).take(at), pa.array(child[c], pa.int32()), pa.array(s), whole.column(2).take(at)], names=["node_id", "cloud_id", "child", "distance", "vectors"])

    return clouds.select("node_id", "cloud_id", "vectors").mapInArrow(run, PLACED)


def inner_centers(group: pa.Table, size: int, metric: str, seed: int, assign_on: str = "float") -> np.ndarray:
    """The center cloud of a cluster: all its vectors if they are few, else k-means in which every cloud has mass 1."""
    flat, off = K.ragged(group["vectors"])
    if len(flat) <= size:
        return flat
    n = np.diff(off)
    return lloyd(flat, size, 10, seed, np.repeat(1 / np.maximum(n, 1), n), metric == "ip", make("tq8") if assign_on == "tq8" else None)[0]


def train(clouds: DataFrame, ks: dict[int, int], counts: dict[int, int], metric: str = "ip", iters: int = 5, size: int = 0, mpcc: int = 100, seed: int = 0, assign_on: str = "float") -> DataFrame:
    """Center clouds (node_id, child, vectors): ``ks[node]`` of them for each node of ``clouds(node_id, cloud_id, vectors)``.

    Nodes of more than 2048 clouds are clustered on a hash sample of ``mpcc`` clouds per cluster; a center cloud is formed from
    at most about MPPC vectors per center of it, so the groups that reach one task are bounded even where a cluster takes
    all of a node. A cluster that goes empty keeps its center.
    """
    spark = clouds.sparkSession
    some = spark.createDataFrame([(n, float(min(1.0, mpcc * k / counts[n]) if mpcc and counts[n] > max(2048, mpcc * k) else 1.0), float(min(1.0, 4 * k / counts[n] + 64 / counts[n])), k) for n, k in ks.items()], "node_id long, share double, seeds double, k int")
    unit = lambda salt: F.pmod(F.xxhash64(F.lit(salt), F.col("cloud_id")), F.lit(1 << 30)) / float(1 << 30)
    sample = persisted(clouds.join(F.broadcast(some), "node_id").withColumn("h", unit(seed)).filter("h < greatest(share, seeds)").select("node_id", "cloud_id", "vectors", "h", "share", "seeds", "k"))
    if size <= 0:
        size = int(np.ceil(sample.agg(F.avg(F.size("vectors"))).first()[0] or 1))
    pick = F.row_number().over(Window.partitionBy("node_id").orderBy("h", "cloud_id"))
    chosen = sample.filter("h < seeds").select("node_id", "cloud_id", "h", "k").withColumn("child", (pick - 1).cast("int")).filter("child < k").select("node_id", "cloud_id", "child")
    centers = persisted(sample.join(chosen, ["node_id", "cloud_id"]).select("node_id", "child", "vectors"))
    sample = sample.filter("h < share").select("node_id", "cloud_id", "vectors")

    def shrink(group: pa.Table) -> pa.Table:
        c = inner_centers(group, size, metric, seed, assign_on)
        return pa.table({"node_id": group["node_id"].slice(0, 1), "child": group["child"].slice(0, 1), "vectors": K.nested(c, np.array([0, len(c)]))})

    scorer = make("tq8") if assign_on == "tq8" else None
    for step in range(iters):
        placed = persisted(assign(sample, centers, metric, 1, scorer).select("node_id", "child", "cloud_id", "vectors"))
        full = placed.groupBy("node_id", "child").agg(F.sum(F.size("vectors")).alias("n")).select("node_id", "child", (F.lit(float(MPPC * size)) / F.col("n")).alias("part"))
        fresh = placed.join(full, ["node_id", "child"]).filter(unit(seed + 1 + step) < F.col("part")).select("node_id", "child", "vectors").groupBy("node_id", "child").applyInArrow(shrink, CENTERS)
        fresh = fresh.withColumnRenamed("vectors", "fresh")
        centers = persisted(centers.join(fresh, ["node_id", "child"], "left").select("node_id", "child", F.coalesce("fresh", "vectors").alias("vectors")))
    return centers


def cluster(clouds: DataFrame, k: int, metric: str = "ip", **how) -> tuple[DataFrame, DataFrame]:
    """(centers(cluster, vectors), assigned(cloud_id, cluster, distance)) of one flat clustering."""
    rooted = clouds.select(F.lit(0).cast("long").alias("node_id"), "cloud_id", "vectors")
    n = rooted.count()
    centers = train(rooted, {0: min(k, n)}, {0: n}, metric, **how)
    placed = assign(rooted, centers, metric)
    return centers.select(F.col("child").alias("cluster"), "vectors"), placed.select("cloud_id", F.col("child").alias("cluster"), "distance")


def top_centers(clouds: DataFrame, centers: DataFrame, metric: str, top: int) -> DataFrame:
    """(cloud_id, cluster, distance): the ``top`` nearest of given centers(cluster, vectors) for every cloud."""
    rooted = search.spread(clouds.select(F.lit(0).cast("long").alias("node_id"), "cloud_id", "vectors"))
    placed = assign(rooted, centers.select(F.lit(0).cast("long").alias("node_id"), F.col("cluster").cast("int").alias("child"), "vectors"), metric, top)
    return placed.select("cloud_id", F.col("child").alias("cluster"), "distance")


def cost(assigned: DataFrame) -> DataFrame:
    return assigned.agg(F.sum("distance").alias("cost"))


def weighted_vector_cost(vectors: DataFrame, centers: np.ndarray) -> DataFrame:
    """Sum over clouds of the mean squared distance from their vectors to the nearest center: each cloud has mass 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, off = K.ragged(batch.column(0))
            low = np.concatenate([K.pair_distances(flat[a : a + STEP], centers, "l2").min(1) for a in range(0, len(flat), STEP)]) if len(flat) else np.zeros(0)
            n = np.diff(off)
            yield pa.RecordBatch.from_arrays([pa.array([float((low / np.repeat(np.maximum(n, 1), n)).sum())])], names=["cost"])

    return vectors.select("vectors").mapInArrow(run, "cost double").agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"))


def cost_lower_bound(clouds: DataFrame, k: int, size: int, pool: int = 20_000, seed: int = 0) -> DataFrame:
    """What k center clouds of ``size`` vectors could cost at best, about: the cost of all their vectors as free centers, found by k-means over a hash sample of ``pool`` clouds."""
    rows = clouds.orderBy(F.xxhash64(F.lit(seed), F.col("cloud_id")), "cloud_id").limit(pool).select("vectors").collect()
    flat = np.array([v for r in rows for v in r.vectors], np.float64)
    mass = np.array([1 / len(r.vectors) for r in rows for _ in r.vectors])
    return weighted_vector_cost(clouds, lloyd(flat, min(k * size, len(flat)), 10, seed, mass)[0])


def subsample_assign(vectors: DataFrame, k: int, max_size: int, mppc: int = MPPC, iters: int = 10, metric: str = "l2", seed: int = 0, assign_on: str = "float") -> tuple[np.ndarray, DataFrame, DataFrame]:
    """k-means on a hash sample of ``mppc`` vectors per cluster, every row of vectors(vec_id, v) assigned: (centers, (vec_id, cluster), (cluster, size, kept)).

    A cluster above ``max_size`` of which all but two members at most equal another of its members is a heap of duplicates:
    ``kept`` is false for it. Its members are reported here, not dropped, so that a search can still reach them.
    """
    some = vectors.orderBy(F.xxhash64(F.lit(seed), F.col("vec_id")), "vec_id").limit(mppc * k).select("v").collect()
    x = np.array([r.v for r in some], np.float64)
    centers = lloyd(x, k, iters, seed, None, metric == "ip", make("tq8") if assign_on == "tq8" else None)[0]
    sent = vectors.sparkSession.sparkContext.broadcast(centers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            near = np.concatenate([K.pair_distances(v[a : a + STEP], sent.value, metric).argmin(1) for a in range(0, len(v), STEP)]) if len(v) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(near, pa.int32())], names=["vec_id", "cluster"])

    placed = vectors.select(F.col("vec_id").cast("long"), "v").mapInArrow(run, "vec_id long, cluster int")
    same = placed.join(vectors.select("vec_id", F.xxhash64("v").alias("h")), "vec_id").groupBy("cluster", "h").agg(F.count("*").alias("n"))
    sizes = same.groupBy("cluster").agg(F.sum("n").alias("size"), F.max("n").alias("most"))
    return centers, placed, sizes.select("cluster", "size", (~((F.col("size") > max_size) & (F.col("most") >= F.col("size") - 2))).alias("kept"))


def spark_kmeans(vectors: DataFrame, k: int, weight: str | None = None, iters: int = 10, seed: int = 0) -> tuple[np.ndarray, DataFrame, float]:
    """Plain L2 k-means by Spark ML over vectors(vec_id, v[, weight]): (centers, (vec_id, cluster), cost)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.withColumn("features", array_to_vector(F.col("v").cast("array<double>")))
    model = KMeans(k=k, maxIter=iters, seed=seed, **({"weightCol": weight} if weight else {})).fit(rows)
    return np.array(model.clusterCenters()), model.transform(rows).select("vec_id", F.col("prediction").alias("cluster")), float(model.summary.trainingCost)


def two_stage(vectors: np.ndarray, k1: int, k2: int, iters: int = 10, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coarse k-means, and k-means of the residuals: (coarse centers, residual centers, codes (n, 2)). For bounded training sets."""
    coarse, a = lloyd(vectors, k1, iters, seed)
    rest, b = lloyd(vectors - coarse[a], k2, iters, seed + 1)
    return coarse, rest, np.stack([a, b], 1)


def farthest_first(clouds: list[np.ndarray], m: int, first: int = 0) -> tuple[list[int], list[float]]:
    """Prototype positions by k-center under EMD, and the cover radius after each; the first of equals wins. For bounded training sets."""
    from ..functions.emd import emd

    chosen, radius = [first], []
    near = np.array([emd(c, clouds[first]) for c in clouds])
    while len(chosen) < min(m, len(clouds)):
        radius.append(float(near.max()))
        nxt = int(near.argmax())
        chosen.append(nxt)
        near = np.minimum(near, [emd(c, clouds[nxt], cap) if cap > 0 else 0.0 for c, cap in zip(clouds, near)])
    return chosen, [*radius, float(near.max())]
