"""Exact top-k by integer inner product with one KD-tree per shard.

The space is cut into shards by median splits of a bounded sample; a cell that gets too many rows (equal vectors cannot be
split) is dealt out by id. Each shard has a tree with tight bounding boxes; the box bound of a query q is
sum(max(q * low, q * high)). First every query runs best-first through the tree of its own shard, which gives a k-th score;
that score travels with the query, so another shard is left at its root when its box cannot reach it, and else only boxes
(and then members) that reach it are opened. Ties with the k-th score are opened too, hence the result is exact.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import shared_path, table

LEAF_ROWS = 128
SHARD_ROWS = 8192
QUERY_BLOCK = 1024
#: Rows that the splits of the space are taken from (by hash of the id), and the most cells; further shards come from dealing out cells.
SAMPLE_ROWS, MAX_CELLS = 32_768, 4096
#: Sums of products below this are exact in float64; other vectors are scored with Python's integers.
EXACT = float(1 << 53)
LIMIT = (1 << 63) - 1


class KDTree:
    """Median-split tree over integer vectors (float64 holds their products exactly)."""

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF_ROWS):
        self.order = np.arange(len(vectors))
        self.low, self.high, self.child, self.span = [], [], [], []
        self._split(vectors, 0, len(vectors), leaf)
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.vectors = vectors[self.order]

    def _split(self, v: np.ndarray, a: int, b: int, leaf: int) -> None:
        todo = [(a, b, -1)]
        while todo:
            a, b, parent = todo.pop()
            me = len(self.span)
            rows = v[self.order[a:b]]
            low, high = rows.min(0), rows.max(0)
            self.low.append(low)
            self.high.append(high)
            self.span.append((a, b))
            self.child.append([])
            if parent >= 0:
                self.child[parent].append(me)
            wide = int(np.argmax(high - low))
            if b - a > leaf and high[wide] > low[wide]:
                mid = (b - a) // 2
                part = np.argpartition(rows[:, wide], mid)
                self.order[a:b] = self.order[a:b][part]
                todo += [(a, a + mid, me), (a + mid, b, me)]

    def search(self, q: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best k (score, id) per query among members whose score reaches ``floor``; ``ids`` follows the original rows.

        ``own`` is each query's id, which is no candidate. Empty places have score -inf.
        """
        ids = ids[self.order]
        best = np.full((len(q), k), -np.inf)
        who = np.full((len(q), k), np.iinfo(np.int64).max)
        plus, minus = np.maximum(q, 0), np.minimum(q, 0)
        bound = np.full((len(q), len(self.span)), -np.inf)
        bound[:, 0] = plus @ self.high[0] + minus @ self.low[0]
        active = np.arange(len(q))
        while len(active):
            node = bound[active].argmax(1)
            reach = bound[active, node]
            kth = np.maximum(best[active, -1], floor[active])
            go = (reach >= kth) & (reach > -np.inf)
            active, node = active[go], node[go]
            bound[active, node] = -np.inf
            for x in np.unique(node).tolist():
                mine = active[node == x]
                if self.child[x]:
                    for c in self.child[x]:
                        bound[mine, c] = plus[mine] @ self.high[c] + minus[mine] @ self.low[c]
                    continue
                a, b = self.span[x]
                score = q[mine] @ self.vectors[a:b].T
                score[(ids[None, a:b] == own[mine, None]) | (score < np.maximum(best[mine, -1], floor[mine])[:, None])] = -np.inf
                s = np.concatenate([best[mine], score], 1)
                w = np.concatenate([who[mine], np.broadcast_to(ids[a:b], (len(mine), b - a))], 1)
                o = np.lexsort((w, -s), axis=1)[:, :k]
                best[mine], who[mine] = np.take_along_axis(s, o, 1), np.take_along_axis(w, o, 1)
        return best, who


class Cells:
    """Median splits of the space into at most ``cells`` cells."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.axis, self.cut, self.child = [], [], []
        self._grow(sample, np.arange(len(sample)), cells)
        self.axis, self.cut, self.child = np.array(self.axis), np.array(self.cut), np.array(self.child, np.int64).reshape(-1, 2)

    def _grow(self, v: np.ndarray, rows: np.ndarray, cells: int) -> None:
        todo = [(rows, cells, -1, 0)]
        while todo:
            rows, cells, parent, side = todo.pop()
            me = len(self.axis)
            if parent >= 0:
                self.child[parent][side] = me
            spread = v[rows].max(0) - v[rows].min(0) if len(rows) else np.zeros(0)
            wide = int(np.argmax(spread)) if spread.size else 0
            self.axis.append(-1)
            self.cut.append(0.0)
            self.child.append([-1, -1])
            if cells > 1 and spread.size and spread[wide] > 0:
                x = v[rows, wide]
                cut = np.median(x)
                cut = cut if (x > cut).any() else x[x < x.max()].max()
                self.axis[me], self.cut[me] = wide, float(cut)
                todo += [(rows[x <= cut], (cells + 1) // 2, me, 0), (rows[x > cut], cells // 2, me, 1)]

    def of(self, v: np.ndarray) -> np.ndarray:
        at = np.zeros(len(v), np.int64)
        inner = np.flatnonzero(self.axis[at] >= 0)
        while len(inner):
            n = at[inner]
            at[inner] = self.child[n, (v[inner, self.axis[n]] > self.cut[n]).astype(int)]
            inner = inner[self.axis[at[inner]] >= 0]
        return at


def _stack(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def _large(v: np.ndarray) -> np.ndarray:
    """Vectors that float64 may not score exactly."""
    return (v * v).sum(1) * 4 >= EXACT if v.size else np.zeros(len(v), bool)


def _exact(q: np.ndarray, own: np.ndarray, v: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of the ``k`` best, in whole numbers of any size, cut to 64 bits."""
    rows = [[int(x) for x in row] for row in v]
    out: list[tuple[int, int, int]] = []
    for i, x in enumerate(q):
        ints = [int(y) for y in x]
        scored = sorted((-max(-LIMIT, min(LIMIT, sum(map(operator.mul, ints, row)))), int(c)) for row, c in zip(rows, ids) if c != own[i])
        out += [(i, c, -s) for s, c in scored[:k]]
    return tuple(np.array([o[n] for o in out], np.int64) for n in range(3))


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = 20, every: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best rows for each row whose id is divisible by ``every``.

    Rows with a null id, a null vector or a null or non-finite component take no part. Rows that repeat both id and
    vector count once; a query never returns rows of its own id. A query meets only vectors of its own dimension.
    Ties go to the smaller id; fewer candidates than ``k`` give fewer rows; an empty vector scores 0. Scores are exact
    whatever the components' size; one beyond 64 bits counts as the largest (smallest) 64-bit number. Other columns are not read.
    """
    spark = vectors.sparkSession
    at = lambda c: F.col(f"`{c}`")
    whole = F.forall(at(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < float("inf")))
    rows = vectors.filter(at(id_col).isNotNull() & at(vector).isNotNull()).filter(whole)
    rows = rows.select(at(id_col).cast("long").alias("id"), F.transform(at(vector), lambda x: x.cast("double") * scale).alias("v"))

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            values = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists)))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.floor(values.astype(np.float64)) + 0.0))], names=["id", "v"])

    rows = table(rows.mapInArrow(floors, "id long, v array<double>").distinct().withColumn("dim", F.size("v")), "vectors")
    counts = {r.dim: r["count"] for r in rows.groupBy("dim").count().collect()}
    cells = {}
    for dim, n in counts.items():  # one dimension, as a rule
        wanted = min(MAX_CELLS, -(-n // SHARD_ROWS))
        part = rows.filter(F.col("dim") == dim)
        share = min(1.0, SAMPLE_ROWS / n)
        some = part.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < max(1, int(share * (1 << 20)))).select("v").limit(2 * SAMPLE_ROWS).toArrow() if wanted > 1 and dim else None
        cells[dim] = Cells(_stack(some["v"], dim), wanted) if some is not None and some.num_rows else Cells(np.zeros((0, dim)), 1)
    sent = spark.sparkContext.broadcast(cells)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            cell = np.zeros(len(dims), np.int64)
            for dim in np.unique(dims).tolist():
                mine = np.flatnonzero(dims == dim)
                cell[mine] = sent.value[dim].of(_stack(batch.column(1).take(pa.array(mine)), dim))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=["id", "v", "dim", "cell"])

    placed = table(rows.mapInArrow(place, "id long, v array<double>, dim int, cell long"), "placed")
    sizes = placed.groupBy("dim", "cell").agg(F.count("*").alias("n"))  # at most MAX_CELLS rows a dimension
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / (2 * SHARD_ROWS))).cast("int")
    sharded = placed.join(F.broadcast(sizes.select("dim", "cell", parts.alias("parts"))), ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).select("id", "v", "dim", "cell", "part")

    queries_schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.ArrayType(T.DoubleType())), T.StructField("dim", T.IntegerType()), T.StructField("kth", T.DoubleType())])

    def prime(group: pa.Table) -> pa.Table:
        ids, dim = group["id"].to_numpy(), group["dim"][0].as_py()
        v = _stack(group["v"], dim)
        big = _large(v)
        asks = np.flatnonzero(ids % every == 0)
        kth = np.full(len(asks), -np.inf)
        if len(asks) and dim and not big.all():
            tree = KDTree(v[~big])
            for a in range(0, len(asks), QUERY_BLOCK):
                q = asks[a : a + QUERY_BLOCK]
                best, _ = tree.search(v[q], ids[q], ids[~big], k, np.full(len(q), -np.inf))
                kth[a : a + QUERY_BLOCK] = np.where(big[q], -np.inf, best[:, -1])
        return group.take(asks).select(["id", "v", "dim"]).append_column("kth", pa.array(kth)).cast(to_arrow_schema(queries_schema))

    path = shared_path(spark, "queries")
    sharded.groupBy("dim", "cell", "part").applyInArrow(prime, queries_schema).write.parquet(path)

    def scan(group: pa.Table) -> pa.Table:
        ids, dim = group["id"].to_numpy(), group["dim"][0].as_py()
        v = _stack(group["v"], dim)
        big = _large(v)
        tree = KDTree(v[~big]) if dim and not big.all() else None
        out = [pa.table({x: pa.array([], pa.int64()) for x in ("query_id", "vec_id", "score")})]

        def give(query: np.ndarray, item: np.ndarray, score: np.ndarray) -> None:
            out.append(pa.table({"query_id": query, "vec_id": item, "score": pa.array(score, pa.int64())}))

        for block in _query_blocks(path, dim):
            own, q, kth = block["id"].to_numpy(), _stack(block["v"], dim), block["kth"].to_numpy()
            if not dim:
                near = np.sort(ids)[: k + 1]
                r, c = np.nonzero(near[None] != own[:, None])
                give(own[r], near[c], np.zeros(len(r), np.int64))
                continue
            vast = _large(q)
            if tree is not None and not vast.all():
                best, who = tree.search(q[~vast], own[~vast], ids[~big], k, kth[~vast])
                r, c = np.nonzero(best > -np.inf)
                give(own[~vast][r], who[r, c], best[r, c].astype(np.int64))
            # Few vectors are so large; they meet everything.
            for asks, rows in ((vast, np.ones(len(ids), bool)), (~vast, big)):
                if asks.any() and rows.any():
                    r, c, s = _exact(q[asks], own[asks], v[rows], ids[rows], k)
                    give(own[asks][r], c, s)
        return pa.concat_tables(out)

    found = sharded.groupBy("dim", "cell", "part").applyInArrow(scan, "query_id long, vec_id long, score long")
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.dropDuplicates(["query_id", "vec_id", "score"]).withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _query_blocks(path: str, dim: int) -> Iterator[pa.Table]:
    """The primed queries of one dimension, a block at a time, from the shared folder."""
    source = ds.dataset(path if "://" in path else path.removeprefix("file:"), format="parquet")
    for batch in source.to_batches(columns=["id", "v", "kth"], filter=ds.field("dim") == dim, batch_size=QUERY_BLOCK):
        if batch.num_rows:
            yield pa.Table.from_batches([batch])
