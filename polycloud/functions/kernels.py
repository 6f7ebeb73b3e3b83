"""Numpy kernels over ragged clouds: a flat (vectors, dim) matrix and the offsets of its clouds. Sums are float64."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Query and item vectors that meet in one product, at most; larger clouds meet in pieces.
TILE_Q, TILE_D = 512, 2048
#: Clouds of more vectors are reduced one by one, smaller ones together, position by position.
WIDE = 64
#: Distances that agree to so many decimals tie, as in the SQL that the queries are compared with.
DECIMALS = 9
METRICS = ("ip", "l2")


def check_metric(metric: str) -> str:
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}, not {metric!r}")
    return metric


def ragged(column: pa.Array | pa.ChunkedArray, kind: type | None = np.float64) -> tuple[np.ndarray, np.ndarray]:
    """Flat vectors (of ``kind``, or as they come) and offsets (clouds + 1) of an Arrow list<list<float>> column; null clouds are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.nan_to_num(np.asarray(pc.list_value_length(column).to_numpy(zero_copy_only=False), np.float64)).astype(np.int64)
    vectors = column.flatten()
    values = vectors.flatten().to_numpy(zero_copy_only=False)
    values = values if kind is None else values.astype(kind)
    dim = len(values) // len(vectors) if len(vectors) else 0
    if dim * len(vectors) != len(values):
        raise ValueError("vectors of a batch differ in dimension")
    return values.reshape(len(vectors), dim), np.concatenate([[0], np.cumsum(sizes)])


def nested(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The reverse of ``ragged``, as float32."""
    values = pa.array(np.ascontiguousarray(flat, np.float32).ravel())
    inner = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * flat.shape[1], pa.int32()), values)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), inner)


def pair_distances(q: np.ndarray, d: np.ndarray, metric: str) -> np.ndarray:
    """Vector distances: -<q, d>, or squared L2 clamped at 0."""
    dot = q @ d.T
    if metric == "ip":
        return -dot
    return np.maximum(0, (q * q).sum(1)[:, None] + (d * d).sum(1)[None, :] - 2 * dot)


def reduce_chamfer(block: np.ndarray, q_off: np.ndarray, d_off: np.ndarray) -> np.ndarray:
    """(queries, documents) means over query vectors of minima over document vectors; a side without vectors gives inf."""
    out = np.full((len(q_off) - 1, len(d_off) - 1), np.inf)
    qs, ds = np.flatnonzero(np.diff(q_off)), np.flatnonzero(np.diff(d_off))
    if len(qs) and len(ds):
        low = np.minimum.reduceat(block, d_off[ds] - d_off[0], axis=1)
        out[np.ix_(qs, ds)] = np.add.reduceat(low, q_off[qs] - q_off[0], axis=0) / np.diff(q_off)[qs][:, None]
    return out


class Measure:
    """Vector distances of a metric as a product of two matrices, of which each side is made once; ``code`` (a quantizer) stands in for exact vectors.

    The product lacks what a query vector adds to all its distances (``added``), and the clamp at 0 of squared distances.
    """

    def __init__(self, metric: str, code=None):
        self.metric, self.code = metric, code

    def queries(self, q: np.ndarray) -> np.ndarray:
        a = self.code.query_side(q) if self.code else q
        return a if self.metric == "ip" or (self.code and self.code.tables) else np.concatenate([a, np.ones((len(a), 1))], 1)

    def items(self, d: np.ndarray) -> np.ndarray:
        b = self.code.item_side(d) if self.code else d
        if self.code and self.code.tables:
            return b
        if self.metric == "ip":
            return -b
        return np.concatenate([-2 * b, self._norms(d)[:, None]], 1)

    def _norms(self, d: np.ndarray) -> np.ndarray:
        return self.code.norms(self.code.encode(d)) if self.code else (d * d).sum(1)

    def added(self, q: np.ndarray) -> np.ndarray | None:
        return (q * q).sum(1) if self.metric == "l2" else None

    def product(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if self.code and self.code.tables:
            dot, norms = self.code.look_up(a, b)
            return -dot if self.metric == "ip" else norms - 2 * dot
        return a @ b.T


class Items:
    """Clouds laid out for products with queries: of small clouds the p-th vectors of all that have one are adjacent, large ones stay apart.

    ``order`` says which cloud a column is about; clouds without vectors have no column.
    """

    def __init__(self, flat: np.ndarray, off: np.ndarray, measure: Measure):
        self.measure = measure
        side = measure.items(np.asarray(flat, np.float64))
        sizes = np.diff(off)
        small = np.flatnonzero((sizes > 0) & (sizes <= WIDE))
        small = small[np.argsort(-sizes[small], kind="stable")]
        large = np.flatnonzero(sizes > WIDE)
        self.order = np.concatenate([small, large])
        self.n_small = len(small)
        having = [int((sizes[small] > p).sum()) for p in range(int(sizes[small].max(initial=0)))]
        self.slabs = [side[off[small[:n]] + p] for p, n in enumerate(having)]
        self.large = [side[off[i] : off[i + 1]] for i in large]

    def minima(self, a: np.ndarray, added: np.ndarray | None) -> np.ndarray:
        """(query vectors, columns): the nearest vector of every cloud to each of ``a``, a side made by ``Measure.queries``."""
        out = np.empty((len(a), len(self.order)))
        product, n = self.measure.product, self.n_small
        for p, slab in enumerate(self.slabs):
            m = len(slab)
            if p == 0:
                out[:, :m] = product(a, slab)
            else:
                np.minimum(out[:, :m], product(a, slab), out=out[:, :m])
        for i, b in enumerate(self.large, n):
            out[:, i] = product(a, b[:TILE_D]).min(1)
            for at in range(TILE_D, len(b), TILE_D):
                np.minimum(out[:, i], product(a, b[at : at + TILE_D]).min(1), out=out[:, i])
        if added is not None:
            out += added[:, None]
            np.maximum(out, 0, out=out)
        return out


def spans(off: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of adjacent clouds with at most ``most`` vectors, or one cloud."""
    out, a, n = [], 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
        out.append((a, min(b, n)))
        a = out[-1][1]
    return out


def sums(rows: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of ``n`` adjacent rows from each ``start``; a loop over places, since reduceat along rows takes longer than a product."""
    out = rows[start]
    for p in range(1, int(n.max())):
        has = np.flatnonzero(n > p)
        if len(has) == len(n):
            out += rows[start + p]
        else:
            out[has] += rows[start[has] + p]
    return out


class Asks:
    """Query clouds with their side of the product, made once."""

    def __init__(self, flat: np.ndarray, off: np.ndarray, measure: Measure):
        flat = np.asarray(flat, np.float64)
        self.side, self.added, self.off = measure.queries(flat), measure.added(flat), off
        self.spans = spans(off, TILE_Q)

    def __len__(self) -> int:
        return len(self.off) - 1

    def meet(self, items: Items):
        """(first query, end, scores of these queries to the columns): means over query vectors of minima over item vectors; inf without query vectors."""
        for a, b in self.spans:
            off = self.off[a : b + 1]
            n = np.diff(off)
            if b - a == 1 and n[0] > TILE_Q:
                total = np.zeros(len(items.order))
                for at in range(off[0], off[1], TILE_Q):
                    total += self.low(items, at, min(at + TILE_Q, off[1])).sum(0)
                yield a, b, total[None] / n[0]
                continue
            if not n.any():
                yield a, b, np.full((b - a, len(items.order)), np.inf)
                continue
            low = self.low(items, off[0], off[-1])
            if (n == 1).all():
                yield a, b, low
                continue
            full = np.flatnonzero(n)
            mean = sums(low, off[full] - off[0], n[full])
            mean /= n[full, None]
            if len(full) < b - a:
                some, mean = mean, np.full((b - a, len(items.order)), np.inf)
                mean[full] = some
            yield a, b, mean

    def low(self, items: Items, a: int, b: int) -> np.ndarray:
        """Minima of query vectors ``a`` to ``b``."""
        return items.minima(self.side[a:b], None if self.added is None else self.added[a:b])


def chamfer(q: np.ndarray, q_off: np.ndarray, d: np.ndarray, d_off: np.ndarray, metric: str, code=None) -> np.ndarray:
    """Asymmetric Chamfer distances of all query clouds to all document clouds, a bounded tile at a time; a side without vectors gives inf."""
    out = np.full((len(q_off) - 1, len(d_off) - 1), np.inf)
    if not len(q) or not len(d):
        return out
    measure = Measure(metric, code)
    asks = Asks(q, q_off, measure)
    for c, e in spans(d_off, TILE_D):
        items = Items(d[d_off[c] : d_off[e]], d_off[c : e + 1] - d_off[c], measure)
        for a, b, scores in asks.meet(items):
            out[a:b, c + items.order] = scores
    return out


class Best:
    """The ``k`` nearest items of each of ``n`` queries so far; ties (to DECIMALS) go to the smaller id."""

    def __init__(self, n: int, k: int):
        self.n, self.k, self.limit = n, k, np.full(n, np.inf)
        none = np.zeros(0, np.int64)
        self.held, self.more, self.pending = (none, none, np.zeros(0)), [], 0

    def add(self, first: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores`` of queries ``first`` and on to the items ``ids``."""
        limit = self.limit[first : first + len(scores)]
        if scores.shape[1] > self.k and np.isinf(limit).any():
            kth = np.partition(scores, self.k - 1, axis=1)[:, self.k - 1]
            np.copyto(limit, kth, where=kth < limit)
        r, c = np.divmod(np.flatnonzero(scores <= limit[:, None] + 2 * 10.0**-DECIMALS), max(1, scores.shape[1]))
        if len(r):
            self.more.append((r + first, ids[c], scores[r, c]))
            self.pending += len(r)
            if self.pending > max(self.n * self.k, 1 << 15):
                self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) held, by query and nearness."""
        if self.more:
            r, c, s = (np.concatenate([x[i] for x in [self.held, *self.more]]) for i in range(3))
            self.more, self.pending = [], 0
            ok = np.isfinite(s)
            if not ok.all():
                r, c, s = r[ok], c[ok], s[ok]
            order = np.lexsort((c, np.round(s, DECIMALS), r))
            r, c, s = r[order], c[order], s[order]
            keep = np.arange(len(r)) - np.searchsorted(r, np.arange(self.n))[r] < self.k
            r, c, s = r[keep], c[keep], s[keep]
            self.held = r, c, s
            last = np.searchsorted(r, np.arange(self.n), "right") - 1
            full = np.bincount(r, minlength=self.n) >= self.k
            self.limit[full] = np.minimum(self.limit[full], s[last[full]])
        return self.held


def top_k(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, score) of the ``k`` smallest finite scores per row, ties (to DECIMALS) to the smaller id."""
    if scores.shape[1] > 4 * k:
        # Ties at the k-th place all stay until ids decide.
        kth = np.partition(scores, k - 1, axis=1)[:, k - 1]
        r, c = np.nonzero((scores <= kth[:, None] + 2 * 10.0**-DECIMALS) & np.isfinite(scores))
    else:
        r, c = np.nonzero(np.isfinite(scores))
    order = np.lexsort((ids[c], np.round(scores[r, c], DECIMALS), r))
    r, c = r[order], c[order]
    first = np.searchsorted(r, np.arange(scores.shape[0]))
    keep = np.arange(len(r)) - first[r] < k
    return r[keep], ids[c[keep]], scores[r[keep], c[keep]]
