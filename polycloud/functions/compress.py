"""Query compression: fewer vectors per query cloud."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K
from .quantize import ALIGNMENT


def ball_carving(q: np.ndarray, threshold: float, metric: str = "ip", align: int = 1) -> np.ndarray:
    """Greedy clusters in input order: a vector joins the first vector within ``threshold`` (inner product at least, squared distance at most).

    IP represents a cluster by its sum, L2 by its mean. While the count is no multiple of ``align`` (and above it), the two
    nearest representatives merge.
    """
    left, groups = np.ones(len(q), bool), []
    for i in range(len(q)):
        if left[i]:
            near = q @ q[i] >= threshold if metric == "ip" else ((q - q[i]) ** 2).sum(1) <= threshold
            take = left & near
            take[i] = True
            groups.append(np.flatnonzero(take))
            left &= ~take
    reps = [(q[g].sum(0), len(g)) for g in groups]
    mean = lambda r: r[0] / r[1]
    while len(reps) > align and len(reps) % align:
        m = np.array([mean(r) for r in reps])
        d = K.pair_distances(m, m, metric)
        np.fill_diagonal(d, np.inf)
        i, j = sorted(np.unravel_index(d.argmin(), d.shape))
        reps[i] = (reps[i][0] + reps[j][0], reps[i][1] + reps[j][1])
        del reps[j]
    return np.array([r[0] if metric == "ip" else mean(r) for r in reps]).reshape(len(reps), q.shape[1])


def ward(q: np.ndarray, threshold: float = np.inf, target: int = 1, align: int = 1, strict: bool = False) -> np.ndarray:
    """Agglomeration by least variance increase (Lance-Williams); a cluster is represented by its sum.

    Merges while the cheapest merge costs at most ``threshold`` and more than ``target`` clusters are left, then until the
    count is a multiple of ``align``. ``strict`` ignores the threshold and stops at ``target`` exactly.
    """
    n = len(q)
    sums, size = q.astype(np.float64).copy(), np.ones(n)
    d = K.pair_distances(q, q, "l2") / 2
    np.fill_diagonal(d, np.inf)
    alive = np.ones(n, bool)
    while alive.sum() > max(1, target):
        i, j = np.unravel_index(d.argmin(), d.shape)
        if not strict and d[i, j] > threshold and (alive.sum() % align == 0 or alive.sum() <= align):
            break
        k = alive.copy()
        k[[i, j]] = False
        total = size[i] + size[j] + size[k]
        new = ((size[i] + size[k]) * d[i, k] + (size[j] + size[k]) * d[j, k] - size[k] * d[i, j]) / total
        sums[i] += sums[j]
        size[i] += size[j]
        d[i, k] = d[k, i] = new
        d[j, :] = d[:, j] = np.inf
        alive[j] = False
    return sums[alive]


def compress(q: np.ndarray, method: str = "ward", threshold: float = 0.3, metric: str = "ip", quantizer: str = "none", target: int = 1, align: int | None = None) -> np.ndarray:
    """Dispatch by method: ``none``, ``ball``, ``ward`` (threshold), ``dynamic`` (ward, aligned for the quantizer), ``strict`` (ward to ``target``)."""
    step = ALIGNMENT.get(quantizer, 1) if align is None else align
    if not len(q) or method == "none":
        return q
    if method == "ball":
        return ball_carving(q, threshold, metric, ALIGNMENT.get(quantizer, 1))
    if method in ("ward", "dynamic"):
        return ward(q, threshold, 1, step if method == "dynamic" or align else 1)
    if method == "strict":
        return ward(q, target=target, strict=True)
    raise ValueError(f"unknown compression {method!r}")


def compress_queries(queries: DataFrame, **how) -> DataFrame:
    """``queries(query_id, vectors)`` with each cloud compressed. Distances to compressed sums keep the order of the mean, not its value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, off = K.ragged(batch.column(1))
            parts = [compress(flat[a:b], **how) for a, b in zip(off[:-1], off[1:])]
            sizes = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            whole = np.concatenate(parts) if parts else flat
            yield pa.RecordBatch.from_arrays([batch.column(0), K.nested(whole.reshape(sizes[-1], flat.shape[1]), sizes)], names=["query_id", "vectors"])

    return queries.select("query_id", "vectors").mapInArrow(run, "query_id long, vectors array<array<float>>")
