"""Named SQL functions of the engine."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf

from . import kernels as K
from .compress import compress
from .emd import emd
from .fde import FDEConfig, encode


def _cloud(x) -> np.ndarray:
    return np.array([np.asarray(v, np.float64) for v in x]) if x is not None and len(x) else np.zeros((0, 0))


def register(spark: SparkSession, fde: int = 1280) -> None:
    """chamfer_ip(a, b), chamfer_l2(a, b), emd(a, b), mean_pool(a), fde_query(a), fde_document(a), compress_query(a, threshold).

    Clouds are array<array<float>>. Null or empty clouds give null.
    """

    def pairwise(f):
        @pandas_udf("double")
        def run(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series([f(_cloud(x), _cloud(y)) if x is not None and y is not None and len(x) and len(y) else None for x, y in zip(a, b)], dtype="float64")

        return run

    def ch(metric: str):
        return lambda a, b: float(K.chamfer(a, np.array([0, len(a)]), b, np.array([0, len(b)]), metric)[0, 0])

    cfg = FDEConfig.preset(fde)

    def single(f):
        @pandas_udf("array<float>")
        def run(a: pd.Series) -> pd.Series:
            return pd.Series([f(_cloud(x)).astype(np.float32) if x is not None and len(x) else None for x in a])

        return run

    @pandas_udf("array<array<float>>")
    def squeeze(a: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([[list(map(float, v)) for v in compress(_cloud(x), "ward", y)] if x is not None and len(x) else None for x, y in zip(a, t)])

    for name, f in {"chamfer_ip": pairwise(ch("ip")), "chamfer_l2": pairwise(ch("l2")), "emd": pairwise(lambda a, b: emd(a, b)), "mean_pool": single(lambda a: a.mean(0)), "fde_query": single(lambda a: encode(a, cfg, True)), "fde_document": single(lambda a: encode(a, cfg, False)), "compress_query": squeeze}.items():
        spark.udf.register(name, f)


def register_probe(spark: SparkSession, centers: list[tuple[int, list[list[float]]]], metric: str = "ip", name: str = "probe") -> None:
    """The table function probe(vectors, n): (leaf_id, rank, distance) of the ``n`` lists nearest to a cloud, for ``LATERAL`` joins. ``centers`` are (leaf_id, center vectors) of bounded number."""
    ids = [i for i, _ in centers]
    flat = np.array([v for _, c in centers for v in c], np.float64)
    off = np.concatenate([[0], np.cumsum([len(c) for _, c in centers])])

    @udtf(returnType="leaf_id bigint, rank int, distance double")
    class Probe:
        def eval(self, vectors, n: int):
            q = _cloud(vectors)
            if len(q):
                d = K.chamfer(q, np.array([0, len(q)]), flat, off, metric)[0]
                for rank, i in enumerate(sorted(range(len(ids)), key=lambda i: (d[i], ids[i]))[:n], 1):
                    yield int(ids[i]), rank, float(d[i])

    spark.udtf.register(name, Probe)
