"""Measuring builds and searches: stage times, latency, sweeps that stop early, compression and routing studies."""

from __future__ import annotations

import subprocess
import time
from collections.abc import Callable, Iterable
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.compress import compress_queries
from ..functions.quantize import Quantizer, make
from . import evaluate, search


def stage_times(stages: list[tuple[str, Callable[[DataFrame | None], DataFrame]]], warm: int = 1) -> tuple[DataFrame, dict[str, float]]:
    """Runs a search as stages, each given what the one before returned, materialized and timed: (the last result, seconds by stage, summed over no repeats)."""
    for turn in range(warm + 1):
        got, seconds = None, {}
        for name, stage in stages:
            t = time.perf_counter()
            got = stage(got).persist()
            got.count()
            seconds[name] = time.perf_counter() - t
    return got, seconds


def latencies(answer: Callable[[DataFrame], DataFrame], queries: DataFrame, n: int = 50) -> DataFrame:
    """(query_id, ms) of batches of one query, ``n`` of them by hash: what a lone caller waits."""
    ids = [r.query_id for r in queries.select("query_id").orderBy(F.xxhash64("query_id"), "query_id").limit(n).collect()]
    rows = []
    for i in ids:
        t = time.perf_counter()
        answer(queries.filter(F.col("query_id") == i)).collect()
        rows.append((i, 1000 * (time.perf_counter() - t)))
    return queries.sparkSession.createDataFrame(rows, "query_id long, ms double")


def scores(answer: Callable[[DataFrame], DataFrame], queries: DataFrame, truth: DataFrame, k: int) -> dict[str, float]:
    """Recall of one batch without timing: recall_1_k, recall_k_k and rows found per query."""
    found = answer(queries).persist()
    r = evaluate.mean_recall(found, truth, k).first()
    return {"recall_1_k": r.recall_1_k, "recall_k_k": r.recall_k_k, "found": found.count() / max(1, queries.count())}


def until(points: Iterable[dict], run: Callable[[dict], dict], min_qps: float = 0.0, max_recall: float = 1.1, metric: str = "recall_k_k", patience: int = 2) -> list[dict]:
    """Results of ``run`` over ``points`` in order, ended once throughput fell below ``min_qps`` or the recall passed ``max_recall`` in ``patience`` points running."""
    out, bad = [], 0
    for p in points:
        out.append({**p, **run(p)})
        bad = bad + 1 if out[-1]["qps"] < min_qps or out[-1][metric] >= max_recall else 0
        if bad >= patience:
            break
    return out


def built(build: Callable[[], object], save: str | None = None) -> dict:
    """Builds (and saves) an index: seconds, bytes by table, parameters and the commit of the working tree."""
    t = time.perf_counter()
    index = build()
    rows = {name: df.count() for name, df in index.tables.items()}
    out = {"seconds": time.perf_counter() - t, "rows": rows, "params": vars(index.params) if hasattr(index.params, "__dict__") else index.params}
    if save:
        index.save(save)
        from pyarrow import fs as pafs

        fs, root = pafs.FileSystem.from_uri(save if "://" in save else f"file://{save}")
        out["bytes"] = {name: sum(f.size or 0 for f in fs.get_file_info(pafs.FileSelector(f"{root}/{name}", recursive=True))) for name in index.tables}
    git = subprocess.run(["git", "-C", str(Path(__file__).parent), "rev-parse", "--short", "HEAD"], capture_output=True, text=True)
    return out | {"commit": git.stdout.strip() or None}


def compression_sweep(queries: DataFrame, clouds: DataFrame, truth: DataFrame, k: int, thresholds: Iterable[float], method: str = "ward", metric: str = "ip") -> list[dict]:
    """Per threshold: mean vectors per compressed query, and the recall of exact search with it."""
    out = []
    for x in thresholds:
        small = compress_queries(queries, method=method, threshold=x, metric=metric)
        size = small.agg(F.avg(F.size("vectors"))).first()[0]
        out.append({"threshold": x, "size": size, "recall": evaluate.mean_recall(search.exact_top_k(small, clouds, k, metric), truth, k).first().recall_k_k})
    return out


def all_pairs_quality(vectors: np.ndarray, names: Iterable[str]) -> list[dict]:
    """Error and order of each quantizer's inner products over all pairs of a bounded set of vectors: mean absolute error, correlation, seconds to fit and to encode."""
    exact = vectors @ vectors.T
    at = np.triu_indices(len(vectors), 1)
    out = []
    for name in names:
        t0 = time.perf_counter()
        q: Quantizer = make(name).fit(vectors)
        t1 = time.perf_counter()
        codes = q.encode(vectors)
        t2 = time.perf_counter()
        got = q.dots(vectors, codes)
        out.append({"quantizer": name, "error": float(np.abs(got - exact)[at].mean()), "correlation": float(np.corrcoef(got[at], exact[at])[0, 1]), "fit_s": t1 - t0, "encode_s": t2 - t1})
    return out


def leaf_simulation(postings: DataFrame, truth: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """(leaf_id, wanted, kept): true neighbours that a leaf holds, and those of them that a search returned."""
    gold = truth.filter(F.col("rank") <= k).select("query_id", "cloud_id").join(postings, "cloud_id")
    hit = found.select("query_id", "cloud_id", F.lit(1).alias("hit")).distinct()
    return gold.join(hit, ["query_id", "cloud_id"], "left").groupBy("leaf_id").agg(F.count("*").alias("wanted"), F.count("hit").alias("kept"))


def greedy_cover(truth: DataFrame, postings: DataFrame, rounds: int) -> DataFrame:
    """(query_id, round, leaf_id, covered): the lists that together hold most of a query's true neighbours, picked greedily; ties go to the smaller list."""
    left = truth.select("query_id", "cloud_id").distinct().join(postings, "cloud_id")
    out = None
    for n in range(1, rounds + 1):
        per = left.groupBy("query_id", "leaf_id").agg(F.count("*").alias("covered"))
        best = per.groupBy("query_id").agg(F.max(F.struct("covered", (-F.col("leaf_id")).alias("l"))).alias("b")).select("query_id", F.lit(n).alias("round"), (-F.col("b.l")).alias("leaf_id"), F.col("b.covered").alias("covered"))
        out = best if out is None else out.unionByName(best)
        done = left.join(best.select("query_id", "leaf_id"), ["query_id", "leaf_id"], "left_semi").select("query_id", "cloud_id").distinct()
        left = left.join(done, ["query_id", "cloud_id"], "left_anti")
    return out


def route_report(found: DataFrame, truth: DataFrame, candidates: DataFrame, k: int) -> dict[str, float]:
    """Of a routed search: recall of the returned ids against the true top ``k``, and the candidates per query (mean and quantiles)."""
    recall = evaluate.mean_recall(found, truth, k).first().recall_k_k
    n = candidates.groupBy("query_id").agg(F.countDistinct("cloud_id").alias("n"))
    q = evaluate.percentiles(n, "n").first()
    return {"recall": recall, "candidates": n.agg(F.avg("n")).first()[0], **{f"candidates_{c}": q[c] for c in ("p50", "p95", "p99")}}


def parent_pool_recall(truth: DataFrame, postings: DataFrame, parents: DataFrame, probes: DataFrame) -> DataFrame:
    """(query_id, recall) if all lists under the probed lists' parents were read: ``parents(leaf_id, parent_id)``, ``probes(query_id, leaf_id)``."""
    pool = probes.join(parents, "leaf_id").select("query_id", "parent_id").distinct().join(parents, "parent_id").join(postings, "leaf_id").select("query_id", "cloud_id").distinct()
    hit = truth.join(pool.withColumn("hit", F.lit(1)), ["query_id", "cloud_id"], "left")
    return hit.groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))
