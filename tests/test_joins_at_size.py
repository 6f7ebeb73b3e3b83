"""Joins whose tasks hold a fixed amount: tiles, blocks, passes and either side travelling give the same rows."""

from __future__ import annotations

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from polycloud.functions import kernels as K
from polycloud.functions import quantize as Q
from polycloud.operators import cluster, search
from polycloud.plans import fixtures as X


def peak_mb(run):
    tracemalloc.start()
    run()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak / 1e6


def batch_of(ids, flat, off):
    return pa.RecordBatch.from_arrays([pa.array(ids), K.nested(flat, off)], names=["cloud_id", "vectors"])


@pytest.mark.parametrize("metric", K.METRICS)
def test_large_clouds_meet_in_tiles(metric):
    g = np.random.default_rng(0)
    x = g.normal(size=(5000, 8))
    off = np.array([0, 4000, 4001, 4001, 5000])
    assert peak_mb(lambda: K.chamfer(x, off, x, off, metric)) < 60  # one block of 4000 x 4000 is 128 MB
    want = K.reduce_chamfer(K.pair_distances(x, x, metric), off, off)
    np.testing.assert_allclose(K.chamfer(x, off, x, off, metric), want, atol=1e-9)


def test_many_small_clouds_meet_in_tiles():
    """6,000 queries and 6,000 items of one vector: 288 MB of scores, of which a task holds a tile and the best."""
    g = np.random.default_rng(1)
    x = g.normal(size=(6000, 8)).astype(np.float32)
    ids, off = np.arange(6000), np.arange(6001)
    sent = SimpleNamespace(value=[(ids, x, off)])
    out = {}
    for name in ("_queries_travel", "_items_travel"):
        make = getattr(search, name)
        assert peak_mb(lambda: out.setdefault(name, list(make(sent, K.Measure("l2"), 5)(iter([batch_of(ids, x, off)]))))) < 100
    rows = [sorted(zip(*[np.concatenate([b.column(i).to_numpy() for b in o]).tolist() for i in range(2)])) for o in out.values()]
    assert rows[0] == rows[1] and len(rows[0]) == 30_000


def test_random_tiles_and_empty_clouds(monkeypatch):
    g = np.random.default_rng(2)
    for turn in range(20):
        monkeypatch.setattr(K, "TILE_Q", int(g.integers(1, 9)))
        monkeypatch.setattr(K, "TILE_D", int(g.integers(1, 9)))
        monkeypatch.setattr(K, "WIDE", int(g.integers(0, 5)))
        q, d = g.normal(size=(30, 3)), g.normal(size=(40, 3))
        qo, do = (np.concatenate([[0], np.sort(g.integers(0, n + 1, m)), [n]]) for n, m in ((30, 9), (40, 15)))
        for metric in K.METRICS:
            full = np.ix_(np.flatnonzero(np.diff(qo)), np.flatnonzero(np.diff(do)))
            got = K.chamfer(q, qo, d, do, metric)
            want = [[np.mean([min(K.pair_distances(v[None], d[do[c] : do[c + 1]], metric)[0]) for v in q[qo[a] : qo[a + 1]]]) for c in full[1][0]] for a in full[0][:, 0]]
            np.testing.assert_allclose(got[full], want, atol=1e-9)
            assert np.isinf(got).sum() == got.size - got[full].size


def test_each_side_is_coded_once(monkeypatch):
    z, seen = Q.make("tq8"), []
    encode = Q.TurboQuant8.encode
    monkeypatch.setattr(Q.TurboQuant8, "encode", lambda self, x: seen.append(len(x)) or encode(self, x))
    x = np.random.default_rng(0).normal(size=(9000, 8))
    K.chamfer(x, np.arange(9001), x, np.arange(9001), "ip", z)
    assert sum(seen) == 18_000


def test_ties_are_by_nine_decimals():
    best = K.Best(1, 2)
    best.add(0, np.array([[0.5 + 2e-13, 0.7, 0.5]]), np.array([1, 2, 3]))
    best.add(0, np.array([[0.5 + 1e-13]]), np.array([0]))
    assert best.merge()[1].tolist() == [0, 1]
    assert K.top_k(np.array([[0.5 + 2e-13, 0.7, 0.5]]), np.array([1, 2, 3]), 2)[1].tolist() == [1, 3]


def found(df):
    return sorted((r.query_id, r.cloud_id, round(r.distance, 9)) for r in df.collect())


def test_either_side_travels_in_any_number_of_passes(spark, sf_dir, monkeypatch):
    c = X.clouds_ragged(spark, sf_dir)
    q = X.as_queries(c)
    pairs = q.select("query_id").crossJoin(c.select("cloud_id")).filter("(query_id + cloud_id) % 3 = 0")
    want, some = found(search.exact_top_k(q, c, 4)), found(search.score_pairs(pairs, q, c))
    everything = found(search.all_distances(q, c))
    assert [x for x in everything if (x[0] + x[1]) % 3 == 0] == some
    for block, whole, partial in ((8000, 1, 0), (2000, 40_000, 0), (2000, 40_000, 1 << 40)):
        for name, x in (("BLOCK_BYTES", block), ("PASS_BYTES", whole), ("PARTIAL_BYTES", partial), ("HELD", 9)):
            monkeypatch.setattr(search, name, x)
        assert len(list(search.packed(c, "cloud_id"))) > 1
        monkeypatch.setattr(search, "PAIR_PASSES", 1 << 30)
        assert found(search.exact_top_k(q, c, 4)) == want and found(search.score_pairs(pairs, q, c)) == some
    monkeypatch.setattr(search, "PAIR_PASSES", 0)
    assert found(search.score_pairs(pairs, q, c)) == some


def test_hits_are_summed_where_clouds_meet(spark, sf_dir, monkeypatch):
    v = X.vectors(spark, sf_dir).select(F.col("vec_id").alias("cloud_id"), F.array("embedding").alias("vectors"))
    hits = search.all_distances(X.as_queries(v), v).filter("query_id <> cloud_id and distance < -0.2")
    of = lambda c: F.floor(F.sqrt(c))
    want = found(search.sum_of_minima(hits.select(of("query_id").alias("query_id"), F.col("query_id").alias("query_pos"), of("cloud_id").alias("cloud_id"), "distance")))
    c = X.clouds_ragged(spark, sf_dir)
    assert found(search.sums_of_minima(X.as_queries(c), c, -0.2)) == want
    monkeypatch.setattr(K, "TILE_Q", 5)
    asks = [tuple(x) for x in search._sums(SimpleNamespace(value=[b for p in search.packed(X.as_queries(c), "query_id") for b in p]), K.Measure("ip"), -0.2)(iter([_arrow(c)]))]
    assert sorted((q, d, round(s, 9)) for b in asks for q, d, s in zip(*[x.to_pylist() for x in b])) == want


def _arrow(clouds):
    return clouds.select("cloud_id", "vectors").toArrow().combine_chunks().to_batches()[0]


def test_work_is_spread_over_all_cores(spark, sf_dir):
    """Tables of a few bytes that are compared for minutes are not left to one task."""
    cores = spark.sparkContext.defaultParallelism
    c = X.clouds8(spark, sf_dir)
    centers = X.clouds_label(spark, sf_dir).select(F.col("cloud_id").cast("int").alias("cluster"), "vectors")
    for df in (search.exact_top_k(X.as_queries(c), c, 3, scorer=None), search.all_distances(X.as_queries(c), c), cluster.top_centers(c, centers, "ip", 1)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert f"Repartition {cores}, true" in plan
