from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.errors import PythonException, SparkRuntimeException
from pyspark.sql import Window
from pyspark.sql import functions as F

from polycloud.functions import register
from polycloud.functions import vector as V
from polycloud.operators import clouds as C
from polycloud.operators import cluster, evaluate, search
from polycloud.plans import fixtures as X
from polycloud.plans import index as plans
from polycloud.plans.index import Index, build
from polycloud.plans.params import IndexParams, SearchParams
from polycloud.streaming.query_stream import serve

SCHEMA = "cloud_id long, vectors array<array<float>>"


def clouds_of(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), SCHEMA)


def rows_of(df):
    return [(r.query_id, r.cloud_id, round(r.distance, 6)) for r in df.orderBy("query_id", "rank").collect()]


def test_golden_ground_truth_ip(spark):
    docs = clouds_of(spark, [[[1.0, 0.0], [0.0, 1.0]], [[-1.0, 0.0], [0.0, -1.0]]])
    asks = X.as_queries(clouds_of(spark, [[[1.0, 0.0]], [[-1.0, 0.0], [0.0, -1.0]]]))
    assert rows_of(search.exact_top_k(asks, docs, 2, "ip")) == [(0, 0, -1), (0, 1, 0), (1, 1, -1), (1, 0, 0)]


def test_golden_ground_truth_l2(spark):
    docs = clouds_of(spark, [[[1.0, 0.0], [0.0, 1.0]], [[-1.0, 0.0]]])
    asks = X.as_queries(clouds_of(spark, [[[1.0, 0.0], [0.0, -1.0]]]))
    assert rows_of(search.exact_top_k(asks, docs, 2, "l2")) == [(0, 0, 1), (0, 1, 3)]


def test_edges_of_exact_search(spark):
    docs = clouds_of(spark, [[[1.0, 0.0]], [], None, [[1.0, 0.0]]])
    asks = X.as_queries(clouds_of(spark, [[[1.0, 0.0]], None, []]))
    assert rows_of(search.exact_top_k(asks, docs, 9)) == [(0, 0, -1), (0, 3, -1)]  # a tie, fewer rows than k
    assert search.exact_top_k(asks.limit(0), docs, 3).count() == 0
    assert search.exact_top_k(asks, docs.limit(0), 3).count() == 0
    with pytest.raises(ValueError):
        search.exact_top_k(asks, docs, 1, "cosine")


def test_native_functions_agree_with_kernels(spark, sf_dir):
    register.register(spark)
    c = X.clouds8(spark, sf_dir).filter("cloud_id < 12")
    pairs = c.select(F.col("vectors").alias("a")).limit(3).crossJoin(c.select(F.col("vectors").alias("b")))
    got = pairs.select(V.chamfer("a", "b", "l2").alias("n"), F.expr("chamfer_l2(a, b)").alias("p"), V.chamfer("a", "b", "ip").alias("i"), F.expr("chamfer_ip(a, b)").alias("j"), F.expr("emd(a, b)").alias("e")).collect()
    assert all(abs(r.n - r.p) < 1e-6 and abs(r.i - r.j) < 1e-6 and r.e >= 0 for r in got)


def test_cloud_operators(spark):
    c = clouds_of(spark, [[[0.0, 0.0], [3.0, 4.0], [0.0, 2.0]], [[0.0, 0.0]]])
    assert [[list(map(lambda x: round(x, 6), v)) for v in r.vectors] for r in C.clean(c).collect()] == [[[0.6, 0.8], [0.0, 1.0]]]
    bad = clouds_of(spark, [[[float("nan"), 1.0]], [], [[1.0], [1.0, 2.0]]])
    v = C.validate(bad).first()
    assert (v.empty, v.non_finite, v.ragged_dim) == (1, 1, 1)
    with pytest.raises((SparkRuntimeException, PythonException, Exception)):
        C.checked(bad).collect()
    assert C.subsample(c, 1, "cloud_id").count() == 1
    assert {r.cloud_id for r in C.only(c, spark.createDataFrame([(1,)], "cloud_id long")).collect()} == {1}


@pytest.mark.parametrize("family", ["flat", "cluster_tree", "lists", "spill_tree", "fde_scan", "fde_graph", "pooled_scan", "pooled_graph", "cloud_graph", "vector_tree", "vector_graph", "emd_routes"])
def test_families_find_most_neighbours(spark, sf_dir, family):
    q, c = X.held_out(X.clouds8(spark, sf_dir))
    index = build(c, IndexParams.of(family, max_leaf=12, niters=2, prototypes=8, bucket=32, shard_rows=512))
    truth = search.exact_top_k(q, c, 5)
    found = index.search(q, SearchParams(k=5, nprobes=14 if family == "spill_tree" else 6, num_rerank=25))
    assert found.groupBy("query_id").count().agg(F.max("count")).first()[0] <= 5
    assert evaluate.mean_recall(found, truth, 5).first().recall_k_k >= 0.6


def test_a_tree_that_peels_slowly_posts_every_cloud(spark, monkeypatch):
    def peel(at, centers, metric, top=1):  # all but one cloud of a node stay together
        last = F.max("cloud_id").over(Window.partitionBy("node_id"))
        return at.select("node_id", "cloud_id", (F.col("cloud_id") == last).cast("int").alias("child"), F.lit(0.0).alias("distance"), "vectors")

    monkeypatch.setattr(plans, "cluster", SimpleNamespace(**{**vars(cluster), "assign": peel}))
    c = clouds_of(spark, [[[float(i)]] for i in range(40)])
    index = build(c, IndexParams.of("cluster_tree", metric="l2", max_leaf=2, niters=1))
    assert index.height() == 12  # the cap is met
    assert index.flat_clustering().select("cloud_id").distinct().count() == 40
    assert index.tables["nodes"].filter("not is_leaf and level = 12").count() == 0


def test_emd_routes_reach_every_cloud(spark, sf_dir):
    q, c = X.held_out(X.clouds8(spark, sf_dir))
    index = build(c, IndexParams.of("emd_routes", prototypes=4, bucket=6))
    assert index.tables["buckets"].select("cloud_id").distinct().count() == c.count()
    full = index.search(q, SearchParams(k=5, nprobes=4, num_rerank=10_000))
    assert rows_of(full) == rows_of(search.exact_top_k(q, c, 5))


def test_emd_routes_recall(spark, sf_dir):
    q, c = X.held_out(X.clouds8(spark, sf_dir))
    truth = search.exact_top_k(q, c, 10)
    index = build(c, IndexParams.of("emd_routes", prototypes=8, bucket=24))
    for n in (4, 6):
        found = index.search(q, SearchParams(k=10, nprobes=n, num_rerank=100))
        assert evaluate.mean_recall(found, truth, 10).first().recall_k_k >= 0.9


def test_save_load_and_introspection(spark, sf_dir, tmp_path):
    q, c = X.held_out(X.clouds8(spark, sf_dir))
    index = build(c, IndexParams.of("cluster_tree", max_leaf=12, niters=1))
    index.save(f"file://{tmp_path}/i")
    again = Index.load(spark, f"file://{tmp_path}/i")
    sp = SearchParams(k=3, nprobes=4, num_rerank=10, quantizer="tq8", rerank_on="tq8")
    assert rows_of(again.search(q, sp)) == rows_of(index.search(q, sp))
    assert again.flat_clustering().select("cloud_id").distinct().count() == c.count()
    assert again.root_child_clustering().select("cloud_id").distinct().count() == c.count()
    assert again.height() >= 1
    assert again.probe(q, SearchParams(nprobes=2, strategy="flat_leaf")).groupBy("query_id").count().agg(F.max("count")).first()[0] == 2


def test_clustering_separates_far_groups(spark):
    g = np.random.default_rng(0)
    rows = [(g.normal(size=(3, 4)) + (20 if i % 2 else 0)).tolist() for i in range(20)]
    _, placed = cluster.cluster(clouds_of(spark, rows), 2, "l2", iters=3)
    by = {}
    for r in placed.collect():
        by.setdefault(r.cloud_id % 2, set()).add(r.cluster)
    assert by[0].isdisjoint(by[1])
    order, radius = cluster.farthest_first([np.array(r) for r in rows], 3)
    assert len(set(order)) == 3 and radius == sorted(radius, reverse=True)


def test_centers_past_the_block_bound(spark, monkeypatch):
    """Nodes in several blocks, and one node's centers over several blocks, cluster as in one."""
    g = np.random.default_rng(1)
    rows = [(i % 3, i, (g.normal(size=(2, 4)) + 5 * (i % 6)).tolist()) for i in range(90)]
    c = spark.createDataFrame(rows, "node_id long, cloud_id long, vectors array<array<float>>")
    ks, counts = {0: 4, 1: 3, 2: 5}, {0: 30, 1: 30, 2: 30}
    one = cluster.train(c, ks, counts, "l2", 2)
    placed = {(r.cloud_id, r.child) for r in cluster.assign(c, one, "l2", 2).collect()}
    monkeypatch.setattr(cluster, "CENTER_BYTES", 200)
    assert len(cluster.center_blocks(one)) > 3
    assert {(r.cloud_id, r.child) for r in cluster.assign(c, one, "l2", 2).collect()} == placed
    many = cluster.train(c, ks, counts, "l2", 2)
    key = lambda d: sorted((r.node_id, r.child, str(np.round(r.vectors, 4))) for r in d.collect())
    assert key(one) == key(many)
    tree = build(c.select("cloud_id", "vectors"), IndexParams.of("cluster_tree", metric="l2", max_leaf=6, niters=1))
    assert tree.flat_clustering().select("cloud_id").distinct().count() == 90


def test_lists_in_parts_score_the_same(spark, sf_dir, monkeypatch):
    q, c = X.held_out(X.clouds8(spark, sf_dir))
    lists = c.withColumn("leaf_id", F.col("cloud_id") % 3)
    probes = q.select("query_id", F.explode(F.array(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("leaf_id"))
    whole = {(r.query_id, r.cloud_id, round(r.distance, 9)) for r in search.score_lists(probes, q, lists).collect()}
    monkeypatch.setattr(search, "LIST_CLOUDS", 4)
    monkeypatch.setattr(search, "LIST_QUERIES", 2)
    assert {(r.query_id, r.cloud_id, round(r.distance, 9)) for r in search.score_lists(probes, q, lists).collect()} == whole
    assert len(whole) == q.count() * lists.filter("leaf_id <> 1").count()


def test_graphs_of_several_cells(spark, sf_dir):
    from polycloud.operators import graph

    c = X.clouds2(spark, sf_dir)
    q = X.as_queries(c.filter("cloud_id % 10 = 0"))
    made, routes = graph.build_graphs(c, "ip", 16, 32, 1.0, 60, two_pass=True)
    made = cluster.persisted(made)
    assert made.select("cloud_id").distinct().count() == c.count() and routes.count() > 1
    truth = search.exact_top_k(q, c, 5)
    everywhere = search.ranked(graph.search_graphs(q, made, routes, 5, 64, "ip", cells=100), 5)
    assert evaluate.mean_recall(everywhere, truth, 5).first().recall_k_k >= 0.95
    one = graph.search_graphs(q, made, routes, 5, 64, "ip", cells=1)
    assert one.select("query_id").distinct().count() == q.count()
    assert graph.edges_of(made).select("node_id").distinct().count() >= 0.9 * c.count()


def test_saved_codebooks_and_routing(spark, sf_dir, tmp_path):
    q, c = X.held_out(X.clouds8(spark, sf_dir))
    index = build(c, IndexParams.of("emd_routes", prototypes=4, bucket=6, bucket_build="tq8"))
    sp = SearchParams(k=3, nprobes=2, num_rerank=10, quantizer="pq", routing="graph")
    want = rows_of(index.search(q, sp))
    index.save(f"file://{tmp_path}/e")
    again = Index.load(spark, f"file://{tmp_path}/e")
    assert "pq" in again._fitted and rows_of(again.search(q, sp)) == want
    other = spark.read.parquet(f"{tmp_path}/e/prototypes").withColumn("train_row", F.col("train_row") + 1)
    rows = other.collect()
    spark.createDataFrame(rows, other.schema).write.mode("overwrite").parquet(f"{tmp_path}/e/prototypes")
    with pytest.raises(ValueError, match="other prototypes"):
        Index.load(spark, f"file://{tmp_path}/e")


def test_duplicate_heaps_two_stages_and_bounds(spark):
    g = np.random.default_rng(5)
    v = [(i, (g.normal(size=3) + 10 * (i % 2)).tolist()) for i in range(60)] + [(100 + i, [50.0, 50.0, 50.0]) for i in range(40)]
    d = spark.createDataFrame(v, "vec_id long, v array<float>")
    centers, placed, sizes = cluster.subsample_assign(d, 3, max_size=30)
    assert placed.count() == 100 and sizes.agg(F.sum("size")).first()[0] == 100
    assert all(r.kept or r.size >= 38 for r in sizes.collect()) and sizes.filter("not kept").count() <= 1
    coarse, rest, code = cluster.two_stage(np.array([x for _, x in v]), 3, 8)
    x = np.array([x for _, x in v])
    assert ((x - coarse[code[:, 0]] - rest[code[:, 1]]) ** 2).sum() <= ((x - coarse[code[:, 0]]) ** 2).sum()
    clouds = clouds_of(spark, [(g.normal(size=(3, 4)) + 20 * (i % 2)).tolist() for i in range(20)])
    low = cluster.cost_lower_bound(clouds, 2, 1).first().cost
    whole = cluster.weighted_vector_cost(clouds, np.array([[0.0] * 4])).first().cost
    assert 0 < low < whole


def test_recall_counts_ties(spark):
    truth = spark.createDataFrame([(0, 1, 5, 1.0), (0, 2, 6, 2.0), (0, 3, 7, 2.0)], "query_id long, rank int, cloud_id long, distance double")
    found = spark.createDataFrame([(0, 5), (0, 6), (0, 7)], "query_id long, cloud_id long")
    assert evaluate.recall(found, truth, 2).first().recall == 1.5
    assert evaluate.needed_for_full_recall(truth, truth, 3).first().needed == 3
    assert len(evaluate.sweep({"a": [1, 2], "b": [3]}, {"x": {"b": [4, 5]}})) == 4


def test_qrels_mapping(spark):
    qrels = spark.createDataFrame([("q0", "missing", 1), ("q1", "d2", 1), ("q1", "d1", 1), ("q1", "d2", 1)], "query_id string, doc_id string, score int")
    rows = spark.createDataFrame([(7, "d1"), (3, "d2")], "row long, external_id string")
    gold, report = search.map_qrels(qrels, rows)
    assert sorted((r.query_id, r.cloud_id) for r in gold.collect()) == [("q1", 3), ("q1", 7)]
    assert tuple(report.first()) == (1, 1)


def test_query_stream_answers_once(spark, sf_dir, tmp_path):
    q, c = X.held_out(X.clouds8(spark, sf_dir))
    q.write.parquet(f"{tmp_path}/in")
    index = build(c, IndexParams.of("flat"))
    s = serve(spark.readStream.schema(q.schema).parquet(f"{tmp_path}/in"), index, SearchParams(k=2, num_rerank=0), f"{tmp_path}/out", f"{tmp_path}/cp")
    s.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2 * q.count()


def test_command_line(spark, sf_dir, tmp_path):
    from polycloud.__main__ import main

    q, c = X.held_out(X.clouds8(spark, sf_dir))
    c.write.parquet(f"{tmp_path}/c")
    q.write.parquet(f"{tmp_path}/q")
    main(["build", f"{tmp_path}/c", f"{tmp_path}/i", "--family", "lists", "--niters", "1"])
    main(["search", f"{tmp_path}/i", f"{tmp_path}/q", f"{tmp_path}/r", "--k", "3", "--nprobes", "100"])
    main(["truth", f"{tmp_path}/c", f"{tmp_path}/q", f"{tmp_path}/t", "--k", "3"])
    main(["sweep", f"{tmp_path}/i", f"{tmp_path}/q", f"{tmp_path}/t", f"{tmp_path}/s", "--k", "3", "--nprobes", "1", "100"])
    assert rows_of(spark.read.parquet(f"{tmp_path}/r")) == rows_of(spark.read.parquet(f"{tmp_path}/t"))
    swept = spark.read.option("header", True).csv(f"{tmp_path}/s").orderBy(F.col("nprobes").cast("int")).collect()
    assert [float(r.recall_k_k) <= 1 for r in swept] == [True, True] and float(swept[1].recall_k_k) == 1
