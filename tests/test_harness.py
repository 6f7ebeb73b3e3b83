from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from polycloud.functions import register
from polycloud.operators import clouds as C
from polycloud.operators import cluster, evaluate, harness, search
from polycloud.plans import fixtures as X
from polycloud.plans.index import build
from polycloud.plans.params import IndexParams
from polycloud.sources import datasets


@pytest.fixture(scope="module")
def case(spark):
    g = np.random.default_rng(7)
    rows = [(i, (g.normal(size=(3, 8)) + 3 * np.eye(8)[i % 4]).tolist()) for i in range(40)]
    c = spark.createDataFrame(rows, "cloud_id long, vectors array<array<float>>").cache()
    q = X.as_queries(c.filter("cloud_id < 8"))
    return c, q, search.exact_top_k(q, c, 4).cache()


def test_measuring_searches(spark, case, tmp_path):
    c, q, truth = case
    answer = lambda some: search.exact_top_k(some, c, 4)
    found, seconds = harness.stage_times([("score", lambda _: search.all_distances(q, c)), ("rank", lambda s: search.ranked(s, 4))])
    assert set(seconds) == {"score", "rank"} and found.count() == 32
    assert harness.scores(answer, q, truth, 4) == {"recall_1_k": 1.0, "recall_k_k": 1.0, "found": 4.0}
    assert harness.latencies(answer, q, 2).count() == 2
    calls = harness.until([{"n": n} for n in range(6)], lambda p: {"qps": 10 - 3 * p["n"], "recall_k_k": 0.5}, min_qps=5)
    assert [p["n"] for p in calls] == [0, 1, 2, 3]
    made = harness.built(lambda: build(c, IndexParams.of("lists", max_leaf=10, niters=1)), f"{tmp_path}/i")
    assert made["rows"]["clouds"] == 40 and made["bytes"]["clouds"] > 0 and made["seconds"] > 0
    swept = harness.compression_sweep(q, c, truth, 4, [0.0, 1e9])
    assert swept[0]["size"] == 3 and swept[0]["recall"] == 1 and swept[1]["size"] == 1


def test_quality_of_all_pairs():
    v = np.random.default_rng(0).normal(size=(60, 16))
    got = {x["quantizer"]: x for x in harness.all_pairs_quality(v, ["none", "tq8", "tq4", "tq2"])}
    assert got["none"]["error"] < 1e-12 and got["tq8"]["error"] < got["tq4"]["error"] < got["tq2"]["error"] and got["tq8"]["correlation"] > 0.99


def test_routing_studies(spark, case):
    c, q, truth = case
    postings = c.select((F.col("cloud_id") % 4).alias("leaf_id"), "cloud_id")
    cover = {(r.query_id, r.round): r.covered for r in harness.greedy_cover(truth, postings, 4).collect()}
    assert all(sum(cover.get((i, n), 0) for n in range(1, 5)) == 4 for i in range(8))
    assert all(cover[i, 1] >= cover.get((i, 2), 0) for i in range(8))
    per = harness.leaf_simulation(postings, truth, truth, 4).agg(F.sum("wanted"), F.sum("kept")).first()
    assert tuple(per) == (32, 32)
    report = harness.route_report(truth, truth, truth, 4)
    assert report["recall"] == 1 and report["candidates"] == 4 == report["candidates_p50"]
    parents = spark.createDataFrame([(n, n // 2) for n in range(4)], "leaf_id long, parent_id long")
    probes = q.select("query_id", (F.col("query_id") % 4).alias("leaf_id"))
    assert all(0 <= r.recall <= 1 for r in harness.parent_pool_recall(truth, postings, parents, probes).collect())
    first = evaluate.routed_prefix(truth, probes.withColumn("rank", F.lit(1)), postings)
    assert first.count() == 32 and first.filter("first_probe = 1").count() > 0


def test_fronts_are_thinned(spark):
    front = spark.createDataFrame([("a", r / 1000, 100.0 - r / 10) for r in (900, 904, 911, 925, 930)], "method string, recall double, qps double")
    assert sorted(r.recall for r in evaluate.spaced(front).collect()) == [0.9, 0.911, 0.93]


def test_forming_clouds(spark, case):
    c, q, truth = case
    made = C.from_arrays(spark, np.arange(8.0), np.array([0, 4, 4, 8]), 2, np.array([5, 6, 7]))
    assert [(r.cloud_id, r.vectors) for r in made.orderBy("cloud_id").collect()] == [(5, [[0.0, 1.0], [2.0, 3.0]]), (6, []), (7, [[4.0, 5.0], [6.0, 7.0]])]
    with pytest.raises(ValueError):
        C.from_arrays(spark, np.arange(8.0), np.array([0, 3, 8]), 2)
    with pytest.raises(Exception, match="no vector left"):
        C.clean(spark.createDataFrame([(1, [[0.0, 0.0]])], c.schema), strict=True).collect()
    some, gt = C.subsample_with_truth(q, truth, 3)
    assert some.count() == 3 and gt.select("query_id").distinct().count() == 3 and gt.count() == 12


def test_centroid_tables_and_spark_kmeans(spark, case):
    c, q, truth = case
    v = C.flatten(c).select((F.col("cloud_id") * 100 + F.col("vec_pos")).alias("vec_id"), "v")
    centers, placed, cost = cluster.spark_kmeans(v, 6)
    assert centers.shape == (6, 8) and placed.count() == 120 and cost > 0
    found = search.via_centroids(q, c, 4, centers, shortlist=40)
    assert evaluate.mean_recall(found, truth, 4).first().recall_k_k == 1
    every = np.array([r.v for r in v.collect()], np.float64)
    assert evaluate.mean_recall(search.via_centroids(q, c, 4, every), truth, 4).first().recall_k_k == 1


def test_probe_as_a_table_function(spark, case):
    c, q, _ = case
    centers = [(r.cloud_id, r.vectors) for r in c.filter("cloud_id >= 30").collect()]
    register.register_probe(spark, centers)
    q.createOrReplaceTempView("asking")
    got = {(r.query_id, r.rank): r.leaf_id for r in spark.sql("SELECT query_id, p.* FROM asking, LATERAL probe(vectors, 2) p").collect()}
    want = search.exact_top_k(q, c.filter("cloud_id >= 30"), 2).collect()
    assert got == {(r.query_id, r.rank): r.cloud_id for r in want}


def test_other_layouts_of_datasets(spark, tmp_path):
    at = tmp_path / "test"
    at.mkdir()
    (at / "collection.tsv").write_text('0\tone "quoted\n1\ttwo\n')
    (at / "questions.search.tsv").write_text("7\twhat\n")
    (at / "qas.search.jsonl").write_text(json.dumps({"qid": 7, "query": "what", "answer_pids": [1, 0]}) + "\n")
    d = datasets.load_passages(spark, str(tmp_path))
    assert sorted(map(tuple, d.corpus.collect())) == [("0", 'one "quoted'), ("1", "two")]
    assert sorted(map(tuple, d.qrels.collect())) == [("7", "0", 1), ("7", "1", 1)]
    spark.createDataFrame([(1, bytearray(b"x"))], "`corpus-id` int, image binary").write.parquet(f"{tmp_path}/corpus")
    spark.createDataFrame([(2, "q")], "`query-id` int, query string").write.parquet(f"{tmp_path}/queries")
    spark.createDataFrame([(2, 1, 1), (2, 3, 0)], "`query-id` int, `corpus-id` int, score int").write.parquet(f"{tmp_path}/qrels")
    d = datasets.load_pages(spark, str(tmp_path))
    assert list(map(tuple, d.qrels.collect())) == [("2", "1", 1)] and d.corpus.first().id == "1"
