from __future__ import annotations

import json

import numpy as np
import pytest

from polycloud.operators import search
from polycloud.sources import datasets, formats


@pytest.fixture()
def two(spark):
    formats.register(spark)
    return spark.createDataFrame([(0, [[1.0, 0.0], [0.0, 1.0]]), (1, [[-1.0, 0.0]])], "cloud_id long, vectors array<array<float>>")


def test_clouds_round_trip(spark, two, tmp_path):
    path = str(tmp_path / "x.pcs")
    formats.write_clouds(two, path)
    assert np.fromfile(path, "<u8", 3).tolist() == [2, 2, 3]
    assert np.fromfile(path, "<u8", 4, offset=24 + 24).tolist() == [3, 0, 4, 6]
    assert sorted(map(tuple, [(r.cloud_id, str(r.vectors)) for r in spark.read.format("pcs").load(path).collect()])) == sorted((r.cloud_id, str(r.vectors)) for r in two.collect())
    assert [p.name for p in tmp_path.iterdir()] == ["x.pcs"]


def test_broken_clouds_are_refused(spark, two, tmp_path):
    bad = spark.createDataFrame([(0, [[float("inf")]])], two.schema)
    with pytest.raises(Exception, match="finite"):
        formats.write_clouds(bad, str(tmp_path / "bad.pcs"))
    assert not (tmp_path / "bad.pcs").exists()


def test_gold_truth_dense_graph_ids(spark, two, tmp_path):
    gold = spark.createDataFrame([(0, 3), (0, 8), (1, 1), (2, 0), (2, 4), (2, 9)], "query_id long, cloud_id long")
    formats.write_gold(gold, 3, str(tmp_path / "gold"))
    assert sorted(map(tuple, spark.read.format("gold").load(str(tmp_path / "gold")).collect())) == sorted(map(tuple, gold.collect()))
    asks = two.selectExpr("cloud_id as query_id", "vectors")
    truth = search.exact_top_k(asks, two, 2)
    formats.write_truth(truth, 2, str(tmp_path / "gt"))
    assert sorted(map(tuple, spark.read.format("gt").load(str(tmp_path / "gt")).collect())) == sorted(map(tuple, truth.collect()))
    dense = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "vec_id long, v array<float>")
    formats.write_dense(dense, str(tmp_path / "d"))
    assert sorted(map(str, spark.read.format("dense").load(str(tmp_path / "d")).collect())) == sorted(map(str, dense.collect()))
    graph = spark.createDataFrame([(0, [1, 2]), (1, []), (2, [0])], "node_id long, neighbors array<long>")
    formats.write_graph(graph, 2, str(tmp_path / "g"))
    assert sorted(map(str, spark.read.format("graph").load(str(tmp_path / "g")).collect())) == sorted(map(str, graph.collect()))
    ids = spark.createDataFrame([(0, "a"), (1, "b c")], "row long, external_id string")
    formats.write_ids(ids, str(tmp_path / "ids"))
    assert sorted(map(tuple, formats.read_ids(spark, str(tmp_path / "ids")).collect())) == [(0, "a"), (1, "b c")]
    with pytest.raises(ValueError):
        formats.write_ids(spark.createDataFrame([(0, "a\nb")], ids.schema), str(tmp_path / "ids2"))


def test_pipeline_end_to_end(spark, tmp_path):
    (tmp_path / "qrels").mkdir()
    (tmp_path / "corpus.jsonl").write_text("\n".join(json.dumps({"_id": f"d{i}", "title": f"t{i}", "text": f"word{i} common"}) for i in range(6)))
    (tmp_path / "queries.jsonl").write_text("\n".join(json.dumps({"_id": f"q{i}", "text": f"word{i}"}) for i in range(3)))
    (tmp_path / "qrels" / "test.tsv").write_text("query-id\tcorpus-id\tscore\nq0\td0\t1\nq1\td1\t1\nq2\td9\t1\nq2\td2\t0\n")
    data = datasets.load_jsonl(spark, str(tmp_path))
    out = datasets.generate(data, datasets.HashingTokenEncoder(16), f"file://{tmp_path}/made", 2)
    gold = {(r.query_id, r.cloud_id) for r in out["gold"].collect()}
    first = {(r.query_id, r.cloud_id) for r in out["truth"].filter("rank = 1").collect()}
    assert gold == first == {(0, 0), (1, 1)}
    with pytest.raises(ValueError, match="other settings"):
        datasets.generate(data, datasets.HashingTokenEncoder(16), f"file://{tmp_path}/made", 2, "l2")


def test_pseudo_queries_and_diverse_rows():
    q = datasets.pseudo_query("A title", "word " * 100)
    assert q == datasets.pseudo_query("A title", "word " * 100) and len(q.split()) == 32
    rows = datasets.diverse_rows(np.array([[0.0], [0.0], [5.0], [1.0]]), 3)
    assert rows.tolist() == [0, 2, 3]
