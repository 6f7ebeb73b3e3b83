from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from polycloud.operators import search
from polycloud.plans import fixtures as X
from polycloud.plans import index as plans
from polycloud.plans.index import build
from polycloud.plans.params import ALL, IndexParams, SearchParams


def rows_of(df):
    return [(r.query_id, r.cloud_id, round(r.distance, 6)) for r in df.orderBy("query_id", "rank").collect()]


@pytest.mark.parametrize("family", ["flat", "cluster_tree", "lists", "spill_tree", "vector_tree", "emd_routes"])
def test_reading_all_takes_no_pair_anywhere(spark, sf_dir, family, monkeypatch):
    """Lists read whole and scored anew whole are one scan: no query travels to every list, no cloud to every query."""
    c = X.clouds8(spark, sf_dir)
    q = X.as_queries(c)
    index = build(c, IndexParams.of(family, max_leaf=24, niters=1, prototypes=4, bucket=16))
    want = rows_of(search.exact_top_k(q, c, 5))
    for name in ("score_pairs", "score_lists"):
        monkeypatch.setattr(search, name, lambda *a, **k: pytest.fail("pairs travel"))
    assert rows_of(index.search(q, SearchParams(k=5, nprobes=10_000, num_rerank=100_000))) == want


def test_reading_all_reads_what_the_index_lists(spark, sf_dir):
    c = X.clouds8(spark, sf_dir)
    index = build(c, IndexParams.of("lists", niters=1))
    index.tables["postings"] = index.tables["postings"].filter("cloud_id <> 3")
    got = index.search(X.as_queries(c), SearchParams(k=100, nprobes=ALL, num_rerank=ALL))
    assert got.filter("cloud_id = 3").count() == 0 and got.select("cloud_id").distinct().count() == c.count() - 1


def test_exact_scores_are_not_taken_twice(spark, sf_dir, monkeypatch):
    q, c = X.held_out(X.clouds8(spark, sf_dir))
    index = build(c, IndexParams.of("lists", niters=1))
    want = rows_of(index.search(q, SearchParams(k=5, nprobes=3, num_rerank=20, rerank_on="tq8", quantizer="tq8")))
    monkeypatch.setattr(search, "rerank", lambda *a, **k: pytest.fail("scored again"))
    assert len(rows_of(index.search(q, SearchParams(k=5, nprobes=3, num_rerank=20)))) == len(want)


def test_vector_hits_are_not_capped(spark, sf_dir):
    """With every list read, each cloud is a candidate and every query vector counts, however few are scored anew."""
    c = X.clouds8(spark, sf_dir)
    q = X.as_queries(c.filter("cloud_id % 9 = 0"))
    index = build(c, IndexParams.of("vector_tree", max_leaf=24, niters=1))
    got = plans._search_vector_tree(index, q, SearchParams(k=1, nprobes=ALL // 2, num_rerank=1)).join(q.select("query_id", F.size("vectors").alias("n")), "query_id")
    want = {(r.query_id, r.cloud_id): r.distance for r in search.all_distances(q, c).collect()}
    mine = {(r.query_id, r.cloud_id): r.distance / r.n for r in got.collect()}
    assert set(mine) == set(want) and all(abs(mine[x] - want[x]) < 1e-6 for x in want)
