from __future__ import annotations

import pytest

from polycloud.operators import evaluate, search
from polycloud.plans import fixtures as X
from polycloud.plans.index import build
from polycloud.plans.params import IndexParams, SearchParams


@pytest.mark.parametrize("family,sp", [("flat", SearchParams(k=10, num_rerank=10, quantizer="tq1")), ("lists", SearchParams(k=10, nprobes=1, num_rerank=10)), ("fde_scan", SearchParams(k=10, num_rerank=10)), ("pooled_graph", SearchParams(k=10, num_rerank=10, beam=10, cells=1))])
def test_a_search_widens_until_it_finds_what_it_should(spark, sf_dir, family, sp):
    """Settings that fit few clouds find too little in more of them; with a recall to reach they are where the search begins."""
    from dataclasses import replace

    c = X.clouds2(spark, sf_dir)
    q = X.as_queries(c)
    index = build(c, IndexParams.of(family, niters=1, shard_rows=64))
    truth = search.exact_top_k(q, c, 10)
    of = lambda p: evaluate.mean_recall(index.search(q, p), truth, 10).first().recall_k_k
    assert of(sp) < 0.9 <= of(replace(sp, recall=0.9))
