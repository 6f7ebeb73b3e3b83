from __future__ import annotations

from pyspark.sql import functions as F

from polycloud.operators import graph


def test_a_hop_multiplies_no_repeated_edges(spark):
    """A thousand places and a thousand copies of three edges at one node: few rows meet, not a million."""
    frontier = spark.range(1000).select((F.col("id") % 50).alias("query_id"), F.lit(7).alias("node_id"))
    edges = spark.range(1000).select(F.lit(7).alias("node_id"), (F.col("id") % 3).alias("neighbor"))
    out = graph.hop(frontier, edges)
    assert {(r.query_id, r.node_id) for r in out.collect()} == {(q, n) for q in range(50) for n in range(3)}
    join = out._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)[1]
    assert join.count("Aggregate [") == 2  # both sides come without repetitions
