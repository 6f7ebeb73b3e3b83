"""Quality and throughput reports, all relational."""

from __future__ import annotations

import itertools
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def recall(found: DataFrame, truth: DataFrame, k_gt: int, tie: float = 1e-6) -> DataFrame:
    """(query_id, recall): found ids among the first ``k_gt`` true ones, over ``k_gt``; true ids tied with the last also count."""
    last = truth.filter(F.col("rank") == k_gt).select("query_id", F.col("distance").alias("last"))
    good = truth.join(last, "query_id", "left").filter((F.col("rank") <= k_gt) | (F.abs(F.col("distance") - F.col("last")) < tie)).select("query_id", "cloud_id")
    hits = found.select("query_id", "cloud_id").distinct().join(good, ["query_id", "cloud_id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("hits"))
    return truth.select("query_id").distinct().join(hits, "query_id", "left").select("query_id", (F.coalesce("hits", F.lit(0)) / k_gt).alias("recall"))


def mean_recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row: recall_1_k (the nearest is among the found) and recall_k_k."""
    one = recall(found, truth, 1).agg(F.avg(F.least("recall", F.lit(1.0))).alias("recall_1_k"))
    return one.crossJoin(recall(found, truth, k).agg(F.avg("recall").alias("recall_k_k")))


def percentiles(rows: DataFrame, value: str, points: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Exact percentiles with linear interpolation, one column p50, p95, ... each."""
    return rows.agg(*[F.percentile(value, p).alias(f"p{round(100 * p)}") for p in points])


def over_retrieval(found: DataFrame, truth: DataFrame, k: int, budgets: tuple[int, ...]) -> DataFrame:
    """(budget, recall): mean share of the true top ``k`` among the first ``budget`` of an approximate ranking."""
    gold = truth.filter(F.col("rank") <= k).select("query_id", "cloud_id")
    n = gold.select("query_id").distinct().count()
    hit = found.join(gold, ["query_id", "cloud_id"])
    return hit.agg(*[F.sum((F.col("rank") <= b).cast("int")).alias(str(b)) for b in budgets]).select(F.explode(F.array(*[F.struct(F.lit(b).alias("budget"), (F.coalesce(F.col(str(b)), F.lit(0)) / (n * k)).alias("recall")) for b in budgets])).alias("x")).select("x.*")


def needed_for_full_recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(query_id, needed): the rank by which all of the true top ``k`` have appeared; null if one never does."""
    gold = truth.filter(F.col("rank") <= k).select("query_id", "cloud_id")
    both = gold.join(found.select("query_id", "cloud_id", "rank"), ["query_id", "cloud_id"], "left")
    return both.groupBy("query_id").agg(F.when(F.count("rank") == F.count("*"), F.max("rank")).alias("needed"))


def routed_prefix(truth: DataFrame, probes: DataFrame, postings: DataFrame) -> DataFrame:
    """(query_id, cloud_id, first_probe): how many ranked lists must be probed before each true neighbour is seen."""
    placed = probes.select("query_id", "leaf_id", F.col("rank").alias("probe")).join(postings, "leaf_id")
    return truth.select("query_id", "cloud_id").join(placed, ["query_id", "cloud_id"], "left").groupBy("query_id", "cloud_id").agg(F.min("probe").alias("first_probe"))


def pareto(rows: DataFrame, recall_col: str = "recall", qps: str = "qps", by: str = "method") -> DataFrame:
    """Points no other of the same method beats in both recall and throughput."""
    best = rows.groupBy(by, recall_col).agg(F.max(qps).alias(qps))
    above = F.max(qps).over(Window.partitionBy(by).orderBy(F.desc(recall_col)).rowsBetween(Window.unboundedPreceding, -1))
    return best.withColumn("_m", above).filter(F.col("_m").isNull() | (F.col(qps) > F.col("_m"))).drop("_m")


def spaced(front: DataFrame, gap: float = 0.01, recall_col: str = "recall", by: str = "method") -> DataFrame:
    """A front thinned for plotting: from the highest recall down, points at least ``gap`` below the last one kept; the highest stays."""
    ordered = F.reverse(F.array_sort(F.collect_list(F.struct(recall_col, F.struct(*[c for c in front.columns if c != by]).alias("row")))))
    keep = lambda acc, x: F.when((F.size(acc) == 0) | (F.element_at(acc, -1)[recall_col] - x[recall_col] >= gap - 1e-12), F.concat(acc, F.array(x))).otherwise(acc)
    rows = front.groupBy(by).agg(ordered.alias("o")).select(by, F.aggregate("o", F.filter("o", lambda x: F.lit(False)), keep).alias("kept"))
    return rows.select(by, F.explode("kept").alias("x")).select(by, "x.row.*")


def qps_at_recall(rows: DataFrame, target: float, recall_col: str = "recall", qps: str = "qps", by: str = "method") -> DataFrame:
    """(method, qps) interpolated linearly between the bracketing points of each front; null where the target is not reached."""
    front = pareto(rows, recall_col, qps, by)
    w = Window.partitionBy(by).orderBy(recall_col)
    d = front.withColumn("r0", F.lag(recall_col).over(w)).withColumn("q0", F.lag(qps).over(w))
    up = d.filter(F.col(recall_col) >= target).withColumn("n", F.row_number().over(w)).filter("n = 1")
    value = F.when(F.col("r0").isNull(), F.col(qps)).otherwise(F.col("q0") + (F.col(qps) - F.col("q0")) * (F.lit(target) - F.col("r0")) / (F.col(recall_col) - F.col("r0")))
    return front.select(by).distinct().join(up.select(by, value.alias(qps)), by, "left")


def best_qps(rows: DataFrame, target: float, recall_col: str = "recall", qps: str = "qps", by: str = "method") -> DataFrame:
    return rows.groupBy(by).agg(F.max(F.when(F.col(recall_col) >= target, F.col(qps))).alias(qps))


def geometric_mean(rows: DataFrame, value: str, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.exp(F.avg(F.ln(value))).alias(value))


def clustering_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (ari, nmi) of two labelings (item, label)."""
    t = a.select("item", F.col("label").alias("x")).join(b.select("item", F.col("label").alias("y")), "item").groupBy("x", "y").agg(F.count("*").cast("double").alias("n"))
    rows, cols = t.groupBy("x").agg(F.sum("n").alias("a")), t.groupBy("y").agg(F.sum("n").alias("b"))
    two = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    s = t.agg(F.sum("n").alias("t"), two("n").alias("ij")).crossJoin(rows.agg(two("a").alias("i"), F.sum(-F.col("a") * F.ln("a")).alias("ha"))).crossJoin(cols.agg(two("b").alias("j"), F.sum(-F.col("b") * F.ln("b")).alias("hb")))
    s = s.crossJoin(t.join(rows, "x").join(cols, "y").agg(F.sum(F.col("n") * F.ln(F.col("n") / (F.col("a") * F.col("b")))).alias("m")))
    pairs = F.col("t") * (F.col("t") - 1) / 2
    expected = F.when(pairs > 0, F.col("i") * F.col("j") / pairs).otherwise(0.0)
    top = (F.col("i") + F.col("j")) / 2 - expected
    mutual = F.col("m") / F.col("t") + F.ln("t")
    ha, hb = F.col("ha") / F.col("t") + F.ln("t"), F.col("hb") / F.col("t") + F.ln("t")
    mean = (ha + hb) / 2
    return s.select(F.when(F.abs(top) > 1e-12, (F.col("ij") - expected) / top).otherwise(1.0).alias("ari"), F.when(mean > 1e-12, mutual / mean).otherwise(1.0).alias("nmi"))


def assignment_stats(assigned: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Per cluster: size, radius, mean and median distance."""
    return assigned.groupBy(cluster).agg(F.count("*").alias("size"), F.max("distance").alias("radius"), F.avg("distance").alias("mean"), F.percentile("distance", 0.5).alias("median"))


def tree_stats(nodes: DataFrame) -> DataFrame:
    """One row: nodes, leaves, height, mean leaf size, parents whose children are unbalanced ((max - min) / total >= 0.8). ``nodes(node_id, parent_id, level, is_leaf, n_clouds)``."""
    per = nodes.filter("parent_id is not null").groupBy("parent_id").agg(((F.max("n_clouds") - F.min("n_clouds")) / F.sum("n_clouds")).alias("spread"))
    return nodes.agg(F.count("*").alias("nodes"), F.sum(F.col("is_leaf").cast("long")).alias("leaves"), F.max("level").alias("height"), F.avg(F.when(F.col("is_leaf"), F.col("n_clouds"))).alias("mean_leaf")).crossJoin(per.agg(F.coalesce(F.sum((F.col("spread") >= 0.8).cast("long")), F.lit(0)).alias("unbalanced")))


def posting_stats(postings: DataFrame, clouds: DataFrame) -> DataFrame:
    """One row: replication of listed clouds, mean size listed and in the corpus, clouds in no list."""
    sizes = clouds.select("cloud_id", F.size("vectors").alias("n"))
    listed = postings.join(sizes, "cloud_id").agg((F.count("*") / F.countDistinct("cloud_id")).alias("replication"), F.avg("n").alias("mean_listed"))
    return listed.crossJoin(sizes.agg(F.avg("n").alias("mean_corpus"))).crossJoin(sizes.join(postings, "cloud_id", "left_anti").agg(F.count("*").alias("uncovered")))


def tfidf_clusters(tokens: DataFrame, coarse: DataFrame, r: int) -> DataFrame:
    """(cloud_id, coarse_id, weight): the ``r`` coarse clusters with the largest summed tf-idf. ``tokens(cloud_id, fine_id)``, ``coarse(fine_id, coarse_id)``."""
    n = tokens.select("cloud_id").distinct().count()
    tf = tokens.groupBy("cloud_id", "fine_id").agg(F.count("*").alias("tf"))
    idf = tf.groupBy("fine_id").agg((F.ln((1 + F.lit(n)) / (1 + F.count("*"))) + 1).alias("idf"))
    weight = tf.join(idf, "fine_id").join(coarse, "fine_id").groupBy("cloud_id", "coarse_id").agg(F.sum(F.col("tf") * F.col("idf")).alias("weight"))
    w = Window.partitionBy("cloud_id").orderBy(F.desc("weight"), "coarse_id")
    return weight.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= r).drop("n")


def timed(run: Callable[[], object], repeats: int = 3, warm: int = 1) -> float:
    """Best seconds of ``repeats`` after ``warm`` untimed runs."""
    for _ in range(warm):
        run()
    best = float("inf")
    for _ in range(repeats):
        t = time.perf_counter()
        run()
        best = min(best, time.perf_counter() - t)
    return best


def search_stats(search: Callable[[], DataFrame], truth: DataFrame, k: int, n_queries: int, repeats: int = 1) -> dict:
    """Throughput and recall of a batch search."""
    seconds = timed(lambda: search().count(), repeats)
    r = mean_recall(search(), truth, k).first()
    return {"qps": n_queries / seconds, "seconds": seconds, "recall_1_k": r.recall_1_k, "recall_k_k": r.recall_k_k}


def sweep(grid: dict[str, list], overrides: dict[str, dict[str, list]] | None = None) -> list[dict]:
    """All parameter combinations; a variant's entries replace the shared ones."""
    out = []
    for variant, own in (overrides or {"": {}}).items():
        g = {**grid, **own}
        out += [{**({"variant": variant} if variant else {}), **dict(zip(g, values))} for values in itertools.product(*g.values())]
    return out
