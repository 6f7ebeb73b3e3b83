"""Command line: build an index, search it, compute ground truth, encode a dataset, measure a sweep.

    python -m polycloud build  clouds.parquet index --family cluster_tree --metric ip
    python -m polycloud search index queries.parquet out.parquet --k 10 --nprobes 8 --rerank 50 --quantizer tq4
    python -m polycloud truth  clouds.parquet queries.parquet out.parquet --k 100
    python -m polycloud embed  dataset-folder out-folder
    python -m polycloud sweep  index queries.parquet truth.parquet out.csv --nprobes 1 2 4 8 --rerank 20 50

Clouds are Parquet (cloud_id, vectors) or a .pcs file; queries carry query_id, or cloud_id in a .pcs file.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from .operators import evaluate, search
from .plans.index import Index, build
from .plans.params import FAMILIES, IndexParams, SearchParams
from .sources import datasets, formats


def _clouds(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith(".pcs"):
        formats.register(spark)
        return spark.read.format("pcs").load(path)
    return spark.read.parquet(path)


def _queries(spark: SparkSession, path: str) -> DataFrame:
    q = _clouds(spark, path)
    return q if "query_id" in q.columns else q.withColumnRenamed("cloud_id", "query_id")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="polycloud", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build")
    b.add_argument("clouds")
    b.add_argument("index")
    b.add_argument("--family", choices=FAMILIES, default="lists")
    for name, kind in (("k-per-level", int), ("max-leaf", int), ("max-depth", int), ("niters", int), ("mpcc", int), ("fde", int), ("degree", int), ("beam", int), ("alpha", float), ("prototypes", int), ("bucket", int)):
        b.add_argument(f"--{name}", type=kind)
    s, w = sub.add_parser("search"), sub.add_parser("sweep")
    t, e = sub.add_parser("truth"), sub.add_parser("embed")
    for x in (s, w):
        x.add_argument("index")
        x.add_argument("queries")
    s.add_argument("out")
    w.add_argument("truth")
    w.add_argument("out")
    for x, many in ((s, None), (w, "+")):
        x.add_argument("--nprobes", type=int, nargs=many, default=8 if many is None else [8])
        x.add_argument("--rerank", type=int, nargs=many, default=50 if many is None else [50])
        x.add_argument("--quantizer", nargs=many, default="none" if many is None else ["none"])
        x.add_argument("--beam", type=int, default=64)
    t.add_argument("clouds")
    t.add_argument("queries")
    t.add_argument("out")
    e.add_argument("dataset")
    e.add_argument("out")
    for x in (s, w, t, e):
        x.add_argument("--k", type=int, default=10)
    for x in (b, t, e):
        x.add_argument("--metric", choices=("ip", "l2"), default="ip")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.command == "build":
        given = {k: v for k, v in vars(a).items() if v is not None and k not in ("command", "clouds", "index", "family")}
        build(_clouds(spark, a.clouds), IndexParams.of(a.family, **given)).save(a.index)
    elif a.command == "search":
        sp = SearchParams(k=a.k, nprobes=a.nprobes, num_rerank=a.rerank, quantizer=a.quantizer, beam=a.beam)
        Index.load(spark, a.index).search(_queries(spark, a.queries), sp).write.mode("overwrite").parquet(a.out)
    elif a.command == "truth":
        search.exact_top_k(_queries(spark, a.queries), _clouds(spark, a.clouds), a.k, a.metric).write.mode("overwrite").parquet(a.out)
    elif a.command == "embed":
        datasets.generate(datasets.load_jsonl(spark, a.dataset), datasets.HashingTokenEncoder(), a.out, a.k, a.metric)
    else:
        index, queries, truth = Index.load(spark, a.index), _queries(spark, a.queries).cache(), spark.read.parquet(a.truth).cache()
        n, rows = queries.count(), []
        for one in evaluate.sweep({"nprobes": a.nprobes, "num_rerank": a.rerank, "quantizer": a.quantizer}):
            got = evaluate.search_stats(lambda one=one: index.search(queries, SearchParams(k=a.k, beam=a.beam, **one)), truth, a.k, n)
            rows.append({"k": a.k, **one, **got})
        spark.createDataFrame(rows).coalesce(1).write.mode("overwrite").option("header", True).csv(a.out)


if __name__ == "__main__":
    main()
