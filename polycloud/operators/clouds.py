"""Clouds: one row per item with its vectors. Forming, flattening, validating, filtering, sampling."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import vector as V


def group_vectors(vectors: DataFrame, cloud_id: Column, position: Column, v: str = "v") -> DataFrame:
    """clouds(cloud_id, vectors) from one vector per row, in order of ``position``."""
    rows = vectors.select(cloud_id.cast("long").alias("cloud_id"), F.struct(position.cast("long").alias("p"), F.col(v).alias("v")).alias("x"))
    return rows.groupBy("cloud_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["v"]).alias("vectors"))


def from_arrays(spark: SparkSession, data: np.ndarray, offsets: np.ndarray, dim: int, ids: np.ndarray | None = None) -> DataFrame:
    """clouds(cloud_id, vectors) from flat coordinates and offsets counted in coordinates; ids are row numbers unless given."""
    off = np.asarray(offsets, np.int64)
    if len(off) < 1 or off[0] != 0 or off[-1] != len(data) or (np.diff(off) < 0).any() or (off % dim).any():
        raise ValueError("offsets must run from 0 to the number of coordinates, whole vectors a cloud")
    n = len(off) - 1
    if ids is not None and len(ids) != n:
        raise ValueError(f"{len(ids)} ids for {n} clouds")
    vectors = K.nested(np.asarray(data, np.float32).reshape(-1, dim), off // dim)
    return spark.createDataFrame(pa.table({"cloud_id": pa.array(np.arange(n) if ids is None else np.asarray(ids), pa.int64()), "vectors": vectors}))


def flatten(clouds: DataFrame) -> DataFrame:
    """(cloud_id, vec_pos, v)."""
    return clouds.select("cloud_id", F.posexplode("vectors").alias("vec_pos", "v"))


def stats(clouds: DataFrame) -> DataFrame:
    """One row: clouds, vectors, mean, smallest and largest cloud, dimension."""
    n = F.size("vectors")
    return clouds.agg(F.count("*").alias("clouds"), F.sum(n).cast("long").alias("vectors"), F.avg(n).alias("mean_size"), F.min(n).alias("min_size"), F.max(n).alias("max_size"), F.max(F.size(F.get("vectors", F.lit(0)))).alias("dim"))


def validate(clouds: DataFrame) -> DataFrame:
    """One row of counts: empty clouds, null or non-finite coordinates, odd dimensions, rows off unit norm (by 1e-3)."""
    bad = F.exists("vectors", lambda v: v.isNull() | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    dims = F.size(F.array_distinct(F.transform("vectors", lambda v: F.size(v)))) > 1
    off = F.size(F.filter("vectors", lambda v: F.abs(F.sqrt(V.squared_norm(v)) - 1) > 1e-3))
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return clouds.agg(count(F.col("vectors").isNull() | (F.size("vectors") <= 0)).alias("empty"), count(F.coalesce(bad, F.lit(False))).alias("non_finite"), count(dims).alias("ragged_dim"), count(F.greatest(off, F.lit(0))).alias("off_unit"), F.countDistinct(F.size(F.get("vectors", F.lit(0)))).alias("dims"))


def checked(clouds: DataFrame) -> DataFrame:
    """``clouds`` without its empty ones, failing (at run time) on a non-finite coordinate."""
    bad = F.exists("vectors", lambda v: F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    return clouds.filter(F.size("vectors") > 0).withColumn("vectors", F.when(bad, F.raise_error(F.concat(F.lit("non-finite coordinate in cloud "), F.col("cloud_id").cast("string")))).otherwise(F.col("vectors")))


def only(clouds: DataFrame, ids: DataFrame) -> DataFrame:
    """Clouds whose id is in ``ids(cloud_id)``."""
    return clouds.join(ids.select("cloud_id"), "cloud_id", "left_semi")


def flatten_only(clouds: DataFrame, ids: DataFrame) -> DataFrame:
    return flatten(only(clouds, ids))


def clean(clouds: DataFrame, strict: bool = False) -> DataFrame:
    """Zero rows dropped, the others at unit norm; clouds that lose all rows are dropped, or with ``strict`` fail the query."""
    out = clouds.withColumn("vectors", V.clean_cloud("vectors"))
    if strict:
        lost = (F.size("vectors") <= 0) | F.col("vectors").isNull()
        return out.withColumn("vectors", F.when(lost, F.raise_error(F.concat(F.lit("no vector left in cloud "), F.col("cloud_id").cast("string")))).otherwise(F.col("vectors")))
    return out.filter(F.size("vectors") > 0)


def mean_pooled(clouds: DataFrame, normalize: bool = False) -> DataFrame:
    """Clouds of one vector each, the mean."""
    return clouds.select("cloud_id", F.array(V.mean_pool("vectors", normalize)).alias("vectors"))


def subsample(rows: DataFrame, n: int, id_col: str, seed: int = 0) -> DataFrame:
    """A fixed choice of ``n`` rows without replacement, by hash of the id."""
    return rows.orderBy(F.xxhash64(F.lit(seed), F.col(id_col)), id_col).limit(n)


def subsample_with_truth(queries: DataFrame, truth: DataFrame, n: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The same ``n`` queries in both tables."""
    some = subsample(queries, n, "query_id", seed)
    return some, truth.join(some.select("query_id"), "query_id", "left_semi")


def stratified_sample(rows: DataFrame, size: Column, flag: Column, n: int, strata: int = 4, id_col: str = "cloud_id", seed: int = 0) -> DataFrame:
    """``n`` rows over strata (quantiles of ``size`` x ``flag``) in proportion, by largest remainder."""
    from pyspark.sql import Window

    edges = [x / strata for x in range(1, strata)]
    cuts = rows.agg(F.percentile_approx(size, edges, 10_000).alias("c")).first()["c"] or []
    level = sum((size > c).cast("int") for c in cuts) if cuts else F.lit(0)
    d = rows.withColumn("_st", F.struct(level.alias("l"), flag.alias("f")))
    per = d.groupBy("_st").count()  # strata x flags rows
    total = F.sum("count").over(Window.partitionBy(F.lit(1)))
    quota = per.withColumn("exact", F.col("count") * n / total).withColumn("base", F.floor("exact"))
    left = F.lit(n) - F.sum("base").over(Window.partitionBy(F.lit(1)))
    quota = quota.withColumn("q", F.col("base") + (F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(F.col("exact") - F.col("base")), "_st")) <= left).cast("int"))
    pick = F.row_number().over(Window.partitionBy("_st").orderBy(F.xxhash64(F.lit(seed), F.col(id_col)), id_col))
    return d.join(F.broadcast(quota.select("_st", "q")), "_st").withColumn("_n", pick).filter("_n <= q").drop("_st", "q", "_n")
