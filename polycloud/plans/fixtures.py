"""Clouds derived from the embeddings table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clouds import group_vectors


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")


def clouds_by(spark: SparkSession, sf_dir: str, cloud_id: Column) -> DataFrame:
    return group_vectors(vectors(spark, sf_dir), cloud_id, F.col("vec_id"), "embedding")


def clouds8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clouds_by(spark, sf_dir, F.floor(F.col("vec_id") / 8))


def clouds2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many small clouds."""
    return clouds_by(spark, sf_dir, F.floor(F.col("vec_id") / 2))


def clouds_ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clouds_by(spark, sf_dir, F.floor(F.sqrt(F.col("vec_id"))))


def clouds_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few large clouds."""
    return clouds_by(spark, sf_dir, F.col("label"))


def as_queries(clouds: DataFrame) -> DataFrame:
    return clouds.select(F.col("cloud_id").alias("query_id"), "vectors")


def held_out(clouds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every tenth cloud asks the others."""
    return as_queries(clouds.filter("cloud_id % 10 = 0")), clouds.filter("cloud_id % 10 <> 0")
