"""Small JSON documents beside Parquet tables, through Spark so that any file system works."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def write_manifest(spark: SparkSession, path: str, content: dict) -> None:
    spark.createDataFrame([(json.dumps(content, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads("".join(r.value for r in spark.read.text(path).collect()))


def reusable(spark: SparkSession, path: str, content: dict) -> bool:
    """Whether a manifest exists and says exactly this; a different one is an error, so results are never silently mixed."""
    try:
        found = read_manifest(spark, path)
    except Exception as e:  # noqa: BLE001 - a missing path differs by file system
        if "PATH_NOT_FOUND" in str(e):
            return False
        raise
    if found != content:
        raise ValueError(f"{path} was made with other settings: {found}")
    return True
