"""Retrieval datasets (corpus, queries, judgments) from local files, and the pipeline that encodes them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels as K
from ..operators import search
from .manifest import reusable, write_manifest


@dataclass
class Dataset:
    """corpus(id, text), queries(id, text), qrels(query_id, doc_id, score)."""

    corpus: DataFrame
    queries: DataFrame
    qrels: DataFrame


def load_jsonl(spark: SparkSession, folder: str, split: str = "test") -> Dataset:
    """corpus.jsonl and queries.jsonl (_id, title, text) and qrels/<split>.tsv; title and text are joined by a blank."""
    text = F.trim(F.concat_ws(" ", F.col("title"), F.col("text")))
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("_id", "title", "text")])
    one = lambda name: spark.read.schema(schema).json(f"{folder}/{name}.jsonl").select(F.col("_id").alias("id"), text.alias("text"))
    qrels = spark.read.option("sep", "\t").option("header", True).csv(f"{folder}/qrels/{split}.tsv")
    return Dataset(one("corpus"), one("queries"), qrels.toDF("query_id", "doc_id", "score").withColumn("score", F.col("score").cast("int")))


def load_passages(spark: SparkSession, folder: str, queries: str = "search", split: str = "test") -> Dataset:
    """collection.tsv (id, passage), questions.<queries>.tsv (id, question; sets "search" and "forum") and qas.<queries>.jsonl (qid, answer_pids), under ``folder``/``split``."""
    at = f"{folder}/{split}"
    two = lambda name: spark.read.option("sep", "\t").option("quote", "").schema("id string, text string").csv(f"{at}/{name}.tsv")
    answers = spark.read.schema("qid string, answer_pids array<string>").json(f"{at}/qas.{queries}.jsonl")
    qrels = answers.select(F.col("qid").alias("query_id"), F.explode("answer_pids").alias("doc_id"), F.lit(1).alias("score"))
    return Dataset(two("collection"), two(f"questions.{queries}"), qrels)


def load_pages(spark: SparkSession, folder: str) -> Dataset:
    """Parquet folders corpus (corpus-id, image), queries (query-id, query) and qrels (query-id, corpus-id, score); judgments of score 0 are left out. The corpus column ``text`` holds the image's bytes, for an encoder of images."""
    corpus, queries, qrels = (spark.read.parquet(f"{folder}/{x}") for x in ("corpus", "queries", "qrels"))
    image = F.col("image.bytes") if "struct" in dict(corpus.dtypes)["image"] else F.col("image")
    return Dataset(
        corpus.select(F.col("`corpus-id`").cast("string").alias("id"), image.alias("text")),
        queries.select(F.col("`query-id`").cast("string").alias("id"), F.col("query").alias("text")),
        qrels.filter("score > 0").select(F.col("`query-id`").cast("string").alias("query_id"), F.col("`corpus-id`").cast("string").alias("doc_id"), F.col("score").cast("int").alias("score")),
    )


class Encoder(Protocol):
    dim: int

    def encode(self, texts: list[str]) -> list[np.ndarray]: ...


@dataclass
class HashingTokenEncoder:
    """A deterministic stand-in for a learned encoder: one unit vector per token, seeded by the token."""

    dim: int = 32
    max_tokens: int = 64

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for t in texts:
            tokens = (t or "").lower().split()[: self.max_tokens] or [""]
            rows = np.stack([np.random.default_rng(list(w.encode()) + [0]).normal(size=self.dim) for w in tokens])
            out.append(rows / np.linalg.norm(rows, axis=1, keepdims=True))
        return out


@dataclass
class ModelEncoder:
    """A late-interaction model in ONNX form behind the same interface: ``model`` maps token ids and mask to one vector per token, ``tokenizer`` is a tokenizers JSON file. Loaded once per worker."""

    model: str
    tokenizer: str
    dim: int = 128
    max_tokens: int = 180

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        session, words = _loaded(self.model, self.tokenizer)
        out = []
        for t in texts:
            ids = words.encode(t or "").ids[: self.max_tokens]
            feed = {session.get_inputs()[0].name: np.array([ids], np.int64), session.get_inputs()[1].name: np.ones((1, len(ids)), np.int64)}
            out.append(session.run(None, feed)[0][0].astype(np.float64))
        return out


@lru_cache(maxsize=2)
def _loaded(model: str, tokenizer: str):
    import onnxruntime
    from tokenizers import Tokenizer

    return onnxruntime.InferenceSession(model), Tokenizer.from_file(tokenizer)


def encode_texts(rows: DataFrame, encoder: Encoder, id_col: str, text: str, out: str = "cloud_id") -> DataFrame:
    """(id, vectors) of ``rows`` by an encoder; rows without vectors after cleanup fail."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clouds = [c[np.linalg.norm(c, axis=1) > 1e-9] for c in encoder.encode(batch.column(1).to_pylist())]
            if any(not len(c) for c in clouds):
                raise ValueError("a text has no vector left")
            if clouds:
                flat = np.concatenate([c / np.linalg.norm(c, axis=1, keepdims=True) for c in clouds])
                yield pa.RecordBatch.from_arrays([batch.column(0), K.nested(flat, np.concatenate([[0], np.cumsum([len(c) for c in clouds])]))], names=[out, "vectors"])

    return rows.select(F.col(id_col).cast("long").alias(out), F.col(text).cast("string").alias("t")).mapInArrow(run, f"{out} long, vectors array<array<float>>")


def numbered(rows: DataFrame) -> DataFrame:
    """(row, id, text): gapless row numbers in order of id, from partition counts of a range sort."""
    ordered = rows.orderBy("id").rdd.zipWithIndex().map(lambda x: (x[1], x[0]["id"], x[0]["text"]))
    return rows.sparkSession.createDataFrame(ordered, "row long, id string, text string")


def generate(data: Dataset, encoder: Encoder, path: str, k: int = 100, metric: str = "ip") -> dict[str, DataFrame]:
    """Corpus and query clouds, gold judgments and exact ground truth under ``path``, reused if made with the same settings."""
    spark = data.corpus.sparkSession
    settings = {"metric": metric, "k": k, "encoder": type(encoder).__name__, "dim": encoder.dim}
    names = ("clouds", "ids", "queries", "gold", "truth")
    if not reusable(spark, f"{path}/manifest", settings):
        ids = numbered(data.corpus)
        ids.select("row", F.col("id").alias("external_id")).write.mode("overwrite").parquet(f"{path}/ids")
        encode_texts(ids, encoder, "row", "text").write.mode("overwrite").parquet(f"{path}/clouds")
        asked = numbered(data.queries)
        qrels = data.qrels.join(asked.select(F.col("id").alias("query_id"), "row"), "query_id").select(F.col("row").alias("query_id"), "doc_id", "score")
        gold, _ = search.map_qrels(qrels, spark.read.parquet(f"{path}/ids"))
        gold.write.mode("overwrite").parquet(f"{path}/gold")
        kept = asked.join(spark.read.parquet(f"{path}/gold").select(F.col("query_id").alias("row")).distinct(), "row", "left_semi")
        encode_texts(kept, encoder, "row", "text", "query_id").write.mode("overwrite").parquet(f"{path}/queries")
        search.exact_top_k(spark.read.parquet(f"{path}/queries"), spark.read.parquet(f"{path}/clouds"), k, metric).write.mode("overwrite").parquet(f"{path}/truth")
        write_manifest(spark, f"{path}/manifest", settings)
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def pseudo_query(title: str, text: str, words: int = 32, seed: int = 0) -> str:
    """A deterministic query of up to ``words`` words: the title, then a span of the text."""
    import zlib

    head, body = title.split(), text.split()
    room = max(0, words - len(head))
    start = zlib.crc32(f"{seed}:{title}:{text[:64]}".encode()) % max(1, len(body) - room + 1)
    return " ".join((head + body[start : start + room])[:words])


def diverse_rows(cloud: np.ndarray, n: int) -> np.ndarray:
    """Positions (sorted) of up to ``n`` distinct vectors, farthest first from the first; the earliest of equals wins."""
    chosen = [0]
    near = ((cloud - cloud[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(cloud)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((cloud - cloud[chosen[-1]]) ** 2).sum(1))
    return np.array(sorted(chosen))
