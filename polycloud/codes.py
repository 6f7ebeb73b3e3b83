"""Queries that return what each quantizer makes of the embeddings, and the SQL that recomputes it from the definition.

A row is (vec_id, code_sum, dot): the code of the next vector as sum of position times code, and the approximate inner product
of a vector with the next one's code, rounded. Rotations, levels and codebooks are literals of the SQL; codes, scales,
table look-ups and estimators are spelt out in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.quantize import SymmetricPQ, TurboQuant, make, rotation
from .plans import fixtures as X

NAMES = ("pq", "fastscan", "rabitq", "tq4", "tq8", "tq1", "tq1a", "sympq", "tqc", "tq2")
DIM, WORDS, BLOCK = 64, 16, 8
#: Pairs that are coded at once.
STEP = 1024


def quantized(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    v = X.vectors(spark, sf_dir)
    q = make(name)
    if name in ("pq", "fastscan"):  # fixed books: the slices of the first vectors
        first = np.array([r.embedding for r in v.filter(F.col("vec_id") < WORDS).orderBy("vec_id").collect()], np.float64)
        q.block, q.books = BLOCK, [first[:, a : a + BLOCK] for a in range(0, DIM, BLOCK)]
    elif name in ("rabitq", "tqc"):
        means = v.select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m")).orderBy("i").collect()
        q.mean = np.array([r.m for r in means])
    pairs = v.select("vec_id", F.col("embedding").alias("a")).join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    sent = spark.sparkContext.broadcast(q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        vectors = lambda x: x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(x), -1)
        for whole in batches:
            for at in range(0, whole.num_rows, STEP):
                batch = whole.slice(at, STEP)
                a, b = vectors(batch.column(1)), vectors(batch.column(2))
                codes = q.encode(b)
                code = np.unpackbits(codes["code"], axis=1, count=DIM) if name in ("tq1", "tq1a") else np.floor(codes["code"])
                sums = (code.astype(np.int64) * np.arange(1, code.shape[1] + 1)).sum(1)
                mine, its = q.query_side(a), q.item_side(b)
                if q.tables:  # the places of an item in the tables of its query
                    dots = np.take_along_axis(mine, its[:, :-1].astype(np.intp), 1).sum(1) * mine[:, -2] + mine[:, -1]
                else:
                    dots = (mine * its).sum(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums, pa.int64()), pa.array([round(x, 5) for x in dots.tolist()], pa.float64())], names=["vec_id", "code_sum", "dot"])

    return pairs.select("vec_id", "a", "b").mapInArrow(run, "vec_id long, code_sum long, dot double")


def _list(x: np.ndarray) -> str:
    return "[" + ", ".join(_list(y) if np.ndim(y) else repr(float(y)) for y in x) + "]"


_PAIRS = "e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), p AS (SELECT a.vec_id, a.x AS q, b.x AS d FROM e a JOIN e b ON b.vec_id = a.vec_id + 1)"
_SUM = "list_sum(list_transform(range(1, len(code) + 1), lambda i: i * code[i]))::BIGINT AS code_sum"
_IP = "list_inner_product"


def _norm(x: str) -> str:
    return f"sqrt({_IP}({x}, {x}))"


def _turbo(levels: np.ndarray, centered: bool) -> str:
    """Levels of the rotated unit vector scaled to sqrt(dim); the query as 8-bit steps up to 3.91724."""
    mean = "m AS (SELECT list(a ORDER BY i) AS m FROM (SELECT i, avg(x) AS a FROM (SELECT generate_subscripts(x, 1) AS i, unnest(x) AS x FROM e) GROUP BY i))," if centered else ""
    rest = "list_transform(range(1, 65), lambda i: d[i] - m[i])" if centered else "d"
    lift = f"{_IP}(q, m)" if centered else "0"
    return f"""{mean}
        s AS (SELECT vec_id, q, {rest} AS d, {lift} AS lift FROM p{', m' if centered else ''}),
        t AS (SELECT vec_id, lift, {_norm('q')} AS nq, {_norm('d')} AS nd, list_transform(r, lambda c: {_IP}(q, c)) AS rq, list_transform(r, lambda c: {_IP}(d, c)) AS rd FROM s, rot),
        u AS (SELECT *, list_transform(rd, lambda x: len(list_filter({_list((levels[1:] + levels[:-1]) / 2)}, lambda e: e <= x / nd * sqrt(64)))) AS code,
              list_transform(rq, lambda x: round_even(least(3.91724, greatest(-3.91724, x / nq * sqrt(64))) * (127 / 3.91724), 0)) AS cq FROM t),
        w AS (SELECT *, list_transform(code, lambda c: ({_list(levels)})[c + 1]) AS level FROM u)
        SELECT vec_id, {_SUM}, round({_IP}(cq, level) * nq / {_norm('cq')} * nd / {_norm('level')} + lift, 5) AS dot FROM w"""


def _product(cut: str) -> str:
    part = lambda x: f"list_transform(range(0, 8), lambda b: {x}[8 * b + 1:8 * b + 8])"
    return f"""f AS (SELECT list(x ORDER BY vec_id) AS f FROM e WHERE vec_id < {WORDS}),
        k AS (SELECT list_transform(range(0, 8), lambda b: list_transform(f, lambda x: x[8 * b + 1:8 * b + 8])) AS books FROM f),
        s AS (SELECT vec_id, {part('q')} AS q, {part('d')} AS d, books FROM p, k),
        t AS (SELECT vec_id, list_transform(range(1, 9), lambda b: list_transform(books[b], lambda w: {_IP}(q[b], w))) AS tables,
              list_transform(range(1, 9), lambda b: list_transform(books[b], lambda w: 2 * {_IP}(d[b], w) - {_IP}(w, w))) AS near FROM s),
        u AS (SELECT vec_id, tables, list_transform(near, lambda x: list_position(x, list_max(x)) - 1) AS code, list_max(list_transform(tables, lambda t: list_max(t) - list_min(t))) / 255 AS step FROM t)
        SELECT vec_id, {_SUM}, round(step * list_sum(list_transform(range(1, 9), lambda b: {cut})) + list_sum(list_transform(tables, lambda t: list_min(t))), 5) AS dot FROM u""".replace("{at}", "(tables[b][code[b] + 1] - list_min(tables[b])) / step")


_ROTATED = f"t AS (SELECT vec_id, {_norm('q')} AS nq, {_norm('d')} AS nd, list_transform(r, lambda c: {_IP}(q, c)) AS rq, list_transform(r, lambda c: {_IP}(d, c)) AS rd FROM p, rot)"
_TOP = lambda x: f"list_max(list_transform({x}, lambda y: abs(y)))"


def sql(name: str) -> str:
    rot = f"rot AS (SELECT {_list(rotation(DIM).T)} AS r)"
    if name == "pq":
        return f"WITH {_PAIRS}, {_product('round_even({at}, 0)')}"
    if name == "fastscan":
        return f"WITH {_PAIRS}, {_product('floor({at} + 1e-9)')}"
    if name in ("tq4", "tq2", "tqc"):
        return f"WITH {_PAIRS}, {rot}, {_turbo(TurboQuant(2 if name == 'tq2' else 4).levels, name == 'tqc')}"
    if name == "tq8":
        scaled = lambda x: f"list_transform({x}, lambda y: round_even(y * (127 / {_TOP(x)}), 0))"
        return f"""WITH {_PAIRS}, {rot}, {_ROTATED}, u AS (SELECT *, {scaled('rq')} AS cq, {scaled('rd')} AS code FROM t)
            SELECT vec_id, {_SUM}, round({_IP}(cq, code) * nq / {_norm('cq')} * nd / {_norm('code')}, 5) AS dot FROM u"""
    bits = "list_transform(rd, lambda y: CASE WHEN y > 0 THEN 1 ELSE 0 END)"
    if name == "tq1":
        return f"""WITH {_PAIRS}, {rot}, {_ROTATED}, u AS (SELECT *, {bits} AS code FROM t)
            SELECT vec_id, {_SUM}, round((64 - 2.0 * len(list_filter(range(1, 65), lambda i: (rq[i] > 0) <> (rd[i] > 0)))) / 64, 5) AS dot FROM u"""
    if name == "tq1a":
        return f"""WITH {_PAIRS}, {rot}, {_ROTATED}, u AS (SELECT *, {bits} AS code, list_transform(rq, lambda y: round_even(y * (7 / {_TOP('rq')}), 0)) AS cq FROM t)
            SELECT vec_id, {_SUM}, round({_IP}(cq, list_transform(code, lambda c: 2.0 * c - 1)) * nq / {_norm('cq')} / sqrt(64) * nd, 5) AS dot FROM u"""
    if name == "sympq":
        book = SymmetricPQ().book
        code = lambda x, n: f"list_transform(range(0, 16), lambda b: list_transform({_list(book)}, lambda w: 2 * {_IP}(list_transform({x}[4 * b + 1:4 * b + 4], lambda y: y / {n} * sqrt(64)), w) - {_IP}(w, w)))"
        pick = "list_transform({}, lambda x: list_position(x, list_max(x)) - 1)"
        words = lambda x: f"flatten(list_transform({x}, lambda c: ({_list(book)})[c + 1]))"
        return f"""WITH {_PAIRS}, {rot}, {_ROTATED}, u AS (SELECT vec_id, nq, nd, {code('rq', 'nq')} AS fq, {code('rd', 'nd')} AS fd FROM t),
            v AS (SELECT vec_id, nq, nd, {pick.format('fd')} AS code, {words(pick.format('fq'))} AS wq, {words(pick.format('fd'))} AS wd FROM u)
            SELECT vec_id, {_SUM}, round({_IP}(wq, wd) * nq / {_norm('wq')} * nd / {_norm('wd')}, 5) AS dot FROM v"""
    return f"""WITH {_PAIRS}, {rot}, m AS (SELECT list(a ORDER BY i) AS m FROM (SELECT i, avg(x) AS a FROM (SELECT generate_subscripts(x, 1) AS i, unnest(x) AS x FROM e) GROUP BY i)),
        t AS (SELECT vec_id, {_IP}(q, m) AS lift, list_transform(r, lambda c: {_IP}(q, c)) AS rq, list_transform(r, lambda c: {_IP}(list_transform(range(1, 65), lambda i: d[i] - m[i]), c)) AS rd FROM p, rot, m),
        u AS (SELECT *, list_transform(rd, lambda y: least(7, greatest(-8, floor(y / ({_TOP('rd')} / 8))))) AS code FROM t),
        w AS (SELECT *, list_transform(code, lambda c: c + 0.5) AS mid FROM u)
        SELECT vec_id, {_SUM}, round({_IP}(rq, mid) * {_IP}(rd, rd) / {_IP}(rd, mid) + lift, 5) AS dot FROM w"""
