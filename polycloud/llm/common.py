"""Shared plumbing of the training-data operators: shared-folder tables, whole-text tokenising in numpy, components."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes of text that one numpy step looks at; only bounds memory, results do not depend on it.
STEP_BYTES = 1 << 17
# Rows of the largest broadcast built here: keys so frequent that fewer than this many can exist.
HOT_KEYS = 1000


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor sees, from ``spark.checkpoint.dir``; set to a local one only where the session names none (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import atexit
        import shutil
        import tempfile

        path = tempfile.mkdtemp(prefix="shared-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", "file://" + path)
        path = "file://" + path
    return path.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def lean(spark: SparkSession) -> Iterator[None]:
    """Queries run inside delete their shuffle files as soon as they end, not when the driver happens to collect its garbage, and hand Python a few MB at a time."""
    wanted = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the Python worker, which stays for later tasks, gives the memory it has freed back to the system."""

    @wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
            if trim:
                trim(0)

    return whole


def table(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back: cuts lineage, survives lost executors.

    The shuffles behind it are deleted once it is written. ``drop_table`` deletes the table itself.
    """
    path = shared_path(df.sparkSession, name)
    with lean(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Deletes what ``table`` wrote; only for tables that no result still reads."""
    for folder in {path.rpartition("/")[0] for path in df.inputFiles()}:
        fs, at = pafs.FileSystem.from_uri(folder)
        fs.delete_dir(at)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that clash with no column of ``df`` (case-insensitively)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def join_hot(left: DataFrame, right: DataFrame, key: str, copies: str, total: int, salt: Column, how: str = "left") -> DataFrame:
    """``left`` joined to one-row-per-key ``right`` when some keys hold a large share of ``left``.

    Keys with more than ``total / HOT_KEYS`` copies (at least 10,000) number fewer than HOT_KEYS, so that part of
    ``right`` is broadcast; the rest is an ordinary shuffle join, in which the rows already matched carry a salted
    key and spread evenly. Null keys match nothing. ``copies`` is the column of ``right`` that counts the key's rows in ``left``.
    """
    least = max(10_000, total // HOT_KEYS)
    right = right.filter(F.col(f"`{key}`").isNotNull())
    columns = [c for c in right.columns if c not in (key, copies)]
    hot_key, cold_key, salted, *mine = unused(left, "hot_key", "cold_key", "salted_key", *[f"hot_{c}" for c in columns], *[f"cold_{c}" for c in columns])
    of_hot, of_cold = mine[: len(columns)], mine[len(columns) :]
    at = lambda c: F.col(f"`{c}`")
    hot = right.filter(at(copies) > least).select(at(key).alias(hot_key), *[at(c).alias(x) for c, x in zip(columns, of_hot)])
    cold = right.filter(at(copies) <= least).select(F.struct(at(key).alias("k"), F.lit(0).alias("s")).alias(cold_key), *[at(c).alias(x) for c, x in zip(columns, of_cold)])
    out = left.join(F.broadcast(hot), at(key) == at(hot_key), "left")
    spread = F.when(at(hot_key).isNull(), 0).otherwise(1 + F.pmod(salt, F.lit(997)).cast("int"))
    out = out.withColumn(salted, F.struct(at(key).alias("k"), spread.alias("s"))).join(cold, at(salted) == at(cold_key), "left")
    matched = at(hot_key).isNotNull() | at(cold_key).isNotNull()
    out = out if how == "left" else out.filter(matched)
    return out.select(*[at(c) for c in left.columns], *[F.when(at(hot_key).isNotNull(), at(h)).otherwise(at(x)).alias(c) for c, h, x in zip(columns, of_hot, of_cold)])


# --- whole texts as bytes


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` after A-Z became a-z; every byte of a non-ASCII character belongs.
ALNUM = byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: `[^\x20\x09-\x0D]`
SOLID = ~byte_set((0x20, 0x20), (0x09, 0x0D))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All texts of an Arrow column as one byte array and the n + 1 offsets; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    big = pa.types.is_large_string(column.type)
    buffers = column.buffers()
    if not len(column) or buffers[1] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64 if big else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the maximal runs of ``member`` bytes; no run crosses an offset."""
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    starts, ends = [], []
    for a in range(0, len(data), STEP_BYTES):
        b = min(len(data), a + STEP_BYTES)
        now = member[data[a:b]]
        before = np.empty_like(now)
        before[1:] = now[:-1]
        before[0] = a > 0 and member[data[a - 1]]
        starts.append(np.flatnonzero(now & (~before | cut[a:b])) + a)
        ends.append(np.flatnonzero(before & (~now | cut[a:b])) + a)
    if len(data) and member[data[-1]]:
        ends.append(np.array([len(data)]))
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return join(starts), join(ends)


_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Words of more bytes are hashed one by one.
_LONG = 64


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each lower-cased word, eight bytes at a time. Equal words have equal hashes; callers compare the bytes of what matters."""
    out = np.empty(len(starts), np.uint64)
    low = np.zeros(len(data) + 8, np.uint8)
    np.take(LOWER, data, out=low[: len(data)])
    at_any_byte = np.ndarray((len(data) + 1,), "<u8", low, strides=(1,))
    step = STEP_BYTES // 8
    for i in range(0, len(starts), step):
        a, left = starts[i : i + step], ends[i : i + step] - starts[i : i + step]
        h = mix(left.astype(np.uint64) * _ODD)
        some, k = np.arange(len(a)), 0
        many = np.flatnonzero(left > _LONG)
        while len(some):
            rest = left[some] - k
            word = at_any_byte[a[some] + k]
            short = rest < 8
            word[short] &= (np.uint64(1) << (rest[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
            h[some] = mix((h[some] ^ word) * _ODD)
            k += 8
            some = some[(rest > 8) & (k < _LONG)]
        for j in many.tolist():
            h[j] = xxhash.xxh64_intdigest(low[a[j] : a[j] + left[j]].tobytes(), 1)
        out[i : i + step] = h
    return out


def lower_words(text: bytes, member: np.ndarray = ALNUM) -> list[bytes]:
    data = np.frombuffer(text, np.uint8)
    low = LOWER[data].tobytes()
    s, e = word_spans(data, np.array([0, len(data)]), member)
    return [low[a:b] for a, b in zip(s.tolist(), e.tolist())]


def batches_of(batch: pa.RecordBatch, text: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of text (one row at least)."""
    n = batch.num_rows
    if not n:
        return
    i = batch.schema.get_field_index(text)
    _, offsets = text_bytes(batch.column(i))
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield batch.slice(a, min(b, n) - a)
        a = b


# --- components


def union_arrays(parent: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Joins u[i] with v[i] in the forest ``parent`` (smaller index is the root) and flattens it; returns the mask of pairs that joined something."""
    first = parent[u] != parent[v]
    while len(u):
        a, b = parent[u], parent[v]
        differ = a != b
        if not differ.any():
            break
        u, v, a, b = u[differ], v[differ], a[differ], b[differ]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up
    return first


def components(edges: DataFrame, kind: str = "long") -> DataFrame:
    """(node, root) of every node in ``edges(u, v)``; root is the smallest node reachable.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until the edges no longer change. Every round is
    written to the shared folder; nothing but two sums per round reaches the driver.
    """
    links = table(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = None
    while True:
        both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large-star: each larger neighbour joins the smallest neighbour (or the node itself)
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        # small-star: a node and its smaller neighbours join the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, links = links, table(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        drop_table(before)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionAll(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()).groupBy("node").agg(F.min("root").alias("root"))


# --- numbering

#: Rows that one task numbers at a time, on average.
NUMBER_ROWS = 100_000


def numbered(df: DataFrame, group: str, total: int, salt: Column, order: list[Column], name: str) -> DataFrame:
    """``df`` with a gapless number from 0 within each ``group``, however large a group is.

    Rows of a group are spread over buckets by ``salt`` (any deterministic expression of the row); a bucket is numbered by
    itself and starts where the buckets before it end. Only bucket counts are summed over a group.
    """
    from pyspark.sql import Window

    key, first, same = unused(df, "bucket", "first", "same_bucket")
    # One key for the window and the join with the buckets' starts, so the rows are shuffled once.
    d = df.withColumn(key, F.struct(F.col(f"`{group}`").alias("g"), F.pmod(salt, F.lit(max(1, -(-total // NUMBER_ROWS)))).alias("b")))
    counts = d.groupBy(key).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(F.col(key)["g"]).orderBy(F.col(key)["b"]).rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(F.col(key).alias(same), F.coalesce(before, F.lit(0)).alias(first))
    out = d.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    out = out.join(starts, out[key] == starts[same]).withColumn(name, (F.col(name) + F.col(first) - 1).cast("long"))
    return out.drop(key, first, same)
