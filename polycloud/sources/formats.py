"""Binary files of clouds, judgments, ground truth, dense vectors and graphs, as Spark data sources.

    spark.dataSource.register(CloudSource); spark.read.format("pcs").load(path)

Layouts (little endian):
  pcs    u64 dim, u64 clouds, u64 vectors; f32 data; u64 count, u64 offsets (in floats)
  gold   u64 offsets, u64 entries; u64 offsets; u32 ids
  gt     i32 k; per query k x (f32 distance, u32 id)
  dense  u32 n, u32 dim; f32 rows
  graph  u32 n, u32 max degree; u32 sizes; u32 edges
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Bytes of data in one read partition.
SPLIT = 64 << 20


@dataclass
class Range(InputPartition):
    begin: int
    end: int


class _Ranges(DataSourceReader):
    """Items are read in ranges; each task maps the file and touches its own part only."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.open()

    def open(self) -> None:
        raise NotImplementedError

    def splits(self, ends: np.ndarray) -> list[Range]:
        """Ranges of items whose cumulative bytes are ``ends``."""
        cuts = [0]
        while cuts[-1] < len(ends):
            base = ends[cuts[-1] - 1] if cuts[-1] else 0
            cuts.append(max(cuts[-1] + 1, int(np.searchsorted(ends, base + SPLIT, "right"))))
        return [Range(a, b) for a, b in zip(cuts[:-1], cuts[1:])] or [Range(0, 0)]


class _CloudReader(_Ranges):
    def open(self) -> None:
        head = np.fromfile(self.path, "<u8", 3)
        if len(head) < 3:
            raise ValueError(f"{self.path}: no header")
        self.dim, self.n, self.vectors = (int(x) for x in head)
        at = 24 + 4 * self.dim * self.vectors
        count = int(np.fromfile(self.path, "<u8", 1, offset=at)[0])
        if count != self.n + 1:
            raise ValueError(f"{self.path}: {count} offsets for {self.n} clouds")
        self.offsets_at = at + 8

    def _offsets(self) -> np.ndarray:
        return np.memmap(self.path, "<u8", "r", self.offsets_at, (self.n + 1,))

    def partitions(self) -> list[Range]:
        off = self._offsets().astype(np.int64)
        if off[0] or off[-1] != self.dim * self.vectors or (np.diff(off) < 0).any() or (self.dim and (off % self.dim).any()):
            raise ValueError(f"{self.path}: offsets are not those of whole vectors")
        return self.splits(4 * off[1:])

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.end == part.begin:
            return
        off = self._offsets()[part.begin : part.end + 1].astype(np.int64)
        data = np.memmap(self.path, "<f4", "r", 24, (self.dim * self.vectors,)) if self.vectors else np.zeros(0, np.float32)
        for a in range(0, part.end - part.begin, 4096):
            b = min(a + 4096, part.end - part.begin)
            flat = np.array(data[off[a] : off[b]])
            if not np.isfinite(flat).all():
                raise ValueError(f"{self.path}: a coordinate is not finite")
            inner = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) // self.dim + 1) * self.dim, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(part.begin + a, part.begin + b)), pa.ListArray.from_arrays(pa.array((off[a : b + 1] - off[a]) // self.dim, pa.int32()), inner)], names=["cloud_id", "vectors"])


@dataclass
class Piece(WriterCommitMessage):
    path: str
    vectors: int
    sizes: list[int]
    dim: int


class _CloudWriter(DataSourceArrowWriter):
    """Tasks write their rows' floats beside the target; the commit joins them under the header and renames once.

    The DataFrame's partitions must be in order of cloud_id, which becomes the position; ``write_clouds`` sees to it.
    """

    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, batches: Iterator[pa.RecordBatch]) -> Piece:
        from ..functions.kernels import ragged

        piece = Piece(f"{self.path}.{uuid.uuid4().hex}.part", 0, [], 0)
        with open(piece.path, "wb") as f:
            for batch in batches:
                flat, off = ragged(batch.column(batch.schema.get_field_index("vectors")))
                if not np.isfinite(flat).all():
                    raise ValueError("a coordinate is not finite")
                piece.dim = piece.dim or flat.shape[1]
                f.write(np.ascontiguousarray(flat, "<f4").tobytes())
                piece.vectors += len(flat)
                piece.sizes += np.diff(off).tolist()
        return piece

    def commit(self, pieces: list[Piece | None]) -> None:
        some = [p for p in pieces if p and p.sizes]
        dims = {p.dim for p in some if p.dim}
        if len(dims) > 1:
            raise ValueError(f"clouds of dimensions {sorted(dims)}")
        dim, sizes = dims.pop() if dims else 0, np.array([s for p in some for s in p.sizes], np.int64)
        with open(self.path + ".tmp", "wb") as f:
            np.array([dim, len(sizes), sizes.sum()], "<u8").tofile(f)
            for p in some:
                with open(p.path, "rb") as g:
                    while part := g.read(1 << 22):
                        f.write(part)
            np.array([len(sizes) + 1], "<u8").tofile(f)
            np.concatenate([[0], np.cumsum(sizes) * dim]).astype("<u8").tofile(f)
        os.replace(self.path + ".tmp", self.path)
        self.abort(pieces)

    def abort(self, pieces: list[Piece | None]) -> None:
        for p in pieces:
            if p and os.path.exists(p.path):
                os.remove(p.path)


class CloudSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pcs"

    def schema(self) -> str:
        return "cloud_id long, vectors array<array<float>>"

    def reader(self, schema) -> DataSourceReader:
        return _CloudReader(self.options)

    def writer(self, schema, overwrite) -> DataSourceArrowWriter:
        return _CloudWriter(self.options)


class _GoldReader(_Ranges):
    def open(self) -> None:
        self.count, self.entries = (int(x) for x in np.fromfile(self.path, "<u8", 2))
        self.offsets = np.fromfile(self.path, "<u8", self.count, offset=16).astype(np.int64)
        if not self.count or self.offsets[0] or self.offsets[-1] != self.entries or (np.diff(self.offsets) < 0).any():
            raise ValueError(f"{self.path}: offsets must rise from 0 to {self.entries}")

    def partitions(self) -> list[Range]:
        return self.splits(4 * self.offsets[1:])

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        off = self.offsets[part.begin : part.end + 1]
        ids = np.fromfile(self.path, "<u4", int(off[-1] - off[0]), offset=16 + 8 * self.count + 4 * int(off[0]))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(part.begin, part.end), np.diff(off))), pa.array(ids.astype(np.int64))], names=["query_id", "cloud_id"])


class GoldSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gold"

    def schema(self) -> str:
        return "query_id long, cloud_id long"

    def reader(self, schema) -> DataSourceReader:
        return _GoldReader(self.options)


_GT = np.dtype([("distance", "<f4"), ("id", "<u4")])


class _TruthReader(_Ranges):
    def open(self) -> None:
        self.k = int(np.fromfile(self.path, "<i4", 1)[0])
        size = os.path.getsize(self.path) - 4
        if self.k <= 0 or size % (8 * self.k):
            raise ValueError(f"{self.path}: {size} bytes are no whole queries of k = {self.k}")
        self.n = size // (8 * self.k)

    def partitions(self) -> list[Range]:
        return self.splits(8 * self.k * np.arange(1, self.n + 1))

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        rows = np.fromfile(self.path, _GT, (part.end - part.begin) * self.k, offset=4 + 8 * self.k * part.begin)
        n = part.end - part.begin
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(part.begin, part.end), self.k)), pa.array(np.tile(np.arange(1, self.k + 1, dtype=np.int32), n)), pa.array(rows["id"].astype(np.int64)), pa.array(rows["distance"].astype(np.float64))], names=["query_id", "rank", "cloud_id", "distance"])


class TruthSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gt"

    def schema(self) -> str:
        return "query_id long, rank int, cloud_id long, distance double"

    def reader(self, schema) -> DataSourceReader:
        return _TruthReader(self.options)


class _DenseReader(_Ranges):
    def open(self) -> None:
        self.n, self.dim = (int(x) for x in np.fromfile(self.path, "<u4", 2))
        if os.path.getsize(self.path) != 8 + 4 * self.n * self.dim:
            raise ValueError(f"{self.path}: size does not fit {self.n} x {self.dim}")

    def partitions(self) -> list[Range]:
        return self.splits(4 * self.dim * np.arange(1, self.n + 1))

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        flat = np.fromfile(self.path, "<f4", (part.end - part.begin) * self.dim, offset=8 + 4 * self.dim * part.begin)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(part.begin, part.end)), pa.ListArray.from_arrays(pa.array(np.arange(part.end - part.begin + 1) * self.dim, pa.int32()), pa.array(flat))], names=["vec_id", "v"])


class DenseSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "dense"

    def schema(self) -> str:
        return "vec_id long, v array<float>"

    def reader(self, schema) -> DataSourceReader:
        return _DenseReader(self.options)


class _GraphReader(_Ranges):
    def open(self) -> None:
        self.n, self.degree = (int(x) for x in np.fromfile(self.path, "<u4", 2))
        self.sizes = np.fromfile(self.path, "<u4", self.n, offset=8).astype(np.int64)
        if (self.sizes > self.degree).any():
            raise ValueError(f"{self.path}: a node has more than {self.degree} edges")

    def partitions(self) -> list[Range]:
        return self.splits(4 * np.cumsum(self.sizes))

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        size = self.sizes[part.begin : part.end]
        edges = np.fromfile(self.path, "<u4", int(size.sum()), offset=8 + 4 * self.n + 4 * int(self.sizes[: part.begin].sum()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(part.begin, part.end)), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(edges.astype(np.int64)))], names=["node_id", "neighbors"])


class GraphSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "graph"

    def schema(self) -> str:
        return "node_id long, neighbors array<long>"

    def reader(self, schema) -> DataSourceReader:
        return _GraphReader(self.options)


SOURCES = (CloudSource, GoldSource, TruthSource, DenseSource, GraphSource)


def register(spark: SparkSession) -> None:
    for s in SOURCES:
        spark.dataSource.register(s)


def write_clouds(clouds: DataFrame, path: str) -> None:
    """Clouds in order of cloud_id into one file."""
    register(clouds.sparkSession)
    clouds.orderBy("cloud_id").write.format("pcs").mode("append").save(path)


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else "file://" + os.path.abspath(path))


@contextmanager
def _finished(path: str) -> Iterator[pa.NativeFile]:
    """A stream whose file takes its name only once it is whole, on any file system that Arrow knows."""
    fs, at = _place(path)
    with fs.open_output_stream(at + ".tmp", compression=None) as out:
        yield out
    fs.move(at + ".tmp", at)


def _atomic(path: str, *arrays: np.ndarray) -> None:
    with _finished(path) as out:
        for a in arrays:
            out.write(np.ascontiguousarray(a).tobytes())


def _streamed(path: str, head: np.ndarray, rows: DataFrame, bytes_of) -> None:
    """Head, then ``bytes_of(batch)`` of each batch of ordered ``rows``: the driver holds a partition at a time."""
    names = rows.columns
    with _finished(path) as out:
        out.write(head.tobytes())
        held: list[tuple] = []
        for r in rows.toLocalIterator(prefetchPartitions=True):
            held.append(tuple(r))
            if len(held) == 10_000:
                out.write(bytes_of(dict(zip(names, zip(*held)))))
                held = []
        if held:
            out.write(bytes_of(dict(zip(names, zip(*held)))))


def write_gold(gold: DataFrame, n_queries: int, path: str) -> None:
    """Relevant ids per query 0 .. n_queries - 1. Judgment files are small; they pass the driver."""
    t = gold.filter("query_id is not null and cloud_id is not null").orderBy("query_id", "cloud_id").toArrow()
    q = t["query_id"].to_numpy()
    off = np.searchsorted(q, np.arange(n_queries + 1))
    _atomic(path, np.array([n_queries + 1, len(q)], "<u8"), off.astype("<u8"), t["cloud_id"].to_numpy().astype("<u4"))


def write_truth(truth: DataFrame, k: int, path: str) -> None:
    """Ground truth of queries 0, 1, ... with exactly ``k`` ranks each, streamed in order."""
    rows = truth.filter(F.col("rank") <= k)
    n = rows.agg(F.count("*").alias("n"), F.countDistinct("query_id").alias("q"), F.min("query_id").alias("a"), F.max("query_id").alias("b")).first()
    if n.n != n.q * k or (n.q and (n.a != 0 or n.b != n.q - 1)):
        raise ValueError(f"queries must be 0 .. n - 1 with {k} ranks each")

    def raw(cols: dict) -> bytes:
        out = np.empty(len(cols["cloud_id"]), _GT)
        out["distance"], out["id"] = cols["distance"], cols["cloud_id"]
        return out.tobytes()

    _streamed(path, np.array([k], "<i4"), rows.orderBy("query_id", "rank").select("distance", "cloud_id"), raw)


def write_dense(rows: DataFrame, path: str) -> None:
    n = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    _streamed(path, np.array([n.n, n.d or 0], "<u4"), rows.orderBy("vec_id").select("v"), lambda cols: np.array(cols["v"], "<f4").tobytes())


def write_graph(rows: DataFrame, degree: int, path: str) -> None:
    t = rows.orderBy("node_id").select("neighbors").toArrow()["neighbors"].combine_chunks()
    size = np.array([len(x) for x in t.to_pylist()], "<u4")
    if len(size) and size.max() > degree:
        raise ValueError(f"a node has more than {degree} edges")
    _atomic(path, np.array([len(size), degree], "<u4"), size, t.flatten().to_numpy(zero_copy_only=False).astype("<u4"))


def write_ids(ids: DataFrame, path: str) -> None:
    """External ids, one per line in row order; an id with a line break is refused. ``ids(row, external_id)``."""
    bad = ids.filter(F.col("external_id").rlike("[\r\n]") | F.col("external_id").isNull())
    if not bad.isEmpty():
        raise ValueError("an external id is null or holds a line break")
    _streamed(path, np.zeros(0, "u1"), ids.orderBy("row").select("external_id"), lambda cols: "".join(x + "\n" for x in cols["external_id"]).encode())


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """ids(row, external_id). One file has one order, so one task reads it, a block at a time, wherever it lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column(0).to_pylist():
                fs, at = _place(p)
                row, rest = 0, b""
                with fs.open_input_stream(at, compression=None) as stream:
                    while block := stream.read(1 << 20):
                        *lines, rest = (rest + block).split(b"\n")
                        yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(lines))), pa.array([x.decode() for x in lines], pa.string())], names=["row", "external_id"])
                        row += len(lines)
                if rest:
                    yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([rest.decode()])], names=["row", "external_id"])

    return spark.createDataFrame([(path,)], "path string").coalesce(1).mapInArrow(run, "row long, external_id string")
