"""Fixed-dimensional encodings: a cloud as one vector whose inner product approximates Chamfer similarity.

Per repetition, random hyperplanes split the space into 2^bits cells (numbered in Gray code). A query adds up its vectors
per cell, a document averages them; cells a document leaves empty may take its nearest vector by Hamming distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K

#: Final size -> (repetitions, hyperplanes, projected dimension).
PRESETS = {640: (20, 2, 8), 1280: (20, 3, 8), 1920: (30, 3, 8), 2560: (20, 4, 8), 5120: (20, 5, 8), 10240: (20, 5, 16)}


@dataclass(frozen=True)
class FDEConfig:
    repetitions: int = 20
    bits: int = 3
    projected: int = 8  # 0 keeps the vector's own dimension
    fill_empty: bool = True
    normalize: bool = False  # unit-length cells instead of means
    final: int = 0  # count-sketch the whole to this size
    seed: int = 42

    @staticmethod
    def preset(size: int, **more) -> FDEConfig:
        if size not in PRESETS:
            raise ValueError(f"size must be one of {sorted(PRESETS)}, not {size}")
        return FDEConfig(*PRESETS[size], **more)


def gray(bits: np.ndarray) -> np.ndarray:
    """Cell numbers of sign bits (rows, bits): each further bit is flipped by the last bit of the number so far."""
    out = np.zeros(bits.shape[0], np.int64)
    for b in bits.T:
        out = (out << 1) + (b.astype(np.int64) ^ (out & 1))
    return out


def gray_distance(bits: np.ndarray, cell: int) -> np.ndarray:
    """Sign bits by which rows differ from a cell."""
    code = cell ^ (cell >> 1)
    want = np.array([(code >> (bits.shape[1] - 1 - i)) & 1 for i in range(bits.shape[1])], bool)
    return (bits != want).sum(1)


def encode(cloud: np.ndarray, cfg: FDEConfig, query: bool) -> np.ndarray:
    """The encoding of one cloud."""
    if query and cfg.fill_empty:
        cfg = FDEConfig(cfg.repetitions, cfg.bits, cfg.projected, False, cfg.normalize, cfg.final, cfg.seed)
    dim, cells = cloud.shape[1], 1 << cfg.bits
    width = cfg.projected or dim
    out = np.zeros((cfg.repetitions, cells, width))
    for r in range(cfg.repetitions):
        g = np.random.default_rng([cfg.seed, r])
        planes = g.normal(size=(dim, cfg.bits))
        bits = cloud @ planes > 0
        low = cloud
        if cfg.projected:
            to, sign = g.integers(0, cfg.projected, dim), g.choice([-1.0, 1.0], dim)
            low = np.zeros((len(cloud), cfg.projected))
            np.add.at(low.T, to, (cloud * sign).T)
        cell = gray(bits)
        np.add.at(out[r], cell, low)
        if not query:
            n = np.bincount(cell, minlength=cells)
            full = n > 0
            if cfg.normalize:
                out[r, full] /= np.maximum(np.linalg.norm(out[r, full], axis=1, keepdims=True), 1e-12)
            else:
                out[r, full] /= n[full, None]
            if cfg.fill_empty and len(cloud):
                for c in np.flatnonzero(~full):
                    out[r, c] = low[gray_distance(bits, int(c)).argmin()]
    flat = out.ravel()
    if cfg.final:
        g = np.random.default_rng([cfg.seed, 1 << 20])
        small = np.zeros(cfg.final)
        np.add.at(small, g.integers(0, cfg.final, len(flat)), flat * g.choice([-1.0, 1.0], len(flat)))
        return small
    return flat


def encode_clouds(clouds: DataFrame, cfg: FDEConfig, query: bool, id_col: str = "cloud_id") -> DataFrame:
    """(id, vectors) where each cloud is one vector, its encoding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, off = K.ragged(batch.column(1))
            rows = [encode(flat[a:b], cfg, query) for a, b in zip(off[:-1], off[1:])]
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), K.nested(np.stack(rows), np.arange(len(rows) + 1))], names=[id_col, "vectors"])

    return clouds.select(id_col, "vectors").mapInArrow(run, f"{id_col} long, vectors array<array<float>>")
