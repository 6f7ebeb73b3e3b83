"""Vector quantizers. Each is fitted on a bounded sample (or on nothing), encodes vectors, and scores queries against codes.

``scorer(metric)`` gives f(q, d) -> (len(q), len(d)) approximate vector distances with the sign conventions of the exact
kernels. Joins of many clouds make each side once (``query_side``, ``item_side``), so that codes meet in one product, as exact
vectors do; where that is no product of matrices (``tables``), ``look_up`` takes its place. Codes are derived from the floats where they are used; an index
persists no codes.
"""

from __future__ import annotations

import io
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

NAMES = ("none", "pq", "fastscan", "rabitq", "tq4", "tq8", "tq1", "tq1a", "sympq", "sympq1", "sympq2", "sympq8", "sympq16", "tqc", "tq2")
#: Vectors the data-dependent quantizers are fitted on, at most.
FIT_VECTORS = 50_000


def rotation(dim: int, seed: int = 42) -> np.ndarray:
    """A seeded random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def lloyd(x: np.ndarray, k: int, iters: int = 10, seed: int = 0, weights: np.ndarray | None = None, spherical: bool = False, scorer: Quantizer | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Plain (weighted) k-means: centers and assignment. Empty centers restart at a random row; ``spherical`` keeps unit centers and assigns by inner product; ``scorer`` (an 8-bit code, say) replaces exact distances."""
    g = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[g.choice(len(x), k, replace=False)].astype(np.float64)
    w = np.ones(len(x)) if weights is None else weights
    for step in range(iters + 1):
        near = -scorer.scorer("ip" if spherical else "l2")(x, c) if scorer else x @ c.T if spherical else 2 * x @ c.T - (c * c).sum(1)
        a = near.argmax(1)
        if step == iters:
            break
        mass = np.bincount(a, w, k)
        total = np.zeros_like(c)
        np.add.at(total, a, x * w[:, None])
        c = total / np.maximum(mass, 1e-12)[:, None]
        empty = mass == 0
        if empty.any():
            c[empty] = x[g.choice(len(x), int(empty.sum()))]
        if spherical:
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c, a


def _gaussian_levels(n: int) -> np.ndarray:
    """Lloyd-Max levels of a standard normal, from its quantiles."""
    g = np.random.default_rng(7).normal(size=200_000)
    x = np.quantile(g, (np.arange(n) + 0.5) / n)
    for _ in range(60):
        edge = (x[1:] + x[:-1]) / 2
        b = np.digitize(g, edge)
        x = np.bincount(b, g, n) / np.maximum(np.bincount(b, minlength=n), 1)
    return x


class Quantizer:
    name = "none"
    #: Whether the sides meet in ``look_up`` and not in a product of matrices.
    tables = False

    def fit(self, sample: np.ndarray) -> Quantizer:
        return self

    def encode(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {"x": x}

    def dots(self, q: np.ndarray, codes: dict[str, np.ndarray]) -> np.ndarray:
        return q @ codes["x"].T

    def norms(self, codes: dict[str, np.ndarray]) -> np.ndarray:
        return (codes["x"] ** 2).sum(1)

    def query_side(self, q: np.ndarray) -> np.ndarray:
        """Rows whose product with those of ``item_side`` is ``dots``."""
        return q

    def item_side(self, d: np.ndarray) -> np.ndarray:
        return self.encode(d)["x"]

    def scorer(self, metric: str) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        def run(q: np.ndarray, d: np.ndarray) -> np.ndarray:
            codes = self.encode(d)
            dot = self.dots(q, codes)
            if metric == "ip":
                return -dot
            return np.maximum(0, (q * q).sum(1)[:, None] + self.norms(codes)[None] - 2 * dot)

        return run


@dataclass
class ProductQuantizer(Quantizer):
    """Blocks of ``block`` coordinates against codebooks of ``k`` words; query tables are cut to 8 bits (rounded, or truncated)."""

    block: int = 8
    k: int = 256
    truncate: bool = False
    books: list[np.ndarray] = field(default_factory=list)
    name: str = "pq"
    tables = True

    def fit(self, sample: np.ndarray) -> ProductQuantizer:
        sample = sample[: self.k * 128 if self.k > 16 else 4096]
        self.books = [lloyd(sample[:, a : a + self.block], self.k, 8, b + 1)[0] for b, a in enumerate(range(0, sample.shape[1], self.block))]
        return self

    def _parts(self, x: np.ndarray):
        return [(book, x[:, a : a + self.block]) for book, a in zip(self.books, range(0, x.shape[1], self.block))]

    def encode(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {"code": np.stack([(2 * part @ book.T - (book * book).sum(1)).argmax(1).astype(np.uint8) for book, part in self._parts(x)], 1)}

    def decode(self, codes: dict[str, np.ndarray]) -> np.ndarray:
        return np.concatenate([book[codes["code"][:, b]] for b, book in enumerate(self.books)], 1)

    def _tables(self, q: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """A table of whole numbers per block (queries, words), the size of their step and what is added."""
        tables = [part @ book.T for book, part in self._parts(q)]
        low = np.stack([t.min(1) for t in tables], 1)
        span = np.max([t.max(1) - t.min(1) for t in tables], axis=0)
        step = np.maximum(span, 1e-12) / 255
        cut = (lambda v: np.floor(v + 1e-9)) if self.truncate else np.rint
        return [cut((t - low[:, b : b + 1]) / step[:, None]) for b, t in enumerate(tables)], step, low.sum(1)

    def dots(self, q: np.ndarray, codes: dict[str, np.ndarray]) -> np.ndarray:
        tables, step, low = self._tables(q)
        out = np.zeros((len(q), len(codes["code"])))
        for b, t in enumerate(tables):
            out += t[:, codes["code"][:, b]]
        return out * step[:, None] + low[:, None]

    def query_side(self, q: np.ndarray) -> np.ndarray:
        """The tables of a query one after the other, their step, what is added."""
        tables, step, low = self._tables(q)
        return np.concatenate([*tables, step[:, None], low[:, None]], 1)

    def item_side(self, d: np.ndarray) -> np.ndarray:
        """Places in a query's tables, and the squared norm."""
        codes = self.encode(d)
        first = np.cumsum([0, *[len(book) for book in self.books]])[:-1]
        return np.concatenate([codes["code"] + first, self.norms(codes)[:, None]], 1)

    def look_up(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Dots and squared norms of two sides. Whole numbers up to 255 a block, so single precision adds them exactly."""
        words = np.ascontiguousarray(a[:, :-2].T, np.float32)
        at = b[:, :-1].astype(np.intp)
        out = words[at[:, 0]]
        for i in range(1, at.shape[1]):
            out += words[at[:, i]]
        return out.T * a[:, -2:-1] + a[:, -1:], b[:, -1]

    def norms(self, codes: dict[str, np.ndarray]) -> np.ndarray:
        return sum((book * book).sum(1)[codes["code"][:, b]] for b, book in enumerate(self.books))


class _Rotated(Quantizer):
    """Shared by the rotation-based codes: rotate, scale to sqrt(dim), round, and correct by norm over code norm."""

    def __init__(self, seed: int = 42):
        self.seed, self._r = seed, {}

    def rotate(self, x: np.ndarray) -> np.ndarray:
        dim = x.shape[1]
        if dim not in self._r:
            self._r[dim] = rotation(dim, self.seed)
        return x @ self._r[dim]

    def _unit(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = np.linalg.norm(x, axis=1)
        return self.rotate(x) / np.maximum(n, 1e-12)[:, None] * np.sqrt(x.shape[1]), n

    def norms(self, codes: dict[str, np.ndarray]) -> np.ndarray:
        return codes["norm"] ** 2


class TurboQuant(_Rotated):
    """Sign and magnitude level of each rotated coordinate (``bits`` in all); queries become int8 after clamping."""

    def __init__(self, bits: int = 4, seed: int = 42):
        super().__init__(seed)
        self.bits, self.name = bits, f"tq{bits}"
        self.levels = _gaussian_levels(1 << bits)

    def encode(self, x: np.ndarray) -> dict[str, np.ndarray]:
        u, n = self._unit(x)
        code = np.digitize(u, (self.levels[1:] + self.levels[:-1]) / 2).astype(np.uint8)
        size = np.linalg.norm(self.levels[code], axis=1)
        return {"code": code, "scale": n / np.maximum(size, 1e-12), "norm": n}

    def dots(self, q: np.ndarray, codes: dict[str, np.ndarray]) -> np.ndarray:
        u, n = self._unit(q)
        top = 3.91724
        code = np.rint(np.clip(u, -top, top) * (127 / top))
        size = np.linalg.norm(code, axis=1)
        return (code * (n / np.maximum(size, 1e-12))[:, None]) @ self.levels[codes["code"]].T * codes["scale"][None]

    def query_side(self, q: np.ndarray) -> np.ndarray:
        u, n = self._unit(q)
        code = np.rint(np.clip(u, -3.91724, 3.91724) * (127 / 3.91724))
        return code * (n / np.maximum(np.linalg.norm(code, axis=1), 1e-12))[:, None]

    def item_side(self, d: np.ndarray) -> np.ndarray:
        codes = self.encode(d)
        return self.levels[codes["code"]] * codes["scale"][:, None]


class TurboQuant8(_Rotated):
    """int8 by each vector's largest rotated coordinate, on both sides."""

    name = "tq8"

    def encode(self, x: np.ndarray) -> dict[str, np.ndarray]:
        r, n = self.rotate(x), np.linalg.norm(x, axis=1)
        code = np.rint(r * (127 / np.maximum(np.abs(r).max(1, initial=0), 1e-12))[:, None]).astype(np.int8)
        return {"code": code, "scale": n / np.maximum(np.linalg.norm(code.astype(np.float64), axis=1), 1e-12), "norm": n}

    def dots(self, q: np.ndarray, codes: dict[str, np.ndarray]) -> np.ndarray:
        c = self.encode(q)
        return (c["code"].astype(np.float64) * c["scale"][:, None]) @ codes["code"].T.astype(np.float64) * codes["scale"][None]

    def query_side(self, q: np.ndarray) -> np.ndarray:
        c = self.encode(q)
        return c["code"] * c["scale"][:, None]

    item_side = query_side


class SignQuant(_Rotated):
    """One bit a coordinate. Symmetric: dot ~ dim - 2 Hamming, unit norms assumed. Asymmetric: queries keep int4 values."""

    def __init__(self, asymmetric: bool = False, seed: int = 42):
        super().__init__(seed)
        self.asymmetric, self.name = asymmetric, "tq1a" if asymmetric else "tq1"

    def encode(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {"code": np.packbits(self.rotate(x) > 0, axis=1), "dim": np.array([x.shape[1]]), "norm": np.linalg.norm(x, axis=1)}

    def dots(self, q: np.ndarray, codes: dict[str, np.ndarray]) -> np.ndarray:
        dim = int(codes["dim"][0])
        if self.asymmetric:
            r, n = self.rotate(q), np.linalg.norm(q, axis=1)
            code = np.rint(r * (7 / np.maximum(np.abs(r).max(1, initial=0), 1e-12))[:, None])
            sign = 2.0 * np.unpackbits(codes["code"], axis=1, count=dim) - 1
            size = np.maximum(np.linalg.norm(code, axis=1), 1e-12)
            return (code * (n / size)[:, None]) @ sign.T / np.sqrt(dim) * codes["norm"][None]
        mine = np.packbits(self.rotate(q) > 0, axis=1)
        out = np.empty((len(q), len(codes["code"])))
        for i, row in enumerate(mine):
            out[i] = dim - 2.0 * np.bitwise_count(row ^ codes["code"]).sum(1)
        return out / dim

    def query_side(self, q: np.ndarray) -> np.ndarray:
        if not self.asymmetric:
            return np.where(self.rotate(q) > 0, 1.0, -1.0) / q.shape[1]
        r, n = self.rotate(q), np.linalg.norm(q, axis=1)
        code = np.rint(r * (7 / np.maximum(np.abs(r).max(1, initial=0), 1e-12))[:, None])
        return code * (n / np.maximum(np.linalg.norm(code, axis=1), 1e-12))[:, None]

    def item_side(self, d: np.ndarray) -> np.ndarray:
        sign = np.where(self.rotate(d) > 0, 1.0, -1.0)
        return sign * (np.linalg.norm(d, axis=1) / np.sqrt(d.shape[1]))[:, None] if self.asymmetric else sign

    def norms(self, codes: dict[str, np.ndarray]) -> np.ndarray:
        return codes["norm"] ** 2 if self.asymmetric else np.ones(len(codes["code"]))


class SymmetricPQ(_Rotated):
    """Rotated blocks of ``block`` coordinates against 16 words fitted to a standard normal; both sides are coded, one 16 x 16 table scores."""

    name = "sympq"

    def __init__(self, block: int = 4, seed: int = 42):
        super().__init__(seed)
        self.block, self.name = block, "sympq" if block == 4 else f"sympq{block}"
        self.book = lloyd(np.random.default_rng(11).normal(size=(20_000, block)), 16, 20, 1)[0]
        self.table = self.book @ self.book.T

    def encode(self, x: np.ndarray) -> dict[str, np.ndarray]:
        u, n = self._unit(x)
        u = np.pad(u, ((0, 0), (0, -u.shape[1] % self.block))).reshape(len(x), -1, self.block)
        code = (2 * u @ self.book.T - (self.book**2).sum(1)).argmax(2).astype(np.uint8)
        size = np.sqrt(self.table[code, code].sum(1))
        return {"code": code, "scale": n / np.maximum(size, 1e-12), "norm": n}

    def dots(self, q: np.ndarray, codes: dict[str, np.ndarray]) -> np.ndarray:
        c = self.encode(q)
        out = np.zeros((len(q), len(codes["code"])))
        for b in range(c["code"].shape[1]):
            out += self.table[c["code"][:, b]][:, codes["code"][:, b]]
        return out * c["scale"][:, None] * codes["scale"][None]

    def query_side(self, q: np.ndarray) -> np.ndarray:
        """The words of a vector; their products are the table's."""
        c = self.encode(q)
        return self.book[c["code"]].reshape(len(q), -1) * c["scale"][:, None]

    item_side = query_side


def sign_reference(q: list[float], d: list[float], rows: list[list[float]], asymmetric: bool) -> float:
    """The one-bit estimate of <q, d> spelt out a coordinate at a time; ``rows`` is the rotation (coordinate, rotated coordinate)."""
    dim = len(d)
    turned = [[sum(x[i] * rows[i][j] for i in range(dim)) for j in range(dim)] for x in (q, d)]
    sign = [1 if y > 0 else -1 for y in turned[1]]
    if not asymmetric:
        return sum(s if y > 0 else -s for s, y in zip(sign, turned[0])) / dim
    top = max(abs(y) for y in turned[0])
    code = [round(7 * y / top) for y in turned[0]]
    length = lambda x: sum(y * y for y in x) ** 0.5
    return sum(c * s for c, s in zip(code, sign)) * length(q) / length(code) * length(d) / dim**0.5


class RaBitQ(_Rotated):
    """Residual to a fitted mean, rotated; ``bits`` a coordinate; the published unbiased estimator <o, q> / <o, code>."""

    name = "rabitq"

    def __init__(self, bits: int = 4, seed: int = 42):
        super().__init__(seed)
        self.bits, self.mean = bits, None

    def fit(self, sample: np.ndarray) -> RaBitQ:
        self.mean = sample[:FIT_VECTORS].mean(0)
        return self

    def encode(self, x: np.ndarray) -> dict[str, np.ndarray]:
        rest = x - self.mean
        r = self.rotate(rest)
        half = 1 << (self.bits - 1)
        step = np.maximum(np.abs(r).max(1, initial=0), 1e-12)[:, None] / half
        code = np.clip(np.floor(r / step), -half, half - 1) + 0.5
        # <r, code> corrects the length that rounding takes away.
        align = (r * code).sum(1)
        factor = np.where(align > 1e-12, (r * r).sum(1) / np.maximum(align, 1e-12), 0.0)
        return {"code": code, "factor": factor, "lift": x @ self.mean, "norm": np.linalg.norm(x, axis=1)}

    def dots(self, q: np.ndarray, codes: dict[str, np.ndarray]) -> np.ndarray:
        return self.rotate(q) @ codes["code"].T * codes["factor"][None] + (q @ self.mean)[:, None]

    def query_side(self, q: np.ndarray) -> np.ndarray:
        return np.concatenate([self.rotate(q), (q @ self.mean)[:, None]], 1)

    def item_side(self, d: np.ndarray) -> np.ndarray:
        codes = self.encode(d)
        return np.concatenate([codes["code"] * codes["factor"][:, None], np.ones((len(d), 1))], 1)


class CenteredTurboQuant(TurboQuant):
    """TQ4 of the residual to a fitted mean."""

    def __init__(self, bits: int = 4, seed: int = 42):
        super().__init__(bits, seed)
        self.name, self.mean = "tqc", None

    def fit(self, sample: np.ndarray) -> CenteredTurboQuant:
        self.mean = sample[:FIT_VECTORS].mean(0)
        return self

    def encode(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return super().encode(x - self.mean) | {"norm": np.linalg.norm(x, axis=1)}

    def dots(self, q: np.ndarray, codes: dict[str, np.ndarray]) -> np.ndarray:
        return super().dots(q, codes) + (q @ self.mean)[:, None]

    def query_side(self, q: np.ndarray) -> np.ndarray:
        return np.concatenate([super().query_side(q), (q @ self.mean)[:, None]], 1)

    def item_side(self, d: np.ndarray) -> np.ndarray:
        return np.concatenate([super().item_side(d), np.ones((len(d), 1))], 1)


def make(name: str, dim: int = 0) -> Quantizer:
    """An unfitted quantizer by name."""
    table: dict[str, Callable[[], Quantizer]] = {
        "none": Quantizer, "pq": ProductQuantizer, "fastscan": lambda: ProductQuantizer(4, 16, True, name="fastscan"), "rabitq": RaBitQ,
        "tq4": TurboQuant, "tq8": TurboQuant8, "tq1": SignQuant, "tq1a": lambda: SignQuant(True), "sympq": SymmetricPQ, "tqc": CenteredTurboQuant, "tq2": lambda: TurboQuant(2),
        **{f"sympq{b}": (lambda b=b: SymmetricPQ(b)) for b in (1, 2, 8, 16)},
    }
    if name not in table:
        raise ValueError(f"quantizer must be one of {NAMES}, not {name!r}")
    return table[name]()


def fitted_state(q: Quantizer) -> bytes | None:
    """What ``fit`` learnt, if anything."""
    learnt = {f"b{i}": b for i, b in enumerate(getattr(q, "books", []))} or ({"mean": q.mean} if getattr(q, "mean", None) is not None else {})
    if not learnt:
        return None
    out = io.BytesIO()
    np.savez(out, **learnt)
    return out.getvalue()


def restored(name: str, state: bytes) -> Quantizer:
    q = make(name)
    with np.load(io.BytesIO(state)) as learnt:
        if "mean" in learnt:
            q.mean = learnt["mean"]
        else:
            q.books = [learnt[f"b{i}"] for i in range(len(learnt))]
    return q


#: Compressed queries come in multiples of these, by quantizer.
ALIGNMENT = {"tq4": 6, "tq1": 4, "tq8": 6, "sympq": 3, "fastscan": 6}
