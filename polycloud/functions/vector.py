"""Vector functions as native column expressions (no Python on the executors), accumulated in double."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Col = Column | str


def _sum(pairs: Column) -> Column:
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: an expression used inside a lambda is else evaluated for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def dot(a: Col, b: Col) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def ip_distance(a: Col, b: Col) -> Column:
    """-<a, b> for float or integer vectors."""
    return -dot(a, b)


def l2_distance(a: Col, b: Col) -> Column:
    """Squared L2."""
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def split_l2_distance(a: Col, b: Col) -> Column:
    """Squared L2 from norms, clamped at 0."""
    return F.greatest(F.lit(0.0), squared_norm(a) + squared_norm(b) - 2 * dot(a, b))


def squared_norm(v: Col) -> Column:
    return _sum(F.transform(v, lambda x: x.cast("double") * x.cast("double")))


def normalized(v: Col, least: float = 1e-7) -> Column:
    """Unit vector, or the vector itself where its norm is not above ``least``."""
    v = F.col(v) if isinstance(v, str) else v

    def scaled(x: Column) -> Column:
        return _let(F.sqrt(squared_norm(x)), lambda n: F.when(n > least, F.transform(x, lambda y: (y.cast("double") / n).cast("float"))).otherwise(x))

    return _let(v, scaled)


def distance(a: Col, b: Col, metric: str) -> Column:
    return ip_distance(a, b) if metric == "ip" else l2_distance(a, b)


def chamfer(a: Col, b: Col, metric: str = "ip") -> Column:
    """Mean over vectors of ``a`` of the smallest distance to vectors of ``b``; null where either has none."""
    low = F.transform(a, lambda x: F.array_min(F.transform(b, lambda y: distance(x, y, metric))))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.aggregate(low, F.lit(0.0), lambda acc, x: acc + x) / F.size(a))


def mean_pool(vectors: Col, normalize: bool = False) -> Column:
    """Coordinate-wise mean of a cloud."""
    zero = F.transform(F.get(vectors, F.lit(0)), lambda x: F.lit(0.0))
    total = F.aggregate(vectors, zero, lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y.cast("double")))
    mean = _let(F.size(vectors), lambda n: F.transform(total, lambda x: (x / n).cast("float")))
    return normalized(mean) if normalize else mean


def clean_cloud(vectors: Col, least: float = 1e-9) -> Column:
    """Rows of norm above ``least``, scaled to unit norm."""
    return F.transform(F.filter(vectors, lambda v: F.sqrt(squared_norm(v)) > least), lambda v: normalized(v, least))


def hamming(a: Col, b: Col) -> Column:
    """Differing bits of two arrays of longs."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)


def bytes_touched(vectors: Col, width: int = 4) -> Column:
    """Work of scoring against a cloud: its coordinates times their width."""
    return F.size(vectors) * F.size(F.get(vectors, F.lit(0))) * width
