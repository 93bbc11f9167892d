"""Vector metrics as Column expressions: double accumulation, inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def vector(v: Column | Sequence[float] | str) -> Column:
    """A column of vectors, or a literal one."""
    if isinstance(v, Column):
        return v
    if isinstance(v, str):
        return F.col(v)
    return F.array(*(F.lit(float(x)) for x in v))


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def sq_l2(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(sq_l2(a, b))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_similarity(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - cosine_similarity(a, b)


def normalize(a: Column, eps: float = 1e-12) -> Column:
    """Unit length; a zero vector stays zero."""
    # one pass for the norm, shared by all components
    return F.transform(F.array(F.greatest(norm(a), F.lit(eps))), lambda n: F.transform(a, lambda x: x.cast("double") / n))[0]


def similarity(sq_distance: Column) -> Column:
    """1 - squared L2 / 2: the cosine of unit vectors."""
    return F.lit(1.0) - sq_distance / 2


METRICS = {"l2": sq_l2, "cosine": cosine_distance, "dot": lambda a, b: -dot(a, b)}

#: The same from matrices: from dot products and squared lengths, fast but with cancellation, and row by row, term by term.
ROUGH = {"l2": lambda d, q, x: q + x - 2 * d, "cosine": lambda d, q, x: 1 - d / np.sqrt(q * x), "dot": lambda d, q, x: -d}
EXACT = {"l2": lambda x, q: ((x - q) ** 2).sum(1), "cosine": lambda x, q: 1 - (x * q).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum(1))), "dot": lambda x, q: -(x * q).sum(1)}
