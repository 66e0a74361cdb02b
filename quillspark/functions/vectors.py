"""Vector functions over ARRAY<FLOAT> columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    """Unit length; rows shorter than 1e-12 are divided by that, so a zero row stays zero."""
    return F.transform(v, lambda x: (x.cast("double") / F.greatest(norm(v), F.lit(1e-12))).cast("float"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dot_literal(v: Column, q: Sequence[float]) -> Column:
    """v . q for a known q, written out term by term so that it compiles into the stage."""
    return reduce(lambda s, x: s + x, [F.get(v, F.lit(i)).cast("double") * F.lit(float(x)) for i, x in enumerate(q)])
