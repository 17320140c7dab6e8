"""Column expressions over array<float> vectors, computed in double precision on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot_product(a, b) -> Column:
    products = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(v) -> Column:
    return F.sqrt(F.aggregate(_col(v), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalize(v) -> Column:
    """Unit-length vector; a zero vector stays zero."""
    n = l2_norm(v)
    return F.transform(_col(v), lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))


def valid_vector(v, dim: int) -> Column:
    """True for a vector of ``dim`` entries without nulls; False also for a null vector."""
    v = _col(v)
    return F.coalesce((F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull()), F.lit(False))
