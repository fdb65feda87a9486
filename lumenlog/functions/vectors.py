"""Vector expressions. Sums run in double precision by ascending index, on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column, dim: int | None = None) -> Column:
    """The inner product of two arrays of one length (dim, where given); others are an error.

    An unrolled sum would be one method too large for the JVM to compile, and several times slower.
    """
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    fit = F.size(a) == F.size(b)
    if dim is not None:
        fit = fit & (F.size(a) == dim)
    wrong = F.raise_error(F.concat_ws(" ", F.lit("vectors have lengths"), F.size(a).cast("string"), F.size(b).cast("string"))).cast("double")
    return F.when(fit, total).otherwise(wrong)
