"""Column functions on array<float> vectors; arithmetic in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalized(v: Column) -> Column:
    """v / |v|; the zero vector stays."""
    held = F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n)))
    return held[0]


def masked_mean(vectors: Column, mask: Column) -> Column:
    """Mean of the vectors (array of arrays) whose mask is 1; the divisor is 1e-9 at least."""
    pairs = F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda p: p["m"] == 1)
    zero = F.transform(F.element_at(vectors, 1), lambda _: F.lit(0.0))
    total = F.aggregate(pairs, zero, lambda s, p: F.zip_with(s, p["v"], lambda a, b: a + b.cast("double")))
    return F.transform(total, lambda x: x / F.greatest(F.size(pairs).cast("double"), F.lit(1e-9)))
