"""Expressions on vectors held as arrays."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def zero_vector(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), dim)


def masked_mean(hidden: Column, mask: Column, floor: float = 1e-9) -> Column:
    """Mean of the token vectors whose mask is set.

    `hidden` is an array of token vectors and `mask` the array of their 0/1 weights. The sum of weights is bounded
    below by `floor`, so a fully masked text gives the zero vector.
    """
    weighted = F.zip_with(
        hidden, mask, lambda vector, m: F.transform(vector, lambda x: x.cast("double") * m.cast("double"))
    )
    zeros = F.transform(F.get(hidden, F.lit(0)), lambda _: F.lit(0.0))
    total = F.aggregate(weighted, zeros, lambda acc, vector: F.zip_with(acc, vector, lambda a, b: a + b))
    weight = F.greatest(
        F.aggregate(mask, F.lit(0.0), lambda acc, m: acc + m.cast("double")), F.lit(floor)
    )
    return F.transform(total, lambda x: x / weight)
