"""Vector functions on float arrays, in single precision from left to right where a result is stored as float."""

from __future__ import annotations

from pyspark.sql import Column, functions as F



def _float(c: Column) -> Column:
    return c.cast("float")


def _sum(values: Column, kind: str) -> Column:
    return F.aggregate(values, F.lit(0).cast(kind), lambda s, x: (s + x).cast(kind))


def dot(a: Column, b: Column, kind: str = "float") -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast(kind) * y.cast(kind)), kind)


def cosine(a: Column, b: Column, kind: str = "float") -> Column:
    """Cosine similarity; 0 for empty vectors and for a zero norm, an error for different sizes, null for null."""
    norm = lambda v: F.sqrt(dot(v, v, kind)).cast(kind)
    scale = (norm(a) * norm(b)).cast(kind)
    value = F.when(scale == 0, F.lit(0).cast(kind)).otherwise((dot(a, b, kind) / F.when(scale != 0, scale)).cast(kind))
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in size")).cast(kind)).when(F.size(a) == 0, F.lit(0).cast(kind)).otherwise(value)


def l2_normalise(v: Column) -> Column:
    """The vector over its length; a zero vector stays."""
    norm = _float(F.sqrt(dot(v, v)))
    return F.when(norm == 0, v).otherwise(F.transform(v, lambda x: _float(x / F.when(norm != 0, norm))))


def mean_pool(rows: Column) -> Column:
    """The mean over an array of vectors of one size, then unit length; empty for no vectors."""
    n = F.size(rows)
    summed = F.aggregate(F.slice(rows, 2, F.greatest(n, F.lit(1))), rows[0], lambda s, r: F.zip_with(s, r, lambda x, y: _float(x + y)))
    return F.when(n > 0, l2_normalise(F.transform(summed, lambda x: _float(x / n)))).otherwise(F.array().cast("array<float>"))


def round_float(score: Column, digits: int) -> Column:
    """A float rounded half away from zero in single precision."""
    scale = _float(F.lit(10**digits))
    return _float(F.round(_float(score * scale)) / scale)


def float_as_json_number(c: Column) -> Column:
    """A float as the double that JSON writers print."""
    return c.cast("double")
