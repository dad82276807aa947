"""Column functions on vectors, computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-9


def _double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    """Sum of products; null if either is null or holds a null."""
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(_double(v), F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(v: Column, epsilon: float = EPSILON) -> Column:
    """The vector divided by its length plus a small number, so that zeros stay zeros."""
    return F.transform(F.arrays_zip(_double(v).alias("x"), F.array_repeat(norm(v), F.size(v)).alias("n")), lambda p: p["x"] / (p["n"] + epsilon))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for a vector of zeros or of another length."""
    same = F.size(a) == F.size(b)
    return F.when(same, F.try_divide(dot(a, b), norm(a) * norm(b)))


def l2_distance(a: Column, b: Column) -> Column:
    """Euclidean distance; null for vectors of different lengths."""
    squares = F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y))
    return F.when(F.size(a) == F.size(b), F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)))


def is_vector(v: Column, dim: int) -> Column:
    """True if the vector has ``dim`` numbers, none null, NaN or infinite."""
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == dim) & good, F.lit(False))


def require_dim(v: Column, dim: int) -> Column:
    """The vector; a row whose vector has another length fails the job."""
    text = F.concat(F.lit(f"vector of length {dim} expected, got "), F.size(v).cast("string"))
    return F.when(F.size(v) == dim, v).otherwise(F.raise_error(text).cast("array<float>"))


def box_from_corner(x: Column, y: Column, width: Column, height: Column) -> Column:
    """A box given by corner and size as top, right, bottom, left, cut to whole numbers."""
    whole = lambda c, name: c.cast("int").alias(name)
    return F.struct(whole(y, "top"), whole(x + width, "right"), whole(y + height, "bottom"), whole(x, "left"))
