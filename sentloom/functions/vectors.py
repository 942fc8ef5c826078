"""Vector arithmetic as Column expressions, always in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Fixed value: smallest squared length used when vectors are normalised inside a batch product, so
# that a zero vector stays zero there.
NORM_EPSILON = 1e-12


def _col(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return _total(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column | str) -> Column:
    return F.sqrt(
        F.aggregate(
            _col(v), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")
        )
    )


def l2_normalize(v: Column | str) -> Column:
    """Unit vector; NULL for a zero vector."""
    v = _col(v)
    # The norm goes through a one-element array, so that it is computed once per vector and not
    # once per element. No function's body names what is bound outside of it: Spark does not take
    # an expression with such a body out of the plan for a Python function and fails.
    pair = F.struct(v.alias("v"), F.nullif(norm(v), F.lit(0.0)).alias("n"))
    scaled = F.transform(
        F.array(pair),
        lambda p: F.when(
            p["n"].isNotNull(),
            F.zip_with(p["v"], F.array_repeat(p["n"], F.size(p["v"])), lambda x, n: x.cast("double") / n),
        ),
    )
    return F.get(scaled, F.lit(0))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two vectors; NULL when one of them is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def softplus(x: Column) -> Column:
    """ln(1 + e^x) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def mean_pool(frames: Column | str, dim: int) -> Column:
    """Mean of the frame vectors of one clip; NULL for a clip without frames."""
    frames = _col(frames)
    n = F.size(frames)
    total = F.aggregate(
        frames,
        F.array_repeat(F.lit(0.0), dim),
        lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y.cast("double")),
    )
    return F.when(n > 0, F.transform(total, lambda x: x / n))
