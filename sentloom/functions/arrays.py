"""Array functions: padding, masks, one-hot, shift, gather, regroup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _int(value: Column | int) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def fill(value: Column, n: Column | int) -> Column:
    """``n`` copies of ``value``; none for a negative ``n``."""
    return F.array_repeat(value, F.greatest(_int(n), F.lit(0)).cast("int"))


def _checked(cond: Column, message: str, value: Column) -> Column:
    return F.when(cond, value).otherwise(F.raise_error(F.lit(message)))


def pad_ids(ids: Column | str, width: Column | int, truncate: bool = False) -> Column:
    """Zero-pad to ``width``. Longer input is cut when ``truncate``, else it is an error."""
    ids, width = _col(ids), _int(width)
    padded = F.concat(ids, fill(F.lit(0), width - F.size(ids)))
    if truncate:
        return F.slice(padded, F.lit(1), width)
    return _checked(F.size(ids) <= width, "sequence longer than the padded width", padded)


def length_mask(n: Column | int, width: Column | int) -> Column:
    """``n`` ones, then zeros, ``width`` in all."""
    width = _int(width)
    ones = F.least(_int(n), width)
    return F.concat(fill(F.lit(1), ones), fill(F.lit(0), width - ones))


def pad_vectors(seq: Column | str, width: Column | int, dim: int) -> Column:
    """Pad a sequence of vectors with zero vectors; an empty or longer sequence is an error."""
    seq, width = _col(seq), _int(width)
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return _checked(
        (F.size(seq) > 0) & (F.size(seq) <= width),
        "expected between 1 and the padded width vectors",
        F.concat(seq, fill(zero, width - F.size(seq))),
    )


def pad_flat(frames: Column | str, width: Column | int, dim: int) -> Column:
    """Flatten frames of ``dim`` values and pad with zeros to ``width`` frames."""
    frames, width = _col(frames), _int(width)
    missing = (width - F.size(frames)) * dim
    return F.concat(F.flatten(frames), fill(F.lit(0.0).cast("float"), missing))


def apply_mask(seq: Column | str, mask: Column | str) -> Column:
    """Multiply each vector of a sequence by its 0/1 mask."""
    # The inner body names nothing from outside: see l2_normalize in vectors.py.
    return F.zip_with(
        _col(seq),
        _col(mask),
        lambda v, m: F.zip_with(v, F.array_repeat(m, F.size(v)), lambda x, y: x * y),
    )


def one_hot(value: Column | str, depth: int) -> Column:
    value = _col(value)
    return F.transform(F.sequence(F.lit(0), F.lit(depth - 1)), lambda i: (i == value).cast("int"))


def shift_right(seq: Column | str, zero: Column) -> Column:
    """Put ``zero`` in front and drop the last element; the length stays the same."""
    seq = _col(seq)
    return F.when(
        F.size(seq) > 0, F.concat(F.array(zero), F.slice(seq, F.lit(1), F.size(seq) - 1))
    ).otherwise(seq)


def gather(seq: Column | str, index: Column | str) -> Column:
    """0-based element; an index outside the sequence is NULL."""
    return F.get(_col(seq), _col(index))


def concat_vectors(*cols: Column | str) -> Column:
    return F.concat(*[_col(c) for c in cols])


def regroup(flat: Column | str, stride: int) -> Column:
    """Flat array → array of arrays of ``stride`` elements."""
    flat = _col(flat)
    steps = F.sequence(F.lit(0), (F.size(flat) / stride).cast("int") - 1)
    return F.when(
        F.size(flat) >= stride,
        F.transform(steps, lambda i: F.slice(flat, i * stride + 1, F.lit(stride))),
    ).otherwise(F.array_repeat(F.slice(flat, 1, 0), 0))
