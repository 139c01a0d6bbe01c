"""Column expressions. All are built-in functions, so they stay in code generation; only
``hash_uniform`` is for code that works on batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def is_missing(column: Column | str, floating: bool = False) -> Column:
    """Null, or NaN when the column is a floating-point one."""
    column = _col(column)
    return column.isNull() | F.isnan(column) if floating else column.isNull()


def nan_to_null(column: Column | str) -> Column:
    column = _col(column)
    return F.when(~F.isnan(column), column)


def sentinel_to_null(column: Column | str, value) -> Column:
    return F.nullif(_col(column), F.lit(value))


def years_from_days(column: Column | str, digits: int = 1) -> Column:
    """Years from a day offset that counts backwards from the application."""
    return F.round(_col(column) / F.lit(-365), digits)


def ratio(numerator: Column | str, denominator: Column | str, digits: int = 0) -> Column:
    """Rounded quotient; null where the denominator is zero."""
    return F.round(F.try_divide(_col(numerator), _col(denominator)), digits)


def log_or_null(column: Column | str) -> Column:
    """Natural logarithm; null for zero and below."""
    return F.ln(_col(column))


def threshold_flag(score: Column | str, cut: float) -> Column:
    return F.when(_col(score) > F.lit(cut), F.lit(1)).otherwise(F.lit(0))


def seeded_hash(seed, key: Column | str) -> Column:
    """Hex digest of seed and key: the same for a row whatever the partitioning."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws(":", seed, _col(key).cast("string")))


def hash_number(seed, key: Column | str) -> Column:
    """A number below 2**32 spread evenly over the keys."""
    return F.conv(F.substring(seeded_hash(seed, key), 1, 8), 16, 10).cast("bigint")


def known(df: DataFrame, column: str) -> Column:
    """The column, with NaN as null where it is a floating-point one."""
    floating = isinstance(df.schema[column].dataType, (T.FloatType, T.DoubleType))
    return nan_to_null(column) if floating else F.col(column)


def hash_bits(h: np.ndarray, *salt: int) -> np.ndarray:
    """Whole numbers below 2**53 from the hash of the key, by SplitMix64's finisher."""
    out = np.empty(len(h), np.uint64)
    with np.errstate(over="ignore"):
        # A few thousand at a time, which stay in the cache.
        for begin in range(0, len(h), 8192):
            z = out[begin : begin + 8192]
            z[:] = h[begin : begin + 8192].astype(np.int64, copy=False).view(np.uint64)
            shifted = np.empty_like(z)
            for s in salt:
                z += np.uint64((s + 1) * 0x9E3779B97F4A7C15 % 2**64)
                z ^= np.right_shift(z, np.uint64(30), out=shifted)
                z *= np.uint64(0xBF58476D1CE4E5B9)
                z ^= np.right_shift(z, np.uint64(27), out=shifted)
                z *= np.uint64(0x94D049BB133111EB)
                z ^= np.right_shift(z, np.uint64(31), out=shifted)
            z >>= np.uint64(11)
    return out


def hash_uniform(h: np.ndarray, *salt: int) -> np.ndarray:
    """Numbers in [0, 1) from the hash of the key."""
    return hash_bits(h, *salt).astype(float) / 2.0**53
