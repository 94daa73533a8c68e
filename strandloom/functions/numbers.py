"""Roundings whose exact results are part of an output contract."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def two_decimals(v: Column) -> Column:
    """Two decimals as an interpreter of the older kind prints them: exact ties go away from zero, else the nearest.

    A double is an exact tie at two decimals only where eight times it is an odd integer.
    """
    v = v.cast("double")
    eighths = v * 8
    tie = (eighths == F.floor(eighths)) & (F.abs(F.pmod(eighths, F.lit(2.0))) == 1.0)
    away = F.signum(v) * (F.floor(F.abs(v) * 100) + 1) / 100
    plain = F.regexp_replace(F.format_number(v, 2), ",", "").cast("double")
    return F.when(v.isNull(), None).when((v == 0) | F.isnan(v) | (F.abs(v) == float("inf")), 0.0).when(tie, away).otherwise(plain)


def half_even_two(v: Column) -> Column:
    """Two decimals, half to even, where a fraction within 1e-8 of a half counts as one."""
    scaled = v.cast("double") * 100
    floor = F.floor(scaled)
    fraction = scaled - floor
    up = F.when(F.abs(fraction - 0.5) < 1e-8, F.pmod(floor, F.lit(2)) == 1).otherwise(fraction > 0.5)
    return (floor + up.cast("int")) / 100.0


def ten_thousands(v: Column) -> Column:
    """The nearest multiple of ten thousand, half to even."""
    return F.bround(v.cast("long"), -4).cast("long")


def power_log(v: Column, base: float = 2.0) -> Column:
    return F.log(base, v)


def _texts(values: pd.Series, text: Callable[[float], str]) -> pd.Series:
    return pd.Series([None if v != v else text(v) for v in values], dtype=object)


@F.pandas_udf(StringType())
def _double_digits(values: pd.Series) -> pd.Series:
    return _texts(values, lambda v: np.format_float_positional(v, trim="0"))


@F.pandas_udf(StringType())
def _float_digits(values: pd.Series) -> pd.Series:
    return _texts(values, _fewest_decimals)


def _fewest_decimals(v: float) -> str:
    single = np.float32(v)
    fixed = (f"{float(single):.{k}f}" for k in range(1, 12)) if np.isfinite(single) else ()
    return next((t for t in fixed if np.float32(t) == single), None) or np.format_float_positional(float(single), trim="0")


def _with_names(v: Column, digits: Column) -> Column:
    inf = F.lit(float("inf"))
    return F.when(F.isnan(v), "nan").when(v == inf, "inf").when(v == -inf, "-inf").when(v.isNotNull(), digits)


def double_text(v: Column) -> Column:
    """The fewest digits that give the double again, never with an exponent, at least one decimal; ``nan``, ``inf``, ``-inf``."""
    return _with_names(v.cast("double"), _double_digits(v.cast("double")))


def float_text(v: Column) -> Column:
    """The fewest decimals, one to eleven, that give the float again, or the double's digits if none do; ``nan``, ``inf``, ``-inf``."""
    return _with_names(v.cast("float"), _float_digits(v.cast("float")))
