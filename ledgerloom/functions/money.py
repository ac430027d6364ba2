"""Exact money: integer minor units and decimals, never floats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MINOR_DIGITS = 2
RATE_DIGITS = 8


class FloatMoneyError(TypeError):
    """A money column has a binary floating-point type."""


def forbid_float_money(frame: DataFrame, *columns: str) -> DataFrame:
    """``frame``, if none of the money columns is a float; checked before anything runs."""
    bad = [c for c in columns if isinstance(frame.schema[c].dataType, (T.FloatType, T.DoubleType))]
    if bad:
        raise FloatMoneyError(f"money must be exact, but these are floats: {', '.join(bad)}")
    return frame


def _exact(text: Column, digits: int) -> Column:
    """The trimmed text as a decimal; null where it is no plain number of so many decimals."""
    plain = F.trim(text)
    return F.when(plain.rlike(rf"^[+-]?(\d+(\.\d{{0,{digits}}})?|\.\d{{1,{digits}}})$"), plain)


def parse_minor(text: Column) -> Column:
    """Text such as ``12.50`` to minor units; excess digits are refused, not rounded."""
    return (_exact(text, MINOR_DIGITS).try_cast(T.DecimalType(20, MINOR_DIGITS)) * 100).try_cast(T.LongType())


def parse_rate(text: Column) -> Column:
    """Text to a rate of at most eight decimals; null otherwise."""
    return _exact(text, RATE_DIGITS).try_cast(T.DecimalType(18, RATE_DIGITS))


def strict(value: Column, raw: Column, what: str) -> Column:
    """``value``, or an error where it is null though ``raw`` isn't blank."""
    return F.when(value.isNull() & (F.trim(raw) != ""), F.raise_error(F.concat(F.lit(f"{what} not understood: "), raw)).cast(T.StringType()).cast(T.LongType())).otherwise(value)


def minor_of_double(value: Column) -> Column:
    """Minor units of a two-decimal amount that a table stores as double."""
    return (value.cast(T.DecimalType(18, 2)) * 100).cast(T.LongType())


def half_up(value: Column, digits: int = 0) -> Column:
    return F.round(value, digits)


def half_even(value: Column, digits: int = 0) -> Column:
    return F.bround(value, digits)
