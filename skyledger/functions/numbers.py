"""Decimal rounding by the exact binary value of a double.

Spark's ``round`` and ``format_string`` round the shortest decimal text of a number, so
2.675 becomes 2.68 although the double is below 2.675. Here the product with the power of
ten is taken together with its rounding error: splitting the value into two halves of 26
bits makes both partial products exact.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _bound(value: Column, use) -> Column:
    """``use`` of the absolute value; the lambda binds it, so it is computed once."""
    return F.get(F.transform(F.array(F.abs(value).cast("double")), use), 0)


def _units(x: Column, digits: int, ties_to_even: bool) -> Column:
    """``x`` (not negative) in units of the last decimal place, as BIGINT."""
    scale = float(10**digits)
    product = x * scale
    head = x * 134217729.0 - (x * 134217729.0 - x)
    error = (head * scale - product) + (x - head) * scale
    whole = F.floor(product)
    beyond = ((product - whole) - 0.5) + error
    up = (beyond > 0) | ((beyond == 0) & (whole % 2 == 1)) if ties_to_even else beyond >= 0
    return whole + F.when(up, 1).otherwise(0)


def to_fixed(value: Column, digits: int) -> Column:
    """Text with ``digits`` decimal places; ties go away from zero."""
    def shown(x: Column) -> Column:
        number, scale = _units(x, digits, ties_to_even=False), 10**digits
        return F.concat(
            F.floor(number / scale).cast("string"), F.lit("."), F.lpad((number % scale).cast("string"), digits, "0")
        )

    text = _bound(value, shown)
    return F.when(value < 0, F.concat(F.lit("-"), text)).otherwise(text)


def round_half_even(value: Column, digits: int) -> Column:
    """Nearest number with ``digits`` decimal places; only true ties go to the even one."""
    size = _bound(value, lambda x: _units(x, digits, ties_to_even=True) / float(10**digits))
    return F.when(value < 0, -size).otherwise(size)
