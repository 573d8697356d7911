"""Numbers from text, and ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnout.functions.text import as_col, strip_all

#: Scores, ledger amounts and balances.
MONEY = "decimal(14,4)"


def float_from_text(c: Column | str) -> Column:
    """Number with optional thousands commas; anything else is NULL."""
    return strip_all(F.replace(as_col(c), F.lit(","), F.lit(""))).try_cast("double")


def int_from_text(c: Column | str) -> Column:
    """As :func:`float_from_text`, truncated towards zero."""
    return float_from_text(c).try_cast("int")


def attempts_from_text(c: Column | str) -> Column:
    """Attempt count; values below one are NULL."""
    n = int_from_text(c)
    return F.when(n >= 1, n)


def ratio(top: Column | str, bottom: Column | str, digits: int = 6) -> Column:
    """Rounded quotient, zero when the denominator is zero."""
    top, bottom = as_col(top), as_col(bottom)
    return F.when(bottom == 0, F.lit(0.0)).otherwise(F.round(top / bottom, digits))


def at_least_one(value: int, what: str) -> int:
    """The value if it is a count of one or more."""
    if int(value) < 1:
        raise ValueError(f"{what} must be 1 or more, not {value}")
    return int(value)
