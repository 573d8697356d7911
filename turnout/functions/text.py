"""Text expressions.

Two trims are kept apart: table columns trim spaces only (``trim``), file cells trim every
kind of white space (``strip_all``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Fixed value: the characters that count as white space in files.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip_all(c: Column | str) -> Column:
    """Remove leading and trailing white space of any kind."""
    return F.btrim(as_col(c), F.lit(WHITE_SPACE))


def collapse_spaces(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(as_col(c), f"[{WHITE_SPACE}]+", " "))


def blank_to_null(c: Column | str) -> Column:
    """Strip a file cell and turn an empty one into NULL."""
    return F.nullif(strip_all(c), F.lit(""))


def normalise_email(c: Column | str) -> Column:
    """Lower-cased, space-trimmed address; blank becomes NULL."""
    return F.nullif(F.lower(F.trim(as_col(c))), F.lit(""))


def normalise_header(c: Column | str) -> Column:
    """Header text without byte-order mark, runs of white space collapsed, lower-cased."""
    return F.lower(collapse_spaces(F.replace(as_col(c), F.lit("﻿"), F.lit(""))))


def normalise_key(c: Column | str) -> Column:
    return F.lower(collapse_spaces(c))


def not_blank(c: Column | str) -> Column:
    c = as_col(c)
    return c.isNotNull() & (F.trim(c) != "")


def coalesce_label(*cols: Column | str, default: str) -> Column:
    """First non-blank trimmed value, else ``default``."""
    return F.coalesce(*[F.nullif(F.trim(as_col(c)), F.lit("")) for c in cols], F.lit(default))


def initcap_words(c: Column | str) -> Column:
    """Upper-case the first character after any non-alphanumeric one, lower-case the rest."""
    # Each piece is a run of alphanumerics or a run of anything else.
    pieces = F.regexp_extract_all(F.lower(as_col(c)), F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"), 1)
    return F.array_join(
        F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), p.substr(F.lit(2), F.length(p)))), ""
    )


def session_label(c: Column | str) -> Column:
    return F.coalesce(strip_all(c), F.lit(""))


def split_trailing_years(c: Column | str) -> tuple[Column, Column]:
    """Split ``text (N)`` into the text and N; only a bracket at the very end counts."""
    text = blank_to_null(c)
    pattern = r"\s*\(\s*(\d+)\s*\)\s*$"
    years = F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("int")
    return F.nullif(F.regexp_replace(text, pattern, ""), F.lit("")), years


def scope_key(city: Column | str, on: Column | str, label: Column | str) -> Column:
    """``city|yyyy-mm-dd|label`` with the city lower-cased; missing parts stay empty."""
    return F.concat_ws(
        "|",
        F.coalesce(F.lower(strip_all(city)), F.lit("")),
        F.coalesce(F.date_format(as_col(on), "yyyy-MM-dd"), F.lit("")),
        F.coalesce(strip_all(label), F.lit("")),
    )


def session_display(city: Column | str, on: Column | str, label: Column | str) -> Column:
    """``City · dd Mon yyyy · label``; an undated session says so."""
    from turnout.functions.dates import nullify_sentinel

    day = nullify_sentinel(on)
    return F.when(day.isNull(), F.concat(as_col(city), F.lit(" · no session date"))).otherwise(
        F.concat_ws(
            " · ", as_col(city), F.date_format(day, "dd MMM yyyy"), F.nullif(strip_all(label), F.lit(""))
        )
    )


def city_slug(c: Column | str) -> Column:
    """Lower-cased city with spaces as underscores."""
    return F.replace(normalise_key(F.coalesce(as_col(c), F.lit(""))), F.lit(" "), F.lit("_"))


def city_title(c: Column | str) -> Column:
    plain = F.translate(strip_all(F.coalesce(as_col(c), F.lit(""))), "_-", "  ")
    return F.when(plain == "", F.lit("—")).otherwise(initcap_words(plain))


def slot_name(c: Column | str) -> Column:
    """``morning`` or ``evening`` from the accepted spellings, else NULL."""
    key = F.lower(strip_all(c))
    # Accepted spellings of a slot.
    return F.when(key.isin("morning", "m", "am"), "morning").when(key.isin("evening", "e", "pm"), "evening")


def bootcamp_display(city: Column | str, on: Column | str, slot: Column | str) -> Column:
    name = slot_name(slot)
    slot_label = (
        F.when(name.isNotNull(), F.initcap(name))
        .otherwise(F.coalesce(F.nullif(strip_all(slot), F.lit("")), F.lit("—")))
    )
    return F.when(as_col(on).isNull(), F.concat(city_title(city), F.lit(" · no session date"))).otherwise(
        F.concat_ws(" · ", city_title(city), F.date_format(as_col(on), "dd MMM yyyy"), slot_label)
    )


def fixed_text(c: Column | str, digits: int) -> Column:
    """Non-negative double with a fixed number of decimals, rounded on its exact binary value.

    ``405.95`` is stored just below its face value and so gives ``405.9``.  The product with
    the power of ten is split into its rounded value and its rounding error, which decides
    whether an apparent half really is one.
    """
    x, scale = as_col(c).cast("double"), float(10**digits)
    high = x * 134217729.0 - (x * 134217729.0 - x)
    product = x * scale
    error = (high * scale - product) + (x - high) * scale
    whole = F.floor(product)
    over = product - whole
    up = (over > 0.5) | ((over == 0.5) & ((error > 0) | ((error == 0) & (whole % 2 == 1))))
    units = whole + up.cast("long")
    if digits == 0:
        return F.format_number(units, 0)
    decimals = F.lpad((units % int(scale)).cast("string"), digits, "0")
    return F.concat(F.format_number(F.floor(units / int(scale)), 0), F.lit("."), decimals)


def compact_number(c: Column | str) -> Column:
    """``1.2k``, ``3M``, thousands commas below a thousand, two decimals for fractions."""
    x = as_col(c).cast("double")
    size = F.abs(x)

    def scaled(unit: float, suffix: str) -> Column:
        text = F.replace(fixed_text(size / unit, 1), F.lit(","), F.lit(""))
        return F.concat(F.regexp_replace(text, r"\.0$", ""), F.lit(suffix))

    body = (
        F.when(size >= 1e6, scaled(1e6, "M"))
        .when(size >= 1e3, scaled(1e3, "k"))
        .when(size == F.floor(size), F.format_number(size, 0))
        .otherwise(fixed_text(size, 2))
    )
    return F.concat(F.when(x < 0, "-").otherwise(""), body)


def thousands(c: Column | str) -> Column:
    return F.format_number(as_col(c).cast("long"), 0)


def score_text(c: Column | str) -> Column:
    """Up to four decimals without trailing zeros; a dash for NULL."""
    x = as_col(c).cast("double")
    fixed = F.replace(fixed_text(F.abs(x), 4), F.lit(","), F.lit(""))
    short = F.regexp_replace(F.regexp_replace(fixed, "0+$", ""), r"\.$", "")
    return F.when(x.isNull(), F.lit("—")).otherwise(F.concat(F.when(x < 0, "-").otherwise(""), short))
