"""Dates and times.

Business days and hours are India Standard Time.  Stored times are UTC instants; parquet
gives them as zone-less timestamps, so they are shifted explicitly and the session time
zone never matters.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import date, datetime, time, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnout.functions.text import as_col, blank_to_null

BUSINESS_ZONE = "Asia/Kolkata"

#: A date that means "no date".
SENTINEL_DATE = date(1970, 1, 1)


def business_time(ts: Column | str, zone: str = BUSINESS_ZONE) -> Column:
    """Wall-clock time in the business zone of a UTC timestamp."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), as_col(ts).cast("timestamp_ntz"))


def business_date(ts: Column | str, zone: str = BUSINESS_ZONE) -> Column:
    return F.to_date(business_time(ts, zone))


def business_hour(ts: Column | str, zone: str = BUSINESS_ZONE) -> Column:
    return F.hour(business_time(ts, zone))


def nullify_sentinel(d: Column | str) -> Column:
    return F.nullif(as_col(d).cast("date"), F.lit(SENTINEL_DATE))


def completed_years(born: Column | str, as_of: Column | str) -> Column:
    """Completed calendar years; a 29 February birthday falls on 1 March in common years."""
    born, as_of = as_col(born), as_col(as_of)
    before_birthday = F.date_format(as_of, "MMdd") < F.date_format(born, "MMdd")
    return F.year(as_of) - F.year(born) - before_birthday.cast("int")


# Names of months in files, short and in full.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
MONTH_NAMES = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")

#: An offset stands only behind a time of day; the last group of 15-01-2024 is none.
OFFSET = r"(?<=:\d{2}|\.\d{1,6}|:\d{2}\s|\.\d{1,6}\s)(Z|[+-]\d{2}:?\d{2})$"

_ISO = r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?$"
_ISO_UTC = r"^\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{2}(:\d{2}(\.\d{1,6})?)?Z$"


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _day(text: Column) -> Column:
    """ISO text of a day, by its shape: year first, numbers with the year last (month first, else day first), or a month's name."""
    numbers = {n: i + 1 for names in (MONTHS, MONTH_NAMES) for i, n in enumerate(names)}
    month = F.create_map(*[F.lit(x) for pair in numbers.items() for x in pair])

    def iso(parts: Column, year: int, month: Column, day: int) -> Column:
        made = F.concat_ws("-", F.get(parts, F.lit(year)), month, F.get(parts, F.lit(day)))
        return F.when(made.try_cast("date").isNotNull(), made)

    number = lambda parts, i: F.get(parts, F.lit(i))
    named = lambda parts, i: F.try_element_at(month, F.get(parts, F.lit(i))).cast("string")
    return (
        F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), text)
        .when(text.rlike(r"^\d{1,2}-\d{1,2}-\d{4}$"),
              _bound(F.split(text, "-"), lambda p: F.coalesce(iso(p, 2, number(p, 0), 1), iso(p, 2, number(p, 1), 0))))
        .when(text.rlike(r"^[A-Za-z]+ \d{1,2} \d{4}$"), _bound(F.split(text, " "), lambda p: F.when(named(p, 0).isNotNull(), iso(p, 2, named(p, 0), 1))))
        .when(text.rlike(r"^\d{1,2} [A-Za-z]+ \d{4}$"), _bound(F.split(text, " "), lambda p: F.when(named(p, 1).isNotNull(), iso(p, 2, named(p, 1), 0))))
    )


def _clock(text: Column) -> Column:
    """Time of day as hours, minutes and what follows, on 24 hours: H:mm[:ss[.f]] or, with AM or PM, h:mm[:ss]."""
    hour = F.substring_index(text, ":", 1).cast("int")
    rest = F.regexp_extract(text, r"^\d{1,2}(:\d{2}(?::\d{2})?) ?[AP]M$", 1)
    half = F.when(hour.between(1, 12) & (rest != ""), F.concat((hour % 12 + F.when(text.endswith("PM"), 12).otherwise(0)).cast("string"), rest))
    return F.when(text.endswith("M"), half).when(text != "", text)


def _other_layout(text: Column) -> Column:
    """Day and time of day of a cell that is not ISO: separators of a day become hyphens, or spaces beside the name of a month."""
    clock = F.upper(F.regexp_extract(text, r"[ T,]\s*(\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?\s*(?:[aApP][mM])?)\s*$", 1))
    clock = F.regexp_replace(clock, r"\s*([AP]M)$", " $1")
    day = F.regexp_replace(F.regexp_replace(text, r"[ T,]\s*\d{1,2}:\d{2}.*$", ""), r"^\s+|[\s,]+$", "")
    day = F.when(day.rlike("[A-Za-z]"), F.initcap(F.regexp_replace(day, r"[\s,/.-]+", " "))).otherwise(F.regexp_replace(day, "[/.]", "-"))
    on = _bound(day, _day)
    return F.when(text.rlike(r"\d:\d"), F.concat(on, F.lit(" "), _bound(clock, _clock))).otherwise(on).try_cast("timestamp_ntz")


def _wall_time(cell: Column) -> Column:
    """Day and time of day of a cell without offset; midnight without a time, NULL for anything else.

    The shape of a cell picks its layout, and the text that this gives is parsed once.
    """
    return _bound(cell, lambda text: F.when(text.rlike(_ISO), text.try_cast("timestamp_ntz")).otherwise(_other_layout(text)))


def parse_date_text(c: Column | str) -> Column:
    """Day of a cell in any layout of ``_day``, a time after it left out; anything else, and the sentinel, is NULL."""
    return nullify_sentinel(F.to_date(_wall_time(F.regexp_replace(blank_to_null(c), OFFSET, ""))))


def unparsed(cell: Column | str, parsed: Column | str) -> Column:
    """Whether a cell that is not blank came to nothing; counted, it says what a file lost."""
    return blank_to_null(cell).isNotNull() & as_col(parsed).isNull()


def parse_timestamp_text(c: Column | str, zone: str = BUSINESS_ZONE) -> Column:
    """UTC timestamp of a cell: an explicit offset is an instant, anything else is wall time in ``zone``.

    Layouts are those of ``_day`` and ``_clock``; 03/04/2024 is the fourth of March.
    """
    def instant(text: Column) -> Column:
        mark = F.regexp_extract(text, OFFSET, 1)
        sign = F.when(F.substring(mark, 1, 1) == "-", -1).otherwise(1)
        digits = F.regexp_replace(mark, "[^0-9]", "")
        minutes = F.when(digits == "", 0).otherwise(
            sign * (F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int"))
        )
        return _wall_time(F.regexp_replace(text, OFFSET, "")) - F.make_dt_interval(mins=minutes)

    def local(wall: Column) -> Column:
        return F.convert_timezone(F.lit(zone), F.lit("UTC"), wall)

    # The common shapes come first: one or two patterns and one parse.
    return _bound(blank_to_null(c), lambda text: (
        F.when(text.rlike(_ISO), local(text.try_cast("timestamp_ntz")))
        .when(text.rlike(_ISO_UTC), F.substring(text, F.lit(1), F.length(text) - 1).try_cast("timestamp_ntz"))
        .when(text.rlike(OFFSET), instant(text)).otherwise(local(_other_layout(text)))))


def display_timestamp(ts: Column | str) -> Column:
    return F.date_format(as_col(ts), "dd-MM-yyyy HH:mm:ss")


def month_of(ts: Column | str) -> Column:
    return F.date_format(as_col(ts), "yyyy-MM")


# --- request values (plain Python, one per request) -------------------------------------


def parse_filter_date(raw: str | None) -> date | None:
    try:
        return date.fromisoformat((raw or "").strip()[:10])
    except ValueError:
        return None


def parse_filter_moment(raw: str | None, end: bool = False) -> datetime | None:
    """Start (or inclusive end) of a range; a bare date means the first (or last) moment of that day."""
    text = (raw or "").strip().replace("T", " ")
    for layout in ("%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%d"):
        try:
            moment = datetime.strptime(text, layout)
        except ValueError:
            continue
        return datetime.combine(moment.date(), time.max) if end and layout == "%Y-%m-%d" else moment
    return None


def effective_range(
    wanted_from: date | None,
    wanted_to: date | None,
    data_min: date | None,
    data_max: date | None,
    max_days: int | None = None,
) -> tuple[date, date] | None:
    """Requested range filled, swapped and clamped to the data; None means all data.

    A start alone means that day, an end alone everything up to it.
    """
    if data_min is None or data_max is None or (wanted_from is None and wanted_to is None):
        return None
    first, last = sorted((wanted_from or data_min, wanted_to or wanted_from or data_max))
    first, last = max(first, data_min), min(last, data_max)
    first = min(first, last)
    return first, last if max_days is None else min(last, first + timedelta(days=max_days))


def parse_retention(text: str) -> tuple[int, str]:
    """``730d``, ``12 months`` and the like as (amount, unit); a bare number is days."""
    # Accepted unit spellings.
    units = {
        "days": ("d", "day", "days"),
        "weeks": ("w", "wk", "week", "weeks"),
        "months": ("m", "mo", "month", "months"),
        "years": ("y", "yr", "year", "years"),
        "hours": ("h", "hr", "hour", "hours"),
    }
    found = re.fullmatch(r"\s*(?:interval\s+)?'?(\d+)\s*([a-zA-Z]+)?'?\s*", text, re.IGNORECASE)
    if not found:
        raise ValueError(f"not a length of time to keep rows: {text!r}")
    word = (found[2] or "days").lower()
    for unit, spellings in units.items():
        if word in spellings:
            return int(found[1]), unit
    raise ValueError(f"{word!r} is no unit of time")
