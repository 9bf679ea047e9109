"""Time stamps of mail headers: parsing, zones, and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The shapes that stamps come in.
US = r"(\d{1,2})/(\d{1,2})/(\d{4})\s+(?:at\s+)?(\d{1,2}):(\d{2})(?::(\d{2}))?\s*([AaPp]\.?[Mm]\.?)"
LONG = (
    r"(?:[A-Za-z]+,?\s+)?([A-Za-z]{3,9})\.?\s+(\d{1,2}),?\s+(\d{4})\s+(?:at\s+)?(\d{1,2}):(\d{2})(?::(\d{2}))?"
    r"\s*([AaPp]\.?[Mm]\.?)"
)
DAY_FIRST = (
    r"(\d{1,2})\s+([A-Za-z]{3,9})\.?\s*,?\s*(\d{4})\s+(?:at\s+)?(\d{1,2}):(\d{2})(?::(\d{2}))?\s*([AaPp]\.?[Mm]\.?)?"
)
OFFSET = r"(?i)\((?:UTC|GMT)?\s*([+-])\s*(\d{1,2}):?(\d{2})\)"
PARTIAL = r"(?:[A-Za-z]+,?\s+)?([A-Za-z]{3,9})\.?\s+(\d{1,2})\s*(?:,|:|$)"
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def _group(text: Column, pattern: str, k: int) -> Column:
    found = F.regexp_extract(text, pattern, k)
    return F.when(found != "", found)


def month(name: Column) -> Column:
    at = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(name, 1, 3)))
    return F.when(at > 0, at.cast("int"))


def hour24(hour: Column, mark: Column) -> Column:
    h, m = hour.cast("int"), F.lower(F.substring(F.coalesce(mark, F.lit("")), 1, 1))
    return F.when((m == "p") & (h != 12), h + 12).when((m == "a") & (h == 12), 0).otherwise(h)


def offset_minutes(text: Column) -> Column:
    """The signed offset in brackets, null without one; zero is an offset."""
    sign = _group(text, OFFSET, 1)
    total = _group(text, OFFSET, 2).cast("int") * 60 + _group(text, OFFSET, 3).cast("int")
    return F.when(sign == "-", -total).otherwise(F.when(sign.isNotNull(), total))


def _make(y: Column, m: Column, d: Column, h: Column, mi: Column) -> Column:
    """Null where the calendar or the clock has no such time."""
    date = F.format_string("%04d-%02d-%02d %02d:%02d", *(F.coalesce(x.cast("int"), F.lit(0)) for x in (y, m, d, h, mi)))
    known = y.isNotNull() & m.isNotNull() & d.isNotNull() & h.isNotNull() & mi.isNotNull()
    return F.when(known, F.try_to_timestamp(date, F.lit("yyyy-MM-dd HH:mm")).cast("timestamp_ntz"))


def parse_stamp(text: Column, partial_year: int = 2020) -> Column:
    """struct(naive, offset_min, how).

    Shapes are tried in the order month/day/year, day-month-year, weekday-month
    form, month and day alone (at noon of ``partial_year``).  A shape with a
    month that there is claims the stamp; if its day or hour is impossible the
    stamp is unparsed.
    """
    t = F.trim(text)
    g = lambda p, k: _group(t, p, k)
    us_month = g(US, 1).cast("int")
    us = us_month.between(1, 12)
    us_time = _make(g(US, 3), us_month, g(US, 2), hour24(g(US, 4), g(US, 7)), g(US, 5))
    dm = month(g(DAY_FIRST, 2))
    dm_time = _make(g(DAY_FIRST, 3), dm, g(DAY_FIRST, 1), hour24(g(DAY_FIRST, 4), g(DAY_FIRST, 7)), g(DAY_FIRST, 5))
    lm = month(g(LONG, 1))
    lm_time = _make(g(LONG, 3), lm, g(LONG, 2), hour24(g(LONG, 4), g(LONG, 7)), g(LONG, 5))
    pm = month(g(PARTIAL, 1))
    pm_time = _make(F.lit(partial_year), pm, g(PARTIAL, 2), F.lit(12), F.lit(0))
    offset = offset_minutes(t)
    naive = F.when(us, us_time).when(dm.isNotNull(), dm_time).when(lm.isNotNull(), lm_time).when(pm.isNotNull(), pm_time)
    timed = F.when(us, "outlook-us").when(dm.isNotNull(), "day-month-year").when(lm.isNotNull(), "long")
    how = F.when(naive.isNull(), "unparsed").when(timed.isNull(), "partial-no-time").when(offset.isNotNull(), "offset").otherwise(timed)
    return F.struct(naive.alias("naive"), F.when(how != "unparsed", offset).alias("offset_min"), how.alias("how"))


def to_zone(naive: Column, zone: Column, target: str = "America/New_York") -> Column:
    return F.convert_timezone(zone, F.lit(target), naive)


def zone_label(naive: Column, zone: Column, target: str = "America/New_York", short: str = "ET") -> Column:
    """"HH:MM ET", or both clock times where they differ."""
    there = F.date_format(to_zone(naive, zone, target), "HH:mm")
    here = F.date_format(naive, "HH:mm")
    city = F.translate(F.element_at(F.split(zone, "/"), -1), "_", " ")
    same = to_zone(naive, zone, target) == naive
    return F.when(same, F.concat(there, F.lit(f" {short}"))).otherwise(F.concat(here, F.lit(" "), city, F.lit(" -> "), there, F.lit(f" {short}")))


def from_offset(naive: Column, minutes: Column, target: str = "America/New_York") -> Column:
    utc = naive - F.make_dt_interval(F.lit(0), F.lit(0), minutes, F.lit(0))
    return F.convert_timezone(F.lit("UTC"), F.lit(target), utc)


def absolute_minutes(date: Column, hhmm: Column) -> Column:
    """Minutes since an era; a bad date is null, a bad time midnight."""
    day = F.unix_date(F.try_to_timestamp(date, F.lit("yyyy-MM-dd")).cast("date")) * 1440
    time = F.when(hhmm.rlike("^[0-2][0-9][0-5][0-9]$"), F.substring(hhmm, 1, 2).cast("int") * 60 + F.substring(hhmm, 3, 2).cast("int"))
    return day + F.coalesce(time, F.lit(0))
