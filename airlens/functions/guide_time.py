"""Guide time texts: ISO-8601 with optional offset, the compact form, and minutes since the MJD epoch."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from airlens.functions.text import percent_encode

ISO = r"(?s)^(\d{4})-(\d{2})-(\d{2})T(\d{2}):(\d{2}):(\d{2})(?:$|(Z)|([+-])(\d{2}):(\d{2}))"
COMPACT = r"(?s)^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})"
COMPACT_OFFSET = r"(?s)^\d{14} ([+-])(\d{2})(\d{2})"
UNIX_EPOCH_MJD = 40587  # fixed value: day number of 1970-01-01


def _digits(col: Column, *places: tuple[int, int]) -> list[Column]:
    """Parts of a text that a pattern has found good: all its parts stand at fixed places, so nothing is matched again."""
    return [F.substring(col, at, size) for at, size in places]


def xmltv_to_iso(col: Column) -> Column:
    """Compact time to ISO text; null unless it starts with 14 digits; no range check (FN-6)."""
    g = _digits(col, (1, 4), (5, 2), (7, 2), (9, 2), (11, 2), (13, 2))
    base = F.concat(g[0], F.lit("-"), g[1], F.lit("-"), g[2], F.lit("T"), g[3], F.lit(":"), g[4], F.lit(":"), g[5])
    sign, hours, minutes = _digits(col, (16, 1), (17, 2), (19, 2))
    offset = (
        F.when(~col.rlike(COMPACT_OFFSET), "").when((sign == "+") & (hours == "00") & (minutes == "00"), "Z")
        .otherwise(F.concat(sign, hours, F.lit(":"), minutes))
    )
    return F.when(col.rlike(COMPACT), F.concat(base, offset))


def _offset(col: Column) -> tuple[Column, Column]:
    """What stands behind the seconds of an ISO text, and the minutes of an offset; null without one."""
    mark, hours, minutes = _digits(col, (20, 1), (21, 2), (24, 2))
    return mark, F.when(mark.isin("+", "-"), hours.try_cast("bigint") * 60 + minutes.try_cast("bigint"))


def iso_to_xmltv(col: Column) -> Column:
    """ISO text to compact time; null when it is not one (FN-7)."""
    base = F.concat(*_digits(col, (1, 4), (6, 2), (9, 2), (12, 2), (15, 2), (18, 2)))
    mark, size = _offset(col)
    minutes = size.cast("int")
    sign = F.when((mark == "-") & (minutes > 0), "-").otherwise("+")
    numeric = F.format_string(" %s%02d%02d", sign, F.floor(minutes / 60).cast("int"), minutes % 60)
    offset = F.when(mark == "Z", " +0000").when(mark.isin("+", "-"), numeric).otherwise("")
    return F.when(col.rlike(ISO), F.concat(base, offset))


def iso_to_minutes(col: Column) -> Column:
    """Minutes since the MJD epoch in UTC, seconds ignored; null when not ISO text (FN-8)."""
    y, mo, d, h, mi = (part.try_cast("bigint") for part in _digits(col, (1, 4), (6, 2), (9, 2), (12, 2), (15, 2)))
    early = mo <= 2
    yy, mm = F.when(early, y - 1).otherwise(y), F.when(early, mo + 12).otherwise(mo)
    # the day-number formula, in whole numbers; both divisions truncate
    centi, milli = (yy - 1900) * 36525, (mm + 1) * 306001
    days = d + 14956 + ((centi - F.when(centi < 0, -F.pmod(-centi, F.lit(100))).otherwise(F.pmod(centi, F.lit(100)))) / 100).cast("bigint") + F.floor(milli / 10000)
    mark, offset = _offset(col)
    signed = F.when(mark == "-", -offset).otherwise(offset)
    return F.when(col.rlike(ISO), days * 1440 + h * 60 + mi - F.coalesce(signed, F.lit(0)))


def minutes_to_unix(minutes: Column) -> Column:
    """Unix seconds of MJD minutes (FN-8)."""
    return (minutes - UNIX_EPOCH_MJD * 1440) * 60


def build_crid(channel_id: Column, start: Column, authority: str = "guide.invalid") -> Column:
    """Programme reference: authority, encoded channel and the first 14 characters of the bare start time (FN-5)."""
    bare = F.substring(F.translate(start, "-:T", ""), 1, 14)
    return F.concat(F.lit(f"crid://{authority}/"), percent_encode(channel_id), F.lit("/"), bare)
