"""Instants: ``YYYY-MM-DDThh:mm:ss``, optional fraction, then ``Z`` or ``±hh:mm``.

Built-in expressions only. Date and time must exist (no 30 February, no second 60, no year 0);
offsets run to ±23:59.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the written form of an instant.
INSTANT = r"\A(?!0000)\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])T(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:\.\d+)?(?:Z|[+-](?:[01]\d|2[0-3]):[0-5]\d)\z"


def _num(c: Column, start: int, n: int) -> Column:
    return F.substring(c, start, n).try_cast("int")


def _days_in_month(c: Column) -> Column:
    y, m = _num(c, 1, 4), _num(c, 6, 2)
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)


def is_instant(c: Column) -> Column:
    """True where the text is an instant, else false (also for null)."""
    return F.coalesce(c.rlike(INSTANT) & (_num(c, 9, 2) <= _days_in_month(c)), F.lit(False))


def instant_key(c: Column) -> Column:
    """Point in time as struct(sec, frac, rest), comparable; null where the text is no instant. frac
    holds 18 decimal places, rest those beyond them without closing zeros."""
    zone = F.regexp_extract(c, r"([+-])(\d\d):(\d\d)\z", 0)
    shift = F.when(zone == "", 0).otherwise(
        F.when(F.substring(zone, 1, 1) == "-", -1).otherwise(1) * (F.substring(zone, 2, 2).try_cast("bigint") * 3600 + F.substring(zone, 5, 2).try_cast("bigint") * 60)
    )
    day = F.unix_date(F.substring(c, 1, 10).try_cast("date")).cast("bigint")
    sec = day * 86400 + _num(c, 12, 2) * 3600 + _num(c, 15, 2) * 60 + _num(c, 18, 2) - shift
    rest = F.rtrim(F.substring(F.regexp_extract(c, r"\.(\d+)", 1), 19, 1 << 30), F.lit("0"))
    frac = F.rpad(F.substring(F.regexp_extract(c, r"\.(\d+)", 1), 1, 18), 18, "0").try_cast("bigint")
    return F.when(is_instant(c), F.struct(sec.alias("sec"), F.coalesce(frac, F.lit(0)).cast("bigint").alias("frac"), rest.alias("rest")))


def non_blank(c: Column) -> Column:
    """True where the text holds anything but white space (Unicode separators and the
    information separators count as white space); false for null."""
    return F.coalesce(c.rlike(r"[^\s\p{Z}\x{85}\x1c-\x1f]"), F.lit(False))
