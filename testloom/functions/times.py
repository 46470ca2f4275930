"""Time expressions. The session's time zone is UTC; reference times are parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whole hours above which a time is old or stale, and days after which it counts as a default. Fixed values.
OLD_HOURS = 24
STALE_HOURS = 1
DEFAULTED_DAYS = 30

_DATE = r"\d{4}-\d{2}-\d{2}"
_TIME = r"\d{2}:\d{2}(?::\d{2}(?:[.,]\d{1,9})?)?"
_ZONE = r"(?:[zZ]|[+-]\d{2}:?\d{2})?"
PLAIN = rf"^{_DATE}T\d{{2}}:\d{{2}}:\d{{2}}(?:\.\d{{1,9}})?Z$"
SHAPE = rf"^{_DATE}(?:[T _]{_TIME}{_ZONE})?$"


def parsed_time(c: Column) -> Column:
    """Date, or date and time with or without zone; other texts are null. No zone means UTC."""
    text = F.regexp_replace(F.regexp_replace(c, "^(.{10})[ _]", "$1T"), ",", ".")
    text = F.regexp_replace(text, r"([+-]\d{2})(\d{2})$", "$1:$2")
    text = F.when(F.length(text) > 10, text).otherwise(F.concat(F.substring(text, 1, 10), F.lit("T00:00:00Z")))
    text = F.when(text.rlike(r"(?:[zZ]|[+-]\d{2}:\d{2})$"), F.regexp_replace(text, "z$", "Z")).otherwise(F.concat(text, F.lit("Z")))
    # what needs no replacement is spared all of them
    return F.when(c.rlike(PLAIN), c.try_cast("timestamp")).when(c.rlike(SHAPE), text.try_cast("timestamp"))


def legal_seconds(c: Column) -> Column:
    """A duration: finite and not negative, else null."""
    v = c.try_cast("double")
    return F.when((v >= 0) & (v < float("inf")), v)


def plus_seconds(t: Column, seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(t) + F.round(seconds * 1e6).cast("long"))


def not_defaulted(t: Column, reference: Column) -> Column:
    """t unless it is more than 30 days before the reference time."""
    return F.when(t > reference - F.expr(f"interval {DEFAULTED_DAYS} days"), t)


def age(t: Column, reference: Column) -> Column:
    """future, old, stale or valid; hours are cut to whole ones. Null if either is."""
    micros = F.unix_micros(reference) - F.unix_micros(t)
    hours = F.floor(micros / F.lit(3_600_000_000))
    return F.when(micros < 0, F.lit("future")).when(hours > OLD_HOURS, F.lit("old")).when(hours > STALE_HOURS, F.lit("stale")).when(micros.isNotNull(), F.lit("valid"))


def millis(t: Column) -> Column:
    """Whole milliseconds; a missing time counts as 0."""
    return F.coalesce(F.expr("bigint(0)") + F.floor(F.unix_micros(t) / 1000), F.lit(0)).cast("long")
