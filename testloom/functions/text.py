"""Text expressions: Unicode trim, byte-bounded cuts, length rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Limits in bytes of UTF-8. Fixed values.
TEXT_BYTES = 8000
FIELD_BYTES = 1000
EMAIL_BYTES = 254
BRANCH_BYTES = 36
SHA_BYTES = 40
VARIANT_BYTES = 64

_EDGES = r"^[\s\p{Z}\x{85}]+|[\s\p{Z}\x{85}]+$"
#: A cut character at the end of a hex string: a lead byte with too few bytes after it.
_TAIL = r"(?:[CD][0-9A-F]|E[0-9A-F](?:[89AB][0-9A-F])?|F[0-7](?:[89AB][0-9A-F]){0,2})$"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, _EDGES, "")


def truncated(c: Column, limit: int = TEXT_BYTES) -> Column:
    """c trimmed and cut to `limit` bytes at a character boundary; null stays null."""
    t = trimmed(c)
    # whole characters of the first bytes; hex positions are even, so the tail starts on a byte
    head = F.hex(F.substring(F.encode(t, "UTF-8"), F.lit(1), F.lit(limit)))
    cut = F.regexp_replace(head, rf"^((?:..)*?){_TAIL}", "$1")
    return F.when(F.octet_length(t) <= limit, t).otherwise(F.decode(F.unhex(cut), "UTF-8"))


def too_short(c: Column) -> Column:
    return F.coalesce(F.octet_length(trimmed(c)), F.lit(0)) == 0


def too_long(c: Column, limit: int) -> Column:
    return F.coalesce(F.octet_length(trimmed(c)), F.lit(0)) > limit


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def failure_message_lines(message: Column, most: int = 20) -> tuple[Column, Column]:
    """(shown lines, number of lines left out): tabs become four blanks, carriage returns go,
    blank lines go unless first."""
    lines = F.split(F.coalesce(message, F.lit("")), "\n")
    shown = F.transform(F.slice(lines, 1, most), lambda x: F.regexp_replace(F.regexp_replace(x, "\t", "    "), "\r", ""))
    shown = F.filter(shown, lambda x, i: (i == 0) | (F.length(trimmed(x)) > 0))
    return shown, F.greatest(F.size(lines) - most, F.lit(0))


def redacted_command(line: Column, token: Column) -> Column:
    """A command line without its first `--token` or `--token=` and without any copy of the token."""
    without = F.regexp_replace(line, r"(?s)^(.*?)--token=?", "$1")
    return trimmed(F.when(F.coalesce(token, F.lit("")) != "", F.replace(without, token, F.lit(""))).otherwise(without))


def percent_encoded_segment(c: Column) -> Column:
    """The nine characters that a path segment may not hold, percent-encoded, `%` itself kept."""
    for char, code in ((" ", "%20"), ('"', "%22"), ("#", "%23"), ("<", "%3C"), (">", "%3E"), ("`", "%60"), ("?", "%3F"), ("{", "%7B"), ("}", "%7D")):
        c = F.replace(c, F.lit(char), F.lit(code))
    return c
