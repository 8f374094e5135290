"""Tests and formats on plain text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Unicode White_Space characters, the set trimmed around texts.
WHITE_SPACE = (
    "\t\n\u000b\u000c\r \u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Accepted spellings of a UUID.
UUID_HYPHENATED = "[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
UUID_ANY_SPELLING = (
    f"^({UUID_HYPHENATED}|[0-9a-fA-F]{{32}}|urn:uuid:{UUID_HYPHENATED}|\\{{{UUID_HYPHENATED}\\}})$"
)


def trim_white(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def is_uuid_text(text: Column) -> Column:
    """Trimmed text is a hyphenated UUID of 36 characters."""
    return trim_white(text).rlike(f"^{UUID_HYPHENATED}$")


def is_uuid_any_spelling(text: Column) -> Column:
    """UUID as accepted in the envelope: hyphenated, plain, urn or braced."""
    return text.rlike(UUID_ANY_SPELLING)


def canonical_uuid(text: Column) -> Column:
    """Lower-case hyphenated form of any accepted spelling."""
    digits = F.regexp_replace(F.lower(trim_white(text)), "urn:uuid:|[{}-]", "")
    return F.regexp_replace(digits, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def format_uptime(seconds: Column) -> Column:
    """``1h 2m``, ``2m 3s`` or ``3s``."""
    hours, minutes, rest = _clock_parts(seconds)
    return (
        F.when(hours > 0, F.concat(hours.cast("string"), F.lit("h "), minutes.cast("string"), F.lit("m")))
        .when(minutes > 0, F.concat(minutes.cast("string"), F.lit("m "), rest.cast("string"), F.lit("s")))
        .otherwise(F.concat(rest.cast("string"), F.lit("s")))
    )


def format_uptime_dashboard(seconds: Column) -> Column:
    """Always hours and minutes, as on the overview panel."""
    hours, minutes, _ = _clock_parts(seconds)
    return F.concat(hours.cast("string"), F.lit("h "), minutes.cast("string"), F.lit("m"))


def _clock_parts(seconds: Column) -> tuple[Column, Column, Column]:
    total = seconds.cast("bigint")
    hours = F.floor(total / 3600)
    minutes = F.floor((total % 3600) / 60)
    return hours, minutes, total % 60


def lossy_utf8(payload: Column) -> Column:
    """Bytes as text, broken sequences replaced by the replacement character."""
    return F.make_valid_utf8(payload.cast("string"))
