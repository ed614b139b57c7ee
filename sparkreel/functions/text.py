"""Text columns: whitespace, names, subtitle escapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points that count as whitespace for strip and split.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85"
    "\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# Characters a file name must not hold, and those trimmed from its ends.
UNSAFE_NAME_CHARS = r'[<>:"/\\|?*\x00-\x1f]'
NAME_EDGE_CHARS = " ._-"
NAME_LENGTH = 80
EMPTY_NAME = "untitled"


def strip(text: Column) -> Column:
    """Text without leading and trailing Unicode whitespace."""
    return F.btrim(text, F.lit(WHITESPACE))


def has_text(text: Column) -> Column:
    return F.coalesce(strip(text) != "", F.lit(False))


def single_spaced(text: Column) -> Column:
    """Words parted by one space each, none around them."""
    return F.btrim(F.regexp_replace(text, f"[{WHITESPACE}]+", " "))


def word_count(spaced: Column) -> Column:
    """Words of a single-spaced text."""
    gaps = F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit("")))
    return F.when(spaced == "", F.lit(0)).otherwise(gaps + 1)


def or_default(text: Column, default: Column) -> Column:
    """Default in place of a missing or empty text."""
    return F.coalesce(F.nullif(text, F.lit("")), default)


def safe_filename(title: Column) -> Column:
    """A title as one path component."""
    masked = F.regexp_replace(strip(title), UNSAFE_NAME_CHARS, "_")
    return or_default(
        F.substring(F.btrim(masked, F.lit(NAME_EDGE_CHARS)), 1, NAME_LENGTH), F.lit(EMPTY_NAME)
    )


def escape_dialogue(text: Column) -> Column:
    """Text as it may stand in a subtitle dialogue line."""
    escaped = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    escaped = F.replace(escaped, F.lit("{"), F.lit("\\{"))
    escaped = F.replace(escaped, F.lit("}"), F.lit("\\}"))
    return F.replace(escaped, F.lit("\n"), F.lit("\\N"))
