"""Title normalisation and percent-encoding as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 25 code points with the Unicode White_Space property, and the
# separator that introduces a publisher suffix.
WHITE_SPACE = "".join(
    chr(c)
    for c in (
        *range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
        0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
    )
)
PUBLISHER_SEPARATOR = " - "


def unicode_trim(text: Column) -> Column:
    """Strip Unicode white space from both ends (plain ``trim`` strips only U+0020)."""
    return F.trim(text, F.lit(WHITE_SPACE))


def is_blank(text: Column) -> Column:
    return unicode_trim(text) == ""


def without_publisher(text: Column) -> Column:
    """Cut at the last ``" - "``; the text must already be trimmed."""
    tail = F.substring_index(text, PUBLISHER_SEPARATOR, -1)
    kept = F.length(text) - F.length(tail) - len(PUBLISHER_SEPARATOR)
    return F.when(
        F.contains(text, F.lit(PUBLISHER_SEPARATOR)), F.left(text, kept)
    ).otherwise(text)


def words(text: Column) -> Column:
    """Lower-case words of letters and digits, joined by single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{IsAlphabetic}\p{N}]+", " "))


def fingerprint(title: Column) -> Column:
    """De-duplication key of a title: trimmed, publisher cut, lower-cased, words only.

    All-punctuation titles share the empty key.
    """
    return words(without_publisher(unicode_trim(title)))


def percent_encode(text: Column) -> Column:
    """RFC 3986 encoding: only ``A-Za-z0-9-_.~`` pass, a space becomes ``%20``."""
    form = F.url_encode(text)
    for written, wanted in (("+", "%20"), ("%7E", "~"), ("*", "%2A")):
        form = F.replace(form, F.lit(written), F.lit(wanted))
    return form
