"""Text expressions. All of them are built-in Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Every character that separates words (Unicode white space and U+001C-1F)
# except the plain space. The wide range in front lets letters fail on one comparison.
_OTHER_SPACES = (
    r"[\x09-\x1f\x85\xa0\u1680-\u3000&&"
    r"[\x09-\x0d\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"
)


def filled(content: Column) -> Column:
    """Null text counts as empty text."""
    return F.coalesce(content, F.lit(""))


def words(text: Column) -> Column:
    """Words between runs of white space; none for null or blank text.

    Splitting at a literal space compiles no pattern per row; the pattern that turns other
    white space into spaces is compiled once.
    """
    spaced = F.regexp_replace(filled(text), _OTHER_SPACES, " ")
    return F.array_remove(F.split(spaced, " "), "")


def has_link(content: Column) -> Column:
    return F.contains(F.lower(filled(content)), F.lit("http"))


def fingerprint(content: Column) -> Column:
    """SHA-256 of the whole text: equal texts are told apart from others at a fixed 44
    characters, so grouping by text does not shuffle the text."""
    return F.base64(F.unhex(F.sha2(filled(content), 256)))
