"""String cleaning as column expressions."""

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x1c-\x1f]"
SPACE_CHARS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def _unicode_digits():
    digits = [chr(c) for c in range(0x80, 0x20000) if unicodedata.category(chr(c)) == "Nd"]
    return "".join(digits), "".join(str(unicodedata.digit(d)) for d in digits)


_DIGITS, _ASCII = _unicode_digits()


def strip(c: Column) -> Column:
    """Cut Unicode whitespace at both ends; plain ``trim`` would cut blanks only."""
    return F.trim(c, F.lit(SPACE_CHARS))


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U){SPACE}+", " ")


def ascii_digits(c: Column) -> Column:
    """Digits of other scripts become 0-9; plain ASCII text skips the lookup."""
    return F.when(c.rlike(r"^[\x00-\x7f]*+\z"), c).otherwise(F.translate(c, _DIGITS, _ASCII))


# Printable ASCII in which no letter follows a digit or sign.
_BLANK_WORDS = r"^[A-Za-z ]*+(?:[!-@\[-`{-~]++(?![A-Za-z])[A-Za-z ]*+)*+\z"


def title(c: Column) -> Column:
    """Capitalise every run of letters, also after digits and punctuation (``1St``, ``O'Brien``).

    ``initcap`` starts words at blanks only, so it serves just the texts where that is
    the same; others are cut into runs.
    """
    runs = F.regexp_extract_all(
        F.lower(c), F.lit(r"([\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+)"), F.lit(1)
    )
    return F.when(c.rlike(_BLANK_WORDS), F.initcap(c)).otherwise(F.array_join(F.transform(runs, F.initcap), ""))


def normalize_location(c: Column) -> Column:
    return title(F.nullif(collapse(strip(c)), F.lit("")))


def comma_parts(c: Column) -> Column:
    """Comma list to array: parts stripped, blanks dropped, duplicates kept, never null."""
    spaced = F.transform(F.split(c, ",", -1), strip)
    parts = F.when(c.rlike(rf"(?U){SPACE},"), spaced).otherwise(F.split(c, rf"(?U),{SPACE}*+", -1))
    return F.coalesce(F.array_remove(parts, ""), F.array().cast("array<string>"))


def split_cuisines(c: Column) -> Column:
    """Capitals depend on letter runs, which no comma or blank cuts: capitalise once, then split."""
    return comma_parts(title(strip(c)))


def contains_text(text: Column, query: Column) -> Column:
    """Literal, case-insensitive substring test; a null text never matches."""
    return F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lower(query))
