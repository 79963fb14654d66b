"""Text column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataloom.functions.numeric import as_col

# Fixed value: the characters that str.split() and \s treat as white space in ASCII text.
SPACE = r"[ \t\n\r\f\x0B]"


def strip(c) -> Column:
    """Trim all ASCII white space, not only blanks."""
    return F.trim(as_col(c), F.lit(" \t\n\r\f\x0b"))


def clean(c) -> Column:
    """Squeeze newlines and blanks, then drop control characters, then trim."""
    c = F.regexp_replace(as_col(c), r"\n{3,}", "\n\n")
    c = F.regexp_replace(c, r" {2,}", " ")
    c = F.regexp_replace(c, r"[\x00-\x08\x0B-\x0C\x0E-\x1F\x7F]", "")
    return strip(c)


def words(c) -> Column:
    """White-space separated words, no empty strings."""
    return F.filter(F.split(as_col(c), rf"{SPACE}+"), lambda w: w != "")


def tokens(c, pattern: str = "[a-z0-9_]+") -> Column:
    """Distinct lower-case tokens in order of first sight."""
    return F.array_distinct(token_list(c, pattern))


def token_list(c, pattern: str = "[a-z0-9_]+") -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(as_col(c), F.lit(""))), F.lit(pattern), F.lit(0))


def norm_label(c, spaced: bool = True) -> Column:
    """Lower-case label; other characters become one blank (``spaced``) or vanish."""
    low = F.lower(F.coalesce(as_col(c), F.lit("")))
    if spaced:
        return F.trim(F.regexp_replace(low, r"[^a-z0-9]+", " "))
    return F.regexp_replace(low, r"[^a-z0-9]+", "")


# Fixed value: the amount pattern, after lower-casing and trimming.
AMOUNT = r"^\$?[0-9]+(,[0-9]{3})*(\.[0-9]+)?([ \t\n\r]*(million|billion|thousand))?$"


def is_number(c) -> Column:
    return F.lower(strip(c)).rlike(AMOUNT)


def to_number(c) -> Column:
    """Amount text such as ``$1,200 million`` as a double, null when it is none."""
    low = F.lower(strip(c))
    digits = F.regexp_extract(F.regexp_replace(low, ",", ""), r"([0-9]+(?:\.[0-9]+)?)", 1)
    scale = (
        F.when(low.endswith("million"), F.lit(1e6))
        .when(low.endswith("billion"), F.lit(1e9))
        .when(low.endswith("thousand"), F.lit(1e3))
        .otherwise(F.lit(1.0))
    )
    return F.when(is_number(c), digits.try_cast("double") * scale)


def year(c) -> Column:
    """First year 1900-2199 in the text, -1 when there is none."""
    found = F.regexp_extract(F.coalesce(as_col(c), F.lit("")), r"(19[0-9]{2}|20[0-9]{2}|21[0-9]{2})", 1)
    return F.when(found == "", F.lit(-1)).otherwise(found.try_cast("int"))


def contains_any(c, cues) -> Column:
    """True when the lower-case text holds one of the plain cue strings."""
    out = F.lit(False)
    for cue in cues:
        out = out | as_col(c).contains(cue)
    return out
