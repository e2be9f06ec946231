"""Text column expressions. All but `nfkc` are native and stay inside code generation."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# ---- fixed values: the characters Unicode counts as white space, including the separators U+001C..U+001F ----
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# ---- fixed values: double-encoded sequences and their repair, applied in this order ----
MOJIBAKE = [
    ("Ã¦", "æ"), ("Ã¸", "ø"), ("Ã¥", "å"),
    ("Ã†", "Æ"), ("Ã˜", "Ø"), ("Ã…", "Å"),
    ("Ã©", "é"), ("Ã¨", "è"), ("Ã ", "à"),
    ("Ã¼", "ü"), ("Ã¶", "ö"), ("Ã¤", "ä"),
]
DANISH_WORDS = ["danmark", "dansk", "københavn", "aarhus", "odense", "og", "er", "det", "den", "der"]
COUNTRY_BY_SUFFIX = [(".dk", "DK"), (".com", "US"), (".co.uk", "GB"), (".org", "US")]
# ---- end of fixed values ----


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_empty(c: Column | str) -> Column:
    """True for null and for the empty string, which the data model treats alike."""
    return F.coalesce(_col(c), F.lit("")) == ""


def or_null(c: Column | str) -> Column:
    """The value, with the empty string turned into null."""
    return F.nullif(_col(c), F.lit(""))


def strip(c: Column | str) -> Column:
    """Remove any Unicode white space at both ends (`trim` alone removes spaces only)."""
    return F.btrim(_col(c), F.lit(WHITESPACE))


def title_key(c: Column | str) -> Column:
    """The form in which two titles are compared."""
    return F.lower(strip(c))


def collapse_spaces(c: Column | str) -> Column:
    """Every white-space run becomes one space and the ends are trimmed.

    Single characters are mapped first: a pattern with the full Unicode class takes twice as long.
    """
    spaced = F.translate(_col(c), WHITESPACE, " " * len(WHITESPACE))
    return F.trim(F.regexp_replace(spaced, "  +", " "))


def clean_text(c: Column | str) -> Column:
    """Tags become spaces, white-space runs become one space, ends are trimmed."""
    return collapse_spaces(F.regexp_replace(_col(c), "<[^>]+>", " "))


def normalize_text(c: Column | str) -> Column:
    """Trim and collapse white space; empty text becomes null."""
    return F.when(~is_empty(c), collapse_spaces(c))


def fix_mojibake(c: Column | str) -> Column:
    """Repair double-encoded letters. All of them start with the same character, so most text is only searched once."""
    out = c = _col(c)
    for wrong, right in MOJIBAKE:
        out = F.replace(out, F.lit(wrong), F.lit(right))
    return F.when(c.contains("Ã"), out).otherwise(c)


def content_hash(c: Column | str) -> Column:
    """MD5 of the UTF-8 text; null when there is no text."""
    return F.when(~is_empty(c), F.md5(_col(c)))


# Two code points that are no characters; they stand for a genuine replacement character while a text is repaired.
GUARD = "\ufdd0\ufdd1"


def utf8_clean(c: Column | str) -> Column:
    """Drop byte sequences that are not valid UTF-8; valid text and genuine U+FFFD characters are returned untouched."""
    c = _col(c)
    guarded = F.make_valid_utf8(F.replace(c, F.lit("\ufffd"), F.lit(GUARD)))
    repaired = F.replace(F.replace(guarded, F.lit("\ufffd"), F.lit("")), F.lit(GUARD), F.lit("\ufffd"))
    return F.when(F.is_valid_utf8(c), c).otherwise(repaired)


@F.pandas_udf(T.StringType())
def nfkc(values: pd.Series) -> pd.Series:
    """Unicode compatibility composition, for which Spark has no built-in function."""
    return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


def guess_language(domain: Column | str, text: Column | str, whole_words: bool = True) -> Column:
    """'da' for `.dk` domains and for text with a Danish word, else 'en'.

    `whole_words=False` looks for the words anywhere inside other words, which marks much English as Danish.
    """
    body = F.lower(_col(text))
    if whole_words:
        danish = body.rlike(r"(?U)\b(" + "|".join(DANISH_WORDS) + r")\b")
    else:
        danish = F.lit(False)
        for word in DANISH_WORDS:
            danish = danish | body.contains(word)
    return F.when(_col(domain).endswith(".dk") | F.coalesce(danish, F.lit(False)), "da").otherwise("en")


def guess_country(domain: Column | str) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for suffix, country in COUNTRY_BY_SUFFIX:
        out = out.when(_col(domain).endswith(suffix), country)
    return out.otherwise("unknown")
