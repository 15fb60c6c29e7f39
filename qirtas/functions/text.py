"""Text normalisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values -----------------------------------------------------------------------------------------------------
DIGITS_FROM, DIGITS_TO = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹٫٬", "01234567890123456789.,"
LETTERS_FROM, LETTERS_TO = "أإآٱىةؤئ", "اااايهوي"
#: Known misreads of a recogniser: pattern, replacement.
MISREADS = [(r"(?<![A-Za-z])[Pρp][.-]?\s?[2o](?=\s*\d|\s*$)", "ج.م "), (r"(?<=\d)\s*[I|l]\s*(?=\d{1,2}:\d{2})", " ")]
# ----------------------------------------------------------------------------------------------------------------------


def one_space(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)[\s\p{Z}]+", " "))


def ascii_digits(c: Column) -> Column:
    return F.translate(c, DIGITS_FROM, DIGITS_TO)


def visible(c: Column) -> Column:
    """Without format characters: direction marks, zero-width characters, soft hyphens."""
    return F.regexp_replace(c, r"[\p{Cf}\x{00AD}]", "")


def clean(c: Column) -> Column:
    """Readable form for values: nothing invisible, ASCII digits and separators, known misreads mended, single spaces."""
    c = ascii_digits(visible(c))
    for pattern, instead in MISREADS:
        c = F.regexp_replace(c, pattern, instead)
    return one_space(c)


def norm(c: Column) -> Column:
    """Comparison form for labels and keywords: lower case, no diacritics, one form of Arabic letters, words and & only."""
    c = F.translate(F.regexp_replace(F.lower(c), "[ً-ْـ]", ""), LETTERS_FROM, LETTERS_TO)
    return F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}_&]+", " "))


def arabic_letters(c: Column) -> Column:
    return F.regexp_count(c, F.lit("[ء-ي]"))


def latin_letters(c: Column) -> Column:
    return F.regexp_count(c, F.lit("[A-Za-z]"))


def is_rtl(c: Column) -> Column:
    """Whether Arabic letters outnumber Latin ones."""
    return arabic_letters(c) > latin_letters(c)


def whole_word(text: Column, keyword: str) -> Column:
    """Whether a normalised text has a normalised keyword as whole words."""
    return F.concat(F.lit(" "), text, F.lit(" ")).contains(f" {keyword} ")
