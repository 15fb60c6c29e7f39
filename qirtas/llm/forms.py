"""Visually identical text with different characters: one consistent form.

`plain` keeps the reading as it looks: composed characters, letters of the script that a word is written in, ordinary spaces
and hyphens, ASCII or Arabic-Indic digits, nothing invisible. `comparison_key` is plain with compatibility normalisation of
what looks different (superscripts, fractions) and full case folding, so that equal-looking readings are equal.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qirtas.runtime import only

# --- Fixed values -----------------------------------------------------------------------------------------------------
#: Letters of other scripts that look like a Latin letter.
GREEK_LATIN = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J", "ο": "o", "ϲ": "c", "ϳ": "j", "ν": "v", "α": "a", "ι": "i", "κ": "k", "ρ": "p", "υ": "u",
}
CYRILLIC_LATIN = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C",
    "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y",
    "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ү": "y", "ӏ": "l", "Ӏ": "I",
}
OTHER_LATIN = {"օ": "o", "ո": "n", "ս": "u", "Օ": "O", "Տ": "S", "ɡ": "g", "ɑ": "a", "ӧ": "ö"}
#: Letters that Arabic text shows as an ordinary Arabic letter.
ARABIC_LIKE = {"ی": "ي", "ک": "ك", "ھ": "ه", "ہ": "ه", "ە": "ه", "ڪ": "ك", "۰": "٠", "۱": "١", "۲": "٢", "۳": "٣", "۴": "٤", "۵": "٥", "۶": "٦", "۷": "٧", "۸": "٨", "۹": "٩"}
HYPHENS = "‐‑⁃﹣－"
#: Default-ignorable code points.
IGNORABLE = "­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ￰-￸\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0000-\U000e0fff"
#: Compatibility decompositions that look different from what they stand for.
LOOKS_OTHER = ("<super>", "<sub>", "<fraction>", "<circle>", "<square>", "<vertical>")
# ----------------------------------------------------------------------------------------------------------------------

#: Readings made of these characters alone are plain already: ASCII, Arabic letters and digits without marks, Arabic comma.
_TRIVIAL = r"^[\x20-\x7Eء-غف-ي٠-٩،]*$"
_DROP = re.compile(f"[{IGNORABLE}]+")
_SPACE = re.compile("[\\u00a0\\u1680\\u2000-\\u200a\\u202f\\u205f\\u3000]")
_HYPHEN = re.compile(f"[{HYPHENS}]")
_ARABIC = str.maketrans(ARABIC_LIKE)
#: Compatibility composition would make a sigma of the lunate letter; it looks like the Cyrillic one.
_LUNATE = str.maketrans({"Ϲ": "С", "ϲ": "с"})
_TO_LATIN = GREEK_LATIN | CYRILLIC_LATIN | OTHER_LATIN
_FROM_LATIN = {"G": {v: k for k, v in reversed(GREEK_LATIN.items())}, "C": {v: k for k, v in reversed(CYRILLIC_LATIN.items())}}
_WORD = re.compile(r"[^\W_]+(?:[̀-ͯ]+[^\W_]*)*")
_FOREIGN = re.compile("[\\u0370-\\u052f\\u0531-\\u058f\\u1f00-\\u1fff\\u0251\\u0261]")


def _script(ch: str) -> str:
    """L, G or C where the letter belongs to that script alone, a small letter where it looks like a Latin one, else ''."""
    if ch in _TO_LATIN:
        return "g" if ch in GREEK_LATIN else "c"
    code = ord(ch)
    if code < 0x250 or 0x1E00 <= code < 0x1F00:
        return "L" if ch.isalpha() else ""
    if 0x370 <= code < 0x400 or 0x1F00 <= code < 0x2000:
        return "G"
    return "C" if 0x400 <= code < 0x530 else ""


def _one_script(text: str) -> str:
    """Replace look-alike letters by those of the script that their word is written in.

    A word with a letter that only Greek or Cyrillic has is of that script; other words with Latin letters, or with
    look-alikes alone, are Latin, except that words of look-alikes of one script alone stay beside genuine words of that
    script when no Latin word is near.
    """
    words = [(m, {_script(ch) for ch in m[0]}) for m in _WORD.finditer(text)]
    own = {s for _, found in words for s in found & {"G", "C"}}
    latin = any("L" in found and not found & {"G", "C"} for _, found in words)
    out, at = [], 0
    for m, found in words:
        word = m[0]
        if found & {"g", "c", "G", "C"}:
            if "G" in found or "C" in found:
                home = "G" if "G" in found else "C"
                if "L" in found and all(ch in _FROM_LATIN[home] for ch in word if _script(ch) == "L"):
                    word = "".join(_FROM_LATIN[home].get(ch, ch) for ch in word)
            elif "L" not in found and not latin and found & {"g", "c"} in ({"g"}, {"c"}) and (found & {"g", "c"}).pop().upper() in own and not any(ch.isdigit() for ch in word):
                pass
            else:
                word = "".join(_TO_LATIN.get(ch, ch) for ch in word)
        out += [text[at : m.start()], word]
        at = m.end()
    return "".join(out) + text[at:]


def plain(text: str) -> str:
    """The plain form of a reading; see the module. Empty text gives itself; spaces are neither joined nor trimmed."""
    text = _SPACE.sub(" ", _DROP.sub("", text))
    if text.isascii():
        return text
    text = text.translate(_LUNATE)
    if not any(unicodedata.decomposition(ch).startswith(LOOKS_OTHER) for ch in set(text)):
        text = unicodedata.normalize("NFKC", text)
    else:
        text = unicodedata.normalize("NFC", "".join(ch if unicodedata.decomposition(ch).startswith(LOOKS_OTHER) else unicodedata.normalize("NFKC", ch) for ch in text))
    text = _DROP.sub("", _HYPHEN.sub("-", text)).translate(_ARABIC)
    return _one_script(text) if _FOREIGN.search(text) else text


def comparison_key(text: str) -> str:
    """plain, compatibility-composed, case-folded, with runs of white space as one space and none at the ends."""
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", plain(text)).casefold())
    return " ".join(folded.split())


def per_value(fn: Callable[[str], str]) -> Callable[[pd.Series], pd.Series]:
    """fn over a batch, once for each distinct value; null stays null."""

    def run(values: pd.Series) -> pd.Series:
        codes, distinct = pd.factorize(values, use_na_sentinel=True)
        done = pd.Series([fn(v) for v in distinct], dtype=object)
        return done.reindex(codes).where(codes >= 0, None).reset_index(drop=True)

    return run


def plain_column(text: Column) -> Column:
    return F.pandas_udf(per_value(plain), "string")(text)


def key_column(text: Column) -> Column:
    return F.pandas_udf(per_value(comparison_key), "string")(text)


def readings(lines: DataFrame) -> DataFrame:
    """receipt_id, line_no, field (text, alts), pos, reading: one row per reading that is not null."""
    of = lambda field, pos, c: F.struct(F.lit(field).alias("field"), pos.cast("int").alias("pos"), c.alias("reading"))
    alts = F.transform(F.coalesce(F.col("alts"), F.array().cast("array<string>")), lambda x, i: of("alts", i, x))
    return (
        only(lines, "receipt_id", "line_no", "text", "alts").select("receipt_id", "line_no", F.explode(F.concat(F.array(of("text", F.lit(0), F.col("text"))), alts)).alias("r"))
        .select("receipt_id", "line_no", "r.field", "r.pos", "r.reading")
        .where(F.col("reading").isNotNull())
    )


def needs_work(reading: Column) -> Column:
    """Whether plain could change the reading at all: false only where all characters are plain in any order."""
    return ~reading.rlike(_TRIVIAL)


def disguised(lines: DataFrame) -> DataFrame:
    """Readings that contain characters other than those of their plain form, with that form."""
    return readings(lines).where(needs_work(F.col("reading"))).withColumn("plain", plain_column(F.col("reading"))).where(F.col("plain") != F.col("reading"))
