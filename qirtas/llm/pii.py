"""Personal information in free text: found, and replaced by typed placeholders.

E-mail addresses, phone numbers, identity numbers and street addresses have forms. What has none is judged by the corpus: how
strongly a term reveals a protected entity is estimated from its co-occurrence with such entities, in bits (the log odds that
the entity is there, given the term). Three kinds of co-occurrence count:

* with the name roles that the tokens of the analyses carry, against all labelled tokens: names of persons; terms that nothing
  labels fall back on the disclosure of their endings;
* with the roles of providers and banks: a term beside such a one belongs to its name and reveals no person;
* with the addresses found by form, right behind them: towns, quarters and floors that belong to the address.

A text whose terms exceed the threshold holds the entity, and those terms are generalised to a placeholder. `disclosure`
reports the bits that are left after that.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator
from datetime import date
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qirtas.llm.canonical import edits
from qirtas.llm.forms import plain
from qirtas.runtime import only, written

# --- Fixed values -----------------------------------------------------------------------------------------------------
#: Words of trades and legal forms: a phrase with one of them names an organisation.
TRADE_WORDS = set(
    "bakery trading trdg trade co company corp inc llc ltd electronics elec electronic pharmacy pharm import export imp exp group sons "
    "s.a.e sae bros brothers stores store market shop est establishment factory restaurant "
    "bank banque bk bnk trust credit finance microfinance wallet pay cash money transfer express bills gifts remit giro mutual union "
    "شركة شركه مخبز مخابز صيدلية صيدليه للتجارة للتجاره للإلكترونيات للالكترونيات إلكترونيات الكترونيات للاستيراد والتصدير استيراد تصدير "
    "مجموعة مجموعه وأولاده واولاده وشركاه محل مصنع مطعم بنك مصرف محفظة محفظه للتمويل للائتمان باي كاش صندوق".split()
)
#: Words that are spelt like a name but are a preposition: "on".
NEVER_ALONE = {"على"}
#: Words before a place or street name.
PLACE_WORDS = ["Ezbet", "Tell", "Bab el", "New", "Old", "Kafr", "Mit", "عزبة", "عزبه", "تل", "باب", "كفر", "ميت", "حي"]
STREET_AFTER = r"(?:st|street|str|rd|road|ave|avenue|blvd|sq|square|lane)"
STREET_BEFORE = r"(?:شارع|ش\.|ميدان|طريق|حارة)"
BUILDING = r"(?:bldg|building|flat|apt|apartment|villa|عمارة|عماره|شقة|شقه|برج|فيلا)"
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID]", "address": "[ADDRESS]", "person_name": "[NAME]"}
# ----------------------------------------------------------------------------------------------------------------------

#: Bits (log odds) from which on a term discloses an entity: 2.5 is a probability of 0.85.
DISCLOSURE_BITS = 2.5
#: Bits from which on a word behind an address belongs to it: it does so more often than not.
PLACE_BITS = 0.0
#: Labelled occurrences that the base rate counts for beside those of a term.
PRIOR = 0.5
#: Least share of the distinct words with an ending that are of names.
ENDING_SHARE = 0.7
#: Labelled occurrences from which on a term speaks for itself; with fewer its endings speak.
TERM_COUNT = 3
#: Distinct words from which on an ending speaks.
ENDING_WORDS = 8

_AT = r"(?:@|\(at\)|\[at\])"
_DOT = r"(?:\.|\s?(?:\[dot\]|\(dot\))\s?)"
EMAIL = re.compile(rf"[\w.+\-]+\s?{_AT}\s?[\w\-]+(?:{_DOT}[\w\-]+)*{_DOT}[A-Za-z][\w\-]*\w", re.I)
HANDLE = re.compile(r"\S+")
PHONE = re.compile(r"(?<![\w.+/\-])(?:\(?\+?\d{1,4}\)?[\s.\-]?)?\(?\d{1,5}\)?(?:[\s.\-]?\d{2,8}){1,4}(?![\w/]|[.\-:]\d)")
ID = re.compile(r"(?<![\w\-.+])[23](?:[\s\-]?\d){13}(?!\w|-\d)")
PASSPORT = re.compile(r"(?<![\w\-])[A-Z]\d{8}(?![\w\-])")
_PLACE = r"(?:" + "|".join(PLACE_WORDS) + r")\s+[\w'\-]+(?:\s+\d{5}(?!\d))?"
_TAIL = rf"(?:[،,]?\s*(?:{_PLACE}|بجوار\s+\w+|أمام\s+\w+|الدور\s+\w+|شقة\s+\w+|\d+(?:st|nd|rd|th) floor|(?-i:[A-Z][a-z]+)\s+\d{{5}}(?!\d))){{0,6}}"
ADDRESS = re.compile(
    rf"(?:\b{BUILDING}\.?\s{{0,3}}\d{{1,6}}\s{{0,3}}[,،]?\s{{0,3}}){{0,3}}(?:\b\d+\s+(?:el[\s\-]|al[\s\-])?[^\W\d_]+(?:\s[^\W\d_]+)?\s{STREET_AFTER}\b\.?|(?:\b\d+\s*)?(?<!\w){STREET_BEFORE}\s*[^\W\d_]+){_TAIL}"
    rf"|\b{BUILDING}\.?\s*\d+\s*[,،]\s*[^\W\d_]+(?:\s[^\W\d_]+)?\s{STREET_AFTER}\b\.?{_TAIL}"
    rf"|\b{BUILDING}\s*\d+\s+{BUILDING}\s*\d+{_TAIL}",
    re.I,
)
PLACE = re.compile(rf"(?<!\w){_PLACE}")
#: Words without which nothing is an address.
STREETISH = re.compile(rf"\b{STREET_AFTER}\b|{BUILDING}|{STREET_BEFORE}", re.I)
UNNUMBERED = re.compile(STREET_BEFORE)
LANDLINE = re.compile(r"(?:0020|20)?0?(?:2\d{8}|3\d{7}|(?:13|15|40|4[5-8]|50|55|57|6[2-9]|8[246-8]|9[2-7])\d{7})")
#: Ten digits in the groups in which they are dialled elsewhere.
GROUPED = re.compile(r"(?:\(\d{3}\)\s?|\d{3}[.\-])\d{3}[.\-]\d{4}")
_DIGITS = str.maketrans("٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789")
_DIGIT = re.compile(r"\d")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_FOLD = str.maketrans({"أ": "ا", "إ": "ا", "آ": "ا", "ى": "ي", "ة": "ه", "ؤ": "و", "ئ": "ي", "ـ": None})
_ARTICLE = re.compile(r"^(?:el|al)(?=[a-z]{4,})|^ال(?=\w{3,})")


def term(word: str) -> str:
    """A word as a term: lower case, one spelling of Arabic letters, without an article grown to it."""
    return _ARTICLE.sub("", word.lower().translate(_FOLD))


def is_phone(text: str) -> bool:
    """Whether a run of digits with separators is a full phone number; short service numbers are none."""
    plus = "+" in text
    digits = re.sub(r"\D", "", text)
    if re.fullmatch(r"(?:0020|20)?01[0125]\d{8}", digits):
        return True
    if re.fullmatch(r"(?:0020|20)1[0125]\d{8}", digits):
        return plus or digits.startswith("00")
    if plus:
        return 9 <= len(digits) <= 15
    return bool(GROUPED.fullmatch(text.strip())) or digits.startswith("0") and bool(LANDLINE.fullmatch(digits))


def is_national_id(text: str) -> bool:
    """Whether 14 digits are a national identity number: century, then a birth date that exists."""
    d = re.sub(r"\D", "", text)
    try:
        date((1900 if d[0] == "2" else 2000) + int(d[1:3]), int(d[3:5]), int(d[5:7]))
        return len(d) == 14
    except ValueError:
        return False


def spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, type) of the forms in a text: email, phone, id_number, address; not overlapping, in order."""
    found: list[tuple[int, int, str]] = []
    ascii_digits = text.translate(_DIGITS)
    taken = bytearray(len(text))

    def add(pattern: re.Pattern, kind: str, ok=lambda t: True) -> None:
        for m in pattern.finditer(ascii_digits):
            if ok(m[0]) and not any(taken[m.start() : m.end()]):
                taken[m.start() : m.end()] = b"\x01" * (m.end() - m.start())
                found.append((m.start(), m.end(), kind))

    if "@" in text or "(" in text or "[" in text:
        add(EMAIL, "email")
    digit = _DIGIT.search(ascii_digits) is not None
    if digit:
        add(ID, "id_number", is_national_id)
        add(PASSPORT, "id_number")
    if (STREETISH if digit else UNNUMBERED).search(text):
        add(ADDRESS, "address")
    if digit:
        add(PHONE, "phone", is_phone)
    return sorted(found)


def outside(text: str, found: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """The stretches of a text outside the spans."""
    out, at = [], 0
    for s, e, _ in found:
        out.append((at, s))
        at = e
    return [*out, (at, len(text))]


_PHRASE = re.compile(r"[^:;/()\d]+")


def name_words(text: str, found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """(start, end, term) of the words that may belong to a person's name: outside forms, handles and place names, and not
    in a phrase that names an organisation."""
    out = []
    for s, e in outside(text, found):
        part = text[s:e]
        if "@" in part:
            part = HANDLE.sub(lambda m: " " * len(m[0]) if "@" in m[0] else m[0], part)
        if len(part) > 5:
            part = PLACE.sub(lambda m: " " * len(m[0]), part)
        for phrase in _PHRASE.finditer(part):
            words = [(s + phrase.start() + m.start(), s + phrase.start() + m.end(), m[0]) for m in _WORD.finditer(phrase[0])]
            told = [_told(w) for _, _, w in words]
            if any(t is None for t in told) or "*" in phrase[0]:
                continue
            out += [(a, b, t) for (a, b, _), t in zip(words, told) if t]
    return out


def _lessened(word: str, letters: int) -> set[str]:
    """A word with up to so many letters left out: words as many edits apart have one in common."""
    out = {word}
    for _ in range(letters):
        out |= {w[:k] + w[k + 1 :] for w in out for k in range(len(w))}
    return out


_TRADES = {w.translate(_FOLD) for w in TRADE_WORDS}
_NEAR_TRADES: dict[str, list[str]] = {}
for _w in sorted(_TRADES):
    for _v in _lessened(_w, 2 if len(_w) >= 9 else 1) if len(_w) >= 6 else ():
        _NEAR_TRADES.setdefault(_v, []).append(_w)


@lru_cache(maxsize=200_000)
def is_trade(word: str) -> bool:
    """Whether a word is a trade word, or a long one with a slip; with two in words of nine letters or more."""
    if word in _TRADES:
        return True
    if not 6 <= len(word) <= 40:
        return False
    near = {t for v in _lessened(word, 2 if len(word) >= 8 else 1) for t in _NEAR_TRADES.get(v, ())}
    return any(edits(word, t) <= (2 if len(t) >= 9 else 1) for t in near)


@lru_cache(maxsize=200_000)
def _told(word: str) -> str | None:
    """The term of a word, '' if it says nothing, None if it names a trade."""
    if is_trade(word.lower().translate(_FOLD)):
        return None
    return term(word) if len(word) > 1 and word not in NEVER_ALONE else ""


def items(analyses: DataFrame) -> DataFrame:
    """receipt_id, field, pos, text, role: one row per line and token text that is not null."""
    of = lambda field, i, text, role: F.struct(F.lit(field).alias("field"), i.cast("int").alias("pos"), text.alias("text"), role.alias("role"))
    none = F.lit(None).cast("string")
    lines = F.transform(F.coalesce("text_lines", F.array().cast("array<string>")), lambda x, i: of("text_lines", i, x, none))
    tokens = F.transform(F.coalesce("tokens", F.from_json(F.lit("[]"), "array<struct<text string, line int, role string>>")), lambda x, i: of("tokens", i, x["text"], F.nullif(x["role"], F.lit(""))))
    return only(analyses, "receipt_id", "text_lines", "tokens").select("receipt_id", F.explode(F.concat(lines, tokens)).alias("i")).select("receipt_id", "i.*").where(F.col("text").isNotNull())


_BEHIND = re.compile(r"(?:[\s,،.]+([^\W\d_]{2,}))(?:[\s,،.]+([^\W\d_]{2,}))?")


def behind(text: str, found: list[tuple[int, int, str]]) -> list[str]:
    """The terms right behind the addresses of a text, two at most of each; one that leads to another form is none."""
    starts = [s for s, _, _ in found]
    out = []
    for _, e, kind in found:
        if kind == "address" and (m := _BEHIND.match(text, e)):
            out += [term(m[g]) for g in (1, 2) if m[g] and not any(s >= m.end(g) and not text[m.end(g) : s].strip(" :.") for s in starts)]
    return out


READ_SCHEMA = "receipt_id string, field string, pos int, text string, role string, kinds array<string>, words array<string>, behind array<string>"


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Forms and possible name words of each item; once per distinct text of a batch."""
    known: dict[str, tuple] = {}
    for b in batches:
        if len(known) > 300_000:
            known.clear()
        rows = []
        for text in b["text"]:
            if (got := known.get(text)) is None:
                shown = text if text.isascii() else plain(text)
                found = spans(shown)
                got = known[text] = (sorted({k for _, _, k in found}), [t for _, _, t in name_words(shown, found)], behind(shown, found) if found else [])
            rows.append(got)
        kinds, words, near = zip(*rows) if rows else ((), (), ())
        yield b.assign(kinds=list(kinds), words=list(words), behind=list(near))


def _bits(share: F.Column) -> F.Column:
    return F.log2(share / (1 - share))


def term_disclosure(read: DataFrame) -> DataFrame:
    """word, n (labelled items), names, person_bits, firm_bits: what a word says of a person, or of a provider or bank."""
    labelled = read.where(F.col("role").isNotNull() & (F.col("role") != "note"))
    name, firm = F.col("role").endswith(".name"), F.col("role").endswith(".bank") | (F.col("role") == "provider")
    counts = labelled.select(F.explode(F.array_distinct("words")).alias("word"), name.alias("name"), firm.alias("firm")).groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.count_if("name").alias("names"), F.count_if("firm").alias("firms"))
    base = labelled.agg(*[F.greatest(F.avg(c.cast("double")), F.lit(1e-6)).alias(k) for k, c in (("base", name), ("firm_base", firm))])
    share = lambda hits, b: (F.col(hits) + PRIOR * F.col(b)) / (F.col("n") + PRIOR)
    return counts.crossJoin(F.broadcast(base)).select("word", "n", "names", _bits(share("names", "base")).alias("person_bits"), _bits(share("firms", "firm_base")).alias("firm_bits"))


def place_disclosure(read: DataFrame) -> DataFrame:
    """word, bits of the words that stand behind addresses: how surely one does where the word is met."""
    met = read.select(F.explode(F.array_distinct(F.concat("words", "behind"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    near = read.where("size(behind) > 0").select(F.explode(F.array_distinct("behind")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("near"))
    return near.join(met, "word").where(F.col("n") >= TERM_COUNT).select("word", _bits((F.col("near") + PRIOR * 0.1) / (F.col("n") + PRIOR)).alias("bits"))


def ending_disclosure(terms: DataFrame) -> DataFrame:
    """ending (last 3 or 4 letters), share of the distinct labelled words with it that are of names, kept where it speaks."""
    ends = F.expr("transform(sequence(3, 4), k -> right(word, k))")
    by = terms.where(F.length("word") >= 6).select(F.explode(ends).alias("ending"), (2 * F.col("names") > F.col("n")).cast("double").alias("name"))
    return by.groupBy("ending").agg(F.count(F.lit(1)).alias("words"), F.avg("name").alias("share")).where(F.col("words") >= ENDING_WORDS)


def disclosing(analyses: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The items read; the words that disclose a person: word, bits; and those that belong to an address: word."""
    read = written(items(analyses).mapInPandas(_read, READ_SCHEMA), "pii-items")
    tokens = read.where("field = 'tokens'")
    terms = written(term_disclosure(tokens), "pii-terms")
    places = written(place_disclosure(tokens).where(F.col("bits") >= PLACE_BITS).select("word"), "pii-places")
    often = terms.where(F.col("n") >= TERM_COUNT)
    sure = often.where(F.col("person_bits") >= DISCLOSURE_BITS).select("word", F.col("person_bits").alias("bits"))
    asked = read.select(F.explode("words").alias("word")).distinct().where(F.length("word") >= 6).join(often, "word", "left_anti")
    ended = (
        asked.select("word", F.explode(F.expr("transform(sequence(3, 4), k -> right(word, k))")).alias("ending"))
        .join(ending_disclosure(terms), "ending")
        .groupBy("word")
        .agg(F.max_by("share", F.length("ending")).alias("share"))
        .where(F.col("share") >= ENDING_SHARE)
        .select("word", _bits(F.least("share", F.lit(0.999))).alias("bits"))
    )
    words = sure.unionByName(ended).groupBy("word").agg(F.max("bits").alias("bits")).join(places, "word", "left_anti")
    return read, written(words, "pii-words"), places


def persons(read: DataFrame, words: DataFrame) -> DataFrame:
    """receipt_id, field, pos, word, bits of the words that disclose a person: not beside a word of a provider or bank."""
    firms = written(term_disclosure(read.where("field = 'tokens'")).where((F.col("n") >= TERM_COUNT) & (F.col("firm_bits") >= DISCLOSURE_BITS)).select("word"), "pii-firms")
    at = read.where("size(words) > 0").select("receipt_id", "field", "pos", F.posexplode("words").alias("k", "word"), "words")
    beside = lambda d: F.coalesce(F.get("words", F.col("k") + d), F.lit(""))
    hit = at.select("receipt_id", "field", "pos", "word", beside(-1).alias("before"), beside(1).alias("after")).join(words, "word")
    for side in ("before", "after"):
        hit = hit.join(firms.withColumnRenamed("word", side), side, "left_anti")
    return hit.select("receipt_id", "field", "pos", "word", "bits")


def found_types(analyses: DataFrame) -> DataFrame:
    """receipt_id, field, pos, pii_type: one row for each type that a line or token text holds at least once."""
    read, words, _ = disclosing(analyses)
    forms = read.select("receipt_id", "field", "pos", F.explode("kinds").alias("pii_type"))
    return forms.unionByName(persons(read, words).select("receipt_id", "field", "pos").distinct().withColumn("pii_type", F.lit("person_name")))


_CLUSTER = re.compile(r"[^\W_][\u0300-\u036f\u064b-\u0655\u200b-\u200f\u00ad]*|.", re.S)


def offsets(text: str, shown: str) -> list[int]:
    """For each place of the plain form of a text, and its end, the place in the text that it comes from."""
    if len(text) == len(shown) and text.isascii():
        return list(range(len(text) + 1))
    out: list[int] = []
    for m in _CLUSTER.finditer(text):
        out += [m.start()] * len(plain(m[0]))
    if len(out) == len(shown):
        return [*out, len(text)]
    out = []
    for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, text, shown, autojunk=False).get_opcodes():
        out += [i1 + min(k, i2 - i1) if tag == "equal" else i1 for k in range(j2 - j1)]
    return [*out, len(text)]


_JOINING = re.compile(r"[\s.\-,]*(?:\b\w\.?[\s.\-]*)?(?:(?:el|al|abd|ال|عبد)[\s\-]*)*", re.I)


def replaced(text: str, told: set[str], towns: set[str]) -> str:
    """The text with a placeholder for each form and for each run of the told words; what lies between is as it was."""
    shown = text if text.isascii() else plain(text)
    found = []
    for s, e, kind in spans(shown):
        # words behind an address that the corpus knows to belong to it
        while kind == "address" and (m := _BEHIND.match(shown, e)) and term(m[1]) in towns:
            e = m.end(1)
        found.append((s, e, kind))
    joined: list[list[int]] = []
    for s, e, t in name_words(shown, found):
        if t not in told:
            continue
        # words of one name are one placeholder
        if joined and _JOINING.fullmatch(shown, joined[-1][1], s):
            joined[-1][1] = e
        else:
            joined.append([s, e])
    if not found and not joined:
        return text
    at_text = range(len(text) + 1) if shown == text else offsets(text, shown)
    made, at = [], 0
    for s, e, kind in sorted([*found, *((s, e, "person_name") for s, e in joined)]):
        made += [text[at : at_text[s]], PLACEHOLDERS[kind]]
        at = at_text[e]
    return "".join(made) + text[at:]


def _replaced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    of = lambda x: set(x) if x is not None else set()
    for b in batches:
        yield b.drop(columns=["names", "towns"]).assign(sanitised=[replaced(t, of(n), of(w)) for t, n, w in zip(b["text"], b["names"], b["towns"])])


def sanitised(analyses: DataFrame) -> DataFrame:
    """receipt_id, field, pos, text, sanitised: every line and token text with placeholders for what it discloses. The text
    between placeholders is unchanged."""
    read, words, places = disclosing(analyses)
    keys = ["receipt_id", "field", "pos"]
    named = persons(read, words).groupBy(*keys).agg(F.collect_set("word").alias("names"))
    near = read.where("size(behind) > 0").select(*keys, F.explode("behind").alias("word")).join(places, "word", "left_semi").groupBy(*keys).agg(F.collect_set("word").alias("towns"))
    numbered = read.select(*keys, "text", (F.size("kinds") > 0).alias("formed")).join(named, keys, "left").join(near, keys, "left")
    # most texts hold nothing and stay in the JVM
    some = F.col("formed") | F.col("names").isNotNull()
    done = numbered.where(some).drop("formed").mapInPandas(_replaced, "receipt_id string, field string, pos int, text string, sanitised string")
    return done.unionByName(numbered.where(~some).select(*keys, "text", F.col("text").alias("sanitised")))


def disclosure(analyses: DataFrame) -> DataFrame:
    """field, texts, disclosing (texts with a word that discloses a person), bits_before and bits_after: the mean over texts of the
    most bits that one of their words holds of a person's name, as written and with what `sanitised` leaves."""
    read, words, _ = disclosing(analyses)
    keys = ["receipt_id", "field", "pos"]
    terms = term_disclosure(read.where("field = 'tokens'")).select("word", F.greatest("person_bits", F.lit(0.0)).alias("known"))
    gone = persons(read, words).select(*keys, "word").distinct().withColumn("gone", F.lit(True))
    at = read.select(*keys, F.explode_outer(F.array_distinct("words")).alias("word")).join(terms, "word", "left").join(words.withColumnRenamed("bits", "told"), "word", "left").join(gone, [*keys, "word"], "left")
    bits = F.coalesce("told", "known", F.lit(0.0))
    per = at.groupBy(*keys).agg(F.max(bits).alias("before"), F.max(F.when(F.col("gone"), 0.0).otherwise(bits)).alias("after"), F.max(F.coalesce("gone", F.lit(False)).cast("int")).alias("told"))
    return per.groupBy("field").agg(F.count(F.lit(1)).alias("texts"), F.sum("told").alias("disclosing"), F.round(F.avg("before"), 6).alias("bits_before"), F.round(F.avg("after"), 6).alias("bits_after"))
