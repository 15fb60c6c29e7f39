"""Parsers of values as column expressions. An unparsable text gives null; no text makes them fail."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from qirtas.functions import text as T
from qirtas.functions.vocabulary import BANKS, CURRENCIES, SENTENCES

# --- Fixed values -----------------------------------------------------------------------------------------------------
NUMBER = r"(?:\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)"
PHONE = r"(?:\+?20|0)1[0125]\d{8}"
ACCOUNT = r"[\w.+-]+@[\w-]+(?:\.[\w-]+)*"
MOBILE = r"(?<!\d)(?:\+?20|0020)?0?(1[0125]\d{8})(?!\d)"
ADDRESS = r"[A-Za-z0-9._%+\-]+\s?@\s?[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*"
DOTTED = r"^[^@\s]+@[^@\s.]+(?:\.[^@\s.]+)+$"
BANK_CODE = r"^([A-Z]{2,6})\s+(\d[\dA-Z*-]{4,})$"
ACCOUNT_NUMBER = r"^[\dA-Z*xX#]{6,}$"
# ----------------------------------------------------------------------------------------------------------------------

_TOKENS = {t.lower(): code for code, tokens in CURRENCIES.items() for t in tokens}
#: A currency token not beside other letters, longest first.
_COIN = "(?<![A-Za-z؀-ۿ])(?:" + "|".join(re.escape(t) for t in sorted(_TOKENS, key=len, reverse=True)) + ")(?![A-Za-z؀-ۿ])"
CURRENCY = f"(?i)({_COIN})"
BANK = "(?i)^(" + "|".join(re.escape(b) for b in sorted(BANKS, key=len, reverse=True)) + r")(?![\p{L}\p{N}_])[\s:-]*(.*)$"
_SUM = rf"((?:{_COIN}\s*)?{NUMBER}(?:\s*{_COIN})?)"
#: Party and pattern of each sentence; group 1 is the sum, group 2 the party's value.
SENTENCE = [(party, "(?i)" + p.replace(" ", r"\s+").replace("{amount}", _SUM).replace("{party}", "([^.!،]+?)") + r"\s*(?:[.!،]|$)") for party, p in SENTENCES]


def _or_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def money(c: Column) -> Column:
    """struct(value decimal(18,2), currency) of a text that is an amount and nothing else; its sign is dropped."""
    c = T.clean(c)
    token = F.lower(_or_null(F.regexp_extract(c, CURRENCY, 1)))
    number = F.regexp_extract(F.trim(F.regexp_replace(c, CURRENCY, " ")), rf"^[-+]?\s*({NUMBER})$", 1)
    value = F.replace(_or_null(number), F.lit(","), F.lit("")).try_cast("decimal(18,2)")
    code = F.try_element_at(F.create_map(*[F.lit(x) for kv in _TOKENS.items() for x in kv]), token)
    return F.when(value.isNotNull(), F.struct(value.alias("value"), code.alias("currency")))


def phone(c: Column) -> Column:
    """The first Egyptian mobile number in a text, as 0 and ten digits, also where separators split it."""
    c = T.ascii_digits(c)
    found = F.coalesce(_or_null(F.regexp_extract(c, MOBILE, 1)), _or_null(F.regexp_extract(F.regexp_replace(c, r"[\s().\-]", ""), MOBILE, 1)))
    return F.concat(F.lit("0"), found)


def email(c: Column) -> Column:
    """The first address in a text, in lower case, also with a space at its @; wallet handles have no dotted host."""
    found = F.regexp_extract(c, ADDRESS, 0)
    return F.lower(F.regexp_replace(_or_null(found), r"\s", ""))


def is_dotted(c: Column) -> Column:
    """Whether an address has a dotted host: an e-mail address, not the handle of a wallet."""
    return c.rlike(DOTTED)


def reference(c: Column) -> Column:
    """The longest run of at least four letters, digits and inner hyphens; the first of equals."""
    runs = F.regexp_extract_all(T.ascii_digits(c), F.lit(r"[A-Za-z0-9\-]{4,}"), F.lit(0))
    runs = F.filter(F.transform(runs, lambda r: F.regexp_replace(r, "^-+|-+$", "")), lambda r: F.length(r) >= 4)
    return F.aggregate(runs, F.lit(None).cast("string"), lambda best, r: F.when(best.isNull() | (F.length(r) > F.length(best)), r).otherwise(best))


def classify(c: Column) -> Column:
    """array<struct<slot,value>>: what a free-standing value looks like, by the first rule that fits."""
    c = T.clean(c)
    compact = F.regexp_replace(c, r"[\s-]", "")
    pair = lambda *xs: F.array(*[F.struct(F.lit(s).alias("slot"), v.alias("value")) for s, v in xs])
    held = F.regexp_extract(c, BANK, 2)
    return (
        F.when(c.rlike(ACCOUNT), pair(("account", F.regexp_extract(c, ACCOUNT, 0))))
        .when(compact.rlike(f"^{PHONE}$"), pair(("phone", compact)))
        .when(c.rlike(BANK) & held.rlike(r"\d"), pair(("bank", F.regexp_extract(c, BANK, 1)), ("account", held)))
        .when(c.rlike(BANK_CODE), pair(("bank", F.regexp_extract(c, BANK_CODE, 1)), ("account", F.regexp_extract(c, BANK_CODE, 2))))
        .when(compact.rlike(ACCOUNT_NUMBER) & (F.regexp_count(compact, F.lit(r"\d")) >= 4), pair(("account", c)))
        .when(F.regexp_count(c, F.lit(r"\p{L}")) >= 3, pair(("name", c)))
        .otherwise(F.array().cast("array<struct<slot:string,value:string>>"))
    )


def sentence(c: Column) -> Column:
    """struct(amount, party, value) of a text that tells a transfer in one sentence, by the first pattern that fits: the sum
    as printed, the party it names and what it says of it."""
    out = None
    for party, pattern in SENTENCE:
        got = F.struct(F.regexp_extract(c, pattern, 1).alias("amount"), F.lit(party).alias("party"), F.regexp_extract(c, pattern, 2).alias("value"))
        out = F.when(c.rlike(pattern), got) if out is None else out.when(c.rlike(pattern), got)
    return out


def sentence_party(c: Column) -> Column:
    """array<struct<slot,value>> of what a sentence says of a party: a phone anywhere wins, else what the text looks like."""
    number = _or_null(F.regexp_extract(F.regexp_replace(T.clean(c), r"[\s-]", ""), PHONE, 0))
    return F.when(number.isNotNull(), F.array(F.struct(F.lit("phone").alias("slot"), number.alias("value")))).otherwise(classify(c))


_DATE = r"(?<!\d)(?:\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.](?:\d{4}|\d{2}))(?!\d)|(?<!\d)\d{1,2}\s*\p{L}{3,9}\.?,?\s*\d{4}|\p{L}{3,9}\.?\s+\d{1,2},?\s+\d{4}"


def looks_dated(c: Column) -> Column:
    """Whether a text holds something of the shape of a date."""
    return T.ascii_digits(c).rlike(_DATE)


def described(c: Column) -> Column:
    """What a leftover text is: money (with a currency), datetime, phone, account; null if it is just text."""
    slots = F.filter(F.transform(classify(c), lambda p: p["slot"]), lambda s: s != "name")
    return F.when(money(c)["currency"].isNotNull(), "money").when(looks_dated(c), "datetime").otherwise(F.try_element_at(slots, F.lit(-1)))


def valid(target: Column, c: Column) -> Column:
    """Whether a text can be the value of a target field."""
    slot = F.element_at(F.split(target, r"\."), -1)
    compact = F.regexp_replace(c, " ", "")
    return (
        F.when(slot.isin("amount", "fees", "total"), money(c).isNotNull())
        .when(slot == "datetime", looks_dated(c))
        .when(slot == "reference", compact.rlike(r"^[\p{L}\p{N}_\-/#.]{4,}$") & compact.rlike(r"\d"))
        .when(slot == "account", F.size(classify(c)) > 0)
        .when(slot == "name", F.regexp_count(c, F.lit(r"\p{L}")) >= 2)
        .otherwise(c.rlike(r"[\p{L}\p{N}_]"))
    )


def cross_check(amount: Column, fees: Column, total: Column) -> Column:
    """struct(amount, fees, total, derived, warning): of three sums one is derived from the others, or they are compared."""
    a, f, t = amount, fees, total
    have = lambda *cs: F.when(F.lit(True), F.lit(True)) if not cs else _all([c.isNotNull() for c in cs])
    off, same = F.abs(a + f - t) > F.lit(0.01), F.abs(a - t) <= F.lit(0.01)
    zeroed = have(a, f, t) & off & same
    derived = F.when(have(a, f, t), F.lit(None)).when(have(a, f), "total").when(have(a, t) & (t >= a), "fees").when(have(f, t) & a.isNull(), "amount")
    money_ = lambda c: c.cast("decimal(18,2)")
    return F.struct(
        money_(F.when(derived == "amount", t - f).otherwise(a)).alias("amount"),
        money_(F.when(zeroed, F.lit(0)).when(derived == "fees", t - a).otherwise(f)).alias("fees"),
        money_(F.when(derived == "total", a + f).otherwise(t)).alias("total"),
        derived.alias("derived"),
        F.when(zeroed, "fees zeroed").when(have(a, f, t) & off, "sums differ").alias("warning"),
    )


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
