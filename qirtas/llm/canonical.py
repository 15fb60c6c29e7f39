"""Free-entered values mapped to the entries of a canonical list, with the unmatched ones reported.

A multi-pattern automaton over the canonical names and their aliases finds embedded mentions; the longest non-overlapping
ones win. Values without a mention go to token-set similarity with misspelt and abbreviated tokens, over an index of the
list's tokens by bigrams and of its names by their most telling tokens. How telling a word is comes from the list (in how many
entries it stands) and from the values: a word of the list that stands mostly beside words that no entry has ("credit") tells
no entry by itself. The list is held by every task: it may have at most `MAX_ENTRIES` entries. Values of any length are matched
without a shuffle, once per distinct value of a batch.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qirtas.llm.forms import comparison_key
from qirtas.runtime import only

#: Bound of the canonical list, whose automaton every task holds (about 1 kB an entry).
MAX_ENTRIES = 100_000
#: Least share of an entry's token weight that a value must have, and least share of the value's own weight that the entry
#: must explain, for a match by similarity.
COVER, EXPLAIN = 0.74, 0.5
#: Least share of the distinct values with a word that have a word strange to the list, for the word to tell nothing by itself;
#: and its weight then.
STRANGE, GENERIC_WEIGHT = 0.5, 0.35
#: Least similarity of two tokens, 1 - edits / longer length, to count as misspelt.
TOKEN_SIM = 0.66

# --- Fixed values -----------------------------------------------------------------------------------------------------
#: Words around a name that say nothing about which one is meant.
NOISE = set("app atm s.a.e sae egypt branch br main via to a/c ac account acc no ltd co in at from by instant online mobile فرع حساب".split())
#: Abbreviations that are neither a beginning nor a skeleton of their word.
SHORT_WORDS = {"bk": "bank", "bnk": "bank", "bnq": "banque", "mny": "money", "wlt": "wallet", "trf": "transfer", "exp": "express", "intl": "international", "micro": "microfinance", "fin": "finance", "comm": "commercial", "inv": "investment", "coop": "cooperative", "agri": "agricultural"}
#: Usual names of currencies beside those of the list.
CURRENCY_NAMES = {
    "EGP": ["le", "l e", "l.e", "egyptian pounds", "egypt pound", "egy pound", "egy pounds", "e pound", "ج.م", "ج م", "جم", "ج", "جنيه", "جنيه مصرى", "جنيهات"],
    "USD": ["us$", "us $", "u.s. dollar", "u s dollar", "u s dollars", "us dollars", "dollar us", "american dollar", "dollar", "dollars", "دولار"],
    "EUR": ["euros", "eur", "اليورو"],
    "SAR": ["s r", "saudi rial", "saudi riyals", "riyal saudi", "ر.س", "ر س"],
    "AED": ["dhs", "uae dirhams", "emirati dirham", "dirham", "د.إ", "د إ"],
    "KWD": ["kuwait dinar", "kuwaiti dinars", "د.ك", "د ك"],
    "QAR": ["qatar riyal", "qatari rial", "qatari riyals", "ر.ق", "ر ق"],
    "JOD": ["jordan dinar", "jordanian dinars", "jordan dinars", "د.أ", "د ا"],
    "GBP": ["pounds sterling", "sterling", "british pound", "uk pound", "gb pound"],
    "TRY": ["turkish liras", "turkish lira", "tl", "turkey lira"],
}
#: Further names by field and canonical value.
ALIASES = {"currency": CURRENCY_NAMES}
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a"}
# ----------------------------------------------------------------------------------------------------------------------

_ARABIC_FOLD = str.maketrans({"أ": "ا", "إ": "ا", "آ": "ا", "ٱ": "ا", "ى": "ي", "ة": "ه", "ؤ": "و", "ئ": "ي", "ـ": None})
_MARKS = re.compile("[ً-ٰٟ]")
_SYMBOLS = "$€£₺"
_WORD = re.compile(rf"[^\W_]+|[{_SYMBOLS}]")


def folded(value: str) -> str:
    """The comparison key with Arabic spelling variants as one."""
    return _MARKS.sub("", comparison_key(value)).translate(_ARABIC_FOLD)


def words(text: str) -> list[str]:
    """The words of a folded text; initials with full stops between them are one word."""
    text = re.sub(r"\b(?:[^\W\d_]\.){2,}(?:[^\W\d_]\b)?", lambda m: m[0].replace(".", "") + " ", text)
    return _WORD.findall(text)


def edits(a: str, b: str) -> int:
    """Edit distance with transpositions of neighbours."""
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            cost = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, last[j - 2] + 1)
            row.append(cost)
    return row[-1]


def _plainer(token: str) -> str:
    """A token with letters in place of the figures and signs that stand for them; numbers stay."""
    return token if token.isdigit() else "".join(LOOKALIKES.get(ch, ch) for ch in token)


@lru_cache(maxsize=200_000)
def token_similarity(a: str, b: str) -> float:
    """Of a token as written and one of the list: 1 if equal, less for look-alikes, abbreviations and misspellings, else 0."""
    if a == b:
        return 1.0
    if _same_looks(a, b):
        return 0.97
    if SHORT_WORDS.get(a) == b:
        return 0.95
    if len(a) >= 3 and len(b) > len(a) and b.startswith(a):
        return 0.9
    if len(a) >= 2 and len(b) >= 4 and a[0] == b[0] and len(b) > len(a) and _skeleton(a, b):
        return 0.74
    if min(len(a), len(b)) < 3:
        return 0.0
    sim = 1 - edits(_plainer(a), b) / max(len(a), len(b))
    return sim if sim >= TOKEN_SIM else 0.0


def _same_looks(a: str, b: str) -> bool:
    if len(a) != len(b) or a.isdigit():
        return False
    return all(x == y or LOOKALIKES.get(x) == y or x == "1" and y == "l" for x, y in zip(a, b))


def _skeleton(a: str, b: str) -> bool:
    """Whether a is b shortened to some of its letters: natl, islm, hsg. With vowels it must keep half of them."""
    it = iter(b)
    return len(a) <= 5 and all(ch in it for ch in a) and (not set(a) & set("aeiouاوي") or a[-1] == b[-1] and 2 * len(a) >= len(b))


class Grams:
    """Strings found by the padded bigrams that they share with another."""

    def __init__(self, strings: list[str]):
        self.strings = strings
        of: dict[str, list[int]] = {}
        for k, s in enumerate(strings):
            for g in self.grams(s):
                of.setdefault(g, []).append(k)
        self.of = {g: np.array(v) for g, v in of.items()}
        self.lengths = np.array([len(s) for s in strings])
        letters = sorted({ch for s in strings for ch in s})
        self.letters = {ch: k for k, ch in enumerate(letters)}
        self.counts = np.zeros((len(letters), len(strings)), dtype=np.int32)
        for k, s in enumerate(strings):
            for ch in s:
                self.counts[self.letters[ch], k] += 1

    @staticmethod
    def grams(s: str) -> set[str]:
        p = f"^{s}$"
        return {p[k : k + 2] for k in range(len(p) - 1)}

    def near(self, text: str, share: float) -> list[str]:
        """The strings of which at most a share of the longer one's letters is to be edited to get the text, and perhaps others.

        An edit changes two bigrams, an exchange of neighbours three, and each at most one letter for another.
        """
        own = self.grams(text)
        lists = [self.of[g] for g in own if g in self.of]
        if not lists:
            return []
        shared = np.bincount(np.concatenate(lists), minlength=len(self.strings))
        most = np.floor(share * np.maximum(self.lengths, len(text)))
        hit = (shared >= np.maximum(1, len(own) - 3 * most)) & (np.abs(self.lengths - len(text)) <= most)
        at = np.flatnonzero(hit)
        own_letters = Counter(text)
        same = np.zeros(len(at), dtype=np.int64)
        for ch, n in own_letters.items():
            if ch in self.letters:
                same += np.minimum(self.counts[self.letters[ch], at], n)
        at = at[np.maximum(self.lengths[at], len(text)) - same <= most[at]]
        return [self.strings[k] for k in at]


class Matcher:
    """Matches values of one field to its entries: rows (canon_id, canonical, name_en, name_ar, short_form).

    generic: words that tell no entry by themselves. aliases: canonical -> further names.
    """

    def __init__(self, entries: list[tuple], generic: set[str] = frozenset(), aliases: dict[str, list[str]] | None = None):
        aliases = aliases or {}
        names: dict[int, list[str]] = {}
        self.patterns: dict[str, int] = {}
        shared: Counter = Counter()
        self.shorts: dict[str, int] = {}
        for cid, *forms_ in entries:
            own = [folded(n) for n in forms_[:3] if n and n.strip()]
            short = forms_[3] if len(forms_) > 3 and forms_[3] else None
            extra = [folded(n) for n in aliases.get(forms_[0] or "", [])]
            names[cid] = list(dict.fromkeys(own))
            if short:
                own.append(folded(short))
                self.shorts[folded(short)] = cid
            for n in dict.fromkeys([*own, *extra]):
                for p in {" ".join(words(n)), n}:
                    if p:
                        shared[p] += p not in self.patterns or self.patterns[p] != cid
                        self.patterns[p] = cid
        self.patterns = {p: c for p, c in self.patterns.items() if shared[p] == 1}
        # lists of codes: three letters, of which two may be exchanged
        self.codes = {n: c for c, own in names.items() for n in own if len(n) == 3 and n.isascii() and aliases}
        self.squashed = {p.replace(" ", ""): c for p, c in self.patterns.items() if len(p) >= 6}
        self.whole = Grams(list(self.squashed))
        # tokens of each name of each entry, and how telling each token is
        self.names = [(cid, tuple(dict.fromkeys(words(n)))) for cid, own in names.items() for n in own]
        holders: dict[str, set[int]] = {}
        for cid, toks in self.names:
            for t in toks:
                holders.setdefault(t, set()).add(cid)
        count = len(entries)
        self.weight = {t: math.log(1 + count / len(h)) * (GENERIC_WEIGHT if t in generic else 1.0) for t, h in holders.items()}
        self.telling = {t: next(iter(h)) for t, h in holders.items() if len(h) == 1 and t not in generic and len(t) >= 3}
        # a name is found by those of its heaviest tokens without which it cannot be covered, and by its telling ones
        self.by_token: dict[str, list[int]] = {}
        for k, (_, toks) in enumerate(self.names):
            missed, allowed = 0.0, (1 - COVER) * sum(self.weight[t] for t in toks)
            for t in sorted(toks, key=lambda t: -self.weight[t]):
                if missed <= allowed or t in self.telling:
                    self.by_token.setdefault(t, []).append(k)
                missed += self.weight[t]
        self.tokens = Grams(list(holders))
        self.by_start: dict[str, list[str]] = {}
        for t in holders:
            self.by_start.setdefault(t[:1], []).append(t)
            if len(t) > 3:
                self.by_start.setdefault(t[:3], []).append(t)
        self.known = {folded(s) for n in aliases.values() for x in n for s in words(x)} | set(SHORT_WORDS)
        self.noise = {folded(n) for n in NOISE}
        self.alike: dict[str, dict[str, float]] = {}
        self.automaton = ahocorasick.Automaton()
        for p, c in self.patterns.items():
            self.automaton.add_word(p, (p, c))
        if len(self.automaton):
            self.automaton.make_automaton()

    def mention(self, text: str) -> int:
        """The entry of the longest mention in whole words, left of those that overlap; 0 where none is or two tie."""
        if not len(self.automaton):
            return 0
        best, hits = 0, []
        edge = lambda k: k < 0 or k >= len(text) or not text[k].isalnum()
        for end, (p, c) in self.automaton.iter(text):
            start, n = end - len(p) + 1, len(p)
            if n >= best and (edge(start - 1) or not p[0].isalnum()) and (edge(end + 1) or not p[-1].isalnum()):
                hits, best = ([] if n > best else hits), n
                # of equally long mentions that overlap the left one counts
                if not hits or start >= hits[-1][0] + n:
                    hits.append((start, c))
        return hits[0][1] if len({c for _, c in hits}) == 1 else 0

    def alike_tokens(self, token: str) -> dict[str, float]:
        """The tokens of the list that a token may be, with their similarity."""
        if token not in self.alike:
            if len(self.alike) > 200_000:
                self.alike.clear()
            asked = self.by_start.get(token[:3], []) if len(token) > 5 else self.by_start.get(token[:1], [])
            asked = {t for t in asked if t.startswith(token) or len(token) <= 5 and len(t) > len(token)}
            asked |= {*self.tokens.near(token, 1 - TOKEN_SIM), *self.tokens.near(_plainer(token), 1 - TOKEN_SIM)}
            asked |= {t for t in (token, SHORT_WORDS.get(token)) if t in self.weight}
            sims = ((t, token_similarity(token, t)) for t in asked)
            self.alike[token] = {t: s for t, s in sims if s > 0}
        return self.alike[token]

    def strange(self, tokens: list[str]) -> tuple[list[str], bool]:
        """The list's tokens that a value has exactly, and whether it also has a word that no entry has in any spelling."""
        return [t for t in dict.fromkeys(tokens) if t in self.weight], any(len(t) >= 3 and t.isalpha() and t not in self.noise and t not in self.known and not self.alike_tokens(t) for t in tokens)

    def similar(self, tokens: list[str]) -> int:
        """The entry whose token set is most similar, if similar enough and clearly ahead of the next entry."""
        own = [t for t in dict.fromkeys(tokens) if not t.isdigit() and t not in self.noise and len(t) > 1] or list(dict.fromkeys(tokens))
        alike = {v: self.alike_tokens(v) for v in own}
        back: dict[str, list[tuple[float, str]]] = {}
        for v, found in alike.items():
            for t, s in found.items():
                back.setdefault(t, []).append((s, v))
        weights = {v: self.weight.get(v, 1.5) for v in own}
        every = sum(weights.values())
        scores: dict[int, float] = {}
        for k in {k for t in back for k in self.by_token.get(t, ())}:
            cid, toks = self.names[k]
            total = sum(self.weight[t] for t in toks)
            got, told, rest = 0.0, 0.0, every
            used: set[str] = set()
            matched_: set[str] = set()
            for sim, v, t in sorted(((s, v, t) for t in toks for s, v in back.get(t, ())), reverse=True):
                if t in matched_ or v in used:
                    continue
                matched_.add(t)
                used.add(v)
                got += sim * self.weight[t]
                rest -= weights[v]
                if t in self.telling:
                    told = max(told, sim)
            # words of the value that the entry does not have count as telling words
            cover, explain = got / total, got / (got + 0.6 * max(rest, 0.0))
            if told >= 0.75 and explain >= EXPLAIN and cover < COVER:
                cover = max(cover, COVER * told if told < 1 and len(own) > 1 else COVER)
            if cover >= COVER and explain >= EXPLAIN:
                scores[cid] = max(scores.get(cid, 0.0), cover * explain)
        if not scores:
            return 0
        top = sorted(scores.items(), key=lambda x: (-x[1], x[0]))
        return top[0][0] if len(top) == 1 or top[0][1] > top[1][1] + 0.02 else 0

    def match(self, value: str) -> int:
        """canon_id of the entry meant by a value, 0 if none."""
        text = folded(value)
        tokens = words(text)
        if not tokens:
            return 0
        found = self.mention(text) or self.mention(" ".join(tokens))
        if found:
            return found
        joined = "".join(tokens)
        if joined in self.squashed:
            return self.squashed[joined]
        if joined in self.codes:
            return self.codes[joined]
        if self.codes:
            # a code with two neighbouring letters exchanged
            for t in dict.fromkeys([joined, *tokens]):
                near = {c for code, c in self.codes.items() if len(t) == 3 and sorted(t) == sorted(code) and edits(t, code) == 1}
                if len(near) == 1:
                    return near.pop()
        if joined in self.shorts:
            return self.shorts[joined]
        tokens = words(" ".join(_plainer(t) if any(ch.isalpha() for ch in t) else t for t in re.split(r"[\s/_,()*:-]+", text)))
        found = self.mention(" ".join(tokens)) or self.similar(tokens)
        if found or len(joined) < 6:
            return found
        shown = _plainer(joined)
        near = sorted((edits(shown, s) / max(len(s), len(joined)), self.squashed[s]) for s in self.whole.near(shown, 0.2) if abs(len(s) - len(joined)) <= 3)
        best = {c for d, c in near if d <= 0.2 and d == near[0][0]}
        return best.pop() if len(best) == 1 else 0


def matched(values: DataFrame, entries: DataFrame, aliases: dict[str, dict[str, list[str]]] = ALIASES) -> DataFrame:
    """values (…, field, value) with canon_id of the entry meant, 0 if none. Null and blank values give 0.

    entries: canon_id, field, canonical, name_en, name_ar, short_form; names may be null. An empty list matches nothing.
    aliases: field -> canonical -> further names.
    """
    rows = only(entries, "field", "canon_id", "canonical", "name_en", "name_ar", "short_form").where("field is not null and canon_id is not null").limit(MAX_ENTRIES + 1).collect()
    if len(rows) > MAX_ENTRIES:
        raise ValueError(f"more than {MAX_ENTRIES} canonical entries")
    by_field: dict[str, list[tuple]] = {}
    for r in sorted(rows, key=lambda r: r["canon_id"]):
        by_field.setdefault(r["field"], []).append(tuple(r)[1:])

    def beside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matchers = {f: Matcher(e, aliases=aliases.get(f)) for f, e in by_field.items()}
        for b in batches:
            out = []
            for f, v in zip(b["field"], b["value"]):
                if f in matchers:
                    told, strange = matchers[f].strange(words(folded(v)))
                    out += [(f, t, int(strange)) for t in told]
            yield pd.DataFrame(out, columns=["field", "token", "strange"])

    # the tokens of the list alone: as many as it has
    distinct = values.where(F.col("value").rlike(r"(?U)[^\s\p{Z}]")).select("field", "value").distinct()
    seen = distinct.mapInPandas(beside, "field string, token string, strange int").groupBy("field", "token").agg(F.avg("strange").alias("strange")).where(F.col("strange") >= STRANGE)
    generic: dict[str, set[str]] = {}
    for r in seen.collect():
        generic.setdefault(r["field"], set()).add(r["token"])

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        matchers = {f: Matcher(e, generic.get(f, set()), aliases.get(f)) for f, e in by_field.items()}
        known: dict[tuple, int] = {}
        for fields, texts in batches:
            out = []
            for key in zip(fields, texts):
                if key not in known:
                    if len(known) > 500_000:
                        known.clear()
                    m = matchers.get(key[0])
                    known[key] = m.match(key[1]) if m and key[1] else 0
                out.append(known[key])
            yield pd.Series(out, dtype="int32")

    match = F.pandas_udf(run, "int")
    return values.withColumn("canon_id", match(F.col("field"), F.col("value")))


def entered_values(parties: DataFrame, receipts: DataFrame, entries: DataFrame) -> DataFrame:
    """receipt_id, side, field, value: the free-entered values that are neither null, blank nor exactly canonical."""
    parties, receipts = only(parties, "receipt_id", "side", "bank"), only(receipts, "receipt_id", "currency", "provider")
    entries = only(entries, "field", "canonical")
    bank = parties.select("receipt_id", "side", F.lit("bank").alias("field"), F.col("bank").alias("value"))
    rest = receipts.select("receipt_id", F.explode(F.array(*[F.struct(F.lit("-").alias("side"), F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("currency", "provider")])).alias("v")).select("receipt_id", "v.*")
    exact = entries.select("field", F.col("canonical").alias("value")).distinct()
    return bank.unionByName(rest).where(F.col("value").rlike(r"(?U)[^\s\p{Z}]")).join(exact, ["field", "value"], "left_anti")
