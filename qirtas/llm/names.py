"""Variant spellings of names typed by people: the rows that mean one person or organisation, linked.

1. Words. Rows that have two names say which spellings, nicknames, abbreviations and scripts stand for the same given name or
   trade: the words beside the family name are aligned and counted. Legal forms tell organisations; the words that stand with
   many different words in their names are trades. Misspelt words go to a known one by shared deletions. All of it is joined
   as tables: no word list is held by the driver or broadcast.
2. Readings. Every name is read as family name, given name (or trades) and further given names, in any order and script.
   Family names become phonetic keys that both scripts share. A reading is a vector of weighted fields: the character n-grams of its family
   key by rarity, the tokens of its given name (in full, and as an initial), those of its further names (in full, as
   initials, and one for a missing name).
3. Sparse cosine join. The vector of a reading is the tensor product of its fields' vectors, so the cosine of two readings is
   the product of those of their fields, and a pair must share a feature of each: the join runs over the n-grams of the family
   keys first (prefix-filtered on both sides, exact at or above KEY_COSINE, for keys of any frequency), then over the tokens
   of the other fields. Readings that contradict each other in a given or further name share no feature and are never compared.
4. Average linkage of the readings, weighted by their rows, by rounds that merge all reciprocal nearest neighbours at once. For average
   linkage this gives the groups that one merge after the other would give, and no group of readings is ever one task.
   Readings with an initial for the given name then join the one person that they fit.

Nothing is decided by an absolute number of rows: a table whose rows are all repeated gives the same links.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from qirtas.llm.forms import plain
from qirtas.runtime import only, written

# --- Fixed values -----------------------------------------------------------------------------------------------------
TITLES = set("mr mrs ms miss dr eng prof hagg hagga hajj haj hag ustaz ustaza capt captain sheikh السيد السيدة السيده سيد الحاج الحاجة الحاجه أستاذ استاذ الأستاذ مهندس دكتور دكتورة كابتن".split())
#: Words of legal forms, and words that join names.
LEGAL = "co company corp corporation inc llc ltd limited plc gmbh group sons s.a.e sae bros brothers and & the شركة شركه مجموعة مجموعه وأولاده واولاده وشركاه ذ.م.م".split()
ARABIC_SOUNDS = {
    "ا": "a", "أ": "a", "إ": "a", "آ": "a", "ٱ": "a", "ب": "b", "ت": "t", "ث": "th", "ج": "g", "ح": "h", "خ": "K", "د": "d", "ذ": "z", "ر": "r",
    "ز": "z", "س": "s", "ش": "S", "ص": "s", "ض": "d", "ط": "t", "ظ": "z", "ع": "", "غ": "G", "ف": "f", "ق": "k", "ك": "k", "ل": "l", "م": "m",
    "ن": "n", "ه": "h", "و": "u", "ؤ": "u", "ي": "i", "ى": "i", "ئ": "i", "ء": "", "ة": "a",
}
LATIN_SOUNDS = [("kh", "K"), ("sh", "S"), ("gh", "G"), ("ph", "f"), ("ou", "u"), ("oo", "u"), ("ee", "i"), ("ei", "i"), ("ie", "i"), ("q", "k"), ("j", "g"), ("y", "i"), ("w", "u"), ("o", "u"), ("e", "i"), ("c", "k"), ("x", "ks"), ("v", "f")]
#: Latin letters by which the same name may begin.
SAME_INITIAL = {"o": "ou", "u": "ou", "e": "eia", "i": "ie", "a": "ae", "g": "gj", "j": "gj", "k": "kq", "q": "kq"}
#: How far two further names agree: equal, equal initials, an initial that fits, one name missing, one left out in the middle.
EQUAL, INITIALS, FITS, MISSING, LEFT_OUT, LONGER = 1.0, 0.85, 0.75, 0.7, 0.65, 0.9
# ----------------------------------------------------------------------------------------------------------------------

#: Least cosine of the n-gram vectors of two family keys, and most edits between them (the check that follows the join).
KEY_COSINE, KEY_EDITS = 0.35, 2
#: Weight of the family field: the exponent of its cosine.
FAMILY_WEIGHT = 0.3
#: A misspelt family key is at least so many times rarer than the right one; twice as many where it takes two edits. Two edits
#: count only between readings whose further names agree too: the given name or trade alone is shared by too many.
RARER = 4
#: Average similarity at which groups of readings are joined.
LINK = 0.35
#: Of the persons that an initial fits, the one meant has at least this share of the rows.
CLEAR = 0.6
#: Least share of a trade word's names that have a legal form.
TRADE_SHARE = 0.08
#: Letters from which on a word is looked up by its thirds.
LONG_WORD = 32
#: Rows of an entity that are paired in one task.
PAIR_BLOCK = 2000

_ARABIC = re.compile("[ء-ي]")
_SPLIT = re.compile(r"[\s,،\-_/]+")
_MARKS = re.compile("[ً-ٰٟ]")
_FOLD = str.maketrans({"أ": "ا", "إ": "ا", "آ": "ا", "ٱ": "ا", "ى": "ي", "ة": "ه", "ؤ": "و", "ئ": "ي", "ـ": None})
_LEGAL = {w.translate(_FOLD) for w in LEGAL}


def sounds(word: str) -> str:
    """A phonetic key that a word has in Latin and in Arabic script alike, where all its vowels are written."""
    if _ARABIC.search(word):
        key = "".join(ARABIC_SOUNDS.get(ch, "") for ch in word)
    else:
        key = word
        for a, b in LATIN_SOUNDS:
            key = key.replace(a, b)
        key = re.sub("[^a-zKSG]", "", key)
    return re.sub(r"(.)\1+", r"\1", key)


def words(name: str) -> list[str]:
    """The words of a name without titles; the article and the servant-of compounds as one word with what follows."""
    text = (name if name.isascii() else _MARKS.sub("", plain(name))).lower().replace("ـ", "")
    out: list[str] = []
    for w in _SPLIT.split(text):
        w = w.strip(".'`’\"()")
        if not w or w in TITLES or (len(w) == 1 and _ARABIC.match(w)):
            continue
        if _ARABIC.search(w):
            w = w.translate(_FOLD)
        if out and out[-1] in ("abd", "abdel", "abdul", "عبد"):
            out[-1] = "عبد" + re.sub("^ال", "", w) if out[-1] == "عبد" else "abd" + w if w not in ("el", "al", "ul") else "abd"
        elif out and out[-1] == "abdel":
            out[-1] = "abd" + w
        else:
            out.append(w)
    return [_servant(w) for w in out if w not in ("el", "al", "ال")]


def _servant(word: str) -> str:
    if word.startswith("عبد") and len(word) > 5:
        return "عبد" + re.sub("^ال", "", word[3:])
    if m := re.match(r"abd(?:el|al|ul)?(?=[a-z]{4,})", word):
        return "abd" + word[m.end() :]
    return word


def bare(word: str) -> str:
    """A family name without the article grown to it."""
    if word.startswith("ال") and len(word) >= 6:
        return word[2:]
    return word[2:] if re.match("[ea]l[a-z]{5,}", word) else word


def near_equal(a: str, b: str, most: int) -> bool:
    """Whether at most `most` letters are to be changed, put in or left out to make a of b."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > most:
        return False
    far = most + 1
    row = {j: j for j in range(min(most, len(b)) + 1)}
    for i, x in enumerate(a, 1):
        before, row = row, {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            best = before.get(j, far) + 1
            if j:
                best = min(best, row.get(j - 1, far) + 1, before.get(j - 1, far) + (x != b[j - 1]))
            row[j] = best
        if min(row.values()) > most:
            return False
    return row[len(b)] <= most


def aligned(own: list[str], other: list[str]) -> list[tuple[str, str]]:
    """(word, word) of the words of one party's two names beside its family name, where their number agrees: Latin and Arabic
    where the scripts differ, else those that differ, both ways."""
    a, b = own, other
    if not a or not b:
        return []
    if _ARABIC.search(a[0]) and not _ARABIC.search(b[0]):
        a, b = b, a
    # the family names sound alike as a whole; they are the longest such pair
    best = max(((len(x) + len(y), i, j) for i, x in enumerate(a) for j, y in enumerate(b) if len(x) >= 5 and near_equal(sounds(bare(x)), sounds(bare(y)), 1)), default=None)
    if not best:
        return []
    a, b = a[: best[1]] + a[best[1] + 1 :], b[: best[2]] + b[best[2] + 1 :]
    if len(a) != len(b):
        return []
    both = [(x, y) for x, y in zip(a, b) if len(x) > 1 and len(y) > 1]
    if all(bool(_ARABIC.search(x)) == bool(_ARABIC.search(y)) for x, y in both):
        return [p for x, y in both if x != y for p in ((x, y), (y, x))]
    return both


def named(column: str) -> Column:
    """Whether a name is neither null, blank nor masked."""
    c = F.col(column)
    return c.isNotNull() & c.rlike(r"(?U)[^\s\p{Z}]") & ~c.contains("*") & ~c.contains("＊")


SPLIT_SCHEMA = "name string, other string, n bigint, own array<string>, theirs array<string>, firm boolean, pairs array<struct<a:string,b:string>>"


def _split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for name, other, n in zip(b["name"], b["other"], b["n"]):
            both = [words(name), words(other) if other is not None else []]
            firm = any(w in _LEGAL for ws in both for w in ws)
            own, theirs = ([w for w in ws if w not in _LEGAL] for ws in both)
            out.append((name, other, n, own, theirs, firm, aligned(own, theirs)))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in SPLIT_SCHEMA.split(", ")])


def split_names(parties: DataFrame) -> DataFrame:
    """id and SPLIT_SCHEMA: the words of each distinct pair of name and name_alt, with the number of its rows."""
    other = F.when(named("name_alt"), F.col("name_alt")).alias("other")
    distinct = parties.where(named("name")).groupBy("name", other).agg(F.count(F.lit(1)).alias("n"))
    return written(distinct.mapInPandas(_split, SPLIT_SCHEMA).withColumn("id", F.monotonically_increasing_id()), "names")


_IS_ARABIC = "[ء-ي]"


def word_table(names: DataFrame) -> DataFrame:
    """word, canon, n: the words with the given name or trade that they spell; see step 1 of the module. n: how often it is
    so spelt, in distinct names. Words of legal forms have the canon ''."""
    script = lambda c: F.col(c).rlike(_IS_ARABIC)
    counts = written(names.select(F.explode("pairs").alias("p")).groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count(F.lit(1)).alias("n")), "aligned")
    major = lambda df, w, c: df.groupBy(F.col(w).alias("word")).agg(F.max_by(c, F.struct("n", c)).alias("canon"), F.max("n").alias("n"), F.sum("n").alias("all")).where("n >= 2 and 2 * n >= all").select("word", "canon", "n")
    across = counts.where(~script("a") & script("b"))
    first = major(across, "a", "b")
    arabic = across.groupBy(F.col("b").alias("word")).agg(F.sum("n").alias("n")).where("n >= 2").select("word", F.col("word").alias("canon"), "n")
    sure = first.unionByName(arabic)
    # spellings met only beside another spelling in the same script
    within = counts.where(script("a") == script("b"))
    beside = major(within.join(first.select(F.col("word").alias("b"), "canon"), "b").groupBy("a", "canon").agg(F.sum("n").alias("n")), "a", "canon")
    known = written(sure.unionByName(beside.join(sure, "word", "left_anti")), "spellings")
    legal = names.sparkSession.createDataFrame([(w, "", 1 << 40) for w in sorted(_LEGAL) if len(w) >= 5], "word string, canon string, n bigint")
    # misspelt by one edit: both words lose a letter and are equal, or, of long words, the first or last thirds are
    less = "transform(sequence(1, length(word)), k -> concat(left(word, k - 1), substring(word, k + 1)))"
    thirds = "flatten(transform(sequence(length(word) - 1, length(word) + 1), l -> array(concat('<', left(word, cast(l div 3 as int))), concat('>', right(word, cast(l div 3 as int))))))"
    shortened = F.explode(F.expr(f"array_distinct(concat(if(length(word) < {LONG_WORD + 2}, concat(array(word), {less}), array()), if(length(word) >= {LONG_WORD}, {thirds}, array())))")).alias("short")
    asked = names.select(F.explode(F.concat("own", "theirs")).alias("word")).distinct().where(F.length("word") >= 4).join(known, "word", "left_anti")
    target = known.unionByName(legal).where("n >= 3 and length(word) >= 3").select(F.col("word").alias("right"), "canon", "n", shortened)
    letters = lambda c: F.array_sort(F.split(F.col(c), ""))
    met = asked.select("word", shortened).join(target, "short").select("word", "right", "canon", "n").distinct()
    met = met.where((script("word") == script("right")) & ((F.levenshtein("word", "right", 1) >= 0) | (letters("word") == letters("right"))))
    by = met.groupBy("word", "canon").agg(F.sum("n").alias("n")).groupBy("word").agg(F.max_by("canon", F.struct("n", "canon")).alias("canon"), F.max("n").alias("n"), F.sum("n").alias("all"))
    return written(known.unionByName(by.where("5 * n >= 4 * all").select("word", "canon", F.lit(1).cast("bigint").alias("n"))), "words")


def trades(names: DataFrame, known: DataFrame) -> DataFrame:
    """canon of the words that name a trade: they stand beside legal forms, and in most of these names another word, the family
    name, stands with fewer different words than they do."""
    rows = names.where("firm").select("id", F.posexplode(F.array("own", "theirs")).alias("side", "w")).unionByName(names.where("not firm").select(F.lit(None).cast("bigint").alias("id"), F.posexplode(F.array("own", "theirs")).alias("side", "w")))
    flat = rows.where("size(w) > 1").select("id", "side", F.explode("w").alias("word")).join(known.select("word", "canon"), "word", "left").withColumn("canon", F.coalesce("canon", "word")).where("canon != '' and length(word) > 1")
    share = flat.groupBy("canon").agg(F.avg(F.col("id").isNotNull().cast("int")).alias("share")).where(F.col("share") >= TRADE_SHARE).select("canon")
    firms = written(flat.where("id is not null").groupBy("id", "side").agg(F.collect_set("canon").alias("w")).where("size(w) > 1"), "firms")
    one = firms.select("id", "side", "w", F.explode("w").alias("canon"))
    beside = one.select("canon", F.explode("w").alias("with")).where("with != canon").distinct().groupBy("canon").agg(F.count(F.lit(1)).alias("with"))
    of = one.drop("w").join(beside, "canon").groupBy("id", "side").agg(F.collect_list(F.struct("canon", "with")).alias("of"))
    wider = of.select(F.explode("of").alias("o"), F.array_min(F.col("of.with")).alias("least")).groupBy("o.canon").agg(F.avg((F.col("o.with") > F.col("least")).cast("int")).alias("wider")).where("wider >= 0.5").select("canon")
    return wider.join(share, "canon", "left_semi").withColumn("trade", F.lit(True))


def initials(known: DataFrame) -> DataFrame:
    """canon, ini: the letters by which a given name may begin in Latin script, from its most usual spelling."""
    usual = known.where(~F.col("word").rlike(_IS_ARABIC)).groupBy("canon").agg(F.max_by(F.left("word", F.lit(1)), F.struct("n", "word")).alias("i"))
    return usual.select("canon", _initials(F.col("i")).alias("ini"))


def _initials(letter: Column) -> Column:
    same = F.create_map(*[F.lit(x) for kv in SAME_INITIAL.items() for x in kv])
    return F.coalesce(F.try_element_at(same, letter), letter)


Word = tuple[str, "str | None", bool, "str | None"]


def read(own: list[Word], firm: bool) -> tuple[str, str, list[str], list[tuple[str, str]]] | None:
    """(kind, family key, trades, [(given or further name, its initials)]) of (word, canon, whether a trade, initials) in order;
    kind is P or O. An initial is a letter with a full stop; an unknown name is its phonetic key."""
    own = [w for w in own if w[1] != ""]
    if not own:
        return None
    if firm or any(t for _, _, t, _ in own):
        rest = [w for w, _, t, _ in own if not t]
        if not rest:
            return None
        unknown = [w for w, c, t, _ in own if not t and c is None] or rest
        family = max(unknown, key=len)
        return "O", sounds(bare(family)), sorted({c or w for w, c, t, _ in own if t}), []
    name = lambda w, c, i: (w[0] + ".", w[0]) if len(w) == 1 else (c, i or "") if c else (sounds(w), SAME_INITIAL.get(w[0], w[0]))
    unknown = [k for k, (w, c, _, _) in enumerate(own) if c is None and len(w) >= 4]
    if not unknown:
        if len(own) < 2 or len(own[-1][0]) == 1:
            return None
        at = len(own) - 1
    else:
        at = max(unknown, key=lambda k: (len(own[k][0]), k))
    return "P", sounds(bare(own[at][0])), [], [name(w, c, i) for k, (w, c, _, i) in enumerate(own) if k != at]


def _fuller(x: tuple[str, str], y: tuple[str, str]) -> tuple[str, str]:
    """Of a name in two readings the fuller one: a name for its initial, a known one for an unknown one."""
    if x[0].endswith("."):
        return y if not y[0].endswith(".") and x[0][0] in y[1] else x
    return y if not _ARABIC.search(x[0]) and _ARABIC.search(y[0]) else x


READ_SCHEMA = "id bigint, n bigint, kind string, key1 string, key2 string, trades array<string>, given array<struct<name:string,ini:string>>"


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for i, n, firm, ws in zip(b["id"], b["n"], b["firm"], b["ws"]):
            sides: list[list[Word]] = [[], []]
            for w in ws:
                sides[w["side"]].append((w["word"], w["canon"], bool(w["trade"]), w["ini"]))
            a, o = read(sides[0], firm), read(sides[1], firm)
            if a is None or not a[1]:
                continue
            kind, key, trade, given = a
            if o is None or o[0] != kind or not near_equal(key, o[1], 3):
                out.append((i, n, kind, key, key, trade, given))
            else:
                given = [_fuller(x, o[3][k]) if k < len(o[3]) else x for k, x in enumerate(given)] + o[3][len(given) :]
                out.append((i, n, kind, key, o[1], sorted({*trade, *o[2]}), given))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in READ_SCHEMA.split(", ")])


def readings(names: DataFrame, known: DataFrame, trade: DataFrame) -> DataFrame:
    """READ_SCHEMA of the names of which a family name can be read. A row's second name fills in what its first leaves out."""
    side = lambda c, k: F.transform(c, lambda w, i: F.struct(F.lit(k).alias("side"), i.alias("pos"), w.alias("word")))
    flat = names.select("id", "n", "firm", F.explode(F.concat(side("own", 0), side("theirs", 1))).alias("w")).select("id", "n", "firm", "w.*")
    about = known.join(trade, "canon", "left").join(initials(known), "canon", "left").select("word", "canon", "trade", "ini")
    # a word that no spelling explains may be a trade by itself
    about = about.unionByName(trade.select(F.col("canon").alias("word"), "canon", "trade", F.lit(None).cast("string").alias("ini")).join(known, "word", "left_anti").select("word", "canon", "trade", "ini"))
    whole = flat.join(about, "word", "left").groupBy("id", "n", "firm").agg(F.array_sort(F.collect_list(F.struct("side", "pos", "word", "canon", "trade", "ini"))).alias("ws"))
    return written(whole.mapInPandas(_read, READ_SCHEMA), "readings")


def gram_vectors(keys: DataFrame) -> DataFrame:
    """key, n, gram, df, weight: unit vectors of the padded bigrams and trigrams of each key, weighted by rarity among keys."""
    padded = F.concat(F.lit("^"), F.col("key"), F.lit("$"))
    grams = F.expr("array_distinct(concat(transform(sequence(1, length(p) - 1), k -> substring(p, k, 2)), transform(sequence(1, greatest(length(p) - 2, 1)), k -> substring(p, k, 3))))")
    flat = keys.select("key", "n", padded.alias("p")).where(F.length("p") >= 4).select("key", "n", F.explode(grams).alias("gram"))
    df = flat.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    total = keys.agg(F.count(F.lit(1)).alias("total"))
    weighted = flat.join(df, "gram").crossJoin(F.broadcast(total)).select("key", "n", "gram", "df", F.log(1 + F.col("total") / F.col("df")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("key")))
    return weighted.withColumn("weight", F.col("w") / F.greatest(norm, F.lit(1e-9)))


def cosine_pairs(keys: DataFrame) -> DataFrame:
    """a, b, cosine, edits, na, nb of all pairs of keys (a < b; key, n) at or above KEY_COSINE and within KEY_EDITS; exact, for keys of any
    frequency. Two letters exchanged are one edit.

    The rarest n-grams of a key that together hold more than 1 - KEY_COSINE² of its squared length are its prefix: of the
    n-grams that a pair shares the rarest lies in the prefixes of both, else the cosine cannot reach the threshold.
    """
    vectors = written(gram_vectors(keys), "grams")
    order = W.partitionBy("key").orderBy("df", "gram").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("weight") * F.col("weight")).over(order), F.lit(0.0))
    prefix = vectors.withColumn("before", before).where(F.col("before") <= 1 - KEY_COSINE**2).select("gram", "key")
    b = prefix.select("gram", F.col("key").alias("b"))
    near = (F.col("a") < F.col("b")) & (F.abs(F.length("a") - F.length("b")) <= KEY_EDITS)
    met = prefix.withColumnRenamed("key", "a").join(b, "gram").where(near).select("a", "b").where(F.levenshtein("a", "b", KEY_EDITS) >= 0).distinct()
    per = vectors.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("gram", "weight"))).alias("v"), F.first("n").alias("n"))
    side = lambda c: per.select(F.col("key").alias(c), F.col("v").alias(f"v{c}"), F.col("n").alias(f"n{c}"))
    both = met.join(side("a"), "a").join(side("b"), "b")
    dot = F.aggregate(F.map_entries("va"), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.try_element_at(F.col("vb"), e["key"]), F.lit(0.0)))
    letters = lambda c: F.array_sort(F.split(F.col(c), ""))
    edits = F.when(letters("a") == letters("b"), 1).otherwise(F.levenshtein("a", "b", KEY_EDITS))
    return both.select("a", "b", F.round(dot, 6).alias("cosine"), edits.alias("edits"), "na", "nb").where(F.col("cosine") >= KEY_COSINE)


def _further(a: Column, b: Column) -> Column:
    """How far the further names of two readings of one given name agree: 0 where they contradict each other."""
    short, long_ = F.when(F.size(a) <= F.size(b), a).otherwise(b), F.when(F.size(a) <= F.size(b), b).otherwise(a)
    is_initial = lambda x: x["name"].endswith(".")
    fits = lambda x, y: F.instr(y["ini"], x["ini"]) > 0

    def agree(x: Column, y: Column) -> Column:
        return (
            F.when(x["name"] == y["name"], F.when(is_initial(x), INITIALS).otherwise(EQUAL))
            .when(is_initial(x) & fits(x, y) | is_initial(y) & fits(y, x), FITS)
            .otherwise(0.0)
        )

    direct = F.array_min(F.zip_with(short, F.slice(long_, 1, F.size(short)), agree))
    in_order = F.aggregate(long_, F.lit(0), lambda p, y: F.when((p < F.size(short)) & (F.get(short, p)["name"] == y["name"]), p + 1).otherwise(p)) == F.size(short)
    same = F.size(a) == F.size(b)
    return F.when(F.size(short) == 0, F.when(same, EQUAL).otherwise(MISSING)).when(direct > 0, direct * F.when(same, 1.0).otherwise(LONGER)).when(in_order, LEFT_OUT).otherwise(0.0)


def _reading_keys(rows: DataFrame) -> DataFrame:
    """id and the distinct readings: r, kind, family, given, ini, further, trades, certain, rows."""
    n = rows.select("n", F.explode(F.array_distinct(F.array("key1", "key2"))).alias("key")).groupBy("key").agg(F.sum("n").alias("n"))
    a, b = n.select(F.col("key").alias("key1"), F.col("n").alias("a")), n.select(F.col("key").alias("key2"), F.col("n").alias("b"))
    # of the keys of a row's two names the more frequent one counts
    placed = rows.join(a, "key1").join(b, "key2").withColumn("family", F.when(F.col("b") > F.col("a"), F.col("key2")).otherwise(F.col("key1")))
    first = F.get("given", 0)
    placed = placed.select("id", "n", "kind", "family", F.coalesce(first["name"], F.lit("")).alias("given"), F.coalesce(first["ini"], F.lit("")).alias("ini"), F.slice("given", 2, 1000).alias("further"), "trades")
    return written(placed, "placed")


def similar_readings(r: DataFrame, near: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of similar readings (a, b, s) where both say whom they mean, and (a, b, s) where a has an initial, an unknown
    given name or no trade and b is one that it may mean."""
    firm = F.col("kind") == "O"
    plain_names = F.filter("further", lambda x: ~x["name"].endswith("."))
    full = r.where("certain")
    eq = lambda c: F.concat(F.lit("="), c)
    # what a reading is found by: its given name or trades, or an initial; any of its further names, or none
    given = F.when(firm, F.concat(F.transform("trades", eq), F.array(F.lit("?")))).otherwise(F.concat(F.array(eq(F.col("given"))), F.transform(F.filter(F.split("ini", ""), lambda x: x != ""), lambda x: F.concat(F.lit("?"), x))))
    further = F.when(firm, F.array(F.lit("*"))).otherwise(F.concat(F.array(F.lit("*")), F.array_distinct(F.transform(plain_names, lambda x: eq(x["name"])))))
    found_by = full.select(F.col("r").alias("b"), "kind", "family", F.col("further").alias("b_further"), F.explode(given).alias("g"), further.alias("h")).withColumn("h", F.explode("h"))
    father = F.get("further", 0)["name"]
    asks_h = F.when(~firm & father.isNotNull() & ~father.endswith("."), eq(father)).otherwise(F.lit("*"))
    asks_g = F.when(firm, F.transform("trades", eq)).otherwise(F.array(eq(F.col("given"))))
    short_g = F.when(firm, F.array(F.lit("?"))).otherwise(F.transform(F.filter(F.split("ini", ""), lambda x: x != ""), lambda x: F.concat(F.lit("?"), x)))
    near = near.unionByName(r.select("family").distinct().select("family", F.col("family").alias("target"), F.lit(1.0).alias("cosine"), F.lit(0).alias("edits")))

    def joined(asking: DataFrame, g: Column, h: Column) -> DataFrame:
        own = asking.select(F.col("r").alias("a"), "kind", "family", "given", "further", F.explode(g).alias("g"), h.alias("h"))
        pairs = own.join(near, "family").withColumnRenamed("family", "own").withColumnRenamed("target", "family").join(found_by, ["kind", "family", "g", "h"])
        return pairs.where("a != b and (edits < 2 or size(further) > 0 and size(b_further) > 0)").withColumn("f", _further(F.col("further"), F.col("b_further"))).where("f > 0")

    weight = F.pow("cosine", F.lit(FAMILY_WEIGHT))
    both = joined(full, asks_g, asks_h).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (weight * F.col("f")).alias("s"))
    both = both.groupBy("a", "b").agg(F.round(F.max("s"), 6).alias("s"))
    # a given name that no spelling explains needs an equal further name, a family that is only similar one that fits
    short = joined(r.where("not certain and (kind = 'O' or ini != '')"), short_g, F.lit("*"))
    short = short.where((firm | F.col("given").endswith(".") | (F.col("f") >= LONGER)) & ((F.col("cosine") == 1) | ~firm & (F.size("further") > 0) & (F.size("b_further") > 0)))
    short = short.groupBy("a", "b").agg(F.round(F.max(weight * F.col("f")), 6).alias("s"))
    return both, short


def average_linkage(items: DataFrame, pairs: DataFrame, least: float = LINK) -> DataFrame:
    """item, cluster of average-linkage clustering. items: item bigint, rows (its weight). pairs: a < b, s > 0; other pairs have 0.

    Each round merges every two clusters that are each other's nearest; ties fall by a hash of the pair, so that there is
    always such a pair, until no pair reaches `least`. The mean of similarities never exceeds the greater one, so what two
    clusters are to each other changes by no merge of others: the order of merges does not matter.
    """
    size = items.select(F.col("item").alias("c"), "rows")
    a, b = size.select(F.col("c").alias("a"), F.col("rows").alias("ra")), size.select(F.col("c").alias("b"), F.col("rows").alias("rb"))
    edges = written(pairs.join(a, "a").join(b, "b").select("a", "b", "ra", "rb", (F.col("s") * F.col("ra") * F.col("rb")).alias("w")), "edges")
    sim = F.round(F.col("w") / (F.col("ra") * F.col("rb")), 9)
    place = edges.select(F.explode(F.array("a", "b")).alias("item")).distinct().withColumn("cluster", F.col("item"))
    while True:
        strong = edges.where(sim >= least).withColumn("o", F.struct(sim, F.xxhash64("a", "b"), "a", "b"))
        best = strong.select(F.explode(F.array("a", "b")).alias("c"), "o", "a", "b", "ra", "rb").groupBy("c").agg(F.max_by(F.struct("a", "b", "ra", "rb"), "o").alias("n"))
        # a pair that is the best of both of its clusters
        merged = written(best.groupBy("n").count().where("count = 2").select(F.col("n.b").alias("old"), F.col("n.a").alias("new"), (F.col("n.ra") + F.col("n.rb")).alias("rows")), "merged")
        if merged.isEmpty():
            return place
        into = merged.select(F.explode(F.array(F.struct(F.col("old").alias("c"), "new", "rows"), F.struct(F.col("new").alias("c"), "new", "rows"))).alias("m")).select("m.*")
        for x in ("a", "b"):
            side = into.select(F.col("c").alias(x), F.col("new").alias(f"n{x}"), F.col("rows").alias(f"m{x}"))
            edges = edges.join(side, x, "left").withColumn(x, F.coalesce(f"n{x}", x)).withColumn(f"r{x}", F.coalesce(f"m{x}", f"r{x}")).drop(f"n{x}", f"m{x}")
        lo, hi = F.when(F.col("a") < F.col("b"), F.struct("a", F.col("ra").alias("r"))).otherwise(F.struct(F.col("b").alias("a"), F.col("rb").alias("r"))), F.when(F.col("a") < F.col("b"), F.struct(F.col("b").alias("a"), F.col("rb").alias("r"))).otherwise(F.struct("a", F.col("ra").alias("r")))
        edges = edges.where("a != b").select(lo.alias("l"), hi.alias("h"), "w").select(F.col("l.a").alias("a"), F.col("h.a").alias("b"), F.col("l.r").alias("ra"), F.col("h.r").alias("rb"), "w")
        edges = written(edges.groupBy("a", "b", "ra", "rb").agg(F.sum("w").alias("w")), "edges")
        place = written(place.join(merged.select(F.col("old").alias("cluster"), "new"), "cluster", "left").select("item", F.coalesce("new", "cluster").alias("cluster")), "clusters")


def linked(parties: DataFrame, cosine: bool = True) -> DataFrame:
    """party_id, name, entity: rows of one entity mean the same person or organisation.

    Rows whose party_id is null or whose name is null, blank or masked are not in the result, nor are names of which no family
    name can be read: they mean nobody in particular. Names may be of any length. cosine=False leaves the cosine join of
    family keys out, to measure what it finds.
    """
    parties = only(parties, "party_id", "name", "name_alt").where("party_id is not null")
    names = split_names(parties)
    known = word_table(names)
    rows = _reading_keys(readings(names, known, trades(names, known)))
    what = ["kind", "family", "given", "ini", "further", "trades"]
    certain = F.when(F.col("kind") == "O", F.size("trades") > 0).otherwise(F.col("given").rlike(_IS_ARABIC))
    # a reading's number comes from what it says, so that ties fall the same way in every run
    r = written(rows.groupBy(*what).agg(F.sum("n").alias("rows")).withColumn("certain", certain).withColumn("r", F.xxhash64(*what)), "distinct-readings")
    families = written(r.groupBy(F.col("family").alias("key")).agg(F.sum("rows").alias("n")), "families")
    if cosine:
        pairs_ = cosine_pairs(families).where(F.greatest("na", "nb") >= RARER * F.greatest("edits", F.lit(1)) * F.least("na", "nb"))
        both = F.explode(F.array(F.struct(F.col("a").alias("family"), F.col("b").alias("target")), F.struct(F.col("b").alias("family"), F.col("a").alias("target"))))
        near = written(pairs_.select(both.alias("p"), "cosine", "edits").select("p.*", "cosine", "edits"), "near")
    else:
        near = r.sparkSession.createDataFrame([], "family string, target string, cosine double, edits int")
    sure, short = similar_readings(r, near)
    place = average_linkage(r.select(F.col("r").alias("item"), "rows"), sure)
    placed = written(r.join(place, r["r"] == place["item"], "left").select(*r.columns, F.coalesce("cluster", "r").alias("cluster")), "persons")
    weight = placed.where("certain").groupBy("cluster").agg(F.sum("rows").alias("weight"))
    fit = short.join(placed.select(F.col("r").alias("b"), "cluster", "kind"), "b").groupBy("a", "cluster", "kind").agg(F.max("s").alias("s")).join(weight, "cluster")
    top = fit.groupBy("a", "kind", "s").agg(F.max_by("cluster", F.struct("weight", "cluster")).alias("entity"), F.max("weight").alias("most"), F.sum("weight").alias("all"))
    top = top.groupBy("a", "kind").agg(F.max_by(F.struct("entity", "most", "all"), "s").alias("t")).where(F.col("t.most") >= F.when(F.col("kind") == "O", 1.0).otherwise(CLEAR) * F.col("t.all"))
    entity = placed.join(top.select(F.col("a").alias("r"), "t.entity"), "r", "left").select(*what, F.coalesce("entity", "cluster").alias("entity"))
    by_name = rows.join(entity, what).select("id", "entity").join(names.select("id", "name", F.col("other").alias("_other")), "id").drop("id")
    own = parties.where(named("name")).withColumn("_o", F.when(named("name_alt"), F.col("name_alt")))
    return own.join(by_name.withColumnRenamed("name", "_name"), (F.col("name") == F.col("_name")) & F.col("_o").eqNullSafe(F.col("_other"))).select("party_id", "name", "entity")


def pairs(links: DataFrame) -> DataFrame:
    """party_id_a < party_id_b of every pair of rows of one entity whose name strings differ. `linked` is the form to use
    where entities may be large: pairs grow with the square. A large entity's rows are paired in blocks of PAIR_BLOCK."""
    blocks = links.groupBy("entity").agg(F.ceil(F.count(F.lit(1)) / PAIR_BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    salted = links.join(blocks, "entity", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    a = salted.select("entity", F.col("party_id").alias("party_id_a"), F.col("name").alias("name_a"), F.pmod(F.xxhash64("party_id"), "blocks").cast("int").alias("block"))
    b = salted.select("entity", F.col("party_id").alias("party_id_b"), F.col("name").alias("name_b"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    return a.join(b, ["entity", "block"]).where((F.col("party_id_a") < F.col("party_id_b")) & (F.col("name_a") != F.col("name_b"))).select("party_id_a", "party_id_b")
