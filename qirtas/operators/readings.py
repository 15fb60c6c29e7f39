"""Votes and confidences over alternative readings."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from qirtas.functions import text as T

# --- Fixed values -----------------------------------------------------------------------------------------------------
VOTE_BONUS, QUORUM = 10.0, 2
#: Characters that are noise at the ends of a line: edges of icons, rules of tables.
EDGE_NOISE = "-_.,:;'\"`|!()[]{}~ـ،؛ "
#: How much less confident the Latin reading of a Latin line may be, and how similar to what the other reading has in its place.
LATIN_MARGIN, MIXED_SIMILARITY = 0.05, 0.6
# ----------------------------------------------------------------------------------------------------------------------


def until_quorum(votes: DataFrame, group: list[str], order: str, reading: str, quorum: int = QUORUM) -> DataFrame:
    """Votes up to and with the one at which a reading first has `quorum` votes; all of them where none gets there.

    Null readings are attempts without a vote.
    """
    so_far = F.count(reading).over(W.partitionBy(*group, reading).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    reached = F.min(F.when(F.col(reading).isNotNull() & (F.col("_n") >= quorum), F.col(order))).over(W.partitionBy(*group))
    return votes.withColumn("_n", so_far).withColumn("_at", reached).where(F.col("_at").isNull() | (F.col(order) <= F.col("_at"))).drop("_n", "_at")


def voted(votes: DataFrame, group: list[str], reading: str, conf: str, order: str, quorum: int = QUORUM, bonus: float = VOTE_BONUS) -> DataFrame:
    """group, reading, votes, confidence: the reading of the highest sum of confidence + bonus, ties to the one met first.

    confidence: its highest confidence x votes / max(all votes, quorum). Two levels of aggregation, the first with map-side
    combine, so a group of any size is no task of its own.
    """
    by = votes.where(F.col(reading).isNotNull()).groupBy(*group, reading).agg(F.sum(F.col(conf) + F.lit(bonus)).alias("weight"), F.count(F.lit(1)).alias("votes"), F.max(conf).alias("most"), F.min(order).alias("met"))
    best = F.max_by(F.struct(F.col(reading).alias("reading"), "votes", "most"), F.struct("weight", -F.col("met")))
    won = by.groupBy(*group).agg(best.alias("b"), F.sum("votes").alias("cast"))
    return won.select(*group, F.col("b.reading").alias("reading"), F.col("b.votes").alias("votes"), (F.col("b.most") * F.col("b.votes") / F.greatest(F.col("cast"), F.lit(quorum))).alias("confidence"))


def weighted_confidence(lines: DataFrame, group: list[str], text: str, conf: str) -> DataFrame:
    """group, confidence: mean confidence weighted by length of text; null where all texts are empty."""
    n = F.length(text)
    return lines.where(F.col(text).isNotNull() & F.col(conf).isNotNull()).groupBy(*group).agg((F.sum(F.col(conf) * n) / F.nullif(F.sum(n), F.lit(0))).alias("confidence"))


def tidy(c: Column) -> Column:
    """Single spaces, and none of the noise at the ends of a line."""
    return F.trim(T.one_space(c), F.lit(EDGE_NOISE))


def mended(c: Column) -> Column:
    """An o among the digits before an @ as zero; the servant-of names as one word."""
    return F.regexp_replace(F.regexp_replace(c, r"(?<=\d)[oO](?=[\doO]*@)", "0"), r"عبد\s+ال", "عبدال")


def spliced(arabic: str, latin: str) -> str | None:
    """A line of both scripts: its Latin words, all at one end, replaced by the words of the Latin reading from that end that are
    most similar; None where the scripts alternate or nothing is similar enough."""
    own = arabic.split()
    is_arabic = [bool(re.search("[؀-ۿ]", w)) for w in own]
    count = is_arabic.count(False)
    front = is_arabic == [False] * count + [True] * (len(own) - count)
    if not front and is_arabic != [True] * (len(own) - count) + [False] * count:
        return None
    letters = lambda words: re.sub("[^a-z]", "", " ".join(words).lower())
    there = letters(own[:count] if front else own[-count:] if count else [])
    words = latin.split()
    taken = lambda k: words[:k] if front else words[len(words) - k :]
    ratio, k = max(((difflib.SequenceMatcher(None, there, letters(taken(k))).ratio(), -k) for k in range(1, len(words) + 1)), default=(0.0, 0)) if there else (0.0, 0)
    if ratio < MIXED_SIMILARITY:
        return None
    k = -k
    # marks beside the words belong to them
    while k < len(words) and not any(ch.isascii() and ch.isalnum() for ch in (words[k] if front else words[-k - 1])):
        k += 1
    rest = own[count:] if front else own[: len(own) - count]
    return " ".join([*taken(k), *rest] if front else [*rest, *taken(k)])


def chosen(ar: Column, ar_conf: Column, en: Column, en_conf: Column, margin: float = LATIN_MARGIN) -> Column:
    """struct(text, confidence) of an Arabic and a Latin recogniser's readings of one line.

    Arabic letters are only the Arabic reading's; what else the line has may come from the Latin one. A Latin line is the Latin
    reading's, if not clearly less confident; of readings with the same letters the one with more word breaks. A null or blank
    reading loses, and so does a Latin one with characters that neither script has.
    """
    a, e = tidy(F.coalesce(ar, F.lit(""))), tidy(F.coalesce(en, F.lit("")))
    junk = (e == "") | e.rlike(r"[^\x00-\x7F؀-ۿ]")
    arabic = a.rlike("[ء-يٱ-ۓ]")
    breaks = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    same = F.replace(a, F.lit(" "), F.lit("")) == F.replace(e, F.lit(" "), F.lit(""))

    def splice(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([spliced(p, q) if p and q else None for p, q in zip(x, y)], dtype=object)

    both = ~junk & arabic & a.rlike("[A-Za-z]")
    mixed = F.pandas_udf(splice, "string")(F.when(both, a), F.when(both, T.one_space(en)))
    latin_wins = F.when(same & (a != e), breaks(e) >= breaks(a)).otherwise(en_conf >= ar_conf - margin)
    ours, theirs = F.struct(a.alias("text"), ar_conf.alias("confidence")), F.struct(e.alias("text"), en_conf.alias("confidence"))
    got = F.when(junk, ours).when(a == "", theirs).when(arabic, F.struct(F.coalesce(mixed, a).alias("text"), ar_conf.alias("confidence"))).when(latin_wins, theirs).otherwise(ours)
    return F.struct(mended(got["text"]).alias("text"), got["confidence"].alias("confidence"))
