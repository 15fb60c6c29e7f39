"""Words matched to the closest of a fixed list, labels scored by how they occur in alternative readings."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qirtas.functions import text as T
from qirtas.functions.vocabulary import FIELD_LABELS, norm

# --- Fixed values -----------------------------------------------------------------------------------------------------
SCORES = {"exact": 100.0, "prefix": 96.0, "suffix": 95.0}
SCORED_FUZZY, SCORED_LENGTH = 82.0, 5
# ----------------------------------------------------------------------------------------------------------------------


def closest(words: list[str], cutoff: float, clear: bool = False, first_letter: bool = False):
    """A column function: the word of the list most similar to a text, if its difflib ratio reaches the cutoff.

    Ties go to the earlier word; with clear, a tie gives null. first_letter: the first letters must agree. Null and empty
    texts give null; so do those that are too long to reach the cutoff with any word.
    """
    longest = max(map(len, words), default=0) * (2 / cutoff - 1) + 1

    def one(text: str) -> str | None:
        if not text or len(text) > longest:
            return None
        best, at, tied = cutoff, None, False
        matcher = difflib.SequenceMatcher(None, "", text)
        for w in words:
            # 2 x the shorter length / both lengths bounds the ratio
            if first_letter and w[:1] != text[:1] or 2 * min(len(w), len(text)) < best * (len(w) + len(text)):
                continue
            matcher.set_seq1(w)
            if matcher.quick_ratio() < best:
                continue
            ratio = difflib.SequenceMatcher(None, text, w).ratio()
            if ratio > best or at is None and ratio >= best:
                best, at, tied = ratio, w, False
            elif ratio == best:
                tied = True
        return None if clear and tied else at

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str | None, str | None] = {None: None}
        for b in batches:
            for v in b.unique():
                if v not in known:
                    known[v] = one(v)
            yield b.map(known).astype(object)

    return F.pandas_udf(run, "string")


def scored_labels(lines: DataFrame, key: list[str], readings: Column, fields: dict[str, list[str]] = FIELD_LABELS, least: float = SCORED_FUZZY) -> DataFrame:
    """key, target, score of the label that any reading of a line has best: equal, in front, at the end, or misspelt.

    Of equal scores the longer label, then the earlier. Lines without a label have no row.
    """
    table: dict[str, tuple[str, int]] = {}
    for target, words in fields.items():
        for w in words:
            table.setdefault(norm(w), (target, len(table)))
    spark = lines.sparkSession
    known = F.broadcast(spark.createDataFrame([(n, t, k) for n, (t, k) in table.items()], "label string, target string, ord int"))
    texts = lines.select(*key, F.explode(F.array_distinct(F.transform(readings, T.norm))).alias("n")).where(F.length("n") >= 1)
    score = F.when(F.col("n") == F.col("label"), SCORES["exact"]).when(F.col("n").startswith(F.concat("label", F.lit(" "))), SCORES["prefix"]).when(F.col("n").endswith(F.concat(F.lit(" "), F.col("label"))), SCORES["suffix"])
    # whole words first: an equality on the text, its beginnings and its ends
    w = F.split("n", " ")
    # of a text of any length only as many words as the longest label has
    most = max((len(n.split(" ")) for n in table), default=1)
    pieces = F.array_distinct(F.expr(f"concat(transform(sequence(1, least({most}, size(w))), k -> array_join(slice(w, 1, k), ' ')), transform(sequence(1, least({most}, size(w))), k -> array_join(slice(w, size(w) - k + 1, k), ' ')))"))
    whole = texts.withColumn("w", w).select(*key, "n", F.explode(pieces).alias("label")).join(known, "label").select(*key, "n", "target", score.alias("score"), F.length("label").alias("size"), "ord")
    long = [n for n in table if len(n) >= SCORED_LENGTH]
    # texts that no label meets in whole words may misspell one
    rest = texts.join(whole.select(*key, "n").distinct(), [*key, "n"], "left_anti")
    near = rest.withColumn("label", closest(long, least / 100)(F.col("n"))).where("label is not null").join(known, "label")
    ratio = _ratio()
    fuzzy = near.select(*key, "n", "target", ratio(F.col("n"), F.col("label")).alias("score"), F.length("label").alias("size"), "ord")
    every = whole.unionByName(fuzzy)
    return every.groupBy(*key).agg(F.max_by(F.struct("target", "score"), F.struct("score", "size", -F.col("ord"))).alias("b")).select(*key, "b.target", F.round("b.score", 6).alias("score"))


def _ratio():
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() * 100 for x, y in zip(a, b)], dtype="float64")

    return F.pandas_udf(run, "double")
