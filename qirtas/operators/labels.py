"""Lines recognised as labels: exactly, with a value in the same line, or misspelt."""

from __future__ import annotations

import difflib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qirtas.functions import text as T
from qirtas.functions import values as V
from qirtas.functions.vocabulary import FUZZY_LENGTH, FUZZY_RATIO, label_rows, labels


def similarity(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio()


def _misspelt(rows: list[tuple]):
    """norm -> index of the most similar label, -1 if none is similar enough; ties go to the earlier label.

    The letters that two texts share bound their ratio: only the labels that it can still reach are compared.
    """
    long = [(r[0], r[3]) for r in rows if len(r[0]) >= FUZZY_LENGTH]
    sizes = np.array([len(label) for label, _ in long])
    letters: dict[str, np.ndarray] = {}
    for k, (label, _) in enumerate(long):
        for ch in label:
            letters.setdefault(ch, np.zeros(len(long), dtype=np.int64))[k] += 1
    # 2 x the shorter length / both lengths bounds the ratio too
    longest = int(max((len(label) for label, _ in long), default=0) * (2 / FUZZY_RATIO - 1)) + 1

    def one(n: str) -> int:
        if not FUZZY_LENGTH <= len(n) <= longest:
            return -1
        same = np.zeros(len(long), dtype=np.int64)
        for ch, count in Counter(n).items():
            if ch in letters:
                same += np.minimum(letters[ch], count)
        best, at = FUZZY_RATIO, -1
        for k in np.flatnonzero(2 * same >= FUZZY_RATIO * (sizes + len(n)) - 1e-9):
            ratio = difflib.SequenceMatcher(None, n, long[k][0]).ratio()
            if ratio > best or (at < 0 and ratio >= best):
                best, at = ratio, long[k][1]
        return at

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, int] = {"": -1}
        for b in batches:
            if len(known) > 500_000:
                known = {"": -1}
            out = []
            for n in b:
                if n not in known:
                    known[n] = one(n)
                out.append(known[n])
            yield pd.Series(out, dtype="int32")

    return F.pandas_udf(run, "int")


def exact(lines: DataFrame) -> DataFrame:
    """lines (…, text) with label columns kind, target, ord where the whole text is a label, else null."""
    known = F.broadcast(labels(lines.sparkSession))
    return lines.join(known, T.norm(F.col("text")) == known["label"], "left").drop("label")


def labelled(lines: DataFrame, key: list[str], vocabulary: list[tuple] | None = None) -> DataFrame:
    """lines with kind (field, party), target and inline (the value in the same line, '' if none); null where no label is.

    key: columns that identify a line. Exact labels win over misspelt ones, those over labels with a value in the line; of
    these the earlier label, then the shorter one, then one in front. Null text has no label. All of it is a projection: labels
    are looked up in a map of the vocabulary, nothing is exploded, joined or shuffled.
    """
    rows = vocabulary or label_rows()
    told = lambda r: F.struct(F.lit(r[1]).alias("kind"), F.lit(r[2]).alias("target"), F.lit(r[3]).alias("ord"))
    by_norm = F.create_map(*[x for r in rows for x in (F.lit(r[0]), told(r))])
    by_ord = F.create_map(*[x for r in rows for x in (F.lit(r[3]), told(r))])
    base = lines.withColumn("_norm", T.norm(F.col("text"))).withColumn("_exact", F.try_element_at(by_norm, F.col("_norm")))
    # an empty text is compared with nothing
    base = base.withColumn("_fuzzy", _misspelt(rows)(F.coalesce(F.when(F.col("_exact").isNull(), F.col("_norm")), F.lit(""))))
    base = base.withColumn("_whole", F.coalesce("_exact", F.try_element_at(by_ord, F.col("_fuzzy"))))
    # every split of a line into a label and a value; a part of more words than any label has is none
    most = max((len(r[0].split(" ")) for r in rows), default=0)
    w, n = F.split(F.trim("text"), " "), F.col("_n")
    # the normalised form of each word: '' for a mark that stands alone, several words for words joined by marks
    base = base.withColumn("_w", F.when(F.col("_whole").isNull(), w)).withColumn("_n", F.transform("_w", T.norm))
    count = lambda c: F.transform(c, lambda x: F.when(x == "", 0).otherwise(F.size(F.split(x, " "))))
    reach = lambda c: F.aggregate(c, F.struct(F.lit(0).alias("sum"), F.lit(0).alias("k")), lambda s, x: F.struct((s["sum"] + x).alias("sum"), F.when(s["sum"] + x <= most, s["k"] + 1).otherwise(s["k"]).alias("k")), lambda s: F.least(s["k"], F.size(c) - 1))
    base = base.withColumn("_front", reach(count(n))).withColumn("_back", reach(F.reverse(count(n))))
    upto = lambda k: F.when(F.col(k) >= 1, F.sequence(F.lit(1), F.col(k))).otherwise(F.array().cast("array<int>"))
    joined = lambda c: F.array_join(F.filter(c, lambda x: x != ""), " ")
    size = F.size("_w")

    def split(k, side: int):
        part, rest = (F.slice(n, F.lit(1), k), F.slice("_w", k + 1, size - k)) if side == 0 else (F.slice(n, size - k + 1, k), F.slice("_w", F.lit(1), size - k))
        return F.struct(k.alias("k"), F.lit(side).alias("side"), F.try_element_at(by_norm, joined(part)).alias("l"), F.array_join(rest, " ").alias("rest"))

    known = lambda side, k: F.filter(F.transform(upto(k), lambda x: split(x, side)), lambda s: s["l"].isNotNull())
    base = base.withColumn("_met", F.when(F.col("_whole").isNull() & (size >= 2), F.concat(known(0, "_front"), known(1, "_back"))))
    fits = F.filter("_met", lambda s: (s["l"]["kind"] == "party") | V.valid(s["l"]["target"], s["rest"]))
    best = F.array_min(F.transform(fits, lambda s: F.struct(s["l"]["ord"].alias("ord"), s["k"].alias("k"), s["side"].alias("side"), s["l"]["kind"].alias("kind"), s["l"]["target"].alias("target"), s["rest"].alias("rest"))))
    # V.valid is costly: only where a label was met
    base = base.withColumn("_best", F.when(F.size("_met") > 0, best))
    kind = F.coalesce("_whole.kind", "_best.kind")
    label = F.struct(kind.alias("kind"), F.coalesce("_whole.target", "_best.target").alias("target"), F.when(kind.isNotNull(), F.coalesce(F.when(F.col("_whole").isNull(), F.col("_best.rest")), F.lit(""))).alias("inline"))
    # a generator of one row: a filter on the label is not pushed below it, where it would compute everything once more
    return base.select(*[F.col(c) for c in lines.columns], F.explode(F.array(label)).alias("_label")).select(*[F.col(c) for c in lines.columns], "_label.*")
