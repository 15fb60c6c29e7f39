"""Records of several sources combined so that each source has its target share of all tokens.

Iterative proportional fitting rakes the expected copies of the documents of each cell (source, language, topic) to the
sources' target shares and to the corpus' own shares of languages and topics, under each source's most repeats. The total is
asked for, or the largest for which every source can give its share; what a source cannot give of a larger one is reported
as its shortfall, and how far languages and topics stay from their marginals too. Documents are then drawn by a hash under a threshold calibrated on
the tokens really drawn, so that the shares are met to within about a document a source and a rerun draws the same.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from qirtas.llm.tokens import VOCABULARY, with_tokens
from qirtas.runtime import only, written

#: Languages and topics with a marginal of their own; the rest of each together has one. They bound the cells that are raked.
MAX_LANGUAGES, MAX_TOPICS = 32, 64
#: Sources with a target: a fixed list, checked. It bounds the cells with the two above.
MAX_SOURCES = 500
ITERATIONS = 30
#: Ranks have 2 * HALF bits; the threshold is found one half of them at a time.
HALF = 12


def topic_of(text: F.Column) -> F.Column:
    """The top folder of the first changed file; 'message' for records without a diff."""
    folder = F.regexp_extract(text, r"(?:^|\n)diff --git a/([^/\s]+)/", 1)
    return F.when(folder == "", "message").otherwise(folder)


def _common(docs: DataFrame, column: str, most: int) -> DataFrame:
    """docs with the values of a column beyond the `most` largest by tokens as one, 'other'."""
    top = docs.groupBy(column).agg(F.sum("tokens").alias("t")).orderBy(F.desc("t"), column).limit(most).select(F.col(column).alias("_top"))
    return docs.join(top, F.col(column) == F.col("_top"), "left").withColumn(column, F.coalesce("_top", F.lit("other"))).drop("_top")


def rake(tokens: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], caps: np.ndarray, iterations: int = ITERATIONS) -> np.ndarray:
    """Expected copies of each cell: tokens x copies has the target sums by each code, the first code's last and exactly.

    caps: the most copies of each cell. Where a cap keeps a cell below what raking asks, the others of its source make up.
    """
    copies = np.minimum(1.0, caps)
    first, goal = codes[0], targets[0]
    for _ in range(iterations):
        for code, target in zip(codes[1:], targets[1:]):
            have = np.bincount(code, weights=tokens * copies, minlength=len(target))
            ratio = np.divide(target, have, out=np.ones_like(target), where=have > 0)
            copies = np.minimum(copies * ratio[code], caps)
        copies = _filled(tokens, first, goal, copies, caps)
    return copies


def _filled(tokens: np.ndarray, code: np.ndarray, goal: np.ndarray, copies: np.ndarray, caps: np.ndarray) -> np.ndarray:
    """copies scaled within each source so that its tokens are its goal, no cell above its cap."""
    out = copies.copy()
    for s in range(len(goal)):
        own = np.flatnonzero(code == s)
        w, t, c = np.maximum(copies[own], 1e-12), tokens[own], caps[own]
        fixed = np.zeros(len(own), dtype=bool)
        for _ in range(len(own) + 1):
            rest = goal[s] - (t * c)[fixed].sum()
            base = (t * w)[~fixed].sum()
            factor = rest / base if base > 0 else 0.0
            over = ~fixed & (w * factor > c)
            if not over.any():
                break
            fixed |= over
        out[own] = np.where(fixed, c, np.minimum(w * max(factor, 0.0), c))
    return out


def expected(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, total_tokens: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The documents with tokens, cell columns; and for each cell its expected copies."""
    wanted = only(targets, "source", "target_share", "max_repeats").where("source is not null and target_share is not null and max_repeats is not null").limit(MAX_SOURCES + 1).collect()
    if len(wanted) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources with a target")
    documents, targets = only(documents, "doc_id", "text", "lang", "source").where("doc_id is not null"), only(targets, "source", "target_share", "max_repeats").where("source is not null and target_share is not null and max_repeats is not null")
    sized = with_tokens(documents.select("doc_id", "text", F.coalesce("lang", F.lit("none")).alias("lang"), "source", topic_of(F.coalesce("text", F.lit(""))).alias("topic")), vocabulary=vocabulary).where("tokens > 0")
    docs = written(sized.join(targets.select("source").distinct(), "source", "left_semi"), "sized")
    docs = _common(_common(docs, "lang", MAX_LANGUAGES), "topic", MAX_TOPICS)
    cells = docs.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens")).orderBy("source", "lang", "topic").toPandas()
    spark = documents.sparkSession
    schema = "source string, lang string, topic string, copies double"
    if not len(cells):
        return docs, spark.createDataFrame([], schema)
    want = {r["source"]: (float(r["target_share"]), int(r["max_repeats"])) for r in wanted}
    tokens = cells["tokens"].to_numpy(dtype=float)
    codes, levels = [], []
    for c in ("source", "lang", "topic"):
        values, code = np.unique(cells[c].astype(str), return_inverse=True)
        codes.append(code)
        levels.append(values)
    share = np.array([want[s][0] for s in levels[0]])
    share = share / share.sum()
    repeats = np.array([want[s][1] for s in levels[0]], dtype=float)
    there = np.bincount(codes[0], weights=tokens)
    total = float(total_tokens) if total_tokens is not None else float(np.min(np.where(share > 0, repeats * there / np.maximum(share, 1e-12), np.inf)))
    # a source gives no more than all its documents, each as often as it may
    given = np.minimum(share * total, repeats * there)
    goals = [given] + [np.bincount(c, weights=tokens) / tokens.sum() * given.sum() for c in codes[1:]]
    # rounded, so that a cell at its cap is not drawn once more
    cells["copies"] = np.round(rake(tokens, codes, goals, repeats[codes[0]]), 6)
    return docs, spark.createDataFrame(cells[["source", "lang", "topic", "copies"]], schema)


def _threshold(weights: DataFrame, bits: str, before: str, name: str) -> DataFrame:
    """source, name, reached: the last value of `bits` at which the tokens so far are still below the source's goal."""
    run = weights.groupBy("source", bits, "goal", before).agg(F.sum("tokens").alias("t"))
    so_far = F.col(before) + F.sum("t").over(W.partitionBy("source").orderBy(bits)) - F.col("t")
    return run.withColumn("so_far", so_far).where(F.col("so_far") < F.col("goal")).groupBy("source", "goal").agg(F.max(bits).alias(name), F.max("so_far").alias("reached"))


def mixed(documents: DataFrame, targets: DataFrame, seed: int = 0, vocabulary: str = VOCABULARY, total_tokens: int | None = None) -> DataFrame:
    """doc_id, source, lang, topic, tokens, copies (at least 1) of the documents drawn.

    targets: source, target_share, max_repeats (at most MAX_SOURCES). total_tokens: the size of the mixture; without it the
    largest for which every source can give its share. Shares are scaled to 1 over the sources that have
    tokens; sources without a target and documents without an id or tokens are not drawn. Of repeated rows each is drawn. No document is drawn more than max_repeats
    times.
    """
    docs, cells = expected(documents, targets, vocabulary, total_tokens)
    part = F.col("copies") - F.floor("copies")
    # a document is drawn once more if its hash, as a share of its probability, is below its source's threshold of about 1
    u = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << (2 * HALF - 2)))
    rank = F.when(part > 1e-9, F.least(F.floor(u / part), F.lit((1 << (2 * HALF)) - 1))).cast("int")
    d = written(docs.join(cells, ["source", "lang", "topic"]).withColumn("part", part).withColumn("u", rank).withColumn("high", F.shiftright("u", HALF)).withColumn("low", F.col("u") % (1 << HALF)), "drawn-from")
    goal = d.groupBy("source").agg(F.sum(F.col("part") * F.col("tokens")).alias("goal"))
    open_ = d.where(F.col("u").isNotNull()).join(goal, "source")
    high = _threshold(open_.withColumn("zero", F.lit(0).cast("bigint")), "high", "zero", "cut").select("source", F.col("cut").alias("high_cut"), F.col("reached").alias("high_reached"))
    near = open_.join(high, "source").where(F.col("high") == F.col("high_cut"))
    low = _threshold(near, "low", "high_reached", "cut").select("source", F.col("cut").alias("low_cut"), F.col("reached").alias("low_reached"))
    at_cut = near.join(low, "source").where(F.col("low") == F.col("low_cut")).groupBy("source").agg(F.sum("tokens").alias("at_cut"))
    # the documents at the threshold are drawn too if that comes nearer to the goal
    cuts = high.join(low, "source").join(at_cut, "source").join(goal, "source").select("source", "high_cut", "low_cut", (F.col("low_reached") + F.col("at_cut") - F.col("goal") <= F.col("goal") - F.col("low_reached")).alias("with_cut"))
    drawn = d.join(cuts, "source", "left")
    below = (F.col("high") < F.col("high_cut")) | (F.col("high") == F.col("high_cut")) & ((F.col("low") < F.col("low_cut")) | (F.col("low") == F.col("low_cut")) & F.col("with_cut"))
    copies = F.floor("copies") + F.coalesce(below, F.lit(False)).cast("int")
    return drawn.select("doc_id", "source", "lang", "topic", "tokens", copies.cast("int").alias("copies")).where("copies > 0")


def shares(drawn: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """source, target_share, actual_share, tokens, documents, most_copies, shortfall of every source with a target. shortfall: the
    tokens that a source lacks of its share of total_tokens (of what was drawn, without it), at least 0."""
    by = drawn.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_copies"))
    total = by.agg(F.sum("tokens").alias("total")).crossJoin(targets.agg(F.sum("target_share").alias("all")))
    rows = targets.join(by, "source", "left").crossJoin(F.broadcast(total))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    asked = F.lit(total_tokens) if total_tokens is not None else F.coalesce("total", F.lit(0))
    short = F.greatest(F.lit(0), F.round(F.col("target_share") / F.col("all") * asked) - zero("tokens")).cast("bigint")
    return rows.select("source", "target_share", F.round(F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0)), 6).alias("actual_share"), zero("tokens").alias("tokens"), zero("documents").alias("documents"), zero("most_copies").alias("most_copies"), short.alias("shortfall"))


def marginals(drawn: DataFrame, documents: DataFrame) -> DataFrame:
    """dimension (lang, topic), value, corpus_share, actual_share, residual: how far the mixture is from the corpus' own shares of
    languages and topics. documents: the sized documents of `expected`."""
    out = None
    for c in ("lang", "topic"):
        have = drawn.groupBy(F.col(c).alias("value")).agg(F.sum(F.col("tokens") * F.col("copies")).alias("have"))
        want = documents.groupBy(F.col(c).alias("value")).agg(F.sum("tokens").alias("want"))
        both = want.join(have, "value", "left").withColumn("have", F.coalesce("have", F.lit(0)))
        sums = both.agg(F.sum("want").alias("all"), F.greatest(F.sum("have"), F.lit(1)).alias("drawn"))
        share = both.crossJoin(F.broadcast(sums)).select(F.lit(c).alias("dimension"), "value", F.round(F.col("want") / F.col("all"), 6).alias("corpus_share"), F.round(F.col("have") / F.col("drawn"), 6).alias("actual_share"))
        share = share.withColumn("residual", F.round(F.col("actual_share") - F.col("corpus_share"), 6))
        out = share if out is None else out.unionByName(share)
    return out
