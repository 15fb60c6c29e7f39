"""Receipts from positioned lines: labels paired with values by geometry, party blocks, headline amounts, leftovers.

Everything is a join, window or fold over the lines of all receipts at once. Values that labels compete for are claimed by a
fold over each receipt's labels in reading order that carries the lines already used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from qirtas.functions import text as T
from qirtas.functions import values as V
from qirtas.functions.vocabulary import CHANNELS, MONEY_FIELDS, PROVIDERS, STATUS_WORDS, norm
from qirtas.operators import labels as L
from qirtas.operators import layout as G
from qirtas.runtime import written

#: Least confidence of a line.
MIN_SCORE = 0.6


def prepared(lines: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """Lines cleaned, labelled, joined from fragments, labelled again where these join, and numbered from top to bottom: receipt_id, line_no, text, box, kind,
    target, inline. Lines below min_score, without text or without a box are left out."""
    rows = lines.where((F.col("score") >= min_score) & F.col("x0").isNotNull() & F.col("y0").isNotNull()).select("receipt_id", "line_no", T.clean(F.col("text")).alias("text"), *G.BOX).where("text != ''")
    rows = L.labelled(rows, ["receipt_id", "line_no"])
    joined = G.fragments(rows, label=L.labelled)
    order = W.partitionBy("receipt_id").orderBy("y0", "x0", "line_no")
    return joined.withColumn("line_no", F.row_number().over(order) - 1)


def candidates(lines: DataFrame) -> DataFrame:
    """For each field label without an inline value, the free lines that may hold its value, best first.

    The row of the label by gap, then just below it by height, then for money just above it; only valid texts.
    """
    wanted = G.prefixed(lines.where("kind = 'field' and inline = ''").select("receipt_id", "line_no", "text", "target", *G.BOX), "a_", ["receipt_id"])
    free = G.prefixed(lines.where("kind is null").select("receipt_id", "line_no", "text", *G.BOX), "b_", ["receipt_id"])
    h = G.height("a_")
    row = G.v_overlap("a_", "b_") >= 0.5
    within = lambda d: (d >= -0.3 * h) & (d <= 2 * h)
    below = G.h_overlap("a_", "b_") & within(F.col("b_y0") - F.col("a_y1"))
    above = G.h_overlap("a_", "b_") & within(F.col("a_y0") - F.col("b_y1")) & F.col("a_target").isin(*MONEY_FIELDS)
    rank = F.when(row, F.struct(F.lit(0).alias("k"), G.h_gap("a_", "b_").alias("d"))).when(below, F.struct(F.lit(1).alias("k"), F.col("b_y0").alias("d"))).when(above, F.struct(F.lit(2).alias("k"), (-F.col("b_y1")).alias("d")))
    pairs = wanted.join(free, "receipt_id").withColumn("rank", rank).where(F.col("rank").isNotNull() & V.valid(F.col("a_target"), F.col("b_text")))
    best = F.array_sort(F.collect_list(F.struct("rank", F.col("b_line_no").alias("no"), F.col("b_text").alias("text"))))
    return pairs.groupBy("receipt_id", F.col("a_line_no").alias("label_no"), F.col("a_target").alias("target"), F.col("a_text").alias("label")).agg(best.alias("cands"))


def claims(cands: DataFrame, taken: DataFrame) -> DataFrame:
    """receipt_id, label_no, target, label, value_no, value: labels in reading order, each takes its best line still free.

    taken: receipt_id, line_no of lines used before.
    """
    used = taken.groupBy("receipt_id").agg(F.collect_set("line_no").alias("taken"))
    per = cands.groupBy("receipt_id").agg(F.array_sort(F.collect_list(F.struct("label_no", "target", "label", "cands"))).alias("labels")).join(used, "receipt_id", "left")
    fold = F.expr(
        """aggregate(labels,
             struct(coalesce(taken, cast(array() as array<int>)) as used, cast(array() as array<struct<label_no:int,target:string,label:string,value_no:int,value:string>>) as picks),
             (s, l) -> transform(array(filter(l.cands, c -> not array_contains(s.used, c.no))), free ->
                 if(size(free) = 0, s, struct(concat(s.used, array(free[0].no)) as used,
                    concat(s.picks, array(struct(l.label_no as label_no, l.target as target, l.label as label, free[0].no as value_no, free[0].text as value))) as picks)))[0],
             s -> s.picks)"""
    )
    return per.select("receipt_id", F.explode(fold).alias("p")).select("receipt_id", "p.*")


def _at(*ord_: Column | int) -> Column:
    """When a value is written: step of the extraction, label, line."""
    return F.struct(*[(c if isinstance(c, Column) else F.lit(c)).cast("int").alias(n) for n, c in zip("sab", ord_)]).alias("at")


def _pairs(rows: DataFrame, party: Column, pairs: Column, at: Column) -> DataFrame:
    """receipt_id, party, slot, value, ord of an array of slots and values for each row."""
    return rows.select("receipt_id", party.alias("party"), at, F.posexplode(pairs).alias("n", "v")).select("receipt_id", "party", "v.slot", "v.value", F.struct("at", "n").alias("ord"))


def _party_values(said: DataFrame, blocks: DataFrame, heads: DataFrame, found: DataFrame) -> DataFrame:
    """receipt_id, party, slot, value, ord of the values of each party: from sentences, headers with a value, the lines
    under headers, and labels that name a party."""
    one = lambda slot, c: F.array(F.struct(slot.alias("slot"), c.alias("value")))
    channel = T.norm(F.col("inline")).isin(*[norm(c) for c in CHANNELS])
    inline = F.when(channel, one(F.lit("via"), F.col("inline"))).otherwise(V.classify(F.col("inline")))
    named = F.split("target", r"\.")
    direct = F.when(named[1] == "account", V.classify(F.col("value"))).otherwise(one(named[1], F.col("value")))
    return (
        _pairs(said, F.col("party"), V.sentence_party(F.col("value")), _at(0, F.col("line_no"), 0))
        .unionByName(_pairs(heads.where("inline != ''"), F.col("target"), inline, _at(1, F.col("line_no"), -1)))
        .unionByName(_pairs(blocks, F.col("party"), V.classify(F.col("text")), _at(1, F.col("head_no"), F.col("line_no"))))
        .unionByName(_pairs(found.where(F.col("target").contains(".")), named[0], direct, _at(2, F.col("label_no"), 0)))
    )


def implied_senders(rows: DataFrame, used: DataFrame, parties: DataFrame) -> DataFrame:
    """receipt_id, line_no, text of the lines just above the first receiver header, in its column, up to the next label or
    used line, where a receipt has no sender: its header was not read."""
    first = rows.where("kind in ('party', 'sentence') and target = 'receiver'").groupBy("receipt_id").agg(F.min_by(F.struct("line_no", *G.BOX), "line_no").alias("h")).select("receipt_id", *[F.col(f"h.{c}").alias(f"h_{c}") for c in ("line_no", *G.BOX)])
    first = first.join(parties.where("party = 'sender'"), "receipt_id", "left_anti")
    above = rows.join(first, "receipt_id").where("line_no < h_line_no").join(used.distinct().withColumn("used", F.lit(True)), ["receipt_id", "line_no"], "left")
    stop = F.max(F.when(F.col("used") | F.col("kind").isNotNull(), F.col("line_no"))).over(W.partitionBy("receipt_id"))
    return above.withColumn("stop", stop).where((F.col("line_no") > F.coalesce("stop", F.lit(-1))) & (F.length("text") >= 3) & G.h_overlap("", "h_")).select("receipt_id", "line_no", "text")


def status_of(c: Column) -> Column:
    """The first status with one of its words, as whole words, in a normalised text."""
    out = None
    for status, words in STATUS_WORDS.items():
        has = F.lit(False)
        for w in words:
            has = has | T.whole_word(c, norm(w))
        out = F.when(has, status) if out is None else out.when(has, status)
    return out


def provider_of(c: Column) -> Column:
    """The first provider with one of its keywords in a normalised text; Latin ones of 4 or more letters also inside a word."""
    out = None
    for name, words in PROVIDERS.items():
        has = F.lit(False)
        for w in map(norm, words):
            has = has | (c.contains(w) if w.isascii() and len(w) >= 4 else T.whole_word(c, w))
        out = F.when(has, name) if out is None else out.when(has, name)
    return out


def extracted(lines: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """One row per receipt: provider, status, type, amount, fees, total, currency, reference, datetime (as printed), note,
    sender and receiver (name, phone, account, bank, via, other: further values of a slot, as they come), evidence in the
    order in which values are found, unmapped (the leftovers with their type).

    lines: receipt_id, line_no, text, score, x0, y0, x1, y1. Receipts of which no line is readable have no row.
    """
    every = written(prepared(lines, min_score).withColumn("said", V.sentence(F.col("text"))), "prepared")
    # a label within a sentence opens nothing, but ends the block above it
    rows = every.withColumn("kind", F.when(F.col("said").isNotNull() & F.col("kind").isNotNull(), "sentence").otherwise(F.col("kind"))).drop("said")
    line = ["receipt_id", "line_no"]
    said = every.where("said is not null").select(*line, "text", "said.*")
    heads = rows.where("kind = 'party'")
    blocks = written(G.party_blocks(rows).join(said.select(*line), line, "left_anti"), "blocks")
    taken = blocks.select(*line).unionByName(said.select(*line))
    picked = claims(candidates(rows), taken)
    inline = rows.where("kind = 'field' and inline != ''").select("receipt_id", F.col("line_no").alias("label_no"), "target", F.col("text").alias("label"), F.lit(None).cast("int").alias("value_no"), F.col("inline").alias("value"))
    found = written(picked.unionByName(inline), "claims")
    used = taken.unionByName(found.where("value_no is not null").select("receipt_id", F.col("value_no").alias("line_no")))
    parties = written(_party_values(said, blocks, heads, found), "parties")
    implied = written(implied_senders(rows, used, parties), "implied")
    parties = parties.unionByName(_pairs(implied, F.lit("sender"), V.classify(F.col("text")), _at(3, -F.col("line_no"), 0)))
    left = rows.where("kind is null").join(used.unionByName(implied.select(*line)), line, "left_anti").withColumn("m", V.money(F.col("text")))
    # a headline is looked for where nothing else gives the amount
    given = found.where("target = 'amount'").select("receipt_id").unionByName(said.select("receipt_id"))
    headline = left.join(given, "receipt_id", "left_anti").where(F.col("m.currency").isNotNull()).groupBy("receipt_id").agg(F.max_by(F.struct("line_no", "text", "m"), F.struct(G.height(), -F.col("line_no"))).alias("headline"))
    headline = written(headline, "headline")
    heading = headline.select("receipt_id", "headline.line_no", "headline.text")

    # the first label that has a value gives the field
    first = lambda t: F.min_by("value", F.when(F.col("target") == t, F.col("label_no")))
    fields = found.groupBy("receipt_id").agg(*[first(t).alias(t) for t in (*MONEY_FIELDS, "reference", "datetime", "note", "type")], *[F.min(F.when(F.col("target") == t, F.col("label_no"))).alias(f"{t}_no") for t in MONEY_FIELDS])
    told = said.groupBy("receipt_id").agg(F.min_by("amount", "line_no").alias("told"), F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("sentences"))
    shown = lambda df, at, no, field, label, value: df.select("receipt_id", at, no.cast("int").alias("label_no"), field.alias("field"), label.cast("string").alias("label"), F.col(value).alias("value"))
    none, no = F.lit(None), F.col("line_no")
    titled = blocks.join(heads.select("receipt_id", F.col("line_no").alias("head_no"), F.col("text").alias("label")), ["receipt_id", "head_no"])
    evidence = (
        shown(said, _at(0, no, 0), none, F.lit("sentence"), none, "text")
        .unionByName(shown(titled, _at(1, F.col("head_no"), no), F.col("head_no"), F.col("party"), F.col("label"), "text"))
        .unionByName(shown(found, _at(2, F.col("label_no"), 0), F.col("label_no"), F.col("target"), F.col("label"), "value"))
        .unionByName(shown(implied, _at(3, -no, 0), none, F.lit("sender"), none, "text"))
        .unionByName(shown(heading, _at(4, no, 0), none, F.lit("amount"), none, "text"))
    )
    evidence = evidence.groupBy("receipt_id").agg(F.array_sort(F.collect_list(F.struct("at", "label_no", "field", "label", "value"))).alias("e"))
    evidence = evidence.select("receipt_id", F.transform("e", lambda e: F.struct(*[e[c].alias(c) for c in ("label_no", "field", "label", "value")])).alias("evidence"))

    slots, both = ("name", "phone", "account", "bank", "via"), ("sender", "receiver")
    one = lambda p, s: F.min_by("value", F.when((F.col("party") == p) & (F.col("slot") == s), F.col("ord")))
    more = lambda p: F.array_sort(F.collect_list(F.when((F.col("party") == p) & (F.col("_nth") > 1), F.struct("ord", "value"))))
    other = lambda p: F.when(F.size(f"{p}_more") > 0, F.transform(f"{p}_more", lambda x: x["value"])).alias("other")
    party = lambda p: F.struct(*[F.col(f"{p}_{s}").alias(s) for s in slots], other(p)).alias(p)
    nth = F.row_number().over(W.partitionBy("receipt_id", "party", "slot").orderBy("ord"))
    sides = parties.withColumn("_nth", nth).groupBy("receipt_id").agg(*[one(p, s).alias(f"{p}_{s}") for p in both for s in slots], *[more(p).alias(f"{p}_more") for p in both]).select("receipt_id", *map(party, both))

    rest = left.where(F.length("text") >= 3).join(heading.select(*line), line, "left_anti").withColumn("type", V.described(F.col("text")))
    rest = rest.groupBy("receipt_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "text", "type"))).alias("unmapped"), F.min_by("text", F.when(F.col("type") == "datetime", F.col("line_no"))).alias("dated"))
    base = rows.groupBy("receipt_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("page"))
    for part in (fields, told, sides, rest, headline, evidence):
        base = base.join(part, "receipt_id", "left")
    texts = lambda c: F.coalesce(F.transform(c, lambda u: u["text"]), F.array().cast("array<string>"))
    words = lambda c: T.norm(F.array_join(c, " "))
    worth = lambda t: V.money(F.col(t))["value"]
    # a field takes the currency of the value that it has: an amount told in a sentence hides a labelled one
    coins = F.array(*[F.when(F.col("told").isNull() | F.lit(t != "amount"), F.struct(F.col(f"{t}_no").alias("no"), V.money(F.col(t))["currency"].alias("coin"))) for t in MONEY_FIELDS])
    coin = F.array_min(F.filter(coins, lambda c: c["coin"].isNotNull()))["coin"]
    return base.select(
        "receipt_id", provider_of(words(texts("page"))).alias("provider"), status_of(words(F.concat(texts("unmapped"), texts("sentences")))).alias("status"), "type",
        F.coalesce(worth("told"), worth("amount"), F.col("headline.m.value")).alias("amount"), worth("fees").alias("fees"), worth("total").alias("total"),
        F.coalesce(V.money(F.col("told"))["currency"], coin, F.col("headline.m.currency")).alias("currency"), "reference", F.coalesce("datetime", "dated").alias("datetime"), "note", "sender", "receiver", "evidence", "unmapped",
    )
