"""Geometry of boxes and the order of lines: predicates as columns, nearest values, fragments, blocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from qirtas.runtime import written

BOX = ["x0", "y0", "x1", "y1"]


def _c(prefix: str, name: str) -> Column:
    return F.col(f"{prefix}{name}")


def height(p: str = "") -> Column:
    return _c(p, "y1") - _c(p, "y0")


def v_overlap(a: str, b: str) -> Column:
    """Shared height as a share of the lower box, at least 0. a, b: prefixes of the box columns."""
    shared = F.least(_c(a, "y1"), _c(b, "y1")) - F.greatest(_c(a, "y0"), _c(b, "y0"))
    return F.greatest(F.lit(0), shared) / F.greatest(F.lit(1), F.least(height(a), height(b)))


def h_overlap(a: str, b: str) -> Column:
    return (_c(a, "x0") < _c(b, "x1")) & (_c(b, "x0") < _c(a, "x1"))


def h_gap(a: str, b: str) -> Column:
    return F.greatest(_c(a, "x0"), _c(b, "x0")) - F.least(_c(a, "x1"), _c(b, "x1"))


def inside(a: str, b: str, share: float = 0.8) -> Column:
    """Whether at least a share of the area of box a lies in box b."""
    w = F.greatest(F.lit(0), F.least(_c(a, "x1"), _c(b, "x1")) - F.greatest(_c(a, "x0"), _c(b, "x0")))
    h = F.greatest(F.lit(0), F.least(_c(a, "y1"), _c(b, "y1")) - F.greatest(_c(a, "y0"), _c(b, "y0")))
    return w * h >= F.lit(share) * (_c(a, "x1") - _c(a, "x0")) * height(a)


def prefixed(df: DataFrame, prefix: str, keep: list[str]) -> DataFrame:
    return df.select(*[c if c in keep else F.col(c).alias(prefix + c) for c in df.columns])


def fragments(lines: DataFrame, group: str = "receipt_id", apart: float = 0.5, overlap: float = 0.6, label: Callable[[DataFrame, list[str]], DataFrame] | None = None) -> DataFrame:
    """Pieces of one phrase joined: neighbours from left to right on one row, closer than a share of the lower height.

    lines: group, line_no, text, box, kind (null where no label). Labels are not joined. In each row (lines whose overlap
    with the row's previous line exceeds `overlap`) a piece opens a new phrase where the gap to its left neighbour is too
    large; text is joined right to left where it is Arabic. label(texts, key) adds kind, target and inline to texts: pieces that
    make a label together end their phrase and have its kind. Returns group, line_no (the first), text, box, kind, target,
    inline.
    """
    order = W.partitionBy(group).orderBy("y0", "x0", "line_no")
    before = {f"p_{c}": F.lag(c).over(order) for c in BOX}
    row = F.sum(F.when(F.col("p_y0").isNull() | (v_overlap("", "p_") <= overlap), 1).otherwise(0)).over(order)
    rows = lines.withColumns(before).withColumn("_row", row).drop(*before)
    across = W.partitionBy(group, "_row").orderBy("x0", "line_no")
    left = {f"l_{c}": F.lag(c).over(across) for c in [*BOX, "kind"]}
    near = (h_gap("", "l_") < apart * F.least(height(), height("l_"))) & (v_overlap("", "l_") > overlap) & F.col("kind").isNull() & F.col("l_kind").isNull()
    phrase = F.sum(F.when(F.col("l_x0").isNotNull() & near, 0).otherwise(1)).over(across)
    parts = rows.withColumns(left).withColumn("_phrase", phrase)
    pieces = F.array_sort(F.collect_list(F.struct("x0", "line_no", "text", "y0", "x1", "y1")))
    joined = parts.groupBy(group, "_row", "_phrase").agg(F.min("line_no").alias("line_no"), pieces.alias("_p"), *[F.max(c).alias(c) for c in ("kind", "target", "inline")])
    none = "cast(array() as array<struct<lo:int,hi:int,kind:string,target:string,inline:string>>)"
    if label is None:
        joined = joined.withColumn("_f", F.expr(none))
    else:
        joined = written(joined, "phrases")
        runs = joined.where(F.size("_p") > 1).select(group, "line_no", F.explode(F.expr("flatten(transform(sequence(0, size(_p) - 2), i -> transform(sequence(i + 1, size(_p) - 1), j -> struct(i as lo, j as hi, slice(_p, i + 1, j - i + 1) as q))))")).alias("r"))
        found = label(runs.select(group, "line_no", "r.lo", "r.hi", _phrase_text(F.col("r.q")).alias("text")), [group, "line_no", "lo", "hi"]).where("kind is not null")
        joined = joined.join(found.groupBy(group, "line_no").agg(F.collect_list(F.struct("lo", "hi", "kind", "target", "inline")).alias("_f")), [group, "line_no"], "left")
    # from the left: the first pieces that make a label close a phrase, the next piece opens another
    ends = F.expr(
        f"""aggregate(sequence(0, size(_p) - 1), struct(0 as start, {none} as done),
             (s, j) -> transform(array(filter(coalesce(_f, {none}), f -> f.lo = s.start and f.hi = j)), hit -> if(size(hit) = 0, s, struct(j + 1 as start, concat(s.done, hit) as done)))[0],
             s -> if(s.start < size(_p), concat(s.done, array(struct(s.start as lo, size(_p) - 1 as hi, kind, target, inline))), s.done))"""
    )
    out = joined.select(group, "_p", F.explode(ends).alias("s")).select(group, F.expr("slice(_p, s.lo + 1, s.hi - s.lo + 1)").alias("q"), "s.kind", "s.target", "s.inline")
    least, most = (lambda c: F.array_min(F.col(f"q.{c}")).alias(c)), (lambda c: F.array_max(F.col(f"q.{c}")).alias(c))
    return out.select(group, least("line_no"), _phrase_text(F.col("q")).alias("text"), least("x0"), least("y0"), most("x1"), most("y1"), "kind", "target", "inline")


def _phrase_text(pieces: Column) -> Column:
    forward = F.array_join(pieces["text"], " ")
    return F.when(forward.rlike("[؀-ۿ]"), F.array_join(F.reverse(pieces)["text"], " ")).otherwise(forward)


def text_rows(tokens: DataFrame, group: list[str], line: str, text: str, x: str) -> DataFrame:
    """Tokens of a line as one text in reading order: from the right where Arabic letters outnumber Latin ones."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(x).alias("x"), F.col(text).alias("t"))))
    g = tokens.groupBy(*group, line).agg(ordered.alias("_t"))
    plain = F.array_join(F.transform("_t", lambda t: t["t"]), " ")
    back = F.array_join(F.transform(F.reverse("_t"), lambda t: t["t"]), " ")
    rtl = F.regexp_count(plain, F.lit("[ء-ي]")) > F.regexp_count(plain, F.lit("[A-Za-z]"))
    return g.select(*group, line, F.when(rtl, back).otherwise(plain).alias("text"))


def same_row_nearest(labels: DataFrame, values: DataFrame, group: str = "receipt_id") -> DataFrame:
    """For each label the value on its row with the least gap, then the lowest line_no."""
    pairs = prefixed(labels, "a_", [group]).join(prefixed(values, "b_", [group]), group).where(v_overlap("a_", "b_") >= 0.5)
    return pairs.groupBy(group, "a_line_no").agg(F.min_by(F.struct("b_line_no", "b_text"), F.struct(h_gap("a_", "b_"), F.col("b_line_no"))).alias("v")).select(group, F.col("a_line_no").alias("label_no"), F.col("v.b_line_no").alias("value_no"), F.col("v.b_text").alias("value"))


def party_blocks(lines: DataFrame, group: str = "receipt_id") -> DataFrame:
    """group, head_no, party, line_no, text: the lines under each party header, in its column, down to the next label or gap.

    lines: group, line_no (position from top to bottom), text, box, kind, target. A line under two headers belongs to the
    upper one.
    """
    heads = prefixed(lines.where("kind = 'party'"), "h_", [group])
    under = lines.join(heads, group).where((F.col("line_no") > F.col("h_line_no")) & (F.col("y0") >= F.col("h_y0") + 0.5 * height("h_")))
    stop = F.min(F.when(F.col("kind").isNotNull(), F.col("line_no"))).over(W.partitionBy(group, "h_line_no"))
    near = under.withColumn("_stop", stop).where(F.col("kind").isNull() & (F.col("_stop").isNull() | (F.col("line_no") < F.col("_stop")))).where(h_overlap("", "h_") & (F.length("text") >= 3))
    order = W.partitionBy(group, "h_line_no").orderBy("line_no")
    bottom = F.coalesce(F.lag("y1").over(order), F.col("h_y1"))
    broken = F.max(F.when(F.col("y0") - bottom > 4 * F.greatest(height("h_"), height()), 1).otherwise(0)).over(order)
    kept = near.withColumn("_broken", broken).where("_broken = 0")
    first = F.min("h_line_no").over(W.partitionBy(group, "line_no"))
    return kept.withColumn("_first", first).where("h_line_no = _first").select(group, F.col("h_line_no").alias("head_no"), F.col("h_target").alias("party"), "line_no", "text")


def text_lines(lines: DataFrame, group: str = "receipt_id", tolerance: float = 0.6) -> DataFrame:
    """lines with `row`, the number of the text row that each belongs to, from top to bottom.

    A fold over the lines by their middle: a line joins the last row if its middle is within tolerance x the smaller of its
    height and the row's mean height of the row's mean middle, else it opens a row. Lines without a box have a null row.
    """
    boxed = lines.where("y0 is not null and y1 is not null")
    item = F.struct(((F.col("y0") + F.col("y1")) / 2).alias("cy"), "x0", "line_no", (F.col("y1") - F.col("y0")).cast("double").alias("h"))
    rows = boxed.groupBy(group).agg(F.array_sort(F.collect_list(item)).alias("items"))
    fold = F.expr(
        f"""aggregate(items, struct(cast(-1 as int) as row, cast(0 as double) as cy, cast(0 as double) as h, cast(0 as int) as n, cast(array() as array<struct<line_no:int,row:int>>) as done),
             (s, i) -> if(s.n > 0 and abs(i.cy - s.cy) <= {tolerance} * least(i.h, s.h),
                struct(s.row as row, (s.cy * s.n + i.cy) / (s.n + 1) as cy, (s.h * s.n + i.h) / (s.n + 1) as h, s.n + 1 as n, concat(s.done, array(struct(i.line_no as line_no, s.row as row))) as done),
                struct(s.row + 1 as row, i.cy as cy, i.h as h, 1 as n, concat(s.done, array(struct(i.line_no as line_no, s.row + 1 as row))) as done)),
             s -> s.done)"""
    )
    found = rows.select(group, F.explode(fold).alias("f")).select(group, "f.line_no", "f.row")
    return lines.join(found, [group, "line_no"], "left")


def merged_boxes(boxes: DataFrame, group: str = "receipt_id") -> DataFrame:
    """group, x0, y0, x1, y1, boxes: boxes that touch joined to their bounding box until none touch.

    Each round joins every box with those that it intersects and keeps the bounding box of what they reach; it ends when a
    round changes nothing, which takes about as many rounds as the logarithm of the longest chain.
    """
    now = boxes.select(group, *BOX).where("x0 is not null and y0 is not null and x1 is not null and y1 is not null").groupBy(group, *BOX).agg(F.count(F.lit(1)).alias("boxes"))
    now = written(now, "boxes")
    while True:
        a, b = prefixed(now, "a_", [group]), prefixed(now, "b_", [group])
        touch = (F.col("a_x0") < F.col("b_x1")) & (F.col("b_x0") < F.col("a_x1")) & (F.col("a_y0") < F.col("b_y1")) & (F.col("b_y0") < F.col("a_y1"))
        flat = (F.col("a_x0") == F.col("b_x0")) & (F.col("a_y0") == F.col("b_y0")) & (F.col("a_x1") == F.col("b_x1")) & (F.col("a_y1") == F.col("b_y1"))
        reach = a.join(b, group).where(touch | flat).groupBy(group, *[f"a_{c}" for c in BOX], "a_boxes").agg(*[F.min(f"b_{c}").alias(c) for c in ("x0", "y0")], *[F.max(f"b_{c}").alias(c) for c in ("x1", "y1")])
        grown = written(reach.groupBy(group, *BOX).agg(F.sum("a_boxes").alias("boxes")), "boxes")
        same = grown.count() == now.count() and grown.select(group, *BOX).exceptAll(now.select(group, *BOX)).isEmpty()
        now = grown
        if same:
            return now
