"""Fixed-capacity containers filled with documents of varying length, by vector best-fit.

A container has three capacities: tokens, documents, and attention cost (the sum of squared lengths, what a block-diagonal
mask costs). The second and third are parameters (`Limits`) whose defaults bind: many short documents fill a container by their
number, one long document leaves little room for others by its cost. A document goes into the open container that it fits
under all three and that it leaves with the least weighted norm of what remains. Documents are packed in blocks of bounded
size, drawn by hash so that each has the mix of lengths of the whole; what a block could only put into badly filled containers
is drawn again, into fewer blocks, and packed once more.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qirtas.runtime import only, written

#: Documents in one block: the working set of one task.
BLOCK_ITEMS = 4000
#: Containers filled to at least this share are final in every round but the last.
FULL = 0.985
#: Times that badly filled containers are opened and their documents packed again.
ROUNDS = 3
#: Weights of tokens, documents and attention cost, each as a share of its capacity, in the norm of what remains.
WEIGHTS = np.array([1.0, 0.05, 0.05])

ITEM = "size_id int, capacity bigint, doc_id bigint, part int, start bigint, tokens bigint"
PACKED = ITEM + ", block bigint, bin int, fill double"


#: Sizes of containers: a fixed list, checked.
MAX_SIZES = 1000


class Limits(NamedTuple):
    """Capacities besides tokens. tokens_each: a container takes at most a document for every so many tokens of its capacity;
    attention: its cost is at most this share of the square of its capacity. One document alone may exceed the cost."""

    tokens_each: float = 12.0
    attention: float = 0.9


def capacities(capacity: int, limits: Limits = Limits()) -> np.ndarray:
    """Tokens, documents and attention cost that a container of so many tokens takes."""
    return np.array([capacity, max(1, int(capacity / limits.tokens_each)), limits.attention * float(capacity) ** 2])


def best_fit(sizes: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """The container number of each item: longest first, each into the feasible container left with the least residual.

    A container that the shortest item does not fit any more is closed. An item that exceeds a capacity alone has a container
    of its own.
    """
    order = np.argsort(-sizes, kind="stable")
    left = np.empty((len(sizes), 3))
    number = np.empty(len(sizes), dtype=np.int64)
    bins = np.empty(len(sizes), dtype=np.int64)
    opened = made = 0
    scale = WEIGHTS / limits
    least = np.array([sizes.min(), 1.0, float(sizes.min()) ** 2]) if len(sizes) else None
    for k in order:
        need = np.array([sizes[k], 1.0, float(sizes[k]) ** 2])
        at = -1
        if opened:
            rest = left[:opened] - need
            fits = np.flatnonzero((rest >= 0).all(axis=1))
            if len(fits):
                at = fits[np.argmin(((rest[fits] * scale) ** 2).sum(axis=1))]
        if at < 0:
            left[opened], number[opened] = limits, made
            at, opened, made = opened, opened + 1, made + 1
        left[at] -= need
        bins[k] = number[at]
        if (left[at] < least).any():
            opened -= 1
            left[at], number[at] = left[opened], number[opened]
    return bins


def items(sized: DataFrame, sizes: DataFrame) -> DataFrame:
    """ITEM rows: each document once for each capacity; one that alone exceeds it in pieces, all but the last of them full.

    Documents without an id or without tokens, and sizes without an id or a capacity, are in no container.
    """
    sized, sizes = only(sized, "doc_id", "tokens"), only(sizes, "size_id", "capacity_tokens").where("size_id is not null and capacity_tokens > 0")
    each = sized.where("doc_id is not null and tokens > 0").select("doc_id", F.col("tokens").alias("all")).crossJoin(F.broadcast(sizes.select("size_id", F.col("capacity_tokens").cast("bigint").alias("capacity"))))
    piece = F.explode(F.expr("sequence(0, cast((all - 1) div capacity as int))"))
    cut = each.withColumn("part", piece).withColumn("start", F.col("part") * F.col("capacity"))
    return cut.select("size_id", "capacity", "doc_id", "part", "start", F.least("capacity", F.col("all") - F.col("start")).alias("tokens"))


def _packer(limits: Limits):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "doc_id", "part"], ascending=[False, True, True], kind="stable")
        capacity, tokens = int(pdf["capacity"].iloc[0]), pdf["tokens"].to_numpy()
        most = capacities(capacity, limits)
        bins = best_fit(tokens, most)
        # a container is full by the capacity that it has used most of
        used = np.stack([np.bincount(bins, weights=w) for w in (tokens, np.ones(len(tokens)), tokens.astype(float) ** 2)], axis=1) / most
        return pdf.assign(bin=bins.astype("int32"), fill=used.max(axis=1)[bins])

    return pack


def packed(sized: DataFrame, sizes: DataFrame, block_items: int = BLOCK_ITEMS, rounds: int = ROUNDS, limits: Limits = Limits()) -> DataFrame:
    """size_id, container_id, doc_id, part, start, tokens: one row per document, or piece of one too long, and capacity.

    sized: doc_id (unique), tokens. sizes: size_id, capacity_tokens (at most MAX_SIZES, broadcast). A document is split only if
    it alone exceeds the capacity. An empty table gives no rows.
    """
    if len(sizes.select("size_id").limit(MAX_SIZES + 1).collect()) > MAX_SIZES:
        raise ValueError(f"more than {MAX_SIZES} sizes of containers")
    left = written(items(sized, sizes), "items")
    out: DataFrame | None = None
    for k in range(rounds):
        whole = left.where("tokens = capacity") if k == 0 else None
        open_ = left.where("tokens < capacity") if k == 0 else left
        counts = {r["size_id"]: r["count"] for r in open_.groupBy("size_id").count().collect()}
        if not counts and whole is None:
            break
        blocks = F.create_map(*[F.lit(x) for s, n in counts.items() for x in (s, max(1, -(-n // block_items)))]) if counts else F.create_map(F.lit(0), F.lit(1))
        block = F.pmod(F.xxhash64("doc_id", "part", F.lit(k)), F.coalesce(F.try_element_at(blocks, F.col("size_id")), F.lit(1)))
        done = written(open_.withColumn("block", block).groupBy("size_id", "block").applyInPandas(_packer(limits), PACKED), f"packed-{k}")
        final = done if k == rounds - 1 else done.where(F.col("fill") >= FULL)
        rows = final.select("size_id", "doc_id", "part", "start", "tokens", F.concat_ws("-", "size_id", F.lit(k), "block", "bin").alias("container_id"))
        if whole is not None:
            rows = rows.unionByName(whole.select("size_id", "doc_id", "part", "start", "tokens", F.concat_ws("-", "size_id", F.lit("w"), "doc_id", "part").alias("container_id")))
        out = rows if out is None else out.unionByName(rows)
        left = done.where(F.col("fill") < FULL).drop("block", "bin", "fill")
    return out.select("size_id", "container_id", "doc_id", "part", "start", "tokens")


def report(rows: DataFrame, sizes: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """size_id, capacity_tokens, containers, documents, pieces, tokens, fill (share of the containers' tokens used), and how many
    containers are full by documents or by attention cost, to 95 % of that capacity."""
    cost, squares = F.col("capacity_tokens").cast("double"), F.sum(F.col("tokens").cast("double") ** 2)
    per = rows.groupBy("size_id", "container_id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("pieces"), F.count_if(F.col("part") == 0).alias("documents"), squares.alias("squares")).join(sizes, "size_id")
    by_documents = F.count_if(F.col("pieces") >= 0.95 * F.greatest(F.lit(1), F.floor(F.col("capacity_tokens") / limits.tokens_each)))
    by = per.groupBy("size_id", "capacity_tokens").agg(
        F.count(F.lit(1)).alias("containers"), F.sum("documents").alias("documents"), F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"),
        by_documents.alias("full_by_documents"), F.count_if(F.col("squares") >= 0.95 * limits.attention * cost**2).alias("full_by_attention"),
    )
    return by.withColumn("fill", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6))
