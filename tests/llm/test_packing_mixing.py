import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from qirtas.llm import mixing as M
from qirtas.llm import packing as B
from qirtas.llm.tokens import VOCABULARY, encoding, with_tokens

SIZES = [(1, 64), (2, 256), (None, 9), (3, None), (4, 0)]


def test_tokens(spark):
    from pathlib import Path

    texts = ["", "hello world", None, "<|endoftext|>", "ß" * 50_000, "مرحبا"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    enc = encoding(VOCABULARY, Path(VOCABULARY).read_bytes())
    got = {r["doc_id"]: r["tokens"] for r in with_tokens(df).collect()}
    assert got == {k: len(enc.encode_ordinary(t)) if t else 0 for k, t in enumerate(texts)}


def test_best_fit_respects_every_capacity():
    rnd = np.random.default_rng(1)
    sizes = rnd.integers(1, 100, 500)
    limits = np.array([100.0, 5.0, 6000.0])
    bins = B.best_fit(sizes, limits)
    for b in np.unique(bins):
        own = sizes[bins == b]
        assert own.sum() <= 100 and (len(own) <= 5) and ((own**2).sum() <= 6000 or len(own) == 1)


@pytest.mark.parametrize("block", [7, 4000])
def test_packed(spark, block):
    rnd = random.Random(2)
    sized = [(k, rnd.choice([1, 3, 30, 60, 64, 65, 200, 900]), "x") for k in range(200)] + [(900, 0, None), (901, None, None), (None, 5, None)]
    df = spark.createDataFrame(sized, "doc_id bigint, tokens bigint, TOKENS string")
    sizes = spark.createDataFrame(SIZES, "size_id int, capacity_tokens int")
    rows = B.packed(df, sizes, block_items=block).collect()
    for size, capacity in ((1, 64), (2, 256)):
        own = [r for r in rows if r["size_id"] == size]
        bins = {}
        for r in own:
            bins.setdefault(r["container_id"], []).append(r)
        for members in bins.values():
            assert sum(r["tokens"] for r in members) <= capacity and len(members) <= B.capacities(capacity)[1]
        docs = {}
        for r in own:
            docs.setdefault(r["doc_id"], []).append(r)
        assert set(docs) == set(range(200))
        for d, parts in docs.items():
            n = sized[d][1]
            assert sum(r["tokens"] for r in parts) == n and len(parts) == -(-n // capacity)
            assert sorted(r["start"] for r in parts) == [k * capacity for k in range(len(parts))]
        total = sum(s[1] for s in sized[:200])
        assert block < 100 or len(bins) <= 1.08 * total / capacity + 1
    assert {r["size_id"] for r in rows} == {1, 2}
    assert B.packed(df.limit(0), sizes).count() == 0
    assert B.report(B.packed(df, sizes), sizes).count() == 2


def test_each_capacity_changes_the_result():
    rnd = np.random.default_rng(3)
    sizes = np.concatenate([rnd.integers(1, 8, 300), rnd.integers(20, 95, 200)])
    loose = B.best_fit(sizes, B.capacities(100, B.Limits(0.5, 1.0)))
    few = B.best_fit(sizes, B.capacities(100, B.Limits(25, 1.0)))
    cheap = B.best_fit(sizes, B.capacities(100, B.Limits(0.5, 0.5)))
    assert max(np.bincount(few)) == 4 < max(np.bincount(loose))
    cost = np.bincount(cheap, weights=sizes.astype(float) ** 2)
    assert all(c <= 5000 or n == 1 for c, n in zip(cost, np.bincount(cheap))) and np.bincount(loose, weights=sizes.astype(float) ** 2).max() > 5000
    assert not np.array_equal(loose, few) and not np.array_equal(loose, cheap)
    # by default both bind
    default = B.capacities(100)
    assert default[1] < 100 and default[2] < 100**2


def test_too_many_sizes(spark):
    with pytest.raises(ValueError):
        B.packed(spark.createDataFrame([(1, 1)], "doc_id bigint, tokens bigint"), spark.range(B.MAX_SIZES + 1).selectExpr("cast(id as int) size_id", "10 capacity_tokens"))


def test_rake_meets_sources_exactly_under_caps():
    rnd = np.random.default_rng(4)
    tokens = rnd.integers(1, 1000, 60).astype(float)
    src, lang = rnd.integers(0, 3, 60), rnd.integers(0, 4, 60)
    share, caps = np.array([0.5, 0.3, 0.2]), np.array([2.0, 1.0, 4.0])
    total = min(caps * np.bincount(src, weights=tokens) / share) * 0.9
    goals = [share * total, np.bincount(lang, weights=tokens) / tokens.sum() * total]
    copies = M.rake(tokens, [src, lang], goals, caps[src])
    assert np.allclose(np.bincount(src, weights=tokens * copies), goals[0]) and (copies <= caps[src] + 1e-9).all()


def test_mixed(spark):
    rnd = random.Random(6)
    docs = [(k, "word " * rnd.randint(1, 40), rnd.choice(["en", "ar", None]), rnd.choice(["a"] * 8 + ["b"]), "t") for k in range(900)]
    docs += [(1000, None, "en", "a", None), (1001, "", "en", "a", None), (1002, "x", "en", None, None), (1003, "x y", "en", "other", None), (None, "x", None, "a", None), (1004, "long " * 20_000, None, "c", None)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, LANG string")
    targets = spark.createDataFrame([("a", 0.6, 1), ("b", 0.3, 3), ("gone", 0.1, 2), (None, 0.5, 1), ("c", None, 1)], "source string, target_share double, max_repeats int")
    drawn = M.mixed(df, targets).collect()
    assert {r["source"] for r in drawn} == {"a", "b"} and all(1 <= r["copies"] <= (1 if r["source"] == "a" else 3) for r in drawn)
    assert len({r["doc_id"] for r in drawn}) == len(drawn) and not {1000, 1001, 1002, 1003} & {r["doc_id"] for r in drawn}
    sums = {s: sum(r["tokens"] * r["copies"] for r in drawn if r["source"] == s) for s in "ab"}
    assert sums["b"] / sum(sums.values()) == pytest.approx(1 / 3, abs=0.02)
    assert {tuple(r) for r in M.mixed(df, targets).collect()} == {tuple(r) for r in drawn}
    report = {r["source"]: r for r in M.shares(M.mixed(df, targets), targets).collect()}
    assert report["gone"]["tokens"] == 0 and report["a"]["most_copies"] == 1
    assert M.mixed(df.limit(0), targets).count() == 0 and M.mixed(df, targets.limit(0)).count() == 0


def test_a_total_beyond_what_a_source_can_give(spark):
    rnd = random.Random(8)
    docs = [(k, "word " * rnd.randint(5, 30), rnd.choice(["en", "ar"]), "a" if k < 400 else "b") for k in range(440)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 3)], "source string, target_share double, max_repeats int")
    have = {r["source"]: r["t"] for r in M.expected(df, targets)[0].groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
    total = 2 * (3 * have["b"] + 500)
    drawn = M.mixed(df, targets, total_tokens=total)
    report = {r["source"]: r for r in M.shares(drawn, targets, total).collect()}
    assert report["b"]["tokens"] == 3 * have["b"] and report["b"]["shortfall"] == 500 and report["b"]["most_copies"] == 3
    assert abs(report["a"]["tokens"] - total / 2) <= 40 and report["a"]["shortfall"] <= 40
    small = M.shares(M.mixed(df, targets, total_tokens=have["b"]), targets, have["b"]).collect()
    assert all(abs(r["tokens"] - have["b"] / 2) <= 40 for r in small)
    left = M.marginals(drawn, M.expected(df, targets)[0]).collect()
    assert {(r["dimension"], r["value"]) for r in left} == {("lang", "en"), ("lang", "ar"), ("topic", "message")} and all(abs(r["residual"]) < 0.1 for r in left)
    with pytest.raises(ValueError):
        M.mixed(df, spark.range(M.MAX_SOURCES + 1).selectExpr("cast(id as string) source", "0.1D target_share", "1 max_repeats"))
