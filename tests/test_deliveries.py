import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from qirtas.operators.deliveries import DeliveryIndex, _contained, keep_one, repeated
from qirtas.streaming.deliveries import keep_once, once_within

SCHEMA = "id bigint, batch_id int, channel string, message_id string, at bigint, MESSAGE_ID string, known string"
HOW = dict(channel="channel", identifier="message_id", batch="batch_id", order=["at"], key="id")


def rows():
    rnd = random.Random(5)
    out = [(k, rnd.choice([None, 1, 2, 3, 9]), rnd.choice(["a", "b", None]), rnd.choice([None, "", " x", "x", "X", *map(str, range(40))]), rnd.choice([None, 1, 2]), "other", "yes") for k in range(400)]
    # one message is a third of all rows; one identifier is very long
    return out + [(1000 + k, k % 4, "a", "hot", 7, None, None) for k in range(200)] + [(5000 + k, 2, "a", "l" * 200_000, 1, None, None) for k in range(2)]


def test_repeated_equals_counting(spark):
    data = rows()
    n = Counter((r[2], r[3]) for r in data if r[3] is not None)
    got = {tuple(r) for r in repeated(spark.createDataFrame(data, SCHEMA), **HOW).collect()}
    assert got == {k for k, c in n.items() if c > 1}


def test_keep_one_keeps_every_row_without_identifier_and_one_of_each(spark):
    data = rows()
    got = keep_one(spark.createDataFrame(data, SCHEMA), rounds=5, **HOW)
    assert got.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    got = [tuple(r) for r in got.collect()]
    assert Counter((r[2], r[3]) for r in got if r[3] is not None) == Counter({(r[2], r[3]) for r in data if r[3] is not None})
    assert sorted(r[0] for r in got if r[3] is None) == sorted(r[0] for r in data if r[3] is None)
    assert set(got) <= set(data)
    # the first by batch, then by time, nulls first, then by key: whatever the spans
    kept = {(r[2], r[3]): r[0] for r in got if r[3] is not None}
    for k in {(r[2], r[3]) for r in data if r[3] is not None}:
        assert kept[k] == min((r[1] is not None, r[1] or 0, r[4] is not None, r[4] or 0, r[0]) for r in data if (r[2], r[3]) == k)[4]


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repeated(empty, **HOW).count() == keep_one(empty, **HOW).count() == 0


def test_index_lives_on_and_merges(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    seen, merges = set(), 0
    for k in range(6):
        batch = [(k * 10 + j, "a", str(k * 2 + j)) for j in range(4)]
        index = DeliveryIndex(spark, path, prefixes=5, fan_in=2)
        got = index.ingest(spark.createDataFrame(batch, "id bigint, c string, m string"), F.col("c"), F.col("m"), [], "id").collect()
        assert {r["identifier"]: r["known"] for r in got} == {m: m in seen for _, _, m in batch}
        seen |= {m for _, _, m in batch}
        merges += index.merges
        assert all(len(own) < 2 for own in index.tiers.values())
    # six runs, two of a tier at a time
    assert merges == 4 and sorted(t for t, own in index.tiers.items() if own) == [1, 2]
    assert {i[3:] for r in index._read(index.runs).collect() for i in r["ids"]} == seen


def test_blocks_are_sorted_and_bounded(spark, monkeypatch):
    from qirtas.operators import deliveries

    index = DeliveryIndex(spark, prefixes=3)
    index.ingest(spark.range(1000).select("id", F.lit("c").alias("c"), F.col("id").cast("string").alias("m")), F.col("c"), F.col("m"), [], "id")
    blocks = index._read(index.runs).collect()
    assert all(list(r["ids"]) == sorted(r["ids"]) for r in blocks) and sum(len(r["ids"]) for r in blocks) == 1000
    assert deliveries.prefixes_for(10) == 8 and deliveries.prefixes_for(10**9) == 4000


def test_a_small_batch_reads_its_prefixes_only(spark):
    index = DeliveryIndex(spark, prefixes=16)
    index.ingest(spark.range(2000).select("id", F.lit("c").alias("c"), F.col("id").cast("string").alias("m")), F.col("c"), F.col("m"), [], "id")
    some = index._read(index.runs, [3])
    assert "PartitionFilters: [" in some._jdf.queryExecution().toString() and {r["prefix"] for r in some.collect()} == {3}
    got = index.ingest(spark.createDataFrame([(1, "c", "77"), (2, "c", "new")], "id bigint, c string, m string"), F.col("c"), F.col("m"), [], "id")
    assert {r["identifier"]: r["known"] for r in got.collect()} == {"77": True, "new": False}


@settings(max_examples=50)
@given(st.lists(st.text(max_size=3)), st.lists(st.text(max_size=3)))
def test_binary_search(ids, block):
    import numpy as np

    found = _contained(np.array([*ids, "q"], dtype=object), np.array(sorted(set(block)), dtype=object))
    assert list(found) == [i in set(block) for i in [*ids, "q"]]


@pytest.mark.parametrize("way", ["index", "watermark"])
def test_stream(spark, tmp_path, way):
    for k, batch in enumerate([[(1, "a", "m", 1), (2, "a", "m", 2), (3, "a", None, 3)], [(4, "a", "m", 4), (5, "b", "m", 5), (6, "a", None, 6)]]):
        spark.createDataFrame(batch, "id int, c string, m string, s bigint").withColumn("t", F.timestamp_seconds("s")).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema("id int, c string, m string, s bigint, t timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    if way == "index":
        keep_once(stream, "c", "m", ["t"], "id", f"{tmp_path}/out").awaitTermination()
        got = spark.read.parquet(f"{tmp_path}/out/batch=*")
    else:
        once_within(stream, ["c", "m"], "t", "1 hour").writeStream.format("memory").queryName("once").outputMode("append").trigger(availableNow=True).start().awaitTermination()
        got = spark.table("once")
    got = got.select("id", "c", "m").collect()
    assert sorted(r["id"] for r in got if r["m"] is None) == [3, 6]
    assert sorted((r["c"], r["m"]) for r in got if r["m"]) == [("a", "m"), ("b", "m")]
