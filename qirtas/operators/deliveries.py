"""Messages delivered at least once: keep exactly one copy of each, across batches.

The identifiers seen so far are an index of immutable runs. A run holds, for each hash prefix, blocks of identifiers as
sorted arrays. An incoming batch is aggregated by identifier (with map-side combine, so that one identifier that holds a
third of all rows leaves each task as one row), and each prefix of the batch is binary-searched in the blocks of that
prefix, which stream past one at a time. What is novel becomes a new run of tier 0; `fan_in` runs of one tier are merged
into one of the next, so that an identifier is rewritten about as often as there are tiers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qirtas.runtime import new_path, only, written

RUN_SCHEMA = "prefix int, ids array<string>"
#: Identifiers in one sorted array: about 2 MB of strings; and of one batch in one hash prefix, which one task holds.
BLOCK_IDS, PREFIX_IDS = 50_000, 250_000
#: Spans in which a stored table is replayed.
ROUNDS = 4
_SEPARATOR = "\x1f"


def _contained(ids: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Which ids the sorted block has, by binary search."""
    if not len(block):
        return np.zeros(len(ids), dtype=bool)
    at = np.minimum(np.searchsorted(block, ids), len(block) - 1)
    return block[at] == ids


class DeliveryIndex:
    """Identifiers that were delivered, as immutable runs of sorted arrays by hash prefix.

    prefixes: number of hash prefixes. It is fixed for the life of an index: a prefix's identifiers of one batch are held by
    one task, so choose about (identifiers expected in a batch) / PREFIX_IDS; `prefixes_for` does. Blocks of the index are
    streamed: how much was delivered before does not matter.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, prefixes: int = 64, fan_in: int = 4):
        """path: where the index lives; one that exists there already is gone on with. Without it the index is a new one
        for this session."""
        self.spark, self.prefixes, self.fan_in = spark, prefixes, fan_in
        self.lasting = path is not None
        self.path = (path or new_path(spark, "deliveries")).rstrip("/")
        #: tier -> paths of its runs
        self.tiers: dict[int, list[str]] = {}
        self.batches: set[int] = set()
        self._made = self._saved = self.merges = 0
        if self.lasting:
            self._load()

    @property
    def runs(self) -> list[str]:
        return [r for tier in sorted(self.tiers) for r in self.tiers[tier]]

    def _load(self) -> None:
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        found = hadoop.Path(f"{self.path}/manifest-*/_SUCCESS")
        fs = found.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = sorted(x.getPath().getParent().getName() for x in fs.globStatus(found) or [])
        if names:
            row = self.spark.read.schema("runs array<struct<tier:int,path:string>>, batches array<bigint>, made int, prefixes int").json(f"{self.path}/{names[-1]}").first()
            for r in row["runs"]:
                self.tiers.setdefault(r["tier"], []).append(r["path"])
            self.batches, self._made, self._saved, self.prefixes = set(row["batches"]), row["made"], int(names[-1][9:]), row["prefixes"]

    def _save(self) -> None:
        """Write what the index consists of; a manifest is never changed, the last whole one counts."""
        if self.lasting:
            self._saved += 1
            runs = [(tier, r) for tier in sorted(self.tiers) for r in self.tiers[tier]]
            row = self.spark.createDataFrame([(runs, sorted(self.batches), self._made, self.prefixes)], "runs array<struct<tier:int,path:string>>, batches array<bigint>, made int, prefixes int")
            row.coalesce(1).write.mode("overwrite").json(f"{self.path}/manifest-{self._saved:08d}")

    def _run_path(self) -> str:
        self._made += 1
        return f"{self.path}/run-{self._made:06d}"

    def _read(self, runs: list[str], prefixes: list[int] | None = None) -> DataFrame:
        """The blocks of runs; only the folders of the given prefixes are read."""
        rows = self.spark.read.schema("ids array<string>, prefix int").parquet(*runs) if len(runs) == 1 else _union([self.spark.read.schema("ids array<string>, prefix int").parquet(r) for r in runs])
        rows = rows.select("prefix", "ids")
        return rows.where(F.col("prefix").isin(prefixes)) if prefixes is not None else rows

    def _write(self, ids: DataFrame, tier: int) -> None:
        """ids(prefix int, full_id string), distinct -> a run of sorted blocks, one folder a prefix."""

        def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            at, own = -1, []
            for b in batches:
                for prefix, full_id in zip(b["prefix"], b["full_id"]):
                    if own and (prefix != at or len(own) >= BLOCK_IDS):
                        yield pd.DataFrame({"prefix": [at], "ids": [own]})
                        own = []
                    at = prefix
                    own.append(full_id)
            if own:
                yield pd.DataFrame({"prefix": [at], "ids": [own]})

        path = self._run_path()
        ordered = ids.repartition(min(self.prefixes, _width(self.spark)), "prefix").sortWithinPartitions("prefix", "full_id")
        ordered.mapInPandas(blocks, RUN_SCHEMA).write.mode("overwrite").partitionBy("prefix").parquet(path)
        if self.spark.read.schema("ids array<string>, prefix int").parquet(path).isEmpty():
            return
        self.tiers.setdefault(tier, []).append(path)

    def merge_runs(self) -> None:
        """Merge every tier that has fan_in runs into one run of the next. The old runs are kept: a reader may still use them."""
        tier = 0
        while tier <= max(self.tiers, default=-1):
            own = self.tiers.get(tier, [])
            if len(own) >= self.fan_in:
                self._write(self._read(own).select("prefix", F.explode("ids").alias("full_id")), tier + 1)
                self.tiers[tier] = []
                self.merges += 1
            tier += 1

    def ingest(self, rows: DataFrame, channel: Column, identifier: Column, order: list[Column], key: str) -> DataFrame:
        """look_up, then add: for batches whose result needs no writing before they count as seen."""
        seen = self.look_up(rows, channel, identifier, order, key)
        self.add(seen)
        return seen.drop("prefix", "full_id")

    def add(self, seen: DataFrame, batch: int | None = None) -> None:
        """Make the novel identifiers of a look_up known. batch: its number, remembered in self.batches."""
        self._write(seen.where(~F.col("known")).select("prefix", "full_id"), 0)
        self.merge_runs()
        if batch is not None:
            self.batches.add(batch)
        self._save()

    def look_up(self, rows: DataFrame, channel: Column, identifier: Column, order: list[Column], key: str) -> DataFrame:
        """One row per identifier of a batch: channel, identifier, n (copies in the batch), known (delivered in an earlier
        batch), and key of the copy that comes first by order, nulls first, then by key; stored, with prefix and full_id.

        Rows with a null identifier are not in the result: nothing says that they are copies. A null channel is a channel
        of its own. Identifiers are compared exactly, the empty one included.
        """
        full = F.concat(F.coalesce(F.concat(F.lit("1"), channel), F.lit("0")), F.lit(_SEPARATOR), identifier)
        keyed = (
            rows.where(identifier.isNotNull())
            .select(full.alias("full_id"), channel.alias("channel"), identifier.alias("identifier"), F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)], F.col(key).alias("key")).alias("first"))
            .groupBy("full_id", "channel", "identifier")
            .agg(F.count(F.lit(1)).alias("n"), F.min("first").getField("key").alias(key))
            .select(F.pmod(F.xxhash64("full_id"), F.lit(self.prefixes)).cast("int").alias("prefix"), "*")
        )
        path = new_path(self.spark, "batch")
        if not self.runs:
            keyed.withColumn("known", F.lit(False)).write.parquet(path)
            return self.spark.read.parquet(path)
        # a small batch needs few prefixes of the index: only their folders are read
        keyed = written(keyed, "keyed")
        needed = [r["prefix"] for r in keyed.select("prefix").distinct().limit(self.prefixes).collect()]
        index = self._read(self.runs, needed if len(needed) < self.prefixes else None)
        names = keyed.columns
        asked = keyed.select("prefix", F.lit(0).alias("part"), F.lit(None).cast("array<string>").alias("ids"), F.struct(*names[1:]).alias("row"))
        known = index.select("prefix", F.lit(1).alias("part"), "ids", F.lit(None).cast(asked.schema["row"].dataType).alias("row"))
        both = asked.unionByName(known).repartition(min(self.prefixes, _width(self.spark)), "prefix").sortWithinPartitions("prefix", "part")
        told = both.select("prefix", "part", "ids", F.col("row.full_id").alias("full_id")).mapInPandas(_searched, "prefix int, full_id string, known boolean")
        keyed.join(told.where("known").select("full_id").withColumn("_known", F.lit(True)), "full_id", "left").select(*names, F.coalesce("_known", F.lit(False)).alias("known")).write.parquet(path)
        return self.spark.read.parquet(path)


def _width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _searched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each prefix its asked identifiers (part 0), then the index's blocks (part 1), one in memory at a time."""
    at, parts, known, ids = None, [], np.zeros(0, dtype=bool), np.empty(0, dtype=object)

    def told() -> pd.DataFrame:
        return pd.DataFrame({"prefix": np.full(known.sum(), at), "full_id": ids[known], "known": True})

    for b in batches:
        for prefix, own in b.groupby("prefix", sort=False):
            if prefix != at:
                if at is not None and known.any():
                    yield told()
                at, parts, ids, known = prefix, [], np.empty(0, dtype=object), np.zeros(0, dtype=bool)
            asked = own.loc[own["part"] == 0, "full_id"]
            if len(asked):
                parts.append(asked.to_numpy(dtype=object))
            for block in own.loc[own["part"] == 1, "ids"]:
                if parts:
                    ids = np.sort(np.concatenate(parts))
                    parts, known = [], np.zeros(len(ids), dtype=bool)
                if len(ids):
                    known |= _contained(ids, np.asarray(block, dtype=object))
    if at is not None and known.any():
        yield told()


def prefixes_for(ids: int) -> int:
    """Hash prefixes so that one of a batch of so many identifiers fits a task."""
    return max(8, -(-ids // PREFIX_IDS))


def batch_rounds(rows: DataFrame, batch: str, rounds: int) -> tuple[list[Column], int]:
    """Conditions that split the batches of a stored table into at most `rounds` consecutive spans, all rows in exactly one;
    and the mean number of rows of a span."""
    low, high, n = rows.agg(F.min(batch), F.max(batch), F.count(F.lit(1))).first()
    if low is None:
        return [F.lit(True)], n
    step = max(1, -(-(high - low + 1) // rounds))
    spans = [F.col(batch).between(s, s + step - 1) for s in range(low, high + 1, step)]
    return [spans[0] | F.col(batch).isNull(), *spans[1:]], -(-n // len(spans))


def replay(rows: DataFrame, channel: str, identifier: str, batch: str, order: list[str], key: str, rounds: int = ROUNDS, fan_in: int = 3) -> DataFrame:
    """Replay a stored table of deliveries through a new index, in spans of batches as they came.

    Returns channel, identifier, n, known, key: one row per identifier and span in which it was delivered; key is the row
    to keep if not known: the first by batch (nulls first), then by order, then the smaller key. What is kept does not
    depend on the spans. An empty table gives no rows.
    """
    rows = only(rows, *dict.fromkeys([channel, identifier, batch, *order, key]))
    spans, each = batch_rounds(rows, batch, rounds)
    index = DeliveryIndex(rows.sparkSession, prefixes=prefixes_for(each), fan_in=fan_in)
    seen = [index.ingest(rows.where(span), F.col(channel), F.col(identifier), [F.col(o) for o in (batch, *order)], key).select("channel", "identifier", "n", "known", key) for span in spans]
    return _union(seen)


def keep_one(rows: DataFrame, channel: str, identifier: str, batch: str, order: list[str], key: str, **how: int) -> DataFrame:
    """All columns of exactly one row of each (channel, identifier), and of every row whose identifier is null.

    key: a unique, non-null column. The row kept is the first by batch (nulls first), then by order (nulls first), then by key.
    """
    kept = replay(rows, channel, identifier, batch, order, key, **how).where(~F.col("known")).select(F.col(key).alias("kept key"))
    # by place, for other columns may have the same names
    plain = rows.toDF(*[f"c{i}" for i in range(len(rows.columns))])
    k, i = (F.col(f"c{rows.columns.index(c)}") for c in (key, identifier))
    out = plain.where(i.isNull()).unionByName(plain.where(i.isNotNull()).join(kept, k == F.col("kept key"), "left_semi"))
    return out.toDF(*rows.columns)


def repeated(rows: DataFrame, channel: str, identifier: str, batch: str, order: list[str], key: str, **how: int) -> DataFrame:
    """channel, identifier of each message that was delivered more than once, in one batch or several."""
    return replay(rows, channel, identifier, batch, order, key, **how).where((F.col("n") > 1) | F.col("known")).select("channel", "identifier").distinct()
