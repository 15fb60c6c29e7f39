"""Redeliveries in a stream: exact with an index of everything seen, or within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from qirtas.operators.deliveries import DeliveryIndex
from qirtas.runtime import new_path


def once_within(stream: DataFrame, keys: list[str], event_time: str, delay: str) -> DataFrame:
    """The stream without repetitions of keys within the watermark; rows with a null key all pass. State is bounded."""
    whole = None
    for k in keys:
        whole = F.col(k).isNotNull() if whole is None else whole & F.col(k).isNotNull()
    # a null identifier is no identifier: such rows get one of their own
    own = F.when(~whole, F.concat_ws("~", F.lit("row"), F.uuid()))
    marked = stream.withColumn(event_time, F.col(event_time).cast("timestamp")).withColumn("_own", own).withWatermark(event_time, delay)
    return marked.dropDuplicatesWithinWatermark([*keys, "_own"]).drop("_own")


def keep_once(stream: DataFrame, channel: str, identifier: str, order: list[str], key: str, out: str, index: DeliveryIndex | None = None) -> StreamingQuery:
    """Write each message of the stream once to `out`, whenever its first copy came: exact, without a horizon.

    A micro-batch writes to its own folder `out/batch=<id>` before its identifiers count as seen, and is skipped if they
    do: a batch that is run again neither loses nor repeats rows. To go on after a restart give an index with a path.
    """
    index = index or DeliveryIndex(stream.sparkSession)

    def batch(rows: DataFrame, number: int) -> None:
        if number in index.batches:
            return
        rows = rows.persist()
        try:
            seen = index.look_up(rows, F.col(channel), F.col(identifier), [F.col(o) for o in order], key)
            first = seen.where(~F.col("known")).select(F.col(key).alias("_first"))
            novel = rows.where(F.col(identifier).isNotNull()).join(first, F.col(key) == F.col("_first"), "left_semi")
            rows.where(F.col(identifier).isNull()).unionByName(novel).write.mode("overwrite").parquet(f"{out}/batch={number}")
            index.add(seen, number)
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", new_path(stream.sparkSession, "stream")).trigger(availableNow=True).start()
