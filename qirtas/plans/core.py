"""Queries pN_ of the general operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qirtas.operators import deliveries, timestamps
from qirtas.runtime import table

#: Table, identifier, order in which copies arrived, unique key.
_DELIVERED = [("image_messages", "provider_message_id", ["received_at"], "delivery_id"), ("receipt_transactions", "message_id", ["created_at"], "id")]


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    found = [
        deliveries.repeated(table(spark, folder, t), "channel", i, "batch_id", o, k).select(F.lit(t).alias("source_table"), "channel", F.col("identifier").alias("message_id"))
        for t, i, o, k in _DELIVERED
    ]
    return found[0].unionByName(found[1])


def p5_keep_image_messages(spark: SparkSession, folder: str) -> DataFrame:
    t, i, o, k = _DELIVERED[0]
    return deliveries.keep_one(table(spark, folder, t), "channel", i, "batch_id", o, k).select("delivery_id", "batch_id", "channel", "provider_message_id", "sender_id")


def p5_keep_transactions(spark: SparkSession, folder: str) -> DataFrame:
    t, i, o, k = _DELIVERED[1]
    return deliveries.keep_one(table(spark, folder, t), "channel", i, "batch_id", o, k).select("id", "batch_id", "channel", "message_id", "extraction_status")


def p6_values(spark: SparkSession, folder: str) -> DataFrame:
    """receipt_id, field, value, normal of every value that states a day."""
    r = table(spark, folder, "receipts")
    values = r.select("receipt_id", "conversation_id", "tz_name", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("date", "date_iso")])).alias("v")).select("receipt_id", "conversation_id", "tz_name", "v.field", "v.value").where("value is not null")
    return timestamps.normalised(values, "value", "tz_name", ["field", "conversation_id"], ["receipt_id"], ["receipt_id", "field"])


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return p6_values(spark, folder).where(F.col("value") != F.col("normal")).select("receipt_id", "field", "normal").distinct()


QUERIES = {"p5_found": p5_found, "p5_keep_image_messages": p5_keep_image_messages, "p5_keep_transactions": p5_keep_transactions, "p6_found": p6_found}


def _keep_sql(t: str, identifier: str, order: str, key: str, columns: str) -> str:
    return f"""
    WITH ranked AS (
      SELECT *, row_number() OVER (PARTITION BY channel, {identifier} ORDER BY batch_id NULLS FIRST, {order} NULLS FIRST, {key}) AS rn FROM {t})
    SELECT {columns} FROM ranked WHERE {identifier} IS NULL OR rn = 1"""


ORACLE = {
    "p5_found": """
      SELECT 'image_messages' AS source_table, channel, provider_message_id AS message_id FROM image_messages
      WHERE provider_message_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1
      UNION ALL
      SELECT 'receipt_transactions', channel, message_id FROM receipt_transactions
      WHERE message_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1""",
    "p5_keep_image_messages": _keep_sql("image_messages", "provider_message_id", "received_at", "delivery_id", "delivery_id, batch_id, channel, provider_message_id, sender_id"),
    "p5_keep_transactions": _keep_sql("receipt_transactions", "message_id", "created_at", "id", "id, batch_id, channel, message_id, extraction_status"),
}
