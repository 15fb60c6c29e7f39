"""The transactions table: pending rows merged with results, duplicates, nested leftovers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qirtas.functions import values as V

LEFTOVERS = "struct<unmapped:array<struct<text:string,type:string>>>"


def merged(pending: DataFrame, results: DataFrame, key: list[str], keep: list[str], take: list[str]) -> DataFrame:
    """Upsert: one row per key of either side; `keep` columns come from pending, `take` from results where it has the key,
    else from pending if it has such a column. Null keys never match. Plain files have no MERGE: the table is rewritten."""
    p = pending.select(*[F.col(c).alias(f"p_{c}") for c in pending.columns])
    on = None
    for k in key:
        c = F.col(f"p_{k}") == results[k]
        on = c if on is None else on & c
    both = p.join(results, on, "full")
    old = lambda c: F.coalesce(results[c], F.col(f"p_{c}")) if c in pending.columns else results[c]
    return both.select(*[F.coalesce(F.col(f"p_{k}"), results[k]).alias(k) for k in key], *[F.col(f"p_{c}").alias(c) for c in keep], *[old(c).alias(c) for c in take])


def repeated_by(rows: DataFrame, columns: list[str], key: str) -> DataFrame:
    """columns, copies, first key of the groups of rows equal in all columns, none of them null: possible duplicates."""
    whole = None
    for c in columns:
        whole = F.col(c).isNotNull() if whole is None else whole & F.col(c).isNotNull()
    return rows.where(whole).groupBy(*columns).agg(F.count(F.lit(1)).alias("copies"), F.min(key).alias("first")).where("copies > 1")


def leftovers(rows: DataFrame, key: str, column: str = "other_data") -> DataFrame:
    """key, pos, text, type of the unmapped lines that a JSON column holds; malformed JSON has none."""
    parsed = F.from_json(F.col(column), LEFTOVERS)
    return rows.where(F.col(column).isNotNull()).select(key, F.posexplode(parsed["unmapped"]).alias("pos", "u")).select(key, "pos", "u.text", "u.type")


def address_columns(rows: DataFrame, column: str) -> DataFrame:
    """rows with `email` where the column is an address with a dotted host, else `account`."""
    dotted = V.is_dotted(F.col(column))
    return rows.withColumn("email", F.when(dotted, F.col(column))).withColumn("account", F.when(~dotted, F.col(column)))


def flat_parties(parties: DataFrame, fields: list[str], key: str = "receipt_id", side: str = "side") -> DataFrame:
    """One row per key with <side>_<field> columns for sender and receiver; of several rows of a side the first party_id."""
    first = lambda s, f: F.min_by(f, F.when(F.col(side) == s, F.col("party_id"))).alias(f"{s}_{f}")
    return parties.groupBy(key).agg(*[first(s, f) for s in ("sender", "receiver") for f in fields])


PARTY_COLUMNS = ("name", "phone", "email", "account", "bank")


def result_columns(results: DataFrame, key: str = "receipt_id") -> DataFrame:
    """Extraction results as columns of the store: key, extraction_status (extracted if amount, total or reference is known, else
    no_data), the plain fields, the columns of both parties (an account that is an e-mail address is one), and what has no
    column as JSON in other_data: via and further values of a party, and the leftovers that have a type; null if nothing is left."""
    found = F.coalesce(F.col("amount").cast("string"), F.col("total").cast("string"), F.col("reference"))
    columns, extra = [], []
    for side in ("sender", "receiver"):
        dotted = F.coalesce(V.is_dotted(F.col(f"{side}.account")), F.lit(False))
        of = {c: F.col(f"{side}.{c}") for c in ("name", "phone", "bank")} | {"email": F.when(dotted, F.col(f"{side}.account")), "account": F.when(~dotted, F.col(f"{side}.account"))}
        columns += [of[c].alias(f"{side}_{c}") for c in PARTY_COLUMNS]
        via, other = F.col(f"{side}.via"), F.col(f"{side}.other")
        extra.append(F.when(via.isNotNull() | other.isNotNull(), F.struct(via.alias("via"), other.alias("other"))).alias(side))
    typed = F.transform(F.filter("unmapped", lambda u: u["type"].isNotNull()), lambda u: F.struct(u["text"].alias("text"), u["type"].alias("type")))
    extra.append(F.when(F.size(typed) > 0, typed).alias("unmapped"))
    return results.select(
        key, F.when(found.isNotNull(), "extracted").otherwise("no_data").alias("extraction_status"), F.lit(None).cast("string").alias("error"), "provider", F.col("status").alias("transfer_status"), F.col("type").alias("transfer_type"),
        "amount", "fees", "total", "currency", F.col("reference").alias("reference_id"), F.col("datetime").alias("date"), F.col("note").alias("notes"), *columns, F.nullif(F.to_json(F.struct(*extra)), F.lit("{}")).alias("other_data"),
    )


def failures(errors: DataFrame, key: str = "receipt_id", error: str = "error") -> DataFrame:
    """key, extraction_status, error of receipts whose image could not be had or read; to be merged like results."""
    return errors.select(key, F.lit("failed").alias("extraction_status"), F.col(error).alias("error"))
