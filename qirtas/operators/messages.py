"""Webhook payloads flattened to events, replies formatted, long texts split into parts."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# --- Fixed values -----------------------------------------------------------------------------------------------------
PAYLOAD = (
    "struct<object:string,entry:array<struct<changes:array<struct<field:string,value:struct<contacts:array<struct<wa_id:string,profile:struct<name:string>>>,"
    "messages:array<struct<id:string,`from`:string,type:string,timestamp:string,image:struct<id:string,caption:string,mime_type:string,sha256:string>>>,"
    "statuses:array<struct<id:string,recipient_id:string,status:string>>>>>>>>"
)
OBJECT, FIELD, STATUSES = "whatsapp_business_account", "messages", ("delivered", "read")
EXTENSIONS = {"image/jpeg": ".jpg", "image/png": ".png", "image/webp": ".webp"}
MAX_PART = 4096
# ----------------------------------------------------------------------------------------------------------------------


def events(bodies: DataFrame, body: str = "body", key: str = "body_id", keep_all: bool = True) -> DataFrame:
    """key, place, kind (image, delivered, read), message_id, party_id, party_name, media_ref, caption, mime_type, filename,
    sha256, sent_at of the events in JSON bodies.

    keep_all=False: only the first event of a body, messages of a value before its statuses. Bodies that are not JSON, of
    another object or without known events give none; images without id or sender are none.
    """
    value = bodies.select(key, F.from_json(body, PAYLOAD).alias("p")).where(F.col("p.object") == OBJECT).select(key, F.posexplode("p.entry").alias("e", "entry")).select(key, "e", F.posexplode("entry.changes").alias("c", "change")).where(F.col("change.field") == FIELD)
    at = lambda kind: F.struct(F.col("e"), F.col("c"), F.lit(kind).alias("k"), F.col("i")).alias("place")
    m = value.select(key, "e", "c", F.col("change.value.contacts").alias("contacts"), F.posexplode("change.value.messages").alias("i", "m")).where((F.col("m.type") == "image") & (F.col("m.image.id") != "") & (F.col("m.from") != ""))
    who = F.get(F.filter(F.coalesce("contacts", F.array().cast("array<struct<wa_id:string,profile:struct<name:string>>>")), lambda x: x["wa_id"] == F.col("m.from")), 0)
    ext = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv]), F.col("m.image.mime_type")), F.lit(""))
    images = m.select(
        key, at(0), F.lit("image").alias("kind"), F.col("m.id").alias("message_id"), F.col("m.from").alias("party_id"), who["profile"]["name"].alias("party_name"), F.col("m.image.id").alias("media_ref"), F.col("m.image.caption").alias("caption"),
        F.col("m.image.mime_type").alias("mime_type"), F.concat(F.col("m.image.id"), ext).alias("filename"), F.col("m.image.sha256").alias("sha256"), F.timestamp_seconds(F.col("m.timestamp").try_cast("bigint")).alias("sent_at"),
    )
    s = value.select(key, "e", "c", F.posexplode("change.value.statuses").alias("i", "s")).where(F.col("s.status").isin(*STATUSES) & (F.col("s.id") != "") & (F.col("s.recipient_id") != ""))
    states = s.select(key, at(1), F.col("s.status").alias("kind"), F.col("s.id").alias("message_id"), F.col("s.recipient_id").alias("party_id"))
    every = images.unionByName(states, allowMissingColumns=True)
    if keep_all:
        return every
    return every.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy("place"))).where("_r = 1").drop("_r")


def signed(bodies: DataFrame, secret: str | None, body: str = "body", signature: str = "signature") -> DataFrame:
    """Bodies whose signature is the hex HMAC-SHA256 of the body, after the last `=`; without a secret none are."""

    def verify(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, signs in batches:
            yield pd.Series([bool(secret and t is not None and s) and hmac.compare_digest(hmac.new(secret.encode(), t.encode(), hashlib.sha256).hexdigest().encode(), s.rpartition("=")[2].encode()) for t, s in zip(texts, signs)], dtype=bool)

    return bodies.where(F.pandas_udf(verify, "boolean")(F.col(body), F.col(signature)))


def shown_date(c: Column) -> Column:
    """An ISO date or time as it is read: 24 Sep 2026, 10:11 PM; what is none stays as it is."""
    at = F.coalesce(F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss")), F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm")), F.try_to_timestamp(c, F.lit("yyyy-MM-dd")))
    return F.when(at.isNull(), c).when(c.contains("T"), F.date_format(at, "d MMM yyyy, h:mm a")).otherwise(F.date_format(at, "d MMM yyyy"))


def reply(provider: Column, status: Column, kind: Column, sums: dict[str, Column], currency: Column, reference: Column, date: Column, note: Column, parties: dict[str, list[Column]]) -> Column:
    """The lines of a reply in order; null if neither amount nor total nor reference is known. sums: Amount, Fees, Total. date: as
    ISO text. parties: From and To with their values in order."""
    line = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f"{name}: "), c.cast("string")))
    lines = [line("Provider", provider), line("Status", status), line("Type", kind)]
    lines += [F.when(c.isNotNull(), F.concat_ws(" ", line(name, c), currency)) for name, c in sums.items()]
    lines += [line("Reference", reference), line("Date", shown_date(date)), line("Note", note)]
    lines += [line(name, F.nullif(F.concat_ws(", ", *values), F.lit(""))) for name, values in parties.items()]
    known = F.coalesce(sums["Amount"].cast("string"), sums["Total"].cast("string"), reference)
    return F.when(known.isNotNull(), F.concat_ws("\n", F.lit("*Transaction details*"), *lines))


def parts_of(text: str, most: int = MAX_PART) -> list[str]:
    """A text in parts of at most `most` characters: cut at the last line break that fits, else at the last space, else hard."""
    out, at, end = [], 0, len(text)
    while True:
        while at < end and text[at].isspace():
            at += 1
        if end - at <= most:
            last = text[at:end].rstrip()
            return [*out, last] if last else out
        cut = max(text.rfind("\n", at + 1, at + most), -1)
        cut = cut if cut > at else text.rfind(" ", at + 1, at + most)
        cut = cut if cut > at else at + most
        out.append(text[at:cut].rstrip())
        at = cut


def parts(texts: DataFrame, key: str, text: str, most: int = MAX_PART) -> DataFrame:
    """key, part (from 0), of, body: the parts of each text; null and blank texts have none."""

    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([parts_of(t, most) for t in b])

    # only texts that may need a cut leave the JVM
    whole = F.array(F.trim(F.col(text), F.lit(" \t\n\r\x0b\x0c")))
    short = texts.where(F.length(text) <= most).select(key, whole.alias("p"))
    long = texts.where(F.length(text) > most).select(key, F.pandas_udf(split, "array<string>")(F.col(text)).alias("p"))
    return short.unionByName(long).select(key, F.size("p").alias("of"), F.posexplode("p").alias("part", "body")).where("body != ''").select(key, "part", "of", "body")
