"""Queries over receipts, messages and their stores, each over whole tables, with the same result in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qirtas.functions import text as T
from qirtas.functions import values as V
from qirtas.functions.vocabulary import CURRENCIES, STATUS_WORDS, keyword_rows, label_rows, norm
from qirtas.operators import closest, extract, labels, layout, messages, readings, statistics, store
from qirtas.runtime import new_path, table
from qirtas.sources import files
from qirtas.streaming import deliveries as stream_deliveries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_DIGITS = f"translate(%s, {_sql(T.DIGITS_FROM)}, {_sql(T.DIGITS_TO)})"
_NORM = f"trim(regexp_replace(translate(regexp_replace(lower(%s), '[\\u064B-\\u0652\\u0640]', '', 'g'), {_sql(T.LETTERS_FROM)}, {_sql(T.LETTERS_TO)}), '[^\\pL\\pN_&]+', ' ', 'g'))".replace("\\u064B-\\u0652\\u0640", "ً-ْـ")
_LABELS = ", ".join(f"({_sql(n)}, {_sql(k)}, {_sql(t)}, {o})" for n, k, t, o in label_rows())


# --- text and values --------------------------------------------------------------------------------------------------
@query(f"SELECT receipt_id, line_no, {_NORM % 'text'} AS norm FROM ocr_lines")
def text_norm(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "ocr_lines").select("receipt_id", "line_no", T.norm(F.col("text")).alias("norm"))


@query("""SELECT receipt_id, line_no, len(regexp_extract_all(text, '[ء-ي]')) AS arabic, len(regexp_extract_all(text, '[A-Za-z]')) AS latin FROM ocr_lines WHERE text IS NOT NULL""")
def text_scripts(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "ocr_lines").where("text is not null")
    return rows.select("receipt_id", "line_no", T.arabic_letters(F.col("text")).cast("bigint").alias("arabic"), T.latin_letters(F.col("text")).cast("bigint").alias("latin"))


_TOKENS = sorted({t.lower() for ts in CURRENCIES.values() for t in ts}, key=lambda t: (-len(t), t))


@query()
def money_parse(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "ocr_lines").select("receipt_id", "line_no", V.money(F.col("text")).alias("m")).where("m is not null")
    return rows.select("receipt_id", "line_no", F.col("m.value").cast("double").alias("value"), "m.currency")


@query("""
  SELECT receipt_id,
    CAST(CASE WHEN amount IS NULL AND fees IS NOT NULL AND total IS NOT NULL THEN total - fees ELSE amount END AS DOUBLE) AS amount,
    CAST(CASE WHEN amount IS NOT NULL AND fees IS NOT NULL AND total IS NOT NULL AND abs(amount + fees - total) > 0.01 AND abs(amount - total) <= 0.01 THEN 0
         WHEN fees IS NULL AND amount IS NOT NULL AND total >= amount THEN total - amount ELSE fees END AS DOUBLE) AS fees,
    CAST(CASE WHEN total IS NULL AND amount IS NOT NULL AND fees IS NOT NULL THEN amount + fees ELSE total END AS DOUBLE) AS total,
    CASE WHEN amount IS NOT NULL AND fees IS NOT NULL AND total IS NOT NULL THEN NULL WHEN amount IS NOT NULL AND fees IS NOT NULL THEN 'total'
         WHEN amount IS NOT NULL AND total >= amount THEN 'fees' WHEN amount IS NULL AND fees IS NOT NULL AND total IS NOT NULL THEN 'amount' END AS derived,
    CASE WHEN abs(amount + fees - total) > 0.01 THEN CASE WHEN abs(amount - total) <= 0.01 THEN 'fees zeroed' ELSE 'sums differ' END END AS warning
  FROM receipts""")
def money_crosscheck(spark: SparkSession, folder: str) -> DataFrame:
    r = table(spark, folder, "receipts")
    return r.select("receipt_id", V.cross_check(F.col("amount"), F.col("fees"), F.col("total")).alias("c")).select("receipt_id", *[F.col(f"c.{x}").cast("double").alias(x) for x in ("amount", "fees", "total")], "c.derived", "c.warning")


@query(f"""
  WITH t AS (SELECT party_id, {_DIGITS % 'phone'} AS p FROM parties WHERE phone IS NOT NULL),
  m AS (SELECT party_id, coalesce(nullif(regexp_extract(p, '(?:^|[^0-9])(?:\\+?20|0020)?0?(1[0125][0-9]{{8}})(?:$|[^0-9])', 1), ''),
       nullif(regexp_extract(regexp_replace(p, '[\\s().\\-]', '', 'g'), '(?:^|[^0-9])(?:\\+?20|0020)?0?(1[0125][0-9]{{8}})(?:$|[^0-9])', 1), '')) AS d FROM t)
  SELECT party_id, '0' || d AS phone FROM m WHERE d IS NOT NULL""")
def phone_canonical(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "parties").select("party_id", V.phone(F.col("phone")).alias("phone")).where("phone is not null")


@query("""
  WITH t AS (SELECT doc_id, lower(regexp_replace(nullif(regexp_extract(text, '[A-Za-z0-9._%+\\-]+\\s?@\\s?[A-Za-z0-9\\-]+(?:\\.[A-Za-z0-9\\-]+)*', 0), ''), '\\s', '', 'g')) AS a FROM documents)
  SELECT doc_id, CASE WHEN d THEN a END AS email, CASE WHEN NOT d THEN a END AS account
  FROM (SELECT *, regexp_matches(a, '^[^@\\s]+@[^@\\s.]+(?:\\.[^@\\s.]+)+$') AS d FROM t) WHERE a IS NOT NULL""")
def email_or_handle(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select("doc_id", V.email(F.col("text")).alias("a")).where("a is not null")
    return store.address_columns(rows, "a").select("doc_id", "email", "account")


@query(f"""
  WITH r AS (SELECT receipt_id, line_no, list_filter(list_transform(regexp_extract_all({_DIGITS % 'text'}, '[A-Za-z0-9\\-]{{4,}}'), lambda x: trim(x, '-')), lambda x: len(x) >= 4) AS runs FROM ocr_lines WHERE text IS NOT NULL)
  SELECT receipt_id, line_no, list_filter(runs, lambda x: len(x) = list_max(list_transform(runs, lambda y: len(y))))[1] AS reference FROM r WHERE len(runs) > 0""")
def reference_longest(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "ocr_lines").where("text is not null")
    return rows.select("receipt_id", "line_no", V.reference(F.col("text")).alias("reference")).where("reference is not null")


@query()
def value_kinds(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "ocr_lines").select("receipt_id", "line_no", F.posexplode(V.classify(F.col("text"))).alias("pos", "v"))
    return rows.select("receipt_id", "line_no", "pos", "v.slot", "v.value")


# --- vocabulary -------------------------------------------------------------------------------------------------------
@query(f"SELECT receipt_id, line_no, kind, target FROM ocr_lines JOIN (VALUES {_LABELS}) AS l(label, kind, target, ord) ON {_NORM % 'text'} = label")
def label_exact(spark: SparkSession, folder: str) -> DataFrame:
    return labels.exact(table(spark, folder, "ocr_lines").select("receipt_id", "line_no", "text")).where("kind is not null").select("receipt_id", "line_no", "kind", "target")


@query()
def label_any(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "ocr_lines").select("receipt_id", "line_no", T.clean(F.col("text")).alias("text"))
    return labels.labelled(rows, ["receipt_id", "line_no"]).where("kind is not null").select("receipt_id", "line_no", "kind", "target", "inline")


_STATUS = " ".join("WHEN " + " OR ".join(f"contains(said, {_sql(' ' + k + ' ')})" for s, k, _ in keyword_rows(STATUS_WORDS) if s == status) + f" THEN {_sql(status)}" for status in STATUS_WORDS)


@query(f"WITH t AS (SELECT receipt_id, ' ' || string_agg({_NORM % 'text'}, ' ' ORDER BY line_no) || ' ' AS said FROM ocr_lines WHERE text IS NOT NULL GROUP BY receipt_id) SELECT receipt_id, CASE {_STATUS} END AS status FROM t")
def status_of_receipt(spark: SparkSession, folder: str) -> DataFrame:
    said = table(spark, folder, "ocr_lines").where("text is not null").groupBy("receipt_id").agg(F.array_sort(F.collect_list(F.struct("line_no", T.norm(F.col("text")).alias("n")))).alias("l"))
    return said.select("receipt_id", extract.status_of(F.array_join(F.transform("l", lambda x: x["n"]), " ")).alias("status"))


@query(f"""
  WITH k AS (SELECT canon_id, unnest([{_NORM % 'name_en'}, {_NORM % 'name_ar'}]) AS keyword FROM canon_values WHERE field = 'provider'),
  hits AS (SELECT receipt_id, canon_id, count(*) AS n FROM ocr_lines JOIN k ON contains(' ' || {_NORM % 'text'} || ' ', ' ' || keyword || ' ') GROUP BY ALL)
  SELECT receipt_id, arg_max(canon_id, n * 1000 - canon_id) AS canon_id FROM hits GROUP BY receipt_id""")
def provider_by_keywords(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "canon_values").where("field = 'provider'")
    k = names.select("canon_id", F.explode(F.array(T.norm(F.col("name_en")), T.norm(F.col("name_ar")))).alias("keyword"))
    # whole words: the runs of words of a line, as long as the longest keyword, are looked up by equality
    most = k.agg(F.max(F.size(F.split("keyword", " ")))).first()[0] or 0
    runs = f"array_distinct(flatten(transform(sequence(1, least({most}, size(w))), n -> transform(sequence(1, size(w) - n + 1), i -> array_join(slice(w, i, n), ' ')))))"
    rows = table(spark, folder, "ocr_lines").select("receipt_id", F.split(T.norm(F.col("text")), " ").alias("w")).where(F.lit(most > 0)).select("receipt_id", F.explode(F.expr(runs)).alias("keyword"))
    hits = rows.join(k, "keyword").groupBy("receipt_id", "canon_id").agg(F.count(F.lit(1)).alias("hits"))
    return hits.groupBy("receipt_id").agg(F.max_by("canon_id", F.struct("hits", -F.col("canon_id"))).alias("canon_id"))


@query()
def label_scored(spark: SparkSession, folder: str) -> DataFrame:
    return closest.scored_labels(table(spark, folder, "ocr_lines").where("text is not null"), ["receipt_id", "line_no"], F.array_compact(F.concat(F.array("text"), F.coalesce("alts", F.array().cast("array<string>")))))


@query()
def currency_closest(spark: SparkSession, folder: str) -> DataFrame:
    codes = closest.closest(list(CURRENCIES), 0.6, clear=True, first_letter=True)
    return table(spark, folder, "receipts").select("receipt_id", codes(F.upper(F.trim("currency"))).alias("code")).where("code is not null")


# --- geometry and order -----------------------------------------------------------------------------------------------
_OVERLAP = "greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) / CAST(greatest(1, least(a.y1 - a.y0, b.y1 - b.y0)) AS DOUBLE)"
_GAP = "greatest(a.x0, b.x0) - least(a.x1, b.x1)"


@query(f"""
  WITH l AS (SELECT o.* FROM ocr_lines o JOIN (VALUES {_LABELS}) AS v(label, kind, target, ord) ON {_NORM % 'text'} = label)
  SELECT receipt_id, label_no, value_no, value FROM (
    SELECT a.receipt_id, a.line_no AS label_no, b.line_no AS value_no, b.text AS value, row_number() OVER (PARTITION BY a.receipt_id, a.line_no ORDER BY {_GAP}, b.line_no) AS rn
    FROM l a JOIN (SELECT o.* FROM ocr_lines o ANTI JOIN l USING (receipt_id, line_no)) b ON a.receipt_id = b.receipt_id AND {_OVERLAP} >= 0.5) WHERE rn = 1""")
def value_on_row(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "ocr_lines").select("receipt_id", "line_no", "text", *layout.BOX)
    known = labels.exact(rows)
    return layout.same_row_nearest(known.where("kind is not null").select(*rows.columns), known.where("kind is null").select(*rows.columns))


@query()
def rows_of_lines(spark: SparkSession, folder: str) -> DataFrame:
    return layout.text_lines(table(spark, folder, "ocr_lines").select("receipt_id", "line_no", *layout.BOX)).select("receipt_id", "line_no", "row")


@query()
def boxes_joined(spark: SparkSession, folder: str) -> DataFrame:
    return layout.merged_boxes(table(spark, folder, "ocr_lines"))


@query("""
  WITH s AS (SELECT receipt_id, line_no, x0 + 2 AS x0, y0 + 2 AS y0, x1 - 2 AS x1, y1 - 2 AS y1 FROM ocr_lines WHERE x0 IS NOT NULL AND line_no % 2 = 0
             UNION ALL SELECT receipt_id, line_no, x0 + (x1 - x0) // 2, y0, x1 + (x1 - x0) // 2, y1 FROM ocr_lines WHERE x0 IS NOT NULL AND line_no % 2 = 1)
  SELECT receipt_id, line_no FROM s a WHERE EXISTS (
    SELECT 1 FROM ocr_lines b WHERE b.receipt_id = a.receipt_id
      AND greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) >= 0.8 * (a.x1 - a.x0) * (a.y1 - a.y0))""")
def boxes_inside(spark: SparkSession, folder: str) -> DataFrame:
    """Boxes drawn a little smaller (even lines), or moved half aside (odd lines), that lie in a box of their receipt."""
    rows = table(spark, folder, "ocr_lines").select("receipt_id", "line_no", *layout.BOX).where("x0 is not null")
    even, half = F.col("line_no") % 2 == 0, F.expr("(x1 - x0) div 2").cast("int")
    moved = rows.select("receipt_id", "line_no", F.when(even, F.col("x0") + 2).otherwise(F.col("x0") + half).alias("x0"), F.when(even, F.col("y0") + 2).otherwise(F.col("y0")).alias("y0"), F.when(even, F.col("x1") - 2).otherwise(F.col("x1") + half).alias("x1"), F.when(even, F.col("y1") - 2).otherwise(F.col("y1")).alias("y1"))
    a, b = layout.prefixed(moved, "a_", ["receipt_id"]), layout.prefixed(rows, "b_", ["receipt_id"])
    pairs = a.join(b, (a["receipt_id"] == b["receipt_id"]) & layout.inside("a_", "b_"), "left_semi")
    return pairs.select("receipt_id", F.col("a_line_no").alias("line_no"))


@query()
def receipt_fields(spark: SparkSession, folder: str) -> DataFrame:
    e = extract.extracted(table(spark, folder, "ocr_lines"))
    return files.flat(e)


@query("""
  WITH t AS (SELECT receipt_id, unnest(tokens, recursive := true) FROM receipt_analyses)
  SELECT receipt_id, line, count(*) AS tokens, CAST(sum(length(text)) AS BIGINT) AS characters FROM t WHERE text IS NOT NULL GROUP BY ALL""")
def token_lines(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "receipt_analyses").select("receipt_id", F.explode("tokens").alias("t")).select("receipt_id", "t.*").where("text is not null")
    return t.groupBy("receipt_id", "line").agg(F.count(F.lit(1)).alias("tokens"), F.sum(F.length("text")).alias("characters"))


@query(f"""
  SELECT receipt_id, arg_max(value, y1 - y0 + 0.001 / (1 + line_no)) AS value FROM (
    SELECT receipt_id, line_no, y0, y1, CAST(replace(regexp_extract({_DIGITS % 'text'}, '^\\s*([0-9]{{1,3}}(?:,[0-9]{{3}})+(?:\\.[0-9]+)?|[0-9]+(?:\\.[0-9]+)?) (?:EGP|USD|EUR)\\s*$', 1), ',', '') AS VARCHAR) AS value FROM ocr_lines WHERE text IS NOT NULL)
  WHERE value <> '' GROUP BY receipt_id""")
def headline_amount(spark: SparkSession, folder: str) -> DataFrame:
    form = r"^\s*([0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|[0-9]+(?:\.[0-9]+)?) (?:EGP|USD|EUR)\s*$"
    rows = table(spark, folder, "ocr_lines").withColumn("value", F.replace(F.regexp_extract(T.ascii_digits(F.col("text")), form, 1), F.lit(","), F.lit(""))).where("value != ''")
    return rows.groupBy("receipt_id").agg(F.max_by("value", F.struct(layout.height(), -F.col("line_no"))).alias("value"))


# --- votes ------------------------------------------------------------------------------------------------------------
@query("""
  WITH v AS (SELECT receipt_id, line_no, unnest(alts) AS reading, unnest(range(len(alts))) AS pos, score FROM ocr_lines WHERE alts IS NOT NULL),
  b AS (SELECT receipt_id, line_no, reading, sum(score * 100 + 10) AS weight, count(*) AS votes, max(score * 100) AS most, min(pos) AS met FROM v WHERE reading IS NOT NULL GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY receipt_id, line_no ORDER BY weight DESC, met) AS rn, sum(votes) OVER (PARTITION BY receipt_id, line_no) AS cast_ FROM b)
  SELECT receipt_id, line_no, reading, votes, round(most * votes / greatest(cast_, 2), 6) AS confidence FROM r WHERE rn = 1""")
def reading_votes(spark: SparkSession, folder: str) -> DataFrame:
    v = table(spark, folder, "ocr_lines").select("receipt_id", "line_no", (F.col("score") * 100).alias("conf"), F.posexplode("alts").alias("pos", "reading"))
    return readings.voted(v, ["receipt_id", "line_no"], "reading", "conf", "pos").withColumn("confidence", F.round("confidence", 6))


@query("""
  WITH v AS (SELECT receipt_id, line_no, unnest(alts) AS reading, unnest(range(len(alts))) AS pos FROM ocr_lines WHERE alts IS NOT NULL),
  n AS (SELECT *, count(reading) OVER (PARTITION BY receipt_id, line_no, reading ORDER BY pos) AS so_far FROM v),
  q AS (SELECT *, min(CASE WHEN reading IS NOT NULL AND so_far >= 2 THEN pos END) OVER (PARTITION BY receipt_id, line_no) AS stop FROM n)
  SELECT receipt_id, line_no, count(*) AS attempts FROM q WHERE stop IS NULL OR pos <= stop GROUP BY ALL""")
def attempts_until_quorum(spark: SparkSession, folder: str) -> DataFrame:
    v = table(spark, folder, "ocr_lines").select("receipt_id", "line_no", F.posexplode("alts").alias("pos", "reading"))
    return readings.until_quorum(v, ["receipt_id", "line_no"], "pos", "reading").groupBy("receipt_id", "line_no").agg(F.count(F.lit(1)).alias("attempts"))


@query("SELECT receipt_id, round(sum(score * length(text)) / nullif(sum(length(text)), 0), 9) AS confidence FROM ocr_lines WHERE text IS NOT NULL AND score IS NOT NULL GROUP BY receipt_id")
def length_weighted_confidence(spark: SparkSession, folder: str) -> DataFrame:
    return readings.weighted_confidence(table(spark, folder, "ocr_lines"), ["receipt_id"], "text", "score").withColumn("confidence", F.round("confidence", 9))


@query("SELECT engine, score >= 0.6 AS kept, count(*) AS lines FROM ocr_lines GROUP BY ALL")
def confidence_filter(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "ocr_lines").groupBy("engine", (F.col("score") >= extract.MIN_SCORE).alias("kept")).agg(F.count(F.lit(1)).alias("lines"))


# --- store ------------------------------------------------------------------------------------------------------------
@query("""
  WITH m AS (SELECT channel, provider_message_id AS message_id, min(delivery_id) AS delivery_id FROM image_messages WHERE provider_message_id IS NOT NULL GROUP BY ALL),
  t AS (SELECT channel, message_id, max(id) AS id FROM receipt_transactions WHERE message_id IS NOT NULL GROUP BY ALL)
  SELECT coalesce(m.channel, t.channel) AS channel, coalesce(m.message_id, t.message_id) AS message_id, delivery_id, id FROM m FULL JOIN t ON m.channel = t.channel AND m.message_id = t.message_id""")
def store_merge(spark: SparkSession, folder: str) -> DataFrame:
    m = table(spark, folder, "image_messages").where("provider_message_id is not null").groupBy("channel", F.col("provider_message_id").alias("message_id")).agg(F.min("delivery_id").alias("delivery_id"))
    t = table(spark, folder, "receipt_transactions").where("message_id is not null").groupBy("channel", "message_id").agg(F.max("id").alias("id"))
    return store.merged(m, t, ["channel", "message_id"], ["delivery_id"], ["id"])


@query("SELECT image_sha256, count(*) AS copies, min(id) AS first FROM receipt_transactions WHERE image_sha256 IS NOT NULL GROUP BY ALL HAVING count(*) > 1")
def duplicate_images(spark: SparkSession, folder: str) -> DataFrame:
    return store.repeated_by(table(spark, folder, "receipt_transactions"), ["image_sha256"], "id")


@query("SELECT provider, reference_id, count(*) AS copies, min(id) AS first FROM receipt_transactions WHERE provider IS NOT NULL AND reference_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1")
def duplicate_references(spark: SparkSession, folder: str) -> DataFrame:
    return store.repeated_by(table(spark, folder, "receipt_transactions"), ["provider", "reference_id"], "id")


@query("SELECT id, octet_length(image) AS bytes, sha256(image) AS sha256 FROM receipt_transactions WHERE image IS NOT NULL")
def image_facts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "receipt_transactions").where("image is not null").select("id", F.octet_length("image").cast("bigint").alias("bytes"), F.sha2("image", 256).alias("sha256"))


@query("""
  WITH u AS (SELECT id, unnest(CAST(json_extract(other_data, '$.unmapped') AS JSON[])) AS u, generate_subscripts(CAST(json_extract(other_data, '$.unmapped') AS JSON[]), 1) - 1 AS pos FROM receipt_transactions WHERE other_data IS NOT NULL)
  SELECT id, CAST(pos AS INT) AS pos, json_extract_string(u, '$.text') AS text, json_extract_string(u, '$.type') AS type FROM u""")
def unmapped_lines(spark: SparkSession, folder: str) -> DataFrame:
    return store.leftovers(table(spark, folder, "receipt_transactions"), "id")


_FLAT = ["name", "phone", "mail", "wallet_id", "bank", "account_type"]


@query("SELECT receipt_id, " + ", ".join(f"(list({f} ORDER BY party_id) FILTER (side = '{s}'))[1] AS {s}_{f}" for s in ("sender", "receiver") for f in _FLAT) + " FROM parties GROUP BY receipt_id")
def parties_flat(spark: SparkSession, folder: str) -> DataFrame:
    return store.flat_parties(table(spark, folder, "parties"), _FLAT)


# --- messages ---------------------------------------------------------------------------------------------------------
def _bodies(spark: SparkSession, folder: str) -> DataFrame:
    """Webhook bodies made of the stored messages, one image each."""
    m = table(spark, folder, "image_messages")
    message = F.struct(F.col("provider_message_id").alias("id"), F.col("sender_id").alias("from"), F.lit("image").alias("type"), F.unix_timestamp("sent_at").cast("string").alias("timestamp"), F.struct(F.col("media_ref").alias("id"), "caption", "mime_type", "sha256").alias("image"))
    value = F.struct(F.array(F.struct(F.col("sender_id").alias("wa_id"), F.struct(F.col("sender_name").alias("name")).alias("profile"))).alias("contacts"), F.array(message).alias("messages"))
    body = F.struct(F.lit(messages.OBJECT).alias("object"), F.array(F.struct(F.array(F.struct(F.lit(messages.FIELD).alias("field"), value.alias("value"))).alias("changes"))).alias("entry"))
    return m.select(F.col("delivery_id").alias("body_id"), F.to_json(body).alias("body"))


@query("SELECT delivery_id AS body_id, provider_message_id AS message_id, sender_id AS party_id, sender_name AS party_name, media_ref, caption, sha256 FROM image_messages WHERE media_ref <> '' AND sender_id <> ''")
def webhook_events(spark: SparkSession, folder: str) -> DataFrame:
    return messages.events(_bodies(spark, folder)).select("body_id", "message_id", "party_id", "party_name", "media_ref", "caption", "sha256")


_WHO = ("name", "phone", "email", "account", "bank")


@query(f"""
  SELECT id, CASE WHEN amount IS NOT NULL OR total IS NOT NULL OR reference_id IS NOT NULL THEN '*Transaction details*'
    || coalesce(chr(10) || 'Provider: ' || provider, '') || coalesce(chr(10) || 'Status: ' || transfer_status, '') || coalesce(chr(10) || 'Type: ' || transfer_type, '')
    || coalesce(chr(10) || 'Amount: ' || amount || coalesce(' ' || currency, ''), '') || coalesce(chr(10) || 'Fees: ' || fees || coalesce(' ' || currency, ''), '') || coalesce(chr(10) || 'Total: ' || total || coalesce(' ' || currency, ''), '')
    || coalesce(chr(10) || 'Reference: ' || reference_id, '') || coalesce(chr(10) || 'Date: ' || strftime(date, '%-d %b %Y, %-I:%M %p'), '') || coalesce(chr(10) || 'Note: ' || notes, '')
    || {" || ".join(f"coalesce(chr(10) || '{n}: ' || nullif(list_aggregate(list_filter([{', '.join(f'{s}_{c}' for c in _WHO)}], lambda x: x IS NOT NULL), 'string_agg', ', '), ''), '')" for n, s in (("From", "sender"), ("To", "receiver")))}
    END AS reply FROM receipt_transactions""")
def reply_text(spark: SparkSession, folder: str) -> DataFrame:
    r = table(spark, folder, "receipt_transactions")
    sums = {n: r[c] for n, c in (("Amount", "amount"), ("Fees", "fees"), ("Total", "total"))}
    who = {n: [r[f"{s}_{c}"] for c in _WHO] for n, s in (("From", "sender"), ("To", "receiver"))}
    text = messages.reply(r["provider"], r["transfer_status"], r["transfer_type"], sums, r["currency"], r["reference_id"], F.date_format(r["date"], "yyyy-MM-dd'T'HH:mm:ss"), r["notes"], who)
    return r.select("id", text.alias("reply"))


@query()
def text_parts(spark: SparkSession, folder: str) -> DataFrame:
    return messages.parts(table(spark, folder, "documents"), "doc_id", "text")


@query("SELECT DISTINCT channel, provider_message_id FROM image_messages WHERE provider_message_id IS NOT NULL")
def stream_once(spark: SparkSession, folder: str) -> DataFrame:
    path, out = f"{folder}/image_messages.parquet", new_path(spark, "once")
    source = table(spark, folder, "image_messages")
    # a table is one file or a folder of files; the stream source reads folders
    rows = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 4).parquet(f"{path}*")
    stream_deliveries.keep_once(rows, "channel", "provider_message_id", ["received_at"], "delivery_id", out).awaitTermination()
    return spark.read.schema(source.schema).parquet(f"{out}/batch=*").where("provider_message_id is not null").select("channel", "provider_message_id")


# --- statistics -------------------------------------------------------------------------------------------------------
@query("""
  SELECT event_type, count(value) AS n, round(min(value), 6) AS min, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS stdev, round(max(value), 6) AS max,
    round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99
  FROM events WHERE value IS NOT NULL GROUP BY event_type""")
def latency_described(spark: SparkSession, folder: str) -> DataFrame:
    d = statistics.described(table(spark, folder, "events"), ["event_type"], "value")
    return d.select("event_type", "n", *[F.round(c, 6).alias(c) for c in d.columns[2:]])


@query("SELECT user_id, count(value) AS n, round(avg(CASE WHEN value <= 5.0 THEN 1.0 ELSE 0.0 END), 9) AS share FROM events WHERE value IS NOT NULL GROUP BY user_id")
def within_limit(spark: SparkSession, folder: str) -> DataFrame:
    return statistics.within(table(spark, folder, "events"), ["user_id"], "value", 5.0).withColumn("share", F.round("share", 9))


# --- stated cases: the result of each is written beside it ----------------------------------------------------------------
_READINGS = [
    ("المرجع", 0.96, "jll", 0.4, "المرجع"), ("رقم", 0.60, "ioso", 0.95, "رقم"), ("ahmed9o@instapay", 0.99, "ahmed90@instapay", 0.98, "ahmed90@instapay"), ("To Instapay", 0.957, "ToInstapay", 0.999, "To Instapay"), ("MahmoudFA", 0.99, "Mahmoud F A", 0.98, "Mahmoud F A"),
    ("Ling Expen  عيدية", 0.92, "Living Expenses - ", 0.8, "Living Expenses - عيدية"), ("Note ملاحظة", 0.9, "xq", 0.5, "Note ملاحظة"), (") EGP", 0.88, ") EGP", 0.9, "EGP"), ("عيدية Livng", 0.9, "- Living", 0.8, "عيدية - Living"),
    (None, None, "Total", 0.7, "Total"), ("Total", 0.7, None, None, "Total"), ("Total", 0.9, "Tötal", 0.99, "Total"), ("احمد عبد الرحمن", 0.9, "x", 0.2, "احمد عبدالرحمن"), ("a9o@x", 0.2, "", 0.9, "a90@x"), ("Clear", 0.99, "Clean", 0.5, "Clear"),
]


def _values(rows: list[tuple], names: str) -> str:
    shown = lambda v: "NULL" if v is None else _sql(v) if isinstance(v, str) else str(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(shown, r)) + ')' for r in rows)}) AS t({names})"


@query(_values([(k, r[4]) for k, r in enumerate(_READINGS)], "case_no, text"))
def reading_chosen(spark: SparkSession, folder: str) -> DataFrame:
    """An Arabic and a Latin recogniser's readings of one line: which one counts."""
    rows = spark.createDataFrame([(k, *r[:4]) for k, r in enumerate(_READINGS)], "case_no int, ar string, ar_conf double, en string, en_conf double")
    return rows.select("case_no", readings.chosen(F.col("ar"), F.col("ar_conf"), F.col("en"), F.col("en_conf"))["text"].alias("text"))


#: receipt: lines (text, x0, y0, x1, y1).
_RECEIPTS = {
    "labels": [("1,250.50 EGP", 300, 100, 620, 160), ("Transfer Amount", 340, 170, 580, 198), ("From", 60, 260, 120, 288), ("Nadia Example", 60, 300, 300, 328), ("To Mobile Wallet", 60, 400, 300, 428), ("01000000001", 60, 440, 260, 468), ("Reference", 60, 540, 190, 568), ("900000000001", 600, 540, 820, 568), ("Date: 23 Sep 2026 03:54 PM", 60, 600, 480, 628)],
    "parties": [("Sender Name: Nadia Example", 60, 100, 460, 128), ("Receiver Number: 01000000001", 60, 150, 460, 178), ("Amount", 60, 200, 160, 228), ("501 EGP", 500, 200, 620, 228)],
    "sentence": [("You transferred 9 EGP To 01000000002", 60, 100, 560, 128)],
    "headline": [("45 EGP", 300, 100, 420, 180), ("From", 60, 260, 120, 288), ("Omar Example", 60, 300, 300, 328)],
    "implied": [("Nadia Example", 60, 300, 300, 328), ("To", 60, 400, 100, 428), ("Omar Example", 60, 440, 300, 468), ("Amount: 7 EGP", 60, 600, 300, 628)],
    "arabic": [("المبلغ", 500, 100, 600, 128), ("١٬٢٥٠٫٥٠ ج.م", 60, 100, 260, 128), ("الرقم المرجعي", 450, 200, 600, 228), ("900000000002", 60, 200, 260, 228)],
}
_EXPECTED = [
    ("labels", 1250.5, "EGP", "Nadia Example", None, "01000000001", "Mobile Wallet", "900000000001", "23 Sep 2026 03:54 PM"), ("parties", 501.0, "EGP", "Nadia Example", None, "01000000001", None, None, None), ("sentence", 9.0, "EGP", None, None, "01000000002", None, None, None),
    ("headline", 45.0, "EGP", "Omar Example", None, None, None, None, None), ("implied", 7.0, "EGP", "Nadia Example", "Omar Example", None, None, None, None), ("arabic", 1250.5, "EGP", None, None, None, None, "900000000002", None),
]


def _cases(spark: SparkSession) -> DataFrame:
    rows = [(r, k, line[0], 0.95, *line[1:]) for r, lines in _RECEIPTS.items() for k, line in enumerate(lines)]
    return extract.extracted(spark.createDataFrame(rows, "receipt_id string, line_no int, text string, score double, x0 int, y0 int, x1 int, y1 int"))


@query(_values(_EXPECTED, "receipt_id, amount, currency, sender_name, receiver_name, receiver_phone, receiver_via, reference, datetime"))
def receipt_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Receipts whose fields are stated."""
    e = _cases(spark)
    return e.select("receipt_id", F.col("amount").cast("double").alias("amount"), "currency", F.col("sender.name").alias("sender_name"), F.col("receiver.name").alias("receiver_name"), F.col("receiver.phone").alias("receiver_phone"), F.col("receiver.via").alias("receiver_via"), "reference", "datetime")


@query(_values([(r[0], "extracted" if r[1] is not None else "no_data", r[3], r[5], '{"receiver":{"via":"Mobile Wallet"}}' if r[6] else None) for r in _EXPECTED], "receipt_id, extraction_status, sender_name, receiver_phone, other_data"))
def store_columns(spark: SparkSession, folder: str) -> DataFrame:
    """The same receipts as rows of the store."""
    return store.result_columns(_cases(spark)).select("receipt_id", "extraction_status", "sender_name", "receiver_phone", "other_data")
