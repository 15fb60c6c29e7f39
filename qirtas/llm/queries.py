"""Queries pN_ of the subpackage, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from qirtas.llm import canonical, forms, mixing, names, packing, pii, tokens, truncation
from qirtas.runtime import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    entries = table(spark, folder, "canon_values")
    values = canonical.entered_values(table(spark, folder, "parties"), table(spark, folder, "receipts"), entries)
    return canonical.matched(values, entries).select("receipt_id", "side", "field", "canon_id").distinct()


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return names.pairs(names.linked(table(spark, folder, "parties"))).distinct()


def p2_entities(spark: SparkSession, folder: str) -> DataFrame:
    """party_id, name, entity of every row whose name can be read."""
    return names.linked(table(spark, folder, "parties"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return pii.found_types(table(spark, folder, "receipt_analyses")).distinct()


def p3_sanitised(spark: SparkSession, folder: str) -> DataFrame:
    return pii.sanitised(table(spark, folder, "receipt_analyses"))


def p3_disclosure(spark: SparkSession, folder: str) -> DataFrame:
    """The bits that the texts disclose of persons, before and after."""
    return pii.disclosure(table(spark, folder, "receipt_analyses"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return forms.disguised(table(spark, folder, "ocr_lines")).select("receipt_id", "line_no", "field", "pos").distinct()


def p7_packed(spark: SparkSession, folder: str) -> DataFrame:
    sized = tokens.with_tokens(table(spark, folder, "documents").select("doc_id", "text"))
    return packing.packed(sized, table(spark, folder, "pack_sizes"))


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    return packing.report(p7_packed(spark, folder), table(spark, folder, "pack_sizes"))


def p8_mixed(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.shares(p8_mixed(spark, folder), table(spark, folder, "mix_targets"))


def p8_marginals(spark: SparkSession, folder: str) -> DataFrame:
    """How far languages and topics of the mixture are from those of the corpus."""
    documents, targets = table(spark, folder, "documents"), table(spark, folder, "mix_targets")
    return mixing.marginals(mixing.mixed(documents, targets), mixing.expected(documents, targets)[0])


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.judged(table(spark, folder, "documents")).where("cut").select("doc_id").distinct()


def p9_rates(spark: SparkSession, folder: str) -> DataFrame:
    """source, documents, cut_documents, rate."""
    return truncation.rates(truncation.judged(table(spark, folder, "documents")))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_entities": p2_entities, "p3_found": p3_found, "p3_sanitised": p3_sanitised, "p3_disclosure": p3_disclosure, "p4_found": p4_found, "p7_packed": p7_packed, "p7_fill": p7_fill, "p8_mixed": p8_mixed, "p8_shares": p8_shares, "p8_marginals": p8_marginals, "p9_found": p9_found, "p9_rates": p9_rates}
ORACLE: dict[str, str] = {}
