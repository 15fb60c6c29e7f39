"""Readers and writers: images as binary rows, tab-separated words of a recogniser, nested and flat results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- Fixed values -----------------------------------------------------------------------------------------------------
IMAGE_GLOB = "*.{jpg,jpeg,png,bmp,webp,tif,tiff,JPG,JPEG,PNG,BMP,WEBP,TIF,TIFF}"
MAX_IMAGE = 20 * 1024 * 1024
WORD_COLUMNS = ["level", "page_num", "block_num", "par_num", "line_num", "word_num", "left", "top", "width", "height", "conf", "text"]
LIST_SEPARATOR = " | "
# ----------------------------------------------------------------------------------------------------------------------


def images(spark: SparkSession, folder: str, most: int = MAX_IMAGE) -> DataFrame:
    """path, modificationTime, length, content, sha256 of the image files of a folder, up to a size; content is read only
    where it is selected."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", IMAGE_GLOB).option("recursiveFileLookup", "true").load(folder)
    return rows.where(F.col("length") <= most).withColumn("sha256", F.sha2("content", 256))


def words(spark: SparkSession, path: str) -> DataFrame:
    """The words of a tab-separated report: numbers cut to whole ones, rows of confidence below 0 or without text left out."""
    schema = ", ".join(f"{c} string" for c in WORD_COLUMNS)
    rows = spark.read.option("sep", "\t").option("header", "true").option("quote", "").schema(schema).csv(path)
    whole = [F.col(c).try_cast("double").cast("int").alias(c) for c in WORD_COLUMNS[:-1]]
    return rows.select(*whole, "text").where((F.col("conf") >= 0) & F.col("text").rlike(r"\S"))


def lines_of_words(words_: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Words joined to lines: group, page, block, paragraph, line; text in reading order, mean confidence, box."""
    keys = [*(group or []), "page_num", "block_num", "par_num", "line_num"]
    ordered = F.array_sort(F.collect_list(F.struct(F.col("left").alias("x"), "word_num", "text")))
    by = words_.groupBy(*keys).agg(ordered.alias("_w"), F.avg("conf").alias("conf"), F.min("left").alias("x0"), F.min("top").alias("y0"), F.max(F.col("left") + F.col("width")).alias("x1"), F.max(F.col("top") + F.col("height")).alias("y1"))
    forward = F.array_join(F.transform("_w", lambda w: w["text"]), " ")
    backward = F.array_join(F.transform(F.reverse("_w"), lambda w: w["text"]), " ")
    rtl = F.regexp_count(forward, F.lit("[ء-ي]")) > F.regexp_count(forward, F.lit("[A-Za-z]"))
    return by.select(*keys, F.when(rtl, backward).otherwise(forward).alias("text"), "conf", "x0", "y0", "x1", "y1")


def flat(results: DataFrame) -> DataFrame:
    """Structs as columns named <struct>_<field>, lists of strings as one text, other lists as JSON."""
    out = []

    def shown(c, kind):
        if kind.typeName() != "array":
            return c
        return F.array_join(c, LIST_SEPARATOR) if kind.elementType.typeName() == "string" else F.to_json(c)

    for f in results.schema.fields:
        if f.dataType.typeName() == "struct":
            out += [shown(F.col(f"{f.name}.{g.name}"), g.dataType).alias(f"{f.name}_{g.name}") for g in f.dataType.fields]
        else:
            out.append(shown(F.col(f.name), f.dataType).alias(f.name))
    return results.select(*out)


def write_csv(results: DataFrame, path: str) -> None:
    """Flat rows with a header; nulls are empty."""
    flat(results).write.mode("errorifexists").option("header", "true").option("nullValue", "").option("emptyValue", "").csv(path)


def write_json(results: DataFrame, path: str) -> None:
    """One JSON object a line, nested as it is; null fields are kept."""
    results.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def write_text(lines: DataFrame, path: str, group: str = "receipt_id", order: str = "line_no", text: str = "text") -> None:
    """The lines of each group in order, one text per group."""
    joined = lines.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("l"))
    joined.select(F.array_join(F.transform("l", lambda x: x[text]), "\n").alias("value")).write.mode("errorifexists").text(path)
