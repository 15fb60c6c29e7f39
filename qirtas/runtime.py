"""Session-level helpers: tables of a data folder, and places to cut lineage that survive the loss of an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table `name` of a folder that holds one parquet file or directory per table."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which every executor shares.

    Only where the session names none and runs on one machine (tests) is a folder of our own made and remembered in the
    session; on a cluster a machine's own folder would be lost with it, so there the setting is needed.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("spark.qirtas.folder", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="qirtas-")
        spark.conf.set("spark.qirtas.folder", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and return the stored table: lineage is cut and nothing is computed twice."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint that keeps the partitions of df and the order within them."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def partitions_for(spark: SparkSession, rows: int, rows_each: int) -> int:
    """Partitions so that each has about rows_each rows, but at least as many as shuffles have anyway when rows suffice."""
    return max(1, min(max(-(-rows // rows_each), int(spark.conf.get("spark.sql.shuffle.partitions"))), -(-rows // 1000) or 1))


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns of df, also where other columns have the same names up to case: Spark finds those ambiguous.

    Of columns with exactly the same name the first is taken; a name that no column has in its case is taken in any case.
    """
    have = df.columns
    lower = [c.lower() for c in have]
    if all(lower.count(n.lower()) == 1 for n in names):
        return df.select(*names)
    at = [have.index(n) if n in have else lower.index(n.lower()) for n in names]
    return df.toDF(*[f"c{i}" for i in range(len(have))]).select(*[F.col(f"c{i}").alias(n) for i, n in zip(at, names)])
