"""Latency statistics: descriptions, shares within a limit, rows per group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def described(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """group, n, min, mean, stdev (sample; 0 for one value), max, p50, p90, p95, p99 (linear). Nulls are left out."""
    p = F.percentile(value, F.array(*[F.lit(x) for x in (0.5, 0.9, 0.95, 0.99)]))
    by = rows.where(F.col(value).isNotNull()).groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.min(value).alias("min"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("stdev"), F.max(value).alias("max"), p.alias("_p")
    )
    return by.select(*group, "n", "min", "mean", "stdev", "max", *[F.get("_p", k).alias(n) for k, n in enumerate(("p50", "p90", "p95", "p99"))])


def within(rows: DataFrame, group: list[str], value: str, limit: float) -> DataFrame:
    """group, n, share of the values of at most the limit."""
    return rows.where(F.col(value).isNotNull()).groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(value) <= limit).cast("int")).alias("share"))
