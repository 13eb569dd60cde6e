"""Table statistics: counts, distinct values, ranges, histograms, common values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def column_stats(df: DataFrame, columns: list[str], exact: bool = False) -> DataFrame:
    """column_name, n_rows, ndv, nulls, lo, hi: one pass over the data, with
    HyperLogLog distinct counts unless `exact`."""
    ndv = F.countDistinct if exact else F.approx_count_distinct
    aggs = []
    for c in columns:
        aggs += [ndv(c).alias(f"{c}__ndv"), F.count(c).alias(f"{c}__n"), F.min(c).cast("string").alias(f"{c}__lo"), F.max(c).cast("string").alias(f"{c}__hi")]
    row = df.agg(F.count("*").alias("__rows"), *aggs)
    parts = [
        row.select(F.lit(c).alias("column_name"), F.col("__rows").alias("n_rows"), F.col(f"{c}__ndv").alias("ndv"), (F.col("__rows") - F.col(f"{c}__n")).alias("nulls"), F.col(f"{c}__lo").alias("lo"), F.col(f"{c}__hi").alias("hi"))
        for c in columns
    ]
    return reduce(DataFrame.unionAll, parts)


def most_common(df: DataFrame, column: str, k: int) -> DataFrame:
    """value, n of the k most frequent values."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "value").limit(k)


def histogram(df: DataFrame, column: str, buckets: int = 100) -> DataFrame:
    """bucket (from 0), n of equal-width buckets; nulls are left out."""
    span = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))  # one row
    width = (F.col("hi") - F.col("lo")) / buckets
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(buckets - 1), F.floor((F.col(column) - F.col("lo")) / width))).otherwise(0)
    return df.where(F.col(column).isNotNull()).select(column).join(F.broadcast(span)).groupBy(at.cast("long").alias("bucket")).agg(F.count("*").alias("n"))


def selectivity(df: DataFrame, predicate: str) -> float:
    """The share of rows a predicate keeps."""
    return df.agg(F.avg(F.coalesce(F.expr(predicate), F.lit(False)).cast("int"))).first()[0] or 0.0
