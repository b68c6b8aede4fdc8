"""Observability over tables of timings and over a log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Upper bounds of the latency buckets in microseconds; the last bucket has none.
BOUNDS = (50, 100, 250, 500, 1000, 2500, 5000, 10000)


def histogram(df: DataFrame, column: str, bounds: tuple = BOUNDS) -> DataFrame:
    """(bucket, n): rows per bucket; bucket is the place of the first bound not below the value."""
    case = F.lit(len(bounds))
    for i, b in reversed(list(enumerate(bounds))):
        case = F.when(F.col(column) <= b, i).otherwise(case)
    return df.where(F.col(column).isNotNull()).groupBy(case.cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def bucket_percentile(hist: DataFrame, p: float) -> DataFrame:
    """One row, bucket: the first one whose running count reaches p of all. The window sees one row a bucket."""
    run = hist.select("bucket", F.sum("n").over(W.orderBy("bucket")).alias("upto"), F.sum("n").over(W.partitionBy()).alias("all"))
    return run.where(F.col("upto") >= p * F.col("all")).agg(F.min("bucket").alias("bucket"))


def percentiles(df: DataFrame, column: str, ps: tuple[float, ...] = (0.5, 0.95, 0.99), exact: bool = True) -> DataFrame:
    """One row with p50, p95 ...; exact=False: a bounded summary for large tables."""
    pick = (lambda p: F.percentile(column, F.lit(p))) if exact else (lambda p: F.percentile_approx(column, F.lit(p), F.lit(10_000)))
    return df.agg(*[pick(p).alias(f"p{round(100 * p)}") for p in ps])


def slow_queries(df: DataFrame, column: str, threshold: float, k: int = 10, key: str = "_id") -> DataFrame:
    """The k largest values over the threshold; ties by key."""
    return df.where(F.col(column) > threshold).orderBy(F.col(column).desc(), key).limit(k)


def cardinalities(df: DataFrame, columns: list[str], exact: bool = False) -> DataFrame:
    """(field, n): distinct values per column, in one pass; approximate unless exact."""
    count = F.count_distinct if exact else lambda c: F.approx_count_distinct(c, 0.02)
    row = df.agg(*[count(c).alias(c) for c in columns])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("n")) for c in columns])).alias("x")).select("x.field", "x.n")
