"""Histograms, quantiles and shares, as gates and audits need them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def histogram(df: DataFrame, by: list[str], value: str, width: float, buckets: int) -> DataFrame:
    """(by, bucket, n): buckets of equal width from 0, the last one open.  Null values are left out."""
    b = F.least(F.floor(F.col(value) / width), F.lit(buckets)).cast("long")
    return df.where(F.col(value).isNotNull()).groupBy(*by, b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def histogram_quantile(hist: DataFrame, by: list[str], width: float, quantiles: dict[str, float]) -> DataFrame:
    """(by, names ...): lower edge of the first bucket at which the cumulated count reaches n * q."""
    run = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)  # as many rows as buckets
    whole = Window.partitionBy(*by)
    h = hist.withColumn("_c", F.sum("n").over(run)).withColumn("_t", F.sum("n").over(whole))
    return h.groupBy(*by).agg(*(F.min(F.when(F.col("_c") >= F.col("_t") * q, F.col("bucket") * width)).alias(n) for n, q in quantiles.items()))


def index_quantile(df: DataFrame, by: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """(by, n, names ...): the element at floor(n * q) of the sorted values, the last one at most.

    Values are counted first, so only distinct values are ranked.
    """
    per = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    run = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    c = per.withColumn("_c", F.sum("_n").over(run)).withColumn("_t", F.sum("_n").over(Window.partitionBy(*by)))
    at = lambda q: F.least(F.floor(F.col("_t") * q), F.col("_t") - 1)
    return c.groupBy(*by).agg(F.max("_t").alias("n"), *(F.min(F.when(F.col("_c") > at(q), F.col(value))).alias(name) for name, q in quantiles.items()))


def within_shares(df: DataFrame, by: list[str], value: str, limits: dict[str, float]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.avg((F.col(value) <= x).cast("int")).alias(n) for n, x in limits.items()))


def coverage(base: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """One row (base, other, both, share): distinct key tuples of either table and of both."""
    tagged = base.select(*keys, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(other.select(*keys, F.lit(0).alias("a"), F.lit(1).alias("b")))
    per = tagged.groupBy(*keys).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return per.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("base"), F.coalesce(F.sum("b"), F.lit(0)).alias("other"), F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("both")).withColumn("share", F.when(F.col("base") > 0, F.col("both") / F.col("base")))


def spread_class(metres: Column) -> Column:
    """How harmful it is that two names share a key, by how far their places are apart."""
    return F.when(metres.isNull(), "unknown").when(metres < 200, "benign").when(metres < 2000, "suspect").otherwise("harmful")
