"""Operators that depend on an order: first and last rows, modes, ranks, deltas, runs, shards, greedy packing."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from azanami.runtime import Stage


def first_wins(df: DataFrame, keys: list[str], ord_: str) -> DataFrame:
    """The row with the smallest ord_ of each key, as one partial aggregate."""
    cols = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*cols), F.col(ord_)).alias("_r")).select(*keys, "_r.*")


def last_wins(df: DataFrame, keys: list[str], ord_: str) -> DataFrame:
    """The row with the largest ord_ of each key."""
    cols = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.col(ord_)).alias("_r")).select(*keys, "_r.*")


def mode_by(df: DataFrame, keys: list[str], value: str, ord_: str) -> DataFrame:
    """The most frequent value of each key; of equally frequent ones the one met first."""
    per = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min(ord_).alias("_first"))
    best = F.max_by(F.col(value), F.struct(F.col("n"), -F.col("_first")))
    return per.groupBy(*keys).agg(best.alias(value), F.max("n").alias("n"))


def top_n(df: DataFrame, by: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group, ranked; Spark cuts groups in the map tasks already (window group limit)."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= n)


def delta_encode(df: DataFrame, by: list[str], order: list[str], cols: list[str]) -> DataFrame:
    """Each column as the difference from the row before; the first row of a group keeps its value."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumns({c: F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0)) for c in cols})


def delta_decode(df: DataFrame, by: list[str], order: list[str], cols: list[str]) -> DataFrame:
    """Inverse of ``delta_encode``: running sums."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.sum(c).over(w) for c in cols})


def dense_groups(df: DataFrame, by: list[str], number: str, plain: Column) -> DataFrame:
    """(by, n, dense): whether a group's numbers are exactly 1 .. n, each once and all of them plain."""
    agg = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(number).alias("_lo"), F.max(number).alias("_hi"), F.count_distinct(number).alias("_d"), F.bool_and(plain).alias("_p"))
    return agg.select(*by, "n", ((F.col("_lo") == 1) & (F.col("_hi") == F.col("n")) & (F.col("_d") == F.col("n")) & F.col("_p")).alias("dense"))


def shard_bounds(keys: DataFrame, key: str, size: int) -> DataFrame:
    """(shard, bound, n): the keys in binary order cut every ``size`` keys, with each shard's first key.

    The rank is found in two steps (counts per range partition, then within it), so no task sorts all keys.
    """
    distinct = keys.select(F.col(key).alias("bound")).where(F.col("bound").isNotNull()).distinct().repartitionByRange("bound").sortWithinPartitions("bound")
    tagged = distinct.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    tagged = Stage(tagged.sparkSession, "ranges").keep(tagged)
    counts = tagged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_base"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row per partition
    ranked = tagged.join(F.broadcast(before), "_p").withColumn("_rank", F.col("_before") + F.col("_i") - F.col("_base"))
    shards = ranked.groupBy(F.floor(F.col("_rank") / size).cast("long").alias("shard")).agg(F.min("bound").alias("bound"), F.count(F.lit(1)).alias("n"))
    return shards


def as_of_shard(texts: DataFrame, text: str, bounds: DataFrame) -> DataFrame:
    """Adds ``shard``: the last shard whose bound is not above the text, or the first.

    Texts and bounds are merged by range partition; within a partition the last bound seen is carried on, and the last bound of
    the partitions before is looked up, so neither side is broadcast or compared with all of the other.
    """
    a = texts.select(F.struct(*texts.columns).alias("_row"), F.col(text).alias("_k"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_s"))
    b = bounds.select(F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.col("bound").alias("_k"), F.lit(0).alias("_kind"), F.col("shard").cast("long").alias("_s"))
    both = a.unionByName(b).repartitionByRange("_k", "_kind").sortWithinPartitions("_k", "_kind").withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    both = Stage(both.sparkSession, "ranges").keep(both)
    last = both.groupBy("_p").agg(F.max("_s").alias("_m"))
    carried = last.withColumn("_c", F.max("_m").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))).select("_p", "_c")  # one row per partition
    w = Window.partitionBy("_p").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    out = both.join(F.broadcast(carried), "_p").withColumn("shard", F.coalesce(F.max("_s").over(w), F.col("_c"), F.lit(0)))
    return out.where("_kind = 1").select("_row.*", "shard")


def part_of(bounds: Column, ident: Column) -> Column:
    """Number of bounds not above an id: the part of a short sorted list that holds it."""
    return F.size(F.filter(bounds, lambda b: b <= ident))


def greedy_parts(df: DataFrame, by: str, item: str, weight: str, most: int) -> DataFrame:
    """(by, item, weight, part): items in order are put into one part until it would exceed ``most``; an item is never split.

    The reset makes this sequential within a group; groups run in parallel.  Items must be aggregated before, one row each.
    """
    schema = f"{by} string, {item} string, {weight} long, part long"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(item, kind="stable")
        part, used, out = 0, 0, []
        for w in pdf[weight]:
            if used and used + w > most:
                part, used = part + 1, 0
            used += w
            out.append(part)
        return pdf.assign(part=out)[[by, item, weight, "part"]]

    return df.select(F.col(by).cast("string"), F.col(item).cast("string"), F.col(weight).cast("long")).groupBy(by).applyInPandas(run, schema)


def seeded_sample(df: DataFrame, n: int, ident: str, seed: int = 0) -> DataFrame:
    """n rows chosen by a hash of their id: the same at every run and partitioning."""
    return df.orderBy(F.xxhash64(F.col(ident), F.lit(seed)), ident).limit(n)


def change_from_last(df: DataFrame, order: str, cols: list[str]) -> DataFrame:
    """Adds for each column its change in percent from the row before, null for the first or after a zero.  For histories of builds: one row each."""
    w = Window.orderBy(order)
    return df.withColumns({f"{c}_pct": F.when(F.lag(c).over(w) != 0, (F.col(c) - F.lag(c).over(w)) / F.lag(c).over(w) * 100) for c in cols})


