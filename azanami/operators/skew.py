"""Per-key results when a few keys hold most rows.

``count_by_key`` never sends raw rows across the network: each task folds its rows into a hash table
of mergeable states (Spark's partial aggregation, which spills to sorted runs when memory is short),
and only those compact states are shuffled.  A key with a third of all rows therefore costs one state per
map task, not a third of the data in one reducer.

``attach_by_key`` joins rows to one state per key without a hot reducer.  A key is *heavy* if it has
more than 1/``slices`` of all rows, so there can be at most ``slices`` heavy keys whatever the data size; that
proven bound is what allows them to be broadcast, and all other keys are small enough to be hashed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from azanami.runtime import Stage

#: Heavy keys hold more than 1/SLICES of the rows, hence there are fewer than SLICES of them.
SLICES = 1000
#: Rows that one task may hold in any case.
SMALL = 500_000


def aggregate_by_key(df: DataFrame, keys: list[str], **states: Column) -> DataFrame:
    """Group by keys with algebraic aggregates only (count, sum, min, max, ... : states that merge).

    A null key forms its own group, an empty table gives no rows, repeated rows count each time.
    """
    return df.groupBy(*keys).agg(*(c.alias(n) for n, c in states.items()))


def attach_by_key(rows: DataFrame, per_key: DataFrame, key: str, n: str, total: int | None = None, slices: int = SLICES, how: str = "inner", small: int = SMALL) -> DataFrame:
    """Join of many rows to one row per key, inner or left.

    ``per_key`` has key once per value, and in ``n`` the number of rows of that key.  ``total``: number of all
    rows, counted from ``per_key`` if not given.  Null keys match nothing.  Up to ``small`` rows in all are joined plainly: no key
    can be too much for a task then.
    """
    if total is None:
        total = per_key.agg(F.sum(n)).first()[0] or 0
    if total <= small:
        return rows.join(per_key, key, how)
    bar = max(total // slices, 1)
    heavy, light = per_key.where(F.col(n) > bar), per_key.where(F.col(n) <= bar)
    heavy = heavy.withColumn("_heavy", F.lit(True))
    tagged = rows.join(F.broadcast(heavy), key, "left")
    hot = tagged.where(F.col("_heavy")).drop("_heavy")
    cold = tagged.where(F.col("_heavy").isNull()).select(*rows.columns).join(light, key, how)
    return hot.unionByName(cold)


def plain_code(c: Column) -> Column:
    """A municipality code as six ASCII digits: spaces, hyphens and digit width don't count; null for anything else."""
    s = F.translate(c, "０１２３４５６７８９", "0123456789")
    s = F.regexp_replace(s, r"(?U)[\s\p{Pd}−­ｰー]+", "")
    return F.when(s.rlike("^[0-9]{6}$"), s)


def codes_by_table(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows per plain code of several tables: (src_table, code, n_rows, n_all).

    tables: name -> (DataFrame, column of codes).  ``n_all`` counts all rows of the table, null and malformed codes
    included; the code null stands for those.  Tables may have any further columns.
    """
    out = None
    for name, (df, col) in tables.items():
        one = df.select(F.lit(name).alias("src_table"), plain_code(F.col(col)).alias("code"))
        out = one if out is None else out.unionByName(one)
    counted = aggregate_by_key(out, ["src_table", "code"], n_rows=F.count(F.lit(1)))
    counted = Stage(counted.sparkSession, "codes").keep(counted)  # at most a million codes a table: the totals come from these, not from a second scan
    total = counted.groupBy("src_table").agg(F.sum("n_rows").alias("n_all"))
    return counted.join(F.broadcast(total), "src_table")  # one row per table name


def heavy_codes(tables: dict[str, tuple[DataFrame, str]], share: float = 0.02) -> DataFrame:
    """Codes with at least ``share`` of all rows of their table: (src_table, code)."""
    c = codes_by_table(tables)
    return c.where(F.col("code").isNotNull() & (F.col("n_rows") >= share * F.col("n_all"))).select("src_table", "code")


def join_salted(rows: DataFrame, other: DataFrame, keys: list[str], counts: DataFrame, n: str, salt_by: str, slices: int = SLICES) -> DataFrame:
    """Inner join of rows with ``other``, either with many rows per key, where a few keys hold most of ``rows``.

    ``counts``: keys and their number of rows in ``n``.  Fewer than ``slices`` keys exceed 1/``slices`` of all rows; the rows of such
    a key are spread by a hash of ``salt_by`` over as many parts as bring each below that, and meet a copy of the other side's rows in each.
    """
    counts = Stage(counts.sparkSession, "salts").keep(counts)
    bar = max((counts.agg(F.sum(n)).first()[0] or 0) // slices, 1)
    heavy = counts.where(F.col(n) > bar).select(*keys, F.ceil(F.col(n) / bar).cast("long").alias("_salts"))
    a = rows.join(F.broadcast(heavy), keys, "left")
    b = other.join(F.broadcast(heavy), keys, "left")
    cold = a.where(F.col("_salts").isNull()).drop("_salts").join(b.where(F.col("_salts").isNull()).drop("_salts"), keys)
    hot_a = a.where(F.col("_salts").isNotNull()).withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.col("_salts"))).drop("_salts")
    hot_b = b.where(F.col("_salts").isNotNull()).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_salts") - 1))).drop("_salts")
    return cold.unionByName(hot_a.join(hot_b, [*keys, "_salt"]).drop("_salt"))
