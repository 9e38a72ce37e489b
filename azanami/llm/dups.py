"""Duplicates hidden by formatting, by progressive refinement of a partition of the rows.

Rows are first divided by what is cheap to compute and no formatting changes: the digits of each value, as an order-free
set without empty ones (white space, punctuation, letter case and the order of fields leave them as they are).  Rows alone in
their class are done: they have no copy.  Only members of larger classes get the costly key, the sorted set of all
stripped values, which decides exactly.  Both levels count with partial aggregation; rows meet the counts through a join that has
no hot reducer.  The cheap class is computed in two scans rather than written out: it costs less than its table would.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from azanami.operators.skew import attach_by_key
from azanami.runtime import Stage

FIELDS = ["lg_code", "machiaza_id", "oaza_cho", "chome", "koaza"]
_IGNORED = r"(?U)[\s\p{P}]+"
_SEP = "\u0001"


def stripped(c: Column) -> Column:
    """Without white space, punctuation and letter case; null as empty text."""
    return F.regexp_replace(F.lower(F.coalesce(c.cast("string"), F.lit(""))), _IGNORED, "")


def _values(fields: list[str]) -> Column:
    return F.array_distinct(F.filter(F.array(*(stripped(F.col(f)) for f in fields)), lambda v: v != ""))


def _cheap(fields: list[str]) -> Column:
    """Class of a row: a hash of the set of its values' digits."""
    digits = F.array(*(F.regexp_replace(F.coalesce(F.col(f).cast("string"), F.lit("")), "[^0-9]+", "") for f in fields))
    return F.xxhash64(F.array_sort(F.array_distinct(F.filter(digits, lambda v: v != ""))))


def _divided(df: DataFrame, row_id: str, fields: list[str]) -> tuple[DataFrame, DataFrame, int]:
    """Rows as (row_id, fields, _class), the shared classes with their number of rows, and the number of all rows."""
    base = df.select(F.col(row_id).cast("long").alias("row_id"), *(F.col(f).cast("string").alias(f"_f{i}") for i, f in enumerate(fields)), _cheap(fields).alias("_class"))
    classes = base.groupBy("_class").agg(F.count(F.lit(1)).alias("_members"), F.min("row_id").alias("_first"))
    classes = Stage(df.sparkSession, "classes").keep(classes, "classes")
    return base, classes, classes.agg(F.sum("_members")).first()[0] or 0


def _keyed(base: DataFrame, classes: DataFrame, total: int, n_fields: int) -> DataFrame:
    """(row_id, key) of the rows in shared classes; rows whose values are all null or empty are left out."""
    shared = attach_by_key(base, classes.where("_members > 1").select("_class", "_members"), "_class", "_members", total)
    v = shared.select("row_id", _values([f"_f{i}" for i in range(n_fields)]).alias("_v")).where(F.size("_v") > 0)
    return Stage(base.sparkSession, "keyed").keep(v.select("row_id", F.array_join(F.array_sort("_v"), _SEP).alias("key")), "keyed")


def refine(df: DataFrame, row_id: str, fields: list[str] = FIELDS) -> DataFrame:
    """(row_id, key, n, keep_id) of every row that shares its key with another; n counts the key's rows.

    Rows whose fields are all null or empty have no identity and belong to no class.  Rows with a null id are counted but can
    neither be kept nor named; a row given twice counts twice.  Columns other than the id and the fields don't matter.
    """
    keyed = _keyed(*_divided(df, row_id, fields), len(fields))
    groups = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("keep_id")).where("n > 1")
    groups = Stage(df.sparkSession, "groups").keep(groups, "groups")
    return attach_by_key(keyed, groups, "key", "n")


def copies(df: DataFrame, row_id: str = "row_id", fields: list[str] = FIELDS) -> DataFrame:
    """(keep_id, copy_id): the smallest id of each group of equal rows with each other id of it."""
    return refine(df, row_id, fields).where("row_id <> keep_id").select("keep_id", F.col("row_id").alias("copy_id")).distinct()


def entries(df: DataFrame, row_id: str = "row_id", fields: list[str] = FIELDS) -> DataFrame:
    """One row per entry: (keep_id, n_copies), rows without any value left out; n_copies counts the entry's rows.

    Rows alone in their cheap class are entries of their own; the rest are told apart by the costly key.
    """
    base, classes, total = _divided(df, row_id, fields)
    grouped = _keyed(base, classes, total, len(fields)).groupBy("key").agg(F.min("row_id").alias("keep_id"), F.count(F.lit(1)).alias("n_copies"))
    # the class without any digits may be that of a row without any value: its single member is looked at
    blank = F.xxhash64(F.array().cast("array<string>"))
    alone = classes.where(F.col("_members") == 1)
    odd = base.join(alone.where(F.col("_class") == blank).select("_class"), "_class").where(F.size(_values([f"_f{i}" for i in range(len(fields))])) > 0)
    single = alone.where(F.col("_class") != blank).select(F.col("_first").alias("keep_id")).unionByName(odd.select(F.col("row_id").alias("keep_id")))
    return grouped.select("keep_id", "n_copies").unionByName(single.withColumn("n_copies", F.lit(1).cast("long")))
