"""Readers for zipped and legacy CSV, and the sinks of built tables."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """CSV with a header, all text; columns are matched by name, missing cells are empty text, blank lines are skipped."""
    df = spark.read.csv(path, header=True, quote='"', escape='"', enforceSchema=False, ignoreLeadingWhiteSpace=False)
    have = set(df.columns)
    return df.select(*(F.coalesce(F.col(f"`{f.name}`"), F.lit("")).alias(f.name) if f.name in have else F.lit("").alias(f.name) for f in schema))


def read_plain_split(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """CSV without quoting: every comma separates."""
    df = spark.read.csv(path, header=True, quote="", ignoreLeadingWhiteSpace=False)
    have = set(df.columns)
    return df.select(*(F.coalesce(F.col(f"`{f.name}`"), F.lit("")).alias(f.name) if f.name in have else F.lit("").alias(f.name) for f in schema))


def read_zip_csv(spark: SparkSession, path: str, schema: StructType, encoding: str = "utf-8", positional: bool = False, batch: int = 10_000) -> DataFrame:
    """Rows of the CSV members of zip files, one task a file, streamed; adds ``file_name``.

    Columns are matched by the header, or by place if ``positional`` (the header is then skipped).  CP932 members: encoding="cp932".
    """
    names = [f.name for f in schema]
    out_schema = ", ".join(f"`{n}` string" for n in [*names, "file_name"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in z.namelist():
                        if member.lower().endswith(".csv"):
                            with z.open(member) as raw:
                                yield from rows(path, io.TextIOWrapper(raw, encoding=encoding, errors="replace", newline=""))

    def rows(path: str, text) -> Iterator[pd.DataFrame]:
        reader = csv.reader(text)
        header = next(reader, None)
        if header is None:
            return
        place = {n: i for i, n in enumerate(names)} if positional else {n: header.index(n) for n in names if n in header}
        block: list[list[str]] = []
        for cells in reader:
            if not cells or cells == [""]:
                continue
            block.append([cells[place[n]] if n in place and place[n] < len(cells) else "" for n in names] + [path.rsplit("/", 1)[-1]])
            if len(block) >= batch:
                yield pd.DataFrame(block, columns=[*names, "file_name"])
                block = []
        if block:
            yield pd.DataFrame(block, columns=[*names, "file_name"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, out_schema)


def with_file_part(df: DataFrame, pattern: str, column: str = "part") -> DataFrame:
    """Rows of files whose name matches the pattern, with its first group as a column (df needs ``file_name``)."""
    return df.where(F.col("file_name").rlike(pattern)).withColumn(column, F.regexp_extract("file_name", pattern, 1))


def latest(spark: SparkSession, folder: str, prefix: str) -> str | None:
    """The greatest file name that begins with prefix."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(folder)
    names = [s.getPath().getName() for s in p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)]
    fitting = [n for n in names if n.startswith(prefix)]
    return f"{folder.rstrip('/')}/{max(fitting)}" if fitting else None


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or an empty one if it doesn't exist."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def write_by_key(df: DataFrame, path: str, key: str, rows_per_file: int | None = None) -> None:
    """Range-partitioned and sorted by key, so that a reader's filter on it skips files and row groups.  Replaces the folder."""
    w = df.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite")
    (w.option("maxRecordsPerFile", rows_per_file) if rows_per_file else w).parquet(path)


def write_parts(df: DataFrame, path: str, by: str, order: list[str], rows_per_file: int) -> None:
    """One folder per value of ``by``, files of bounded length; a big value is spread over several tasks by range."""
    df.repartitionByRange(by, *order).sortWithinPartitions(by, *order).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy(by).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def append_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def decode_rail(raw: DataFrame, json_column: str) -> tuple[DataFrame, DataFrame]:
    """(lines, stations) from a document {lines: [{code, name, company}], stations: [[code, group, name, line, pref, post, address, lat, lng]]}."""
    schema = "lines array<struct<code:int,name:string,company:string>>, stations array<array<string>>"
    d = raw.select(F.from_json(json_column, schema).alias("d"))
    lines = d.select(F.inline("d.lines"))
    s = d.select(F.posexplode("d.stations").alias("ord", "s"))
    at = lambda i, kind: F.get("s", F.lit(i)).try_cast(kind)
    stations = s.select(at(0, "int").alias("code"), at(1, "int").alias("group_code"), at(2, "string").alias("name"), at(3, "int").alias("line_code"), at(4, "int").alias("pref"), at(5, "string").alias("postal_code"), at(6, "string").alias("address"), at(7, "double").alias("lat"), at(8, "double").alias("lng"), "ord")
    named = stations.join(lines.select(F.col("code").alias("line_code"), F.col("name").alias("line_name"), "company"), "line_code", "left")
    return lines, named.withColumns({"line_name": F.coalesce("line_name", F.lit("")), "company": F.coalesce("company", F.lit(""))})
