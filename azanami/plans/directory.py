"""Directory: prefectures, municipalities with wards, lines and stations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from azanami.functions.names import prefecture_keys
from azanami.functions.text import key_of_nfkc, nfkc
from azanami.operators.prefix import prefix_hits
from azanami.operators.small import join_small


#: Credits that accompany results; whoever loads a register names its source here.
CREDITS = {"registry": "address registry", "survey": "survey of positions", "rail": "railway data"}


def with_attribution(df: DataFrame, *sources: str) -> DataFrame:
    return df.withColumn("attribution", F.array(*(F.lit(CREDITS[s]) for s in sources)))


def resolve_prefs(df: DataFrame, column: str, prefs: DataFrame) -> DataFrame:
    """Adds pref and pref_name: a code 1 .. 47 in any width of digits, or a name with or without its last letter and nothing after it; else null."""
    raw = F.trim(nfkc(F.col(column).cast("string")))
    t = df.withColumn("_raw", raw).withColumn("_rid", F.monotonically_increasing_id())
    codes = prefs.select(F.col("code").alias("_c"), F.col("name").alias("_cn"))
    by_code = join_small(t.withColumn("_c", F.when(F.col("_raw").rlike("^[0-9]{1,2}$"), F.lpad("_raw", 2, "0"))), codes, "_c", "left")
    names = prefecture_keys(prefs).groupBy("key").agg(F.max_by(F.struct("pref", "pref_name"), "whole").alias("_n"))
    both = join_small(by_code.withColumn("key", key_of_nfkc(F.col("_raw"))), names, "key", "left")
    return both.select(*df.columns, F.coalesce(F.when(F.col("_cn").isNotNull(), F.col("_c")), "_n.pref").alias("pref"), F.coalesce("_cn", "_n.pref_name").alias("pref_name"))


def list_prefectures(cities: DataFrame) -> DataFrame:
    return cities.where("level = 'pref'").select("code", "name", "lat", "lng").orderBy("code")


def ward_name(name: Column, parent: Column) -> Column:
    return F.when(F.startswith(name, parent), F.substring(name, F.length(parent) + 1, F.length(name))).otherwise(name)


def list_municipalities(cities: DataFrame, pref: str | None = None, mode: str = "wards") -> DataFrame:
    """(pref, ord, municipality, ward, lat, lng) of one prefecture, or of all; ``ward`` is an array, null where there is none.

    A city with wards is listed by its wards, in mode "nested" as one row with all of them and the city's own position.
    A ward whose city is missing stands alone.
    """
    c = cities.where("level <> 'pref'")
    if pref is not None:
        c = c.where(F.col("pref") == pref)
    bodies = cities.select(F.col("code").alias("parent"), F.col("name").alias("p_name"), F.col("lat").alias("p_lat"), F.col("lng").alias("p_lng"))
    parents = cities.where("parent is not null").select(F.col("parent").alias("code")).distinct()
    plain = c.where("level <> 'ward'").join(parents.withColumn("_has", F.lit(True)), "code", "left").where("_has is null or level <> 'city'")
    plain = plain.select("pref", F.col("code").alias("ord"), F.col("name").alias("municipality"), F.lit(None).cast("array<string>").alias("ward"), "lat", "lng")
    w = c.where("level = 'ward'").join(bodies, "parent", "left")
    alone = w.where("p_name is null").select("pref", F.col("code").alias("ord"), F.col("name").alias("municipality"), F.lit(None).cast("array<string>").alias("ward"), "lat", "lng")
    owned = w.where("p_name is not null").withColumn("w", ward_name(F.col("name"), F.col("p_name")))
    if mode == "nested":
        wards = F.transform(F.array_sort(F.collect_list(F.struct("code", "w"))), lambda x: x["w"])
        owned = owned.groupBy("pref", "p_name").agg(F.min("code").alias("ord"), wards.alias("ward"), F.min_by("p_lat", "code").alias("lat"), F.min_by("p_lng", "code").alias("lng")).select("pref", "ord", F.col("p_name").alias("municipality"), "ward", "lat", "lng")
    else:
        owned = owned.select("pref", F.col("code").alias("ord"), F.col("p_name").alias("municipality"), F.array("w").alias("ward"), "lat", "lng")
    return plain.unionByName(alone).unionByName(owned).orderBy("pref", "ord")


def list_stations(stations: DataFrame, pref: int | None = None, line: int | None = None, unknown_pref: bool = False) -> DataFrame:
    """Stations of a prefecture and a line, in line order; none at all if the prefecture asked for is unknown."""
    out = stations.where("false") if unknown_pref else stations
    if pref is not None:
        out = out.where(F.col("pref") == pref)
    if line is not None:
        out = out.where(F.col("line_code") == line)
    return out.orderBy("ord", "code")


def get_station(stations: DataFrame, code: int) -> DataFrame:
    return stations.where(F.col("code") == code)


def list_lines(lines: DataFrame, stations: DataFrame, pref: int) -> DataFrame:
    """Lines with a station in the prefecture, by code."""
    return lines.join(stations.where(F.col("pref") == pref).select(F.col("line_code").alias("code")), "code", "left_semi").orderBy("code")


def stations_per_line(lines: DataFrame, stations: DataFrame) -> DataFrame:
    """(code, stations): 0 for lines without any."""
    n = stations.groupBy(F.col("line_code").alias("code")).agg(F.count(F.lit(1)).alias("stations"))
    return lines.select("code").join(n, "code", "left").select("code", F.coalesce("stations", F.lit(0)).alias("stations"))


def strip_prefectures(df: DataFrame, text: str, prefs: DataFrame) -> DataFrame:
    """Adds pref and rest to texts as they stand (no key is made): the longest full prefecture name at the begin."""
    hits = prefix_hits(df.select(F.col(text).alias("_t")).distinct(), "_t", prefs.select(F.col("name").alias("_k"), F.col("code").alias("pref")), "_k")
    best = hits.groupBy("_t").agg(F.max_by(F.struct("pref", "rest"), "matched").alias("_b")).select(F.col("_t").alias(text), "_b.*")
    return df.join(best, text, "left")
