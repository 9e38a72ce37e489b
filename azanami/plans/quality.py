"""Quality gates over built tables, and audits of keys, positions and coverage.  Every gate gives one row of metrics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from azanami.functions.geo import GATE_BOX, haversine_m, in_box
from azanami.operators.order import top_n
from azanami.operators.stats import coverage, histogram, histogram_quantile, index_quantile, spread_class, within_shares

PREF_MARGIN = 0.6
FAR_TOWN_M, FAR_NUMBER_M, BROKEN_NUMBER_M = 60_000, 500, 5_000
#: Allowed changes from one build to the next: coverage in points, the rest in percent.
COVERAGE_DROP, COUNT_DROP, MEDIAN_CHANGE, OUTLIER_GROWTH = 0.5, 1.0, 25.0, 20.0
MAX_FILES, MAX_FILE_BYTES = 20_000, 25 << 20


def pct(part: Column, whole: Column) -> Column:
    return F.round(100 * F.try_divide(part, whole), 4)


def prefecture_boxes(cities: DataFrame, margin: float = PREF_MARGIN) -> DataFrame:
    """(pref, lat0, lat1, lng0, lng1): box of each prefecture's municipalities, widened."""
    c = cities.where("level <> 'pref' and lat is not null and lng is not null")
    return c.groupBy("pref").agg((F.min("lat") - margin).alias("lat0"), (F.max("lat") + margin).alias("lat1"), (F.min("lng") - margin).alias("lng0"), (F.max("lng") + margin).alias("lng1"))


def _rated_towns(towns: DataFrame, cities: DataFrame) -> DataFrame:
    t = towns.dropDuplicates(["lg_code", "machiaza_id"]).withColumn("pref", F.substring("lg_code", 1, 2))
    c = cities.select(F.col("code").alias("lg_code"), F.col("lat").alias("c_lat"), F.col("lng").alias("c_lng"))
    t = t.join(c, "lg_code", "left").join(prefecture_boxes(cities), "pref", "left")
    placed = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    outside = placed & ~in_box(F.col("lat"), F.col("lng"), GATE_BOX)
    beyond = placed & F.col("lat0").isNotNull() & ~(F.col("lat").between(F.col("lat0"), F.col("lat1")) & F.col("lng").between(F.col("lng0"), F.col("lng1")))
    return t.withColumns({"placed": placed, "outside": outside, "beyond": F.coalesce(beyond, F.lit(False)), "far_m": haversine_m(F.col("lat"), F.col("lng"), F.col("c_lat"), F.col("c_lng"))})


def town_gate(towns: DataFrame, cities: DataFrame) -> DataFrame:
    """Towns once each: coverage, positions outside the country (none may be), outside their prefecture's box, far from their city."""
    t = _rated_towns(towns, cities)
    return t.agg(F.count(F.lit(1)).alias("towns"), F.count_if("placed").alias("placed"), pct(F.count_if("placed"), F.count(F.lit(1))).alias("coverage_pct"), F.count_if("outside").alias("outside_country"), F.count_if("beyond").alias("outside_pref"),
                 F.count_if(F.col("far_m") > FAR_TOWN_M).alias("far_towns"), F.round(F.max("far_m"), 1).alias("farthest_m"), (F.count_if("outside") == 0).alias("ok"))


def far_by_city(towns: DataFrame, cities: DataFrame) -> DataFrame:
    """(lg_code, farthest_m, farthest_town, n): municipalities with towns far from their own position; of equally far towns the smaller id."""
    t = _rated_towns(towns, cities).where(F.col("far_m") > FAR_TOWN_M)
    town = F.min_by("machiaza_id", F.struct(-F.col("far_m"), "machiaza_id"))
    return t.groupBy("lg_code").agg(F.round(F.max("far_m"), 1).alias("farthest_m"), town.alias("farthest_town"), F.count(F.lit(1)).alias("n"))


def flag_rates(towns: DataFrame, flag: str = "rsdt_addr_flg") -> DataFrame:
    """(pref, flag, n, rate): rows by value of a flag within each prefecture, and their share of its rows."""
    per = towns.groupBy(F.substring("lg_code", 1, 2).alias("pref"), F.col(flag).alias("flag")).agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("rate", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("pref")), 6))  # a few values a prefecture


def rows_per_file(lines: DataFrame, file: str = "file_name", headers: int = 0) -> DataFrame:
    """(file, rows) without ``headers`` lines each."""
    return lines.groupBy(F.col(file).alias("file")).agg((F.count(F.lit(1)) - headers).alias("rows"))


def catalogued(files: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(name, modified): local files by the last part of their path, with the newest date that a catalogue (path, modified) has for that name."""
    base = lambda c: F.substring_index(c, "/", -1)
    newest = catalogue.groupBy(base("path").alias("name")).agg(F.max("modified").alias("modified"))
    return files.select(base("path").alias("name")).where("name <> ''").distinct().join(newest, "name")


def number_gate(distances: DataFrame, metres: str = "metres") -> DataFrame:
    """Distances of numbers from their block: median and p99 by histogram (5 m buckets), maximum, far and broken ones."""
    h = histogram(distances.withColumn("_g", F.lit(0)), ["_g"], metres, 5.0, 600)
    q = histogram_quantile(h, ["_g"], 5.0, {"median_m": 0.5, "p99_m": 0.99})
    a = distances.agg(F.count(metres).alias("numbers"), F.round(F.max(metres), 1).alias("max_m"), F.count_if(F.col(metres) > FAR_NUMBER_M).alias("far"), F.count_if(F.col(metres) > BROKEN_NUMBER_M).alias("broken")).withColumn("_g", F.lit(0))
    return a.join(q, "_g", "left").drop("_g").withColumn("ok", F.col("broken") == 0)  # one row each


def parcel_gate(parcels: DataFrame) -> DataFrame:
    """Lots with a position: distance from their town's centroid (20 m buckets), and the surveyed share."""
    centre = parcels.groupBy("lg", "machiaza_id").agg(F.round(F.avg("lat"), 6).alias("o_lat"), F.round(F.avg("lng"), 6).alias("o_lng"))
    d = parcels.join(centre, ["lg", "machiaza_id"]).withColumn("metres", haversine_m(F.col("lat"), F.col("lng"), F.col("o_lat"), F.col("o_lng"))).withColumn("_g", F.lit(0))
    q = histogram_quantile(histogram(d, ["_g"], "metres", 20.0, 500), ["_g"], 20.0, {"median_m": 0.5, "p99_m": 0.99})
    a = d.groupBy("_g").agg(F.count(F.lit(1)).alias("lots"), pct(F.count_if((F.col("scale") > 0) & (F.col("scale") <= 500)), F.count(F.lit(1))).alias("surveyed_pct"))
    return a.join(q, "_g", "left").drop("_g")


def scale_counts(parcels: DataFrame) -> DataFrame:
    return parcels.groupBy("scale").agg(F.count(F.lit(1)).alias("n"))


def file_gate(spark, path: str) -> DataFrame:
    """Number of files below path, their bytes and the largest: from the listing alone, contents aren't read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).drop("content")
    return f.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.max("length").alias("largest")).withColumn("ok", (F.col("files") <= MAX_FILES) & (F.coalesce("largest", F.lit(0)) <= MAX_FILE_BYTES))


def regression_gate(now: DataFrame, before: DataFrame) -> DataFrame:
    """(metric, before, now, change, ok) of two metric tables (metric, kind, value); kind: coverage, count, median or outliers."""
    j = now.select("metric", "kind", F.col("value").alias("now")).join(before.select("metric", F.col("value").alias("before")), "metric", "left")
    growth = F.when(F.col("before") != 0, (F.col("now") - F.col("before")) / F.col("before") * 100)
    change = F.when(F.col("kind") == "coverage", F.col("now") - F.col("before")).otherwise(growth)
    ok = (F.when(F.col("kind") == "coverage", change >= -COVERAGE_DROP).when(F.col("kind") == "count", change >= -COUNT_DROP)
          .when(F.col("kind") == "median", F.abs(change) <= MEDIAN_CHANGE).otherwise(change <= OUTLIER_GROWTH))
    return j.select("metric", "before", "now", change.alias("change"), F.coalesce(ok, F.lit(True)).alias("ok"))


def _hull(xy: np.ndarray) -> np.ndarray:
    """Convex hull of planar points; few points are returned as they are."""
    pts = np.unique(xy, axis=0)
    if len(pts) < 4:
        return pts

    def half(seq):
        out: list = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def _to_plane(lat: np.ndarray, lng: np.ndarray) -> np.ndarray:
    return np.stack([lat, lng], axis=1)


def group_spread(df: DataFrame, keys: list[str], salts: int = 16) -> DataFrame:
    """(keys, spread_m): greatest distance between two positions of a group, without forming its pairs.

    The farthest two of a group that spans a few degrees are corners of its convex hull; hulls merge, so big groups are first reduced in
    ``salts`` parts.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", lat double, lng double"

    def corners(pdf: pd.DataFrame) -> pd.DataFrame:
        h = _hull(_to_plane(pdf["lat"].to_numpy(), pdf["lng"].to_numpy()))
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] * len(h) for k in keys}, "lat": h[:, 0], "lng": h[:, 1]})

    def widest(pdf: pd.DataFrame) -> pd.DataFrame:
        h = np.radians(_hull(_to_plane(pdf["lat"].to_numpy(), pdf["lng"].to_numpy())))
        a = np.sin((h[:, None, 0] - h[None, :, 0]) / 2) ** 2 + np.cos(h[:, None, 0]) * np.cos(h[None, :, 0]) * np.sin((h[:, None, 1] - h[None, :, 1]) / 2) ** 2
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "spread_m": [2 * 6_371_000.0 * float(np.arcsin(np.minimum(1, np.sqrt(a.max()))))]})

    p = df.where("lat is not null and lng is not null").select(*keys, "lat", "lng").distinct().withColumn("_salt", F.pmod(F.xxhash64("lat", "lng"), F.lit(salts)))
    reduced = p.groupBy(*keys, "_salt").applyInPandas(lambda pdf: corners(pdf), schema)
    return reduced.groupBy(*keys).applyInPandas(lambda pdf: widest(pdf), ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", spread_m double")


def key_collisions(names: DataFrame, keys: list[str], name: str, ident: str) -> DataFrame:
    """(keys, names, ids, spread_m, class): keys that stand for several different names of different places."""
    g = names.groupBy(*keys).agg(F.count_distinct(name).alias("names"), F.count_distinct(ident).alias("ids")).where("names > 1")
    s = group_spread(names.join(g.select(*keys), keys, "left_semi"), keys)
    out = g.join(s, keys, "left").withColumn("spread_m", F.round("spread_m", 1))
    return out.withColumn("class", spread_class(F.col("spread_m")))


def accuracy_audit(found: DataFrame, level: str = "match_level", metres: str = "metres") -> DataFrame:
    """(level, n, p50, p90, p99, within shares): distances from an outside source by level of the match."""
    q = index_quantile(found, [level], metres, {"p50": 0.5, "p90": 0.9, "p99": 0.99}).drop("n")
    w = within_shares(found.where(F.col(metres).isNotNull()), [level], metres, {"within_10": 10, "within_50": 50, "within_100": 100, "within_500": 500})
    return w.join(q, level)


def town_coverage(towns: DataFrame, numbers: DataFrame, keys: list[str]) -> DataFrame:
    """Share of towns with at least one number."""
    return coverage(towns, numbers, keys)


def coverage_extremes(df: DataFrame, by: str, hit: Column, at_least: int, n: int = 10) -> DataFrame:
    """(side, rank, by, total, hits, ratio): the n groups covered best and worst among those of some size."""
    g = df.groupBy(by).agg(F.count(F.lit(1)).alias("total"), F.count_if(hit).alias("hits")).where(F.col("total") >= at_least).withColumn("ratio", F.round(F.col("hits") / F.col("total"), 6))
    both = g.withColumn("side", F.explode(F.array(F.lit("best"), F.lit("worst"))))
    return top_n(both, ["side"], [F.when(F.col("side") == "best", -F.col("ratio")).otherwise(F.col("ratio")), F.asc(by)], n)


def profile(df: DataFrame, column: str) -> DataFrame:
    """(first, n, distinct): rows and distinct values by first letter, to judge how evenly shards would fill."""
    return df.where(F.col(column) != "").groupBy(F.substring(column, 1, 1).alias("first")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(column).alias("distinct"))
