"""Nearest stations of points, by widening grids.

In each round points and stations meet by grid cell, stations also in the eight cells around, so a round is an equi-join.  A
point is done when its k-th neighbour is nearer than the border of what it has seen; only the others go on to
the next, coarser grid.  The last grid has one cell for the whole earth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from azanami.functions.geo import METRES_PER_DEGREE, finite, haversine_m
from azanami.runtime import Stage

CELLS = (0.1, 0.5, 3.0, 20.0, 400.0)


def nearest_stations(points: DataFrame, ident: str, stations: DataFrame, limit: int = 10, group_by_station: bool = False, max_distance: float | None = None, cells: tuple[float, ...] = CELLS) -> DataFrame:
    """(ident, rank, code, group_code, distance_m): the ``limit`` nearest stations of each point, nearest first.

    points: ident, lat, lng.  stations: code, group_code, lat, lng, ord.  Points that aren't finite numbers have no rows, nor do
    stations without a position take part.  Ties go to the smaller ord.  With ``group_by_station`` a group is listed once, by its
    nearest station.  ``max_distance`` cuts after the limit.
    """
    p = points.select(F.col(ident).alias("_id"), finite(F.col("lat")).alias("lat"), finite(F.col("lng")).alias("lng")).where("lat is not null and lng is not null")
    s = stations.select("code", "group_code", "ord", finite(F.col("lat")).alias("s_lat"), finite(F.col("lng")).alias("s_lng")).where("s_lat is not null and s_lng is not null")
    stage = Stage(points.sparkSession, "nearest")
    left, done = stage.keep(p.dropDuplicates(["_id"]), "points"), None
    for k, size in enumerate(cells):
        last = k == len(cells) - 1
        cell = lambda c, size=size: F.floor(F.col(c) / size).cast("long")
        around = F.array(*(F.struct((cell("s_lat") + a).alias("cy"), (cell("s_lng") + b).alias("cx")) for a in (-1, 0, 1) for b in (-1, 0, 1)))
        spread = s.select("*", F.explode(around).alias("c")).select("*", "c.cy", "c.cx").drop("c")
        seen = left.withColumns({"cy": cell("lat"), "cx": cell("lng")}).join(spread, ["cy", "cx"], "left")
        seen = seen.withColumn("d", haversine_m(F.col("lat"), F.col("lng"), F.col("s_lat"), F.col("s_lng")))
        order = [F.asc_nulls_last("d"), F.asc("ord"), F.asc("code")]
        if group_by_station:
            seen = seen.withColumn("_g", F.row_number().over(Window.partitionBy("_id", "group_code").orderBy(*order))).where("_g = 1")
        ranked = seen.withColumn("rank", F.row_number().over(Window.partitionBy("_id").orderBy(*order))).where(F.col("rank") <= max(limit, 1))
        safe = F.least(F.lit(size * METRES_PER_DEGREE), size * METRES_PER_DEGREE * F.cos(F.radians(F.least(F.abs("lat") + 2 * size, F.lit(90.0))))) * 0.999
        safe = F.when((F.abs("lng") + 2 * size > 180) | (F.abs("lat") + 2 * size > 89), -1.0).otherwise(safe)
        ranked = ranked.withColumn("_far", F.max(F.when(F.col("rank") == limit, F.col("d"))).over(Window.partitionBy("_id")))
        ranked = stage.keep(ranked.withColumn("_ok", F.lit(True) if last else F.coalesce(F.col("_far") <= safe, F.lit(False))), f"round{k}")
        found = ranked.where("_ok and d is not null").select("_id", "rank", "code", "group_code", "d")
        done = found if done is None else done.unionByName(found)
        if last:
            break
        left = ranked.where("not _ok and rank = 1").select("_id", "lat", "lng")
        if left.isEmpty():
            break
    out = done.where(F.col("rank") <= limit)
    if max_distance is not None:
        out = out.where(F.col("d") <= max_distance)
    return out.select(F.col("_id").alias(ident), "rank", "code", "group_code", F.col("d").alias("distance_m"))
