"""Points near other points, or inside regions, by trapezoidal decomposition.

A region is cut by horizontal slabs, and within a slab at its corners, into trapezoids between a left and a right edge.  The
region of a site is the disc of the given radius, of which every slab holds a piece between two tangents.  Slabs are cut into tiles
along longitude so that a busy latitude is shared by many tasks; a trapezoid that crosses a tile's border is stored in
either.  A point is located by two binary searches among its tile's trapezoids, ordered by their left ends, and a look at the
edges' sides; for discs the exact distance then decides.  Positions are searched once however often they repeat.

A tile with more than 1/``SLICES`` of all points or of all trapezoids is divided among tasks in both directions: each of so many
parts of its points meets each of so many parts of its trapezoids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from azanami.functions.geo import EARTH_RADIUS_M, METRES_PER_DEGREE, finite, haversine_m, in_box
from azanami.operators.skew import SLICES, join_salted
from azanami.runtime import Stage

#: Tiles are so many slabs wide.
TILE_SLABS = 16
#: Slack of the discs' trapezoids in degrees, well above rounding and below any distance that matters.
SLACK = 1e-7
#: Points or trapezoids that one task may hold in any case.
FEW = 20_000
_EDGES = ["y0", "y1", "l0", "l1", "r0", "r1"]


def decompose(rings: list[np.ndarray], height: float) -> np.ndarray:
    """Trapezoids (y0, y1, left x at y0, at y1, right x at y0, at y1) of what an odd number of the rings' sides encloses.

    rings: arrays of (lat, lng), closed or not.  Sides may touch but not cross.  Each trapezoid lies in one slab of the given height.
    """
    a = np.concatenate([r for r in rings])
    b = np.concatenate([np.roll(r, -1, axis=0) for r in rings])
    up = a[:, 0] <= b[:, 0]
    lo, hi = np.where(up[:, None], a, b), np.where(up[:, None], b, a)
    keep = lo[:, 0] < hi[:, 0]
    lo, hi = lo[keep], hi[keep]
    if not len(lo):
        return np.zeros((0, 6))
    first, last = int(np.floor(lo[:, 0].min() / height)), int(np.floor(hi[:, 0].max() / height))
    ys = np.unique(np.concatenate([lo[:, 0], hi[:, 0], np.arange(first + 1, last + 1) * height]))
    ys = ys[(ys >= lo[:, 0].min()) & (ys <= hi[:, 0].max())]
    i, j = np.searchsorted(ys, lo[:, 0]), np.searchsorted(ys, hi[:, 0])
    side = np.repeat(np.arange(len(lo)), j - i)
    level = np.arange(len(side)) - np.repeat(np.cumsum(j - i) - (j - i), j - i) + i[side]
    at = lambda y: lo[side, 1] + (hi[side, 1] - lo[side, 1]) * (y - lo[side, 0]) / (hi[side, 0] - lo[side, 0])
    x0, x1 = at(ys[level]), at(ys[level + 1])
    order = np.lexsort((x0 + x1, level))
    x0, x1, level = x0[order], x1[order], level[order]
    return np.stack([ys[level[::2]], ys[level[::2] + 1], x0[::2], x1[::2], x0[1::2], x1[1::2]], axis=1)


def _decomposed(height: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for ident, rings in zip(pdf["name"], pdf["rings"]):
                shape = [np.array([(p["lat"], p["lng"]) for p in r], dtype=float) for r in rings if r is not None and len(r) > 2 and all(p is not None for p in r)]
                shape = [r for r in shape if np.isfinite(r).all()]
                if shape:
                    yield pd.DataFrame(decompose(shape, height), columns=_EDGES).assign(name=ident)

    return run


def _discs(sites: DataFrame, radius_m: float, height: float) -> DataFrame:
    """Trapezoids around the pieces of each site's disc: in every slab the tangents at the middle of the piece."""
    half_sine = float(np.sin(radius_m / EARTH_RADIUS_M / 2))
    # no point of the disc is wider than this ellipse: half-axes of the radius along latitude, and of ``wide`` along longitude
    wide = 2 * F.degrees(F.asin(F.least(F.lit(1.0), F.lit(half_sine) / F.cos(F.radians(F.abs("lat") + F.lit(height)))))) + SLACK
    reach = height + SLACK
    slabs = F.sequence(_floor(F.col("lat") - reach, height), _floor(F.col("lat") + reach, height))
    s = sites.select("lat", "lng", wide.alias("_w"), F.explode(slabs).alias("slab"))
    ends = {"y0": F.greatest(F.col("slab") * height, F.col("lat") - reach), "y1": F.least((F.col("slab") + 1) * F.lit(height), F.col("lat") + reach)}
    s = s.withColumns(ends).where("y0 < y1")
    u = lambda y: (F.col(y) - F.col("lat")) / reach
    s = s.withColumn("_m", (u("y0") + u("y1")) / 2).withColumn("_c", F.sqrt(1 - F.col("_m") * F.col("_m")))
    x = lambda y: F.col("_w") * (1 - F.col("_m") * u(y)) / F.col("_c")
    return s.select("lat", "lng", F.lit(None).cast("string").alias("name"), "y0", "y1", (F.col("lng") - x("y0")).alias("l0"), (F.col("lng") - x("y1")).alias("l1"), (F.col("lng") + x("y0")).alias("r0"), (F.col("lng") + x("y1")).alias("r1"))


def _floor(c: Column, unit: float) -> Column:
    return F.floor(c / F.lit(unit)).cast("long")


def _sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Match points to the trapezoids of their cell; input sorted by cell, trapezoids before points."""
    carry = None  # trapezoids of the cell that the last batch ended in
    for pdf in batches:
        if not len(pdf):
            continue
        edges = pdf[pdf["kind"] == 0]
        if carry is not None and len(carry):
            edges = pd.concat([carry, edges], ignore_index=True)
        points = pdf[pdf["kind"] == 1]
        if len(points) and len(edges):
            yield _locate(edges, points)
        tail = pdf[_CELL].iloc[-1]
        carry = edges[(edges[_CELL] == tail).all(axis=1)]


_CELL = ["slab", "tile", "pp", "pe"]


def _locate(edges: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
    both = np.concatenate([edges[_CELL].to_numpy(), points[_CELL].to_numpy()])
    _, cell = np.unique(both, axis=0, return_inverse=True)
    cell = cell.reshape(-1)
    ce, cp = cell[: len(edges)], cell[len(edges) :]
    begin = edges["x"].to_numpy()
    order = np.lexsort((begin, ce))
    ce, begin = ce[order], begin[order]
    y0, y1, l0, l1, r0, r1 = (edges[c].to_numpy()[order] for c in _EDGES)
    reach = float((np.maximum(r0, r1).clip(max=edges["x2"].to_numpy()[order]) - begin).max())
    x, y = points["lng"].to_numpy(), points["lat"].to_numpy()
    first, last = np.searchsorted(ce, cp, "left"), np.searchsorted(ce, cp, "right")  # the cell's trapezoids
    lo, hi = _bisect(begin, first, last, x - reach), _bisect(begin, first, last, x)
    n = np.maximum(hi - lo, 0)
    p = np.repeat(np.arange(len(points)), n)
    e = np.repeat(lo, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    t = (y[p] - y0[e]) / (y1[e] - y0[e])
    ok = (y0[e] <= y[p]) & (y[p] < y1[e]) & (l0[e] + t * (l1[e] - l0[e]) <= x[p]) & (x[p] < r0[e] + t * (r1[e] - r0[e]))
    p, e = p[ok], order[e[ok]]
    return pd.DataFrame({"p_lat": y[p], "p_lng": x[p], "s_lat": edges["lat"].to_numpy()[e], "s_lng": edges["lng"].to_numpy()[e], "name": edges["name"].to_numpy()[e]})


def _bisect(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For each x the first index in [lo, hi) whose value exceeds it all searches in step."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        go = lo < hi
        if not go.any():
            return lo
        mid = (lo + hi) >> 1
        up = np.zeros(len(go), dtype=bool)
        up[go] = values[mid[go]] <= x[go]
        lo = np.where(go & up, mid + 1, lo)
        hi = np.where(go & ~up, mid, hi)


def located(points: DataFrame, trapezoids: DataFrame, height: float, slices: int = SLICES, few: int = FEW) -> DataFrame:
    """(p_lat, p_lng, s_lat, s_lng, name) of the distinct points (lat, lng) with every trapezoid (lat, lng, name, y0 .. r1) that holds them."""
    width = TILE_SLABS * height
    stage = Stage(points.sparkSession, "located")
    t = trapezoids.withColumn("slab", _floor((F.col("y0") + F.col("y1")) / 2, height))
    t = t.select("*", F.explode(F.sequence(_floor(F.least("l0", "l1"), width), _floor(F.greatest("r0", "r1"), width))).alias("tile"))
    t = t.withColumns({"kind": F.lit(0), "x": F.greatest(F.least("l0", "l1"), F.col("tile") * F.lit(width)), "x2": (F.col("tile") + 1) * F.lit(width)})
    p = points.select("lat", "lng").distinct().select("lat", "lng", _floor(F.col("lat"), height).alias("slab"), _floor(F.col("lng"), width).alias("tile"), F.lit(1).alias("kind"))
    both = stage.keep(t.unionByName(p, allowMissingColumns=True), "cells")
    load = stage.keep(both.groupBy("slab", "tile").agg(F.count_if(F.col("kind") == 1).alias("p"), F.count_if(F.col("kind") == 0).alias("e")), "load")
    all_p, all_e = load.agg(F.coalesce(F.sum("p"), F.lit(0)), F.coalesce(F.sum("e"), F.lit(0))).first()
    bar_p, bar_e = max(all_p // slices, few), max(all_e // slices, few)
    busy = load.where((F.col("p") > bar_p) | (F.col("e") > bar_e)).select("slab", "tile", F.ceil(F.col("p") / bar_p).cast("int").alias("np"), F.ceil(F.col("e") / bar_e).cast("int").alias("ne"))
    tagged = both.join(load.where("p > 0 and e > 0").select("slab", "tile"), ["slab", "tile"], "left_semi").join(F.broadcast(busy), ["slab", "tile"], "left")  # fewer than 2 * slices rows
    parts = lambda n: F.greatest(F.coalesce(F.col(n), F.lit(1)), F.lit(1))
    own = lambda n: F.pmod(F.xxhash64("lat", "lng", "y0"), parts(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), parts(n) - 1)
    is_p = F.col("kind") == 1
    tagged = tagged.select("*", F.explode(F.when(is_p, F.array(own("np"))).otherwise(every("np"))).alias("pp"))
    tagged = tagged.select("*", F.explode(F.when(is_p, every("ne")).otherwise(F.array(own("ne")))).alias("pe")).drop("np", "ne")
    tagged = tagged.repartition(*_CELL).sortWithinPartitions(*_CELL, "kind")
    return tagged.mapInPandas(_sweep, "p_lat double, p_lng double, s_lat double, s_lng double, name string")


def matching_positions(points: DataFrame, sites: DataFrame, radius_m: float, **how) -> DataFrame:
    """Distinct positions (p_lat, p_lng) and (s_lat, s_lng) at most radius_m apart.

    points and sites have ``lat`` and ``lng``, neither null, and lie away from the poles.
    """
    height = radius_m / METRES_PER_DEGREE
    found = located(points, _discs(sites.select("lat", "lng").distinct(), radius_m, height), height, **how)
    return found.drop("name").where(haversine_m(F.col("p_lat"), F.col("p_lng"), F.col("s_lat"), F.col("s_lng")) <= radius_m)


def _with_rows(found: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows (_pid, lat, lng) with what was found at their position."""
    per_spot = rows.groupBy(F.col("lat").alias("p_lat"), F.col("lng").alias("p_lng")).agg(F.count(F.lit(1)).alias("n"))
    return join_salted(rows.withColumnsRenamed({"lat": "p_lat", "lng": "p_lng"}), found, ["p_lat", "p_lng"], per_spot, "n", "_pid")


def pairs_within(points: DataFrame, point_id: str, sites: DataFrame, site_id: str, radius_m: float = 250.0, lat: str = "lat", lng: str = "lng", **how) -> DataFrame:
    """All pairs (point_id, site_id) at most radius_m apart by the haversine formula.

    Rows whose coordinates are null, NaN or outside 20..46 / 122..154 take no part, coordinates being taken as they stand.
    Repeated rows give repeated pairs; rows at one position each give their own.  Further columns don't matter.
    """
    p = points.select(F.col(point_id).alias("_pid"), F.col(lat).alias("lat"), F.col(lng).alias("lng")).where(in_box(F.col("lat"), F.col("lng")))
    s = sites.select(F.col(site_id).alias("_sid"), F.col(lat).alias("lat"), F.col(lng).alias("lng")).where(in_box(F.col("lat"), F.col("lng")))
    found = matching_positions(p, s, radius_m, **how)
    with_sites = found.join(s.withColumnsRenamed({"lat": "s_lat", "lng": "s_lng"}), ["s_lat", "s_lng"]).select("p_lat", "p_lng", "_sid")
    out = _with_rows(with_sites, p)
    return out.select(F.col("_pid").alias(point_id), F.col("_sid").alias(site_id))


def containing_regions(points: DataFrame, point_id: str, regions: DataFrame, region_id: str, rings: str = "rings", height: float = 0.1, lat: str = "lat", lng: str = "lng", **how) -> DataFrame:
    """All pairs (point_id, region_id) of points and the regions that contain them; regions may overlap.

    ``rings``: array of rings, each an array of (lat, lng), whose sides must not cross; a ring within a ring is a hole.  A point on a
    region's lower or left border is inside, on its upper or right border outside.  Points with coordinates that are null or not finite, null
    region ids, and rings of fewer than three corners or with a missing one take no part; of a region given twice each row counts.
    """
    p = points.select(F.col(point_id).alias("_pid"), finite(F.col(lat)).alias("lat"), finite(F.col(lng)).alias("lng")).where("lat is not null and lng is not null")
    r = regions.select(F.col(region_id).cast("string").alias("name"), F.col(rings).alias("rings")).where("name is not null and rings is not null")
    shapes = r.mapInPandas(_decomposed(height), ", ".join(f"{c} double" for c in _EDGES) + ", name string")
    shapes = shapes.withColumns({"lat": F.lit(None).cast("double"), "lng": F.lit(None).cast("double")})
    found = located(p, shapes, height, **how).select("p_lat", "p_lng", F.col("name").cast(regions.schema[region_id].dataType).alias("_rid"))
    return _with_rows(found, p).select(F.col("_pid").alias(point_id), F.col("_rid").alias(region_id))
