"""Spatial joins on longitude and latitude: nearest grid line, point in polygon, centroids.

Polygons carry ring, an array of struct(lon, lat) in order, closed or not.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from freshet.sources.staging import Staging


def _edges(ring: Column) -> Column:
    """Consecutive vertex pairs (a, b), the last vertex joined to the first."""
    shifted = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.zip_with(ring, shifted, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _crossing(e: Column, lat: Column) -> Column:
    """Longitude where an edge meets a latitude that it spans, never beyond the edge's ends."""
    a, b = e["a"], e["b"]
    at = (b["lon"] - a["lon"]) * F.try_divide(lat - a["lat"], b["lat"] - a["lat"]) + a["lon"]
    return F.least(F.greatest(at, F.least(a["lon"], b["lon"])), F.greatest(a["lon"], b["lon"]))


def _spans(e: Column, lat: Column) -> Column:
    return (e["a"]["lat"] > lat) != (e["b"]["lat"] > lat)


def _on_border(e: Column, lon: Column, lat: Column) -> Column:
    a, b = e["a"], e["b"]
    turn = (b["lon"] - a["lon"]) * (lat - a["lat"]) - (b["lat"] - a["lat"]) * (lon - a["lon"])
    in_box = lon.between(F.least(a["lon"], b["lon"]), F.greatest(a["lon"], b["lon"])) & lat.between(
        F.least(a["lat"], b["lat"]), F.greatest(a["lat"], b["lat"])
    )
    return (turn == 0) & in_box


def inside_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Even-odd ray test; a point on the border is inside."""
    edges = _edges(ring)
    crossed = F.filter(edges, lambda e: _spans(e, lat) & (lon < _crossing(e, lat)))
    return (F.size(crossed) % 2 == 1) | F.exists(edges, lambda e: _on_border(e, lon, lat))


def centroids(polygons: DataFrame, ring: str = "ring") -> DataFrame:
    """Adds lon and lat of the polygon centroid (shoelace sums about the first vertex)."""
    work = polygons.withColumn("_o", F.col(ring)[0]).withColumn("_e", _edges(F.col(ring)))

    def sums(acc, e):
        ax, ay = e["a"]["lon"] - F.col("_o.lon"), e["a"]["lat"] - F.col("_o.lat")
        bx, by = e["b"]["lon"] - F.col("_o.lon"), e["b"]["lat"] - F.col("_o.lat")
        cross = ax * by - bx * ay
        return F.struct(
            (acc["area"] + cross).alias("area"),
            (acc["x"] + (ax + bx) * cross).alias("x"),
            (acc["y"] + (ay + by) * cross).alias("y"),
        )

    zero = F.struct(F.lit(0.0).alias("area"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    work = work.withColumn("_s", F.aggregate("_e", zero, sums))
    return (
        work.withColumns(
            {
                "lon": F.col("_o.lon") + F.try_divide(F.col("_s.x"), 3 * F.col("_s.area")),
                "lat": F.col("_o.lat") + F.try_divide(F.col("_s.y"), 3 * F.col("_s.area")),
            }
        )
        .drop("_o", "_e", "_s")
    )


def nearest_on_axis(
    points: DataFrame, axis: DataFrame, at: str, value: str, rank: str | None = None, out: str = "nearest"
) -> DataFrame:
    """Adds the axis value closest to column `at`; ties go to the lower rank (or value).

    The distinct coordinates and the axis values are range partitioned together, so each
    partition has one stretch of the axis, however far apart its values lie. Windows find the
    value before and the one after a coordinate within its partition; where a partition has
    none, those of the partitions beside it are carried over, a table of one row a partition.
    Points outside the axis take its end; a point without a coordinate (null or NaN) has no
    nearest value. The answers join back on the coordinate.
    """
    spark = points.sparkSession
    staging = Staging(spark, "nearest")
    order = F.col(rank) if rank else F.col(value)
    lines = axis.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("x")).agg(F.min(order).alias("r"))
    line = F.struct(F.col("x").alias("v"), "r")
    places = points.select(F.col(at).cast("double").alias("x")).filter("x is not null and not isnan(x)").distinct()
    both = lines.select("x", line.alias("line")).unionByName(places, allowMissingColumns=True)
    both = staging.keep(both.repartitionByRange("x").withColumn("part", F.spark_partition_id()))
    ends = both.groupBy("part").agg(
        F.min(F.when(F.col("line").isNotNull(), F.struct("x", "line")))["line"].alias("first"),
        F.max(F.when(F.col("line").isNotNull(), F.struct("x", "line")))["line"].alias("last"),
    )
    # One row a partition: what comes before it and after it on the axis.
    parts = sorted(ends.collect())
    before, after, carried = None, None, {}
    for part, _, last in parts:
        carried[part] = [before]
        before = last or before
    for part, first, _ in reversed(parts):
        carried[part].append(after)
        after = first or after
    schema = StructType([StructField("part", IntegerType()), *[StructField(c, both.schema["line"].dataType) for c in ("before", "after")]])
    beside = spark.createDataFrame([(part, *c) for part, c in carried.items()], schema)
    up = Window.partitionBy("part").orderBy("x", F.col("line").isNull())
    down = Window.partitionBy("part").orderBy(F.desc("x"), F.col("line").isNull())
    near = both.withColumns(
        {"below": F.last("line", ignorenulls=True).over(up), "above": F.last("line", ignorenulls=True).over(down)}
    ).filter("line is null")
    near = near.join(F.broadcast(beside), "part")
    found = F.filter(F.array(F.coalesce("below", "before"), F.coalesce("above", "after")), lambda c: c.isNotNull())
    best = F.array_min(
        F.transform(found, lambda c: F.struct(F.abs(c["v"] - F.col("x")).alias("d"), c["r"].alias("r"), c["v"].alias("v")))
    )
    told = near.select(F.col("x").alias("_x"), best["v"].alias(out))
    return points.join(told, F.col(at).cast("double") == F.col("_x"), "left").drop("_x")


# Share of a tile by which an edge counts for the tiles beside it, far above the rounding of a crossing.
TILE_SLACK = 1e-6


def _tiles(low: Column, high: Column, tile: float, slack: float = 0.0) -> Column:
    return F.sequence(F.floor(low / tile - slack), F.floor(high / tile + slack))


def tile_edges(polygons: DataFrame, ring: str = "ring", tile: float = 1.0) -> DataFrame:
    """One row per polygon and tile (_tx, _ty) that it meets, with its columns but the ring.

    _edges are the edges that cross the tile, _odd tells whether the right end of the tile's
    lower side is inside the ring. That decides any point of the tile (`inside_tile`), so no
    row carries the ring: an edge is written once for each tile it crosses. The corners come
    from the edges' crossings of the tile lines, added up along each line. Vertices without a
    coordinate are left out; a polygon without any has no tile.
    """
    staging = Staging(polygons.sparkSession, "tiles")
    known = F.filter(ring, lambda p: p["lon"].isNotNull() & p["lat"].isNotNull() & ~F.isnan(p["lon"]) & ~F.isnan(p["lat"]))
    # Written, so that the number of a polygon holds when a task runs again.
    shapes = staging.keep(polygons.withColumns({ring: known, "_shape": F.monotonically_increasing_id()}))
    lons, lats = F.transform(ring, lambda p: p["lon"]), F.transform(ring, lambda p: p["lat"])
    grid = shapes.select("_shape", _tiles(F.array_min(lons), F.array_max(lons), tile).alias("x"), F.explode(_tiles(F.array_min(lats), F.array_max(lats), tile)).alias("_ty"))
    grid = grid.select("_shape", "_ty", F.explode("x").alias("_tx"))

    e = F.col("_e")
    south, north = F.least(e["a"]["lat"], e["b"]["lat"]), F.greatest(e["a"]["lat"], e["b"]["lat"])
    base = F.col("_ty") * tile
    rows = shapes.select("_shape", F.explode(_edges(F.col(ring))).alias("_e")).withColumn(
        "_ty", F.explode(_tiles(south, north, tile, TILE_SLACK))
    )
    low = _crossing(e, F.greatest(south, base - TILE_SLACK * tile))
    high = _crossing(e, F.least(north, base + (1 + TILE_SLACK) * tile))
    flat = south == north
    left = F.when(flat, F.least(e["a"]["lon"], e["b"]["lon"])).otherwise(F.least(low, high))
    right = F.when(flat, F.greatest(e["a"]["lon"], e["b"]["lon"])).otherwise(F.greatest(low, high))
    crossed = rows.withColumn("_tx", F.explode(_tiles(left, right, tile, TILE_SLACK)))

    # The last tile whose right end lies before the crossing of the line; the ends as inside_tile computes them.
    guess = F.ceil(F.col("at") / tile) - 2
    last = guess + F.when((guess + 2) * tile < F.col("at"), 1).when((guess + 1) * tile < F.col("at"), 0).otherwise(-1)
    corners = rows.filter(_spans(e, base)).withColumn("at", _crossing(e, base)).select("_shape", "_ty", last.alias("_tx"), F.lit(1).alias("n"))

    tiles = (
        grid.unionByName(crossed, allowMissingColumns=True)
        .unionByName(corners, allowMissingColumns=True)
        .groupBy("_shape", "_ty", "_tx")
        .agg(F.collect_list("_e").alias("_edges"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    )
    beyond = Window.partitionBy("_shape", "_ty").orderBy(F.desc("_tx"))
    tiles = tiles.withColumn("_odd", F.sum("n").over(beyond) % 2 == 1).filter("_odd or size(_edges) > 0")
    return tiles.drop("n").join(shapes.drop(ring), "_shape").drop("_shape")


def inside_tile(lon: Column, lat: Column, tile: float) -> Column:
    """The even-odd ray test of a point with a row of `tile_edges`; a point on the border is inside.

    A ray from the point passes as many edges, by parity, as one from the tile's corner (x, y),
    but for edges of this tile: those between the point and the tile's right side, and those
    that cross that side between the two latitudes. The latter are counted by the same
    crossings as the former (an edge over x moves the parity unless its eastern end does), so a
    rounded crossing can never count in one and miss in the other.
    """
    x, y = (F.col("_tx") + 1) * tile, F.col("_ty") * tile

    def flips(e):
        over = (e["a"]["lon"] > x) != (e["b"]["lon"] > x)
        east = F.when(e["a"]["lon"] > x, e["a"]["lat"]).otherwise(e["b"]["lat"])
        side = _spans(e, lat) & (x < _crossing(e, lat))
        corner = _spans(e, y) & (x < _crossing(e, y))
        ahead = _spans(e, lat) & (lon < _crossing(e, lat))
        return (ahead != side) != (over & ((side != corner) != ((east > lat) != (east > y))))

    odd = (F.size(F.filter("_edges", flips)) % 2 == 1) != F.col("_odd")
    return odd | F.exists("_edges", lambda e: _on_border(e, lon, lat))


def points_in_polygons(
    points: DataFrame, polygons: DataFrame, polygon_cols: Sequence[str], ring: str = "ring", tile: float = 1.0
) -> DataFrame:
    """Every (point, polygon) match. Points carry lon and lat; those without are in no polygon.

    Tiles turn the range join into an equi-join, a match is told from the edges of one tile,
    and adaptive execution splits a tile that holds a large part of the points.
    """
    areas = tile_edges(polygons.select(*polygon_cols, ring), ring, tile)
    lon, lat = F.col("lon"), F.col("lat")
    tiled = points.filter(~(F.isnan("lon") | F.isnan("lat"))).withColumns({"_tx": F.floor(lon / tile), "_ty": F.floor(lat / tile)})
    hits = tiled.join(areas, ["_tx", "_ty"]).filter(inside_tile(lon, lat, tile))
    return hits.drop("_tx", "_ty", "_edges", "_odd")


def first_polygon(
    points: DataFrame, polygons: DataFrame, point_id: str, polygon_id: str, ring: str = "ring", tile: float = 1.0
) -> DataFrame:
    """The first polygon (by id) holding each point; null where there is none."""
    slim = points.select(point_id, "lon", "lat")
    hits = points_in_polygons(slim, polygons, [polygon_id], ring, tile)
    first = hits.groupBy(point_id).agg(F.min(polygon_id).alias(polygon_id))
    return points.join(first, point_id, "left")


def zonal_mean(
    cells: DataFrame, polygons: DataFrame, polygon_id: str, values: Sequence[str], by: Sequence[str] = (),
    ring: str = "ring", tile: float = 1.0,
) -> DataFrame:
    """Mean of all grid cells inside each polygon, per polygon and `by` columns.

    Cells are located once per coordinate, not once per time step.
    """
    places = cells.select("lon", "lat").distinct()
    located = points_in_polygons(places, polygons, [polygon_id], ring, tile)
    return cells.join(located, ["lon", "lat"]).groupBy(polygon_id, *by).agg(*[F.avg(v).alias(v) for v in values])
