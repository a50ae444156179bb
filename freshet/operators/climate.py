"""Area-weighted basin climate from a long climate grid.

grid(lon, lat, member, init_date, date, tmin, tmax, ppt, pet); sub-basins(basin,
hybas_id, lon, lat of the centroid, sub_area).
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.functions.cleaning import adjust, mean_temperature, ordered_tmin
from freshet.operators.spatial import nearest_on_axis

SERIES = ["member", "init_date", "date"]


def cell_weights(
    subbasins: DataFrame, grid: DataFrame, axes: tuple[DataFrame, DataFrame] | None = None
) -> DataFrame:
    """(basin, lon, lat, area): the area each grid cell stands for in a basin.

    Longitude and latitude are matched on their own; several sub-basins may share a cell.
    axes, tables of the lon and the lat values, saves the scans of the grid that find them.
    """
    lons, lats = axes or (grid.select("lon").distinct(), grid.select("lat").distinct())
    slim = subbasins.select("basin", "sub_area", F.col("lon").alias("at_lon"), F.col("lat").alias("at_lat"))
    picked = nearest_on_axis(slim, lons, "at_lon", "lon", out="cell_lon")
    picked = nearest_on_axis(picked, lats, "at_lat", "lat", out="cell_lat")
    return picked.groupBy("basin", F.col("cell_lon").alias("lon"), F.col("cell_lat").alias("lat")).agg(
        F.sum("sub_area").alias("area")
    )


def basin_climate(
    grid: DataFrame,
    subbasins: DataFrame,
    layout: str = "seas5",
    temp_offset: float | None = None,
    precip_factor: float | None = None,
    by: Sequence[str] = SERIES,
    axes: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """Area-weighted tmin, tmax, tavg, ppt and pet per basin and time step.

    Forecast layouts (seas5, seas5Multi) repair crossed temperatures first; era5 does
    not. A mean with a cell unknown is unknown: plans.climate fills the grid first, and writes one
    output per initialisation.
    """
    if layout != "era5":
        grid = grid.withColumn("tmin", ordered_tmin(F.col("tmin"), F.col("tmax")))
    weights = cell_weights(subbasins, grid, axes)
    joined = grid.join(weights, ["lon", "lat"])

    def mean(v: str):
        return F.when(F.count(v) == F.count("*"), F.try_divide(F.sum(F.col(v) * F.col("area")), F.sum("area")))

    out = joined.groupBy("basin", *by).agg(
        adjust(mean("tmin"), offset=temp_offset).alias("tmin"),
        adjust(mean("tmax"), offset=temp_offset).alias("tmax"),
        adjust(mean("ppt"), factor=precip_factor).alias("ppt"),
        mean("pet").alias("pet"),
    )
    return out.withColumn("tavg", mean_temperature(F.col("tmin"), F.col("tmax")))
