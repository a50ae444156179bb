"""From a climate cube to basin climate: fill, repair, area means, one output per initialisation."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.operators import climate, gaps
from freshet.sources.sinks import write_per_key
from freshet.sources.staging import Staging

VARIABLES = ["tmin", "tmax", "ppt", "pet"]


def filled_cube(grid: DataFrame, cube: Sequence[str] = ("init_date",), values: Sequence[str] = VARIABLES) -> DataFrame:
    """The grid with each unknown cell at the median of its variable over its own cube."""
    return gaps.fill_median(grid, values, by=cube)


def basin_series(
    grid: DataFrame,
    subbasins: DataFrame,
    cube: Sequence[str] = ("init_date",),
    layout: str = "seas5",
    temp_offset: float | None = None,
    precip_factor: float | None = None,
) -> DataFrame:
    """Basin climate of all cubes: fill by cube, crossed temperatures, area-weighted means.

    The filled cube is written once and read by the weights and the means. A variable that is
    unknown in a whole cube stays unknown.
    """
    staging = Staging(grid.sparkSession, "climate")
    filled = staging.keep(filled_cube(grid, cube))
    cells = staging.keep(filled.select("lon", "lat").distinct())
    axes = cells.select("lon").distinct(), cells.select("lat").distinct()
    return climate.basin_climate(filled, subbasins, layout, temp_offset, precip_factor, axes=axes)


def archive(
    grid: DataFrame, subbasins: DataFrame, path: str, batch: int = 64, most: int | None = None, **settings
) -> DataFrame:
    """Writes basin_series() under path, one folder per init_date, and reads the archive back.

    Initialisations that the ledger of the archive names are not computed again, so a stopped
    run goes on where it ended (see write_per_key() for batch and most).
    """
    kept = write_per_key(grid, lambda todo: basin_series(todo, subbasins, **settings), path, "init_date", batch, most)
    return kept.withColumn("init_date", F.col("init_date").cast("date"))
