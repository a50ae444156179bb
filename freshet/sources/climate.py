"""Long climate grids from the three cube layouts."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def normalise_grid(
    raw: DataFrame, layout: str, start_date: str, days_per_step: float = 1.0, members: int | None = None
) -> DataFrame:
    """lon, lat, member, init_date, date and the variables, whatever the cube layout.

    era5 has a time column; seas5 adds lead_time and member; seas5Multi adds init_time.
    Valid date = start + days_per_step * (lead [+ init]). members keeps the first so many.
    """
    start = F.lit(start_date).cast("date")

    def days(col: str):
        return (F.col(col) * days_per_step).cast("int")

    if layout == "era5":
        date, init, member = F.date_add(start, days("time")), F.lit(None).cast("date"), F.lit(1)
    elif layout == "seas5":
        date, init, member = F.date_add(start, days("lead_time")), start, F.col("member")
    elif layout == "seas5Multi":
        init = F.date_add(start, days("init_time"))
        date, member = F.date_add(init, days("lead_time")), F.col("member")
    else:
        raise ValueError(f"unknown layout {layout}")
    out = raw.select(
        "lon", "lat", member.cast("int").alias("member"), init.alias("init_date"), date.alias("date"),
        *[c for c in ("tmin", "tmax", "ppt", "pet") if c in raw.columns],
    )
    return out.filter(F.col("member") <= members) if members is not None else out


def read_climate_grid(
    spark: SparkSession, path: str, layout: str, start_date: str, days_per_step: float = 1.0, members: int | None = None
) -> DataFrame:
    """Landed long-form cube (Parquet); variable and member selection reach the scan."""
    return normalise_grid(spark.read.parquet(path), layout, start_date, days_per_step, members)
