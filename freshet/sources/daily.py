"""Landed daily discharge in its three layouts, normalised to (gage_id, date, q, ...)."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.functions.calendar import with_calendar
from freshet.functions.cleaning import approved_only, date_window
from freshet.functions.units import cfs_to_mm_usgs, cms_to_mm

USGS_SCHEMA = "agency_cd string, site_no string, Date date, value double, qualifier string"
HYDAT_SCHEMA = "STATION_NUMBER string, Date date, Parameter string, Value double, Symbol string"
CARAVAN_SCHEMA = "time_offset int, streamflow double, total_precipitation_sum double"


def _read(spark: SparkSession, path: str, schema: str, fmt: str) -> DataFrame:
    if fmt == "csv":
        return spark.read.schema(schema).option("header", True).csv(path)
    return spark.read.format(fmt).load(path)


def read_usgs_daily(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    return _read(spark, path, USGS_SCHEMA, fmt)


def usgs_series(raw: DataFrame, gages: DataFrame, start=None, end=None) -> DataFrame:
    """Approved cubic feet per second as mm/day after the start date.

    gages carries gage_id and area (km2).
    """
    flow = approved_only(F.col("value"), F.col("qualifier"))
    rows = raw.select(F.col("site_no").alias("gage_id"), F.col("Date").alias("date"), flow.alias("_cfs"))
    rows = date_window(rows, start, end).join(gages.select("gage_id", "area"), "gage_id")
    rows = rows.withColumn("q", cfs_to_mm_usgs(F.col("_cfs"), F.col("area"))).drop("_cfs", "area")
    return with_calendar(rows)


def read_hydat_daily(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    return _read(spark, path, HYDAT_SCHEMA, fmt)


def hydat_series(raw: DataFrame, gages: DataFrame, start=None, end=None) -> DataFrame:
    """The Flow rows of the long parameter table as mm/day after the start date."""
    rows = raw.filter(F.col("Parameter") == "Flow").select(
        F.col("STATION_NUMBER").alias("gage_id"), F.col("Date").alias("date"), F.col("Value").alias("_cms")
    )
    rows = date_window(rows, start, end).join(gages.select("gage_id", "area"), "gage_id")
    rows = rows.withColumn("q", cms_to_mm(F.col("_cms"), F.col("area"))).drop("_cms", "area")
    return with_calendar(rows)


def days_since(units, offset):
    """Date from a "days since <date>[ time]" text and a number of days."""
    origin = F.regexp_extract(units, r"days since (\d{4}-\d{2}-\d{2})", 1)
    return F.date_add(F.try_to_date(origin, "yyyy-MM-dd"), offset.cast("int"))


def with_watershed(files: DataFrame, path_col: str = "path") -> DataFrame:
    """watershed_id and data_project from a file name <project>_<watershed>.<ext>."""
    stem = F.regexp_extract(F.col(path_col), r"([^/\\]+)\.[A-Za-z0-9]+$", 1)
    return files.withColumns(
        {"data_project": F.regexp_extract(stem, r"^([^_]+)_", 1), "watershed_id": F.regexp_replace(stem, r"^[^_]+_", "")}
    )


def read_caravan(
    spark: SparkSession, path: str, start=None, end=None, schema: str = "units string, " + CARAVAN_SCHEMA, fmt: str = "csv"
) -> DataFrame:
    """A directory of one file per watershed as one long table (dates inclusive at both ends).

    Ids come from the file name; dates from the "days since" text of the units column.
    """
    raw = _read(spark, path, schema, fmt).select("*", F.col("_metadata.file_path").alias("path"))
    return caravan_series(with_watershed(raw), start, end)


def caravan_series(raw: DataFrame, start=None, end=None) -> DataFrame:
    rows = raw.select(
        "data_project",
        "watershed_id",
        days_since(F.col("units"), F.col("time_offset")).alias("date"),
        F.col("streamflow").alias("q"),
        F.col("total_precipitation_sum").alias("ppt"),
    )
    return with_calendar(date_window(rows, start, end, open_start=False))
