"""Reservoir and flow sensor files: DATE TIME as "yyyymmdd hhmm", VALUE as text."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Sensor numbers of the reservoir service.
SENSORS = {"full_natural_flow": 8, "storage": 15, "outflow": 23, "inflow": 76}


def parse_sensor(raw: DataFrame, date_time: str = "DATE TIME", value: str = "VALUE", out: str = "value") -> DataFrame:
    """date from the first word of the time stamp, the value as a number; junk is null."""
    day = F.split(F.col(f"`{date_time}`"), " ")[0]
    rest = [F.col(f"`{c}`") for c in raw.columns if c not in (date_time, value)]
    return raw.select(
        *rest,
        F.try_to_date(day, "yyyyMMdd").alias("date"),
        F.expr(f"try_cast(`{value}` as double)").alias(out),
    )


def read_sensor_csv(spark: SparkSession, path: str, out: str = "value", with_station: bool = False) -> DataFrame:
    """Sensor CSV files; every column is text until parsed."""
    raw = spark.read.option("header", True).csv(path)
    columns = ["DATE TIME", "VALUE", *(["STATION_ID"] if with_station else [])]
    return parse_sensor(raw.select(*[F.col(f"`{c}`") for c in columns]), out=out)


def reservoir_series(storage: DataFrame, inflow: DataFrame, keys: list[str]) -> DataFrame:
    """Storage days with the inflow of the day where there is one."""
    return storage.join(inflow, [*keys, "date"], "left")
