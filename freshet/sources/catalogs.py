"""Gage catalogs and reference-gage selection."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of the published gage site table.
SITE_SCHEMA = (
    "STAID string, STANAME string, DRAIN_SQKM double, HUC02 string, LAT_GAGE double, LNG_GAGE double, "
    "STATE string, BOUND_SOURCE string, `HCDN-2009` string, HBN36 string, OLD_HCDN string, NSIP_SENTINEL string"
)


def read_gage_catalog(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV gage table. Ids stay strings; blank and ND are null.

    Without a schema every column is read as a string (no inference pass over the file).
    """
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("nullValue", "ND")
    if schema:
        reader = reader.schema(schema)
    table = reader.csv(path)
    blanks = {c: F.when(F.trim(F.col(f"`{c}`")) != "", F.col(f"`{c}`")) for c, t in table.dtypes if t == "string"}
    return table.withColumns(blanks)


def reference_gages(
    classification: DataFrame, sites: DataFrame, class_value: str = "Ref", region: str | None = None
) -> DataFrame:
    """Reference-class gages, of one aggregate region if given, with their site columns."""
    kept = classification.filter(F.col("CLASS") == class_value)
    if region is not None:
        kept = kept.filter(F.col("AGGECOREGION") == region)
    return kept.join(sites, "STAID", "left")


def unregulated_gages(stations: DataFrame, regulation: DataFrame) -> DataFrame:
    """Stations whose regulation record says they are not regulated; unknown ones are dropped."""
    return stations.join(regulation, "STATION_NUMBER", "left").filter(F.col("REGULATED") != F.lit(True))
