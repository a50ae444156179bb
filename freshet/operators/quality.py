"""Which years and gages carry enough record to be used."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from freshet.functions.calendar import with_calendar

GAGE = ["gage_id"]


def one_per_day(df: DataFrame, keys: Sequence[str], date: str = "date", **how: str) -> DataFrame:
    """Aggregate to one row per key and day, e.g. q="sum".

    This is what bounds every per-gage and per-year window of the library by the
    calendar, whatever the raw rows look like; partial sums combine before the
    shuffle, so a gage with most of the rows costs no more than any other.
    """
    aggs = [getattr(F, fn)(c).alias(c) for c, fn in how.items()]
    return with_calendar(df.groupBy(*keys, date).agg(*aggs), date)


def valid_years(
    daily: DataFrame, min_q: float = 0.0001, min_days: int = 30, keys: Sequence[str] = GAGE, strict: bool = False
) -> DataFrame:
    """(keys, year, n_days) of years with at least (strict: more than) min_days flows above min_q."""
    n = F.count_if(F.col("q") > min_q)
    counted = daily.groupBy(*keys, "year").agg(n.alias("n_days"))
    return counted.filter(F.col("n_days") > min_days if strict else F.col("n_days") >= min_days)


def gages_with_years(
    years: DataFrame, min_years: int = 20, keys: Sequence[str] = GAGE, strict: bool = False
) -> DataFrame:
    """Gages that keep at least (strict: more than) min_years valid years."""
    counted = years.groupBy(*keys).agg(F.count("*").alias("num_years"))
    return counted.filter(F.col("num_years") > min_years if strict else F.col("num_years") >= min_years)


def long_enough(
    daily: DataFrame, min_years: int, start=None, keys: Sequence[str] = GAGE
) -> DataFrame:
    """Raw gate: more than 365 rows per required year and a last date after start."""
    gates = F.col("n_rows") > 365 * min_years
    if start is not None:
        gates = gates & (F.col("last_date") > F.lit(start).cast("date"))
    counted = daily.groupBy(*keys).agg(
        F.count("*").alias("n_rows"), F.max("date").alias("last_date"), F.count_distinct("year").alias("n_years")
    )
    return counted.filter(gates)


def enough_distinct_years(daily: DataFrame, min_years: int, keys: Sequence[str] = GAGE) -> DataFrame:
    """Collection gate: gages whose records touch at least min_years different years."""
    years = daily.select(*keys, "year").distinct()
    return gages_with_years(years, min_years, keys)


def restrict_to_valid_years(
    daily: DataFrame,
    min_q: float = 0.0001,
    min_days: int = 30,
    min_years: int = 20,
    keys: Sequence[str] = GAGE,
    strict: bool = False,
) -> DataFrame:
    """Rows of valid years of gages that have enough of them.

    The same gates as valid_years and gages_with_years, as windows: on a table that is
    partitioned by gage they move no rows, where a semi-join would shuffle the days again.
    """
    flowing = F.count_if(F.col("q") > min_q).over(Window.partitionBy(*keys, "year"))
    years = F.size(F.collect_set("year").over(Window.partitionBy(*keys)))
    kept = daily.withColumn("_days", flowing)
    kept = kept.filter(F.col("_days") > min_days if strict else F.col("_days") >= min_days)
    kept = kept.withColumn("_years", years)
    kept = kept.filter(F.col("_years") > min_years if strict else F.col("_years") >= min_years)
    return kept.drop("_days", "_years")


def record_header(
    daily: DataFrame, upstream: DataFrame | None = None, keys: Sequence[str] = GAGE
) -> DataFrame:
    """num_years, start_year, end_year and, when given, num_upstream_basins per gage."""
    years = daily.select(*keys, "year").distinct()
    header = years.groupBy(*keys).agg(
        F.count("*").alias("num_years"), F.min("year").alias("start_year"), F.max("year").alias("end_year")
    )
    if upstream is None:
        return header
    counts = upstream.select(*keys, "num_upstream_basins")
    return header.join(counts, list(keys), "left")
