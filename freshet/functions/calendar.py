"""Calendar keys: year parts, seasons, water years and lead months."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEASONS = ("win", "spr", "sum", "fal")


def with_calendar(df: DataFrame, date: str = "date") -> DataFrame:
    """Add year, month and doy (day of the calendar year) where they are absent."""
    parts = {"year": F.year(date), "month": F.month(date), "doy": F.dayofyear(date)}
    return df.withColumns({k: v for k, v in parts.items() if k not in df.columns})


def season(month: Column) -> Column:
    """Season of the calendar year; December belongs to its own year's winter."""
    return (
        F.when(month.isin(12, 1, 2), "win")
        .when(month.isin(3, 4, 5), "spr")
        .when(month.isin(6, 7, 8), "sum")
        .when(month.isin(9, 10, 11), "fal")
    )


def water_year(date: Column) -> Column:
    """Water year: 1 October plus 92 days is 1 January."""
    return F.year(F.date_add(date, 92))


def water_year_start(date: Column, month: int = 10, day: int = 1) -> Column:
    """First day of the water year that holds the date."""
    this = F.make_date(F.year(date), F.lit(month), F.lit(day))
    return F.when(date >= this, this).otherwise(F.add_months(this, -12))


def wy_day(date: Column, month: int = 10, day: int = 1) -> Column:
    """1-based day index inside the water year (1..366)."""
    return F.datediff(date, water_year_start(date, month, day)) + 1


def lead_start_date(date: Column, lead: Column) -> Column:
    """Forecast start of a lead month; end-of-month days are clamped."""
    return F.add_months(date, (F.lit(1) - lead).cast("int"))
