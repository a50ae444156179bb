"""Trend statistics over yearly values: long (keys, year, metric, value) to one row per
(keys, metric) and on to one wide row per gage.

A (gage, metric) series has one value per year, so the arrays and windows below hold
at most as many entries as the record has years.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.functions.cleaning import signif
from freshet.functions.moments import correlation
from freshet.functions.distributions import with_spearman_p
from freshet.operators.yearly import (
    BASEFLOW_METRICS,
    FDC_METRICS,
    FLASHINESS_METRICS,
    PULSE_METRICS,
    REVERSAL_METRICS,
    RUNOFF_METRICS,
    TIMING_METRICS,
    VOLUME_METRICS,
)

GAGE = ["gage_id"]
STATS = ["slp", "rho", "pval", "mean", "median"]
RECESSION_METRICS = ["log_a_pointcloud", "log_a_events", "b_pointcloud", "b_events", "concavity"]
METRICS = [
    *VOLUME_METRICS,
    *FDC_METRICS,
    *FLASHINESS_METRICS,
    *TIMING_METRICS,
    *PULSE_METRICS,
    "TQmean",
    *REVERSAL_METRICS,
    *RUNOFF_METRICS,
    *BASEFLOW_METRICS,
    *RECESSION_METRICS,
]


def _median_of(values: Column) -> Column:
    """Median of an already sorted array."""
    n = F.size(values)
    low, high = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    return F.when(n > 0, (F.get(values, low) + F.get(values, high)) / 2)


def sen_slope(points: Column) -> Column:
    """Sorted array of the slopes between the points (struct year, value) of one series.

    A series has one point per year: two hundred years make 19,900 slopes in one array.
    """
    slopes = F.flatten(
        F.transform(
            points,
            lambda a, i: F.transform(
                F.filter(F.slice(points, i + 2, F.size(points)), lambda b: b["year"] != a["year"]),
                lambda b: (b["value"] - a["value"]) / (b["year"] - a["year"]),
            ),
        )
    )
    return F.sort_array(slopes)


def trends(yearly: DataFrame, keys: Sequence[str] = GAGE, min_years: int = 3) -> DataFrame:
    """Theil-Sen slope, Spearman rho and p, mean and median per (keys, metric).

    Series with fewer than min_years values give no row. Timing metrics report mean and
    median as whole days, rounded half to even.
    """
    group = [*keys, "metric"]
    series = Window.partitionBy(*group)
    valid = yearly.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    # Ranks compare twelve significant digits: yearly values that differ by the last
    # rounding step of an interpolation are ties.
    ranked = valid.withColumn("_level", signif(F.col("value"), 12)).withColumns(
        {
            "_rank": F.rank().over(series.orderBy("_level")),
            "_ties": F.count("*").over(Window.partitionBy(*group, "_level")),
            "_year_rank": F.row_number().over(series.orderBy("year")),
        }
    ).withColumn("_rank", F.col("_rank") + (F.col("_ties") - 1) / 2)
    stats = (
        ranked.groupBy(*group)
        .agg(
            F.count("*").alias("n"),
            correlation("_year_rank", "_rank").alias("rho"),
            (F.max("_ties") > 1).alias("tied"),
            F.avg("value").alias("mean"),
            F.median("value").alias("median"),
            F.sort_array(F.collect_list(F.struct("year", "value"))).alias("_points"),
        )
        .filter(F.col("n") >= min_years)
        .withColumn("_slopes", sen_slope(F.col("_points")))
    )
    stats = with_spearman_p(stats)
    whole_days = F.col("metric").isin(TIMING_METRICS)
    return stats.select(
        *group,
        "n",
        _median_of(F.col("_slopes")).alias("slp"),
        "rho",
        "pval",
        F.when(whole_days, F.bround("mean")).otherwise(F.col("mean")).alias("mean"),
        F.when(whole_days, F.bround("median")).otherwise(F.col("median")).alias("median"),
    )


def summary_wide(
    trend_rows: DataFrame, keys: Sequence[str] = GAGE, metrics: Sequence[str] = METRICS
) -> DataFrame:
    """One row per gage with <metric>_<stat> columns; absent metrics stay null."""
    stats = [F.first(s, ignorenulls=True).alias(s) for s in STATS]
    return trend_rows.groupBy(*keys).pivot("metric", list(metrics)).agg(*stats)
