"""Ensemble forecasts against climatology, by water year.

Traces are long: (keys, member, param_id, date, sim). A trace holds one row per day of
a forecast year and a (keys, date) group holds one row per trace, so windows and
percentiles here are bounded by the calendar and by the ensemble size.
"""

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.functions.calendar import with_calendar
from freshet.functions.cleaning import overlay_observed, signif
from freshet.functions.moments import running_total

BASIN = ["basin"]
TRACE = ["member", "param_id"]

# The quantiles of the forecast product and the scaling of the
# smoothing kernel (quartiles of the normal kernel at a quarter of the bandwidth).
QUANTILES = {"Q05": 0.05, "Q25": 0.25, "Q50": 0.5, "Q75": 0.75, "Q95": 0.95}
KERNEL_SCALE = 0.3706506
KERNEL_CUT = 4


def quantile_columns(df: DataFrame, by: Sequence[str], value: str, prefix: str) -> DataFrame:
    """<prefix>_Q05 .. <prefix>_Q95 of the value per group."""
    probs = F.array(*[F.lit(p) for p in QUANTILES.values()])
    grouped = df.groupBy(*by).agg(F.percentile(value, probs).alias("_q"))
    return grouped.select(*by, *[F.col("_q")[i].alias(f"{prefix}_{q}") for i, q in enumerate(QUANTILES)])


def ensemble(members: DataFrame, params: DataFrame, keys: Sequence[str] = BASIN) -> DataFrame:
    """Every climate member of a basin with every kept parameter set of the same basin."""
    return members.join(params, list(keys))


def splice(history: DataFrame, forecast: DataFrame, keys: Sequence[str] = BASIN, member: str = "member") -> DataFrame:
    """History up to its last day for every member, then the member's forecast after it."""
    cut = history.groupBy(*keys).agg(F.max("date").alias("_cut"))
    members = forecast.select(*keys, member).distinct()
    past = history.join(members, list(keys)).withColumn("is_forecast", F.lit(False))
    ahead = (
        forecast.join(cut, list(keys))
        .filter(F.col("date") > F.col("_cut"))
        .drop("_cut")
        .withColumn("is_forecast", F.lit(True))
    )
    return past.unionByName(ahead)


def _start_doy(water_year_start: str) -> Column:
    return F.dayofyear(F.lit(water_year_start).cast("date"))


def water_year_climatology(
    history: DataFrame, water_year_start: str, value: str = "flow", keys: Sequence[str] = BASIN
) -> DataFrame:
    """Quantiles over the years of cumulative flow by day of water year (1..365).

    A water year is the 365 rows from a row on the start day of year. It is left out when
    those rows span more than 366 days, and the last start of a record is left out. Nulls
    become the mean of the block, and its first value is at least 1.
    """
    series = Window.partitionBy(*keys).orderBy("date")
    until_now = series.rowsBetween(Window.unboundedPreceding, 0)
    before = series.rowsBetween(Window.unboundedPreceding, -1)
    is_start = F.dayofyear("date") == _start_doy(water_year_start)
    rows = history.select(*keys, "date", F.col(value).alias("v")).withColumn("_i", F.row_number().over(series))
    rows = rows.withColumn("_s", F.when(is_start, F.col("_i")))
    rows = rows.withColumns(
        {"_earlier": F.max("_s").over(before), "_final": F.max("_s").over(Window.partitionBy(*keys))}
    )
    # A block that is short of days runs on into the next one, so a row can belong to
    # the latest start and to the one before it.
    latest = F.max(F.when(F.col("_s").isNotNull(), F.struct("_s", "_earlier"))).over(until_now)
    blocks = (
        rows.withColumn("_latest", latest)
        .withColumn("block", F.explode(F.array("_latest._s", "_latest._earlier")))
        .filter("block < _final and _i - block < 365")
        .withColumn("day_of_wy", (F.col("_i") - F.col("block") + 1).cast("int"))
    )
    block = Window.partitionBy(*keys, "block")
    filled = blocks.withColumns(
        {
            "_mean": F.avg("v").over(block),
            "_span": F.datediff(F.max("date").over(block), F.min("date").over(block)),
            "_rows": F.count("*").over(block),
        }
    ).filter("_span <= 366 and _rows = 365")
    v = F.coalesce("v", "_mean")
    first = F.when((F.col("day_of_wy") == 1) & (v < 1), F.lit(1.0)).otherwise(v)
    running = block.orderBy("day_of_wy").rowsBetween(Window.unboundedPreceding, 0)
    summed = filled.withColumn("_v", first).withColumn("_cum", F.sum("_v").over(running))
    return quantile_columns(summed, [*keys, "day_of_wy"], "_cum", "Clim")


def storage_climatology(
    history: DataFrame, water_year_start: str, value: str = "stor", keys: Sequence[str] = BASIN
) -> DataFrame:
    """Quantiles over the years of storage by day of year, in water year order."""
    by_doy = quantile_columns(
        history.withColumn("_doy", F.dayofyear("date")), [*keys, "_doy"], value, "Clim"
    )
    start = F.lit(water_year_start).cast("date")
    # Each day of year has at most one place in the 365 days from the start.
    offset = F.pmod(F.col("_doy") - F.dayofyear(start), F.when(_has_leap_day(start), 366).otherwise(365))
    placed = by_doy.withColumn("day_of_wy", (offset + 1).cast("int"))
    inside = (F.col("day_of_wy") <= 365) & (
        F.dayofyear(F.date_add(start, F.col("day_of_wy") - 1)) == F.col("_doy")
    )
    return placed.filter(inside).drop("_doy")


def _has_leap_day(start: Column) -> Column:
    """Whether day numbers wrap after 366: the calendar year of the start is a leap year."""
    return F.dayofyear(F.make_date(F.year(start), F.lit(12), F.lit(31))) == 366


def forecast_quantiles(
    traces: DataFrame,
    water_year_start: str,
    observed: DataFrame | None = None,
    value: str = "sim",
    keys: Sequence[str] = BASIN,
    trace: Sequence[str] = TRACE,
    cumulative: bool = True,
) -> DataFrame:
    """Quantiles across traces by date in the water year; flow accumulates, storage does not.

    Days already observed in this water year take the observation in every trace. A trace's
    total is unknown from its first day without a value on.
    """
    start = F.lit(water_year_start).cast("date")
    this_year = traces.filter((F.col("date") >= start) & (F.col("date") < F.add_months(start, 12)))
    if observed is not None:
        this_year = overlay_observed(this_year, observed, [*keys, "date"], value, since=water_year_start)
    if cumulative:
        one = Window.partitionBy(*keys, *trace).orderBy("date")
        this_year = this_year.withColumn(value, running_total(value, one.rowsBetween(Window.unboundedPreceding, 0)))
    return quantile_columns(this_year, [*keys, "date"], value, "Pred")


def water_year_history(
    history: DataFrame, water_year_start: str, value: str = "flow", keys: Sequence[str] = BASIN, cumulative: bool = True
) -> DataFrame:
    """WaterYear_Curr and _1YrAgo.._3YrAgo by day index; the 366th day of a year is dropped.

    A year's total is unknown from its first day without a value on.
    """
    start = F.lit(water_year_start).cast("date")
    years_ago = F.when(F.col("date") >= start, 0)
    for k in (1, 2, 3):
        years_ago = years_ago.when(F.col("date") >= F.add_months(start, -12 * k), k)
    rows = history.select(*keys, "date", F.col(value).alias("v"), years_ago.alias("_ago")).filter("_ago is not null")
    year = Window.partitionBy(*keys, "_ago").orderBy("date")
    level = running_total("v", year.rowsBetween(Window.unboundedPreceding, 0)) if cumulative else F.col("v")
    rows = rows.withColumns({"day_of_wy": F.row_number().over(year), "_level": level}).filter("day_of_wy <= 365")
    names = {0: "WaterYear_Curr", 1: "WaterYear_1YrAgo", 2: "WaterYear_2YrAgo", 3: "WaterYear_3YrAgo"}
    return rows.groupBy(*keys, "day_of_wy").agg(
        *[F.max(F.when(F.col("_ago") == k, F.col("_level"))).alias(n) for k, n in names.items()]
    )


def forecast_product(
    basins: DataFrame,
    predicted: DataFrame,
    climatology: DataFrame,
    past: DataFrame,
    water_year_start: str,
    kind: str,
    keys: Sequence[str] = BASIN,
    units: str = "Acre Feet",
) -> DataFrame:
    """365 rows per basin: forecast and climatology quantiles and past water years, null padded.

    basins carries keys, lat, lon and max_storage; kind tags streamflow or storage.
    """
    start = F.lit(water_year_start).cast("date")
    spine = basins.withColumn("day_of_wy", F.explode(F.sequence(F.lit(1), F.lit(365)))).withColumn(
        "date", F.date_add(start, F.col("day_of_wy") - 1)
    )
    return (
        spine.join(predicted, [*keys, "date"], "left")
        .join(climatology, [*keys, "day_of_wy"], "left")
        .join(past, [*keys, "day_of_wy"], "left")
        .withColumns({"units": F.lit(units), "storage_or_streamflow": F.lit(kind)})
    )


def percent_of_average(product: DataFrame, keys: Sequence[str] = BASIN, current: str = "WaterYear_Curr") -> DataFrame:
    """Last current value as a percentage of the median climatology of its day (2 significant digits)."""
    has = F.col(current).isNotNull()
    last = product.groupBy(*keys).agg(
        F.max(F.when(has, F.struct(F.col("day_of_wy"), F.col(current).alias("now"), F.col("Clim_Q50")))).alias("_l")
    )
    return last.select(*keys, (signif(F.try_divide(F.col("_l.now"), F.col("_l.Clim_Q50")), 2) * 100).alias("percent_of_average"))


def smooth_climatology(
    climatology: DataFrame, keys: Sequence[str] = BASIN, bandwidth: float = 12, prefix: str = "Clim"
) -> DataFrame:
    """Normal-kernel smoothing of each climatology quantile over the day of water year."""
    sigma = KERNEL_SCALE * bandwidth
    reach = math.floor(KERNEL_CUT * sigma)
    cols = [f"{prefix}_{q}" for q in QUANTILES]
    near = Window.partitionBy(*keys).orderBy("day_of_wy").rangeBetween(-reach, reach)
    days = climatology.withColumn("_near", F.collect_list(F.struct("day_of_wy", *cols)).over(near))

    def weight(d):
        return F.exp(-0.5 * F.pow((d["day_of_wy"] - F.col("day_of_wy")) / sigma, 2))

    def total(pick):
        return F.aggregate("_near", F.lit(0.0), lambda acc, d: acc + pick(d))

    days = days.withColumn("_w", total(weight))
    smoothed = {c: total(lambda d, c=c: weight(d) * d[c]) / F.col("_w") for c in cols}
    return days.select(*keys, "day_of_wy", *[e.alias(c) for c, e in smoothed.items()])


def roll_years(product: DataFrame, as_of: str, water_year_start: str) -> DataFrame:
    """Once the water year has begun, each year column moves one year back for plotting."""
    begun = F.lit(as_of).cast("date") > F.lit(water_year_start).cast("date")
    moves = [
        ("WaterYear_3YrAgo", "WaterYear_2YrAgo"),
        ("WaterYear_2YrAgo", "WaterYear_1YrAgo"),
        ("WaterYear_1YrAgo", "WaterYear_Curr"),
    ]
    return product.withColumns({to: F.when(begun, F.col(src)).otherwise(F.col(to)) for to, src in moves})
