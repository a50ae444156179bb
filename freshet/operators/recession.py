"""Recession events of daily flow and the power-law parameters of -dQ/dt = a * Q^b.

A (gage, year) holds at most 366 rows; events, their points and the yearly fits all
stay inside that group, so one hash partitioning by gage serves every step.
"""

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.functions.cleaning import require_columns
from freshet.operators.trends import RECESSION_METRICS
from freshet.operators.yearly import to_long

GAGE = ["gage_id"]
MIN_LENGTH = 5


def recession_days(daily: DataFrame, keys: Sequence[str] = GAGE) -> DataFrame:
    """Daily rows with position i, year length n, and whether a recession can start there.

    A day qualifies when flow falls over the next four steps and each step is smaller
    than the one before, with six consecutive flows present; the last five days of a
    year never qualify.
    """
    require_columns(daily, [*keys, "year", "doy", "q"])
    year = Window.partitionBy(*keys, "year")
    ordered = year.orderBy("doy")
    ahead = [F.col("q"), *[F.lead("q", k).over(ordered) for k in range(1, MIN_LENGTH + 1)]]
    falling = F.col("i") <= F.col("n") - MIN_LENGTH
    for j in range(MIN_LENGTH - 1):
        first, second = ahead[j] - ahead[j + 1], ahead[j + 1] - ahead[j + 2]
        falling = falling & (first > 0) & (F.abs(second) < F.abs(first))
    return (
        daily.select(*keys, "year", "doy", "q")
        .withColumns(
            {"i": F.row_number().over(ordered), "n": F.count("*").over(year), "q_next": F.lead("q").over(ordered)}
        )
        .withColumn("falling", F.coalesce(falling, F.lit(False)))
    )


def event_days(daily: DataFrame, keys: Sequence[str] = GAGE) -> DataFrame:
    """The days of each recession event, numbered from 1 (pos) out of len.

    Events are runs of at least five qualifying days. A run still open five days before
    the end of the year takes the remaining days with it and is always long enough.
    """
    year = Window.partitionBy(*keys, "year")
    running = year.orderBy("doy").rowsBetween(Window.unboundedPreceding, 0)
    days = recession_days(daily, keys).withColumn("_run", F.count_if(~F.col("falling")).over(running))
    last_start = F.col("n") - MIN_LENGTH
    days = days.withColumn(
        "_open_run", F.max(F.when((F.col("i") == last_start) & F.col("falling"), F.col("_run"))).over(year)
    )
    days = days.withColumn(
        "event",
        F.when(F.col("falling"), F.col("_run")).when(F.col("i") > last_start, F.col("_open_run")),
    ).filter("event is not null")
    event = Window.partitionBy(*keys, "year", "event")
    return (
        days.withColumns({"len": F.count("*").over(event), "pos": F.row_number().over(event.orderBy("doy"))})
        .filter((F.col("len") >= MIN_LENGTH) | (F.col("event") == F.col("_open_run")))
        .select(*keys, "year", "event", "doy", "i", "q", "q_next", "pos", "len")
    )


def events(daily: DataFrame, keys: Sequence[str] = GAGE) -> DataFrame:
    """One row per event: start and end positions, length and the day of its middle."""
    middle = F.col("pos") == F.ceil(F.col("len") / 2)
    return event_days(daily, keys).groupBy(*keys, "year", "event").agg(
        F.min("i").alias("start"),
        F.max("i").alias("end"),
        F.max("len").alias("len"),
        F.max(F.when(middle, F.col("doy"))).alias("doy"),
    )


def event_fits(daily: DataFrame, keys: Sequence[str] = GAGE) -> DataFrame:
    """Per event log_a and b, concavity, and its log-log points (x = ln Q, y = ln -dQ).

    The first day is left out of the fit. Concavity is b of the second half less b of the
    first, over events of six days or more; the halves share their middle day. Events
    without a fit are dropped.
    """
    step = F.col("q") - F.col("q_next")
    usable = (F.col("pos") < F.col("len")) & (F.col("q") > 0) & (step > 0)
    # The logs only exist for positive values: blank the inputs before taking them.
    x, y = F.ln(F.when(usable, F.col("q"))), F.ln(F.when(usable, step))
    days = event_days(daily, keys).withColumns({"x": x, "y": y})
    mid = F.floor(F.col("len") / 2)
    in_fit, first, second = F.col("pos") >= 2, F.col("pos") < mid, F.col("pos") >= mid

    def fit(fn, part: Column) -> Column:
        used = part & F.col("x").isNotNull()
        return F.when(F.count_if(used) >= 2, fn(F.when(used, F.col("y")), F.when(used, F.col("x"))))

    middle = F.col("pos") == F.ceil(F.col("len") / 2)
    fitted = days.groupBy(*keys, "year", "event").agg(
        F.max("len").alias("len"),
        F.max(F.when(middle, F.col("doy"))).alias("doy"),
        fit(F.regr_intercept, in_fit).alias("log_a"),
        fit(F.regr_slope, in_fit).alias("b"),
        (fit(F.regr_slope, second) - fit(F.regr_slope, first)).alias("concavity"),
        F.collect_list(F.when(in_fit & F.col("x").isNotNull(), F.struct("x", "y"))).alias("points"),
    )
    return fitted.filter("log_a is not null and b is not null").withColumn(
        "concavity", F.when(F.col("len") >= 6, F.col("concavity"))
    )


def yearly_parameters(fits: DataFrame, keys: Sequence[str] = GAGE) -> DataFrame:
    """Per year: median event b, point-cloud b, both log_a at the median b, mean concavity."""
    group = [*keys, "year"]
    with_b = fits.withColumn("median_b", F.median("b").over(Window.partitionBy(*group)))
    points = with_b.select(*group, "event", "median_b", "concavity", F.explode("points").alias("p")).select(
        *group, "event", "concavity", "median_b", "p.x", "p.y", (F.col("p.y") - F.col("median_b") * F.col("p.x")).alias("shift")
    )
    cloud = points.groupBy(*group).agg(
        F.when(F.count("*") > 10, F.median("shift")).alias("log_a_pointcloud"),
        F.when(F.count("*") > 10, F.regr_slope("y", "x")).alias("b_pointcloud"),
        F.first("median_b").alias("b_events"),
    )
    by_event = points.groupBy(*group, "event").agg(
        F.median("shift").alias("log_a"), F.first("concavity").alias("concavity")
    )
    by_year = by_event.groupBy(*group).agg(
        F.median("log_a").alias("log_a_events"), F.avg("concavity").alias("concavity")
    )
    return cloud.join(by_year, group)


def recession_metrics(fits: DataFrame, keys: Sequence[str] = GAGE, min_years: int = 3) -> DataFrame:
    """Long yearly recession metrics of gages with fitted events in at least min_years years."""
    params = yearly_parameters(fits, keys)
    enough = F.count("b_events").over(Window.partitionBy(*keys)) >= min_years
    kept = params.withColumn("_enough", enough).filter("_enough")
    return to_long(kept, [*keys, "year"], RECESSION_METRICS).filter("value is not null")


def log_a_seasonality(fits: DataFrame, keys: Sequence[str] = GAGE, min_years: int = 3) -> DataFrame:
    """Sinusoid of event log_a over the year: all events, and the halves split at the median year.

    Amplitude and day of minimum come from least squares on sine and cosine of the day
    of year; sums about the means take the intercept out, which leaves a 2x2 system.
    Needs ten events for each fit, and event years in at least min_years years.
    """
    years = fits.select(*keys, "year").distinct().groupBy(*keys).agg(
        F.median("year").alias("_mid"), F.count("*").alias("_years")
    )
    half = F.when(F.col("year") <= F.col("_mid"), "first_half").otherwise("last_half")
    angle = F.col("doy") * (2 * math.pi / 365)
    points = fits.join(years.filter(F.col("_years") >= min_years), list(keys)).select(
        *keys,
        F.explode(F.array(F.lit("all"), half)).alias("part"),
        F.sin(angle).alias("s"),
        F.cos(angle).alias("c"),
        F.col("log_a").alias("y"),
    )
    moments = points.groupBy(*keys, "part").agg(
        F.count("*").alias("n"),
        F.var_pop("s").alias("ss"),
        F.var_pop("c").alias("cc"),
        F.covar_pop("s", "c").alias("sc"),
        F.covar_pop("s", "y").alias("sy"),
        F.covar_pop("c", "y").alias("cy"),
    )
    fitted = (
        moments.withColumn("det", F.col("ss") * F.col("cc") - F.col("sc") * F.col("sc"))
        .filter("n >= 10 and abs(det) > 1e-12")
        .withColumn("b1", F.expr("(sy * cc - cy * sc) / det"))
        .withColumn("b2", F.expr("(cy * ss - sy * sc) / det"))
        .withColumn("phase", F.atan2(-F.col("b2"), F.col("b1")) * 365 / (2 * math.pi))
        .withColumn("low", F.expr("phase + if(phase < 0, 365, 0) + 273.75D"))
        .withColumn("low", F.expr("if(low > 365, low - 365, low)"))
        .withColumn("amplitude", F.sqrt(F.col("b1") * F.col("b1") + F.col("b2") * F.col("b2")))
    )
    out = []
    for part in ("all", "first_half", "last_half"):
        here = F.col("part") == part
        out.append(F.max(F.when(here, F.col("amplitude"))).alias(f"log_a_seasonality_amplitude_{part}"))
        out.append(F.max(F.when(here, F.col("low"))).alias(f"log_a_seasonality_minimum_{part}"))
    return fitted.groupBy(*keys).agg(*out)
