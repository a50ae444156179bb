"""Yearly streamflow signatures: daily(gage_id, date, year, month, doy, q[, ppt]) to
long rows (gage_id, year, metric, value).

daily holds one row per gage and day (quality.one_per_day), so a (gage, year) group
has at most 366 rows. All windows use the gage/year keys, so a daily table that is
hash-partitioned by gage and sorted by (gage, year, doy) is read without another
shuffle or sort.
"""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.functions.calendar import season
from freshet.functions.cleaning import require_columns
from freshet.operators.gaps import interpolate_linear

GAGE = ["gage_id"]

# The percentiles and cumulative-flow days the signatures report.
FLOW_PERCENTILES = [1, 5, 10, 20, 25, 30, 40, 50, 60, 70, 75, 80, 90, 95, 99]
TIMING_PERCENTILES = [5, 10, 20, 30, 40, 50, 60, 70, 80, 90, 95]

VOLUME_METRICS = ["Qann", "Qwin", "Qspr", "Qsum", "Qfal", *[f"Q{p}" for p in FLOW_PERCENTILES], "Q95_Q10"]
FDC_METRICS = ["FDCall", "FDC90", "FDCmid"]
FLASHINESS_METRICS = ["flashinessRB"]
TIMING_METRICS = [*[f"D{p}_day" for p in TIMING_PERCENTILES], "D25_to_D75", "Dmax"]
PULSE_METRICS = [f"{what}_{side}_pulses_{scope}" for what in ("n", "dur") for scope in ("year", "all") for side in ("high", "low")]
REVERSAL_METRICS = [f"Flow_Reversals_{s}" for s in ("annual", "winter", "spring", "summer", "fall")]
RUNOFF_METRICS = [f"{s}_runoff_ratio" for s in ("annual", "winter", "spring", "summer", "fall")]
BASEFLOW_METRICS = ["BFI_Eckhardt", "BFI_LyneHollick"]

SEASON_LABELS = {"win": "winter", "spr": "spring", "sum": "summer", "fal": "fall"}


def to_long(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Metric columns as (keys, metric, value) rows."""
    pairs = ", ".join(f"'{m}', cast(`{m}` as double)" for m in metrics)
    return df.selectExpr(*keys, f"stack({len(metrics)}, {pairs}) as (metric, value)")


def by_year(keys: Sequence[str] = GAGE):
    return Window.partitionBy(*keys, "year")


def volumes(daily: DataFrame, keys: Sequence[str] = GAGE, stat: str = "sum") -> DataFrame:
    """Annual and seasonal flow: totals (stat="sum") or means (stat="mean").

    Years or seasons without any valid flow give no row, as grouping drops nulls first.
    """
    require_columns(daily, [*keys, "year", "month", "q"])
    how = {"sum": F.sum, "mean": F.avg}[stat]
    s = season(F.col("month"))
    aggs = [how("q").alias("Qann")]
    aggs += [how(F.when(s == code, F.col("q"))).alias(f"Q{code}") for code in SEASON_LABELS]
    wide = daily.groupBy(*keys, "year").agg(*aggs)
    return to_long(wide, [*keys, "year"], VOLUME_METRICS[:5]).filter("value is not null")


def flow_percentiles(daily: DataFrame, keys: Sequence[str] = GAGE) -> DataFrame:
    """Linear-interpolated percentiles of the daily flows of each year, and Q95 - Q10."""
    require_columns(daily, [*keys, "year", "q"])
    probs = F.array(*[F.lit(p / 100) for p in FLOW_PERCENTILES])
    wide = daily.groupBy(*keys, "year").agg(F.percentile("q", probs).alias("p"))
    cols = {f"Q{p}": F.col("p")[i] for i, p in enumerate(FLOW_PERCENTILES)}
    wide = wide.withColumns(cols).withColumn("Q95_Q10", F.col("Q95") - F.col("Q10"))
    return to_long(wide, [*keys, "year"], VOLUME_METRICS[5:]).filter("value is not null")


def fdc_slopes(daily: DataFrame, keys: Sequence[str] = GAGE) -> DataFrame:
    """Slopes of the log flow-duration curve: all, exceedance >= 0.9, and 0.2..0.8."""
    require_columns(daily, [*keys, "year", "q"])
    year = by_year(keys)
    ranked = (
        daily.select(*keys, "year", "q")
        .withColumns({"_rows": F.count("*").over(year), "_n": F.count("q").over(year)})
        .filter("q is not null and _rows >= 30 and _n >= 10")
        .withColumn("_rank", F.row_number().over(year.orderBy(F.desc("q"))))
        .withColumns({"x": F.col("_rank") / (F.col("_n") + 1), "y": F.log10(F.col("q") + 1e-10)})
    )

    def slope(inside: Column) -> Column:
        fit = F.regr_slope(F.when(inside, F.col("y")), F.when(inside, F.col("x")))
        return F.when(F.count_if(inside) >= 3, fit)

    wide = ranked.groupBy(*keys, "year").agg(
        slope(F.lit(True)).alias("FDCall"),
        slope(F.col("x") >= 0.9).alias("FDC90"),
        slope(F.col("x").between(0.2, 0.8)).alias("FDCmid"),
    )
    return to_long(wide, [*keys, "year"], FDC_METRICS).filter("value is not null")


def flashiness(daily: DataFrame, keys: Sequence[str] = GAGE) -> DataFrame:
    """Richards-Baker index; gaps of at most 20 % of the year are interpolated, flat at the ends."""
    require_columns(daily, [*keys, "year", "doy", "q"])
    year = by_year(keys)
    usable = (
        daily.select(*keys, "year", "doy", "q")
        .withColumns({"_rows": F.count("*").over(year), "_n": F.count("q").over(year)})
        .filter("_rows >= 30 and (_rows - _n) / _rows <= 0.2")
        .drop("_rows", "_n")
    )
    filled = interpolate_linear(usable, [*keys, "year"], "doy", "q", ends="flat")
    steps = filled.withColumn("_step", F.abs(F.col("q") - F.lag("q").over(year.orderBy("doy"))))
    out = steps.groupBy(*keys, "year").agg(F.try_divide(F.sum("_step"), F.sum("q")).alias("flashinessRB"))
    return to_long(out, [*keys, "year"], FLASHINESS_METRICS).filter("value is not null")


def timing(daily: DataFrame, keys: Sequence[str] = GAGE) -> DataFrame:
    """Day of year by which 5..95 % of the annual flow has passed, the 25-75 % span, and Dmax.

    The running total stops at the first null of a year: no later day can reach a share.
    """
    require_columns(daily, [*keys, "year", "doy", "q"])
    year = by_year(keys)
    running = year.orderBy("doy").rowsBetween(Window.unboundedPreceding, 0)
    curve = (
        daily.select(*keys, "year", "doy", "q")
        .withColumns(
            {
                "_rows": F.count("*").over(year),
                "_total": F.sum("q").over(year),
                "_cum": F.sum("q").over(running),
                "_gaps": F.count_if(F.col("q").isNull()).over(running),
            }
        )
        .filter("_rows >= 300 and _total > 0")
        .withColumn("_share", F.when(F.col("_gaps") == 0, 100 * F.col("_cum")))
    )

    def reached(p: int) -> Column:
        return F.min(F.when(F.col("_share") >= p * F.col("_total"), F.col("doy")))

    peak = F.max(F.when(F.col("q").isNotNull(), F.struct(F.col("q"), -F.col("doy"), F.col("doy").alias("at"))))
    wide = curve.groupBy(*keys, "year").agg(
        *[reached(p).alias(f"D{p}_day") for p in TIMING_PERCENTILES],
        (reached(75) - reached(25)).alias("D25_to_D75"),
        peak["at"].alias("Dmax"),
    )
    return to_long(wide, [*keys, "year"], TIMING_METRICS).filter("value is not null")


def pulses(daily: DataFrame, keys: Sequence[str] = GAGE, min_days: int = 250) -> DataFrame:
    """Number and mean length of runs of days above the 90th or below the 10th percentile.

    Thresholds are those of the year and those of the gage's whole record; a null day
    ends a run.
    """
    require_columns(daily, [*keys, "year", "doy", "q"])
    year, ordered = by_year(keys), by_year(keys).orderBy("doy")
    record = Window.partitionBy(*keys)
    probs = F.array(F.lit(0.1), F.lit(0.9))
    marked = (
        daily.select(*keys, "year", "doy", "q")
        .withColumns(
            {
                "_all": F.percentile("q", probs).over(record),
                "_year": F.percentile("q", probs).over(year),
                "_rows": F.count("*").over(year),
            }
        )
        .filter(F.col("_year").isNotNull() & (F.col("_rows") >= min_days))
    )
    exceeding = {
        f"{side}_{scope}": F.coalesce(
            F.col("q") > F.col(f"_{scope}")[1] if side == "high" else F.col("q") < F.col(f"_{scope}")[0],
            F.lit(False),
        )
        for scope in ("year", "all")
        for side in ("high", "low")
    }
    marked = marked.withColumns(exceeding)
    starts = {
        f"s_{k}": F.col(k) & ~F.coalesce(F.lag(k).over(ordered), F.lit(False)) for k in exceeding
    }
    # Run count = number of run starts; mean length = days in runs / number of runs.
    aggs = []
    for k in exceeding:
        side, scope = k.split("_")
        n_runs = F.count_if(F.col(f"s_{k}"))
        aggs.append(n_runs.alias(f"n_{side}_pulses_{scope}"))
        aggs.append(F.when(n_runs > 0, F.count_if(F.col(k)) / n_runs).alias(f"dur_{side}_pulses_{scope}"))
    wide = marked.withColumns(starts).groupBy(*keys, "year").agg(*aggs)
    return to_long(wide, [*keys, "year"], PULSE_METRICS).filter("value is not null")


def tqmean(daily: DataFrame, keys: Sequence[str] = GAGE, min_days: int = 250) -> DataFrame:
    """Percent of days with flow above the annual mean."""
    require_columns(daily, [*keys, "year", "q"])
    year = by_year(keys)
    marked = daily.select(*keys, "year", "q").withColumns(
        {"_mean": F.avg("q").over(year), "_rows": F.count("*").over(year)}
    )
    above = F.count_if(F.col("q") > F.col("_mean"))
    wide = (
        marked.filter((F.col("_rows") >= min_days) & F.col("_mean").isNotNull())
        .groupBy(*keys, "year")
        .agg((above / F.count("q") * 100).alias("TQmean"))
    )
    return to_long(wide, [*keys, "year"], ["TQmean"])


def _reversal(window, threshold: float) -> Column:
    """True where flow turns at this day by more than the threshold share of it."""
    q = F.col("q")
    prev, following = q - F.lag("q").over(window), F.lead("q").over(window) - q
    turns = ((prev >= 0) & (following < 0)) | ((prev <= 0) & (following > 0))
    return F.coalesce((F.abs(following) > F.abs(threshold * q)) & turns, F.lit(False))


def reversals(daily: DataFrame, keys: Sequence[str] = GAGE, min_days: int = 250, threshold: float = 0.02) -> DataFrame:
    """Flow direction changes per year and per season.

    Nulls are removed first. The days of a season are taken in day-of-year order, so
    December follows February directly in the winter of a calendar year.
    """
    require_columns(daily, [*keys, "year", "month", "doy", "q"])
    marked = daily.select(
        *keys, "year", "doy", "q", season(F.col("month")).alias("season"), F.col("q").isNull().alias("_gap")
    )
    # Splitting each window by the gap flag removes the null days from the sequence
    # while they still count towards the row gates.
    present = Window.partitionBy(*keys, "year", "_gap").orderBy("doy")
    present_in_season = Window.partitionBy(*keys, "year", "season", "_gap").orderBy("doy")
    turns = marked.withColumns(
        {"_annual": _reversal(present, threshold), "_seasonal": _reversal(present_in_season, threshold)}
    )
    aggs = [F.count_if("_annual").alias("Flow_Reversals_annual")]
    for code, label in SEASON_LABELS.items():
        here = F.col("season") == code
        aggs.append(
            F.when(F.count_if(here) >= 30, F.count_if(here & F.col("_seasonal"))).alias(f"Flow_Reversals_{label}")
        )
    wide = turns.groupBy(*keys, "year").agg(*aggs, F.count("*").alias("_rows"), F.count("q").alias("_n"))
    wide = wide.filter((F.col("_rows") >= min_days) & (F.col("_n") > 0))
    return to_long(wide, [*keys, "year"], REVERSAL_METRICS).filter("value is not null")


def runoff_ratios(daily: DataFrame, keys: Sequence[str] = GAGE) -> DataFrame:
    """Flow over precipitation by year and season, on days where both are present."""
    require_columns(daily, [*keys, "year", "month", "q", "ppt"])
    both = daily.filter("q is not null and ppt is not null")
    s = season(F.col("month"))
    aggs = []
    for label, inside in [("annual", F.lit(True)), *[(v, s == k) for k, v in SEASON_LABELS.items()]]:
        flow, rain = F.sum(F.when(inside, F.col("q"))), F.sum(F.when(inside, F.col("ppt")))
        aggs.append(F.when(rain > 0.001, flow / rain).alias(f"{label}_runoff_ratio"))
    wide = both.groupBy(*keys, "year").agg(*aggs)
    return to_long(wide, [*keys, "year"], RUNOFF_METRICS).filter("value is not null")


def _bfi_years(daily: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per usable year with its flows in day order (at most 366 of them)."""
    series = F.transform(F.sort_array(F.collect_list(F.struct("doy", "q"))), lambda d: d["q"])
    years = daily.groupBy(*keys, "year").agg(
        series.alias("qs"), F.count("*").alias("_rows"), F.count("q").alias("_n"), F.sum("q").alias("_total")
    )
    return years.filter("_rows >= 250 and (_rows - _n) / _rows <= 0.2 and _total > 0")


def _eckhardt_sum(qs: Column, bfi_max: float = 0.8, a: float = 0.98) -> Column:
    """Sum of the digital-filter baseflow; a null flow ends it for the rest of the year."""
    first = qs[0] * bfi_max

    def step(acc, q):
        raw = ((1 - bfi_max) * a * acc["b"] + (1 - a) * bfi_max * q) / (1 - a * bfi_max)
        held = F.greatest(F.least(raw, q), F.lit(0.0))
        b = F.when(q.isNotNull() & acc["b"].isNotNull(), held)
        return F.struct(b.alias("b"), (acc["total"] + F.coalesce(b, F.lit(0.0))).alias("total"))

    return F.aggregate(
        F.slice(qs, 2, F.greatest(F.size(qs) - 1, F.lit(0))),
        F.struct(first.cast("double").alias("b"), F.coalesce(first, F.lit(0.0)).cast("double").alias("total")),
        step,
        lambda acc: acc["total"],
    )


def _quickflow(pairs: Column, alpha: float) -> Column:
    """One pass of the recursive filter over (value, cap) pairs, first element given by the caller.

    Returns the filtered values in the order of the pairs.
    """

    def step(acc, pair):
        raw = alpha * acc["f"] + (1 + alpha) / 2 * (pair["v"] - acc["v"])
        held = F.greatest(F.lit(0.0), F.least(raw, pair["cap"]))
        usable = pair["v"].isNotNull() & acc["v"].isNotNull() & acc["f"].isNotNull()
        f = F.when(usable, held)
        return F.struct(
            pair["v"].alias("v"), f.alias("f"), F.concat(acc["out"], F.array(f)).alias("out")
        )

    head = pairs[0]
    start = F.struct(head["v"].alias("v"), head["start"].alias("f"), F.array(head["start"]).alias("out"))
    return F.aggregate(F.slice(pairs, 2, F.greatest(F.size(pairs) - 1, F.lit(0))), start, step, lambda acc: acc["out"])


def _lyne_hollick_sum(years: DataFrame, alpha: float = 0.925) -> DataFrame:
    """Adds lh_sum: baseflow left after a forward and a backward quickflow pass.

    Every further pass would restart from the flows, so one forward-backward pair is
    the whole filter.
    """
    # Neither least nor greatest may skip nulls here: usable rows have no null value,
    # and a null cap only occurs with a null value.
    ahead = years.withColumn(
        "_pairs",
        F.transform("qs", lambda q: F.struct(q.alias("v"), q.alias("cap"), F.lit(0.0).alias("start"))),
    ).withColumn("_fwd", _quickflow(F.col("_pairs"), alpha))
    back = ahead.withColumn(
        "_pairs",
        F.reverse(
            F.zip_with("_fwd", "qs", lambda f, q: F.struct(f.alias("v"), q.alias("cap"), f.alias("start")))
        ),
    ).withColumn("_bwd", F.reverse(_quickflow(F.col("_pairs"), alpha)))
    base = F.zip_with(
        "qs", "_bwd", lambda q, f: F.when(q.isNotNull() & f.isNotNull(), F.greatest(q - f, F.lit(0.0)))
    )
    total = F.aggregate(base, F.lit(0.0), lambda acc, b: acc + F.coalesce(b, F.lit(0.0)))
    return back.withColumn("lh_sum", total).drop("_pairs", "_fwd", "_bwd")


def baseflow_indices(daily: DataFrame, keys: Sequence[str] = GAGE) -> DataFrame:
    """Baseflow share of the annual flow by the Eckhardt and Lyne-Hollick filters."""
    require_columns(daily, [*keys, "year", "doy", "q"])
    years = _lyne_hollick_sum(_bfi_years(daily, keys))
    wide = years.select(
        *keys,
        "year",
        (_eckhardt_sum(F.col("qs")) / F.col("_total")).alias("BFI_Eckhardt"),
        (F.col("lh_sum") / F.col("_total")).alias("BFI_LyneHollick"),
    )
    return to_long(wide, [*keys, "year"], BASEFLOW_METRICS)


def median_flow_dates(
    daily: DataFrame, keys: Sequence[str] = GAGE, percentiles: Sequence[int] = tuple(TIMING_PERCENTILES)
) -> DataFrame:
    """Median over years of the first day whose flow is at or below a whole-record percentile."""
    require_columns(daily, [*keys, "year", "doy", "q"])
    probs = F.array(*[F.lit(p / 100) for p in percentiles])
    record = daily.groupBy(*keys).agg(F.percentile("q", probs).alias("_t"))
    first_days = (
        daily.select(*keys, "year", "doy", "q")
        .join(record, list(keys))
        .groupBy(*keys, "year")
        .agg(*[F.min(F.when(F.col("q") <= F.col("_t")[i], F.col("doy"))).alias(f"_d{i}") for i in range(len(percentiles))])
    )
    return first_days.groupBy(*keys).agg(
        *[F.median(f"_d{i}").alias(f"D{p}_med_date") for i, p in enumerate(percentiles)]
    )


FAMILIES: Mapping[str, object] = {
    "volumes": volumes,
    "percentiles": flow_percentiles,
    "fdc": fdc_slopes,
    "flashiness": flashiness,
    "timing": timing,
    "pulses": pulses,
    "tqmean": tqmean,
    "reversals": reversals,
    "baseflow": baseflow_indices,
}
