"""Hindcast verification by lead month and tercile against climatology.

A hindcast is long: (keys, init_date, member, param_id, date, pred, obs). Everything is
one pass over all initialisations; nothing is spilled or stacked by hand.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.functions.calendar import lead_start_date

BASIN = ["basin"]
TRACE = ["init_date", "member", "param_id"]
MAX_LEAD = 7

# The tercile bounds and median of the verification.
TERCILES = (0.333, 0.5, 0.667)


def monthly_climatology(history: DataFrame, keys: Sequence[str] = BASIN, value: str = "flow") -> DataFrame:
    """Mean times number of days per year and month (gaps count as mean days)."""
    return history.groupBy(*keys, F.year("date").alias("year"), F.month("date").alias("month")).agg(
        (F.avg(value) * F.count("*")).alias("total")
    )


def monthly_storage_climatology(history: DataFrame, keys: Sequence[str] = BASIN, value: str = "stor") -> DataFrame:
    """Last storage of each month; the last year of a record, still running, is left out."""
    months = history.groupBy(*keys, F.year("date").alias("year"), F.month("date").alias("month")).agg(
        F.max_by(value, "date").alias("total")
    )
    final = F.max("year").over(Window.partitionBy(*keys))
    return months.withColumn("_final", final).filter("year < _final").drop("_final")


def _months_in_order(hindcast: DataFrame, keys: Sequence[str], trace: Sequence[str]) -> DataFrame:
    months = hindcast.groupBy(*keys, *trace, F.month("date").alias("month")).agg(
        F.min("date").alias("first_day"),
        F.count("*").alias("_days"),
        F.when(F.count("pred") == F.count("*"), F.avg("pred")).alias("_pred"),
        F.avg("obs").alias("_obs"),
    )
    order = Window.partitionBy(*keys, *trace).orderBy("first_day")
    return months.withColumn("lead", F.row_number().over(order))


def lead_months(hindcast: DataFrame, keys: Sequence[str] = BASIN, trace: Sequence[str] = TRACE) -> DataFrame:
    """Cumulative predicted and observed flow of each trace by lead month, from daily means.

    The date is the 15th day of the month's rows. A day without a prediction leaves the
    month's prediction, and the total from there on, unknown; so does a month without any
    observation for the observed total.
    """
    so_far = Window.partitionBy(*keys, *trace).orderBy("lead").rowsBetween(Window.unboundedPreceding, 0)

    def cumulative(name: str) -> Column:
        known = F.count_if(F.col(name).isNull()).over(so_far) == 0
        return F.when(known, F.sum(F.col(name) * F.col("_days")).over(so_far))

    months = _months_in_order(hindcast, keys, trace)
    return months.select(
        *keys, *trace, "lead", F.date_add("first_day", 14).alias("date"),
        cumulative("_pred").alias("pred"), cumulative("_obs").alias("act"),
    )


def lead_months_storage(hindcast: DataFrame, keys: Sequence[str] = BASIN, trace: Sequence[str] = TRACE) -> DataFrame:
    """Mean predicted and observed storage of each trace by lead month."""
    return _months_in_order(hindcast, keys, trace).select(
        *keys, *trace, "lead", F.date_add("first_day", 14).alias("date"),
        F.col("_pred").alias("pred"), F.col("_obs").alias("act"),
    )


def with_start_date(leads: DataFrame) -> DataFrame:
    """Complete rows with the mid-month date of their forecast start."""
    return leads.na.drop(subset=["pred", "act"]).withColumn("start_date", lead_start_date(F.col("date"), F.col("lead")))


def climatology_by_lead(monthly: DataFrame, keys: Sequence[str] = BASIN, max_lead: int = MAX_LEAD) -> DataFrame:
    """Flow accumulated over the lead months from each start month of each year but the last.

    A missing month leaves the totals from there on unknown.
    """
    index = F.col("year") * 12 + F.col("month")
    months = monthly.withColumn("_m", index)
    series = Window.partitionBy(*keys).orderBy("_m")
    cols = {}
    for lead in range(1, max_lead + 1):
        span = series.rangeBetween(0, lead - 1)
        cols[f"_t{lead}"] = F.when(F.count("total").over(span) == lead, F.sum("total").over(span))
    cols["_final"] = F.max("year").over(Window.partitionBy(*keys))
    pairs = ", ".join(f"{k}, _t{k}" for k in range(1, max_lead + 1))
    return months.withColumns(cols).filter("year < _final").selectExpr(
        *keys, "year as start_year", "month as start_month", f"stack({max_lead}, {pairs}) as (lead, total)"
    ).filter("total is not null")


def _tercile(value: Column, low: Column, high: Column) -> Column:
    return F.when(value > high, 3).when(value > low, 2).otherwise(1)


def skill_rows(leads: DataFrame, climatology: DataFrame, keys: Sequence[str] = BASIN) -> DataFrame:
    """Tercile classes and six signed errors per forecast start and lead.

    leads comes from with_start_date. climatology is climatology_by_lead (matched on start
    month and lead) or a monthly table with month and total (storage: matched on the
    month of the lead). An ensemble and a climatology group are bounded by members x
    parameter sets and by years.
    """
    probs = F.array(*[F.lit(p) for p in TERCILES])
    pred = leads.groupBy(*keys, "start_date", "lead", "date").agg(
        F.percentile("pred", probs).alias("_p"), F.min("act").alias("_act")
    )
    pred = pred.withColumns({"start_month": F.month("start_date"), "month": F.month("date")})
    match = ["start_month", "lead"] if "lead" in climatology.columns else ["month"]
    clim = climatology.groupBy(*keys, *match).agg(F.percentile("total", probs).alias("_c"))
    rows = pred.join(clim, [*keys, *match], "left")
    p, c, act = F.col("_p"), F.col("_c"), F.col("_act")
    errors = []
    for i, name in enumerate(("25", "50", "75")):
        errors += [(p[i] - act).alias(f"predMAE{name}"), (c[i] - act).alias(f"climMAE{name}")]
    return rows.select(
        *keys, "start_date", "month", F.col("lead").alias("leadTime"),
        _tercile(p[1], c[0], c[2]).alias("predTerc"), _tercile(act, c[0], c[2]).alias("actTerc"), *errors,
    )


def tercile_contingency(skill: DataFrame, keys: Sequence[str] = BASIN) -> DataFrame:
    """P(actual | predicted) and P(predicted | actual) by lead, for the pairs that occur."""
    counts = skill.groupBy(*keys, "leadTime", "predTerc", "actTerc").agg(F.count("*").alias("n"))
    of_pred = F.sum("n").over(Window.partitionBy(*keys, "leadTime", "predTerc"))
    of_act = F.sum("n").over(Window.partitionBy(*keys, "leadTime", "actTerc"))
    return counts.withColumns({"p_act_given_pred": F.col("n") / of_pred, "p_pred_given_act": F.col("n") / of_act})


def skill_maps(skill: DataFrame, keys: Sequence[str] = BASIN, cap: float | None = 99.9) -> DataFrame:
    """Median signed error, median relative error (%) and tercile hit rates by lead and month.

    Relative errors above 100 show as the cap; pass None to keep them.
    """
    aggs = []
    for name in ("25", "50", "75"):
        p, c = F.col(f"predMAE{name}"), F.col(f"climMAE{name}")
        # An exact climatology is infinitely better than any error.
        share = F.when((c == 0) & (p != 0), F.lit(float("inf"))).otherwise(F.try_divide(F.abs(p) - F.abs(c), F.abs(c)))
        relative = F.median(share) * 100
        if cap is not None:
            relative = F.when(relative > 100, F.lit(cap)).otherwise(relative)
        aggs += [F.median(p).alias(f"absMae{name}"), relative.alias(f"relMae{name}")]
    for label, t in (("low", 1), ("med", 2), ("high", 3)):
        hit = F.count_if((F.col("actTerc") == t) & (F.col("predTerc") == t))
        aggs.append(F.try_divide(hit, F.count_if(F.col("actTerc") == t)).alias(f"{label}_hit_rate"))
    return skill.groupBy(*keys, "leadTime", "month").agg(*aggs)
