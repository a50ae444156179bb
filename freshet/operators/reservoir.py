"""Reservoir water balance: losses, loss models and projected storage.

Daily reservoir rows are (keys, date, stor in acre-feet, inflow in cfs), one per day.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.functions.cleaning import drop_until_complete, floor_at
from freshet.functions.moments import running_total
from freshet.functions.units import cfs_to_acft_day
from freshet.operators.forecast import TRACE, quantile_columns
from freshet.operators.gaps import interpolate_linear

BASIN = ["basin"]
PREDICTORS = ("inflow", "stor", "doy")


def raw_loss(stor: Column, next_stor: Column, inflow: Column) -> Column:
    """Outflow, evaporation and withdrawals: inflow less the storage change to the next day."""
    return -(next_stor - stor - inflow)


def loss_records(
    reservoir: DataFrame, keys: Sequence[str] = BASIN, inflow_of: str = "today", floors: bool = True
) -> DataFrame:
    """Daily stor, inflow (acre-feet), loss and day-of-year mean loss, gaps filled.

    Leading rows go until storage and inflow are both present; storage is interpolated,
    inflow gaps take the mean. Storage, loss and inflow are floored at 1 and the loss is
    rescaled to the mean inflow. inflow_of="tomorrow" is the older balance, which sets the
    storage change against the inflow of the later day.
    """
    whole = Window.partitionBy(*keys)
    ordered = whole.orderBy("date")
    rows = drop_until_complete(reservoir, keys, ["stor", "inflow"])
    rows = interpolate_linear(rows, keys, "date", "stor", ends="edge")
    rows = rows.withColumn("_acft", cfs_to_acft_day(F.col("inflow")))
    last_known = F.max(F.when(F.col("_acft").isNotNull(), F.struct("date", "_acft"))).over(whole)["_acft"]
    is_last = F.col("date") == F.max("date").over(whole)
    rows = rows.withColumn("_acft", F.coalesce("_acft", F.when(is_last, last_known)))
    rows = rows.withColumn("_acft", F.coalesce("_acft", F.avg("_acft").over(whole)))
    carried = F.col("_acft") if inflow_of == "today" else F.lead("_acft").over(ordered)
    rows = rows.withColumn("loss", raw_loss(F.col("stor"), F.lead("stor").over(ordered), carried))
    rows = rows.withColumn("inflow", F.col("_acft")).drop("_acft")
    if floors:
        rows = rows.withColumns({c: floor_at(F.col(c), 1.0) for c in ("stor", "loss", "inflow")})
        mean_loss, mean_inflow = F.avg("loss").over(whole), F.avg("inflow").over(whole)
        rows = rows.withColumn("loss", F.col("loss") * (1 - F.try_divide(mean_loss - mean_inflow, mean_loss)))
    by_doy = F.avg("loss").over(Window.partitionBy(*keys, F.dayofyear("date")))
    return rows.withColumn("doy_loss", by_doy)


def unfilled_records(reservoir: DataFrame, keys: Sequence[str] = BASIN) -> DataFrame:
    """Daily stor, inflow (acre-feet) and loss as they were measured: nothing filled, floored or rescaled.

    The storage change to the next row is set against that row's inflow; a loss is null where
    either of them is unknown, and on the last day.
    """
    ordered = Window.partitionBy(*keys).orderBy("date")
    rows = reservoir.withColumn("inflow", cfs_to_acft_day(F.col("inflow")))
    loss = raw_loss(F.col("stor"), F.lead("stor").over(ordered), F.lead("inflow").over(ordered))
    return rows.select(*keys, "date", "stor", "inflow", loss.alias("loss"))


def mean_loss_by_doy(records: DataFrame, keys: Sequence[str] = BASIN) -> DataFrame:
    return records.groupBy(*keys, F.dayofyear("date").alias("doy")).agg(F.avg("loss").alias("doy_loss"))


def loss_models(records: DataFrame, keys: Sequence[str] = BASIN) -> DataFrame:
    """Six regressions of loss, on x and ln x of inflow, storage and day-of-year mean, with weights.

    A weight is the regression's share of the summed adjusted R2; it may be negative.
    Columns are <x>_<lin|log>_<slope|intercept|weight>.
    """
    x = {"inflow": F.col("inflow"), "stor": F.col("stor"), "doy": F.col("doy_loss")}
    aggs, names = [], []
    for p in PREDICTORS:
        for form, col in (("lin", x[p]), ("log", F.ln(x[p]))):
            name = f"{p}_{form}"
            names.append(name)
            aggs += [
                F.regr_slope("loss", col).alias(f"{name}_slope"),
                F.regr_intercept("loss", col).alias(f"{name}_intercept"),
                F.regr_r2("loss", col).alias(f"{name}_r2"),
                F.regr_count("loss", col).alias(f"{name}_n"),
            ]
    fits = records.groupBy(*keys).agg(*aggs)
    adjusted = {
        f"{n}_adj": 1 - F.try_divide((1 - F.col(f"{n}_r2")) * (F.col(f"{n}_n") - 1), F.col(f"{n}_n") - 2) for n in names
    }
    fits = fits.withColumns(adjusted)
    total = sum([F.col(f"{n}_adj") for n in names[1:]], F.col(f"{names[0]}_adj"))
    fits = fits.withColumn("_total", total)
    return fits.select(
        *keys,
        *[F.col(f"{n}_{part}") for n in names for part in ("slope", "intercept")],
        *[F.try_divide(F.col(f"{n}_adj"), F.col("_total")).alias(f"{n}_weight") for n in names],
    )


def _weighted_fit(predictor: str, x: Column) -> Column:
    def part(form: str, value: Column) -> Column:
        n = f"{predictor}_{form}"
        return F.col(f"{n}_weight") * (F.col(f"{n}_intercept") + value * F.col(f"{n}_slope"))

    return part("log", F.ln(x)) + part("lin", x)


def project_storage(
    traces: DataFrame,
    records: DataFrame,
    models: DataFrame,
    keys: Sequence[str] = BASIN,
    trace: Sequence[str] = TRACE,
    inflow: str = "inflow",
) -> DataFrame:
    """Projected storage per trace from the last observed storage on.

    Loss from inflow and season gives a first storage; the storage fits at that level
    complete the loss, and one more water balance gives the result. Storage stays at
    1 or more. An unknown inflow, or a day of year that the records never had a loss for,
    leaves the storage unknown from there on.
    """
    last = records.groupBy(*keys).agg(F.max(F.struct("date", "stor")).alias("_l"))
    state = models.join(last.select(*keys, F.col("_l.date").alias("_from"), F.col("_l.stor").alias("_s0")), list(keys))
    ahead = (
        traces.join(state, list(keys))
        .filter(F.col("date") >= F.col("_from"))
        .withColumn("doy", F.dayofyear("date"))
        .join(mean_loss_by_doy(records, keys), [*keys, "doy"], "left")
        .withColumn("_in", floor_at(F.col(inflow), 1.0))
    )
    so_far = Window.partitionBy(*keys, *trace).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    ahead = ahead.withColumn(
        "_loss_if", floor_at(_weighted_fit("inflow", F.col("_in")) + _weighted_fit("doy", F.col("doy_loss")), 0.0)
    )
    stor_share = F.col("stor_log_weight") + F.col("stor_lin_weight")
    ahead = ahead.withColumns(
        {
            "_cum_in": running_total("_in", so_far),
            "_cum_if": running_total(F.try_divide(F.col("_loss_if"), 1 - stor_share), so_far),
        }
    )
    first = floor_at(F.col("_s0") + F.col("_cum_in") - F.col("_cum_if"), 1.0)
    ahead = ahead.withColumn("_s1", first).withColumn(
        "_loss", floor_at(F.col("_loss_if") + _weighted_fit("stor", F.col("_s1")), 0.0)
    )
    ahead = ahead.withColumn("_cum_loss", running_total("_loss", so_far))
    stor = floor_at(F.col("_s0") + F.col("_cum_in") - F.col("_cum_loss"), 1.0)
    return ahead.select(*keys, *trace, "date", stor.alias("stor"))


def storage_quantiles(projected: DataFrame, keys: Sequence[str] = BASIN, value: str = "stor") -> DataFrame:
    return quantile_columns(projected, [*keys, "date"], value, "Pred")


def closure(
    rows: DataFrame, keys: Sequence[str] = BASIN, out: str = "loss", order: Sequence[str] = ("year", "month")
) -> DataFrame:
    """r2 and slope of inflow less loss (or measured outflow) on the storage change.

    rows are monthly by default; order=("date",) takes daily ones.
    """
    ordered = Window.partitionBy(*keys).orderBy(*order)
    steps = rows.withColumns(
        {"_ds": F.col("stor") - F.lag("stor").over(ordered), "_net": F.col("inflow") - F.col(out)}
    )
    return steps.groupBy(*keys).agg(
        F.regr_r2("_net", "_ds").alias("r2"), F.regr_slope("_net", "_ds").alias("slope"), F.regr_count("_net", "_ds").alias("n")
    )
