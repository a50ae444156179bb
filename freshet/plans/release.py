"""Reservoir storage of the coming months by a release model for each basin and lead."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.operators import features, release, reservoir
from freshet.sources.staging import Staging


def storage_by_lead(
    daily: DataFrame, keys: Sequence[str] = ("basin",), leads: Sequence[int] = range(1, 7), **forest
) -> DataFrame:
    """(keys, start_year, start_month, lead, stor, actual, model_loss, r2) of every start month.

    daily is (keys, date, stor, inflow in cfs). Months are made of the unfilled records, their
    gaps take the mean. For each basin and lead the lags are screened and a forest learns
    the loss from the rolling means known at the start and the month; its settings go on to
    release.fit_by_basin. All models are rows of one job. A month's loss weighs model and
    monthly mean by the model's cross-validated r2, of which less than none counts as none.
    Starts before the longest lag is there have no storage, nor have leads behind a month
    without a model. Leads run from 1 without a gap; months beyond the record have no row.
    """
    staging = Staging(daily.sparkSession, "release")
    months = features.backfilled_months(reservoir.unfilled_records(daily, keys), keys)
    months = staging.keep(months.withColumn("number", F.col("year") * 12 + F.col("month") - 1))
    rows = features.lead_rows(months, leads, keys=keys).drop("lags")
    rows = features.split_rows(rows, [*keys, "lead"], ["year", "month"])
    rows = rows.withColumn("date", F.make_date("year", "month", F.lit(1)))
    told = release.fit_by_basin(rows, [*keys, "lead"], ("x",), one_hot=False, **forest)
    models = told.select(
        *keys, "lead", (F.year("date") * 12 + F.month("date") - 1).alias("number"), F.col("prediction").alias("model_loss"), F.greatest("cv_r2", F.lit(0.0)).alias("r2")
    )
    starts = months.select(*keys, F.col("number").alias("start"), F.col("stor").alias("stor0"))
    ahead = months.withColumn("lead", F.explode(F.array(*[F.lit(k) for k in leads])))
    ahead = ahead.select(*keys, "month", "number", "lead", (F.col("number") - F.col("lead")).alias("start"), "inflow", F.col("stor").alias("actual"))
    rows = (
        ahead.join(starts, [*keys, "start"])
        .join(models, [*keys, "lead", "number"], "left")
        .join(features.mean_loss_by_month(months, keys), [*keys, "month"])
    )
    out = features.project_months(rows, [*keys, "start"])
    return out.select(
        *keys, F.floor(F.col("start") / 12).cast("int").alias("start_year"), (F.col("start") % 12 + 1).alias("start_month"),
        "lead", "stor", "actual", "model_loss", "r2",
    )
