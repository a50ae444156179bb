"""The weekly forecast: one job for all basins, streamflow and storage stacked."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.functions.cleaning import correct_monthly_bias, negative_to_null
from freshet.functions.units import cfs_to_acft_day, mm_to_acft
from freshet.operators import forecast, reservoir
from freshet.operators.gaps import interpolate_linear
from freshet.sources.staging import Staging

BASIN = ["basin"]


def streamflow(
    basins: DataFrame, traces: DataFrame, sensor: DataFrame, water_year_start: str,
    params: DataFrame | None = None, keys: Sequence[str] = BASIN,
) -> DataFrame:
    """Cumulative streamflow product in acre-feet.

    traces(keys, member, param_id, date, sim in mm/day); sensor(keys, date, value in cfs);
    basins(keys, lat, lon, max_storage, area km2); params adds monthly biases to remove. The filled
    flow and the traces are written once, and all three parts of the product read these.
    """
    staging = Staging(traces.sparkSession, "streamflow")
    flow = sensor.select(*keys, "date", cfs_to_acft_day(negative_to_null(F.col("value"))).alias("flow"))
    flow = staging.keep(interpolate_linear(flow, keys, "date", "flow", ends="edge"))
    if params is not None:
        traces = correct_monthly_bias(traces, params, [*keys, "param_id"])
    areas = basins.select(*keys, "area")
    traces = traces.join(areas, list(keys)).withColumn("sim", mm_to_acft(F.col("sim"), F.col("area"))).drop("area")
    traces = staging.keep(traces)
    return forecast.forecast_product(
        basins.drop("area"),
        forecast.forecast_quantiles(traces, water_year_start, flow.withColumnRenamed("flow", "obs"), keys=keys),
        forecast.water_year_climatology(flow, water_year_start, keys=keys),
        forecast.water_year_history(flow, water_year_start, keys=keys),
        water_year_start,
        "Streamflow",
        keys,
    )


def storage(
    basins: DataFrame, traces: DataFrame, levels: DataFrame, water_year_start: str,
    params: DataFrame | None = None, keys: Sequence[str] = BASIN,
) -> DataFrame:
    """Storage product: loss models from the record, projected along every trace.

    levels(keys, date, stor acre-feet, inflow cfs); traces as for streamflow. The filled
    records feed the models, the projection and the climatology, and the projected traces the
    quantiles, so each is written once.
    """
    staging = Staging(traces.sparkSession, "storage")
    records = staging.keep(reservoir.loss_records(levels, keys))
    traces = staging.keep(traces)
    models = reservoir.loss_models(records, keys)
    if params is not None:
        traces = correct_monthly_bias(traces, params, [*keys, "param_id"])
    areas = basins.select(*keys, "area")
    inflow = traces.join(areas, list(keys)).withColumn("inflow", mm_to_acft(F.col("sim"), F.col("area"))).drop("area", "sim")
    projected = reservoir.project_storage(inflow, records, models, keys)
    last = records.groupBy(*keys).agg(F.max("date").alias("_last"))
    past = traces.select(*keys, *forecast.TRACE).distinct().join(
        records.join(last, list(keys)).filter(F.col("date") < F.col("_last")).select(*keys, "date", "stor"), list(keys)
    )
    whole = staging.keep(past.unionByName(projected))
    return forecast.forecast_product(
        basins.drop("area"),
        forecast.forecast_quantiles(whole, water_year_start, value="stor", keys=keys, cumulative=False),
        forecast.storage_climatology(records, water_year_start, keys=keys),
        forecast.water_year_history(records, water_year_start, "stor", keys=keys, cumulative=False),
        water_year_start,
        "Storage",
        keys,
    )


def weekly_product(streamflow_rows: DataFrame, storage_rows: DataFrame, basin: str = "basin") -> DataFrame:
    """Both products of all basins, stacked under the published column names.

    Only storage rows carry the reservoir's maximum storage.
    """
    flow = streamflow_rows.withColumn("max_storage", F.lit(None).cast("double"))
    both = flow.unionByName(storage_rows)
    names = {"date": "Date", basin: "Reservoir", "units": "Units", "lat": "Lat", "lon": "Lon"}
    last = {"max_storage": "MaxStorage", "storage_or_streamflow": "StorageOrStreamflow"}
    traces = [c for c in both.columns if c.startswith(("Pred_", "Clim_", "WaterYear_"))]
    return both.select(
        *[F.col(c).alias(n) for c, n in names.items()], *traces, *[F.col(c).alias(n) for c, n in last.items()]
    )
