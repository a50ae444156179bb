"""Column rules and small table filters that clean raw records."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Approval flags under which a discharge value is used.
APPROVED_FLAGS = ["A", "A e", "P", "P e"]


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError("missing required columns: " + ", ".join(missing))
    return df


def approved_only(value: Column, flag: Column) -> Column:
    return F.when(flag.isin(APPROVED_FLAGS), value)


def negative_to_null(value: Column) -> Column:
    return F.when(value >= 0, value)


def floor_at(value: Column, floor: float) -> Column:
    """Values at or below the floor become the floor; null stays null."""
    return F.when(value <= floor, F.lit(float(floor))).otherwise(value)


def ordered_tmin(tmin: Column, tmax: Column) -> Column:
    """A minimum at or above the maximum is moved 0.1 below it."""
    return F.when(tmin >= tmax, tmax - 0.1).otherwise(tmin)


def mean_temperature(tmin: Column, tmax: Column) -> Column:
    return (tmin + tmax) / 2


def adjust(value: Column, offset: float | None = None, factor: float | None = None) -> Column:
    """Optional additive offset (temperatures) and factor (precipitation)."""
    if offset is not None:
        value = value + offset
    if factor is not None:
        value = value * factor
    return value


def signif(x: Column, digits: int) -> Column:
    """Round to significant digits, half to even."""
    magnitude = F.floor(F.log10(F.abs(x))) - digits + 1
    scale = F.pow(F.lit(10.0), F.abs(magnitude))
    rounded = F.when(magnitude < 0, F.bround(x * scale) / scale).otherwise(F.bround(x / scale) * scale)
    return F.when(x == 0, F.lit(0.0)).otherwise(rounded)


def complete_cases(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop(subset=list(columns) if columns else None)


def date_window(df: DataFrame, start=None, end=None, date: str = "date", open_start: bool = True) -> DataFrame:
    """Keep dates after start (or from start on, if not open) up to and including end."""
    if start is not None:
        bound = F.lit(start).cast("date")
        df = df.filter(F.col(date) > bound if open_start else F.col(date) >= bound)
    if end is not None:
        df = df.filter(F.col(date) <= F.lit(end).cast("date"))
    return df


def drop_partial_month(df: DataFrame, keys: Sequence[str], date: str = "date") -> DataFrame:
    """Drop the trailing month of each trace unless it runs to its last day."""
    last = F.max(date).over(Window.partitionBy(*keys))
    marked = df.withColumn("_last", last)
    keep = (F.col("_last") == F.last_day("_last")) | (F.col(date) < F.trunc("_last", "MM"))
    return marked.filter(keep).drop("_last")


def drop_until_complete(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], date: str = "date"
) -> DataFrame:
    """Drop the rows before the first one where every listed column is present."""
    present = F.lit(True)
    for c in columns:
        present = present & F.col(c).isNotNull()
    first = F.min(F.when(present, F.col(date))).over(Window.partitionBy(*keys))
    return df.withColumn("_first", first).filter(F.col(date) >= F.col("_first")).drop("_first")


def bias_long(params: DataFrame, keys: Sequence[str], prefix: str = "mnthBias_") -> DataFrame:
    """Twelve bias columns as rows (keys, month, bias)."""
    pairs = ", ".join(f"{m}, `{prefix}{m}`" for m in range(1, 13))
    return params.selectExpr(*keys, f"stack(12, {pairs}) as (month, bias)")


def correct_monthly_bias(
    traces: DataFrame, params: DataFrame, keys: Sequence[str], value: str = "sim", date: str = "date"
) -> DataFrame:
    """value * (100 - bias of the month) / 100 with the biases of the run."""
    biases = bias_long(params, keys).withColumnRenamed("month", "_month")
    return (
        traces.withColumn("_month", F.month(date))
        .join(biases, [*keys, "_month"], "left")
        .withColumn(value, F.col(value) * (100 - F.coalesce("bias", F.lit(0.0))) / 100)
        .drop("_month", "bias")
    )


def overlay_observed(
    traces: DataFrame, observed: DataFrame, keys: Sequence[str], value: str = "sim", obs: str = "obs", since=None
) -> DataFrame:
    """Where a day has been observed, the observation replaces every trace value.

    Observations from ``since`` on (the water year start) count; earlier ones do not.
    """
    obs_rows = observed.select(*keys, F.col(obs).alias("_obs")).filter(F.col("_obs").isNotNull())
    if since is not None:
        obs_rows = obs_rows.filter(F.col("date") >= F.lit(since).cast("date"))
    return (
        traces.join(obs_rows, list(keys), "left")
        .withColumn(value, F.coalesce("_obs", value))
        .drop("_obs")
    )
