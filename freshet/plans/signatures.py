"""Gage signature products: every yearly metric, its trends, one wide row per gage."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame

from freshet.operators import quality, recession, trends, yearly
from freshet.sources.sinks import not_done

GAGE = ["gage_id"]


def arrange(daily: DataFrame, keys: Sequence[str] = GAGE) -> DataFrame:
    """One shuffle and one sort that every signature family then reuses.

    Persist the result before fanning out: a cached table keeps its partitioning and
    sort order, so the families add neither exchanges nor day-order sorts on daily rows.
    """
    return daily.repartition(*keys).sortWithinPartitions(*keys, "year", "doy")


def yearly_metrics(
    daily: DataFrame,
    keys: Sequence[str] = GAGE,
    families: Sequence[str] | None = None,
    volume_stat: str = "sum",
    fits: DataFrame | None = None,
) -> DataFrame:
    """All yearly metrics as long rows; runoff ratios join in when daily has ppt.

    fits are recession event fits computed before, if there are any.
    """
    parts = []
    for name, family in yearly.FAMILIES.items():
        if families is not None and name not in families:
            continue
        parts.append(family(daily, keys, volume_stat) if name == "volumes" else family(daily, keys))
    if families is None or "recession" in families:
        parts.append(recession.recession_metrics(fits if fits is not None else recession.event_fits(daily, keys), keys))
    if "ppt" in daily.columns and (families is None or "runoff" in families):
        parts.append(yearly.runoff_ratios(daily, keys))
    return reduce(DataFrame.unionByName, parts)


def gage_summary(
    daily: DataFrame,
    gages: DataFrame | None = None,
    upstream: DataFrame | None = None,
    keys: Sequence[str] = GAGE,
    min_q: float = 0.0001,
    min_days: int = 30,
    min_years: int = 20,
    families: Sequence[str] | None = None,
    cache: bool = True,
) -> DataFrame:
    """Header, <metric>_<stat> columns and recession seasonality, one row per accepted gage.

    The accepted days are shuffled and sorted once, and cached (memory, then disk) because
    every family reads them; spark.catalog.clearCache() frees them after the write. With
    cache=False each family goes back to the source.
    """
    kept = quality.restrict_to_valid_years(arrange(daily, keys), min_q, min_days, min_years, keys)
    if cache:
        kept = kept.persist()
    with_recession = families is None or "recession" in families
    fits = recession.event_fits(kept, keys) if with_recession else None
    if cache and with_recession:
        fits = fits.persist()
    metrics = yearly_metrics(kept, keys, families, fits=fits)
    wide = trends.summary_wide(trends.trends(metrics, keys), keys)
    header = quality.record_header(kept, upstream, keys)
    out = header.join(wide, list(keys), "left")
    if with_recession:
        out = out.join(recession.log_a_seasonality(fits, keys), list(keys), "left")
    return gages.join(out, list(keys)) if gages is not None else out


def resume_summary(daily: DataFrame, existing: DataFrame | None, keys: Sequence[str] = GAGE, **options) -> DataFrame:
    """gage_summary of the gages that the existing output does not hold yet.

    Finished gages are dropped before any shuffle of their days. Append the result to the
    existing output; keys may be (data_project, watershed_id) for a collection.
    """
    todo = not_done(daily, existing, keys) if existing is not None else daily
    return gage_summary(todo, keys=keys, **options)
