import datetime as dt

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from freshet.functions import calendar, cleaning
from freshet.operators import forecast, gaps, reservoir
from freshet.plans import weekly
from freshet.sources import sinks


def days(first, n):
    day = dt.date.fromisoformat(first)
    return [day + dt.timedelta(days=i) for i in range(n)]


def table(spark, values, name="flow", first="2000-10-01", basin="a"):
    rows = [(basin, d, None if v is None else float(v)) for d, v in zip(days(first, len(values)), values)]
    return spark.createDataFrame(rows, f"basin string, date date, {name} double")


def column(df, name):
    return [r[name] for r in df.orderBy("date").collect()]


def test_interpolation_and_ends(spark):
    df = table(spark, [None, 2, None, None, 5, None])
    assert column(gaps.interpolate_linear(df, ["basin"], "date", "flow"), "flow") == [None, 2, 3, 4, 5, None]
    assert column(gaps.interpolate_linear(df, ["basin"], "date", "flow", ends="flat"), "flow") == [2, 2, 3, 4, 5, 5]
    assert column(gaps.interpolate_linear(df, ["basin"], "date", "flow", ends="edge"), "flow") == [2, 2, 3, 4, 5, 5]
    two = table(spark, [None, None, 2, 4, None, None])
    assert column(gaps.interpolate_linear(two, ["basin"], "date", "flow", ends="edge"), "flow") == [2, 2, 2, 4, 4, 4]
    assert column(gaps.fill_next(two, ["basin"], "date", "flow"), "flow") == [2, 2, 2, 4, None, None]
    assert column(gaps.fill_mean(two, ["basin"], "flow"), "flow") == [3, 3, 2, 4, 3, 3]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=300))
def test_histogram_medians_are_exact(spark, numbers):
    df = spark.createDataFrame([(float(x), float(-x)) for x in numbers] + [(None, None)], "x double, y double")
    got = gaps.exact_medians(df, ["x", "y"], bins=4)
    assert got["x"] == pytest.approx(np.median(numbers)) and got["y"] == pytest.approx(-np.median(numbers))


def test_medians_when_one_value_holds_a_third_of_the_rows(spark):
    df = spark.range(3001).select(F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id") / 7.0).alias("x"))
    want = float(np.median([5.0 if i % 3 == 0 else i / 7.0 for i in range(3001)]))
    assert gaps.exact_medians(df, ["x"], bins=8)["x"] == pytest.approx(want)


def test_median_of_nothing_is_null(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert gaps.exact_medians(df, ["x"])["x"] is None
    assert gaps.fill_median(df, ["x"]).first()["x"] is None


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 14), st.floats(allow_nan=True), st.floats(-10, 10)), min_size=1, max_size=200))
def test_group_medians_are_exact(spark, rows):
    df = spark.createDataFrame([(k if k else None, x, y if k != 3 else None) for k, x, y in rows], "k int, x double, y double")
    got = {r["k"]: (r["x"], r["y"]) for r in gaps.group_medians(df, ["k"], ["x", "y"], bins=4).collect()}
    groups = {}
    for k, x, y in rows:
        xs, ys = groups.setdefault(k if k else None, ([], []))
        xs += [x] if x == x else []
        ys += [y] if k != 3 else []
    assert set(got) == set(groups)
    for k, (xs, ys) in groups.items():
        for value, numbers in zip(got[k], (xs, ys)):
            middle = sorted(numbers)[(len(numbers) - 1) // 2 : len(numbers) // 2 + 1]
            want = sum(m / 2 for m in middle) * (2 if len(middle) == 1 else 1) if middle else None
            assert value == want or value == pytest.approx(want, nan_ok=True)


def test_mean_and_median_fill_keep_rows_with_a_null_key(spark):
    df = spark.createDataFrame([(None, 1.0), (None, None), ("a", None), ("b", 2.0), ("b", None), ("b", 5.0)], "k string, v double")
    mean = sorted(gaps.fill_mean(df, ["k"], "v").collect(), key=str)
    assert sorted(str(r["v"]) for r in mean) == sorted(["1.0", "1.0", "None", "2.0", "3.5", "5.0"])
    middle = gaps.fill_median(df, ["v"], by=["k"])
    assert sorted(str(r["v"]) for r in middle.collect()) == sorted(["1.0", "1.0", "None", "2.0", "3.5", "5.0"])
    assert gaps.fill_median(df.limit(0), ["v"], by=["k"]).collect() == []


def test_writes_per_key_resume_and_replace_only_their_own(spark, tmp_path):
    rows = spark.createDataFrame([(k, v) for k in "abcde" for v in range(3)], "run string, v int")
    ran = []

    def compute(todo):
        ran.append(sorted(r["run"] for r in todo.select("run").distinct().collect()))
        if len(ran) == 3:
            raise RuntimeError("lost")
        return todo.groupBy("run").agg(F.sum("v").alias("v"))

    path = str(tmp_path / "out")
    with pytest.raises(RuntimeError, match="lost"):
        sinks.write_per_key(rows, compute, path, "run", batch=2)
    got = sinks.write_per_key(rows, compute, path, "run", batch=2).collect()
    assert ran == [["a", "b"], ["c", "d"], ["e"], ["e"]]
    assert sorted((r["run"], r["v"]) for r in got) == [(k, 3) for k in "abcde"]
    sinks.write_per_key(rows, compute, path, "run")
    assert len(ran) == 4


def test_water_year_calendar(spark):
    df = table(spark, [1] * 400, first="2003-09-30")
    row = {r["date"]: r for r in df.select("date", calendar.water_year(F.col("date")).alias("wy"), calendar.wy_day(F.col("date")).alias("n")).collect()}
    assert (row[dt.date(2003, 9, 30)]["wy"], row[dt.date(2003, 10, 1)]["wy"]) == (2003, 2004)
    assert row[dt.date(2003, 10, 1)]["n"] == 1 and row[dt.date(2004, 9, 30)]["n"] == 366
    start = df.select(calendar.lead_start_date(F.lit("2004-03-31").cast("date"), F.lit(2)).alias("s")).first()["s"]
    assert start == dt.date(2004, 2, 29)


def test_partial_month_and_leading_rows(spark):
    df = table(spark, [1] * 40, first="2001-01-01")
    assert max(column(cleaning.drop_partial_month(df, ["basin"]), "date")) == dt.date(2001, 1, 31)
    full = table(spark, [1] * 31, first="2001-01-01")
    assert cleaning.drop_partial_month(full, ["basin"]).count() == 31
    gaps_first = table(spark, [None, None, 1, None])
    assert cleaning.drop_until_complete(gaps_first, ["basin"], ["flow"]).count() == 2


def test_signif_floor_and_order(spark):
    row = spark.range(1).select(
        cleaning.signif(F.lit(123456.0), 2).alias("a"), cleaning.signif(F.lit(-0.0012345), 4).alias("b"),
        cleaning.signif(F.lit(0.0), 2).alias("c"), cleaning.signif(F.lit(2.5), 1).alias("d"),
        cleaning.floor_at(F.lit(0.3), 1).alias("e"), cleaning.ordered_tmin(F.lit(5.0), F.lit(4.0)).alias("f"),
        cleaning.negative_to_null(F.lit(-1.0)).alias("g"),
    ).first()
    assert list(row)[:6] == pytest.approx([120000, -0.001234, 0, 2, 1, 3.9]) and row["g"] is None


def test_climatology_of_constant_years(spark):
    df = table(spark, [2] * (365 * 4 + 1))
    clim = forecast.water_year_climatology(df, "2002-10-01")
    rows = {r["day_of_wy"]: r for r in clim.collect()}
    assert len(rows) == 365 and rows[365]["Clim_Q05"] == rows[365]["Clim_Q95"] == 730


def test_climatology_skips_years_with_large_gaps_and_fills_small_ones(spark):
    first = [1.0] * 365
    first[9] = None
    first[0] = 0.0
    second = [5.0] * 300
    df = table(spark, first, first="2001-10-01").unionByName(table(spark, second, first="2002-10-01"))
    df = df.unionByName(table(spark, [3.0] * 730, first="2003-10-01"))
    rows = {r["day_of_wy"]: r for r in forecast.water_year_climatology(df, "2005-10-01").collect()}
    mean = 363 / 364
    # two years are left: the first one and the last but one
    totals = sorted([1 + 363 + mean, 3 * 365])
    assert rows[365]["Clim_Q50"] == pytest.approx(sum(totals) / 2)


def test_smoothing_keeps_a_constant_and_matches_a_loop(spark):
    rng = np.random.default_rng(0)
    v = rng.random(60)
    cols = ", ".join(f"Clim_{q} double" for q in forecast.QUANTILES)
    df = spark.createDataFrame([("a", i + 1, 7.0, *[float(x)] * 4) for i, x in enumerate(v)], f"basin string, day_of_wy int, {cols}")
    got = {r["day_of_wy"]: r for r in forecast.smooth_climatology(df).collect()}
    sigma = 0.3706506 * 12
    for d in (1, 30, 60):
        w = np.array([np.exp(-0.5 * ((k - d) / sigma) ** 2) if abs(k - d) <= 4 * sigma else 0 for k in range(1, 61)])
        assert got[d]["Clim_Q50"] == pytest.approx((w * v).sum() / w.sum())
        assert got[d]["Clim_Q05"] == pytest.approx(7)


def traces(spark, first="2001-09-25", n=30):
    rows = [("a", m, p, d, float(m * 10 + p)) for m in (1, 2) for p in (1, 2) for d in days(first, n)]
    return spark.createDataFrame(rows, "basin string, member int, param_id int, date date, sim double")


def test_ensemble_quantiles_overlay_and_accumulate(spark):
    obs = table(spark, [100, 100], "obs", "2001-09-30")
    got = forecast.forecast_quantiles(traces(spark), "2001-10-01", obs).orderBy("date").collect()
    assert got[0]["date"] == dt.date(2001, 10, 1) and got[0]["Pred_Q05"] == 100
    assert got[1]["Pred_Q50"] == pytest.approx(100 + np.median([11, 12, 21, 22]))


def test_enumeration_and_splice(spark):
    members = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "basin string, member int")
    params = spark.createDataFrame([("a", 1), ("a", 2), ("b", 9)], "basin string, param_id int")
    assert forecast.ensemble(members, params).count() == 5
    history = table(spark, [1, 1, 1], "v", "2001-10-01")
    ahead = spark.createDataFrame([("a", m, d, 5.0) for m in (1, 2) for d in days("2001-10-02", 4)], "basin string, member int, date date, v double")
    out = forecast.splice(history, ahead).collect()
    assert sum(not r["is_forecast"] for r in out) == 6 and sum(r["is_forecast"] for r in out) == 4


def test_history_columns_product_and_roll(spark):
    flow = table(spark, [1] * 365 + [2] * 365 + [3] * 10)
    past = forecast.water_year_history(flow, "2002-10-01")
    basins = spark.createDataFrame([("a", 1.0, 2.0, 9.0)], "basin string, lat double, lon double, max_storage double")
    clim = forecast.water_year_climatology(flow, "2002-10-01")
    pred = forecast.forecast_quantiles(traces(spark, "2002-10-01"), "2002-10-01")
    out = forecast.forecast_product(basins, pred, clim, past, "2002-10-01", "streamflow")
    rows = {r["day_of_wy"]: r for r in out.collect()}
    assert len(rows) == 365
    assert rows[10]["WaterYear_Curr"] == 30 and rows[11]["WaterYear_Curr"] is None
    assert rows[365]["WaterYear_1YrAgo"] == 730 and rows[365]["WaterYear_2YrAgo"] == 365
    assert rows[30]["Pred_Q50"] is not None and rows[31]["Pred_Q50"] is None
    rolled = {r["day_of_wy"]: r for r in forecast.roll_years(out, "2002-11-01", "2002-10-01").collect()}
    assert rolled[10]["WaterYear_1YrAgo"] == 30 and rolled[365]["WaterYear_3YrAgo"] == 365
    assert forecast.percent_of_average(out).first()["percent_of_average"] == pytest.approx(150)


def test_storage_climatology_covers_the_year_in_order(spark):
    for start in ("2003-10-01", "2004-10-01"):
        df = table(spark, range(365 * 3), "stor", "2001-01-01")
        clim = forecast.storage_climatology(df, start).orderBy("day_of_wy").collect()
        assert [r["day_of_wy"] for r in clim] == [i + 1 for i, d in enumerate(days(start, 365)) if d.timetuple().tm_yday <= 365]


def test_loss_of_a_linear_reservoir(spark):
    acft = 86400 / 43559.9
    rows = [("a", d, 1000.0 + 5 * i, 10.0) for i, d in enumerate(days("2001-01-01", 10))]
    levels = spark.createDataFrame(rows, "basin string, date date, stor double, inflow double")
    got = reservoir.loss_records(levels, floors=False).orderBy("date").collect()
    assert got[0]["loss"] == pytest.approx(10 * acft - 5) and got[-1]["loss"] is None
    debiased = reservoir.loss_records(levels).orderBy("date").collect()
    assert debiased[0]["loss"] == pytest.approx(10 * acft)


def project_by_loop(s0, inflow, doy_loss, m):
    def fit(p, x):
        return m[f"{p}_log_weight"] * (m[f"{p}_log_intercept"] + np.log(x) * m[f"{p}_log_slope"]) + m[f"{p}_lin_weight"] * (
            m[f"{p}_lin_intercept"] + x * m[f"{p}_lin_slope"]
        )

    x = np.maximum(inflow, 1)
    base = np.maximum(fit("inflow", x) + fit("doy", doy_loss), 0)
    share = m["stor_log_weight"] + m["stor_lin_weight"]
    s1 = np.maximum(s0 + x.cumsum() - (base / (1 - share)).cumsum(), 1)
    total = np.maximum(base + fit("stor", s1), 0)
    return np.maximum(s0 + x.cumsum() - total.cumsum(), 1)


def levels(spark, n=800, seed=1):
    rng = np.random.default_rng(seed)
    stor = 5000 + np.cumsum(rng.normal(0, 20, n))
    inflow = rng.gamma(2, 40, n)
    rows = [("a", d, float(s), float(i)) for d, s, i in zip(days("2000-10-01", n), stor, inflow)]
    return spark.createDataFrame(rows, "basin string, date date, stor double, inflow double")


def test_projected_storage_matches_a_loop(spark):
    records = reservoir.loss_records(levels(spark))
    models = reservoir.loss_models(records)
    weights = models.first().asDict()
    assert sum(v for k, v in weights.items() if k.endswith("_weight")) == pytest.approx(1)
    last = records.agg(F.max("date")).first()[0]
    ahead = [last + dt.timedelta(days=i) for i in range(60)]
    rng = np.random.default_rng(9)
    flow = rng.gamma(2, 60, 60)
    rows = [("a", 1, 1, d, float(x)) for d, x in zip(ahead, flow)]
    tr = spark.createDataFrame(rows, "basin string, member int, param_id int, date date, inflow double")
    got = column(reservoir.project_storage(tr, records, models), "stor")
    by_doy = {r["doy"]: r["doy_loss"] for r in reservoir.mean_loss_by_doy(records).collect()}
    s0 = records.filter(F.col("date") == last).first()["stor"]
    want = project_by_loop(s0, flow, np.array([by_doy[d.timetuple().tm_yday] for d in ahead]), weights)
    assert np.allclose(got, want)


def test_weekly_product_end_to_end(spark):
    basins = spark.createDataFrame([("a", 40.0, -120.0, 9e3, 1500.0)], "basin string, lat double, lon double, max_storage double, area double")
    held = levels(spark)
    sensor = held.select("basin", "date", F.col("inflow").alias("value"))
    start = "2002-10-01"
    rows = [("a", m, p, d, 0.1 * m + 0.01 * p) for m in (1, 2) for p in (1, 2) for d in days("2002-12-01", 200)]
    tr = spark.createDataFrame(rows, "basin string, member int, param_id int, date date, sim double")
    bias = ", ".join(f"{10.0 * (m % 2)}D as mnthBias_{m}" for m in range(1, 13))
    params = spark.sql(f"select 'a' as basin, p as param_id, {bias} from values (1), (2) as t(p)")
    flow = weekly.streamflow(basins, tr, sensor, start, params)
    stor = weekly.storage(basins, tr, held, start, params)
    out = weekly.weekly_product(flow, stor)
    assert out.count() == 730 and {r[0] for r in out.select("StorageOrStreamflow").distinct().collect()} == {"Streamflow", "Storage"}
    assert out.columns[:5] == ["Date", "Reservoir", "Units", "Lat", "Lon"] and len(out.columns) == 21
    assert out.filter("MaxStorage is not null").count() == 365
    seen = stor.filter("Pred_Q50 is not null").agg(F.min("date"), F.max("date")).first()
    assert seen[0] == dt.date(2002, 10, 1) and seen[1] > dt.date(2003, 5, 1)
