import datetime as dt
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from freshet.operators import features, verify
from freshet.operators.features import _inversions, _kendall_cdf, kendall


def hindcast(spark):
    """Two traces of one start: 31 + 28 + 31 days; observations stop in February."""
    first = dt.date(2001, 1, 1)
    rows = []
    for member in (1, 2):
        for i in range(90):
            day = first + dt.timedelta(days=i)
            rows.append(("a", first, member, 1, day, float(member), 2.0 if i < 59 else None))
    return spark.createDataFrame(rows, "basin string, init_date date, member int, param_id int, date date, pred double, obs double")


def test_lead_months_accumulate(spark):
    got = verify.lead_months(hindcast(spark)).filter("member = 2").orderBy("lead").collect()
    assert [r["pred"] for r in got] == [62, 118, 180]
    assert [r["act"] for r in got] == [62, 118, None]
    assert got[1]["date"] == dt.date(2001, 2, 15)
    started = verify.with_start_date(verify.lead_months(hindcast(spark))).select("start_date").distinct().collect()
    assert [r[0] for r in started] == [dt.date(2001, 1, 15)]
    storage = verify.lead_months_storage(hindcast(spark)).filter("member = 1").orderBy("lead").collect()
    assert [r["pred"] for r in storage] == [1, 1, 1]


def test_leads_cross_the_new_year(spark):
    rows = [("a", dt.date(2001, 11, 1), 1, 1, dt.date(2001, 11, 1) + dt.timedelta(days=i), 1.0, 1.0) for i in range(100)]
    df = spark.createDataFrame(rows, "basin string, init_date date, member int, param_id int, date date, pred double, obs double")
    got = verify.lead_months(df).orderBy("lead").collect()
    assert [r["date"].month for r in got] == [11, 12, 1, 2]


def test_climatology_by_lead_skips_unknown_months_and_the_last_year(spark):
    rows = [("a", y, m, float(m)) for y in (2001, 2002) for m in range(1, 13)]
    monthly = spark.createDataFrame(rows, "basin string, year int, month int, total double")
    got = {(r["start_year"], r["start_month"], r["lead"]): r["total"] for r in verify.climatology_by_lead(monthly).collect()}
    assert got[(2001, 11, 3)] == 11 + 12 + 1 and got[(2001, 1, 7)] == 28
    assert all(k[0] == 2001 for k in got)
    holes = verify.climatology_by_lead(monthly.withColumn("total", F.when(~((F.col("year") == 2001) & (F.col("month") == 3)), F.col("total"))))
    got = {(r["start_year"], r["start_month"], r["lead"]): r["total"] for r in holes.collect()}
    assert (2001, 2, 1) in got and (2001, 2, 2) not in got and (2001, 3, 1) not in got


def skill_of(spark, medians, act):
    leads, clim = [], []
    for i, m in enumerate(medians):
        date = dt.date(2001, 1 + i, 15)
        leads += [("a", date, 1, date, m + e, act) for e in (-1.0, 0.0, 1.0)]
        clim += [("a", 1 + i, 1, float(v)) for v in range(1, 10)]
    left = spark.createDataFrame(leads, "basin string, start_date date, lead int, date date, pred double, act double")
    right = spark.createDataFrame(clim, "basin string, start_month int, lead int, total double")
    return verify.skill_rows(left, right)


def test_terciles_of_ensemble_medians(spark):
    rows = skill_of(spark, [2.0, 5.0, 9.0], 5.0).orderBy("month").collect()
    assert [r["predTerc"] for r in rows] == [1, 2, 3] and {r["actTerc"] for r in rows} == {2}
    assert rows[0]["predMAE50"] == -3 and rows[0]["climMAE50"] == 0
    assert rows[2]["predMAE25"] == pytest.approx(9 - 0.334 - 5)


def test_contingency_sums_to_one_and_maps(spark):
    skill = skill_of(spark, [2.0, 5.0, 9.0, 9.0], 5.0).cache()
    table = verify.tercile_contingency(skill)
    for given, p in (("predTerc", "p_act_given_pred"), ("actTerc", "p_pred_given_act")):
        sums = table.groupBy("leadTime", given).agg(F.sum(p).alias("s")).collect()
        assert all(r["s"] == pytest.approx(1) for r in sums)
    maps = {r["month"]: r for r in verify.skill_maps(skill).collect()}
    assert maps[2]["med_hit_rate"] == 1 and maps[3]["med_hit_rate"] == 0 and maps[1]["low_hit_rate"] is None
    assert maps[3]["relMae50"] == 99.9  # the climatology is exactly right: any error is infinitely worse
    assert verify.skill_maps(skill, cap=None).filter("relMae25 > 100").count() >= maps[3]["relMae25"] // 99.9


def brute_kendall(x, y):
    return sum(np.sign(b[0] - a[0]) * np.sign(b[1] - a[1]) for a, b in itertools.combinations(zip(x, y), 2))


def test_kendall_matches_all_pairs():
    rng = np.random.default_rng(3)
    for n, spread in ((2, 5), (7, 3), (40, 6), (120, 1000), (333, 12)):
        x, y = rng.integers(0, spread, n).astype(float), rng.integers(0, spread, n).astype(float)
        assert kendall(x, y)[0] == brute_kendall(x, y)
    assert _inversions(np.array([3, 1, 2, 0])) == 5 and _inversions(np.array([0])) == 0


def test_exact_kendall_p_counts_permutations():
    n, x = 6, np.arange(6.0)
    s_all = [brute_kendall(x, p) for p in itertools.permutations(range(n))]
    y = np.array([0.0, 2, 1, 3, 5, 4])
    s, _, p = kendall(x, y)
    upper = sum(v >= s for v in s_all) / len(s_all)
    lower = sum(v <= s for v in s_all) / len(s_all)
    assert p == pytest.approx(min(1, 2 * min(upper, lower)))
    assert _kendall_cdf(6)[-1] == pytest.approx(1)


def monthly(spark, n=60):
    rng = np.random.default_rng(4)
    rows = [("a", 2001 + i // 12, 1 + i % 12, float(100 + rng.random()), float(rng.random()), float(rng.random())) for i in range(n)]
    return spark.createDataFrame(rows, "basin string, year int, month int, stor double, inflow double, loss double")


def test_rolling_means_need_the_full_width(spark):
    rows = features.rolling_means(monthly(spark), [3], 2).orderBy("year", "month").collect()
    stor = [r["stor"] for r in rows]
    assert rows[3]["stor_mn_3"] is None
    assert rows[4]["stor_mn_3"] == pytest.approx(np.mean(stor[0:3]))
    assert rows[59]["stor_mn_3"] == pytest.approx(np.mean(stor[55:58]))


def test_lag_screening_ranks_a_planted_lag_first(spark):
    base = monthly(spark).orderBy("year", "month").toPandas()
    base["loss"] = base["inflow"].rolling(2).mean().shift(1).fillna(0.5)
    df = spark.createDataFrame(base)
    screened = features.screen_lags(df, range(1, 5), 1).filter("series = 'inflow'").orderBy("rank").collect()
    assert screened[0]["width"] == 2 and screened[0]["p"] < 1e-6
    chosen = features.choose_lags(features.screen_lags(df, range(1, 5), 1), (1,))
    assert {(r["series"], r["width"]) for r in chosen.collect()} >= {("inflow", 2), ("inflow", 4), ("stor", 4)}


def test_projection_matches_the_capped_loop(spark):
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for t in range(20):
        out = inflow = 0.0
        for lead in range(1, 7):
            s0, i, m, p = rng.random() * 10, rng.random(), rng.random() * 6, rng.random() * 6
            rows.append((t, lead, s0, i, m, p, 0.3))
            inflow += i
            out = min(out + m * 0.7 + 0.3 * p, s0 + inflow)
            want[(t, lead)] = s0 + inflow - out
    df = spark.createDataFrame(rows, "t int, lead int, stor0 double, inflow double, mean_loss double, model_loss double, r2 double")
    got = {(r["t"], r["lead"]): r["stor"] for r in features.project_months(df, ["t"]).collect()}
    assert all(got[k] == pytest.approx(v) for k, v in want.items())


def test_monthly_tables_and_split(spark):
    rows = [("a", dt.date(2001, 1, 1) + dt.timedelta(days=i), float(i) if i != 30 else None, 1.0, 2.0) for i in range(100)]
    df = spark.createDataFrame(rows, "basin string, date date, stor double, inflow double, loss double")
    row = features.monthly_table(df, storage="last", scale="days").filter("month = 1").first()
    assert (row["stor"], row["inflow"], row["loss"]) == (29, 31, 62)
    assert features.monthly_table(df).filter("month = 2").first()["inflow"] == 30.4375
    split = features.split_rows(df)
    assert split.filter("is_validation").count() == 33
    assert features.split_rows(df, share=0.75, validate="rest").filter("is_validation").count() == 25
    assert features.split_by_date(df, "2001-04-01").filter("is_validation").count() == 10
    assert math.isclose(features.mean_loss_by_month(features.monthly_table(df)).first()["mean_loss"], 2 * 30.4375)


def test_a_month_without_inflow_or_loss_stops_the_projection(spark):
    rows = [("a", 1, 100.0, 10.0, 5.0, 5.0, 0.5), ("a", 2, 100.0, None, 5.0, 5.0, 0.5), ("a", 3, 100.0, 10.0, 5.0, 5.0, 0.5)]
    rows += [("b", 1, 100.0, 10.0, 5.0, 5.0, 0.5), ("b", 2, 100.0, 10.0, None, 5.0, 0.5)]
    months = spark.createDataFrame(rows, "trace string, lead int, stor0 double, inflow double, mean_loss double, model_loss double, r2 double")
    got = {(r["trace"], r["lead"]): r["stor"] for r in features.project_months(months, ["trace"]).collect()}
    assert got == {("a", 1): 105.0, ("a", 2): None, ("a", 3): None, ("b", 1): 105.0, ("b", 2): None}


def test_an_exact_climatology_shows_as_the_cap(spark):
    rows = [("g", 1, 1, 2, 2, *[5.0, 0.0] * 3), ("g", 1, 1, 2, 2, *[3.0, 0.0] * 3), ("g", 1, 1, 2, 2, *[1.0, 2.0] * 3)]
    names = ", ".join(f"{w}MAE{q} double" for q in ("25", "50", "75") for w in ("pred", "clim"))
    skill = spark.createDataFrame(rows, f"basin string, leadTime int, month int, predTerc int, actTerc int, {names}")
    got = verify.skill_maps(skill, ["basin"]).first()
    assert got["relMae50"] == 99.9 and got["absMae50"] == 3.0
