import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from freshet.operators import scoring


def pair_rows(spark, sim, obs, run=1, first="2001-01-01"):
    day = dt.date.fromisoformat(first)
    rows = [
        ("a", run, day + dt.timedelta(days=i), None if s is None else float(s), None if o is None else float(o))
        for i, (s, o) in enumerate(zip(sim, obs))
    ]
    return spark.createDataFrame(rows, "basin string, run_id int, date date, sim double, obs double")


RUN = ["basin", "run_id"]


def test_split_overlaps_when_three_divides_the_length(spark):
    for n, cal, val in ((9, [1, 2, 3, 6, 7, 8, 9], [3, 4, 5, 6]), (10, [1, 2, 3, 7, 8, 9, 10], [4, 5, 6])):
        rows = scoring.split_periods(pair_rows(spark, range(n), range(n)), RUN).orderBy("date").collect()
        assert [i + 1 for i, r in enumerate(rows) if r["in_cal"]] == cal
        assert [i + 1 for i, r in enumerate(rows) if r["in_val"]] == val


def test_perfect_run(spark):
    obs = [float(i % 17 + 1) for i in range(400)]
    row = scoring.scores(pair_rows(spark, obs, obs), RUN).first()
    assert row["kgeAll"] == pytest.approx(1) and row["nseAll"] == pytest.approx(1)
    assert row["maeAll"] == 0 and row["biasAll"] == 0 and row["mnthSumAbsBias"] == 0


def test_ten_percent_too_much(spark):
    obs = [float(i % 17 + 1) for i in range(400)]
    row = scoring.scores(pair_rows(spark, [1.1 * o for o in obs], obs), RUN).first()
    assert row["biasAll"] == pytest.approx(10) and row["mnthBias_7"] == pytest.approx(10)
    assert row["mnthSumAbsBias"] == pytest.approx(10)
    assert row["kgeAll"] == pytest.approx(1 - np.sqrt(0.1**2 + 0.1**2))


def test_scores_skip_pairs_with_a_null_and_match_numpy(spark):
    rng = np.random.default_rng(1)
    obs, sim = rng.random(200) + 1, rng.random(200) + 1
    row = scoring.scores(pair_rows(spark, [*sim, None, 3.0], [*obs, 5.0, None]), RUN).first()
    r = np.corrcoef(sim, obs)[0, 1]
    kge = 1 - np.sqrt((r - 1) ** 2 + (sim.std() / obs.std() - 1) ** 2 + (sim.mean() / obs.mean() - 1) ** 2)
    assert row["kgeAll"] == pytest.approx(kge)
    assert row["nseAll"] == pytest.approx(1 - ((obs - sim) ** 2).sum() / ((obs - obs.mean()) ** 2).sum())
    assert row["rmseAll"] == pytest.approx(np.sqrt(((obs - sim) ** 2).mean()))


def test_constant_or_zero_observations_do_not_stop_the_job(spark):
    row = scoring.scores(pair_rows(spark, [1.0, 2.0, 3.0], [0.0, 0.0, 0.0]), RUN).first()
    assert row["kgeAll"] is None and row["nseAll"] is None and row["biasAll"] is None


def scored(spark, n=60):
    rows = [("a", i, i, 0.5 + i / 200, 0.5 + (n - i) / 200, 0.5 + i / 200, (i - 30.5), i / 100, float(i), float(i), i - 20.2) for i in range(1, n + 1)]
    names = "basin string, run_id int, run_number int, kgeCalibration double, kgeValidation double, kgeAll double, biasAll double, nseAll double, maeAll double, rmseAll double, mnthSumAbsBias double"
    return spark.createDataFrame(rows, names)


def test_threshold_falls_a_step_per_block(spark):
    got = scoring.accept(scored(spark), ["basin"], target=0.67, block=10, wanted=5, step=0.01).collect()
    want = []
    for i in range(1, 61):
        limit = round(0.67 - 0.01 * ((i - 1) // 10 + 1), 10)
        if 0.5 + i / 200 > limit and 0.5 + (60 - i) / 200 > limit:
            want.append(i)
    assert sorted(r["run_number"] for r in got) == want[:5] and want


def test_best_runs(spark):
    got = scoring.best(scored(spark), ["basin"], 3).orderBy("rank").collect()
    assert [r["run_id"] for r in got] == [20, 21, 19]


@pytest.mark.parametrize("k", [3, 40, 1000])
def test_first_rows_beyond_the_group_limit_equal_a_window(spark, monkeypatch, k):
    rng = random.Random(k)
    rows = [
        (rng.choice(["a", "a", "b", None]), i, rng.choice([None, float("nan"), -1.0, 0.0, 0.0, rng.random(), rng.random()]))
        for i in range(400)
    ]
    df = spark.createDataFrame(rows, "basin string, run_id int, v double").repartition(4)
    order = Window.partitionBy("basin").orderBy(F.col("v").asc_nulls_last(), "run_id")
    want = df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).collect()
    monkeypatch.setattr(scoring, "GROUP_LIMIT", 2)
    got = scoring.first_rows(df, ["basin"], F.col("v"), "run_id", k).select("basin", "run_id", "rank").collect()
    assert sorted((str(r["basin"]), r["run_id"], r["rank"]) for r in got) == sorted((str(r["basin"]), r["run_id"], r["rank"]) for r in want)


def test_composite_keeps_duplicates(spark):
    got = scoring.best_composite(scored(spark), ["basin"])
    assert got.count() == 40
    assert got.filter("chosen_by = 'mae'").agg(F.max("run_id")).first()[0] == 4
    assert got.filter("run_id = 60").count() == 2


def test_parameter_draws_repeat_and_respect_their_order(spark):
    ids = spark.range(3000).withColumnRenamed("id", "run_id")
    sets = scoring.parameter_sets(scoring.draw_uniforms(ids, seed=4))
    again = scoring.parameter_sets(scoring.draw_uniforms(ids.repartition(5), seed=4))
    assert sets.exceptAll(again).count() == 0
    assert sets.filter("k1 > k0 or k2 > k1 or uz1 < perc").count() == 0
    low = sets.agg(F.min("fc"), F.max("fc"), F.avg(F.when(F.col("fc") < 150, 1).otherwise(0))).first()
    assert 25 <= low[0] < 40 and 1150 < low[1] <= 1200 and low[2] == pytest.approx(0.5, abs=0.05)


def test_warm_up_and_ensemble_fit(spark):
    rng = np.random.default_rng(2)
    obs = rng.random(500) + 1
    pairs = pair_rows(spark, obs * 2, obs, 1).unionByName(pair_rows(spark, obs * 4, obs, 2))
    kept = scoring.drop_warm_up(pairs, RUN)
    assert kept.count() == 2 * (500 - 365)
    medians = scoring.ensemble_median(kept, ["basin"])
    row = scoring.ensemble_fit(medians, scoring.scores(pairs, RUN), ["basin"]).first()
    assert row["r2"] == pytest.approx(1) and row["bias_median"] == pytest.approx(200)
    line = scoring.line_of_median(scoring.monthly_depths(kept, RUN), ["basin"], "month").first()
    assert line["slope"] == pytest.approx(3)
    errors = scoring.monthly_errors(kept, RUN).filter("run_id = 2").collect()
    assert all(r["error"] == pytest.approx(300) for r in errors)
