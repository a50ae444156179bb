import itertools
import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from freshet.functions.distributions import spearman_tail_counts, with_normal_cdf, with_spearman_p
from freshet.operators import trends


def yearly_rows(spark, values, metric="Qann", first=2001):
    rows = [("a", first + i, metric, None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "gage_id string, year int, metric string, value double")


def only(spark, values, metric="Qann"):
    return trends.trends(yearly_rows(spark, values, metric)).first()


def test_straight_line(spark):
    row = only(spark, [365 * i for i in range(1, 6)])
    assert row["slp"] == pytest.approx(365) and row["rho"] == pytest.approx(1)
    assert row["pval"] == pytest.approx(2 / 120)
    assert (row["mean"], row["median"]) == (1095, 1095)


def test_ties_use_average_ranks_and_the_t_form(spark):
    row = only(spark, [1, 2, 2, 3])
    rho = np.corrcoef([1, 2, 3, 4], [1, 2.5, 2.5, 4])[0, 1]
    assert row["rho"] == pytest.approx(rho)
    # two degrees of freedom: the t distribution has a closed form
    t = rho * math.sqrt(2 / (1 - rho**2))
    assert row["pval"] == pytest.approx(1 - t / math.sqrt(2 + t * t))
    assert row["slp"] == pytest.approx(0.583333, abs=1e-5)


def test_two_values_give_no_trend(spark):
    assert only(spark, [1, 2]) is None
    assert only(spark, [1, None, 2]) is None


def test_constant_series_has_no_correlation(spark):
    row = only(spark, [4, 4, 4, 4])
    assert row["slp"] == 0 and row["rho"] is None and row["pval"] is None


def test_timing_metrics_round_half_to_even(spark):
    row = only(spark, [100, 101, 100, 101], "D50_day")
    assert row["mean"] == 100 and row["median"] == 100


def p_values(spark, rows):
    df = spark.createDataFrame(rows, "n int, rho double, tied boolean")
    return [r["pval"] for r in with_spearman_p(df).select("pval").collect()]


def test_exact_counts_are_those_of_all_permutations():
    for n in (3, 5):
        brute = {}
        for perm in itertools.permutations(range(n)):
            s = sum((i - p) ** 2 for i, p in enumerate(perm))
            brute[s] = brute.get(s, 0) + 1
        assert spearman_tail_counts(n) == brute


def test_edgeworth_is_close_to_the_exact_tail(spark):
    n = 11
    counts = spearman_tail_counts(n)
    total, middle = math.factorial(n), (n**3 - n) / 6
    rows, want = [], []
    for s in sorted(counts)[::7]:
        tail = sum(c for k, c in counts.items() if (k >= s if s > middle else k <= s))
        want.append(min(1.0, 2 * tail / total))
        rows.append((n, 1 - 6 * s / (n**3 - n), False))
    assert np.allclose(p_values(spark, rows), want, atol=1.2e-3)


def t_two_sided(t, nu):
    x = np.linspace(0, t, 200_001)
    pdf = math.gamma((nu + 1) / 2) / (math.sqrt(nu * math.pi) * math.gamma(nu / 2)) * (1 + x * x / nu) ** (-(nu + 1) / 2)
    return 1 - 2 * np.trapezoid(pdf, x)


def test_t_form_matches_the_integral(spark):
    rows = [(n, rho, True) for n in (3, 4, 5, 8, 13, 30, 60) for rho in (-0.7, 0.1, 0.45)]
    want = [t_two_sided(abs(r) * math.sqrt((n - 2) / (1 - r * r)), n - 2) for n, r, _ in rows]
    assert np.allclose(p_values(spark, rows), want, atol=1e-8)


def test_normal_cdf(spark):
    xs = [-6.0, -1.96, -0.3, 0.0, 0.5, 2.5, 7.5]
    df = with_normal_cdf(spark.createDataFrame([(x,) for x in xs], "x double"), "x", "p")
    got = [r["p"] for r in df.collect()]
    assert np.allclose(got, [0.5 * math.erfc(-x / math.sqrt(2)) for x in xs], atol=1e-14)


def test_summary_has_every_column(spark):
    wide = trends.summary_wide(trends.trends(yearly_rows(spark, [3, 1, 2, 5])))
    assert len(wide.columns) == 1 + 5 * len(trends.METRICS)
    # the signature contract: 320 trend columns and six of recession seasonality
    assert 5 * len(trends.METRICS) == 320
    row = wide.first()
    assert row["Qann_slp"] is not None and row["FDC90_rho"] is None


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 9), min_size=3, max_size=12))
def test_sen_slope_is_the_median_of_pair_slopes(spark, numbers):
    slopes = [(b - a) / (j - i) for (i, a), (j, b) in itertools.combinations(enumerate(numbers), 2)]
    assert only(spark, numbers)["slp"] == pytest.approx(float(np.median(slopes)))
