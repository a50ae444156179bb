import math

import numpy as np
import pytest

from freshet.operators import recession


def power_recession(a, b, q0, days):
    q = [q0]
    for _ in range(days - 1):
        q.append(q[-1] - a * q[-1] ** b)
    return q


def events_by_loop(q, least=5):
    """Positions (1-based start, end) of recession events of one year."""
    n, found, start = len(q), [], None
    if n < least + 1:
        return found
    dq = [None if q[i] is None or q[i + 1] is None else q[i + 1] - q[i] for i in range(n - 1)] + [None]

    def falls(i):
        for j in range(i, i + least - 1):
            if None in (q[j], q[j + 1], dq[j], dq[j + 1]) or q[j + 1] >= q[j] or abs(dq[j + 1]) >= abs(dq[j]):
                return False
        return True

    for i in range(n - least):
        if falls(i):
            start = i if start is None else start
        elif start is not None:
            if i - start >= least:
                found.append((start + 1, i))
            start = None
    if start is not None:
        found.append((start + 1, n))
    return found


def found(df):
    return sorted((r["start"], r["end"]) for r in recession.events(df).collect())


def test_events_match_a_loop(series):
    rng = np.random.default_rng(5)
    q = []
    while len(q) < 330:
        q += power_recession(0.05, 1.5, float(rng.uniform(2, 9)), int(rng.integers(6, 20))) + [5.0, 6.0]
    q[40], q[150] = None, None
    assert found(series({("a", "2001-01-01"): q})) == events_by_loop(q)


def test_an_open_recession_runs_to_the_last_day(series):
    q = [1.0] * 30 + power_recession(0.05, 1.5, 9.0, 12)
    assert found(series({("a", "2001-01-01"): q})) == events_by_loop(q) == [(31, 42)]


def test_short_runs_are_no_events(series):
    q = [5.0] * 20 + power_recession(0.05, 1.5, 9.0, 8) + [9.0] * 40
    assert found(series({("a", "2001-01-01"): q})) == events_by_loop(q) == []


def test_fit_recovers_the_power_law(series):
    q = [5.0] * 20 + power_recession(0.04, 1.6, 9.0, 14) + [20.0] * 20
    fit = recession.event_fits(series({("a", "2001-01-01"): q})).first()
    assert fit["b"] == pytest.approx(1.6) and fit["log_a"] == pytest.approx(math.log(0.04))
    assert fit["concavity"] == pytest.approx(0, abs=1e-9)


def test_yearly_parameters(series):
    q = []
    for b in (1.2, 1.5, 1.9):
        q += power_recession(0.03, b, 9.0, 15) + [30.0] * 5
    row = recession.yearly_parameters(recession.event_fits(series({("a", "2001-01-01"): q}))).first()
    assert row["b_events"] == pytest.approx(1.5)
    assert row["log_a_events"] == pytest.approx(math.log(0.03), abs=0.2)


def test_two_years_are_not_enough(series):
    q = ([20.0] * 10 + power_recession(0.04, 1.6, 9.0, 14) + [20.0] * 341) * 2
    df = series({("a", "2001-01-01"): q})
    assert recession.recession_metrics(recession.event_fits(df)).count() == 0
    assert recession.recession_metrics(recession.event_fits(df), min_years=2).count() > 0


def test_seasonality_of_a_known_sine(spark):
    phi = 40.0
    rows = [
        ("a", 2001 + k % 3, k, int(5 + 9.7 * k) % 365, math.sin(2 * math.pi * (int(5 + 9.7 * k) % 365 - phi) / 365))
        for k in range(36)
    ]
    fits = spark.createDataFrame(rows, "gage_id string, year int, event long, doy int, log_a double")
    row = recession.log_a_seasonality(fits).first()
    assert row["log_a_seasonality_amplitude_all"] == pytest.approx(1)
    assert row["log_a_seasonality_minimum_all"] == pytest.approx(phi + 273.75)
    assert row["log_a_seasonality_amplitude_first_half"] == pytest.approx(1)
    assert row["log_a_seasonality_minimum_last_half"] == pytest.approx(phi + 273.75)
