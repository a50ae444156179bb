import math
import random

import numpy as np
import pytest

from freshet.operators import quality, yearly


def noisy(n=365, seed=3):
    rng = random.Random(seed)
    return [round(5 + 4 * math.sin(i / 40) + rng.random() * 3, 3) for i in range(n)]


def test_volumes_sum_and_mean_by_season(series, values):
    got = values(yearly.volumes(series({("a", "2001-01-01"): [2] * 365})))
    assert got[(2001, "Qann")] == 730
    assert got[(2001, "Qwin")] == 2 * (31 + 28 + 31)
    assert got[(2001, "Qspr")] == 2 * 92
    got = values(yearly.volumes(series({("a", "2001-01-01"): [2] * 365}), stat="mean"))
    assert got[(2001, "Qann")] == 2


def test_volumes_of_a_season_without_flow_give_no_row(series, values):
    got = values(yearly.volumes(series({("a", "2001-03-01"): [1, None, 3]})))
    assert (2001, "Qwin") not in got and got[(2001, "Qspr")] == 4


def test_percentiles_are_type_seven_and_monotone(series, values):
    q = noisy()
    got = values(yearly.flow_percentiles(series({("a", "2001-01-01"): q})))
    for p in yearly.FLOW_PERCENTILES:
        assert got[(2001, f"Q{p}")] == pytest.approx(np.percentile(q, p))
    ordered = [got[(2001, f"Q{p}")] for p in yearly.FLOW_PERCENTILES]
    assert ordered == sorted(ordered)
    assert got[(2001, "Q95_Q10")] == pytest.approx(np.percentile(q, 95) - np.percentile(q, 10))


def test_fdc_slopes_match_least_squares(series, values):
    q = noisy(200)
    got = values(yearly.fdc_slopes(series({("a", "2001-01-01"): [*q, None, None]})))
    x = np.arange(1, 201) / 201
    y = np.log10(np.sort(q)[::-1] + 1e-10)
    for name, inside in (("FDCall", x >= 0), ("FDC90", x >= 0.9), ("FDCmid", (x >= 0.2) & (x <= 0.8))):
        assert got[(2001, name)] == pytest.approx(np.polyfit(x[inside], y[inside], 1)[0])


def test_fdc_needs_thirty_rows(series, values):
    assert values(yearly.fdc_slopes(series({("a", "2001-01-01"): noisy(29)}))) == {}


def test_flashiness_fills_small_gaps_flat_at_the_ends(series, values):
    q = [None, *[1, 3] * 20, 1, None, 3, None]
    filled = [1, *[1, 3] * 20, 1, 2, 3, 3]
    got = values(yearly.flashiness(series({("a", "2001-01-01"): q})))
    assert got[(2001, "flashinessRB")] == pytest.approx(np.abs(np.diff(filled)).sum() / sum(filled))


def test_flashiness_skips_years_with_a_fifth_missing(series, values):
    q = [1.0] * 40 + [None] * 11
    assert values(yearly.flashiness(series({("a", "2001-01-01"): q}))) == {}


def test_timing_of_constant_flow(series, values):
    got = values(yearly.timing(series({("a", "2001-01-01"): [1] * 365})))
    assert got[(2001, "D50_day")] == 183 and got[(2001, "D5_day")] == 19
    assert got[(2001, "D25_to_D75")] == 274 - 92
    assert got[(2001, "Dmax")] == 1
    days = [got[(2001, f"D{p}_day")] for p in yearly.TIMING_PERCENTILES]
    assert days == sorted(days)


def test_a_null_stops_the_running_total(series, values):
    q = [1.0] * 365
    q[99] = None
    got = values(yearly.timing(series({("a", "2001-01-01"): q})))
    assert got[(2001, "D20_day")] == 73 and (2001, "D30_day") not in got
    assert got[(2001, "Dmax")] == 1


def test_pulses_count_runs_and_mean_length(series, values):
    q = [1.0] * 365
    for start, length in ((50, 1), (100, 2), (200, 4)):
        q[start : start + length] = [9.0] * length
    got = values(yearly.pulses(series({("a", "2001-01-01"): q})))
    assert got[(2001, "n_high_pulses_year")] == 3
    assert got[(2001, "dur_high_pulses_year")] == pytest.approx(7 / 3)
    assert got[(2001, "n_low_pulses_year")] == 0 and (2001, "dur_low_pulses_year") not in got


def test_a_null_day_splits_a_pulse(series, values):
    q = [1.0] * 365
    q[100:105] = [9.0, 9.0, None, 9.0, 9.0]
    got = values(yearly.pulses(series({("a", "2001-01-01"): q})))
    assert got[(2001, "n_high_pulses_all")] == 2


def test_tqmean(series, values):
    got = values(yearly.tqmean(series({("a", "2001-01-01"): [1] * 300 + [11] * 65})))
    assert got[(2001, "TQmean")] == pytest.approx(65 / 365 * 100)


def reversals_by_loop(q):
    q = [v for v in q if v is not None]
    n = 0
    for i in range(1, len(q) - 1):
        before, after = q[i] - q[i - 1], q[i + 1] - q[i]
        if abs(after) > abs(0.02 * q[i]) and ((before >= 0 > after) or (before <= 0 < after)):
            n += 1
    return n


def test_reversals_ignore_small_turns_and_nulls(series, values):
    q = [100 + (i % 2) for i in range(200)] + [100 + 3 * (i % 2) for i in range(165)]
    q[250] = None
    got = values(yearly.reversals(series({("a", "2001-01-01"): q})))
    assert got[(2001, "Flow_Reversals_annual")] == reversals_by_loop(q)
    winter = q[:59] + q[334:]
    assert got[(2001, "Flow_Reversals_winter")] == reversals_by_loop(winter)


def test_a_season_of_nulls_has_no_reversals(series, values):
    q = [float(i % 5) + 1 for i in range(365)]
    q[59:151] = [None] * 92
    got = values(yearly.reversals(series({("a", "2001-01-01"): q})))
    assert got[(2001, "Flow_Reversals_spring")] == 0


def test_runoff_ratio_needs_both_values(series, values):
    got = values(yearly.runoff_ratios(series({("a", "2001-06-01"): [1, 2, None, 4]}, extra=[2, None, 5, 8])))
    assert got[(2001, "annual_runoff_ratio")] == pytest.approx(5 / 10)
    assert (2001, "winter_runoff_ratio") not in got


def eckhardt_by_loop(q, bfi_max=0.8, a=0.98):
    b = [None if q[0] is None else q[0] * bfi_max]
    for i in range(1, len(q)):
        if q[i] is None or b[-1] is None:
            b.append(None)
        else:
            raw = ((1 - bfi_max) * a * b[-1] + (1 - a) * bfi_max * q[i]) / (1 - a * bfi_max)
            b.append(max(min(raw, q[i]), 0))
    return sum(v for v in b if v is not None)


def lyne_hollick_by_loop(q, alpha=0.925):
    def run(values, first):
        out = [first]
        for i in range(1, len(values)):
            (v, cap), (pv, _) = values[i], values[i - 1]
            if v is None or pv is None or out[-1] is None:
                out.append(None)
            else:
                out.append(max(0, min(alpha * out[-1] + (1 + alpha) / 2 * (v - pv), cap)))
        return out

    forward = run([(v, v) for v in q], 0.0)
    backward = run(list(zip(forward, q))[::-1], forward[-1])[::-1]
    return sum(max(v - f, 0) for v, f in zip(q, backward) if v is not None and f is not None)


@pytest.mark.parametrize("hole", [None, 0, 120, 364])
def test_baseflow_folds_match_loops(series, values, hole):
    q = noisy()
    if hole is not None:
        q[hole] = None
    total = sum(v for v in q if v is not None)
    got = values(yearly.baseflow_indices(series({("a", "2001-01-01"): q})))
    assert got[(2001, "BFI_Eckhardt")] == pytest.approx(eckhardt_by_loop(q) / total)
    assert got[(2001, "BFI_LyneHollick")] == pytest.approx(lyne_hollick_by_loop(q) / total)
    assert 0 <= got[(2001, "BFI_Eckhardt")] <= 1


def test_median_flow_dates(series):
    falling = [float(365 - i) for i in range(365)]
    row = yearly.median_flow_dates(series({("a", "2001-01-01"): falling, ("b", "2001-01-01"): falling})).first()
    assert row["D50_med_date"] == 183


def test_gages_do_not_mix(series, values):
    both = series({("a", "2001-01-01"): noisy(seed=1), ("b", "2001-01-01"): noisy(seed=2)})
    alone = values(yearly.pulses(series({("a", "2001-01-01"): noisy(seed=1)})))
    mixed = values(yearly.pulses(both).filter("gage_id = 'a'"))
    assert alone == mixed


def test_valid_year_gates(series):
    days = series({("a", "2001-01-01"): [1] * 40 + [0] * 325 + [1] * 29, ("b", "2001-01-01"): [1] * 400})
    years = {(r["gage_id"], r["year"]) for r in quality.valid_years(days).collect()}
    assert years == {("a", 2001), ("b", 2001), ("b", 2002)}
    assert [r["gage_id"] for r in quality.gages_with_years(quality.valid_years(days), 2).collect()] == ["b"]
    assert quality.gages_with_years(quality.valid_years(days), 2, strict=True).count() == 0
    kept = quality.restrict_to_valid_years(days, min_years=2)
    assert {r["gage_id"] for r in kept.select("gage_id").distinct().collect()} == {"b"}
    assert quality.enough_distinct_years(days, 2).count() == 2


def test_one_per_day_adds_up_duplicates(spark):
    rows = spark.sql("select 'a' as gage_id, date '2001-05-01' as date, 1.5D as q union all select 'a', date '2001-05-01', 2.0D")
    assert quality.one_per_day(rows, ["gage_id"], q="sum").first()["q"] == 3.5


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="doy"):
        yearly.timing(spark.sql("select 'a' as gage_id, 2001 as year, 1D as q"))
