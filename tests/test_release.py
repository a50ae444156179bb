import datetime as dt

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from freshet.operators import features, release, reservoir
from freshet.plans import release as plan
from freshet.sources import staging


def plain_tree(cells, bins, y, w, rows, at):
    """One tree grown node by node with all splits looked at; predictions of the rows `at`."""
    out = {}

    def go(rows, at):
        n, s = w[rows].sum(), (w[rows] * y[rows]).sum()
        best = None
        if n > release.NODE:
            for c, size in enumerate(bins):
                for b in range(size if c == 0 else size - 1):
                    left = (cells[c] == b) if c == 0 else (cells[c] <= b)
                    ln, ls = w[rows][left[rows]].sum(), (w[rows] * y[rows])[left[rows]].sum()
                    if 0 < ln < n:
                        gain = ls * ls / ln + (s - ls) ** 2 / (n - ln) - s * s / n
                        if best is None or gain > best[0] + 1e-9:
                            best = gain, left
        if best is None or best[0] <= 1e-9:
            out.update({i: s / n for i in at})
            return
        left = best[1]
        go(rows[left[rows]], at[left[at]])
        go(rows[~left[rows]], at[~left[at]])

    go(rows, at)
    return out


def test_trees_grown_together_equal_trees_grown_node_by_node():
    rng = np.random.default_rng(1)
    n, bins = 120, [12, 9, 7]
    cells = [rng.integers(0, b, n) for b in bins]
    y = np.sin(cells[0]) + cells[1] * cells[2] / 9 + rng.normal(size=n)
    weights = rng.multinomial(90, np.full(90, 1 / 90), size=4)
    weights = np.concatenate([weights, np.zeros((4, 30), int)], axis=1).astype(float)
    got = release.grow(cells, bins, y, weights, np.arange(n) >= 90, 14, rng)
    for t in range(4):
        want = plain_tree(cells, bins, y, weights[t], np.flatnonzero(weights[t]), np.arange(90, n))
        assert got[t, 90:] == pytest.approx([want[i] for i in range(90, n)])


def test_nodes_that_end_are_not_counted_over(monkeypatch):
    """Tables are made for nodes that may split alone, and of rows that a tree drew."""
    rng = np.random.default_rng(4)
    n, bins = 200, [12, 9, 7]
    cells = [rng.integers(0, b, n) for b in bins]
    y = rng.normal(size=n)
    weights = np.zeros((30, n))
    weights[:, : release.NODE] = 1  # all trees end at once
    weights[0, :150] = 1  # but the first
    sizes, count = [], np.bincount
    monkeypatch.setattr(release.np, "bincount", lambda x, w, size: sizes.append((len(x), size)) or count(x, w, size))
    got = release.grow(cells, bins, y, weights, np.ones(n, bool), 14, rng)
    assert got[1:] == pytest.approx(np.full((29, n), y[: release.NODE].mean()))
    # Two sums by tree, then a table of each column for the one tree left, from its own rows.
    assert sizes[:8] == [(30 * n, 30)] * 2 + [(150, size) for size in bins for _ in range(2)]


def rows(spark, basins=("a", "b"), n=400):
    out = []
    for k, basin in enumerate(basins):
        rng = np.random.default_rng(k)
        for i in range(n):
            day = dt.date(2000, 1, 1) + dt.timedelta(days=i)
            stor, inflow = float(rng.random()), float(rng.random())
            out.append((basin, day, day.month, 3 * stor + inflow * (1 + day.month) + k, stor, inflow))
    out += [("few", dt.date(2000, 1, 1), 1, 1.0, 2.0, 3.0), ("a", dt.date(1999, 1, 1), 1, None, 1.0, 1.0)]
    frame = spark.createDataFrame(out, "basin string, date date, month int, loss double, stor double, inflow double")
    return frame.withColumn("is_validation", F.dayofyear("date") % 3 == 0)


def test_forests_of_all_basins_at_once(spark):
    settings = {"trees": 30, "folds": 3, "repeats": 2, "block": 8}
    data = rows(spark)
    told = release.fit_by_basin(data, **settings)
    got = {(r["basin"], r["date"]): (r["prediction"], r["cv_r2"]) for r in told.collect()}
    assert len(got) == 801 and got["few", dt.date(2000, 1, 1)] == (None, None)
    again = {(r["basin"], r["date"]): (r["prediction"], r["cv_r2"]) for r in release.fit_by_basin(data.repartition(7), **settings).collect()}
    assert got.keys() == again.keys()
    assert all(a == b or a[0] == pytest.approx(b[0]) and a[1] == pytest.approx(b[1]) for a, b in ((got[k], again[k]) for k in got))
    quality = {(r["basin"], r["is_validation"]): r["r2"] for r in release.fit_quality(told.filter("basin <> 'few'")).collect()}
    assert len(quality) == 4 and all(0.8 < x <= 1 for x in quality.values())
    assert all(0.7 < r2 < 1 for (basin, _), (_, r2) in got.items() if basin != "few")
    assert release.fit_by_basin(data.limit(0), **settings).collect() == []


def test_blocks_of_trees_keep_partitions_of_their_own(spark, monkeypatch):
    """Blocks are long and their rows few: adaptive execution must not join them by size."""
    data = release.training_rows(rows(spark)).filter("basin in ('a', 'b')")
    asked, whole = [], type(data).repartition
    monkeypatch.setattr(type(data), "repartition", lambda self, *by: asked.append(by[0]) or whole(self, *by))
    told = release.fit_by_basin(data, trees=6, folds=2, repeats=2, block=2)
    assert asked == [2 * 2 * 2 * 2 * 3, 2 * 3]  # basins, settings, repeats, folds and blocks; basins and blocks
    assert told.filter("prediction is not null").count() == data.count()


def test_trees_grown_together_stay_in_a_cache(monkeypatch):
    sizes, grow = [], release.grow
    monkeypatch.setattr(release, "grow", lambda *a: sizes.append(a[3].shape) or grow(*a))
    n = 2500
    task = {"basin": "a", "setting": 0, "repeat": -1, "fold": -1, "block": 0, "month": [1 + i % 12 for i in range(n)], "loss": [float(i % 7) for i in range(n)]}
    task |= {"stor": [float(i % 91) for i in range(n)], "is_validation": [False] * n}
    batch = pa.RecordBatch.from_pylist([task])
    made = release._forester(["basin"], ["stor"], 50, 50, 2, ["all"], 1, False, True)
    assert len(list(made(iter([batch])))) == 1
    assert sum(t for t, _ in sizes) == 50 and max(t * r for t, r in sizes) <= 50_000


def test_trees_with_the_month_as_a_number_equal_trees_grown_node_by_node():
    rng = np.random.default_rng(2)
    n, bins = 90, [12, 9]
    cells = [rng.integers(0, b, n) for b in bins]
    y = cells[0] * 1.5 + np.cos(cells[1]) + rng.normal(size=n)
    weights = rng.multinomial(n, np.full(n, 1 / n), size=3).astype(float)
    got = release.grow(cells, bins, y, weights, np.ones(n, bool), 2, rng, hot=False)
    # A first column of one bin that no split can use leaves all others to be split at an edge.
    for t in range(3):
        # Only rows that were drawn: two splits may part those alike, and others not.
        drawn = np.flatnonzero(weights[t])
        want = plain_tree([np.zeros(n, int), *cells], [1, *bins], y, weights[t], drawn, drawn)
        assert got[t, drawn] == pytest.approx([want[i] for i in drawn])


def reservoirs(spark, basins=("a", "b"), days=1500):
    """Daily storage and inflow; a month without storage, single days without either, and an empty basin."""
    out = []
    for k, basin in enumerate(basins):
        rng = np.random.default_rng(k)
        stor = 5000.0
        for i in range(days):
            day = dt.date(2001, 1, 1) + dt.timedelta(days=i)
            inflow = float(round(40 + 30 * np.sin(i / 58) + rng.random() * 10, 3))
            stor = round(float(stor + inflow * 1.9 - (60 + 20 * np.cos(day.month)) * (1.2 + rng.random() / 5)), 3)
            lost = (day.year, day.month) == (2002, 5) or i % 97 == 0
            out.append((basin, day, None if lost else stor, None if i % 61 == 0 else inflow))
    out.append(("empty", dt.date(2001, 1, 1), None, None))
    return spark.createDataFrame(out, "basin string, date date, stor double, inflow double")


def test_unfilled_records_and_months_by_hand(spark):
    data = reservoirs(spark, ("a",))
    days = data.filter("basin = 'a'").toPandas().sort_values("date").reset_index(drop=True)
    days["acft"] = days["inflow"] * 86400 / 43559.9
    days["loss"] = -(days["stor"].shift(-1) - days["stor"] - days["acft"].shift(-1))
    records = reservoir.unfilled_records(data)
    got = records.filter("basin = 'a'").toPandas().sort_values("date").reset_index(drop=True)
    np.testing.assert_allclose(got["loss"].astype(float), days["loss"].astype(float))
    assert got["loss"].isna().sum() > 30
    days["ym"] = [(d.year, d.month) for d in days["date"]]
    by = days.groupby("ym")
    want = by.agg(stor=("stor", "last"), inflow=("acft", "mean"), loss=("loss", "mean"), n=("date", "size"))
    want["inflow"] *= want["n"]
    want["loss"] *= want["n"]
    want = want.fillna(want.mean())
    months = {(r["year"], r["month"]): r for r in features.backfilled_months(records).filter("basin = 'a'").collect()}
    assert months.keys() == set(want.index)
    for ym, row in want.iterrows():
        assert [months[ym][c] for c in ("stor", "inflow", "loss")] == pytest.approx([row["stor"], row["inflow"], row["loss"]])


def test_lead_rows_by_hand(spark):
    months = staging.Staging(spark, "test").keep(features.backfilled_months(reservoir.unfilled_records(reservoirs(spark))))
    data = months.toPandas()
    got = features.lead_rows(months, (1, 6)).collect()
    assert {r["basin"] for r in got} == {"a", "b"}
    for basin in ("a", "b"):
        one = data[data["basin"] == basin].sort_values(["year", "month"]).reset_index(drop=True)
        for lead in (1, 6):
            longest, lags, series = 24 - lead, [], {}
            for v in ("stor", "inflow"):
                scores = []
                for w in range(1, longest + 1):
                    series[v, w] = one[v].rolling(w).mean().shift(lead)
                    known = series[v, w].notna()
                    scores.append((-round(abs(features.kendall(series[v, w][known].round(7).to_numpy(), one["loss"][known].to_numpy())[1]), 9), w))
                lags += [(v, w) for w in sorted({w for _, w in sorted(scores)[:5]} | {longest})]
            rows = [r for r in got if r["basin"] == basin and r["lead"] == lead]
            assert {tuple(r["lags"]) for r in rows} == {tuple(f"{v}_mn_{w}" for v, w in lags)}
            assert len(rows) == len(one) - longest - lead + 1
            at = {(y, m): i for i, (y, m) in enumerate(zip(one["year"], one["month"]))}
            for r in rows:
                i = at[r["year"], r["month"]]
                assert r["x"] == pytest.approx([series[k][i] for k in lags]) and r["loss"] == pytest.approx(one["loss"][i])


def test_storage_by_lead_carries_each_months_model(spark):
    settings = {"trees": 20, "folds": 3, "repeats": 2, "block": 8}
    data = reservoirs(spark)
    got = plan.storage_by_lead(data, leads=(1, 2, 3), **settings).toPandas()
    again = plan.storage_by_lead(data.repartition(5), leads=(1, 2, 3), **settings).toPandas()
    order = ["basin", "start_year", "start_month", "lead"]
    got, again = (f.sort_values(order).reset_index(drop=True) for f in (got, again))
    assert not got.duplicated(order).any() and got[order].equals(again[order])
    np.testing.assert_allclose(got["stor"].astype(float), again["stor"].astype(float))
    months = features.backfilled_months(reservoir.unfilled_records(data)).toPandas()
    months["mean_loss"] = months.groupby(["basin", "month"])["loss"].transform("mean")
    at = {(r.basin, r.year * 12 + r.month - 1): r for r in months.itertuples()}
    told = {(r.basin, r.start_year * 12 + r.start_month - 1, r.lead): r for r in got.itertuples()}
    assert set(told) == {(b, n, k) for b, n in at for k in (1, 2, 3) if (b, n + k) in at}
    known = 0
    for (basin, start, lead), r in told.items():
        assert r.actual == pytest.approx(at[basin, start + lead].stor)
        into = out = 0.0
        for k in range(1, lead + 1):
            month, step = at[basin, start + k], told[basin, start, k]
            into += month.inflow
            out = min(out + month.mean_loss * (1 - step.r2) + step.r2 * step.model_loss, at[basin, start].stor + into)
        if np.isnan(out):
            assert np.isnan(r.stor)
        else:
            known += 1
            assert 0 <= r.r2 <= 1 and r.stor == pytest.approx(at[basin, start].stor + into - out)
    assert known > 60
    assert plan.storage_by_lead(data.limit(0), leads=(1, 2), **settings).collect() == []
