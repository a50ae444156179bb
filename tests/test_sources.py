import datetime as dt

import pytest
from pyspark.sql import functions as F

from freshet.operators import release
from freshet.plans import signatures
from freshet.sources import catalogs, climate, daily, sensors, sinks


def write(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text)
    return str(folder / name)


def test_catalog_keeps_zeros_quotes_and_nulls(spark, tmp_path):
    path = write(tmp_path, "sites.txt", 'STAID,STANAME,DRAIN_SQKM,STATE\n00123,"CREEK, UPPER",12.5,AK\n00456,RIVER,ND,\n')
    rows = {r["STAID"]: r for r in catalogs.read_gage_catalog(spark, path).collect()}
    assert rows["00123"]["STANAME"] == "CREEK, UPPER"
    assert rows["00456"]["DRAIN_SQKM"] is None and rows["00456"]["STATE"] is None
    typed = catalogs.read_gage_catalog(spark, path, "STAID string, STANAME string, DRAIN_SQKM double, STATE string")
    assert typed.filter("STAID = '00123'").first()["DRAIN_SQKM"] == 12.5


def test_reference_and_unregulated_gages(spark):
    classes = spark.createDataFrame([("01", "Alaska", "Ref"), ("02", "Alaska", "Non-ref"), ("03", "West", "Ref")], "STAID string, AGGECOREGION string, CLASS string")
    sites = spark.createDataFrame([("01", 5.0)], "STAID string, DRAIN_SQKM double")
    got = catalogs.reference_gages(classes, sites).collect()
    assert {(r["STAID"], r["DRAIN_SQKM"]) for r in got} == {("01", 5.0), ("03", None)}
    assert catalogs.reference_gages(classes, sites, region="Alaska").count() == 1
    stations = spark.createDataFrame([("a",), ("b",), ("c",)], "STATION_NUMBER string")
    rule = spark.createDataFrame([("a", True), ("b", False)], "STATION_NUMBER string, REGULATED boolean")
    assert [r[0] for r in catalogs.unregulated_gages(stations, rule).collect()] == ["b"]


def test_sensor_text(spark, tmp_path):
    path = write(tmp_path, "s.csv", "STATION_ID,DATE TIME,VALUE\nXYZ,20010102 0000,12.5\nXYZ,20010103 0000,---\nXYZ,bad,7\nXYZ,20010104 0000,-5\nXYZ,20010105 0000,\n")
    rows = sensors.read_sensor_csv(spark, path, with_station=True).collect()
    assert [(r["date"], r["value"]) for r in rows] == [
        (dt.date(2001, 1, 2), 12.5), (dt.date(2001, 1, 3), None), (None, 7.0), (dt.date(2001, 1, 4), -5.0), (dt.date(2001, 1, 5), None),
    ]
    assert rows[0]["STATION_ID"] == "XYZ"


def test_usgs_file(spark, tmp_path):
    path = write(tmp_path, "q.csv", "agency_cd,site_no,Date,value,qualifier\nUSGS,0001,2001-01-02,100,A\nUSGS,0001,2001-01-03,100,P e\nUSGS,0001,2001-01-04,100,A:<\nUSGS,0001,2001-01-01,100,A\n")
    gages = spark.createDataFrame([("0001", 10.0)], "gage_id string, area double")
    rows = daily.usgs_series(daily.read_usgs_daily(spark, path), gages, start="2001-01-01").orderBy("date").collect()
    assert [r["q"] for r in rows] == pytest.approx([100 * 86400 / (10 * 3280.84**3) * 1e6] * 2 + [None])
    assert rows[0]["doy"] == 2 and rows[0]["gage_id"] == "0001"


def test_hydat_file_and_unknown_area(spark, tmp_path):
    path = write(tmp_path, "h.csv", "STATION_NUMBER,Date,Parameter,Value,Symbol\n01A,2001-05-01,Flow,3,\n01A,2001-05-01,Level,9,\n02B,2001-05-01,Flow,2,\n")
    gages = spark.createDataFrame([("01A", 100.0), ("02B", None)], "gage_id string, area double")
    rows = {r["gage_id"]: r["q"] for r in daily.hydat_series(daily.read_hydat_daily(spark, path), gages, "2001-01-01").collect()}
    assert rows == pytest.approx({"01A": 3 * 86400 * 1e9 / (100 * 1e12), "02B": 2 * 99999})


def test_caravan_folder(spark, tmp_path):
    text = "units,time_offset,streamflow,total_precipitation_sum\ndays since 1980-01-01 00:00:00,{},1.5,4\ndays since 1980-01-01,{},2.5,\n"
    write(tmp_path / "c", "hysets_01A_x.csv", text.format(0, 366))
    write(tmp_path / "c", "hysets_77.csv", text.format(1, 5000))
    rows = daily.read_caravan(spark, str(tmp_path / "c"), "1980-01-01", "1981-12-31").orderBy("watershed_id", "date").collect()
    assert [(r["watershed_id"], r["date"], r["q"]) for r in rows] == [
        ("01A_x", dt.date(1980, 1, 1), 1.5), ("01A_x", dt.date(1981, 1, 1), 2.5), ("77", dt.date(1980, 1, 2), 1.5),
    ]
    assert {r["data_project"] for r in rows} == {"hysets"}


def test_climate_layouts(spark, tmp_path):
    raw = spark.createDataFrame([(1.0, 2.0, 1, 10, 31, 0.5), (1.0, 2.0, 9, 10, 31, 0.5)], "lon double, lat double, member int, lead_time int, init_time int, ppt double")
    raw.write.parquet(str(tmp_path / "grid"))
    got = climate.read_climate_grid(spark, str(tmp_path / "grid"), "seas5Multi", "1990-01-01", members=5).collect()
    assert [(r["init_date"], r["date"]) for r in got] == [(dt.date(1990, 2, 1), dt.date(1990, 2, 11))]
    hours = climate.normalise_grid(raw.withColumn("time", F.lit(48)), "era5", "1990-01-01", days_per_step=1 / 24).first()
    assert hours["date"] == dt.date(1990, 1, 3) and hours["init_date"] is None
    assert climate.normalise_grid(raw, "seas5", "1990-01-01").first()["date"] == dt.date(1990, 1, 11)
    with pytest.raises(ValueError):
        climate.normalise_grid(raw, "other", "1990-01-01")


def test_resume_and_sinks(spark, tmp_path):
    new = spark.createDataFrame([("01", "p"), ("02", "p"), ("02", "r")], "watershed_id string, data_project string")
    done = spark.createDataFrame([(2, "p")], "watershed_id int, data_project string").withColumn("watershed_id", F.format_string("%02d", "watershed_id"))
    left = sinks.not_done(new, done, ["watershed_id", "data_project"])
    assert {tuple(r) for r in left.collect()} == {("01", "p"), ("02", "r")}
    path = str(tmp_path / "out")
    sinks.append(left, path)
    sinks.append(sinks.not_done(new, spark.read.parquet(path), ["watershed_id", "data_project"]), path)
    assert spark.read.parquet(path).count() == 3
    filled = sinks.union_fill(left, left.withColumn("extra", F.lit(1)))
    assert filled.filter("extra is null").count() == 2
    product = spark.createDataFrame([("a", 1), ("b", 2)], "basin string, v int")
    sinks.write_forecast(product, str(tmp_path / "fc"), "csv")
    sinks.write_table(product, str(tmp_path / "t"))
    assert spark.read.option("header", True).csv(str(tmp_path / "fc")).filter("basin = 'b'").count() == 1


def test_release_model_learns_and_reloads(spark, tmp_path):
    rows = [
        ("a", dt.date(2001, 1, 1) + dt.timedelta(days=i), 100.0 + (i * 37) % 91, 10.0 + (i * 13) % 29, float(100 + (i * 37) % 91))
        for i in range(300)
    ]
    records = spark.createDataFrame(rows, "basin string, date date, stor double, inflow double, loss double")
    data = release.training_rows(records)
    train = data.filter("not is_validation")
    model, r2 = release.fit(train, trees=10, folds=2, repeats=2)
    assert r2 > 0.5
    quality = release.fit_quality(release.predict(model, data)).collect()
    assert {r["is_validation"] for r in quality} == {True, False} and all(r["r2"] > 0.7 for r in quality)
    release.save(model, str(tmp_path / "forest"))
    again = release.predict(release.load(str(tmp_path / "forest")), data.limit(5))
    assert again.select("prediction").count() == 5


def test_release_query_fits_each_basin_with_all_settings(spark, monkeypatch):
    from driver_queries import verification

    # Two basins of opposite rule: one pooled forest cannot follow both.
    rows = [
        (g, dt.date(2001, 1, 1) + dt.timedelta(days=i), s, 10.0, s if g else 400.0 - s)
        for g in (0, 1) for i in range(200) for s in [100.0 + (i * 37) % 91]
    ]
    records = spark.createDataFrame(rows, "gage_id int, date date, stor double, inflow double, loss double")
    asked, whole = [], release.fit_by_basin

    def fit(rows, keys, **settings):
        asked.append(settings)
        return whole(rows, keys, **{"trees": 20, "folds": 2, "repeats": 1, **settings})

    monkeypatch.setattr(release, "fit_by_basin", fit)
    monkeypatch.setattr(release, "raw_records", lambda *_: records)
    monkeypatch.setattr(verification, "reservoir", lambda *_: records)
    monkeypatch.setattr(verification.res, "loss_records", lambda *_: records)
    got = verification.QUERIES["l1_release_model"](spark, "").collect()
    assert asked == [{}]  # the defaults: all trees, folds, repeats and settings
    assert len(got) == 4 and all(r["r2"] > 0.7 for r in got)


def test_release_records_are_raw(spark):
    from freshet.functions.units import cfs_to_acft_day

    days = [dt.date(2001, 1, d) for d in range(1, 6)]
    stor, inflow = [100.0, None, 300.0, 250.0, 250.0], [10.0, 20.0, None, 40.0, 5.0]
    frame = spark.createDataFrame([("a", *r) for r in zip(days, stor, inflow)], "basin string, date date, stor double, inflow double")
    got = release.raw_records(frame).withColumn("unit", cfs_to_acft_day(F.lit(1.0))).orderBy("date").collect()
    u = got[0]["unit"]
    assert [r["stor"] for r in got] == [100.0, 200.0, 300.0, 250.0, 250.0]
    assert [r["inflow"] for r in got] == pytest.approx([10 * u, 20 * u, 30 * u, 40 * u, 5 * u])
    assert [r["loss"] for r in got][:4] == pytest.approx([0.0, 0.0, 50 + 30 * u, 40 * u]) and got[4]["loss"] is None


def test_signature_product_has_the_whole_contract(series):
    q = [5 + (i % 11) + (i % 7) / 10 for i in range(365 * 4)]
    out = signatures.gage_summary(series({("a", "2001-01-01"): q}), min_years=3)
    # id and three header columns, 320 trend columns, six of recession seasonality
    assert len(out.columns) == 4 + 326
    again = signatures.resume_summary(series({("a", "2001-01-01"): q, ("b", "2001-01-01"): q}), out.select("gage_id"), min_years=3, families=["volumes"])
    assert [r["gage_id"] for r in again.collect()] == ["b"]
    row = out.first()
    assert row["num_years"] == 4 and row["Qann_mean"] is not None and row["annual_runoff_ratio_slp"] is None
