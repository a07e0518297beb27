"""Sources, sinks and the six raw layouts of the table builder."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from regimecast.functions import calendar as cal
from regimecast.operators import features
from regimecast.plans import etl
from regimecast.session import scratch_path
from regimecast.sources import tables
from tests.conftest import rows


def stamps(df):
    return df.orderBy(etl.TS).collect()


def test_country_load_prefers_then_falls_back(spark):
    data = [("31-12-2024 23:00", 1.0, "SE"), ("01/01/2025 00:00", 2.0, "DK"), ("02-01-2025 00:00", 3.0, "SE")]
    raw = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "i int, DateUTC string, Value double, CountryCode string")
    assert [r[etl.VALUE] for r in stamps(etl.country_load(raw))] == [2.0]
    other = etl.country_load(raw, preferred="NO", order="i")
    assert [(r[etl.TS], r[etl.VALUE]) for r in stamps(other)] == [
        (dt.datetime(2024, 12, 31, 23), 1.0), (dt.datetime(2025, 1, 2), 3.0),
    ]


def test_dated_hours_drops_missing_load(spark):
    raw = spark.createDataFrame([(dt.date(2020, 1, 1), 1, 5.0, 30.0), (dt.date(2020, 1, 1), 24, None, 31.0), (dt.date(2020, 1, 2), 3, 7.0, 32.0)], "Date date, Hour int, load double, T double")
    got = [tuple(r) for r in stamps(etl.dated_hours(raw))]
    assert got == [(dt.datetime(2020, 1, 1, 0), 5.0, 30.0), (dt.datetime(2020, 1, 2, 2), 7.0, 32.0)]


def test_plant_power_collapses_inverters(spark):
    raw = spark.createDataFrame([("15-05-2020 00:15", 1.0, 10.0, 4.0), ("15-05-2020 00:15", 2.0, 20.0, 6.0)], "DATE_TIME string, AC_POWER double, DC_POWER double, DAILY_YIELD double")
    row = etl.plant_power(raw).first()
    assert (row[etl.TS], row[etl.VALUE], row["dc_power"], row["daily_yield"]) == (dt.datetime(2020, 5, 15, 0, 15), 3.0, 30.0, 5.0)


def test_wind_vectors(spark):
    raw = spark.createDataFrame([("20120101 1:00".replace(" 1", " 01"), 0.5, 3.0, 4.0, 0.0, -2.0)], "TIMESTAMP string, TARGETVAR double, U10 double, V10 double, U100 double, V100 double")
    row = etl.wind_vectors(raw).first()
    assert row["wind_speed_10m"] == 5.0 and row["wind_speed_100m"] == 2.0
    assert row["wind_direction_10m"] == pytest.approx(53.13010235) and row["wind_direction_100m"] == pytest.approx(-90.0)
    assert len(row) == 10


def test_bearing_series_takes_the_short_way_round(spark):
    raw = spark.createDataFrame([(2020, 1, 1, h, 0, d) for h, d in enumerate((350.0, 10.0, 50.0))], ["Year", "Month", "Day", "Hour", "Minute", "wind direction at 100m (deg)"])
    got = [r[etl.VALUE] for r in stamps(etl.bearing_series(raw))]
    assert got == pytest.approx([0.0, 500.0, 1000.0], abs=1e-4)


def test_banded_series(spark):
    raw = spark.createDataFrame([("2024-06-01T00:30:00Z", 10.0, 8.0, 13.0)], "datetime_gmt string, generation_mw double, lcl_mw double, ucl_mw double")
    row = etl.banded_series(raw).first()
    assert row["generation_uncertainty"] == 5.0 and row[etl.TS] == dt.datetime(2024, 6, 1, 0, 30)


def test_processed_table_matches_pandas(spark):
    n = 200
    hours = pd.date_range("2024-01-01", periods=n, freq="h")
    values = [float((i * 37) % 101) for i in range(n)]
    raw = spark.createDataFrame([(t.to_pydatetime(), y) for t, y in zip(hours, values)], "timestamp timestamp, energy_generation double")
    raw = raw.withColumn("timestamp", cal.naive(F.col("timestamp")))
    got = etl.processed(raw).orderBy(etl.TS).toPandas()
    assert got.shape == (n - 168, 26)
    y = pd.Series(values)
    for k in features.TABLE_LAGS:
        assert got[f"energy_generation_lag_{k}"].tolist() == y.shift(k)[168:].tolist()
    for w in features.ROLLING_WINDOWS:
        assert got[f"energy_generation_rolling_mean_{w}"].tolist() == pytest.approx(y.rolling(w, min_periods=1).mean()[168:].tolist())
        assert got[f"energy_generation_rolling_std_{w}"].tolist() == pytest.approx(y.rolling(w, min_periods=1).std()[168:].tolist())
    assert got["day_of_week"].tolist() == hours.dayofweek[168:].tolist()


def test_sources_fail_alone_and_unite_by_kind(spark, views):
    as_base = lambda df: df.select(F.col("ts").alias(etl.TS), F.col("y").alias(etl.VALUE))
    sources = [
        etl.Source("daily", "load", lambda: as_base(views.daily_orders)),
        etl.Source("hourly", "load", lambda: as_base(views.hourly_all).withColumn("extra", F.lit(1))),
        etl.Source("absent", "wind", lambda: spark.read.parquet("/no/such/folder")),
    ]
    folder = scratch_path(spark, "etl")
    report = etl.run_sources(spark, sources, folder)
    status = {r["name"]: r for r in report.collect()}
    assert status["daily"]["ok"] and status["hourly"]["ok"] and not status["absent"]["ok"]
    assert "PATH_NOT_FOUND" in status["absent"]["error"]
    united = etl.unify(spark, report, folder)
    assert set(united) == {"load"}
    table = united["load"]
    assert table.count() == status["daily"]["total_rows"] + status["hourly"]["total_rows"]
    assert table.where("dataset_source = 'daily' AND extra IS NOT NULL").count() == 0


def test_preamble_is_skipped_in_every_file(spark):
    path = scratch_path(spark, "text")
    for name in ("a", "b"):
        lines = ["Source,ID 7", "t,v"] + [f"{i},{i / 2}" for i in range(50)] + [f"{50},"]
        spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode("append").text(path)
    out = tables.read_with_preamble(spark, path, "t int, v double")
    assert rows(out.where("v IS NOT NULL")) == sorted([(i, i / 2) for i in range(50)] * 2, key=repr)
    assert out.where("v IS NULL").count() == 2


def test_preamble_with_splittable_files(spark):
    path = scratch_path(spark, "split-text")
    lines = ["meta", "t,v"] + [f"{i},{i}.0" for i in range(2000)]
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        out = tables.read_with_preamble(spark, path, "t int, v double")
        assert out.agg(F.count("t"), F.sum("t")).first()[:] == (2000, sum(range(2000)))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_delimited_source_and_missing_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("when,load\n2024-01-01 00:00:00,1.5\n2024-01-01 01:00:00,2.5\n")
    out = tables.read_delimited(spark, str(tmp_path / "a.csv"), "when string, load double", "when", "load")
    assert [r["y"] for r in out.orderBy("ts").collect()] == [1.5, 2.5]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.read_delimited(spark, str(tmp_path / "none.csv"), "when string, load double", "when", "load")


def test_registry_checks(spark, views):
    registry = tables.Registry({"ok": views.hourly_gappy, "short": views.hourly_gappy.limit(5)}, ["ts", "y"])
    assert registry.load("ok").where("y IS NULL").count() == 0
    for bad, error in (("short", ValueError), ("none", KeyError)):
        with pytest.raises(error):
            registry.load(bad)
    with pytest.raises(ValueError):
        tables.Registry({"a": views.hourly_type}, ["missing"]).load("a")


def test_results_have_no_nan(spark):
    path = scratch_path(spark, "json")
    tables.write_results(spark.createDataFrame([("a", float("nan")), ("b", 1.0)], "m string, v double"), path)
    assert rows(spark.read.schema("m string, v double").json(path)) == [("a", None), ("b", 1.0)]


def test_unparsable_dates_become_null(spark):
    df = spark.createDataFrame([("31-12-2024 10:00",), ("2024-12-31",), ("soon",)], "d string")
    got = [r[0] for r in df.select(cal.parse_mixed("d")).collect()]
    assert got == [dt.datetime(2024, 12, 31, 10), dt.datetime(2024, 12, 31), None]
