import datetime as dt

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from slatework.plans.refresh import refresh_table
from slatework.sources import sinks, tables

DAYS = [dt.date(2025, 4, d) for d in (1, 2, 3)]


def test_snapshot_fallback_and_dates(spark, tmp_path):
    frame = spark.createDataFrame([("Aaron   Judge", "2025-04-01"), ("X", "bad")], "name string, d string")
    sinks.export(frame, str(tmp_path / "f"))
    out = tables.load_snapshot(spark, str(tmp_path / "none"), str(tmp_path / "f"), schema="name string, d string", date="d", clean="name")
    assert sorted((r["name"], r["d"]) for r in out.collect()) == [("Aaron Judge", DAYS[0]), ("X", None)]
    sinks.export(frame.limit(0), str(tmp_path / "empty"))
    with pytest.raises(AnalysisException):
        tables.load_snapshot(spark, str(tmp_path / "f"), str(tmp_path / "f"), schema="name strin, d string")
    assert tables.load_snapshot(spark, str(tmp_path / "empty"), str(tmp_path / "f"), schema="name string, d string").count() == 2


def test_write_snapshot_replaces(spark, tmp_path):
    path = str(tmp_path / "s")
    sinks.write_snapshot(spark.createDataFrame([(DAYS[0], 1)], "game_date date, v int"), path)
    sinks.write_snapshot(spark.createDataFrame([(DAYS[1], 2), (DAYS[2], 3)], "game_date date, v int"), path)
    assert sorted(r["v"] for r in spark.read.parquet(path).collect()) == [2, 3]


def test_upsert_insert_and_slices(spark):
    target = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, v string, o int")
    updates = spark.createDataFrame([(2, "old", 1), (2, "new", 2), (3, "c", 1)], "k int, v string, o int")
    assert {r["k"]: r["v"] for r in sinks.upsert(target, updates, keys=["k"], order=[F.col("o")]).collect()} == {1: "a", 2: "new", 3: "c"}
    added = sinks.insert_new(target, updates, keys=["k"], order=[F.col("o")])
    assert sorted((r["k"], r["v"]) for r in added.collect()) == [(1, "a"), (2, "b"), (3, "c")]
    replaced = sinks.replace_slice(target, spark.createDataFrame([(2, "x", 9), (2, "y", 9)], "k int, v string, o int"), slice_columns=["k"])
    assert sorted((r["k"], r["v"]) for r in replaced.collect()) == [(1, "a"), (2, "x"), (2, "y")]


def test_refresh_rewrites_touched_dates_only(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_snapshot(spark.createDataFrame([(DAYS[0], 1, "a", 0), (DAYS[1], 2, "b", 0)], "game_date date, k int, v string, o int"), path)
    refresh_table(spark, path, spark.createDataFrame([(DAYS[1], 2, "B", 1), (DAYS[2], 3, "c", 1)], "game_date date, k int, v string, o int"), keys=["game_date", "k"], order="o", partition="game_date")
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "B"), (3, "c")]


def test_refresh_moves_rows_to_their_new_date(spark, tmp_path):
    path, shape = str(tmp_path / "t"), "game_date date, k int, v string, o int"
    sinks.write_snapshot(spark.createDataFrame([(DAYS[0], 1, "a", 0), (DAYS[1], 2, "b", 0), (DAYS[1], 4, "d", 0)], shape), path)
    refresh_table(spark, path, spark.createDataFrame([(DAYS[1], 1, "A", 1), (DAYS[2], 2, "B", 1)], shape), keys=["k"], order="o", partition="game_date")
    spark.catalog.refreshByPath(path)
    rows = sorted((r["k"], r["v"], r["game_date"]) for r in spark.read.parquet(path).collect())
    assert rows == [(1, "A", DAYS[1]), (2, "B", DAYS[2]), (4, "d", DAYS[1])]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["t"] and not (tmp_path / "t" / f"game_date={DAYS[0]}").exists()


def test_upsert_ties_are_settled(spark):
    target = spark.createDataFrame([(1, "old", 0)], "k int, v string, o int")
    rows = [(1, "x", 5), (1, "y", 5), (2, "z", 5), (2, "z", 5)]
    results = {tuple(sorted(tuple(r) for r in sinks.upsert(target, spark.createDataFrame(part, "k int, v string, o int"), keys=["k"], order=order).collect()))
               for part in (rows, rows[::-1]) for order in ([F.col("o")], [])}
    assert len(results) == 1 and len(results.pop()) == 2


def test_weather_hours_with_missing_series(spark):
    payload = '{"hourly": {"time": ["2025-04-01T18:00", "2025-04-01T19:00"], "temperature_2m": [60.5, 61.0], "weather_code": [1]}}'
    out = tables.weather_hours(spark.createDataFrame([(1, payload), (2, None)], "id int, p string"), payload="p", keys=["id"]).collect()
    assert [(r["time"].hour, r["temperature_2m"], r["weather_code"], r["precipitation"]) for r in out] == [(18, 60.5, 1, None), (19, 61.0, None, None)]
