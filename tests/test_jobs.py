"""Composed jobs on fixtures: weather derivation, starter override, exact splits, drivers, absolute signals."""

import json
import random
from collections import Counter
from datetime import date, datetime

from pyspark.sql import functions as F

from slatework.catalog.domain import prepared_sources
from slatework.operators import splits
from slatework.plans import hitters, models, scoring
from slatework.plans.weather import derive_game_weather
from slatework.session import settle

FOLDER = "/root/testdata/sf0.001"
DAY = date(2024, 6, 1)


def document(**hours):
    return json.dumps({"hourly": {"time": [f"2024-06-01T{h}" for h in hours["time"]], **{k: v for k, v in hours.items() if k != "time"}}})


def test_weather_of_domes_missing_starts_ties_and_missing_hours(spark):
    games = spark.createDataFrame(
        [
            (1, DAY, datetime(2024, 6, 1, 23, 40), "NYY", "Park", None), (2, DAY, None, "NYY", "Park", "Open"), (3, DAY, None, "TB", "Dome", None), (4, DAY, datetime(2024, 6, 1, 20), "BOS", "Park", None),
            (5, DAY, None, "NOWHERE", "Park", None), (6, DAY, None, "SF", "Park", "retractable"), (7, DAY, datetime(2024, 6, 1, 20), "CHC", None, None),
        ],
        "game_id int, game_date date, start_utc timestamp, home_team string, venue string, roof_type string",
    )
    parks = spark.createDataFrame([(t, 1.0, 2.0, "America/New_York") for t in ("NYY", "NYY", "TB", "BOS", "SF", "CHC")], "team string, lat double, lon double, tz string")
    landed = spark.createDataFrame(
        [
            ("NYY", DAY, document(time=["18:00", "20:00", "21:00"], temperature_2m=[60.0, 80.0, 90.0], relative_humidity_2m=[50.0, None, 50.0], wind_speed_10m=[10.0], wind_direction_10m=[180.0])),
            ("TB", DAY, document(time=["19:00"], temperature_2m=[99.0])), ("BOS", DAY, document(time=[], temperature_2m=[])), ("CHC", DAY, "not json"),
        ],
        "team string, day date, payload string",
    )
    got = {r["game_id"]: r for r in derive_game_weather(games, parks, landed, domes=["Dome"]).collect()}
    assert set(got) == {1, 2, 3, 4, 6, 7}
    # 19:40 local asks for 19:00: 18:00 and 20:00 are equally near, the earlier entry counts.
    assert got[1]["local_game_time"] == datetime(2024, 6, 1, 19, 40) and got[1]["temp_f"] == 60.0 and got[1]["weather_source"] == "observed"
    assert got[1]["wind_out_factor"] == 1.1 and got[1]["dew_point_f"] is not None
    assert got[2]["local_game_time"] == datetime(2024, 6, 1, 19) and got[2]["observation_time"] == datetime(2024, 6, 1, 18)
    for dome in (3, 6):
        assert (got[dome]["temp_f"], got[dome]["wind_speed_mph"], got[dome]["weather_source"], got[dome]["weather_available"]) == (72.0, 0.0, "indoor", True)
        assert got[dome]["observation_time"] == got[dome]["local_game_time"] and got[dome]["dew_point_f"] is None
    for without in (4, 7):
        assert (got[without]["temp_f"], got[without]["weather_source"], got[without]["weather_available"], got[without]["wind_out_factor"]) == (None, "missing", False, 1.0)


def test_overridden_rows_equal_a_fresh_serving_build(spark):
    s = prepared_sources(spark, FOLDER)
    scheduled = hitters.load_spine(s).select("game_id", "game_date", "player_name", "team", "opp_team", "home_team", "pitcher_name")
    served = settle(hitters.enrich_for_serving(scheduled, s))
    pitchers = [r[0] for r in s.plays.select("pitcher").distinct().orderBy("pitcher").limit(2).collect()]
    teams = [r[0] for r in served.select("opp_team").distinct().orderBy("opp_team").limit(8).collect()]
    overrides = served.where(F.col("opp_team").isin(teams)).select("game_date", F.col("opp_team").alias("team"), F.lit(pitchers[0]).alias("pitcher_name")).distinct()
    overrides = overrides.union(overrides.withColumn("pitcher_name", F.lit(pitchers[1]))).union(overrides.withColumn("pitcher_name", F.lit(" ")))
    got = hitters.override_starters(served, overrides, s)
    changed = scheduled.withColumn("pitcher_name", F.when(F.col("opp_team").isin(teams), pitchers[0]).otherwise(F.col("pitcher_name")))
    fresh = hitters.enrich_for_serving(changed, s)
    rows = lambda df: Counter(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*sorted(served.columns)).collect())
    assert rows(got) == rows(fresh)
    assert got.where("starter_override_applied").count() == served.where(F.col("opp_team").isin(teams)).count() > 0


def test_splits_are_exact_per_class_and_stable(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([0, 0, 0, 1, None])) for i in range(3000)] + [(5000, 7)]
    df = spark.createDataFrame(rows, "k int, y int")
    sizes = Counter(y for _, y in rows)
    held = splits.stratified_split(df, label="y", key=["k"], share=0.3).collect()
    assert Counter(r["y"] for r in held if r["is_holdout"]) == Counter({y: int(n * 0.3 + 0.5) for y, n in sizes.items() if int(n * 0.3 + 0.5)})
    assert {(r["k"], r["is_holdout"]) for r in held} == {(r["k"], r["is_holdout"]) for r in splits.stratified_split(df.orderBy(F.desc("k")), label="y", key=["k"], share=0.3).collect()}
    for label in ("y", None):
        counts = {}
        for r in splits.hashed_folds(df, key=["k"], folds=7, label=label).collect():
            counts.setdefault(r["y"] if label else None, Counter())[r["fold"]] += 1
        for own in counts.values():
            full = [own.get(f, 0) for f in range(7)]
            assert max(full) - min(full) <= 1
    assert splits.hashed_folds(df.limit(0), key=["k"], folds=3).count() == 0 and splits.hashed_folds(df, key=["k"], folds=1).where("fold = 0").count() == 3001


def test_drivers_of_a_linear_model(spark):
    model = models.Linear(["a", "b", "c"], [1.0, -2.0, 0.5], -1.0, {"a": 1.0, "b": 0.0, "c": 4.0})
    rows = spark.createDataFrame([(1, 3.0, 1.0, None), (2, 1.0, 0.0, 4.0), (3, float("nan"), -1.0, 0.0)], "k int, a double, b double, c double")
    got = {(r["k"], r["direction"], r["rank"]): (r["feature"], r["impact"]) for r in models.drivers(rows, model, key=["k"]).collect()}
    assert got == {(1, "up", 1): ("a", 2.0), (1, "down", 1): ("b", -2.0), (3, "up", 1): ("b", 2.0), (3, "down", 1): ("c", -2.0)}
    base = model.base()
    assert base == 2.0
    scored = {r["k"]: r["proba"] for r in model.transform(rows).collect()}
    assert abs(scored[1] - 1 / (1 + 2.718281828459045 ** -2.0)) < 1e-9 and scored[1] == scored[2] == scored[3]


def test_absolute_signals_by_target(spark):
    rows = spark.createDataFrame([(i, t, i / 100 * w) for i in range(101) for t, w in (("hr", 0.2), ("so", 0.9), ("new", 0.5))], "k int, target string, p double")
    calibration = scoring.calibrate(rows.where("target <> 'new'"), probability="p")
    cuts = {r["target"]: r.asDict() for r in calibration.collect()}
    assert abs(cuts["hr"]["STRONG_BUY"] - 0.18) < 1e-9 and abs(cuts["so"]["AVOID"] - 0.225) < 1e-9
    parts = rows.withColumns({"slate": F.lit(DAY), "size": F.col("k").cast("double")})
    from slatework.operators.slate import Term

    ranked = scoring.score_slate(parts, slate_keys=["slate", "target"], probability="p", key=["k"], dedupe=["k"], components={"size": (1.0, [Term("size", 1.0)])}, drop_lowest=True, calibration=calibration)
    signals = Counter((r["target"], r["absolute_signal"]) for r in ranked.collect())
    assert signals[("hr", "STRONG_BUY")] == signals[("so", "STRONG_BUY")] == 11 and signals[("new", None)] == 101
    assert not any(s == "STRONG_SELL" for _, s in signals) and signals[("hr", "AVOID")] == 25


def test_incremental_rebuild_equals_a_full_one(spark):
    """Plays of a few games vanish, change or appear; only reached rows are built anew."""
    before = prepared_sources(spark, FOLDER)
    full = settle(hitters.build_hitter_features(before))
    dates = [r[0] for r in before.games.select("game_date").distinct().orderBy(F.desc("game_date")).limit(60).collect()]
    changed = [r[0] for r in before.games.where(F.col("game_date").isin(dates)).orderBy(F.xxhash64("game_id")).limit(6).select("game_id").collect()]
    picked = F.col("game_id").isin(changed)
    fate = F.pmod(F.xxhash64("id"), F.lit(3))
    plays = before.plays.where(~(picked & (fate == 0))).withColumn("play_result", F.when(picked & (fate == 1), "Home Run").otherwise(F.col("play_result")))
    box = before.pitching_box.withColumn("earned_runs", F.when(picked, F.col("earned_runs") + 3).otherwise(F.col("earned_runs")))
    from dataclasses import replace

    after = replace(before, plays=settle(plays), pitching_box=settle(box))
    games = spark.createDataFrame([(g,) for g in changed], before.games.select("game_id").schema)
    got = hitters.rebuild_changed(full, before, after, games)
    want = hitters.build_hitter_features(after)
    columns = sorted(full.columns)
    rows = lambda df: Counter(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect())
    wanted = rows(want)
    assert rows(got) == wanted and rows(full) != wanted
    spine = hitters._canonical_spine(after)
    assert 0 < hitters.reached_rows(spine, before, after, games).count() < spine.count()


def test_details_of_small_negatives_read_as_in_sql(spark):
    from slatework.catalog import ORACLES
    from slatework.plans import scoring
    from slatework.verify import duckdb

    values = [-0.04, -0.05, 0.0, 0.04, 1.25, -1.25, None]
    shown = scoring.details({"Balance": ("v", 1, 1.0)})[0]["value"]
    got = [r["t"] for r in spark.createDataFrame([(v,) for v in values], "v double").select(shown.alias("t")).collect()]
    assert got == ["-0.0", "-0.0", "0.0", "0.0", "1.2", "-1.2", "Unavailable"]
    con = duckdb.connect()
    con.execute("CREATE TABLE customer AS SELECT unnest(range(7)) AS c_custkey, 'X' AS c_mktsegment, unnest([-0.04, -0.05, 0.0, 0.04, 1.25, -1.25, NULL]::DOUBLE[]) AS c_acctbal")
    assert got == [r[1] for r in sorted(con.execute(ORACLES["m23_details"]).fetchall())]


def test_details_of_large_numbers_read_in_plain_digits_as_in_sql(spark):
    from slatework.catalog import ORACLES
    from slatework.plans import scoring
    from slatework.verify import duckdb

    values = [9999999.94, 9999999.96, 10000000.0, -12345678.25, 9e15, float("nan")]
    shown = scoring.details({"Balance": ("v", 1, 1.0), "Two": ("v", 2, 1.0)})
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(shown[0]["value"].alias("t"), shown[1]["value"].alias("two")).collect()
    got = [r["t"] for r in rows][:-1]
    assert got == ["9999999.9", "10000000.0", "10000000.0", "-12345678.2", "9000000000000000.0"]
    assert [r["two"] for r in rows][1:4] == ["9999999.96", "10000000.0", "-12345678.25"]
    con = duckdb.connect()
    con.execute("CREATE TABLE customer AS SELECT unnest(range(5)) AS c_custkey, 'X' AS c_mktsegment, unnest([9999999.94, 9999999.96, 10000000.0, -12345678.25, 9e15]::DOUBLE[]) AS c_acctbal")
    assert got == [r[1] for r in sorted(con.execute(ORACLES["m23_details"]).fetchall())]


def test_margin_adds_the_shifts_first(spark):
    """As the SQL does, so equal scores tie in both; beginning with the base rounds otherwise."""
    from slatework.plans import models

    model = models.Linear(["a", "b"], [0.2, 0.3], 0.1, {"a": 0.0, "b": 0.0})
    got = spark.createDataFrame([(1.0, 1.0)], "a double, b double").select(model.margin().alias("m")).first()["m"]
    assert got == 0.1 + (0.2 + 0.3) and got != 0.1 + 0.2 + 0.3
