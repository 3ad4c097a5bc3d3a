import datetime as dt
import random

from pyspark.sql import functions as F

from slatework.operators import history

DAY = dt.date(2025, 4, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


def random_games(seed, entities=("a", "b", None), days=40, most=3):
    """Games with double-headers, one hot entity and one single-game entity."""
    random.seed(seed)
    rows, game = [], 0
    for entity in entities:
        for n in range(days):
            for _ in range(random.choice([0, 1, 1, most if entity == "a" else 1])):
                game += 1
                rows.append((entity, day(n), game, random.randint(0, 1), random.randint(0, 5)))
    rows.append(("single", day(5), game + 1, 1, 4))
    return rows


SCHEMA = "entity string, game_date date, game long, hr int, pa int"
OPTIONS = dict(entity=["entity"], date="game_date", game="game", flags={"hr": "hr"}, weight="pa", windows=(3, 5), lookback=4, strength=20.0)


def expected(rows, entity, date):
    past = sorted((r for r in rows if r[0] == entity and r[1] < date), key=lambda r: (r[1], r[2]))
    if not past:
        return None
    out = {"season": sum(r[3] for r in past) / len(past), "games": len(past), "days": (date - past[-1][1]).days}
    for n in (3, 5, 4):
        last = past[-n:]
        out[n] = (sum(r[3] for r in last) / len(last), len(last), sum(r[4] for r in last))
    rate, _, weight = out[4]
    out["shrunk"] = (rate * weight + out["season"] * 20) / (weight + 20)
    return out


def test_recent_form_equals_brute_force(spark):
    rows = random_games(1)
    frame = spark.createDataFrame(rows, SCHEMA)
    # Questions on dates without a game as well, and for an entity without history.
    asked = spark.createDataFrame([(r[0], r[1]) for r in rows] + [("a", day(60)), ("single", day(5)), ("nobody", day(9)), (None, day(70))], "entity string, game_date date")
    out = history.recent_form(asked, frame, **OPTIONS).collect()
    assert len(out) == asked.count()
    for row in out:
        want = expected(rows, row["entity"], row["game_date"])
        if want is None:
            assert row["recent_hr_rate_g3"] is None and row["season_games_prior"] is None and row["shrunk_recent_hr_rate"] is None
            continue
        assert abs(row["recent_hr_rate_g3"] - want[3][0]) < 1e-12
        assert row["recent_games_used_g5"] == want[5][1] and row["recent_weight_used_g5"] == want[5][2]
        assert abs(row["season_hr_rate_to_date"] - want["season"]) < 1e-12
        assert row["season_games_prior"] == want["games"] and row["days_since_last_game"] == want["days"]
        assert abs(row["shrunk_recent_hr_rate"] - want["shrunk"]) < 1e-12


def test_no_leakage(spark):
    rows = random_games(2)
    frame = spark.createDataFrame(rows, SCHEMA)
    cut = day(20)
    asked = spark.createDataFrame([("a", cut), ("b", cut)], "entity string, game_date date")
    full = history.recent_form(asked, frame, **OPTIONS).orderBy("entity").collect()
    before = history.recent_form(asked, frame.where(F.col("game_date") < F.lit(cut)), **OPTIONS).orderBy("entity").collect()
    assert full == before


def test_prior_days_window_edges(spark):
    rows = [("a", day(0), 1, 1, 10), ("a", day(30), 2, 1, 20), ("a", day(31), 3, 1, 40), ("a", day(31), 4, 1, 80)]
    frame = spark.createDataFrame(rows, SCHEMA)
    asked = spark.createDataFrame([("a", day(30)), ("a", day(31)), ("a", day(0)), ("z", day(3))], "entity string, game_date date")
    out = history.prior_days(
        asked, frame, keys=["entity"], date="game_date", days=30, parts={"pa": F.sum("pa"), "max_pa": F.max("pa")},
        result={"n": history.rows_seen(), "pa": F.col("pa"), "max_pa": F.col("max_pa")}, last={"last_pa": ("pa", "game")}, last_date="last_date",
    )
    got = {(r["entity"], r["game_date"]): (r["n"], r["pa"], r["max_pa"], r["last_pa"], r["last_date"]) for r in out.collect()}
    assert got[("a", day(30))] == (1, 10, 10, 10, day(0))
    assert got[("a", day(31))] == (1, 20, 20, 20, day(30))
    assert got[("a", day(0))] == (0, None, None, None, None)
    assert got[("z", day(3))] == (0, None, None, None, None)


def test_pair_history_null_keys_and_double_header(spark):
    rows = [("x", None, day(0), 1, 4, 1), ("x", None, day(0), 2, 3, 0), ("x", None, day(2), 3, 0, 0), ("x", "p", day(2), 3, 4, 2)]
    frame = spark.createDataFrame(rows, "b string, p string, d date, g long, pa long, hr long")
    base = dict(pair=["b", "p"], date="d", game="g", weight="pa", counts={"hr": "hr"}, suffix="vs")
    strict = {(r["p"], r["g"]): r for r in history.pair_history(frame, frame, **base).collect()}
    assert strict[(None, 2)]["prior_games_vs"] == 0 and strict[(None, 2)]["prior_hr_rate_vs"] is None
    assert strict[(None, 3)]["prior_games_vs"] == 2 and strict[(None, 3)]["prior_pa_vs"] == 7
    assert strict[(None, 3)]["last_hr_vs"] == 0 and strict[(None, 3)]["days_since_last_vs"] == 2
    ordered = {(r["p"], r["g"]): r for r in history.pair_history(frame, frame, same_day=True, **base).collect()}
    assert ordered[(None, 2)]["prior_games_vs"] == 1 and ordered[(None, 2)]["last_hr_vs"] == 1 and ordered[(None, 2)]["days_since_last_vs"] == 0
    assert ordered[("p", 3)]["prior_games_vs"] == 0


def test_asof_and_nearest_equal_brute_force(spark):
    random.seed(5)
    start = dt.datetime(2025, 4, 1)
    seconds = lambda: start + dt.timedelta(seconds=random.randint(0, 7200))
    probes = [(i, random.choice("aaab"), seconds()) for i in range(200)]
    seen = [(random.choice("aaab"), seconds(), i) for i in range(150)]
    p = spark.createDataFrame(probes, "id long, k string, at timestamp_ntz")
    o = spark.createDataFrame(seen, "k string, ts timestamp_ntz, v long")
    for strict in (True, False):
        got = {r["id"]: r["asof_ts"] for r in history.asof(p, o, keys=["k"], probe_time="at", time="ts", values=["v"], strict=strict, bucket_seconds=300).collect()}
        for i, k, at in probes:
            past = [t for kk, t, _ in seen if kk == k and (t < at or (t == at and not strict))]
            assert got[i] == (max(past) if past else None)
    close = {r["id"]: r["nearest_ts"] for r in history.nearest(p, o, keys=["k"], probe_time="at", time="ts", values=["v"], bucket_seconds=300).collect()}
    for i, k, at in probes:
        mine = sorted(t for kk, t, _ in seen if kk == k)
        assert close[i] == min(mine, key=lambda t: (abs((t - at).total_seconds()), t))


def test_last_location(spark):
    rows = [("A", day(0), "B"), ("A", day(1), "A"), ("A", day(1), "C"), ("A", day(3), "C"), ("B", day(0), "B"), ("B", day(0), "B")]
    out = history.last_location(spark.createDataFrame(rows, "t string, d date, l string"), team="t", date="d", location="l").collect()
    assert {(r["t"], r["d"]): (r["l"], r["previous_location"]) for r in out} == {
        ("A", day(0)): ("B", "A"), ("A", day(1)): ("C", "A"), ("A", day(3)): ("C", "C"), ("B", day(0)): ("B", "B"),
    }
