"""Stints and point-in-interval joins against a day-by-day replay."""

import random
from datetime import date, timedelta

from slatework.operators import registry, stints

DAY = date(2024, 1, 1)


def day(n):
    return DAY + timedelta(days=n)


def roster_on(snapshots, person, when):
    """Teams whose latest snapshot up to ``when`` lists the person."""
    out = set()
    for team in {t for _, t, _ in snapshots}:
        taken = [d for _, t, d in snapshots if t == team and d <= when]
        if taken and (person, team, max(taken)) in snapshots:
            out.add(team)
    return out


def moved_on(moves, person, when):
    taken = [(d, t) for p, t, d in moves if p == person and d <= when]
    return {max(taken)[1]} if taken else set()


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault((r["p"], r["d"]), set()).add(r["t"])
    return out


def test_rosters_and_moves_day_by_day(spark):
    rng = random.Random(5)
    people, teams = list("abcdef"), list("XYZ")
    snapshots = {(p, t, day(n)) for t in teams for n in rng.sample(range(400), 12) for p in people if rng.random() < 0.5}
    moves = {(rng.choice(people), rng.choice(teams), day(rng.randrange(400))) for _ in range(40)}
    asked = [(p, day(n)) for p in [*people, "nobody"] for n in range(0, 420, 3)]
    frame = lambda rows: spark.createDataFrame([*rows, *list(rows)[:5], (None, "X", DAY), ("a", None, DAY), ("a", "X", None)], "p string, t string, d date")
    days = spark.createDataFrame([*asked, *asked[:9], (None, DAY), ("a", None)], "p string, d date")
    names = {"person": "p", "team": "t", "date": "d"}
    for made, replay, rows in ((stints.roster_stints, roster_on, snapshots), (stints.move_stints, moved_on, moves)):
        got = found(stints.teams_on(days, made(frame(rows), **names), **names))
        want = {(p, d): teams for p, d in asked if (teams := replay(rows, p, d))}
        assert got == want


def test_equal_neighbours_are_one_stint(spark):
    rows = [("a", "X", day(0)), ("a", "X", day(10)), ("a", "Y", day(20)), ("a", "Y", day(20)), ("a", "X", day(30))]
    got = stints.move_stints(spark.createDataFrame(rows, "p string, t string, d date"), person="p", team="t", date="d").orderBy("starts").collect()
    assert [(r["t"], r["starts"], r["ends"]) for r in got] == [("X", day(0), day(20)), ("Y", day(20), day(30)), ("X", day(30), None)]


def test_no_rows(spark):
    none = spark.createDataFrame([], "p string, t string, d date")
    names = {"person": "p", "team": "t", "date": "d"}
    assert stints.teams_on(none, stints.roster_stints(none, **names), **names).count() == 0
    some = spark.createDataFrame([("a", "X", DAY)], "p string, t string, d date")
    assert stints.teams_on(none, stints.roster_stints(some, **names), **names).count() == 0


def test_history_counts_only_days_the_name_was_seen(spark):
    audit = spark.createDataFrame([("raw a", "A", "X|Y"), ("raw b", "B", None), ("raw c", "C", "Z")], "raw string, canonical_name string, observed_teams string")
    seen = spark.createDataFrame([("raw a", day(5)), ("raw a", day(5)), ("raw b", day(5)), ("raw c", day(40))], "raw string, d date")
    held = lambda rows: spark.createDataFrame(rows, "canonical_name string, team string, starts date, ends date")
    roster = held([("A", "Q", day(0), day(5)), ("A", "X", day(5), day(6)), ("C", "Z", day(0), day(40))])
    moves = held([("A", "R", day(6), None), ("C", "W", day(40), None)])
    got = {r["raw"]: tuple(r[c] for c in registry.HISTORY) for r in registry.with_team_history(audit, seen, roster=roster, moves=moves, raw="raw", date="d").collect()}
    assert got == {"raw a": ("X", None, "official_roster_match"), "raw b": (None, None, "no_observed_team"), "raw c": (None, "W", "official_history_mismatch")}
