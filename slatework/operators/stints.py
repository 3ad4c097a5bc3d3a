"""Which team an entity belonged to on a day: stints from snapshots and moves, and the join of dates to stints.

A stint is (person, team, starts, ends), with ``ends`` the first day it no longer holds, NULL while it does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from slatework.operators.aggregates import joined_values


def roster_stints(snapshots: DataFrame, *, person: str, team: str, date: str) -> DataFrame:
    """Runs of a team's consecutive snapshots that list a person.

    A stint ends with the team's first snapshot that no longer lists the person.  Snapshots are numbered per team, so a
    person's numbers less their own count are constant over a run.  Windows hold calendar days, not rows.
    """
    listed = snapshots.select(person, team, date).dropna().distinct()
    order = Window.partitionBy(team).orderBy(date)
    days = listed.select(team, date).distinct().withColumns({"__n": F.row_number().over(order), "__next": F.lead(date).over(order)})
    own = Window.partitionBy(person, team).orderBy(date)
    runs = listed.join(days, [team, date]).withColumn("__run", F.col("__n") - F.row_number().over(own))
    return runs.groupBy(person, team, "__run").agg(
        F.min(date).alias("starts"), F.max(F.struct("__n", "__next"))["__next"].alias("ends")
    ).drop("__run")


def move_stints(moves: DataFrame, *, person: str, team: str, date: str) -> DataFrame:
    """From each move to another team until the next one.  Of several moves on a day the last team in order counts."""
    daily = moves.select(person, team, date).dropna().groupBy(person, date).agg(F.max(team).alias(team))
    own = Window.partitionBy(person).orderBy(date)
    changed = daily.where(F.col(team).isNotNull()).withColumn("__before", F.lag(team).over(own)).where(~F.col("__before").eqNullSafe(F.col(team)))
    return changed.select(person, team, F.col(date).alias("starts"), F.lead(date).over(own).alias("ends"))


def _held(days: DataFrame, stints: DataFrame, *, person: str, date: str) -> DataFrame:
    """``days`` (without NULL persons or dates) joined to the stints that hold on them.

    Stints are cut into the months they share with the asked days, and days meet them on (person, month): an equi join that
    a long stint enters once per month, not once per day or as a pair with every day.
    """
    span = days.agg(F.min(date).alias("first"), F.max(date).alias("last")).first()
    first, last = (F.lit(span[x]).cast("date") for x in ("first", "last"))
    begin, end = F.greatest("starts", first), F.least(F.date_sub(F.coalesce("ends", F.date_add(last, 1)), 1), last)
    cut = stints.where(begin <= end).withColumn("__month", F.explode(F.sequence(F.trunc(begin, "month"), F.trunc(end, "month"), F.expr("interval 1 month"))))
    held = days.withColumn("__month", F.trunc(date, "month")).join(cut, [person, "__month"])
    return held.where((F.col("starts") <= F.col(date)) & (F.col("ends").isNull() | (F.col(date) < F.col("ends"))))


def teams_on(asked: DataFrame, stints: DataFrame, *, person: str, team: str, date: str) -> DataFrame:
    """(person, date, team) for the stints that hold on each asked day."""
    return _held(asked.select(person, date).dropna().distinct(), stints, person=person, date=date).select(person, date, team).distinct()


def known_teams(seen: DataFrame, stints: DataFrame, *, key: str, person: str, team: str, date: str, name: str) -> DataFrame:
    """Per key: the distinct teams its person belonged to on the days the key was seen, as 'A|B'.

    The days carry their key into the join, so they are neither made distinct nor joined to again: a task folds its pairs of
    key and team up before they are shuffled.
    """
    days = seen.select(key, person, date).dropna(subset=[person, date])
    return joined_values(_held(days, stints, person=person, date=date), keys=[key], value=team, name=name)
