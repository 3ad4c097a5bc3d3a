"""Daily refresh: reload the changed slices, rebuild features, retrain, publish."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from slatework.plans.hitters import HitterSources, build_hitter_features
from slatework.plans.models import Settings, Stack, feature_columns, fit_stack, holdout_metrics
from slatework.session import settle
from slatework.sources.sinks import overwrite_slices, remove_folder, upsert, write_snapshot


def refresh_table(spark: SparkSession, path: str, updates: DataFrame, *, keys: Sequence[str], order: str, partition: str) -> None:
    """Upsert rows into a date-partitioned table, rewriting only the dates the updates touch.

    A row whose key is updated under another date leaves its old date, so the old dates of all updated keys are
    rewritten too, and a date that loses its last row is removed.  The rewritten dates are staged next to the
    table first, because a table cannot be overwritten while it is being read; the stage is removed afterwards.
    Dates are replaced one after the other: a reader may see some of them renewed and others not yet.
    """
    table = spark.read.parquet(path)
    moved = table.join(updates.select(*keys).distinct(), list(keys), "left_semi").select(partition)
    touched = settle(updates.select(partition).union(moved).distinct())
    staged = f"{path.rstrip('/')}__staged-{uuid.uuid4().hex}"
    upsert(table.join(touched, partition, "left_semi"), updates, keys=keys, order=[F.col(order)]).write.parquet(staged)
    renewed = spark.read.parquet(staged)
    overwrite_slices(renewed, path, [partition])
    # As many as dates that an update emptied.
    for row in touched.join(renewed.select(partition).distinct(), partition, "left_anti").collect():
        remove_folder(spark, f"{path.rstrip('/')}/{partition}={row[0]}")
    remove_folder(spark, staged)


def rebuild_and_train(sources: HitterSources, *, snapshot: str, label: str = "label", target: str = "hr", settings: Settings = Settings(), lookback: int = 20) -> tuple[Stack, DataFrame]:
    """Write the feature snapshot, train on it, and return the stack with its hold-out metrics."""
    spark = sources.games.sparkSession
    write_snapshot(build_hitter_features(sources, lookback=lookback), snapshot)
    features = spark.read.parquet(snapshot)
    columns = feature_columns(features, label=label, target=target)
    stack, scored = fit_stack(features, features=columns, label=label, date="game_date", key=["game_id", "player_name"], settings=settings)
    return stack, holdout_metrics(scored, label)
