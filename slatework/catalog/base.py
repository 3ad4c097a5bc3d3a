"""Query registry and the driver-table analogues the queries run on.

An order stands for a game, a customer for a batter, a supplier for a pitcher, a line item for a play, a
nation for a team.  Every query reads whole tables.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where plain SQL can say the same, its oracle."""

    def register(run: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded for comparison (the engines add in different orders); -0.0 becomes 0.0."""
    return df.select(
        *[(F.round(c, places) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes]
    )


def plays(spark: SparkSession, folder: str) -> DataFrame:
    """Line items with their order's customer and date."""
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), "o_custkey", F.to_date("o_orderdate").alias("game_date")
    )
    return table(spark, folder, "lineitem").join(orders, "l_orderkey")


#: Line items of a task: what a task groups does not grow with the tables.
LINES_PER_TASK = 1 << 18


def line_parts(spark: SparkSession, folder: str) -> int:
    """Parts that the line items fill."""
    return max(math.ceil(table(spark, folder, "lineitem").count() / LINES_PER_TASK), 1)


def game_plays(spark: SparkSession, folder: str) -> DataFrame:
    """``plays`` dealt out by order, in as many parts as the line items fill.

    An order has few lines, so grouping by order (and anything beside it) needs no further shuffle, and a task's groups are
    bounded.
    """
    lines = table(spark, folder, "lineitem")
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), "o_custkey", F.to_date("o_orderdate").alias("game_date")
    )
    parts = line_parts(spark, folder)
    return lines.repartition(parts, "l_orderkey").join(orders.repartition(parts, "l_orderkey"), "l_orderkey")


def games(spark: SparkSession, folder: str) -> DataFrame:
    """One row per customer and order with counts of its lines."""
    from slatework.operators.aggregates import entity_games

    return entity_games(
        game_plays(spark, folder),
        keys=["o_custkey", "l_orderkey", "game_date"],
        counts={
            "hr_count": F.col("l_returnflag") == "R",
            "hit_count": F.col("l_returnflag").isin("R", "A"),
            "so_count": F.col("l_returnflag") == "N",
            "pa_count": F.col("l_quantity") > 2,
        },
    )


def form_games(spark: SparkSession, folder: str) -> DataFrame:
    """``games`` with 0/1 outcome flags."""
    return games(spark, folder).withColumns(
        {f"{s}_game": (F.col(f"{s}_count") > 0).cast("int") for s in ("hr", "hit", "so")}
    )


# The same frames for the oracles.
PLAYS_SQL = """plays AS (
  SELECT l.*, o.o_custkey, CAST(o.o_orderdate AS DATE) AS game_date
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)"""

GAMES_SQL = PLAYS_SQL + """, games AS (
  SELECT o_custkey, l_orderkey, game_date,
         count(*) FILTER (l_returnflag = 'R') AS hr_count,
         count(*) FILTER (l_returnflag IN ('R', 'A')) AS hit_count,
         count(*) FILTER (l_returnflag = 'N') AS so_count,
         count(*) FILTER (l_quantity > 2) AS pa_count
  FROM plays GROUP BY ALL)"""


def sorted_tokens_sql(text: str) -> str:
    return f"array_to_string(list_sort(string_split({text}, ' ')), ' ')"


def indel_sql(a: str, b: str) -> str:
    """100 x 2 x (longest common subsequence) / (both lengths) of two non-empty texts: one row of the usual table per character of ``a``."""
    matches = f"list_transform(string_split({a}, ''), lambda x: list_transform(string_split({b}, ''), lambda y: CASE WHEN x = y THEN 1 ELSE 0 END))"
    step = "lambda p, m: list_transform(range(1, len(m) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: CASE WHEN m[k] = 1 THEN coalesce(p[k - 1], 0) + 1 ELSE p[k] END)))"
    return f"(200e0 * list_reduce(list_prepend(list_transform(range(length({b})), lambda i: 0), {matches}), {step})[-1] / (length({a}) + length({b})))"
