"""Game features from a store of dated player metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from slatework.functions.numeric import clip, col, linear, num, ratio
from slatework.operators.history import prior_days

HITTER_METRICS = ("barrel_rate", "ev95_plus", "sweet_spot_percent", "avg_hit_speed", "k_percent", "ab", "hr")
PITCHER_METRICS = ("hr_per_9", "k_percent", "era", "barrel_rate_allowed", "avg_hit_speed_allowed")


def temperature_factor(temp: Column | str) -> Column:
    return clip((col(temp) - num(50)) / num(30), 0, 1)


def wind_factor(wind: Column | str) -> Column:
    return F.when(col(wind) > 10, num(1.2)).when(col(wind) < -10, num(0.8)).otherwise(num(1))


def hitter_scores() -> dict[str, Column]:
    per_ab = F.coalesce(ratio("hr", "ab"), num(0))
    return {
        "hr_per_ab": per_ab,
        "power_score": linear({"barrel_rate": 0.4, "ev95_plus": 0.3, "avg_hit_speed": 0.002}) + per_ab * num(10),
        "contact_quality_score": linear({"sweet_spot_percent": 0.5, "avg_hit_speed": 0.002})
        + (num(100) - F.coalesce("pitcher_k_percent", num(0))) * num(0.3),
    }


def pitcher_scores() -> dict[str, Column]:
    return {
        "hr_vulnerability": linear(
            {"pitcher_hr_per_9": 0.4, "pitcher_barrel_rate_allowed": 0.3, "pitcher_avg_hit_speed_allowed": 0.002, "pitcher_era": 0.1}
        ),
        "k_probability_score": linear({"pitcher_k_percent": 0.7, "barrel_rate": -0.2, "ev95_plus": -0.1}),
    }


def latest_metrics(rows: DataFrame, metrics: DataFrame, *, player: str, date: str, pitchers: bool, columns: Sequence[str], prefix: str = "") -> DataFrame:
    """Latest metrics strictly before each row's date: an as-of join on (player, day)."""
    stats = metrics.where(F.col("is_pitcher") == F.lit(pitchers)).select(F.col("player_id").alias(player), F.col("stat_date").alias(date), *columns)
    return prior_days(
        rows, stats, keys=[player], date=date, parts={}, result={}, last={f"{prefix}{c}": (c, date) for c in columns}, last_date=f"{prefix}stat_date"
    )


def build_metric_features(games: DataFrame, metrics: DataFrame, *, home_runs: str = "home_hr_hitters", elite: Sequence[str] = (), park_factor: Column | None = None) -> DataFrame:
    """One row per (game, lineup hitter) with metric, matchup and context features, and a home-run label.

    ``games`` has game_id, game_date, home_team, lineup array<long>, pitcher_id, pitcher_name, weather_temp,
    weather_wind and an array of the players who homered.  Rows without metrics on either side are left out.
    """
    rows = games.select("*", F.explode("lineup").alias("player_id"))
    rows = latest_metrics(rows, metrics, player="player_id", date="game_date", pitchers=False, columns=HITTER_METRICS)
    rows = latest_metrics(rows, metrics, player="pitcher_id", date="game_date", pitchers=True, columns=PITCHER_METRICS, prefix="pitcher_")
    rows = rows.where("stat_date is not null and pitcher_stat_date is not null")
    factor = num(1) if park_factor is None else park_factor
    return rows.withColumns(
        hitter_scores() | pitcher_scores()
        | {
            "temperature_factor": temperature_factor(F.coalesce("weather_temp", num(70))),
            "wind_factor": wind_factor(F.coalesce("weather_wind", num(0))),
            "park_factor": factor,
            "is_elite_pitcher": F.coalesce(F.lower("pitcher_name").isin(*elite), F.lit(False)).cast("int"),
            "label": F.coalesce(F.array_contains(home_runs, F.col("player_id")), F.lit(False)).cast("int"),
        }
    )
