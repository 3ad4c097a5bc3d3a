"""Labelled pick datasets and pick-level features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from slatework.functions import names, numeric
from slatework.functions.numeric import num, ratio_of_sums
from slatework.operators import aggregates, joins
from slatework.operators.ordering import top_rows

# Matchup types a batted-ball trend is kept for, and its rates.
MATCHUP_TYPES = ("vs_lhp", "vs_rhp")
TREND_RATES = ("ground_ball_rate", "fly_ball_rate", "line_drive_rate", "pull_rate", "opposite_rate")
SPIN_WEIGHTS = {"fastball_spin": 0.4, "breaking_spin": 0.4, "offspeed_spin": 0.2}


def matchup_score(category: Column, cutoff_columns: Mapping[str, Column], cutoff: float, neutral: float = 0.5) -> Column:
    """Neutral score, 0 where the category's own feature is above the cut-off."""
    chain = F
    for name, feature in cutoff_columns.items():
        chain = chain.when((category == name) & (feature > cutoff), num(0))
    return chain.otherwise(num(neutral))


def results_per_game(plays: DataFrame, results: Sequence[str], name: str = "hr_count") -> DataFrame:
    """Count of the given play results per game and normalized batter."""
    rows = plays.where(F.col("play_result").isin(*results))
    return rows.groupBy("game_id", F.lower(F.trim("batter")).alias("player_key")).agg(F.count(F.lit(1)).alias(name))


def results_lookup(plays: DataFrame, games: DataFrame, results: Sequence[str], name: str = "hr_count") -> DataFrame:
    """Results per date, team and surname, so that two players of one surname on different teams stay apart."""
    rows = plays.where(F.col("play_result").isin(*results)).join(games.select("game_id", "game_date", "home_team", "away_team"), "game_id")
    team = F.when(F.col("inning_half").ilike("Bottom%"), F.col("home_team")).otherwise(F.col("away_team"))
    return rows.groupBy("game_date", team.alias("team"), names.surname_key("batter").alias("surname")).agg(F.count(F.lit(1)).alias(name))


def pitcher_totals(box: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ratio-of-sums ERA, HR/9, K/9 and WHIP."""
    ip = "innings_pitched"
    return box.groupBy(*keys).agg(
        F.sum(ip).alias("total_ip"),
        ratio_of_sums("earned_runs", ip, 9).alias("pitcher_era"),
        ratio_of_sums("home_runs", ip, 9).alias("pitcher_hr_per_9"),
        ratio_of_sums("strikeouts", ip, 9).alias("pitcher_k_per_9"),
        ratio_of_sums(F.col("hits") + F.col("walks"), ip).alias("pitcher_whip"),
    )


def label_picks(picks: DataFrame, games: DataFrame, plays: DataFrame, box: DataFrame, *, by_description: bool = False, results: Sequence[str] = ("Home Run",)) -> DataFrame:
    """Picks with their game (same date), the outcome label and the opposing team's leading pitcher.

    The game is found by team on either side, or by the 'A @ B' text in either order.  Of two games of one
    pairing on a date the first is taken, so a pick is never repeated; it is taken before the join, so a pick never
    meets all games of its team on a date.
    """
    first = [F.col("game_id").asc_nulls_last()]
    schedule = games.select("game_id", F.col("game_date").alias("analysis_date"), "home_team", "away_team")
    if by_description:
        joined = joins.either_order_join(
            picks, schedule, left_pair=joins.split_matchup("game_description"), right_pair=("home_team", "away_team"), on=["analysis_date"], first=first
        )
    else:
        joined = joins.either_side_join(picks, schedule, team="team", home="home_team", away="away_team", on=["analysis_date"], first=first)
    joined = top_rows(joined, ["pick_id"], first)
    joined = joined.withColumn("player_key", F.lower(F.trim("player_name"))).join(results_per_game(plays, results), ["game_id", "player_key"], "left")
    leading = top_rows(pitcher_totals(box, ["game_id", "team", "player_name"]), ["game_id", "team"], [F.col("total_ip").desc(), F.col("player_name")])
    leading = leading.select("game_id", F.col("team").alias("__opponent"), F.col("player_name").alias("leading_pitcher"), "pitcher_era", "pitcher_hr_per_9", "pitcher_k_per_9", "pitcher_whip")
    opponent = F.when(F.col("team") == F.col("home_team"), F.col("away_team")).otherwise(F.col("home_team"))
    joined = joined.withColumn("__opponent", opponent).join(leading, ["game_id", "__opponent"], "left")
    return joined.withColumn("label", numeric.flag(F.col("hr_count") > 0)).drop("__opponent", "player_key")


def attach_pick_features(picks: DataFrame, *, pitcher_season: DataFrame, exit_velocity: DataFrame, batter_season: DataFrame, trends: DataFrame, minimum_events: int = 5) -> DataFrame:
    """Season features by 'Last, First' key (latest row of each), spin composite, batted-ball trends per matchup type."""
    keyed = picks.withColumns({"player_key": names.last_first("player_name"), "pitcher_key": names.last_first("pitcher_name")})
    spin = [c for c in SPIN_WEIGHTS if c in pitcher_season.columns]
    pitchers = pitcher_season.withColumnRenamed("last_name_first_name", "pitcher_key")
    if spin:
        pitchers = pitchers.withColumn("spin_composite", numeric.linear({c: SPIN_WEIGHTS[c] for c in spin}))
    speeds = exit_velocity.withColumnRenamed("last_name_first_name", "player_key")
    seasons = batter_season.withColumnRenamed("last_name_first_name", "player_key")
    out = joins.lookup_first(keyed, pitchers, on=["pitcher_key"], order=[F.col(pitchers.columns[1]).desc_nulls_last()])
    out = joins.lookup_first(out, speeds, on=["player_key"], order=[F.col("year").desc()])
    out = joins.lookup_first(out, seasons, on=["player_key"], order=[F.col("data_date").desc_nulls_last()])
    wide = aggregates.pivot_means(
        trends.where(F.col("batted_ball_events") > minimum_events).withColumn("player_key", names.last_first("player_name")),
        keys=["player_key"], category="matchup_type", values=MATCHUP_TYPES, measures=TREND_RATES,
    )
    return out.join(wide, "player_key", "left").drop("player_key", "pitcher_key")
