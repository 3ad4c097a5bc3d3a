"""Starting-pitcher table: lineups paired with games, actual results, rollups, history, arsenal, opponent form, labels."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from slatework.functions import codes, names, numeric, text
from slatework.functions.numeric import num, ratio
from slatework.operators import aggregates, history, joins, registry
from slatework.operators.ordering import join_on, top_rows
from slatework.plans.hitters import HITS, HitterSources, arsenals, by_game, pitch_mix, prepared
from slatework.session import settle, stored

THRESHOLDS = (3, 4, 5, 6)


@dataclass(frozen=True)
class StarterSources:
    """The hitter sources plus season pitching metrics."""

    base: HitterSources
    pitcher_season: DataFrame


def starter_spine(s: StarterSources) -> DataFrame:
    """One row per side of every lineup paired with its game; double-headers pair in game order.

    Lineups without a game are dropped (``unmatched_lineups`` counts them).
    """
    paired = _paired_lineups(s).where("game_id is not null")
    away_is = {"home": ("home", "away"), "away": ("away", "home")}
    side = lambda me, other, flag: F.struct(
        F.col(f"{me}_team").alias("team"), F.col(f"{other}_team").alias("opponent_team"), F.col(f"{me}_name").alias("starter_name"),
        F.col(f"{me}_confirmed").alias("lineup_confirmed"), F.col(f"{me}_size").alias("opponent_lineup_size"), F.lit(flag).alias("is_home"),
    )
    rows = paired.select("game_date", "game_id", "lineup_game_id", F.inline(F.array(*[side(*away_is[k], k == "home") for k in away_is])))
    return rows.withColumn("starter_key", names.initial_key("starter_name"))


def _paired_lineups(s: StarterSources) -> DataFrame:
    """Lineups with the game they belong to.  Documents are read before the rows are put in order, which looks at every row twice."""
    told = {f"{side}_confirmed": text.lineup_confirmed(f"{side}_lineup") for side in ("home", "away")} | {f"{side}_size": F.size(text.batting_order(f"{side}_lineup")) for side in ("home", "away")}
    listed = s.base.lineups.where("home_pitcher is not null and away_pitcher is not null").select(
        "game_date", "home_team", "away_team", F.col("game_id").alias("lineup_game_id"), text.json_name("home_pitcher").alias("home_name"),
        text.json_name("away_pitcher").alias("away_name"), *[c.alias(n) for n, c in told.items()],
    )
    games = s.base.games.select("game_date", "home_team", "away_team", "game_id")
    return joins.sequence_join(settle(listed), games, on=["game_date", "home_team", "away_team"], left_order="lineup_game_id", right_order="game_id")


def unmatched_lineups(s: StarterSources) -> DataFrame:
    return _paired_lineups(s).where("game_id is null").agg(F.count(F.lit(1)).alias("unmatched"))


def _starter_order() -> list[Column]:
    return [F.col("innings_pitched").desc_nulls_last(), F.col("strikeouts").desc_nulls_last(), F.col("id")]


def actual_starters(s: StarterSources) -> DataFrame:
    """Most innings, then strikeouts, per game and team."""
    best = top_rows(s.base.pitching_box, ["game_id", "team"], _starter_order())
    return best.select(
        "game_id", "team", F.col("player_name").alias("actual_starter_name"), F.col("innings_pitched").alias("actual_innings_pitched"), F.col("strikeouts").alias("actual_strikeouts")
    )


def pitching_history(s: StarterSources) -> DataFrame:
    """Every appearance with date, opponent, starter flag, pitches thrown and batters faced.

    A game's few appearances tell its starters among themselves: rows are dealt out by game once and joined with none of their own.
    """
    listed = by_game(s.base, s.base.pitching_box).withColumn("__first", F.first("id").over(Window.partitionBy("game_id", "team").orderBy(*_starter_order())))
    listed = listed.withColumn("is_starter", F.coalesce(F.col("team").isNotNull() & (F.col("id") == F.col("__first")), F.lit(False))).drop("__first")
    box = listed.join(by_game(s.base, s.base.games.select("game_id", "game_date", "home_team", "away_team")), "game_id")
    box = box.withColumn("opponent_team", F.when(F.col("team") == F.col("home_team"), F.col("away_team")).otherwise(F.col("home_team"))).drop("home_team", "away_team")
    box = box.withColumns({"starter_key": names.initial_key("player_name"), "team": codes.team_code("team"), "opponent_team": codes.team_code("opponent_team")})
    parents = s.base.plays.where("pitcher is not null").select(F.col("id").alias("play_id"), "game_id", names.initial_key("pitcher").alias("starter_key"))
    load = aggregates.workload(parents, s.base.pitches, parent="play_id", keys=["game_id", "starter_key"])
    return box.join(load, ["game_id", "starter_key"], "left")


def attach_rolling(df: DataFrame, appearances: DataFrame, *, days: int = 30, starts_only: bool = False) -> DataFrame:
    """Appearances, means, ratio-of-sums rates and workload over the days before each start."""
    rows = appearances.where("is_starter") if starts_only else appearances
    sums = {"ip": "innings_pitched", "so": "strikeouts", "er": "earned_runs", "h": "hits", "bb": "walks", "pitches": "pitch_count", "faced": "batters_faced"}
    parts = {f"{k}_sum": F.sum(F.col(c).cast("double")) for k, c in sums.items()} | {f"{k}_n": F.count(c) for k, c in sums.items()} | {"max_pitches": F.max("pitch_count")}
    innings = F.col("ip_sum")
    per_inning = lambda top, scale: F.when(innings > 0, top / innings * num(scale))
    result = {
        "starter_starts_30d": history.rows_seen(),
        "starter_avg_ip_30d": ratio("ip_sum", "ip_n"),
        "starter_avg_so_30d": ratio("so_sum", "so_n"),
        "starter_k_per_9_30d": per_inning(F.col("so_sum"), 9),
        "starter_era_30d": per_inning(F.col("er_sum"), 9),
        "starter_whip_30d": per_inning(F.col("h_sum") + F.col("bb_sum"), 1),
        "starter_avg_pitches_30d": ratio("pitches_sum", "pitches_n"),
        "starter_max_pitches_30d": F.col("max_pitches").cast("double"),
        "starter_avg_batters_faced_30d": ratio("faced_sum", "faced_n"),
    }
    return history.prior_days(df, rows, keys=["starter_key"], date="game_date", days=days, parts=parts, result=result)


def attach_versus_opponent(df: DataFrame, appearances: DataFrame) -> DataFrame:
    """Earlier starts against the opponent, strictly before the date; 0 starts and NULLs when there are none."""
    keyed = df.withColumn("__opponent", codes.team_code("opponent_team"))
    rows = appearances.where("is_starter").withColumn("__opponent", F.col("opponent_team"))
    parts = {"ip": F.sum(F.col("innings_pitched").cast("double")), "so": F.sum(F.col("strikeouts").cast("double"))}
    parts |= {f"{k}_{f.__name__}": f(c) for k, c in (("pitches", "pitch_count"), ("faced", "batters_faced")) for f in (F.sum, F.count)}
    result = {
        "starter_prior_starts_vs_opp": history.rows_seen(),
        "starter_prior_ip_vs_opp": F.col("ip"),
        "starter_prior_so_vs_opp": F.col("so"),
        "starter_prior_k_per_9_vs_opp": F.when(F.col("ip") > 0, F.col("so") / F.col("ip") * num(9)),
        "starter_prior_avg_pitches_vs_opp": ratio("pitches_sum", "pitches_count"),
        "starter_prior_avg_batters_faced_vs_opp": ratio("faced_sum", "faced_count"),
    }
    out = history.prior_days(
        keyed, rows, keys=["starter_key", "__opponent"], date="game_date", parts=parts, result=result,
        last={"starter_last_so_vs_opp": ("strikeouts", "game_id")}, last_date="__last",
    )
    return out.withColumn("starter_days_since_last_vs_opp", history.days_since("game_date", "__last")).drop("__last", "__opponent")


def attach_season(df: DataFrame, s: StarterSources) -> DataFrame:
    season = s.pitcher_season.select(
        names.initial_key(names.first_last("last_name_first_name")).alias("starter_key"), F.col("last_name_first_name").alias("__raw"),
        *[F.col(c).alias(f"starter_{c}_season") for c in ("k_percent", "bb_percent", "whiff_percent")],
    )
    return joins.lookup_first(df, season, on=["starter_key"], order=[F.col("__raw")]).drop("__raw")


def attach_arsenal(df: DataFrame, s: StarterSources) -> DataFrame:
    """Starter's two main pitches and how the opposing team has fared against them."""
    metrics = ["whiff_percent", "k_percent", "put_away"]
    keyed = registry.with_canonical(df, s.base.canonical, raw="starter_name", name="pitcher_canonical").withColumn("__team", codes.team_code("team"))
    known = ["pitcher_canonical", "game_date"]
    meant = keyed.select(*known, F.col("__team").alias("team")).where("pitcher_canonical is not null")
    meant = meant.unionByName(meant.withColumn("team", F.lit(None).cast("string"))).distinct()
    # Read twice below: for the team and, where that has none, without one.
    profile = stored(aggregates.top_two(pitch_mix(arsenals(s.base), meant), entity=[*known, "team"], kind="pitch_type", usage="pitch_usage", metrics=metrics, few_kinds=True))
    fields = [c for c in profile.columns if c not in (*known, "team")]
    specific = profile.where("team is not null").withColumnRenamed("team", "__team")
    without_team = profile.where("team is null").drop("team")
    out = joins.priority_join(keyed, specific, without_team, on=[*known, "__team"], fallback_on=known, values=fields)

    team_record = aggregates.weighted_profile(
        s.base.hitter_arsenal.where("team is not null and pitch_type is not null").withColumn("__opponent", codes.team_code("team")),
        keys=["__opponent", "pitch_type"], weight="pa", metrics=metrics,
    )
    out = out.withColumn("__opponent", codes.team_code("opponent_team"))
    for side in ("primary", "secondary"):
        one = team_record.select("__opponent", F.col("pitch_type").alias(f"{side}_pitch_type"), *[F.col(m).alias(f"opp_team_{m}_vs_{side}_pitch") for m in metrics])
        out = out.join(one, ["__opponent", f"{side}_pitch_type"], "left")
    overall = {
        f"opp_team_{m}_vs_starter_arsenal": numeric.blend([(f"opp_team_{m}_vs_{side}_pitch", f"{side}_pitch_usage") for side in ("primary", "secondary")]) for m in metrics
    }
    return out.withColumns(overall).drop("__team", "__opponent", "pitcher_canonical")


def team_batting_days(s: StarterSources) -> DataFrame:
    """PA, strikeouts and hits per (date, batting team); a double-header is one day."""
    rows = s.base.plays.join(s.base.games.select("game_id", "game_date", "home_team", "away_team"), "game_id")
    batting = F.when(F.col("inning_half").ilike("Bottom%"), F.col("home_team")).otherwise(F.col("away_team"))
    result = F.col("play_result")
    return aggregates.entity_games(
        rows.withColumn("opponent_team", batting), keys=["game_date", "opponent_team"], counts={"pa": F.lit(True), "strikeouts": result == "Strikeout", "hits": result.isin(*HITS)}
    )


def attach_opponent_form(df: DataFrame, s: StarterSources, days: int = 14) -> DataFrame:
    parts = {c: F.sum(c) for c in ("pa", "strikeouts", "hits")}
    result = {
        "opp_team_games_14d": history.rows_seen(),
        "opp_team_pa_per_game_14d": ratio("pa", history.rows_seen()),
        "opp_team_k_rate_14d": ratio("strikeouts", "pa"),
        "opp_team_hits_per_pa_14d": ratio("hits", "pa"),
    }
    return history.prior_days(df, team_batting_days(s), keys=["opponent_team"], date="game_date", days=days, parts=parts, result=result)


def build_starter_features(s: StarterSources, *, thresholds: Sequence[int] = THRESHOLDS, starts_only: bool = False) -> DataFrame:
    """One row per starter and game, with every feature and the strikeout labels.

    The spine and the appearances are written once; each group of features is computed from them on its own, written, and
    joined by (game, lineup, side), so what a group shuffles does not lie on disk beside the others.
    """
    if s.base.canonical is None:
        s = replace(s, base=prepared(s.base))
    appearances = stored(pitching_history(s))
    base = stored(join_on(starter_spine(s), actual_starters(s), ["game_id", "team"], "left"))
    key = ["game_id", "lineup_game_id", "is_home"]
    # Season metrics are met by another key, so they come before the rows are wide.
    around = attach_season(base.select(*key, *[c for c in base.columns if c not in key]), s)
    parts = [attach_rolling(base, appearances, starts_only=starts_only), attach_versus_opponent(base, appearances), attach_arsenal(base, s), attach_opponent_form(base, s)]
    df = stored(around)
    for part in parts:
        df = df.join(stored(part.select(*key, *[c for c in part.columns if c not in df.columns])), key)
    own = [c for c in around.columns if c in base.columns]
    df = df.select(*own, *[c for c in df.columns if c not in around.columns], *[c for c in around.columns if c not in own])
    count = F.coalesce("actual_strikeouts", F.lit(0)).cast("int")
    return df.withColumn("actual_strikeouts", count).withColumns({f"label_so_{t}_plus": numeric.flag(F.col("actual_strikeouts") >= t) for t in thresholds})
