"""Hitter feature table: spine -> season quality -> hands -> lineup -> form -> opposing pitching -> pitch mix -> history -> context."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from slatework.functions import codes, geo, names, numeric, text, weather
from slatework.functions.numeric import num, ratio
from slatework.operators import aggregates, history, joins, registry
from slatework.operators.ordering import join_on, top_rows
from slatework.session import stored

# Play results that count as hits.
HITS = ("Single", "Double", "Triple", "Home Run")

FORM_FLAGS = {"hr": "hr_game", "hit": "hit_game", "so": "so_game"}

# Factors of the interaction products, each with the value a missing factor takes.
INTERACTIONS = {
    "recent_hr_x_projected_pa": (("recent_hr_rate_lookback", 0.0), ("projected_pa", 4.2)),
    "recent_hit_x_projected_pa": (("recent_hit_rate_lookback", 0.0), ("projected_pa", 4.2)),
    "recent_hr_x_platoon_advantage": (("recent_hr_rate_lookback", 0.0), ("platoon_advantage", 0.0)),
    "recent_hit_x_platoon_advantage": (("recent_hit_rate_lookback", 0.0), ("platoon_advantage", 0.0)),
    "recent_hr_x_top_half_lineup": (("recent_hr_rate_lookback", 0.0), ("top_half_lineup", 0.0)),
    "recent_hit_x_top_half_lineup": (("recent_hit_rate_lookback", 0.0), ("top_half_lineup", 0.0)),
    "recent_hr_x_middle_lineup": (("recent_hr_rate_lookback", 0.0), ("middle_lineup", 0.0)),
    "recent_hit_x_middle_lineup": (("recent_hit_rate_lookback", 0.0), ("middle_lineup", 0.0)),
    "hr_delta_x_projected_pa": (("recent_vs_season_hr_delta", 0.0), ("projected_pa", 4.2)),
    "hit_delta_x_projected_pa": (("recent_vs_season_hit_delta", 0.0), ("projected_pa", 4.2)),
    "projected_pa_x_lineup_confirmed": (("projected_pa", 4.2), ("lineup_confirmed", 0.0)),
}
# The shrunk rate falls back to the recent rate before it falls back to 0.
SHRUNK_INTERACTIONS = ("projected_pa", "platoon_advantage")


@dataclass(frozen=True)
class HitterSources:
    """Input tables (see FIXTURES.md for their columns)."""

    games: DataFrame
    plays: DataFrame
    pitches: DataFrame
    pitching_box: DataFrame
    lineups: DataFrame
    players: DataFrame
    name_registry: DataFrame
    exit_velocity: DataFrame
    batter_season: DataFrame
    pitcher_arsenal: DataFrame
    hitter_arsenal: DataFrame
    game_weather: DataFrame
    parks: DataFrame
    canonical: DataFrame | None = None
    #: Parts that the event tables fill; the spine is built from games dealt out in so many.  ``dealt`` where the frames are so already.
    parts: int | None = None
    dealt: bool = False


def prepared(s: HitterSources, *, fuzzy: bool = True) -> HitterSources:
    """The sources with the canonical name of every name they contain, resolved in one pass."""
    flipped = [t.select(names.first_last("last_name_first_name").alias("n")) for t in (s.exit_velocity, s.batter_season, s.pitcher_arsenal, s.hitter_arsenal)]
    # Plays and lineups are read once: a row hands out all its names.
    listed = [F.coalesce(text.batting_order(f"{side}_lineup")["name"], F.array().cast("array<string>")) for side in ("home", "away")]
    starting = F.array(*[text.json_name(f"{side}_pitcher") for side in ("home", "away")])
    seen = [
        s.plays.select(F.explode(F.array(names.strip_action("batter"), F.col("pitcher"))).alias("n")), s.players.select(F.coalesce("full_name", "display_name").alias("n")),
        *flipped, s.lineups.select(F.explode(F.concat(*listed, starting)).alias("n")),
    ]
    return replace(s, canonical=registry.canonical_names([(df, "n") for df in seen], s.name_registry, fuzzy=fuzzy))


def batting_side(pitcher_team: Column, bottom_half: Column, home: Column, away: Column) -> tuple[Column, Column]:
    """(team, is_home) of the batter: the side that is not the pitcher's, else by half-inning."""
    bottom = F.coalesce(bottom_half, F.lit(False))
    team = F.when(pitcher_team == home, away).when(pitcher_team == away, home).when(bottom, home).otherwise(away)
    is_home = F.when(pitcher_team == away, True).when(pitcher_team == home, False).when(bottom, True).otherwise(False)
    return team, is_home


def products(pairs: Mapping[str, tuple[tuple[str, float], tuple[str, float]]]) -> dict[str, Column]:
    """Products of two columns, each with its own default for NULL."""
    read = lambda c: F.coalesce(F.col(c[0]).cast("double"), num(c[1]))
    return {name: read(a) * read(b) for name, (a, b) in pairs.items()}


def cleaned_plays(plays: DataFrame, games: DataFrame) -> DataFrame:
    """Plays with a result, joined to their game; the batter without trailing play text, unknown batters dropped."""
    rows = plays.where(F.col("play_result").isNotNull() & (F.trim(F.coalesce("batter", F.lit(""))) != ""))
    rows = rows.join(games.select("game_id", "game_date", "home_team", "away_team"), "game_id")
    rows = rows.withColumn("player_name", names.strip_action("batter"))
    return rows.where((F.col("player_name") != "") & (F.lower("player_name") != "unknown"))


def by_game(s: HitterSources, df: DataFrame) -> DataFrame:
    """Rows dealt out by game where the sources say in how many parts."""
    return df if s.parts is None or s.dealt else df.repartition(s.parts, "game_id")


def load_spine(s: HitterSources) -> DataFrame:
    """One row per (game, batter) with outcome labels, side and the pitcher faced most."""
    result = F.col("play_result")
    dealt = partial(by_game, s)
    by_pitcher = lambda df: df if s.parts is None else df.repartition(s.parts, "game_id", "pitcher_name")
    spine = aggregates.entity_games(
        cleaned_plays(dealt(s.plays), dealt(s.games)),
        keys=["game_id", "game_date", "home_team", "away_team", "player_name"],
        counts={
            "hr_count": result == "Home Run", "hit_count": result.isin(*HITS), "so_count": result == "Strikeout", "pa_count": result != "Other",
        },
        modes={"inning_half_mode": "inning_half", "pitcher_name": "pitcher"},
    ).where("pa_count >= 1")
    pitched = top_rows(
        dealt(s.pitching_box.select("game_id", F.col("player_name").alias("pitcher_name"), F.col("team").alias("__pteam"), "innings_pitched", "id")),
        ["game_id", "pitcher_name"], [F.coalesce("innings_pitched", num(0)).desc(), F.col("id")],
    ).select("game_id", "pitcher_name", "__pteam")
    spine = by_pitcher(spine).join(by_pitcher(pitched), ["game_id", "pitcher_name"], "left")
    team, is_home = batting_side(F.col("__pteam"), F.col("inning_half_mode").ilike("Bottom%"), F.col("home_team"), F.col("away_team"))
    spine = spine.withColumns({"team": team, "is_home": is_home})
    return spine.withColumns(
        {
            "opp_team": F.when(F.col("is_home"), F.col("away_team")).otherwise(F.col("home_team")),
            "label": numeric.flag(F.col("hr_count") > 0), "label_hit": numeric.flag(F.col("hit_count") > 0), "label_so": numeric.flag(F.col("so_count") > 0),
        }
    ).drop("__pteam", "inning_half_mode")


def attach_season_quality(df: DataFrame, s: HitterSources) -> DataFrame:
    """Exit velocity (latest year) and expected stats by canonical name."""
    numbers = {"avg_ev": "avg_hit_speed", "barrel_rate": "brl_percent", "sweet_spot_percent": "anglesweetspotpercent", "ev95_percent": "ev95percent"}
    speed = registry.with_canonical(
        s.exit_velocity.withColumn("__raw", names.first_last("last_name_first_name")), s.canonical, raw="__raw", name="batter_canonical"
    ).select("batter_canonical", "year", "__raw", *[numeric.percent_text(c).alias(n) for n, c in numbers.items()])
    expected = registry.with_canonical(
        s.batter_season.withColumn("__raw", names.first_last("last_name_first_name")), s.canonical, raw="__raw", name="batter_canonical"
    ).select("batter_canonical", "data_date", "__raw", "xwoba", "xba", "xslg")
    df = joins.lookup_first(df, speed, on=["batter_canonical"], order=[F.col("year").desc(), F.col("__raw")]).drop("year", "__raw")
    return joins.lookup_first(df, expected, on=["batter_canonical"], order=[F.col("data_date").desc_nulls_last(), F.col("__raw")]).drop("data_date", "__raw")


def attach_hands(df: DataFrame, s: HitterSources) -> DataFrame:
    people = s.players.withColumn("__full", F.coalesce("full_name", "display_name")).where("__full is not null")
    bats = registry.with_canonical(people, s.canonical, raw="__full", name="batter_canonical").select("batter_canonical", F.upper(F.trim("bats")).alias("__bats"), "player_id")
    throws = people.select(names.normalize_name("__full").alias("__pitcher_key"), F.upper(F.trim("throws")).alias("__throws"), "player_id").where(F.col("__throws").isin("L", "R"))
    df = joins.lookup_first(df, bats, on=["batter_canonical"], order=[F.col("player_id")]).drop("player_id")
    df = df.withColumn("__pitcher_key", names.normalize_name("pitcher_name"))
    df = joins.lookup_first(df, throws, on=["__pitcher_key"], order=[F.col("player_id")]).drop("player_id")
    return df.withColumns(codes.handedness("__bats", "__throws")).drop("__bats", "__throws", "__pitcher_key")


def lineup_slots(s: HitterSources) -> DataFrame:
    """One row per (date, team, canonical batter): confirmed flag, slot, slot flags and expected appearances."""
    both = F.array(*[F.struct(F.col(f"{side}_team").alias("team"), F.col(f"{side}_lineup").alias("lineup")) for side in ("home", "away")])
    teams = s.lineups.select("game_date", "game_id", F.inline(both))
    rows = teams.select("game_date", "game_id", codes.team_code("team").alias("team"), text.lineup_confirmed("lineup").cast("double").alias("lineup_confirmed"), F.inline(text.batting_order("lineup")))
    rows = registry.with_canonical(rows, s.canonical, raw="name", name="batter_canonical")
    one = top_rows(rows, ["game_date", "team", "batter_canonical"], [F.col("game_id"), F.col("slot")])
    return one.select("game_date", "team", "batter_canonical", "lineup_confirmed", F.col("slot").cast("double").alias("lineup_slot"), *[c.alias(n) for n, c in codes.slot_flags("slot").items()])


def attach_lineup(df: DataFrame, s: HitterSources) -> DataFrame:
    df = df.withColumn("team", codes.team_code("team"))
    return join_on(df, lineup_slots(s), ["game_date", "team", "batter_canonical"], "left")


def form_games(s: HitterSources) -> DataFrame:
    """Every batter's games with 0/1 outcomes and appearances, by canonical name.

    Plays are counted per game and raw name before names and dates are looked up; spellings of one batter are added up after.
    """
    result = F.col("play_result")
    rows = by_game(s, s.plays.where(F.col("batter").isNotNull()).select("game_id", "batter", "play_result")).withColumn("player_name", names.strip_action("batter")).where("player_name <> ''")
    games = rows.groupBy("game_id", "player_name").agg(
        F.max(numeric.flag(result == "Home Run")).alias("hr_game"),
        F.max(numeric.flag(result.isin(*HITS))).alias("hit_game"),
        F.max(numeric.flag(result == "Strikeout")).alias("so_game"),
        aggregates.count_if(result != "Other").alias("pa_game"),
    ).join(by_game(s, s.games.select("game_id", "game_date")), "game_id")
    games = registry.with_canonical(games, s.canonical, raw="player_name", name="batter_canonical")
    flags = [F.max(c).alias(c) for c in ("hr_game", "hit_game", "so_game")]
    return games.groupBy("batter_canonical", "game_date", "game_id").agg(*flags, F.sum("pa_game").alias("pa_game"))


def attach_form(df: DataFrame, s: HitterSources, lookback: int = 20) -> DataFrame:
    return history.recent_form(
        df, form_games(s), entity=["batter_canonical"], date="game_date", game="game_id", flags=FORM_FLAGS, weight="pa_game", lookback=lookback
    )


PITCHING = {"pitcher_era_30d": ("earned_runs", 9.0), "pitcher_hr_per_9_30d": ("home_runs", 9.0), "pitcher_k_per_9_30d": ("strikeouts", 9.0)}


def attach_opposing_pitching(df: DataFrame, s: HitterSources, *, by: str = "team", days: int = 30) -> DataFrame:
    """30-day means of per-appearance ratios of the opposing team (training) or pitcher (serving)."""
    key = "opp_team" if by == "team" else "pitcher_name"
    box = s.pitching_box.where("innings_pitched > 0").join(s.games.select("game_id", "game_date"), "game_id")
    ratios = {n: ratio(c, "innings_pitched") * num(scale) for n, (c, scale) in PITCHING.items()} | {"pitcher_whip_30d": ratio(F.col("hits") + F.col("walks"), "innings_pitched")}
    rows = box.select(F.col("team" if by == "team" else "player_name").alias(key), "game_date", *[c.alias(n) for n, c in ratios.items()])
    parts = {f"{n}_{f.__name__}": f(n) for n in ratios for f in (F.sum, F.count)}
    result = {n: ratio(f"{n}_sum", f"{n}_count") for n in ratios}
    return history.prior_days(df, rows, keys=[key], date="game_date", days=days, parts=parts, result=result)


MIX = ("pitch_usage", "whiff_percent", "k_percent", "put_away")


@dataclass(frozen=True)
class Arsenals:
    """Pitches counted per (pitcher, team, kind, day), and the undated published arsenals."""

    days: DataFrame
    listed: DataFrame


def arsenals(s: HitterSources) -> Arsenals:
    plays = s.plays.where("pitcher is not null").join(s.games.select("game_id", "game_date", "home_team", "away_team"), "game_id").select(
        F.col("id").alias("play_id"), "pitcher", "game_date", F.when(F.col("inning_half").like("Top%"), F.col("home_team")).otherwise(F.col("away_team")).alias("team"), "play_result"
    )
    plays = registry.with_canonical(plays, s.canonical, raw="pitcher", name="pitcher_canonical").withColumn("team", codes.team_code("team"))
    thrown = s.pitches.where("pitch_type is not null").select("play_id", "id", "pitch_number", codes.pitch_type("pitch_type").alias("pitch_type"), "result").join(plays, "play_id")
    days = aggregates.mix_counts(
        thrown, keys=["pitcher_canonical", "team", "pitch_type", "game_date"], parent="play_id", order=["pitch_number", "id"],
        miss=F.coalesce("result", F.lit("")).ilike("%swing%strike%"), finish=F.col("play_result") == "Strikeout",
    )
    listed = s.pitcher_arsenal.where("last_name_first_name is not null and pitch_type is not null").select(
        names.first_last("last_name_first_name").alias("__raw"), codes.team_code("team").alias("team"), "pitch_type", *MIX
    )
    return Arsenals(stored(days), stored(registry.with_canonical(listed, s.canonical, raw="__raw", name="pitcher_canonical")))


def pitch_mix(known: Arsenals, asked: DataFrame) -> DataFrame:
    """Arsenals as they were known before each asked (pitcher_canonical, game_date, team), as shares of the pitches.

    Only earlier days enter.  Published arsenals are undated; where one lists a pitch, it replaces the counted one.  An asked
    row meets the kinds its pitcher threw for that one team: a handful, however many teams and dates there are.
    """
    entity = ["pitcher_canonical", "game_date", "team"]
    asked = asked.select(*entity).distinct()
    kinds = known.days.select("pitcher_canonical", "team", "pitch_type").distinct()
    # The asked rows are what the answer consists of: nothing is joined back to them.
    counted = history.known_before(
        join_on(asked, kinds, ["pitcher_canonical", "team"]), known.days, keys=["pitcher_canonical", "team", "pitch_type"], date="game_date",
        parts={"n": F.sum("used"), "m": F.sum("missed"), "f": F.sum("finished")},
        result={"pitch_usage": F.col("n").cast("double"), "whiff_percent": ratio("m", "n"), "k_percent": ratio("f", "n"), "put_away": ratio("f", "n")},
    ).where("pitch_usage > 0").withColumns({"__source": F.lit(2), "__raw": F.col("pitcher_canonical")})
    listed = join_on(asked, known.listed, ["pitcher_canonical", "team"]).withColumn("__source", F.lit(1))
    # A handful of kinds per asked row: shares, the choice of a source and what callers group by entity need one shuffle.
    both = listed.unionByName(counted).repartition(*entity)
    shares = both.withColumn("__share", ratio("pitch_usage", F.sum("pitch_usage").over(Window.partitionBy(*entity, "__source"))))
    best = top_rows(shares, [*entity, "pitch_type"], [F.col("__source"), F.col("__raw")])
    return best.select(*entity, "pitch_type", F.col("__share").alias("pitch_usage"), "whiff_percent", "k_percent", "put_away")


def arsenal_team(known: Arsenals, asked: DataFrame) -> DataFrame:
    """(pitcher_canonical, game_date, opp_team) with ``team``: the asked team where the pitcher has an arsenal with it by
    then, else the first team in order that he has one with."""
    pitcher = ["pitcher_canonical"]
    asked = asked.select(*pitcher, "game_date", "opp_team").where("pitcher_canonical is not null and game_date is not null").distinct()
    since = known.days.groupBy(*pitcher, "team").agg(F.min("game_date").alias("game_date"))
    listed = known.listed.groupBy(*pitcher, "team").agg(F.sum("pitch_usage").alias("u")).where("u <> 0")
    out = history.known_before(asked, since, keys=pitcher, date="game_date", parts={"min_team": F.min("team")}, result={"__counted": F.col("min_team")})
    always = listed.groupBy(*pitcher).agg(F.min("team").alias("__listed"))
    out = out.join(always, pitcher, "left")
    out = out.join(since.select(*pitcher, F.col("team").alias("opp_team"), F.col("game_date").alias("__since")), [*pitcher, "opp_team"], "left")
    out = out.join(listed.select(*pitcher, F.col("team").alias("opp_team"), F.lit(True).alias("__is_listed")), [*pitcher, "opp_team"], "left")
    own = F.coalesce(F.col("__since") < F.col("game_date"), F.lit(False)) | F.coalesce("__is_listed", F.lit(False))
    return out.select(*pitcher, "game_date", "opp_team", F.when(own, F.col("opp_team")).otherwise(F.least("__counted", "__listed")).alias("team"))


def attach_pitch_matchup(df: DataFrame, s: HitterSources) -> DataFrame:
    """Pitcher's two main pitches (by name and team, else by name), and the batter's record against them."""
    metrics = ["whiff_percent", "k_percent"]
    df = registry.with_canonical(df, s.canonical, raw="pitcher_name", name="pitcher_canonical").withColumn("opp_team", codes.team_code("opp_team"))
    known = arsenals(s)
    entity = ["pitcher_canonical", "game_date", "team"]
    meant = stored(arsenal_team(known, df))
    profile = aggregates.top_two(pitch_mix(known, meant), entity=entity, kind="pitch_type", usage="pitch_usage", metrics=metrics, few_kinds=True)
    profile = stored(join_on(meant, profile, entity).drop("team"))
    df = join_on(df, profile, ["pitcher_canonical", "game_date", "opp_team"], "left")

    record = ["whiff_percent", "k_percent", "ba", "slg", "woba"]
    batters = registry.with_canonical(
        s.hitter_arsenal.where("last_name_first_name is not null and pitch_type is not null").withColumn("__raw", names.first_last("last_name_first_name")),
        s.canonical, raw="__raw", name="batter_canonical",
    )
    versus = aggregates.weighted_profile(batters, keys=["batter_canonical", "pitch_type"], weight="pa", metrics=record)
    for side in ("primary", "secondary"):
        one = versus.select("batter_canonical", F.col("pitch_type").alias(f"{side}_pitch_type"), *[F.col(m).alias(f"batter_{m}_vs_{side}_pitch") for m in record])
        df = df.join(one, ["batter_canonical", f"{side}_pitch_type"], "left")
    overall = {
        f"batter_{m}_vs_pitcher_arsenal": numeric.blend([(f"batter_{m}_vs_{side}_pitch", f"{side}_pitch_usage") for side in ("primary", "secondary")])
        for m in ("k_percent", "whiff_percent", "woba")
    }
    return df.withColumns(overall).drop("pitcher_canonical")


def attach_pitcher_history(df: DataFrame, *, same_day: bool = False) -> DataFrame:
    return history.pair_history(
        df, df, pair=["batter_canonical", "pitcher_name"], date="game_date", game="game_id", weight="pa_count",
        counts={"hit": "hit_count", "hr": "hr_count", "so": "so_count"}, same_day=same_day, suffix="vs_pitcher",
    )


def attach_park(df: DataFrame, s: HitterSources, constants: Mapping[str, float]) -> DataFrame:
    """Park factor of the home team's park."""
    table = s.parks.select(codes.team_code("team").alias("__home"), "park_factor")
    keyed = df.withColumn("__home", codes.team_code("home_team"))
    return registry.factor_or_default(keyed, table, key="__home", factor="park_factor", constants=dict(constants)).drop("__home")


def attach_travel(df: DataFrame, s: HitterSources) -> DataFrame:
    """Distance and zones since the team's previous stop, and the fatigue score; zero where a location is unknown."""
    sides = joins.sides(s.games.select("game_id", "game_date", "home_team", "away_team"), home="home_team", away="away_team")
    stops = sides.select(codes.team_code("team").alias("team"), "game_date", codes.team_code("home_team").alias("location"))
    moved = history.last_location(stops, team="team", date="game_date", location="location")
    parks = s.parks.select(codes.team_code("team").alias("location"), "lat", "lon", "tz")
    before = parks.select(F.col("location").alias("previous_location"), *[F.col(c).alias(f"from_{c}") for c in ("lat", "lon", "tz")])
    moved = moved.join(parks, "location", "left").join(before, "previous_location", "left")
    known = F.col("lat").isNotNull() & F.col("from_lat").isNotNull()
    moved = moved.select(
        "team", "game_date",
        F.when(known, geo.haversine_miles("from_lat", "from_lon", "lat", "lon")).otherwise(num(0)).alias("travel_distance_miles"),
        F.when(known, geo.zone_changes("tz", "from_tz")).otherwise(0).alias("timezone_changes"),
    )
    df = join_on(df, moved, ["team", "game_date"], "left").withColumns(numeric.with_defaults({"travel_distance_miles": 0.0, "timezone_changes": 0}))
    return df.withColumn("travel_fatigue_score", geo.travel_fatigue("travel_distance_miles", "timezone_changes"))


def attach_weather(df: DataFrame, s: HitterSources) -> DataFrame:
    fields = [*weather.WEATHER_DEFAULTS, "roof_status_estimated", "weather_available"]
    joined = df.join(s.game_weather.select("game_id", *fields), "game_id", "left").withColumns(numeric.with_defaults(weather.WEATHER_DEFAULTS))
    closed = F.lower(F.coalesce("roof_status_estimated", F.lit(""))) == "closed"
    joined = joined.withColumns(
        {"roof_closed_estimated": numeric.flag_double(closed), "weather_data_available": F.coalesce(F.col("weather_available").cast("double"), num(0))}
    ).drop("roof_status_estimated", "weather_available")
    return joined.withColumns(weather.pull_side_wind())


def attach_interactions(df: DataFrame) -> DataFrame:
    made = products(INTERACTIONS)
    for stem in ("hr", "hit"):
        rate = F.coalesce(f"shrunk_recent_{stem}_rate", f"recent_{stem}_rate_lookback", num(0))
        for other in SHRUNK_INTERACTIONS:
            made[f"shrunk_recent_{stem}_x_{other}"] = rate * F.coalesce(F.col(other), num(4.2 if other == "projected_pa" else 0.0))
    return df.withColumns(made)


# Park factors used while the park table is too small.
PARK_FACTORS = {
    "ARI": 1.05, "ATL": 1.00, "BAL": 1.05, "BOS": 1.15, "CHC": 1.00, "CIN": 1.15, "CLE": 0.95, "COL": 1.35, "DET": 0.95,
    "HOU": 1.10, "KC": 0.95, "LAD": 1.00, "MIA": 0.90, "MIL": 1.00, "MIN": 0.95, "NYY": 1.20, "OAK": 0.90, "PHI": 1.10,
    "PIT": 0.90, "SD": 1.00, "SEA": 0.90, "SF": 0.90, "TB": 0.90, "TEX": 1.05, "WSH": 1.00,
}


def composite_features(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "adjusted_power": F.coalesce("xslg", num(0)) * F.coalesce("park_factor", num(1)),
            "pitcher_hr_vulnerability": numeric.row_mean("pitcher_hr_per_9_30d", "pitcher_era_30d"),
        }
    )


KEY = ("game_id", "player_name")


def _joined(base: DataFrame, parts: Sequence[DataFrame]) -> DataFrame:
    """Base rows with the new columns of each part, all keyed by game and player.

    Each part reads the written base, not the frame built so far, so the plan grows with the number of
    parts rather than doubling at every step that looks its own rows up again.  A part is written before the next is built: what
    it shuffles does not lie on disk beside what the others do.
    """
    out = base
    for part in parts:
        new = [c for c in part.columns if c not in out.columns]
        out = out.join(stored(part.select(*KEY, *new)), list(KEY))
    return out


def build_hitter_features(s: HitterSources, *, lookback: int = 20, park_constants: Mapping[str, float] = PARK_FACTORS) -> DataFrame:
    """Training table: one row per (game, batter)."""
    s = s if s.canonical is not None else prepared(s)
    base = stored(registry.with_canonical(load_spine(s), s.canonical, raw="player_name", name="batter_canonical"))
    parts = [attach_form(base, s, lookback), attach_opposing_pitching(base, s), attach_pitch_matchup(base, s), attach_pitcher_history(base)]
    return _assembled(base, parts, s, park_constants)


def _canonical_spine(s: HitterSources) -> DataFrame:
    return registry.with_canonical(load_spine(s), s.canonical, raw="player_name", name="batter_canonical")


def reached_rows(spine: DataFrame, before: HitterSources, after: HitterSources, changed: DataFrame, *, days: int = 30) -> DataFrame:
    """(game_id, player_name) of the rows whose features can differ after the events of the ``changed`` games (game_id) did.

    Those are the games' own rows, all later rows of their batters and pitchers, rows within ``days`` days against their teams,
    and each team's next game.  Every condition is an equi join with a table as small as the change.
    """
    rows, thrown, stops = [], [], []
    for s in (before, after):
        games = s.games.join(changed, "game_id", "left_semi")
        plays = s.plays.join(games.select("game_id", "game_date"), "game_id")
        rows.append(registry.with_canonical(plays.select(names.strip_action("batter").alias("player_name"), "game_date"), s.canonical, raw="player_name", name="batter_canonical"))
        thrown.append(registry.with_canonical(plays.select("pitcher", "game_date"), s.canonical, raw="pitcher", name="pitcher_canonical"))
        stops.append(joins.sides(games.select("game_id", "game_date", "home_team", "away_team"), home="home_team", away="away_team").select("team", "game_date"))
    both = lambda pair: pair[0].unionByName(pair[1])
    since = lambda df, key: df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("game_date").alias("__since"))
    teams = stored(both(stops).distinct())
    windows = teams.select(F.col("team").alias("opp_team"), F.explode(F.sequence(F.date_add("game_date", 1), F.date_add("game_date", days))).alias("game_date")).distinct()
    schedule = both([joins.sides(s.games.select("game_id", "game_date", "home_team", "away_team"), home="home_team", away="away_team").select("team", "game_date") for s in (before, after)]).distinct()
    following = schedule.withColumn("__next", F.lead("game_date").over(Window.partitionBy("team").orderBy("game_date")))
    following = teams.join(following, ["team", "game_date"]).select("team", F.col("__next").alias("game_date")).where("game_date is not null").distinct()

    keyed = registry.with_canonical(spine, after.canonical, raw="pitcher_name", name="pitcher_canonical")
    later = lambda df, firsts, key: df.join(firsts, key).where(F.col("game_date") > F.col("__since"))
    reached = [
        keyed.join(changed, "game_id", "left_semi"), later(keyed, since(both(rows), "batter_canonical"), "batter_canonical"), later(keyed, since(both(thrown), "pitcher_canonical"), "pitcher_canonical"),
        keyed.join(windows, ["opp_team", "game_date"], "left_semi"), keyed.join(following, ["team", "game_date"], "left_semi"),
    ]
    return reduce(DataFrame.unionByName, [r.select(*KEY) for r in reached]).distinct()


def rebuild_changed(features: DataFrame, before: HitterSources, after: HitterSources, changed: DataFrame, *, lookback: int = 20, park_constants: Mapping[str, float] = PARK_FACTORS) -> DataFrame:
    """The training table after the events of some games changed: rows the change reaches built anew, all others as they were.

    ``features`` is the table of ``before``; both sources hold resolved names.  Rosters, season and weather tables are taken
    to be the same.
    """
    changed = stored(changed.select("game_id").distinct())
    spine = stored(_canonical_spine(after))
    reached = stored(reached_rows(spine, before, after, changed))
    base = stored(spine.join(reached, list(KEY), "left_semi"))
    met = history.pair_history(
        base, spine, pair=["batter_canonical", "pitcher_name"], date="game_date", game="game_id", weight="pa_count", counts=PAIR_COUNTS, suffix="vs_pitcher"
    )
    parts = [attach_form(base, after, lookback), attach_opposing_pitching(base, after), attach_pitch_matchup(base, after), met]
    anew = _assembled(base, parts, after, park_constants)
    kept = features.join(changed, "game_id", "left_anti").join(reached, list(KEY), "left_anti")
    return kept.unionByName(anew.select(*features.columns))


def _assembled(base: DataFrame, parts: Sequence[DataFrame], s: HitterSources, park_constants: Mapping[str, float]) -> DataFrame:
    """Base rows with their context, the columns of all parts, and what follows from both.

    The context is joined to the narrow base, by half a dozen keys, before the parts make rows wide; then all meet by one key.
    """
    keyed = base.select(*KEY, *[c for c in base.columns if c not in KEY])
    around = _with_context(keyed, s, park_constants)
    out = _joined(stored(around), parts)
    own = [c for c in around.columns if c in base.columns]
    added = [c for c in out.columns if c not in around.columns]
    return composite_features(attach_interactions(out.select(*own, *added, *[c for c in around.columns if c not in own])))


def _with_context(df: DataFrame, s: HitterSources, park_constants: Mapping[str, float]) -> DataFrame:
    """Steps that only join dimension-like tables onto the rows."""
    df = attach_lineup(attach_hands(attach_season_quality(df, s), s), s)
    return attach_weather(attach_travel(attach_park(df, s, park_constants), s), s)


PAIR_COUNTS = {"hit": "hit_count", "hr": "hr_count", "so": "so_count"}


def override_starters(served: DataFrame, overrides: DataFrame, s: HitterSources) -> DataFrame:
    """What-if: rows facing another pitcher than announced, with everything that depends on the pitcher asked anew.

    ``served`` comes from ``enrich_for_serving``; ``overrides`` holds game_date, team (the pitcher's) and pitcher_name, the first
    name in order where a team has several.  Only swapped rows ask the 30-day rollups, the arsenal, hands and the pair history
    again; what does not depend on the pitcher is kept, and all other rows pass by.
    """
    s = s if s.canonical is not None else prepared(s)
    named = overrides.select("game_date", codes.team_code("team").alias("__opp"), F.nullif(F.trim("pitcher_name"), F.lit("")).alias("__new")).where("__new is not null")
    new = top_rows(named, ["game_date", "__opp"], [F.col("__new")])
    marked = join_on(served.withColumn("__opp", codes.team_code("opp_team")), new, ["game_date", "__opp"], "left").drop("__opp")
    swap = F.col("__new").isNotNull() & ~F.col("__new").eqNullSafe(F.col("pitcher_name"))
    kept = marked.where(~swap).select(*served.columns, F.col("__new").isNotNull().alias("starter_override_applied"))
    changed = marked.where(swap).withColumn("pitcher_name", F.col("__new"))
    probe = stored(changed.select(*KEY, "game_date", "team", "opp_team", "pitcher_name", "batter_canonical"))
    played = registry.with_canonical(load_spine(s), s.canonical, raw="player_name", name="batter_canonical")
    met = history.pair_history(
        probe, played, pair=["batter_canonical", "pitcher_name"], date="game_date", game="game_id", weight="pa_count", counts=PAIR_COUNTS, suffix="vs_pitcher"
    )
    asked = [attach_opposing_pitching(probe, s, by="pitcher"), attach_pitch_matchup(probe, s), attach_hands(probe, s), met]
    anew = {c for part in asked for c in part.columns} - set(probe.columns)
    fresh = _joined(changed.select(*[c for c in served.columns if c not in anew]), asked)
    fresh = composite_features(attach_interactions(fresh.withColumn("starter_override_applied", F.lit(True))))
    return kept.unionByName(fresh.select(*kept.columns))


def enrich_for_serving(rows: DataFrame, s: HitterSources, *, lookback: int = 20, park_constants: Mapping[str, float] = PARK_FACTORS) -> DataFrame:
    """Point-in-time features for scheduled (game, batter, pitcher) rows, any number of dates in one job.

    ``rows`` needs game_id, game_date, player_name, team, opp_team, home_team, pitcher_name.  Form and pair
    history read completed games only, so the rows' own outcomes are not needed.
    """
    s = s if s.canonical is not None else prepared(s)
    played = registry.with_canonical(load_spine(s), s.canonical, raw="player_name", name="batter_canonical")
    base = stored(registry.with_canonical(rows, s.canonical, raw="player_name", name="batter_canonical"))
    met = history.pair_history(
        base, played, pair=["batter_canonical", "pitcher_name"], date="game_date", game="game_id", weight="pa_count",
        counts=PAIR_COUNTS, suffix="vs_pitcher",
    )
    parts = [attach_form(base, s, lookback), attach_opposing_pitching(base, s, by="pitcher"), attach_pitch_matchup(base, s), met]
    return _assembled(base, parts, s, park_constants)
