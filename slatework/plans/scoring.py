"""Slate scoring: score, tier, composite, de-duplicate, rank signal, explanation; any set of dates in one job."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from slatework.functions import codes, numeric
from slatework.functions.numeric import half_even, num
from slatework.operators import metrics, slate
from slatework.operators.ordering import join_on
from slatework.operators.registry import slate_team_validation
from slatework.session import settle

# Neutral inputs for features a scheduled row may lack.
SERVING_DEFAULTS = {
    "pitcher_era_30d": 4.5, "pitcher_hr_per_9_30d": 1.2, "pitcher_k_per_9_30d": 20.0, "pitcher_whip_30d": 1.3, "travel_distance_miles": 0.0,
    "timezone_changes": 0.0, "wind_speed_mph": 0.0, "temp_f": 72.0, "precipitation_mm": 0.0, "wind_out_factor": 1.0,
    "recent_hr_rate_lookback": 0.03, "recent_hit_rate_lookback": 0.25, "recent_so_rate_lookback": 0.20,
}

# What the components of a score are called.
COMPONENT_LABELS = {
    "power_component": "Power quality", "matchup_component": "Pitcher matchup", "form_component": "Recent form",
    "environment_component": "Park and environment", "freshness_component": "Freshness",
}

# Detail lines of an explanation: label -> (column, decimals, scale).
DETAILS = {
    "xwOBA": ("xwoba", 3, 1.0), "Barrel rate": ("barrel_rate", 1, 1.0), "Avg EV": ("avg_ev", 1, 1.0), "Pitcher HR/9 (30d)": ("pitcher_hr_per_9_30d", 2, 1.0),
    "Pitcher ERA (30d)": ("pitcher_era_30d", 2, 1.0), "Recent HR rate": ("recent_hr_rate_lookback", 1, 100.0), "Park factor": ("park_factor", 2, 1.0),
    "Temperature": ("temp_f", 1, 1.0), "Travel fatigue": ("travel_fatigue_score", 1, 1.0),
}


def plain_text(value: Column, places: int) -> Column:
    """A rounded number as text in plain digits from ten million on too, where a cast writes an exponent."""
    size = F.abs(value)
    digits = value.try_cast(f"decimal(38,{max(places, 1)})").cast("string")
    return F.when((size >= num(1e7)) & (size < num(1e16)), F.regexp_replace(digits, r"(\.\d+?)0+$", "$1")).otherwise(value.cast("string"))


def details(fields: Mapping[str, tuple[str, int, float]] = DETAILS) -> Column:
    """array<struct<label, value>>; a missing value reads 'Unavailable'."""
    rows = []
    for label, (column, places, scale) in fields.items():
        value = half_even(F.col(column).cast("double") * num(scale), places)
        rows.append(F.struct(F.lit(label).alias("label"), F.coalesce(plain_text(value, places), F.lit("Unavailable")).alias("value")))
    return F.array(*rows)


def score_slate(
    rows: DataFrame, *, slate_keys: Sequence[str], probability: str, key: Sequence[str], dedupe: Sequence[str], hit: str | None = None,
    odds: str | None = None, components=slate.HITTER_SCORE, thresholds: Mapping[str, float] | None = None, drop_lowest: bool = False, calibration: DataFrame | None = None, target: str = "target",
) -> DataFrame:
    """Scored candidates -> one ranked row per player with signal, price edge, composite score and explanation.

    Absolute signals compare the probability with fixed ``thresholds``, or with those that ``calibration`` holds for the row's
    ``target`` (see ``calibrate``), so one job scores slates of many dates and targets; a target without calibration has none.
    With ``drop_lowest`` rows below the lowest absolute threshold leave before the slate is ranked.
    """
    present = {c: d for c, d in SERVING_DEFAULTS.items() if c in rows.columns}
    df = rows.withColumns(numeric.with_defaults(present))
    scored = slate.slate_score(df, slate=slate_keys, components=components, keep_components=True)
    signal = None
    if calibration is not None:
        held = calibration.select(F.col(target), *[F.col(t).alias(f"__{t}") for t in metrics.TIER_POINTS])
        scored = join_on(scored, held, [target], "left")
        cuts = [(F.col(f"__{t}"), t) for t in metrics.TIER_POINTS]
        signal = F.when(cuts[-1][0].isNotNull(), numeric.tier(probability, cuts, "STRONG_SELL"))
    elif thresholds:
        signal = numeric.tier(probability, sorted(((v, k) for k, v in thresholds.items()), reverse=True), "STRONG_SELL")
    if signal is not None:
        scored = scored.withColumn("absolute_signal", signal).drop(*[f"__{t}" for t in metrics.TIER_POINTS])
        if drop_lowest:
            scored = scored.where(~F.col("absolute_signal").eqNullSafe("STRONG_SELL"))
    price = F.col(odds).cast("double") if odds else F.lit(None).cast("double")
    priced = F.coalesce(numeric.edge(probability, price), num(0))
    scored = scored.withColumns({"implied_probability": F.coalesce(numeric.implied_probability(price), num(0)), "edge": priced, "edge_pct": priced * num(100)})
    best = slate.best_per_key(scored, keys=[*slate_keys, *dedupe], score=probability, tie=key)
    ranked = slate.rank_signal(best, slate=slate_keys, score=probability, tie=key)
    labels = COMPONENT_LABELS if set(COMPONENT_LABELS) <= set(ranked.columns) else {f"{c}_component": c for c in components}
    ranked = ranked.withColumn("components", slate.top_components(labels))
    detail = {k: v for k, v in DETAILS.items() if v[0] in ranked.columns}
    ranked = ranked.withColumn("details", details(detail) if detail else F.lit(None))
    if len(components) > 1:
        ranked = ranked.withColumn("summary", slate.score_summary(F.col("components")))
    if hit:
        text = F.when(F.col(hit) > 0, F.concat_ws(" ", F.lit("Came true:"), F.col(hit).cast("string"), F.lit("counted"))).otherwise("Did not come true")
        ranked = ranked.withColumn("result_summary", text)
    return ranked.drop(*labels)


def calibrate(scored: DataFrame, *, probability: str, target: str = "target") -> DataFrame:
    """Per target the probability each absolute signal starts at: the table that slates of later dates are scored with."""
    return metrics.tier_thresholds(scored, probability, [target])


def cards(ranked: DataFrame, *, title: Column, probability: str) -> DataFrame:
    """The card a reader sees of each row: title, signals, percent, what drives it, its detail lines, and any warning."""
    parts = {
        "title": title, "signal": F.col("signal"), "absolute_signal": F.col("absolute_signal"), "probability_pct": half_even(F.col(probability) * num(100), 1),
        "summary": F.col("summary") if "summary" in ranked.columns else F.lit(None).cast("string"),
        "warning": F.when(F.col("team_warning"), F.lit("Team may be out of date")) if "team_warning" in ranked.columns else F.lit(None).cast("string"),
    }
    return ranked.withColumn("card", F.struct(*[c.alias(n) for n, c in parts.items()]))


def attach_team_validation(predictions: DataFrame, context: DataFrame, *, player: str, team: str) -> DataFrame:
    """Status and warning from the player's current, roster and transaction teams."""
    joined = predictions.join(context, player, "left").withColumn("__team", codes.team_code(team))
    status = slate_team_validation("__team", codes.team_code("current_team"), "roster_teams", "transaction_teams")
    return joined.withColumns({"team_status": status, "team_warning": status == "possible_team_mismatch"}).drop("__team")


def daily_report(predictions: DataFrame, *, slate_keys: Sequence[str], hit: str, team: str, opponent: str) -> dict[str, DataFrame]:
    """Slate statistics, teams and matchups, one frame each for all dates."""
    return {
        "stats": slate.slate_stats(predictions.withColumn("__hit", F.col(hit) > 0), slate=slate_keys, hit="__hit"),
        "teams": predictions.where(F.col(team).isNotNull()).select(*slate_keys, team).distinct(),
        "matchups": slate.matchup_list(predictions, slate=slate_keys, team=team, opponent=opponent),
    }


def slate_job(
    rows: DataFrame, calibration: DataFrame, context: DataFrame, *, slate_keys: Sequence[str], probability: str, key: Sequence[str], dedupe: Sequence[str], player: str, team: str, opponent: str, hit: str,
    target: str = "target", odds: str | None = None, components=slate.HITTER_SCORE, drop_lowest: bool = True,
) -> dict[str, DataFrame]:
    """Scored candidates of many dates and targets -> predictions with cards and team warnings, and the report on them.

    The predictions are written once; statistics, teams and matchups read that copy.
    """
    keys = [*slate_keys, target]
    ranked = score_slate(
        rows, slate_keys=keys, probability=probability, key=key, dedupe=dedupe, hit=hit, odds=odds, components=components, drop_lowest=drop_lowest, calibration=calibration, target=target
    )
    told = attach_team_validation(ranked, context, player=player, team=team)
    title = F.concat_ws(" vs ", F.col(player).cast("string"), F.col(opponent).cast("string"))
    predictions = settle(cards(told, title=title, probability=probability))
    return {"predictions": predictions, **daily_report(predictions, slate_keys=keys, hit=hit, team=team, opponent=opponent)}


def runtime_calibration(predictions: DataFrame, *, label: str, probability: str, signal: str | None = None) -> DataFrame:
    """Calibration of all scored rows, or of one rank signal's."""
    rows = predictions if signal is None else predictions.where(F.col("signal") == signal)
    return metrics.calibration_summary(rows, label=label, score=probability)
