"""Ranking, scoring and picking within a slate (a date, or any other grouping of candidate rows)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from slatework.functions.numeric import half_even, num, total
from slatework.operators.ordering import join_on, top_rows, with_positions

# Share of the slate, best first, that earns each signal.
RANK_CUTS = ((0.10, "STRONG_BUY"), (0.25, "BUY"), (0.50, "MODERATE"), (0.75, "AVOID"), (1.00, "STRONG_SELL"))


def signal_of(position: Column, rows: Column, cuts: Sequence[tuple[float, str]] = RANK_CUTS) -> Column:
    place, chain = position / rows, F
    for cut, label in cuts:
        chain = chain.when(place < num(cut), F.lit(label))
    return chain.otherwise(F.lit(cuts[-1][1]))


def rank_signal(df: DataFrame, *, slate: Sequence[str], score: str, tie: Sequence[str], cuts: Sequence[tuple[float, str]] = RANK_CUTS, name: str = "signal") -> DataFrame:
    """Signal by 0-based rank share within the slate, highest score first, ties by ``tie`` ascending."""
    placed = with_positions(df, slate, [F.col(score).desc(), *[F.col(c) for c in tie]], "slate_position", "slate_rows", using=[score, *tie])
    return placed.withColumn(name, signal_of(F.col("slate_position"), F.col("slate_rows"), cuts))


@dataclass(frozen=True)
class Term:
    """One min-max normalised input of a slate score."""

    column: str
    weight: float
    default: float = 0.0
    floor: float | None = None
    invert: bool = False


# Hitter score (component -> weight, terms) and starter strikeout score.
HITTER_SCORE = {
    "power": (0.30, [Term("xwoba", 0.45, 0.320), Term("barrel_rate", 0.35, 0.06), Term("avg_ev", 0.20, 88.0)]),
    "matchup": (0.25, [Term("pitcher_hr_per_9_30d", 0.6, 1.2), Term("pitcher_era_30d", 0.4, 4.0)]),
    "form": (0.20, [Term("recent_hr_rate_lookback", 1.0, 0.03)]),
    "environment": (0.15, [Term("park_factor", 0.5, 1.0), Term("wind_out_factor", 0.3, 1.0), Term("temp_f", 0.2, 72.0, floor=40.0)]),
    "freshness": (0.10, [Term("travel_fatigue_score", 1.0, 0.0, invert=True)]),
}
STARTER_SCORE = {
    "strikeouts": (1.0, [
        Term("starter_k_per_9_30d", 0.26, 8.0), Term("starter_avg_so_30d", 0.24, 4.5),
        Term("starter_k_percent_season", 0.16, 22.0), Term("starter_whiff_percent_season", 0.14, 24.0),
        Term("opp_team_k_rate_14d", 0.12, 0.22), Term("opp_team_pa_per_game_14d", 0.04, 38.0),
        Term("starter_avg_ip_30d", 0.04, 5.0),
    ]),
}


def slate_score(df: DataFrame, *, slate: Sequence[str], components: Mapping[str, tuple[float, Sequence[Term]]], name: str = "score", keep_components: bool = False) -> DataFrame:
    """0-100 score: weighted min-max positions of each term within the slate; a constant or empty pool counts 0.5.

    Missing values stay out of a slate's minimum and maximum; they read as the term's default, at most at the ends
    of the slate's range.  The pools come from one grouped aggregate joined back, so no slate is gathered into one task.
    """
    terms = [t for _, group in components.values() for t in group]

    def present(t: Term) -> Column:
        v = F.col(t.column).cast("double")
        return v if t.floor is None else F.when(v.isNotNull(), F.greatest(v, num(t.floor)))

    pools = df.groupBy(*slate).agg(
        *[F.min(present(t)).alias(f"__lo_{t.column}") for t in terms], *[F.max(present(t)).alias(f"__hi_{t.column}") for t in terms]
    )
    scored = join_on(df, pools, slate)

    def place(t: Term) -> Column:
        low, high = F.col(f"__lo_{t.column}"), F.col(f"__hi_{t.column}")
        flat = high.isNull() | (high == low)
        at = (F.coalesce(present(t), num(t.default)) - low) / F.nullif(high - low, num(0))
        at = F.least(num(1), F.greatest(num(0), at))
        return F.when(flat, num(0.5)).otherwise(num(1) - at if t.invert else at)

    parts = {key: total([place(t) * num(t.weight) for t in group]) for key, (_, group) in components.items()}
    raw = total([parts[key] * num(weight) for key, (weight, _) in components.items()])
    columns = [half_even(raw * num(100), 1).alias(name)]
    if keep_components:
        columns += [half_even(parts[key] * num(100), 1).alias(f"{key}_component") for key in components]
    return scored.select(*df.columns, *columns)


def top_components(labels: Mapping[str, str]) -> Column:
    """array<struct<score, label>> of component columns, strongest first; equal scores keep the given order."""
    items = [
        F.struct(F.col(c).alias("score"), F.lit(-i).alias("place"), F.lit(label).alias("label"))
        for i, (c, label) in enumerate(labels.items())
    ]
    ranked = F.sort_array(F.array(*items), asc=False)
    return F.transform(ranked, lambda x: F.struct(x["score"].alias("score"), x["label"].alias("label")))


def score_summary(components: Column) -> Column:
    """'... driven by <first> and <second>.' text of a ranked component array."""
    label = lambda i: F.lower(components[i]["label"])
    return F.concat(F.lit("Rating driven by "), label(0), F.lit(" and "), label(1), F.lit("."))


def best_per_key(df: DataFrame, *, keys: Sequence[str], score: str, tie: Sequence[str]) -> DataFrame:
    """One row per key, the highest score; equal scores by ``tie`` ascending."""
    return top_rows(df, keys, [F.col(score).desc_nulls_last(), *[F.col(c) for c in tie]])


def top_n_per_day(df: DataFrame, *, day: str, score: str, tie: Sequence[str], n: int) -> DataFrame:
    return top_rows(df, [day], [F.col(score).desc_nulls_last(), *[F.col(c) for c in tie]], n)


def hitter_outlook(df: DataFrame, *, team: Sequence[str], player: str, slot: str, hit: str, home_run: str, xwoba: str, recent_so: str, k_rate: str, whiff_rate: str, listed: int = 9, named: int = 3) -> DataFrame:
    """Per team: the expected order (first ``listed``), and the ``named`` highest strikeout risks and damage scores.

    Batting order first (unknown slots last), then hit probability.  Only the few rows that are reported
    leave the map side, so a team's row count does not matter.
    """
    def read(column: str, default: float) -> Column:
        return F.coalesce(F.col(column).cast("double"), num(default))

    scored = df.withColumns(
        {
            "damage_score": read(hit, 0) * num(0.55) + read(home_run, 0) * num(0.30) + read(xwoba, 0.320) * num(0.15),
            "k_risk_score": read(recent_so, 0.22) * num(0.30) + read(k_rate, 0.24) * num(0.45) + read(whiff_rate, 0.25) * num(0.25),
            "__slot": F.when(F.col(slot) > 0, F.col(slot)).otherwise(99),
        }
    )

    def listing(order: Sequence[Column], n: int, name: str) -> DataFrame:
        ranked = top_rows(scored, team, [*order, F.col(player)], n, rank="__place")
        rows = F.sort_array(F.collect_list(F.struct("__place", player)))
        return ranked.groupBy(*team).agg(F.transform(rows, lambda r: r[player]).alias(name))

    order = listing([F.col("__slot"), F.col(hit).desc()], listed, "expected_order")
    risks = listing([F.col("k_risk_score").desc()], named, "strikeout_risks")
    damage = listing([F.col("damage_score").desc()], named, "damage_threats")
    return join_on(join_on(order, risks, team), damage, team)


def slate_stats(df: DataFrame, *, slate: Sequence[str], hit: str) -> DataFrame:
    """Rows, hits and hit rate (percent, one place) per slate."""
    return df.groupBy(*slate).agg(
        F.count(F.lit(1)).alias("total_picks"),
        F.sum(F.col(hit).cast("long")).alias("total_hits"),
        half_even(F.avg(F.col(hit).cast("double")) * num(100), 1).alias("hit_rate"),
    )


def matchup_list(df: DataFrame, *, slate: Sequence[str], team: str, opponent: str) -> DataFrame:
    """Distinct 'A vs B' labels per slate, each pairing once whichever side the row is on."""
    label = F.concat_ws(" vs ", F.least(team, opponent), F.greatest(team, opponent))
    return df.where(F.col(team).isNotNull() & F.col(opponent).isNotNull()).select(*slate, label.alias("matchup")).distinct()


def override_starters(df: DataFrame, overrides: DataFrame, *, opponent: str, pitcher: str, features: Mapping[str, float]) -> DataFrame:
    """What-if: swap the pitcher (and its features) for rows facing a team named in ``overrides``.

    ``overrides`` has the ``opponent`` key, ``pitcher`` and a column per feature; a feature it does not
    know falls back to the given default.
    """
    chosen = overrides.withColumnsRenamed({c: f"__new_{c}" for c in overrides.columns if c != opponent})
    joined = join_on(df, chosen, [opponent], "left")
    swapped = F.col(f"__new_{pitcher}").isNotNull()
    new = {pitcher: F.coalesce(F.col(f"__new_{pitcher}"), F.col(pitcher)), "starter_override_applied": swapped}
    new |= {
        f: F.when(swapped, F.coalesce(F.col(f"__new_{f}"), num(default))).otherwise(F.col(f)) for f, default in features.items()
    }
    return joined.withColumns(new).select(*df.columns, "starter_override_applied")


def starter_options(current: DataFrame, roster: DataFrame, *, team: str, pitcher: str) -> DataFrame:
    """Candidate pitchers, one row each with its ``place`` from 0: by name, the one currently listed first if the roster lacks it.

    A roster may be of any length.  A team without a candidate has no row; blank names are none.
    """
    names = roster.select(team, F.trim(pitcher).alias("candidate")).where("candidate <> ''").distinct().withColumn("__listed", F.lit(1))
    now = current.withColumn("candidate", F.trim(pitcher)).where("candidate <> ''")
    missing = join_on(now, names.select(team, "candidate"), [team, "candidate"], "left_anti").withColumn("__listed", F.lit(0))
    rows = join_on(current, names, [team]).unionByName(missing)
    placed = with_positions(rows, current.columns, [F.col("__listed"), F.col("candidate")], "place", "candidates")
    return placed.select(*current.columns, "place", "candidate", "candidates")
