"""Stakes, settlement and bankroll rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from slatework.functions.numeric import num, ratio, share
from slatework.operators.ordering import join_on, running_totals, top_rows
from slatework.session import settle

STAKES = ("flat_unit", "confidence_linear", "confidence_tiered")


def usable_bets(df: DataFrame, *, confidence: str, odds: str, label: str) -> DataFrame:
    """Typed bets with a price above 1 and a confidence; unparsable numbers count as missing."""
    typed = df.withColumns(
        {
            confidence: F.col(confidence).try_cast("double"),
            odds: F.col(odds).try_cast("double"),
            label: F.coalesce(F.col(label).try_cast("int"), F.lit(0)),
        }
    )
    return typed.where((F.col(odds) > 1) & F.col(confidence).isNotNull())


def filter_bets(df: DataFrame, *, date: str, confidence: str, start=None, end=None, minimum: float | None = None) -> DataFrame:
    if start is not None:
        df = df.where(F.col(date) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col(date) <= F.lit(end).cast("date"))
    return df if minimum is None else df.where(F.col(confidence) >= minimum)


def unit_profit(label: Column | str, odds: Column | str) -> Column:
    """Profit of a unit stake; a win without a usable price adds 0."""
    label, odds = (F.col(c) if isinstance(c, str) else c for c in (label, odds))
    return F.when(label == 1, F.when(odds > 1, odds - num(1)).otherwise(num(0))).otherwise(num(-1))


def overall_result(df: DataFrame, *, label: str, odds: str) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total_picks"),
        F.sum((F.col(label) == 1).cast("long")).alias("total_hits"),
        share(F.sum((F.col(label) == 1).cast("long")), F.count(F.lit(1))).alias("hit_rate"),
        share(F.sum(unit_profit(label, odds)), F.count(F.lit(1))).alias("roi"),
    )


def recommendations(df: DataFrame, *, probability: str, odds: str, minimum_edge: float = 0.05, missing_odds: float = 10.0) -> DataFrame:
    """Rows whose probability beats the priced one by at least ``minimum_edge``, best first."""
    implied = num(1) / F.coalesce(F.col(odds), num(missing_odds))
    priced = df.withColumns({"implied_probability": implied, "edge": F.col(probability) - implied})
    return priced.where(F.col("edge") >= minimum_edge).orderBy(F.col("edge").desc())


def stake_table(counts: DataFrame, *, confidence: str, groups: Sequence[str] = ()) -> DataFrame:
    """Stakes per (groups, confidence) from the bets counted by it (``__n``): ``__linear`` from 0.5 to 2.0 and ``__tiered`` by rank,
    each with mean 1 over the group's bets."""
    c = F.col(confidence).cast("double")
    placed = running_totals(counts, groups, [F.col(confidence)], {"n": "__n"}, "__below_", "__of_")
    rank = (F.col("__below_n") + (F.col("__n") + 1) / num(2)) / F.col("__of_n")
    tiered = F.when(rank >= 0.9, num(1.75)).when(rank >= 0.75, num(1.25)).when(rank >= 0.5, num(1.0)).otherwise(num(0.5))
    low_high = placed.groupBy(*groups).agg(F.min(c).alias("__lo"), F.max(c).alias("__hi"))
    scaled = _with_row(placed, low_high, groups).withColumns(
        {"__linear": num(0.5) + num(1.5) * ((c - F.col("__lo")) / F.greatest(F.col("__hi") - F.col("__lo"), num(1e-9))), "__tiered": tiered}
    )
    mean = lambda stake: F.sum(F.col(stake) * F.col("__n")) / F.sum("__n")
    means = scaled.groupBy(*groups).agg(mean("__linear").alias("__linear_mean"), mean("__tiered").alias("__tiered_mean"))
    return _with_row(scaled, means, groups).select(
        *groups, confidence, (F.col("__linear") / F.col("__linear_mean")).alias("__linear"), (F.col("__tiered") / F.col("__tiered_mean")).alias("__tiered")
    )


def with_stakes(df: DataFrame, *, confidence: str, odds: str, groups: Sequence[str] = ()) -> DataFrame:
    """Flat, confidence-linear (0.5-2.0) and confidence-tiered stakes, each with mean 1 within its group.

    A stake depends on the confidence alone, so ranks, scales and means come from the counts of distinct
    confidences; the bets are only counted once and joined once.
    """
    c = F.col(confidence).cast("double")
    counts = df.where(F.col(confidence).isNotNull()).groupBy(*groups, confidence).agg(F.count(F.lit(1)).alias("__n"))
    return join_on(df, stake_table(counts, confidence=confidence, groups=groups), [*groups, confidence], "left").select(
        *df.columns,
        num(1).alias("flat_unit"),
        F.col("__linear").alias("confidence_linear"),
        F.col("__tiered").alias("confidence_tiered"),
        (num(1) / F.col(odds)).alias("implied_probability"),
        (c / num(100)).alias("confidence_probability"),
        (c / num(100) - num(1) / F.col(odds)).alias("confidence_edge"),
    )


def _with_row(df: DataFrame, summary: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Attach a per-group summary; an ungrouped summary is a single aggregate row."""
    if groups:
        return join_on(df, summary, groups)
    one = summary.withColumn("__one", F.lit(1))
    return df.withColumn("__one", F.lit(1)).join(F.broadcast(one), "__one").drop("__one")


def settle_bets(df: DataFrame, *, stake: str, label: str, odds: str, groups: Sequence[str] = ()) -> DataFrame:
    """Bets, stake, profit, ROI %, hit % and mean stake."""
    profit = F.when(F.col(label) == 1, F.col(stake) * (F.col(odds) - num(1))).otherwise(-F.col(stake))
    sums = df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("bets"), F.sum(stake).alias("stake"), F.sum(profit).alias("profit"), F.sum(F.col(label).cast("long")).alias("__hits")
    )
    return _settled(sums, groups)


def settle_schemes(df: DataFrame, *, label: str, odds: str, groups: Sequence[str] = (), schemes: Sequence[str] = STAKES) -> DataFrame:
    """Settlement of several stake columns in one pass over the bets, one row per group and scheme."""
    won = F.col(label) == 1
    aggs = [F.count(F.lit(1)).alias("bets"), F.sum(F.col(label).cast("long")).alias("__hits")]
    for s in schemes:
        aggs += [F.sum(s).alias(f"__{s}_stake"), F.sum(F.when(won, F.col(s) * (F.col(odds) - num(1))).otherwise(-F.col(s))).alias(f"__{s}_profit")]
    rows = F.inline(F.array(*[F.struct(F.lit(s).alias("scheme"), F.col(f"__{s}_stake").alias("stake"), F.col(f"__{s}_profit").alias("profit")) for s in schemes]))
    return _settled(df.groupBy(*groups).agg(*aggs).select(*groups, "bets", "__hits", rows), [*groups, "scheme"])


def _settled(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    return sums.select(
        *keys,
        "bets",
        "stake",
        "profit",
        F.when(F.col("stake") > 0, F.col("profit") / F.col("stake") * num(100)).otherwise(num(0)).alias("roi_pct"),
        share("__hits", "bets").alias("hit_rate_pct"),
        F.coalesce(ratio("stake", "bets"), num(0)).alias("avg_stake"),
    )


def profitable_days(daily: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    return daily.groupBy(*groups).agg(
        F.count(F.when(F.round("profit", 4) > 0, 1)).alias("profitable_days"), F.count(F.lit(1)).alias("total_days")
    )


# The pools whose best bets of a day are scenarios of their own, and what they add to the name.
RANKED_IN = {"all_picks": "", "confidence_70_plus": "_conf70", "edge_5_plus": "_edge5"}


def scenario_cuts(confidence: str, edge: str) -> dict[str, Column]:
    c, e = F.col(confidence), F.col(edge)
    return {"all_picks": F.lit(True), "confidence_70_plus": c >= 70, "confidence_80_plus": c >= 80, "edge_5_plus": e >= 0.05, "edge_10_plus": e >= 0.10}


def settle_scenarios(df: DataFrame, *, day: str, confidence: str, edge: str, label: str, odds: str, tie: Sequence[str], tops: Sequence[int] = (5, 10)) -> DataFrame:
    """Settlement of every stake scheme in every scenario, one row each.

    Within a scenario a stake depends on the confidence alone, so a bet enters as part of three numbers per (scenario,
    confidence): bets, hits and the wins' odds less 1.  Those of the plain scenarios are conditional sums of one
    aggregate; only the best bets of a day, a few per day and pool, are handed on as rows.
    """
    won = F.coalesce(F.col(label) == 1, F.lit(False))
    gain = F.when(won, F.col(odds) - num(1)).otherwise(num(0))
    cuts = scenario_cuts(confidence, edge)
    sums = {"__n": F.lit(1), "__hits": won.cast("long"), "__gain": gain}
    plain = df.groupBy(confidence).agg(*[F.sum(F.when(cut, value)).alias(f"{name}{s}") for name, cut in cuts.items() for s, value in sums.items()])
    each = [F.struct(F.lit(name).alias("scenario"), *[F.col(f"{name}{s}").alias(s) for s in sums]) for name in cuts]
    plain = plain.select(confidence, F.inline(F.array(*each))).where("__n > 0")

    pools = F.filter(F.array(*[F.when(cuts[name], F.lit(name)) for name in RANKED_IN]), lambda t: t.isNotNull())
    narrow = df.select(day, confidence, odds, label, *[t for t in tie if t not in (odds, confidence, day)], F.explode(pools).alias("scenario"))
    best = top_rows(narrow, ["scenario", day], [F.col(confidence).desc(), *[F.col(t) for t in tie]], max(tops), rank="__r")
    suffix = F.create_map(*[F.lit(x) for pair in RANKED_IN.items() for x in pair])
    names = [F.when(F.col("__r") <= n, F.concat(F.lit(f"top_{n}_per_day"), F.try_element_at(suffix, F.col("scenario")))) for n in tops]
    best = best.withColumn("scenario", F.explode(F.filter(F.array(*names), lambda t: t.isNotNull())))
    best = best.groupBy(confidence, "scenario").agg(*[F.sum(value).alias(s) for s, value in sums.items()])

    counted = settle(plain.unionByName(best))
    stakes = stake_table(counted, confidence=confidence, groups=["scenario"]).withColumn("__flat", num(1))
    staked = join_on(counted, stakes, ["scenario", confidence])
    schemes = dict(zip(STAKES, ("__flat", "__linear", "__tiered")))
    rows = F.inline(F.array(*[F.struct(F.lit(s).alias("scheme"), F.col(c).alias("__stake")) for s, c in schemes.items()]))
    settled = staked.select("scenario", *sums, rows).groupBy("scenario", "scheme").agg(
        F.sum("__n").alias("bets"), F.sum(F.col("__stake") * F.col("__n")).alias("stake"),
        F.sum(F.col("__stake") * (F.col("__gain") - (F.col("__n") - F.col("__hits")))).alias("profit"), F.sum("__hits").alias("__hits"),
    )
    return _settled(settled, ["scenario", "scheme"])


def kelly_growth(probability: Column | str, odds: Column | str, label: Column | str, fraction: float = 0.25, cap: float = 0.25) -> Column:
    """Log growth of a bankroll that stakes a capped Kelly fraction; NULL without a positive edge."""
    p, o, y = (F.col(c) if isinstance(c, str) else c for c in (probability, odds, label))
    advantage = p - num(1) / o
    share_of_bank = F.least(num(fraction) * advantage / (o - num(1)), num(cap))
    factor = F.when(y == 1, num(1) + share_of_bank * (o - num(1))).otherwise(num(1) - share_of_bank)
    return F.when((o > 1) & (advantage > 0), F.log(factor))


def kelly_results(df: DataFrame, *, rules: Mapping[str, Column], probability: str, odds: str, label: str, bankroll: float = 1000.0) -> DataFrame:
    """Final bankroll, its log growth, ROI, bets and win rate per betting rule.

    Each bet stakes a share of the running bankroll, so the final bankroll is a product over the bets and
    does not depend on their order: a sum of logarithms, with no sequential pass.  ``log_growth`` stays finite
    where millions of bets carry the bankroll past the largest double.
    """
    tags = F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]), lambda t: t.isNotNull())
    bets = df.withColumn("__growth", kelly_growth(probability, odds, label)).where("__growth is not null").withColumn("rule", F.explode(tags))
    sums = bets.groupBy("rule").agg(
        F.count(F.lit(1)).alias("bets"), F.sum(F.col(label).cast("long")).alias("__wins"), F.sum("__growth").alias("__log")
    )
    return sums.select(
        "rule", "bets", ratio("__wins", "bets").alias("win_rate"), F.col("__log").alias("log_growth"),
        (num(bankroll) * F.exp("__log")).alias("final_bankroll"), ((F.exp("__log") - num(1)) * num(100)).alias("roi_pct"),
    )


def kelly_curve(df: DataFrame, *, day: str, probability: str, odds: str, label: str, groups: Sequence[str] = (), bankroll: float = 1000.0) -> DataFrame:
    """Bankroll and its log growth at the end of each day: growth is summed per day, then accumulated over the calendar."""
    bets = df.withColumn("__growth", kelly_growth(probability, odds, label)).where("__growth is not null")
    daily = bets.groupBy(*groups, day).agg(F.count(F.lit(1)).alias("bets"), F.sum("__growth").alias("__log"))
    upto = Window.partitionBy(*groups).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    daily = daily.withColumn("log_growth", F.sum("__log").over(upto))
    return daily.withColumn("bankroll", num(bankroll) * F.exp("log_growth")).drop("__log")
