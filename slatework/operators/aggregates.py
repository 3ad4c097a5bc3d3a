"""Grouped summaries: game spines, profiles, metric packs, coverage, segments."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from slatework.functions.numeric import blend, col, flag, num, ratio, share, weighted_mean
from slatework.operators.ordering import join_on, top_rows


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def rate_if(condition: Column) -> Column:
    """Percentage of all rows of the group for which the condition is true; unknown counts as false."""
    return F.avg(F.when(condition, num(1)).otherwise(num(0))) * num(100)


def entity_games(events: DataFrame, *, keys: Sequence[str], counts: Mapping[str, Column], modes: Mapping[str, str] | None = None) -> DataFrame:
    """Event rows -> one row per entity and game with conditional counts and most frequent values.

    Modes are found from per-value counts (ties to the smallest value), so that a game with many rows is
    counted before it is shuffled instead of being collected into a frequency map.  The events are read once: a row
    stands once per mode, under that mode's value, and the conditional counts travel with the first of them.
    """
    if not modes:
        return events.groupBy(*keys).agg(*[count_if(c).alias(name) for name, c in counts.items()])
    held = [F.when(c, 1).otherwise(0).alias(f"__c{i}") for i, c in enumerate(counts.values())]
    kinds = [events.schema[value].dataType for value in modes.values()]

    def under(i: int, value: str) -> Column:
        return F.struct(F.lit(i).alias("__mode"), *[(F.col(value) if i == j else F.lit(None).cast(kind)).alias(f"__v{j}") for j, kind in enumerate(kinds)])

    marked = F.explode(F.array(*[under(i, value) for i, value in enumerate(modes.values())])).alias("__m")
    rows = events.select(*keys, *held, marked).select(*keys, *[f"__c{i}" for i in range(len(held))], "__m.*")
    first = F.col("__mode") == 0
    counted = rows.groupBy(*keys, "__mode", *[f"__v{j}" for j in range(len(kinds))]).agg(
        F.count(F.lit(1)).alias("__n"), *[F.sum(F.when(first, F.col(f"__c{i}")).otherwise(0)).alias(f"__c{i}") for i in range(len(held))]
    )

    def best(j: int) -> Column:
        mine = (F.col("__mode") == j) & F.col(f"__v{j}").isNotNull()
        return F.min(F.when(mine, F.struct((-F.col("__n")).alias("n"), F.col(f"__v{j}").alias("v"))))["v"]

    return counted.groupBy(*keys).agg(*[F.sum(f"__c{i}").alias(name) for i, name in enumerate(counts)], *[best(j).alias(name) for j, name in enumerate(modes)])


def most_frequent(df: DataFrame, *, keys: Sequence[str], value: str, name: str) -> DataFrame:
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    best = F.min(F.struct((-F.col("__n")).alias("n"), F.col(value).alias("v")))
    return counted.groupBy(*keys).agg(best["v"].alias(name))


def any_then_rate(events: DataFrame, *, entity: Sequence[str], game: str, conditions: Mapping[str, Column]) -> DataFrame:
    """Share of games in which the condition held at least once."""
    games = events.groupBy(*entity, game).agg(*[F.max(flag(c)).alias(name) for name, c in conditions.items()])
    return games.groupBy(*entity).agg(
        F.count(F.lit(1)).alias("games"), *[F.avg(F.col(name).cast("double")).alias(f"{name}_rate") for name in conditions]
    )


def distinct_counts(df: DataFrame, keys: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """Exact distinct counts of several columns per group.

    Each (column, value) is de-duplicated first and counted after, which spreads a hot group over its
    values; several count(distinct) in one aggregate would bring them back together.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(name).alias("c"), F.col(c).cast("string").alias("v")) for name, c in columns.items()]))
    long = df.select(*keys, pairs.alias("p")).select(*keys, "p.c", "p.v").distinct()
    return long.groupBy(*keys).agg(*[count_if((F.col("c") == name) & F.col("v").isNotNull()).alias(name) for name in columns])


def joined_values(df: DataFrame, *, keys: Sequence[str], value: str, separator: str = "|", name: str = "joined", most: int | None = None) -> DataFrame:
    """Distinct values per key in ascending order, as one delimited string; the first ``most`` of them where given.

    Without ``most``, the caller knows that a key has few distinct values.
    """
    unique = df.select(*keys, value).where(F.col(value).isNotNull()).distinct()
    if most is not None:
        unique = top_rows(unique, keys, [F.col(value)], most)
    return unique.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list(value)), separator).alias(name))


def mix_profile(pitches: DataFrame, *, entity: Sequence[str], kind: str, parent: str, order: Sequence[str], miss: Column, finish: Column) -> DataFrame:
    """Per entity and kind: usage, share of rows that miss, share that are the finishing last row of their parent."""
    counts = mix_counts(pitches, keys=[*entity, kind], parent=parent, order=order, miss=miss, finish=finish)
    return counts.select(
        *entity, kind, F.col("used").alias("usage_count"), (F.col("missed") / F.col("used")).alias("whiff_rate"), (F.col("finished") / F.col("used")).alias("finish_rate")
    )


def mix_counts(pitches: DataFrame, *, keys: Sequence[str], parent: str, order: Sequence[str], miss: Column, finish: Column) -> DataFrame:
    """Per key: rows, rows that miss, and rows that are the finishing last row of their parent.

    A parent is one play, so the window that finds its last row holds a few rows.
    """
    marked = pitches.withColumn("__is_last", F.struct(*order) == F.max(F.struct(*order)).over(Window.partitionBy(parent)))
    return marked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("used"), F.count(F.when(miss, 1)).alias("missed"), F.count(F.when(F.col("__is_last") & finish, 1)).alias("finished")
    )


def usage_share(profile: DataFrame, *, entity: Sequence[str], usage: str, name: str = "usage_share") -> DataFrame:
    """Raw counts -> share of the entity's total, so counted and published profiles can be mixed."""
    whole = profile.groupBy(*entity).agg(F.sum(usage).alias("__all"))
    return join_on(profile, whole, entity).withColumn(name, ratio(usage, "__all")).drop("__all")


def top_two(profile: DataFrame, *, entity: Sequence[str], kind: str, usage: str, metrics: Sequence[str], few_kinds: bool = False) -> DataFrame:
    """Primary and secondary kind per entity as columns, and usage-weighted means over all its kinds.

    Only the two most used kinds are ranked (ties by name); the means are a plain aggregate.  Where an entity has ``few_kinds``,
    all of them are ranked and the means taken in the same grouping, so the profile is read once.
    """
    used = profile.where(F.col(usage).isNotNull())
    order = [F.col(usage).desc(), F.col(kind)]
    fields = [kind, usage, *metrics]
    pick = {1: "primary", 2: "secondary"}
    sides = [F.max(F.when(F.col("__r") == r, F.col(f))).alias(f"{side}_{f}") for r, side in pick.items() for f in fields]
    overall = [weighted_mean(m, usage).alias(f"overall_{m}") for m in metrics]
    if few_kinds:
        return used.withColumn("__r", F.row_number().over(Window.partitionBy(*entity).orderBy(*order))).groupBy(*entity).agg(*sides, *overall)
    wide = top_rows(used, entity, order, 2, rank="__r").groupBy(*entity).agg(*sides)
    return join_on(wide, used.groupBy(*entity).agg(*overall), entity)


def weighted_profile(df: DataFrame, *, keys: Sequence[str], weight: str, metrics: Sequence[str]) -> DataFrame:
    """Weighted mean of each metric per key; NULL metrics weigh in as 0, weights below 0 as 0."""
    return df.groupBy(*keys).agg(*[weighted_mean(m, weight).alias(m) for m in metrics])


def two_point(metric: str, primary: Column | str, secondary: Column | str, w1: Column | str, w2: Column | str) -> Column:
    return blend([(primary, w1), (secondary, w2)]).alias(metric)


def pivot_means(df: DataFrame, *, keys: Sequence[str], category: str, values: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Long -> wide: ``<measure>_<category value>`` averages for the listed category values."""
    return df.groupBy(*keys).agg(
        *[F.avg(F.when(F.col(category) == v, F.col(m))).alias(f"{m}_{v}") for m in measures for v in values]
    )


HIT_EVENTS = ("single", "double", "triple", "home_run")


def contact_pack(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Contact-quality metrics per key from batted-ball rows.

    Percentages are over all rows; a missing speed or angle fails its test.  Batted-ball shares are over
    rows that have a type.
    """
    speed, angle, event, kind = F.col("launch_speed"), F.col("launch_angle"), F.col("events"), F.col("bb_type")
    known_hands = F.col("stand").isNotNull() & F.col("p_throws").isNotNull()
    same = F.col("stand") == F.col("p_throws")
    hits, at_bats = count_if(event.isin(*HIT_EVENTS)), F.count(event)
    walks, rows = count_if(event == "walk"), F.count(F.lit(1))
    average, on_base = F.coalesce(ratio(hits, at_bats), num(0)), ratio(hits + walks, rows)
    shares = {"fb": "fly_ball", "gb": "ground_ball", "ld": "line_drive", "iffb": "popup"}
    return df.groupBy(*keys).agg(
        rows.alias("pa"),
        at_bats.alias("ab"),
        hits.alias("hits"),
        count_if(event == "home_run").alias("hr"),
        count_if(event == "strikeout").alias("so"),
        walks.alias("bb"),
        average.alias("avg"),
        on_base.alias("obp"),
        rate_if(speed >= 95).alias("ev95_plus"),
        rate_if((angle >= 15) & (angle <= 30)).alias("sweet_spot_percent"),
        F.coalesce(F.avg(speed), num(0)).alias("avg_hit_speed"),
        F.coalesce(F.avg(F.when(speed.isNotNull(), angle)), num(0)).alias("avg_hit_angle"),
        rate_if((speed >= 98) & (angle >= 26) & (angle <= 30)).alias("barrel_rate"),
        *[share(count_if(kind == value), F.count(kind)).alias(f"{stem}_percent") for stem, value in shares.items()],
        rate_if(known_hands & same).alias("pull_percent"),
        rate_if(~known_hands).alias("center_percent"),
        rate_if(known_hands & ~same).alias("oppo_percent"),
        ((on_base * num(1.25) + average * num(0.5)) * num(100)).cast("int").alias("wrc_plus"),
    )


def pitching_pack(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Allowed-contact metrics per key from batted-ball rows; innings are rows / 4.5."""
    speed, angle, event = F.col("launch_speed"), F.col("launch_angle"), F.col("events")
    rows = F.count(F.lit(1))
    innings = rows / num(4.5)
    hits, homers = count_if(event.isin(*HIT_EVENTS)), count_if(event == "home_run")
    strikeouts, walks = count_if(event == "strikeout"), count_if(event == "walk")
    return df.groupBy(*keys).agg(
        rows.alias("pa"),
        innings.alias("innings_pitched"),
        hits.alias("hits_allowed"),
        homers.alias("hr_allowed"),
        strikeouts.alias("so"),
        walks.alias("bb_allowed"),
        ((homers * 4 + hits) / innings * num(9)).alias("era"),
        ((homers * 13 + walks * 3 - strikeouts * 2) / innings).alias("fip"),
        (homers / innings * num(9)).alias("hr_per_9"),
        ((hits + walks) / innings).alias("whip"),
        share(strikeouts, rows).alias("k_percent"),
        share(walks, rows).alias("bb_percent"),
        F.coalesce(F.avg(speed), num(0)).alias("avg_hit_speed_allowed"),
        rate_if((speed >= 98) & (angle >= 26) & (angle <= 30)).alias("barrel_rate_allowed"),
    )


def play_mix(df: DataFrame, *, keys: Sequence[str], result: str, home_run: str, strikeout: str, walk: str, fly: str, ground: str, line: str) -> DataFrame:
    """Counts of play classes by exact value and LIKE pattern, with zero-guarded percentages."""
    value = F.col(result)
    rows = F.count(F.lit(1))
    flies, grounders, liners = (count_if(value.like(p)) for p in (fly, ground, line))
    homers, strikeouts = count_if(value == home_run), count_if(value == strikeout)
    return df.groupBy(*keys).agg(
        rows.alias("plays"),
        homers.alias("hr_allowed"),
        strikeouts.alias("strikeouts"),
        count_if(value == walk).alias("walks"),
        flies.alias("fly_balls"),
        grounders.alias("ground_balls"),
        liners.alias("line_drives"),
        share(strikeouts, rows).alias("k_rate_pct"),
        share(homers, rows).alias("hr_rate_pct"),
        share(flies, flies + grounders + liners).alias("fly_ball_pct"),
    )


def workload(parents: DataFrame, children: DataFrame, *, parent: str, keys: Sequence[str]) -> DataFrame:
    """Children and distinct parents per key, children counted per parent first so the join cannot fan out."""
    per_parent = children.groupBy(parent).agg(F.count(F.lit(1)).alias("__n"))
    joined = parents.select(parent, *keys).distinct().join(per_parent, parent, "left")
    return joined.groupBy(*keys).agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("pitch_count"), F.count(F.lit(1)).alias("batters_faced")
    )


def _melt(one_row: DataFrame, names: Sequence[str], fields: Sequence[str], label: str) -> DataFrame:
    """One wide row of '<name>|<field>' columns -> one row per name."""
    rows = [F.struct(F.lit(n).alias(label), *[F.col(f"`{n}|{f}`").alias(f) for f in fields]) for n in names]
    return one_row.select(F.inline(F.array(*rows)))


def column_statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """mean, std, min, max and NULL count per column, in one pass."""
    fields = {
        "mean": lambda c: F.avg(c), "std": lambda c: F.stddev_samp(c), "min": lambda c: F.min(c), "max": lambda c: F.max(c),
        "nulls": lambda c: F.count(F.lit(1)) - F.count(c),
    }
    wide = df.agg(*[f(col(c).cast("double")).alias(f"{c}|{name}") for c in columns for name, f in fields.items()])
    return _melt(wide, columns, list(fields), "feature")


def coverage(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Share of non-NULL values per column (percent), overall or per key."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(f"__{c}") for c in columns])
    rows = [F.struct(F.lit(c).alias("feature"), F.col(f"__{c}").alias("present"), share(f"__{c}", "rows").alias("coverage_pct")) for c in columns]
    return per_key.select(*keys, "rows", F.inline(F.array(*rows)))


def covered_columns(df: DataFrame, columns: Sequence[str], minimum_pct: float) -> list[str]:
    """Columns with at least the given coverage, from one aggregate row."""
    row = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.count(c).alias(c) for c in columns]).first()
    return [c for c in columns if row["__rows"] and 100.0 * row[c] / row["__rows"] >= minimum_pct]


def table_profile(df: DataFrame, *, key: str, date: str) -> DataFrame:
    """Rows, exact distinct keys and date range.  Keys are grouped before they are counted."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), F.min(date).alias("__lo"), F.max(date).alias("__hi"))
    return per_key.agg(
        F.sum("__n").alias("total_rows"), F.count(key).alias("distinct_keys"), F.min("__lo").alias("first_date"), F.max("__hi").alias("last_date")
    )


def segment_returns(df: DataFrame, *, segments: Mapping[str, Column], label: str, profit: str, minimum: int = 0) -> DataFrame:
    """Bets, win rate and ROI of overlapping segments.

    All segments are conditional sums of one aggregate, so rows are neither copied per segment nor
    shuffled; segments with no more than ``minimum`` bets are left out.
    """
    aggs = []
    for name, condition in segments.items():
        inside = F.when(condition, 1)
        aggs += [
            F.count(inside).alias(f"{name}|bets"),
            F.count(F.when(condition & (F.col(label) == 1), 1)).alias(f"{name}|wins"),
            F.sum(F.when(condition, F.col(profit))).alias(f"{name}|profit"),
        ]
    rows = _melt(df.agg(*aggs), list(segments), ["bets", "wins", "profit"], "segment")
    return rows.where(F.col("bets") > minimum).select(
        "segment", "bets", share("wins", "bets").alias("win_rate"), share("profit", "bets").alias("roi")
    )


def category_returns(df: DataFrame, *, category: str, label: str, profit: str, minimum: int) -> DataFrame:
    grouped = df.where(F.col(category).isNotNull()).groupBy(category).agg(
        F.count(F.lit(1)).alias("bets"), F.sum((F.col(label) == 1).cast("long")).alias("__wins"), F.sum(profit).alias("__profit")
    )
    return grouped.where(F.col("bets") >= minimum).select(
        category, "bets", share("__wins", "bets").alias("win_rate"), share("__profit", "bets").alias("roi")
    )


def top_report(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def marker_rates(df: DataFrame, *, score: str, label: str, thresholds: Sequence[float]) -> DataFrame:
    """Winners and win rate at or above each threshold; thresholds without a winner are left out."""
    aggs = []
    for t in thresholds:
        above = F.col(score) >= t
        aggs += [count_if(above).alias(f"{t}|rows"), count_if(above & (F.col(label) == 1)).alias(f"{t}|winners")]
    rows = _melt(df.agg(*aggs), [str(t) for t in thresholds], ["rows", "winners"], "threshold")
    return rows.where("winners > 0").select(
        F.col("threshold").cast("double").alias("threshold"), "winners", share("winners", "rows").alias("win_rate")
    )


def resolution_summary(df: DataFrame, *, source: str, raw: str, matched: str, ambiguous: str, match_type: str, samples: int = 5) -> DataFrame:
    """Per source: distinct names, matched, unmatched, ambiguous, counts per match type, a few unmatched samples."""
    names = df.select(source, raw, matched, ambiguous, match_type).distinct()
    per_type = names.groupBy(source, match_type).agg(
        F.count(F.lit(1)).alias("n"), count_if(F.col(matched)).alias("m"), count_if(F.col(ambiguous)).alias("a")
    )
    summary = per_type.groupBy(source).agg(
        F.sum("n").alias("distinct_names"),
        F.sum("m").alias("matched"),
        (F.sum("n") - F.sum("m")).alias("unmatched"),
        F.sum("a").alias("ambiguous"),
        F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", match_type, F.col("n").cast("string")))), ",").alias("by_type"),
    )
    shown = top_rows(names.where(~F.col(matched)), [source], [F.col(raw)], samples)
    shown = shown.groupBy(source).agg(F.array_join(F.sort_array(F.collect_list(raw)), "|").alias("unmatched_samples"))
    return join_on(summary, shown, [source], "left")


def rematch_rates(meetings: DataFrame, failures: DataFrame, *, pair: Sequence[str], date: str, success: Column) -> DataFrame:
    """Pairs with a failed prediction: later meetings and how many succeeded.

    The pair's latest failure decides, so each pair meets one date; later days are counted from per-day sums.
    """
    last = failures.groupBy(*pair).agg(F.max(date).alias("initial_fail_date"))
    by_day = meetings.groupBy(*pair, date).agg(F.count(F.lit(1)).alias("__n"), count_if(success).alias("__wins"))
    later = F.col(date) > F.col("initial_fail_date")
    return join_on(last, by_day, pair, "left").groupBy(*pair, "initial_fail_date").agg(
        F.coalesce(F.sum(F.when(later, F.col("__n"))), F.lit(0)).alias("future_matchups"),
        F.coalesce(F.sum(F.when(later, F.col("__wins"))), F.lit(0)).alias("revenge_wins"),
    ).withColumn("revenge_rate", F.coalesce(ratio("revenge_wins", "future_matchups"), num(0)))


def average_rematch_rate(rates: DataFrame, minimum: int) -> DataFrame:
    reliable = rates.where(F.col("future_matchups") >= minimum)
    return reliable.agg(F.count(F.lit(1)).alias("pairs"), F.avg("revenge_rate").alias("avg_revenge_rate"))


def date_coverage(df: DataFrame, *, date: str, entity: str, limit: int | None = None) -> DataFrame:
    """Dates with row and distinct-entity counts, newest first; ``limit`` dates where given."""
    per_entity = df.where(F.col(date).isNotNull()).groupBy(date, entity).agg(F.count(F.lit(1)).alias("__n"))
    per_date = per_entity.groupBy(date).agg(F.sum("__n").alias("total_rows"), F.count(entity).alias("distinct_entities"))
    newest = per_date.orderBy(F.col(date).desc())
    return newest if limit is None else newest.limit(limit)
