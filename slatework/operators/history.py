"""What was known about an entity before a date.

Everything here is first reduced to one row (or the last N games) per entity and calendar day, by partial
aggregation before the shuffle.  A window over an entity then holds at most its calendar days, however
many raw rows the entity has, and only earlier days can enter a row's features.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from slatework.functions.numeric import ratio, shrunk_rate
from slatework.operators.ordering import join_on, top_rows


def day_number(value: Column | str) -> Column:
    return F.datediff(value, F.lit("1970-01-01").cast("date"))


def _before(keys: Sequence[str], days: int | None):
    window = Window.partitionBy(*keys).orderBy("__day")
    return window.rangeBetween(Window.unboundedPreceding if days is None else -days, -1)


def prior_days(spine: DataFrame, history: DataFrame, *, keys: Sequence[str], date: str, **known) -> DataFrame:
    """Attach aggregates of ``history`` over the days before each spine date; ``known`` are the arguments of ``known_before``."""
    found = known_before(spine.select(*keys, date).distinct(), history, keys=keys, date=date, **known)
    return join_on(spine, found, [*keys, date], "left")


def known_before(
    asked: DataFrame,
    history: DataFrame,
    *,
    keys: Sequence[str],
    date: str,
    parts: Mapping[str, Column],
    result: Mapping[str, Column],
    days: int | None = None,
    last: Mapping[str, tuple[str, str]] | None = None,
    last_date: str | None = None,
) -> DataFrame:
    """Rows of ``asked`` with aggregates of ``history`` over the ``days`` days before their date (all earlier days if None).

    ``asked`` is read once and holds few rows per key and date: what it has beside ``keys`` and ``date`` is passed on.

    ``parts``   named per-day aggregates.  Names starting with ``max_`` / ``min_`` combine over days by
                max / min, all others by sum.
    ``result``  output columns as expressions over the combined parts.
    ``last``    ``out: (value, order)``: the value at the highest order of the latest day in the frame.
    ``last_date``  name for the latest day in the frame.
    """
    last = dict(last or {})
    carried = {f"__last_{out}": F.max_by(value, order) for out, (value, order) in last.items()}
    by_day = history.groupBy(*keys, date).agg(
        F.count(F.lit(1)).alias("__rows"),
        *[expr.alias(name) for name, expr in parts.items()],
        *[expr.alias(name) for name, expr in carried.items()],
    )
    days_seen = by_day.withColumn("__asked", F.lit(False)).unionByName(
        asked.withColumn("__asked", F.lit(True)), allowMissingColumns=True
    ).withColumn("__day", day_number(date))

    frame = _before(keys, days)

    def combined(name: str) -> Column:
        combine = F.max if name.startswith("max_") else F.min if name.startswith("min_") else F.sum
        return combine(name).over(frame)

    windowed = {name: combined(name) for name in ["__rows", *parts]}
    # A struct keeps "the latest day's value, even if NULL" apart from "no earlier day".
    windowed |= {
        name: F.last(F.when(~F.col("__asked"), F.struct(F.col(name).alias("v"))), ignorenulls=True).over(frame)["v"]
        for name in carried
    }
    windowed["__last_date"] = F.max(F.when(~F.col("__asked"), F.col(date))).over(frame)
    known = days_seen.withColumns(windowed).where("__asked")
    out = [expr.alias(name) for name, expr in result.items()]
    out += [F.col(f"__last_{name}").alias(name) for name in last]
    if last_date:
        out.append(F.col("__last_date").alias(last_date))
    return known.select(*asked.columns, *out)


def rows_seen() -> Column:
    """For ``prior_days`` results: number of history rows in the frame, 0 when none."""
    return F.coalesce(F.col("__rows"), F.lit(0)).cast("long")


def days_since(date: Column | str, earlier: Column | str) -> Column:
    return F.datediff(date, earlier)


def recent_form(
    spine: DataFrame,
    games: DataFrame,
    *,
    entity: Sequence[str],
    date: str,
    game: str,
    flags: Mapping[str, str],
    weight: str,
    windows: Sequence[int] = (3, 5, 10, 20),
    lookback: int = 20,
    strength: float = 20.0,
) -> DataFrame:
    """Form over the last N games and the season, strictly before each spine date.

    ``games`` has one row per entity and game, ``flags`` maps an output stem to a 0/1 column (never NULL),
    ``weight`` is the appearances of the game.  Adds, per stem and N, ``recent_<stem>_rate_g<N>``, with games and weight
    used; the same for ``lookback``; season rates and counts; days since the last game; the lookback rate
    shrunk towards the season rate and its difference from it.
    """
    suffixes = {f"g{n}": n for n in sorted(set(windows))} | {"lookback": lookback}
    values = [weight, *flags.values()]

    # Days: the season up to a date.  Games: the last N of every day are enough to find the last N overall.
    by_day = games.groupBy(*entity, date).agg(
        F.count(F.lit(1)).alias("__games"), *[F.sum(c).alias(f"__day_{c}") for c in values]
    )
    last_games = top_rows(games.select(*entity, date, game, *values), [*entity, date], [F.col(game).desc()], max(suffixes.values()))

    # The last N games as a difference of two running sums, so a game costs the same for every N.
    order = Window.partitionBy(*entity).orderBy(date, game)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    running = last_games.withColumns({"__k": F.row_number().over(order)} | {f"__upto_{c}": F.sum(c).over(upto) for c in values})

    def over_last(column: str, n: int) -> Column:
        return (F.col(f"__upto_{column}") - F.coalesce(F.lag(f"__upto_{column}", n).over(order), F.lit(0))).cast("double")

    form: dict[str, Column] = {}
    for suffix, n in suffixes.items():
        used = F.least(F.col("__k"), F.lit(n))
        form |= {f"recent_{stem}_rate_{suffix}": over_last(column, n) / used for stem, column in flags.items()}
        form |= {f"recent_games_used_{suffix}": used.cast("long"), f"recent_weight_used_{suffix}": over_last(weight, n)}
    after_game = running.select(*entity, date, game, F.struct(*[c.alias(n) for n, c in form.items()]).alias("__form"))

    asked = spine.select(*entity, date).distinct()
    stream = (
        asked.withColumn("__kind", F.lit(0))
        .unionByName(by_day.withColumn("__kind", F.lit(1)), allowMissingColumns=True)
        .unionByName(after_game.withColumn("__kind", F.lit(2)), allowMissingColumns=True)
    )
    # A date's question (kind 0) sorts before that date's own rows, so the frame below holds earlier days only.
    earlier = Window.partitionBy(*entity).orderBy(date, "__kind", game).rowsBetween(Window.unboundedPreceding, -1)
    known = stream.withColumns(
        {
            "__known": F.last("__form", ignorenulls=True).over(earlier),
            "__season_games": F.sum("__games").over(earlier),
            "__last_date": F.max(F.when(F.col("__kind") == 1, F.col(date))).over(earlier),
        }
        | {f"__season_{c}": F.sum(f"__day_{c}").over(earlier) for c in values}
    ).where("__kind = 0").select("*", "__known.*")
    known = known.withColumns(
        {f"season_{stem}_rate_to_date": ratio(f"__season_{c}", "__season_games") for stem, c in flags.items()}
        | {
            "season_games_prior": F.col("__season_games"),
            "season_weight_prior": F.col(f"__season_{weight}").cast("double"),
            "days_since_last_game": days_since(date, "__last_date"),
        }
    )
    known = known.withColumns(
        {
            f"shrunk_recent_{stem}_rate": shrunk_rate(
                f"recent_{stem}_rate_lookback", "recent_weight_used_lookback", f"season_{stem}_rate_to_date", strength
            )
            for stem in flags
        }
        | {
            f"recent_vs_season_{stem}_delta": F.col(f"recent_{stem}_rate_lookback") - F.col(f"season_{stem}_rate_to_date")
            for stem in flags
        }
    )
    # An entity without an earlier game has no form: NULL, not zero games.
    features = [c for c in known.columns if c.startswith(("recent_", "season_", "shrunk_", "days_since"))]
    return join_on(spine, known.select(*entity, date, *features), [*entity, date], "left")


def recent_form_on(games: DataFrame, on: Column, *, entity: Sequence[str], date: str, **options) -> DataFrame:
    """Form of every entity as of one date (serving): the training computation with a one-date spine."""
    spine = games.select(*entity).distinct().withColumn(date, on.cast("date"))
    return recent_form(spine, games.where(F.col(date) < on), entity=entity, date=date, **options)


def pair_history(
    spine: DataFrame,
    games: DataFrame,
    *,
    pair: Sequence[str],
    date: str,
    game: str,
    weight: str,
    counts: Mapping[str, str],
    same_day: bool = False,
    suffix: str = "vs_opponent",
    dealt: int | None = None,
) -> DataFrame:
    """Earlier meetings of a pair: games, weight, counts, rates per weight, last meeting's counts, days since.

    Strictly earlier dates by default.  With ``same_day`` an earlier game of the same day counts too (order
    by date, game), as for features built from an already ordered spine; ``spine`` must then be ``games``.
    NULL keys form their own pair.

    ``dealt`` is for ``spine`` being ``games`` and pairs of few games: the rows are dealt out by pair in so many parts and carry
    their history, so they are shuffled once and joined with nothing.
    """
    values = {weight: weight, **counts}
    parts = {f"day_{stem}": F.sum(c) for stem, c in values.items()}
    sums = {f"prior_{stem}_{suffix}": F.coalesce(F.col(f"day_{stem}"), F.lit(0)) for stem in values}
    result = {f"prior_games_{suffix}": rows_seen()} | sums
    last = {f"last_{stem}_{suffix}": (c, game) for stem, c in counts.items()}
    known = dict(keys=pair, date=date, parts=parts, result=result, last=last, last_date=f"last_date_{suffix}")
    if dealt:
        games = games.repartition(dealt, *pair)
        out = known_before(games, games, **known)
    else:
        out = prior_days(spine, games, **known)
    if same_day:
        today = Window.partitionBy(*pair, date).orderBy(game).rowsBetween(Window.unboundedPreceding, -1)
        previous = Window.partitionBy(*pair, date).orderBy(game)
        out = out.withColumns(
            {f"prior_games_{suffix}": F.col(f"prior_games_{suffix}") + F.count(F.lit(1)).over(today)}
            | {f"prior_{s}_{suffix}": F.col(f"prior_{s}_{suffix}") + F.coalesce(F.sum(c).over(today), F.lit(0)) for s, c in values.items()}
            | {f"last_{s}_{suffix}": F.when(F.count(F.lit(1)).over(today) > 0, F.lag(c).over(previous)).otherwise(F.col(f"last_{s}_{suffix}")) for s, c in counts.items()}
            | {f"last_date_{suffix}": F.when(F.count(F.lit(1)).over(today) > 0, F.col(date)).otherwise(F.col(f"last_date_{suffix}"))}
        )
    prior_weight = F.col(f"prior_{weight}_{suffix}")
    return out.withColumns(
        {f"prior_{stem}_rate_{suffix}": ratio(f"prior_{stem}_{suffix}", prior_weight) for stem in counts}
        | {
            f"prior_avg_{weight}_{suffix}": ratio(prior_weight, f"prior_games_{suffix}"),
            f"days_since_last_{suffix}": days_since(date, f"last_date_{suffix}"),
        }
    ).drop(f"last_date_{suffix}")


def pair_summary_on(games: DataFrame, on: Column, *, pair: Sequence[str], date: str, game: str, weight: str, counts: Mapping[str, str]) -> DataFrame:
    """One row per pair that met before ``on``: meetings, sums, rates, values at the last meeting, days since."""
    latest = F.struct(date, game)
    summary = games.where(F.col(date) < on).groupBy(*pair).agg(
        F.count(F.lit(1)).alias("prior_games"),
        F.sum(weight).alias("prior_weight"),
        *[F.sum(c).alias(f"prior_{stem}") for stem, c in counts.items()],
        *[F.max_by(c, latest).alias(f"last_{stem}") for stem, c in counts.items()],
        F.max(date).alias("__last"),
    )
    return summary.withColumns(
        {f"prior_{stem}_rate": ratio(f"prior_{stem}", "prior_weight") for stem in counts}
        | {"days_since_last": days_since(on, "__last")}
    ).drop("__last")


def neighbours(
    probes: DataFrame,
    observations: DataFrame,
    *,
    keys: Sequence[str],
    probe_time: str,
    time: str,
    values: Sequence[str],
    bucket_seconds: int = 600,
    strict: bool = True,
) -> DataFrame:
    """Attach the latest observation before each probe and the first one after, as structs ``previous`` and ``following``.

    Each struct has the observation's ``time`` and ``values``.  With ``strict`` an observation at the
    probe's own time is neither; otherwise it is the previous one.  Time is cut into buckets: rows are
    sorted within (key, bucket), and what lies outside a bucket comes from one summary row per bucket, so
    a key with most of the rows is sorted in as many tasks as it has buckets.
    """
    seen = F.struct(F.col(time).alias("time"), *values)
    marked = observations.select(*keys, F.col(time).alias("__ts"), seen.alias("__obs"))
    rows = marked.unionByName(probes.withColumn("__ts", F.col(probe_time)), allowMissingColumns=True)
    rows = rows.withColumn("__bucket", F.floor(F.unix_micros(F.col("__ts").cast("timestamp")) / F.lit(bucket_seconds * 1_000_000)))

    # No bucket's carried-in value needs more than its neighbours' first and last observations.
    tie = F.struct("__ts", "__obs")
    summary = rows.groupBy(*keys, "__bucket").agg(F.max(F.when(F.col("__obs").isNotNull(), tie)).alias("__hi"), F.min(F.when(F.col("__obs").isNotNull(), tie)).alias("__lo"))
    past = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    future = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(1, Window.unboundedFollowing)
    summary = summary.select(
        *keys,
        "__bucket",
        F.last("__hi", ignorenulls=True).over(past)["__obs"].alias("__from_past"),
        F.first("__lo", ignorenulls=True).over(future)["__obs"].alias("__from_future"),
    )
    # At equal times probes come first when strict (they may not see the observation), last otherwise.
    is_probe = F.col("__obs").isNull()
    side = F.when(is_probe, 0 if strict else 2).otherwise(1)
    inside = Window.partitionBy(*keys, "__bucket")
    backwards = F.when(is_probe, 0).otherwise(1)
    rows = rows.withColumns(
        {
            "__prev": F.last("__obs", ignorenulls=True).over(
                inside.orderBy("__ts", side, "__obs").rowsBetween(Window.unboundedPreceding, -1)
            ),
            "__next": F.last("__obs", ignorenulls=True).over(
                inside.orderBy(F.col("__ts").desc(), backwards, F.col("__obs").desc()).rowsBetween(Window.unboundedPreceding, -1)
            ),
        }
    )
    found = join_on(rows.where(is_probe), summary, [*keys, "__bucket"], "left")
    return found.select(
        *probes.columns,
        F.coalesce("__prev", "__from_past").alias("previous"),
        F.coalesce("__next", "__from_future").alias("following"),
    )


def asof(probes: DataFrame, observations: DataFrame, *, keys: Sequence[str], probe_time: str, time: str, values: Sequence[str], strict: bool = True, **options) -> DataFrame:
    """Left as-of join: the latest observation before (or, not strict, at) the probe time."""
    found = neighbours(probes, observations, keys=keys, probe_time=probe_time, time=time, values=values, strict=strict, **options)
    return found.select(
        *probes.columns, F.col("previous.time").alias(f"asof_{time}"), *[F.col(f"previous.{v}").alias(f"asof_{v}") for v in values]
    )


def nearest(probes: DataFrame, observations: DataFrame, *, keys: Sequence[str], probe_time: str, time: str, values: Sequence[str], **options) -> DataFrame:
    """The observation closest in time; of two equally close ones the earlier."""
    found = neighbours(probes, observations, keys=keys, probe_time=probe_time, time=time, values=values, strict=False, **options)

    def gap(side: str) -> Column:
        return F.abs(F.unix_micros(F.col(f"{side}.time").cast("timestamp")) - F.unix_micros(F.col(probe_time).cast("timestamp")))

    later = F.col("previous").isNull() | (gap("following") < gap("previous"))
    chosen = F.when(later & F.col("following").isNotNull(), F.col("following")).otherwise(F.col("previous"))
    found = found.withColumn("__near", chosen)
    return found.select(
        *probes.columns, F.col("__near.time").alias(f"nearest_{time}"), *[F.col(f"__near.{v}").alias(f"nearest_{v}") for v in values]
    )


def last_location(appearances: DataFrame, *, team: str, date: str, location: str) -> DataFrame:
    """Where each team was before its last stop of a day; its home (the team itself) before the first.

    One row per (team, day).  The previous stop is the day's second-last location, or the last one of the
    team's previous day, so only the two highest stops of a day are needed.
    """
    last_two = top_rows(appearances.select(team, date, location), [team, date], [F.col(location).desc()], 2, rank="__r")
    by_day = last_two.groupBy(team, date).agg(
        F.max(F.when(F.col("__r") == 1, F.col(location))).alias(location),
        F.max(F.when(F.col("__r") == 2, F.col(location))).alias("__second"),
    )
    day_before = F.lag(location).over(Window.partitionBy(team).orderBy(date))
    return by_day.select(
        team, date, location, F.coalesce("__second", day_before, F.col(team)).alias("previous_location")
    )


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Newest row per key."""
    return top_rows(df, keys, order, 1)
