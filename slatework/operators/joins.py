"""Joins by priority, by either side, by sequence and by containment, all as hash-partitionable equi joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from slatework.operators.ordering import join_on, top_rows, with_positions


def lookup_first(df: DataFrame, table: DataFrame, *, on: Sequence[str], order: Sequence[Column], defaults: Mapping[str, object] | None = None) -> DataFrame:
    """Left join to the first table row per key, in an explicit order; unmatched rows take the defaults."""
    joined = df.join(top_rows(table, on, order), list(on), "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in (defaults or {}).items()})


def either_order_join(left: DataFrame, right: DataFrame, *, left_pair: tuple[Column, Column], right_pair: tuple[str, str], on: Sequence[str] = (), how: str = "left", first: Sequence[Column] | None = None) -> DataFrame:
    """Join where the left pair equals the right pair in either order.

    'A @ B' or 'B @ A' is one equality once both sides are sorted, so the OR needs no nested loop.  With ``first``, an order,
    a pair meets only its first right row, chosen before the join.
    """
    a, b = left_pair
    c, d = (F.col(x) for x in right_pair)
    keyed = left.withColumns({"__lo": F.least(a, b), "__hi": F.greatest(a, b)})
    other = right.withColumns({"__lo": F.least(c, d), "__hi": F.greatest(c, d)})
    # least/greatest skip NULLs; a pair with a NULL side must not match.
    keyed = keyed.withColumn("__lo", F.when(a.isNotNull() & b.isNotNull(), F.col("__lo")))
    other = other.where(c.isNotNull() & d.isNotNull())
    if first is not None:
        other = top_rows(other, [*on, "__lo", "__hi"], first)
    return keyed.join(other, [*on, "__lo", "__hi"], how).drop("__lo", "__hi")


def split_matchup(value: Column | str, separator: str = " @ ") -> tuple[Column, Column]:
    """The two sides of an 'A @ B' label."""
    parts = F.split(F.col(value) if isinstance(value, str) else value, separator)
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


def sides(games: DataFrame, *, home: str, away: str, team: str = "team", opponent: str = "opponent", is_home: str = "is_home") -> DataFrame:
    """Game row -> one row per side."""
    both = F.array(
        F.struct(F.col(home).alias(team), F.col(away).alias(opponent), F.lit(True).alias(is_home)),
        F.struct(F.col(away).alias(team), F.col(home).alias(opponent), F.lit(False).alias(is_home)),
    )
    keep = [c for c in games.columns if c not in (team, opponent, is_home)]
    return games.select(*keep, F.inline(both))


def either_side_join(rows: DataFrame, games: DataFrame, *, team: str, home: str, away: str, on: Sequence[str], how: str = "left", first: Sequence[Column] | None = None) -> DataFrame:
    """Join a team's rows to games where it is either side: each game offers one key per distinct side.

    With ``first``, an order, a side meets only its first game, chosen before the join.
    """
    offered = games.withColumn("__side", F.explode(F.array_distinct(F.array(home, away))))
    if first is not None:
        offered = top_rows(offered, [*on, "__side"], first)
    return rows.withColumn("__side", F.col(team)).join(offered, [*on, "__side"], how).drop("__side")


def sequence_join(left: DataFrame, right: DataFrame, *, on: Sequence[str], left_order: str, right_order: str, how: str = "left") -> DataFrame:
    """Pair the i-th left row with the i-th right row of each key (double-headers).

    Rows are numbered over range-partitioned data, so a key of any size spreads over many tasks.
    """
    numbered = lambda df, order: with_positions(df, on, [F.col(order)], "__at", "__of").withColumn("sequence", (F.col("__at") + 1).cast("int")).drop("__at", "__of")
    return numbered(left, left_order).join(numbered(right, right_order), [*on, "sequence"], how)


def priority_join(df: DataFrame, specific: DataFrame, general: DataFrame, *, on: Sequence[str], fallback_on: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Values by the full key, and only where the full key has no row at all, by the shorter key.

    Both tables must have one row per key.  The values travel as one struct, so a matched row with NULL
    values is not overwritten field by field.
    """
    pack = F.struct(*values)
    first = specific.select(*on, pack.alias("__specific"))
    second = general.select(*fallback_on, pack.alias("__general"))
    joined = df.join(first, list(on), "left").join(second, list(fallback_on), "left")
    return joined.withColumn("__v", F.coalesce("__specific", "__general")).select(*df.columns, "__v.*")


def cascade_join(df: DataFrame, table: DataFrame, *, group: Sequence[str], keys: Sequence[tuple[str, bool]], order: Sequence[Column], values: Sequence[str]) -> DataFrame:
    """Try key after key (each within ``group``): values come from the first key that finds a row.

    A key flagged unique only counts where a single table row carries it (a shared surname decides nothing).
    """
    found = []
    joined = df
    for i, (key, unique) in enumerate(keys):
        # Two rows per key tell whether it is unique; no key is ever gathered whole.
        ranked = top_rows(table, [*group, key], order, 2, rank="__r")
        per_key = ranked.groupBy(*group, key).agg(
            F.max(F.when(F.col("__r") == 1, F.struct(*values))).alias(f"__v{i}"), F.count(F.lit(1)).alias("__n")
        )
        if unique:
            per_key = per_key.where("__n = 1")
        joined = joined.join(per_key.drop("__n"), [*group, key], "left")
        found.append(F.col(f"__v{i}"))
    return joined.withColumn("__v", F.coalesce(*found)).select(*df.columns, "__v.*")


def unmatched_count(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """How many left rows have no partner."""
    return left.join(right.select(*on).distinct(), list(on), "left_anti").agg(F.count(F.lit(1)).alias("unmatched"))


def words(text: Column | str) -> Column:
    """Lower-case words of a text, punctuation removed."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def mentions(texts: DataFrame, names: DataFrame, *, text: str, name: str) -> DataFrame:
    """Distinct (text row, name) pairs where the name stands in the text as a run of whole words.

    Instead of testing every name against every text, each text is turned into its distinct word runs of
    the word counts that the names have and equi-joined.  The runs are de-duplicated within the row, and
    those whose first word begins no name go before anything is shuffled, where the first words are few
    enough for the planner to send them to all tasks.
    """
    listed = names.select(F.array_join(words(name), " ").alias("__run"), name).where("__run <> ''").distinct()
    # The word counts of names: a handful of numbers.
    lengths = sorted(r[0] for r in listed.select(F.size(F.split("__run", " "))).distinct().collect())
    first = F.substring_index("__run", " ", 1)
    begins = listed.select(first.alias("__first")).distinct()
    tokens = words(text)

    def runs(n: int) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(tokens) - n, F.lit(0)))
        cut = F.transform(starts, lambda i: F.array_join(F.slice(tokens, i + 1, n), " "))
        return tokens if n == 1 else F.when(F.size(tokens) >= n, cut).otherwise(F.array().cast("array<string>"))

    if not lengths:
        lengths = [1]
    every = F.array_distinct(F.flatten(F.array(*[runs(n) for n in lengths])))
    other = [c for c in texts.columns if c != text]
    found = texts.select(*other, F.explode(every).alias("__run")).withColumn("__first", first).join(begins, "__first", "left_semi")
    return found.join(listed, "__run").select(*other, name)


def distinct_overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Sizes of two sets of names and of their overlap."""
    tagged = left.select(F.col(key).alias("k"), F.lit(1).alias("side")).unionByName(
        right.select(F.col(key).alias("k"), F.lit(2).alias("side"))
    )
    per_key = tagged.where("k is not null").groupBy("k").agg(F.bit_or("side").alias("sides"))
    return per_key.agg(
        F.count(F.when(F.col("sides").isin(1, 3), 1)).alias("left_distinct"),
        F.count(F.when(F.col("sides").isin(2, 3), 1)).alias("right_distinct"),
        F.count(F.when(F.col("sides") == 3, 1)).alias("shared"),
    )
