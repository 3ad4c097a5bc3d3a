"""Positions and running totals over a total order, without putting a group into one task.

A window partitioned by slate would sort the whole slate in one task.  Here the rows are range-partitioned
by the full order instead, so a group of any size (or one tied score) spreads over many partitions; only
one summary row per (group, partition) is combined, and that table is as small as the partition count.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from slatework.session import settle

_SLOT = (1 << 33) - 1


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join on same-named keys where NULL keys meet NULL keys; the right copies are dropped."""
    renamed = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    condition = [left[k].eqNullSafe(renamed[f"__{k}"]) for k in keys]
    return left.join(renamed, condition, how).drop(*[f"__{k}" for k in keys])


def _laid_out(df: DataFrame, groups: Sequence[str], order: Sequence[Column]) -> DataFrame:
    ordered = df.orderBy(*groups, *order).withColumn("__at", F.monotonically_increasing_id())
    return settle(ordered).withColumns(
        {"__part": F.shiftright("__at", 33), "__index": F.col("__at").bitwiseAND(F.lit(_SLOT))}
    )


def _pieces(laid: DataFrame, groups: Sequence[str], sums: Mapping[str, str | Column]) -> DataFrame:
    """Per (group, partition): first index, rows and sums, plus the totals of the group's earlier partitions."""
    names = ["__rows", *[f"__sum_{name}" for name in sums]]
    pieces = laid.groupBy(*groups, "__part").agg(
        F.min("__index").alias("__first"),
        F.count(F.lit(1)).alias("__rows"),
        *[F.sum(value).alias(f"__sum_{name}") for name, value in sums.items()],
    )
    before = Window.partitionBy(*groups).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    pieces = pieces.withColumns(
        {f"{n}_before": F.coalesce(F.sum(n).over(before), F.lit(0)) for n in names}
        | {"__group_rows": F.sum("__rows").over(whole)}
        | {f"__all_{name}": F.sum(f"__sum_{name}").over(whole) for name in sums}
    )
    return pieces.drop(*names)


def with_positions(df: DataFrame, groups: Sequence[str], order: Sequence[Column], position: str = "position", size: str = "group_rows", using: Sequence[str] | None = None) -> DataFrame:
    """0-based position of each row in its group and the group's row count.

    ``order`` should end in a unique key, which makes the positions reproducible and lets ties spread.  ``using`` names the
    columns that ``order`` reads: then those and the group are counted, sorted and written, and the positions joined back, so
    wide rows are shuffled once and never written.  Rows equal in all of them follow each other in any order.
    """
    narrow = None if using is None else list(dict.fromkeys([*groups, *using]))
    if narrow is None or set(df.columns) <= set(narrow):
        laid = _laid_out(df, groups, order)
        pieces = _pieces(laid, groups, {})
        joined = join_on(laid, pieces, [*groups, "__part"])
        return joined.select(
            *df.columns,
            (F.col("__rows_before") + F.col("__index") - F.col("__first")).alias(position),
            F.col("__group_rows").alias(size),
        )
    counts = df.groupBy(*narrow).agg(F.count(F.lit(1)).alias("__n"))
    places = settle(running_totals(counts, groups, order, {"n": "__n"}, "__before_", "__all_"))
    joined = join_on(df, places, narrow)
    named = [F.col("__before_n").alias(position), F.col("__all_n").alias(size)]
    if places.where("__n > 1").isEmpty():
        return joined.select(*df.columns, *named)
    # Repeated rows may be many: they are spread and numbered like any other group.
    again = with_positions(joined.where("__n > 1"), narrow, [F.col(c) for c in narrow], "__copy", "__copies")
    repeated = again.select(*df.columns, (F.col("__before_n") + F.col("__copy")).alias(position), F.col("__all_n").alias(size))
    return joined.where("__n = 1").select(*df.columns, *named).unionByName(repeated)


def running_totals(df: DataFrame, groups: Sequence[str], order: Sequence[Column], sums: Mapping[str, str], prefix: str = "before_", whole: str = "all_") -> DataFrame:
    """For each ``name: column`` in ``sums``: its sum over the group's earlier rows and over the whole group."""
    laid = _laid_out(df, groups, order)
    pieces = _pieces(laid, groups, sums)
    # One range partition at a time: no window partition is larger than a partition of the sorted data.
    inside = Window.partitionBy(*groups, "__part").orderBy("__index").rowsBetween(Window.unboundedPreceding, -1)
    laid = laid.withColumns({f"__in_{name}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for name, c in sums.items()})
    joined = join_on(laid, pieces, [*groups, "__part"])
    return joined.select(
        *df.columns,
        *[(F.col(f"__sum_{n}_before") + F.col(f"__in_{n}")).alias(f"{prefix}{n}") for n in sums],
        *[F.col(f"__all_{n}").alias(f"{whole}{n}") for n in sums],
    )


def top_rows(df: DataFrame, groups: Sequence[str], order: Sequence[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """First ``n`` rows per group.  Spark trims every map task to n rows per group before the shuffle."""
    name = rank or "__rank"
    kept = df.withColumn(name, F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col(name) <= n)
    return kept if rank else kept.drop(name)


def fractional_rank(df: DataFrame, groups: Sequence[str], value: str, name: str = "percentile_rank") -> DataFrame:
    """Percentile rank with ties averaged: mean 1-based rank of the equal values over the group's size."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("__ties"))
    ranked = running_totals(counts, groups, [F.col(value)], {"ties": "__ties"}, "__below_", "__of_")
    rank = (F.col("__below_ties") + (F.col("__ties") + 1) / F.lit(2.0)) / F.col("__of_ties")
    return join_on(df, ranked.select(*groups, value, rank.alias(name)), [*groups, value], "left")
