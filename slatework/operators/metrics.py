"""Exact evaluation metrics as aggregates.

Rank-based metrics first collapse rows to distinct scores; cut-off metrics collapse to the few intervals
between cut-offs.  Nothing is evaluated row by row against every threshold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from slatework.functions.numeric import num, ratio, share
from slatework.operators.ordering import running_totals


def _scores(df: DataFrame, groups: Sequence[str], label: str, score: str) -> DataFrame:
    return df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(*groups, score).agg(
        F.sum(F.col(label).cast("long")).alias("__pos"), F.count(F.lit(1)).alias("__n")
    ).withColumn("__neg", F.col("__n") - F.col("__pos"))


def ranking_metrics(df: DataFrame, *, label: str, score: str, groups: Sequence[str] = ()) -> DataFrame:
    """ROC AUC (ties count half), average precision and Brier score; NULL where only one class occurs."""
    totals = running_totals(_scores(df, groups, label, score), groups, [F.col(score)], {"pos": "__pos", "neg": "__neg"})
    # Going down the scores: positives and rows at or above this one.
    above_pos = F.col("all_pos") - F.col("before_pos")
    above_all = above_pos + F.col("all_neg") - F.col("before_neg")
    p, n = F.max("all_pos"), F.max("all_neg")
    both = (p > 0) & (n > 0)
    auc = ratio(F.sum(F.col("__pos") * (F.col("before_neg") + F.col("__neg") / num(2))), p * n)
    precision = ratio(F.sum(F.col("__pos") * ratio(above_pos, above_all)), p)
    squared = F.sum(F.col("__pos") * F.pow(num(1) - F.col(score), num(2)) + F.col("__neg") * F.pow(F.col(score), num(2)))
    return totals.groupBy(*groups).agg(
        (p + n).alias("rows"),
        p.alias("positives"),
        F.when(both, auc).alias("roc_auc"),
        F.when(both, precision).alias("average_precision"),
        F.when(both, ratio(squared, p + n)).alias("brier_score"),
    )


def _confusion(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    return {
        "accuracy": ratio(tp + tn, tp + fp + fn + tn),
        "precision": F.coalesce(ratio(tp, tp + fp), num(0)),
        "recall": F.coalesce(ratio(tp, tp + fn), num(0)),
        "f1": F.coalesce(ratio(tp * 2, tp * 2 + fp + fn), num(0)),
    }


def confusion_metrics(df: DataFrame, *, label: str, score: str, cut: float = 0.5, groups: Sequence[str] = ()) -> DataFrame:
    """Confusion counts, accuracy, precision, recall, F1 at ``score >= cut``, and log loss (scores clipped at 1e-15)."""
    y, hit = F.col(label) == 1, F.col(score) >= cut
    p = F.least(F.greatest(F.col(score), num(1e-15)), num(1 - 1e-15))
    counts = df.groupBy(*groups).agg(
        F.count(F.when(hit & y, 1)).alias("tp"),
        F.count(F.when(hit & ~y, 1)).alias("fp"),
        F.count(F.when(~hit & y, 1)).alias("fn"),
        F.count(F.when(~hit & ~y, 1)).alias("tn"),
        F.avg(-F.when(y, F.log(p)).otherwise(F.log(num(1) - p))).alias("log_loss"),
    )
    return counts.withColumns(_confusion(*[F.col(c) for c in ("tp", "fp", "fn", "tn")]))


def cuts_passed(score: Column | str, cuts: Sequence[float], inclusive: bool = True) -> Column:
    """How many of the ascending cut-offs a score reaches (or exceeds): a binary search of plain comparisons."""
    score = F.col(score) if isinstance(score, str) else score
    cuts = sorted(cuts)

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        reached = score >= num(cuts[middle]) if inclusive else score > num(cuts[middle])
        return F.when(reached, search(middle + 1, high)).otherwise(search(low, middle))

    return search(0, len(cuts))


def cut_table(df: DataFrame, *, label: str, score: str, cuts: Sequence[float], inclusive: bool) -> DataFrame:
    """Rows and positives at or above (or, not inclusive, strictly above) each cut-off.

    A row is counted once, under the number of cut-offs it passes; the per-cut counts are suffix sums over
    at most ``len(cuts) + 1`` rows.
    """
    cuts = sorted(cuts)
    limits = F.array(*[num(c) for c in cuts])
    passed = cuts_passed(score, cuts, inclusive)
    cells = df.withColumn("__passed", passed).groupBy("__passed").agg(
        F.count(F.lit(1)).alias("__n"), F.sum(F.col(label).cast("long")).alias("__pos")
    )
    grid = df.sparkSession.range(len(cuts) + 1).select(F.col("id").cast("int").alias("__passed"))
    upwards = Window.orderBy(F.col("__passed").desc()).rowsBetween(Window.unboundedPreceding, 0)
    cells = grid.join(cells, "__passed", "left").withColumns(
        {
            "predicted": F.coalesce(F.sum("__n").over(upwards), F.lit(0)),
            "true_positive": F.coalesce(F.sum("__pos").over(upwards), F.lit(0)),
            "rows": F.coalesce(F.sum("__n").over(Window.partitionBy()), F.lit(0)),
            "positives": F.coalesce(F.sum("__pos").over(Window.partitionBy()), F.lit(0)),
        }
    )
    return cells.where("__passed > 0").select(
        F.element_at(limits, F.col("__passed")).alias("threshold"), "predicted", "true_positive", "rows", "positives"
    )


def best_f1(df: DataFrame, *, label: str, score: str, cuts: Sequence[float]) -> DataFrame:
    """The cut-off with the highest F1 at ``score > cut``, the lowest of equal ones."""
    table = cut_table(df, label=label, score=score, cuts=cuts, inclusive=False)
    tp, fp = F.col("true_positive"), F.col("predicted") - F.col("true_positive")
    fn = F.col("positives") - F.col("true_positive")
    table = table.withColumns({"precision": F.coalesce(ratio(tp, tp + fp), num(0)), "recall": F.coalesce(ratio(tp, tp + fn), num(0)), "f1": F.coalesce(ratio(tp * 2, tp * 2 + fp + fn), num(0))})
    return table.orderBy(F.col("f1").desc(), "threshold").limit(1).select("threshold", "precision", "recall", "f1")


def compare_scores(df: DataFrame, *, label: str, scores: tuple[str, str], cuts: Sequence[float]) -> DataFrame:
    """Predictions and hit rate (percent) of two scores at each cut-off, and the first one's improvement."""
    first, second = (
        cut_table(df, label=label, score=s, cuts=cuts, inclusive=True).select(
            "threshold", F.col("predicted").alias(f"{s}_predictions"), share("true_positive", "predicted").alias(f"{s}_hit_rate")
        )
        for s in scores
    )
    return first.join(second, "threshold").withColumn("improvement", F.col(f"{scores[0]}_hit_rate") - F.col(f"{scores[1]}_hit_rate"))


def equal_width_bin(score: Column | str, bins: int = 10) -> Column:
    """0-based bin of a probability among equal-width bins, edges at i / bins, the last one closed."""
    return cuts_passed(score, [i * (1.0 / bins) for i in range(1, bins)])


def calibration_bins(df: DataFrame, *, label: str, score: str, bins: int = 10, groups: Sequence[str] = ()) -> DataFrame:
    binned = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).withColumn("bin", equal_width_bin(score, bins))
    return binned.groupBy(*groups, "bin").agg(
        F.count(F.lit(1)).alias("rows"), F.avg(score).alias("predicted"), F.avg(F.col(label).cast("double")).alias("actual")
    )


def calibration_summary(df: DataFrame, *, label: str, score: str, bins: int = 10, groups: Sequence[str] = ()) -> DataFrame:
    """Rows, expected calibration error, mean probability and actual rate, as percentages."""
    cells = calibration_bins(df, label=label, score=score, bins=bins, groups=groups)
    rows = F.sum("rows")
    return cells.groupBy(*groups).agg(
        rows.alias("rows"),
        (ratio(F.sum(F.abs(F.col("predicted") - F.col("actual")) * F.col("rows")), rows) * num(100)).alias("ece_pct"),
        (ratio(F.sum(F.col("predicted") * F.col("rows")), rows) * num(100)).alias("avg_probability_pct"),
        (ratio(F.sum(F.col("actual") * F.col("rows")), rows) * num(100)).alias("actual_rate_pct"),
    )


def percentile_points(df: DataFrame, score: str, points: Sequence[float], groups: Sequence[str] = ()) -> DataFrame:
    """Exact percentiles with linear interpolation, one row per group and point.

    Scores are counted before they are ordered, and only the two order statistics around each point are
    kept, so no task holds all scores.
    """
    counts = df.where(F.col(score).isNotNull()).groupBy(*groups, F.col(score).cast("double").alias("__s")).agg(F.count(F.lit(1)).alias("__n"))
    placed = running_totals(counts, groups, [F.col("__s")], {"n": "__n"})
    wanted = F.explode(F.array(*[num(p) for p in points])).alias("point")
    spot = (F.col("all_n") - 1) * F.col("point")
    low, high = F.floor(spot), F.ceil(spot)

    def holds(at: Column) -> Column:
        return (F.col("before_n") <= at) & (at < F.col("before_n") + F.col("__n"))

    near = placed.select(*groups, "__s", "__n", "before_n", "all_n", wanted).where(holds(low) | holds(high))
    ends = near.groupBy(*groups, "point").agg(
        F.max(F.when(holds(low), F.col("__s"))).alias("__lo"), F.max(F.when(holds(high), F.col("__s"))).alias("__hi"), F.max(spot - low).alias("__w")
    )
    return ends.select(*groups, "point", (F.col("__lo") + (F.col("__hi") - F.col("__lo")) * F.col("__w")).alias("threshold"))


# Percentile each signal tier starts at.
TIER_POINTS = {"STRONG_BUY": 0.90, "BUY": 0.75, "MODERATE": 0.50, "AVOID": 0.25}


def tier_thresholds(df: DataFrame, score: str, groups: Sequence[str] = ()) -> DataFrame:
    """One row (per group) with the score each tier starts at."""
    rows = percentile_points(df, score, list(TIER_POINTS.values()), groups)
    return rows.groupBy(*groups).agg(*[F.max(F.when(F.col("point") == p, F.col("threshold"))).alias(t) for t, p in TIER_POINTS.items()])


def tier_summary(df: DataFrame, *, label: str, score: str, thresholds: dict[str, float] | None = None) -> DataFrame:
    """Rows, positives, hit rate and mean score of each tier.

    The four thresholds are one small row; they are read once and become constants of a single aggregate.
    """
    cuts = thresholds or tier_thresholds(df, score).first().asDict()
    if any(v is None for v in cuts.values()):
        cuts = dict.fromkeys(cuts, float("inf"))
    tiers, chain = list(TIER_POINTS), F
    for t in tiers:
        chain = chain.when(F.col(score) >= num(cuts[t]), F.lit(t))
    grouped = df.where(F.col(score).isNotNull()).withColumn("tier", chain.otherwise(F.lit("STRONG_SELL"))).groupBy("tier").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col(label).cast("long")).alias("positive_count"), F.avg(F.col(label).cast("double")).alias("hit_rate"), F.avg(score).alias("avg_score")
    )
    return grouped.select("tier", "rows", "positive_count", "hit_rate", "avg_score")


def quantile_calibration(df: DataFrame, *, label: str, score: str, bins: int = 10) -> DataFrame:
    """Calibration over bins cut at the score percentiles; a score on an inner edge belongs to the bin below it.

    The edges are ``bins - 1`` numbers; they are read once and become constants of a single aggregate.
    """
    points = [i / bins for i in range(1, bins)]
    edges = [r["threshold"] for r in percentile_points(df, score, points).collect()]
    binned = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).withColumn("bin", cuts_passed(score, edges, inclusive=False))
    cells = binned.groupBy("bin").agg(
        F.count(F.lit(1)).alias("rows"), F.avg(score).alias("predicted"), F.avg(F.col(label).cast("double")).alias("actual")
    )
    return cells.withColumn("gap", F.abs(F.col("predicted") - F.col("actual")))


def mean_calibration_error(bins: DataFrame) -> DataFrame:
    """Unweighted mean gap over the bins that hold rows."""
    return bins.agg(F.count(F.lit(1)).alias("bins"), F.avg("gap").alias("mean_calibration_error"))
