"""Quality rules with robust multivariate outliers, in DataFrame operations only.

Counts of the whole text (words, their characters, symbols, repeated lines, words in repeated 3-word windows) give a
base rule and a vector of transformed statistics.  Per language and source, the mean and covariance of the vectors
are estimated by minimum covariance determinant: from two starts (quartiles; plain mean and covariance) concentration
steps keep the ``coverage`` share of documents nearest to the centre, and the start that ends with the smaller
determinant wins.  A step is one aggregation: rows are counted and summed per group and narrow bin of log distance,
and running sums over a group's few hundred bins give the kept share's moments.  So a group of any size is combined
before the shuffle.  Variances carry a floor (``TOLERANCE``), estimates of small groups are drawn towards their
language's by ``prior`` documents, and documents farther than the chi-square cut-off ``1 - tail`` are rejected.

NULL, empty and blank texts count no words and fail the base rule.  NULL languages and sources are groups of their
own.  Repeated rows count and are judged like all others.  An empty table gives an empty result.  Extra columns are
kept; those named like an added one are replaced by it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from slatework.llm.common import SPACE, free_of, masked, words_of, written
from slatework.operators.ordering import join_on

SYMBOLS = "#*$%&|<>"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
ADDED = [*STATS, "base_failed", "distance", "kept"]
#: Least standard deviation of each transformed statistic.
TOLERANCE = [0.5, 0.12, 0.08, 0.15, 0.15]
_P = len(TOLERANCE)
_PAIRS = [(i, j) for i in range(_P) for j in range(i + 1)]


def text_stats(docs: DataFrame, text: str = "text", hash_digits: int = 64) -> DataFrame:
    """``docs`` without the text column, with the counts in STATS, exact however few ``hash_digits`` a window's hash keeps."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACE))) > 0)
    base = docs.withColumns({
        "__words": words_of(F.col(text)),
        "__lines": lines,
        "word_chars": F.length(F.translate(whole, SPACE, "")).cast("long"),
        "n_symbols": (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long"),
    }).drop(text)
    base = base.withColumns({
        "n_words": F.size("__words").cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        # Binary digits that hold a word's position: the rest of 64 bits holds the window's hash.
        "__bits": F.greatest(F.length(F.bin(F.size("__words"))), F.lit(64 - hash_digits)),
    }).drop("__lines")
    word = lambda i: F.get("__words", i)
    key = lambda i: F.call_function("shiftleft", F.xxhash64(word(i), word(i + 1), word(i + 2)), F.col("__bits")).bitwiseOR(i.cast("long"))
    windows = F.when(F.col("n_words") >= 4, F.sort_array(F.transform(F.sequence(F.lit(0), F.size("__words") - 3), key)))
    base = base.withColumn("__windows", F.coalesce(windows, F.array().cast("array<bigint>")))
    hashed = lambda x: F.call_function("shiftright", x, F.col("__bits"))
    # Equal windows are neighbours in the sorted keys.  Different ones may share the digits that are left of a hash,
    # so the words of the windows found decide.
    meets = lambda x, i: hashed(x).eqNullSafe(hashed(F.get("__windows", i)))
    maybe = F.filter("__windows", lambda x, i: meets(x, i - 1) | meets(x, i + 1))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("__bits")) - 1
    base = base.withColumn("__maybe", F.transform(maybe, lambda x: x.bitwiseAND(mask))).drop("__windows")
    window = lambda x: F.concat_ws(" ", word(x.cast("int")), word(x.cast("int") + 1), word(x.cast("int") + 2))
    told = F.when(F.size("__maybe") > 0, F.sort_array(F.transform("__maybe", lambda x: F.struct(window(x).alias("w"), x.alias("at")))))
    base = base.withColumn("__told", told).drop("__words", "__maybe")
    same = lambda x, i: x["w"].eqNullSafe(F.get("__told", i)["w"])
    repeated = F.filter("__told", lambda x, i: same(x, i - 1) | same(x, i + 1))
    base = base.withColumn("__at", F.coalesce(F.sort_array(F.transform(repeated, lambda x: x["at"])), F.array().cast("array<bigint>"))).drop("__told")
    covered = F.aggregate(
        "__at",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("last")),
        lambda acc, x: F.struct((acc["n"] + F.least(F.lit(3).cast("long"), x - acc["last"])).alias("n"), x.alias("last")),
        lambda acc: acc["n"],
    )
    return base.withColumn("n_repeat_words", covered).drop("__at", "__bits")


def vector() -> list[Column]:
    """Transformed statistics of a document with words."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return [
        F.log(words + 1.0),
        F.log(chars / words),
        F.sqrt(F.col("n_symbols") / chars),
        F.sqrt(F.col("n_dup_lines") / words * 10.0),
        F.asin(F.sqrt(F.least(F.lit(1.0), F.col("n_repeat_words") / words))),
    ]


def chi_square_cut(p: int, share: float) -> float:
    """Quantile of the chi-square distribution, by bisection."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_share(p, middle) < share else (low, middle)
    return low


def chi_square_share(p: int, x: float) -> float:
    """Chi-square distribution function: the series of the lower incomplete gamma function."""
    a, h = p / 2, x / 2
    if h <= 0:
        return 0.0
    term = total = 1 / a
    for n in range(1, 2000):
        term *= h / (a + n)
        total += term
    return min(1.0, total * math.exp(a * math.log(h) - h - math.lgamma(a)))


def _moments() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n"),
        *[F.sum(f"x{i}").alias(f"s{i}") for i in range(_P)],
        *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i, j in _PAIRS],
    ]


_SUMS = ["n", *[f"s{i}" for i in range(_P)], *[f"q{i}{j}" for i, j in _PAIRS]]


def _shape(df: DataFrame) -> DataFrame:
    """From sums to mean m*, covariance c** with the floor added, and the inverse w** of its Cholesky factor."""
    df = df.withColumns({f"m{i}": F.col(f"s{i}") / F.col("n") for i in range(_P)})
    floor = lambda i, j: TOLERANCE[i] ** 2 if i == j else 0.0
    return _factor(df.withColumns({f"c{i}{j}": F.col(f"q{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}") + floor(i, j) for i, j in _PAIRS}))


def _factor(df: DataFrame) -> DataFrame:
    total = lambda terms: sum(terms, F.lit(0.0))
    for j in range(_P):
        inner = F.col(f"c{j}{j}") - total(F.col(f"l{j}{k}") * F.col(f"l{j}{k}") for k in range(j))
        df = df.withColumn(f"l{j}{j}", F.sqrt(F.greatest(inner, F.lit(TOLERANCE[j] ** 2 / 4))))
        df = df.withColumns({
            f"l{i}{j}": (F.col(f"c{i}{j}") - total(F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j))) / F.col(f"l{j}{j}")
            for i in range(j + 1, _P)
        }) if j + 1 < _P else df
    for j in range(_P):
        df = df.withColumn(f"w{j}{j}", 1 / F.col(f"l{j}{j}"))
        for i in range(j + 1, _P):
            df = df.withColumn(f"w{i}{j}", -total(F.col(f"l{i}{k}") * F.col(f"w{k}{j}") for k in range(j, i)) / F.col(f"l{i}{i}"))
    return df.withColumn("log_det", total(2 * F.log(F.col(f"l{i}{i}")) for i in range(_P)))


_SHAPE = [*[f"m{i}" for i in range(_P)], *[f"w{i}{j}" for i, j in _PAIRS]]


def _distance() -> Column:
    """Squared Mahalanobis distance of x* from m*."""
    away = [F.col(f"x{i}") - F.col(f"m{i}") for i in range(_P)]
    parts = [sum((F.col(f"w{i}{j}") * away[j] for j in range(i + 1)), F.lit(0.0)) for i in range(_P)]
    return sum((part * part for part in parts), F.lit(0.0))


def _starts(rows: DataFrame, groups: list[str]) -> DataFrame:
    """Two first shapes per group, with the sums' columns left out."""
    plain = _shape(rows.groupBy(*groups).agg(*_moments())).select(*groups, F.lit(0).alias("start"), *_SHAPE)
    cells = rows.select(*groups, F.posexplode(F.array(*[f"x{i}" for i in range(_P)])).alias("dim", "x"))
    cells = cells.groupBy(*groups, "dim", F.floor(F.col("x") * 64).alias("cell")).agg(F.count(F.lit(1)).alias("rows"))
    order = Window.partitionBy(*groups, "dim").orderBy("cell")
    cells = cells.withColumns({"upto": F.sum("rows").over(order), "all": F.sum("rows").over(Window.partitionBy(*groups, "dim"))})
    at = lambda share: F.min(F.when(F.col("upto") >= F.col("all") * share, F.col("cell"))) / 64.0
    quartiles = cells.groupBy(*groups, "dim").agg(at(0.5).alias("middle"), ((at(0.75) - at(0.25)) / 1.349).alias("spread"))
    wide = quartiles.groupBy(*groups).agg(
        *[F.max(F.when(F.col("dim") == i, F.col("middle"))).alias(f"m{i}") for i in range(_P)],
        *[F.max(F.when(F.col("dim") == i, F.col("spread"))).alias(f"d{i}") for i in range(_P)],
    )
    scaled = wide.select(
        *groups, F.lit(1).alias("start"), *[f"m{i}" for i in range(_P)],
        *[(1 / F.sqrt(F.col(f"d{i}") * F.col(f"d{i}") + TOLERANCE[i] ** 2) if i == j else F.lit(0.0)).alias(f"w{i}{j}") for i, j in _PAIRS],
    )
    return plain.unionByName(scaled)


def _concentrated(rows: DataFrame, shapes: DataFrame, groups: list[str], coverage: float) -> DataFrame:
    """Sums over the ``coverage`` share of each group's rows that are nearest to each start's centre."""
    near = join_on(rows, shapes, groups).withColumn("bin", F.floor(F.log(_distance() + 1e-9) * 16))
    bins = near.groupBy(*groups, "start", "bin").agg(*_moments())
    upto = Window.partitionBy(*groups, "start").orderBy("bin")
    whole = Window.partitionBy(*groups, "start")
    bins = bins.withColumns({"all": F.sum("n").over(whole), "before": F.coalesce(F.sum("n").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    kept = bins.where(F.col("before") < F.col("all") * coverage)
    return kept.groupBy(*groups, "start").agg(*[F.sum(c).alias(c) for c in _SUMS])


def estimate(rows: DataFrame, groups: Sequence[str], *, broad: Sequence[str], coverage: float = 0.6, steps: int = 4, prior: float = 40.0) -> DataFrame:
    """Per group the minimum-covariance-determinant mean and inverse factor, drawn towards the broad group's."""
    groups, broad = list(groups), list(broad)
    shapes = written(_starts(rows, groups))
    for _ in range(steps):
        ended = written(_concentrated(rows, shapes, groups, coverage))
        shapes = written(_shape(ended).select(*groups, "start", *_SHAPE, "log_det"))
    best = Window.partitionBy(*groups).orderBy("log_det", "start")
    first = shapes.withColumn("place", F.row_number().over(best)).where("place = 1").select(*groups, "start")
    sums = join_on(ended, first, [*groups, "start"]).drop("start")
    own = sums.withColumns({f"m{i}": F.col(f"s{i}") / F.col("n") for i in range(_P)}).withColumns(
        {f"v{i}{j}": F.col(f"q{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}") for i, j in _PAIRS}
    )
    pooled = own.groupBy(*broad).agg(
        *[(F.sum(f"s{i}") / F.sum("n")).alias(f"bm{i}") for i in range(_P)],
        *[(F.sum(F.col("n") * F.col(f"v{i}{j}")) / F.sum("n")).alias(f"bv{i}{j}") for i, j in _PAIRS],
    )
    n = F.col("n")
    drawn = lambda a, b: (n * F.col(a) + prior * F.col(b)) / (n + prior)
    # A normal sample cut to its nearest share has a smaller covariance by this factor.
    factor = coverage / chi_square_share(_P + 2, chi_square_cut(_P, coverage))
    both = join_on(own, pooled, broad).select(
        *groups, *[drawn(f"m{i}", f"bm{i}").alias(f"m{i}") for i in range(_P)],
        *[(drawn(f"v{i}{j}", f"bv{i}{j}") * factor + (TOLERANCE[i] ** 2 if i == j else 0.0)).alias(f"c{i}{j}") for i, j in _PAIRS],
    )
    return _factor(both).select(*groups, *_SHAPE)


def judge(docs: DataFrame, *, text: str = "text", groups: Sequence[str] = ("lang", "source"), broad: Sequence[str] = ("lang",), tail: float = 0.01, coverage: float = 0.6, steps: int = 4) -> DataFrame:
    """``docs`` without the text, with STATS, ``base_failed``, ``distance`` (squared; NULL where the base failed), ``kept``."""
    original = docs.columns
    docs, names = masked(docs)
    text, groups, broad = names[text], [names[g] for g in groups], [names[b] for b in broad]
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = written(text_stats(docs, text).withColumn("base_failed", failed).withColumns({f"x{i}": v for i, v in enumerate(vector())}))
    fitted = written(estimate(stats.where(~F.col("base_failed")), groups, broad=broad, coverage=coverage, steps=steps))
    judged = join_on(stats, fitted, groups, "left")
    distance = F.when(~F.col("base_failed"), _distance())
    kept = ~F.col("base_failed") & (distance <= chi_square_cut(_P, 1 - tail))
    rest = [F.col(names[c]).alias(c) for c in free_of(original, ADDED) if names[c] != text]
    return judged.select(*rest, *STATS, "base_failed", distance.alias("distance"), kept.alias("kept"))
