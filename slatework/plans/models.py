"""Training and scoring with Spark ML: imputed, class-weighted base learners and a logistic stack."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import partial

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Row, functions as F

from slatework.functions.numeric import half_even, logistic, num
from slatework.operators import metrics, splits
from slatework.operators.aggregates import covered_columns
from slatework.operators.ordering import running_totals
from slatework.session import settle, together

BASES = ("boost", "forest")

# Columns that describe the game being predicted, never features.
SAME_GAME = {
    "hr_count", "hit_count", "so_count", "pa_count", "label", "label_hit", "label_so", "confidence_score", "odds_decimal",
    "actual_strikeouts", "actual_innings_pitched", "game_id", "pick_id", "lineup_game_id",
}

# Feature-name fragments a target leaves out.
TARGET_GATES = {"hr": ("_hit_", "_so_"), "hit": ("_hr_",), "so": ()}


@dataclass(frozen=True)
class Settings:
    depth: int = 4
    step: float = 0.03
    rounds: int = 100
    trees: int = 50
    folds: int = 5
    holdout: float = 0.2
    tail: float = 0.15
    seed: int = 42
    #: Fits that may run at the same time: one tree level is a short job, so a single fit leaves a cluster idle.
    parallel: int = 8


@dataclass(frozen=True)
class Stack:
    """Fitted base models and meta model."""

    features: list[str]
    label: str
    bases: Mapping[str, "Scorer"]
    meta: "Scorer"
    fold_metrics: list[Row] = field(default_factory=list)

    def transform(self, df: DataFrame, name: str = "proba") -> DataFrame:
        """Append the stacked probability (and each base model's) to the rows."""
        for base, model in self.bases.items():
            df = model.transform(df, base)
        return self.meta.transform(df, name)


@dataclass(frozen=True)
class Linear:
    """A logistic score by its numbers: coefficients in feature order, intercept and what missing values read as."""

    features: Sequence[str]
    coefficients: Sequence[float]
    intercept: float
    medians: Mapping[str, float]

    def shifts(self) -> list[Column]:
        """Per feature: coefficient x (value - median)."""
        read = lambda f: F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")), num(self.medians[f]))
        return [num(w) * (read(f) - num(self.medians[f])) for f, w in zip(self.features, self.coefficients)]

    def base(self) -> float:
        """The margin of a row whose features are all at their medians."""
        return float(self.intercept + sum(w * self.medians[f] for f, w in zip(self.features, self.coefficients)))

    def margin(self) -> Column:
        """The log odds: equal features have equal margins, to the last bit."""
        shifts = self.shifts()
        return num(self.base()) + sum(shifts[1:], shifts[0])

    def transform(self, df: DataFrame, name: str = "proba") -> DataFrame:
        return df.withColumn(name, logistic(self.margin()))


@dataclass(frozen=True)
class Scorer:
    """A fitted pipeline, or a constant where training had one class only."""

    model: PipelineModel | None
    constant: float = 0.0
    medians: Mapping[str, float] = field(default_factory=dict)

    def linear(self, features: Sequence[str]) -> Linear:
        """The numbers of a logistic model; a constant score has coefficients 0."""
        if self.model is None:
            margin = math.log(max(self.constant, 1e-12) / max(1 - self.constant, 1e-12))
            return Linear(features, [0.0] * len(features), margin, dict.fromkeys(features, 0.0))
        last = self.model.stages[-1]
        return Linear(features, last.coefficients.toArray().tolist(), float(last.intercept), self.medians)

    def transform(self, df: DataFrame, name: str) -> DataFrame:
        if self.model is None:
            return df.withColumn(name, num(self.constant))
        scored = self.model.transform(df)
        return scored.select(*df.columns, vector_to_array("probability")[1].alias(name))


def feature_columns(df: DataFrame, *, label: str, target: str | None = None, exclude: Sequence[str] = ()) -> list[str]:
    """Numeric columns that are not labels, ids or same-game outcomes, minus the target's gated ones."""
    gates = TARGET_GATES.get(target or "", ())
    numeric = ("int", "bigint", "double", "float", "smallint", "tinyint")
    return [
        c for c, kind in df.dtypes
        if (kind in numeric or kind.startswith("decimal")) and c != label and c not in SAME_GAME and c not in exclude
        and not c.startswith("label_") and not any(g in f"_{c}_" for g in gates)
    ]


def with_weight(df: DataFrame, label: str, name: str = "__weight") -> DataFrame:
    """Positives weighted negatives / positives, from one aggregate row."""
    row = df.agg(F.sum(F.col(label).cast("long")).alias("p"), F.count(F.lit(1)).alias("n")).first()
    positives, rows = row["p"] or 0, row["n"]
    weight = (rows - positives) / positives if positives else 1.0
    return df.withColumn(name, F.when(F.col(label) == 1, num(weight or 1.0)).otherwise(num(1)))


def grouped_medians(df: DataFrame, features: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """(groups, feature, median) for many features and groups in one pass.

    Values are counted per group before they are ordered, so a group or a value with most of the rows is one count.
    NULL and NaN do not enter; a group without any value of a feature has no row.
    """
    pairs = F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in features]))
    keys = [*groups, "feature"]
    counts = df.select(*groups, pairs).where(F.col("v").isNotNull() & ~F.isnan("v")).groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("n"))
    placed = running_totals(counts, keys, [F.col("v")], {"n": "n"})
    spot = (F.col("all_n") - 1) * F.lit(0.5)
    holds = lambda at: (F.col("before_n") <= at) & (at < F.col("before_n") + F.col("n"))
    low, high = holds(F.floor(spot)), holds(F.ceil(spot))
    return placed.where(low | high).groupBy(*keys).agg(((F.max(F.when(low, F.col("v"))) + F.max(F.when(high, F.col("v")))) / 2).alias("median"))


def exact_medians(df: DataFrame, features: Sequence[str]) -> dict[str, float]:
    """Median per feature; 0 where a feature has no value."""
    return dict.fromkeys(features, 0.0) | {r["feature"]: float(r["median"]) for r in grouped_medians(df, features).collect()}


def medians_of_sets(df: DataFrame, features: Sequence[str], sets: Mapping[object, Column]) -> dict[object, dict[str, float]]:
    """``exact_medians`` of several, overlapping sets of the rows (a condition each) in one pass: values are counted once, by set, and put in order once."""
    held = [F.coalesce(chosen, F.lit(False)).cast("int").alias(f"__n{i}") for i, chosen in enumerate(sets.values())]
    pairs = F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in features]))
    names = [f"__n{i}" for i in range(len(sets))]
    counts = df.select(*held, pairs).where(F.col("v").isNotNull() & ~F.isnan("v")).groupBy("feature", "v").agg(*[F.sum(n).alias(n) for n in names])
    placed = running_totals(counts, ["feature"], [F.col("v")], {n: n for n in names})

    def at(n: str, place: Callable) -> Column:
        spot = place((F.col(f"all_{n}") - 1) * F.lit(0.5))
        return F.max(F.when((F.col(f"before_{n}") <= spot) & (spot < F.col(f"before_{n}") + F.col(n)), F.col("v")))

    found = placed.groupBy("feature").agg(*[((at(n, F.floor) + at(n, F.ceil)) / 2).alias(n) for n in names]).collect()
    return {chosen: dict.fromkeys(features, 0.0) | {r["feature"]: float(r[n]) for r in found if r[n] is not None} for chosen, n in zip(sets, names)}


def filled(df: DataFrame, medians: Mapping[str, float], prefix: str = "__f_") -> DataFrame:
    """NULL and NaN features replaced by the given medians, under prefixed names."""
    value = lambda c: F.col(c).cast("double")
    return df.withColumns({f"{prefix}{c}": F.when(value(c).isNull() | F.isnan(value(c)), num(m)).otherwise(value(c)) for c, m in medians.items()})


def _prepared(features: Sequence[str], medians: Mapping[str, float]) -> list:
    """Stages that fill with the training rows' medians and assemble the vector."""
    chosen = ", ".join(f"coalesce(nanvl(cast(`{c}` as double), CAST(NULL AS DOUBLE)), {medians[c]!r}D) AS `__f_{c}`" for c in features)
    return [
        SQLTransformer(statement=f"SELECT *, {chosen} FROM __THIS__"),
        VectorAssembler(inputCols=[f"__f_{c}" for c in features], outputCol="__vector", handleInvalid="keep"),
    ]


def _typed(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in features})


def fit_base(kind: str, train: DataFrame, features: Sequence[str], label: str, settings: Settings, validation: str | None = None, medians: Mapping[str, float] | None = None) -> Scorer:
    """Median imputation and one weighted tree model; a constant when the label has one class.

    ``validation`` names a boolean column of rows the boosting rounds are stopped on; ``medians`` are the training rows', where known.
    """
    classes = {r[0] for r in train.select(F.col(label).cast("int")).distinct().collect()}
    if len(classes) < 2:
        return Scorer(None, float(max(classes, default=0)))
    common = dict(featuresCol="__vector", labelCol=label, maxDepth=settings.depth, weightCol="__weight", seed=settings.seed)
    if kind == "boost":
        learner = GBTClassifier(maxIter=settings.rounds, stepSize=settings.step, **common)
        if validation:
            learner.setValidationIndicatorCol(validation)
    elif kind == "forest":
        learner = RandomForestClassifier(numTrees=settings.trees, **common)
    else:
        learner = LogisticRegression(featuresCol="__vector", labelCol=label, weightCol="__weight")
    data = with_weight(_typed(train, features), label).withColumn(label, F.col(label).cast("double"))
    medians = exact_medians(data, features) if medians is None else {c: medians[c] for c in features}
    return Scorer(Pipeline(stages=[*_prepared(features, medians), learner]).fit(data), medians=medians)


@dataclass(frozen=True)
class Prepared:
    """Written training rows with their folds, the rows the final models are fitted on, the hold-out rows and all fills.

    Fills are by fold (those of its earlier folds) and, under ``"tail"``, of all training rows.
    """

    folded: DataFrame
    tail: DataFrame
    holdout: DataFrame
    fills: Mapping[object, Mapping[str, float]]


def prepare(df: DataFrame, *, features: Sequence[str], label: str, date: str, key: Sequence[str], settings: Settings = Settings()) -> Prepared:
    """What every fit on these rows shares: splits by date and the fills of every fold, for all features together."""
    rows = settle(df.where(F.col(label).isNotNull()).select(*key, date, label, *features))
    rows = splits.holdout_split(rows, date=date, key=key, share=settings.holdout)
    train, holdout = rows.where("not is_holdout"), rows.where("is_holdout")
    folded = settle(splits.expanding_folds(train, date=date, key=key, folds=settings.folds))
    tail = settle(splits.holdout_split(train, date=date, key=key, share=settings.tail, name="is_tail"))
    folds = range(1, settings.folds + 1)
    fills = medians_of_sets(folded, features, {fold: F.col("fold") < fold for fold in folds} | {"tail": F.lit(True)})
    return Prepared(folded, tail, holdout, fills)


def fit_stack(df: DataFrame, *, features: Sequence[str], label: str, date: str, key: Sequence[str], settings: Settings = Settings()) -> tuple[Stack, DataFrame]:
    """Train on the earlier dates, return the stack and the scored hold-out rows."""
    return fit_prepared(prepare(df, features=features, label=label, date=date, key=key, settings=settings), features=features, label=label, key=key, settings=settings)


def fit_prepared(rows: Prepared, *, features: Sequence[str], label: str, key: Sequence[str], settings: Settings = Settings()) -> tuple[Stack, DataFrame]:
    """The stack on some of the prepared features."""
    return fit_stacks([(rows, features, label)], key=key, settings=settings)[0]


def fit_stacks(asked: Sequence[tuple[Prepared, Sequence[str], str]], *, key: Sequence[str], settings: Settings = Settings()) -> list[tuple[Stack, DataFrame]]:
    """One stack and its scored hold-out rows per (prepared rows, features, label).

    Base models are fitted on expanding folds; their out-of-fold probabilities train the logistic meta
    model, so it never sees a prediction made on training rows.  The final base models are fitted on all
    training rows with the last dates as the stopping set.  Fits of all folds and of the final models, of all stacks, depend
    on written rows only, so they run side by side; a boosted fit is a long chain of short jobs, so those start first, the
    largest before the others.
    """
    # A feature without any value cannot be imputed.
    whole = [partial(covered_columns, rows.tail.unionByName(rows.holdout, allowMissingColumns=True), features, 1e-9) for rows, features, _ in asked]
    used = together(whole, settings.parallel)
    steps = ["tail", *range(settings.folds, 0, -1)]
    fits = [(kind, step, i) for kind in BASES for step in steps for i in range(len(asked))]

    def fit(kind: str, step: object, i: int) -> Scorer:
        rows, _, label = asked[i]
        if step == "tail":
            return fit_base(kind, rows.tail, used[i], label, settings, validation="is_tail" if kind == "boost" else None, medians=rows.fills["tail"])
        return fit_base(kind, rows.folded.where(F.col("fold") < step), used[i], label, settings, medians=rows.fills[step])

    fitted = dict(zip(fits, together([partial(fit, *f) for f in fits], settings.parallel)))

    def finish(i: int) -> tuple[Stack, DataFrame]:
        rows, _, label = asked[i]
        of_fold = {(fold, kind): fitted[kind, fold, i] for fold in range(1, settings.folds + 1) for kind in BASES}
        return _stacked(rows, of_fold, {kind: fitted[kind, "tail", i] for kind in BASES}, features=used[i], label=label, key=key, settings=settings)

    return together([partial(finish, i) for i in range(len(asked))], settings.parallel)


def _stacked(
    rows: Prepared, of_fold: Mapping[tuple[int, str], Scorer], bases: Mapping[str, Scorer], *, features: Sequence[str], label: str, key: Sequence[str], settings: Settings
) -> tuple[Stack, DataFrame]:
    """The meta model on the out-of-fold probabilities of fitted base models, and the scored hold-out rows."""
    out_of_fold, fold_rows = None, []
    for fold in range(1, settings.folds + 1):
        now = _typed(rows.folded.where(F.col("fold") == fold), features)
        for kind in BASES:
            now = of_fold[fold, kind].transform(now, kind)
        now = now.select(*key, label, "fold", *BASES)
        out_of_fold = now if out_of_fold is None else out_of_fold.unionByName(now)
    out_of_fold = settle(out_of_fold)
    for kind in BASES:
        fold_rows += metrics.ranking_metrics(out_of_fold, label=label, score=kind, groups=["fold"]).withColumn("model", F.lit(kind)).collect()
    meta = _fit_meta(out_of_fold, label)
    stack = Stack(list(features), label, bases, meta, fold_rows)
    return stack, stack.transform(_typed(rows.holdout, features))


def _fit_meta(rows: DataFrame, label: str) -> Scorer:
    classes = rows.agg(F.avg(F.col(label).cast("double")).alias("p"), F.countDistinct(label).alias("n")).first()
    if classes["n"] < 2:
        return Scorer(None, float(classes["p"] or 0.0))
    stages = [VectorAssembler(inputCols=list(BASES), outputCol="__meta"), LogisticRegression(featuresCol="__meta", labelCol="__y")]
    return Scorer(Pipeline(stages=stages).fit(rows.withColumn("__y", F.col(label).cast("double"))))


def holdout_metrics(scored: DataFrame, label: str, scores: Sequence[str] = (*BASES, "proba")) -> DataFrame:
    """AUC, average precision and Brier score of several score columns, one row each."""
    long = scored.select(label, F.inline(F.array(*[F.struct(F.lit(s).alias("model"), F.col(s).alias("score")) for s in scores])))
    return metrics.ranking_metrics(long, label=label, score="score", groups=["model"])


def fit_thresholds(df: DataFrame, *, features: Mapping[int, Sequence[str]], date: str, key: Sequence[str], settings: Settings = Settings(), label: str = "label_so_{}_plus") -> dict[int, tuple[Stack, DataFrame]]:
    """One stack per strikeout threshold; a threshold whose training rows are of one class scores that class.

    The fits of all thresholds run side by side.
    """
    named = {threshold: (columns, label.format(threshold)) for threshold, columns in features.items()}
    rows = together([partial(prepare, df, features=columns, label=own, date=date, key=key, settings=settings) for columns, own in named.values()], settings.parallel)
    stacks = fit_stacks([(one, columns, own) for one, (columns, own) in zip(rows, named.values())], key=key, settings=settings)
    return dict(zip(named, stacks))


def ablation(df: DataFrame, *, scenarios: Mapping[str, Sequence[str]], label: str, date: str, key: Sequence[str], settings: Settings = Settings()) -> DataFrame:
    """Hold-out metrics of the stack for each named feature set; splits and fills are made once, the fits of all sets run side by side."""
    rows = prepare(df, features=list(dict.fromkeys(c for columns in scenarios.values() for c in columns)), label=label, date=date, key=key, settings=settings)
    stacks = fit_stacks([(rows, columns, label) for columns in scenarios.values()], key=key, settings=settings)
    measured = together([partial(holdout_metrics, scored, label, ["proba"]) for _, scored in stacks], settings.parallel)
    out = None
    for (name, columns), one in zip(scenarios.items(), measured):
        one = one.withColumns({"scenario": F.lit(name), "features": F.lit(len(columns))})
        out = one if out is None else out.unionByName(one)
    return out


def lookback_sweep(df: DataFrame, *, lookbacks: Sequence[int], stems: Sequence[str], features: Sequence[str], label: str, date: str, key: Sequence[str], settings: Settings = Settings()) -> DataFrame:
    """Hold-out metrics of the stack for each number of last games.

    ``df`` holds the form over every N at once, as ``history.recent_form`` gives it with ``windows=lookbacks``; each fit takes
    the columns of its N.
    """
    own = {str(n): [*features, *[f"recent_{stem}_rate_g{n}" for stem in stems], f"recent_weight_used_g{n}"] for n in lookbacks}
    return ablation(df, scenarios=own, label=label, date=date, key=key, settings=settings).withColumn("lookback", F.col("scenario").cast("int")).drop("scenario")


def lookback_rows(df: DataFrame, *, lookbacks: Sequence[int], stems: Sequence[str]) -> DataFrame:
    """Per number of last games: rows, rows with any earlier game, rows with all N, and the mean rates.

    The frame is read once: a row hands out one small struct per N, which partial aggregation folds up before any shuffle.
    """
    each = [
        F.struct(F.lit(n).alias("lookback"), F.col(f"recent_games_used_g{n}").alias("used"), *[F.col(f"recent_{stem}_rate_g{n}").alias(f"{stem}_rate") for stem in stems])
        for n in lookbacks
    ]
    return df.select(F.inline(F.array(*each))).groupBy("lookback").agg(
        F.count(F.lit(1)).alias("rows"), F.count("used").alias("rows_with_form"), F.count(F.when(F.col("used") == F.col("lookback"), 1)).alias("rows_with_all"),
        *[F.avg(f"{stem}_rate").alias(f"mean_{stem}_rate") for stem in stems],
    )


def importances(spark, scorer: Scorer, features: Sequence[str]) -> DataFrame:
    """Feature importance of a tree model, largest first."""
    values = [] if scorer.model is None else scorer.model.stages[-1].featureImportances.toArray()
    rows = [(f, float(v)) for f, v in zip(features, values)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.col("importance").desc(), "feature")


def fit_linear(df: DataFrame, features: Sequence[str], label: str, settings: Settings = Settings()) -> Scorer:
    return fit_base("linear", df, features, label, settings)


def drivers(scored: DataFrame, model: Linear, *, key: Sequence[str], top: int = 3) -> DataFrame:
    """Per row: the features that move a logistic score most, up and down.

    A feature's impact is coefficient x (value - training median); ``delta_pct`` is what it does to the
    probability at the base margin.  Rows with ``direction`` and ``rank`` 1..top.
    """
    base = model.base()
    impacts = F.array(
        *[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"), shift.alias("impact")) for f, shift in zip(model.features, model.shifts())]
    )
    # Ranked inside the row: no shuffle, however many rows there are.
    size = F.abs
    listed = F.filter(impacts, lambda x: size(x["impact"]) >= 1e-6)
    ups = F.filter(listed, lambda x: x["impact"] > 0)
    downs = F.filter(listed, lambda x: x["impact"] < 0)

    def ranked(items, direction):
        order = F.sort_array(F.transform(items, lambda x: F.struct((-size(x["impact"])).alias("o"), x["feature"].alias("feature"), x["value"].alias("value"), x["impact"].alias("impact"))))
        return F.transform(
            F.slice(order, 1, top),
            lambda x, i: F.struct(
                F.lit(direction).alias("direction"), (i + 1).alias("rank"), x["feature"].alias("feature"), x["value"].alias("value"), x["impact"].alias("impact"),
                half_even((logistic(num(base) + x["impact"]) - logistic(num(base))) * num(100), 1).alias("delta_pct"),
            ),
        )

    return scored.select(*key, F.inline(F.concat(ranked(ups, "up"), ranked(downs, "down"))))


def cross_validate(df: DataFrame, *, features: Sequence[str], label: str, key: Sequence[str], kind: str = "forest", folds: int = 5, settings: Settings = Settings()) -> DataFrame:
    """Mean and standard deviation of the AUC over hashed folds."""
    # Folds look at their input several times.
    rows = settle(df.where(F.col(label).isNotNull()).select(*key, label, *features))
    rows = settle(splits.hashed_folds(rows, key=key, folds=folds))
    fills = medians_of_sets(rows, features, {fold: F.col("fold") != fold for fold in range(folds)})
    fitted = together([partial(fit_base, kind, rows.where(F.col("fold") != fold), features, label, settings, medians=fills[fold]) for fold in range(folds)], settings.parallel)
    out = None
    for fold, model in enumerate(fitted):
        scored = model.transform(_typed(rows.where(F.col("fold") == fold), features), "proba")
        scored = scored.select("fold", label, "proba")
        out = scored if out is None else out.unionByName(scored)
    per_fold = metrics.ranking_metrics(out, label=label, score="proba", groups=["fold"])
    return per_fold.agg(F.count("roc_auc").alias("folds"), F.avg("roc_auc").alias("auc_mean"), F.stddev_pop("roc_auc").alias("auc_std"))


def proxy_label(df: DataFrame, score: str = "confidence_score", cut: float = 70, name: str = "proxy_outcome") -> DataFrame:
    return df.withColumn(name, F.coalesce((F.col(score) >= cut).cast("int"), F.lit(0)))


def outcome_distribution(df: DataFrame, *, outcome: str, features: Sequence[str]) -> DataFrame:
    """Per feature: mean and median over all rows, over positives and over negatives, and the share of rows that have it."""
    y = F.coalesce(F.col(outcome) == 1, F.lit(False)).alias("__y")
    rows = df.select(y, *features)
    long = F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features]))
    means = rows.select("__y", long).groupBy("feature").agg(
        F.avg("value").alias("mean_all"), F.avg(F.when(F.col("__y"), F.col("value"))).alias("mean_positive"), F.avg(F.when(~F.col("__y"), F.col("value"))).alias("mean_negative"),
        (F.count("value") / F.count(F.lit(1)) * num(100)).alias("present_pct"),
    )
    # A row belongs to its class and to the whole.
    parts = rows.withColumn("class_part", F.explode(F.array(F.lit("all"), F.when(F.col("__y"), F.lit("positive")).otherwise(F.lit("negative")))))
    medians = grouped_medians(parts, features, ["class_part"]).groupBy("feature").agg(
        *[F.max(F.when(F.col("class_part") == part, F.col("median"))).alias(f"median_{part}") for part in ("all", "positive", "negative")]
    )
    return means.join(medians, "feature", "left")
