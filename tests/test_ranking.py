import math
import random

import pytest
from pyspark.sql import functions as F

from slatework.operators import backtest, joins, metrics, ordering, slate, splits


def test_positions_with_hot_group_and_ties(spark):
    random.seed(1)
    rows = [("hot" if random.random() < 0.8 else random.choice(["x", None]), random.choice([0.1, 0.2, None]), i) for i in range(3000)]
    frame = spark.createDataFrame(rows, "g string, s double, i long").repartition(7)
    out = ordering.with_positions(frame, ["g"], [F.col("s").desc_nulls_last(), F.col("i")]).collect()
    groups = {}
    for g, s, i in rows:
        groups.setdefault(g, []).append((-s if s is not None else math.inf, i))
    place = {(g, i): n for g, members in groups.items() for n, (_, i) in enumerate(sorted(members))}
    assert len(out) == len(rows)
    assert all(r["position"] == place[(r["g"], r["i"])] and r["group_rows"] == len(groups[r["g"]]) for r in out)


def test_running_totals(spark):
    rows = [("a" if i % 3 else "b", i, float(i % 5)) for i in range(500)]
    out = ordering.running_totals(spark.createDataFrame(rows, "g string, i long, v double"), ["g"], [F.col("i")], {"v": "v"}).collect()
    for r in out:
        mine = [v for g, i, v in rows if g == r["g"]]
        assert r["before_v"] == sum(v for g, i, v in rows if g == r["g"] and i < r["i"]) and r["all_v"] == sum(mine)


def test_fractional_rank(spark):
    frame = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (3.0,), (None,)], "v double")
    out = sorted((r["v"] is None, r["v"], r["percentile_rank"]) for r in ordering.fractional_rank(frame, [], "v").collect())
    assert [r[2] for r in out] == [0.25, 0.625, 0.625, 1.0, None]


def test_slate_score_constant_pool_and_single_row(spark):
    parts = {"c": (0.6, [slate.Term("x", 1.0, 5.0)]), "d": (0.4, [slate.Term("y", 1.0, 0.0, invert=True)])}
    rows = [("one", 1, 3.0, 2.0), ("flat", 2, 4.0, 1.0), ("flat", 3, 4.0, 1.0), ("two", 4, 0.0, 0.0), ("two", 5, None, 8.0)]
    # Missing values stay out of the range; a default beyond it stands at its end.
    rows += [("three", 6, 1.0, 1.0), ("three", 7, 3.0, 1.0), ("three", 8, None, 1.0)]
    out = slate.slate_score(spark.createDataFrame(rows, "s string, i long, x double, y double"), slate=["s"], components=parts).collect()
    got = {r["i"]: r["score"] for r in out}
    assert got == {1: 50.0, 2: 50.0, 3: 50.0, 4: 70.0, 5: 30.0, 6: 20.0, 7: 80.0, 8: 80.0}


def test_rank_signal_shares(spark):
    frame = spark.range(100).select(F.lit("s").alias("s"), (F.col("id") / 100).alias("p"), "id")
    counts = {r["signal"]: r["count"] for r in slate.rank_signal(frame, slate=["s"], score="p", tie=["id"]).groupBy("signal").count().collect()}
    assert counts == {"STRONG_BUY": 10, "BUY": 15, "MODERATE": 25, "AVOID": 25, "STRONG_SELL": 25}
    one = slate.rank_signal(frame.limit(1), slate=["s"], score="p", tie=["id"]).first()
    assert one["signal"] == "STRONG_BUY"


def auc(pairs):
    pos, neg = [p for y, p in pairs if y], [p for y, p in pairs if not y]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def average_precision(pairs):
    total = sum(y for y, _ in pairs)
    out, cuts = 0.0, sorted({p for _, p in pairs}, reverse=True)
    previous = 0.0
    for cut in cuts:
        chosen = [y for y, p in pairs if p >= cut]
        recall = sum(chosen) / total
        out += (recall - previous) * sum(chosen) / len(chosen)
        previous = recall
    return out


def test_ranking_metrics(spark):
    random.seed(2)
    pairs = [(random.randint(0, 1), random.choice([0.0, 0.1, 0.5, 0.5, 0.9, 1.0])) for _ in range(400)]
    row = metrics.ranking_metrics(spark.createDataFrame(pairs, "y int, p double"), label="y", score="p").first()
    assert row["roc_auc"] == pytest.approx(auc(pairs)) and row["average_precision"] == pytest.approx(average_precision(pairs))
    assert row["brier_score"] == pytest.approx(sum((p - y) ** 2 for y, p in pairs) / len(pairs))
    single = metrics.ranking_metrics(spark.createDataFrame([(1, 0.2), (1, 0.9)], "y int, p double"), label="y", score="p").first()
    assert single["roc_auc"] is None and single["brier_score"] is None and single["positives"] == 2


def test_bins_on_edges(spark):
    rows = [(p,) for p in (0.0, 0.1, 0.3, 0.30000000000000004, 0.7, 0.95, 1.0)]
    out = [r["b"] for r in spark.createDataFrame(rows, "p double").select(metrics.equal_width_bin("p").alias("b")).collect()]
    # 3 x 0.1 and 7 x 0.1 are a hair above 0.3 and 0.7, as for any linearly spaced edges.
    assert out == [0, 1, 2, 3, 6, 9, 9]


def test_percentiles_and_best_f1(spark):
    values = [1.0, 2.0, 2.0, 7.0, 9.0]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    out = {r["point"]: r["threshold"] for r in metrics.percentile_points(frame, "v", [0.9, 0.5, 0.25, 0.0, 1.0]).collect()}
    assert out == {0.9: pytest.approx(8.2), 0.5: 2.0, 0.25: 2.0, 0.0: 1.0, 1.0: 9.0}
    scored = spark.createDataFrame([(1, 0.4), (1, 0.35), (0, 0.3), (0, 0.1)], "y int, p double")
    best = metrics.best_f1(scored, label="y", score="p", cuts=[i * 0.01 for i in range(1, 50)]).first()
    assert best["threshold"] == pytest.approx(0.30) and best["f1"] == 1.0


def test_kelly_equals_sequential_bankroll(spark):
    random.seed(4)
    bets = [(i, random.random(), random.uniform(0.9, 6), random.randint(0, 1)) for i in range(300)]
    bank, placed = 1000.0, 0
    for _, p, o, y in bets:
        if o > 1 and p - 1 / o > 0:
            f = min(0.25 * (p - 1 / o) / (o - 1), 0.25)
            bank += bank * f * (o - 1) if y else -bank * f
            placed += 1
    frame = spark.createDataFrame(bets, "i long, p double, o double, y int")
    out = backtest.kelly_results(frame, rules={"all": F.lit(True)}, probability="p", odds="o", label="y").first()
    assert out["bets"] == placed and out["final_bankroll"] == pytest.approx(bank, rel=1e-9)


def test_stakes_have_mean_one(spark):
    rows = [(float(i % 17), 1.5 + i % 3, i % 2) for i in range(200)]
    staked = backtest.with_stakes(spark.createDataFrame(rows, "c double, o double, y int"), confidence="c", odds="o")
    row = staked.agg(*[F.avg(s).alias(s) for s in backtest.STAKES]).first()
    assert all(row[s] == pytest.approx(1.0) for s in backtest.STAKES)
    flat = backtest.with_stakes(spark.createDataFrame([(5.0, 2.0, 1)] * 3, "c double, o double, y int"), confidence="c", odds="o")
    assert {r["confidence_linear"] for r in flat.collect()} == {1.0}


def test_usable_bets_and_profit(spark):
    rows = [("70", "2.5", "1"), ("x", "2.0", "1"), ("60", "1.0", "0"), ("60", None, "1"), ("50", "3", None)]
    out = backtest.usable_bets(spark.createDataFrame(rows, "c string, o string, y string"), confidence="c", odds="o", label="y").collect()
    assert [(r["c"], r["o"], r["y"]) for r in out] == [(70.0, 2.5, 1), (50.0, 3.0, 0)]
    profit = spark.createDataFrame([(1, 2.5), (1, 1.0), (1, None), (0, 3.0)], "y int, o double").select(backtest.unit_profit("y", "o").alias("p")).collect()
    assert [r["p"] for r in profit] == [1.5, 0.0, 0.0, -1.0]


def test_splits(spark):
    import datetime as dt

    days = [dt.date(2025, 4, 1) + dt.timedelta(days=i) for i in range(11)]
    frame = spark.createDataFrame([(d, i) for i, d in enumerate(days * 2)], "d date, k long")
    held = {r["d"] for r in splits.holdout_split(frame, date="d", key=["k"]).where("is_holdout").collect()}
    assert held == set(days[-3:])
    short = spark.createDataFrame([(days[i % 3], i) for i in range(10)], "d date, k long")
    assert splits.holdout_split(short, date="d", key=["k"], by="row").where("is_holdout").count() == 2
    # Few dates are still split by date, and rows without a date train.
    assert {r["d"] for r in splits.holdout_split(short, date="d", key=["k"]).where("is_holdout").collect()} == {days[2]}
    undated = spark.createDataFrame([(d, i) for i, d in enumerate([*days, None])], "d date, k long")
    for split in (splits.holdout_split(undated, date="d", key=["k"]), splits.date_quantile_split(undated, date="d")):
        assert split.count() == 12 and split.where("d IS NULL AND NOT is_holdout").count() == 1
    none = undated.where("d IS NULL")
    assert splits.holdout_split(none, date="d", key=["k"]).where("NOT is_holdout").count() == 1
    folds = {r["fold"]: r["count"] for r in splits.expanding_folds(frame, date="d", key=["k"]).groupBy("fold").count().collect()}
    assert folds == {0: 7, 1: 3, 2: 3, 3: 3, 4: 3, 5: 3}


def test_join_helpers(spark):
    games = spark.createDataFrame([("A", "B", 1), ("C", "C", 2)], "home string, away string, g long")
    picks = spark.createDataFrame([("B @ A",), ("A @ B",), ("C @ C",), ("A @ C",), (None,)], "label string")
    out = joins.either_order_join(picks, games, left_pair=joins.split_matchup("label"), right_pair=("home", "away")).collect()
    assert {r["label"]: r["g"] for r in out} == {"B @ A": 1, "A @ B": 1, "C @ C": 2, "A @ C": None, None: None}
    teams = spark.createDataFrame([("A",), ("C",), ("Z",)], "team string").withColumn("x", F.lit(1))
    sided = joins.either_side_join(teams, games.withColumn("x", F.lit(1)), team="team", home="home", away="away", on=["x"]).collect()
    assert sorted((r["team"], r["g"]) for r in sided if r["g"]) == [("A", 1), ("C", 2)]
    texts = spark.createDataFrame([(1, "The New-York Yankees won; yankees!"), (2, "Newyork yankees")], "id long, t string")
    names = spark.createDataFrame([("new york yankees",), ("Yankees",)], "n string")
    found = joins.mentions(texts, names, text="t", name="n").collect()
    assert sorted((r["id"], r["n"]) for r in found) == [(1, "Yankees"), (1, "new york yankees"), (2, "Yankees")]


def test_wide_rows_are_never_written(spark, monkeypatch):
    """Only group, order and key columns reach a checkpoint, and repeated rows keep places of their own."""
    written = []
    for module in (ordering, splits):
        real = module.settle
        monkeypatch.setattr(module, "settle", lambda df, real=real: written.append(df.columns) or real(df))
    rows = [("hot" if i % 3 else None, float(i % 7), i % 400, f"text {i}") for i in range(2400)]
    frame = spark.createDataFrame(rows, "s string, p double, k long, wide string")
    ranked = slate.rank_signal(frame, slate=["s"], score="p", tie=["k"])
    places = {}
    for r in ranked.collect():
        places.setdefault(r["s"], []).append((r["slate_position"], -r["p"], r["k"]))
    for own in places.values():
        own.sort()
        assert [p for p, _, _ in own] == list(range(len(own))) and [o[1:] for o in own] == sorted(o[1:] for o in own)
    assert sorted(r["wide"] for r in ranked.select("wide").collect()) == sorted(r[3] for r in rows)
    unique = frame.withColumn("k", F.monotonically_increasing_id())
    written.clear()
    slate.rank_signal(unique, slate=["s"], score="p", tie=["k"]).count()
    splits.expanding_folds(unique.withColumn("d", F.col("p")), date="d", key=["k"]).count()
    splits.positional_split(unique.withColumn("d", F.col("p")), date="d", key=["k"]).count()
    assert written and not any("wide" in columns for columns in written)


@pytest.mark.parametrize("n", [0, 1, 5, 6, 7, 100])
def test_folds_and_split_by_position(spark, n):
    """Most rows share one date, some have none; the blocks are cut exactly."""
    rows = [(None if i % 9 == 4 else 3 if i % 4 else i % 6, (i * 37) % 101, "x") for i in range(n)]
    frame = spark.createDataFrame(rows, "d int, k int, wide string").repartition(3)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    block, first = n // 6, max(math.floor(n * 0.8), 1)
    fold = {r[1]: 0 if not block or i < n - 5 * block else (i - (n - 5 * block)) // block + 1 for i, r in enumerate(order)}
    late = {r[1]: i >= first for i, r in enumerate(order)}
    assert {r["k"]: r["fold"] for r in splits.expanding_folds(frame, date="d", key=["k"]).collect()} == fold
    assert {r["k"]: r["is_holdout"] for r in splits.positional_split(frame, date="d", key=["k"]).collect()} == late


def test_entity_games_reads_events_once(spark):
    from slatework.operators.aggregates import entity_games

    random.seed(4)
    rows = [(random.choice(["hot", "hot", "x", None]), random.choice(["a", "b", None]), random.choice([1, 2, 3, None])) for _ in range(400)] + [("none", None, None)]
    frame = spark.createDataFrame(rows, "g string, side string, who long")
    out = entity_games(frame, keys=["g"], counts={"n": F.lit(True), "a": F.col("side") == "a"}, modes={"usual": "side", "most": "who"})
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1

    def mode(values):
        values = [v for v in values if v is not None]
        return min(set(values), key=lambda v: (-values.count(v), v)) if values else None

    for r in out.collect():
        own = [x for x in rows if x[0] == r["g"]]
        assert tuple(r) == (r["g"], len(own), sum(x[1] == "a" for x in own), mode([x[1] for x in own]), mode([x[2] for x in own]))


def test_kelly_growth_outlives_the_largest_bankroll(spark):
    """60,000 won bets: the bankroll overflows, its logarithm does not."""
    bets = spark.range(60000).select(F.lit(0.5).alias("p"), F.lit(2.5).alias("o"), F.lit(1).alias("y"))
    out = backtest.kelly_results(bets, rules={"all": F.lit(True)}, probability="p", odds="o", label="y").first()
    assert out["final_bankroll"] == float("inf")
    assert out["log_growth"] == pytest.approx(60000 * math.log1p(0.25 * (0.5 - 1 / 2.5)))


def test_kelly_curve_outlives_the_largest_bankroll(spark):
    bets = spark.range(60000).select((F.col("id") % 3).alias("d"), F.lit(0.5).alias("p"), F.lit(2.5).alias("o"), F.lit(1).alias("y"))
    out = backtest.kelly_curve(bets, day="d", probability="p", odds="o", label="y").orderBy("d").collect()
    assert [r["log_growth"] for r in out] == [pytest.approx(n * 20000 * math.log1p(0.25 * (0.5 - 1 / 2.5))) for n in (1, 2, 3)]


def test_score_one_bit_past_a_tie_is_a_tie(spark):
    """60.650000000000006 is what a weighted sum makes of 60.65."""
    from slatework.functions.numeric import half_even

    got = spark.createDataFrame([(60.650000000000006,), (60.65,), (60.75,), (58.05,)], "v double").select(half_even("v", 1).alias("r")).collect()
    assert [r["r"] for r in got] == [60.6, 60.6, 60.8, 58.0]
