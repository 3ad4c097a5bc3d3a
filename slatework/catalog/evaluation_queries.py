"""Metrics and backtests (M6-M17, P17, P18, A28, A32): label = returned line, probability from its discount."""

from __future__ import annotations

from pyspark.sql import functions as F

from slatework.catalog.base import PLAYS_SQL, plays, query, rounded
from slatework.functions.numeric import edge, implied_probability, num, tier
from slatework.operators import backtest, metrics
from slatework.session import settle

CUTS_SQL = "[" + ", ".join(f"{i} * 0.01e0" for i in range(1, 50)) + "]"


def _scored(spark, folder):
    return plays(spark, folder).select(
        "game_date", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus",
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        (F.col("l_discount") * num(5) + F.col("l_tax") * num(4)).alias("proba"),
        (F.col("l_quantity") / num(50)).alias("other"),
        (F.col("l_quantity") * num(2)).alias("confidence_score"),
        (num(1) + F.col("l_tax") * num(60)).alias("odds"),
    )


_SCORED_SQL = f"""{PLAYS_SQL}, s AS (SELECT game_date, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linestatus, CAST(l_returnflag = 'R' AS INT) AS label,
      l_discount * 5e0 + l_tax * 4e0 AS proba, l_quantity / 50e0 AS other, l_quantity * 2e0 AS confidence_score, 1e0 + l_tax * 60e0 AS odds FROM plays)"""


@query(
    "m6_auc_ap_brier",
    f"""WITH {_SCORED_SQL}, d AS (SELECT l_linestatus, proba, sum(label) AS np, count(*) - sum(label) AS nn FROM s GROUP BY ALL),
    c AS (SELECT *, sum(nn) OVER (PARTITION BY l_linestatus ORDER BY proba) - nn AS below, sum(np) OVER (PARTITION BY l_linestatus ORDER BY proba DESC) AS tp,
          sum(np + nn) OVER (PARTITION BY l_linestatus ORDER BY proba DESC) AS pred FROM d),
    t AS (SELECT l_linestatus, sum(np) AS p, sum(nn) AS n, sum(np * (below + nn / 2e0)) AS u, sum(np * (tp / pred)) AS ap FROM c GROUP BY 1)
    SELECT t.l_linestatus, CAST(p + n AS BIGINT) AS "rows", CAST(p AS BIGINT) AS positives, round(u / (p * n), 9) AS roc_auc, round(ap / p, 9) AS average_precision,
           round(b.brier, 9) AS brier_score
    FROM t JOIN (SELECT l_linestatus, avg((proba - label) ** 2) AS brier FROM s GROUP BY 1) b USING (l_linestatus)""",
)
def ranking(spark, folder):
    return rounded(metrics.ranking_metrics(_scored(spark, folder), label="label", score="proba", groups=["l_linestatus"]), 9)


@query(
    "m7_confusion",
    f"""WITH {_SCORED_SQL}, c AS (SELECT count(*) FILTER (proba >= 0.5 AND label = 1) AS tp, count(*) FILTER (proba >= 0.5 AND label = 0) AS fp,
        count(*) FILTER (proba < 0.5 AND label = 1) AS fn, count(*) FILTER (proba < 0.5 AND label = 0) AS tn,
        round(avg(-CASE WHEN label = 1 THEN ln(least(greatest(proba, 1e-15), 1 - 1e-15)) ELSE ln(1 - least(greatest(proba, 1e-15), 1 - 1e-15)) END), 7) AS log_loss FROM s)
    SELECT *, round((tp + tn) / (tp + fp + fn + tn), 9) AS accuracy, round(tp / (tp + fp), 9) AS "precision", round(tp / (tp + fn), 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1 FROM c""",
)
def confusion(spark, folder):
    out = metrics.confusion_metrics(_scored(spark, folder), label="label", score="proba")
    return rounded(out.withColumn("log_loss", F.round("log_loss", 7)), 9)


@query(
    "m8_best_f1",
    f"""WITH {_SCORED_SQL}, g AS (SELECT unnest({CUTS_SQL}) AS threshold),
    c AS (SELECT threshold, count(*) FILTER (proba > threshold AND label = 1) AS tp, count(*) FILTER (proba > threshold AND label = 0) AS fp, count(*) FILTER (proba <= threshold AND label = 1) AS fn
      FROM s, g GROUP BY 1)
    SELECT round(threshold, 9) AS threshold, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS "precision", round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1
    FROM c ORDER BY 2 * tp / (2 * tp + fp + fn) DESC, threshold LIMIT 1""",
)
def best_f1(spark, folder):
    return rounded(metrics.best_f1(_scored(spark, folder), label="label", score="proba", cuts=[i * 0.01 for i in range(1, 50)]), 9)


@query(
    "m9_threshold_compare",
    f"""WITH {_SCORED_SQL}, g AS (SELECT unnest([0.5e0, 0.6e0, 0.7e0, 0.8e0, 0.85e0, 0.9e0]) AS threshold),
    c AS (SELECT threshold, count(*) FILTER (proba >= threshold) AS a, count(*) FILTER (proba >= threshold AND label = 1) AS ah,
          count(*) FILTER (other >= threshold) AS b, count(*) FILTER (other >= threshold AND label = 1) AS bh FROM s, g GROUP BY 1)
    SELECT threshold, a AS proba_predictions, round(coalesce(ah / nullif(a, 0), 0) * 100, 7) AS proba_hit_rate, b AS other_predictions,
      round(coalesce(bh / nullif(b, 0), 0) * 100, 7) AS other_hit_rate, round(coalesce(ah / nullif(a, 0), 0) * 100 - coalesce(bh / nullif(b, 0), 0) * 100, 7) AS improvement FROM c""",
)
def threshold_compare(spark, folder):
    out = metrics.compare_scores(_scored(spark, folder), label="label", scores=("proba", "other"), cuts=[0.5, 0.6, 0.7, 0.8, 0.85, 0.9])
    return rounded(out, 7)


_BIN_SQL = "len(list_filter([i * 0.1e0 for i in range(1, 10)], lambda e: proba >= e))"


@query(
    "m10_ece",
    f"""WITH {_SCORED_SQL}, b AS (SELECT {_BIN_SQL} AS bin, count(*) AS n, avg(proba) AS p, avg(label) AS a FROM s GROUP BY 1)
    SELECT CAST(sum(n) AS BIGINT) AS "rows", round(sum(abs(p - a) * n) / sum(n) * 100, 6) AS ece_pct, round(sum(p * n) / sum(n) * 100, 6) AS avg_probability_pct, round(sum(a * n) / sum(n) * 100, 6) AS actual_rate_pct FROM b""",
)
def expected_calibration(spark, folder):
    return rounded(metrics.calibration_summary(_scored(spark, folder), label="label", score="proba"))


@query(
    "m10_calibration_bins",
    f"""WITH {_SCORED_SQL} SELECT CAST({_BIN_SQL} AS INT) AS bin, count(*) AS "rows", round(avg(proba), 8) AS predicted, round(avg(label), 8) AS actual FROM s GROUP BY 1""",
)
def calibration_bins(spark, folder):
    return rounded(metrics.calibration_bins(_scored(spark, folder), label="label", score="proba"), 8)


_QUANTILE_SQL = f"""{_SCORED_SQL}, e AS (SELECT unnest(quantile_cont(proba * other, [i / 10e0 for i in range(1, 10)])) AS edge FROM s),
    b AS (SELECT CAST((SELECT count(*) FROM e WHERE edge < s.proba * s.other) AS INT) AS bin, proba * other AS p, label FROM s),
    q AS (SELECT bin, count(*) AS "rows", avg(p) AS predicted, avg(label) AS actual, abs(avg(p) - avg(label)) AS gap FROM b GROUP BY 1)"""


def _joint(spark, folder):
    return _scored(spark, folder).withColumn("joint", F.col("proba") * F.col("other"))


@query(
    "m10_quantile_calibration",
    f"""WITH {_QUANTILE_SQL} SELECT bin, "rows", round(predicted, 8) AS predicted, round(actual, 8) AS actual, round(gap, 8) AS gap FROM q""",
)
def quantile_calibration(spark, folder):
    return rounded(metrics.quantile_calibration(_joint(spark, folder), label="label", score="joint"), 8)


@query("m10_mean_calibration_error", f"WITH {_QUANTILE_SQL} SELECT count(*) AS bins, round(avg(gap), 8) AS mean_calibration_error FROM q")
def mean_calibration_error(spark, folder):
    return rounded(metrics.mean_calibration_error(metrics.quantile_calibration(_joint(spark, folder), label="label", score="joint")), 8)


@query(
    "m11_thresholds",
    f"""WITH {_SCORED_SQL} SELECT unnest([0.9e0, 0.75e0, 0.5e0, 0.25e0]) AS point, round(unnest(quantile_cont(proba * other, [0.9, 0.75, 0.5, 0.25])), 9) AS threshold FROM s""",
)
def thresholds(spark, folder):
    scored = _scored(spark, folder).withColumn("joint", F.col("proba") * F.col("other"))
    return rounded(metrics.percentile_points(scored, "joint", [0.9, 0.75, 0.5, 0.25]), 9)


@query(
    "a28_tier_summary",
    f"""WITH {_SCORED_SQL}, q AS (SELECT quantile_cont(proba * other, [0.9, 0.75, 0.5, 0.25]) AS q FROM s),
    t AS (SELECT CASE WHEN proba * other >= q[1] THEN 'STRONG_BUY' WHEN proba * other >= q[2] THEN 'BUY' WHEN proba * other >= q[3] THEN 'MODERATE' WHEN proba * other >= q[4] THEN 'AVOID' ELSE 'STRONG_SELL' END AS tier, label, proba * other AS joint FROM s, q)
    SELECT tier, count(*) AS "rows", CAST(sum(label) AS BIGINT) AS positive_count, round(avg(label), 8) AS hit_rate, round(avg(joint), 8) AS avg_score FROM t GROUP BY 1""",
)
def tier_summary(spark, folder):
    scored = _scored(spark, folder).withColumn("joint", F.col("proba") * F.col("other"))
    return rounded(metrics.tier_summary(scored, label="label", score="joint"), 8)


@query(
    "p18_fixed_tiers",
    f"""WITH {_SCORED_SQL}, t AS (SELECT CASE WHEN proba >= 0.85 THEN 'STRONG_BUY' WHEN proba >= 0.7 THEN 'BUY' WHEN proba >= 0.55 THEN 'MODERATE' WHEN proba >= 0.4 THEN 'AVOID' ELSE 'STRONG_SELL' END AS tier, label, proba FROM s)
    SELECT tier, count(*) AS n_rows, CAST(sum(label) AS BIGINT) AS positives, round(avg(proba), 8) AS avg_prob FROM t GROUP BY 1""",
)
def fixed_tiers(spark, folder):
    cuts = [(0.85, "STRONG_BUY"), (0.70, "BUY"), (0.55, "MODERATE"), (0.40, "AVOID")]
    tiers = _scored(spark, folder).withColumn("tier", tier("proba", cuts, "STRONG_SELL"))
    return tiers.groupBy("tier").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("label").cast("long")).alias("positives"), F.round(F.avg("proba"), 8).alias("avg_prob")
    )


@query(
    "p17_edge",
    f"""WITH {_SCORED_SQL} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN odds > 1 THEN 1 / odds ELSE 0 END, 9) AS implied_probability,
      round(CASE WHEN odds > 1 THEN proba - 1 / odds ELSE 0 END, 9) AS edge, round(CASE WHEN odds > 1 THEN proba - 1 / odds ELSE 0 END * 100, 7) AS edge_pct FROM s""",
)
def edges(spark, folder):
    e = edge("proba", "odds")
    return _scored(spark, folder).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(implied_probability("odds"), 9).alias("implied_probability"),
        F.round(e, 9).alias("edge"), F.round(e * num(100), 7).alias("edge_pct"),
    )


@query(
    "m12_recommendations",
    f"""WITH {_SCORED_SQL}, r AS (SELECT *, proba - 1 / coalesce(CASE WHEN l_linestatus = 'F' THEN odds END, 10e0) AS edge FROM s)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(edge, 8) AS edge FROM r WHERE edge >= 0.05""",
)
def recommendations(spark, folder):
    scored = _scored(spark, folder).withColumn("odds", F.when(F.col("l_linestatus") == "F", F.col("odds")))
    out = backtest.recommendations(scored, probability="proba", odds="odds")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("edge", 8).alias("edge"))


@query(
    "m13_unit_profit",
    f"""WITH {_SCORED_SQL} SELECT count(*) AS total_picks, CAST(sum(label) AS BIGINT) AS total_hits, round(avg(label) * 100, 7) AS hit_rate,
      round(sum(CASE WHEN label = 1 THEN CASE WHEN odds > 1 THEN odds - 1 ELSE 0 END ELSE -1 END) / count(*) * 100, 6) AS roi FROM s""",
)
def unit_profit(spark, folder):
    out = backtest.overall_result(_scored(spark, folder), label="label", odds="odds")
    return out.select("total_picks", "total_hits", F.round("hit_rate", 7).alias("hit_rate"), F.round("roi", 6).alias("roi"))


_STAKED_SQL = f"""{_SCORED_SQL}, u AS (SELECT * FROM s WHERE odds > 1),
    r AS (SELECT *, (rank() OVER (ORDER BY confidence_score) + (count(*) OVER (PARTITION BY confidence_score) - 1) / 2e0) / count(*) OVER () AS pr,
          0.5e0 + 1.5e0 * ((confidence_score - min(confidence_score) OVER ()) / greatest(max(confidence_score) OVER () - min(confidence_score) OVER (), 1e-9)) AS lin FROM u),
    k AS (SELECT *, CASE WHEN pr >= 0.9 THEN 1.75e0 WHEN pr >= 0.75 THEN 1.25e0 WHEN pr >= 0.5 THEN 1e0 ELSE 0.5e0 END AS tr FROM r),
    st AS (SELECT *, 1e0 AS flat_unit, lin / avg(lin) OVER () AS confidence_linear, tr / avg(tr) OVER () AS confidence_tiered, confidence_score / 100e0 - 1 / odds AS confidence_edge FROM k)"""


def _staked(spark, folder):
    bets = backtest.usable_bets(_scored(spark, folder), confidence="confidence_score", odds="odds", label="label")
    return backtest.with_stakes(bets, confidence="confidence_score", odds="odds")


@query(
    "m14_stakes",
    f"""WITH {_STAKED_SQL} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, flat_unit, round(confidence_linear, 8) AS confidence_linear, round(confidence_tiered, 8) AS confidence_tiered, round(confidence_edge, 8) AS confidence_edge FROM st""",
)
def stakes(spark, folder):
    return rounded(
        _staked(spark, folder).select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "flat_unit", "confidence_linear", "confidence_tiered", "confidence_edge"
        ), 8,
    )


def _settle_sql(keys: str, source: str) -> str:
    group = f"{keys}, " if keys else ""
    return f"""SELECT {group}scheme, count(*) AS bets, round(sum(stake), 5) AS stake, round(sum(CASE WHEN label = 1 THEN stake * (odds - 1) ELSE -stake END), 5) AS profit,
        round(sum(CASE WHEN label = 1 THEN stake * (odds - 1) ELSE -stake END) / sum(stake) * 100, 6) AS roi_pct, round(avg(label) * 100, 6) AS hit_rate_pct, round(sum(stake) / count(*), 7) AS avg_stake
      FROM (SELECT {group}label, odds, unnest(['flat_unit', 'confidence_linear', 'confidence_tiered']) AS scheme, unnest([flat_unit, confidence_linear, confidence_tiered]) AS stake FROM {source}) GROUP BY ALL"""


def _settled(df):
    return df.withColumns(
        {c: F.round(c, places) + F.lit(0.0) for c, places in {"stake": 5, "profit": 5, "roi_pct": 6, "hit_rate_pct": 6, "avg_stake": 7}.items()}
    )


@query("m15_settle", f"WITH {_STAKED_SQL} {_settle_sql('', 'st')}")
def settle_all(spark, folder):
    return _settled(backtest.settle_schemes(_staked(spark, folder), label="label", odds="odds"))


@query("m16_daily", f"WITH {_STAKED_SQL} {_settle_sql('game_date', 'st')}")
def settle_daily(spark, folder):
    return _settled(backtest.settle_schemes(_staked(spark, folder), label="label", odds="odds", groups=["game_date"]))


@query(
    "m16_profitable_days",
    f"""WITH {_STAKED_SQL}, d AS ({_settle_sql('game_date', 'st')})
    SELECT scheme, count(*) FILTER (round(profit, 4) > 0) AS profitable_days, count(*) AS total_days FROM d GROUP BY 1""",
)
def profitable_days(spark, folder):
    daily = backtest.settle_schemes(_staked(spark, folder), label="label", odds="odds", groups=["game_date"])
    return backtest.profitable_days(daily, ["scheme"])


_TIE = "confidence_score DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, odds"


@query(
    "m17_scenarios",
    f"""WITH {_SCORED_SQL}, u AS (SELECT *, confidence_score / 100e0 - 1 / odds AS ce FROM s WHERE odds > 1),
    base AS (SELECT *, row_number() OVER (PARTITION BY game_date ORDER BY {_TIE}) AS ra FROM u),
    c7 AS (SELECT *, row_number() OVER (PARTITION BY game_date ORDER BY {_TIE}) AS ra FROM u WHERE confidence_score >= 70),
    e5 AS (SELECT *, row_number() OVER (PARTITION BY game_date ORDER BY {_TIE}) AS ra FROM u WHERE ce >= 0.05),
    sc AS (SELECT 'all_picks' AS scenario, * FROM base UNION ALL SELECT 'confidence_70_plus', * FROM c7 UNION ALL SELECT 'confidence_80_plus', * FROM base WHERE confidence_score >= 80
      UNION ALL SELECT 'edge_5_plus', * FROM e5 UNION ALL SELECT 'edge_10_plus', * FROM base WHERE ce >= 0.1
      UNION ALL SELECT 'top_5_per_day', * FROM base WHERE ra <= 5 UNION ALL SELECT 'top_10_per_day', * FROM base WHERE ra <= 10
      UNION ALL SELECT 'top_5_per_day_conf70', * FROM c7 WHERE ra <= 5 UNION ALL SELECT 'top_10_per_day_conf70', * FROM c7 WHERE ra <= 10
      UNION ALL SELECT 'top_5_per_day_edge5', * FROM e5 WHERE ra <= 5 UNION ALL SELECT 'top_10_per_day_edge5', * FROM e5 WHERE ra <= 10),
    r AS (SELECT *, (rank() OVER (PARTITION BY scenario ORDER BY confidence_score) + (count(*) OVER (PARTITION BY scenario, confidence_score) - 1) / 2e0) / count(*) OVER (PARTITION BY scenario) AS pr,
          0.5e0 + 1.5e0 * ((confidence_score - min(confidence_score) OVER w) / greatest(max(confidence_score) OVER w - min(confidence_score) OVER w, 1e-9)) AS lin FROM sc WINDOW w AS (PARTITION BY scenario)),
    k AS (SELECT *, CASE WHEN pr >= 0.9 THEN 1.75e0 WHEN pr >= 0.75 THEN 1.25e0 WHEN pr >= 0.5 THEN 1e0 ELSE 0.5e0 END AS tr FROM r),
    st AS (SELECT *, 1e0 AS flat_unit, lin / avg(lin) OVER (PARTITION BY scenario) AS confidence_linear, tr / avg(tr) OVER (PARTITION BY scenario) AS confidence_tiered FROM k)
    {_settle_sql('scenario', 'st')}""",
)
def scenario_family(spark, folder):
    bets = backtest.usable_bets(_scored(spark, folder), confidence="confidence_score", odds="odds", label="label")
    bets = bets.withColumn("confidence_edge", F.col("confidence_score") / num(100) - num(1) / F.col("odds"))
    out = backtest.settle_scenarios(
        bets, day="game_date", confidence="confidence_score", edge="confidence_edge", label="label", odds="odds", tie=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "odds"]
    )
    return _settled(out)


@query(
    "a32_overall_result",
    f"""WITH {_SCORED_SQL}, x AS (SELECT l_linestatus, label, CASE WHEN l_linestatus = 'F' THEN odds END AS odds FROM s)
    SELECT count(*) AS total_picks, CAST(sum(label) AS BIGINT) AS total_hits, round(avg(label) * 100, 6) AS hit_rate,
      round(sum(CASE WHEN label = 1 THEN CASE WHEN odds > 1 THEN odds - 1 ELSE 0 END ELSE -1 END) / count(*) * 100, 6) AS roi FROM x""",
)
def overall(spark, folder):
    x = _scored(spark, folder).withColumn("odds", F.when(F.col("l_linestatus") == "F", F.col("odds")))
    return rounded(backtest.overall_result(x, label="label", odds="odds"))


@query(
    "p14_optional_filters",
    f"""WITH {_SCORED_SQL} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, confidence_score FROM s WHERE game_date >= DATE '1997-01-01' AND game_date <= DATE '1998-12-31' AND confidence_score >= 60""",
)
def optional_filters(spark, folder):
    out = backtest.filter_bets(
        _scored(spark, folder), date="game_date", confidence="confidence_score", start="1997-01-01", end="1998-12-31", minimum=60
    )
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "confidence_score")


@query(
    "p15_usable_bets",
    """SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS confidence, value AS odds, CAST(event_type = 'purchase' AS INT) AS label
    FROM events WHERE value > 1 AND TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) IS NOT NULL""",
)
def usable_bets(spark, folder):
    from slatework.catalog.base import table

    events = table(spark, folder, "events").select(
        "event_id", F.get_json_object("props", "$.k").alias("confidence"), F.col("value").cast("string").alias("odds"),
        F.when(F.col("event_type") == "purchase", "1").alias("label"),
    )
    return backtest.usable_bets(events, confidence="confidence", odds="odds", label="label")


@query(
    "f21_probability_delta",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(1 / (1 + exp(-l_discount)), 9) AS probability,
      round_even((1 / (1 + exp(-(l_discount - l_tax * 10))) - 1 / (1 + exp(-l_discount))) * 100, 1) + 0e0 AS delta_pct FROM lineitem""",
)
def probability_delta(spark, folder):
    from slatework.catalog.base import table
    from slatework.functions import numeric

    lines = table(spark, folder, "lineitem")
    return lines.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(numeric.logistic("l_discount"), 9).alias("probability"),
        (numeric.probability_delta("l_discount", -F.col("l_tax") * num(10)) + F.lit(0.0)).alias("delta_pct"),
    )
