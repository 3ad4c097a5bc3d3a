"""Training and scoring jobs (M1-M5, M18-M27) on orders: does an order have a returned line?"""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from slatework.catalog.base import GAMES_SQL, form_games, query, rounded, table
from slatework.functions.numeric import flag
from slatework.operators import aggregates, history, slate, splits
from slatework.plans import models, scoring
from slatework.session import settle, together

FEATURES = ["lines", "quantity", "discount", "tax", "price", "balance"]
KEY = ["o_orderkey"]


def _training(spark, folder):
    flag_is = F.col("l_returnflag")
    lines = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("lines"), F.avg("l_quantity").alias("quantity"), F.max("l_discount").alias("discount"),
        F.max(F.when(F.col("l_linestatus") == "F", F.col("l_tax"))).alias("tax"), aggregates.count_if(flag_is == "R").alias("returned"),
    )
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_acctbal").alias("balance"))
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("game_date"), F.col("o_totalprice").alias("price"), "o_orderpriority")
    return orders.join(lines, "o_orderkey").join(customers, "o_custkey").withColumns({"label": flag(F.col("returned") > 0)} | {f"label_so_{t}_plus": flag(F.col("returned") >= t) for t in (1, 2, 3, 4)})


_TRAINING_SQL = """x AS (SELECT l_orderkey AS o_orderkey, count(*) AS lines, avg(l_quantity) AS quantity, max(l_tax) FILTER (l_linestatus = 'F') AS tax, count(*) FILTER (l_returnflag = 'R') AS returned FROM lineitem GROUP BY 1),
    t AS (SELECT o.o_orderkey, CAST(o_orderdate AS DATE) AS game_date, o_totalprice AS price, x.* EXCLUDE (o_orderkey), CAST(returned > 0 AS INT) AS label FROM orders o JOIN x USING (o_orderkey))"""


@query(
    "m1_median_imputation",
    f"""WITH {_TRAINING_SQL}, m AS (SELECT quantile_cont(CAST(tax AS DOUBLE), 0.5) AS tax, quantile_cont(price, 0.5) AS price FROM t)
    SELECT t.o_orderkey, round(coalesce(t.tax, m.tax), 6) AS tax_filled, round(coalesce(t.price, m.price), 6) AS price_filled, round(m.price, 6) AS price_median FROM t, m""",
)
def imputation(spark, folder):
    rows = _training(spark, folder)
    medians = models.exact_medians(rows, ["tax", "price"])
    out = models.filled(rows, medians)
    return out.select(
        *KEY, F.round("__f_tax", 6).alias("tax_filled"), F.round("__f_price", 6).alias("price_filled"), F.round(F.lit(medians["price"]), 6).alias("price_median")
    )


@query(
    "m2_class_weight",
    f"WITH {_TRAINING_SQL} SELECT o_orderkey, round(CASE WHEN label = 1 THEN (SELECT (count(*) - sum(label)) / sum(label) FROM t) ELSE 1 END, 9) AS weight FROM t",
)
def class_weight(spark, folder):
    return models.with_weight(_training(spark, folder), "label", "weight").select("o_orderkey", F.round("weight", 9).alias("weight"))


@query("m3_base_models")
def base_models(spark, folder):
    written = settle(_training(spark, folder).select(*KEY, "game_date", "label", *FEATURES))
    rows = splits.holdout_split(written, date="game_date", key=KEY)
    train, scored = rows.where("not is_holdout"), rows.where("is_holdout").withColumns({c: F.col(c).cast("double") for c in FEATURES})
    medians, settings = models.exact_medians(train, FEATURES), models.Settings()
    fitted = together([partial(models.fit_base, kind, train, FEATURES, "label", settings, medians=medians) for kind in models.BASES], settings.parallel)
    for kind, model in zip(models.BASES, fitted):
        scored = model.transform(scored, kind)
    return models.holdout_metrics(scored, "label", models.BASES)


@query("m4_stack")
def stack(spark, folder):
    _, scored = models.fit_stack(_training(spark, folder), features=FEATURES, label="label", date="game_date", key=KEY)
    return models.holdout_metrics(scored, "label")


@query("m5_threshold_family")
def threshold_family(spark, folder):
    fitted = models.fit_thresholds(settle(_training(spark, folder)), features=dict.fromkeys((1, 2, 3, 4), FEATURES), date="game_date", key=KEY)
    measured = together([partial(models.holdout_metrics, scored, f"label_so_{t}_plus", ["proba"]) for t, (_, scored) in fitted.items()], len(fitted))
    out = None
    for threshold, one in zip(fitted, measured):
        one = one.withColumn("threshold", F.lit(threshold))
        out = one if out is None else out.unionByName(one)
    return out


def _linear(spark, folder):
    rows = settle(_training(spark, folder))
    return rows.withColumns({c: F.col(c).cast("double") for c in FEATURES}), models.fit_linear(rows, FEATURES, "label")


@query("m18_slate_scoring")
def slate_scoring(spark, folder):
    rows, scorer = _linear(spark, folder)
    scored = scorer.transform(rows, "proba").withColumns(
        {"slate": F.date_trunc("month", "game_date").cast("date"), "xwoba": F.col("discount"), "barrel_rate": F.col("tax"), "avg_ev": F.col("quantity"), "pitcher_hr_per_9_30d": F.col("balance"),
         "pitcher_era_30d": F.col("lines"), "recent_hr_rate_lookback": F.col("discount"), "park_factor": F.lit(1.0), "wind_out_factor": F.lit(1.0), "temp_f": F.col("quantity"), "travel_fatigue_score": F.col("lines"), "odds": F.col("quantity") / 10}
    )
    return scoring.score_slate(scored, slate_keys=["slate"], probability="proba", key=KEY, dedupe=["o_custkey"], hit="returned", odds="odds").drop(*FEATURES)


@query("m18_starter_slate")
def starter_slate(spark, folder):
    rows, scorer = _linear(spark, folder)
    terms = slate.STARTER_SCORE["strikeouts"][1]
    inputs = {t.column: F.col(FEATURES[i % len(FEATURES)]) for i, t in enumerate(terms)}
    scored = scorer.transform(rows, "proba").withColumns(inputs | {"slate": F.date_trunc("month", "game_date").cast("date")})
    out = scoring.score_slate(scored, slate_keys=["slate"], probability="proba", key=KEY, dedupe=["o_custkey"], components=slate.STARTER_SCORE)
    return out.select("slate", "o_orderkey", "o_custkey", "proba", "score", "signal", "slate_position")


@query("m18_runtime_calibration")
def runtime_calibration(spark, folder):
    rows, scorer = _linear(spark, folder)
    scored = scorer.transform(rows, "proba").withColumn("slate", F.date_trunc("month", "game_date").cast("date"))
    ranked = slate.rank_signal(scored, slate=["slate"], score="proba", tie=KEY)
    return scoring.runtime_calibration(ranked, label="label", probability="proba", signal="STRONG_BUY")


# A score with given numbers: what a stored model is scored and explained with.
GIVEN = models.Linear(
    FEATURES, [0.25, -0.03, 12.0, -9.0, 0.000004, -0.00005], -0.4,
    {"lines": 4.0, "quantity": 25.5, "discount": 0.08, "tax": 0.06, "price": 140000.0, "balance": 4500.0},
)
_GIVEN_SQL = f"""{_TRAINING_SQL},
    w AS (SELECT o_orderkey, game_date, label, returned, lines, quantity, max_discount AS discount, tax, price, c_acctbal AS balance FROM t JOIN (SELECT l_orderkey AS o_orderkey, max(l_discount) AS max_discount FROM lineitem GROUP BY 1) USING (o_orderkey)
      JOIN orders USING (o_orderkey) JOIN customer ON c_custkey = o_custkey),
    f AS (SELECT o_orderkey, label, returned, game_date, unnest({FEATURES}) AS feature, unnest([lines, quantity, discount, tax, price, balance]::DOUBLE[]) AS value, unnest({[float(c) for c in GIVEN.coefficients]}::DOUBLE[]) AS c,
      unnest({[GIVEN.medians[x] for x in FEATURES]}::DOUBLE[]) AS m FROM w),
    i AS (SELECT *, c * (coalesce(value, m) - m) AS impact FROM f),
    b AS (SELECT {GIVEN.base()!r}::DOUBLE AS base)"""


# Games of a customer with the form over the last N of them, for every N of the sweep.
LOOKBACKS = (3, 5, 10)


def _swept(spark, folder):
    games = form_games(spark, folder).where("pa_count >= 1")
    form = history.recent_form(
        games, games, entity=["o_custkey"], date="game_date", game="l_orderkey", flags={"hr": "hr_game", "so": "so_game"}, weight="pa_count", windows=LOOKBACKS
    )
    return form.withColumn("label", F.col("hr_game"))


@query(
    "m21_lookback_counts",
    f"""WITH {GAMES_SQL}, f AS (SELECT *, CAST(hr_count > 0 AS INT) AS hr, CAST(so_count > 0 AS INT) AS so FROM games WHERE pa_count >= 1),
    p AS (SELECT a.l_orderkey, f.hr, f.so, row_number() OVER (PARTITION BY a.l_orderkey ORDER BY f.game_date DESC, f.l_orderkey DESC) AS rn FROM f a JOIN f ON f.o_custkey = a.o_custkey AND f.game_date < a.game_date),
    n AS (SELECT unnest([3, 5, 10]) AS lookback), u AS (SELECT l_orderkey, lookback, count(*) AS used, avg(hr) AS hr, avg(so) AS so FROM p, n WHERE rn <= lookback GROUP BY ALL)
    SELECT lookback, (SELECT count(*) FROM f) AS rows, count(*) AS rows_with_form, count(*) FILTER (used = lookback) AS rows_with_all, round(avg(hr), 8) AS mean_hr_rate, round(avg(so), 8) AS mean_so_rate FROM u GROUP BY 1""",
)
def lookback_counts(spark, folder):
    return rounded(models.lookback_rows(_swept(spark, folder), lookbacks=LOOKBACKS, stems=["hr", "so"]), 8)


@query("m21_lookback_sweep")
def lookback_sweep(spark, folder):
    return models.lookback_sweep(
        settle(_swept(spark, folder)), lookbacks=LOOKBACKS, stems=["hr", "so"], features=["season_hr_rate_to_date", "days_since_last_game"], label="label", date="game_date", key=["o_custkey", "l_orderkey"]
    )


# Two targets scored with given numbers over all months, in one job: a customer's best order per month and target.
_JOB_SQL = f"""{_GIVEN_SQL},
    pr AS (SELECT o_orderkey, label, returned, game_date, sum(impact) AS s FROM i GROUP BY ALL),
    cand AS (SELECT o_orderkey, CAST(date_trunc('month', game_date) AS DATE) AS slate, unnest(['hr', 'so']) AS target, unnest([1 / (1 + exp(-(base + s))), 1 / (1 + exp(-(0.5e0 - 0.8e0 * (base + s))))]) AS proba, unnest([returned, lines0 - returned]) AS hits
      FROM pr JOIN (SELECT o_orderkey, lines AS lines0 FROM w) USING (o_orderkey), b),
    cal AS (SELECT target, quantile_cont(proba, 0.9) AS q1, quantile_cont(proba, 0.75) AS q2, quantile_cont(proba, 0.5) AS q3, quantile_cont(proba, 0.25) AS q4 FROM cand GROUP BY 1),
    abs AS (SELECT c.*, o_custkey, o_orderpriority AS team, o_clerk_team AS opponent, o_totalprice / 100000 AS odds, CASE WHEN proba >= q1 THEN 'STRONG_BUY' WHEN proba >= q2 THEN 'BUY' WHEN proba >= q3 THEN 'MODERATE' WHEN proba >= q4 THEN 'AVOID' ELSE 'STRONG_SELL' END AS absolute_signal
      FROM cand c JOIN cal USING (target) JOIN (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN '1-URGENT' ELSE '2-HIGH' END AS o_clerk_team FROM orders) USING (o_orderkey)),
    one AS (SELECT * FROM abs WHERE absolute_signal <> 'STRONG_SELL' QUALIFY row_number() OVER (PARTITION BY slate, target, o_custkey ORDER BY proba DESC, o_orderkey) = 1),
    rk AS (SELECT *, row_number() OVER (PARTITION BY slate, target ORDER BY proba DESC, o_orderkey) - 1 AS place, count(*) OVER (PARTITION BY slate, target) AS n FROM one),
    cx AS (SELECT c_custkey AS o_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN '' WHEN 'MACHINERY' THEN '1-URGENT' ELSE '2-HIGH' END AS cur, (SELECT list(DISTINCT o_orderpriority) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS past FROM customer)"""


def _job(spark, folder):
    hr = GIVEN.transform(_training(spark, folder))
    so = 1 / (1 + F.exp(-(F.lit(0.5) - F.lit(0.8) * GIVEN.margin())))
    both = F.inline(F.array(
        F.struct(F.lit("hr").alias("target"), F.col("proba").alias("p"), F.col("returned").alias("hits")), F.struct(F.lit("so").alias("target"), so.alias("p"), (F.col("lines") - F.col("returned")).alias("hits"))
    ))
    rows = settle(hr.select(
        "o_orderkey", "o_custkey", F.trunc("game_date", "month").alias("slate"), F.col("o_orderpriority").alias("team"), F.when(F.col("o_orderkey") % 3 == 0, "1-URGENT").otherwise("2-HIGH").alias("opponent"),
        (F.col("price") / 100000).alias("odds"), "quantity", both,
    ).withColumnRenamed("p", "proba"))
    orders = table(spark, folder, "orders")
    past = aggregates.joined_values(orders.where("o_orderstatus = 'P'"), keys=["o_custkey"], value="o_orderpriority", name="transaction_teams")
    context = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_mktsegment") == "BUILDING", "").when(F.col("c_mktsegment") == "MACHINERY", "1-URGENT").otherwise("2-HIGH").alias("current_team"), F.lit(None).cast("string").alias("roster_teams")
    ).join(past, "o_custkey", "left")
    return scoring.slate_job(
        rows, scoring.calibrate(rows, probability="proba"), context, slate_keys=["slate"], probability="proba", key=KEY, dedupe=["o_custkey"], player="o_custkey", team="team", opponent="opponent", hit="hits", odds="odds",
        components={"size": (1.0, [slate.Term("quantity", 1.0)])},
    )


@query(
    "m18_slate_job",
    f"""WITH {_JOB_SQL}, st AS (SELECT rk.*, CASE WHEN cur <> '' AND team = cur THEN 'current_team_match' WHEN list_contains(coalesce(past, []), team) THEN 'historical_team_match' WHEN cur <> '' THEN 'possible_team_mismatch' ELSE 'unknown' END AS team_status FROM rk JOIN cx USING (o_custkey))
    SELECT slate, target, o_orderkey, o_custkey, absolute_signal, CASE WHEN place / n < 0.1e0 THEN 'STRONG_BUY' WHEN place / n < 0.25e0 THEN 'BUY' WHEN place / n < 0.5e0 THEN 'MODERATE' WHEN place / n < 0.75e0 THEN 'AVOID' ELSE 'STRONG_SELL' END AS signal, place AS slate_position,
      team_status, team_status = 'possible_team_mismatch' AS team_warning, o_custkey || ' vs ' || opponent AS title, CASE WHEN team_status = 'possible_team_mismatch' THEN 'Team may be out of date' END AS warning,
      CASE WHEN hits > 0 THEN 'Came true: ' || hits || ' counted' ELSE 'Did not come true' END AS result_summary, round(proba, 9) AS proba FROM st""",
)
def slate_predictions(spark, folder):
    out = _job(spark, folder)["predictions"]
    return out.select(
        "slate", "target", "o_orderkey", "o_custkey", "absolute_signal", "signal", "slate_position", "team_status", "team_warning", F.col("card.title").alias("title"), F.col("card.warning").alias("warning"), "result_summary", F.round("proba", 9).alias("proba")
    )


@query(
    "m18_slate_report",
    f"""WITH {_JOB_SQL}, stat AS (SELECT slate, target, count(*) AS total_picks, CAST(sum(CAST(hits > 0 AS INT)) AS BIGINT) AS total_hits, round_even(avg(CAST(hits > 0 AS INT)) * 100, 1) AS hit_rate FROM rk GROUP BY ALL),
    tm AS (SELECT slate, target, string_agg(DISTINCT team, '|' ORDER BY team) AS teams FROM rk GROUP BY ALL), mu AS (SELECT slate, target, string_agg(DISTINCT least(team, opponent) || ' vs ' || greatest(team, opponent), '|' ORDER BY least(team, opponent) || ' vs ' || greatest(team, opponent)) AS matchups FROM rk GROUP BY ALL)
    SELECT * FROM stat JOIN tm USING (slate, target) JOIN mu USING (slate, target)""",
)
def slate_report(spark, folder):
    job = _job(spark, folder)
    keys = ["slate", "target"]
    teams = aggregates.joined_values(job["teams"], keys=keys, value="team", name="teams")
    matchups = aggregates.joined_values(job["matchups"], keys=keys, value="matchup", name="matchups")
    return job["stats"].join(teams, keys).join(matchups, keys)


@query("m21_ablation")
def ablation(spark, folder):
    rows = settle(_training(spark, folder))
    groups = {"counts": ("lines", "quantity"), "rates": ("discount", "tax"), "money": ("price", "balance")}
    scenarios = {"all": FEATURES} | {f"no_{name}": [c for c in FEATURES if c not in group] for name, group in groups.items()}
    return models.ablation(rows, scenarios=scenarios, label="label", date="game_date", key=KEY)


@query(
    "m22_drivers",
    f"""WITH {_GIVEN_SQL}, r AS (SELECT o_orderkey, CASE WHEN impact > 0 THEN 'up' ELSE 'down' END AS direction, feature, value, impact FROM i WHERE abs(impact) >= 1e-6),
    n AS (SELECT *, CAST(row_number() OVER (PARTITION BY o_orderkey, direction ORDER BY abs(impact) DESC, feature) AS INT) AS rank FROM r)
    SELECT o_orderkey, direction, rank, feature, round(value, 6) AS value, round(impact, 9) AS impact, round_even((1 / (1 + exp(-(base + impact))) - 1 / (1 + exp(-base))) * 100, 1) AS delta_pct FROM n, b WHERE rank <= 3""",
)
def drivers(spark, folder):
    return models.drivers(_training(spark, folder), GIVEN, key=KEY).withColumns({"value": F.round("value", 6), "impact": F.round("impact", 9)})


@query("m22_drivers_fitted")
def drivers_fitted(spark, folder):
    rows, scorer = _linear(spark, folder)
    return models.drivers(rows, scorer.linear(FEATURES), key=KEY)


@query(
    "m23_details",
    """SELECT c_custkey, coalesce(CAST(round_even(CASE WHEN c_mktsegment <> 'BUILDING' THEN c_acctbal END, 1) AS VARCHAR), 'Unavailable') AS balance_text FROM customer""",
)
def details(spark, folder):
    rows = table(spark, folder, "customer").withColumn("balance", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal")))
    return rows.select("c_custkey", scoring.details({"Balance": ("balance", 1, 1.0)})[0]["value"].alias("balance_text"))


@query(
    "m24_proxy_distribution",
    f"""WITH {_TRAINING_SQL}, l AS (SELECT label, unnest(['quantity', 'tax']) AS feature, unnest([quantity, tax]::DOUBLE[]) AS v FROM t)
    SELECT feature, round(avg(v), 9) AS mean_all, round(avg(v) FILTER (label = 1), 9) AS mean_positive, round(avg(v) FILTER (label = 0), 9) AS mean_negative, round(quantile_cont(v, 0.5), 9) AS median_all, round(quantile_cont(v, 0.5) FILTER (label = 1), 9) AS median_positive, round(quantile_cont(v, 0.5) FILTER (label = 0), 9) AS median_negative, round(count(v) / count(*) * 100, 7) AS present_pct FROM l GROUP BY 1""",
)
def proxy(spark, folder):
    rows = models.proxy_label(_training(spark, folder), "returned", 1)
    out = models.outcome_distribution(rows, outcome="proxy_outcome", features=["quantity", "tax"])
    return rounded(out.withColumn("present_pct", F.round("present_pct", 7)), 9)


@query("m25_importances")
def importances(spark, folder):
    rows = _training(spark, folder)
    return models.importances(spark, models.fit_base("forest", rows, FEATURES, "label", models.Settings()), FEATURES)


@query("m26_cross_validation")
def cross_validation(spark, folder):
    return models.cross_validate(_training(spark, folder), features=FEATURES, label="label", key=KEY, folds=5)


@query(
    "m26_positional_split",
    f"""WITH {_TRAINING_SQL}, r AS (SELECT o_orderkey, row_number() OVER (ORDER BY game_date, o_orderkey) - 1 AS i, count(*) OVER () AS n FROM t) SELECT o_orderkey, i >= greatest(floor(n * 0.8e0), 1) AS is_holdout FROM r""",
)
def positional(spark, folder):
    return splits.positional_split(_training(spark, folder), date="game_date", key=KEY).select("o_orderkey", "is_holdout")


@query(
    "m26_stratified_split",
    f"WITH {_TRAINING_SQL} SELECT o_orderkey, label, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(o_orderkey AS VARCHAR))) <= floor(count(*) OVER (PARTITION BY label) * 0.2e0 + 0.5e0) AS is_holdout FROM t",
)
def stratified(spark, folder):
    return splits.stratified_split(_training(spark, folder), label="label", key=KEY).select(*KEY, "label", "is_holdout")


@query(
    "m26_balanced_folds",
    f"""WITH {_TRAINING_SQL}, r AS (SELECT o_orderkey, label, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(o_orderkey AS VARCHAR))) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM t)
    SELECT o_orderkey, label, CAST(len(list_filter([1, 2, 3, 4], lambda k: i >= k * n // 5)) AS INT) AS fold FROM r""",
)
def balanced_folds(spark, folder):
    return splits.hashed_folds(_training(spark, folder), key=KEY, folds=5, label="label").select(*KEY, "label", "fold")


@query(
    "m27_scored_dataset",
    f"WITH {_GIVEN_SQL} SELECT o_orderkey, label, round(1 / (1 + exp(-(base + s))), 9) AS proba FROM (SELECT o_orderkey, label, sum(impact) AS s FROM i GROUP BY ALL), b",
)
def scored_dataset(spark, folder):
    return GIVEN.transform(_training(spark, folder)).select(*KEY, "label", F.round("proba", 9).alias("proba"))


@query("m27_scored_fitted")
def scored_fitted(spark, folder):
    rows, scorer = _linear(spark, folder)
    return scorer.transform(rows, "proba").select(*KEY, "label", "proba")
