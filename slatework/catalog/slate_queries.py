"""Ranking within a slate (W13-W23): a slate is the month an order falls in."""

from __future__ import annotations

from pyspark.sql import functions as F

from slatework.catalog.base import PLAYS_SQL, plays, query, rounded, table
from slatework.operators import backtest, slate, splits
from slatework.operators.ordering import fractional_rank


def _orders(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", F.to_date("o_orderdate").alias("game_date"),
        F.date_trunc("month", "o_orderdate").cast("date").alias("slate"),
    )


_ORDERS_SQL = """o AS (SELECT o_orderkey, o_custkey, o_totalprice, CAST(o_orderdate AS DATE) AS game_date,
      CAST(date_trunc('month', o_orderdate) AS DATE) AS slate FROM orders)"""

_SIGNAL_SQL = """CASE WHEN place < 0.1e0 THEN 'STRONG_BUY' WHEN place < 0.25e0 THEN 'BUY' WHEN place < 0.5e0 THEN 'MODERATE'
           WHEN place < 0.75e0 THEN 'AVOID' ELSE 'STRONG_SELL' END"""


@query(
    "w13_rank_signal",
    f"""WITH {_ORDERS_SQL}, r AS (
      SELECT *, row_number() OVER (PARTITION BY slate ORDER BY o_totalprice DESC, o_orderkey) - 1 AS slate_position,
             count(*) OVER (PARTITION BY slate) AS slate_rows FROM o),
    p AS (SELECT *, CAST(slate_position AS DOUBLE) / slate_rows AS place FROM r)
    SELECT slate, o_orderkey, o_totalprice, slate_position, slate_rows, {_SIGNAL_SQL} AS signal FROM p""",
)
def rank_signal(spark, folder):
    ranked = slate.rank_signal(_orders(spark, folder), slate=["slate"], score="o_totalprice", tie=["o_orderkey"])
    return ranked.select("slate", "o_orderkey", "o_totalprice", "slate_position", "slate_rows", "signal")


@query(
    "w13_rank_signal_ties",
    f"""WITH {PLAYS_SQL}, r AS (
      SELECT l_linestatus, l_discount, row_number() OVER (PARTITION BY l_linestatus ORDER BY l_discount DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS pos,
             count(*) OVER (PARTITION BY l_linestatus) AS n FROM plays),
    p AS (SELECT *, CAST(pos AS DOUBLE) / n AS place FROM r)
    SELECT l_linestatus, l_discount, {_SIGNAL_SQL} AS signal, count(*) AS n_rows, min(pos) AS first_position, max(pos) AS last_position
    FROM p GROUP BY ALL""",
)
def rank_signal_ties(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_linestatus", "l_discount", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    ranked = slate.rank_signal(
        lines, slate=["l_linestatus"], score="l_discount", tie=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    )
    return ranked.groupBy("l_linestatus", "l_discount", "signal").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("slate_position").alias("first_position"), F.max("slate_position").alias("last_position")
    )


def _scored(spark, folder):
    """Orders with the inputs of the hitter and starter scores, some of them missing."""
    lines = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.max("l_discount").alias("xwoba"),
        F.max(F.when(F.col("l_returnflag") == "R", F.col("l_tax"))).alias("barrel_rate"),
        F.max("l_quantity").alias("avg_ev"),
        F.min("l_tax").alias("pitcher_hr_per_9_30d"),
        F.max("l_linenumber").cast("double").alias("pitcher_era_30d"),
        F.min("l_discount").alias("recent_hr_rate_lookback"),
        F.min(F.when(F.col("l_linestatus") == "F", F.col("l_quantity"))).alias("temp_f"),
        F.count(F.lit(1)).cast("double").alias("travel_fatigue_score"),
    )
    return _orders(spark, folder).join(lines, "o_orderkey").withColumns(
        {"park_factor": F.lit(1.0), "wind_out_factor": F.col("o_totalprice")}
    )


def _position_sql(column: str, default: float) -> str:
    """Place in the slate's range of present values; 0.5 in a flat or empty one; missing values at the default's place."""
    low, high = f"min({column}) OVER w", f"max({column}) OVER w"
    place = f"least(1e0, greatest(0e0, (coalesce({column}, {default}e0) - {low}) / ({high} - {low})))"
    return f"CASE WHEN {high} IS NULL OR {high} = {low} THEN 0.5e0 ELSE {place} END AS {column}"


_SCORED_SQL = f"""{_ORDERS_SQL}, x AS (
      SELECT l_orderkey AS o_orderkey, coalesce(max(l_discount), 0.32e0) AS xw, max(l_tax) FILTER (l_returnflag = 'R') AS br, max(l_quantity) AS ev,
             min(l_tax) AS hr9, CAST(max(l_linenumber) AS DOUBLE) AS era, min(l_discount) AS fm,
             CASE WHEN count(*) FILTER (l_linestatus = 'F' AND l_quantity IS NOT NULL) > 0 THEN greatest(min(l_quantity) FILTER (l_linestatus = 'F'), 40e0) END AS tf, CAST(count(*) AS DOUBLE) AS fat
      FROM lineitem GROUP BY 1),
    s AS (SELECT o.*, x.* EXCLUDE (o_orderkey) FROM o JOIN x USING (o_orderkey)),
    n AS (SELECT slate, o_orderkey, """ + ", ".join(
    _position_sql(c, default) for c, default in {"xw": 0.32, "br": 0.06, "ev": 88, "hr9": 1.2, "era": 4, "fm": 0.03, "tf": 72, "fat": 0}.items()
) + """, CASE WHEN max(o_totalprice) OVER w = min(o_totalprice) OVER w THEN 0.5e0 ELSE (o_totalprice - min(o_totalprice) OVER w) / (max(o_totalprice) OVER w - min(o_totalprice) OVER w) END AS wind,
             max(fat) OVER w = min(fat) OVER w AS flat FROM s WINDOW w AS (PARTITION BY slate)),
    c AS (SELECT *, xw * 0.45e0 + br * 0.35e0 + ev * 0.2e0 AS power, hr9 * 0.6e0 + era * 0.4e0 AS matchup, fm AS form,
             0.5e0 * 0.5e0 + wind * 0.3e0 + tf * 0.2e0 AS environment, CASE WHEN flat THEN 0.5e0 ELSE 1e0 - fat END AS freshness FROM n)"""


@query(
    "w14_slate_composite",
    f"""WITH {_SCORED_SQL}
    SELECT slate, o_orderkey, round_even((power * 0.3e0 + matchup * 0.25e0 + form * 0.2e0 + environment * 0.15e0 + freshness * 0.1e0) * 100e0, 1) AS score FROM c""",
)
def slate_composite(spark, folder):
    scored = slate.slate_score(_scored(spark, folder), slate=["slate"], components=slate.HITTER_SCORE)
    return scored.select("slate", "o_orderkey", "score")


def _starters(spark, folder):
    return table(spark, folder, "lineitem").groupBy(
        "l_suppkey", F.date_trunc("month", "l_shipdate").cast("date").alias("slate")
    ).agg(
        F.max("l_quantity").alias("starter_k_per_9_30d"),
        F.count(F.lit(1)).cast("double").alias("starter_avg_so_30d"),
        F.max(F.when(F.col("l_returnflag") == "R", F.col("l_tax"))).alias("starter_k_percent_season"),
        F.min("l_discount").alias("starter_whiff_percent_season"),
        F.max("l_linenumber").cast("double").alias("opp_team_k_rate_14d"),
        F.min("l_quantity").alias("opp_team_pa_per_game_14d"),
        F.max("l_discount").alias("starter_avg_ip_30d"),
    )


_STARTERS = {"k9": 8, "so": 4.5, "ks": 22, "wh": 24, "ok": 0.22, "pa": 38, "ip": 5}


@query(
    "w15_starter_score",
    """WITH s AS (SELECT l_suppkey, CAST(date_trunc('month', l_shipdate) AS DATE) AS slate, max(l_quantity) AS k9, CAST(count(*) AS DOUBLE) AS so,
        max(l_tax) FILTER (l_returnflag = 'R') AS ks, min(l_discount) AS wh, CAST(max(l_linenumber) AS DOUBLE) AS ok, min(l_quantity) AS pa, max(l_discount) AS ip
      FROM lineitem GROUP BY ALL),
    n AS (SELECT l_suppkey, slate, """
    + ", ".join(
        _position_sql(c, default) for c, default in _STARTERS.items()
    )
    + """ FROM s WINDOW w AS (PARTITION BY slate))
    SELECT l_suppkey, slate, round_even((k9 * 0.26e0 + so * 0.24e0 + ks * 0.16e0 + wh * 0.14e0 + ok * 0.12e0 + pa * 0.04e0 + ip * 0.04e0) * 1e0 * 100e0, 1) AS score FROM n""",
)
def starter_score(spark, folder):
    scored = slate.slate_score(_starters(spark, folder), slate=["slate"], components=slate.STARTER_SCORE)
    return scored.select("l_suppkey", "slate", "score")


@query(
    "w16_component_rank",
    f"""WITH {_SCORED_SQL}, long AS (
      SELECT slate, o_orderkey, label, ord, round_even(v * 100e0, 1) AS v FROM (
        SELECT slate, o_orderkey, unnest([power, matchup, form, environment, freshness]) AS v,
               unnest(['Power quality', 'Pitcher matchup', 'Recent form', 'Park and environment', 'Freshness']) AS label, unnest([1, 2, 3, 4, 5]) AS ord FROM c)),
    r AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY v DESC, ord) AS rn FROM long)
    SELECT slate, o_orderkey, max(label) FILTER (rn = 1) AS first_component, max(label) FILTER (rn = 2) AS second_component, max(v) FILTER (rn = 1) AS first_score
    FROM r GROUP BY ALL""",
)
def component_rank(spark, folder):
    scored = slate.slate_score(_scored(spark, folder), slate=["slate"], components=slate.HITTER_SCORE, keep_components=True)
    ranked = slate.top_components(
        {
            "power_component": "Power quality", "matchup_component": "Pitcher matchup", "form_component": "Recent form",
            "environment_component": "Park and environment", "freshness_component": "Freshness",
        }
    )
    return scored.withColumn("c", ranked).select(
        "slate", "o_orderkey", F.col("c")[0]["label"].alias("first_component"), F.col("c")[1]["label"].alias("second_component"),
        F.col("c")[0]["score"].alias("first_score"),
    )


@query(
    "w17_top_n_per_day",
    f"""WITH {_ORDERS_SQL} SELECT o_orderkey, game_date, o_totalprice FROM o
    QUALIFY row_number() OVER (PARTITION BY game_date ORDER BY o_totalprice DESC, o_orderkey) <= 3""",
)
def top_n_per_day(spark, folder):
    best = slate.top_n_per_day(_orders(spark, folder), day="game_date", score="o_totalprice", tie=["o_orderkey"], n=3)
    return best.select("o_orderkey", "game_date", "o_totalprice")


@query(
    "w18_percent_rank",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
        round((rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2e0) / count(*) OVER (), 9) AS percentile_rank FROM lineitem""",
)
def percent_rank(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return rounded(fractional_rank(lines, [], "l_quantity"), 9)


@query(
    "w19_slate_dedupe",
    f"""WITH {_ORDERS_SQL} SELECT o_custkey, slate, o_orderkey, o_totalprice FROM o
    QUALIFY row_number() OVER (PARTITION BY o_custkey, slate ORDER BY o_totalprice DESC, o_orderkey) = 1""",
)
def slate_dedupe(spark, folder):
    best = slate.best_per_key(_orders(spark, folder), keys=["o_custkey", "slate"], score="o_totalprice", tie=["o_orderkey"])
    return best.select("o_custkey", "slate", "o_orderkey", "o_totalprice")


@query(
    "w20_holdout_split",
    f"""WITH {_ORDERS_SQL}, d AS (SELECT game_date, dense_rank() OVER (ORDER BY game_date DESC) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT game_date FROM o))
    SELECT o_orderkey, o.game_date, r <= greatest(ceil(n * 0.2e0), 1) AS is_holdout FROM o JOIN d USING (game_date)""",
)
def holdout_split(spark, folder):
    split = splits.holdout_split(_orders(spark, folder), date="game_date", key=["o_orderkey"])
    return split.select("o_orderkey", "game_date", "is_holdout")


@query(
    "w20_quantile_split",
    f"""WITH {_ORDERS_SQL}, d AS (SELECT game_date, row_number() OVER (ORDER BY game_date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT game_date FROM o))
    SELECT o_orderkey, o.game_date, i > floor(n * 0.8e0) AS is_holdout FROM o JOIN d USING (game_date)""",
)
def quantile_split(spark, folder):
    split = splits.date_quantile_split(_orders(spark, folder), date="game_date")
    return split.select("o_orderkey", "game_date", "is_holdout")


@query(
    "w21_time_folds",
    f"""WITH {_ORDERS_SQL}, r AS (SELECT o_orderkey, row_number() OVER (ORDER BY game_date, o_orderkey) - 1 AS i, count(*) OVER () AS n FROM o)
    SELECT o_orderkey, CAST(CASE WHEN i < n - 5 * (n // 6) THEN 0 ELSE (i - (n - 5 * (n // 6))) // (n // 6) + 1 END AS INT) AS fold FROM r""",
)
def time_folds(spark, folder):
    return splits.expanding_folds(_orders(spark, folder), date="game_date", key=["o_orderkey"]).select("o_orderkey", "fold")


_BETS_SQL = f"""{PLAYS_SQL}, bets AS (SELECT game_date, 0.3e0 + l_discount AS p, 1e0 + 0.5e0 + l_tax * 30e0 AS odds, CAST(l_returnflag = 'R' AS INT) AS y FROM plays),
    grown AS (SELECT *, least(0.25e0 * (p - 1 / odds) / (odds - 1), 0.25e0) AS f FROM bets WHERE p - 1 / odds > 0)"""


def _bets(spark, folder):
    return plays(spark, folder).select(
        "game_date", (F.lit(0.3) + F.col("l_discount")).alias("p"), (F.lit(1.0) + F.lit(0.5) + F.col("l_tax") * F.lit(30.0)).alias("odds"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
    )


@query(
    "w22_kelly",
    f"""WITH {_BETS_SQL}, tagged AS (
      SELECT *, 'all' AS rule FROM grown UNION ALL SELECT *, 'edge_5' FROM grown WHERE p - 1 / odds > 0.05 UNION ALL SELECT *, 'confident' FROM grown WHERE p > 0.36)
    SELECT rule, count(*) AS bets, round(avg(y), 9) AS win_rate, round(sum(ln(CASE WHEN y = 1 THEN 1 + f * (odds - 1) ELSE 1 - f END)), 5) AS log_growth
    FROM tagged GROUP BY rule""",
)
def kelly(spark, folder):
    rules = {"all": F.lit(True), "edge_5": F.col("p") - 1 / F.col("odds") > 0.05, "confident": F.col("p") > 0.36}
    out = backtest.kelly_results(_bets(spark, folder), rules=rules, probability="p", odds="odds", label="y")
    return out.select("rule", "bets", F.round("win_rate", 9).alias("win_rate"), (F.round("log_growth", 5) + F.lit(0.0)).alias("log_growth"))


@query(
    "w22_kelly_curve",
    f"""WITH {_BETS_SQL}, d AS (SELECT game_date, count(*) AS bets, sum(ln(CASE WHEN y = 1 THEN 1 + f * (odds - 1) ELSE 1 - f END)) AS g FROM grown GROUP BY 1)
    SELECT game_date, bets, round(sum(g) OVER (ORDER BY game_date), 5) AS log_growth FROM d""",
)
def kelly_curve(spark, folder):
    out = backtest.kelly_curve(_bets(spark, folder), day="game_date", probability="p", odds="odds", label="y")
    return out.select("game_date", "bets", (F.round("log_growth", 5) + F.lit(0.0)).alias("log_growth"))


@query(
    "w23_lineup_outlook",
    """WITH x AS (SELECT l_suppkey AS team, concat_ws('-', l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS INT), l_extendedprice) AS player, l_linenumber AS slot,
        l_discount AS hit, l_discount * 0.55e0 + l_tax * 0.3e0 + coalesce(CASE WHEN l_returnflag <> 'N' THEN l_tax END, 0.32e0) * 0.15e0 AS damage,
        coalesce(CASE WHEN l_returnflag = 'R' THEN l_tax END, 0.22e0) * 0.3e0 + l_discount * 0.45e0 + l_tax * 0.25e0 AS risk FROM lineitem),
    y AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY CASE WHEN slot > 0 THEN slot ELSE 99 END, hit DESC, player) AS a,
        row_number() OVER (PARTITION BY team ORDER BY risk DESC, player) AS b, row_number() OVER (PARTITION BY team ORDER BY damage DESC, player) AS c FROM x)
    SELECT team, string_agg(player, '|' ORDER BY a) FILTER (a <= 9) AS expected_order, string_agg(player, '|' ORDER BY b) FILTER (b <= 3) AS strikeout_risks,
        string_agg(player, '|' ORDER BY c) FILTER (c <= 3) AS damage_threats FROM y GROUP BY team""",
)
def lineup_outlook(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("team"),
        F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey")], F.col("l_quantity").cast("int").cast("string"), F.col("l_extendedprice").cast("string")).alias("player"),
        F.col("l_linenumber").alias("slot"), F.col("l_discount").alias("hit"), F.col("l_tax").alias("hr"),
        F.when(F.col("l_returnflag") != "N", F.col("l_tax")).alias("xwoba"),
        F.when(F.col("l_returnflag") == "R", F.col("l_tax")).alias("recent_so"),
    )
    out = slate.hitter_outlook(
        lines, team=["team"], player="player", slot="slot", hit="hit", home_run="hr", xwoba="xwoba", recent_so="recent_so", k_rate="hit", whiff_rate="hr"
    )
    return out.select("team", *[F.array_join(c, "|").alias(c) for c in ("expected_order", "strikeout_risks", "damage_threats")])


@query(
    "m18_slate_stats",
    f"""WITH {_ORDERS_SQL} SELECT slate, count(*) AS total_picks, CAST(sum(CAST(o_totalprice > 200000 AS INT)) AS BIGINT) AS total_hits,
      round_even(avg(CAST(o_totalprice > 200000 AS INT)) * 100e0, 1) AS hit_rate FROM o GROUP BY slate""",
)
def slate_stats(spark, folder):
    return slate.slate_stats(_orders(spark, folder).withColumn("won", F.col("o_totalprice") > 200000), slate=["slate"], hit="won")


@query(
    "m18_matchup_list",
    f"""WITH {PLAYS_SQL} SELECT DISTINCT p.game_date, CAST(least(c.c_nationkey, s.s_nationkey) AS VARCHAR) || ' vs ' || CAST(greatest(c.c_nationkey, s.s_nationkey) AS VARCHAR) AS matchup
    FROM plays p JOIN customer c ON c.c_custkey = p.o_custkey JOIN supplier s ON s.s_suppkey = p.l_suppkey""",
)
def matchup_list(spark, folder):
    home = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("team"))
    away = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("opponent"))
    return slate.matchup_list(
        plays(spark, folder).join(home, "o_custkey").join(away, "l_suppkey"), slate=["game_date"], team="team", opponent="opponent"
    )


@query(
    "m19_starter_override",
    """WITH top AS (SELECT l_orderkey, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_suppkey) = 1),
    new AS (SELECT s_nationkey AS opp, min(s_suppkey) AS sup, avg(s_acctbal) AS era FROM supplier GROUP BY 1 HAVING avg(s_acctbal) > 4500)
    SELECT o.o_orderkey, CASE WHEN n.sup IS NOT NULL THEN n.sup ELSE t.l_suppkey END AS pitcher,
      round(CASE WHEN n.sup IS NOT NULL THEN n.era ELSE o.o_totalprice END, 4) AS era, n.sup IS NOT NULL AS starter_override_applied
    FROM orders o JOIN top t ON t.l_orderkey = o.o_orderkey JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN new n ON n.opp = c.c_nationkey""",
)
def starter_override(spark, folder):
    from slatework.operators.ordering import top_rows

    teams = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("opponent"))
    top = top_rows(
        table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_extendedprice", F.col("l_suppkey").alias("pitcher")),
        ["o_orderkey"], [F.col("l_extendedprice").desc(), F.col("pitcher")],
    )
    rows = _orders(spark, folder).join(teams, "o_custkey").join(top, "o_orderkey").select("o_orderkey", "opponent", "pitcher", F.col("o_totalprice").alias("era"))
    overrides = table(spark, folder, "supplier").groupBy(F.col("s_nationkey").alias("opponent")).agg(
        F.min("s_suppkey").alias("pitcher"), F.avg("s_acctbal").alias("era")
    ).where("era > 4500")
    out = slate.override_starters(rows, overrides, opponent="opponent", pitcher="pitcher", features={"era": 4.5})
    return out.select("o_orderkey", "pitcher", F.round("era", 4).alias("era"), "starter_override_applied")


@query(
    "m19_starter_options",
    """WITH now AS (SELECT n_nationkey AS team, CASE WHEN n_regionkey <= 2 THEN n_name ELSE '' END AS pitcher FROM nation),
    rows AS (SELECT DISTINCT team, pitcher, s_name AS candidate, 1 AS listed FROM now JOIN supplier ON s_nationkey = team
      UNION ALL SELECT team, pitcher, pitcher, 0 FROM now WHERE pitcher <> '' AND (team, pitcher) NOT IN (SELECT (s_nationkey, s_name) FROM supplier))
    SELECT team, pitcher, row_number() OVER (PARTITION BY team ORDER BY listed, candidate) - 1 AS place, candidate, count(*) OVER (PARTITION BY team) AS candidates FROM rows""",
)
def starter_options(spark, folder):
    current = table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("team"), F.when(F.col("n_regionkey") <= 2, F.col("n_name")).otherwise("").alias("pitcher")
    )
    roster = table(spark, folder, "supplier").select(F.col("s_nationkey").alias("team"), F.col("s_name").alias("pitcher"))
    return slate.starter_options(current, roster, team="team", pitcher="pitcher")
