"""Grouped summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from slatework.catalog.base import PLAYS_SQL, plays, query, rounded, table
from slatework.functions.numeric import blend, mean_of_ratios, num, ratio_of_sums, weighted_mean
from slatework.operators import aggregates as agg
from slatework.operators.backtest import unit_profit
from slatework.operators.ordering import top_rows


@query("a2_mode", "SELECT l_orderkey, mode() WITHIN GROUP (ORDER BY l_returnflag) AS usual_flag FROM lineitem GROUP BY 1")
def mode(spark, folder):
    return agg.most_frequent(table(spark, folder, "lineitem"), keys=["l_orderkey"], value="l_returnflag", name="usual_flag")


@query(
    "a3_filtered_aggregates",
    """SELECT user_id, count(*) FILTER (event_type <> 'error') AS good_events, round(sum(value) FILTER (event_type = 'purchase'), 4) AS spent, round(avg(value) FILTER (event_type = 'view'), 9) AS view_mean FROM events GROUP BY 1""",
)
def filtered(spark, folder):
    kind, value = F.col("event_type"), F.col("value")
    return table(spark, folder, "events").groupBy("user_id").agg(
        agg.count_if(kind != "error").alias("good_events"), F.round(F.sum(F.when(kind == "purchase", value)), 4).alias("spent"), F.round(F.avg(F.when(kind == "view", value)), 9).alias("view_mean")
    )


@query(
    "a4_any_in_game",
    f"""WITH {PLAYS_SQL}, g AS (SELECT o_custkey, l_orderkey, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS r, max(CASE WHEN l_quantity > 45 THEN 1 ELSE 0 END) AS b FROM plays GROUP BY ALL)
    SELECT o_custkey, count(*) AS games, round(avg(r), 9) AS returned_rate, round(avg(b), 9) AS bulk_rate FROM g GROUP BY 1""",
)
def any_in_game(spark, folder):
    conditions = {"returned": F.col("l_returnflag") == "R", "bulk": F.col("l_quantity") > 45}
    return rounded(agg.any_then_rate(plays(spark, folder), entity=["o_custkey"], game="l_orderkey", conditions=conditions), 9)


@query(
    "a5_distinct_counts",
    "SELECT l_returnflag, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1",
)
def distinct_counts(spark, folder):
    return agg.distinct_counts(table(spark, folder, "lineitem"), ["l_returnflag"], {"orders": "l_orderkey", "parts": "l_partkey", "suppliers": "l_suppkey"})


@query("a6_mean_of_ratios", "SELECT l_suppkey, round(avg(l_discount / nullif(l_tax, 0) * 9), 8) AS era, round(avg(l_linenumber / nullif(l_tax, 0)), 7) AS whip FROM lineitem GROUP BY 1")
def ratios_mean(spark, folder):
    return table(spark, folder, "lineitem").groupBy("l_suppkey").agg(
        F.round(mean_of_ratios("l_discount", "l_tax", 9), 8).alias("era"), F.round(mean_of_ratios("l_linenumber", "l_tax"), 7).alias("whip")
    )


@query(
    "a7_ratio_of_sums",
    "SELECT l_orderkey, round(CASE WHEN sum(l_tax) > 0 THEN sum(l_discount) / sum(l_tax) * 9 END, 8) AS era, round(sum(l_linenumber) / sum(l_quantity), 9) AS per_unit FROM lineitem GROUP BY 1",
)
def sums_ratio(spark, folder):
    return table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.round(ratio_of_sums("l_discount", "l_tax", 9), 8).alias("era"), F.round(ratio_of_sums("l_linenumber", "l_quantity"), 9).alias("per_unit")
    )


@query(
    "a8_weighted_average",
    """SELECT l_suppkey, l_returnflag, round(sum(coalesce(CASE WHEN l_linestatus = 'F' THEN l_discount END, 0) * greatest(l_quantity - 10, 0)) / nullif(sum(greatest(l_quantity - 10, 0)), 0), 9) AS rate FROM lineitem GROUP BY ALL""",
)
def weighted(spark, folder):
    rate = weighted_mean(F.when(F.col("l_linestatus") == "F", F.col("l_discount")), F.col("l_quantity") - 10)
    return table(spark, folder, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.round(rate, 9).alias("rate"))


@query(
    "a9_two_point_blend",
    """WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag <> 'N' THEN l_discount END AS a, CASE WHEN l_linestatus = 'F' THEN l_tax END AS b, l_quantity - 5 AS wa, l_linenumber - 2 AS wb FROM lineitem),
    y AS (SELECT *, a IS NOT NULL AND wa > 0 AS ua, b IS NOT NULL AND wb > 0 AS ub FROM x)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((CASE WHEN ua THEN a * wa ELSE 0 END + CASE WHEN ub THEN b * wb ELSE 0 END) / nullif(CASE WHEN ua THEN wa ELSE 0 END + CASE WHEN ub THEN wb ELSE 0 END, 0), 9) AS blended FROM y""",
)
def two_point(spark, folder):
    first = F.when(F.col("l_returnflag") != "N", F.col("l_discount"))
    second = F.when(F.col("l_linestatus") == "F", F.col("l_tax"))
    value = blend([(first, F.col("l_quantity") - 5), (second, F.col("l_linenumber") - 2)])
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(value, 9).alias("blended"))


@query(
    "a10_sorted_distinct_concat",
    "SELECT l_partkey, string_agg(DISTINCT CAST(s_nationkey AS VARCHAR), '|' ORDER BY CAST(s_nationkey AS VARCHAR)) AS teams FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1",
)
def sorted_concat(spark, folder):
    venues = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("string").alias("team"))
    return agg.joined_values(table(spark, folder, "lineitem").join(venues, "l_suppkey"), keys=["l_partkey"], value="team", name="teams")


@query(
    "a12_key_counts",
    "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL",
)
def key_counts(spark, folder):
    return table(spark, folder, "lineitem").groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))


@query(
    "a13_mix_profile",
    """WITH e AS (SELECT l_suppkey, l_returnflag, l_orderkey, l_linestatus, l_discount, rank() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS r FROM lineitem)
    SELECT l_suppkey, l_returnflag, count(*) AS usage_count, round(avg(CASE WHEN l_linestatus ILIKE '%f%' THEN 1 ELSE 0 END), 9) AS whiff_rate, round(avg(CASE WHEN r = 1 AND l_discount > 0.05 THEN 1 ELSE 0 END), 9) AS finish_rate
    FROM e GROUP BY ALL""",
)
def mix(spark, folder):
    profile = agg.mix_profile(
        table(spark, folder, "lineitem"), entity=["l_suppkey"], kind="l_returnflag", parent="l_orderkey", order=["l_linenumber", "l_partkey", "l_suppkey"],
        miss=F.col("l_linestatus").ilike("%f%"), finish=F.col("l_discount") > 0.05,
    )
    return rounded(profile, 9)


@query(
    "a13_usage_share",
    "WITH p AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, event_type, n, round(n / sum(n) OVER (PARTITION BY user_id), 9) AS usage_share FROM p",
)
def usage_share(spark, folder):
    counted = table(spark, folder, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return rounded(agg.usage_share(counted, entity=["user_id"], usage="n"), 9)


_PROFILE_SQL = "p AS (SELECT l_suppkey, l_partkey, sum(l_quantity) AS usage, avg(CASE WHEN l_linestatus = 'F' THEN l_discount END) AS whiff FROM lineitem GROUP BY ALL)"


@query(
    "a14_top2_pivot",
    f"""WITH {_PROFILE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY usage DESC, l_partkey) AS rn FROM p)
    SELECT l_suppkey, max(l_partkey) FILTER (rn = 1) AS primary_l_partkey, max(usage) FILTER (rn = 1) AS primary_usage, round(max(whiff) FILTER (rn = 1), 9) AS primary_whiff,
      max(l_partkey) FILTER (rn = 2) AS secondary_l_partkey, max(usage) FILTER (rn = 2) AS secondary_usage, round(max(whiff) FILTER (rn = 2), 9) AS secondary_whiff,
      round(sum(coalesce(whiff, 0) * usage) / sum(usage), 9) AS overall_whiff FROM r GROUP BY 1""",
)
def top2(spark, folder):
    profile = table(spark, folder, "lineitem").groupBy("l_suppkey", "l_partkey").agg(
        F.sum("l_quantity").alias("usage"), F.avg(F.when(F.col("l_linestatus") == "F", F.col("l_discount"))).alias("whiff")
    )
    return rounded(agg.top_two(profile, entity=["l_suppkey"], kind="l_partkey", usage="usage", metrics=["whiff"]), 9)


@query(
    "a15_pivot_avg",
    "SELECT user_id, " + ", ".join(f"round(avg(value) FILTER (event_type = '{t}'), 9) AS value_{t}" for t in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY 1",
)
def pivot(spark, folder):
    kinds = ["click", "error", "purchase", "signup", "view"]
    return rounded(agg.pivot_means(table(spark, folder, "events"), keys=["user_id"], category="event_type", values=kinds, measures=["value"]), 9)


def _batted(spark, folder):
    """Line items read as batted balls, with missing readings."""
    return table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("player_id"),
        F.year("l_shipdate").alias("season"),
        F.when(F.col("l_returnflag") == "R", F.when(F.col("l_discount") > 0.05, "home_run").otherwise("single"))
        .when(F.col("l_returnflag") == "A", F.when(F.col("l_discount") > 0.05, "strikeout").otherwise("walk")).alias("events"),
        F.when(F.col("l_linestatus") == "F", F.col("l_quantity") + num(60)).alias("launch_speed"),
        F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("launch_angle"),
        F.when(F.col("l_linenumber") <= 2, "fly_ball").when(F.col("l_linenumber") == 4, "ground_ball").when(F.col("l_linenumber") == 5, "line_drive").when(F.col("l_linenumber") == 6, "popup").alias("bb_type"),
        F.when(F.col("l_tax") > 0.01, "R").when(F.col("l_tax") > 0, "L").alias("stand"),
        F.when(F.col("l_discount") > 0.04, "R").otherwise("L").alias("p_throws"),
    )


_BATTED_SQL = """b AS (SELECT l_suppkey AS player_id, CAST(year(l_shipdate) AS INT) AS season,
      CASE WHEN l_returnflag = 'R' THEN CASE WHEN l_discount > 0.05 THEN 'home_run' ELSE 'single' END WHEN l_returnflag = 'A' THEN CASE WHEN l_discount > 0.05 THEN 'strikeout' ELSE 'walk' END END AS ev,
      CASE WHEN l_linestatus = 'F' THEN l_quantity + 60 END AS sp, CASE WHEN l_linenumber <> 3 THEN l_quantity END AS an,
      CASE WHEN l_linenumber <= 2 THEN 'fly_ball' WHEN l_linenumber = 4 THEN 'ground_ball' WHEN l_linenumber = 5 THEN 'line_drive' WHEN l_linenumber = 6 THEN 'popup' END AS bb,
      CASE WHEN l_tax > 0.01 THEN 'R' WHEN l_tax > 0 THEN 'L' END AS st, CASE WHEN l_discount > 0.04 THEN 'R' ELSE 'L' END AS pt FROM lineitem)"""


@query(
    "a16_contact_pack",
    f"""WITH {_BATTED_SQL}, x AS (SELECT player_id, season, count(*) AS pa, count(ev) AS ab, count(*) FILTER (ev IN ('single', 'home_run')) AS hits, count(*) FILTER (ev = 'home_run') AS hr,
        count(*) FILTER (ev = 'strikeout') AS so, count(*) FILTER (ev = 'walk') AS bb,
        avg(CASE WHEN sp >= 95 THEN 100e0 ELSE 0 END) AS ev95, avg(CASE WHEN an BETWEEN 15 AND 30 THEN 100e0 ELSE 0 END) AS sweet, avg(sp) AS speed, avg(an) FILTER (sp IS NOT NULL) AS angle,
        avg(CASE WHEN sp >= 98 AND an BETWEEN 26 AND 30 THEN 100e0 ELSE 0 END) AS barrel,
        count(*) FILTER (bb = 'fly_ball') / nullif(count(bb), 0) * 100 AS fb, count(*) FILTER (bb = 'ground_ball') / nullif(count(bb), 0) * 100 AS gb,
        count(*) FILTER (bb = 'line_drive') / nullif(count(bb), 0) * 100 AS ld, count(*) FILTER (bb = 'popup') / nullif(count(bb), 0) * 100 AS iff,
        avg(CASE WHEN st = pt THEN 100e0 ELSE 0 END) AS pull, avg(CASE WHEN st IS NULL THEN 100e0 ELSE 0 END) AS center, avg(CASE WHEN st <> pt THEN 100e0 ELSE 0 END) AS oppo FROM b GROUP BY ALL),
    y AS (SELECT *, coalesce(hits / nullif(ab, 0), 0) AS a, (hits + bb) / pa AS o FROM x)
    SELECT player_id, season, pa, ab, hits, hr, so, bb, round(a, 8) AS avg, round(o, 8) AS obp, round(ev95, 8) AS ev95_plus, round(sweet, 8) AS sweet_spot_percent, round(coalesce(speed, 0), 8) AS avg_hit_speed,
      round(coalesce(angle, 0), 8) AS avg_hit_angle, round(barrel, 8) AS barrel_rate, round(coalesce(fb, 0), 8) AS fb_percent, round(coalesce(gb, 0), 8) AS gb_percent, round(coalesce(ld, 0), 8) AS ld_percent, round(coalesce(iff, 0), 8) AS iffb_percent,
      round(pull, 8) AS pull_percent, round(center, 8) AS center_percent, round(oppo, 8) AS oppo_percent, CAST(trunc((o * 1.25e0 + a * 0.5e0) * 100e0) AS INT) AS wrc_plus FROM y""",
)
def contact_pack(spark, folder):
    return rounded(agg.contact_pack(_batted(spark, folder), ["player_id", "season"]), 8)


@query(
    "a17_pitching_pack",
    f"""WITH {_BATTED_SQL}, x AS (SELECT player_id, season, count(*) AS pa, count(*) / 4.5e0 AS ip, count(*) FILTER (ev IN ('single', 'home_run')) AS h, count(*) FILTER (ev = 'home_run') AS hr,
        count(*) FILTER (ev = 'strikeout') AS so, count(*) FILTER (ev = 'walk') AS bb, avg(sp) AS speed, avg(CASE WHEN sp >= 98 AND an BETWEEN 26 AND 30 THEN 100e0 ELSE 0 END) AS barrel FROM b GROUP BY ALL)
    SELECT player_id, season, pa, round(ip, 8) AS innings_pitched, h AS hits_allowed, hr AS hr_allowed, so, bb AS bb_allowed, round((hr * 4 + h) / ip * 9, 8) AS era, round((13 * hr + 3 * bb - 2 * so) / ip, 8) AS fip,
      round(hr / ip * 9, 8) AS hr_per_9, round((h + bb) / ip, 8) AS whip, round(so / pa * 100, 8) AS k_percent, round(bb / pa * 100, 8) AS bb_percent, round(coalesce(speed, 0), 8) AS avg_hit_speed_allowed, round(barrel, 8) AS barrel_rate_allowed FROM x""",
)
def pitching_pack(spark, folder):
    return rounded(agg.pitching_pack(_batted(spark, folder), ["player_id", "season"]), 8)


@query(
    "a18_play_mix",
    """WITH x AS (SELECT l_suppkey, count(*) AS n, count(*) FILTER (p_type = 'PROMO') AS hr, count(*) FILTER (p_type = 'ECONOMY') AS k, count(*) FILTER (p_type = 'STANDARD') AS w,
        count(*) FILTER (p_name LIKE '%ring%') AS fl, count(*) FILTER (p_name LIKE '%bolt%') AS gr, count(*) FILTER (p_name LIKE '%widget%') AS li
      FROM lineitem JOIN (SELECT p_partkey, p_type, p_name FROM part) ON p_partkey = l_partkey GROUP BY 1)
    SELECT l_suppkey, n AS plays, hr AS hr_allowed, k AS strikeouts, w AS walks, fl AS fly_balls, gr AS ground_balls, li AS line_drives, round(k / n * 100, 8) AS k_rate_pct, round(hr / n * 100, 8) AS hr_rate_pct,
      round(coalesce(fl / nullif(fl + gr + li, 0), 0) * 100, 8) AS fly_ball_pct FROM x""",
)
def play_mix(spark, folder):
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat_ws(" ", "p_type", "p_name").alias("result"), "p_type")
    lines = table(spark, folder, "lineitem").join(parts, "l_partkey")
    # One text column holds both the class and the play, as in play-by-play data.
    exact = {"home_run": "PROMO", "strikeout": "ECONOMY", "walk": "STANDARD"}
    by_type = agg.play_mix(lines, keys=["l_suppkey"], result="p_type", fly="-", ground="-", line="-", **exact).drop("fly_balls", "ground_balls", "line_drives", "fly_ball_pct")
    by_name = agg.play_mix(lines, keys=["l_suppkey"], result="result", fly="%ring%", ground="%bolt%", line="%widget%", home_run="-", strikeout="-", walk="-")
    return rounded(by_type.join(by_name.select("l_suppkey", "fly_balls", "ground_balls", "line_drives", "fly_ball_pct"), "l_suppkey"), 8)


@query(
    "a19_top_after_aggregate",
    """WITH a AS (SELECT l_orderkey, l_suppkey, sum(l_quantity) AS ip, sum(l_linenumber) AS so FROM lineitem GROUP BY ALL)
    SELECT l_orderkey, l_suppkey, ip, CAST(so AS BIGINT) AS so FROM a QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY ip DESC, so DESC, l_suppkey) = 1""",
)
def top_after_aggregate(spark, folder):
    totals = table(spark, folder, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.sum("l_quantity").alias("ip"), F.sum("l_linenumber").alias("so"))
    return top_rows(totals, ["l_orderkey"], [F.col("ip").desc(), F.col("so").desc(), F.col("l_suppkey")])


@query(
    "a20_workload",
    "SELECT o.o_custkey, o.o_orderstatus, count(l.l_orderkey) AS pitch_count, count(DISTINCT o.o_orderkey) AS batters_faced FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY ALL",
)
def workload(spark, folder):
    parents = table(spark, folder, "orders").select(F.col("o_orderkey").alias("parent"), "o_custkey", "o_orderstatus")
    children = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("parent"))
    return agg.workload(parents, children, parent="parent", keys=["o_custkey", "o_orderstatus"])


@query(
    "a21_column_statistics",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(avg({c}), 7) AS mean, round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min, round(max({c}), 6) AS max, count(*) - count({c}) AS nulls FROM lineitem"
        for c in ("l_quantity", "l_discount", "l_tax")
    ),
)
def statistics(spark, folder):
    out = agg.column_statistics(table(spark, folder, "lineitem"), ["l_quantity", "l_discount", "l_tax"])
    return out.select("feature", F.round("mean", 7).alias("mean"), *[F.round(c, 6).alias(c) for c in ("std", "min", "max")], "nulls")


@query(
    "a22_coverage",
    """WITH x AS (SELECT CAST(o_orderdate AS DATE) AS d, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price, CASE WHEN o_orderpriority = '5-LOW' THEN 1 END AS low FROM orders)
    SELECT d AS game_date, n AS "rows", unnest(['price', 'low']) AS feature, unnest([p, l]) AS present, unnest([round(p / n * 100, 8), round(l / n * 100, 8)]) AS coverage_pct FROM (SELECT d, count(*) AS n, count(price) AS p, count(low) AS l FROM x GROUP BY 1)""",
)
def coverage(spark, folder):
    orders = table(spark, folder, "orders").select(
        F.to_date("o_orderdate").alias("game_date"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("price"), F.when(F.col("o_orderpriority") == "5-LOW", 1).alias("low")
    )
    return rounded(agg.coverage(orders, ["price", "low"], ["game_date"]), 8)


@query(
    "a23_table_profile",
    "SELECT CAST(count(*) AS BIGINT) AS total_rows, count(DISTINCT o_custkey) AS distinct_keys, CAST(min(o_orderdate) AS DATE) AS first_date, CAST(max(o_orderdate) AS DATE) AS last_date FROM orders",
)
def profile(spark, folder):
    return agg.table_profile(table(spark, folder, "orders").withColumn("d", F.to_date("o_orderdate")), key="o_custkey", date="d")


@query(
    "a24_team_day_form",
    f"""WITH {PLAYS_SQL} SELECT game_date, CASE WHEN l_linestatus ILIKE 'f%' THEN c_nationkey ELSE s_nationkey END AS batting_team, count(*) AS pa, count(*) FILTER (l_returnflag = 'N') AS strikeouts, count(*) FILTER (l_returnflag IN ('R', 'A')) AS hits
    FROM plays JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL""",
)
def team_day(spark, folder):
    home = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    away = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    rows = plays(spark, folder).join(home, "o_custkey").join(away, "l_suppkey").withColumn(
        "batting_team", F.when(F.col("l_linestatus").ilike("f%"), F.col("c_nationkey")).otherwise(F.col("s_nationkey"))
    )
    flag = F.col("l_returnflag")
    return agg.entity_games(rows, keys=["game_date", "batting_team"], counts={"pa": F.lit(True), "strikeouts": flag == "N", "hits": flag.isin("R", "A")})


def _bets(spark, folder):
    brands = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    lines = table(spark, folder, "lineitem").join(brands, "l_partkey").select(
        "p_brand", (F.col("l_returnflag") == "R").cast("int").alias("label"), (F.col("l_quantity") * num(2)).alias("confidence"),
        (num(1) + F.col("l_tax") * num(100)).alias("odds"), (F.col("l_linestatus") == "F").alias("is_home"),
    )
    return lines.withColumn("profit", unit_profit("label", "odds"))


_BETS_SQL = """b AS (SELECT p_brand, CAST(l_returnflag = 'R' AS INT) AS label, l_quantity * 2e0 AS confidence, 1 + l_tax * 100e0 AS odds, l_linestatus = 'F' AS is_home FROM lineitem JOIN part ON p_partkey = l_partkey),
    x AS (SELECT *, CASE WHEN label = 1 THEN CASE WHEN odds > 1 THEN odds - 1 ELSE 0 END ELSE -1 END AS profit FROM b)"""


@query(
    "a25_segment_roi",
    f"""WITH {_BETS_SQL}, s AS (SELECT 'high_confidence' AS segment, * FROM x WHERE confidence >= 70 UNION ALL SELECT 'home', * FROM x WHERE is_home UNION ALL SELECT 'odds_2_4', * FROM x WHERE odds >= 2 AND odds < 4
      UNION ALL SELECT 'odds_4_6', * FROM x WHERE odds >= 4 AND odds < 6 UNION ALL SELECT 'odds_6_8', * FROM x WHERE odds >= 6 AND odds < 8 UNION ALL SELECT 'above_median', * FROM x WHERE confidence >= (SELECT quantile_cont(confidence, 0.5) FROM x))
    SELECT segment, count(*) AS bets, round(avg(label) * 100, 7) AS win_rate, round(sum(profit) / count(*) * 100, 6) AS roi FROM s GROUP BY 1 HAVING count(*) > 100""",
)
def segments(spark, folder):
    from slatework.operators.metrics import percentile_points

    bets = _bets(spark, folder)
    middle = percentile_points(bets, "confidence", [0.5]).first()
    odds = F.col("odds")
    out = agg.segment_returns(
        bets,
        segments={
            "high_confidence": F.col("confidence") >= 70, "home": F.col("is_home"),
            **{f"odds_{lo}_{hi}": (odds >= lo) & (odds < hi) for lo, hi in ((2, 4), (4, 6), (6, 8))},
            "above_median": F.col("confidence") >= (middle["threshold"] if middle else 0.0),
        },
        label="label", profit="profit", minimum=100,
    )
    return out.select("segment", "bets", F.round("win_rate", 7).alias("win_rate"), F.round("roi", 6).alias("roi"))


@query(
    "a26_category_roi",
    f"""WITH {_BETS_SQL} SELECT p_brand, count(*) AS bets, round(avg(label) * 100, 7) AS win_rate, round(sum(profit) / count(*) * 100, 6) AS roi FROM x GROUP BY 1 HAVING count(*) >= 50 ORDER BY bets DESC, p_brand LIMIT 10""",
)
def categories(spark, folder):
    out = agg.category_returns(_bets(spark, folder), category="p_brand", label="label", profit="profit", minimum=50)
    best = agg.top_report(out, [F.col("bets").desc(), F.col("p_brand")], 10)
    return best.select("p_brand", "bets", F.round("win_rate", 7).alias("win_rate"), F.round("roi", 6).alias("roi"))


@query(
    "a26_category_roi_ranked",
    f"""WITH {_BETS_SQL} SELECT p_brand, count(*) AS bets, round(avg(label) * 100, 7) AS win_rate, round(sum(profit) / count(*) * 100, 6) AS roi FROM x GROUP BY 1 HAVING count(*) >= 100 ORDER BY sum(profit) / count(*) DESC, p_brand LIMIT 10""",
)
def categories_by_roi(spark, folder):
    out = agg.category_returns(_bets(spark, folder), category="p_brand", label="label", profit="profit", minimum=100)
    best = agg.top_report(out, [F.col("roi").desc(), F.col("p_brand")], 10)
    return best.select("p_brand", "bets", F.round("win_rate", 7).alias("win_rate"), F.round("roi", 6).alias("roi"))


@query(
    "a27_marker_thresholds",
    f"""WITH {_BETS_SQL}, t AS (SELECT unnest([50e0, 60e0, 70e0, 80e0, 90e0]) AS threshold)
    SELECT threshold, count(*) FILTER (label = 1) AS winners, round(count(*) FILTER (label = 1) / count(*) * 100, 7) AS win_rate FROM x, t WHERE confidence >= threshold GROUP BY 1""",
)
def markers(spark, folder):
    return rounded(agg.marker_rates(_bets(spark, folder), score="confidence", label="label", thresholds=[50, 60, 70, 80, 90]), 7)


@query(
    "a31_rematch_rates",
    f"""WITH {PLAYS_SQL}, f AS (SELECT o_custkey, l_suppkey, max(game_date) AS initial_fail_date FROM plays WHERE l_returnflag = 'R' AND l_discount > 0.05 GROUP BY ALL)
    SELECT f.o_custkey, f.l_suppkey, f.initial_fail_date, count(p.l_orderkey) AS future_matchups, count(*) FILTER (p.l_returnflag = 'A') AS revenge_wins,
      round(coalesce(count(*) FILTER (p.l_returnflag = 'A') / nullif(count(p.l_orderkey), 0), 0), 9) AS revenge_rate
    FROM f LEFT JOIN plays p ON p.o_custkey = f.o_custkey AND p.l_suppkey = f.l_suppkey AND p.game_date > f.initial_fail_date GROUP BY ALL""",
)
def rematches(spark, folder):
    rows = plays(spark, folder)
    failed = rows.where("l_returnflag = 'R' and l_discount > 0.05")
    out = agg.rematch_rates(rows, failed, pair=["o_custkey", "l_suppkey"], date="game_date", success=F.col("l_returnflag") == "A")
    return rounded(out, 9)


@query(
    "a31_rematch_average",
    f"""WITH {PLAYS_SQL}, f AS (SELECT c_nationkey, l_suppkey, max(game_date) AS d FROM plays JOIN customer ON c_custkey = o_custkey WHERE l_returnflag = 'R' GROUP BY ALL),
    r AS (SELECT f.c_nationkey, f.l_suppkey, count(*) AS n, count(*) FILTER (p.l_returnflag = 'A') / count(*) AS rate FROM f JOIN (plays JOIN customer ON c_custkey = o_custkey) p ON p.c_nationkey = f.c_nationkey AND p.l_suppkey = f.l_suppkey AND p.game_date > f.d GROUP BY ALL HAVING count(*) >= 3)
    SELECT count(*) AS pairs, round(avg(rate), 9) AS avg_revenge_rate FROM r""",
)
def rematch_average(spark, folder):
    teams = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    rows = plays(spark, folder).join(teams, "o_custkey")
    rates = agg.rematch_rates(rows, rows.where("l_returnflag = 'R'"), pair=["c_nationkey", "l_suppkey"], date="game_date", success=F.col("l_returnflag") == "A")
    return rounded(agg.average_rematch_rate(rates, 3), 9)


@query(
    "s9_date_coverage",
    "SELECT CAST(o_orderdate AS DATE) AS game_date, CAST(count(*) AS BIGINT) AS total_rows, count(DISTINCT o_custkey) AS distinct_entities FROM orders GROUP BY 1 ORDER BY 1 DESC",
)
def date_coverage(spark, folder):
    orders = table(spark, folder, "orders").select(F.to_date("o_orderdate").alias("game_date"), "o_custkey")
    return agg.date_coverage(orders, date="game_date", entity="o_custkey")
