"""Projections, conditional columns, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from slatework.catalog.base import query, table
from slatework.functions import codes, geo, names, numeric, text, weather
from slatework.functions.numeric import num
from slatework.operators import aggregates as agg

LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
LINE_SQL = ", ".join(LINE)


def _lines(spark, folder):
    return table(spark, folder, "lineitem")


@query(
    "p1_side_resolution",
    """SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'away' WHEN o_orderpriority = '2-HIGH' THEN 'home' WHEN o_orderstatus ILIKE 'f%' THEN 'home' ELSE 'away' END AS team,
      CASE WHEN o_orderpriority = '2-HIGH' THEN true WHEN o_orderpriority = '1-URGENT' THEN false WHEN o_orderstatus ILIKE 'f%' THEN true ELSE false END AS is_home FROM orders""",
)
def side(spark, folder):
    from slatework.plans.hitters import batting_side

    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_orderstatus", F.when(F.col("o_orderpriority") == "1-URGENT", "home").when(F.col("o_orderpriority") == "2-HIGH", "away").alias("pitcher_team")
    )
    home, away = F.lit("home"), F.lit("away")
    team, is_home = batting_side(F.col("pitcher_team"), F.col("o_orderstatus").ilike("f%"), home, away)
    return orders.select("o_orderkey", team.alias("team"), is_home.alias("is_home"))


@query("p2_opponent", f"SELECT {LINE_SQL}, CASE WHEN l_linestatus = 'F' THEN l_partkey ELSE l_suppkey END AS opponent FROM lineitem")
def opponent(spark, folder):
    return _lines(spark, folder).select(*LINE, F.when(F.col("l_linestatus") == "F", F.col("l_partkey")).otherwise(F.col("l_suppkey")).alias("opponent"))


@query(
    "p3_label_family",
    "WITH c AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS so FROM lineitem GROUP BY 1) SELECT l_orderkey, so, "
    + ", ".join(f"CAST(so >= {t} AS INT) AS label_so_{t}_plus" for t in (3, 4, 5, 6)) + " FROM c",
)
def labels(spark, folder):
    counts = _lines(spark, folder).groupBy("l_orderkey").agg(agg.count_if(F.col("l_returnflag") == "R").alias("so"))
    return counts.withColumns({f"label_so_{t}_plus": numeric.flag(F.col("so") >= t) for t in (3, 4, 5, 6)})


@query(
    "p4_null_defaults",
    """SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, 9) AS toxic, l.doc_id IS NOT NULL AS labelled FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def defaults(spark, folder):
    labelled = table(spark, folder, "labels").withColumn("labelled", F.lit(True))
    joined = table(spark, folder, "documents").select("doc_id").join(labelled, "doc_id", "left")
    return joined.withColumns(numeric.with_defaults({"quality": -1, "toxic": 9, "labelled": False}))


@query(
    "p5_precedence",
    """SELECT c_custkey, coalesce(CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal END, s_acctbal, CAST(c_nationkey AS DOUBLE)) AS value FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey""",
)
def precedence(spark, folder):
    suppliers = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("c_custkey"), "s_acctbal")
    joined = table(spark, folder, "customer").join(suppliers, "c_custkey", "left")
    own = F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_acctbal"))
    return joined.select("c_custkey", F.coalesce(own, "s_acctbal", F.col("c_nationkey").cast("double")).alias("value"))


@query(
    "p6_handedness",
    """WITH x AS (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'L' WHEN '2-HIGH' THEN 'R' WHEN '3-MEDIUM' THEN 'S' END AS b, CASE o_orderstatus WHEN 'F' THEN 'L' WHEN 'O' THEN 'R' END AS t FROM orders)
    SELECT o_orderkey, CASE WHEN b = 'R' THEN 1e0 ELSE 0e0 END AS batter_bats_right, CASE WHEN b = 'L' THEN 1e0 ELSE 0e0 END AS batter_bats_left, CASE WHEN b = 'S' THEN 1e0 ELSE 0e0 END AS batter_is_switch,
      CASE WHEN t = 'R' THEN 1e0 ELSE 0e0 END AS pitcher_throws_right, CASE WHEN t = 'L' THEN 1e0 ELSE 0e0 END AS pitcher_throws_left,
      CASE WHEN b IN ('L', 'R') AND t IS NOT NULL THEN CAST(b = t AS DOUBLE) WHEN b = 'S' THEN 0e0 END AS same_hand_matchup, CASE WHEN b IN ('L', 'R') AND t IS NOT NULL THEN CAST(b <> t AS DOUBLE) WHEN b = 'S' THEN 1e0 END AS platoon_advantage FROM x""",
)
def hands(spark, folder):
    bats = F.when(F.col("o_orderpriority") == "1-URGENT", "l").when(F.col("o_orderpriority") == "2-HIGH", " R").when(F.col("o_orderpriority") == "3-MEDIUM", "S")
    throws = F.when(F.col("o_orderstatus") == "F", "L").when(F.col("o_orderstatus") == "O", "r ")
    return table(spark, folder, "orders").select("o_orderkey", *[c.alias(n) for n, c in codes.handedness(bats, throws).items()])


@query(
    "p7_slot_buckets",
    f"""SELECT {LINE_SQL}, CAST(l_linenumber <= 3 AS DOUBLE) AS top_half_lineup, CAST(l_linenumber BETWEEN 4 AND 6 AS DOUBLE) AS middle_lineup, CAST(l_linenumber >= 7 AS DOUBLE) AS bottom_half_lineup,
      coalesce(([4.8e0, 4.7e0, 4.6e0, 4.5e0, 4.3e0, 4.2e0, 4.0e0, 3.9e0, 3.8e0])[l_linenumber], 4e0) AS projected_pa FROM lineitem""",
)
def slots(spark, folder):
    return _lines(spark, folder).select(*LINE, *[c.alias(n) for n, c in codes.slot_flags("l_linenumber").items()])


@query(
    "p8_interactions",
    f"""WITH x AS (
      SELECT *, CASE WHEN l_returnflag = 'R' THEN l_discount END AS hr, CASE WHEN l_returnflag = 'A' THEN l_tax END AS hit, CASE WHEN l_linenumber < 6 THEN l_linenumber END AS pa,
        CASE WHEN l_linestatus = 'F' THEN l_tax END AS platoon, CASE WHEN l_quantity > 10 THEN l_quantity END AS top, CASE WHEN l_quantity < 40 THEN l_quantity END AS middle,
        CASE WHEN l_discount > 0.02 THEN l_discount - 0.05 END AS hr_delta, CASE WHEN l_tax > 0.02 THEN l_tax - 0.05 END AS hit_delta,
        CASE WHEN l_linenumber > 1 THEN 1 ELSE NULL END AS confirmed, CASE WHEN l_discount > 0.04 THEN l_discount * 2 END AS hr_shrunk, CASE WHEN l_tax > 0.04 THEN l_tax * 2 END AS hit_shrunk
      FROM lineitem),
    y AS (
      SELECT *, coalesce(hr, 0) AS a, coalesce(hit, 0) AS b, coalesce(pa, 4.2e0) AS p, coalesce(platoon, 0) AS q, coalesce(hr_shrunk, hr, 0) AS c, coalesce(hit_shrunk, hit, 0) AS d FROM x)
    SELECT {LINE_SQL}, round(a * p, 9) AS recent_hr_x_projected_pa, round(b * p, 9) AS recent_hit_x_projected_pa,
      round(a * q, 9) AS recent_hr_x_platoon_advantage, round(b * q, 9) AS recent_hit_x_platoon_advantage,
      round(a * coalesce(top, 0), 9) AS recent_hr_x_top_half_lineup, round(b * coalesce(top, 0), 9) AS recent_hit_x_top_half_lineup,
      round(a * coalesce(middle, 0), 9) AS recent_hr_x_middle_lineup, round(b * coalesce(middle, 0), 9) AS recent_hit_x_middle_lineup,
      round(coalesce(hr_delta, 0) * p, 9) AS hr_delta_x_projected_pa, round(coalesce(hit_delta, 0) * p, 9) AS hit_delta_x_projected_pa,
      round(p * coalesce(confirmed, 0), 9) AS projected_pa_x_lineup_confirmed,
      round(c * p, 9) AS shrunk_recent_hr_x_projected_pa, round(c * q, 9) AS shrunk_recent_hr_x_platoon_advantage,
      round(d * p, 9) AS shrunk_recent_hit_x_projected_pa, round(d * q, 9) AS shrunk_recent_hit_x_platoon_advantage
    FROM y""",
)
def interactions(spark, folder):
    from slatework.plans.hitters import attach_interactions

    where = lambda test, value: F.when(test, value)
    flag, disc, tax, qty, line = (F.col(c) for c in ("l_returnflag", "l_discount", "l_tax", "l_quantity", "l_linenumber"))
    x = _lines(spark, folder).withColumns({
        "recent_hr_rate_lookback": where(flag == "R", disc), "recent_hit_rate_lookback": where(flag == "A", tax), "projected_pa": where(line < 6, line),
        "platoon_advantage": where(F.col("l_linestatus") == "F", tax), "top_half_lineup": where(qty > 10, qty), "middle_lineup": where(qty < 40, qty),
        "recent_vs_season_hr_delta": where(disc > 0.02, disc - 0.05), "recent_vs_season_hit_delta": where(tax > 0.02, tax - 0.05), "lineup_confirmed": where(line > 1, F.lit(1)),
        "shrunk_recent_hr_rate": where(disc > 0.04, disc * 2), "shrunk_recent_hit_rate": where(tax > 0.04, tax * 2),
    })
    made = attach_interactions(x)
    return made.select(*LINE, *[F.round(c, 9).alias(c) for c in made.columns if c not in x.columns])


@query(
    "p9_weather_interactions",
    f"""WITH x AS (SELECT *, l_quantity AS lf, l_extendedprice / 5000 AS rf, 0.9e0 + l_tax AS carry, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS bl, CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS br,
        CASE WHEN l_returnflag = 'N' THEN 0.9e0 ELSE 1e0 END AS adj, CAST(l_linestatus = 'F' AS INT) AS roof FROM lineitem),
    y AS (SELECT *, round_even(CASE WHEN bl > 0 THEN rf WHEN br > 0 THEN lf ELSE (lf + rf) / 2 END * adj, 3) AS pull FROM x)
    SELECT {LINE_SQL}, pull AS batter_pull_wind_mph, round_even(pull * carry, 3) AS batter_pull_air_carry, round_even(round_even(pull * carry, 3) * (1 - roof * l_discount), 3) AS batter_pull_weather_boost FROM y""",
)
def weather_interactions(spark, folder):
    x = _lines(spark, folder).withColumns(
        {
            "wind_out_to_left_field_mph": F.col("l_quantity"), "wind_out_to_right_field_mph": F.col("l_extendedprice") / num(5000), "air_carry_factor": num(0.9) + F.col("l_tax"),
            "batter_bats_left": numeric.flag_double(F.col("l_returnflag") == "R"), "batter_bats_right": numeric.flag_double(F.col("l_returnflag") == "A"), "batter_is_switch": numeric.flag_double(F.col("l_returnflag") == "N"),
            "roof_closed_estimated": numeric.flag_double(F.col("l_linestatus") == "F"), "roof_status_confidence": F.col("l_discount"), "weather_data_available": num(1),
        }
    )
    wanted = weather.pull_side_wind()
    return x.select(*LINE, *[wanted[n].alias(n) for n in ("batter_pull_wind_mph", "batter_pull_air_carry", "batter_pull_weather_boost")])


@query(
    "p10_composites",
    f"""SELECT {LINE_SQL}, round(coalesce(CASE WHEN l_returnflag = 'R' THEN l_discount END, 0) * (1 + l_tax), 9) AS adjusted_power,
      round((coalesce(CASE WHEN l_returnflag = 'R' THEN l_discount END, 0) + coalesce(CASE WHEN l_linestatus = 'F' THEN l_tax END, 0)) / nullif(CAST(l_returnflag = 'R' AS INT) + CAST(l_linestatus = 'F' AS INT), 0), 9) AS vulnerability FROM lineitem""",
)
def composites(spark, folder):
    power, weak = F.when(F.col("l_returnflag") == "R", F.col("l_discount")), F.when(F.col("l_linestatus") == "F", F.col("l_tax"))
    return _lines(spark, folder).select(
        *LINE, F.round(F.coalesce(power, num(0)) * (num(1) + F.col("l_tax")), 9).alias("adjusted_power"), F.round(numeric.row_mean(power, weak), 9).alias("vulnerability")
    )


@query(
    "p11_clamps",
    f"""SELECT {LINE_SQL}, least(greatest(l_quantity * 3 - 20, 0), 100) AS clipped, round(least(greatest((l_quantity * 2 - 50) / 30, 0), 1), 9) AS temperature_factor,
      CASE WHEN l_quantity - 25 > 10 THEN 1.2e0 WHEN l_quantity - 25 < -10 THEN 0.8e0 ELSE 1e0 END AS wind_factor FROM lineitem""",
)
def clamps(spark, folder):
    from slatework.plans.metric_store import temperature_factor, wind_factor

    return _lines(spark, folder).select(
        *LINE, numeric.clip(F.col("l_quantity") * 3 - 20, 0, 100).alias("clipped"), F.round(temperature_factor(F.col("l_quantity") * 2), 9).alias("temperature_factor"), wind_factor(F.col("l_quantity") - 25).alias("wind_factor")
    )


@query(
    "p12_linear_scores",
    """SELECT p_partkey, p_brand IN ('Brand#1', 'Brand#2') AS is_elite, round(p_size * 0.4e0 + p_retailprice * 0.3e0 + coalesce(CASE WHEN p_type = 'PROMO' THEN p_size END, 0) * 0.2e0, 8) AS power_score FROM part""",
)
def linear_scores(spark, folder):
    parts = table(spark, folder, "part").withColumn("promo_size", F.when(F.col("p_type") == "PROMO", F.col("p_size")))
    score = numeric.linear({"p_size": 0.4, "p_retailprice": 0.3, "promo_size": 0.2})
    return parts.select("p_partkey", F.col("p_brand").isin("Brand#1", "Brand#2").alias("is_elite"), F.round(score, 8).alias("power_score"))


@query(
    "p13_rule_override",
    f"""SELECT {LINE_SQL}, CASE WHEN l_returnflag = 'R' AND p_size > 30 THEN 0e0 ELSE 0.5e0 END AS matchup_score FROM lineitem LEFT JOIN part ON p_partkey = l_partkey""",
)
def rule_override(spark, folder):
    from slatework.plans.picks import matchup_score

    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    joined = _lines(spark, folder).join(parts, "l_partkey", "left")
    return joined.select(*LINE, matchup_score(F.col("l_returnflag"), {"R": F.col("p_size")}, 30).alias("matchup_score"))


@query("p16_coverage_filter", "SELECT 'kept' AS feature, count(*) AS n FROM orders WHERE o_orderstatus <> 'P'")
def coverage_filter(spark, folder):
    orders = table(spark, folder, "orders").select(
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("kept"), F.when(F.col("o_orderpriority") == "5-LOW", F.col("o_totalprice")).alias("dropped")
    )
    kept = agg.covered_columns(orders, ["kept", "dropped"], 50)
    return orders.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("v")) for c in kept])).alias("x")).select("x.*").groupBy("feature").agg(F.count("v").alias("n"))


@query("p19_sanitised", f"SELECT {LINE_SQL}, round(CASE WHEN l_tax > 0 THEN l_discount / l_tax END, 8) AS value FROM lineitem")
def sanitised(spark, folder):
    raw = F.when(F.col("l_tax") > 0, F.col("l_discount") / F.col("l_tax")).when(F.col("l_discount") > 0, num(float("inf"))).otherwise(num(float("nan")))
    return _lines(spark, folder).select(*LINE, F.round(numeric.finite(raw), 8).alias("value"))


@query(
    "p20_numbers_from_text",
    """SELECT event_id, nullif(CAST(CASE WHEN regexp_matches(t, '^[0-9]+(\\.[0-9]+)?%?$') THEN replace(t, '%', '') END AS DOUBLE), 0) AS parsed
    FROM (SELECT event_id, CASE event_type WHEN 'click' THEN CAST(value AS VARCHAR) || '%' WHEN 'view' THEN json_extract_string(props, '$.k') WHEN 'error' THEN 'n/a' ELSE json_extract_string(props, '$.k') || '%' END AS t FROM events)""",
)
def numbers(spark, folder):
    k = F.get_json_object("props", "$.k")
    raw = F.when(F.col("event_type") == "click", F.concat(F.col("value").cast("string"), F.lit("%"))).when(F.col("event_type") == "view", k).when(F.col("event_type") == "error", "n/a").otherwise(F.concat(k, F.lit("%")))
    return table(spark, folder, "events").select("event_id", numeric.percent_text(raw).alias("parsed"))


@query(
    "f2_flip_name",
    """SELECT p_partkey, split_part(p_name, ' ', 2) || ', ' || split_part(p_name, ' ', 1) AS last_first, p_name AS first_last FROM part""",
)
def flips(spark, folder):
    parts = table(spark, folder, "part").withColumn("lf", names.last_first("p_name"))
    return parts.select("p_partkey", F.col("lf").alias("last_first"), names.first_last("lf").alias("first_last"))


@query(
    "f3_name_keys",
    """SELECT p_partkey, p_brand, left(p_name, 1) || ' ' || split_part(p_name, ' ', 2) AS initial_key, p_name || ' ' || lower(replace(p_brand, '#', '')) || ' jr' AS plain_key, lower(replace(p_brand, '#', '')) AS surname_key FROM part""",
)
def keys(spark, folder):
    full = F.concat_ws(" ", F.initcap("p_name"), "p_brand", F.lit("Jr."))
    return table(spark, folder, "part").select(
        "p_partkey", "p_brand", names.initial_key(F.initcap("p_name")).alias("initial_key"), names.plain_key(full).alias("plain_key"), names.surname_key(full).alias("surname_key")
    )


@query(
    "f4_strip_action",
    """SELECT o_orderkey, c_name AS player FROM orders JOIN customer ON c_custkey = o_custkey""",
)
def strip_action(spark, folder):
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    action = F.when(F.col("o_orderstatus") == "F", " Homered to left").when(F.col("o_orderstatus") == "O", " struck out swinging").otherwise(" grounded into a double play")
    raw = F.concat(F.lit("  "), "c_name", action)
    return table(spark, folder, "orders").join(customers, "o_custkey").select("o_orderkey", names.strip_action(raw).alias("player"))


@query("f5_clean_source_name", "SELECT o_orderkey, c_name AS player FROM orders JOIN customer ON c_custkey = o_custkey")
def clean_source(spark, folder):
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    raw = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("Someone pitches to "), "c_name", F.lit(" fouled off"))).when(F.col("o_orderstatus") == "O", F.concat("c_name", F.lit(" (LF) - "))).otherwise(F.concat(F.lit("- "), "c_name", F.lit(" safe at first")))
    return table(spark, folder, "orders").join(customers, "o_custkey").select("o_orderkey", names.clean_source_name(raw).alias("player"))


@query(
    "f6_alias_codes",
    """SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'ARI' WHEN 'SMALL' THEN 'CWS' ELSE p_type END AS team, CASE WHEN p_type = 'PROMO' THEN 'SL' ELSE left(p_type, 2) END AS pitch FROM part""",
)
def alias_codes(spark, folder):
    team = F.when(F.col("p_type") == "ECONOMY", " az").when(F.col("p_type") == "SMALL", "CHW").otherwise(F.lower("p_type"))
    pitch = F.when(F.col("p_type") == "PROMO", "Slider ").otherwise(F.lower("p_type"))
    return table(spark, folder, "part").select("p_partkey", codes.team_code(team).alias("team"), codes.pitch_type(pitch).alias("pitch"))


@query(
    "f7_pattern_classes",
    """SELECT p_type, count(*) FILTER (p_name ILIKE '%BLUE%ring%') AS blue_rings, count(*) FILTER (p_name LIKE 'small%') AS small_ones, count(*) FILTER (contains(p_name, 'bolt')) AS bolts FROM part GROUP BY 1""",
)
def patterns(spark, folder):
    name = F.col("p_name")
    return table(spark, folder, "part").groupBy("p_type").agg(
        agg.count_if(name.ilike("%BLUE%ring%")).alias("blue_rings"), agg.count_if(name.like("small%")).alias("small_ones"), agg.count_if(name.contains("bolt")).alias("bolts")
    )


@query("f9_json_scalar", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_scalar(spark, folder):
    return table(spark, folder, "events").select("event_id", text.json_name("props", "k").alias("k"))


@query(
    "f10_batting_order",
    """WITH x AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS slot, l_partkey FROM lineitem)
    SELECT l_orderkey, CAST(slot AS INT) AS slot, 'P' || l_partkey AS name FROM x""",
)
def batting_orders(spark, folder):
    entry = F.when(F.col("l_returnflag") == "R", F.to_json(F.struct(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("name")))).when(
        F.col("l_returnflag") == "A", F.to_json(F.struct(F.lit("").alias("name"), F.concat(F.lit(" P"), F.col("l_partkey").cast("string")).alias("player_name")))
    ).otherwise(F.concat(F.lit('"P'), F.col("l_partkey").cast("string"), F.lit('"')))
    rows = _lines(spark, folder).withColumn("e", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", entry.alias("json")))
    lineups = rows.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("e")).alias("es"))
    document = F.concat(F.lit('{"confirmed": true, "batting_order": ['), F.array_join(F.transform("es", lambda e: e["json"]), ","), F.lit("]}"))
    return lineups.select("l_orderkey", F.inline(text.batting_order(document)))


@query(
    "f11_regex_fields",
    """SELECT o_orderkey, o_custkey || '-' || (o_orderkey // 100) AS record, round(o_totalprice, 2) AS era, CAST(o_custkey AS INT) AS strikeouts, o_custkey AS player_id, left(o_orderstatus, 1) AS position FROM orders""",
)
def regex_fields(spark, folder):
    price = F.format_string("%.2f", F.col("o_totalprice"))
    line = F.concat_ws(" ", F.concat(F.lit("("), F.col("o_custkey").cast("string"), F.lit(" - "), F.floor(F.col("o_orderkey") / 100).cast("string"), F.lit(")")), price, F.lit("era"), F.concat(F.col("o_custkey").cast("string"), F.lit("SO")))
    orders = table(spark, folder, "orders").withColumns({"line": line, "entry": F.concat(F.lit("A.  Player (L)  "), "o_orderstatus"), "href": F.concat(F.lit("/player/a-player-"), F.col("o_custkey").cast("string"))})
    summary, spot = text.pitcher_summary("line"), text.lineup_line("entry", "href")
    return orders.select("o_orderkey", *[c.alias(n) for n, c in summary.items()], spot["player_id"].alias("player_id"), spot["position"].alias("position"))


@query(
    "f12_section_entries",
    r"""WITH lines AS (SELECT doc_id, list_filter(list_transform(string_split(replace(text, chr(13), ''), chr(10)), lambda x: trim(regexp_replace(trim(x), '^\*+', ''))), lambda x: x <> '') AS ls FROM documents),
    l AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, ls FROM lines),
    h AS (SELECT doc_id, i, trim(regexp_extract(ls[i], '^([A-Z][a-z]+):\s*(.*)$', 2)) AS same, coalesce(ls[i + 1], '') AS nxt FROM l WHERE regexp_matches(ls[i], '^([A-Z][a-z]+):\s*(.*)$')),
    n AS (SELECT doc_id, unnest(string_split(replace(CASE WHEN same <> '' THEN same ELSE nxt END, '**', ''), ',')) AS e FROM h)
    SELECT doc_id, regexp_replace(e, '^[ .]+|[ .]+$', '', 'g') AS entry, count(*) AS times FROM n WHERE regexp_replace(e, '^[ .]+|[ .]+$', '', 'g') <> '' GROUP BY ALL""",
)
def sections(spark, folder):
    entries = text.section_entries("text", r"^([A-Z][a-z]+):\s*(.*)$")
    listed = table(spark, folder, "documents").select("doc_id", F.explode(entries).alias("entry"))
    return listed.groupBy("doc_id", "entry").agg(F.count(F.lit(1)).alias("times"))


@query(
    "f13_transaction_team",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Machinery Men' ELSE 'Builders' END END AS team_name,
      CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'MAC' ELSE 'BLD' END END AS team_code FROM orders""",
)
def transaction_team(spark, folder):
    club = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "Machinery Men").otherwise("Builders")
    line = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("03/12/25 "), club, F.lit(" signed a free agent."))).when(
        F.col("o_orderstatus") == "O", F.concat(F.lit("03/12/25  A pitcher was claimed by "), club, F.lit(" off waivers."))
    ).otherwise(F.lit("03/12/25 Player retired."))
    found = text.team_from_transaction(line, {"Machinery Men": "MAC", "Builders": "BLD"})
    return table(spark, folder, "orders").select("o_orderkey", *[c.alias(n) for n, c in found.items()])


@query(
    "f14_local_start",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 19 HOUR
        WHEN event_type = 'view' THEN ts - INTERVAL 5 HOUR WHEN event_type = 'click' THEN ts - INTERVAL 7 HOUR ELSE ts - INTERVAL 8 HOUR END AS local_start FROM events""",
)
def local_start(spark, folder):
    zone = F.when(F.col("event_type") == "view", "America/New_York").when(F.col("event_type") == "click", "America/Phoenix").otherwise("America/Los_Angeles")
    known = F.when(F.col("event_type") != "error", F.col("ts"))
    return table(spark, folder, "events").select("event_id", geo.local_start(known, F.col("ts").cast("date"), zone).alias("local_start"))


@query(
    "f15_dates",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) - 30 AS from_date, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INT) AS age_days,
      CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END AS parsed, len(generate_series(CAST(o_orderdate AS DATE) - 3, CAST(o_orderdate AS DATE), INTERVAL 1 DAY))::INT AS span FROM orders""",
)
def dates(spark, folder):
    day = F.to_date("o_orderdate")
    written = F.when(F.col("o_orderstatus") == "P", "not a date").otherwise(F.date_format(day, "yyyy-MM-dd"))
    return table(spark, folder, "orders").select(
        "o_orderkey", F.date_sub(day, 30).alias("from_date"), F.datediff(day, F.lit("1995-01-01").cast("date")).alias("age_days"),
        F.try_to_date(written, "yyyy-MM-dd").alias("parsed"), F.size(F.sequence(F.date_sub(day, 3), day)).alias("span"),
    )


_GEO = {"lat1": "c_acctbal / 400", "lon1": "c_nationkey * 5.0e0 - 100", "lat2": "s_acctbal / 400", "lon2": "s_nationkey * 5.0e0 - 100"}


@query(
    "f16_haversine_travel",
    f"""WITH lead AS (SELECT l_orderkey, min(l_suppkey) AS s_suppkey FROM lineitem GROUP BY 1),
    p AS (
      SELECT o_orderkey, c_custkey, s_suppkey, {', '.join(f'radians({e}) AS {n}' for n, e in _GEO.items())}, s_nationkey
      FROM orders JOIN customer ON c_custkey = o_custkey JOIN lead ON l_orderkey = o_orderkey JOIN supplier USING (s_suppkey)),
    a AS (SELECT *, pow(sin((lat2 - lat1) / 2), 2) + cos(lat1) * cos(lat2) * pow(sin((lon2 - lon1) / 2), 2) AS h FROM p), d AS (SELECT *, 3959e0 * 2 * atan2(sqrt(h), sqrt(1 - h)) AS miles FROM a)
    SELECT o_orderkey, c_custkey, s_suppkey, round(miles, 6) AS miles, round(least(greatest(miles / 3000 * 25 + CASE WHEN s_nationkey < 10 THEN 3 ELSE 1 END * 10, 0), 100), 6) AS fatigue FROM d""",
)
def haversine(spark, folder):
    """Distance between each order's customer and its first supplier."""
    lead = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_suppkey").alias("s_suppkey"))
    orders = table(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    joined = orders.join(table(spark, folder, "customer"), "c_custkey").join(lead, "o_orderkey").join(table(spark, folder, "supplier"), "s_suppkey")
    joined = joined.withColumns({n: F.expr(e) for n, e in _GEO.items()})
    miles = geo.haversine_miles("lat1", "lon1", "lat2", "lon2")
    zone = F.when(F.col("s_nationkey") < 10, "America/Los_Angeles").otherwise("America/Chicago")
    return joined.select(
        "o_orderkey", "c_custkey", "s_suppkey", F.round(miles, 6).alias("miles"), F.round(geo.travel_fatigue(miles, geo.zone_changes(zone, F.lit("America/New_York"))), 6).alias("fatigue")
    )


@query(
    "f17_dew_point",
    f"""WITH x AS (SELECT {LINE_SQL}, (l_quantity * 2 - 32) * 5 / 9 AS c, least(greatest(l_discount * 1200, 1e-6), 100) AS rh FROM lineitem), y AS (SELECT *, 17.27e0 * c / (237.7e0 + c) + ln(rh / 100) AS al FROM x)
    SELECT {LINE_SQL}, round(237.7e0 * al / (17.27e0 - al) * 9 / 5 + 32, 7) AS dew_point_f FROM y""",
)
def dew_point(spark, folder):
    return _lines(spark, folder).select(*LINE, F.round(weather.dew_point_f(F.col("l_quantity") * 2, F.col("l_discount") * 1200), 7).alias("dew_point_f"))


@query(
    "f18_wind_components",
    f"""WITH x AS (SELECT {LINE_SQL}, l_quantity / 2 AS sp, (l_extendedprice % 360 + 180) % 360 AS too, CAST(l_linenumber * 7 AS DOUBLE) AS br FROM lineitem),
    y AS (SELECT *, radians((too - br + 180 + 360) % 360 - 180) AS c, radians((too - (br - 45) + 180 + 360) % 360 - 180) AS l, radians((too - (br + 45) + 180 + 360) % 360 - 180) AS r FROM x)
    SELECT {LINE_SQL}, round(greatest(0, sp * cos(c)), 2) + 0e0 AS wind_out_to_center_mph, round(greatest(0, sp * cos(l)), 2) + 0e0 AS wind_out_to_left_field_mph, round(greatest(0, sp * cos(r)), 2) + 0e0 AS wind_out_to_right_field_mph,
      round(greatest(0, -sp * cos(c)), 2) + 0e0 AS wind_in_from_center_mph, round(abs(sp * sin(c)), 2) + 0e0 AS crosswind_mph FROM y""".replace("round(greatest", "round_even(greatest").replace("round(abs", "round_even(abs").replace(", 2) + 0e0", ", 3) + 0e0"),
)
def wind(spark, folder):
    parts = weather.wind_components((F.col("l_linenumber") * 7).cast("double"), F.col("l_quantity") / 2, F.pmod(F.col("l_extendedprice"), num(360)))
    return _lines(spark, folder).select(*LINE, *[(c + F.lit(0.0)).alias(n) for n, c in parts.items()])


@query(
    "f19_roof_and_carry",
    f"""WITH x AS (SELECT {LINE_SQL}, CASE l_returnflag WHEN 'R' THEN 'Retractable' WHEN 'A' THEN 'fixed dome' ELSE 'open' END AS roof, l_discount * 4 AS mm, l_quantity * 2 AS t, l_tax * 300 AS w, l_extendedprice % 360 AS dir FROM lineitem),
    y AS (SELECT *, CASE WHEN lower(roof) LIKE '%fixed%' THEN 'closed' WHEN lower(roof) LIKE '%retractable%' THEN CASE WHEN mm > 0.2 OR t < 58 OR t > 94 OR w > 18 THEN 'closed' ELSE 'open' END ELSE 'open_air' END AS st FROM x),
    z AS (SELECT *, 1 + (t - 70) * 0.0025e0 + (60e0 - 55) * 0.0015e0 AS b FROM y)
    SELECT {LINE_SQL}, st AS roof_status_estimated, CASE WHEN lower(roof) LIKE '%fixed%' THEN 1e0 WHEN st = 'closed' THEN 0.75e0 WHEN st = 'open' THEN 0.65e0 ELSE 0.95e0 END AS roof_status_confidence,
      round_even(least(greatest(CASE WHEN st = 'closed' THEN (b + 1) / 2 ELSE b END, 0.92e0), 1.1e0), 3) AS air_carry_factor,
      CASE WHEN dir BETWEEN 135 AND 225 THEN round_even(1 + least(w, 20) * 0.01e0, 3) WHEN dir >= 315 OR dir <= 45 THEN round_even(greatest(0.85e0, 1 - least(w, 20) * 0.01e0), 3) ELSE 1e0 END AS wind_out_factor,
      lower(roof) IN ('fixed', 'retractable') AS is_dome FROM z""",
)
def roof(spark, folder):
    x = _lines(spark, folder).withColumns(
        {
            "roof": F.when(F.col("l_returnflag") == "R", "Retractable").when(F.col("l_returnflag") == "A", "fixed dome").otherwise("open"),
            "mm": F.col("l_discount") * 4, "t": F.col("l_quantity") * 2, "w": F.col("l_tax") * 300, "dir": F.pmod(F.col("l_extendedprice"), num(360)),
        }
    )
    x = x.withColumns(weather.roof_estimate("roof", "mm", "t", "w"))
    return x.select(
        *LINE, "roof_status_estimated", "roof_status_confidence", weather.air_carry("t", num(60), "roof_status_estimated").alias("air_carry_factor"),
        weather.wind_out_factor("w", "dir").alias("wind_out_factor"), weather.is_dome("roof", F.lit("Some Park"), ["Tropicana Field"]).alias("is_dome"),
    )


@query("f22_safe_casts", "SELECT event_id, coalesce(TRY_CAST(CASE WHEN event_type = 'error' THEN 'bad' ELSE json_extract_string(props, '$.k') END AS DOUBLE), -1) AS k FROM events")
def safe_casts(spark, folder):
    raw = F.when(F.col("event_type") == "error", "bad").otherwise(F.get_json_object("props", "$.k"))
    return table(spark, folder, "events").select("event_id", numeric.to_double(raw, -1).alias("k"))


@query("f23_rounding", f"SELECT {LINE_SQL}, round_even(l_quantity / 2, 0) AS even_half, round(l_quantity / 2, 0) AS half_up FROM lineitem")
def rounding(spark, folder):
    half = F.col("l_quantity") / 2
    return _lines(spark, folder).select(*LINE, numeric.half_even(half, 0).alias("even_half"), F.round(half, 0).alias("half_up"))
