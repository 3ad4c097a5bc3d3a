"""The driver tables read as the library's domain tables (FIXTURES.md), and the same views in SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from slatework.catalog.base import line_parts, table
from slatework.functions.numeric import num
from slatework.operators.registry import seed_registry
from slatework.plans.hitters import HitterSources, prepared
from slatework.plans.starters import StarterSources
from slatework.session import stored


def _renamed(df, **names):
    return df.select(*[F.col(old).alias(new) for new, old in names.items()])


def _lines(spark, folder, parts):
    """Orders with customer, both teams and date, and line items with supplier names, both dealt out by order in ``parts``.

    What follows groups and joins by order, so it needs no further shuffle and a task's work does not grow with the tables.
    """
    nations = table(spark, folder, "nation")
    home = _renamed(nations, c_nationkey="n_nationkey", home_team="n_name")
    away = _renamed(nations, lead_nation="n_nationkey", away_team="n_name")
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey")
    suppliers = table(spark, folder, "supplier")
    names = suppliers.select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    dealt = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey").repartition(parts, "l_orderkey")
    leads = dealt.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_suppkey").alias("lead"))
    lead_nations = suppliers.select(F.col("s_suppkey").alias("lead"), F.col("s_nationkey").alias("lead_nation"))
    sold = table(spark, folder, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("game_date"), "o_totalprice").join(customers, "o_custkey")
    orders = sold.repartition(parts, "o_orderkey").join(leads, "o_orderkey").join(lead_nations, "lead").join(home, "c_nationkey").join(away, "lead_nation")
    lines = table(spark, folder, "lineitem").join(names, "l_suppkey").drop("l_shipdate").repartition(parts, "l_orderkey")
    return orders, lines


def prepared_sources(spark, folder, fuzzy: bool = True, lineups: bool = True) -> HitterSources:
    """Hitter sources with the event tables written (they stand for stored tables) and names resolved.

    Tables are written one after another, and only those read more than once: pitches stay a view of the line items, and
    ``lineups`` one where nothing but their names is asked for.
    """
    s = hitter_sources(spark, folder, keep=stored)
    tables = ["plays", "pitching_box", "name_registry", *(["lineups"] if lineups else [])]
    return prepared(replace(s, dealt=False, **{name: stored(getattr(s, name)) for name in tables}), fuzzy=fuzzy)


def hitter_sources(spark, folder, keep=None) -> HitterSources:
    """The library's sources as views of the driver tables; ``keep`` may write the orders that most of them start from."""
    parts = line_parts(spark, folder)
    orders, lines = _lines(spark, folder, parts)
    sold = keep(orders) if keep else orders
    orders = sold.repartition(parts, "o_orderkey") if keep else orders
    games = sold.select(F.col("o_orderkey").alias("game_id"), "game_date", "home_team", "away_team")
    flag, deep = F.col("l_returnflag"), F.col("l_discount") > 0.05
    result = F.when((flag == "R") & deep, "Home Run").when(flag == "R", "Single").when((flag == "A") & deep, "Strikeout").when(flag == "A", "Walk").otherwise(F.when(deep, "Other").otherwise("Groundout"))
    # A play is an (order, line number); lines sharing one are its pitches, the highest part its last.
    last = F.max(F.struct("l_partkey", "l_suppkey", "l_extendedprice", result.alias("play_result"), "s_name", F.when(F.col("l_linestatus") == "F", "Bottom 3").otherwise("Top 3").alias("inning_half")))
    plays = lines.groupBy("l_orderkey", "l_linenumber").agg(last.alias("x")).join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "c_name"), "l_orderkey").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("game_id"), F.concat("c_name", F.lit(" homered to left")).alias("batter"),
        F.col("x.s_name").alias("pitcher"), F.col("x.play_result").alias("play_result"), F.col("x.inning_half").alias("inning_half"),
    )
    # Pitches are line items as they lie: nothing here groups them by order.
    pitches = table(spark, folder, "lineitem").join(table(spark, folder, "supplier").select(F.col("s_suppkey").alias("l_suppkey")), "l_suppkey", "left_semi").select(
        F.col("l_suppkey").alias("id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("play_id"), F.col("l_partkey").alias("pitch_number"),
        F.when(F.col("l_tax") > 0.05, "Slider").when(F.col("l_tax") > 0.02, "Sinker").otherwise("Curve").alias("pitch_type"), F.when(deep, "Swinging Strike").otherwise("Ball").alias("result"),
    )
    box = lines.join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "home_team", "away_team"), "l_orderkey").groupBy("l_orderkey", "l_suppkey", "s_name", "home_team", "away_team").agg(
        F.sum("l_quantity").alias("q"), F.count(F.when(flag == "R", 1)).alias("hits"), F.sum("l_linenumber").alias("earned_runs"), F.count(F.when(flag == "N", 1)).alias("walks"),
        F.count(F.when(flag == "A", 1)).alias("strikeouts"), F.count(F.when((flag == "R") & deep, 1)).alias("home_runs"), F.min("l_linestatus").alias("status"),
    ).select(
        F.col("l_suppkey").alias("id"), F.col("l_orderkey").alias("game_id"), F.when(F.col("status") == "O", F.col("home_team")).otherwise(F.col("away_team")).alias("team"), F.col("s_name").alias("player_name"),
        (F.col("q") / num(10)).alias("innings_pitched"), "hits", "earned_runs", "walks", "strikeouts", "home_runs",
    )
    suppliers, customers = table(spark, folder, "supplier"), table(spark, folder, "customer")
    starter = lines.groupBy("l_orderkey").agg(F.min_by("s_name", "l_suppkey").alias("first"), F.max_by("s_name", "l_suppkey").alias("last"))
    pitcher = lambda c: F.to_json(F.struct(F.col(c).alias("name")))
    lineups = orders.join(starter, F.col("o_orderkey") == F.col("l_orderkey")).select(
        "game_date", F.col("o_orderkey").cast("string").alias("game_id"), "home_team", "away_team", pitcher("first").alias("home_pitcher"), pitcher("last").alias("away_pitcher"),
        F.to_json(F.struct((F.col("o_totalprice") > 200000).alias("confirmed"), F.array(F.struct(F.col("c_name").alias("name"))).alias("batting_order"))).alias("home_lineup"),
        F.to_json(F.struct(F.lit(False).alias("confirmed"), F.array("first", "last", "c_name").alias("batting_order"))).alias("away_lineup"),
    )
    hand = lambda key: F.when(F.col(key) < 9, "R").when(F.col(key) < 18, "L").otherwise("S")
    players = customers.select(
        F.col("c_custkey").alias("player_id"), F.col("c_name").alias("full_name"), F.lit(None).cast("string").alias("display_name"), hand("c_nationkey").alias("bats"), F.lit(None).cast("string").alias("throws")
    ).unionByName(
        suppliers.select((F.col("s_suppkey") + 10_000_000_000).alias("player_id"), F.lit(None).cast("string").alias("full_name"), F.col("s_name").alias("display_name"), F.lit(None).cast("string").alias("bats"), hand("s_nationkey").alias("throws"))
    )
    registry = seed_registry(players.select(F.coalesce("full_name", "display_name").alias("full_name"), "player_id"), name="full_name", person_id="player_id")
    speed = customers.select(
        F.col("c_name").alias("last_name_first_name"), F.lit(2025).alias("year"), F.col("c_acctbal").cast("string").alias("avg_hit_speed"), F.concat((F.col("c_nationkey") + 1).cast("string"), F.lit("%")).alias("brl_percent"),
        F.lit("33.1%").alias("anglesweetspotpercent"), F.lit("n/a").alias("ev95percent"),
    )
    season = customers.select(
        F.col("c_name").alias("last_name_first_name"), (F.col("c_acctbal") / num(10000)).alias("xwoba"), num(0.25).alias("xba"), (F.col("c_nationkey") / num(50)).alias("xslg"), F.lit("1995-01-01").cast("date").alias("data_date")
    )
    kind = F.when(F.col("s_nationkey") < 12, "SL").otherwise("SI")
    nations = _renamed(table(spark, folder, "nation"), s_nationkey="n_nationkey", team="n_name")
    arsenal = suppliers.join(nations, "s_nationkey").select(
        F.col("s_name").alias("last_name_first_name"), "team", kind.alias("pitch_type"), (F.col("s_acctbal") / num(100)).alias("pitch_usage"), num(0.3).alias("whiff_percent"), num(0.2).alias("k_percent"), num(0.1).alias("put_away")
    )
    hitting_nations = _renamed(table(spark, folder, "nation"), c_nationkey="n_nationkey", team="n_name")
    hitting = customers.join(hitting_nations, "c_nationkey").select(
        F.col("c_name").alias("last_name_first_name"), "team", F.when(F.col("c_mktsegment") == "BUILDING", "SL").when(F.col("c_mktsegment") == "MACHINERY", "CU").otherwise("SI").alias("pitch_type"), F.col("c_nationkey").alias("pa"),
        *[(F.col("c_acctbal") / num(d)).alias(m) for m, d in (("whiff_percent", 20000), ("k_percent", 30000), ("put_away", 40000), ("ba", 30000), ("slg", 15000), ("woba", 25000))],
    )
    weather = sold.select(
        F.col("o_orderkey").alias("game_id"), *[(F.col("o_totalprice") / num(d)).alias(c) for c, d in (("wind_speed_mph", 20000), ("temp_f", 6000), ("wind_out_to_left_field_mph", 40000), ("wind_out_to_right_field_mph", 60000))],
        num(0.1).alias("precipitation_mm"), num(1.02).alias("wind_out_factor"), num(55).alias("dew_point_f"), num(1.01).alias("air_carry_factor"), num(3).alias("wind_out_to_center_mph"), num(0).alias("wind_in_from_center_mph"),
        num(2).alias("crosswind_mph"), F.when(F.col("o_totalprice") > 300000, "closed").otherwise("open").alias("roof_status_estimated"), num(0.75).alias("roof_status_confidence"), F.lit(True).alias("weather_available"),
    )
    parks = table(spark, folder, "nation").select(
        F.col("n_name").alias("team"), (F.col("n_nationkey") * num(1.5) + num(20)).alias("lat"), (F.col("n_nationkey") * num(2.5) - num(120)).alias("lon"),
        F.when(F.col("n_nationkey") < 10, "America/Los_Angeles").otherwise("America/New_York").alias("tz"), (num(0.9) + F.col("n_nationkey") / num(100)).alias("park_factor"),
    )
    return HitterSources(games, plays, pitches, box, lineups, players, registry, speed, season, arsenal, hitting, weather, parks, parts=parts, dealt=True)


def starter_sources(spark, folder, base: HitterSources | None = None) -> StarterSources:
    season = table(spark, folder, "supplier").select(
        F.col("s_name").alias("last_name_first_name"), (F.col("s_acctbal") / num(400)).alias("k_percent"), num(8).alias("bb_percent"), (F.col("s_nationkey") + num(15)).alias("whiff_percent")
    )
    return StarterSources(base or hitter_sources(spark, folder), season)


DOMAIN_SQL = """leads AS (SELECT l_orderkey AS o_orderkey, min(l_suppkey) AS lead FROM lineitem GROUP BY 1),
    go AS (SELECT o.o_orderkey, o.o_custkey, CAST(o_orderdate AS DATE) AS game_date, o_totalprice, c_name, h.n_name AS home_team, a.n_name AS away_team FROM orders o JOIN customer c ON c_custkey = o_custkey JOIN leads USING (o_orderkey)
      JOIN supplier s ON s_suppkey = lead JOIN nation h ON h.n_nationkey = c_nationkey JOIN nation a ON a.n_nationkey = s_nationkey),
    li AS (SELECT l.*, s_name, CASE WHEN l_returnflag = 'R' THEN CASE WHEN l_discount > 0.05 THEN 'Home Run' ELSE 'Single' END WHEN l_returnflag = 'A' THEN CASE WHEN l_discount > 0.05 THEN 'Strikeout' ELSE 'Walk' END ELSE CASE WHEN l_discount > 0.05 THEN 'Other' ELSE 'Groundout' END END AS play_result,
      CASE WHEN l_linestatus = 'F' THEN 'Bottom 3' ELSE 'Top 3' END AS inning_half FROM lineitem l JOIN supplier s ON s_suppkey = l_suppkey),
    pl AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS game_id, c_name AS player_name, s_name AS pitcher, play_result, inning_half FROM li JOIN go ON o_orderkey = l_orderkey
      QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, play_result DESC) = 1),
    bx AS (SELECT l_suppkey AS id, l_orderkey AS game_id, CASE WHEN min(l_linestatus) = 'O' THEN any_value(home_team) ELSE any_value(away_team) END AS team, s_name AS player_name, sum(l_quantity) / 10e0 AS innings_pitched, count(*) FILTER (l_returnflag = 'R') AS hits,
      CAST(sum(l_linenumber) AS BIGINT) AS earned_runs, count(*) FILTER (l_returnflag = 'N') AS walks, count(*) FILTER (l_returnflag = 'A') AS strikeouts, count(*) FILTER (play_result = 'Home Run') AS home_runs FROM li JOIN go ON o_orderkey = l_orderkey GROUP BY l_suppkey, l_orderkey, s_name),
    sp AS (SELECT game_id, player_name, game_date, home_team, away_team, mode() WITHIN GROUP (ORDER BY inning_half) AS half, mode() WITHIN GROUP (ORDER BY pitcher) AS pitcher_name, count(*) FILTER (play_result = 'Home Run') AS hr_count,
      count(*) FILTER (play_result IN ('Single', 'Home Run')) AS hit_count, count(*) FILTER (play_result = 'Strikeout') AS so_count, count(*) FILTER (play_result <> 'Other') AS pa_count FROM pl JOIN go ON o_orderkey = game_id GROUP BY ALL HAVING count(*) FILTER (play_result <> 'Other') >= 1),
    spine AS (SELECT sp.game_id, sp.player_name, game_date, home_team, away_team, pitcher_name, hr_count, hit_count, so_count, pa_count, CASE WHEN b.team = home_team THEN away_team WHEN b.team = away_team THEN home_team WHEN half ILIKE 'Bottom%' THEN home_team ELSE away_team END AS team,
      CASE WHEN b.team = away_team THEN true WHEN b.team = home_team THEN false WHEN half ILIKE 'Bottom%' THEN true ELSE false END AS is_home, CAST(hr_count > 0 AS INT) AS label, CAST(hit_count > 0 AS INT) AS label_hit, CAST(so_count > 0 AS INT) AS label_so
      FROM sp LEFT JOIN bx b ON b.game_id = sp.game_id AND b.player_name = sp.pitcher_name),
    sided AS (SELECT *, CASE WHEN is_home THEN away_team ELSE home_team END AS opp_team FROM spine)"""
