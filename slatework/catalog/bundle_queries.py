"""Composed jobs (B1-B15) on the driver tables."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from slatework.catalog.base import GAMES_SQL, ORACLES, form_games, query, table
from slatework.catalog.domain import DOMAIN_SQL, hitter_sources, prepared_sources, starter_sources
from slatework.catalog.history_queries import FORM
from slatework.functions.numeric import num
from slatework.operators import history, slate
from slatework.plans import hitters, metric_store, picks, refresh, starters
from slatework.plans.weather import derive_game_weather
from slatework.session import scratch_folder, settle, stored
from slatework.sources import sinks, versioned


@query(
    "entry_form_signal",
    f"""WITH {GAMES_SQL}, flags AS (SELECT *, CAST(hr_count > 0 AS INT) AS hr_game FROM games WHERE pa_count >= 1),
    asked AS (SELECT DISTINCT o_custkey, game_date FROM flags),
    past AS (SELECT a.o_custkey, a.game_date, f.hr_game, f.pa_count, row_number() OVER (PARTITION BY a.o_custkey, a.game_date ORDER BY f.game_date DESC, f.l_orderkey DESC) AS rn
      FROM asked a JOIN flags f ON f.o_custkey = a.o_custkey AND f.game_date < a.game_date),
    form AS (SELECT o_custkey, game_date, avg(hr_game) FILTER (rn <= 20) AS r, sum(pa_count) FILTER (rn <= 20) AS w, avg(hr_game) AS s FROM past GROUP BY ALL),
    scored AS (SELECT f.l_orderkey, f.o_custkey, f.game_date, f.hr_game AS label, CAST(date_trunc('month', f.game_date) AS DATE) AS slate, round(coalesce((r * w + s * 20) / (w + 20), 0.5e0), 6) AS proba
      FROM flags f LEFT JOIN form USING (o_custkey, game_date)),
    p AS (SELECT *, CAST(row_number() OVER (PARTITION BY slate ORDER BY proba DESC, l_orderkey) - 1 AS DOUBLE) / count(*) OVER (PARTITION BY slate) AS place FROM scored)
    SELECT slate, l_orderkey, o_custkey, game_date, label, proba, CASE WHEN place < 0.1e0 THEN 'STRONG_BUY' WHEN place < 0.25e0 THEN 'BUY' WHEN place < 0.5e0 THEN 'MODERATE' WHEN place < 0.75e0 THEN 'AVOID' ELSE 'STRONG_SELL' END AS signal FROM p""",
)
def form_signal(spark, folder):
    games = form_games(spark, folder).where("pa_count >= 1")
    form = history.recent_form(games, games, **FORM)
    scored = form.select(
        F.date_trunc("month", "game_date").cast("date").alias("slate"), "l_orderkey", "o_custkey", "game_date", F.col("hr_game").alias("label"),
        F.round(F.coalesce("shrunk_recent_hr_rate", F.lit(0.5)), 6).alias("proba"),
    )
    ranked = slate.rank_signal(scored, slate=["slate"], score="proba", tie=["l_orderkey"])
    return ranked.drop("slate_position", "slate_rows")


def _spine(s):
    """The spine with the batter's canonical name; every driver name is its own registry entry."""
    return hitters.load_spine(s).withColumn("batter_canonical", F.initcap("player_name"))


@query("b1_spine", f"WITH {DOMAIN_SQL} SELECT * FROM sided")
def spine(spark, folder):
    return hitters.load_spine(hitter_sources(spark, folder))


@query(
    "b2_season_quality",
    f"""WITH {DOMAIN_SQL} SELECT game_id, player_name, nullif(CASE WHEN c_acctbal >= 0 THEN c_acctbal END, 0) AS avg_ev, CAST(c_nationkey + 1 AS DOUBLE) AS barrel_rate, round(c_acctbal / 10000, 8) AS xwoba FROM sided JOIN customer ON c_name = player_name""",
)
def season_quality(spark, folder):
    s = prepared_sources(spark, folder, lineups=False)
    out = hitters.attach_season_quality(stored(_spine(s)), s)
    return out.select("game_id", "player_name", "avg_ev", "barrel_rate", F.round("xwoba", 8).alias("xwoba"))


@query(
    "b3_handedness",
    f"""WITH {DOMAIN_SQL}, x AS (SELECT game_id, player_name, CASE WHEN c_nationkey < 9 THEN 'R' WHEN c_nationkey < 18 THEN 'L' ELSE 'S' END AS b, CASE WHEN s_nationkey < 9 THEN 'R' WHEN s_nationkey < 18 THEN 'L' END AS t FROM sided JOIN customer ON c_name = player_name JOIN supplier ON s_name = pitcher_name)
    SELECT game_id, player_name, CAST(b = 'R' AS DOUBLE) AS batter_bats_right, CASE WHEN b <> 'S' AND t IS NOT NULL THEN CAST(b <> t AS DOUBLE) WHEN b = 'S' THEN 1e0 END AS platoon_advantage FROM x""",
)
def hands(spark, folder):
    s = prepared_sources(spark, folder, lineups=False)
    return hitters.attach_hands(stored(_spine(s)), s).select("game_id", "player_name", "batter_bats_right", "platoon_advantage")


@query(
    "b4_lineup_context",
    f"""WITH {DOMAIN_SQL}, e AS (SELECT game_date, CAST(o_orderkey AS VARCHAR) AS g, home_team AS team, c_name AS name, 1 AS slot, CAST(o_totalprice > 200000 AS DOUBLE) AS conf FROM go
      UNION ALL SELECT game_date, CAST(o_orderkey AS VARCHAR), away_team, n, i, 0e0 FROM (SELECT go.*, unnest([f, l, c_name]) AS n, unnest([1, 2, 3]) AS i FROM go JOIN (SELECT l_orderkey, arg_min(s_name, l_suppkey) AS f, arg_max(s_name, l_suppkey) AS l FROM li GROUP BY 1) ON l_orderkey = o_orderkey)),
    one AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY game_date, team, name ORDER BY g, slot) = 1)
    SELECT sided.game_id, sided.player_name, conf AS lineup_confirmed, CAST(slot AS DOUBLE) AS lineup_slot, ([4.8e0, 4.7e0, 4.6e0])[slot] AS projected_pa FROM sided LEFT JOIN one ON one.game_date = sided.game_date AND one.team = sided.team AND one.name = sided.player_name""",
)
def lineup(spark, folder):
    s = prepared_sources(spark, folder)
    return hitters.attach_lineup(stored(_spine(s)), s).select("game_id", "player_name", "lineup_confirmed", "lineup_slot", "projected_pa")


@query(
    "b5_recent_form",
    f"""WITH {DOMAIN_SQL}, g AS (SELECT player_name, game_date, game_id, max(CAST(play_result = 'Home Run' AS INT)) AS hr FROM pl JOIN go ON o_orderkey = game_id GROUP BY ALL),
    past AS (SELECT s.game_id, s.player_name, g.hr, row_number() OVER (PARTITION BY s.game_id, s.player_name ORDER BY g.game_date DESC, g.game_id DESC) AS rn FROM sided s JOIN g ON g.player_name = s.player_name AND g.game_date < s.game_date),
    a AS (SELECT game_id, player_name, round(avg(hr) FILTER (rn <= 10), 9) AS recent_hr_rate_g10, count(*) AS season_games_prior FROM past GROUP BY ALL)
    SELECT s.game_id, s.player_name, recent_hr_rate_g10, season_games_prior FROM sided s LEFT JOIN a USING (game_id, player_name)""",
)
def form(spark, folder):
    s = prepared_sources(spark, folder, lineups=False)
    out = hitters.attach_form(stored(_spine(s)), s)
    return out.select("game_id", "player_name", F.round("recent_hr_rate_g10", 9).alias("recent_hr_rate_g10"), "season_games_prior")


@query(
    "b6_opposing_pitching",
    f"""WITH {DOMAIN_SQL}, h AS (SELECT b.team, g.game_date, b.* EXCLUDE (team) FROM bx b JOIN go g ON g.o_orderkey = b.game_id WHERE innings_pitched > 0)
    SELECT s.game_id, s.player_name, round(avg(h.earned_runs / h.innings_pitched * 9), 7) AS pitcher_era_30d, round(avg((h.hits + h.walks) / h.innings_pitched), 8) AS pitcher_whip_30d
    FROM sided s LEFT JOIN h ON h.team = s.opp_team AND h.game_date >= s.game_date - INTERVAL 30 DAY AND h.game_date < s.game_date GROUP BY s.game_id, s.player_name""",
)
def opposing(spark, folder):
    s = hitter_sources(spark, folder)
    out = hitters.attach_opposing_pitching(settle(_spine(s)), s)
    return out.select("game_id", "player_name", F.round("pitcher_era_30d", 7).alias("pitcher_era_30d"), F.round("pitcher_whip_30d", 8).alias("pitcher_whip_30d"))


@query(
    "b7_pitch_matchup",
    f"""WITH {DOMAIN_SQL}, ev AS (
      SELECT pl.pitcher AS p, CASE WHEN pl.inning_half LIKE 'Top%' THEN home_team ELSE away_team END AS team, game_date AS day,
        CASE WHEN l_tax > 0.05 THEN 'SL' WHEN l_tax > 0.02 THEN 'SI' ELSE 'CU' END AS k, l_discount
      FROM li JOIN pl ON pl.id = l_orderkey * 10 + l_linenumber JOIN go ON o_orderkey = l_orderkey),
    dy AS (SELECT p, team, k, day, count(*) AS n, count(*) FILTER (l_discount > 0.05) AS m FROM ev GROUP BY ALL),
    ask AS (SELECT DISTINCT pitcher_name AS p, game_date AS d FROM sided WHERE pitcher_name IS NOT NULL),
    cn AS (SELECT p, d, team, k, CAST(sum(n) AS DOUBLE) AS n, sum(m) / sum(n) AS w, 2 AS src FROM ask JOIN dy USING (p) WHERE day < d GROUP BY ALL),
    pb AS (
      SELECT p, d, n_name AS team, CASE WHEN s_nationkey < 12 THEN 'SL' ELSE 'SI' END AS k, s_acctbal / 100 AS n, 0.3e0 AS w, 1 AS src
      FROM ask JOIN supplier ON s_name = p JOIN nation ON n_nationkey = s_nationkey),
    sh AS (SELECT p, d, team, k, w, src, n / nullif(sum(n) OVER (PARTITION BY p, d, team, src), 0) AS u FROM (SELECT * FROM pb UNION ALL SELECT * FROM cn)),
    mx AS (SELECT * FROM sh QUALIFY row_number() OVER (PARTITION BY p, d, team, k ORDER BY src) = 1),
    rk AS (SELECT *, row_number() OVER (PARTITION BY p, d, team ORDER BY u DESC, k) AS rn FROM mx WHERE u IS NOT NULL),
    pf AS (
      SELECT p, d, team, max(k) FILTER (rn = 1) AS k1, max(u) FILTER (rn = 1) AS u1, max(k) FILTER (rn = 2) AS k2, max(u) FILTER (rn = 2) AS u2,
        sum(w * u) / nullif(sum(u), 0) AS ow FROM rk GROUP BY ALL),
    gf AS (SELECT * FROM pf QUALIFY row_number() OVER (PARTITION BY p, d ORDER BY team) = 1),
    m AS (
      SELECT s.game_id, s.player_name, CASE WHEN a.p IS NOT NULL THEN a.k1 ELSE b.k1 END AS k1, CASE WHEN a.p IS NOT NULL THEN a.u1 ELSE b.u1 END AS u1,
        CASE WHEN a.p IS NOT NULL THEN a.k2 ELSE b.k2 END AS k2, CASE WHEN a.p IS NOT NULL THEN a.u2 ELSE b.u2 END AS u2,
        CASE WHEN a.p IS NOT NULL THEN a.ow ELSE b.ow END AS ow
      FROM sided s LEFT JOIN pf a ON a.p = s.pitcher_name AND a.d = s.game_date AND a.team = s.opp_team
      LEFT JOIN gf b ON b.p = s.pitcher_name AND b.d = s.game_date),
    ht AS (SELECT c_name AS player_name, CASE c_mktsegment WHEN 'BUILDING' THEN 'SL' WHEN 'MACHINERY' THEN 'CU' ELSE 'SI' END AS k, CASE WHEN c_nationkey > 0 THEN c_acctbal / 25000 END AS woba FROM customer)
    SELECT m.game_id, m.player_name, k1 AS primary_pitch_type, k2 AS secondary_pitch_type, round(u1, 10) AS primary_pitch_usage, round(ow, 10) AS overall_whiff_percent, round(h1.woba, 10) AS batter_woba_vs_primary_pitch,
      round((coalesce(CASE WHEN u1 > 0 THEN h1.woba * u1 END, 0) + coalesce(CASE WHEN u2 > 0 THEN h2.woba * u2 END, 0)) / nullif(CASE WHEN h1.woba IS NOT NULL AND u1 > 0 THEN u1 ELSE 0 END + CASE WHEN h2.woba IS NOT NULL AND u2 > 0 THEN u2 ELSE 0 END, 0), 10) AS batter_woba_vs_pitcher_arsenal
    FROM m LEFT JOIN ht h1 ON h1.player_name = m.player_name AND h1.k = k1 LEFT JOIN ht h2 ON h2.player_name = m.player_name AND h2.k = k2""",
)
def pitch_matchup(spark, folder):
    s = prepared_sources(spark, folder, lineups=False)
    out = hitters.attach_pitch_matchup(stored(_spine(s)), s)
    numbers = ["primary_pitch_usage", "overall_whiff_percent", "batter_woba_vs_primary_pitch", "batter_woba_vs_pitcher_arsenal"]
    return out.select("game_id", "player_name", "primary_pitch_type", "secondary_pitch_type", *[F.round(c, 10).alias(c) for c in numbers])


@query(
    "b8_pitcher_history",
    f"""WITH {DOMAIN_SQL} SELECT s.game_id, s.player_name, count(h.game_id) AS prior_games_vs_pitcher, round(sum(h.hr_count) / sum(h.pa_count), 9) AS prior_hr_rate_vs_pitcher, arg_max(h.hit_count, (h.game_date, h.game_id)) AS last_hit_vs_pitcher
    FROM sided s LEFT JOIN sided h ON h.player_name = s.player_name AND h.pitcher_name = s.pitcher_name AND h.game_date < s.game_date GROUP BY s.game_id, s.player_name""",
)
def pitcher_history(spark, folder):
    s = hitter_sources(spark, folder)
    out = hitters.attach_pitcher_history(settle(_spine(s)))
    return out.select("game_id", "player_name", "prior_games_vs_pitcher", F.round("prior_hr_rate_vs_pitcher", 9).alias("prior_hr_rate_vs_pitcher"), "last_hit_vs_pitcher")


@query(
    "b9_park_travel",
    f"""WITH {DOMAIN_SQL}, st AS (SELECT home_team AS team, game_date, home_team AS loc FROM go UNION ALL SELECT away_team, game_date, home_team FROM go),
    mv AS (SELECT *, coalesce(lag(loc) OVER w, team) AS prev, row_number() OVER w AS i FROM st WINDOW w AS (PARTITION BY team ORDER BY game_date, loc)), lt AS (SELECT * FROM mv QUALIFY row_number() OVER (PARTITION BY team, game_date ORDER BY i DESC) = 1),
    pk AS (SELECT n_name, n_nationkey, radians(n_nationkey * 1.5e0 + 20) AS lat, radians(n_nationkey * 2.5e0 - 120) AS lon, CASE WHEN n_nationkey < 10 THEN -8 ELSE -5 END AS tz FROM nation),
    d AS (SELECT lt.team, lt.game_date, pow(sin((b.lat - a.lat) / 2), 2) + cos(a.lat) * cos(b.lat) * pow(sin((b.lon - a.lon) / 2), 2) AS h, abs(a.tz - b.tz) AS zones FROM lt JOIN pk a ON a.n_name = prev JOIN pk b ON b.n_name = loc),
    m AS (SELECT *, 3959e0 * 2 * atan2(sqrt(h), sqrt(1 - h)) AS miles FROM d)
    SELECT s.game_id, s.player_name, round(0.9e0 + pk.n_nationkey / 100, 8) AS park_factor, round(miles, 5) AS travel_distance_miles, CAST(zones AS INT) AS timezone_changes, round(least(greatest(miles / 3000 * 25 + zones * 10, 0), 100), 7) AS travel_fatigue_score
    FROM sided s JOIN pk ON pk.n_name = s.home_team LEFT JOIN m ON m.team = s.team AND m.game_date = s.game_date""",
)
def park_travel(spark, folder):
    s = hitter_sources(spark, folder)
    out = hitters.attach_travel(hitters.attach_park(_spine(s), s, hitters.PARK_FACTORS), s)
    return out.select(
        "game_id", "player_name", F.round("park_factor", 8).alias("park_factor"), F.round("travel_distance_miles", 5).alias("travel_distance_miles"), "timezone_changes", F.round("travel_fatigue_score", 7).alias("travel_fatigue_score")
    )


@query(
    "b10_weather",
    f"""WITH {DOMAIN_SQL}, x AS (SELECT game_id, player_name, o_totalprice / 20000 AS ws, o_totalprice / 40000 AS lf, o_totalprice / 60000 AS rf, CAST(o_totalprice > 300000 AS INT) AS roof, CASE WHEN c_nationkey < 9 THEN 'R' WHEN c_nationkey < 18 THEN 'L' ELSE 'S' END AS b FROM sided JOIN go ON o_orderkey = game_id JOIN customer ON customer.c_name = player_name),
    y AS (SELECT *, round_even(CASE b WHEN 'L' THEN rf WHEN 'R' THEN lf ELSE (lf + rf) / 2 END * CASE WHEN b = 'S' THEN 0.9e0 ELSE 1e0 END, 3) AS pull FROM x)
    SELECT game_id, player_name, round(ws, 7) AS wind_speed_mph, CAST(roof AS DOUBLE) AS roof_closed_estimated, pull AS batter_pull_wind_mph, round_even(round_even(pull * 1.01e0, 3) * (1 - roof * 0.75e0), 3) AS batter_pull_weather_boost FROM y""",
)
def weather(spark, folder):
    s = prepared_sources(spark, folder, lineups=False)
    out = hitters.attach_weather(hitters.attach_hands(stored(_spine(s)), s), s)
    return out.select("game_id", "player_name", F.round("wind_speed_mph", 7).alias("wind_speed_mph"), "roof_closed_estimated", "batter_pull_wind_mph", "batter_pull_weather_boost")


# Weather documents of (home team, day): an hour per part number, so days lack hours, some fall between two, and some days have none.
_BEARINGS = "CAST(n_nationkey * 13 AS DOUBLE)"
_WEATHER_SQL = f"""{DOMAIN_SQL}, nk AS (SELECT n_name, n_nationkey FROM nation),
    gm AS (SELECT o_orderkey AS game_id, game_date, home_team, n_nationkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(game_date AS TIMESTAMP) + to_minutes(CAST(o_orderkey * 37 % 1440 AS INT)) END AS start_utc, 'Venue ' || n_nationkey AS venue,
        CASE n_nationkey % 6 WHEN 0 THEN 'Retractable' WHEN 1 THEN 'retractable open' WHEN 2 THEN 'fixed' WHEN 3 THEN 'Open' END AS roof_type, CASE WHEN n_nationkey < 10 THEN 'America/Los_Angeles' ELSE 'America/New_York' END AS tz FROM go JOIN nk ON n_name = home_team),
    hr AS (SELECT home_team, game_date, CAST(game_date AS TIMESTAMP) + to_hours(CAST(l_partkey % 24 AS INT)) AS t, round(avg(l_quantity), 6) * 2 AS temp, round(avg(l_tax), 6) * 900 AS hum, round(max(l_discount), 6) * 4 AS mm, round(max(l_extendedprice), 2) % 40 AS ws, CAST(max(l_suppkey) % 360 AS DOUBLE) AS wd
      FROM lineitem JOIN gm ON game_id = l_orderkey WHERE l_returnflag <> 'N' GROUP BY 1, 2, 3),
    lc AS (SELECT *, coalesce((start_utc AT TIME ZONE 'UTC') AT TIME ZONE tz, CAST(game_date AS TIMESTAMP) + INTERVAL 19 HOUR) AS local, coalesce(lower(roof_type) IN ('fixed', 'retractable'), false) OR venue = 'Venue 4' AS dome FROM gm),
    nr AS (SELECT lc.*, t, temp, hum, mm, ws, wd FROM lc LEFT JOIN hr USING (home_team, game_date) QUALIFY row_number() OVER (PARTITION BY game_id ORDER BY abs(epoch(t) - epoch(date_trunc('hour', local))), t) = 1),
    rd AS (SELECT game_id, game_date, home_team, k, local, dome, roof_type, CASE WHEN dome THEN 'indoor' WHEN t IS NOT NULL THEN 'observed' ELSE 'missing' END AS src, CASE WHEN dome THEN local ELSE t END AS ot, CASE WHEN dome THEN 72e0 ELSE temp END AS temp, CASE WHEN NOT dome THEN hum END AS hum,
        CASE WHEN dome THEN 0e0 ELSE mm END AS mm, CASE WHEN dome THEN 0e0 ELSE ws END AS ws, CASE WHEN NOT dome THEN wd END AS wd FROM nr),
    dp AS (SELECT *, 17.27e0 * ((temp - 32) * 5 / 9) / (237.7e0 + (temp - 32) * 5 / 9) + CASE WHEN hum IS NOT NULL THEN ln(least(greatest(hum, 1e-6), 100) / 100) END AS al, coalesce(nullif(temp, 0), 72) AS tt,
        CASE WHEN roof_type ILIKE '%fixed%' THEN 'closed' WHEN roof_type ILIKE '%retractable%' THEN CASE WHEN coalesce(mm, 0) > 0.2 OR coalesce(nullif(temp, 0), 72) < 58 OR coalesce(nullif(temp, 0), 72) > 94 OR coalesce(ws, 0) > 18 THEN 'closed' ELSE 'open' END ELSE 'open_air' END AS roof FROM rd),
    dw AS (SELECT *, 237.7e0 * al / (17.27e0 - al) * 9 / 5 + 32 AS dew FROM dp),
    cy AS (SELECT *, 1 + (tt - 70) * 0.0025e0 + (coalesce(nullif(dew, 0), 55) - 55) * 0.0015e0 AS boost, radians((coalesce(wd, 0) + 180 - k * 13 + 180 + 720) % 360 - 180) AS c, coalesce(ws, 0) AS sp FROM dw)"""


@query(
    "b10_weather_derived",
    f"""WITH {_WEATHER_SQL} SELECT game_id, local AS local_game_time, ot AS observation_time, src AS weather_source, src <> 'missing' AS weather_available, dome AS is_dome, round(temp, 6) AS temp_f, round(dew, 6) AS dew_point_f, roof AS roof_status_estimated,
      CASE WHEN src = 'observed' THEN CASE WHEN coalesce(wd, 0) BETWEEN 135 AND 225 THEN round_even(1 + least(coalesce(ws, 0), 20) * 0.01e0, 3) WHEN coalesce(wd, 0) >= 315 OR coalesce(wd, 0) <= 45 THEN round_even(greatest(0.85e0, 1 - least(coalesce(ws, 0), 20) * 0.01e0), 3) ELSE 1e0 END ELSE 1e0 END AS wind_out_factor,
      round_even(least(greatest(CASE WHEN roof = 'closed' THEN (boost + 1) / 2 ELSE boost END, 0.92e0), 1.1e0), 3) AS air_carry_factor,
      round_even(greatest(0, sp * cos(c)), 3) + 0e0 AS wind_out_to_center_mph, round_even(greatest(0, -sp * cos(c)), 3) + 0e0 AS wind_in_from_center_mph, round_even(abs(sp * sin(c)), 3) + 0e0 AS crosswind_mph FROM cy""",
)
def weather_derived(spark, folder):
    s = hitter_sources(spark, folder)
    nations = table(spark, folder, "nation").select(F.col("n_name").alias("home_team"), F.col("n_nationkey").alias("k"))
    kind = F.col("k") % 6
    games = s.games.join(nations, "home_team").select(
        "game_id", "game_date", "home_team", F.concat(F.lit("Venue "), F.col("k").cast("string")).alias("venue"),
        F.when(kind == 0, "Retractable").when(kind == 1, "retractable open").when(kind == 2, "fixed").when(kind == 3, "Open").alias("roof_type"),
        F.when(F.col("game_id") % 5 != 0, F.timestamp_seconds(F.unix_timestamp(F.col("game_date").cast("timestamp")) + F.col("game_id") * 37 % 1440 * 60)).alias("start_utc"),
    )
    hours = table(spark, folder, "lineitem").where("l_returnflag <> 'N'").join(games.select(F.col("game_id").alias("l_orderkey"), F.col("home_team").alias("team"), F.col("game_date").alias("day")), "l_orderkey").groupBy(
        "team", "day", (F.col("l_partkey") % 24).alias("hour")
    ).agg(
        (F.round(F.avg("l_quantity"), 6) * 2).alias("temperature_2m"), (F.round(F.avg("l_tax"), 6) * 900).alias("relative_humidity_2m"), (F.round(F.max("l_discount"), 6) * 4).alias("precipitation"),
        (F.round(F.max("l_extendedprice"), 2) % 40).alias("wind_speed_10m"), (F.max("l_suppkey") % 360).cast("double").alias("wind_direction_10m"),
    )
    fields = ["temperature_2m", "relative_humidity_2m", "precipitation", "wind_speed_10m", "wind_direction_10m"]
    listed = hours.groupBy("team", "day").agg(F.sort_array(F.collect_list(F.struct("hour", *fields))).alias("h"))
    clock = F.transform("h", lambda x: F.concat(F.col("day").cast("string"), F.lit("T"), F.lpad(x["hour"].cast("string"), 2, "0"), F.lit(":00"))).alias("time")
    landed = listed.select("team", "day", F.to_json(F.struct(F.struct(clock, *[F.col(f"h.{f}").alias(f) for f in fields]).alias("hourly"))).alias("payload"))
    bearings = {r["home_team"]: r["k"] * 13.0 for r in nations.collect()}
    out = derive_game_weather(games, s.parks, landed, domes=["Venue 4"], bearings=bearings)
    return out.select(
        "game_id", "local_game_time", "observation_time", "weather_source", "weather_available", "is_dome", F.round("temp_f", 6).alias("temp_f"), F.round("dew_point_f", 6).alias("dew_point_f"), "roof_status_estimated",
        "wind_out_factor", "air_carry_factor", *[(F.col(c) + F.lit(0.0)).alias(c) for c in ("wind_out_to_center_mph", "wind_in_from_center_mph", "crosswind_mph")],
    )


@query("b_hitter_features")
def hitter_features(spark, folder):
    return hitters.build_hitter_features(prepared_sources(spark, folder))


@query(
    "b11_starter_spine",
    f"""WITH {DOMAIN_SQL}, st AS (SELECT l_orderkey, arg_min(s_name, l_suppkey) AS f, arg_max(s_name, l_suppkey) AS l FROM li GROUP BY 1),
    lu AS (SELECT go.*, f, l, row_number() OVER (PARTITION BY game_date, home_team, away_team ORDER BY CAST(o_orderkey AS VARCHAR)) AS seq FROM go JOIN st ON l_orderkey = o_orderkey),
    gm AS (SELECT o_orderkey AS gid, game_date, home_team, away_team, row_number() OVER (PARTITION BY game_date, home_team, away_team ORDER BY o_orderkey) AS seq FROM go),
    j AS (SELECT lu.*, gid FROM lu JOIN gm USING (game_date, home_team, away_team, seq))
    SELECT gid AS game_id, CAST(o_orderkey AS VARCHAR) AS lineup_game_id, game_date, home_team AS team, away_team AS opponent_team, f AS starter_name, true AS is_home, 1 AS opponent_lineup_size FROM j UNION ALL
    SELECT gid, CAST(o_orderkey AS VARCHAR), game_date, away_team, home_team, l, false, 3 FROM j""",
)
def starter_spine(spark, folder):
    # Lineups and games both start from the orders.
    out = starters.starter_spine(starter_sources(spark, folder, hitter_sources(spark, folder, keep=settle)))
    return out.select("game_id", "lineup_game_id", "game_date", "team", "opponent_team", "starter_name", "is_home", "opponent_lineup_size")


@query("b11_starter_features")
def starter_features(spark, folder):
    return starters.build_starter_features(starter_sources(spark, folder, prepared_sources(spark, folder)))


@query("b12_serving_features")
def serving(spark, folder):
    s = prepared_sources(spark, folder)
    scheduled = hitters.load_spine(s).select("game_id", "game_date", "player_name", "team", "opp_team", "home_team", "pitcher_name")
    return hitters.enrich_for_serving(scheduled, s)


# Teams in every third day's games send the first supplier of their nation in name order instead.
@query(
    "m19_override_recompute",
    f"""WITH {DOMAIN_SQL}, alt AS (SELECT n_name AS team, min(s_name) AS pitcher FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1),
    ov AS (SELECT DISTINCT game_date, opp_team, pitcher FROM sided JOIN alt ON alt.team = opp_team WHERE date_diff('day', DATE '1992-01-01', game_date) % 3 = 0),
    sw AS (SELECT s.game_id, s.player_name, s.game_date, coalesce(o.pitcher, s.pitcher_name) AS pitcher_name, o.pitcher IS NOT NULL AS applied FROM sided s LEFT JOIN ov o ON o.game_date = s.game_date AND o.opp_team = s.opp_team),
    bd AS (SELECT player_name, game_date AS day, sum(earned_runs / nullif(innings_pitched, 0) * 9) AS e, count(earned_runs / nullif(innings_pitched, 0)) AS n FROM bx JOIN go ON o_orderkey = game_id WHERE innings_pitched > 0 GROUP BY ALL),
    era AS (SELECT w.pitcher_name, w.game_date, sum(e) / nullif(sum(n), 0) AS era FROM (SELECT DISTINCT pitcher_name, game_date FROM sw) w JOIN bd ON bd.player_name = w.pitcher_name AND bd.day < w.game_date AND bd.day >= w.game_date - 30 GROUP BY ALL),
    met AS (SELECT w.game_id, w.player_name, count(h.game_id) AS met FROM sw w LEFT JOIN sided h ON h.player_name = w.player_name AND h.pitcher_name = w.pitcher_name AND h.game_date < w.game_date GROUP BY ALL)
    SELECT w.game_id, w.player_name, w.pitcher_name, applied AS starter_override_applied, round(era, 7) AS pitcher_era_30d, met AS prior_games_vs_pitcher
    FROM sw w JOIN met USING (game_id, player_name) LEFT JOIN era ON era.pitcher_name = w.pitcher_name AND era.game_date = w.game_date""",
)
def override_recompute(spark, folder):
    s = prepared_sources(spark, folder)
    scheduled = hitters.load_spine(s).select("game_id", "game_date", "player_name", "team", "opp_team", "home_team", "pitcher_name")
    served = stored(hitters.enrich_for_serving(scheduled, s))
    names = table(spark, folder, "supplier").join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("team")).agg(F.min("s_name").alias("pitcher_name"))
    teams = table(spark, folder, "nation").select("n_name").collect()
    dates = served.select("game_date").distinct().where(F.datediff("game_date", F.lit("1992-01-01").cast("date")) % 3 == 0)
    out = hitters.override_starters(served, dates.withColumn("team", F.explode(F.array(*[F.lit(r[0]) for r in teams]))).join(names, "team"), s)
    return out.select("game_id", "player_name", "pitcher_name", "starter_override_applied", F.round("pitcher_era_30d", 7).alias("pitcher_era_30d"), "prior_games_vs_pitcher")


# Games from the last month on: strikeouts turn into walks, then the table built before is brought up to date.
@query("b16_incremental_rebuild")
def incremental_rebuild(spark, folder):
    before = prepared_sources(spark, folder)
    built = stored(hitters.build_hitter_features(before))
    last = before.games.agg(F.date_sub(F.max("game_date"), 30)).first()[0]
    changed = stored(before.games.where(F.col("game_date") >= F.lit(last)).select("game_id"))
    result = F.when((F.col("play_result") == "Strikeout") & F.col("__changed").isNotNull(), "Walk").otherwise(F.col("play_result"))
    plays = before.plays.join(changed.withColumn("__changed", F.lit(True)), "game_id", "left").withColumn("play_result", result).drop("__changed")
    return hitters.rebuild_changed(built, before, replace(before, plays=stored(plays.select(*before.plays.columns))), changed)


def _picks(spark, folder):
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("pick_id"), "o_custkey", F.to_date("o_orderdate").alias("analysis_date"))
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("player_name"), F.col("c_nationkey").alias("n_nationkey"))
    teams = table(spark, folder, "nation").select("n_nationkey", F.col("n_name").alias("team"))
    return orders.join(customers, "o_custkey").join(teams, "n_nationkey").select("pick_id", "analysis_date", F.upper("player_name").alias("player_name"), "team")


@query(
    "b13_pick_labels",
    f"""WITH {DOMAIN_SQL}, pk AS (SELECT o_orderkey AS pick_id, CAST(o_orderdate AS DATE) AS analysis_date, c_name, n_name AS team FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
    j AS (SELECT pk.*, g.o_orderkey AS game_id, CASE WHEN pk.team = g.home_team THEN g.away_team ELSE g.home_team END AS opp FROM pk LEFT JOIN go g ON g.game_date = pk.analysis_date AND (g.home_team = pk.team OR g.away_team = pk.team) QUALIFY row_number() OVER (PARTITION BY pick_id ORDER BY g.o_orderkey) = 1),
    hr AS (SELECT game_id, player_name, count(*) AS n FROM (SELECT pl.*, go.c_name AS bat FROM pl JOIN go ON o_orderkey = game_id) WHERE play_result = 'Home Run' GROUP BY ALL),
    ld AS (SELECT * FROM bx QUALIFY row_number() OVER (PARTITION BY game_id, team ORDER BY innings_pitched DESC, player_name) = 1)
    SELECT j.pick_id, j.game_id, CAST(coalesce(hr.n, 0) > 0 AS INT) AS label, ld.player_name AS leading_pitcher, round(ld.earned_runs / nullif(ld.innings_pitched, 0) * 9, 8) AS pitcher_era FROM j LEFT JOIN hr ON hr.game_id = j.game_id AND hr.player_name = j.c_name LEFT JOIN ld ON ld.game_id = j.game_id AND ld.team = j.opp""",
)
def pick_labels(spark, folder):
    s = hitter_sources(spark, folder)
    plays = s.plays.withColumn("batter", F.regexp_replace("batter", " homered to left", ""))
    out = picks.label_picks(_picks(spark, folder), s.games, plays, s.pitching_box)
    return out.select("pick_id", "game_id", "label", "leading_pitcher", F.round("pitcher_era", 8).alias("pitcher_era"))


@query(
    "b13_pick_labels_by_text",
    f"""WITH {DOMAIN_SQL}, pk AS (SELECT o_orderkey AS pick_id, game_date AS analysis_date, c_name, home_team, away_team FROM go),
    j AS (SELECT pk.pick_id, pk.c_name, g.o_orderkey AS game_id FROM pk JOIN go g ON g.game_date = pk.analysis_date AND ((g.home_team = pk.home_team AND g.away_team = pk.away_team) OR (g.home_team = pk.away_team AND g.away_team = pk.home_team)) QUALIFY row_number() OVER (PARTITION BY pick_id ORDER BY g.o_orderkey) = 1),
    hit AS (SELECT game_id, player_name, count(*) AS n FROM pl WHERE play_result IN ('Single', 'Home Run') GROUP BY ALL)
    SELECT pick_id, j.game_id, CAST(coalesce(n, 0) > 0 AS INT) AS label FROM j LEFT JOIN hit ON hit.game_id = j.game_id AND hit.player_name = j.c_name""",
)
def pick_labels_by_text(spark, folder):
    s = hitter_sources(spark, folder)
    schedule = s.games.select(F.col("game_id").alias("pick_id"), "home_team", "away_team")
    # Half of the descriptions name the home side first.
    label = F.when(F.col("home_team") < F.col("away_team"), F.concat_ws(" @ ", "away_team", "home_team")).otherwise(F.concat_ws(" @ ", "home_team", "away_team"))
    rows = _picks(spark, folder).join(schedule.select("pick_id", label.alias("game_description")), "pick_id")
    plays = s.plays.withColumn("batter", F.regexp_replace("batter", " homered to left", ""))
    return picks.label_picks(rows, s.games, plays, s.pitching_box, by_description=True, results=hitters.HITS).select("pick_id", "game_id", "label")


@query(
    "b16_daily_refresh",
    """WITH u AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS slate, o_orderkey, max(l_extendedprice) AS p FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' AND o_orderstatus = 'P' GROUP BY ALL)
    SELECT o.o_orderkey, CAST(date_trunc('month', o.o_orderdate) AS DATE) AS slate, coalesce(u.p, o_totalprice) AS p FROM orders o LEFT JOIN u ON u.o_orderkey = o.o_orderkey""",
)
def daily_refresh(spark, folder):
    path = f"{scratch_folder(spark)}/refresh-{uuid.uuid4().hex}"
    month = F.date_trunc("month", "o_orderdate").cast("date").alias("slate")
    orders = table(spark, folder, "orders")
    sinks.write_snapshot(orders.select("o_orderkey", month, F.col("o_totalprice").alias("p")), path, partition="slate")
    pending = orders.where("o_orderstatus = 'P'").select("o_orderkey", month)
    prices = table(spark, folder, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_extendedprice").alias("p"))
    refresh.refresh_table(spark, path, pending.join(prices, "o_orderkey"), keys=["slate", "o_orderkey"], order="p", partition="slate")
    return spark.read.parquet(path)


@query(
    "b16_refresh_moved_keys",
    """WITH u AS (SELECT o_orderkey, CAST(date_trunc('month', max(l_shipdate)) AS DATE) AS slate, max(l_extendedprice) AS p FROM lineitem JOIN orders ON o_orderkey = l_orderkey
      WHERE o_orderstatus = 'P' GROUP BY 1)
    SELECT o.o_orderkey, coalesce(u.slate, CAST(date_trunc('month', o.o_orderdate) AS DATE)) AS slate, coalesce(u.p, o_totalprice) AS p FROM orders o LEFT JOIN u ON u.o_orderkey = o.o_orderkey""",
)
def refresh_moved_keys(spark, folder):
    """Pending orders move to the month they arrive in."""
    path = f"{scratch_folder(spark)}/refresh-{uuid.uuid4().hex}"
    orders = table(spark, folder, "orders")
    sinks.write_snapshot(orders.select("o_orderkey", F.date_trunc("month", "o_orderdate").cast("date").alias("slate"), F.col("o_totalprice").alias("p")), path, partition="slate")
    lines = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.date_trunc("month", F.max("l_shipdate")).cast("date").alias("slate"), F.max("l_extendedprice").alias("p")
    )
    updates = lines.join(orders.where("o_orderstatus = 'P'").select("o_orderkey"), "o_orderkey")
    refresh.refresh_table(spark, path, updates, keys=["o_orderkey"], order="p", partition="slate")
    return spark.read.parquet(path)


# The same moves, published as one version after another: first the orders of even numbers, then all, some of them again.
@query("b16_atomic_refresh", ORACLES["b16_refresh_moved_keys"])
def atomic_refresh(spark, folder):
    path = f"{scratch_folder(spark)}/versioned-{uuid.uuid4().hex}"
    orders = table(spark, folder, "orders")
    options = {"keys": ["o_orderkey"], "partition": "slate"}
    versioned.create_table(orders.select("o_orderkey", F.date_trunc("month", "o_orderdate").cast("date").alias("slate"), F.col("o_totalprice").alias("p")), path, **options)
    lines = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.date_trunc("month", F.max("l_shipdate")).cast("date").alias("slate"), F.max("l_extendedprice").alias("p")
    )
    updates = settle(lines.join(orders.where("o_orderstatus = 'P'").select("o_orderkey"), "o_orderkey"))
    first = updates.where("o_orderkey % 2 = 0").withColumns({"slate": F.add_months("slate", 1), "p": F.col("p") + 1})
    versioned.refresh_table(spark, path, first, order="p", **options)
    versioned.refresh_table(spark, path, updates, order="p", **options)
    return versioned.read_table(spark, path, partition="slate")


@query("b14_pick_features")
def pick_features(spark, folder):
    s = hitter_sources(spark, folder)
    suppliers = table(spark, folder, "supplier")
    rows = _picks(spark, folder).withColumn("player_name", F.initcap("player_name")).join(
        s.lineups.select(F.col("game_id").cast("long").alias("pick_id"), F.get_json_object("home_pitcher", "$.name").alias("pitcher_name")), "pick_id"
    )
    season = suppliers.select(F.col("s_name").alias("last_name_first_name"), (F.col("s_acctbal") / num(400)).alias("k_percent"), F.col("s_acctbal").alias("fastball_spin"), (F.col("s_nationkey") * num(90)).alias("breaking_spin"))
    trends = table(spark, folder, "customer").select(
        F.col("c_name").alias("player_name"), F.when(F.col("c_nationkey") < 12, "vs_lhp").otherwise("vs_rhp").alias("matchup_type"), *[(F.col("c_acctbal") / num(d)).alias(r) for r, d in zip(picks.TREND_RATES, (100, 200, 300, 400, 500))], (F.col("c_nationkey") * 2).alias("batted_ball_events")
    )
    return picks.attach_pick_features(rows, pitcher_season=season, exit_velocity=s.exit_velocity, batter_season=s.batter_season, trends=trends)


@query(
    "b15_metric_store",
    """WITH m AS (SELECT l_suppkey AS pid, CAST(date_trunc('month', l_shipdate) AS DATE) AS d, avg(l_quantity) AS barrel, max(l_linenumber) AS ab FROM lineitem GROUP BY ALL),
    g AS (SELECT l_orderkey AS game_id, CAST(o_orderdate AS DATE) AS d, min(l_suppkey) AS pitcher, list_distinct(list(l_suppkey)) AS lineup, list(l_suppkey) FILTER (l_returnflag = 'R') AS hr FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL),
    x AS (SELECT game_id, d, pitcher, unnest(lineup) AS pid, hr FROM g),
    a AS (SELECT x.*, h.d AS hd, h.barrel AS hb, p.d AS pd, p.barrel AS pb FROM x ASOF LEFT JOIN m h ON h.pid = x.pid AND h.d < x.d ASOF LEFT JOIN m p ON p.pid = x.pitcher AND p.d < x.d)
    SELECT game_id, pid AS player_id, hd AS stat_date, round(hb * 0.4, 7) AS power_score, round(pb * 0.4, 7) AS hr_vulnerability, CAST(coalesce(list_contains(hr, pid), false) AS INT) AS label FROM a WHERE hd IS NOT NULL AND pd IS NOT NULL""",
)
def metrics(spark, folder):
    lines = table(spark, folder, "lineitem")
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.to_date("o_orderdate").alias("game_date"))
    monthly = lines.groupBy(F.col("l_suppkey").alias("player_id"), F.date_trunc("month", "l_shipdate").cast("date").alias("stat_date")).agg(F.avg("l_quantity").alias("rate"))
    nothing = {c: F.lit(None).cast("double") for c in {*metric_store.HITTER_METRICS, *metric_store.PITCHER_METRICS}}
    stats = monthly.withColumns(nothing | {"barrel_rate": F.col("rate"), "hr_per_9": F.col("rate")}).drop("rate")
    both = stats.withColumn("is_pitcher", F.lit(True)).unionByName(stats.withColumn("is_pitcher", F.lit(False)))
    games = lines.join(orders, "l_orderkey").groupBy(F.col("l_orderkey").alias("game_id"), "game_date").agg(
        F.min("l_suppkey").alias("pitcher_id"), F.collect_set("l_suppkey").alias("lineup"), F.collect_list(F.when(F.col("l_returnflag") == "R", F.col("l_suppkey"))).alias("home_hr_hitters")
    ).withColumns({"home_team": F.lit("X"), "pitcher_name": F.lit("Ace"), "weather_temp": F.lit(None).cast("double"), "weather_wind": F.lit(None).cast("double")})
    out = metric_store.build_metric_features(games, both)
    return out.select("game_id", "player_id", "stat_date", F.round("power_score", 7).alias("power_score"), F.round("hr_vulnerability", 7).alias("hr_vulnerability"), "label")


@query(
    "m20_results_lookup",
    f"""WITH {DOMAIN_SQL} SELECT game_date, CASE WHEN inning_half ILIKE 'Bottom%' THEN home_team ELSE away_team END AS team, lower(replace(player_name, '#', '')) AS surname, count(*) AS hr_count FROM pl JOIN go ON o_orderkey = game_id WHERE play_result = 'Home Run' GROUP BY ALL""",
)
def results_lookup(spark, folder):
    s = hitter_sources(spark, folder)
    plays = s.plays.withColumn("batter", F.regexp_replace("batter", " homered to left", ""))
    return picks.results_lookup(plays, s.games, ["Home Run"])
