"""Windows over an entity's past."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from slatework.catalog.base import GAMES_SQL, PLAYS_SQL, form_games, game_plays, games, line_parts, plays, query, rounded, table
from slatework.functions.numeric import flag, num, ratio
from slatework.operators import history
from slatework.operators.aggregates import entity_games
from slatework.operators.joins import lookup_first
from slatework.operators.ordering import top_rows

FORM = dict(
    entity=["o_custkey"], date="game_date", game="l_orderkey", weight="pa_count",
    flags={"hr": "hr_game", "hit": "hit_game", "so": "so_game"},
)


@query(
    "a1_entity_game_spine",
    f"""WITH {GAMES_SQL}, m AS (
      SELECT o_custkey, l_orderkey, game_date,
             mode() WITHIN GROUP (ORDER BY l_linestatus) AS half_mode,
             mode() WITHIN GROUP (ORDER BY l_suppkey) AS pitcher
      FROM plays GROUP BY ALL)
    SELECT g.*, m.half_mode, m.pitcher,
           CAST(hr_count > 0 AS INT) AS label, CAST(hit_count > 0 AS INT) AS label_hit, CAST(so_count > 0 AS INT) AS label_so
    FROM games g JOIN m USING (o_custkey, l_orderkey, game_date) WHERE pa_count >= 1""",
)
def spine(spark, folder):
    spine = entity_games(
        game_plays(spark, folder),
        keys=["o_custkey", "l_orderkey", "game_date"],
        counts={
            "hr_count": F.col("l_returnflag") == "R",
            "hit_count": F.col("l_returnflag").isin("R", "A"),
            "so_count": F.col("l_returnflag") == "N",
            "pa_count": F.col("l_quantity") > 2,
        },
        modes={"half_mode": "l_linestatus", "pitcher": "l_suppkey"},
    )
    return spine.where("pa_count >= 1").withColumns(
        {"label": flag(F.col("hr_count") > 0), "label_hit": flag(F.col("hit_count") > 0), "label_so": flag(F.col("so_count") > 0)}
    )


_FORM_SQL = f"""WITH {GAMES_SQL}, flags AS (
      SELECT *, CAST(hr_count > 0 AS INT) AS hr_game, CAST(hit_count > 0 AS INT) AS hit_game, CAST(so_count > 0 AS INT) AS so_game FROM games),
    asked AS (SELECT DISTINCT o_custkey, game_date FROM games),
    past AS (
      SELECT a.o_custkey, a.game_date, f.hr_game, f.hit_game, f.so_game, f.pa_count, f.game_date AS past_date,
             row_number() OVER (PARTITION BY a.o_custkey, a.game_date ORDER BY f.game_date DESC, f.l_orderkey DESC) AS rn
      FROM asked a JOIN flags f ON f.o_custkey = a.o_custkey AND f.game_date < a.game_date)"""


@query(
    "w1_last_n_form",
    _FORM_SQL
    + """, form AS (SELECT o_custkey, game_date, """
    + ", ".join(
        f"round(avg({s}_game) FILTER (rn <= {n}), 6) AS recent_{s}_rate_g{n}" for n in (3, 5, 10, 20) for s in ("hr", "hit", "so")
    )
    + ", "
    + ", ".join(
        f"count(*) FILTER (rn <= {n}) AS recent_games_used_g{n}, CAST(sum(pa_count) FILTER (rn <= {n}) AS DOUBLE) AS recent_weight_used_g{n}"
        for n in (3, 5, 10, 20)
    )
    + """ FROM past GROUP BY ALL)
    SELECT g.o_custkey, g.l_orderkey, g.game_date, form.* EXCLUDE (o_custkey, game_date)
    FROM games g LEFT JOIN form USING (o_custkey, game_date)""",
)
def last_n_form(spark, folder):
    base = form_games(spark, folder)
    form = history.recent_form(base, base, **FORM)
    wanted = [c for c in form.columns if re.fullmatch(r"recent_\w+_g\d+", c)]
    return rounded(form.select("o_custkey", "l_orderkey", "game_date", *wanted))


@query(
    "w2_season_to_date",
    _FORM_SQL
    + """, form AS (SELECT o_custkey, game_date, """
    + ", ".join(f"round(avg({s}_game), 6) AS season_{s}_rate_to_date" for s in ("hr", "hit", "so"))
    + """, count(*) AS season_games_prior, CAST(sum(pa_count) AS DOUBLE) AS season_weight_prior FROM past GROUP BY ALL)
    SELECT g.o_custkey, g.l_orderkey, g.game_date, form.* EXCLUDE (o_custkey, game_date)
    FROM games g LEFT JOIN form USING (o_custkey, game_date)""",
)
def season_to_date(spark, folder):
    base = form_games(spark, folder)
    form = history.recent_form(base, base, **FORM)
    wanted = [c for c in form.columns if c.startswith("season_")]
    return rounded(form.select("o_custkey", "l_orderkey", "game_date", *wanted))


@query(
    "w3_days_since_last",
    """SELECT o_custkey, o_orderkey, d AS game_date,
        CAST(date_diff('day', (SELECT max(CAST(p.o_orderdate AS DATE)) FROM orders p WHERE p.o_custkey = q.o_custkey AND CAST(p.o_orderdate AS DATE) < q.d), d) AS INT) AS days_since_last_game
    FROM (SELECT *, CAST(o_orderdate AS DATE) AS d FROM orders) q""",
)
def days_since_last(spark, folder):
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("game_date"))
    out = history.prior_days(
        orders, orders, keys=["o_custkey"], date="game_date", parts={}, result={}, last_date="last_date"
    )
    return out.withColumn("days_since_last_game", history.days_since("game_date", "last_date")).drop("last_date")


@query(
    "w4_shrunk_rate",
    _FORM_SQL
    + """, form AS (SELECT o_custkey, game_date, avg(hr_game) FILTER (rn <= 20) AS r, sum(pa_count) FILTER (rn <= 20) AS w, avg(hr_game) AS s
      FROM past GROUP BY ALL)
    SELECT g.o_custkey, g.l_orderkey, g.game_date,
           round((r * w + s * 20) / (w + 20), 6) AS shrunk_recent_hr_rate, round(r - s, 6) AS recent_vs_season_hr_delta
    FROM games g LEFT JOIN form USING (o_custkey, game_date)""",
)
def shrunk_rates(spark, folder):
    base = form_games(spark, folder)
    form = history.recent_form(base, base, **FORM)
    return rounded(form.select("o_custkey", "l_orderkey", "game_date", "shrunk_recent_hr_rate", "recent_vs_season_hr_delta"))


@query(
    "w5_team_rollup_30d",
    f"""WITH {PLAYS_SQL}, asked AS (SELECT DISTINCT l_suppkey, game_date FROM plays),
    shipped AS (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS d, l_tax, l_discount, l_quantity FROM lineitem WHERE l_tax > 0)
    SELECT a.l_suppkey, a.game_date,
           round(avg(s.l_discount / s.l_tax * 9), 9) AS era_30d, round(avg((s.l_quantity + s.l_discount) / s.l_tax), 7) AS whip_30d
    FROM asked a LEFT JOIN shipped s ON s.l_suppkey = a.l_suppkey AND s.d >= a.game_date - INTERVAL 30 DAY AND s.d < a.game_date
    GROUP BY ALL""",
)
def team_rollup(spark, folder):
    asked = plays(spark, folder).select("l_suppkey", "game_date").distinct()
    shipped = table(spark, folder, "lineitem").where("l_tax > 0").select(
        "l_suppkey",
        F.to_date("l_shipdate").alias("game_date"),
        (ratio("l_discount", "l_tax") * num(9)).alias("era"),
        ratio(F.col("l_quantity") + F.col("l_discount"), "l_tax").alias("whip"),
    )
    parts = {f"{c}_{f.__name__}": f(c) for c in ("era", "whip") for f in (F.sum, F.count)}
    out = history.prior_days(
        asked, shipped, keys=["l_suppkey"], date="game_date", days=30, parts=parts,
        result={f"{c}_30d": ratio(f"{c}_sum", f"{c}_count") for c in ("era", "whip")},
    )
    return out.select("l_suppkey", "game_date", F.round("era_30d", 9).alias("era_30d"), F.round("whip_30d", 7).alias("whip_30d"))


@query(
    "w6_ratio_of_sums_30d",
    f"""WITH {PLAYS_SQL}, asked AS (SELECT DISTINCT l_suppkey, game_date FROM plays),
    h AS (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS d, l_quantity AS ip, l_linenumber AS so, l_tax AS er FROM lineitem)
    SELECT a.l_suppkey, a.game_date, count(h.d) AS starts_30d, round(avg(ip), 11) AS avg_ip_30d, round(avg(so), 11) AS avg_so_30d,
           round(sum(so) / sum(ip) * 9, 11) AS k_per_9_30d, round(sum(er) / sum(ip) * 9, 11) AS era_30d,
           max(so) AS max_so_30d
    FROM asked a LEFT JOIN h ON h.l_suppkey = a.l_suppkey AND h.d >= a.game_date - INTERVAL 30 DAY AND h.d < a.game_date
    GROUP BY ALL""",
)
def ratio_of_sums(spark, folder):
    asked = plays(spark, folder).select("l_suppkey", "game_date").distinct()
    shipped = table(spark, folder, "lineitem").select(
        "l_suppkey", F.to_date("l_shipdate").alias("game_date"), F.col("l_quantity").alias("ip"),
        F.col("l_linenumber").alias("so"), F.col("l_tax").alias("er"),
    )
    rows = history.rows_seen()
    out = history.prior_days(
        asked, shipped, keys=["l_suppkey"], date="game_date", days=30,
        parts={"ip": F.sum("ip"), "so": F.sum("so"), "er": F.sum("er"), "max_so": F.max("so")},
        result={
            "starts_30d": rows,
            "avg_ip_30d": ratio("ip", rows),
            "avg_so_30d": ratio("so", rows),
            "k_per_9_30d": ratio("so", "ip") * num(9),
            "era_30d": ratio("er", "ip") * num(9),
            "max_so_30d": F.col("max_so"),
        },
    )
    return rounded(out, 11)


@query(
    "w7_opponent_form_14d",
    f"""WITH {PLAYS_SQL}, days AS (
      SELECT c.c_nationkey AS team, p.game_date AS d, count(*) AS pa, count(*) FILTER (l_returnflag = 'N') AS so, count(*) FILTER (l_returnflag = 'R') AS hits
      FROM plays p JOIN customer c ON c.c_custkey = p.o_custkey GROUP BY ALL),
    asked AS (SELECT DISTINCT team, d AS game_date FROM days)
    SELECT a.team, a.game_date, count(h.d) AS games_14d, round(avg(h.pa), 6) AS pa_per_game_14d,
           round(sum(h.so) / sum(h.pa), 6) AS k_rate_14d, round(sum(h.hits) / sum(h.pa), 6) AS hits_per_pa_14d
    FROM asked a LEFT JOIN days h ON h.team = a.team AND h.d >= a.game_date - INTERVAL 14 DAY AND h.d < a.game_date
    GROUP BY ALL""",
)
def opponent_form(spark, folder):
    teams = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("team"))
    days = entity_games(
        plays(spark, folder).join(teams, "o_custkey"),
        keys=["team", "game_date"],
        counts={"pa": F.lit(True), "so": F.col("l_returnflag") == "N", "hits": F.col("l_returnflag") == "R"},
    )
    out = history.prior_days(
        days.select("team", "game_date"), days, keys=["team"], date="game_date", days=14,
        parts={c: F.sum(c) for c in ("pa", "so", "hits")},
        result={
            "games_14d": history.rows_seen(),
            "pa_per_game_14d": ratio("pa", history.rows_seen()),
            "k_rate_14d": ratio("so", "pa"),
            "hits_per_pa_14d": ratio("hits", "pa"),
        },
    )
    return rounded(out)


def _pair_games(spark, folder):
    return entity_games(
        game_plays(spark, folder),
        keys=["o_custkey", "l_suppkey", "l_orderkey", "game_date"],
        counts={"pa_count": F.lit(True), "hr_count": F.col("l_returnflag") == "R", "so_count": F.col("l_returnflag") == "N"},
    )


_PAIR_SQL = f"""{PLAYS_SQL}, pg AS (
      SELECT o_custkey, l_suppkey, l_orderkey, game_date, count(*) AS pa_count,
             count(*) FILTER (l_returnflag = 'R') AS hr_count, count(*) FILTER (l_returnflag = 'N') AS so_count
      FROM plays GROUP BY ALL)"""


@query(
    "w8_prior_pair_history",
    f"""WITH {_PAIR_SQL}
    SELECT g.o_custkey, g.l_suppkey, g.l_orderkey, g.game_date, g.pa_count, g.hr_count, g.so_count,
           count(h.l_orderkey) AS prior_games_vs_opponent, CAST(coalesce(sum(h.pa_count), 0) AS BIGINT) AS prior_pa_count_vs_opponent,
           CAST(coalesce(sum(h.hr_count), 0) AS BIGINT) AS prior_hr_vs_opponent, CAST(coalesce(sum(h.so_count), 0) AS BIGINT) AS prior_so_vs_opponent,
           arg_max(h.hr_count, (h.game_date, h.l_orderkey)) AS last_hr_vs_opponent, arg_max(h.so_count, (h.game_date, h.l_orderkey)) AS last_so_vs_opponent,
           round(sum(h.hr_count) / sum(h.pa_count), 6) AS prior_hr_rate_vs_opponent, round(sum(h.so_count) / sum(h.pa_count), 6) AS prior_so_rate_vs_opponent,
           round(sum(h.pa_count) / count(h.l_orderkey), 6) AS prior_avg_pa_count_vs_opponent,
           CAST(date_diff('day', max(h.game_date), g.game_date) AS INT) AS days_since_last_vs_opponent
    FROM pg g LEFT JOIN pg h ON h.o_custkey = g.o_custkey AND h.l_suppkey = g.l_suppkey AND h.game_date < g.game_date
    GROUP BY g.o_custkey, g.l_suppkey, g.l_orderkey, g.game_date, g.pa_count, g.hr_count, g.so_count""",
)
def prior_pairs(spark, folder):
    base = _pair_games(spark, folder)
    return rounded(
        history.pair_history(
            base, base, pair=["o_custkey", "l_suppkey"], date="game_date", game="l_orderkey", weight="pa_count",
            counts={"hr": "hr_count", "so": "so_count"}, dealt=line_parts(spark, folder),
        )
    )


@query(
    "w8_prior_pair_same_day",
    f"""WITH {PLAYS_SQL}, pg AS (
      SELECT l_suppkey, l_returnflag, l_orderkey, game_date, count(*) AS pa_count, count(*) FILTER (l_linestatus = 'F') AS hr_count
      FROM plays GROUP BY ALL)
    SELECT l_suppkey, l_returnflag, l_orderkey, game_date, pa_count, hr_count,
           count(*) OVER w AS prior_games_vs_opponent, CAST(coalesce(sum(pa_count) OVER w, 0) AS BIGINT) AS prior_pa_count_vs_opponent,
           CAST(coalesce(sum(hr_count) OVER w, 0) AS BIGINT) AS prior_hr_vs_opponent,
           lag(hr_count) OVER o AS last_hr_vs_opponent, round(sum(hr_count) OVER w / sum(pa_count) OVER w, 6) AS prior_hr_rate_vs_opponent,
           round(sum(pa_count) OVER w / nullif(count(*) OVER w, 0), 6) AS prior_avg_pa_count_vs_opponent,
           CAST(date_diff('day', lag(game_date) OVER o, game_date) AS INT) AS days_since_last_vs_opponent
    FROM pg
    WINDOW o AS (PARTITION BY l_suppkey, l_returnflag ORDER BY game_date, l_orderkey),
           w AS (PARTITION BY l_suppkey, l_returnflag ORDER BY game_date, l_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def prior_pairs_same_day(spark, folder):
    base = entity_games(
        game_plays(spark, folder),
        keys=["l_suppkey", "l_returnflag", "l_orderkey", "game_date"],
        counts={"pa_count": F.lit(True), "hr_count": F.col("l_linestatus") == "F"},
    )
    return rounded(
        history.pair_history(
            base, base, pair=["l_suppkey", "l_returnflag"], date="game_date", game="l_orderkey", weight="pa_count",
            counts={"hr": "hr_count"}, same_day=True, dealt=line_parts(spark, folder),
        )
    )


@query(
    "w9_prior_starter_vs_opponent",
    f"""WITH {PLAYS_SQL}, lines AS (
      SELECT p.l_suppkey, c.c_nationkey AS opponent, p.l_orderkey, p.game_date, sum(l_quantity) AS ip, sum(l_linenumber) AS so
      FROM plays p JOIN customer c ON c.c_custkey = p.o_custkey GROUP BY ALL),
    starts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY ip DESC, so DESC, l_suppkey) AS rn FROM lines) WHERE rn = 1)
    SELECT g.l_suppkey, g.opponent, g.l_orderkey, g.game_date, count(h.l_orderkey) AS prior_starts_vs_opp,
           round(sum(h.ip), 6) AS prior_ip_vs_opp, CAST(sum(h.so) AS BIGINT) AS prior_so_vs_opp, round(sum(h.so) / sum(h.ip) * 9, 6) AS prior_k_per_9_vs_opp,
           CAST(date_diff('day', max(h.game_date), g.game_date) AS INT) AS days_since_last_vs_opp, CAST(arg_max(h.so, (h.game_date, h.l_orderkey)) AS BIGINT) AS last_so_vs_opp
    FROM starts g LEFT JOIN starts h ON h.l_suppkey = g.l_suppkey AND h.opponent = g.opponent AND h.game_date < g.game_date
    GROUP BY g.l_suppkey, g.opponent, g.l_orderkey, g.game_date""",
)
def starter_vs_opponent(spark, folder):
    teams = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("opponent"))
    lines = game_plays(spark, folder).groupBy("l_suppkey", "o_custkey", "l_orderkey", "game_date").agg(
        F.sum("l_quantity").alias("ip"), F.sum("l_linenumber").alias("so")
    )
    # An order has one customer, so the opponent is looked up for its leading row only.
    leading = top_rows(lines, ["l_orderkey"], [F.col("ip").desc(), F.col("so").desc(), F.col("l_suppkey")])
    starts = leading.join(teams, "o_custkey").select("l_suppkey", "opponent", "l_orderkey", "game_date", "ip", "so")
    # A pair has few starts a day, so they carry their history.
    starts = starts.repartition(line_parts(spark, folder), "l_suppkey", "opponent")
    out = history.known_before(
        starts, starts, keys=["l_suppkey", "opponent"], date="game_date",
        parts={"day_ip": F.sum("ip"), "day_so": F.sum("so")},
        result={
            "prior_starts_vs_opp": history.rows_seen(),
            "prior_ip_vs_opp": F.col("day_ip"),
            "prior_so_vs_opp": F.col("day_so"),
            "prior_k_per_9_vs_opp": ratio("day_so", "day_ip") * num(9),
        },
        last={"last_so_vs_opp": ("so", "l_orderkey")},
        last_date="last_date",
    )
    out = out.withColumn("days_since_last_vs_opp", history.days_since("game_date", "last_date"))
    return rounded(out.drop("last_date", "ip", "so"))


@query(
    "w10_latest_per_key",
    """SELECT o_custkey, o_orderkey, o_totalprice FROM (
      SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""",
)
def latest_per_key(spark, folder):
    orders = table(spark, folder, "orders")
    newest = history.latest(orders, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()])
    return newest.select("o_custkey", "o_orderkey", "o_totalprice")


@query(
    "w11_last_of_parent",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (
      SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS rn FROM lineitem) WHERE rn = 1""",
)
def last_of_parent(spark, folder):
    order = [F.col(c).desc() for c in ("l_linenumber", "l_partkey", "l_suppkey")]
    last = top_rows(table(spark, folder, "lineitem"), ["l_orderkey"], order)
    return last.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


_STOPS_SQL = f"""{PLAYS_SQL}, stops AS (
      SELECT c.c_nationkey AS team, p.game_date, s.s_nationkey AS location
      FROM plays p JOIN customer c ON c.c_custkey = p.o_custkey JOIN supplier s ON s.s_suppkey = p.l_suppkey)"""


@query(
    "w12_previous_location",
    f"""WITH {_STOPS_SQL}, moved AS (
      SELECT *, coalesce(lag(location) OVER w, team) AS previous_location, row_number() OVER w AS stop
      FROM stops WINDOW w AS (PARTITION BY team ORDER BY game_date, location))
    SELECT team, game_date, location, previous_location FROM moved
    QUALIFY row_number() OVER (PARTITION BY team, game_date ORDER BY stop DESC) = 1""",
)
def previous_location(spark, folder):
    teams = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("team"))
    venues = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("location"))
    stops = plays(spark, folder).join(teams, "o_custkey").join(venues, "l_suppkey")
    return history.last_location(stops, team="team", date="game_date", location="location")


@query(
    "a30_pair_summary_asof",
    f"""WITH {_PAIR_SQL}
    SELECT o_custkey, l_suppkey, count(*) AS prior_games, CAST(sum(pa_count) AS BIGINT) AS prior_weight,
           CAST(sum(hr_count) AS BIGINT) AS prior_hr, CAST(sum(so_count) AS BIGINT) AS prior_so,
           arg_max(hr_count, (game_date, l_orderkey)) AS last_hr, arg_max(so_count, (game_date, l_orderkey)) AS last_so,
           round(sum(hr_count) / sum(pa_count), 6) AS prior_hr_rate, round(sum(so_count) / sum(pa_count), 6) AS prior_so_rate,
           CAST(date_diff('day', max(game_date), DATE '1999-06-01') AS INT) AS days_since_last
    FROM pg WHERE game_date < DATE '1999-06-01' GROUP BY ALL""",
)
def pair_summary(spark, folder):
    return rounded(
        history.pair_summary_on(
            _pair_games(spark, folder).repartition(line_parts(spark, folder), "o_custkey", "l_suppkey"), F.lit("1999-06-01").cast("date"), pair=["o_custkey", "l_suppkey"], date="game_date",
            game="l_orderkey", weight="pa_count", counts={"hr": "hr_count", "so": "so_count"},
        )
    )


@query(
    "w1_form_asof_date",
    f"""WITH {GAMES_SQL}, r AS (
      SELECT *, CAST(hr_count > 0 AS INT) AS hr_game, row_number() OVER (PARTITION BY o_custkey ORDER BY game_date DESC, l_orderkey DESC) AS rn
      FROM games WHERE game_date < DATE '1999-06-01')
    SELECT c.o_custkey, round(avg(hr_game) FILTER (rn <= 5), 6) AS recent_hr_rate_g5, count(rn) FILTER (rn <= 5) AS recent_games_used_g5,
           round(avg(hr_game), 6) AS season_hr_rate_to_date, CAST(date_diff('day', max(r.game_date), DATE '1999-06-01') AS INT) AS days_since_last_game
    FROM (SELECT DISTINCT o_custkey FROM games) c LEFT JOIN r USING (o_custkey) GROUP BY ALL
    """.replace("count(rn) FILTER (rn <= 5) AS", "nullif(count(rn) FILTER (rn <= 5), 0) AS"),
)
def form_asof(spark, folder):
    base = form_games(spark, folder)
    form = history.recent_form_on(base, F.lit("1999-06-01").cast("date"), **FORM)
    return rounded(form.select("o_custkey", "recent_hr_rate_g5", "recent_games_used_g5", "season_hr_rate_to_date", "days_since_last_game"))


@query(
    "j4_lateral_top1",
    """SELECT c.c_custkey, c.c_nationkey, t.o_orderkey, t.o_totalprice FROM customer c LEFT JOIN LATERAL (
      SELECT o_orderkey, o_totalprice FROM orders o WHERE o.o_custkey = c.c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) t ON true""",
)
def lateral_top1(spark, folder):
    orders = table(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    return lookup_first(customers, orders, on=["c_custkey"], order=[F.col("o_totalprice").desc(), F.col("o_orderkey")])


@query(
    "j5_asof_latest",
    """WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
         c AS (SELECT user_id, ts, value FROM events WHERE event_type = 'click')
    SELECT p.event_id, p.user_id, p.ts, c.ts AS asof_click_ts, c.value AS asof_value
    FROM p ASOF LEFT JOIN c ON c.user_id = p.user_id AND c.ts < p.ts""",
)
def asof_latest(spark, folder):
    events = table(spark, folder, "events")
    purchases = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    clicks = events.where("event_type = 'click'").select("user_id", F.col("ts").alias("click_ts"), "value")
    return history.asof(purchases, clicks, keys=["user_id"], probe_time="ts", time="click_ts", values=["value"])


@query(
    "j6_nearest_time",
    """WITH hours AS (SELECT DISTINCT user_id, date_trunc('hour', ts) AS mark FROM events),
    best AS (SELECT h.user_id, h.mark, e.ts, e.value, e.event_id,
             row_number() OVER (PARTITION BY h.user_id, h.mark ORDER BY abs(epoch_us(e.ts) - epoch_us(h.mark)), e.ts) AS rn
      FROM hours h JOIN events e ON e.user_id = h.user_id)
    SELECT user_id, mark, ts AS nearest_ts, value AS nearest_value, event_id AS nearest_event_id FROM best WHERE rn = 1""",
)
def nearest_time(spark, folder):
    events = table(spark, folder, "events").select("user_id", "ts", "value", "event_id")
    hours = events.select("user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("mark")).distinct()
    return history.nearest(hours, events, keys=["user_id"], probe_time="mark", time="ts", values=["value", "event_id"])


@query(
    "j7_time_range_30d",
    """WITH o AS (SELECT *, CAST(o_orderdate AS DATE) AS d FROM orders)
    SELECT a.o_custkey, a.o_orderkey, a.d AS game_date, count(b.o_orderkey) AS orders_30d, round(sum(b.o_totalprice), 2) AS spend_30d
    FROM o a LEFT JOIN o b ON b.o_custkey = a.o_custkey AND b.d >= a.d - INTERVAL 30 DAY AND b.d < a.d GROUP BY ALL""",
)
def time_range(spark, folder):
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("game_date"), "o_totalprice")
    out = history.prior_days(
        orders, orders, keys=["o_custkey"], date="game_date", days=30, parts={"spend": F.sum("o_totalprice")},
        result={"orders_30d": history.rows_seen(), "spend_30d": F.round("spend", 2)},
    )
    return out.drop("o_totalprice")
