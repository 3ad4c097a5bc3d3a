"""Joins (J1-J20) and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from slatework.catalog.base import plays, query, rounded, table
from slatework.operators import joins
from slatework.operators.ordering import with_positions


def _lead_suppliers(spark, folder, name):
    """Each order's lowest supplier key, as the away side of the game."""
    return table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_suppkey").alias(name))


def _order_dates(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("game_date"), "o_totalprice", "o_orderstatus")


@query(
    "j1_fact_dimension",
    """SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, o.o_custkey, CAST(o.o_orderdate AS DATE) AS game_date
    FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey WHERE l.l_returnflag = 'R'""",
)
def fact_dimension(spark, folder):
    returned = plays(spark, folder).where("l_returnflag = 'R'")
    return returned.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "o_custkey", "game_date")


@query(
    "j2_composite_left",
    """WITH s AS (SELECT l_orderkey, l_suppkey, count(*) AS n, sum(l_quantity) AS qty FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL),
    a AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)
    SELECT a.l_orderkey, a.l_suppkey, s.n, s.qty FROM a LEFT JOIN s ON s.l_orderkey = a.l_orderkey AND s.l_suppkey = a.l_suppkey""",
)
def composite_left(spark, folder):
    lines = table(spark, folder, "lineitem")
    returned = lines.where("l_returnflag = 'R'").groupBy("l_orderkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"))
    return lines.select("l_orderkey", "l_suppkey").distinct().join(returned, ["l_orderkey", "l_suppkey"], "left")


@query(
    "j3_lookup_defaults",
    """WITH t AS (SELECT s_nationkey, s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > 5000 QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) = 1)
    SELECT c.c_custkey, c.c_nationkey AS nation, coalesce(t.s_suppkey, -1) AS s_suppkey, coalesce(t.s_acctbal, 0.0e0) AS s_acctbal FROM customer c LEFT JOIN t ON t.s_nationkey = c.c_nationkey""",
)
def lookup_defaults(spark, folder):
    suppliers = table(spark, folder, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("nation"), "s_suppkey", "s_acctbal")
    customers = table(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    return joins.lookup_first(customers, suppliers, on=["nation"], order=[F.col("s_suppkey")], defaults={"s_suppkey": -1, "s_acctbal": 0.0})


@query(
    "j8_either_order",
    """WITH g AS (SELECT o.o_orderkey, c.c_nationkey AS home, s.s_nationkey AS away, CAST(o_orderdate AS DATE) AS game_date
        FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN (SELECT l_orderkey, min(l_suppkey) AS lead FROM lineitem GROUP BY 1) m ON m.l_orderkey = o.o_orderkey JOIN supplier s ON s.s_suppkey = m.lead),
    p AS (SELECT DISTINCT a.n_name || ' @ ' || b.n_name AS label, a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey)
    SELECT p.label, count(g.o_orderkey) AS games, min(g.game_date) AS first_date FROM p LEFT JOIN g ON (g.home = p.x AND g.away = p.y) OR (g.home = p.y AND g.away = p.x) GROUP BY 1""",
)
def either_order(spark, folder):
    names = table(spark, folder, "nation").select("n_nationkey", "n_name", "n_regionkey")
    home = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("home_key"))
    away = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("venue"), F.col("s_nationkey").alias("away_key"))
    home_names = names.select(F.col("n_nationkey").alias("home_key"), F.col("n_name").alias("home"))
    away_names = names.select(F.col("n_nationkey").alias("away_key"), F.col("n_name").alias("away"))
    games = (
        _order_dates(spark, folder).join(_lead_suppliers(spark, folder, "venue"), "o_orderkey")
        .join(home, "o_custkey").join(away, "venue").join(home_names, "home_key").join(away_names, "away_key")
        .select("o_orderkey", "home", "away", "game_date")
    )
    other = names.select(F.col("n_nationkey").alias("m_nationkey"), F.col("n_name").alias("m_name"), "n_regionkey")
    pairs = names.join(other, "n_regionkey").where("n_nationkey < m_nationkey")
    picks = pairs.select(F.concat_ws(" @ ", "n_name", "m_name").alias("label"))
    joined = joins.either_order_join(picks, games, left_pair=joins.split_matchup("label"), right_pair=("home", "away"))
    return joined.groupBy("label").agg(F.count("o_orderkey").alias("games"), F.min("game_date").alias("first_date"))


@query(
    "j9_either_side",
    """WITH g AS (SELECT o.o_orderkey, c.c_nationkey AS home, s.s_nationkey AS away, CAST(o_orderdate AS DATE) AS d
        FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN (SELECT l_orderkey, min(l_suppkey) AS lead FROM lineitem GROUP BY 1) m ON m.l_orderkey = o.o_orderkey JOIN supplier s ON s.s_suppkey = m.lead),
    p AS (SELECT DISTINCT s.s_nationkey AS team, CAST(l_shipdate AS DATE) AS d FROM lineitem l JOIN supplier s ON s.s_suppkey = l.l_suppkey)
    SELECT p.team, p.d AS game_date, count(g.o_orderkey) AS games, min(g.o_orderkey) AS first_game FROM p LEFT JOIN g ON (p.team = g.home OR p.team = g.away) AND p.d = g.d GROUP BY 1, 2""",
)
def either_side(spark, folder):
    home = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("home"))
    away = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("away"))
    games = _order_dates(spark, folder).join(_lead_suppliers(spark, folder, "l_suppkey"), "o_orderkey").join(home, "o_custkey").join(away, "l_suppkey").select("o_orderkey", "home", "away", "game_date")
    picks = table(spark, folder, "lineitem").join(away, "l_suppkey").select(F.col("away").alias("team"), F.to_date("l_shipdate").alias("game_date")).distinct()
    joined = joins.either_side_join(picks, games, team="team", home="home", away="away", on=["game_date"])
    return joined.groupBy("team", "game_date").agg(F.count("o_orderkey").alias("games"), F.min("o_orderkey").alias("first_game"))


@query(
    "j10_sequence_join",
    """WITH a AS (SELECT o_orderkey AS lineup_id, o_orderstatus, CAST(o_orderdate AS DATE) AS d, row_number() OVER (PARTITION BY o_orderdate, o_orderstatus ORDER BY o_orderkey) AS seq FROM orders WHERE o_orderpriority = '1-URGENT'),
    b AS (SELECT o_orderkey AS game_id, o_orderstatus, CAST(o_orderdate AS DATE) AS d, row_number() OVER (PARTITION BY o_orderdate, o_orderstatus ORDER BY o_orderkey) AS seq FROM orders WHERE o_orderpriority <> '1-URGENT')
    SELECT a.lineup_id, a.d AS game_date, a.o_orderstatus, CAST(a.seq AS INT) AS "sequence", b.game_id FROM a LEFT JOIN b ON a.d = b.d AND a.o_orderstatus = b.o_orderstatus AND a.seq = b.seq""",
)
def sequence(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", F.to_date("o_orderdate").alias("game_date"))
    urgent = orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("lineup_id"), "o_orderstatus", "game_date")
    rest = orders.where("o_orderpriority <> '1-URGENT'").select(F.col("o_orderkey").alias("game_id"), "o_orderstatus", "game_date")
    return joins.sequence_join(urgent, rest, on=["game_date", "o_orderstatus"], left_order="lineup_id", right_order="game_id")


@query(
    "j11_priority_fallback",
    """WITH a AS (SELECT l_suppkey, l_returnflag, avg(l_discount) AS rate FROM lineitem WHERE l_linenumber = 7 AND l_quantity > 30 GROUP BY ALL),
    b AS (SELECT l_suppkey, avg(l_discount) AS rate FROM lineitem WHERE l_linenumber = 1 AND l_quantity > 35 GROUP BY 1),
    k AS (SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem)
    SELECT k.l_suppkey, k.l_returnflag, round(CASE WHEN a.l_suppkey IS NOT NULL THEN a.rate ELSE b.rate END, 9) AS rate
    FROM k LEFT JOIN a ON a.l_suppkey = k.l_suppkey AND a.l_returnflag = k.l_returnflag LEFT JOIN b ON b.l_suppkey = k.l_suppkey""",
)
def priority_fallback(spark, folder):
    lines = table(spark, folder, "lineitem")
    by_pair = lines.where("l_linenumber = 7 and l_quantity > 30").groupBy("l_suppkey", "l_returnflag").agg(F.avg("l_discount").alias("rate"))
    by_name = lines.where("l_linenumber = 1 and l_quantity > 35").groupBy("l_suppkey").agg(F.avg("l_discount").alias("rate"))
    wanted = lines.select("l_suppkey", "l_returnflag").distinct()
    return rounded(joins.priority_join(wanted, by_pair, by_name, on=["l_suppkey", "l_returnflag"], fallback_on=["l_suppkey"], values=["rate"]), 9)


@query(
    "j12_cascading_keys",
    """WITH c AS (SELECT c_custkey, c_nationkey AS team, c_name AS k1, right(c_name, 3) AS k2, right(c_name, 1) AS k3 FROM customer),
    s AS (SELECT s_suppkey, s_nationkey AS team, 'Customer#' || substr(s_name, 10) AS k1, reverse(right(s_name, 3)) AS k2, right(s_name, 1) AS k3, s_acctbal FROM supplier),
    a AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY team, k1 ORDER BY s_suppkey) = 1),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY team, k2 ORDER BY s_suppkey) = 1),
    d AS (SELECT * FROM s QUALIFY count(*) OVER (PARTITION BY team, k3) = 1)
    SELECT c.c_custkey, coalesce(a.s_suppkey, b.s_suppkey, d.s_suppkey) AS s_suppkey, coalesce(a.s_acctbal, b.s_acctbal, d.s_acctbal) AS s_acctbal
    FROM c LEFT JOIN a ON a.team = c.team AND a.k1 = c.k1 LEFT JOIN b ON b.team = c.team AND b.k2 = c.k2 LEFT JOIN d ON d.team = c.team AND d.k3 = c.k3""",
)
def cascading_keys(spark, folder):
    customers = table(spark, folder, "customer").select(
        "c_custkey", F.col("c_nationkey").alias("team"), F.col("c_name").alias("k1"),
        F.right("c_name", F.lit(3)).alias("k2"), F.right("c_name", F.lit(1)).alias("k3"),
    )
    suppliers = table(spark, folder, "supplier").select(
        "s_suppkey", F.col("s_nationkey").alias("team"), F.concat(F.lit("Customer#"), F.substr("s_name", F.lit(10))).alias("k1"),
        F.reverse(F.right("s_name", F.lit(3))).alias("k2"), F.right("s_name", F.lit(1)).alias("k3"), "s_acctbal",
    )
    out = joins.cascade_join(
        customers, suppliers, group=["team"], keys=[("k1", False), ("k2", False), ("k3", True)], order=[F.col("s_suppkey")], values=["s_suppkey", "s_acctbal"]
    )
    return out.select("c_custkey", "s_suppkey", "s_acctbal")


@query("j13_semi", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def semi(spark, folder):
    returned = table(spark, folder, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, folder, "orders").join(returned, "o_orderkey", "left_semi").select("o_orderkey", "o_custkey")


@query("j14_anti_count", "SELECT count(*) AS unmatched FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber > 4)")
def anti_count(spark, folder):
    late = table(spark, folder, "lineitem").where("l_linenumber > 4").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.unmatched_count(table(spark, folder, "orders"), late, ["o_orderkey"])


@query(
    "j15_contains_join",
    r"""WITH b AS (SELECT DISTINCT unnest(list_filter(string_split(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda w: w <> '')) AS word FROM benchmark),
    d AS (SELECT doc_id, source, unnest(list_distinct(list_filter(string_split(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda w: w <> ''))) AS word FROM documents)
    SELECT word, count(*) AS documents, string_agg(DISTINCT source, '|' ORDER BY source) AS sources FROM d JOIN b USING (word) GROUP BY word""",
)
def contains_join(spark, folder):
    listed = table(spark, folder, "benchmark").select(F.explode(joins.words("text")).alias("word")).distinct()
    texts = table(spark, folder, "documents").select("doc_id", "source", "text")
    found = joins.mentions(texts, listed, text="text", name="word")
    per_source = found.groupBy("word", "source").agg(F.count(F.lit(1)).alias("n"))
    return per_source.groupBy("word").agg(F.sum("n").alias("documents"), F.array_join(F.sort_array(F.collect_list("source")), "|").alias("sources"))


@query(
    "j16_distinct_overlap",
    """SELECT count(DISTINCT k) FILTER (side = 1) AS left_distinct, count(DISTINCT k) FILTER (side = 2) AS right_distinct,
      (SELECT count(*) FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)) AS shared
    FROM (SELECT c_nationkey AS k, 1 AS side FROM customer UNION ALL SELECT s_nationkey, 2 FROM supplier)""",
)
def distinct_overlap(spark, folder):
    return joins.distinct_overlap(
        table(spark, folder, "customer").select(F.col("c_nationkey").alias("nation")), table(spark, folder, "supplier").select(F.col("s_nationkey").alias("nation")), "nation"
    )


@query(
    "j17_label_merge",
    """WITH r AS (SELECT l_orderkey, lower(trim(l_returnflag)) AS k, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL),
    p AS (SELECT DISTINCT l_orderkey, '  ' || l_returnflag || ' ' AS name FROM lineitem)
    SELECT p.l_orderkey, p.name, r.n, CAST(coalesce(r.n, 0) > 0 AS INT) AS label FROM p LEFT JOIN r ON r.l_orderkey = p.l_orderkey AND r.k = lower(trim(p.name))""",
)
def label_merge(spark, folder):
    lines = table(spark, folder, "lineitem")
    results = lines.where("l_linestatus = 'F'").groupBy("l_orderkey", F.lower(F.trim("l_returnflag")).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    picks = lines.select("l_orderkey", F.concat(F.lit("  "), "l_returnflag", F.lit(" ")).alias("name")).distinct()
    joined = picks.withColumn("k", F.lower(F.trim("name"))).join(results, ["l_orderkey", "k"], "left")
    return joined.select("l_orderkey", "name", "n", (F.coalesce("n", F.lit(0)) > 0).cast("int").alias("label"))


@query(
    "j19_union_fallback",
    """SELECT c_nationkey AS nation, c_name AS name, c_acctbal AS balance, 'published' AS origin FROM customer UNION ALL
    SELECT s_nationkey, s_name, s_acctbal, 'counted' FROM supplier""",
)
def union_fallback(spark, folder):
    published = table(spark, folder, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.lit("published").alias("origin"))
    counted = table(spark, folder, "supplier").select(F.lit("counted").alias("origin"), F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return published.unionByName(counted)


@query(
    "j20_side_unpivot",
    """WITH g AS (SELECT o.o_orderkey, c.c_nationkey AS home, s.s_nationkey AS away FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
      JOIN (SELECT l_orderkey, min(l_suppkey) AS lead FROM lineitem GROUP BY 1) m ON m.l_orderkey = o.o_orderkey JOIN supplier s ON s.s_suppkey = m.lead)
    SELECT o_orderkey, home AS team, away AS opponent, true AS is_home FROM g UNION ALL SELECT o_orderkey, away, home, false FROM g""",
)
def side_unpivot(spark, folder):
    home = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("home"))
    away = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("lead"), F.col("s_nationkey").alias("away"))
    games = table(spark, folder, "orders").join(home, "o_custkey").join(_lead_suppliers(spark, folder, "lead"), "o_orderkey").join(away, "lead")
    games = games.select("o_orderkey", "home", "away")
    return joins.sides(games, home="home", away="away").select("o_orderkey", "team", "opponent", "is_home")


@query(
    "o1_custom_order",
    """SELECT o_orderkey, o_orderpriority, o_totalprice, row_number() OVER (ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 3 END, o_totalprice DESC, o_orderkey) - 1 AS place FROM orders""",
)
def custom_order(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    urgency = F.when(F.col("o_orderpriority") == "1-URGENT", 1).when(F.col("o_orderpriority") == "2-HIGH", 2).otherwise(3)
    return with_positions(orders, [], [urgency, F.col("o_totalprice").desc(), F.col("o_orderkey")], position="place", using=["o_orderpriority", "o_totalprice", "o_orderkey"]).drop("group_rows")


@query("o2_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def page(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return orders.orderBy(F.col("o_totalprice").desc(), "o_orderkey").offset(50).limit(25)


@query("o3_top_groups", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS spend FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_groups(spark, folder):
    grouped = table(spark, folder, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("spend"))
    return grouped.orderBy(F.col("n").desc(), "o_custkey").limit(10)


@query("o4_union", "SELECT l_orderkey AS game, l_suppkey AS player, 'away' AS side FROM lineitem UNION ALL SELECT o_orderkey, o_custkey, 'home' FROM orders")
def union_rows(spark, folder):
    away = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("game"), F.col("l_suppkey").alias("player"), F.lit("away").alias("side"))
    home = table(spark, folder, "orders").select(F.col("o_orderkey").alias("game"), F.col("o_custkey").alias("player"), F.lit("home").alias("side"))
    return away.unionByName(home)


@query(
    "o5_keep_last",
    """SELECT o_custkey, CAST(o_orderdate AS DATE) AS game_date, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey DESC) = 1""",
)
def keep_last(spark, folder):
    from slatework.operators.ordering import top_rows

    orders = table(spark, folder, "orders").select("o_custkey", F.to_date("o_orderdate").alias("game_date"), "o_orderkey")
    return top_rows(orders, ["o_custkey", "game_date"], [F.col("o_orderkey").desc()])


@query("o6_intersection", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def intersection(spark, folder):
    orders = table(spark, folder, "orders")
    done, pending = (orders.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k")) for s in ("F", "P"))
    return done.intersect(pending)


@query(
    "o6_team_overlap",
    """WITH a AS (SELECT o_custkey, list(DISTINCT o_orderstatus) AS x FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1), b AS (SELECT o_custkey, list(DISTINCT o_orderstatus) AS y FROM orders WHERE o_orderpriority = '5-LOW' GROUP BY 1)
    SELECT o_custkey, list_has_any(x, y) AS overlaps FROM a JOIN b USING (o_custkey)""",
)
def team_overlap(spark, folder):
    orders = table(spark, folder, "orders")

    def seen(priority, name):
        chosen = orders.where(F.col("o_orderpriority") == priority).select("o_custkey", "o_orderstatus").distinct()
        return chosen.groupBy("o_custkey").agg(F.collect_list("o_orderstatus").alias(name))

    return seen("1-URGENT", "x").join(seen("5-LOW", "y"), "o_custkey").select("o_custkey", F.arrays_overlap("x", "y").alias("overlaps"))


@query("o7_difference", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 400000")
def difference(spark, folder):
    large = table(spark, folder, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("k"))
    return table(spark, folder, "customer").select(F.col("c_custkey").alias("k")).join(large, "k", "left_anti").distinct()
