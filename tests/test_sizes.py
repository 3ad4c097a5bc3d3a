"""Steps that must not grow faster than their input."""

import random
import time
from collections import Counter
from datetime import date

from pyspark.sql import functions as F

from slatework import session
from slatework.catalog import base, bundle_queries, domain, history_queries
from slatework.functions import text
from slatework.operators import aggregates, history, joins, registry, similarity, stints
from slatework.plans import models, picks

DAY = date(2024, 6, 1)


def test_a_pick_meets_one_game_however_many_its_team_plays(spark):
    games = spark.range(300).select((F.col("id") + 5).alias("game_id"), F.lit(DAY).alias("analysis_date"), F.lit("A").alias("home_team"), F.lit("B").alias("away_team"))
    asked = spark.range(200).select(F.col("id").alias("pick_id"), F.lit(DAY).alias("analysis_date"), F.lit("B").alias("team"), F.lit("Ann").alias("player_name"), F.lit("B @ A").alias("text"))
    first = [F.col("game_id")]
    sided = joins.either_side_join(asked, games, team="team", home="home_team", away="away_team", on=["analysis_date"], first=first)
    paired = joins.either_order_join(asked, games, left_pair=joins.split_matchup("text"), right_pair=("home_team", "away_team"), on=["analysis_date"], first=first)
    for out in (sided, paired):
        assert [tuple(r) for r in out.groupBy("game_id").count().collect()] == [(5, 200)]


def test_picks_take_the_first_game_of_their_date(spark):
    games = spark.createDataFrame([(7, DAY, "A", "B"), (4, DAY, "B", "A"), (2, date(2024, 6, 2), "A", "B"), (9, DAY, "C", "C")], "game_id int, game_date date, home_team string, away_team string")
    asked = spark.createDataFrame([(1, DAY, "A", "Ann"), (2, DAY, "C", "Bob"), (3, DAY, "X", "Ann"), (4, DAY, None, "Ann")], "pick_id int, analysis_date date, team string, player_name string")
    plays = spark.createDataFrame([(4, "ann", "Home Run"), (7, "ann", "Out")], "game_id int, batter string, play_result string")
    box = spark.createDataFrame([(4, "B", "Zed", 3.0, 1, 0, 2, 1, 0)], "game_id int, team string, player_name string, innings_pitched double, earned_runs int, home_runs int, strikeouts int, hits int, walks int")
    rows = {r["pick_id"]: (r["game_id"], r["label"], r["leading_pitcher"]) for r in picks.label_picks(asked, games, plays, box).collect()}
    assert rows == {1: (4, 1, "Zed"), 2: (9, 0, None), 3: (None, 0, None), 4: (None, 0, None)}


def test_plain_names_of_a_lineup_are_not_parsed(spark):
    documents = ['{"batting_order": ["A {B", "{\\"name\\": \\"X\\"}", {"name": null, "player": "P"}, "Q", 3, null]}', None]
    out = spark.createDataFrame([(d,) for d in documents], "v string").select(text.batting_order("v").alias("o"))
    assert [[e["name"] for e in r["o"]] for r in out.collect()] == [["A {B", "X", "P", "Q", "3"], []]
    assert "contains(" in out._jdf.queryExecution().analyzed().toString().lower()


def test_history_of_asked_rows_reads_them_once(spark):
    seen = spark.createDataFrame([("a", date(2024, 5, 30), 2), ("a", DAY, 9), (None, date(2024, 5, 1), 5)], "k string, d date, n int")
    rows = [("a", DAY, "x"), ("a", DAY, "y"), ("b", DAY, "x"), (None, DAY, "z")]
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    asked = spark.createDataFrame(rows, "k string, d date, t string").mapInArrow(counted, "k string, d date, t string")
    out = history.known_before(asked, seen, keys=["k"], date="d", parts={"s": F.sum("n")}, result={"total": F.col("s")})
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted(((*r, {"a": 2, "b": None, None: 5}[r[0]]) for r in rows), key=str)
    assert reads.value == len(rows)


def test_top_two_reads_the_profile_once(spark):
    profile = spark.createDataFrame([("a", "SL", 3.0, 1.0), ("a", "CU", 5.0, 0.0), ("a", "SI", 3.0, None), ("b", "SI", None, 1.0)], "e string, k string, u double, m double")
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    out = aggregates.top_two(profile.mapInArrow(counted, profile.schema), entity=["e"], kind="k", usage="u", metrics=["m"], few_kinds=True).collect()
    assert [(r["e"], r["primary_k"], r["secondary_k"], r["secondary_u"]) for r in out] == [("a", "CU", "SI", 3.0)]
    assert reads.value == 4


def test_fits_of_several_stacks_share_one_pool(spark, monkeypatch):
    days = F.date_add(F.lit(DAY), (F.col("id") % 20).cast("int"))
    rows = spark.range(200).select("id", days.alias("d"), (F.col("id") % 7).alias("a"), (F.col("id") % 5).alias("b"), (F.col("id") % 3 % 2).cast("int").alias("y"))
    pools, plain = [], models.together

    def counted(jobs, parallel):
        jobs = list(jobs)
        pools.append(len(jobs))
        return plain(jobs, parallel)

    monkeypatch.setattr(models, "together", counted)
    settings = models.Settings(depth=1, rounds=1, trees=1, folds=1)
    out = models.ablation(rows, scenarios={"both": ["a", "b"], "one": ["a"]}, label="y", date="d", key=["id"], settings=settings)
    assert {(r["scenario"], r["features"], r["rows"]) for r in out.collect()} == {("both", 2, 40), ("one", 1, 40)}
    # Per stack: a fold and the final models, two kinds each.
    assert max(pools) == 8


def test_game_spines_are_grouped_in_parts_of_bounded_size(spark, monkeypatch):
    folder = "/root/testdata/sf0.001"
    whole = sorted(history_queries.spine(spark, folder).collect())
    lines = base.table(spark, folder, "lineitem").count()
    monkeypatch.setattr(base, "LINES_PER_TASK", 500)
    dealt = history_queries.spine(spark, folder)
    assert sorted(dealt.collect()) == whole
    assert dealt.rdd.getNumPartitions() == -(-lines // 500)


def test_dealt_pairs_carry_their_history(spark):
    rows = [("a", "p", date(2024, 5, 1 + g // 2), g, g % 3 + 1, g % 2) for g in range(12)] + [("a", None, DAY, 20, 2, 1), ("a", None, date(2024, 5, 1), 21, 4, 0), (None, "p", None, 22, 1, 1)]
    games = spark.createDataFrame(rows, "b string, p string, d date, g int, w int, h int")
    options = dict(pair=["b", "p"], date="d", game="g", weight="w", counts={"h": "h"})
    for same_day in (False, True):
        plain = history.pair_history(games, games, same_day=same_day, **options)
        dealt = history.pair_history(games, games, same_day=same_day, dealt=5, **options)
        assert dealt.columns == plain.columns
        assert sorted(map(str, dealt.collect())) == sorted(map(str, plain.collect()))
        assert dealt.rdd.getNumPartitions() == 5
        assert "Join" not in dealt._jdf.queryExecution().optimizedPlan().toString()


def test_pair_queries_end_in_parts_of_bounded_size(spark, monkeypatch):
    folder = "/root/testdata/sf0.001"
    monkeypatch.setattr(base, "LINES_PER_TASK", 900)
    for run in (history_queries.pair_summary, history_queries.starter_vs_opponent):
        assert run(spark, folder).rdd.getNumPartitions() == base.line_parts(spark, folder) > 5


def test_the_hitter_spine_is_built_in_parts_of_bounded_size(spark, monkeypatch):
    from slatework.plans import hitters

    folder = "/root/testdata/sf0.001"
    whole = sorted(map(str, bundle_queries.spine(spark, folder).collect()))
    monkeypatch.setattr(base, "LINES_PER_TASK", 500)
    parts = base.line_parts(spark, folder)
    for sources in (domain.hitter_sources(spark, folder), domain.prepared_sources(spark, folder)):
        dealt = hitters.load_spine(sources)
        assert sorted(map(str, dealt.collect())) == whole
        assert dealt.rdd.getNumPartitions() == parts > 10


def test_names_of_all_sources_are_held_once(spark, monkeypatch):
    plans, plain = [], registry.settle
    monkeypatch.setattr(registry, "settle", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or plain(df))
    sources = [(spark.createDataFrame([(n,), (None,), ("Ann Lee",)], "x string"), "x") for n in ("Ann Lee", "Bob Ray", "Cy Day")]
    people = spark.createDataFrame([("Ann Lee", 1), ("Bob Ray", 2)], "full_name string, person_id int")
    out = registry.canonical_names(sources, registry.seed_registry(people, name="full_name", person_id="person_id"))
    assert sorted(map(tuple, out.collect())) == [("Ann Lee", "Ann Lee"), ("Bob Ray", "Bob Ray"), ("Cy Day", "cy day")]
    assert plans[0].count("Aggregate") == 1


def test_lineup_documents_are_read_before_rows_are_put_in_order(spark, monkeypatch):
    from slatework.plans import starters

    written, plain = [], starters.settle
    monkeypatch.setattr(starters, "settle", lambda df: written.append(df.columns) or plain(df))
    out = bundle_queries.starter_spine(spark, "/root/testdata/sf0.001")
    assert len(written) == 1 and not {"home_lineup", "away_lineup"} & set(written[0])
    assert {tuple(r) for r in out.select("is_home", "opponent_lineup_size").distinct().collect()} == {(True, 1), (False, 3)}
    assert "get_json_object" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_names_and_texts_are_written_before_they_are_read(spark, monkeypatch):
    plans, plain = [], registry.settle
    monkeypatch.setattr(registry, "settle", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or plain(df))
    people = spark.createDataFrame([("Ann Lee", 1, "X"), ("Bob Ray", 2, "Y")], "full_name string, person_id int, team string")
    known = registry.seed_registry(people, name="full_name", person_id="person_id")
    texts = spark.createDataFrame([("Team signed Ann Lee today", "X", DAY), ("Team signed Ann Lee today", "Y", date(2024, 6, 2)), ("Nobody", "X", DAY), ("Bob Ray", None, DAY)], "text string, team string, d date")
    moves = registry.transaction_moves(texts, known, text="text", team="team", date="d")
    assert sorted(map(tuple, moves.collect())) == [("Ann Lee", "X", DAY), ("Ann Lee", "Y", date(2024, 6, 2))]
    audit = registry.audit_source(people.unionByName(people), known, people, source="players", raw="full_name", person="full_name", team="team")
    assert sorted(r["canonical_name"] for r in audit.collect()) == ["Ann Lee", "Bob Ray"]
    assert len(plans) == 2 and not any("regexp" in p or "translate" in p for p in plans)


def test_known_teams_carry_their_key(spark):
    days = spark.createDataFrame([("K", "Ann", DAY), ("K", "Ann", date(2024, 7, 3)), ("L", "Ann", DAY), ("M", None, DAY), ("N", "Bob", None)], "raw string, person string, d date")
    held = spark.createDataFrame([("Ann", "T", DAY, date(2024, 6, 20)), ("Ann", "U", date(2024, 7, 1), None), ("Bob", "V", DAY, None)], "person string, team string, starts date, ends date")
    out = stints.known_teams(days, held, key="raw", person="person", team="team", date="d", name="teams")
    assert sorted(map(tuple, out.collect())) == [("K", "T|U"), ("L", "T")]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_medians_of_all_folds_are_found_in_one_pass(spark, monkeypatch):
    rows = [(i % 4, float(i * 7 % 11), None if i % 3 else float(-i)) for i in range(23)] + [(0, float("nan"), None), (9, 1.5, None)]
    df = spark.createDataFrame(rows, "fold int, a double, b double")
    sets = {k: F.col("fold") < k for k in range(5)} | {"all": F.lit(True), "odd": F.col("fold") == 9}
    passes, plain = [], models.running_totals
    monkeypatch.setattr(models, "running_totals", lambda *args: passes.append(1) or plain(*args))
    got = models.medians_of_sets(df, ["a", "b"], sets)
    assert len(passes) == 1
    assert got == {name: models.exact_medians(df.where(chosen), ["a", "b"]) for name, chosen in sets.items()}
    del passes[:]
    tables = spark.range(120).select("id", F.date_add(F.lit(DAY), (F.col("id") % 20).cast("int")).alias("d"), (F.col("id") % 7).alias("a"), (F.col("id") % 3 % 2).cast("int").alias("y"))
    settings = models.Settings(depth=1, trees=1)
    models.cross_validate(tables, features=["a"], label="y", key=["id"], folds=3, settings=settings)
    models.prepare(tables, features=["a"], label="y", date="d", key=["id"], settings=settings)
    assert len(passes) == 2


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").split(" ")
    return {f.rsplit("/", 1)[-1] for f in files if "shuffle_" in f}


def test_a_written_step_leaves_no_shuffle_files(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    for write in (session.settle, session.stored):
        before, setting = shuffle_files(spark), spark.conf.get(name)
        out = write(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
        # Files are removed in the background.
        for _ in range(100):
            left = shuffle_files(spark) - before
            if not left:
                break
            time.sleep(0.1)
        assert not left and spark.conf.get(name) == setting
        assert sorted(map(tuple, out.collect())) == [(k, 143 if k < 6 else 142) for k in range(7)]


def test_hitter_rows_meet_their_features_by_one_key(spark):
    """Nothing of a feature group is left to do once rows are wide."""
    plan = bundle_queries.hitter_features(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 4 and "Window" not in plan and "Aggregate" not in plan


def test_starter_rows_meet_their_features_by_one_key(spark):
    plan = bundle_queries.starter_features(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 4 and "Window" not in plan and "Aggregate" not in plan


def test_similar_names_meet_in_blocks_and_leave_one_pair_each(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcd ") for _ in range(n))
    keys = sorted({word(rng.choice([4, 9, 14, 17, 30, 40, 70])) for _ in range(150)})
    wanted = {k[:-1] + "é" for k in keys[::2]} | {word(9) for _ in range(40)} | {"", "  "}
    people = [(k, (i * 37) % 60 if i % 11 else None) for i, k in enumerate(keys)] + [(keys[3], 200)]
    left, right = spark.createDataFrame([(w,) for w in [*wanted, None]], "w string"), spark.createDataFrame(people, "k string, p int")
    monkeypatch.setattr(similarity, "LEFT_BLOCK", 40)
    monkeypatch.setattr(similarity, "RIGHT_BLOCK", 30)
    options = dict(left_text="w", right_text="k", threshold=75.0)
    found = similarity.best_pairs(left, right, right_order="p", **options).collect()
    every = similarity.similar_pairs(left, right, **options).collect()
    lowest = lambda k: (min((p for t, p in people if t == k and p is not None), default=0) if (k, None) not in people else -1, k)
    best = lambda rows: {w: min(((-r["similarity"], *lowest(r["k"])) for r in rows if r["w"] == w)) for w in {r["w"] for r in rows}}
    assert best(found) == best(every) and len(best(found)) > 30
    assert len(found) < len(every) and max(Counter(r["w"] for r in found).values()) <= -(-len(keys) // 30)
