import random

import pytest
from pyspark.sql import functions as F

from slatework.operators import registry, similarity


def token_sorted(a, b):
    a, b = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    if not a and not b:
        return 100.0
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return 200.0 * table[-1][-1] / (len(a) + len(b))


def some_names(seed, n):
    random.seed(seed)
    first = ["jose", "juan", "aaron", "jon", "john", "jo", "al"]
    last = ["ramirez", "ramires", "judge", "soto", "sotto", "rodriguez lopez", "li"]
    out = []
    for _ in range(n):
        name = f"{random.choice(first)} {random.choice(last)}"
        for _ in range(random.choice([0, 0, 1, 2])):
            at = random.randrange(len(name))
            name = name[:at] + random.choice(["", "x", name[at] * 2]) + name[at + 1:]
        out.append(" ".join(name.split()) or "q")
    return sorted(set(out))


@pytest.mark.parametrize("threshold", [80.0, 85.0, 93.0, 96.0])
def test_similar_pairs_miss_nothing(spark, threshold):
    left, right = some_names(1, 60), some_names(2, 60)
    a = spark.createDataFrame([(n,) for n in left], "l string")
    b = spark.createDataFrame([(n,) for n in right], "r string")
    got = {(r["l"], r["r"]): r["similarity"] for r in similarity.similar_pairs(a, b, left_text="l", right_text="r", threshold=threshold).collect()}
    want = {(x, y): token_sorted(x, y) for x in left for y in right if token_sorted(x, y) >= threshold - 1e-9}
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_fuzzy_join(spark):
    left = spark.createDataFrame([("jose ramirez",), ("jose ramires",), ("zzz",)], "w string")
    right = spark.createDataFrame([("jose ramirez", 1), ("jose ramirez", 2), ("jose ramirezz", 3)], "k string, i long")
    out = {r["w"]: (r["k"], r["i"], r["similarity"]) for r in similarity.fuzzy_join(left, right, left_key="w", right_key="k", right_order="i").collect()}
    assert out["jose ramirez"] == ("jose ramirez", 2, 100.0)
    assert out["jose ramires"][:2] == ("jose ramirez", 1) and out["jose ramires"][2] == pytest.approx(token_sorted("jose ramires", "jose ramirez"))
    assert out["zzz"] == (None, None, None)


REGISTRY = [
    ("Aaron Judge", ["A. J. Judge"], "Judge", "Aaron", "A"),
    ("Jose Ramirez", [], "Ramirez", "Jose", "J"),
    ("Harold Ramirez", [], "Ramirez", "Harold", "H"),
    ("Jorge Ramirez", [], "Ramirez", "Jorge", "J"),
    ("Maximiliano Fernandez", [], "Fernandez", "Maximiliano", "M"),
    ("Manuel Fernandez", [], "Fernandez", "Manuel", "M"),
    ("Will Smith", ["Billy Smith"], "Smith", "Will", "W"),
    ("Wade Smith", ["Billy Smith"], "Smith", "Wade", "W"),
]


def people(spark):
    return spark.createDataFrame(REGISTRY, "canonical_name string, aliases array<string>, last_name string, first_name string, first_initial string")


def test_resolution_ladder(spark):
    raw = ["Judge, Aaron", "A.J. Judge", "J. Judge", "Harold Ramirez Jr.", "H Ramirez", "J. Ramirez", "Maximilianoo Fernandez", "M Fernandez", "Billy Smith", "Nobody Here", " "]
    out = {r["n"]: r for r in registry.resolve_names(spark.createDataFrame([(n,) for n in raw], "n string"), people(spark), raw="n").collect()}
    kinds = {n: (r["match_type"], r["canonical_name"] if r["matched"] else None) for n, r in out.items()}
    assert kinds == {
        "Judge, Aaron": ("exact_canonical", "Aaron Judge"),
        "A.J. Judge": ("exact_alias", "Aaron Judge"),
        "J. Judge": ("unique_last_name", "Aaron Judge"),
        "Harold Ramirez Jr.": ("exact_canonical", "Harold Ramirez"),
        "H Ramirez": ("first_initial_last", "Harold Ramirez"),
        "J. Ramirez": ("ambiguous_last_name", None),
        "Maximilianoo Fernandez": ("fuzzy_same_last_name", "Maximiliano Fernandez"),
        "M Fernandez": ("ambiguous_last_name", None),
        "Billy Smith": ("exact_alias", "Wade Smith"),
        "Nobody Here": ("unresolved", None),
        " ": ("empty", None),
    }
    assert out["J. Ramirez"]["ambiguous"] and out["J. Ramirez"]["candidate_count"] == 3


def test_name_map_skips_shared_surnames(spark):
    keys = {r["key"]: r["canonical_name"] for r in registry.name_map(people(spark)).collect()}
    assert keys["last_judge"] == "Aaron Judge" and "last_smith" not in keys and "last_ramirez" not in keys
    assert keys["billy smith"] == "Wade Smith"


def test_apply_aliases(spark):
    rows = [
        ("Aaron Judge", "Aaron J. Judge", "approved", "team_match"),
        ("Aaron Judge", "AARON J JUDGE", "approved", "team_match"),
        ("Aaron Judge", "a j judge", "auto_matched", "team_match"),
        ("Jose Ramirez", "J Ram", "auto_matched", "team_mismatch"),
        ("Will Smith", "W Smith", "pending", "team_match"),
        ("New Guy", "New Guy", "approved", "no_player_team"),
    ]
    audit = spark.createDataFrame(rows, "canonical_name string, alias_to_apply string, review_status string, team_validation string")
    out = {r["canonical_name"]: list(r["aliases"]) for r in registry.apply_aliases(people(spark), audit).collect()}
    assert out["Aaron Judge"] == ["A. J. Judge", "AARON J JUDGE"]
    assert out["Jose Ramirez"] == [] and out["Will Smith"] == ["Billy Smith"]
    assert out["New Guy"] == ["New Guy"] and len(out) == len(REGISTRY) + 1


def test_team_labels(spark):
    frame = spark.createDataFrame([("NYY", "BOS|NYY", None, "TB"), ("NYY", "BOS", "BOS", None), (None, "BOS", None, "BOS|TB"), ("NYY", None, "NYY", None)], "t string, o string, r string, x string")
    out = frame.select(
        registry.team_validation(F.lit("play_by_play_plays"), "t", "o").alias("v"), registry.historical_team_validation("o", "r", "x").alias("h"), registry.slate_team_validation(F.lit("NYY"), "t", "r", "x").alias("s")
    ).collect()
    assert [r["v"] for r in out] == ["team_match", "team_mismatch", "no_player_team", "no_observed_team"]
    assert [r["h"] for r in out] == ["official_history_mismatch", "official_roster_match", "official_transaction_match", "no_observed_team"]
    assert [r["s"] for r in out] == ["current_team_match", "current_team_match", "unknown", "current_team_match"]


def test_transaction_teams(spark):
    lines = spark.createDataFrame([("Yankees placed OF Aaron Judge on the IL", "NYY"), ("Rays signed Aaron Judge", "TB"), ("Rays signed Aaron Judgement", "TB2")], "text string, team string")
    out = registry.transaction_teams(lines, people(spark), text="text", team="team").collect()
    assert [(r["canonical_name"], r["transaction_teams"]) for r in out] == [("Aaron Judge", "NYY|TB")]


def test_transaction_names_of_any_length(spark):
    lines = spark.createDataFrame([("Mets traded Juan Carlos De La Cruz to the Rays", "NYM")], "text string, team string")
    long = spark.createDataFrame([("Juan Carlos De La Cruz",)], "canonical_name string")
    out = registry.transaction_teams(lines, long, text="text", team="team").collect()
    assert [(r["canonical_name"], r["transaction_teams"]) for r in out] == [("Juan Carlos De La Cruz", "NYM")]


def test_factor_fallback(spark):
    rows = spark.createDataFrame([("COL",), ("XXX",)], "team string")
    small = spark.createDataFrame([("COL", 9.9)], "team string, f double")

    def factors(**options):
        return {r["team"]: r["park_factor"] for r in registry.factor_or_default(rows, small, key="team", factor="f", **options).collect()}

    assert factors(constants={"COL": 1.35}, use_table=False) == {"COL": 1.35, "XXX": 1.0}
    assert factors(constants={}) == {"COL": 9.9, "XXX": 1.0}
    assert factors(constants={"COL": 1.35, "XXX": 1.1}) == {"COL": 9.9, "XXX": 1.1}
