import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from slatework.functions import codes, names, text

VECTORS = {
    "Aaron Judge": "aaron judge",
    "Judge, Aaron": "aaron judge",
    "José Ramírez": "jose ramirez",
    "Juan Soto Jr.": "juan soto",
    "Randy Johnson Sr.": "randy johnson",
    "Soto Jr., Juan": "juan soto",
    "Soto, Juan Jr.": "juan soto",
    "  J.D.   Martinez ": "j d martinez",
    "Ken Griffey III": "ken griffey",
    "Søren ﬁn ½": "sren fin 12",
    "": "",
    None: "",
}


def one(spark, value, column):
    frame = spark.createDataFrame([(value,)], "v string")
    return frame.select(column.alias("r")).first()["r"]


def test_name_vectors(spark):
    rows = spark.createDataFrame([(k,) for k in VECTORS], "v string").select("v", names.normalize_name("v").alias("n")).collect()
    assert {r["v"]: r["n"] for r in rows} == VECTORS


def test_folding_equals_compatibility_decomposition(spark):
    random.seed(3)
    points = [chr(p) for p in range(0x80, 0x3000) if not unicodedata.category(chr(p)).startswith("C")] + list("ﬀﬁﬂ①½㎏ＡＢ𝐀𝟙é́")
    texts = ["".join(random.choices(points + list("abc XYZ,."), k=12)) for _ in range(800)] + points
    rows = spark.createDataFrame([(t,) for t in texts], "v string").select("v", names.ascii_fold("v").alias("f")).collect()
    for row in rows:
        assert row["f"] == unicodedata.normalize("NFKD", row["v"]).encode("ascii", "ignore").decode(), ascii(row["v"])


@pytest.mark.parametrize(
    "raw,expected",
    [
        ("Aaron Judge homered to left", "Aaron Judge"),
        ("Aaron Judge Struck out swinging", "Aaron Judge"),
        ("Bobby Witt", "Bobby Witt"),
        ("Hunter Walker", "Hunter Walker"),
    ],
)
def test_strip_action(spark, raw, expected):
    assert one(spark, raw, names.strip_action("v")) == expected


@pytest.mark.parametrize(
    "raw,expected",
    [
        ("Gerrit Cole pitches to Rafael Devers", "Rafael Devers"),
        ("Rafael Devers (3B) fouled off", "Rafael Devers"),
        (" - Rafael Devers: ", "Rafael Devers"),
        (None, ""),
    ],
)
def test_clean_source_name(spark, raw, expected):
    assert one(spark, raw, names.clean_source_name("v")) == expected


def test_keys(spark):
    assert one(spark, "Juan Pablo Soto", names.last_first("v")) == "Soto, Juan Pablo"
    assert one(spark, "Cher", names.last_first("v")) == "Cher"
    assert one(spark, "Soto, Juan", names.first_last("v")) == "Juan Soto"
    assert one(spark, "Soto,", names.first_last("v")) == "Soto,"
    assert one(spark, "Juan Soto", names.initial_key("v")) == "j soto"
    assert one(spark, "Ronald Acuna Jr.", names.surname_key("v")) == "acuna"
    assert one(spark, None, names.surname_key("v")) == ""


def test_codes(spark):
    assert one(spark, " chw ", codes.team_code("v")) == "CWS"
    assert one(spark, "NYY", codes.team_code("v")) == "NYY"
    assert one(spark, "Four-Seam FB", codes.pitch_type("v")) == "FF"
    assert one(spark, "knuckleball", codes.pitch_type("v")) == "KN"


def test_handedness_switch_and_unknown(spark):
    rows = spark.createDataFrame([("S", None), ("R", "R"), ("L", "R"), ("R", None), (None, "L")], "b string, t string")
    out = rows.select(*[c.alias(n) for n, c in codes.handedness("b", "t").items()]).collect()
    assert [r["same_hand_matchup"] for r in out] == [0.0, 1.0, 0.0, None, None]
    assert [r["platoon_advantage"] for r in out] == [1.0, 0.0, 1.0, None, None]


def test_batting_order_mixed_entries(spark):
    lineup = '{"confirmed": true, "batting_order": ["A B", {"name": ""}, {"fullName": " C D "}, null, {"player": "E F"}]}'
    assert [tuple(r) for r in one(spark, lineup, text.batting_order("v"))] == [(1, "A B"), (3, "C D"), (5, "E F")]
    assert one(spark, None, text.batting_order("v")) == []
    assert one(spark, lineup, text.lineup_confirmed("v")) is True
    assert one(spark, "{}", text.lineup_confirmed("v")) is False


def test_sections_and_teams(spark):
    article = "Tampa Bay Rays set roster\n**Pitchers (13): Shane Baz, Pete Fairbanks.\nCatchers:\n Danny Jansen, Ben Rortvedt \nNotes: none\nOutfielders: Josh Lowe, Shane Baz"
    listed = one(spark, article, text.section_entries("v"))
    assert listed == ["Shane Baz", "Pete Fairbanks", "Danny Jansen", "Ben Rortvedt", "Josh Lowe", "Shane Baz"]
    assert one(spark, article, text.first_seen(text.section_entries("v"))) == listed[:-1]
    teams = {"New York Yankees": "NYY", "Tampa Bay Rays": "TB"}
    assert one(spark, article, text.team_from_title("v", list(teams))) == "Tampa Bay Rays"
    assert one(spark, "x\ny", text.team_from_title("v", list(teams))) == ""
    found = text.team_from_transaction("v", teams)
    assert one(spark, "03/12/25 A was claimed by Tampa Bay Rays", found["team_code"]) == "TB"
    assert one(spark, "03/12/25 New York Yankees signed B", found["team_name"]) == "New York Yankees"
    assert one(spark, "someone retired", found["team_code"]) is None


def test_pitcher_summary(spark):
    fields = text.pitcher_summary("v")
    assert one(spark, "(10 - 4)  3.12 era 120 SO", fields["record"]) == "10-4"
    assert one(spark, "(10-4) 3.12 era 120 SO", fields["era"]) == 3.12
    assert one(spark, "rookie", fields["strikeouts"]) is None
    spot = text.lineup_line("v", F.lit("/player/aaron-judge-592450"))
    assert one(spark, "A. Judge (R) CF", spot["position"]) == "CF"
    assert one(spark, "x", spot["player_id"]) == 592450


def test_action_pattern_is_case_insensitive():
    assert re.match(r"\(\?i\)", names._actions(names.ACTION_VERBS))


def test_fuzzy_join_of_the_whole_table_equals_brute_force(spark):
    """Every raw name against every person of the smallest tables."""
    from slatework.catalog import QUERIES
    from slatework.catalog.name_queries import _people, _raw_names
    from slatework.functions.names import normalize_name
    from slatework.operators.similarity import common_subsequence

    folder = "/root/testdata/sf0.001"
    people = {}
    for r in _people(spark, folder).select(normalize_name("full_name").alias("key"), "person_id").collect():
        people[r["key"]] = min(r["person_id"], people.get(r["key"], r["person_id"]))
    raw = {r[0] for r in _raw_names(spark, folder).select(normalize_name("raw")).distinct().collect()}
    ordered = lambda text: " ".join(sorted(text.split()))

    def best(name):
        if name in people:
            return name, people[name], 100.0
        scored = []
        for key, person in people.items():
            a, b = ordered(name), ordered(key)
            score = 200.0 * common_subsequence(a, b) / (len(a) + len(b)) if a or b else 100.0
            if score >= 85 - 1e-9:
                scored.append((-score, person, key))
        return (min(scored)[2], min(scored)[1], -min(scored)[0]) if scored else (None, None, None)

    got = {r["wanted"]: (r["key"], r["person_id"], r["similarity"]) for r in QUERIES["j18_fuzzy_join"](spark, folder).collect()}
    assert got == {name: best(name) for name in raw}


def test_texts_keep_suffixes_and_lose_whole_code_points(spark):
    rows = [("End Jr", "end jr"), ("Word iv", "word iv"), ("x\U00020000y", "xy"), ("ªJosé", "jose"), ("", ""), (None, None)]
    frame = spark.createDataFrame(rows, "v string, want string").withColumn("got", names.normalize_text("v"))
    assert [(r["v"], r["got"]) for r in frame.collect()] == rows
    assert one(spark, "x\U00020000y", names.normalize_name("v")) == "xy"
