"""Nothing that happens from a day on changes what is said about earlier days."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from slatework.catalog.domain import prepared_sources, starter_sources
from slatework.plans import hitters, starters

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def history(spark):
    whole = prepared_sources(spark, FOLDER)
    days = sorted(r[0] for r in whole.games.select("game_date").distinct().collect())
    day = days[len(days) // 3]
    games = whole.games.where(F.col("game_date") < F.lit(day))
    known = games.select("game_id")
    plays = whole.plays.join(known, "game_id", "left_semi")
    cut = replace(
        whole, games=games, plays=plays, pitching_box=whole.pitching_box.join(known, "game_id", "left_semi"),
        pitches=whole.pitches.join(plays.select(F.col("id").alias("play_id")), "play_id", "left_semi"),
    )
    return whole, cut, day


def unchanged(build, whole, cut, day):
    def rows(df):
        df = df.where(F.col("game_date") < F.lit(day))
        # Sums are taken in any order, so doubles agree to ten digits.
        plain = df.select(*[F.format_string("%.10g", c).alias(c) if kind in ("double", "float") else F.col(c).cast("string").alias(c) for c, kind in df.dtypes])
        return sorted(map(tuple, plain.select(*sorted(plain.columns)).collect()), key=str)

    full, early = rows(build(whole)), rows(build(cut))
    assert len(full) > 100
    assert full == early


def test_hitter_features(history):
    unchanged(hitters.build_hitter_features, *history)


def test_starter_features(spark, history):
    whole, cut, day = history
    unchanged(lambda s: starters.build_starter_features(starter_sources(spark, FOLDER, s)), whole, cut, day)
