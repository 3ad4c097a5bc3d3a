"""From landed hourly documents to one weather row per game."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from slatework.functions import codes, geo, weather
from slatework.functions.numeric import num
from slatework.operators.ordering import join_on, top_rows
from slatework.sources.tables import HOURLY

# An indoor game's air.
INDOOR = {"temp_f": 72.0, "wind_speed_mph": 0.0, "precipitation_mm": 0.0, "wind_out_factor": 1.0}

READINGS = {
    "temp_f": "temperature_2m", "relative_humidity": "relative_humidity_2m", "wind_speed_mph": "wind_speed_10m", "wind_direction_deg": "wind_direction_10m",
    "precipitation_mm": "precipitation", "pressure_msl_hpa": "pressure_msl", "weather_code": "weather_code",
}


def day_documents(landed: DataFrame, *, payload: str, keys: Sequence[str]) -> DataFrame:
    """One row per document key with its hours as an array; of several documents of a key the last in order counts.

    The hours stay within their row: a document is parsed once and never multiplied out.
    """
    shape = ",".join(f"{name}:array<{kind}>" for name, kind in HOURLY.items())
    read = landed.select(*keys, payload).withColumn("__h", F.from_json(F.get_json_object(payload, "$.hourly"), f"struct<{shape}>"))
    series = [F.coalesce(f"__h.{name}", F.array().cast(f"array<{kind}>")).alias(name) for name, kind in HOURLY.items()]
    one = top_rows(read.where("__h is not null"), keys, [F.col(payload).desc()])
    hours = F.transform(F.arrays_zip(*HOURLY), lambda h: h.withField("time", h["time"].try_cast("timestamp_ntz")))
    return one.select(*keys, *series).select(*keys, F.filter(hours, lambda h: h["time"].isNotNull()).alias("hours"))


def nearest_hour(hours: Column, start: Column) -> Column:
    """The hour nearest to the start's full hour, the earlier entry of two equally near; NULL without hours."""
    seconds = lambda t: F.unix_timestamp(t.cast("timestamp"))
    target = seconds(F.date_trunc("hour", start.cast("timestamp")))
    apart = F.transform(hours, lambda h, i: F.struct(F.abs(seconds(h["time"]) - target).alias("apart"), i.alias("i"), h.alias("hour")))
    nearest = F.array_min(F.transform(apart, lambda a: F.struct(a["apart"], a["i"])))
    return F.get(hours, nearest["i"])


def derive_game_weather(games: DataFrame, parks: DataFrame, landed: DataFrame, *, domes: Sequence[str] = (), bearings: Mapping[str, float] | None = None, payload: str = "payload") -> DataFrame:
    """One weather row per game at a known park.

    ``games``: game_id, game_date, start_utc (may be NULL), home_team, venue, roof_type.  ``parks``: team, lat, lon, tz.
    ``landed``: team, day and the location's document of that day in local time.

    ``weather_source`` tells an indoor game's constants, an observed hour and a missing one apart; games without an hour stay,
    with readings NULL, and unavailable.
    """
    bearings = weather.PARK_BEARINGS if bearings is None else bearings
    places = top_rows(parks.select(codes.team_code("team").alias("__home"), "lat", "lon", "tz"), ["__home"], [F.col("tz"), F.col("lat"), F.col("lon")])
    base = games.withColumn("__home", codes.team_code("home_team")).join(places, "__home")
    base = base.withColumns({"local_game_time": geo.local_start("start_utc", "game_date", "tz"), "is_dome": weather.is_dome("roof_type", "venue", domes)})
    documents = day_documents(landed.select(codes.team_code("team").alias("__home"), F.col("day").alias("game_date"), payload), payload=payload, keys=["__home", "game_date"])
    met = join_on(base, documents, ["__home", "game_date"], "left").withColumn("__hour", nearest_hour(F.col("hours"), F.col("local_game_time")))

    indoor, seen = F.col("is_dome"), F.col("__hour").isNotNull()
    readings = {
        name: F.when(indoor, num(INDOOR[name]) if name in INDOOR else F.lit(None)).otherwise(F.col(f"__hour.{field}")) for name, field in READINGS.items()
    }
    told = met.withColumns(
        readings
        | {
            "observation_time": F.when(indoor, F.col("local_game_time")).otherwise(F.col("__hour.time")),
            "weather_available": indoor | seen,
            "weather_source": F.when(indoor, "indoor").when(seen, "observed").otherwise("missing"),
        }
    )
    told = told.withColumns(
        {
            "dew_point_f": weather.dew_point_f("temp_f", "relative_humidity"),
            "wind_out_factor": F.when(F.col("weather_source") == "observed", weather.wind_out_factor("wind_speed_mph", "wind_direction_deg")).otherwise(num(1)),
            **weather.roof_estimate("roof_type", "precipitation_mm", "temp_f", "wind_speed_mph"),
            **weather.wind_components(codes.lookup(dict(bearings), F.col("__home")), "wind_speed_mph", "wind_direction_deg"),
        }
    )
    told = told.withColumn("air_carry_factor", weather.air_carry("temp_f", "dew_point_f", "roof_status_estimated"))
    return told.drop("__home", "__hour", "hours")
