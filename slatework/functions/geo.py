"""Distances, time zones and travel load."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from slatework.functions.codes import lookup
from slatework.functions.numeric import clip, col, num

EARTH_RADIUS_MILES = 3959.0

# Standard-time offsets of the zones venues lie in.
ZONE_HOURS = {
    "America/Los_Angeles": -8, "America/Denver": -7, "America/Chicago": -6,
    "America/New_York": -5, "America/Phoenix": -7, "America/Toronto": -5,
}


def haversine_miles(lat1: Column | str, lon1: Column | str, lat2: Column | str, lon2: Column | str) -> Column:
    lat1, lon1, lat2, lon2 = (F.radians(col(c)) for c in (lat1, lon1, lat2, lon2))
    chord = F.pow(F.sin((lat2 - lat1) / 2), num(2)) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2), num(2))
    return num(EARTH_RADIUS_MILES) * num(2) * F.atan2(F.sqrt(chord), F.sqrt(num(1) - chord))


def zone_hours(zone: Column | str, default: int = -5) -> Column:
    return F.coalesce(lookup(ZONE_HOURS, col(zone)), F.lit(default))


def zone_changes(zone: Column | str, previous: Column | str) -> Column:
    return F.abs(zone_hours(zone) - zone_hours(previous))


def travel_fatigue(miles: Column | str, zones: Column | str) -> Column:
    return clip(col(miles) / num(3000) * num(25) + col(zones).cast("double") * num(10), 0, 100)


def local_start(start_utc: Column | str, day: Column | str, zone: Column | str, default_hour: int = 19) -> Column:
    """Start in the venue's wall-clock time; an unknown start is taken as 19:00 local."""
    assumed = F.make_timestamp_ntz(
        F.year(day), F.month(day), F.dayofmonth(day), F.lit(default_hour), F.lit(0), F.lit(0)
    )
    local = F.from_utc_timestamp(col(start_utc).cast("timestamp"), col(zone)).cast("timestamp_ntz")
    return F.coalesce(local, assumed)
