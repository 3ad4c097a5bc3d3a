"""Code tables: team aliases, pitch-type aliases, handedness, batting-order slots."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from slatework.functions.numeric import col, flag_double, num

# One alias table for every join on team codes.
TEAM_ALIASES = {
    "ATH": "OAK", "AZ": "ARI", "CHW": "CWS", "KCR": "KC", "SDP": "SD", "SFG": "SF", "TBR": "TB", "WSN": "WSH",
}

# Pitch names as sources spell them.
PITCH_TYPES = {
    "four-seam fb": "FF", "4-seam fb": "FF", "four-seam fastball": "FF", "ff": "FF",
    "sinker": "SI", "si": "SI", "slider": "SL", "sl": "SL", "sweeper": "ST", "st": "ST",
    "curve": "CU", "curveball": "CU", "cu": "CU", "changeup": "CH", "change-up": "CH", "ch": "CH",
    "cutter": "FC", "fc": "FC", "splitter": "FS", "fs": "FS", "slurve": "SV", "sv": "SV",
}

# Plate appearances a batting-order slot can expect.
SLOT_APPEARANCES = {1: 4.8, 2: 4.7, 3: 4.6, 4: 4.5, 5: 4.3, 6: 4.2, 7: 4.0, 8: 3.9, 9: 3.8}


def lookup(table: Mapping, key: Column) -> Column:
    """Value of a small fixed table, NULL when the key is not in it."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def team_code(value: Column | str, aliases: Mapping[str, str] = TEAM_ALIASES) -> Column:
    code = F.upper(F.trim(col(value)))
    return F.coalesce(lookup(aliases, code), code)


def pitch_type(value: Column | str, aliases: Mapping[str, str] = PITCH_TYPES) -> Column:
    """Alias if known, else the first two letters in upper case."""
    text = F.trim(F.coalesce(col(value), F.lit("")))
    return F.coalesce(lookup(aliases, F.lower(text)), F.substring(F.upper(text), 1, 2))


def handedness(bats: Column | str, throws: Column | str) -> dict[str, Column]:
    """One-hot hands and the matchup flags; a switch hitter always has the platoon edge, unknown hands give NULL."""
    bats, throws = F.upper(F.trim(col(bats))), F.upper(F.trim(col(throws)))
    known = bats.isin("L", "R") & throws.isin("L", "R")
    return {
        "batter_bats_right": flag_double(bats == "R"),
        "batter_bats_left": flag_double(bats == "L"),
        "batter_is_switch": flag_double(bats == "S"),
        "pitcher_throws_right": flag_double(throws == "R"),
        "pitcher_throws_left": flag_double(throws == "L"),
        "same_hand_matchup": F.when(known, flag_double(bats == throws)).when(bats == "S", num(0)),
        "platoon_advantage": F.when(known, flag_double(bats != throws)).when(bats == "S", num(1)),
    }


def slot_flags(slot: Column | str, appearances: Mapping[int, float] = SLOT_APPEARANCES, default: float = 4.0) -> dict[str, Column]:
    """Top / middle / bottom of the order and the expected appearances of a slot."""
    slot = col(slot).cast("int")
    return {
        "top_half_lineup": F.when(slot.isNotNull(), flag_double(slot <= 3)),
        "middle_lineup": F.when(slot.isNotNull(), flag_double(slot.between(4, 6))),
        "bottom_half_lineup": F.when(slot.isNotNull(), flag_double(slot >= 7)),
        "projected_pa": F.when(slot.isNotNull(), F.coalesce(lookup(appearances, slot), num(default))),
    }
