"""Person-name keys as pure column expressions."""

from __future__ import annotations

import json
import sys
import unicodedata
from functools import cache

from pyspark.sql import Column, functions as F

from slatework.functions.numeric import col

# Generational suffixes, and the verbs that start trailing play text after a batter's name.
SUFFIX = r"(?i)\s+(jr\.?|sr\.?|ii|iii|iv|v)$"
SUFFIX_TOKENS = ("jr", "sr", "ii", "iii", "iv", "v")
ACTION_VERBS = (
    "hit", "struck", "walk", "fly", "bunt", "by", "grounded", "lined", "flied", "popped", "singled", "doubled",
    "tripled", "homered", "reached", "sacrifice", "intentional", "called", "swinging",
)
SOURCE_ACTION_VERBS = (*ACTION_VERBS, "fouled", "safe", "out")


@cache
def _folding(form: str = "NFKD") -> tuple[str, str, dict[str, str]]:
    """(from, to) for ``translate`` and the characters that decompose to several ASCII ones.

    ``from`` first lists the characters that leave one ASCII character, then common ones that leave none:
    past the end of ``to``, translate deletes.
    """
    single_from, single_to, dropped, several = [], [], [], {}
    for point in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= point <= 0xDFFF:
            continue
        char = chr(point)
        plain = unicodedata.normalize(form, char).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            single_from.append(char)
            single_to.append(plain)
        elif plain:
            several[char] = plain
        elif point < 0x2600:
            dropped.append(char)
    return "".join(single_from + dropped), "".join(single_to), several


def ascii_fold(value: Column | str, form: str = "NFKD") -> Column:
    """Decompose to ASCII (compatibility forms too, unless ``form`` is NFD) and drop what has no ASCII form, without leaving the JVM.

    Almost all accented letters map one to one (``translate``); the few ligatures and symbols that expand
    are looked up one by one.
    """
    source, target, several = _folding(form)
    spelling = F.from_json(F.lit(json.dumps(several)), "map<string,string>")
    # What translate leaves is cut around each remaining foreign character, never inside one; plain text stays one piece.
    pieces = F.regexp_extract_all(F.translate(col(value), source, target), F.lit(r"([\x00-\x7F]+|[^\x00-\x7F])"), F.lit(1))
    plain = F.transform(pieces, lambda c: F.when(c < F.lit("\x80"), c).otherwise(F.coalesce(F.try_element_at(spelling, c), F.lit(""))))
    return F.array_join(plain, "")


def normalize_name(value: Column | str) -> Column:
    """'Judge, Aaron' / 'José Ramírez Jr.' -> 'aaron judge' / 'jose ramirez'; NULL -> ''.  For texts that are no names, see ``normalize_text``.

    The suffix is stripped before and after the comma flip, so 'Soto Jr., Juan' and 'Juan Soto Jr.' agree.
    """
    name = F.regexp_replace(F.trim(ascii_fold(value)), SUFFIX, "")
    name = F.regexp_replace(name, r"(?s)^\s*([^,]*?)\s*,\s*(.*)$", "$2 $1")
    return F.coalesce(_tidied(F.regexp_replace(F.trim(name), SUFFIX, "")), F.lit(""))


def normalize_text(value: Column | str) -> Column:
    """``normalize_name`` without what only names have: no suffix is stripped, no comma flipped; accents go, other compatibility forms too; NULL stays."""
    return _tidied(ascii_fold(value, "NFD"))


def _tidied(name: Column) -> Column:
    # Only white space that is not already a single blank is replaced.
    name = F.regexp_replace(F.replace(name, F.lit("."), F.lit(" ")), r"\s{2,}|[\t\n\x0B\f\r]", " ")
    return F.lower(F.trim(name))


def first_last(value: Column | str) -> Column:
    """'Last, First' -> 'First Last'; text without two comma parts is only trimmed; NULL -> ''."""
    text = F.trim(F.coalesce(col(value), F.lit("")))
    parts = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda p: p != "")
    flipped = F.concat_ws(" ", F.get(parts, F.lit(1)), F.get(parts, F.lit(0)))
    return F.when(text.contains(",") & (F.size(parts) >= 2), flipped).otherwise(text)


def last_first(value: Column | str) -> Column:
    """'Juan Pablo Soto' -> 'Soto, Juan Pablo'; single words unchanged."""
    parts = F.split(F.trim(col(value)), r"\s+")
    leading = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), " ")
    return F.when(F.size(parts) >= 2, F.concat(F.element_at(parts, -1), F.lit(", "), leading)).otherwise(col(value))


def initial_key(value: Column | str) -> Column:
    """'Aaron Judge' -> 'a judge' (first initial + last word, lower case)."""
    text = F.lower(F.trim(F.coalesce(col(value), F.lit(""))))
    parts = F.split(text, r"\s+")
    return F.when(F.size(parts) >= 2, F.concat_ws(" ", F.substring(parts[0], 1, 1), F.element_at(parts, -1))).otherwise(text)


def plain_key(value: Column | str) -> Column:
    """Lower case with everything but letters, digits and spaces removed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(col(value), F.lit(""))), "[^a-z0-9 ]+", ""))


def surname_key(value: Column | str) -> Column:
    """Last word of the plain key that is not a generational suffix."""
    words = F.filter(F.split(plain_key(value), r"\s+"), lambda w: (w != "") & ~w.isin(*SUFFIX_TOKENS))
    return F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit(""))


def _actions(verbs: tuple[str, ...]) -> str:
    return r"(?i)\s+(" + "|".join(verbs) + r")\b.*$"


def strip_action(value: Column | str, verbs: tuple[str, ...] = ACTION_VERBS) -> Column:
    """'Aaron Judge homered to left' -> 'Aaron Judge'."""
    return F.regexp_replace(F.trim(col(value)), _actions(verbs), "")


def clean_source_name(value: Column | str, from_plays: bool = True) -> Column:
    """Name out of a raw source cell; play text also loses its lead-in, parentheses and trailing action."""
    text = F.trim(F.coalesce(col(value), F.lit("")))
    if not from_plays:
        return text
    marker = " pitches to "
    at = F.instr(text, marker)
    text = F.when(at > 0, F.trim(F.substr(text, at + len(marker)))).otherwise(text)
    text = F.regexp_replace(text, r"\s*\([^)]*\)\s*", " ")
    text = F.regexp_replace(text, _actions(SOURCE_ACTION_VERBS), "")
    return F.trim(F.regexp_replace(text, r"^[ \-,:;]+|[ \-,:;]+$", ""))


def name_parts(normalized: Column | str) -> dict[str, Column]:
    """first / last / initial of a normalized name, as registry columns."""
    words = F.split(col(normalized), " ")
    return {
        "first_name": words[0],
        "last_name": F.element_at(words, -1),
        "first_initial": F.substring(words[0], 1, 1),
    }
