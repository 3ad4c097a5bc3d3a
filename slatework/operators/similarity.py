"""Fuzzy name matching by token-sorted indel similarity, with an exact candidate filter."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from slatework.operators.ordering import top_rows
from slatework.session import stored


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine-word style step per character of ``b``."""
    places: dict[str, int] = {}
    for i, char in enumerate(a):
        places[char] = places.get(char, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for char in b:
        hit = row & places.get(char, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(DoubleType())
def indel_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """100 x 2 x LCS / (len + len); 100 for two empty strings."""
    return pd.Series(
        [100.0 if not (a or b) else 200.0 * common_subsequence(a, b) / (len(a) + len(b)) for a, b in zip(left, right)],
        dtype="float64",
    )


def sorted_tokens(value: Column | str) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.array_join(F.array_sort(F.filter(F.split(value, r"\s+"), lambda t: t != "")), " ")


def _segments(text: Column, parts: Column) -> Column:
    """Cut a text into near-equal segments: array<struct<i, at, piece>>."""
    size = F.length(text)
    base = F.floor(size / parts).cast("int")
    longer = (size - base * parts).cast("int")

    def segment(i: Column) -> Column:
        # The last ``longer`` segments are one character longer.
        at = i * base + F.greatest(i - (parts - longer), F.lit(0))
        width = base + F.when(i >= parts - longer, 1).otherwise(0)
        return F.struct(i.cast("int").alias("i"), at.cast("int").alias("at"), F.substr(text, (at + 1).cast("int"), width.cast("int")).alias("piece"))

    return F.transform(F.sequence(F.lit(0), (parts - 1).cast("int")), segment)


def similar_pairs(left: DataFrame, right: DataFrame, *, left_text: str, right_text: str, threshold: float, within: Sequence[str] = (), spare: int = 2) -> DataFrame:
    """All (left_text, right_text) pairs of distinct texts with token-sorted similarity >= threshold.

    A similarity of T allows at most k = (1 - T)(len + len) insertions and deletions.  If the left text is
    cut into k + 1 + r segments, at most k of them are hurt, so of any k + 1 at least one survives unchanged in
    every such partner, shifted by at most k.  Each left text therefore asks with its k + 1 rarest pieces only
    (r is ``spare``), by an equi join on (length, length, segment, piece): common pieces, where everyone would meet
    everyone, are left out, and nothing is missed.  What letters alone rule out goes before any pair is
    scored.  ``within`` adds equality keys.
    """
    slack = (100.0 - threshold) / 100.0
    a = left.select(*within, left_text).distinct().withColumn("__a", sorted_tokens(left_text))
    b = right.select(*within, right_text).distinct().withColumn("__b", sorted_tokens(right_text))
    a, b = a.where("__a <> ''").withColumn("__la", F.length("__a")), b.where("__b <> ''").withColumn("__lb", F.length("__b"))

    # Lengths that can reach the threshold, from 2 min / (a + b) >= T.
    keep = threshold / (200.0 - threshold)
    lengths_of = lambda size: F.sequence(
        F.ceil(size * keep - 1e-9).cast("int"), F.floor(size / keep + 1e-9).cast("int")
    )
    edits = F.floor((F.col("__la") + F.col("__lb")) * slack + 1e-9).cast("int")
    a_keys = (
        a.withColumn("__lb", F.explode(lengths_of(F.col("__la"))))
        .withColumn("__s", F.explode(_segments(F.col("__a"), edits + 1 + spare)))
        .select(*within, left_text, "__a", "__la", "__lb", F.col("__s.i").alias("__i"), F.col("__s.piece").alias("__piece"))
    )

    # Where segment i of a length-la text starts, and every place it may have moved to.
    parts = edits + 1 + spare
    base = F.floor(F.col("__la") / parts).cast("int")
    longer = (F.col("__la") - base * parts).cast("int")
    at = F.col("__i") * base + F.greatest(F.col("__i") - (parts - longer), F.lit(0))
    width = base + F.when(F.col("__i") >= parts - longer, 1).otherwise(0)
    first = F.greatest(at - edits, F.lit(0))
    final = F.least(at + edits, F.col("__lb") - width)
    # Segments of width 0 (more edits than characters) match everywhere, once.
    shifts = F.when(width == 0, F.array(F.lit(0))).when(final >= first, F.sequence(first.cast("int"), final.cast("int")))
    b_keys = (
        b.withColumn("__la", F.explode(lengths_of(F.col("__lb"))))
        .withColumn("__i", F.explode(F.sequence(F.lit(0), edits + spare)))
        .withColumns({"__width": width, "__shifts": shifts})
        .withColumn("__at", F.explode("__shifts"))
        .select(*within, right_text, "__b", "__la", "__lb", "__i", F.substr("__b", (F.col("__at") + 1).cast("int"), F.col("__width").cast("int")).alias("__piece"))
        .distinct()
    )
    piece = [*within, "__la", "__lb", "__i", "__piece"]
    common = b_keys.groupBy(*piece).agg(F.count(F.lit(1)).alias("__holders"))
    # One left text has a few dozen pieces per length.
    rarest = Window.partitionBy(*within, left_text, "__lb").orderBy(F.coalesce("__holders", F.lit(0)), "__i")
    a_keys = a_keys.join(common, piece, "left").withColumn("__rank", F.row_number().over(rarest))
    a_keys = a_keys.where((F.col("__rank") <= edits + 1) & (F.col("__holders") > 0)).drop("__holders", "__rank")
    candidates = (
        a_keys.join(b_keys, [*within, "__la", "__lb", "__i", "__piece"])
        .select(*within, left_text, right_text, "__a", "__b")
        .distinct()
    )
    # Letters that only one side has must be deleted or inserted.
    letters = lambda c: F.sort_array(F.split(c, ""))
    apart = F.size(F.array_except(letters("__a"), letters("__b"))) + F.size(F.array_except(letters("__b"), letters("__a")))
    candidates = candidates.where(apart <= F.floor((F.length("__a") + F.length("__b")) * slack + 1e-9))
    scored = candidates.withColumn("similarity", indel_ratio("__a", "__b"))
    return scored.where(F.col("similarity") >= threshold - 1e-9).drop("__a", "__b")


#: Texts that meet in one task, of the left and of the right side.
LEFT_BLOCK, RIGHT_BLOCK = 1 << 14, 1 << 13


def _best_in_block(threshold: float) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Left texts (text, __a) and right texts (key, __b, __rank) -> the most similar key of each text, the lowest rank first.

    The steps of ``common_subsequence`` run on all right texts at once, a machine word each.  Left texts are taken in order, so
    what the letters two of them begin with have left is not computed again.
    """

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("__rank")
        texts = right["__b"].tolist()
        longest = max(map(len, texts), default=0)
        kind = next((k for k, bits in ((np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if longest <= bits), object)
        ones = np.bitwise_count if kind is not object else np.frompyfunc(int.bit_count, 1, 1)
        places: dict[str, list[int]] = {}
        for i, text in enumerate(texts):
            for j, char in enumerate(text):
                places.setdefault(char, [0] * len(texts))[i] |= 1 << j
        masks = {char: np.array(held, dtype=kind) for char, held in places.items()}
        sizes = np.array([len(text) for text in texts], dtype="int64")
        full = np.array([(1 << len(text)) - 1 for text in texts], dtype=kind)
        found, rows, before = [], [full], ""
        for text, a in sorted(zip(left["text"], left["__a"]), key=lambda x: x[1]) if texts else ():
            same = next((i for i, (x, y) in enumerate(zip(before, a)) if x != y), min(len(before), len(a)))
            del rows[same + 1 :]
            for char in a[same:]:
                row, mask = rows[-1], masks.get(char)
                if mask is None:
                    rows.append(row)
                else:
                    hit = row & mask
                    rows.append((row + hit) | (row - hit))
            before = a
            common = sizes - ones(rows[-1] & full).astype("int64")
            similarity = 200.0 * common / (len(a) + sizes)
            at = int(similarity.argmax())
            if similarity[at] >= threshold - 1e-9:
                found.append((text, at, similarity[at]))
        keys = right["key"].tolist()
        return pd.DataFrame({"text": [f[0] for f in found], "key": [keys[f[1]] for f in found], "similarity": [float(f[2]) for f in found]}).astype({"similarity": "float64"})

    return best


def best_pairs(left: DataFrame, right: DataFrame, *, left_text: str, right_text: str, right_order: str, threshold: float) -> DataFrame:
    """(left_text, right_text, similarity), for each left text the most similar right one of every block of right texts.

    At the thresholds names need, few letters have to be equal, and an index of pieces finds most pairs of short texts anyway.  So all
    pairs are scored, in blocks of bounded size, and a block hands on one pair per left text: neither what a task holds nor what
    is shuffled grows with the number of pairs.  Of equally similar texts the one with the lowest ``right_order`` is taken.
    """
    a = stored(left.select(F.col(left_text).alias("text")).distinct().withColumn("__a", sorted_tokens("text")).where("__a <> ''"))
    lowest = top_rows(right.select(F.col(right_text).alias("key"), F.col(right_order).alias("__order")), ["key"], [F.col("__order")])
    b = stored(lowest.withColumn("__b", sorted_tokens("key")).where("__b <> ''"))
    lefts, rights = (max(math.ceil(df.count() / block), 1) for df, block in ((a, LEFT_BLOCK), (b, RIGHT_BLOCK)))
    blocks = F.sequence(F.lit(0), F.lit(rights - 1))
    wanted = a.withColumn("__i", F.pmod(F.xxhash64("__a"), F.lit(lefts)).cast("int")).withColumn("__j", F.explode(blocks))
    dealt = b.withColumn("__j", F.pmod(F.xxhash64("__b"), F.lit(rights)).cast("int"))
    dealt = dealt.withColumn("__rank", F.row_number().over(Window.partitionBy("__j").orderBy("__order", "key"))).drop("__order")
    dealt = dealt.withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit(lefts - 1))))
    # The parts are named, so that adaptive execution does not put small rows with much work together.
    meet = [df.repartition(lefts * rights, "__i", "__j").groupBy("__i", "__j") for df in (wanted, dealt)]
    out = StructType([StructField("text", StringType()), StructField("key", StringType()), StructField("similarity", DoubleType())])
    found = meet[0].cogroup(meet[1]).applyInPandas(_best_in_block(threshold), out)
    return found.withColumnsRenamed({"text": left_text, "key": right_text})


def fuzzy_join(left: DataFrame, right: DataFrame, *, left_key: str, right_key: str, right_order: str, threshold: float = 85.0) -> DataFrame:
    """Left join on equal normalized keys, and for the rest on the most similar key at or above ``threshold``.

    Of equal keys the highest ``right_order`` wins; of equally similar ones the lowest.
    """
    wanted = left.select(left_key).distinct()
    exact_rows = top_rows(right, [right_key], [F.col(right_order).desc()])
    exact = wanted.join(exact_rows, F.col(left_key) == F.col(right_key)).withColumn("similarity", F.lit(100.0))
    rest = wanted.join(right.select(F.col(right_key).alias(left_key)).distinct(), left_key, "left_anti")
    pairs = best_pairs(rest, right, left_text=left_key, right_text=right_key, right_order=right_order, threshold=threshold)
    order = [F.col("similarity").desc(), F.col(right_order)]
    fuzzy = top_rows(pairs.join(right, right_key), [left_key], order)
    matched = exact.unionByName(fuzzy)
    return left.join(matched, left_key, "left")
