"""Helpers the operators share: tables, written intermediate results, input columns."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from slatework.session import scratch_folder

#: Fixed value: the white space that separates words, everywhere in this subpackage.
SPACE = " \t\n\x0b\f\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared scratch folder, read back.

    It cuts the lineage, survives lost executors, and its size is known to the planner, so whether a side is
    broadcast is decided by the session's size limit.
    """
    path = f"{scratch_folder(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_of(columns: Sequence[str], added: Sequence[str]) -> list[str]:
    """The columns whose names are not among the added ones (letter case aside): added columns take the place of those."""
    taken = {a.lower() for a in added}
    return [c for c in columns if c.lower() not in taken]


def masked(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` under neutral column names, so that none meets a working column, and the names by original name."""
    names = {c: f"__in{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def crc_share(key: str, modulo: int) -> Column:
    """crc32 of the key as text, modulo ``modulo``: the folds that the contracts fix.  NULL keys read as ''."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(modulo))


def words_of(text: Column) -> Column:
    """Words of a text, [] for NULL, empty and blank texts."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(F.length(bare) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, f"{SPACE_CLASS}+"))


def bounded_sample(df: DataFrame, key: str, bound: int) -> DataFrame:
    """About ``bound`` rows at most, chosen by a hash of the key: the rows a model is fitted on, and nothing else."""
    rows = df.count()
    if rows <= bound:
        return df
    limit = int(bound / rows * (1 << 30))
    return df.where(F.pmod(F.xxhash64(F.lit("fit"), F.col(key)), F.lit(1 << 30)) < limit)
