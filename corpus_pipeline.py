"""The corpus pipeline: toxicity, language, near duplicates, mixture, packing.

Every stage works on all documents its predecessor kept, takes (spark, docs, sf_dir), and all but the last return the
columns of ``documents``.  Decisions are made for rows, so NULL and repeated ids do no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from slatework.llm import language, minhash, mixing, packing_squares, toxicity
from slatework.llm.common import crc_share, table, written
from slatework.llm.queries import MIXTURE, rated, vocabulary

#: Models, sketches and packing groups have no SQL; the stages are tested against brute force and planted cases.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(crc_share("doc_id", 5) != 0)
    scored = toxicity.score(docs, toxicity.fit(docs, labels), keep=docs.columns, prefix="__")
    return scored.where("__predicted = 0").select(*docs.columns)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.fit(docs.where(crc_share("doc_id", 3) != 1))
    return language.detect(docs, model, keep=docs.columns, prefix="__").where("NOT __rejected").select(*docs.columns)


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs``, written with a key of their own for rows: ids may be NULL or repeated."""
    return written(docs.withColumn("__row", F.monotonically_increasing_id()))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exactly one row of each component stays, the one of the smallest id, also where ids are NULL or repeated."""
    keyed = _keyed(docs)
    found = minhash.near_duplicates(keyed, doc_id="__row").select(F.col("doc_id").alias("__row"), "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64(*docs.columns), "__row")
    first = found.join(keyed.select("__row", order.alias("order")), "__row").groupBy("component_id").agg(F.min("order").alias("order"))
    return keyed.join(written(first.select("order.__row")), "__row", "left_semi").select(*docs.columns)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rates are at most one here: the mixture is reached by leaving documents out, none is repeated."""
    keyed = _keyed(docs)
    rows = keyed.select("__row", "doc_id", "text", F.xxhash64("text").alias("__content"))
    mixed = mixing.mix(rows, table(spark, sf_dir, "labels"), MIXTURE, domain=rated(), cap=1.0, draw=("doc_id", "__content"))
    left_out = written(mixed.where("copies = 0").select("__row"))
    return keyed.join(left_out, "__row", "left_anti").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing_squares.pack(docs, **vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("language ID", drop_unknown_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("mixing sources to target weights", mix_to_targets),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
