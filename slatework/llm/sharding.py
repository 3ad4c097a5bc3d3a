"""Sharding by a two-pass external shuffle.

Pass one scatters the records by seeded hashes: the shard is decided by the record's key and the number of shards
alone (the shard with the greatest hash of key and shard number wins, so one more shard takes records only into
itself), and inside a shard a hash of the key and of the record's place in the input picks one of the shard's
buckets.  Each shard has buckets by its own measured bytes, so that a bucket fits in memory however large or hot
the shard is; a record larger than a bucket lies in one alone or with few others.  Pass two brings each bucket together, puts it in the order of its input places, and draws a
Fisher-Yates permutation with Spark's seeded ``shuffle``.  A record's slot is its position there behind the
shard's earlier buckets.

NULL keys are one key of their own.  NULL texts count no bytes.  Repeated rows are kept, each with its own slot.
Extra columns travel along; those named like an added one are replaced by it.  An empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from slatework.llm.common import free_of, written

ADDED = ["shard", "slot"]


def winning_shard(key: Column, shards: int, seed: int) -> Column:
    """The shard whose seeded hash with the key is greatest."""
    draws = [F.struct(F.xxhash64(F.lit(seed), F.lit(s), key).alias("draw"), F.lit(s).alias("shard")) for s in range(shards)]
    return (F.greatest(*draws) if shards > 1 else draws[0])["shard"]


def scatter(docs: DataFrame, *, key: str, size: Column, shards: int, seed: int, bucket_bytes: int) -> tuple[DataFrame, int]:
    """``docs`` with ``__row``, ``shard`` and ``__bucket``, and the number of buckets of all shards."""
    own = winning_shard(F.col(key), shards, seed).alias("shard")
    # One number per shard.
    held = {r["shard"]: r["bytes"] for r in docs.select(own, size.alias("bytes")).groupBy("shard").agg(F.sum("bytes").alias("bytes")).collect()}
    buckets = [max(1, -(-(held.get(s) or 0) // bucket_bytes)) for s in range(shards)]
    place = F.xxhash64(F.lit(seed + 1), key, "__row")
    marked = docs.withColumn("__row", F.monotonically_increasing_id()).withColumn("shard", own)
    of_shard = F.element_at(F.array(*[F.lit(n) for n in buckets]), F.col("shard") + 1)
    return marked.withColumn("__bucket", F.pmod(place, of_shard.cast("long"))), sum(buckets)


def shard(docs: DataFrame, *, key: str = "doc_id", size: Column, shards: int = 16, seed: int = 17, bucket_bytes: int = 16 << 20) -> DataFrame:
    """``docs`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in each shard)."""
    docs = docs.select(*free_of(docs.columns, [*ADDED, "__row", "__bucket"]))
    scattered, buckets = scatter(docs, key=key, size=size, shards=shards, seed=seed, bucket_bytes=bucket_bytes)
    record = F.struct("__row", *docs.columns)
    # About one bucket per task, and none collected before the shuffle.
    together = scattered.repartition(buckets, "shard", "__bucket")
    gathered = together.groupBy("shard", "__bucket").agg(F.collect_list(record).alias("records"))
    # Buckets in a fixed order per task and records in a fixed order per bucket: a rerun task draws the same permutations.
    fixed = gathered.sortWithinPartitions("shard", "__bucket").withColumn("records", F.sort_array("records"))
    drawn = fixed.withColumn("records", F.shuffle("records", F.lit(seed + 2)))
    counts = written(scattered.groupBy("shard", "__bucket").agg(F.count(F.lit(1)).alias("rows")))
    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "__bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    placed = drawn.join(offsets, ["shard", "__bucket"]).select("shard", "offset", F.posexplode("records").alias("at", "record"))
    return placed.select(*[F.col("record")[c].alias(c) for c in docs.columns], "shard", (F.col("offset") + F.col("at")).alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """The records as Parquet, a folder per shard, in the order of their slots within each file."""
    sharded.repartition("shard", F.floor(F.col("slot") / 1_000_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
