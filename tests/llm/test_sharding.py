"""Sharding: gapless slots, uniform shards, law of keys, repeatable draws."""

from pyspark.sql import functions as F

from slatework.llm.sharding import scatter, shard, winning_shard, write_shards



def parts(df, **options):
    return shard(df, size=F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + 1, **options)


def make(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, slot int, records string")


def rows():
    return [(i, f"text {i}" * (i % 50), 7, "r") for i in range(3000)] + [(None, "n", 7, None), (5, None, 7, None), (6, "", 7, None), (8, "x" * 300_000, 7, None)] + [(9, "same", 7, None)] * 1500


def test_every_row_once_and_slots_gapless(spark):
    df = make(spark, rows())
    out = parts(df, bucket_bytes=8 << 10).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in out), key=str) == sorted(((r[0], r[1]) for r in rows()), key=str)
    slots = {}
    for r in out:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(slots) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {r["records"] for r in out} == {"r", None}


def test_repeatable_and_shuffled(spark):
    df = make(spark, rows()[:3000])
    one = [tuple(r) for r in parts(df).orderBy("shard", "slot").collect()]
    assert one == [tuple(r) for r in parts(df).orderBy("shard", "slot").collect()]
    first = [r[0] for r in one if r[-2] == 0]
    rising = sum(a < b for a, b in zip(first, first[1:])) / len(first)
    assert 0.3 < rising < 0.7


def test_a_new_shard_only_takes_rows(spark):
    ids = spark.range(20_000).select(winning_shard(F.col("id"), 16, 17).alias("a"), winning_shard(F.col("id"), 17, 17).alias("b"))
    counts = {(r["a"], r["b"]): r["count"] for r in ids.groupBy("a", "b").count().collect()}
    assert all(b in (a, 16) for a, b in counts)
    assert all(1000 < sum(v for (a, _), v in counts.items() if a == s) < 1500 for s in range(16))


def test_hot_key_fills_no_bucket(spark):
    """One id on a third of all rows: its shard has as many more buckets, all of about the size asked for."""
    df = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("x" * 80).alias("text")).repartition(6)
    scattered, buckets = scatter(df, key="doc_id", size=F.octet_length("text").cast("long") + 1, shards=16, seed=17, bucket_bytes=64 << 10)
    sizes = [r["count"] * 81 for r in scattered.groupBy("shard", "__bucket").count().collect()]
    assert len(sizes) == buckets and max(sizes) < 1.4 * (64 << 10)
    out = parts(df, bucket_bytes=64 << 10).groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.max("slot").alias("m")).collect()
    assert sum(r["n"] for r in out) == 60_000 and all(r["n"] == r["d"] == r["m"] + 1 for r in out)


def test_empty_and_written(spark, tmp_path):
    assert parts(make(spark, [])).count() == 0
    write_shards(parts(make(spark, rows()[:200])), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 200
