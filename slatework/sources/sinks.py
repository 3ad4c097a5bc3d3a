"""Writing: snapshots, keyed upserts, slice reloads, exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from slatework.operators.ordering import top_rows


def write_snapshot(df: DataFrame, path: str, partition: str = "game_date") -> None:
    """Replace a snapshot, one folder per date.

    Rows are range-partitioned by date first, which keeps a date's files few; the extra hash column splits
    a date that holds much of the data over several tasks.
    """
    spread = F.xxhash64(*[c for c in df.columns if c != partition])
    df.repartitionByRange(F.col(partition), spread).write.mode("overwrite").partitionBy(partition).parquet(path)


def upsert(target: DataFrame, updates: DataFrame, *, keys: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """Target with updates applied by key: updates replace target rows; of several updates the highest order wins.

    Updates that tie in the order are told apart by a hash of the whole row, so one stays and always the same.

    Of each key only the winning row passes the shuffle of its map task, so a key repeated many times in
    the updates is reduced before it meets the others.
    """
    newest = top_rows(updates, keys, [*[o.desc() for o in order], F.xxhash64(*updates.columns)])
    kept = target.join(newest.select(*keys), list(keys), "left_anti")
    return kept.unionByName(newest)


def insert_new(target: DataFrame, rows: DataFrame, *, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Target plus the rows whose key it lacks; of several new rows with one key the first in order is kept."""
    first = top_rows(rows, keys, order)
    return target.unionByName(first.join(target.select(*keys), list(keys), "left_anti").select(*target.columns))


def replace_slice(target: DataFrame, rows: DataFrame, *, slice_columns: Sequence[str]) -> DataFrame:
    """Target with every slice that occurs in ``rows`` reloaded from them."""
    slices = rows.select(*slice_columns).distinct()
    return target.join(slices, list(slice_columns), "left_anti").select(*target.columns).unionByName(rows)


def overwrite_slices(df: DataFrame, path: str, partition: Sequence[str]) -> None:
    """Replace only the partitions present in ``df`` of a partitioned table."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder in whichever store the path names."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def export(df: DataFrame, path: str, fmt: str = "csv", files: int | None = None) -> None:
    """Review queue or slate as CSV (with header) or JSON lines; ``files`` caps the number of output files."""
    out = df if files is None else df.coalesce(files)
    writer = out.write.mode("overwrite")
    writer.csv(path, header=True) if fmt == "csv" else writer.json(path)
