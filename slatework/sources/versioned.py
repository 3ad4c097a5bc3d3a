"""A date-partitioned table whose refreshes are published whole or not at all.

Layout below the table's folder::

    data/__version=<n>/<partition>=<value>/   the partitions written by refresh n
    index/__version=<n>/                      (keys, partition) of the rows refresh n wrote or moved
    manifest/<n>/                             (partition, __version): what the table consists of after refresh n

The manifest is written last, and only one that Spark marked as complete counts.  A reader takes the newest such manifest,
so it sees every partition of a refresh or none; what a failed refresh left behind is referred to by nothing.
Partition values are dates, numbers or plain words, which stand in a folder's name as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from slatework.operators.ordering import top_rows
from slatework.session import settle
from slatework.sources.sinks import remove_folder, upsert


def _listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none where it does not exist, in whichever store the path names."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in store.listStatus(folder)] if store.exists(folder) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    """Published versions, oldest first."""
    names = sorted(int(n) for n in _listed(spark, f"{path}/manifest") if n.isdigit())
    return [n for n in names if "_SUCCESS" in _listed(spark, f"{path}/manifest/{n}")]


def _manifest(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{path}/manifest/{version}")


def _read(spark: SparkSession, path: str, partition: str, rows: list) -> DataFrame | None:
    """The given partitions, and no file of another."""
    if not rows:
        return None
    folders = [f"{path}/data/__version={r['__version']}/{partition}={r['__folder']}" for r in rows]
    return spark.read.option("basePath", f"{path}/data").parquet(*folders).drop("__version")


def read_table(spark: SparkSession, path: str, *, partition: str, version: int | None = None) -> DataFrame:
    """The table as of its newest published version, or of an older one that still exists."""
    known = versions(spark, path)
    if not known:
        raise FileNotFoundError(f"no published version below {path}")
    shown = known[-1] if version is None else version
    # One row per partition value: as many as calendar days.
    df = _read(spark, path, partition, _manifest(spark, path, shown).collect())
    return spark.read.parquet(f"{path}/data/__version={shown}/empty") if df is None else df


def _publish(spark: SparkSession, path: str, version: int, rows: DataFrame) -> None:
    """The step that makes a refresh visible; two writers of one version cannot both succeed."""
    rows.coalesce(1).write.mode("error").parquet(f"{path}/manifest/{version}")


def _folder_name(partition: str):
    """A partition value as Spark spells it in a folder's name."""
    return F.coalesce(F.col(partition).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))


def _write(df: DataFrame, path: str, version: int, partition: str) -> DataFrame:
    """Write the rows as a version and return its (partition, __folder, __version) rows."""
    spread = F.xxhash64(*[c for c in df.columns if c != partition])
    target = f"{path}/data/__version={version}"
    df.repartitionByRange(F.col(partition), spread).write.partitionBy(partition).parquet(target)
    df.limit(0).write.parquet(f"{target}/empty")
    held = sorted(n.split("=", 1)[1] for n in _listed(df.sparkSession, target) if n.startswith(f"{partition}="))
    return df.sparkSession.createDataFrame([(h, version) for h in held], "__folder string, __version int")


def create_table(df: DataFrame, path: str, *, keys: Sequence[str], partition: str) -> None:
    """Publish ``df`` as version 0.  ``keys`` identify a row; NULL partition values make a partition of their own."""
    spark = df.sparkSession
    df = settle(df)
    manifest = _write(df, path, 0, partition)
    df.select(*keys, partition).write.parquet(f"{path}/index/__version=0")
    _publish(spark, path, 0, manifest)


def refresh_table(spark: SparkSession, path: str, updates: DataFrame, *, keys: Sequence[str], order: str, partition: str) -> int:
    """Upsert rows by key and publish the result as the next version, which is returned.

    Only partitions that an update enters or leaves are read and written.  Where a key was before is looked up in the index,
    so finding moved rows reads keys, never the table's rows.
    """
    current = versions(spark, path)[-1]
    version = current + 1
    # What a refresh that failed before publishing left behind.
    for kind in ("data", "index"):
        remove_folder(spark, f"{path}/{kind}/__version={version}")
    remove_folder(spark, f"{path}/manifest/{version}")
    newest = settle(top_rows(updates, keys, [F.col(order).desc(), F.xxhash64(*updates.columns)]))
    committed = [f"{path}/index/__version={v}" for v in range(current + 1) if f"__version={v}" in _listed(spark, f"{path}/index")]
    index = spark.read.option("basePath", f"{path}/index").parquet(*committed)
    known = index.join(newest.select(*keys), list(keys), "left_semi").groupBy(*keys).agg(F.max_by(F.struct(partition), "__version")[partition].alias(partition))
    touched = {r[0] for r in newest.select(_folder_name(partition)).union(known.select(_folder_name(partition))).distinct().collect()}

    rows = _manifest(spark, path, current).collect()
    old = _read(spark, path, partition, [r for r in rows if r["__folder"] in touched])
    renewed = newest if old is None else upsert(old.select(*newest.columns), newest, keys=keys)
    made = _write(renewed, path, version, partition)
    newest.select(*keys, partition).write.parquet(f"{path}/index/__version={version}")
    kept = spark.createDataFrame([(r["__folder"], r["__version"]) for r in rows if r["__folder"] not in touched], "__folder string, __version int")
    _publish(spark, path, version, kept.unionByName(made))
    return version


def vacuum(spark: SparkSession, path: str, *, keep: int = 2) -> None:
    """Remove the data of versions that none of the last ``keep`` manifests refers to, and older manifests."""
    known = versions(spark, path)
    for old in known[:-keep]:
        remove_folder(spark, f"{path}/manifest/{old}")
    used = {r["__version"] for v in known[-keep:] for r in _manifest(spark, path, v).collect()} | set(known[-keep:])
    for name in _listed(spark, f"{path}/data"):
        version = int(name.split("=")[1])
        if version < known[-1] and version not in used:
            remove_folder(spark, f"{path}/data/{name}")
