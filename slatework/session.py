"""Session settings the library is tuned for, and the one place that cuts lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from threading import Lock

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A hot join key is split even where that costs one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Checkpoint files go when their frame does.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(app: str = "slatework", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; on a cluster, pass SETTINGS to spark-submit instead."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir.

    A scratch folder is made only in local mode with none set.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_turn, _asked = Lock(), []


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries planned inside leave no shuffle files once they have run; frames planned outside keep theirs."""
    with _turn:
        if not _asked:
            _asked.append(spark.conf.get(_DROP_SHUFFLES, "false"))
        _asked.append(None)
        spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        with _turn:
            _asked.pop()
            if len(_asked) == 1:
                spark.conf.set(_DROP_SHUFFLES, _asked.pop())


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and continue from the written copy.

    Used where two branches of a plan must see the very same partitioning (global positions, running
    totals) or where a frame is read many times (training).  The copy outlives lost executors; the step's shuffle files
    go as soon as it is written.
    """
    scratch_folder(df.sparkSession)
    with _shuffles_dropped(df.sparkSession):
        step = df.select("*")
    return step.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a compressed Parquet table in the shared scratch folder, read back; no shuffle file of the step is kept.

    For the steps of a feature build: a reader takes the columns it needs, and the planner knows how large the table is.  Readers
    may get several files in one task, so rows to be grouped are dealt out by key first.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/step-{uuid.uuid4().hex}"
    with _shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def together(jobs: Iterable[Callable[[], object]], parallel: int) -> list:
    """Results of the jobs in order, several running at a time: short jobs leave a cluster idle one by one."""
    with ThreadPoolExecutor(parallel) as pool:
        return list(pool.map(lambda job: job(), jobs))
