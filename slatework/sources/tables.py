"""Reading: typed table scans, snapshots with a fallback, landed JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, path: str, columns: Sequence[str], *, schema: StructType | str | None = None, required: Sequence[str] = (), where: Column | None = None) -> DataFrame:
    """Parquet scan with an explicit column list, NOT NULL columns and a predicate, all pushed into the scan."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.parquet(path)
    for column in required:
        df = df.where(F.col(column).isNotNull())
    if where is not None:
        df = df.where(where)
    return df.select(*columns)


def read_jdbc(spark: SparkSession, url: str, table: str, *, partition_column: str, lower, upper, partitions: int, properties: dict[str, str] | None = None) -> DataFrame:
    """Partitioned read from a relational source; connection and credentials come from the caller only."""
    return spark.read.jdbc(
        url, table, column=partition_column, lowerBound=lower, upperBound=upper, numPartitions=partitions, properties=properties or {}
    )


def load_snapshot(spark: SparkSession, primary: str, fallback: str | None = None, *, schema: StructType | str, date: str | None = None, clean: str | None = None, pattern: str = r"\s+", fmt: str = "csv") -> DataFrame:
    """Feature snapshot as typed rows: dates parsed (bad ones NULL), one name column cleaned by a pattern.

    The fallback is read when the primary path does not exist or holds no rows.
    """
    def read(path: str) -> DataFrame:
        reader = spark.read.schema(schema)
        return reader.csv(path, header=True) if fmt == "csv" else reader.format(fmt).load(path)

    try:
        df = read(primary)
        if fallback is not None and df.isEmpty():
            df = read(fallback)
    except AnalysisException as error:
        if fallback is None or error.getCondition() != "PATH_NOT_FOUND":
            raise
        df = read(fallback)
    if date is not None:
        df = df.withColumn(date, F.to_date(F.col(date).try_cast("timestamp")))
    return df if clean is None else df.withColumn(clean, F.trim(F.regexp_replace(clean, pattern, " ")))


HOURLY = {
    "time": "string", "temperature_2m": "double", "relative_humidity_2m": "double", "precipitation": "double",
    "wind_speed_10m": "double", "wind_direction_10m": "double", "pressure_msl": "double", "weather_code": "int",
}


def weather_hours(landed: DataFrame, *, payload: str, keys: Sequence[str]) -> DataFrame:
    """One JSON document per location and day -> one typed row per hour."""
    shape = ",".join(f"{name}:array<{kind}>" for name, kind in HOURLY.items())
    hourly = F.from_json(F.get_json_object(payload, "$.hourly"), f"struct<{shape}>")
    read = landed.select(*keys, hourly.alias("h"))
    # A document may lack a series; an empty one is padded with NULLs where a missing one would drop the document.
    series = [F.coalesce(f"h.{name}", F.array().cast(f"array<{kind}>")).alias(name) for name, kind in HOURLY.items()]
    rows = read.select(*keys, *series).select(*keys, F.inline(F.arrays_zip(*HOURLY))).where("time is not null")
    return rows.withColumn("time", F.col("time").try_cast("timestamp_ntz"))


def read_json_landing(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)
