"""Source readers and the snapshot-refresh rule (O01-O03, P01).

A snapshot is a folder of versions, ``<path>/v=<epoch ms>/``; a version
counts once its completion marker ``<path>/done/v=<epoch ms>/`` exists, which
is written only after the data write has committed. Refreshing writes a new
version and never touches the one readers use, so a failed or half-written
refresh leaves the previous snapshot in place (no rename needed, which object
stores do not make atomic).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.errors import AnalysisException


def read_csv_table(spark: SparkSession, path: str, schema: StructType | str, header: bool = True) -> DataFrame:
    """(O01) CSV with a declared schema (no inference pass over the data)."""
    return spark.read.schema(schema).option("header", header).option("mode", "PERMISSIVE").csv(path)


def read_jdbc_table(spark: SparkSession, url: str, table: str, properties: dict,
                    partition_column: str | None = None, lower: int | None = None,
                    upper: int | None = None, num_partitions: int | None = None) -> DataFrame:
    """(O03) a database table read in parallel slices of ``partition_column``
    (without one, a single connection reads it all)."""
    if partition_column:
        return spark.read.jdbc(url, table, column=partition_column, lowerBound=lower,
                               upperBound=upper, numPartitions=num_partitions, properties=properties)
    return spark.read.jdbc(url, table, properties=properties)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by=None) -> None:
    """(O02) overwrite a table folder (parquet by default, or csv with a header)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    if fmt == "csv":
        w = w.option("header", True)
    w.format(fmt).save(path)


def snapshot_versions(spark: SparkSession, path: str) -> DataFrame:
    """Complete versions of a snapshot: (version, modified_s). Only the tiny
    marker files are listed; no data file is read."""
    try:
        marks = spark.read.format("binaryFile").load(f"{path}/done/v=*/*.json")
    except AnalysisException:
        return spark.createDataFrame([], "version long, modified_s long")
    return (marks.select(F.regexp_extract("path", r"/done/v=(\d+)/", 1).cast("long").alias("version"),
                         F.unix_timestamp("modificationTime").alias("modified_s"))
            .groupBy("version").agg(F.max("modified_s").alias("modified_s")))


def refresh_snapshot(spark: SparkSession, source: DataFrame | Callable[[], DataFrame], path: str,
                     max_age_hours: float = 8, active: bool = True,
                     now: dt.datetime | None = None) -> DataFrame:
    """(P01) read the newest snapshot; first write a new one from ``source``
    when there is none, or when ``active`` and the newest is older than
    ``max_age_hours`` (measured from its marker's modification time)."""
    now = now or dt.datetime.now(dt.timezone.utc)
    latest = snapshot_versions(spark, path).orderBy(F.col("version").desc()).limit(1).collect()
    stale = not latest
    if latest and active:
        stale = now.timestamp() - latest[0]["modified_s"] > max_age_hours * 3600
    if stale:
        version = int(now.timestamp() * 1000)
        if latest and version <= latest[0]["version"]:
            version = latest[0]["version"] + 1
        frame = source() if callable(source) else source
        frame.write.mode("errorifexists").parquet(f"{path}/v={version}")
        (spark.createDataFrame([(version,)], "version long").coalesce(1)
         .write.mode("errorifexists").json(f"{path}/done/v={version}"))
        target = version
    else:
        target = latest[0]["version"]
    return spark.read.parquet(f"{path}/v={target}")
