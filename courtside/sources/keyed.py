"""Snapshots of a keyed table, with their changes (O49, P01).

Every version is a data folder, a folder with what changed against the version
before (rows inserted, changed and deleted, told apart by the hash of the row),
and a commit file that names both. A version exists once its commit file does,
and a commit file can be made only once: of several refreshers that work on the
same version one wins, the others drop what they wrote and read the winner's.

    <path>/commits/<version>.json      <path>/data/<attempt>/      <path>/delta/<attempt>/

On a local disk the commit file is linked into place; elsewhere it is created by
the Hadoop file system with overwriting forbidden, which HDFS does atomically.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import time
import uuid
from collections.abc import Callable, Sequence
from functools import reduce
from urllib.parse import urlparse

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

COMMIT = "version long, data string, delta string, at long"


def row_delta(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(change, columns...): rows of ``new`` that ``old`` lacks (``insert``) or
    holds otherwise (``change``), and rows of ``old`` that ``new`` lacks
    (``delete``). Both have the same columns; keys are unique, and a null key is
    a key like any other. One full join on the keys; unchanged rows are dropped
    by two 64-bit hashes of the row."""
    def side(df, name):
        cells = [F.col(f"`{c}`") for c in new.columns]
        marks = F.struct(*[F.xxhash64(F.lit(seed), *[F.struct(c.isNull(), c) for c in cells]) for seed in (1, 2)])
        return df.select(*[F.col(f"`{k}`").alias(f"__{name}{i}") for i, k in enumerate(keys)],
                         F.struct(*cells).alias(name), marks.alias(name + "_hash"))

    a, b = side(old, "old"), side(new, "new")
    same = reduce(lambda x, y: x & y, [a[f"__old{i}"].eqNullSafe(b[f"__new{i}"]) for i in range(len(keys))])
    change = F.when(F.col("old_hash").isNull(), "insert").when(F.col("new_hash").isNull(), "delete").otherwise("change")
    both = a.join(b, same, "full").where(~F.col("old_hash").eqNullSafe(F.col("new_hash")))
    row = F.coalesce("new", "old")
    return both.select(change.alias("change"), *[row[c].alias(c) for c in new.columns])


def commits(spark: SparkSession, path: str) -> list[Row]:
    """The kept versions, oldest first: (version, data, delta, at in ms)."""
    try:
        found = spark.read.schema(COMMIT).json(f"{path}/commits").where("version is not null").collect()
    except AnalysisException:  # no such folder
        return []
    return sorted(found, key=lambda r: r.version)


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The newest version, or the one asked for."""
    kept = {c.version: c for c in commits(spark, path)}
    return spark.read.parquet(f"{path}/data/{kept[max(kept) if version is None else version].data}")


def changes_since(spark: SparkSession, path: str, version: int) -> DataFrame:
    """(version, change, columns...): what changed after ``version``; versions
    that retention has dropped can't be told any more (ValueError)."""
    kept = commits(spark, path)
    if not kept or not kept[0].version <= version + 1 <= kept[-1].version + 1:
        raise ValueError(f"version {version} is not kept")
    later = [spark.read.parquet(f"{path}/delta/{c.delta}").select(F.lit(c.version).alias("version"), "*") for c in kept if c.version > version]
    return reduce(DataFrame.unionByName, later) if later else (
        spark.read.parquet(f"{path}/delta/{kept[-1].delta}").select(F.lit(0).cast("long").alias("version"), "*").limit(0))


def refresh_keyed(spark: SparkSession, source: DataFrame | Callable[[], DataFrame], path: str, keys: Sequence[str],
                  max_age_hours: float = 8, keep: int = 5, now: dt.datetime | None = None) -> DataFrame:
    """The newest version of the table at ``path``; if there is none, or it is
    older than ``max_age_hours``, ``source`` is read and committed as the next
    one, with its changes, and versions but the newest ``keep`` are removed. A
    source with a repeated key is refused (ValueError)."""
    path = path.rstrip("/")
    at = int((now or dt.datetime.now(dt.timezone.utc)).timestamp() * 1000)
    kept = commits(spark, path)
    if kept and at - kept[-1].at <= max_age_hours * 3_600_000:
        return read_version(spark, path)
    attempt = uuid.uuid4().hex
    data, delta = f"{path}/data/{attempt}", f"{path}/delta/{attempt}"
    (source() if callable(source) else source).write.parquet(data)
    new = spark.read.parquet(data)
    if new.groupBy(*[F.col(f"`{k}`") for k in keys]).count().where("count > 1").limit(1).count():
        _remove(spark, [data])
        raise ValueError(f"the keys {list(keys)} of the source repeat")
    old = spark.read.parquet(f"{path}/data/{kept[-1].data}") if kept else new.limit(0)
    row_delta(old, new, keys).write.parquet(delta)
    version = kept[-1].version + 1 if kept else 1
    told = {"version": version, "data": attempt, "delta": attempt, "at": at}
    if not _create(spark, f"{path}/commits/{version:012d}.json", json.dumps(told)):
        _remove(spark, [data, delta])  # another refresher has won
        for _ in range(50):  # its commit file may still be on its way
            if any(c.version >= version for c in commits(spark, path)):
                return read_version(spark, path)
            time.sleep(0.2)
        raise RuntimeError(f"commit {version} of {path} was begun and not finished")
    for c in [*kept, Row(**told)][:-keep]:
        _remove(spark, [f"{path}/commits/{c.version:012d}.json", f"{path}/data/{c.data}", f"{path}/delta/{c.delta}"])
    return spark.read.parquet(data)


def _local(path: str) -> str | None:
    url = urlparse(path)
    return url.path if url.scheme in ("", "file") else None


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Make a file with a text, unless it exists: False then."""
    here = _local(path)
    if here is None:
        file = spark._jvm.org.apache.hadoop.fs.Path(path)
        system = file.getFileSystem(spark._jsc.hadoopConfiguration())
        if system.exists(file):
            return False
        try:
            out = system.create(file, False)
        except Exception as e:  # made by another in between
            if "AlreadyExists" in str(e):
                return False
            raise
        out.write(text.encode())
        out.close()
        return True
    os.makedirs(os.path.dirname(here), exist_ok=True)
    draft = f"{os.path.dirname(here)}/.{uuid.uuid4().hex}"
    with open(draft, "w") as f:
        f.write(text)
    try:
        os.link(draft, here)
        return True
    except FileExistsError:
        return False
    finally:
        os.unlink(draft)


def _remove(spark: SparkSession, paths: Sequence[str]) -> None:
    for p in paths:
        file = spark._jvm.org.apache.hadoop.fs.Path(p)
        file.getFileSystem(spark._jsc.hadoopConfiguration()).delete(file, True)
