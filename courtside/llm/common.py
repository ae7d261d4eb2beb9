"""Helpers shared by the operators of this subpackage.

Documents are read as (id, text) only, under internal names, so extra columns
of an input can never clash with an operator's own. Text rules used by all:
a word is a run of ``[^\\x20\\x09-\\x0D]``, which is what ``bytes.split()`` gives.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from courtside.session import checkpoint_root


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string) of a table, whatever else it holds."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet into the shared folder and read it back: it cuts
    the lineage, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def open_path(path: str) -> tuple[pafs.FileSystem, str]:
    """A file system and the path in it (file, hdfs, s3 and gs URIs, plain paths)."""
    return pafs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:", path) else (pafs.LocalFileSystem(), path)


def map_batches(df: DataFrame, fn, schema: str, **params) -> DataFrame:
    """``mapInArrow`` with ``fn(columns: dict of lists, **params) -> dict of lists``."""
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch.to_pydict(), **params)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def map_arrow(df: DataFrame, schema: str, fn) -> DataFrame:
    """``mapInArrow`` with ``fn(iterator of batches) -> iterator of dicts of columns``."""
    target = arrow_schema(schema)

    def run(batches):
        for out in fn(batches):
            yield pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c := out[f.name], pa.Array) else pa.array(c, f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def text_key(*cols) -> list[Column]:
    """128 bits that stand for the given columns' values (two seeds), never null."""
    return [F.xxhash64(*cols).alias("k1"), F.xxhash64(F.lit("courtside"), *cols).alias("k2")]


def unused(names: Sequence[str], base: str) -> str:
    """A column name that is none of ``names``, whatever their case."""
    taken = {n.lower() for n in names}
    while base.lower() in taken:
        base += "_"
    return base


def join_on(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]], how: str) -> DataFrame:
    """Null-safe equi-join."""
    cond = reduce(lambda a, b: a & b, [left[x].eqNullSafe(right[y]) for x, y in pairs])
    return left.join(right, cond, how)


def semi_by_row(docs: DataFrame, decided: DataFrame, id_col: str, text_col: str, how: str = "left_semi") -> DataFrame:
    """Rows of ``docs`` whose (id, text) stands in ``decided`` (columns k1, k2),
    or with ``left_anti`` doesn't."""
    k1, k2 = text_key(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    names = docs.columns
    keyed = docs.select(*[F.col(f"`{c}`") for c in names], k1.alias("__k1"), k2.alias("__k2"))
    d = decided.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"))
    return keyed.join(d, ["__k1", "__k2"], how).select(*[F.col(f"`{c}`") for c in names])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable over ``edges`` (a, b longs).

    Large-star and small-star rounds: every round points each node at the
    smallest node it sees and re-hangs its larger neighbours there, so depth
    falls quickly whatever a component's shape. A node's minimum is a
    map-side-combined aggregate and is joined back, a join that AQE can split
    at a hub. Each round is written to the shared folder. Nodes without an
    edge are not listed.
    """
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
               .distinct(), "cc")
    seen = None
    for _ in range(max_rounds):
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        large = large.where("a <> b").distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low2, "a")
        small = (small.select("b", "m").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(low2.select("a", F.col("m").alias("b"))).distinct())
        e = stored(small, "cc")
        state = tuple(e.agg(F.count("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    root = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return root.union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
