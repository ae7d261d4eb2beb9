"""Distinct counts from stored sketches (O24).

A sketch is made once per key and day and stored; any span of days is answered by
the union of its sketches, without the rows. The estimate's standard error is
about 0.83 / sqrt(2 ** lg_k), whatever the counts and the number of sketches
that are united; small counts (to some hundreds) are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LG_K = 14


def relative_error(lg_k: int = LG_K) -> float:
    """The relative standard error of an estimate."""
    return 0.83 / 2 ** (lg_k / 2)


def daily_sketches(df: DataFrame, keys, day: str, value: str, lg_k: int = LG_K) -> DataFrame:
    """(keys..., day, year, sketch): one sketch of the values per key and day;
    store it by ``year`` and add new days beside the old ones. Null values don't
    count; the day of a row may be null."""
    return (df.groupBy(*keys, day).agg(F.hll_sketch_agg(value, lg_k).alias("sketch"))
            .withColumn("year", F.year(day)))


def distinct_estimate(sketches: DataFrame, keys, name: str) -> DataFrame:
    """Estimated distinct values per key over all the days that are passed in."""
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch", True)).alias(name))
