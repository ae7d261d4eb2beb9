"""DataFrame operators the pipelines are built from.

Each is ``DataFrame -> DataFrame`` with column names as parameters. The rule
they follow: anything whose group can grow with the data is done with an
aggregate (partial/map-side combine, skew-safe) plus a join back, not a window
that would pull a whole group into one task. Ordered operators cut the order
into stretches (a day, a minute, a range partition) and run their windows within
a stretch.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtside.functions.exprs import col
from courtside.sources.results import written

SALTS = 32  # parts of a group whose candidates are found apart
_ROW = (1 << 33) - 1  # monotonically_increasing_id: the row below, the partition above


def _list(x) -> list:
    if x is None:
        return []
    return [x] if isinstance(x, (str, Column)) else list(x)


def measured(df: DataFrame, name: str = "side") -> DataFrame:
    """A computed side of a join, written first, so that its size is known when
    the join is planned (O13): Spark sends it to every task if its files are
    below ``spark.sql.autoBroadcastJoinThreshold``, and else shuffles both sides
    and splits the partitions of hot keys. Nothing is broadcast on a promise."""
    return written(df, name)


# ---------------------------------------------------------------- filters

def filter_group_extreme(df: DataFrame, keys, c: str, fn: str = "max") -> DataFrame:
    """Rows whose ``c`` equals the per-group max (or min) of ``c`` (O11).

    An aggregate plus an equi-join back, so a hot group is pre-reduced map-side
    and the join is split by AQE's skew handling instead of sorting one task.
    """
    keys = _list(keys)
    agg = F.max(c) if fn == "max" else F.min(c)
    ext = df.groupBy(*keys).agg(agg.alias("__ext"))
    return (df.join(ext, keys, "inner").where(F.col(c) == F.col("__ext")).drop("__ext"))


def filter_having(df: DataFrame, keys, cond_aggs: dict, cond: Column) -> DataFrame:
    """Rows of groups whose aggregates satisfy ``cond`` (HAVING, then semi join)."""
    keys = _list(keys)
    g = df.groupBy(*keys).agg(*[a.alias(n) for n, a in cond_aggs.items()]).where(cond)
    return df.join(g.select(*keys), keys, "left_semi")


def filter_global_extreme(df: DataFrame, c: str, fn: str = "max") -> DataFrame:
    """Rows where ``c`` equals its global max/min (O12): a one-row scalar
    subquery, evaluated once, then an ordinary filter."""
    agg = F.max(c) if fn == "max" else F.min(c)
    return df.where(F.col(c) == df.agg(agg).scalar())


def slice_by(df: DataFrame, column: str, value, contains: bool = False,
             negate: bool = False) -> DataFrame:
    """Parameter slice (O50/O51): equality (pushed into the parquet scan as a
    literal predicate) or substring test."""
    cond = F.col(column).contains(F.lit(value)) if contains else F.col(column) == F.lit(value)
    return df.where(~cond if negate else cond)


# ---------------------------------------------------------------- pairing

def with_opponent_totals(df: DataFrame, game_keys, value_cols: Sequence[str],
                         prefix: str = "opp_") -> DataFrame:
    """For side-level rows of a game (one row per team in the game), add the
    other side's values (O14): one aggregate gathers a game's sides, and an
    explode of two rows swaps them, so an unknown value stays unknown and does
    not hide the other side's.

    A game has two sides; a game with any other number is dropped, like the
    self-join of the two sides would drop a lone one."""
    keys = _list(game_keys)
    rest = [c for c in df.columns if c not in keys]
    sides = F.collect_list(F.struct(*rest)).alias("__sides")
    games = df.groupBy(*keys).agg(sides).where(F.size("__sides") == 2)
    a, b = F.col("__sides")[0], F.col("__sides")[1]
    pairs = games.select(*keys, F.explode(F.array(F.struct(a.alias("own"), b.alias("opp")),
                                                  F.struct(b.alias("own"), a.alias("opp")))).alias("__p"))
    own = [F.col(f"__p.own.{c}").alias(c) if c in rest else F.col(c) for c in df.columns]
    return pairs.select(*own, *[F.col(f"__p.opp.{c}").alias(prefix + c) for c in value_cols])


# ---------------------------------------------------------------- keep first

def first_per_key(df: DataFrame, keys, order: Sequence[Column]) -> DataFrame:
    """Keep one row per key: the greatest by ``order`` (a tuple of columns,
    compared left to right; make the last one unique) (O19).

    ``max_by`` over a struct is an ordinary aggregate, so hot keys are combined
    map-side instead of being sorted in one task.
    """
    keys = _list(keys)
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("__best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col("__best")[c].alias(c) for c in rest])


# ---------------------------------------------------------------- shares, ranks

def share_of_total(df: DataFrame, n_col: str, by=None, name: str = "share") -> DataFrame:
    """``n / sum(n)`` over all rows or within ``by`` (O27), for rows already
    aggregated to a bounded grain (counts per category, per team, ...): the
    total is a window over those rows, computed in the same pass."""
    total = F.sum(n_col).over(Window.partitionBy(*_list(by)))
    return df.withColumn(name, F.col(n_col) / total)


def null_aware_rank(c, partition=(), ascending: bool = False, kind: str = "rank") -> Column:
    """``rank``/``percent_rank``/``row_number`` where a null value stays null and
    is not counted among the others (R's min_rank / percent_rank) (O34, O35)."""
    c = col(c)
    part = [col(p) for p in _list(partition)] + [c.isNull()]
    w = Window.partitionBy(*part).orderBy(c.asc() if ascending else c.desc())
    fn = {"rank": F.rank, "percent_rank": F.percent_rank, "dense_rank": F.dense_rank}[kind]()
    return F.when(c.isNotNull(), fn.over(w).cast("double" if kind == "percent_rank" else "long"))


def top_n_with_ties(df: DataFrame, n: int, c: str, partition=None) -> DataFrame:
    """Rows whose competition rank by ``c`` descending is <= n (O36, top_n).

    A row is kept iff its value is >= the n-th largest value. Globally that comes
    from ``orderBy(...).limit(n)`` (per-partition top-n, then a merge); per group
    from ``_group_cuts``. The rows themselves are never sorted.
    """
    if partition:
        keys = _list(partition)
        cut = _group_cuts(df, n, c, keys)
        same = reduce(lambda a, b: a & b, [df[k].eqNullSafe(cut["__" + k]) for k in keys])
        return df.join(cut, same).where(F.col(c) >= F.col("__cut")).drop("__cut", *["__" + k for k in keys])
    cut = df.where(F.col(c).isNotNull()).orderBy(F.col(c).desc()).limit(n).agg(F.min(c)).scalar()
    return df.where(F.col(c) >= cut)


def _group_cuts(df: DataFrame, n: int, c: str, keys: list) -> DataFrame:
    """(__key..., __cut): each group's n-th largest value (its least, if it has
    fewer). Equal values are counted first; a group's values are dealt over
    ``SALTS`` parts, each of which hands in its n largest, so a hot group is no
    single task's and the last step sees n * SALTS rows of it at most, however
    many rows tie."""
    counts = (df.where(F.col(c).isNotNull()).groupBy(*keys, c).agg(F.count(F.lit(1)).alias("__n"))
              .withColumn("__salt", F.pmod(F.xxhash64(c), F.lit(SALTS))))
    down = F.col(c).desc()
    few = (counts.withColumn("__r", F.row_number().over(Window.partitionBy(*keys, "__salt").orderBy(down)))
           .where(F.col("__r") <= n))
    above = F.sum("__n").over(Window.partitionBy(*keys).orderBy(down).rowsBetween(Window.unboundedPreceding, -1))
    kept = few.withColumn("__above", F.coalesce(above, F.lit(0))).where(F.col("__above") < n)
    return kept.groupBy(*[F.col(k).alias("__" + k) for k in keys]).agg(F.min(c).alias("__cut"))


def band_percent_rank(df: DataFrame, band: str, value: str, name: str) -> DataFrame:
    """``percent_rank(value)`` within ``band`` (O35):
    (rows in band with a smaller value) / (non-null rows in band - 1).

    Rows are counted per (band, value), and the counts are summed up in order
    over range partitions of (band, value): a band's values are dealt over as
    many tasks as their number asks for, whether they are rounded or all
    different. Null values get null, as in R."""
    counts = df.where(F.col(value).isNotNull()).groupBy(band, value).agg(F.count(F.lit(1)).alias("__n"))
    upto = ranged_running_sum(counts, [band], [F.col(value)], {"__upto": F.col("__n")})
    totals = upto.groupBy(F.col(band).alias("__band")).agg(F.max("__upto").alias("__tot"))
    below = F.col("__upto") - F.col("__n")
    share = F.when(F.col("__tot") > 1, below / (F.col("__tot") - 1)).otherwise(F.lit(0.0))
    ranked = upto.join(totals, F.col(band) == F.col("__band")).select(band, value, share.alias(name))
    return df.join(ranked, [band, value], "left")


# ---------------------------------------------------------------- ordered

def running_sum(df: DataFrame, partition, order: Sequence, values: dict,
                chunk: Column | None = None, chunk_name: str | None = None) -> DataFrame:
    """Running sums ``{out_name: expr}`` within ``partition`` in ``order`` (O28);
    null only before the first value that isn't.

    With ``chunk`` (a coarse, order-preserving function of the order key, e.g.
    the month of a date), the prefix sum runs in two levels: per-chunk totals
    are aggregated and prefix-summed over the (few) chunks of each partition,
    then rows are summed within (partition, chunk) and offset. No window ever
    holds more than one chunk of one key, so a hot key is split across tasks.
    ``chunk_name`` keeps the chunk as a column.
    """
    partition = _list(partition)
    order = _list(order)
    if chunk is None:
        w = (Window.partitionBy(*partition).orderBy(*order)
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        out = df
        for name, e in values.items():
            out = out.withColumn(name, F.sum(e).over(w))
        return out
    out = df.withColumn("__chunk", chunk)
    totals = out.groupBy(*partition, "__chunk").agg(
        *[F.sum(e).alias("__t_" + name) for name, e in values.items()])
    w_prev = (Window.partitionBy(*partition).orderBy("__chunk")
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(*partition, "__chunk", *[
        F.sum("__t_" + name).over(w_prev).alias("__o_" + name) for name in values])
    w = (Window.partitionBy(*partition, "__chunk").orderBy(*order)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = out.join(offsets, partition + ["__chunk"], "left")
    for name, e in values.items():
        here, before = F.sum(e).over(w), F.col("__o_" + name)
        out = out.withColumn(name, F.coalesce(before + here, here, before))
    out = out.drop(*["__o_" + n for n in values])
    return out.withColumnRenamed("__chunk", chunk_name) if chunk_name else out.drop("__chunk")


def ranged_running_sum(df: DataFrame, partition, order: Sequence[Column], values: dict) -> DataFrame:
    """``running_sum`` whose stretches are range partitions of (partition,
    order): their bounds are sampled from the data, so that no stretch has to be
    guessed from what the keys look like. The partitioned rows are written once,
    as a second sampling could cut elsewhere. Make the order unique."""
    partition = _list(partition)
    placed = df.repartitionByRange(*partition, *order).withColumn("__part", F.spark_partition_id())
    return running_sum(written(placed, "ranged"), partition, order, values, chunk=F.col("__part")).drop("__part")


def current_run_length(df: DataFrame, keys, order: Sequence[Column], hit: Column, name: str) -> DataFrame:
    """Length of the run of ``hit`` rows at the end of each group, 0 if the
    last row misses (the current streak). Two aggregates and a join, no window:
    count the rows after the last miss."""
    keys = _list(keys)
    key = F.struct(*order)
    last_miss = (df.where(~hit).groupBy(*keys).agg(F.max(key).alias("__last_miss")))
    return (df.join(last_miss, keys, "left")
            .groupBy(*keys)
            .agg(F.count_if(F.col("__last_miss").isNull() | (key > F.col("__last_miss"))).alias(name)))


def unpivot(df: DataFrame, ids, values: Sequence[str], name_col: str, value_col: str) -> DataFrame:
    """Wide to long (O42); nulls are kept (filter them explicitly)."""
    return df.unpivot(_list(ids), list(values), name_col, value_col)


def separate(df: DataFrame, c: str, into: Sequence[str | None], sep: str) -> DataFrame:
    """Split a text column into columns by a regex (O43): missing pieces are
    null, extra pieces are dropped; a None name skips that piece."""
    parts = F.split(F.col(c), sep)
    out = df
    for i, name in enumerate(into):
        if name:
            out = out.withColumn(name, F.try_element_at(parts, F.lit(i + 1)))
    return out


def unite(df: DataFrame, name: str, cols: Sequence[str], sep: str = "", drop: bool = True) -> DataFrame:
    """Join columns into one text column (O44); null pieces are skipped."""
    out = df.withColumn(name, F.concat_ws(sep, *[F.col(c) for c in cols]))
    return out.drop(*[c for c in cols if c != name]) if drop else out


def global_row_number(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """1-based row number over the whole frame in ``order`` (make the order
    unique) without a single-task window (O33).

    Rows are range-partitioned by the order, with bounds sampled from the data,
    sorted within their partition and written once. A row's number is its place
    in its partition plus the rows of the partitions before, whose counts are
    one row a task."""
    placed = (df.repartitionByRange(*order).sortWithinPartitions(*order)
              .withColumn("__at", F.monotonically_increasing_id()))
    placed = written(placed, "numbered").withColumn("__part", F.shiftright("__at", 33))
    counts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    # at most spark.sql.shuffle.partitions rows, so they can go to every task
    return (placed.join(F.broadcast(offsets), "__part")
            .withColumn(name, F.col("__off") + F.col("__at").bitwiseAND(_ROW) + 1).drop("__part", "__off", "__at"))
