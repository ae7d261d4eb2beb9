"""Operator 6: shards by balanced label propagation, in DataFrame functions only.

Documents with equal texts are linked. Each starts in a shard by hash; in each
round a cell (the copies of one text that started in one shard) asks for the
shard that holds most of its neighbours and has room or sends as much back;
among equal shards a hash of text and round decides. Requests from a shard to
another are admitted by gain, largest first, up to what the other asks to send
back and its room, so full shards swap rows. Rounds go on until ``PATIENCE`` of
them in turn lower no cut; if ``ROUNDS`` have gone by before that, ``settled`` is
false. A text with more copies than a shard holds fills several. At the end
documents without links fill each shard up to its exact quota: row counts
differ by one at most (the law ``rows``).

State is one row per cell, and a group has one cell per shard at most, however
many copies it has; the ranks that the quotas and slots need are bucketed
(``BUCKETS`` by hash per shard), so no task sees a whole shard.

Null text has no bytes and no copies (it links to nothing); an empty text is
one like any other. A null or repeated doc_id is no obstacle: every row gets a
shard and slot of its own. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtside.llm.common import stored, unused

SHARDS = 8
ROUNDS = 60
PATIENCE = 2
BUCKETS = 4096       # rank buckets a shard
RESULT = ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "linked", "cut", "settled")
QUOTA_BUCKETS = 256  # admission buckets for each level of gain


def _lookup(values: dict[int, int], key: Column) -> Column:
    """A value for each shard number (a handful), as a literal map."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def _allowed(asked: dict[tuple[int, int], int], room: dict[int, int]) -> dict[tuple[int, int], int]:
    """How much of what is asked for (from, to) may move: as much as goes the
    other way, and what room is left; less into a shard that holds too much."""
    flow = {(s, t): min(n, asked.get((t, s), 0)) for (s, t), n in asked.items()}
    for t, left in room.items():
        into = [p for p in asked if p[1] == t]
        for p in sorted(into, key=lambda p: (flow[p] - asked[p], p) if left > 0 else (-flow[p], p)):
            more = max(-flow[p], min(asked[p] - flow[p], left))
            flow[p], left = flow[p] + more, left - more
            if left == 0:
                break
    return {p: n for p, n in flow.items() if n > 0}


def propagate(cells: DataFrame, total: int, shards: int, rounds: int) -> tuple[DataFrame, int, bool]:
    """``cells`` (k1, k2, home, shard, n) after label propagation under quotas;
    the cuts that are left (shards of a text beyond its first, over all texts);
    and whether the rounds ended because no move lowered them any more."""
    texts, settled = cells.select("k1", "k2").distinct().count(), False
    pair = F.col("shard") * shards + F.col("to")
    fewest, idle = None, 0
    for r in range(rounds):
        mass = cells.groupBy("k1", "k2", F.col("shard").alias("to")).agg(F.sum("n").alias("mass"))
        held = {x["to"]: x for x in mass.groupBy("to").agg(F.sum("mass").alias("load"), F.count("mass").alias("groups")).collect()}
        groups = sum(x["groups"] for x in held.values())  # texts by shard: each beyond a text's first is a cut
        idle = 0 if fewest is None or groups < fewest else idle + 1
        fewest = groups if fewest is None else min(groups, fewest)
        if idle > PATIENCE:
            settled = True
            break
        room = {t: total // shards - (held[t]["load"] if t in held else 0) for t in range(shards)}
        own = mass.select("k1", "k2", F.col("to").alias("shard"), F.col("mass").alias("own"))
        rank = F.xxhash64("k1", F.lit(r), F.col("to"))
        options = stored(
            cells.join(own, ["k1", "k2", "shard"]).join(mass, ["k1", "k2"]).withColumn("rank", rank)
            .where((F.col("to") != F.col("shard")) & ((F.col("mass") > F.col("own")) | (
                (F.col("mass") == F.col("own")) & (F.col("rank") > F.xxhash64("k1", F.lit(r), F.col("shard"))))))
            .select("k1", "k2", "home", "shard", "to", "n", "mass", "own", "rank"), "shard-options")

        def best(of):
            return (of.groupBy("k1", "k2", "home", "shard")
                    .agg(F.max(F.struct("mass", "rank", "to", "n", "own")).alias("b"))
                    .select("k1", "k2", "home", "shard", "b.to", "b.n", (F.col("b.mass") - F.col("b.own")).alias("gain")))

        def asked(of):  # a row per pair of shards
            return {(x["shard"], x["to"]): x["asked"] for x in of.groupBy("shard", "to").agg(F.sum("n").alias("asked")).collect()}

        wanted = asked(best(options))
        if not wanted:
            settled = True
            break
        fits = {s * shards + t: max(0, room[t]) + wanted.get((t, s), 0) for s in range(shards) for t in range(shards)}
        chosen = stored(best(options.where(F.col("n") <= _lookup(fits, pair))), "shard-requests")
        flow = _allowed(asked(chosen), room)
        if not flow:
            idle += 1  # none fits under this round's order of equal shards
            continue
        allowed = F.coalesce(_lookup({s * shards + t: n for (s, t), n in flow.items()}, pair), F.lit(0))
        chosen = (chosen.where(F.col("n") <= allowed)
                  .withColumn("level", -F.floor(F.log2(F.col("gain") + 1)))
                  .withColumn("bucket", F.pmod(F.xxhash64("k1", "k2", "home", F.lit(r)), F.lit(QUOTA_BUCKETS))))
        queue = Window.partitionBy("shard", "to").orderBy("level", "bucket")
        admitted = (chosen.groupBy("shard", "to", "level", "bucket").agg(F.sum("n").alias("asked"))
                    .withColumn("upto", F.sum("asked").over(queue))
                    .where(F.col("upto") <= allowed).select("shard", "to", "level", "bucket"))
        moves = (chosen.join(F.broadcast(admitted), ["shard", "to", "level", "bucket"], "left_semi")  # pairs of shards x levels x buckets rows
                 .select("k1", "k2", "home", "to"))
        cells = stored(cells.join(moves, ["k1", "k2", "home"], "left")
                       .select("k1", "k2", "home", F.coalesce("to", "shard").alias("shard"), "n"), "cells")
    cut = cells.select("k1", "k2", "shard").distinct().count() - texts
    return cells.select("k1", "k2", "home", "shard"), cut, settled


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text",
                    rounds: int = ROUNDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """``RESULT`` of each row, and the columns named in ``carry``: where one of
    these has a name of ``RESULT``, it keeps it and that of the result is
    lengthened by underscores. ``cut`` and ``settled`` tell how the propagation
    ended (see there); a row's ``linked`` whether its text has copies."""
    text, doc_id = F.col(text_col).cast("string"), F.col(id_col).cast("long")
    rows = stored(docs.select(
        doc_id.alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"), F.xxhash64(text).alias("k1"),
        F.xxhash64(F.lit("copy"), text).alias("k2"), text.isNull().alias("alone"),
        F.xxhash64(F.lit("home"), doc_id, text).alias("h"), F.struct(F.lit(0).alias(unused(carry, "none")), *[F.col(f"`{c}`") for c in carry]).alias("own")),
        "shard-rows")
    total = rows.count()
    rows = rows.withColumn("home", F.pmod("h", F.lit(shards)).cast("int"))
    cells = rows.where("not alone").groupBy("k1", "k2", "home").agg(F.count("h").alias("n"))
    copies = cells.groupBy("k1", "k2").agg(F.sum("n").alias("all")).where("all > 1").select("k1", "k2")
    cells = stored(cells.join(copies, ["k1", "k2"], "left_semi")
                   .select("k1", "k2", "home", F.col("home").alias("shard"), "n"), "cells")
    label, cut, settled = propagate(cells, total, shards, rounds)

    pool = shards  # the label of rows without links
    labelled = (rows.join(label.withColumn("alone", F.lit(False)), ["k1", "k2", "home", "alone"], "left")
                .withColumn("label", F.coalesce("shard", F.lit(pool)))
                .withColumn("bucket", F.pmod(F.shiftright("h", 8), F.lit(BUCKETS)).cast("int")))
    # counted from the stored rows' side: the same (label, bucket) keys
    counts = labelled.groupBy("label", "bucket").agg(F.count("h").alias("n"))
    before = Window.partitionBy("label").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(counts.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))), "shard-ranks")
    load = {t: 0 for t in range(shards + 1)} | dict(offsets.groupBy("label").agg(F.sum("n")).collect())
    quota = {t: total // shards + (t < total % shards) for t in range(shards)} | {pool: 0}
    kept = {t: min(load[t], quota[t]) for t in range(shards)} | {pool: 0}
    # rows beyond a shard's quota join the unlinked ones; each takes a place in line
    line, turn = {}, 0
    for t in [*range(shards), pool]:
        line[t], turn = turn, turn + load[t] - kept[t]
    first, taken = {}, 0
    for t in range(shards):
        first[t], taken = taken, taken + quota[t] - kept[t]

    rank = F.row_number().over(Window.partitionBy("label", "bucket").orderBy("h", "doc_id")) + F.col("offset") - 1
    ranked = (labelled.join(F.broadcast(offsets.drop("n")), ["label", "bucket"])  # (shards + 1) x BUCKETS rows at most
              .withColumn("rank", rank).withColumn("stays", F.col("rank") < _lookup(kept, F.col("label")))
              .withColumn("place", F.col("rank") - _lookup(kept, F.col("label")) + _lookup(line, F.col("label"))))
    vacant = [t for t in range(shards) if quota[t] > kept[t]] or [0]
    open_to = F.lit(vacant[0])
    for t in vacant[1:]:
        open_to = F.when(F.col("place") >= first[t], F.lit(t)).otherwise(open_to)
    final = F.when(F.col("stays"), F.col("label")).otherwise(open_to).cast("int")
    slot = F.when(F.col("stays"), F.col("rank")).otherwise(
        F.col("place") - _lookup(first, F.col("to")) + _lookup({t: kept[t] for t in range(shards)}, F.col("to")))
    found = (F.col("doc_id"), F.col("size"), F.col("text_crc32"), F.lit("rows"), F.col("to"), slot.cast("long"), F.lit(None).cast("int"),
             F.col("shard").isNotNull(), F.lit(cut).cast("long"), F.lit(settled))
    return ranked.withColumn("to", final).select(*[c.alias(unused(carry, name)) for name, c in zip(RESULT, found)],
                                                 *[F.col("own")[c].alias(c) for c in carry])
