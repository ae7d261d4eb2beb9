"""Operator 4: SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints 3 bits apart at most have a half word in which they differ in
one bit at most, which is half the radius. So each distinct fingerprint emits
every variant of either half within one bit (33 a half), shuffled on the
variant together with the other half; it meets the plain halves there, and a
pair that collides is verified by counting the bits of the other half.

A bucket that could hold over ``bucket_pairs`` pairs is not paired up. Its
members emit whole-word balls instead, of radius 1 and 2: in such a bucket any
two members of the inner ball are 2 bits apart at most, an inner and an outer
one 3 at most, so linking all of a bucket that has an inner member to the
smallest of those states every link with one edge a member. A pair 3 bits apart
or less always meets in a bucket that way, so nothing is lost.

Null text counts as empty, an empty or wordless text has fingerprint 0 and is
linked like any other. Rows with equal fingerprints form one class, so copies
cost nothing. A null doc_id takes part but names no component; a component
without any id has a null component_id. Rows that repeat a doc_id stay rows.

``drop_near_duplicates`` leaves one row of every component: that with the smallest
doc_id (null last), of one id that with the smallest text hash, and of rows equal
in both any one.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courtside.llm.common import components, id_text, map_batches, stored, text_key, unused

SHINGLE = 3       # words
DISTANCE = 3      # bits
BUCKET_PAIRS = 4096


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles, as a signed long."""
    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return 0
    line = b" ".join(words)
    if n <= shingle:
        hashes = [xxhash.xxh64_intdigest(line, 42)]
    else:
        sizes = np.fromiter(map(len, words), np.int64, n)
        starts = np.cumsum(sizes + 1) - sizes - 1
        ends = (starts + sizes)[shingle - 1:].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[s:e], 42) for s, e in zip(starts.tolist(), ends)]
    h = np.array(hashes, np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 15):
        bits = np.unpackbits(h[i:i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(h)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, k1, k2, fp) of every row; k1 and k2 stand for the text."""
    def one(cols, shingle):
        return {**{c: cols[c] for c in ("doc_id", "k1", "k2")}, "fp": [fingerprint(t, shingle) for t in cols["text"]]}
    keyed = docs.select("doc_id", "text", *text_key(F.col("text")))
    return map_batches(keyed, one, "doc_id long, k1 long, k2 long, fp long", shingle=shingle)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _balls(fps: DataFrame, masks: list[int], r: int) -> DataFrame:
    """(v, fp, r): whole-word variants."""
    m = F.explode(F.array(*[F.lit(_signed(x)) for x in masks]))
    return fps.select("fp", m.alias("m")).select(F.col("fp").bitwiseXOR(F.col("m")).alias("v"), "fp", F.lit(r).alias("r"))


def _star(buckets: DataFrame) -> DataFrame:
    """Edge from each member of a bucket to the smallest of the inner ball."""
    w = Window.partitionBy("v")
    low = F.min(F.when(F.col("r") == 1, F.col("fp"))).over(w)
    return (buckets.select("fp", low.alias("b")).where("b is not null and fp <> b")
            .select(F.col("fp").alias("a"), "b"))


# A half word as (key: which half * 2**32 + its bits, rest: the other half).
_PLAIN = ("explode(array(struct(fp & 4294967295 as key, shiftrightunsigned(fp, 32) as rest), "
          "struct(shiftrightunsigned(fp, 32) + 4294967296 as key, fp & 4294967295 as rest))) as h")
_FLIPS = "explode(sequence(0, 32)) as flip"  # 0: none; i: bit i - 1
_FLIPPED = "key ^ if(flip = 0, 0L, shiftleft(1L, flip - 1))"


def _whole(key: str, rest: str) -> str:
    """SQL for the fingerprint of (key, rest)."""
    return (f"if({key} >= 4294967296, shiftleft({key} - 4294967296, 32) | {rest}, shiftleft({rest}, 32) | {key})")


def links(fps: DataFrame, distance: int = DISTANCE, bucket_pairs: int = BUCKET_PAIRS) -> DataFrame:
    """Edges (a, b) whose components are those of "at most ``distance`` bits
    apart" over the distinct fingerprints ``fps`` (fp). distance is 0 to 3."""
    if not 0 <= distance <= 3:
        raise ValueError("distance must be 0 to 3")
    if distance == 0:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("a <> b")
    plain = fps.selectExpr(_PLAIN).select("h.*")
    # the flip travels above the other half's bits: two longs a variant
    ball = (plain.select("key", "rest", F.expr(_FLIPS))
            .selectExpr(f"{_FLIPPED} as key", "rest + shiftleft(cast(flip as long), 32) as packed"))
    # an upper bound for a bucket's pairs, from the plain halves alone
    crowd = plain.groupBy("key").agg(F.count("rest").alias("n")).where("n > 1")
    heavy = stored(crowd.select("key", "n", F.expr(_FLIPS)).selectExpr(f"{_FLIPPED} as key", "n")
                   .groupBy("key").agg(F.sum("n").alias("n")).where(f"n * n > {int(bucket_pairs)}").select("key"), "heavy")
    # a size estimate doesn't see that an explode makes 66 rows of one: without
    # the hint the variants may be taken for a small side and broadcast
    met = (plain.join(heavy, "key", "left_anti").hint("merge").join(ball.hint("merge"), "key")
           .selectExpr("key", "rest", "packed & 4294967295 as other", "cast(shiftright(packed, 32) as int) as flip")
           .where(f"bit_count(rest ^ other) + if(flip = 0, 0, 1) <= {int(distance)}")
           .selectExpr(f"{_whole('key', 'rest')} as a", f"{_whole(f'({_FLIPPED})', 'other')} as b").where("a < b"))
    dense = (ball.join(heavy, "key", "left_semi")
             .selectExpr("key", "packed & 4294967295 as other", "cast(shiftright(packed, 32) as int) as flip")
             .selectExpr(f"{_whole(f'({_FLIPPED})', 'other')} as fp").distinct())
    one, two = [1 << i for i in range(64)], [1 << i | 1 << j for i in range(64) for j in range(i)]
    if distance == 1:  # the ball of radius 0 and 1
        far = _star(_balls(dense, [0], 1).union(_balls(dense, one, 2)))
    else:
        inner = _balls(dense, [0, *one], 1)
        far = _star(inner.union(_balls(dense, two, 2)) if distance == 3 else inner)
    return met.union(far).distinct()


def _roots(fps: DataFrame, distance: int, bucket_pairs: int) -> DataFrame:
    """(fp, root) of the distinct fingerprints ``fps``: one root a component."""
    comp = components(links(fps, distance, bucket_pairs))
    return fps.join(comp, fps["fp"] == comp["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                       distance: int = DISTANCE, bucket_pairs: int = BUCKET_PAIRS) -> DataFrame:
    """One row per input row: doc_id, fp (signed long), component_id."""
    fp = stored(fingerprints(id_text(docs, id_col, text_col), shingle).select("doc_id", "fp"), "simhash")
    classes = stored(fp.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-classes")
    rooted = classes.join(_roots(classes.select("fp"), distance, bucket_pairs), "fp")
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    label = rooted.join(named, "root").select("fp", "component_id")
    return fp.join(label, "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                         distance: int = DISTANCE, bucket_pairs: int = BUCKET_PAIRS) -> DataFrame:
    """One row of each component, all columns. Who stays is found on ids and text
    hashes; only rows that repeat both, if there are any, are compared as rows."""
    row = ["doc_id", "k1", "k2"]
    fp = stored(fingerprints(id_text(docs, id_col, text_col), shingle), "simhash")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), *row)).alias("first")
    classes = stored(fp.groupBy("fp").agg(first), "simhash-classes")
    rooted = classes.join(_roots(classes.select("fp"), distance, bucket_pairs), "fp")
    chosen = rooted.groupBy("root").agg(F.min("first").alias("first")).select("first.*").drop("unnamed")
    repeated = fp.groupBy(*row).count().where("count > 1").withColumnsRenamed({c: "r_" + c for c in row})
    again = F.coalesce(F.col("count") > 1, F.lit(False))
    same = (chosen["doc_id"].eqNullSafe(repeated["r_doc_id"])) & (chosen["k1"] == repeated["r_k1"]) & (chosen["k2"] == repeated["r_k2"])
    chosen = stored(chosen.join(repeated, same, "left").select(*row, again.alias("again")), "simhash-chosen")

    names = docs.columns
    key = {c: unused(names, "__" + c) for c in row}
    k1, k2 = text_key(F.col(f"`{text_col}`").cast("string"))
    keyed = docs.select("*", F.col(f"`{id_col}`").cast("long").alias(key["doc_id"]), k1.alias(key["k1"]), k2.alias(key["k2"]))

    def rows_of(some):
        on = [keyed[key[c]].eqNullSafe(some[c]) for c in row]
        return keyed.join(some, on[0] & on[1] & on[2], "left_semi")

    once, twice = rows_of(chosen.where("not again")), rows_of(chosen.where("again"))
    return once.union(twice.dropDuplicates(list(key.values()))).select(*[F.col(f"`{c}`") for c in names])
