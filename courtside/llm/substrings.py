"""Operator 5: repeated byte windows by a depth-limited radix sort of suffixes.

Every byte covered by a ``THRESHOLD``-byte string that also starts anywhere
else is removed. Suffixes are told apart only through their first THRESHOLD
bytes, most significant part first; a pass groups them by one part, and groups
of one leave at once:

1. Pass one takes as digit the window's least ``SEED``-byte string (by a hash,
   leftmost among equals). Equal windows have the same one at the same offset,
   so neighbouring suffixes share a digit and travel as one row: a run, about
   one for every 170 bytes. A run whose digit no other run has is unique.
2. Pass two takes all bytes that a run's windows cover. Runs equal in that are
   copies of each other: all their windows repeat, whatever their number, and
   one of them stands for all in the last pass.
3. Pass three takes whole windows, one row each, but only of runs that share
   their digit with a run of other bytes (the edges of repeated passages).
   Groups of two or more are exactly the repeated windows.

Groups are aggregated before they are shuffled and joined back, so a passage
that a third of all documents share is a row a task, not a group in one. Keys
are 128-bit hashes of the bytes.

Runs and texts are large beside what is known of them, so before they are
shuffled a broadcast bitmap of at most 8 MB (``marked``) leaves out those that
can't meet anything. It lets strangers through, the more the fuller it is, and
never holds back a row: the joins after it decide.

Null text is empty. Matches never cross documents; rows that repeat an id are
documents each, and repeat each other. Texts shorter than the threshold lose
nothing. Removal may cut a character in two: what is left is bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.llm.common import id_text, map_arrow, map_batches, stored

THRESHOLD = 400   # bytes
SEED = 64         # bytes
SPAN = 1 << 18    # bytes worked on at a time, but never less than a document
GROUP = 8192      # distinct runs of a digit (6 MB or so) that one task may hold
BITMAPS = 2048    # of 4 KB, for marked()
_TABLE = np.random.default_rng(400).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_STEPS = np.random.default_rng(401).integers(0, 1 << 62, 16, np.uint64) * np.uint64(4) + np.uint64(3)
_LOW = np.uint64(0xFFFFFFFF)


def seed_hashes(code: np.ndarray, seed: int) -> np.ndarray:
    """Hash of the ``seed`` (a power of two) bytes from each position."""
    h, width, step = _TABLE[code], 1, 0
    while width < seed:
        h = h[:-width] * _STEPS[step] + h[width:]
        width, step = 2 * width, step + 1
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def window_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbouring values."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(values)] = values
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1:width - 1 + n])


def runs(texts: list[bytes], threshold: int, seed: int) -> tuple[np.ndarray, ...]:
    """(which text, first start, last start, seed position, digit, hash of the
    bytes that the run covers as two longs) of every run, in order."""
    raw = b"".join(texts)
    code = np.frombuffer(raw, np.uint8)
    empty = np.empty(0, np.int64)
    if len(code) < threshold:
        return (empty,) * 7
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    h = seed_hashes(code, seed)
    place = np.arange(len(h), dtype=np.uint64)
    at = (window_least((h & ~_LOW) | place, threshold - seed + 1) & _LOW).astype(np.int64)
    # a start is valid if its window ends within its document
    inside = np.zeros(len(at) + 1, np.int32)
    fits = sizes >= threshold
    np.add.at(inside, starts[fits], 1)
    np.add.at(inside, (ends - threshold + 1)[fits], -1)
    valid = np.cumsum(inside[:-1]) > 0
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (at[1:] != at[:-1])
    first = np.flatnonzero(new)
    if not len(first):
        return (empty,) * 7
    stop = np.flatnonzero(valid & np.append(~valid[1:] | new[1:], True))
    which = np.searchsorted(ends, first, "right")
    digest = xxhash.xxh3_128_digest
    pieces = b"".join([digest(raw[a:b]) for a, b in zip(first.tolist(), (stop + threshold).tolist())])
    key = np.frombuffer(pieces, np.int64).reshape(-1, 2)
    base = starts[which]
    seat = at[first]
    return which, first - base, stop - base, seat - base, h[seat].view(np.int64), key[:, 0], key[:, 1]


def spans_of(texts: list[bytes], size: int):
    """Slices of ``texts`` of ``size`` bytes or one text."""
    a, held = 0, 0
    for b, t in enumerate(texts):
        if b > a and held + len(t) > size:
            yield a, b
            a, held = b, 0
        held += len(t)
    if a < len(texts):
        yield a, len(texts)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    d = id_text(docs, id_col, text_col)
    return d.select("doc_id", F.xxhash64("doc_id", "text").alias("dk"), "text")


def marked(rows: DataFrame, keys: DataFrame, col: str) -> DataFrame:
    """``rows`` with a column ``hit``: true wherever the long ``col`` stands in
    that column of ``keys``, and for few other rows while keys are few."""
    slot = F.pmod(F.xxhash64(col), F.lit(BITMAPS << 15))
    bitmaps = (keys.select(F.shiftright(slot, 15).alias("bucket"), slot.bitwiseAND(F.lit((1 << 15) - 1)).alias("bit")).repartition("bucket")
               .groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")))
    # joined in parts of 256 bytes, as each row that meets one copies it
    parts = bitmaps.select("bucket", "bits", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("i"))
    parts = parts.select((F.col("bucket") * 16 + F.col("i")).alias("part"), F.expr("substring(bits, i * 256 + 1, 256)").alias("bits"))
    both = (rows.withColumn("slot", slot).withColumn("part", F.shiftright("slot", 11))
            .join(F.broadcast(parts.where(F.bitmap_count("bits") > 0)), "part", "left"))
    hit = F.expr("(cast(conv(hex(substring(bits, cast((slot & 2047) >> 3 as int) + 1, 1)), 16, 10) as int) >> cast(slot & 7 as int)) & 1 = 1")
    return both.select(*rows.columns, F.coalesce(hit, F.lit(False)).alias("hit"))


def all_runs(keyed: DataFrame, threshold: int, seed: int) -> DataFrame:
    """doc_id, dk, s1, shape (windows * 1024 + seed's offset), digit, bytes_key."""
    def find(batches):
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            ids, dks = batch.column("doc_id"), batch.column("dk")
            for a, b in spans_of(texts, SPAN):
                which, s1, s2, at, digit, key, _ = runs(texts[a:b], threshold, seed)
                pick = pa.array(which + a)
                yield {"doc_id": ids.take(pick), "dk": dks.take(pick), "s1": s1, "shape": (s2 - s1 + 1) * 1024 + at - s1,
                       "digit": digit, "bytes_key": key}
    return map_arrow(keyed, "doc_id long, dk long, s1 int, shape int, digit long, bytes_key long", find)


def _pieces(keyed: DataFrame, wanted: DataFrame, threshold: int) -> DataFrame:
    """The bytes of the wanted runs (doc_id, dk, s1, shape, digit, alone, hot)."""
    lists = stored(wanted.groupBy("doc_id", "dk").agg(F.collect_list(F.struct("s1", "shape", "digit", "alone", "hot")).alias("r")), "run-lists")
    near = marked(keyed, lists, "dk").where("hit")
    lists = lists.select(F.col("doc_id").alias("id2"), F.col("dk").alias("dk2"), "r")
    both = near.join(lists, (near["dk"] == lists["dk2"]) & near["doc_id"].eqNullSafe(lists["id2"]))

    def cut(batches):
        for batch in batches:
            out = {k: [] for k in ("doc_id", "dk", "s1", "shape", "digit", "alone", "hot", "piece")}
            for doc_id, dk, text, found in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "dk", "text", "r"))):
                raw = text.encode()
                for r in found:
                    for k in ("s1", "shape", "digit", "alone", "hot"):
                        out[k].append(r[k])
                    out["doc_id"].append(doc_id)
                    out["dk"].append(dk)
                    out["piece"].append(raw[r["s1"]:r["s1"] + r["shape"] // 1024 - 1 + threshold])
            yield out
    return map_arrow(both.select("doc_id", "dk", "text", "r"),
                  "doc_id long, dk long, s1 int, shape int, digit long, alone boolean, hot boolean, piece binary", cut)


def window_hashes(pieces: list[bytes], threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, start in it, hash) of every window of every piece."""
    code = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    h, width, step, whole, upto = _TABLE[code], 1, 0, None, 0
    bits = threshold
    while bits:  # a window is a chain of powers of two, shortest first
        if bits & 1:
            part = h[upto:]
            whole = part.copy() if whole is None else whole[:len(part)] * _STEPS[15 - step] + part
            upto += width
        bits >>= 1
        if bits:
            h = h[:-width] * _STEPS[step] + h[width:]
            width, step = 2 * width, step + 1
    counts = sizes - threshold + 1
    which = np.repeat(np.arange(len(pieces)), counts)
    start = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
    base = np.cumsum(sizes) - sizes
    return which, start, whole[base[which] + start]


def _grouped_hits(pieces: DataFrame, threshold: int) -> DataFrame:
    """Repeated windows of digits with few runs: a digit's runs meet in a task."""
    names = ("doc_id", "dk", "s1", "digit", "alone", "piece")

    def solve(rows):
        which, start, h = window_hashes(rows["piece"], threshold)
        digit = np.array(rows["digit"], np.int64).view(np.uint64)
        key = (h ^ digit[which]) * _STEPS[3]
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        hit = np.flatnonzero(twice & np.array(rows["alone"], bool)[which])
        if not len(hit):
            return None
        new = np.append(True, (np.diff(which[hit]) != 0) | (np.diff(start[hit]) != 1))
        head, tail = hit[new], hit[np.append(new[1:], True)]
        at = np.array(rows["s1"], np.int64)[which[head]]
        pick = which[head].tolist()
        return {"doc_id": [rows["doc_id"][i] for i in pick], "dk": [rows["dk"][i] for i in pick],
                "a": at + start[head], "b": at + start[tail] + threshold}

    def run(batches):
        held = {c: [] for c in names}
        for batch in batches:
            for c in names:
                held[c] += batch.column(c).to_pylist()
            last = held["digit"][-1]
            whole = held["digit"].index(last)  # rows are sorted: all before are complete groups
            while whole:
                upto, size = 0, 0
                while upto < whole and (size < SPAN or held["digit"][upto] == held["digit"][upto - 1]):
                    size += len(held["piece"][upto])
                    upto += 1
                out = solve({c: held[c][:upto] for c in names})
                held = {c: held[c][upto:] for c in names}
                whole -= upto
                if out:
                    yield out
        if held["digit"]:
            out = solve(held)
            if out:
                yield out

    dealt = pieces.repartition("digit").sortWithinPartitions("digit").select(*names)
    return map_arrow(dealt, "doc_id long, dk long, a long, b long", run)


def _hot_hits(pieces: DataFrame, threshold: int) -> DataFrame:
    """Repeated windows of digits with many runs: a row for each window."""
    def explode(batches):
        for batch in batches:
            texts = batch.column("piece").to_pylist()
            for a, b in spans_of(texts, SPAN):
                which, start, h = window_hashes(texts[a:b], threshold)
                pick = pa.array(which + a)
                yield {c: batch.column(c).take(pick) for c in ("doc_id", "dk", "digit", "alone")} | {
                    "a": np.array(batch.column("s1"))[which + a] + start, "w": h.view(np.int64)}
    rows = map_arrow(pieces, "doc_id long, dk long, digit long, alone boolean, a long, w long", explode)
    twice = stored(rows.groupBy("digit", "w").agg(F.count("a").alias("n")).where("n > 1").select("digit", "w"), "windows")
    near = marked(rows.where("alone"), twice, "w").where("hit")
    return (near.join(twice, ["digit", "w"], "left_semi")
            .select("doc_id", "dk", "a", (F.col("a") + threshold).alias("b")))


def _merged(found: list[dict]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted((x["a"], x["b"]) for x in found):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD,
                   seed: int = SEED, group: int = GROUP, with_bytes: bool = False) -> DataFrame:
    """One row per document row: doc_id, n_bytes, n_removed, n_spans, spans
    (array of [start, end)), kept_sha256, and with ``with_bytes`` what is left
    (kept, binary). Digits with over ``group`` distinct runs are compared
    window by window as rows, the others within a task."""
    if seed & (seed - 1) or not 1 <= seed <= threshold or threshold - seed >= 1023:
        raise ValueError("seed: a power of two, threshold - 1022 to threshold")
    keyed = _keyed(docs, id_col, text_col)
    first = stored(all_runs(keyed, threshold, seed), "runs")
    digits = first.groupBy("digit").agg(F.count("dk").alias("n")).where("n > 1").select("digit")
    every = stored(marked(first, digits, "digit").where("hit").drop("hit"), "runs-met")
    place = F.struct("doc_id", "dk", "s1", "shape")
    kinds = stored(every.groupBy("digit", "bytes_key").agg(F.count("dk").alias("n"), F.min(place).alias("at")), "run-kinds")
    shared = kinds.groupBy("digit").agg(F.count("n").alias("kinds")).where("kinds > 1")
    wanted = kinds.join(shared, "digit").select("digit", "at.*", (F.col("n") == 1).alias("alone"), (F.col("kinds") > group).alias("hot"))
    pieces = stored(_pieces(keyed, wanted, threshold), "run-bytes")
    copies = (every.join(kinds.where("n > 1").select("digit", "bytes_key"), ["digit", "bytes_key"], "left_semi")
              .select("doc_id", "dk", F.col("s1").cast("long").alias("a"),
                      (F.col("s1") + F.floor(F.col("shape") / 1024) - 1 + threshold).alias("b")))
    hits = copies.union(_grouped_hits(pieces.where("not hot"), threshold)).union(_hot_hits(pieces.where("hot"), threshold))
    found = hits.groupBy("doc_id", "dk").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    spans = stored(map_batches(found, lambda cols: cols | {"spans": [_merged(x) for x in cols["spans"]]},
                               "doc_id long, dk long, spans array<array<long>>"), "spans")
    docs = marked(keyed, spans, "dk")
    near, whole = docs.where("hit"), docs.where("not hit")
    spans = spans.select(F.col("doc_id").alias("id2"), F.col("dk").alias("dk2"), "spans")
    both = near.join(spans, (near["dk"] == spans["dk2"]) & near["doc_id"].eqNullSafe(spans["id2"]), "left").select("doc_id", "text", "spans")
    both = both.union(whole.select("doc_id", "text", F.lit(None).cast(spans.schema["spans"].dataType)))

    def cut(cols):
        out = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept_sha256", "kept")}
        for doc_id, text, gone in zip(cols["doc_id"], cols["text"], cols["spans"]):
            raw, gone = (text or "").encode(), gone or []
            edges = [0, *(x for s in gone for x in s), len(raw)]
            kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
            for k, v in (("doc_id", doc_id), ("n_bytes", len(raw)), ("n_removed", len(raw) - len(kept)), ("n_spans", len(gone)),
                         ("spans", gone), ("kept_sha256", hashlib.sha256(kept).hexdigest()), ("kept", kept if with_bytes else None)):
                out[k].append(v)
        return out
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<array<long>>, kept_sha256 string"
    return map_batches(both, cut, schema + ", kept binary" * with_bytes)
