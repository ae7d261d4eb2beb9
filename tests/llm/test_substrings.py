import hashlib
import random

import pytest
from pyspark.sql import functions as F

from courtside.llm import substrings
from courtside.llm.substrings import remove_repeats


def brute(texts, width):
    """Removed byte positions of each text."""
    at = {}
    raws = [(t or "").encode() for t in texts]
    for d, raw in enumerate(raws):
        for i in range(len(raw) - width + 1):
            at.setdefault(raw[i:i + width], []).append((d, i))
    gone = [set() for _ in texts]
    for places in at.values():
        if len(places) > 1:
            for d, i in places:
                gone[d] |= set(range(i, i + width))
    return raws, gone


def expect(rows, width):
    raws, gone = brute([t for _, t in rows], width)
    out = []
    for (i, _), raw, g in zip(rows, raws, gone):
        spans = sum(1 for x in g if x - 1 not in g)
        out.append((i, len(raw), len(g), spans, hashlib.sha256(bytes(b for x, b in enumerate(raw) if x not in g)).hexdigest()))
    return sorted(out, key=repr)


def run(docs, width, **params):
    found = remove_repeats(docs, threshold=width, **params).collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found), key=repr)


def corpus(rng, words, n, passage):
    shared = [" ".join(rng.choices(words, k=passage)) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [" ".join(rng.choices(words, k=rng.randrange(60)))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(shared)
            a = rng.randrange(len(p) // 2)
            parts += [p[a:a + rng.randrange(len(p))], " ".join(rng.choices(words, k=rng.randrange(40)))]
        rows.append((i, "é".join(parts)))
    return rows + [(1000 + i, t) for i, (_, t) in enumerate(rng.sample(rows, 5))] + [(2000, "ab" * 300), (2001, "z" * 500), (2002, "aab" * 40)]


@pytest.mark.parametrize("width,seed,group", [(400, 64, 256), (60, 16, 256), (60, 16, 1), (33, 1, 2)])
def test_matches_brute_force(docs_of, words, width, seed, group):
    rows = corpus(random.Random(width + group), words[:200], 70, 90 if width == 400 else 25)
    assert run(docs_of(rows), width, seed=seed, group=group) == expect(rows, width)


def test_odd_rows(docs_of, odd_rows, words):
    text = " ".join(words[:120])
    rows = odd_rows + [(20, text[:399]), (21, text[:399]), (22, text[:400] + "q"), (23, "r" + text[:400]), (None, text[500:950]), (24, text[480:930]),
                       (25, text[1:] + text[1:])]
    docs = docs_of(rows).selectExpr("*", "1 as dk", "2 as digit", "3 as spans")
    assert run(docs, 400) == expect(rows, 400)
    kept = {r.doc_id: bytes(r.kept) for r in remove_repeats(docs, with_bytes=True).collect()}
    assert kept[22] == b"q" and kept[23] == b"r"
    assert remove_repeats(docs.where("false")).count() == 0


def test_planted_passages_fall_by_their_bytes_alone(docs_of, words):
    """Passages of over 50 words in two documents each: from 400 bytes on they are
    taken whole, shorter ones and documents without any stay, and n_bytes is the
    size of the input whatever was removed."""
    rng = random.Random(12)
    rows, held = [], {}
    for i in range(0, 80, 2):
        passage = " ".join(rng.choices(words, k=51 + i))
        held[i] = held[i + 1] = len(passage)
        rows += [(i + k, f"{i}<{k} " + " ".join(rng.choices(words, k=40)) + f" {k}[{passage}]{k} {i}") for k in range(2)]
    rows += [(100 + i, f"{i} " + " ".join(rng.choices(words, k=150))) for i in range(20)]
    found = {r.doc_id: r for r in remove_repeats(docs_of(rows)).collect()}
    assert 10 < sum(n >= 400 for n in held.values()) and 1 < sum(n < 398 for n in held.values())
    for i, text in rows:
        n = held.get(i, 0)
        assert found[i].n_bytes == len(text.encode())
        if n >= 400:
            assert n <= found[i].n_removed <= n + 2 and found[i].n_spans == 1
        elif n < 398:  # the brackets around a passage repeat with it
            assert found[i].n_removed == 0 and found[i].kept_sha256 == hashlib.sha256(text.encode()).hexdigest()


def shuffle_files(spark):
    """Sizes of the shuffle files that this process holds, by name."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    found = [files.apply(i) for i in range(files.size())]
    return {f.getName(): f.length() for f in found if f.getName().startswith("shuffle_")}


def test_texts_without_repeats_are_not_shuffled(spark, docs_of):
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables too large for it
    rng = random.Random(5)
    rows = [(i, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=5000))) for i in range(400)]
    rows += [(1000 + i, f"{i} {rows[i][1][100:1200]} {i}") for i in range(5)]
    before = shuffle_files(spark)
    try:
        found = {r.doc_id: r.n_removed for r in remove_repeats(docs_of(rows)).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    written = sum(n for name, n in shuffle_files(spark).items() if name not in before)
    assert sum(n > 0 for n in found.values()) == 10 and len(found) == len(rows)
    assert 0 < written < sum(len(t) for _, t in rows) / 3


def test_marked_holds_every_key_and_few_others(spark):
    rows = spark.range(-20000, 20000).select(F.xxhash64("id").alias("k"), "id")
    keys = rows.where("id % 20 = 0").select("k")
    found = {r.id: r.hit for r in substrings.marked(rows, keys.union(keys), "k").collect()}
    assert len(found) == 40000 and all(found[i] for i in range(-20000, 20000, 20))
    assert sum(found.values()) < 2100
    assert not any(r.hit for r in substrings.marked(rows, keys.where("false"), "k").collect())


@pytest.mark.parametrize("group", [256, 1])
def test_full_bitmaps_change_no_row(docs_of, words, odd_rows, monkeypatch, group):
    monkeypatch.setattr(substrings, "marked", lambda rows, keys, col: rows.withColumn("hit", F.lit(True)))
    rows = corpus(random.Random(group), words[:200], 40, 25) + odd_rows
    assert run(docs_of(rows), 60, seed=16, group=group) == expect(rows, 60)
