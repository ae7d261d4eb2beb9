import random

import numpy as np
import pytest
import xxhash

from courtside.llm import simhash
from courtside.llm.common import components
from courtside.llm.simhash import drop_near_duplicates, fingerprint, links, simhash_components


def by_hand(text, k=3):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text)) if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    out = 0
    for b in range(64):
        ones = sum(xxhash.xxh64_intdigest(g.encode(), 42) >> b & 1 for g in grams)
        out |= (2 * ones > len(grams)) << b
    return out


@pytest.mark.parametrize("text", ["", " \n", "one", "two Words", "É É É a a a a", "a b c d e f g a b c", "x " * 300])
def test_fingerprint(text):
    assert fingerprint(text) & (1 << 64) - 1 == by_hand(text)


def brute(values, distance=3):
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in values:
        for b in values:
            if (a ^ b) & (1 << 64) - 1 and bin((a ^ b) & (1 << 64) - 1).count("1") <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def near(rng, n, flips):
    """Random fingerprints, each with a neighbour so many bits away."""
    out = set()
    for _ in range(n):
        v = rng.getrandbits(64)
        w = v
        for b in rng.sample(range(64), flips):
            w ^= 1 << b
        out |= {v, w}
    return sorted(np.array(list(out), np.uint64).view(np.int64).tolist())


@pytest.mark.parametrize("distance,limit", [(0, 4096), (1, 4096), (2, 4096), (3, 4096), (3, 1)])
def test_links_join_what_is_near(spark, distance, limit):
    rng = random.Random(distance)
    values = sorted({v for flips in (1, 2, 3, 4) for v in near(rng, 40, flips)} | {0, -1, 1, 7, 15})
    # a dense cluster: one low half, many high halves a few bits around another
    base = rng.getrandbits(64)
    dense = {base ^ sum(1 << b for b in rng.sample(range(32, 64), rng.randrange(5))) for _ in range(60)}
    values = sorted(set(values) | set(np.array(list(dense), np.uint64).view(np.int64).tolist()))
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    found = links(fps, distance, limit)
    root = {r.node: r.root for r in components(found).collect()}
    assert {v: root.get(v, v) for v in values} == brute(values, distance)
    assert all(bin((r.a ^ r.b) & (1 << 64) - 1).count("1") <= distance for r in found.collect())


def test_components_of_a_long_path(spark):
    n = 300
    edges = [(i, i + 1) for i in range(n)] + [(1000, 1001), (2000, 2000)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {1000: 1000, 1001: 1000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(docs_of, odd_rows):
    docs = docs_of(odd_rows).selectExpr("*", "1 as fp", "2 as component_id", "3 as root")
    found = simhash_components(docs).collect()
    assert len(found) == len(odd_rows)
    label = {(r.doc_id, r.fp & (1 << 64) - 1): r.component_id for r in found}
    assert label[(1, 0)] == label[(2, 0)] == label[(3, 0)] == label[(None, 0)] == 1
    tie = by_hand("tie")
    assert label[(4, tie)] == label[(5, tie)] == 4
    left = drop_near_duplicates(docs)
    assert left.columns == docs.columns
    # one row of each component: 1 of the wordless, 4 of the ties, the orphan
    assert sorted(r.doc_id or -1 for r in left.collect()) == [-1, 1, 4, 6, 8, 9]
    assert [r.text for r in left.collect() if r.doc_id is None] == ["an orphan text"]
    assert drop_near_duplicates(docs.where("false")).count() == 0
    assert simhash.fingerprint(None) == 0


def test_one_row_of_each_component_stays(spark):
    """Null ids, rows that repeat an id, a text or both, texts of one id in
    several components: held against plain linking of all rows."""
    rng = random.Random(8)
    base = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 5) for _ in range(40)) for _ in range(12)]
    texts = base + [b + " x" for b in base] + [b.replace(" ", "  ", 3) for b in base] + [None, "", " "]
    rows = [(rng.choice([None, *range(15)]), rng.choice(texts), rng.randint(0, 2)) for _ in range(160)]
    rows += [(None, base[0], 1)] * 20 + [(3, base[1], 0)] * 9
    docs = spark.createDataFrame(rows, "doc_id long, text string, k1 long").selectExpr("*", "5 as `__doc_id`", "6 as `__K1`", "7 as again")
    left = drop_near_duplicates(docs.repartition(4))
    assert left.columns == docs.columns
    prints = [by_hand(t or "") for _, t, _ in rows]
    root = brute(sorted(set(prints)), 3)
    want = {}
    for (i, t, _), p in zip(rows, prints):
        key = root[p]
        want[key] = min(want.get(key, (2, 0)), (i is None, i or 0))
    got = [(root[by_hand(r.text or "")], (r.doc_id is None, r.doc_id or 0)) for r in left.collect()]
    assert sorted(got) == sorted(want.items())
    assert all((r.doc_id, r.text, r.k1) in rows for r in left.collect())
