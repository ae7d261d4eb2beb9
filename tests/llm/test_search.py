"""Ranked search against plain scoring of every document for every query."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from courtside.llm import search

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERMS.findall((text or "").translate(LOWER))


def by_hand(docs, items, k):
    held = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, q in asked.items():
        rows = []
        for d, c in held:
            m = 50 + 50 * c.total() * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m)) for t in q if t in c)
            if s > 0:
                rows.append((-s, d is not None, d or 0, d))
        out += [(i, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(rows)[:k])]
    return sorted(out, key=repr)


def found(spark, docs, items, k=search.TOP, **options):
    index = search.build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    got = search.search(index, spark.createDataFrame(items, "item_id long, text string"), k, **options)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.schema["rank"].dataType.simpleString() == "int"
    return sorted((tuple(r) for r in got.collect()), key=repr)


@pytest.fixture(scope="module")
def corpus(words):
    rng = random.Random(11)
    weights = [1 / (i + 1) for i in range(400)]
    docs = [(i, " ".join(rng.choices(words[:400], weights, k=rng.randint(1, 300)))) for i in range(900)]
    docs += [(1000 + i, docs[3][1]) for i in range(70)]  # copies: ties beyond the 50th
    items = [(i, " ".join(rng.choices(words[:400], weights, k=25))) for i in range(30)] + [(99, docs[3][1]), (98, words[0])]
    return docs, items


def test_equals_scoring_every_document(spark, corpus):
    assert found(spark, *corpus) == by_hand(*corpus, 50)


def test_small_chunks_blocks_and_k(spark, corpus):
    assert found(spark, *corpus, k=3, block_terms=40, cells=1) == by_hand(*corpus, 3)  # 64 documents a chunk


def test_odd_rows(spark, odd_rows):
    rows = odd_rows + [(10, "TIE tie Tie ı İ ÀÉ àé"), (11, "a\x7fb{c}[d]`e`@f:g/1_2"), (12, "ſtraße Kelvin K")]
    items = [(0, "tie orphan text"), (1, None), (2, ""), (None, "tie word1"), (3, "ünïcode Ünïcode 日本"), (4, "x" * 50000), (0, "tail5"), (5, "a b c d e f g 1 2"),
             (6, "ſtraße strasse K k İ i")]
    assert found(spark, rows, items) == by_hand(rows, items, 50)


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")]) == [] and found(spark, [(1, "a")], []) == [] and found(spark, [(1, " "), (2, None)], [(1, "a")]) == []


def test_common_terms_weigh_nothing(spark):
    docs = [(i, "the same words") for i in range(2000)]
    assert found(spark, docs, [(1, "the words")], k=5) == by_hand(docs, [(1, "the words")], 5)


def test_extra_columns_with_clashing_names(spark):
    docs = spark.createDataFrame([(7, "alpha beta", "x", 3, 4)], "doc_id long, text string, term string, n int, score int")
    items = spark.createDataFrame([(1, "beta", 5, "z")], "item_id long, text string, doc_id int, terms string")
    assert [(r.item_id, r.rank, r.doc_id) for r in search.search(search.build_index(docs), items).collect()] == [(1, 1, 7)]


def test_reading_stops_early_and_is_exact():
    """One chunk: few documents are scored, and the best are right, ties by id."""
    rng = np.random.default_rng(5)
    n, lists = 4000, 4
    impact = (rng.pareto(1.2, (lists, n)) * 1000).astype(np.int64) + 1
    impact[:, :200] //= 7
    doc, term = np.tile(np.arange(n), lists), np.repeat(np.arange(lists), n)
    ids = rng.permutation(n)
    chunk = search.Chunk(ids, np.ones(n, bool), doc, term, impact.ravel(), lists)
    best = search.Best(10)
    scored = chunk.rank(np.arange(lists), best)
    total = impact.sum(axis=0)
    want = sorted(zip(-total, ids))[:10]
    assert [(-s, d) for s, d in zip(best.score, best.doc)] == want
    assert scored < n / 2
    # a second chunk whose bound is below the k-th best is not read at all
    assert search.Chunk(ids, np.ones(n, bool), doc, term, np.ones(lists * n, np.int64), lists).rank(np.arange(lists), best) == 0
