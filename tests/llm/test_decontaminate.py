import random

import pytest

from courtside.llm.decontaminate import MIN_WORDS, RECALL, Items, best_stretch, drop_leaks, leaks, word_ids


def edited(rng, item, k):
    out = list(item)
    for _ in range(k):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[at] = f"edit{rng.random()}"
        elif kind == 1:
            out.insert(at, f"new{rng.random()}")
        else:
            del out[at]
    return out


def distance(item, doc):
    """Edit distance of item against the nearest stretch of doc, by the book."""
    cost = [0] * (len(doc) + 1)
    for i, w in enumerate(item, 1):
        below = cost
        cost = [i] + [0] * len(doc)
        for j, v in enumerate(doc, 1):
            cost[j] = min(below[j - 1] + (w != v), below[j] + 1, cost[j - 1] + 1)
    return min(cost)


@pytest.mark.parametrize("n, times", [(5, 200), (9, 100), (10, 100), (15, 100), (19, 100), (20, 100), (30, 100), (50, 60),
                                      (200, 40), (400, 20), (1000, 6)])
def test_recall_at_the_full_edit_bound(words, n, times):
    rng = random.Random(n)
    found = 0
    for _ in range(times):
        item = rng.choices(words, k=n)
        doc = rng.choices(words, k=rng.randrange(80)) + edited(rng, item, n // 5) + rng.choices(words, k=40)
        found += bool(Items([(1, " ".join(item))], 0.8).leaks([" ".join(doc)])[0])
    assert found >= RECALL * times


def test_lsh_keys_are_the_only_source_of_candidates(words):
    text = " ".join(words[:60])
    items = Items([(1, " ".join(words[10:50])), (2, " ".join(words[100:140]))], 0.8)
    assert {(t, k) for t, k, _ in items.candidates([word_ids("x"), word_ids(text)])} == {(1, 0)}
    assert items.leaks([text]) == [[(1, 40, 0, 10, 50)]]
    items.keys = items.keys + items.keys.dtype.type(1)
    assert items.leaks([text]) == [[]]


def test_walks_end_with_their_text_and_chunks_do_not_matter(words, monkeypatch):
    from courtside.llm import decontaminate
    rng = random.Random(8)
    benchmark = [(i, " ".join(rng.choices(words, k=rng.randrange(5, 70)))) for i in range(40)]
    texts = [" ".join(rng.choices(words, k=rng.randrange(50)) + edited(rng, t.split(), 1) + rng.choices(words, k=rng.randrange(50)))
             for _, t in benchmark] + [None, "", benchmark[0][1], " ".join(words)]
    items = Items(benchmark, 0.8)
    whole = items.leaks(texts)
    assert whole == [items.leaks([t])[0] for t in texts]
    assert [(0, 0)] == [(f[0], f[2]) for f in whole[42]]
    monkeypatch.setattr(decontaminate, "CHUNK", 37)
    assert items.leaks(texts) == whole


def test_leaks_against_brute_force(words):
    """Every text against every item by the book, edits from none to past the bound."""
    rng = random.Random(9)
    benchmark = [(i, " ".join(rng.choices(words, k=rng.randrange(5, 60)))) for i in range(25)]
    texts = []
    for _, t in benchmark:
        item = t.split()
        texts.append(" ".join(rng.choices(words, k=20) + edited(rng, item, rng.randrange(len(item) // 3 + 1)) + rng.choices(words, k=20)))
    got = Items(benchmark, 0.8).leaks(texts)
    for text, found in zip(texts, got):
        true = {i: distance(t.split(), text.split()) for i, t in benchmark}
        assert {f[0]: f[2] for f in found} == {i: d for i, d in true.items() if d <= len(benchmark[i][1].split()) // 5}


def test_verdicts_are_exact_on_a_small_vocabulary():
    rng = random.Random(6)
    missed = 0
    for _ in range(150):
        n = rng.randrange(MIN_WORDS, 16)
        item = rng.choices("abcdefgh", k=n)
        doc = rng.choices("abcdefgh", k=20) + edited(rng, item, rng.randrange(n // 2)) + rng.choices("abcdefgh", k=20)
        true = distance(item, doc)
        got = Items([(1, " ".join(item))], 0.8).leaks([" ".join(doc)])[0]
        assert best_stretch(word_ids(" ".join(item)), word_ids(" ".join(doc)))[0] == true
        assert not got or got[0][2] == true <= n // 5
        missed += not got and true <= n // 5
    assert missed <= 3


def test_table_with_odd_rows(docs_of, odd_rows, spark, words):
    item = " ".join(words[:20])
    near = " ".join(["intro", *words[:4], "changed", *words[5:20], "outro"])
    rows = odd_rows + [(20, "Lead. " + item.upper() + " tail"), (21, near), (21, near), (22, " ".join(words[:9])), (23, "two words")]
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (None, item), (4, "two words"), (5, "words")],
                                  "item_id long, text string").selectExpr("*", "1 as doc_id", "2 as k1")
    docs = docs_of(rows).selectExpr("*", "0 as item_id", "0 as k1", "0 as distance")
    got = sorted((r.doc_id, r.item_id or 0, r.distance) for r in leaks(docs, bench).collect())
    assert got == [(20, 0, 0), (20, 1, 0), (21, 0, 1), (21, 0, 1), (21, 1, 1), (21, 1, 1), (23, 4, 0)]
    left = drop_leaks(docs, bench)
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(r[0]) for r in odd_rows + [(22, "")])
    assert leaks(docs, bench.where("false")).count() == 0
    assert drop_leaks(docs.where("false"), bench).count() == 0


def test_blocks_do_not_change_the_result(docs_of, spark, words, monkeypatch):
    from courtside.llm import decontaminate
    items = [(i, " ".join(words[i * 10:i * 10 + 12])) for i in range(30)]
    docs = docs_of([(i, "x y z " + t + " q") for i, t in items])
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(tuple(r) for r in leaks(docs, bench).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 500)
    assert sorted(tuple(r) for r in leaks(docs, bench).collect()) == whole
    assert {(r[2], r[3]) for r in whole} >= {(i, i) for i, _ in items}
