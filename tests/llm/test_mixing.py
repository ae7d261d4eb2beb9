import numpy as np
import pytest
from pyspark.sql import functions as F

from courtside.llm.mixing import KEEP, kept_share, rates, sample, topic, with_rates


def brute(mass, wants, rounds=4000):
    w = np.array(mass, float)
    w /= w.sum()
    for _ in range(rounds):
        for axis, want in enumerate(wants):
            rest = tuple(i for i in range(w.ndim) if i != axis)
            have = w.sum(axis=rest, keepdims=True)
            shape = [1] * w.ndim
            shape[axis] = -1
            w = w * np.reshape(want, shape) / have
    return w


def texts(rng, n):
    out = []
    for i in range(n):
        body = " ".join(["w"] * int(rng.integers(1, 30)))
        out.append((i, body + (" a | b" if rng.random() < 0.3 else ""), ["en", "fr", None][int(rng.integers(3))],
                    "hot" if rng.random() < 0.5 else f"s{rng.integers(4)}"))
    return out


def test_matches_raking_by_hand(docs_of):
    rows = texts(np.random.default_rng(1), 600)
    found = with_rates(docs_of(rows), alpha=0.5).collect()
    names = [sorted({r[c] or "" for r in found}) for c in ("source", "lang", "topic")]
    cell = {(r.source, r.lang or "", r["topic"]): r["weight"] for r in found}
    mass = np.zeros([len(x) for x in names])
    for r in found:
        at = tuple(x.index(v) for x, v in zip(names, (r.source, r.lang or "", r["topic"])))
        mass[at] += len(r.row.text.split())
    share = [mass.sum(axis=tuple(i for i in range(3) if i != a)) ** 0.5 for a in range(3)]
    fitted = brute(mass, [s / s.sum() for s in share]) / (mass / mass.sum())
    for key, w in cell.items():
        at = tuple(x.index(v) for x, v in zip(names, key))
        assert w == pytest.approx(fitted[at], rel=1e-6)
    top = max(cell.values())
    assert all(r["probability"] == pytest.approx(r["weight"] / top) for r in found)


def test_sample_follows_the_probabilities(docs_of):
    rows = [(i, "one two three", "en", "hot" if i % 4 else "rare") for i in range(8000)]
    kept = sample(docs_of(rows), targets={"source": {"hot": 1, "rare": 1}})
    n = {r.source: r["count"] for r in kept.groupBy("source").count().collect()}
    assert n["rare"] == 2000 and 1850 < n["hot"] < 2150
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_odd_rows_and_empty(docs_of, odd_rows, spark):
    docs = docs_of(odd_rows).selectExpr("*", "1 as weight", "2 as topic", "3 as fitted", "4 as `__source`", "5 as `__draw`", "6 as p", "7 as sampled", "8 as `row`")
    found = with_rates(docs).collect()
    assert len(found) == len(odd_rows) and all(0 <= r["probability"] <= 1 for r in found)
    kept = sample(docs, keep=1.0)
    assert kept.columns == docs.columns and {tuple(r) for r in kept.collect()} <= {tuple(r) for r in docs.collect()} and kept.count() > 0
    assert sample(docs.where("false")).count() == 0
    kinds = spark.sql("select cast(null as string) t union all select 'a | b' union all select 'plain'")
    assert [r[0] for r in kinds.select(topic(F.col("t"))).collect()] == ["none", "table", "prose"]


def test_a_tiny_cell_does_not_thin_out_the_corpus(docs_of):
    rows = [(i, "w " * 20, ["en", "fr"][i % 3 == 0], f"s{i % 4}") for i in range(3000)] + [(9000, "w " * 20, None, "s1")]
    found = rates(docs_of(rows))
    cells = found.collect()
    assert kept_share(found) == pytest.approx(KEEP, rel=1e-4)
    tiny = [r for r in cells if r.lang is None]
    assert [r.probability for r in tiny] == [pytest.approx(1)] and all(0 < r.probability <= 1 for r in cells)
    # the others still meet their targets, in proportion
    total = sum(r.mass for r in cells)
    kept = {v: sum(r.mass * r.probability for r in cells if r.lang == v) / total for v in ("en", "fr")}
    own = {v: sum(r.mass for r in cells if r.lang == v) / total for v in kept}
    assert kept["en"] / kept["fr"] == pytest.approx((own["en"] / own["fr"]) ** 0.8, rel=1e-3)


def test_targets_that_no_mix_meets_keep_the_budget(docs_of):
    rows = [(i, "w w w", "en", "big") for i in range(900)] + [(2000 + i, "w w w", "fr", "small") for i in range(10)]
    found = rates(docs_of(rows), targets={"source": {"small": 1, "big": 1}, "lang": {"en": 9, "fr": 1}})
    assert kept_share(found) == pytest.approx(KEEP, rel=1e-3)
    assert all(r.probability <= 1 for r in found.collect())
