import random
import re

import pytest
from pyspark.sql import functions as F

from courtside.llm.quality import COUNTS, keep_good, measure, quality
from tests.conftest import SF_SMALL


def by_hand(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    at = {}
    for i in range(len(words) - 4):
        at.setdefault(tuple(words[i:i + 5]), []).append(i)
    covered = {i + j for v in at.values() if len(v) > 1 for i in v for j in range(5)}
    seen, copies = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            copies += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), copies, len(covered))


def test_counts_match_a_plain_reading():
    rng = random.Random(2)
    parts = ["a", "b", "ü", "日本", "\n", "\n\n", " ", "\t", " ", " ", "#", "*x", "a b c d e ", "\x0b", "\x0c", "\x1c", "\x85", "\r\n"]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(80)))
        assert measure(text)[:5] == by_hand(text), repr(text)
    assert measure(None) == (0,) * len(COUNTS) == measure("")


def test_verdicts_follow_held_back_labels(spark):
    docs = spark.read.parquet(f"{SF_SMALL[:-5]}0.01/documents.parquet")
    labels = spark.read.parquet(f"{SF_SMALL[:-5]}0.01/labels.parquet").select("doc_id", F.col("quality").alias("q"))
    found = quality(docs).join(labels, "doc_id").select("q", "kept", "base_failed").collect()
    good = [r for r in found if r.q == 1 and not r.base_failed]
    junk = [r for r in found if r.q == 0]
    assert sum(r.kept for r in good) >= 0.99 * len(good)
    assert sum(not r.kept for r in junk) >= 0.95 * len(junk)


def test_odd_rows(docs_of, odd_rows, spark):
    docs = docs_of(odd_rows).selectExpr("*", "1 as k1", "2 as pattern", "3 as kept")
    found = quality(docs).collect()
    assert len(found) == len(odd_rows)
    assert all(r.base_failed and not r.kept for r in found if r.n_words < 10)
    left = keep_good(docs)
    assert left.columns == docs.columns
    assert left.count() == sum(r.kept for r in found)
    assert quality(docs.where("false")).count() == keep_good(docs.where("false")).count() == 0
