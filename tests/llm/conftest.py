import random

import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text) or (doc_id, text, lang, source)."""
    def make(rows):
        full = [(*r, "en", "src0")[:4] if len(r) == 2 else r for r in rows]
        return spark.createDataFrame([(*r, len(r[1] or "")) for r in full], DOC_SCHEMA)
    return make


@pytest.fixture(scope="session")
def words():
    rng = random.Random(7)
    return ["".join(rng.choice("abcdefghiklmnoprstuvz") for _ in range(rng.randint(2, 9))) for _ in range(3000)]


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, repeated rows, a long text, ties."""
    long = " ".join(f"word{i % 997} tail{i}" for i in range(15000))
    return [(None, None), (None, "an orphan text"), (1, None), (2, ""), (3, " \n\t "), (4, "tie"), (4, "tie"),
            (5, "tie"), (6, long), (7, long + " more"), (8, "Ünïcode ß 日本 text"), (9, "x" * 50000)]
