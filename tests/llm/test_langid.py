import numpy as np
import pytest
import zlib
from pyspark.sql import functions as F

from courtside.llm import langid
from courtside.llm.langid import BUCKETS, Model, distinct, grams, identify, predict, train
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_SMALL[:-5]}0.01/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return train(docs, per_lang=120)


def test_held_out_accuracy_and_calibration(docs, model):
    found = predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in found if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    right = [r.lang == r.lang_pred for r in held]
    assert np.mean(right) >= 0.97
    assert abs(np.mean([r.score for r in held]) - np.mean(right)) < 0.05
    assert all(0 <= r.score <= 1 for r in found)


def test_sparse_and_text_only(docs, model):
    assert (model.table == 0).mean() > 0.3
    other = docs.withColumn("lang", F.lit("xx")).withColumn("doc_id", F.col("doc_id") + 100000)
    pick = lambda d: sorted((r.lang_pred, round(r.score, 9)) for r in predict(d, model).collect())
    assert pick(other) == pick(docs)


def test_predict_matches_tf_idf_by_hand(model):
    text = "Ein kurzer Text mit ein paar Wörtern, ein Text."
    h = grams(text)
    at, n = np.unique(h, return_counts=True)
    x = np.zeros(BUCKETS)
    x[at] = n / len(h)
    logits = (x @ model.table.astype(float) + model.bias) / model.heat
    p = langid.softmax(logits)
    lang, score = model.predict(text)
    assert lang == model.langs[p.argmax()] and score == pytest.approx(p.max(), rel=1e-6)
    assert sorted(distinct(h, np.empty(BUCKETS, np.int64)).tolist()) == at.tolist()


def test_odd_rows(docs_of, odd_rows, model):
    docs = docs_of(odd_rows + [(50, "1234 !!")]).selectExpr("*", "1 as held_out", "2 as fit", "3 as rest")
    found = predict(docs, model).collect()
    assert len(found) == len(odd_rows) + 1
    by = {r.doc_id: r for r in found}
    assert all((by[i].lang_pred, by[i].score) == ("und", 0.0) for i in (1, 2, 3, 50)) and by[6].lang_pred in model.langs


def test_nothing_to_learn(docs_of):
    docs = docs_of([(1, "some text", None, "s"), (2, None, "en", "s")])
    assert {(r.lang_pred, r.score) for r in identify(docs).collect()} == {("und", 0.0)}
    assert identify(docs.where("false")).count() == 0
    assert Model([], None, None, 1.0).predict("x") == ("und", 0.0)


def test_texts_without_a_letter_are_und(docs_of, model):
    """Numerals that are no digits, symbols and marks are no letters, in
    learning and in prediction alike."""
    import unicodedata
    odd = ["½", "² ① 12", "Ⅷ", "٣ ४", "\u0301\u0308", "😀 € ∑", "___ 7_", "☃ ⓐ", "ª", "ʰ", "ǅ", "日", "1a", "ſ", "ß ½"]
    want = {t: any(unicodedata.category(c)[0] == "L" for c in t) for t in odd}
    found = {odd[r.doc_id]: r for r in predict(docs_of(list(enumerate(odd))), model).collect()}
    assert {t: r.lang_pred != "und" for t, r in found.items()} == want
    assert all(r.score == 0.0 for t, r in found.items() if not want[t])
    chars = [chr(i) for i in range(0x3000) if unicodedata.category(chr(i)) not in ("Cn", "Cs")]
    assert {c for c in chars if langid.has_letter(c)} == {c for c in chars if unicodedata.category(c)[0] == "L"}


def test_texts_without_a_letter_are_not_learned_from(docs_of):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5]
    docs = docs_of([(i, "½ Ⅷ 12", "xx", "s") for i in ids[:20]] + [(i, f"some words {i}", "en", "s") for i in ids[20:60]])
    assert langid.train(docs).langs == ["en"]
