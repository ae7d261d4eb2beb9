"""Operator 3: language identification by sparse multinomial logistic regression.

Features are character 1- to ``ORDERS``-grams of the lower-cased whole text,
hashed to ``BUCKETS``, weighted by relative frequency times inverse document
frequency. The weights are trained with follow-the-regularised-leader
(proximal, per coordinate) under elastic-net penalties, and the temperature of
the final probabilities is fitted on labelled documents kept out of training.

Document frequencies cover every training document. The classifier itself is
fitted on a bounded sample of them: ``PER_LANG`` documents or so of each
language, drawn by a hash of (id, text); their whole texts become sparse vectors
in the tasks and only those reach the driver.

Rows may be learned from if their label isn't null and crc32(id as text) mod 5
isn't 0 (a null id has no such remainder: not learned from, not held out). A
text that is null or has no letter is ``und`` with score 0, and so is every
text when nothing could be learned. Ties go to the language first in order.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.llm.common import map_batches

ORDERS = 3
BUCKETS = 1 << 16
PER_LANG = 1500
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.8, 1.0, 0.02, 0.02
SCALE = 30.0      # of the features, so that penalties and rates suit frequencies
NEVER = "und"
_letter = regex.compile(r"\p{L}")   # Unicode's letters: no numerals, marks or symbols
_MULT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def grams(text: str | None) -> np.ndarray:
    """Feature numbers of all n-grams of a text, in no particular order."""
    code = np.frombuffer((" " + (text or "").lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    h, out = np.zeros(len(code), np.uint32), []
    for n in range(ORDERS):
        if len(code) <= n:
            break
        h = (h[:len(code) - n] ^ code[n:]) * _MULT[n]
        out.append((h ^ (h >> np.uint32(15))) * _MULT[3] >> np.uint32(16))
    return np.concatenate(out)


def has_letter(text: str | None) -> bool:
    """The one rule of learning and prediction (Java's letters are an older Unicode's)."""
    return bool(text) and _letter.search(text) is not None


def distinct(h: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The distinct values of ``h``; ``last`` is scratch of BUCKETS longs."""
    order = np.arange(len(h))
    last[h] = order
    return h[last[h] == order]


def _frequencies(cols):
    """Per bucket how many texts hold it, and per language how many there are:
    of the texts with a letter."""
    df, last, langs = np.zeros(BUCKETS, np.int64), np.empty(BUCKETS, np.int64), Counter()
    for lang, text in zip(cols["lang"], cols["text"]):
        if has_letter(text):
            df[distinct(grams(text), last)] += 1
            langs[lang] += 1
    at = np.flatnonzero(df)
    return {"bucket": at.tolist() + [None] * len(langs), "lang": [None] * len(at) + list(langs), "n": df[at].tolist() + list(langs.values())}


def _vectors(cols):
    out = {"lang": [], "fit": [], "at": [], "tf": []}
    for lang, fit, text in zip(cols["lang"], cols["fit"], cols["text"]):
        if not has_letter(text):
            continue
        h = grams(text)
        out["lang"].append(lang)
        out["fit"].append(fit)
        at, n = np.unique(h, return_counts=True)
        out["at"].append(at.astype("<i4").tobytes())
        out["tf"].append((n / len(h)).astype("<f4").tobytes())
    return out


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (BUCKETS + 1, classes); the last row is the bias, without penalty."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def weights(at):
        free = at == BUCKETS
        l1 = np.where(free, 0, L1)[:, None]
        l2 = np.where(free, 0, L2)[:, None]
        zz = z[at]
        return np.where(np.abs(zz) <= l1, 0, -(zz - np.sign(zz) * l1) / ((BETA + np.sqrt(n[at])) / ALPHA + l2))

    order = np.arange(len(rows))
    for epoch in range(epochs):
        np.random.default_rng(epoch).shuffle(order)
        for i in order:
            at, x, y = rows[i]
            at, x = np.append(at, BUCKETS), np.append(x, 1.0)
            w = weights(at)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            root = np.sqrt(n[at])
            n[at] += g * g
            z[at] += g - (np.sqrt(n[at]) - root) / ALPHA * w
    return weights(np.arange(BUCKETS + 1))


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits that fits held-back labels best."""
    if not len(y):
        return 1.0

    def loss(t):
        p = softmax(logits / t)[np.arange(len(y)), y]
        return -np.log(np.maximum(p, 1e-12)).mean()
    grid = np.exp(np.linspace(np.log(0.25), np.log(20), 200))
    return float(grid[np.argmin([loss(t) for t in grid])])


class Model:
    """langs, a table (BUCKETS, languages) of weight times idf, bias, temperature."""

    def __init__(self, langs, table, bias, heat):
        self.langs, self.table, self.bias, self.heat = langs, table, bias, heat

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not has_letter(text):
            return NEVER, 0.0
        h = grams(text)
        total = np.zeros(len(self.langs))
        for i in range(0, len(h), 1 << 16):
            total += self.table[h[i:i + (1 << 16)]].sum(axis=0, dtype=np.float64)
        p = softmax((total / len(h) + self.bias) / self.heat)
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          per_lang: int = PER_LANG) -> Model:
    doc_id, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    rest = F.crc32(doc_id.cast("string")) % 5
    rows = docs.select(doc_id.alias("doc_id"), text.alias("text"), F.col(lang_col).cast("string").alias("lang"), rest.alias("rest"))
    rows = rows.where(F.col("lang").isNotNull() & (F.col("rest") != 0) & F.col("text").isNotNull())
    told = map_batches(rows.select("lang", "text"), _frequencies, "bucket int, lang string, n long").groupBy("bucket", "lang").agg(F.sum("n").alias("n"))
    seen, counts = np.zeros(BUCKETS), {}
    for r in told.collect():  # a row per bucket and per language at most
        if r["bucket"] is None:
            counts[r["lang"]] = r["n"]
        else:
            seen[r["bucket"]] = r["n"]
    langs = sorted(counts)
    if not langs:
        return Model([], None, None, 1.0)
    idf = np.log((1 + sum(counts.values())) / (1 + seen)) + 1

    share = F.element_at(F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, per_lang / counts[k]))]), F.col("lang"))
    draw = F.pmod(F.xxhash64(F.lit("langid"), "doc_id", "text"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    fit = F.pmod(F.xxhash64(F.lit("fit"), "doc_id", "text"), F.lit(5)) > 0
    sample = map_batches(rows.where(draw < share).select("text", "lang", fit.alias("fit")), _vectors,
                         "lang string, fit boolean, at binary, tf binary")
    number = {k: i for i, k in enumerate(langs)}
    learn, keep = [], []
    # per_lang rows a language; sorted, so that the fit does not hang on the order of tasks
    for r in sorted(sample.collect(), key=lambda r: (r["lang"], bytes(r["at"]), bytes(r["tf"]))):
        at = np.frombuffer(r["at"], "<i4")
        tf = (np.frombuffer(r["tf"], "<f4") * idf[at] * SCALE).astype(np.float32)
        (learn if r["fit"] else keep).append((at, tf, number[r["lang"]]))
    w = ftrl(learn or keep, len(langs))
    logits = np.array([x @ w[at] + w[BUCKETS] for at, x, _ in keep]).reshape(-1, len(langs))
    heat = temperature(logits, np.array([y for *_, y in keep], np.int64))
    return Model(langs, (w[:BUCKETS] * (idf * SCALE)[:, None]).astype(np.float32), w[BUCKETS], heat)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; text alone decides."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages floats

    def run(cols, shared):
        found = [shared.value.predict(t) for t in cols["text"]]
        return {"doc_id": cols["doc_id"], "held_out": cols["held_out"],
                "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]}
    doc_id = F.col(id_col).cast("long")
    held = F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))
    rows = docs.select(doc_id.alias("doc_id"), held.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, run, "doc_id long, held_out boolean, lang_pred string, score double", shared=shared)


def identify(docs: DataFrame, **params) -> DataFrame:
    return predict(docs, train(docs, **params))
