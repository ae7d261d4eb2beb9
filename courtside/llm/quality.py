"""Operator 10: quality rules under weak supervision.

Each rule votes good (2), bad (1) or abstains (0). Expectation-maximisation
over the vote patterns estimates, with no labels, each rule's accuracy on good
documents and on each kind of junk, and the share of every kind; a document's
verdict is its posterior probability of being good. The
patterns (at most 3 ** number of rules rows, whatever the corpus) are counted
over every document by Spark, and only those counts reach the driver.

Null text has no words. Documents that fail the base rules (fewer than
``MIN_WORDS`` words, or over ``MAX_REPEAT`` percent of the words in repeated
five-word windows) are never kept. Repeated rows get the same verdict each.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.llm.common import id_text, map_batches, semi_by_row, stored, text_key

MIN_WORDS = 10
MAX_REPEAT = 20       # percent of the words
WINDOW = 5            # words
MAX_FALSE = 0.02      # a rule's largest rate of bad votes on good documents
SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
          "n_lines", "n_ended", "n_upper", "n_letters", "n_marks", "n_distinct")
_MULT = np.uint64(0x9E3779B97F4A7C15)


def measure(text: str | None) -> tuple[int, ...]:
    """The COUNTS of one text."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    gaps = len(raw) - len(raw.translate(None, b" \t\n\r\x0b\x0c"))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    ended = sum(x.rstrip()[-1:] in (b".", b"!", b"?", b":", b'"') for x in lines)
    code = np.frombuffer(raw, np.uint8)
    upper = int(np.count_nonzero((code >= 65) & (code <= 90)))
    letters = upper + int(np.count_nonzero((code >= 97) & (code <= 122)))
    ids = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    repeated = 0
    if n > WINDOW:
        h = np.zeros(n - WINDOW + 1, np.uint64)
        for i in range(WINDOW):
            h = h * _MULT + ids[i:n - WINDOW + 1 + i]
            h ^= h >> np.uint64(29)
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        twice = np.zeros(len(h), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        if twice.any():
            edge = np.zeros(n + 1, np.int64)
            at = np.flatnonzero(twice)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + WINDOW, -1)
            repeated = int(np.count_nonzero(np.cumsum(edge[:n])))
    return (n, len(text) - gaps, symbols, len(lines) - len(set(lines)), repeated,
            len(lines), ended, upper, letters, raw.count(b"!"), len(np.unique(ids)))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the row's key (k1, k2) and COUNTS of every row."""
    def run(cols):
        found = [measure(t) for t in cols["text"]]
        out = {k: list(v) for k, v in zip(COUNTS, zip(*found))} if found else {k: [] for k in COUNTS}
        return out | {k: cols[k] for k in ("doc_id", "k1", "k2")}
    keyed = id_text(docs, id_col, text_col).select("doc_id", "text", *text_key(F.col("doc_id"), F.col("text")))
    return map_batches(keyed, run, "doc_id long, k1 long, k2 long, " + ", ".join(f"{c} long" for c in COUNTS))


def _vote(bad, good):
    return F.when(bad, 1).when(good, 2).otherwise(0)


def rules() -> dict:
    """Rule name -> vote over COUNTS."""
    n, per = F.col("n_words"), lambda c: F.try_divide(F.col(c), F.col("n_words"))
    lines = lambda c: F.try_divide(F.col(c), F.col("n_lines"))
    upper = F.when(F.col("n_letters") >= 20, F.try_divide(F.col("n_upper"), F.col("n_letters")))
    variety = F.when((n >= 30) & (n <= 2000), per("n_distinct"))
    return {
        "symbols": _vote(per("n_symbols") > 0.1, per("n_symbols") <= 0.02),
        "repetition": _vote(100 * F.col("n_repeat_words") > MAX_REPEAT * n, F.col("n_repeat_words") * 20 <= n),
        "capitals": _vote(upper > 0.5, upper < 0.2),
        "exclamations": _vote(per("n_marks") > 0.2, per("n_marks") < 0.05),
        "line_copies": _vote(lines("n_dup_lines") > 0.5, lines("n_dup_lines") < 0.2),
        "length": _vote(n < MIN_WORDS, n >= 20),
        "word_length": _vote((per("word_chars") < 2) | (per("word_chars") > 14), per("word_chars").between(3, 12)),
        "variety": _vote(variety < 0.25, variety > 0.4),
        "endings": _vote((F.col("n_lines") > 0) & (F.col("n_ended") == 0), lines("n_ended") >= 0.5),
    }


def estimate(votes: np.ndarray, weight: np.ndarray, rounds: int = 300, tol: float = 1e-9) -> tuple:
    """EM over vote patterns (rows of ``votes``, seen ``weight`` times).

    Junk comes in kinds that set off different rules, so the latent class is
    "good" or one kind of junk for each rule: (prior[k], rate[k, j] = P(rule j
    votes bad | class k, it votes)). Class 0 is good: there a rule's accuracy,
    1 - rate, is held at 1 - MAX_FALSE at least, which is what makes class 0
    the good one. Kind k starts as "rule k mostly fires, others sometimes". A
    Beta prior worth ten documents keeps every rate inside (0, 1)."""
    n, k = votes.shape[1], votes.shape[1] + 1
    start = np.full((k, n), 0.1)
    start[0] = MAX_FALSE / 2
    start[np.arange(1, k), np.arange(n)] = 0.9
    prior, rate = np.array([1 - 0.02 * n] + [0.02] * n), start.copy()
    is_bad, voted = (votes == 1).astype(float), (votes > 0).astype(float)
    total = weight.sum()
    for _ in range(rounds):
        share = weight[:, None] * classes(votes, prior, rate)
        new_prior = (share.sum(axis=0) + 0.1) / (total + 0.1 * k)
        new_rate = (share.T @ is_bad + 10 * start) / (share.T @ voted + 10)
        new_rate[0] = np.minimum(new_rate[0], MAX_FALSE)
        moved = max(np.abs(new_prior - prior).max(), np.abs(new_rate - rate).max())
        prior, rate = new_prior, new_rate
        if moved < tol:
            break
    return prior, rate


def classes(votes: np.ndarray, prior: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """P(class | votes), one row per row of ``votes``."""
    log = np.log(prior) + (votes == 1) @ np.log(rate).T + (votes == 2) @ np.log1p(-rate).T
    p = np.exp(log - log.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, k1, k2, COUNTS, base_failed, pattern, posterior, kept per row."""
    spark = docs.sparkSession
    named = rules()
    pattern = F.concat(*[r.cast("string") for r in named.values()])
    m = stored(measures(docs, id_col, text_col), "quality").withColumn("pattern", pattern)
    seen = {tuple(map(int, r[0])): r[1] for r in m.groupBy("pattern").count().collect()}  # 3 ** rules at most
    table = []
    if seen:
        order = sorted(seen)
        votes = np.array(order, np.int8)
        post = classes(votes, *estimate(votes, np.array([seen[k] for k in order], float)))[:, 0]
        table = [("".join(map(str, k)), float(p)) for k, p in zip(order, post)]
    scored = m.join(F.broadcast(spark.createDataFrame(table, "pattern string, posterior double")), "pattern", "left")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return (scored.withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold)))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns as they are."""
    return semi_by_row(docs, quality(docs, id_col, text_col, threshold).where("kept"), id_col, text_col)
