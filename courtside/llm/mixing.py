"""Operator 8: mix sources to target weights by iterative proportional fitting.

The token mass of each (source, language, topic) cell is raked to the three
target marginals in turn until they all hold. A document's weight is its
cell's fitted mass over its mass; its probability is the weight over a scale.
The scale is the largest weight, so that no probability exceeds 1 and the
expected mix meets every target, as long as that keeps the share ``KEEP`` of all
tokens. Otherwise the scale is 1 / ``KEEP``: no cell gives more than it has,
what it lacks is raked from the other cells, and a value that lacks tokens
altogether is taken whole (its targets' rest goes to the other values in
proportion). So no small cell can thin out the others. ``kept_share`` tells the
share of the tokens that are expected to stay. The draw is a hash of (id, text),
so it is repeatable and repeated rows share it.

Targets: a table {value: share} per dimension (values it leaves out get
nothing), or by default the corpus's own shares to the power ``ALPHA``, which
lifts small sources and tames a hot one. Targets that the cells cannot meet
(a value wanted but absent) are met as far as they can be.

Null source, language or topic are values like any other. A text without
words (null, empty) has no tokens: it is weightless, gets the probability of
its cell and, where a cell has no tokens at all, probability 0. Only cells are
fitted: one row for each combination that occurs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtside.llm.common import join_on, map_arrow, stored

ALPHA = 0.8
KEEP = 0.4  # of all tokens, at least
SEED = "mix-1"
DIMENSIONS = ("source", "lang", "topic")
WORD = r"[^\x20\x09-\x0D]+"


def tokens(text: Column) -> Column:
    """Number of words; a null text has none."""
    gaps = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(gaps, " "), lambda w: w != "")).cast("long")


def topic(text: Column) -> Column:
    """What a text is about, as far as its form tells."""
    t = F.coalesce(text, F.lit(""))
    return (F.when(F.length(F.trim(t)) == 0, "none").when(F.contains(t, F.lit(" | ")), "table")
            .when(F.contains(t, F.lit("icense")), "licence").when(F.contains(t, F.lit("@")), "contact")
            .otherwise("prose"))


def _named(docs: DataFrame, id_col, text_col, source_col, lang_col, topic_of) -> DataFrame:
    """row (the table's own columns, in a struct: no name of theirs can clash),
    source, lang, topic, draw, n_tokens."""
    def own(c):
        return F.col(f"`{c}`")

    text = own(text_col).cast("string")
    draw = F.pmod(F.xxhash64(F.lit(SEED), own(id_col), text), F.lit(1 << 53)) / F.lit(float(1 << 53))
    return docs.select(F.struct("*").alias("row"), own(source_col).cast("string").alias("source"), own(lang_col).cast("string").alias("lang"),
                       topic_of(text).alias("topic"), draw.alias("draw"), tokens(text).alias("n_tokens"))


def _raked(x: np.ndarray, cap: np.ndarray, at: list[np.ndarray], want: list[np.ndarray], passes: int, tolerance: float) -> np.ndarray:
    """``x`` scaled by value of each dimension in turn until the marginals are
    ``want``. What counts of a cell is its ``x`` up to its ``cap``."""
    def have(d):
        return np.bincount(at[d], np.minimum(x, cap), len(want[d]))

    for _ in range(passes):
        for d in range(len(at)):
            own = have(d)
            factor = np.divide(want[d], own, out=np.zeros_like(own), where=own > 0)
            x = np.minimum(x * factor[at[d]], cap * 1e9)  # far over its cap a cell counts no more than the cap
        if max(np.abs(have(d) - want[d]).max() for d in range(len(at))) < tolerance:
            return np.minimum(x, cap)
    # targets that no mix meets: the whole mass that they ask for is kept all the same
    for _ in range(passes):
        own = np.minimum(x, cap).sum()
        if not 0 < own < min(w.sum() for w in want) - tolerance:
            break
        x = np.minimum(x * min(w.sum() for w in want) / own, cap * 1e9)
    return np.minimum(x, cap)


def _filled(want: np.ndarray, cap: np.ndarray) -> np.ndarray:
    """Targets with none over its cap: the rest goes to the others in proportion."""
    full = np.zeros(len(want), bool)
    while True:
        free = want[~full].sum()
        share = np.where(full, cap, want * (max(0.0, 1 - cap[full].sum()) / free if free > 0 else 0.0))
        if not (over := ~full & (share > cap)).any():
            return share
        full |= over


def _fitted(source, lang, topic, mass, targets, alpha, passes, tolerance, keep) -> tuple[np.ndarray, float]:
    """The cells' fitted masses and the scale."""
    share = np.array(mass, float) / float(sum(mass))
    at, want = [], []
    for d, values in zip(DIMENSIONS, (source, lang, topic)):
        number = {v: i for i, v in enumerate(dict.fromkeys(values))}
        at.append(np.array([number[v] for v in values]))
        own = np.bincount(at[-1], share, len(number))
        to = np.array([float(targets[d].get(v, 0.0)) for v in number]) if targets and d in targets else own ** alpha
        want.append(to / (to.sum() or 1.0))
    fitted = _raked(share, np.full(len(share), np.inf), at, want, passes, tolerance)
    scale = float((fitted / share).max()) or 1.0
    if scale * keep > 1:
        cap = share / keep
        want = [_filled(w, np.bincount(a, cap, len(w))) for a, w in zip(at, want)]
        scale, fitted = 1 / keep, _raked(fitted, cap, at, want, passes, tolerance)
    return fitted, scale


def fit(cells: DataFrame, targets: dict[str, dict] | None = None, alpha: float = ALPHA, passes: int = 2000,
        tolerance: float = 1e-9, keep: float = KEEP) -> DataFrame:
    """``cells`` (source, lang, topic, mass) with ``fitted``, scaled to sum to
    1, and ``scale``, the weight that stands for probability 1. One task rakes
    all cells, in the order of their values."""
    def run(batches):
        rows = [r for b in batches for r in zip(*b.to_pydict().values())]
        if rows:
            rows.sort(key=lambda r: [(v is not None, v or "") for v in r[:3]])
            source, lang, topics, mass = zip(*rows)
            fitted, scale = _fitted(source, lang, topics, mass, targets, alpha, passes, tolerance, keep)
            yield {"source": source, "lang": lang, "topic": topics, "mass": mass, "fitted": fitted, "scale": [scale] * len(mass)}

    slim = cells.where("mass > 0").select(*DIMENSIONS, "mass").coalesce(1)  # cells, not documents
    return stored(map_arrow(slim, "source string, lang string, topic string, mass long, fitted double, scale double", run), "mix-cells")


def rates(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", lang_col="lang", topic_of=topic,
          targets=None, alpha=ALPHA, keep=KEEP) -> DataFrame:
    """Cells with weight (fitted share over own share) and probability."""
    named = _named(docs, id_col, text_col, source_col, lang_col, topic_of)
    cells = stored(named.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("mass")), "mix-masses")
    fitted = fit(cells, targets, alpha, keep=keep)
    total = fitted.agg(F.sum("mass")).first()[0] or 1
    weighed = fitted.withColumn("weight", F.col("fitted") / F.col("mass") * F.lit(float(total)))
    return stored(weighed.withColumn("probability", F.least(F.col("weight") / F.col("scale"), F.lit(1.0))).drop("scale"), "mix-rates")


def kept_share(cells: DataFrame) -> float:
    """The share of all tokens that are expected to stay under ``rates``."""
    return cells.agg(F.try_divide(F.sum(F.col("probability") * F.col("mass")), F.sum("mass"))).first()[0] or 0.0


def with_rates(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", lang_col="lang", topic_of=topic,
               targets=None, alpha=ALPHA, keep=KEEP) -> DataFrame:
    """Every row as ``row`` (a struct of its own columns) with source, lang,
    topic, weight, probability and sampled."""
    args = (id_col, text_col, source_col, lang_col, topic_of)
    r = rates(docs, *args, targets, alpha, keep).select(
        F.col("source").alias("s"), F.col("lang").alias("l"), F.col("topic").alias("t"), F.col("weight").alias("w"), F.col("probability").alias("p"))
    out = join_on(_named(docs, *args), r, [("source", "s"), ("lang", "l"), ("topic", "t")], "left")
    probability = F.coalesce("p", F.lit(0.0))
    return out.select("row", *DIMENSIONS, F.coalesce("w", F.lit(0.0)).alias("weight"), probability.alias("probability"),
                      (F.col("draw") < probability).alias("sampled"))


def sample(docs: DataFrame, **params) -> DataFrame:
    """The sampled rows, all columns as they are."""
    return with_rates(docs, **params).where("sampled").select("row.*")
