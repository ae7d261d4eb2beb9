"""Operator 7: benchmark decontamination by CGK embedding and bit sampling.

Texts are lower-cased and cut into words; an item leaks into a document that
holds a stretch of words within ``1 - SIMILARITY`` of the item's word count in
edit distance (words inserted, dropped or replaced). Three steps:

1. CGK embedding: a random walk starts at every word of a document. Driven by
   coins of (walk, step, word) it writes a symbol a step and goes on to the next
   word or stays, so edit distance becomes Hamming distance, and walks that an
   edit has parted meet again. A walk takes two steps a word on average.
2. Bit-sampling LSH: each of ``WALKS`` walks hashes a few samples
   of ``SAMPLED`` symbols. The same keys of the items' own windows are indexed, and
   every window of every document is looked up: equal keys are the only source of
   candidates. Walks from one word share their beginnings whatever the item's
   length, so one set of walks serves windows of three sizes (``SIZES``): 8 steps
   for items under 14 words, 20 under 24 words, and 32 for all others. Longer
   items are covered by windows that start at ``STARTS`` words or more, spread
   evenly; the edits fall on them too, and one key of one window is enough. The
   tests hold recall to ``RECALL`` or more at the full edit bound for 5 to 1000
   words.
3. Exact check: a candidate's surroundings must hold as many of the item's word
   q-grams as the edit bound leaves (no leak can fail this), and then the edit
   distance of the item against the best stretch there decides.

The benchmark is a stated query set: it is read in blocks of ``BLOCK_BYTES``
whatever its size, each matched against all documents. Items under five words
can't be told from common speech: such an item leaks only into a document that
consists of its words. Null and empty items and texts match nothing. Repeated
items and rows are matched each; a null id is kept as null.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from courtside.llm.common import id_text, map_batches, semi_by_row, stored, text_key

SIMILARITY = 0.8
MIN_WORDS = 5
WALKS = 4
SAMPLED = 3
SIZES = ((5, 8, 10, 2), (14, 20, 4, 3), (24, 32, 2, 3))  # items from (words), steps and draws of a walk, places a key is taken from
STARTS = 32
RECALL = 0.98
CHUNK = 1 << 15  # words embedded at once, so that the arrays stay in the cache
BLOCK_BYTES = 4 << 20
_B, _C = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def word_ids(text: str | None) -> np.ndarray:
    words = (text or "").lower().encode().split()
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def odd(seed: int, shape) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, shape, np.uint64) * np.uint64(2) + np.uint64(1)


_GRAM = odd(11, 8)


def grams(ids: np.ndarray, q: int) -> np.ndarray:
    n = len(ids) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = ids[:n] * _GRAM[0]
    for i in range(1, q):
        h += ids[i:i + n] * _GRAM[i]
    return mix(h)


class Walks:
    """The walks, and the samples taken of them for each of the given sizes: one
    of each third of the steps, so that a key's symbols stand apart."""

    def __init__(self, sizes: Sequence[int]):
        self.sizes = np.repeat(sizes, [SIZES[s][2] for s in sizes])  # of each draw
        self.steps = max(SIZES[s][1] for s in sizes)
        self.coins = np.stack([odd(w, self.steps) for w in range(WALKS)])
        self.factors = np.concatenate([odd(100 + s, (WALKS, SIZES[s][2], SAMPLED)) for s in sizes], axis=1)
        picks = []
        for s in sizes:
            thirds = np.linspace(0, SIZES[s][1], SAMPLED + 1).astype(int)
            picks.append(np.random.default_rng(s).integers(thirds[:-1], thirds[1:], (WALKS, SIZES[s][2], SAMPLED)))
        self.picks = np.concatenate(picks, axis=1)
        self.drawn = [[np.argwhere(p == j).tolist() for j in range(self.steps)] for p in self.picks]

    def walk(self, w: int, ids: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
        """(step, places) of walk ``w`` from each of the first ``n`` words.
        ``ids`` holds ``steps`` words more; a 0 stands for the end of a text, and
        no walk passes it. The places are good until the next step."""
        step, ahead, at = np.empty(len(ids), np.uint64), np.empty(n, np.int64), np.arange(n)
        for j in range(self.steps):
            yield j, at
            np.multiply(ids, self.coins[w, j], out=step)
            np.right_shift(step, np.uint64(63), out=step)
            np.take(step.view(np.int64), at, out=ahead, mode="clip")
            at += ahead

    def windows(self, ids: np.ndarray, n: int) -> Iterator[np.ndarray]:
        """The keys of the windows at the first ``n`` words, for every walk and draw."""
        symbol, part = np.empty(n, np.uint64), np.empty(n, np.uint64)
        for w in range(WALKS):
            keys = np.empty((len(self.sizes), n), np.uint64)
            for j, at in self.walk(w, ids, n):
                drawn = self.drawn[w][j]
                if drawn:
                    np.take(ids, at, out=symbol, mode="clip")
                for d, i in drawn:
                    factor = self.factors[w, d, i]
                    if i == 0:  # a draw's steps ascend
                        np.multiply(symbol, factor, out=keys[d])
                    else:
                        np.multiply(symbol, factor, out=part)
                        keys[d] += part
            yield from keys

    def telling(self, ids: np.ndarray, n: int) -> Iterator[np.ndarray]:
        """Which of these keys take their symbols from enough places, none past
        the text's end: only such keys of items are indexed."""
        need = np.array([SIZES[s][3] for s in self.sizes])[:, None]
        for w in range(WALKS):
            whole, last = np.ones((len(need), n), bool), np.full((len(need), n), -1)
            places = np.zeros((len(need), n), np.int64)
            for j, at in self.walk(w, ids, n):
                for d, _ in self.drawn[w][j]:
                    whole[d] &= ids[at] != 0
                    places[d] += at > last[d]
                    last[d] = at
            yield from whole & (places >= need)


def joined(texts: Sequence[np.ndarray], gap: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts one after another, ``gap`` zeros behind each and at the end, and
    where each starts (and the last one's gap ends)."""
    starts = np.concatenate([[0], np.cumsum([len(t) + gap for t in texts])]).astype(np.int64)
    ids = np.zeros(starts[-1] + gap, np.uint64)
    for s, t in zip(starts.tolist(), texts):
        ids[s:s + len(t)] = t
    return ids, starts


def best_stretch(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int]:
    """(distance, start, end) of the stretch of ``region`` nearest to ``item``;
    the earliest end, then the latest start, among equals."""
    m = len(item)
    cost, start = np.arange(m + 1), np.zeros(m + 1, np.int64)
    best = (m, 0, 0)
    for j, word in enumerate(region.tolist(), 1):
        below_cost, below_start = cost, start
        cost, start = np.empty_like(cost), np.empty_like(start)
        cost[0], start[0] = 0, j
        diag = below_cost[:-1] + (item != np.uint64(word))
        up = below_cost[1:] + 1
        take = diag <= up
        c, s = np.where(take, diag, up).tolist(), np.where(take, below_start[:-1], below_start[1:]).tolist()
        prev, prev_start = 0, j
        for i in range(m):
            if prev + 1 < c[i]:
                c[i], s[i] = prev + 1, prev_start
            prev, prev_start = c[i], s[i]
        cost[1:], start[1:] = c, s
        if prev < best[0]:
            best = (prev, prev_start, j)
    return best


class Items:
    """A block of benchmark items, indexed by the LSH keys of their windows."""

    def __init__(self, items: list[tuple[int | None, str]], similarity: float):
        self.items = [(i, word_ids(t)) for i, t in items]
        self.edits = [int((1 - similarity) * len(w) + 1e-9) for _, w in self.items]
        self.short = defaultdict(list)
        for k, (_, w) in enumerate(self.items):
            if 0 < len(w) < MIN_WORDS:
                self.short[w.tobytes()].append(k)
        self.grams: dict[int, tuple[int, int, np.ndarray]] = {}
        sizes = np.searchsorted([low for low, *_ in SIZES], [len(w) for _, w in self.items], "right") - 1
        self.walks = None
        if (sizes >= 0).any():
            self.walks = Walks(np.unique(sizes[sizes >= 0]).tolist())
            self._index(sizes)

    def _index(self, sizes: np.ndarray) -> None:
        """Keys in order, their items and offsets, and tables of their first and last bits."""
        long = np.flatnonzero(sizes >= 0)
        ids, starts = joined([self.items[k][1] for k in long], self.walks.steps)
        n = len(ids) - self.walks.steps
        item = np.repeat(long, np.diff(starts))
        offset = np.arange(n) - np.repeat(starts[:-1], np.diff(starts))
        words = np.array([len(w) for _, w in self.items])[item]
        taken = (offset < words) & (offset % np.maximum(1, words // STARTS) == 0)
        g, k, o = [], [], []
        draws = np.tile(self.walks.sizes, WALKS).tolist()
        for size, keys, good in zip(draws, self.walks.windows(ids, n), self.walks.telling(ids, n)):
            at = np.flatnonzero(taken & good & (sizes[item] == size))
            g.append(keys[at])
            k.append(item[at])
            o.append(offset[at])
        g, k, o = np.concatenate(g), np.concatenate(k), np.concatenate(o)
        order = np.argsort(g, kind="stable")
        self.keys, self.item, self.offset = g[order], k[order].astype(np.int32), o[order].astype(np.int32)
        bits = min(26, max(16, (32 * len(g)).bit_length()))
        self.shift, self.mask = np.uint64(64 - bits), np.uint64((1 << bits) - 1)
        self.first, self.last = np.zeros(1 << bits, bool), np.zeros(1 << bits, bool)
        self.first[g >> self.shift] = True
        self.last[g & self.mask] = True

    def candidates(self, texts: Sequence[np.ndarray]) -> Iterator[tuple[int, int, np.ndarray]]:
        """(text, item, diagonals in order) where a window of the text shares a
        key with one of the item."""
        found = []
        if self.walks is not None:
            ids, starts = joined(texts, self.walks.steps)
            for s in range(0, int(starts[-1]), CHUNK):
                n = min(CHUNK, int(starts[-1]) - s)
                place, known = np.empty(n, np.uint64), np.empty(n, bool)
                for keys in self.walks.windows(ids[s:s + n + self.walks.steps], n):
                    np.right_shift(keys, self.shift, out=place)
                    np.take(self.first, place.view(np.int64), out=known, mode="clip")
                    pos = np.flatnonzero(known)
                    pos = pos[self.last[keys[pos] & self.mask]]
                    lo, hi = np.searchsorted(self.keys, keys[pos], "left"), np.searchsorted(self.keys, keys[pos], "right")
                    m = hi - lo
                    if m.any():
                        at = np.repeat(lo - np.cumsum(m) + m, m) + np.arange(m.sum())
                        p = np.repeat(pos, m) + s
                        doc = np.searchsorted(starts, p, "right") - 1
                        found.append(np.unique(np.stack([doc, self.item[at], p - starts[doc] - self.offset[at]], axis=1), axis=0))
        if not found:
            return
        hits = np.unique(np.concatenate(found), axis=0)
        cut = np.flatnonzero((np.diff(hits[:, :2], axis=0) != 0).any(axis=1)) + 1
        for part in np.split(hits, cut):
            yield int(part[0, 0]), int(part[0, 1]), part[:, 2]

    def near(self, k: int, ids: np.ndarray, diagonals: np.ndarray) -> tuple | None:
        """(item_id, item_words, distance, start, end) of the stretch around the
        diagonals that is nearest to item ``k``, if it is within the bound."""
        item_id, item = self.items[k]
        n, edits = len(item), self.edits[k]
        if k not in self.grams:
            # the longest q-gram of which an in-bound stretch must keep at least one
            q = next(q for q in (3, 2, 1) if q == 1 or n - q + 1 - q * edits >= 1)
            self.grams[k] = q, max(1, n - q + 1 - q * edits), frozenset(grams(item, q).tolist())
        q, need, own = self.grams[k]
        best, bands = None, []
        for d in diagonals.tolist():
            if bands and d - bands[-1][1] <= 2 * edits:
                bands[-1][1] = d
            else:
                bands.append([d, d])
        for low, high in bands:
            a, b = max(0, low - edits), min(len(ids), high + n + 2 * edits)
            if sum(map(own.__contains__, grams(ids[a:b], q).tolist())) >= need:
                dist, s, e = best_stretch(item, ids[a:b])
                if dist <= edits and (best is None or dist < best[2]):
                    best = (item_id, n, dist, a + s, a + e)
        return best

    def leaks(self, texts: Sequence[str | None]) -> list[list[tuple]]:
        """For each text, (item_id, item_words, distance, start, end) of each
        item that leaks into it."""
        ids = [word_ids(t) for t in texts]
        out = [[(self.items[k][0], len(w), 0, 0, len(w)) for k in self.short.get(w.tobytes(), ())] if len(w) < MIN_WORDS else []
               for w in ids]
        for text, k, diagonals in self.candidates(ids):
            if leak := self.near(k, ids[text], diagonals):
                out[text].append(leak)
        return out


_BLOCKS: dict[str, Items] = {}


def _leaks(cols, block, token, similarity):
    if token not in _BLOCKS:  # one block at a time, shared by a worker's tasks
        _BLOCKS.clear()
        _BLOCKS[token] = Items(block.value, similarity)
    items = _BLOCKS[token]
    out = defaultdict(list)
    for k1, k2, doc_id, found in zip(cols["k1"], cols["k2"], cols["doc_id"], items.leaks(cols["text"])):
        for leak in found:
            for name, v in zip(("k1", "k2", "doc_id", "item_id", "item_words", "distance", "start_word", "end_word"),
                               (k1, k2, doc_id, *leak)):
                out[name].append(v)
    return {n: out[n] for n in ("k1", "k2", "doc_id", "item_id", "item_words", "distance", "start_word", "end_word")}


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per document row and item that leaks into it: doc_id, k1, k2
    (the row's key), item_id, item_words, distance, start_word, end_word (the
    nearest stretch)."""
    spark = docs.sparkSession
    items = id_text(benchmark, item_col, item_text_col).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    keyed = id_text(docs, id_col, text_col).select("doc_id", "text", *text_key(F.col("doc_id"), F.col("text")))
    schema = "k1 long, k2 long, doc_id long, item_id long, item_words long, distance long, start_word long, end_word long"
    out = None
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)) == b)
        block = spark.sparkContext.broadcast([tuple(r) for r in part.orderBy("doc_id", "text").collect()])  # BLOCK_BYTES or so
        found = map_batches(keyed, _leaks, schema, block=block, token=uuid.uuid4().hex, similarity=similarity)
        out = found if out is None else out.union(found)
    return spark.createDataFrame([], schema) if out is None else out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The rows into which no item leaks, all columns as they are."""
    bad = stored(leaks(docs, benchmark, id_col, text_col, **params).select("k1", "k2").distinct(), "leaks")
    return semi_by_row(docs, bad, id_col, text_col, "left_anti")
