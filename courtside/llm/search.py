"""Operator 11: ranked lexical search by the Best Position Algorithm.

``build_index`` reads every text once and stores one row per document: its
length in terms and the counts of its distinct terms. ``search`` ranks all
indexed documents for a set of queries. Every task takes the documents of its
part in chunks of bounded size; in a chunk each query term has an impact list,
its documents by falling impact. For a query, positions are read from the top
of its lists, some from each in turn; a document met for the first time is
scored in full by direct accesses to the other lists, which also tell its
positions there. A list's best position is the end of its contiguous run of
seen positions, so the sum of the impacts at the best positions bounds the
score of every document not met yet (a list that was seen to its end adds
nothing). Reading stops when that bound is strictly below the k-th best score,
so that equal scores are still told apart by doc_id. The k best carry over from
chunk to chunk of a task, the tasks' lists are merged by windows, first in parts.

Terms are the maximal runs of ASCII letters, ASCII digits and characters beyond
ASCII; A-Z are lower-cased, nothing else. Scores are integers; see ``search``.

Queries go to the tasks in blocks of about ``BLOCK_TERMS`` terms, the only thing
that is broadcast; a block's chunks hold ``CELLS`` (term, document) places.

Null and empty texts and texts without a term are in no result and count for
nothing. Every row is a document: rows that repeat an id are ranked each, by the
same rule. A null doc_id comes before all others of its score. Query rows that
share an id are one query over the terms of all; a null id is a query like any
other; a query without terms has no rows. Either table may be empty. Other
columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courtside.llm.common import id_text, map_arrow, stored, work_dir

TOP = 50
BLOCK_TERMS = 1 << 15
CELLS = 1 << 24
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")  # in UTF-8, a byte from 0x80 on is part of a character beyond ASCII
PARTS = 64


def term_counts(text: str | None) -> Counter:
    return Counter(TERM.findall(text.encode().lower())) if text else Counter()  # bytes.lower: A-Z only


def _terms(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        counts = [term_counts(t) for t in batch.column("text").to_pylist()]
        at = np.flatnonzero([bool(c) for c in counts])
        offsets = pa.array(np.cumsum([0] + [len(counts[i]) for i in at]), pa.int32())
        flat = pa.array([t for i in at for t in counts[i]], pa.binary()).cast(pa.string())
        tf = pa.array([n for i in at for n in counts[i].values()], pa.int64())
        yield {"doc_id": batch.column("doc_id").take(pa.array(at)), "n": [counts[i].total() for i in at],
               "terms": pa.ListArray.from_arrays(offsets, flat), "tfs": pa.ListArray.from_arrays(offsets, tf)}


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, terms, tfs), stored: a row per document with a term."""
    return stored(map_arrow(id_text(docs, id_col, text_col), "doc_id long, n long, terms array<string>, tfs array<long>", _terms),
                  "search-index")


def query_terms(queries: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct (item_id, term)."""
    terms = map_arrow(id_text(queries, id_col, text_col), "doc_id long, n long, terms array<string>, tfs array<long>", _terms)
    return terms.select(F.col("doc_id").alias("item_id"), F.explode("terms").alias("term")).distinct()


# ---------------------------------------------------------------- one chunk of documents

class Best:
    """The k best documents of one query so far: highest score first, then
    a null id, then the smallest id."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.known, self.doc = np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64)

    @property
    def floor(self) -> int:
        """The k-th best score; -1 while there are fewer."""
        return int(self.score[-1]) if len(self.score) == self.k else -1

    def add(self, score: np.ndarray, known: np.ndarray, doc: np.ndarray) -> None:
        keep = score >= max(1, self.floor)
        if keep.any():
            score, known, doc = (np.concatenate(x) for x in ((self.score, score[keep]), (self.known, known[keep]), (self.doc, doc[keep])))
            order = np.lexsort((doc, known, -score))[:self.k]
            self.score, self.known, self.doc = score[order], known[order], doc[order]


class Chunk:
    """Impact lists over some documents: per term its documents by falling
    impact, and each document's position in each list."""

    def __init__(self, doc_ids: np.ndarray, known: np.ndarray, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_terms: int):
        self.doc_ids, self.known = doc_ids, known
        order = np.lexsort((doc, -impact, term))
        self.doc, self.impact, term = doc[order], impact[order], term[order]
        self.size = np.bincount(term, minlength=n_terms)
        self.start = np.cumsum(self.size) - self.size
        self.place = np.full((n_terms, len(doc_ids)), -1, np.int32)
        self.place[term, self.doc] = np.arange(len(term)) - self.start[term]

    def rank(self, terms: np.ndarray, best: Best, first: int = 16) -> int:
        """Best positions over the lists of ``terms``; returns how many
        documents were scored."""
        lists = terms[self.size[terms] > 0]
        if not len(lists):
            return 0
        start, size = self.start[lists], self.size[lists]
        if int(self.impact[start].sum()) < best.floor:
            return 0
        met = np.zeros(len(self.doc_ids), bool)
        seen = [np.zeros(n, bool) for n in size]
        position = np.zeros(len(lists), np.int64)  # the contiguous seen positions of each list
        read, step, scored = 0, first, 0
        while True:
            docs = np.unique(np.concatenate([self.doc[s + read:s + min(read + step, n)] for s, n in zip(start, size) if n > read]))
            docs = docs[~met[docs]]
            if len(docs):
                met[docs] = True
                scored += len(docs)
                place = self.place[np.ix_(lists, docs)]  # direct accesses
                held = place >= 0
                score = np.where(held, self.impact[np.where(held, place, 0) + start[:, None]], 0).sum(axis=0)
                for i in range(len(lists)):
                    seen[i][place[i][held[i]]] = True
                best.add(score, self.known[docs], self.doc_ids[docs])
            read, step = read + step, step * 2
            bound = 0
            for i, n in enumerate(size):
                at = int(position[i])
                if at < n:
                    gap = int(seen[i][at:].argmin())
                    at = n if seen[i][at + gap] else at + gap
                    position[i] = at
                    if at < n:
                        bound += int(self.impact[start[i] + at - 1])
            if bound < best.floor or (position == size).all():
                return scored


class Searcher:
    """Ranks the documents of index batches for one block of queries."""

    def __init__(self, vocabulary: list[str], weights: list[int], queries: list[list[int]], n_docs: int, n_terms: int, k: int, cells: int):
        self.vocabulary, self.weights = pa.array(vocabulary, pa.string()), np.array(weights, np.int64)
        self.queries = [np.array(q, np.int64) for q in queries]
        self.n_docs, self.n_terms = n_docs, n_terms
        self.best = [Best(k) for _ in queries]
        self.room = max(64, cells // max(1, len(vocabulary)))
        self.held: list[tuple] = []
        self.docs = 0

    def add(self, batch: pa.RecordBatch) -> None:
        for at in range(0, batch.num_rows, self.room):
            self._hold(batch.slice(at, self.room))

    def _hold(self, batch: pa.RecordBatch) -> None:
        if self.docs + batch.num_rows > self.room:
            self.flush()
        lists, ids = batch.column("terms"), batch.column("doc_id")
        term = pc.index_in(lists.flatten(), value_set=self.vocabulary)
        doc = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        tf = batch.column("tfs").flatten().to_numpy(zero_copy_only=False)
        hit = term.is_valid().to_numpy(zero_copy_only=False)
        term = term.fill_null(0).to_numpy(zero_copy_only=False)[hit].astype(np.int64)
        doc, tf = doc[hit], tf[hit]
        m = np.array([50 + 50 * n * self.n_docs // self.n_terms for n in batch.column("n").to_pylist()], np.int64)
        impact = self.weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[doc]))
        some = impact > 0
        self.held.append((ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False),
                          doc[some] + self.docs, term[some], impact[some]))
        self.docs += batch.num_rows

    def flush(self) -> None:
        if self.held:
            chunk = Chunk(*(np.concatenate(x) for x in zip(*self.held)), len(self.weights))
            self.held, self.docs = [], 0
            for query, best in zip(self.queries, self.best):
                chunk.rank(query, best)

    def results(self) -> dict:
        self.flush()
        which = np.repeat(np.arange(len(self.best)), [len(b.score) for b in self.best])
        doc = np.concatenate([b.doc for b in self.best])
        known = np.concatenate([b.known for b in self.best])
        return {"query": which, "doc_id": pa.array(doc, pa.int64(), mask=~known), "score": np.concatenate([b.score for b in self.best])}


# ---------------------------------------------------------------- all documents

def search(index: DataFrame, queries: DataFrame, k: int = TOP, id_col: str = "item_id", text_col: str = "text",
           block_terms: int = BLOCK_TERMS, cells: int = CELLS) -> DataFrame:
    """(item_id, rank, doc_id, score): each query's k highest-scoring documents
    with a score above 0, equal scores by ascending doc_id.

    N documents have a term, L terms in all with repeats, n in one document; df
    documents hold a term, tf times in the document. A term weighs
    w = floor(1000 ln((2N + 2) / (2df + 1))), a document's length counts as
    m = 50 + (50 n N) div L, and the score is the sum over the query's terms of
    w ((1000000000 tf) div (1000 tf + 20 m))."""
    spark = index.sparkSession
    n_docs, n_terms = index.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    asked = stored(query_terms(queries, id_col, text_col), "search-queries")
    held = (index.select(F.explode("terms").alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
            .groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1)))
    weighed = asked.join(held.select("term", weight.cast("long").alias("w")), "term")
    blocks = max(1, math.ceil(asked.count() / block_terms))
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    lists = stored(weighed.groupBy(block.alias("block"), "item_id").agg(F.collect_list(F.struct("term", "w")).alias("terms")), "search-lists")
    path = work_dir(spark, "search-found")
    found = "block long, query long, doc_id long, score long"
    for b in range(blocks):  # a block's queries are bounded; all documents are searched for each
        rows = lists.where(F.col("block") == b).orderBy("item_id").collect()
        vocabulary = {t.term: t.w for r in rows for t in r.terms}
        number = {t: i for i, t in enumerate(vocabulary)}
        told = spark.sparkContext.broadcast((list(vocabulary), list(vocabulary.values()), [[number[t.term] for t in r.terms] for r in rows],
                                             n_docs, n_terms, k, cells))

        def run(batches, told=told, b=b):
            searcher = Searcher(*told.value)
            for batch in batches:
                searcher.add(batch)
            out = searcher.results() if searcher.queries else {"query": [], "doc_id": [], "score": []}
            yield {**out, "block": [b] * len(out["query"])}

        named = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], "query long, item_id long")
        per_task = map_arrow(index, found, run).join(F.broadcast(named), "query").select("item_id", "doc_id", "score")
        per_task.write.mode("append").parquet(path)
    return best_of(spark.read.schema("item_id long, doc_id long, score long").parquet(path), k)


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query: first the k best of each of some parts
    (so no task sorts all that the tasks of a large index hand in), then of these."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first()]
    part = Window.partitionBy("item_id", "part").orderBy(*order)
    fewer = (found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))).withColumn("r", F.row_number().over(part))
             .where(F.col("r") <= k).select("item_id", "doc_id", "score"))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(*order))
    return fewer.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
