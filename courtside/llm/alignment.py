"""Operator 13: alignment of two tokenizers over a corpus, each distinct text once.

Documents are shuffled by their full text, so that every distinct text is
tokenised and aligned once, whatever the number of its copies (copies are
counted on the map side first: a text that a third of all documents repeat is
one row a task). The counts of linked id pairs are weighted by the copies, and
the measures of a text are joined to the ids of its documents.

Tokenizer A is a byte-level BPE of the ``tokenizers`` library and encodes a
space and the text; B is a SentencePiece model, which adds that space itself.
Neither adds special tokens or takes their strings in a text for more than text.
Tokens are laid over the bytes of space + text. Places where a token of A and a
token of B both end cut them into groups; a token of A and a token of B whose
bytes overlap are a link. A pair of ids counts in how many documents it is linked.

``aligned_texts`` gives a row per distinct text with its links, ``pair_counts``
the corpus's table of id pairs (the tokenizers' dictionary: per id of A the ids
of B it stands with), ``measures`` both brought back to the documents. Pairs
seen often are looked up in a broadcast table of at most ``TABLE`` pairs, cut
at a count that a histogram by powers of two gives; all others by a shuffle.

Null and empty texts, and texts that the tokens of A or B don't give back byte
for byte (B normalises, or knows no such character), have no tokens: zeros and
an empty ``groups_sha256``. Every input row gives a row, repeated or null ids
too. An empty table gives an empty one. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.llm.common import id_text, map_arrow, stored, text_key

SLICE_BYTES = 1 << 20   # text that is tokenised at a time
TABLE = 1 << 19         # pairs of the broadcast table
ALIGNED = ("k1 long, k2 long, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
           "links array<struct<pair: long, uses: int>>")


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable
    Latin-1 characters stand for themselves, the other bytes for the letters
    from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteLevel:
    """Texts to ids by a byte-level BPE of the ``tokenizers`` library.

    Where the file is of the standard kind - text is cut by the standard pattern
    and not normalised, every byte has an entry, and entries are numbered in the
    order of their merges - ``tiktoken``, given the file's entries, makes the
    same ids four times as fast, and the ids give back every text. The libraries
    may differ in which newer characters are letters, so texts with a character
    beyond Latin Extended-B are left to ``tokenizers``, and so are very long runs
    of white space, which ``tiktoken`` can't take."""

    # Fixed value: the standard pattern of byte-level tokenizers.
    CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    ODD = re.compile(r"[^\x00-\u024f]|\s{1000}")

    def __init__(self, tokenizer: str):
        from tokenizers import Tokenizer
        self.tok, spec, letters = Tokenizer.from_str(tokenizer), json.loads(tokenizer), _byte_letters()
        self.tok.encode_special_tokens = True
        self.entries = {bytes(letters[c] for c in entry): i for entry, i in spec["model"]["vocab"].items() if all(c in letters for c in entry)}
        special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        self.n = max([*spec["model"]["vocab"].values(), *special.values()]) + 1
        self.bytes = [b""] * self.n
        for token, i in [*self.entries.items(), *special.items()]:
            self.bytes[i] = token
        cut, merges = spec["pre_tokenizer"] or {}, [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        made = [spec["model"]["vocab"].get("".join(m)) for m in merges]
        self.standard = (spec["normalizer"] is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True)
                         and not cut.get("add_prefix_space") and all(bytes([b]) in self.entries for b in range(256))
                         and made == list(range(256, 256 + len(merges))) and not spec["model"].get("ignore_merges")
                         and not spec["model"].get("dropout"))
        if self.standard:
            import tiktoken
            ranks = {t: i for t, i in self.entries.items() if t not in special}
            self.fast = tiktoken.Encoding("entries", pat_str=self.CUT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        plain = [self.standard and not self.ODD.search(t) for t in texts]
        out = [self.fast.encode_ordinary(t) if p else [] for t, p in zip(texts, plain)]
        others = [i for i, p in enumerate(plain) if not p]
        for i, e in zip(others, self.tok.encode_batch_fast([texts[i] for i in others], add_special_tokens=False)):
            out[i] = e.ids
        return out


class Aligner:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, tokenizer: str, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        self.a = ByteLevel(tokenizer)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.n_a, self.n_b, self.bytes_a = self.a.n, self.b.get_piece_size(), self.a.bytes
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in ((i, self.b.id_to_piece(i)) for i in range(self.n_b))]
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        # how a token is written: A's last of a group before '|', B's before ';'
        self.written = ([f"{i}{end}".encode() for i in range(self.n_a) for end in ",|"]
                        + [f"{i}{end}".encode() for i in range(self.n_b) for end in ",;"])

    def encode(self, texts: list[str]) -> tuple[list, list]:
        spaced = [" " + t for t in texts]
        a, b = self.a.encode(spaced), self.b.encode(texts, num_threads=1)
        for i, t in enumerate(spaced):
            whole = t.encode()
            same_a = self.a.standard or b"".join(map(self.bytes_a.__getitem__, a[i])) == whole
            if not same_a or b"".join(map(self.bytes_b.__getitem__, b[i])) != whole:
                a[i], b[i] = [], []
        return a, b

    def align(self, texts: list[str]) -> dict:
        """Columns of the texts' alignments. All texts are laid end to end, so
        one pass over the ends of all tokens aligns them together."""
        a, b = self.encode(texts)
        n_a, n_b = (np.array([len(x) for x in t], np.int64) for t in (a, b))
        flat_a, flat_b = (np.fromiter(chain.from_iterable(t), np.int64, int(n.sum())) for t, n in ((a, n_a), (b, n_b)))
        ends_a, ends_b = np.cumsum(self.size_a[flat_a]), np.cumsum(self.size_b[flat_b])
        text_a, text_b = np.repeat(np.arange(len(texts)), n_a), np.repeat(np.arange(len(texts)), n_b)
        both_a, both_b = np.isin(ends_a, ends_b), np.isin(ends_b, ends_a)
        # a piece between two neighbouring ends of either lies in one token of A and one of B: a link
        ends = np.sort(np.concatenate([ends_a, ends_b[~both_b]]), kind="stable")
        at_a, at_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        pairs = self.n_a * self.n_b
        key, uses = np.unique(text_a[at_a] * pairs + flat_a[at_a] * self.n_b + flat_b[at_b], return_counts=True)
        offsets = np.concatenate([[0], np.cumsum(np.bincount(key // pairs, minlength=len(texts)))])
        links = pa.StructArray.from_arrays([pa.array(key % pairs, pa.int64()), pa.array(uses, pa.int32())], ["pair", "uses"])
        # groups end to end: A's tokens of a group, then B's
        group_a, group_b = np.cumsum(both_a) - both_a, np.cumsum(both_b) - both_b
        upto_a, upto_b = np.cumsum(np.bincount(group_a)), np.cumsum(np.bincount(group_b))
        sign = np.empty(len(flat_a) + len(flat_b), np.int64)
        sign[np.arange(len(flat_a)) + np.concatenate([[0], upto_b])[group_a]] = 2 * flat_a + both_a
        sign[np.arange(len(flat_b)) + upto_a[group_b]] = 2 * (self.n_a + flat_b) + both_b
        stops = np.cumsum(n_a + n_b).tolist()
        digest = [hashlib.sha256(b"".join(map(self.written.__getitem__, sign[start:stop].tolist()))[:-1]).hexdigest() if stop > start else ""
                  for start, stop in zip([0, *stops], stops)]
        return {"n_a": n_a, "n_b": n_b, "n_groups": np.bincount(text_a[both_a], minlength=len(texts)),
                "n_links": np.bincount(text_a[at_a], minlength=len(texts)), "groups_sha256": digest,
                "links": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), links)}


_kept: dict[bytes, Aligner] = {}


def kept_aligner(tokenizer: str, model: bytes) -> Aligner:
    """The aligner of two files, kept by a worker from task to task."""
    key = hashlib.sha256(tokenizer.encode() + model).digest()
    if key not in _kept:
        _kept.clear()
        _kept[key] = Aligner(tokenizer, model)
    return _kept[key]


def slices(texts: list[str], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` characters (a longer text is its own)."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if size:
        yield start, len(texts)


def aligned_texts(docs: DataFrame, tokenizer: str, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per distinct text that isn't empty (columns ``ALIGNED``), stored;
    k1 and k2 are 128 bits that stand for the text."""
    texts = id_text(docs, id_col, text_col).where("text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    told = docs.sparkSession.sparkContext.broadcast((tokenizer, model))  # the two files, of fixed size

    def run(batches):
        aligner = kept_aligner(*told.value)
        for batch in batches:
            all_texts = batch.column("text").to_pylist()
            for start, stop in slices(all_texts):
                part = batch.slice(start, stop - start)
                yield {**aligner.align(all_texts[start:stop]), **{c: part.column(c) for c in ("k1", "k2", "copies")}}

    return stored(map_arrow(texts.select(*text_key(F.col("text")), "copies", "text"), ALIGNED, run), "aligned-texts")


def pair_counts(aligned: DataFrame, n_b: int) -> DataFrame:
    """(pair, a, b, count, best), stored: in how many documents the pair of ids
    is linked, and whether no pair of the same id of A is linked in more."""
    counts = (aligned.select("copies", F.explode("links.pair").alias("pair")).groupBy("pair").agg(F.sum("copies").alias("count"))
              .withColumns({"a": F.expr(f"pair div {n_b}"), "b": F.col("pair") % n_b}))
    counts = stored(counts, "pair-counts")
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    return stored(counts.join(most, "a").select("pair", "a", "b", "count", (F.col("count") == F.col("most")).alias("best")), "pairs")


def frequent_from(pairs: DataFrame, room: int = TABLE) -> int | None:
    """The smallest power of two such that at most ``room`` pairs count as many;
    None if all pairs fit."""
    power = F.floor(F.log2("count")).cast("int")
    held = dict(pairs.groupBy(power.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())  # at most 63 rows
    total, cut = 0, 64
    for p in sorted(held, reverse=True):
        total += held[p]
        if total > room:
            return 1 << cut if cut < 63 else (1 << 63) - 1
        cut = p
    return None


def measures(docs: DataFrame, aligned: DataFrame, pairs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             room: int = TABLE) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose
    pair is a best one of its id of A), count_sum (over links), groups_sha256."""
    links = aligned.select("k1", "k2", F.explode("links").alias("l")).select("k1", "k2", "l.pair", "l.uses")
    table = pairs.select("pair", "count", "best")
    cut = frequent_from(pairs, room)
    often = F.broadcast(table if cut is None else table.where(F.col("count") >= cut))
    looked_up = [_sums(links.join(often, "pair"))]
    if cut is not None:
        rest = links.join(often.select("pair"), "pair", "left_anti")
        looked_up.append(_sums(rest.join(table.where(F.col("count") < cut), "pair")))
    sums = looked_up[0] if cut is None else looked_up[0].unionByName(looked_up[1])
    sums = sums.groupBy("k1", "k2").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    per_text = aligned.drop("copies", "links").join(sums, ["k1", "k2"], "left")
    per_text = stored(per_text, "text-measures")
    keys = id_text(docs, id_col, text_col).select("doc_id", *text_key(F.col("text")))
    out = keys.join(per_text, ["k1", "k2"], "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    return out.select("doc_id", *numbers, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))


def _sums(links: DataFrame) -> DataFrame:
    return links.groupBy("k1", "k2").agg(
        F.sum(F.when(F.col("best"), F.col("uses")).otherwise(0)).alias("n_best"), F.sum(F.col("uses") * F.col("count")).alias("count_sum"))


def align_documents(docs: DataFrame, tokenizer_path: str, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``measures`` of all documents under the tokenizer and model in two files."""
    import sentencepiece
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer = f.read()
    with open(model_path, "rb") as f:
        model = f.read()
    n_b = sentencepiece.SentencePieceProcessor(model_proto=model).get_piece_size()
    aligned = aligned_texts(docs, tokenizer, model, id_col, text_col)
    return measures(docs, aligned, pair_counts(aligned, n_b), id_col, text_col)
