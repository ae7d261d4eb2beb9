"""Operator 2: token ids in binary files under Re-Pair grammar compression.

Documents are range-partitioned by id and written in that order: each task
encodes its texts, appends the end id to each and writes shards of about
``SHARD_IDS`` ids. Within a shard, Re-Pair replaces frequent pairs of ids by
nonterminals, round after round, until no pair occurs ``MIN_COUNT`` times, fewer
than a rule pays for; the file keeps the rules and how many ids each nonterminal
stands for, so any range of ids is decoded without the rest.

A shard file, little-endian: magic ``RPID0002``; longs n_docs, n_ids, n_rules,
n_symbols, first nonterminal, bits a symbol, bits a length; doc ids (long) and
whether they are null (byte); the end of each document (long); then bit-packed,
each from a new byte: the rules (left, right), the length of each rule's
expansion, the sequence.

Encoding a text equals encoding its pieces between ASCII white space (the
tokenizer drops white space and never joins across it), so each worker keeps the
ids of the pieces of words it has met, within ``CACHE_WORDS``, and the tokenizer
sees the same one seldom twice.

Null text is empty: a document of the end id alone. A null id sorts first. Rows
that repeat an id follow each other by text. Nothing is written for an empty
table. Positions count all ids of all documents before, end ids included.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courtside.llm.common import id_text, map_arrow, open_path, stored, work_dir

END_ID = 2
SHARD_IDS = 1 << 20
CACHE_WORDS = 600_000
MIN_COUNT = 4         # a pair is frequent if it occurs this often in a shard: a rule costs three numbers, each use saves one
MAGIC = b"RPID0002"
READ_SHARDS = 4       # that a task reads back, one after the other
SPAN = 1 << 23        # bytes of texts whose words are told apart at a time
JOINED = 1000         # pieces that the tokenizer gets as one text
_SUFFIX = "</w>"
_PLAIN = "[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+"
_PLAIN_WORD = re.compile(_PLAIN)
# The tokenizer's pattern, for lower-case words of those characters.
_PIECE = "('s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+)"


# ---------------------------------------------------------------- grammar

def frequent(seq: np.ndarray, maybe: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Those of the positions ``maybe`` whose pair (with the next symbol) is there
    ``least`` times, the number of each one's pair, and the pairs (left, right)."""
    left, right = seq[maybe].astype(np.uint64), seq[maybe + 1].astype(np.uint64)
    wide, long = np.uint64(int(seq.max()).bit_length()), np.uint64(len(maybe).bit_length())
    pair = left << wide | right
    if 2 * wide + long <= 64:  # pair and place fit one number: a plain sort is several times as fast as one of places
        key = np.sort(pair << long | np.arange(len(maybe), dtype=np.uint64))
        pair, place = key >> long, (key & ((np.uint64(1) << long) - np.uint64(1))).astype(np.int64)
    else:
        place = np.argsort(pair, kind="stable")
        pair = pair[place]
    head = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
    count = np.diff(np.append(head, len(pair)))
    keep = count >= least
    kind = np.empty(len(maybe), np.int32)
    kind[place] = np.repeat(np.where(keep, np.cumsum(keep) - 1, -1).astype(np.int32), count)
    hit = kind >= 0
    kinds = pair[head[keep]]
    return maybe[hit], kind[hit], np.stack([kinds >> wide, kinds & ((np.uint64(1) << wide) - np.uint64(1))], axis=1).astype(np.uint32)


def repair(ids: np.ndarray, least: int = MIN_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(sequence, rules (n, 2), expansion lengths, first nonterminal). Rule i
    makes the symbol first nonterminal + i."""
    seq = ids.astype(np.uint32)
    first = int(seq.max()) + 1 if len(seq) else 0
    rules, lengths = np.empty((0, 2), np.uint32), np.empty(0, np.int64)
    maybe = np.arange(len(seq) - 1)
    while len(maybe):
        at, kind, pairs = frequent(seq, maybe, least)
        # of overlapping pairs every other one is taken, from the left
        start = np.flatnonzero(np.diff(at, prepend=-2) != 1)
        step = np.arange(len(at)) - np.repeat(start, np.diff(start, append=len(at)))
        taken = step & 1 == 0
        worth = np.bincount(kind[taken], minlength=len(pairs)) >= 4  # a rule costs three words; each use saves one
        if not worth.any():
            break
        name = np.cumsum(worth) - 1 + first + len(rules)
        use = taken & worth[kind]
        put = at[use]
        both = pairs[worth]
        size = np.ones(both.shape, np.int64)
        made = both >= first
        size[made] = lengths[both[made] - first]
        rules, lengths = np.concatenate([rules, both]), np.concatenate([lengths, size.sum(axis=1)])
        seq[put] = name[kind[use]]
        # a pair of older symbols only grows rarer: frequent next are pairs of a new symbol, or those frequent now
        near, rest = np.zeros(len(seq), bool), np.ones(len(seq), bool)
        near[at], near[put], near[np.maximum(put - 1, 0)] = True, True, True
        rest[put + 1] = False
        seq, near = seq[rest], near[rest]
        maybe = np.flatnonzero(near[:-1])
    return seq, rules, lengths, first


def expand(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, first: int) -> np.ndarray:
    """The ids that a stretch of symbols stands for."""
    symbol = symbols.astype(np.uint32)
    if not len(rules):
        return symbol
    made = rules[:, 0] >= first
    left = np.ones(len(rules), np.int64)
    left[made] = lengths[rules[made, 0] - first]
    made = symbol >= first
    size = np.ones(len(symbol), np.int64)
    size[made] = lengths[symbol[made] - first]
    upto = np.cumsum(size)
    out = np.empty(upto[-1] if len(upto) else 0, np.uint32)
    at = upto - size
    while len(symbol):  # an id is put in its place once, a nonterminal gives way to its two
        made = symbol >= first
        out[at[~made]] = symbol[~made]
        rule, at = symbol[made] - first, at[made]
        symbol, at = np.concatenate([rules[rule, 0], rules[rule, 1]]), np.concatenate([at, at + left[rule]])
    return out


def packed(values: np.ndarray, bits: int) -> bytes:
    """Numbers below 2 ** bits, end to end. Eight of them fill whole bytes."""
    rows = np.zeros((-(-len(values) // 8), 8), np.uint64)
    rows.reshape(-1)[:len(values)] = values
    words = np.zeros((len(rows), -(-bits // 8)), "<u8")
    for j in range(8):
        k, off = divmod(j * bits, 64)
        words[:, k] |= rows[:, j] << np.uint64(off)
        if off + bits > 64:
            words[:, k + 1] |= rows[:, j] >> np.uint64(64 - off)
    return words.view(np.uint8)[:, :bits].tobytes()[:(len(values) * bits + 7) // 8]


def unpacked(data: bytes, at: int, n: int, bits: int) -> tuple[np.ndarray, int]:
    """n numbers from ``at``, and the place behind them."""
    size, rows = (n * bits + 7) // 8, -(-n // 8)
    whole = np.zeros(rows * bits, np.uint8)
    whole[:size] = np.frombuffer(data, np.uint8, size, at)
    wide = np.zeros((rows, 8 * -(-bits // 8)), np.uint8)
    wide[:, :bits] = whole.reshape(rows, bits)
    words, out = wide.view("<u8"), np.empty((rows, 8), np.uint32)
    for j in range(8):
        k, off = divmod(j * bits, 64)
        value = words[:, k] >> np.uint64(off)
        if off + bits > 64:
            value |= words[:, k + 1] << np.uint64(64 - off)
        out[:, j] = value & np.uint64((1 << bits) - 1)
    return out.ravel()[:n], at + size


class Shard:
    """A shard file's bytes, decoded as asked for."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a shard")
        n_docs, self.n_ids, n_rules, n_symbols, self.first, bits, length_bits = np.frombuffer(data, "<i8", 7, 8).tolist()
        at = 64
        self.doc_ids = np.frombuffer(data, "<i8", n_docs, at)
        self.null = np.frombuffer(data, np.bool_, n_docs, at := at + 8 * n_docs)
        self.ends = np.frombuffer(data, "<i8", n_docs, at := at + n_docs)
        rules, at = unpacked(data, at + 8 * n_docs, 2 * n_rules, bits)
        self.rules = rules.reshape(-1, 2)
        lengths, at = unpacked(data, at, n_rules, length_bits)
        self.lengths = lengths.astype(np.int64)
        self.seq, _ = unpacked(data, at, n_symbols, bits)
        size = np.ones(n_symbols, np.int64)
        made = self.seq >= self.first
        size[made] = self.lengths[self.seq[made] - self.first]
        self.upto = np.cumsum(size)

    def decode(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the shard: only the symbols over them are expanded."""
        if stop <= start:
            return np.empty(0, np.uint32)
        a, b = np.searchsorted(self.upto, [start, stop - 1], "right")
        before = int(self.upto[a - 1]) if a else 0
        return expand(self.seq[a:b + 1], self.rules, self.lengths, self.first)[start - before:stop - before]


def shard_bytes(doc_ids: list, ends: np.ndarray, ids: np.ndarray, least: int = MIN_COUNT) -> bytes:
    seq, rules, lengths, first = repair(ids, least)
    bits = max(1, (first + len(rules) - 1).bit_length()) if len(seq) else 1
    length_bits = max(1, int(lengths.max(initial=0)).bit_length())
    head = np.array([len(doc_ids), len(ids), len(rules), len(seq), first, bits, length_bits], "<i8")
    names = np.array([0 if d is None else d for d in doc_ids], "<i8")
    null = np.array([d is None for d in doc_ids], np.bool_)
    return b"".join([MAGIC, head.tobytes(), names.tobytes(), null.tobytes(), ends.astype("<i8").tobytes(),
                     packed(rules.ravel(), bits), packed(lengths, length_bits), packed(seq, bits)])


# ---------------------------------------------------------------- encoding

class Numbers(dict):
    """Numbers its keys in the order they are first asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class Ragged:
    """A growing list of id sequences in one flat array."""

    def __init__(self):
        self.flat, self.used, self.n = np.empty(1 << 20, np.uint32), 0, 0
        self.start, self.size = np.empty(1 << 18, np.int64), np.empty(1 << 18, np.int64)

    def extend(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while self.n + len(sizes) > len(self.start):
            self.start, self.size = (np.concatenate([x, np.empty_like(x)]) for x in (self.start, self.size))
        self.flat[self.used:self.used + len(flat)] = flat
        self.size[self.n:self.n + len(sizes)] = sizes
        self.start[self.n:self.n + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.used, self.n = self.used + len(flat), self.n + len(sizes)

    def pick(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sequences numbered ``which``, end to end, and their sizes."""
        size = self.size[which]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.arange(total) + np.repeat(self.start[which] - ends + size, size)], size


# How a tokenizer that works word by word says so in its file.
_WORDWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}


class Encoder:
    """Texts to ids through a bounded memory of the pieces of words.

    The words of some texts are told apart first, so what follows is done once
    for each. The tokenizer lower-cases and then cuts a word by its own pattern.
    For words of ASCII and Latin-1 letters that cut is plain (``_PIECE``), so
    those are learned piece by piece; any other word is encoded as it stands. A
    tokenizer whose file says that it normalises or cuts otherwise gets whole
    texts."""

    def __init__(self, tokenizer: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok, self.limit, spec = Tokenizer.from_str(tokenizer), cache_words, json.loads(tokenizer)
        self.wordwise = all(spec.get(k) == v for k, v in _WORDWISE.items()) and not any(
            t["normalized"] or t["lstrip"] or t["rstrip"] or not t["content"].startswith("<|") for t in spec["added_tokens"])
        # every piece of a wordwise tokenizer ends in the one token that has the suffix
        vocabulary = self.tok.get_vocab()
        self.last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith(_SUFFIX)]] = True
        self.wordwise &= spec["model"].get("end_of_word_suffix") == _SUFFIX
        self.pieces, self.piece_ids = Numbers(), Ragged()
        self.uses = np.zeros(1 << 18, np.int32)  # by how many stretches of text

    def forget(self) -> None:
        """Keep the pieces met again since the last time, half of the limit at most."""
        again = np.flatnonzero(self.uses[:len(self.pieces)] > 1)[:self.limit // 2]
        names, ids = list(self.pieces), self.piece_ids.pick(again)
        self.pieces, self.piece_ids = Numbers((names[i], n) for n, i in enumerate(again.tolist())), Ragged()
        self.piece_ids.extend(*ids)
        self.uses[:] = 0

    def ids_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts, end to end, and how many each has."""
        got = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array(list(itertools.chain.from_iterable(got)), np.uint32), np.array([len(x) for x in got], np.int64)

    def learn(self, fresh: list[str]) -> None:
        """Ids of pieces, and of words that are not cut. Plain pieces go to the
        tokenizer many to a text."""
        plain = [bool(_PLAIN_WORD.fullmatch(x)) and "<|" not in x for x in fresh]
        easy = list(itertools.compress(fresh, plain))
        got = []
        for a in range(0, len(easy), JOINED):
            some = easy[a:a + JOINED]
            flat, _ = self.ids_of([" ".join(some)])
            ends = np.flatnonzero(self.last[flat]) + 1
            whole = len(ends) == len(some) and ends[-1] == len(flat)
            got.append((flat, np.diff(ends, prepend=0)) if whole else self.ids_of(some))
        got.append(self.ids_of([x for x, p in zip(fresh, plain) if not p]))
        found = Ragged()
        found.extend(*map(np.concatenate, zip(*got)))
        is_easy = np.array(plain, bool)
        self.piece_ids.extend(*found.pick(np.where(is_easy, np.cumsum(is_easy) - 1, len(easy) + np.cumsum(~is_easy) - 1)))

    def words(self, kinds: pa.Array) -> Ragged:
        """The ids of each word."""
        if len(self.pieces) > self.limit:
            self.forget()
        plain = pc.and_not(pc.match_substring_regex(kinds, f"^{_PLAIN}$"), pc.match_substring(kinds, "<|"))
        cut = pc.ascii_split_whitespace(pc.if_else(plain, pc.replace_substring_regex(pc.utf8_lower(kinds), _PIECE, r"\1 "), kinds))
        each = cut.flatten().dictionary_encode()
        names = pc.binary_join(pa.ListArray.from_arrays([0, len(each.dictionary)], each.dictionary), " ")[0].as_py().split(" ") if len(each) else []
        which = np.fromiter(map(self.pieces.__getitem__, names), np.int64, len(names))
        if len(self.pieces) > self.piece_ids.n:
            self.learn(list(itertools.islice(self.pieces, self.piece_ids.n, None)))
        while len(self.uses) < len(self.pieces):
            self.uses = np.concatenate([self.uses, np.zeros_like(self.uses)])
        self.uses[which] += 1
        flat, size = self.piece_ids.pick(which[each.indices.to_numpy()])
        upto = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(pc.list_value_length(cut).to_numpy()))]
        out = Ragged()
        out.extend(flat, np.diff(upto))
        return out

    def encode(self, texts: list[str | None] | pa.Array) -> list[np.ndarray]:
        """The ids of each text, without an end id."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        if not self.wordwise:
            flat, size = self.ids_of(texts.to_pylist())
            return np.split(flat, np.cumsum(size)[:-1]) if len(size) else []
        cut = pc.ascii_split_whitespace(texts)
        each = cut.flatten().dictionary_encode()
        flat, size = self.words(each.dictionary).pick(each.indices.to_numpy())
        ends = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(pc.list_value_length(cut).to_numpy()))]
        return [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def slices(column: pa.Array, size: int):
    """Stretches of texts of about ``size`` bytes or one text."""
    part = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // size
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(column)]
    return ((a, b) for a, b in zip(edges, edges[1:]) if a < b)


_ENCODERS: dict[str, Encoder] = {}


def write_shards(docs: DataFrame, tokenizer_path: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                 end_id: int = END_ID, shard_ids: int = SHARD_IDS, least: int = MIN_COUNT) -> DataFrame:
    """Write the shards; a stored list of them: shard, part, seq (their order),
    n_docs, n_ids, bytes."""
    spark = docs.sparkSession
    path = path or work_dir(spark, "tokens")
    with open(tokenizer_path, encoding="utf-8") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())  # one file of a few MB, read on the driver only
    token = uuid.uuid4().hex

    def write(batches):
        if token not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[token] = Encoder(vocabulary.value)
        encoder = _ENCODERS[token]
        fs, folder = open_path(path)
        fs.create_dir(folder, recursive=True)
        names, parts, held, seq = [], [], 0, 0

        def flush(part):
            name = f"{folder}/{part:06d}-{seq:06d}-{uuid.uuid4().hex}"
            ends = np.cumsum([len(x) for x in parts])
            data = shard_bytes(names, ends, np.concatenate(parts), least)
            with fs.open_output_stream(f"{name}.part", compression=None) as out:
                out.write(data)
            fs.move(f"{name}.part", f"{name}.rpid")
            return {"shard": [f"{path.rstrip('/')}/{name.rsplit('/', 1)[1]}.rpid"], "part": [part], "seq": [seq],
                    "n_docs": [len(names)], "n_ids": [int(ends[-1])], "bytes": [len(data)]}

        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for a, b in slices(texts, SPAN):
                for doc_id, got in zip(ids[a:b], encoder.encode(texts.slice(a, b - a))):
                    names.append(doc_id)
                    parts.append(np.append(got, np.uint32(end_id)))
                    held += len(got) + 1
                    if held >= shard_ids:
                        yield flush(part)
                        names, parts, held, seq = [], [], 0, seq + 1
        if names:
            yield flush(part)

    n = max(1, docs.rdd.getNumPartitions())
    # rows of one id, or without an id, may be many: their texts' beginnings deal them on
    dealt = (id_text(docs, id_col, text_col).repartitionByRange(n, F.col("doc_id"), F.substring("text", 1, 64))
             .sortWithinPartitions("doc_id", "text"))
    listed = map_arrow(dealt, "shard string, part int, seq int, n_docs long, n_ids long, bytes long", write)
    return stored(listed, "token-shards")


def with_starts(shards: DataFrame) -> DataFrame:
    """The list with ``start``, the ids of all shards before: summed over the
    parts first (a row a task), then within each part."""
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each writing task
    base = parts.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return (shards.join(base, "part")
            .withColumn("start", F.col("base") + F.coalesce(F.sum("n_ids").over(within), F.lit(0))).drop("base"))


def _documents(shards: DataFrame, schema: str, make) -> DataFrame:
    """``make(doc_id, start, ids)`` of every document of the listed shards."""
    def run(batches):
        for batch in batches:
            for name, base in zip(batch.column("shard").to_pylist(), batch.column("start").to_pylist()):
                fs, p = open_path(name)
                with fs.open_input_stream(p, compression=None) as f:
                    shard = Shard(f.read())
                ids = shard.decode(0, shard.n_ids)
                out, begin = {}, 0
                for doc_id, null, end in zip(shard.doc_ids.tolist(), shard.null.tolist(), shard.ends.tolist()):
                    for k, v in make(None if null else doc_id, base + begin, ids[begin:end]).items():
                        out.setdefault(k, []).append(v)
                    begin = end
                yield out
    n = max(1, shards.count() // READ_SHARDS)
    return map_arrow(with_starts(shards).select("shard", "start").repartitionByRange(n, "start"), schema, run)


def read_ids(shards: DataFrame) -> DataFrame:
    """doc_id, start, ids of every document, read back from the files."""
    return _documents(shards, "doc_id long, start long, ids array<long>", lambda d, s, x: {"doc_id": d, "start": s, "ids": x.tolist()})


def read_digests(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned
    32-bit integers), read back from the files."""
    return _documents(shards, "doc_id long, start long, n_tokens long, ids_crc32 long",
                      lambda d, s, x: {"doc_id": d, "start": s, "n_tokens": len(x), "ids_crc32": zlib.crc32(x.astype("<u4").tobytes())})
