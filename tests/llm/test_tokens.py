import random
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from courtside.llm.tokens import (  # noqa: E402
    END_ID, MIN_COUNT, Encoder, Shard, expand, packed, read_digests, read_ids, repair, shard_bytes, unpacked, write_shards,
)

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(PATH)


def test_words_alone_equal_whole_texts(tok):
    rng = random.Random(1)
    parts = ["Hello", "don't", "x's", "'s", "é", "é", "́", "İ", "ΑΣ", "日本", "123", "#!?", "<|endoftext|>", "<|", "a<|startoftext|>b",
             " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", " ", "\r\n", "ﬁ", "½", "_", "​", "🙂", "w" * 300]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(600)]
    coder = Encoder(open(PATH, encoding="utf-8").read(), cache_words=50)
    for a in range(0, 600, 37):
        for t, got in zip(texts[a:a + 37], coder.encode(texts[a:a + 37])):
            assert got.tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("n,kinds", [(0, 1), (1, 5), (2, 1), (5000, 1), (5000, 3), (20000, 50), (3000, 40000)])
def test_repair_round_trip_and_random_access(n, kinds):
    rng = np.random.default_rng(n + kinds)
    ids = rng.integers(0, kinds, n).astype(np.uint32)
    if n == 20000:
        ids = np.concatenate([rng.permutation(np.tile([7, 8, 9, 10], 2500)), np.tile([7, 8, 9, 10, 11], 2000)]).astype(np.uint32)
    seq, rules, lengths, first = repair(ids, 8)
    assert expand(seq, rules, lengths, first).tolist() == ids.tolist()
    assert [len(expand(np.array([first + i]), rules, lengths, first)) for i in range(min(40, len(rules)))] == lengths[:40].tolist()
    if kinds <= 50 and n >= 5000:
        assert len(rules) and len(seq) + 3 * len(rules) < len(ids)
    shard = Shard(shard_bytes([1], np.array([n]), ids, 8))
    for _ in range(50):
        a, b = sorted(rng.integers(0, n + 1, 2).tolist())
        assert shard.decode(a, b).tolist() == ids[a:b].tolist()


def test_files_on_spark(docs_of, odd_rows, words, tok, tmp_path):
    rng = random.Random(3)
    rows = odd_rows + [(100 - i, " ".join(rng.choices(words[:300], k=rng.randrange(200)))) for i in range(60)]
    docs = docs_of(rows).repartition(3).selectExpr("*", "1 as shard", "2 as seq", "3 as part")
    shards = write_shards(docs, PATH, str(tmp_path / "t"), shard_ids=3000, least=8)
    assert shards.count() > 3
    want, at = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [END_ID]
        want.append((i, at, ids))
        at += len(ids)
    got = sorted((tuple(r) for r in read_ids(shards).collect()), key=lambda r: r[1])
    assert [(a, b, list(c)) for a, b, c in got] == want
    digests = {r.start: (r.doc_id, r.n_tokens, r.ids_crc32) for r in read_digests(shards).collect()}
    assert digests == {s: (i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, s, x in want}
    assert read_ids(write_shards(docs.where("false"), PATH, str(tmp_path / "e"))).count() == 0


def test_rows_of_one_id_are_dealt_over_tasks(docs_of, words, tok, tmp_path):
    """Half of the rows have no id or the same one: in order, in many parts."""
    rng = random.Random(4)
    rows = [(i if i % 2 else [None, 7][i % 4 == 0], " ".join(rng.choices(words, k=20))) for i in range(400)]
    docs = docs_of(rows).repartition(8)
    shards = write_shards(docs, PATH, str(tmp_path / "h"))
    assert shards.select("part").distinct().count() >= 6 and max(r.n_docs for r in shards.collect()) < 150
    got = sorted((tuple(r) for r in read_ids(shards).collect()), key=lambda r: r[1])
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    assert [(a, list(c)) for a, _, c in got] == [(i, tok.encode(t, add_special_tokens=False).ids + [END_ID]) for i, t in want]
    assert [b for _, b, _ in got] == [0, *np.cumsum([len(c) for _, _, c in got])[:-1].tolist()]


def test_every_plain_character_beside_every_kind(tok):
    kinds = ["a", "S", "7", "'", "'s", "é", "ß", "!", "<|"]
    chars = [chr(c) for c in [*range(33, 127), *range(0xA1, 0x180)]]
    texts = [f"{a}{c}{b} {c}{c} {b}{c}'ll" for c in chars for a in kinds for b in kinds]
    coder = Encoder(open(PATH, encoding="utf-8").read())
    for t, got in zip(texts, coder.encode(texts)):
        assert got.tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_another_tokenizer_gets_whole_texts(tok):
    assert Encoder(open(PATH, encoding="utf-8").read()).wordwise
    path = public_tokenizers.path("byte_bpe_50k.json")
    other, whole = Encoder(open(path, encoding="utf-8").read()), Tokenizer.from_file(path)
    texts = ["Hello  there\n\n World", None, "", "a <|endoftext|> b", "don't  X"]
    assert not other.wordwise
    assert [x.tolist() for x in other.encode(texts)] == [whole.encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("bits,n", [(1, 0), (1, 9), (7, 100), (17, 1001), (32, 5)])
def test_bit_packing(bits, n):
    values = np.random.default_rng(bits).integers(0, 1 << bits, n).astype(np.uint32)
    data = b"xy" + packed(values, bits) + b"z"
    got, at = unpacked(data, 2, n, bits)
    assert got.tolist() == values.tolist() and at == len(data) - 1 and len(data) == 3 + (n * bits + 7) // 8


def test_rules_go_down_to_the_break_even():
    """No pair is left that occurs as often as a rule pays for."""
    rng = np.random.default_rng(2)
    ids = (rng.pareto(1.0, 30000) * 5).astype(np.uint32) % 500
    seq, rules, lengths, first = repair(ids)
    pairs = seq[:-1].astype(np.uint64) << np.uint64(32) | seq[1:]
    kinds, count = np.unique(pairs, return_counts=True)
    left = kinds[count >= MIN_COUNT]
    assert MIN_COUNT == 4 and all(p >> np.uint64(32) == p & np.uint64(0xFFFFFFFF) for p in left)  # of one id: overlaps
    assert len(seq) + 3 * len(rules) < len(ids)


class Counted:
    """A tokenizer that counts the texts it is given."""

    def __init__(self, tok):
        self.tok, self.texts = tok, []

    def encode_batch_fast(self, texts, **how):
        self.texts += texts
        return self.tok.encode_batch_fast(texts, **how)


def test_new_pieces_reach_the_tokenizer_many_at_a_time(tok):
    rng = random.Random(5)
    words = ["".join(rng.choices("aeioustrnléß", k=9)) + rng.choice(["", ",", "'s", "7"]) for _ in range(4000)]
    words += ["日本", "<|endoftext|>", "a<|", "\x01", "İ", "<", "|>"]
    texts = [" ".join(rng.choices(words, k=200)).title() for _ in range(100)]
    coder = Encoder(open(PATH, encoding="utf-8").read())
    coder.tok = Counted(coder.tok)
    for t, got in zip(texts, coder.encode(texts)):
        assert got.tolist() == tok.encode(t, add_special_tokens=False).ids
    assert len(coder.pieces) > 3000 and len(coder.tok.texts) < 1300  # pieces beside others that must go alone, go alone
    coder.tok.texts.clear()
    coder.encode([" ".join(f"zq{'q' * i}" for i in range(900))])
    assert len(coder.tok.texts) == 1


def test_a_full_memory_keeps_the_pieces_that_came_again(tok):
    coder = Encoder(open(PATH, encoding="utf-8").read(), cache_words=400)
    coder.tok = Counted(coder.tok)
    common = [f"common{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(100)]
    for k in range(12):
        text = " ".join([*common, *(f"rare{chr(97 + k)}{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(100))])
        assert coder.encode([text])[0].tolist() == tok.encode(text, add_special_tokens=False).ids
        assert len(coder.pieces) <= 600 and len(coder.pieces) == coder.piece_ids.n
    assert sum(t.split().count("commonaa") for t in coder.tok.texts) == 1


def test_pairs_too_wide_for_one_number_give_the_same_grammar():
    """Ids near 2 ** 31 beside small ones in the same order: same rules."""
    rng = np.random.default_rng(6)
    small = (rng.pareto(1.0, 20000) * 5).astype(np.uint32) % 300
    seq, rules, lengths, first = repair(small)
    far = np.uint32(1 << 31)
    wide = repair(small + far)
    assert [wide[0].tolist(), wide[1].tolist(), wide[3]] == [(seq + far).tolist(), (rules + far).tolist(), first + far]
    assert wide[2].tolist() == lengths.tolist()
    assert expand(wide[0], wide[1], wide[2], wide[3]).tolist() == (small + far).tolist()
