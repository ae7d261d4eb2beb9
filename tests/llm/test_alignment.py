"""Tokenizer alignment against a token-by-token version over every document."""

import hashlib
from collections import Counter

import pytest

from courtside.llm import alignment

public_tokenizers = pytest.importorskip("public_tokenizers")
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string"


def tokens(text):
    """(id, bytes) of both tokenizers, or nothing."""
    import sentencepiece
    import tokenizers
    a = tokenizers.Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    if not text:
        return [], []
    # byte-level letters, by hand
    plain = list(range(ord("!"), ord("~") + 1)) + list(range(ord("¡"), ord("¬") + 1)) + list(range(ord("®"), ord("ÿ") + 1))
    table, n = {chr(x): x for x in plain}, 0
    for x in range(256):
        if x not in plain:
            table[chr(256 + n)] = x
            n += 1
    ta = [(i, bytes(table[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    tb = []
    for i in b.encode(text):
        p = b.id_to_piece(i)
        tb.append((i, bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    return (ta, tb) if b"".join(x for _, x in ta) == whole == b"".join(x for _, x in tb) else ([], [])


def spans(toks):
    out, at = [], 0
    for i, x in toks:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def by_hand(rows):
    per_doc, counts = [], Counter()
    for _, text in rows:
        a, b = map(spans, tokens(text))
        links = [(i, j) for i, s, e in a for j, u, v in b if s < v and u < e]
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, start = [], 0
        for stop in cuts:
            groups.append(",".join(str(i) for i, s, e in a if start <= s and e <= stop) + "|" + ",".join(str(i) for i, s, e in b if start <= s and e <= stop))
            start = stop
        per_doc.append((a, b, groups, links))
        counts.update(set(links))
    most = {}
    for (i, _), c in counts.items():
        most[i] = max(c, most.get(i, 0))
    return [(d, len(a), len(b), len(g), len(k), sum(counts[x] == most[x[0]] for x in k), sum(counts[x] for x in k),
             hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for (d, _), (a, b, g, k) in zip(rows, per_doc)]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def texts(words):
    import random
    rng = random.Random(2)
    out = [" ".join(rng.choices(words[:60], k=rng.randint(1, 40))) for _ in range(25)]
    out += ["The quick brown fox, isn't it?", "  two  spaces\n\nand\ttabs ", "日本語のテキスト 😀👩‍👩‍👧", "naïve café ﬁne Ⅷ ½", "▁ underscore ▁", "<|endoftext|> <s> </s> <unk> <0x41>",
            "x" * 300, "\u0000\u0001 control", " leading", "é combining", "Ünïcode ß", "a", " ", "\n"]
    return out


def test_equals_the_plain_version(spark, texts):
    rows = list(enumerate(texts)) + [(100 + i, texts[i % 3]) for i in range(12)] + [(None, None), (None, texts[0]), (200, None), (201, ""), (7, texts[7])]
    got = alignment.align_documents(spark.createDataFrame(rows, SCHEMA), A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert rows_of(got) == sorted(by_hand(rows), key=repr)


@pytest.mark.parametrize("room", [0, 40])
def test_pairs_beyond_the_broadcast_table(spark, texts, room):
    rows = list(enumerate(texts)) + [(100 + i, texts[i % 3]) for i in range(12)]
    docs = spark.createDataFrame(rows, SCHEMA)
    with open(A) as f, open(B, "rb") as g:
        aligned = alignment.aligned_texts(docs, f.read(), g.read())
    pairs = alignment.pair_counts(aligned, 32000)
    assert alignment.frequent_from(pairs, room) is not None
    assert rows_of(alignment.measures(docs, aligned, pairs, room=room)) == sorted(by_hand(rows), key=repr)


def test_the_cut_keeps_the_table_small(spark):
    pairs = spark.createDataFrame([(i, n) for i, n in enumerate([1] * 50 + [2, 3, 3, 9, 17])], "pair long, count long")
    assert alignment.frequent_from(pairs, 100) is None
    assert alignment.frequent_from(pairs, 5) == 2 and alignment.frequent_from(pairs, 2) == 8 and alignment.frequent_from(pairs, 1) == 16
    assert alignment.frequent_from(pairs, 0) == (1 << 63) - 1


def test_empty_table_and_clashing_columns(spark):
    assert alignment.align_documents(spark.createDataFrame([], SCHEMA), A, B).collect() == []
    odd = spark.createDataFrame([(1, "a word", 3, 4, "x")], "doc_id long, text string, k1 int, copies int, links string")
    assert rows_of(alignment.align_documents(odd, A, B)) == by_hand([(1, "a word")])


def test_long_text(spark):
    long = " ".join(f"word{i % 97} Tail" for i in range(40000))
    r = alignment.align_documents(spark.createDataFrame([(1, long), (2, long[:40])], SCHEMA), A, B).orderBy("doc_id").collect()
    assert r[0].n_links == r[0].n_a + r[0].n_b - r[0].n_groups and r[0].n_a > 80000


def test_fast_encoding_is_the_tokenizer_s(texts):
    """Every Latin character in front of, behind and between letters, digits,
    spaces and marks; long runs; a file that cuts otherwise."""
    import random

    import tokenizers
    whole = tokenizers.Tokenizer.from_file(A)
    whole.encode_special_tokens = True
    rng = random.Random(5)
    odd = [f"a{chr(i)}b 1{chr(i)}2 {chr(i)}{chr(i)} '{chr(i)} s{chr(i)}'s" for i in range(0x250)]
    alphabet = [" ", "  ", "\n", "\t", "\u00a0", "\u0085", "'s", "'", "'ll", "é", "ß", "ǅ", "½", "²", "ª", "_", "-", "a", "B", "7", "日", "ſ"]
    odd += ["".join(rng.choices(alphabet, k=rng.randint(1, 30))) for _ in range(4000)]
    odd += [" " * 100000 + "x", "x" * 100000, "\n" * 100000, "ab" * 30000 + " " * 999 + "c"]
    with open(A) as f:
        spec = f.read()
    fast = alignment.ByteLevel(spec)
    assert fast.standard
    for t in (odd, texts, []):
        assert fast.encode(t) == [e.ids for e in whole.encode_batch(t, add_special_tokens=False)]
    other = alignment.ByteLevel(spec.replace('"use_regex": true', '"use_regex": false').replace('"use_regex":true', '"use_regex":false'))
    assert not other.standard and other.encode(texts[:5]) == [e.ids for e in other.tok.encode_batch(texts[:5], add_special_tokens=False)]
