import random

from pyspark.sql import functions as F

from courtside.llm import linededup
from courtside.llm.linededup import MIN_CHARS, dedup_lines, line_verdicts


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows):
    """kept line numbers of each distinct (id, text), first places by id."""
    order = sorted({(i is not None, i or 0, i, t) for i, t in rows if t is not None}, key=lambda x: x[:2] + (0,))
    seen, kept = [], {}
    places = []
    for _, _, i, t in order:
        for no, line in enumerate(t.split("\n")):
            places.append(((i, t), no, line))
    for doc, no, line in places:
        if not line.strip(" \t\r\x0b\x0c"):
            kept.setdefault(doc, []).append(no)
            continue
        gone = any(line == s or (max(len(s), len(line)) >= MIN_CHARS and one_edit(line, s)) for s in seen)
        seen.append(line)
        kept.setdefault(doc, [])
        if not gone:
            kept[doc].append(no)
    return kept


def variants(rng, line):
    at = rng.randrange(len(line))
    return rng.choice([line[:at] + line[at + 1:], line[:at] + "é" + line[at:], line[:at] + "Q" + line[at + 1:], line,
                       line[:at] + "zz" + line[at + 1:]])


def corpus(rng, n):
    base = ["".join(rng.choice("ab cdé") for _ in range(rng.choice([2, 4, 5, 6, 9, 40, 130, 200]))) for _ in range(60)]
    lines = base + [variants(rng, x) for x in base for _ in range(4) if x]
    lines += [f"Template line number {c} of many" for c in "0123456789abcdefgh"] + ["", "  "]
    return [(i, "\n".join(rng.choices(lines, k=rng.randrange(1, 12)))) for i in range(n)]


def run(docs):
    return {(r.doc_id, r.n_lines): sorted(r.kept_lines) for r in line_verdicts(docs).collect()}


def test_matches_brute_force(docs_of, monkeypatch):
    for seed, block, piece in ((1, 64, 3), (2, 4, 8), (3, 4, 1), (4, 1, 30)):
        monkeypatch.setattr(linededup, "BLOCK", block)
        monkeypatch.setattr(linededup, "PIECE", piece)
        rows = corpus(random.Random(seed), 60)
        want = {(i, len(t.split("\n"))): kept for (i, t), kept in brute(rows).items()}
        assert run(docs_of(rows)) == want


def test_texts_and_odd_rows(docs_of, odd_rows):
    rows = odd_rows + [(30, "first line here\nsecond line there\n\nfirst line here"), (31, "First line here\nthird\n"),
                       (32, "a\nb\n" + "y" * 5000 + "x" + "y" * 5000), (33, "y" * 10001)]
    docs = docs_of(rows).selectExpr("*", "1 as dk", "2 as line", "3 as place")
    out = dedup_lines(docs)
    assert out.columns == docs.columns
    got = out.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    text = {r.doc_id: r.text for r in got}
    assert text[30] == "first line here\nsecond line there\n" and text[31] == "third\n"
    assert text[1] is None and text[2] == "" and text[3] == " \n\t " and text[33] == ""
    assert [r.text for r in got if r.doc_id == 4] == ["tie", "tie"] and text[5] == ""
    assert dedup_lines(docs.where("false")).count() == 0
    assert line_verdicts(docs).where(F.col("n_kept") > F.col("n_lines")).count() == 0


def test_a_family_that_differs_by_words_emits_no_variants(docs_of):
    """Copies of one line with a word replaced agree in a half, not in all but a
    piece; those with a character replaced are found among them."""
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(14)]
    lines = []
    for i in range(300):
        copy = list(words)
        copy[rng.randrange(14)] = "".join(rng.choice("ijklmnop") for _ in range(6))
        lines.append(" ".join(copy))
    lines += [lines[7][:20] + "Z" + lines[7][21:], lines[8][:50] + lines[8][51:]]
    docs = docs_of(list(enumerate(lines)))
    d = linededup._keyed(docs, "doc_id", "text")
    classes = linededup.line_classes(d)
    found = linededup.candidates(classes)
    assert found.select("k1").distinct().count() > 290
    texts = classes.join(linededup._lines(d).selectExpr("dk", "line"), F.col("place.dk") == F.col("dk")).select("k1", "k2", "place", "n", "line")
    assert linededup._variants(linededup.narrowed(texts.join(found, "k1"))).count() < 600  # of 2 * 49 * 300
    gone = {r.doc_id for r in line_verdicts(docs).collect() if r.n_kept == 0}
    assert gone == {i for i, _ in enumerate(lines) if any(one_edit(lines[i], x) or lines[i] == x for x in lines[:i])} >= {300, 301}
