import io
import random
import zlib

import pytest

from courtside.llm import warc
from courtside.llm.warc import archive_list, encode_record, member, read_archives, read_gaps, salvage, sha1, write_archives


def body(i):
    rng = random.Random(i)
    return (f"<html>{i} " + " ".join(rng.choice(["WARC/1.1", "\x1f", "ünï", "text", "\r\n\r\n"]) for _ in range(400 + 40 * i))).encode()


def archive(n, packed=True):
    wrap = member if packed else (lambda r: r)
    parts = [wrap(encode_record(i, f"http://h/{i}", body(i), None)) for i in range(n)]
    ends = [0]
    for p in parts:
        ends.append(ends[-1] + len(p))
    return bytearray(b"".join(parts)), ends


def read(data):
    out = list(salvage(io.BytesIO(bytes(data))))
    return ({int(x[2]["x-page-id"]): x[3] for x in out if x[0] == "record"}, [x[1:3] for x in out if x[0] == "gap"])


@pytest.mark.parametrize("packed", [True, False])
@pytest.mark.parametrize("chunk", [64, 1 << 20])
def test_round_trip(packed, chunk, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", chunk)
    data, _ = archive(12, packed)
    assert read(data) == ({i: body(i) for i in range(12)}, [])
    assert read(b"") == ({}, [])


@pytest.mark.parametrize("packed", [True, False])
@pytest.mark.parametrize("chunk", [300, 1 << 20])
def test_salvage(packed, chunk, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", chunk)
    data, ends = archive(12, packed)
    hurt = bytearray(data)
    hurt[ends[3] + (150 if packed else 900)] ^= 0x5A                                   # a flipped byte in record 3
    hurt[ends[6]:ends[7]] = b"\0" * (ends[7] - ends[6])              # record 6 blanked
    cut = hurt[:ends[9]] + hurt[ends[9] + 40:ends[11] + 60]          # record 9 loses its head, 11 its tail
    found, gaps = read(cut)
    assert found == {i: body(i) for i in range(12) if i not in (3, 6, 9, 11)}
    assert gaps == [(ends[3], ends[4]), (ends[6], ends[7]), (ends[9], ends[10] - 40), (ends[11] - 40, len(cut))]


def test_two_members_lost_and_foreign_bytes():
    data, ends = archive(6)
    mixed = b"junk \x1f\x8b\x08 more" + data[:ends[2]] + b"\x1f\x8b\x08\0" + zlib.compress(b"x") + data[ends[2]:]
    found, gaps = read(mixed)
    assert sorted(found) == list(range(6)) and len(gaps) == 2


def test_write_and_read_on_spark(spark, tmp_path):
    rows = [(1, "u1", "same"), (2, "u2", "same"), (9, None, "same"), (3, "u\n3", ""), (4, "u4", None), (5, "u5", "x" * 300000),
            (None, "u", "same"), (6, "u6", "twice"), (6, "u6", "twice"), (7, "ü", "日本")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as refers_to")
    archives = write_archives(pages, str(tmp_path / "w"), per_archive=3)
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in read_archives(archives).collect()), key=repr)
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        to = {1: 9, 2: 9, 3: 4}.get(i)
        want.append((i, "revisit" if to else "response", to, len(raw), sha1(raw)))
    assert got == sorted(want, key=repr)
    assert read_gaps(archives).count() == 0
    # smaller payloads are all responses
    big = write_archives(pages, str(tmp_path / "v"), min_bytes=5)
    assert {r.page_id for r in read_archives(big).collect() if r.record_type == "revisit"} == set()
    assert read_archives(write_archives(pages.where("false"), str(tmp_path / "e"))).count() == 0


def test_quarantine_log_on_spark(spark, tmp_path):
    data, ends = archive(8)
    data[ends[2] + 100] ^= 0xFF
    (tmp_path / "a.warc.gz").write_bytes(data)
    found = archive_list(spark, [str(tmp_path / "a.warc.gz")])
    assert sorted(r.page_id for r in read_archives(found).collect()) == [0, 1, 3, 4, 5, 6, 7]
    assert [(r.start, r.end) for r in read_gaps(found).collect()] == [(ends[2], ends[3])]


def gz(*records):
    return member(b"".join(records))


@pytest.mark.parametrize("chunk", [200, 1 << 20])
def test_members_of_many_records(chunk, monkeypatch):
    """Sound records of a member are kept, whatever follows them."""
    monkeypatch.setattr(warc, "CHUNK", chunk)
    r = [encode_record(i, None, body(i), None) for i in range(9)]
    assert read(gz(*r)) == ({i: body(i) for i in range(9)}, [])
    bad = bytearray(r[4])
    bad[900] ^= 0x5A
    data = gz(*r[:4], bytes(bad), *r[5:7]) + gz(r[7]) + gz(r[8])
    found, gaps = read(data)
    assert found == {i: body(i) for i in (0, 1, 2, 3, 5, 6, 7, 8)} and gaps == [(0, len(gz(*r[:4], bytes(bad), *r[5:7])))]
    # cut in the middle of the stream, and one with a wrong check sum
    whole = gz(*r[:6])
    found, gaps = read(whole[:len(whole) * 2 // 3] + gz(r[7]))
    assert {0, 1, 7} <= set(found) <= {0, 1, 2, 3, 4, 7} and all(found[i] == body(i) for i in found) and len(gaps) == 1
    spoilt = bytearray(gz(*r[:3]))
    spoilt[-6] ^= 1
    # only the check sum is wrong: some header is, and no record can be trusted
    assert read(bytes(spoilt) + gz(r[7])) == ({7: body(7)}, [(0, len(spoilt))])
    # a record's digest shows where the damage is
    import struct
    whole = gz(*r[:2], bytes(bad), r[5])
    found, gaps = read(whole[:-8] + struct.pack("<I", zlib.crc32(b"other")) + whole[-4:] + gz(r[7]))
    assert found == {i: body(i) for i in (0, 1, 5, 7)} and gaps == [(0, len(whole))]
    reason = [x[3] for x in salvage(io.BytesIO(whole)) if x[0] == "gap"]
    assert reason == ["block digest differs; 3 records recovered"]


def test_members_longer_than_what_is_held(monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 3000)
    monkeypatch.setattr(warc, "LARGE", 20000)
    r = [encode_record(i, None, body(i), None) for i in range(40)]
    bad = bytearray(r[20])
    bad[900] ^= 0x5A
    assert read(gz(*r)) == ({i: body(i) for i in range(40)}, [])
    found, gaps = read(gz(*r[:20], bytes(bad), *r[21:30]) + gz(*r[30:])[:-300])
    assert {*range(20), *range(21, 30), 30, 31} <= set(found) and len(gaps) == 2 and all(found[i] == body(i) for i in found)


def test_a_record_without_a_digest_needs_the_check_sum():
    plain = encode_record(1, None, body(1), None)
    bare = b"".join(line for line in plain.splitlines(keepends=True)[:11] if not line.startswith(b"WARC-Block-Digest")) + b"".join(plain.splitlines(keepends=True)[11:])
    assert b"Block-Digest" not in bare and read(gz(bare, plain)) == ({1: body(1)}, [])
    spoilt = bytearray(gz(bare))
    spoilt[-6] ^= 1
    assert read(spoilt) == ({}, [(0, len(spoilt))])


def test_digests_of_other_kinds():
    import hashlib
    plain = encode_record(1, None, b"payload", None)
    at = plain.index(b"WARC-Block-Digest: ") + 19
    line = plain[at:plain.index(b"\r\n", at)]
    for named, sound in (("sha256:" + hashlib.sha256(b"payload").hexdigest(), True), ("SHA-256:" + hashlib.sha256(b"other").hexdigest(), False),
                         ("sha1:" + hashlib.sha1(b"payload").hexdigest(), True), ("crc99:what", True)):
        assert (len(read(gz(plain.replace(line, named.encode())))[0]) == 1) is sound


def test_a_wrong_length_fills_no_memory(monkeypatch):
    """Of an uncompressed archive: the reader holds a few chunks, not what a
    record claims, and finds the records behind it."""
    monkeypatch.setattr(warc, "CHUNK", 1 << 16)
    monkeypatch.setattr(warc, "LARGE", 1 << 17)
    wrong = encode_record(0, None, b"x" * 5000, None).replace(b"Content-Length: 5000", b"Content-Length: 999999999")
    large = encode_record(1, None, b"WARC/1.1\r\n y " * 100000, None)   # a true large block, full of version lines
    rest = b"".join(encode_record(i, None, body(i % 7), None) for i in range(2, 900))
    held = []

    class Watched(warc.Window):
        def more(self):
            held.append(len(self.data))
            return super().more()

    monkeypatch.setattr(warc, "Window", Watched)
    found, gaps = read(wrong + large + rest)
    assert sorted(found) == list(range(1, 900)) and gaps == [(0, len(wrong))]
    assert len(rest) > 8 * len(large) > 10 << 20 or max(held) < len(large) + (1 << 20)
    # without a digest the length alone tells
    bare = wrong.replace(b"WARC-Block-Digest", b"X-None")
    assert sorted(read(bare + rest)[0]) == list(range(2, 900))


@pytest.mark.parametrize("chunk", [500, 1 << 20])
def test_long_headers(chunk, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", chunk)
    for before in (0, 3, 40):
        records = [encode_record(i, None, body(1), None) for i in range(before)] + [encode_record(99, "http://h/" + "u" * 200000, b"p", None)]
        assert 99 in read(b"".join(records))[0] and 99 in read(b"".join(map(member, records)))[0]
    monkeypatch.setattr(warc, "MAX_HEAD", 5000)
    assert 99 not in read(b"".join(records))[0] and len(read(b"".join(records))[0]) == 40
