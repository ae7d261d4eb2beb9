"""Operator 9: WARC archives, written by Spark tasks and read by a salvage reader.

Writer: each task writes archives of bounded size, ``.warc.gz`` files of one
gzip member a record, under names of its own; a finished archive is renamed and
only archives of tasks that succeeded are listed, so a lost executor or a rerun
task leaves nothing behind that a reader would see. Of the records with equal payloads of at
least ``min_bytes`` the one with the largest page id is the response, the
others are revisits that name it; smaller payloads are all responses.

Salvage reader: archives are read through a window that holds a record and a
few chunks. A record is accepted if it starts with a version line, its length
adds up, its block digest agrees and its member's gzip check sum holds. A member
may hold any number of records. A damaged record in a member whose check sum
holds costs that record alone. If a member breaks off or can't be inflated to its
end, the records before that are accepted by their digests; if only the check
sum fails, they are as long as a record's digest shows where the damage is (if
none does, headers are damaged, and nobody knows whose). After a failed check the
reader searches on for the next member start (``1F 8B 08``) or, in an
uncompressed archive, the next version line, recovers the records from there on,
and logs the bytes in between as a quarantined gap (start, end, reason; a member
that was recovered in part is a gap, and the reason tells how many records it
gave). The search begins a byte after the start that failed, or, in a member
that gave records, where the last of them was complete. Gzip starts that turn up
by chance inside a member are tried and fail the same checks. A block that claims
to be longer than ``LARGE`` in an uncompressed archive is first hashed as a
stream, and a member with more than that in records is read twice, so a wrong
length in the one and a long row of records in the other fill no memory; a wrong
length inside a member holds what is left of it. Headers may be ``MAX_HEAD`` long,
wherever in the window they stand.

Null html is an empty payload. A null page_id is written without an id and
read back as null; it is a response, and nothing refers to it. Repeated rows
are records each, and so are all rows of the largest id responses. Very long payloads pass through the window whole, one at a time.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtside.llm.common import arrow_schema, open_path, stored, work_dir

PER_ARCHIVE = 20000      # records
ARCHIVE_BYTES = 16 << 20  # when an archive has so many, the next is begun
LEVEL = 4              # of gzip
CHUNK = 1 << 20        # bytes read at a time
MAX_HEAD = 1 << 24     # bytes of a record's headers
LARGE = 8 << 20        # a block that is checked before it is held
VERSION = b"WARC/1.1"
_START = re.compile(rb"WARC/1\.[01]\r\n")
_START_OR_MEMBER = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
RECORD = ("page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, "
          "payload binary, archive string, offset long")
GAP = "archive string, start long, end long, reason string"


# ---------------------------------------------------------------- records

def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _line(value: str) -> str:
    """A header value on one line."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def encode_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record (uncompressed). Revisits keep the digest and length of
    the payload they leave out."""
    revisit = refers_to is not None
    block = b"" if revisit else payload
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}:{sha1(payload)}:{refers_to}")
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:uuid:{name}>"),
            ("WARC-Date", "1970-01-01T00:00:00Z"), ("Content-Type", "text/html; charset=utf-8")]
    if url is not None:
        head.append(("WARC-Target-URI", _line(url)))
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    if revisit:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-ID", str(refers_to))]
    head += [("WARC-Payload-Digest", f"sha1:{sha1(payload)}"), ("X-Payload-Length", str(len(payload))),
             ("WARC-Block-Digest", f"sha1:{sha1(block)}"), ("Content-Length", str(len(block)))]
    lines = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n"
    return lines + block + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


class Damaged(Exception):
    """``resume``: where to search on, if not right behind the start."""

    def __init__(self, why: str, resume: int | None = None):
        super().__init__(why)
        self.resume = resume


def headers_of(data, at: int = 0) -> tuple[dict, int, int] | None:
    """(headers, start of the block, its claimed length) of the record at
    ``at``; None if its headers go on beyond ``data``."""
    if not _START.match(data, at):
        raise Damaged("no version line")
    split = data.find(b"\r\n\r\n", at, at + MAX_HEAD)
    if split < 0:
        if len(data) - at >= MAX_HEAD:
            raise Damaged("headers do not end")
        return None
    head = {}
    for line in bytes(data[at:split]).split(b"\r\n")[1:]:
        k, colon, v = line.partition(b":")
        if not colon:
            raise Damaged("bad header")
        head[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
    size = head.get("content-length", "")
    if not (size.isascii() and size.isdigit() and len(size) < 19):
        raise Damaged("no content length")
    return head, split + 4, int(size)


def hasher(named: str):
    """(a hash object, the digest wanted) of a digest header, or None if the
    header is missing or of a kind that can't be tested."""
    kind, _, value = named.partition(":")
    kind = kind.strip().lower().replace("-", "")
    return (hashlib.new(kind), value.strip()) if kind in ("md5", "sha1", "sha256", "sha512") else None


def agrees(h, value: str) -> bool:
    return value.lower() == h.hexdigest() or value.upper().rstrip("=") == base64.b32encode(h.digest()).decode().rstrip("=")


def decode_record(data, at: int = 0) -> tuple[dict, bytes, int] | None:
    """(headers, block, end) of the record that starts at ``at``; None if it goes
    on beyond ``data``."""
    found = headers_of(data, at)
    if found is None:
        return None
    head, start, size = found
    end = start + size
    if len(data) < end + 4:
        return None
    if data[end:end + 4] != b"\r\n\r\n":
        raise Damaged("length does not add up")
    block = bytes(data[start:end])
    if test := hasher(head.get("warc-block-digest", "")):
        test[0].update(block)
        if not agrees(*test):
            raise Damaged("block digest differs")
    return head, block, end + 4


# ---------------------------------------------------------------- salvage

def upto_fault(z, piece: bytes) -> Iterator[bytes]:
    """What ``z`` makes of a piece that it can't inflate as a whole."""
    for step in (1 << 12, 64, 1):
        while piece:
            before = z.copy()
            try:
                yield z.decompress(piece[:step])
            except zlib.error:
                z = before
                break
            piece = piece[step:]


class Told:
    """What is known of a member when it was read: its end, where its last sound
    record was complete, what was wrong, whether the check sum held, whether a
    record's digest failed, and whether digests then prove the other records."""

    def __init__(self, at: int):
        self.end = self.last = at
        self.why, self.sound, self.spoilt, self.proves = "", False, False, False


class Window:
    """Random reads of a stream that can seek, of which only what may still be
    needed is held."""

    def __init__(self, stream):
        self.stream, self.base, self.data, self.done = stream, 0, bytearray(), False

    def more(self) -> bool:
        if not self.done:
            got = self.stream.read(CHUNK)
            self.done = not got
            self.data += got
        return not self.done

    def forget(self, upto: int) -> None:
        if upto - self.base >= CHUNK:
            del self.data[:upto - self.base]
            self.base = upto

    def rewind(self, at: int) -> None:
        """Hold what follows ``at`` again, if it is forgotten."""
        if at < self.base:
            self.stream.seek(at)
            self.base, self.data, self.done = at, bytearray(), False

    def find_start(self, at: int) -> int:
        """Where the next member or version line may start, or the end."""
        while True:
            m = _START_OR_MEMBER.search(self.data, at - self.base)
            if m:
                return self.base + m.start()
            at = max(at, self.base + len(self.data) - 10)  # a start may straddle the window's end
            self.forget(at)
            if not self.more():
                return self.base + len(self.data)

    def inflate(self, at: int) -> Iterator[tuple[bytes, int, int]]:
        """The gzip member at ``at`` in pieces, each with the places in the
        archive from and up to which it was read; ends when the check sum has held."""
        z, pos = zlib.decompressobj(31), at
        while not z.eof:
            if pos - self.base >= len(self.data) and not self.more():
                raise Damaged("member is cut off")
            piece = bytes(self.data[pos - self.base:pos - self.base + CHUNK])
            while piece and not z.eof:
                before = z.copy()
                try:
                    out = z.decompress(piece, CHUNK)
                except zlib.error as e:
                    for out in upto_fault(before, piece):
                        yield out, pos, pos
                    raise Damaged(str(e)) from None
                begun, pos = pos, pos + len(piece) - len(z.unused_data if z.eof else z.unconsumed_tail)
                piece = z.unconsumed_tail
                yield out, begun, pos
            self.forget(pos)

    def member(self, at: int) -> Iterator[tuple[dict, bytes] | int]:
        """(headers, block) of the records of the gzip member at ``at`` that can
        be trusted, then the member's end; Damaged, if it held anything else.
        Which can be trusted is known at its end: records are held until then,
        or read a second time if they are more than ``LARGE``."""
        told = Told(at)
        held, size, records = [], 0, self._records(at, told)
        for r in records:
            if size <= LARGE:
                held.append(r)
            size += len(r[1])
        if size > LARGE:
            self.rewind(at)
            held = self._records(at, Told(at))
        given = 0
        for head, block in held:
            if told.sound or (told.proves and hasher(head.get("warc-block-digest", ""))):
                given += 1
                yield head, block
        if told.why:
            raise Damaged(f"{told.why}; {given} records recovered" if given else told.why, (told.end if told.sound else told.last) if given else None)
        yield told.end

    def _records(self, at: int, told: Told) -> Iterator[tuple[dict, bytes]]:
        """All records of a member whose length and digest are right. A damaged
        one is skipped up to the next version line. ``told`` tells the rest."""
        raw, wanted, met = bytearray(), 10, False

        def take(last: bool):
            """The next record of ``raw``, or None if ``raw`` has to grow."""
            nonlocal wanted
            while raw and (last or len(raw) >= wanted):
                try:
                    found = headers_of(raw)
                    wanted = 2 * len(raw) if found is None else found[1] + found[2] + 4
                    record = decode_record(raw)
                    if record is None and last:
                        raise Damaged("length does not add up")
                except Damaged as e:
                    if not met:
                        raise
                    told.why, told.spoilt = told.why or str(e), True
                    start = _START.search(raw, 1)
                    del raw[:start.start() if start else len(raw) if last else max(1, len(raw) - 10)]
                    wanted = 10
                    continue
                if record is None:
                    return None
                del raw[:record[2]]
                wanted = 10
                return record[:2]
            return None

        try:
            for out, begun, told.end in self.inflate(at):
                raw += out
                met = met or _START.match(raw) is not None
                while record := take(False):
                    told.last = begun
                    yield record
            while record := take(True):
                yield record
            told.sound = True
        except Damaged as e:
            # a check sum that fails by itself leaves open which headers are wrong
            told.proves = told.spoilt or not str(e).startswith("Error -3 while decompressing data: incorrect")
            told.why = str(e)

    def plain(self, at: int) -> tuple[dict, bytes, int]:
        """The uncompressed record at ``at``."""
        while (found := headers_of(self.data, at - self.base)) is None:
            if not self.more():
                raise Damaged("headers do not end")
        head, start, size = found
        start += self.base
        if size > LARGE:
            self.test_large(head, start, size)
            self.rewind(at)
        while len(self.data) < start + size + 4 - self.base and self.more():
            pass
        record = decode_record(self.data, at - self.base)
        if record is None:
            raise Damaged("length does not add up")
        return head, record[1], start + size + 4

    def test_large(self, head: dict, start: int, size: int) -> None:
        """Read over a large block, holding a few chunks, and fail if its length
        or digest is wrong."""
        test, at, end = hasher(head.get("warc-block-digest", "")), start, start + size
        begun = self.base
        try:
            while at < end:
                if at - self.base >= len(self.data) and not self.more():
                    raise Damaged("length does not add up")
                piece = bytes(self.data[at - self.base:min(end - self.base, at - self.base + CHUNK)])
                if test:
                    test[0].update(piece)
                at += len(piece)
                self.forget(at)
            while len(self.data) < end + 4 - self.base and self.more():
                pass
            if self.data[end - self.base:end + 4 - self.base] != b"\r\n\r\n":
                raise Damaged("length does not add up")
            if test and not agrees(*test):
                raise Damaged("block digest differs")
        finally:
            self.rewind(begun)


def salvage(stream) -> Iterator[tuple]:
    """("record", offset, headers, block) and ("gap", start, end, reason), from
    a stream that can seek. All records of a member have its offset."""
    w, at, bad, why = Window(stream), 0, None, ""
    while True:
        w.rewind(at)
        while at - w.base >= len(w.data) and w.more():
            pass
        if at - w.base >= len(w.data):
            break
        while len(w.data) - (at - w.base) < 12 and w.more():
            pass
        lead = bytes(w.data[at - w.base:at - w.base + 3])
        try:
            found = w.member(at) if lead == b"\x1f\x8b\x08" else iter((w.plain(at),))
            for x in found:
                if isinstance(x, int):
                    end = x
                    continue
                if bad is not None:
                    yield "gap", bad, at, why
                    bad = None
                yield "record", at, x[0], x[1]
                end = x[-1]
        except Damaged as e:
            if bad is None:
                bad, why = at, str(e)
            at = max(at + 1, e.resume or 0)
            w.rewind(at)
            at = w.find_start(at)
            continue
        if bad is not None:  # a sound member without a record
            yield "gap", bad, at, why
            bad = None
        at = end
        w.forget(at)
    if bad is not None:
        yield "gap", bad, at, why


# ---------------------------------------------------------------- Spark

def with_roles(pages: DataFrame, id_col: str, url_col: str, html_col: str, min_bytes: int) -> DataFrame:
    """page_id, url, html, copy, refers_to of every row."""
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                     F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    p = p.withColumns({"digest": F.sha1("html"), "size": F.octet_length("html")})
    # who revisits whom is found on ids and digests alone; the pages themselves
    # are dealt by id, so a payload that many pages share meets in no task
    slim = p.where(F.col("size") >= min_bytes).select("page_id", "digest")
    last = slim.groupBy("digest").agg(F.max("page_id").alias("last_id"), F.count("digest").alias("n")).where("n > 1")
    again = (slim.join(last, "digest").where("page_id < last_id").distinct()
             .select(F.col("page_id").alias("id2"), F.col("digest").alias("digest2"), F.col("last_id").alias("refers_to")))
    return p.join(again, (p["page_id"] == again["id2"]) & (p["digest"] == again["digest2"]), "left").drop("id2", "digest2")


def write_archives(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html", min_bytes: int = 0, per_archive: int = PER_ARCHIVE, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the archives; a stored list of them: archive, records, bytes."""
    path = path or work_dir(pages.sparkSession, "warc")

    def write(batches):
        fs, folder = open_path(path)
        fs.create_dir(folder, recursive=True)
        out, name, records, size = None, None, 0, 0

        def close():
            out.close()
            fs.move(f"{folder}/_{name}.part", f"{folder}/{name}.warc.gz")
            return pa.RecordBatch.from_pydict({"archive": [f"{path.rstrip('/')}/{name}.warc.gz"], "records": [records], "bytes": [size]})

        for batch in batches:
            for r in (r for a in range(0, batch.num_rows, 100) for r in batch.slice(a, 100).to_pylist()):
                if out is None:
                    name, records, size = uuid.uuid4().hex, 0, 0
                    out = fs.open_output_stream(f"{folder}/_{name}.part", compression=None)
                data = member(encode_record(r["page_id"], r["url"], r["html"].encode(), r["refers_to"]))
                out.write(data)
                records, size = records + 1, size + len(data)
                if records >= per_archive or size >= archive_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    dealt = with_roles(pages, id_col, url_col, html_col, min_bytes).select("page_id", "url", "html", "refers_to")
    return stored(dealt.mapInArrow(write, "archive string, records long, bytes long"), "warc-list")


def _each(archives: DataFrame, schema: str, wanted: str, payload: bool = True):
    """Salvage every archive, one to a task at a time."""
    target = arrow_schema(schema)

    def rows(archive):
        fs, p = open_path(archive)
        with fs.open_input_file(p) as stream:
            for kind, at, x, y in salvage(stream):
                if kind != wanted:
                    continue
                if kind == "gap":
                    yield archive, at, x, y
                else:
                    number = lambda k: int(x[k]) if x.get(k, "").lstrip("-").isdigit() else None  # noqa: E731, B023
                    yield (number("x-page-id"), x.get("warc-target-uri"), x.get("warc-type"), number("x-refers-to-page-id"),
                           number("x-payload-length"), x.get("warc-payload-digest", "").removeprefix("sha1:"), y if payload else None, archive, at)

    def batches_of(found):
        hold, size = [], 0
        for r in found:
            hold.append(r)
            size += len(r[6] or b"") if wanted == "record" else 0
            if len(hold) >= 1000 or size >= CHUNK * 8:
                yield hold
                hold, size = [], 0
        if hold:
            yield hold

    def run(batches):
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                for group in batches_of(rows(archive)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*group), target)], schema=target)

    return archives.mapInArrow(run, schema)


def _spread(archives: DataFrame) -> DataFrame:
    n = max(1, archives.count())
    return archives.select("archive").repartitionByRange(n, "archive")


def read_archives(archives: DataFrame, payload: bool = True) -> DataFrame:
    """Every record that can be recovered (RECORD) from a list of archives;
    without ``payload`` the payloads are checked and left out."""
    return _each(_spread(archives), RECORD, "record", payload)


def read_gaps(archives: DataFrame) -> DataFrame:
    """The quarantine log (GAP): byte ranges that hold no sound record."""
    return _each(_spread(archives), GAP, "gap")


def archive_list(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.createDataFrame([(p,) for p in paths], "archive string")
