"""WARC archives: a writer with revisits, and a reader that salvages what follows damage.

Pages are written as gzip members, one a record. Of records with equal payloads the one with the largest page_id is a response and the
others are revisits that refer to it. The reader takes records of any type and checks each member (gzip checksum, version line, block length,
and block and payload digests of the ``ALGORITHMS``; absent and other digests are not checked). After a
failed check it searches for the next member or version line that reads well, goes on from there, and logs the bytes it left out.
Archives are cut at ``ARCHIVE_BYTES``; a task reads one archive through a window, so memory is bounded by a record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barwright.llm.files import Reader, Writer
from barwright.llm.shared import keep, scratch_path

ARCHIVE_BYTES = 16 << 20
DATE = "1970-01-01T00:00:00Z"  # pages carry no time of capture
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP, VERSION = b"\x1f\x8b\x08", b"WARC/1."
FIRST, STEP = 1 << 14, 1 << 20
ALGORITHMS = ("md5", "sha1", "sha224", "sha256", "sha384", "sha512")
HTTP_TYPES = ("request", "response", "revisit")
_BLANK, _CHUNK = re.compile(rb"\r?\n\r?\n"), re.compile(rb"([0-9A-Fa-f]+)[^\r\n]*\r\n")
_LINE = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")


def payload_digest(body: bytes) -> str:
    return base64.b32encode(hashlib.sha1(body).digest()).decode()


def record(page_id: int | None, url: str | None, body: bytes, refers_to: int | None) -> bytes:
    """One uncompressed record: a response with the body, or a revisit with the HTTP headers alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body)
    block = http if refers_to is not None else http + body
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
             f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{payload_digest(body)}",
             *([f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"] if refers_to is not None else []),
             f"WARC-Block-Digest: sha1:{payload_digest(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member without a time stamp."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def agrees(digest: str | None, content: bytes) -> bool:
    """False where ``algorithm:value``, in hex, base32 or base64, is of a known algorithm and not that of ``content``."""
    name, _, value = (digest or "").strip().partition(":")
    name = name.lower().replace("-", "")
    if name not in ALGORITHMS or not value:
        return True
    own, value = hashlib.new(name, content).digest(), value.strip().rstrip("=")
    return value.lower() == own.hex() or value.upper() == base64.b32encode(own).decode().rstrip("=") or any(
        value == code(own).decode().rstrip("=") for code in (base64.b64encode, base64.urlsafe_b64encode))


def unchunked(body: bytes) -> bytes | None:
    """The content of a body in chunked transfer encoding, or None where it is not one."""
    out, at = [], 0
    while m := _CHUNK.match(body, at):
        if not (n := int(m[1], 16)):
            return b"".join(out)
        out.append(body[m.end():m.end() + n])
        at = m.end() + n + 2
    return None


def parse(data: bytes) -> dict | None:
    """Fields of one whole uncompressed record, or None where a check fails."""
    end = data.find(b"\r\n\r\n")
    if not data.startswith(VERSION) or end < 0:
        return None
    at = data.index(b"\r\n") + 2
    head = {k.lower().decode("latin-1"): v.decode("utf-8", "replace") for k, v in _LINE.findall(data[at:end + 2])}
    try:
        n = int(head["content-length"])
    except (KeyError, ValueError):
        return None
    block = data[end + 4:end + 4 + n]
    if n < 0 or len(block) != n or data[end + 4 + n:] != b"\r\n\r\n":
        return None
    if not agrees(head.get("warc-block-digest"), block):
        return None
    kind, digest, body, fields = head.get("warc-type"), head.get("warc-payload-digest"), block, {}
    # a DNS answer is a response without HTTP; a revisit may come without headers
    if kind in HTTP_TYPES and head.get("content-type", "application/http").lower().startswith("application/http") and (block or kind != "revisit"):
        split = _BLANK.search(block)
        if split is None:
            return None
        http, body = block[:split.start()], block[split.end():]
        fields = {k.lower(): v for k, v in _LINE.findall(re.sub(rb"\r?\n", b"\r\n", http) + b"\r\n")}
    # the payload of a revisit is elsewhere, that of a segment or a truncated record is not here as a whole
    if kind in ("request", "response", "resource", "conversion") and "warc-segment-number" not in head and "warc-truncated" not in head:
        whole = unchunked(body) if b"chunked" in fields.get(b"transfer-encoding", b"").lower() else None
        if not agrees(digest, body) and (whole is None or not agrees(digest, whole)):
            return None
    number = lambda key: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", head.get(key, ""))) else None
    length = fields.get(b"content-length", b"")
    return {"page_id": number("warc-record-id"), "payload_bytes": len(body) if kind != "revisit" else int(length) if length.isdigit() else None,
            "payload_digest": digest and digest.removeprefix("sha1:"), "record_type": kind, "refers_to": number("warc-refers-to"),
            "url": head.get("warc-target-uri"), "body": body}


class Window:
    """Bytes of a file by position, read in steps; forgets what lies before the position asked for."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self.read, self.size, self.low, self.data = read, size, 0, b""

    def upto(self, start: int, end: int) -> bytes:
        """Bytes from ``start`` to ``end`` (or the file's end)."""
        end = min(end, self.size)
        if start < self.low or start > self.low + len(self.data):
            self.low, self.data = start, b""
        elif start > self.low + STEP:
            self.low, self.data = start, self.data[start - self.low:]
        have = self.low + len(self.data)
        if end > have:
            self.data += self.read(have, min(max(end - have, STEP), self.size - have))
        return self.data[start - self.low:end - self.low]


def one_member(window: Window, at: int) -> tuple[bytes, int] | None:
    """The content and end of the gzip member at ``at``, or None where it is damaged."""
    z, out, pos, step = zlib.decompressobj(31), [], at, FIRST
    try:
        while not z.eof:
            part = window.upto(pos, pos + step)
            if not part:
                return None
            out.append(z.decompress(part))
            pos, step = pos + len(part), min(2 * step, STEP)
    except zlib.error:
        return None
    return b"".join(out), pos - len(z.unused_data)


def one_plain(window: Window, at: int) -> tuple[bytes, int] | None:
    """The uncompressed record at ``at`` and its end, or None."""
    end, head = -1, b""
    while end < 0 and len(head) < STEP:
        more = window.upto(at, at + max(4096, 2 * len(head)))
        end = more.find(b"\r\n\r\n")
        if len(more) == len(head):
            break
        head = more
    length = re.search(rb"(?i)\r\ncontent-length:[ \t]*(\d+)\r\n", head[:end + 2]) if end >= 0 else None
    if length is None:
        return None
    total = end + 4 + int(length[1]) + 4
    return (window.upto(at, at + total), at + total) if at + total <= window.size else None


def salvage(read: Callable[[int, int], bytes], size: int) -> Iterator[tuple[str, int, int, dict | str]]:
    """("record", start, end, fields) for every record that reads well, ("gap", start, end, reason) for bytes left out."""
    window, at, lost, why = Window(read, size), 0, None, ""
    while at < size:
        head = window.upto(at, at + 16)
        found = one_member(window, at) if head.startswith(GZIP) else one_plain(window, at) if head.startswith(VERSION) else None
        fields = parse(found[0]) if found else None
        if fields is not None:
            if lost is not None:
                yield "gap", lost, at, why
                lost = None
            yield "record", at, found[1], fields
            at = found[1]
            continue
        if lost is None:
            lost, why = at, "bad record" if found else "bad member" if head.startswith(GZIP) else "bad header" if head.startswith(VERSION) else "no record"
        at = following(window, at + 1)
    if lost is not None:
        yield "gap", lost, size, why


def following(window: Window, at: int) -> int:
    """The next place that looks like a member or a version line, or the file's end."""
    while at < window.size:
        part = window.upto(at, at + STEP)
        places = [k for k in (part.find(GZIP), part.find(VERSION)) if k >= 0]
        if places:
            return at + min(places)
        if at + len(part) >= window.size:
            return window.size
        at += max(1, len(part) - len(VERSION) + 1)
    return window.size


def with_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, body (UTF-8; null is empty), refers_to: the largest page_id with an equal payload of at least ``least`` bytes, for all
    other rows with it. Rows that repeat that page_id are responses too; a null page_id refers to the largest of the others, if any."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("body"))
    keyed = rows.withColumn("key", F.sha2("body", 256))
    few, _ = keep(keyed.filter(F.octet_length("body") >= least).groupBy("key").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
                  .filter("n > 1 AND first IS NOT NULL").select("key", "first"), "revisits")
    joined = keyed.join(few, "key", "left")
    return joined.select("page_id", "url", "body", F.expr("CASE WHEN NOT page_id <=> first THEN first END").alias("refers_to"))


def write(records: DataFrame, folder: str) -> DataFrame:
    """Write ``with_revisits`` rows to archives in ``folder``; one row per archive: archive, bytes, records."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n, done = None, 0, []
        for batch in batches:
            for page_id, url, body, refers_to in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
                if out is not None and out.size >= ARCHIVE_BYTES:
                    out.close()
                    done.append((out.name, out.size, n))
                    out = None
                if out is None:
                    out, n = Writer(folder, ".warc.gz"), 0
                out.write(member(record(page_id, url, body.as_py(), refers_to)))
                n += 1
        if out is not None:
            out.close()
            done.append((out.name, out.size, n))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), (pa.string(), pa.int64(), pa.int64()))], ["archive", "bytes", "records"])

    return keep(records.select("page_id", "url", "body", "refers_to").mapInArrow(each, "archive string, bytes long, records long"), "archives")[0]


READ = "archive string, start long, end long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, gap string"


def read(archives: DataFrame, folder: str, keep_body: bool = False) -> DataFrame:
    """Every record and gap of the archives, one task an archive at a time. Rows of quarantined bytes have ``gap`` set and no page."""
    names = [f.split()[0] for f in READ.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
    extra = ["body"] if keep_body else []

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(folder)
        fields = names[3:9]
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                size = reader.open(archive).size()
                rows = []
                for kind, start, end, what in salvage(lambda at, n, name=archive: reader.read(name, at, n), size):
                    good = kind == "record"
                    rows.append((archive, start, end, *((what[f] for f in fields) if good else [None] * len(fields)), None if good else what,
                                 *([what["body"] if good else None] if keep_body else [])))
                    if len(rows) >= 512:
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), [*kinds, pa.binary()])], names + extra)

    # names are dealt out, so the number of tasks comes from the number of archives and not from bytes
    return archives.select("archive").repartition(max(1, archives.count()), "archive").mapInArrow(each, READ + (", body binary" if keep_body else ""))


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write pages, read them back: records and gaps as ``read`` gives them, in a table in the shared folder."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    return keep(read(write(with_revisits(pages), folder), folder), "records")[0]


def gaps(records: DataFrame) -> DataFrame:
    """The quarantine log: archive, start, end, reason."""
    return records.filter("gap IS NOT NULL").select("archive", "start", "end", F.col("gap").alias("reason"))


def pages_of(records: DataFrame) -> DataFrame:
    return records.filter("gap IS NULL").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
