import base64
import gzip
import hashlib

import pytest

from barwright.llm import warc

FOLDER = "/root/testdata/sf0.01"


def sha(body):
    return base64.b32encode(hashlib.sha1(body).digest()).decode()


def expected(rows):
    top = {}
    for page_id, _, html in rows:
        top[html or ""] = max(top.get(html or "", page_id), page_id)
    return sorted((p, len((h or "").encode()), sha((h or "").encode()), "response" if top[h or ""] == p else "revisit", None if top[h or ""] == p else top[h or ""])
                  for p, _, h in rows)


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, body string")


def test_whole_table(spark):
    df = spark.read.parquet(f"{FOLDER}/pages.parquet")
    records = warc.round_trip(df)
    assert warc.gaps(records).count() == 0
    assert sorted(tuple(r) for r in warc.pages_of(records).collect()) == expected([tuple(r) for r in df.collect()])


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "", ""), (3, "http://x/ä \r\n\r\n<", "a\r\n\r\nWARC/1.1\r\n"), (4, "u", "a\r\n\r\nWARC/1.1\r\n"), (5, "u", "é" * 300000), (6, "u", "b"), (-7, "u", "b")]
    got = warc.pages_of(warc.round_trip(pages(spark, rows))).collect()
    assert sorted(tuple(r) for r in got) == expected(rows)
    twice = warc.pages_of(warc.round_trip(pages(spark, [(1, "u", "b"), (2, "u", "b"), (2, "u", "b"), (None, "u", "b"), (None, "v", "c")]))).collect()
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in twice) == [
        ("1", "revisit", 2), ("2", "response", None), ("2", "response", None), ("None", "response", None), ("None", "revisit", 2)]
    assert warc.pages_of(warc.round_trip(pages(spark, rows[:1]).limit(0))).count() == 0


def parts(n=40):
    return [warc.member(warc.record(k, f"http://x/{k}", (f"page {k} " * 2000).encode(), k + 1 if k % 5 == 0 else None)) for k in range(n)]


def read(data):
    return list(warc.salvage(lambda at, n: data[at:at + n], len(data)))


def ids(out):
    return [o[3]["page_id"] for o in out if o[0] == "record"]


def covered(out, size):
    assert [out[0][1], *(o[2] for o in out)] == [*(o[1] for o in out), size]


@pytest.mark.parametrize("kind", ["flip", "cut", "zeros", "junk", "head", "tail", "magic"])
def test_salvage(kind):
    p = parts()
    if kind == "flip":
        p[7] = p[7][:60] + bytes([p[7][60] ^ 255]) + p[7][61:]
    elif kind == "cut":
        p[7] = p[7][:-40]
    elif kind == "zeros":
        p[7] = bytes(len(p[7]))
    elif kind == "junk":
        p[7] = b"garbage" * 30
    elif kind == "head":
        p[0] = p[0][5:]
    elif kind == "tail":
        p[-1] = p[-1][:30]
    elif kind == "magic":
        p[7] = b"\x1f\x8b\x08WARC/1.1\r\n" * 5
    data = b"".join(p)
    out = read(data)
    lost = {"head": 0, "tail": 39}.get(kind, 7)
    assert ids(out) == [k for k in range(40) if k != lost]
    gaps = [o for o in out if o[0] == "gap"]
    start = sum(map(len, p[:lost]))
    assert [(g[1], g[2]) for g in gaps] == [(start, start + len(p[lost]))]
    covered(out, len(data))


def test_plain_and_mixed():
    plain = [warc.record(k, f"u{k}", b"x" * 3000, None) for k in range(6)]
    plain[2] = plain[2][:700] + plain[2][800:]  # shorter than it says
    data = b"".join(plain[:4]) + warc.member(plain[4]) + plain[5]
    out = read(data)
    assert ids(out) == [0, 1, 3, 4, 5]
    covered(out, len(data))


def test_wrong_digest_and_large_records():
    big = warc.record(2, "u", bytes(range(256)) * 20000, None)
    wrong = warc.record(1, "u", b"body", None).replace(b"body\r\n\r\n", b"b0dy\r\n\r\n")
    data = warc.member(wrong) + warc.member(big) + big
    out = read(data)
    assert ids(out) == [2, 2] and [o[:3] for o in out if o[0] == "gap"] == [("gap", 0, len(warc.member(wrong)))]


def test_members_are_plain_gzip(spark, tmp_path):
    done = warc.write(warc.with_revisits(pages(spark, [(1, "u", "one"), (2, "u", "two")])), str(tmp_path)).collect()
    text = b"".join(gzip.open(tmp_path / r.archive).read() for r in done)
    assert text.count(b"WARC/1.1\r\n") == 2 == sum(r.records for r in done)


def test_damaged_archive_in_a_job(spark, tmp_path):
    rows = [(k, f"u{k}", f"text {k} " * 50) for k in range(30)]
    done = warc.write(warc.with_revisits(pages(spark, rows).coalesce(1)), str(tmp_path))
    path = tmp_path / done.first().archive
    data = bytearray(path.read_bytes())
    data[len(data) // 2] ^= 255
    path.write_bytes(data)
    records = warc.read(done, str(tmp_path))
    assert warc.gaps(records).count() == 1 and warc.pages_of(records).count() == 29


def foreign(kind, block, *lines):
    head = ["WARC/1.0", f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:00000000-0000-0000-0000-000000000001>", *lines, f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
CHUNKED = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"
AS_HTTP = "Content-Type: application/http; msgtype=response"
GOOD = [
    (foreign("warcinfo", b"software: x\r\nformat: WARC\r\n", "Content-Type: application/warc-fields"), "warcinfo", b"software: x\r\nformat: WARC\r\n"),
    (foreign("metadata", b"fetchTimeMs: 3\r\n", "Content-Type: application/warc-fields"), "metadata", b"fetchTimeMs: 3\r\n"),
    (foreign("resource", b"plain\n\ntext", f"WARC-Payload-Digest: sha1:{sha(b'plain' + bytes([10, 10]) + b'text')}"), "resource", b"plain\n\ntext"),
    (foreign("response", b"20260101\nexample.org. 60 IN A 192.0.2.1\n", "Content-Type: text/dns"), "response", b"20260101\nexample.org. 60 IN A 192.0.2.1\n"),
    (foreign("conversion", b"text"), "conversion", b"text"),
    (foreign("request", b"GET / HTTP/1.1\r\nHost: x\r\n\r\n", "Content-Type: application/http; msgtype=request"), "request", b""),
    (foreign("revisit", b"", AS_HTTP), "revisit", b""),
    (foreign("response", HTTP + b"b", AS_HTTP), "response", b"b"),
    (foreign("response", HTTP + b"b", AS_HTTP, "WARC-Payload-Digest: sha256:" + hashlib.sha256(b"b").hexdigest(),
             "WARC-Block-Digest: md5:" + hashlib.md5(HTTP + b"b").hexdigest().upper()), "response", b"b"),
    (foreign("response", HTTP + b"b", AS_HTTP, f"WARC-Payload-Digest: SHA-1:{sha(b'b').lower()}", "WARC-Block-Digest: blake9:xyz"), "response", b"b"),
    (foreign("response", CHUNKED + b"3\r\nabc\r\n0\r\n\r\n", AS_HTTP, f"WARC-Payload-Digest: sha1:{sha(b'abc')}"), "response", b"3\r\nabc\r\n0\r\n\r\n"),
    (foreign("response", b"HTTP/1.0 200 OK\nServer: x\n\nb", AS_HTTP), "response", b"b"),
]


@pytest.mark.parametrize("form", [bytes, warc.member])
def test_records_of_foreign_archives(form):
    out = read(b"".join(form(g[0]) for g in GOOD))
    assert [(o[0], o[3]["record_type"], o[3]["body"]) for o in out] == [("record", kind, body) for _, kind, body in GOOD]


@pytest.mark.parametrize("line", ["WARC-Payload-Digest: sha256:" + hashlib.sha256(b"c").hexdigest(), "WARC-Block-Digest: md5:" + hashlib.md5(b"c").hexdigest(),
                                  f"WARC-Payload-Digest: sha1:{sha(b'c')}"])
def test_wrong_digests_of_foreign_archives(line):
    assert [o[0] for o in read(warc.member(foreign("response", HTTP + b"b", AS_HTTP, line)))] == ["gap"]
