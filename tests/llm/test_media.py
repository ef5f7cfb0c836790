import hashlib
import os
import zlib

import pytest
from hypothesis import given, settings, strategies as st
from odd_rows import ODD

from barwright.llm import media


def expected(text):
    raw = (text or "").encode()
    body = raw + b"\xff" * ((-len(raw)) % 576 or (576 if not raw else 0))
    return len(raw), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-32:])


def test_round_trip(spark, documents, docs_of, tmp_path):
    rows = [(int(d), t) for d, t in zip(documents.doc_id, documents.text)] + [(100000 + k, r[1]) for k, r in enumerate(ODD)]
    folder = str(tmp_path / "shards")
    got = media.media_columns(docs_of(rows), folder).collect()
    texts = dict(rows)
    assert sorted(r.doc_id for r in got) == sorted(texts)
    same = {}
    for r in got:
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == expected(texts[r.doc_id])
        assert (r.format, r.width * r.height, r.bits) == ("png", r.payload_bytes, 8)
        assert same.setdefault(r.payload_sha256, (r.media_bytes, r.media_sha256, r.feature)) == (r.media_bytes, r.media_sha256, r.feature)
        with open(f"{folder}/{r.shard}", "rb") as f:
            f.seek(r.offset)
            assert hashlib.sha256(f.read(r.length)).hexdigest() == r.media_sha256
    names = [n for s in os.listdir(folder) for n in media.members(open(f"{folder}/{s}", "rb").read())]
    assert {n[3:-4] for n in names} == set(same)


def test_places(docs_of, tmp_path):
    rows = media.store(docs_of([(k, f"text {k % 3}") for k in range(50)]), str(tmp_path / "s"))
    assert media.index(rows).count() == 3 == rows.select("digest").distinct().count()


def test_damage_is_found(docs_of, tmp_path):
    folder = str(tmp_path / "s")
    rows = media.store(docs_of([(1, "some text")]), folder)
    at = rows.first()
    path = f"{folder}/{at.shard}"
    data = bytearray(open(path, "rb").read())
    data[at.offset + 45] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(Exception):
        media.with_payload(rows, folder).collect()


def test_empty_table(docs_of):
    assert media.media_columns(docs_of([(1, "x")]).limit(0)).collect() == []


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=3000))
def test_png(raw):
    body = media.payload(raw)
    data = media.encode(body)
    assert media.decode(data) == body and media.header(data[:media.HEADER])[1:] == (576, len(body) // 576, 8)
