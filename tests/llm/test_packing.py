import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from barwright.llm import packing, tokens
from odd_rows import ODD

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokens.vocabulary())


def check(rows, texts, tokenizer):
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert len({r.sequence_id for r in rows}) == len(rows)
    for doc_id, text in texts.items():
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        pieces = sorted(by.pop(doc_id), key=lambda r: r.start)
        assert [r.start for r in pieces] == [0, *np.cumsum([r.length for r in pieces])[:-1]]
        assert sum(r.length for r in pieces) == len(ids) == pieces[0].doc_tokens
        for r in pieces:
            assert r.length & (r.length - 1) == 0 and r.length <= 1024 and r.offset == 0
            assert r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())
    assert not by


def test_whole_table(spark, documents, tokenizer):
    rows = packing.pack(spark.read.parquet(f"{FOLDER}/documents.parquet")).drop("ids").collect()
    check(rows, dict(zip(documents.doc_id, documents.text)), tokenizer)


def test_odd_rows(docs_of, tokenizer):
    rows = packing.pack(docs_of([r for r in ODD if r[0] != 5])).collect()
    check(rows, {r[0]: r[1] for r in ODD if r[0] != 5}, tokenizer)
    twice = packing.pack(docs_of(ODD)).filter("doc_id = 5").collect()
    assert len(twice) == 2 * len(packing.lengths(twice[0].doc_tokens))


def test_empty_table(docs_of):
    assert packing.pack(docs_of([(1, "x")]).limit(0)).collect() == []


def test_buckets(docs_of, tmp_path, spark):
    packing.write_buckets(packing.pack(docs_of(ODD)), str(tmp_path / "b"))
    sizes = spark.read.parquet(str(tmp_path / "b")).selectExpr("bucket", "length", "octet_length(ids) AS n").distinct().collect()
    assert sizes and all(r.length == 1 << r.bucket and r.n == 4 * r.length for r in sizes)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_ids_are_those_of_the_json_file(text):
    json_ids = Tokenizer.from_file(tokens.vocabulary()) if not hasattr(test_buckets, "t") else test_buckets.t
    test_buckets.t = json_ids
    assert tokens.encoder(tokens.vocabulary())(text).tolist() == json_ids.encode(text, add_special_tokens=False).ids


def test_every_code_point(tokenizer):
    fast = tokens.encoder(tokens.vocabulary())
    for low in range(0, 0x30000, 4096):
        texts = [f"a{chr(c)}b 1{chr(c)} {chr(c)}2<|endoftext|>{chr(c)}" for c in range(low, low + 4096) if not 0xD800 <= c < 0xE000]
        for text, want in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False)):
            assert fast(text).tolist() == want.ids


def test_lengths():
    for n in range(1, 5000):
        parts = packing.lengths(n)
        assert sum(parts) == n and sorted(parts, reverse=True) == parts and all(p & (p - 1) == 0 and p <= 1024 for p in parts)
