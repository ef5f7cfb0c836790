import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from odd_rows import ODD
from tokenizers import Tokenizer

from barwright.llm import token_files, tokens
from barwright.llm.files import Reader


def check(index, rows, folder, length):
    tokenizer, reader, seen = Tokenizer.from_file(tokens.vocabulary()), Reader(folder), {}
    for r in index:
        ids, positions = token_files.read_row(reader, r.file, r.row, length)
        assert zlib.crc32(ids.astype("<u4").tobytes()) == r.ids_crc32 and not ids[r.used:].any()
        assert r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.used <= length
        for d, s, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
            assert positions[a:b].tolist() == list(range(b - a))
            seen.setdefault(d, []).append((s, ids[a:b]))
    got = sorted(np.concatenate([x for _, x in sorted(p, key=lambda q: q[0])]).tolist() for p in seen.values())
    assert got == sorted([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for _, t in rows)


def test_whole_table(spark, documents, tmp_path):
    index = token_files.write(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), str(tmp_path)).collect()
    check(index, list(zip(documents.doc_id, documents.text)), str(tmp_path), token_files.LENGTH)
    assert sum(r.used for r in index) > 0.98 * token_files.LENGTH * len(index)


def test_odd_rows(docs_of, tmp_path):
    rows = [r for r in ODD if r[0] != 5]
    check(token_files.write(docs_of(rows), str(tmp_path), length=256).collect(), rows, str(tmp_path), 256)
    assert sum(r.doc_ids.count(5) for r in token_files.write(docs_of(ODD), str(tmp_path)).collect()) == 2
    assert token_files.write(docs_of(ODD).limit(0), str(tmp_path)).collect() == []


def slow(lengths, size):
    rows = []
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        fit = [r for r in rows if r[0] >= lengths[k]]
        if fit:
            best = min(fit, key=lambda r: r[0])
        else:
            rows.append(best := [size, []])
        best[0] -= lengths[k]
        best[1].append(k)
    return sorted(r[0] for r in rows)


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 70).flatmap(lambda size: st.tuples(st.just(size), st.lists(st.integers(1, size), max_size=60))))
def test_best_fit(case):
    size, lengths = case
    rows = token_files.best_fit(lengths, size)
    assert sorted(k for r in rows for k in r) == list(range(len(lengths)))
    assert sorted(size - sum(lengths[k] for k in r) for r in rows) == slow(lengths, size)


def test_wide_ids_are_refused(docs_of, tmp_path):
    with pytest.raises(Exception):
        token_files.write(docs_of([(1, "many words here")]), str(tmp_path), width=1).collect()
