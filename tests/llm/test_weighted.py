import hashlib
import math
from collections import Counter

import numpy as np
import pytest
import xxhash
from odd_rows import ODD

from barwright.llm import queries, weighted

FOLDER = "/root/testdata/sf0.01"


def plain_signature(text):
    """The sampling formulas one number at a time."""
    words, mask = text.encode().lower().split(), (1 << 64) - 1
    hashes = [xxhash.xxh3_64_intdigest(w) for w in words]
    count = Counter(hashes[:1])
    for (a, x), (b, y) in zip(zip(hashes, words), zip(hashes[1:], words[1:])):
        if len(x) <= weighted.LONG and len(y) <= weighted.LONG:
            z = (a * 0xD6E8FEB86659FD93 + b * 0x9E3779B97F4A7C15) & mask
            count[z ^ (z >> 32)] += 1
    for w in words:
        for i in range(len(w) - weighted.PIECE + 1 if len(w) > weighted.LONG else 0):
            count[xxhash.xxh3_64_intdigest(w[i:i + weighted.PIECE])] += 1
    if not count:
        return "0000" * weighted.SAMPLES
    best = [(math.inf, 0)] * weighted.SAMPLES
    for term, w in count.items():
        lane = weighted.lanes(np.array([term], np.uint64))[0].tolist()
        for k, (name, b, c, r) in enumerate(lane):
            b, log_c, r = np.float32((b + 0.5) / 65536), weighted.LOG_GAMMA[c], weighted.GAMMA[r]
            t = np.floor(np.float32(math.log(w)) / r + b)
            a = log_c - r * (1 - b) if w == 1 else log_c - r * (t - b) - r
            best[k] = min(best[k], (a, max(1, (name + int(t) * 40503) % 65536)))
    return "".join(f"{name:04x}" for _, name in best)


def test_gamma_quantiles():
    x = weighted._gamma()
    assert np.allclose(1 - (1 + x) * np.exp(-x), (np.arange(len(x)) + 0.5) / len(x), rtol=1e-9) and (np.diff(x) > 0).all()


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def brute(rows, signature):
    """Result rows of (doc_id, text): order by falling id, nulls last, falling hash of the text."""
    rows = [(d, t or "") for d, t in rows]
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0), -signed(xxhash.xxh64_intdigest(r[1].encode(), seed=42))))
    out = []
    for (d, t), (_, n) in zip(rows, rows[1:] + rows[:1]):
        m = len(t) // 3
        e = t[:len(t) - m] + n[:m]
        a, b, c = signature(t), signature(e), signature(n)
        like = lambda x, y: sum(x[i:i + 4] == y[i:i + 4] for i in range(0, len(x), 4)) / weighted.SAMPLES
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), a, b, like(a, b), like(a, c)))
    return sorted(out, key=str)


def fast(text):
    return weighted.signature(*weighted.terms(text.encode())).astype(">u2").tobytes().hex()


def result(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_whole_table(spark, documents):
    got = result(queries.op13_weighted_fingerprint(spark, FOLDER))
    assert got == brute(zip(documents.doc_id, documents.text), fast)
    near, other = np.array([r[5] for r in got]), np.array([r[6] for r in got])
    assert np.median(near) > 0.4 and np.median(other) < 0.2 and (near >= other).mean() > 0.95


def test_formulas(documents):
    for text in [*documents.text[:12], "", "one", "x y x y x", "漢字" * 40 + " and a word", "a" * 500]:
        assert fast(text) == plain_signature(text)


@pytest.mark.parametrize("seed", range(4))
def test_collision_rate_is_generalised_jaccard(seed):
    rng = np.random.default_rng(seed)
    hit, n = 0, 60
    a, b = rng.integers(0, 12, (2, 30))
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    for k in range(n):  # other names of the terms, other draws
        names = np.sort(np.random.default_rng(1000 * seed + k).integers(0, 1 << 63, 30).astype(np.uint64))
        x, y = (weighted.signature(names[v > 0], v[v > 0].astype(float)) for v in (a, b))
        hit += weighted.likeness(x, y) * weighted.SAMPLES
    total = n * weighted.SAMPLES
    assert abs(hit / total - want) < 4 * math.sqrt(want * (1 - want) / total)


@pytest.mark.parametrize("kept", [0, 50, 1 << 13])
def test_draws_taken_from_profiles(monkeypatch, documents, kept):
    monkeypatch.setattr(weighted, "KEPT", kept)
    monkeypatch.setattr(weighted, "STEP", 33)
    for a, b in zip(documents.text[:40], documents.text[1:41]):
        p, q = (weighted.profile(*weighted.terms(t.encode())) for t in (a, b))
        t = weighted.terms(weighted.edited(a, b).encode())
        assert (weighted.signature(*t, (p, q)) == weighted.signature(*t)).all() and (p.sign == weighted.signature(*weighted.terms(a.encode()))).all()


def test_odd_rows(docs_of):
    rows = ODD + [(None, f"nothing to name it {k}") for k in range(30)] + [(-9, "漢" * 100), (4, "one two"), (4, "another text")]
    assert result(weighted.fingerprints(docs_of(rows))) == brute(rows, fast)


@pytest.mark.parametrize("rows", [[(1, "a b c d e f")], [(None, "x y z")], [(1, "a b c"), (1, "a b c")], [(None, None), (None, "")]])
def test_few_rows(docs_of, rows):
    docs = docs_of(rows)
    assert result(weighted.fingerprints(docs)) == brute(rows, fast)
    assert weighted.fingerprints(docs.limit(0)).collect() == []


def test_ranges_of_any_number(spark, docs_of):
    rows = [((k * 7919) % 500 if k % 5 else None, f"text number {k} of many") for k in range(400)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in (1, 3, 40):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            assert result(weighted.fingerprints(docs_of(rows))) == brute(rows, fast)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
