import re

import numpy as np
import pytest

from barwright.llm import near
from odd_rows import ODD

FOLDER = "/root/testdata/sf0.01"


def brute(rows):
    """doc_id -> (n_shingles, component_id) by comparing all pairs that share a shingle."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for doc_id, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
        sets[doc_id] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    held, count = {}, {}
    for d, s in sets.items():
        for x in s:
            held.setdefault(x, []).append(d)
    for ds in held.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1:]:
                count[a, b] = count.get((a, b), 0) + 1
    for (a, b), n in count.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_whole_table(spark, documents):
    df = near.components_of(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    assert result(df) == brute(zip(documents.doc_id, documents.text))


def chain(words, n, step):
    """Texts of which each shares much with the next and little with the last."""
    return [" ".join(words[k * step:k * step + n]) for k in range(6)]


def test_chains_ties_and_case(docs_of):
    words = [f"w{k}" for k in range(400)]
    texts = chain(words, 60, 5) + [" ".join(words[200:250]).upper(), " ".join(words[200:250]), " ".join(words[300:304]), " ".join(words[300:304])]
    # exactly 75 %: 30 of 40 shingles shared
    texts += [" ".join(words[100:100 + 34]) + " " + " ".join(f"x{k}" for k in range(5)), " ".join(words[100:100 + 34]) + " " + " ".join(f"y{k}" for k in range(5))]
    rows = list(enumerate(texts, 10))
    got = result(near.components_of(docs_of(rows)))
    assert got == brute(rows)
    assert {got[d][1] for d in range(10, 16)} == {10}


def test_large_group_of_near_copies(docs_of):
    rng = np.random.default_rng(1)
    base = [f"w{k}" for k in rng.integers(0, 5000, 120)]
    rows = []
    for d in range(700):
        w = list(base)
        for k in rng.integers(0, 120, rng.integers(0, 6)):
            w[k] = f"m{rng.integers(0, 10 ** 9)}"
        rows.append((d, " ".join(w)))
    rng.shuffle(rows)
    assert result(near.components_of(docs_of(rows))) == brute(rows)


def near_copies(m, edits, words=120, seed=1):
    rng = np.random.default_rng(seed)
    base = [f"w{k}" for k in rng.integers(0, 5000, words)]
    rows = []
    for d in range(m):
        w = list(base)
        for k in rng.integers(0, words, rng.integers(0, edits)):
            w[k] = f"m{rng.integers(0, 10 ** 9)}"
        rows.append((d, " ".join(w)))
    rng.shuffle(rows)
    return rows


def test_texts_shipped_are_linear_in_a_group(docs_of, monkeypatch):
    """Members of one group of near copies: as many rows as members in a round, whatever the size of the group."""
    shipped = []
    spokes, tiles = near.spokes, near.in_tiles

    def counted(make):
        def run(pairs):
            groups = make(pairs)
            shipped.append(groups.count())
            return groups
        return run

    monkeypatch.setattr(near, "spokes", counted(spokes))
    monkeypatch.setattr(near, "in_tiles", counted(tiles))
    figures = []
    for m in (600, 1800):
        rows = near_copies(m, 4)
        shipped.clear()
        got = result(near.components_of(docs_of(rows)))
        assert {c for _, c in got.values()} >= {0} and len(got) == m
        figures.append(sum(shipped))
    assert figures[0] < 8 * 600 and figures[1] < 8 * 1800  # a few rows a member, in any number of rounds


def test_apart_after_all_rounds(docs_of, monkeypatch):
    """No rounds of pivots: what is left is refuted or compared in tiles; and with rounds, the same."""
    rows = near_copies(300, 7, seed=4)
    want = brute(rows)
    for rounds in (0, 1):
        monkeypatch.setattr(near, "ROUNDS", rounds)
        assert result(near.components_of(docs_of(rows))) == want


def test_rows_without_an_id(docs_of):
    rows = [(None, f"word{k} " + " ".join(f"w{j}" for j in range(60))) for k in range(40)] + [(7, " ".join(f"w{j}" for j in range(60)))]
    got = near.components_of(docs_of(rows)).collect()
    assert len(got) == 41 and {r.component_id for r in got} == {7} and sum(r.kept for r in got) == 1


def test_odd_rows(docs_of):
    got = sorted(near.components_of(docs_of(ODD)).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    assert [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got] == [
        (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (5, 1, 4, False), (6, 1, 6, True),
        (7, 1, 7, True), (8, 1, 8, True), (None, 2, None, True)]


def test_empty_table(docs_of):
    empty = docs_of([(1, "x")]).limit(0)
    assert near.components_of(empty).collect() == [] and near.drop_near(empty).collect() == []


def test_drop_near(docs_of):
    docs = docs_of(ODD + [(4, "one two"), (4, "another text of one document id")])
    left = near.drop_near(docs)
    assert left.columns == docs.columns
    assert sorted(map(str, (r.doc_id for r in left.collect()))) == sorted(["1", "2", "3", "4", "4", "6", "7", "8", "None"])


def test_entries_guarantee():
    rng = np.random.default_rng(0)
    k = near.CHUNKS * near.WIDTH
    for _ in range(200):
        a = rng.integers(0, 1 << 16, k).astype(np.uint16)
        b = a.copy()
        away = rng.permutation(k)[:near.CHUNKS * (near.ERRORS + 1) - 1]
        b[away] ^= 1
        assert set(near.entries(a[None])[0]) & set(near.entries(b[None])[0])


@pytest.mark.parametrize("m", [2, 3, 9])
def test_linked(m):
    rng = np.random.default_rng(m)
    sets = [np.unique(rng.integers(0, 12, 14).astype(np.uint64)) for _ in range(m)]
    label = near.linked(sets)
    for i in range(m):
        assert label[i] <= i and label[label[i]] == label[i]
