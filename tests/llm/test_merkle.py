import hashlib
import zlib

import pytest

from barwright.llm import merkle, queries

FOLDER = "/root/testdata/sf0.01"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """The root, and for each node its siblings as (left, right) pairs."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = nodes[i - i % 3:i - i % 3 + 3]
            paths[k].append(("".join(run[:i % 3]), "".join(run[i % 3 + 1:])))
        nodes = [h(*nodes[i:i + 3]) for i in range(0, len(nodes), 3)]
        at = [i // 3 for i in at]
    return nodes[0], paths


def fold(node, path):
    for left, right in path:
        node = h(left, node, right)
    return node


def brute(rows):
    """Sorted result rows of (doc_id, source, lang, n_chars, text) rows."""
    sources = {}
    for row in rows:
        sources.setdefault(row[1], []).append(row)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    made, out = {}, []
    for s in names:
        made[s] = sorted(sources[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    subroots = {s: tree([leaf(r) for r in made[s]]) for s in names}
    if not names:
        return []
    root, ups = tree([subroots[s][0] for s in names])
    for s, up in zip(names, ups):
        for row, path in zip(made[s], subroots[s][1]):
            path = path + up
            even = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0
            folded = fold(leaf((*row[:4], row[4].replace("\n", "") if even and row[4] is not None else row[4])), path)
            out.append((row[0], leaf(row), subroots[s][0], root, h(*(a + b for a, b in path)), folded, folded == root))
    return sorted(out, key=str)


def result(df):
    return sorted(map(tuple, df.collect()), key=str)


def fields(df):
    return [tuple(r) for r in df.select(*merkle.FIELDS).collect()]


def test_whole_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = result(queries.op12_merkle_manifest(spark, FOLDER))
    assert got == brute(fields(docs))
    assert {r[6] for r in got} == {True, False}


@pytest.mark.parametrize("depth", [1, 2])
def test_many_rounds_and_sources(spark, monkeypatch, depth):
    """Small blocks: several rounds in the sources and over them, with last blocks of one node."""
    monkeypatch.setattr(merkle, "DEPTH", depth)
    monkeypatch.setattr(merkle, "BLOCK", merkle.WAYS ** depth)
    sizes = [1, 2, 3, 4, 9, 10, 27, 28, 82, 163, 5, 1, 3]
    rows = [(1000 * s + k, None if s == 4 else f"s{s}é", "en", k, f"a\nb {k}" if k % 3 else None) for s, n in enumerate(sizes) for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(7)
    assert result(merkle.audit(docs)) == brute(rows)


def test_odd_rows(docs_of):
    from odd_rows import ODD
    docs = docs_of([(*r, s) for r, s in zip(ODD, ["b", "a", None, "é", "B", "B", "", "b", "a", "b"])] + [(None, "no id here at all today", "b"), (-7, "x\n\n", "a")])
    assert result(merkle.audit(docs)) == brute(fields(docs))
    assert merkle.audit(docs.limit(0)).collect() == []


def test_path_is_that_of_the_leaf(docs_of):
    docs = docs_of([(i, f"text {i}", "s") for i in range(50)])
    for r in merkle.manifest(docs).collect():
        assert fold(r.leaf, [(s["left"], s["right"]) for s in r.path]) == r.root and r.subroot == r.root
