"""The pipeline over a whole table, against each stage done by brute force in Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
from odd_rows import ODD
from test_mixing import fill
from test_near import brute
from tokenizers import Tokenizer

from barwright.llm import packing, tokens, toxicity

FOLDER = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def mixed(rows):
    """doc_id -> copies, from (doc_id, text, source)."""
    size = {d: len(WORD.findall(t)) for d, t, _ in rows}
    total = Counter()
    for d, _, s in rows:
        total[s] += size[d]
    target, out = fill(dict(total)), {}
    for source in total:
        keyed = []
        for d, t, s in rows:
            if s == source and size[d]:
                u = (int(hashlib.md5(str(d).encode()).hexdigest()[:15], 16) + 0.5) / 2 ** 60
                keyed.append((-math.log(u) / (6 / (6 + abs(len(t) / size[d] - 6))), d))
        epochs = int(target[source] // total[source]) if total[source] else 0
        rest, run = target[source] - epochs * total[source], 0
        for _, d in sorted(keyed):
            once = run < rest and run + size[d] - rest <= rest - run
            run += size[d]
            out[d] = epochs + once
    return out


def test_whole_table(spark, documents):
    model = toxicity.train(*(spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels")))
    clean = [r for r in zip(documents.doc_id, documents.text, documents.source) if model.score(r[1]) < toxicity.THRESHOLD]
    assert 0 < len(clean) < len(documents)
    group = brute([r[:2] for r in clean])
    unique = [r for r in clean if group[r[0]][1] == r[0]]
    assert len(unique) < len(clean)
    copies = mixed(unique)
    tokenizer, want = Tokenizer.from_file(tokens.vocabulary()), Counter()
    for d, text, _ in unique:
        ids, start = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4"), 0
        for n in packing.lengths(len(ids)) if copies.get(d) else []:
            want[d, start, n, zlib.crc32(ids[start:start + n].tobytes()), len(ids)] += copies[d]
            start += n
    got = corpus_pipeline.run(spark, FOLDER)
    assert Counter(tuple(r) for r in got.select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect()) == want


def test_odd_rows(spark, docs_of, tmp_path):
    folder = str(tmp_path)
    docs_of(ODD).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(4, 1, 0), (5, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    columns = spark.read.parquet(f"{folder}/documents.parquet").columns
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == columns
    rows, tokens_of = docs.collect(), Counter()
    for r in rows:
        assert r.length > 0 and r.length & (r.length - 1) == 0 and 0 <= r.start <= r.doc_tokens - r.length
        tokens_of[r.doc_id, r.doc_tokens] += r.length
    # near copies, toxic and empty documents are gone; each other one comes as many whole times as it is taken
    assert rows and {d for d, _ in tokens_of} <= {4, 6, 7, 8, None} and all(n % t == 0 for (_, t), n in tokens_of.items())
