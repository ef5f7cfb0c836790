import zlib

import numpy as np
import pandas as pd

from barwright.llm import toxicity
from odd_rows import ODD

FOLDER = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.classify(docs, labels).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 4 == 2 for d in got.doc_id]).all()
    held = got[got.held_out].merge(labels.toPandas(), on="doc_id")
    hit = held.predicted == held.toxic
    print(len(held), hit.mean(), held[held.toxic == 1].predicted.mean(), held[held.toxic == 0].predicted.mean())
    assert held[held.toxic == 1].predicted.mean() > 0.88 and held[held.toxic == 0].predicted.mean() < 0.015


def made(n, seed):
    rng = np.random.default_rng(seed)
    words, bad = [f"{a}{b}" for a in "bcdfgh" for b in "aeiou"], ["vile", "foul"]
    rows = []
    for d in range(n):
        s = [" ".join(rng.choice(words, 8)) for _ in range(rng.integers(1, 12))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            k = rng.integers(0, len(s))
            s[k] += " " + str(rng.choice(bad))
        rows.append((d, ". ".join(s), toxic))
    return rows


def test_finds_the_offending_sentence(docs_of):
    rows = made(600, 0)
    model = toxicity.fit([r[1] for r in rows], np.array([r[2] for r in rows]))
    fresh = made(200, 1)
    got = toxicity.sentences(docs_of([r[:2] for r in fresh]), model).collect()
    assert {r.doc_id for r in got} == {r[0] for r in fresh if r[2]}
    assert all("vile" in r.text or "foul" in r.text for r in got)


def test_odd_rows(spark, docs_of):
    docs = docs_of(ODD)
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (4, 0, 0), (5, 1, None), (None, 1, 1), (6, 1, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.classify(docs, labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns
    assert toxicity.classify(docs.limit(0), labels).count() == 0
    assert toxicity.classify(docs, labels.limit(0)).count() == len(ODD)


def test_length_alone_does_not_make_toxic():
    """Clean sentences of the real table, in texts of 10,000 sentences; one toxic sentence in such a text still counts."""
    docs, labels = (pd.read_parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.merge(labels, on="doc_id").dropna(subset=["toxic"]).fillna({"text": ""})
    held = np.array([zlib.crc32(str(d).encode()) % 4 == 2 for d in rows.doc_id])
    model = toxicity.fit(rows.text[~held].tolist(), rows.toxic[~held].to_numpy())
    fresh = rows[held]
    clean = [t for t in fresh.text[fresh.toxic == 0] if model.score(t) < 0.3]
    found = [t for t in fresh.text[fresh.toxic == 1] if model.score(t) >= 0.3]
    rng = np.random.default_rng(0)
    for k in range(10):
        parts, n = [], 0
        while n < 10_000:
            parts.append(clean[rng.integers(len(clean))])
            n += len(model.sentences(parts[-1]))
        assert model.score("\n".join(parts)) < 0.3
        assert model.score("\n".join([*parts, found[k]])) >= 0.3


def test_no_features_no_length():
    model = toxicity.fit(["a. b"] * 20, np.zeros(20))
    assert model.score("x. " * 10_000) == model.score("x") < 0.3


def test_long_texts_are_fitted(spark, docs_of, monkeypatch):
    """Toxic words that occur in long texts alone are learned; reading in ranges gives the same model as reading at once."""
    rows = made(300, 3)
    long = [(d, ". ".join([t] * (210_000 // max(len(t), 1) + 1)) if y and d % 3 == 0 else t.replace("vile", "bago").replace("foul", "bago"), y) for d, t, y in rows]
    long = [(d, t, y if len(t) > 200_000 else 0) for d, t, y in long]
    docs, labels = docs_of([r[:2] for r in long]), spark.createDataFrame([(r[0], 1, r[2]) for r in long], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    assert any(f in model.number for f in ("=vile", "=foul", "vil", "fou"))
    monkeypatch.setattr(toxicity.Stored.__init__, "__defaults__", (1 << 20,))
    assert toxicity.train(docs, labels) == model


def test_scores_are_those_of_the_weights(spark):
    """Every score of a table again from the weights, one sentence at a time and without the operator's caches."""
    import math
    folder = FOLDER.replace("0.1", "0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    assert model.number and got.keys() == texts.keys()
    for d, text in texts.items():
        clean = 0.0  # log of the chance that no sentence offends
        for sentence in toxicity._SENTENCE.findall((text or "").lower()):
            words = toxicity._WORD.findall(sentence)
            if words:
                known = {model.number[f] for w in words for f in toxicity.features(w) if f in model.number}
                z = model.bias + math.fsum(model.weights[k] for k in known)
                clean -= max(math.log1p(math.exp(-abs(z))) + max(z, 0.0) - model.floor, 0.0)
        want = 1 - math.exp(clean)
        assert abs(got[d].score - want) < 1e-9 and got[d].predicted == int(want >= toxicity.THRESHOLD), d
