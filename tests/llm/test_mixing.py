from pyspark.sql import functions as F
import numpy as np
import pytest

from barwright.llm import mixing
from odd_rows import ODD

FOLDER = "/root/testdata/sf0.01"


def fill(sizes, weights=(5, 2, 1), share=1.5, limit=2.0):
    """Targets by sharing out again and again what lies above the limit."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, open_, left = dict.fromkeys(names, 0.0), set(names), share * sum(sizes.values())
    while open_:
        total = sum(w[s] for s in open_)
        full = [s for s in open_ if left * w[s] / total >= limit * sizes[s]]
        if not full:
            return target | {s: left * w[s] / total for s in open_}
        for s in full:
            target[s] = limit * sizes[s]
        left -= sum(target[s] for s in full)
        open_ -= set(full)
    return target


@pytest.mark.parametrize("case", range(30))
def test_targets(spark, case):
    rng = np.random.default_rng(case)
    names = [f"s{k}" for k in range(rng.integers(1, 9))] + [None]
    sizes = {s: int(10 ** rng.uniform(0, 5)) if rng.random() > 0.1 else 0 for s in names}
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = fill(sizes)
    assert {r.source for r in got} == set(names)
    for r in got:
        assert r.target == pytest.approx(want[r.source], rel=1e-9, abs=1e-9)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = mixing.mix(docs).toPandas()
    want = fill(got.groupby("source")["size"].sum().to_dict())
    for source, rows in got.groupby("source"):
        assert rows.target.iloc[0] == pytest.approx(want[source]) and (rows.taken <= 2 * rows["size"]).all()
        assert abs(rows.taken.sum() - want[source]) <= rows["size"].max() / 2
        assert (rows.taken >= rows["size"] * (want[source] // rows["size"].sum())).all()
    again = mixing.mix(docs.repartition(5)).toPandas()
    cols = ["doc_id", "size", "target", "taken"]
    assert got[cols].sort_values("doc_id").values.tolist() == again[cols].sort_values("doc_id").values.tolist()
    drawn = mixing.draw(docs)
    assert drawn.columns == docs.columns
    seen = drawn.groupBy("doc_id").count().toPandas().set_index("doc_id")["count"].to_dict()
    assert seen == {d: t // s for d, s, t in zip(got.doc_id, got["size"], got.taken) if t}


def test_heavier_documents_come_first(docs_of):
    good, bad = "fives " * 20, "x " * 60
    docs = docs_of([(k, good if k % 2 else bad) for k in range(2000)])
    got = mixing.mix(docs, share=0.5).toPandas()
    assert got[got.doc_id % 2 == 1].copies.mean() > got[got.doc_id % 2 == 0].copies.mean() + 0.1


def test_odd_rows(docs_of):
    docs = docs_of([(*r, [None, "", "b", "B"][k % 4]) for k, r in enumerate(ODD)])
    got = mixing.mix(docs).toPandas()
    assert len(got) == len(ODD) and (got.taken <= 2 * got["size"]).all() and (got[got["size"] == 0].taken == 0).all()
    assert mixing.draw(docs).columns == docs.columns
    assert mixing.mix(docs.limit(0)).count() == 0 == mixing.draw(docs.limit(0)).count()


def test_ending_slice_is_small_for_any_weight(spark):
    """Weights near 0.01, as of base64: the largest slice, one of which is sorted, has few rows of the source."""
    for weight in (0.01, 0.06, 1.0):
        rows = spark.range(50000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), (F.length(F.md5(F.col("id").cast("string").cast("binary"))) * 3).alias("size"),
                                         (-F.log(mixing.hash_draw(F.col("id").cast("string"))) / weight).alias("key"))
        most = rows.groupBy(F.expr(mixing.key_slice("key"))).count().agg(F.max("count")).first()[0]
        assert most < 50000 * 0.001
