"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence scores sigmoid(bias + sum of the weights of its distinct features); the document scores
the noisy-or of its sentences, 1 - prod(1 - p). Weights are learned from document labels alone, by ascent on the likelihood,
and then say which sentences offend. What a sentence of a clean document has by chance is taken off first: p counts as (p - q) / (1 - q),
or 0 below q. The floor q is the least at which clean sentences of the sample leave ``LEAK`` each on average, so that length alone does not
make a document toxic; it is at least the score of a sentence without known features.

The classifier is fitted on at most ``SAMPLE`` labelled rows, those with the smallest hash of their id. Its features are words and
their stems (the first ``STEMS`` letters), so that inflected forms count together; it keeps those that toxic documents have ``LEAST_TOLD``
standard deviations more often than the rate of the labels would give them. Long texts are fitted as well: the sample is stored and gone through ``AT_ONCE`` bytes at a time. While it learns, half of the features are hidden in turn, so that a word is not left without
weight because others next to it explain the label; in the last rounds all are seen and only the bias moves. Scoring reads every sentence of every text in one pass.
"""

from __future__ import annotations

import itertools
import math
import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from barwright.llm.shared import forget, keep, spare

SAMPLE, FILES, AT_ONCE = 10_000, 8, 64 << 20
STEMS = (3, 4, 5, 6)
LEAST_DOCUMENTS, LEAST_TOXIC = 6, 3
LEAST_TOLD = 4.5  # standard deviations between a feature's toxic documents and the expected number
ROUNDS, LAST, STEP, DECAY = 400, 100, 0.1, 0.03
DROPPED, SEED = 0.5, 7
START = -10.0  # log-odds of a sentence without known features, before fitting
CACHE = 300_000
THRESHOLD = 0.3
LEAK = 1e-6  # what a clean sentence may add to -log(1 - score), on average: 0.1 at 100,000 sentences
FOLDS, HELD = 4, 2
_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    """A word, marked as whole, and its stems."""
    return ["=" + word, *(word[:k] for k in STEMS if len(word) >= k)]


class Known(dict):
    """From a word to the numbers of its features; remembers up to CACHE words."""

    def __init__(self, number: dict[str, int]):
        super().__init__()
        self.number = number

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHE:
            self.clear()
        out = self[word] = tuple(self.number[f] for f in features(word) if f in self.number)
        return out


def sentence_ids(text: str | None, known: Known) -> list[set[int]]:
    """The known features of each sentence; a sentence without letters is left out."""
    out = []
    for sentence in _SENTENCE.findall(text.lower() if text else ""):
        if found := _WORD.findall(sentence):
            out.append({k for w in found for k in known[w]})
    return out


@dataclass(frozen=True)
class Model:
    """``number`` names the features; ``weights`` and ``bias`` are their log-odds. ``floor`` is -log(1 - q), taken off each sentence."""

    number: dict[str, int]
    weights: list[float]
    bias: float
    floor: float = 0.0

    def sentences(self, text: str | None, known: Known | None = None) -> list[float]:
        """Log-odds of each sentence that has letters."""
        w = self.weights
        return [self.bias + sum(w[k] for k in ids) for ids in sentence_ids(text, known or Known(self.number))]

    def evidence(self, text: str | None, known: Known | None = None) -> np.ndarray:
        """-log(1 - p) of each sentence, above the floor."""
        return np.maximum(np.logaddexp(0.0, self.sentences(text, known)) - self.floor, 0.0)

    def score(self, text: str | None, known: Known | None = None) -> float:
        """Noisy-or of the sentences. Without known features it is the rate of the labels, however long the text is."""
        if not self.number:
            return 1 / (1 + math.exp(-self.bias))
        return -math.expm1(-float(self.evidence(text, known).sum()))


def chance(values: np.ndarray, weights: np.ndarray, leak: float) -> float:
    """The least floor above which the ``values`` leave ``leak`` a sentence on average, ``weights`` being how many sentences have each."""
    order = np.argsort(values)[::-1]
    v, n = values[order], np.cumsum(weights[order])
    over = np.cumsum(v * weights[order]) - n * np.append(v[1:], 0.0)  # left above the next smaller value
    k = int(np.searchsorted(over, leak * n[-1]))
    return 0.0 if k >= len(v) else float(v[k] - max(leak * n[-1] - (over[k - 1] if k else 0.0), 0.0) / n[k])


def fit(texts: Iterable[str], labels: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Learn word weights; ``texts`` is gone through several times. With labels of one kind or no rows, the model is the rate of the labels."""
    y = np.asarray(labels, np.float64)
    n = len(y)
    rate = float((y.sum() + 1) / (n + 2))
    empty = Model({}, [], float(np.log(rate / (1 - rate))))
    if not n or y.min() == y.max():
        return empty
    # features of toxic documents first; the others are counted for those alone, so memory follows the toxic share of the sample
    hits: Counter[str] = Counter()
    for text in itertools.compress(texts, y):
        hits.update({f for w in set(_WORD.findall(text.lower())) for f in features(w)})
    held = sorted(f for f, k in hits.items() if k >= min(LEAST_TOXIC, n))
    misses = np.zeros(len(held))
    known = Known({f: k for k, f in enumerate(held)})
    for text in itertools.compress(texts, 1 - y):
        misses[list({k for w in set(_WORD.findall(text.lower())) for k in known[w]})] += 1
    count = {f: (int(m), hits[f]) for f, m in zip(held, misses)}
    # a longer stem that occurs as often as the stem it extends says nothing more
    names = [f for f, c in count.items() if sum(c) >= min(LEAST_DOCUMENTS, n) and count.get(f[:-1] if f[0] != "=" else f[1:1 + STEMS[-1]]) != c]
    c = np.array([count[f] for f in names], np.float64).reshape(-1, 2)
    total = c.sum(axis=1)
    spread = np.sqrt(np.maximum(total * rate * (1 - rate) * (1 - (total - 1) / max(n, 2)), 1e-9))
    told = (c[:, 1] - total * rate) / spread
    best = [k for k in np.argsort(-told, kind="stable").tolist() if told[k] >= LEAST_TOLD]
    if not best:
        return empty
    number = {names[k]: i for i, k in enumerate(sorted(best))}
    known = Known(number)

    # sentences of a document with the same features are one entry, ``many`` times
    doc, many, plain, sent, word, at = array("i"), array("d"), np.zeros(n), array("i"), array("i"), 0
    for d, text in enumerate(texts):
        for ids, times in Counter(tuple(sorted(ids)) for ids in sentence_ids(text, known)).items():
            if ids:
                doc.append(d)
                many.append(times)
                word.extend(ids)
                sent.extend([at] * len(ids))
                at += 1
            else:
                plain[d] += times
    if not at:
        return empty
    doc, many, sent, word = np.array(doc), np.array(many), np.array(sent), np.array(word)
    plain[(plain == 0) & (np.bincount(doc, minlength=n) == 0)] = 1
    w = np.zeros(len(number) + 1)
    w[-1] = START
    first, second = np.zeros_like(w), np.zeros_like(w)
    draw = np.random.default_rng(SEED)
    for k in range(1, rounds + 1):
        last = k > rounds - min(LAST, rounds // 2)
        seen = np.ones(len(number)) if last else (draw.random(len(number)) >= DROPPED).astype(float)
        z = w[-1] + np.bincount(sent, (w[:-1] * seen)[word], minlength=at)
        p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-w[-1]))
        quiet = -np.bincount(doc, many * np.logaddexp(0, z), minlength=n) - plain * np.logaddexp(0, w[-1])
        lift = y * np.exp(quiet) / np.maximum(-np.expm1(quiet), 1e-12) - (1 - y)  # d log-likelihood / d p, over 1 - p
        gz = lift[doc] * many * p
        grad = np.append(np.bincount(word, gz[sent], minlength=len(number)) * seen - DECAY * w[:-1], gz.sum() + (lift * plain).sum() * p0) / n
        if last:
            grad[:-1] = first[:-1] = 0.0
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        w += STEP * (first / (1 - 0.9 ** k)) / (np.sqrt(second / (1 - 0.999 ** k)) + 1e-8)
    # a sentence that reaches the threshold alone is an error of its own, not of length
    bias, clean = np.logaddexp(0, w[-1]), y[doc] == 0
    values = np.append(np.logaddexp(0, w[-1] + np.bincount(sent, w[word], minlength=at))[clean], bias)
    counts = np.append(many[clean], max(plain[y == 0].sum(), 1.0))
    low = values < -math.log1p(-THRESHOLD)
    return Model(number, w[:-1].tolist(), float(w[-1]), max(float(bias), chance(values[low], counts[low], LEAK) if low.any() else 0.0))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo the number of folds; null without an id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


ORDER = ["place", "doc_id", "crc"]


class Stored:
    """Texts of a stored sample in order, the first ``n``, read in ranges of the place; a sample of one range is read once."""

    def __init__(self, rows: DataFrame, places: list[int], sizes: list[int], at_once: int = AT_ONCE):
        self.rows, self.n, self.ranges, self.held = rows, len(places), [], None
        total = 0
        for place, size in zip(places, sizes):
            if not self.ranges or (total + size > at_once and place != self.ranges[-1][1]):
                self.ranges.append((place, place))
                total = 0
            self.ranges[-1] = (self.ranges[-1][0], place)
            total += size

    def part(self, low: int, high: int) -> pa.ChunkedArray:
        return self.rows.filter(F.col("place").between(low, high)).orderBy(*ORDER).select("text").toArrow().column("text")

    def __iter__(self) -> Iterator[str]:
        if len(self.ranges) == 1 and self.held is None:
            self.held = self.part(*self.ranges[0])
        parts = [self.held] if self.held is not None else (self.part(*r) for r in self.ranges)
        return itertools.islice((t.as_py() for part in parts for t in part), self.n)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled rows outside the held-out fold, the same rows on every run, whatever their length.

    Labels that are null are left out; a document labelled twice is toxic if one label says so. Null texts count as empty.
    """
    doc_id = F.col("doc_id").cast("long")
    known = labels.select(doc_id.alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(
        F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != HELD))
    chosen = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    found = (docs.select(doc_id.alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
             .join(F.broadcast(chosen), "doc_id")  # at most `sample` rows of 12 bytes
             .withColumns({"place": F.xxhash64("doc_id"), "crc": F.crc32(F.col("text").cast("binary"))}))
    rows, path = keep(found.repartition(FILES), "sample")
    told = rows.select(*ORDER, F.octet_length("text").alias("size"), "toxic").orderBy(*ORDER).limit(sample).toArrow()
    texts = Stored(rows, told.column("place").to_pylist(), told.column("size").to_pylist())
    model = fit(texts, np.array(told.column("toxic").to_pylist()))
    forget(docs.sparkSession, [path])
    return model


def with_score(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """``docs`` with a column ``out``, the score of the whole text; null and empty texts score as texts without sentences."""
    own, text = spare(docs, "whole_row", "scored_text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(model.number)
        for batch in batches:
            scores = [model.score(t.as_py(), known) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], schema=pa.schema(
                [batch.schema.field(0), pa.field(out, pa.float64())]))

    wrapped = docs.select(F.struct("*").alias(own), F.col("text").cast("string").alias(text))
    return wrapped.mapInArrow(each, StructType([wrapped.schema[own], StructField(out, DoubleType())])).select(f"{own}.*", out)


def sentences(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, sentence (position), text, score of the sentences that score ``threshold`` or more."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(model.number)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                spans = [s for s in _SENTENCE.findall(text.as_py() or "") if _WORD.search(s.lower())]
                for k, (span, told) in enumerate(zip(spans, model.evidence(text.as_py(), known))):
                    if (p := -math.expm1(-told)) >= threshold:
                        rows.append((doc_id, k, span.strip(), p))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (
                    pa.int64(), pa.int64(), pa.string(), pa.float64()))], ["doc_id", "sentence", "text", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        each, "doc_id long, sentence long, text string, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted. A null doc_id is not held out. Repeated rows score alike."""
    scored = with_score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train(docs, labels))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == HELD, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose score is ``threshold`` or more."""
    (score,) = spare(docs, "toxic_score")
    return with_score(docs, train(docs, labels), score).filter(F.col(score) < threshold).drop(score)
