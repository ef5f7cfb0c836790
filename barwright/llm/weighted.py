"""Fingerprints of documents by consistent weighted sampling.

The terms of a text are its pairs of neighbouring words and its first word, weighted by how often they occur. For each of ``SAMPLES`` places a term
draws r and c from Gamma(2, 1) and b from (0, 1), all from a hash of the term and the place; with weight w, t = floor(ln w / r + b) and
ln a = ln c - r (t - b) - r. The term with the smallest a is sampled, and two texts sample the same (term, t) with a chance that equals their
generalised Jaccard similarity, the sum of the smaller weights over the sum of the larger ones. A fingerprint keeps 16 bits of each sample.

The next document in the order of ids is found without gathering the order: rows are dealt to ranges between quantiles of the ids, and the first
row of each range is also lent to the range before it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

SAMPLES = 128
LONG, PIECE = 32, 9          # bytes: a longer word counts by its pieces, as texts without spaces have no words
KEPT, STEP = 1 << 13, 128    # terms of a text whose draws are kept for the next step, and made at a time
SHARE = 3                    # the last of so many parts of a text is replaced
_PLACES = np.random.default_rng(20240607).integers(0, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_PAIR = np.array([0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15], np.uint64)


def _gamma(steps: int = 1 << 16) -> np.ndarray:
    """Quantiles of Gamma(2, 1), whose distribution is 1 - (1 + x) exp(-x), by Newton's method."""
    p = (np.arange(steps) + 0.5) / steps
    x = np.where(p < 0.5, np.sqrt(2 * p), 2 - np.log1p(-p))
    for _ in range(60):
        x = np.maximum(x - (p - 1 + (1 + x) * np.exp(-x)) * -np.exp(x) / x, x / 2)
    return x


GAMMA = _gamma().astype(np.float32)
LOG_GAMMA = np.log(_gamma()).astype(np.float32)


def terms(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Rising hashes of the terms of a UTF-8 text and their weights: ASCII case folded, words cut at ASCII white space."""
    words = text.lower().split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    left = h[:-1] * _PAIR[0] + h[1:] * _PAIR[1]
    pairs = left ^ (left >> np.uint64(32))
    if max(map(len, words), default=0) > LONG:
        short = np.fromiter((len(w) <= LONG for w in words), bool, len(words))
        pieces = [xxhash.xxh3_64_intdigest(w[i:i + PIECE]) for w in words if len(w) > LONG for i in range(len(w) - PIECE + 1)]
        pairs = np.concatenate([pairs[short[:-1] & short[1:]], np.array(pieces, np.uint64)])
    hashes, count = np.unique(np.concatenate([h[:1], pairs]), return_counts=True)
    return hashes, count.astype(np.float64)


def lanes(hashes: np.ndarray) -> np.ndarray:
    """Four numbers below 2^16 for each hash and place: a name, and the draws of b, c and r."""
    z = hashes[:, None] * _PLACES
    z ^= z >> np.uint64(32)
    z *= np.uint64(0xD6E8FEB86659FD93)
    z ^= z >> np.uint64(29)
    return z.astype("<u8", copy=False).view("<u2").reshape(*z.shape, 4)


def draws(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each term and place ln a, in upper bits so that integers compare as it does, and 16 bits, never 0, that name (term, t).

    The variates are quantiles at 2^16 steps, taken from tables; ln a has single precision.
    """
    lane = lanes(hashes)
    r, log_c = (table.take(lane[..., k].astype(np.intp), mode="clip") for table, k in ((GAMMA, 3), (LOG_GAMMA, 2)))
    b = (lane[..., 1] + np.float32(0.5)) * np.float32(2.0 ** -16)
    name = lane[..., 0].astype(np.uint16)
    log_a = log_c - r * (1 - b)  # of weight one: t is 0
    more = np.flatnonzero(weights > 1)
    if len(more):
        t = np.floor(np.log(weights[more]).astype(np.float32)[:, None] / r[more] + b[more])
        log_a[more] = log_c[more] - r[more] * (t - b[more]) - r[more]
        name[more] = (name[more] + t.astype(np.int64) * 40503).astype(np.uint16)
    bits = log_a.view(np.uint32)
    order = bits ^ ((bits.view(np.int32) >> 31).view(np.uint32) | np.uint32(1 << 31))
    out = np.empty((*order.shape, 2), "<u4")
    out[..., 1], out[..., 0] = order, np.maximum(name, np.uint16(1))
    return out.view("<u8")[..., 0]


class Profile(NamedTuple):
    """Terms of a text, their draws (None of a text with very many), and its signature."""
    hashes: np.ndarray
    weights: np.ndarray
    values: np.ndarray | None
    sign: np.ndarray


def _least(hashes: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
    return [draws(hashes[i:i + STEP], weights[i:i + STEP]).min(axis=0) for i in range(0, len(hashes), STEP)]


def _sign(least: list[np.ndarray]) -> np.ndarray:
    """The names of the least draws; zeros where there is no term."""
    return np.minimum.reduce(least).astype(np.uint16) if least else np.zeros(SAMPLES, np.uint16)


def profile(hashes: np.ndarray, weights: np.ndarray) -> Profile:
    if not 0 < len(hashes) <= KEPT:
        return Profile(hashes, weights, None, _sign(_least(hashes, weights)))
    values = np.concatenate([draws(hashes[i:i + STEP], weights[i:i + STEP]) for i in range(0, len(hashes), STEP)])
    return Profile(hashes, weights, values, _sign([values.min(axis=0)]))


def signature(hashes: np.ndarray, weights: np.ndarray, like: tuple[Profile, ...] = ()) -> np.ndarray:
    """The signature of weighted terms. Draws of terms that a profile in ``like`` has with the same weight are taken from it."""
    least = []
    for p in like:
        if p.values is not None:
            at = np.minimum(np.searchsorted(p.hashes, hashes), len(p.hashes) - 1)
            same = (p.hashes[at] == hashes) & (p.weights[at] == weights)
            if same.any():
                least.append(p.values.take(at[same], axis=0, mode="clip").min(axis=0))
                hashes, weights = hashes[~same], weights[~same]
    return _sign(least + _least(hashes, weights))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as many characters of the beginning of ``following``, or all it has."""
    m = len(text) // SHARE
    return text[:len(text) - m] + following[:m]


def _ranges(rows: DataFrame, parts: int) -> Column:
    """(rows: known, key) The ranges a row goes to: its own, and, if its key is the first there, -1 less the range before.

    The key is the id, or a hash for rows without one (not known). Ids fall from range to range, then come the others by falling hash. Bounds are
    quantiles of all ids; there are at most ``parts`` ranges for ids and one more than that for the others.
    """
    ids = F.when(F.col("known"), F.col("key"))
    cut = F.percentile_approx(ids, [k / parts for k in range(1, parts)] or [0.5], 10000)
    found = rows.agg(cut.alias("cut"), F.count(ids).alias("n"), F.count(F.lit(1)).alias("all")).first()
    bounds = np.array(sorted(set(found.cut or ())), np.int64)
    slices = max(1, -(-(found.all - found.n) * parts // max(found.all, 1)))
    last = len(bounds)

    def own(known: pd.Series, key: pd.Series) -> np.ndarray:
        slice_ = np.clip(np.floor((0.5 - key.to_numpy() / 2.0 ** 64) * slices), 0, slices - 1).astype(np.int64)
        return np.where(known.to_numpy(), last - np.searchsorted(bounds, key.to_numpy(), side="right"), last + 1 + slice_)

    whole = F.pandas_udf(lambda known, key: pd.Series(own(known, key)), "long")
    # one row a range: the largest key is the first there
    firsts = {r.part: r.key for r in rows.select(whole("known", "key").alias("part"), "key").groupBy("part").agg(F.max("key").alias("key")).collect()}
    order = sorted(firsts)
    before = dict(zip(order, order[-1:] + order[:-1]))

    def to(known: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series([[p, -1 - before[p]] if firsts[p] == v else [p] for p, v in zip(own(known, key).tolist(), key.tolist())])

    return F.explode(F.pandas_udf(to, "array<long>")("known", "key"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is that with the next smaller doc_id; rows without an id come last, rows that share an id (or have none) stand by falling hash of
    their text, and after the last comes the first, which of one row is itself. A null text is empty. Texts without words have the fingerprint of
    zeros; two of them have likeness 1. Extra columns are left out; an empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    known = F.col("doc_id").isNotNull()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumns(
        {"known": known, "key": F.when(known, F.col("doc_id")).otherwise(F.xxhash64("text"))})
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    to = _ranges(rows.select("known", "key"), parts)
    lent = F.col("to") < 0
    dealt = (rows.select("doc_id", "text", to.alias("to"))
             .select(F.when(lent, -1 - F.col("to")).otherwise(F.col("to")).cast("int").alias("part"), lent.alias("lent"), "doc_id", "text"))
    placed = dealt.repartitionById(2 * parts + 1, "part").sortWithinPartitions("part", "lent", F.desc_nulls_last("doc_id"), F.xxhash64("text").desc(), "text")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for batch in batches:
            out = []
            for part, lent, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                if part != at:
                    at, held = part, None
                if lent and held is None:
                    continue  # one of the lent rows has served
                same = held is not None and held[1] == text
                own = held[2] if same else profile(*terms(text.encode()))
                if held is not None:
                    out.append(_row(*held, text, own))
                held = None if lent else (doc_id, text, own)
            yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    return placed.mapInArrow(walk, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                                    "near_edited double, near_next double")


def _row(doc_id: int | None, text: str, own: Profile, following: str, next_: Profile) -> dict:
    changed = edited(text, following)
    raw = changed.encode()
    after = own.sign if changed == text else signature(*terms(raw), (own, next_))
    code = lambda s: s.astype(">u2").tobytes().hex()
    return {"doc_id": doc_id, "n_chars": len(text), "edited_sha256": hashlib.sha256(raw).hexdigest(), "fingerprint": code(own.sign),
            "edited_fingerprint": code(after), "near_edited": likeness(own.sign, after), "near_next": likeness(own.sign, next_.sign)}
