"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key with its quality weight as rate: -ln(u) / weight, u hashed from its id. A source with
a target of t words out of S takes floor(t / S) complete epochs first, then the documents with the smallest keys until
their sizes reach what is left of t. The last one is taken if that comes nearer to the target.

Only DataFrame functions. No source is sorted as a whole: sizes are summed per slice of the key order, and only the slice in
which the budget ends is ordered. Slices are equal steps of the logarithm of the key: of rows of any one weight, a slice expects a share below
ln 2 / (e * PER_OCTAVE), however small the weight. What comes out is one cut per source; whether a document is taken is then a comparison.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from barwright.llm.shared import hash_draw, keep, spare, word_count

WEIGHTS = (5, 2, 1)
SHARE, LIMIT = 1.5, 2.0
PER_OCTAVE = 1024


def key_slice(key: str) -> str:
    return f"cast(floor(log2(greatest({key}, 1e-300D)) * {PER_OCTAVE}) AS int)"


def quality(text: Column, size: Column) -> Column:
    """Weight in (0, 1]: highest for documents whose words take six characters, space included."""
    per_word = F.length(F.coalesce(text, F.lit(""))) / F.greatest(size, F.lit(1))
    return F.lit(6.0) / (F.lit(6.0) + F.abs(per_word - F.lit(6.0)))


def sized(docs: DataFrame, weight: Column | None = None) -> DataFrame:
    """doc_id, source, size in words, key. Without a doc_id the draw is made from the text."""
    size = word_count(F.col("text"))
    name = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.col("text").cast("binary")), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"),
                       hash_draw(name).alias("u"), F.col("text"))
    return base.select("doc_id", "source", "size", (-F.log("u") / (weight if weight is not None else quality(F.col("text"), F.col("size")))).alias("key"))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """One row per source: source, source_size, target (double). ``sizes``: source, source_size.

    Targets are min(limit * size, level * weight) with the level at which they sum to share * all sizes. Sources stand in
    order of (limit * size / weight); the first k of them are at their limit. Windows here run over one row per source.
    """
    if not 0 <= share <= limit:
        raise ValueError("the share must lie between 0 and the limit")
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(limit)))
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, upto = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(Window.partitionBy(F.lit(0))) * F.lit(float(share)) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    s = s.withColumn("level", left / F.sum("weight").over(upto))
    # the level left to the sources from one on rises while those before it belong at their limit, and falls after that
    level = F.max("level").over(Window.partitionBy(F.lit(0)))
    return s.withColumn("level", level).select("source", "source_size", F.least("most", F.col("level") * F.col("weight")).alias("target"))


def cuts(base: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """One row per source: source, source_size, target, epochs, and the last (cut_key, cut_id) taken once more."""
    cut = base.withColumn("slice", F.expr(key_slice("key")))
    slices = cut.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    aims = targets(slices.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, limit)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    aims, _ = keep(aims.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "aims", 1)
    # some ten thousand slices a source at most
    run = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    found = slices.withColumn("upto", F.sum("words").over(run)).alias("s").join(aims.alias("a"), F.expr("s.source <=> a.source")).filter(
        "rest > 0 AND upto - words < rest AND upto >= rest")
    ends, _ = keep(found.select(F.col("s.source").alias("source"), "slice", (F.col("upto") - F.col("words")).alias("before"), "rest"), "ends", 1)
    inside = Window.partitionBy("source").orderBy("key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, 0)
    last = (cut.alias("d").join(ends.alias("e"), F.expr("d.source <=> e.source AND d.slice = e.slice"))
            .select("e.source", "d.doc_id", "d.size", "d.key", "before", "rest")
            .withColumn("total", F.col("before") + F.sum("size").over(inside))
            .filter("total - size < rest AND total - rest <= rest - (total - size)")
            .groupBy("source").agg(F.max(F.struct("key", F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"))).alias("last"))
            .select("source", F.col("last.key").alias("last_key"), F.col("last.id").alias("last_id")))
    joined = (aims.alias("a").join(ends.alias("e"), F.expr("a.source <=> e.source"), "left")
              .join(last.alias("l"), F.expr("a.source <=> l.source"), "left"))
    return joined.select("a.source", "source_size", "target", "epochs", F.col("e.slice").alias("cut_slice"),
                         F.coalesce("last_key", F.lit(-1.0)).alias("cut_key"),
                         F.coalesce("last_id", F.lit(-(1 << 63))).alias("cut_id"))


def copies(base: str, cut: str) -> Column:
    """How often a document is taken, from its key and its source's cut."""
    part = key_slice(f"{base}.key")
    once = (f"CASE WHEN {cut}.cut_slice IS NULL OR {part} > {cut}.cut_slice THEN 0 WHEN {part} < {cut}.cut_slice THEN 1 "
            f"WHEN {base}.key < {cut}.cut_key OR {base}.key = {cut}.cut_key AND coalesce({base}.doc_id, {(1 << 63) - 1}) <= {cut}.cut_id THEN 1 ELSE 0 END")
    return F.expr(f"CASE WHEN {base}.size = 0 THEN 0L ELSE {cut}.epochs + {once} END")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """Per row of ``docs``: doc_id, source, size, source_size, target, copies, taken = copies * size.

    Null and empty texts have size 0 and are not taken. A null source is a source, the last in order. Rows with equal keys and ids
    are taken together. A source without words has target 0. Extra columns are left out; an empty table gives no rows.
    """
    base, _ = keep(sized(docs), "sized")
    found, _ = keep(cuts(base, weights, share, limit), "cuts")
    joined = base.alias("b").join(found.alias("c"), F.expr("b.source <=> c.source"))
    return joined.select("b.doc_id", "b.source", "b.size", "c.source_size", "c.target", copies("b", "c").alias("copies")).withColumn(
        "taken", F.col("copies") * F.col("size"))


def draw(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """``docs`` as mixed: each row as many times as it is taken."""
    base, _ = keep(sized(docs), "sized")
    found, _ = keep(cuts(base, weights, share, limit), "cuts")
    own, size, key, times = spare(docs, "draw_row", "size", "key", "times")
    name = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.col("text").cast("binary")), F.lit(""))
    rows = docs.select(F.struct("*").alias(own), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       word_count(F.col("text")).alias("size"), hash_draw(name).alias("u"), quality(F.col("text"), word_count(F.col("text"))).alias("q"))
    rows = rows.withColumn("key", -F.log("u") / F.col("q"))
    joined = rows.alias("b").join(found.alias("c"), F.expr("b.source <=> c.source"))
    repeated = joined.select(f"b.{own}", F.explode(F.array_repeat(F.lit(0), copies("b", "c").cast("int"))).alias(times))
    return repeated.select(f"{own}.*")


ORACLE = r"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    length(coalesce(text, '')) AS chars, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, md5(text), '')), 1, 15))::BIGINT::DOUBLE + 0.5) / 1152921504606846976.0 AS u
    FROM documents),
  k AS (SELECT *, -ln(u) / (6.0 / (6.0 + abs(chars / greatest(size, 1) - 6.0))) AS key FROM d),
  s AS (SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size)::DOUBLE AS most,
    [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight FROM k GROUP BY source),
  l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s),
  t AS (SELECT source, source_size, least(most, max(level) OVER () * weight) AS target FROM l),
  e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
  r AS (SELECT k.*, e.source_size, e.target, e.epochs, target - epochs * source_size AS rest,
    sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total
    FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
  SELECT doc_id, size, source_size, target,
    (size * (epochs + CASE WHEN total - size < rest AND total - rest <= rest - (total - size) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r"""
