"""Near-duplicate documents by a multi-index Hamming join of b-bit MinHash signatures.

A document is the set of its distinct five-word shingles. Its signature has CHUNKS * WIDTH MinHash values of 16 bits. The
signature is split into CHUNKS chunks, and every chunk is entered once for each way of leaving out ``ERRORS`` of its values.
Two signatures that differ in fewer than CHUNKS * (ERRORS + 1) places have, by pigeonhole, a chunk with at most ``ERRORS``
differences, hence share an entry: every pair below that distance is found. At similarity 0.75 a pair misses all ten
chunks with probability 0.262 ** 10 < 2e-6. All pairs found are confirmed on full sets.

Equal sets are one node, so copies never meet in a bucket. In each bucket the most central member is the pivot: the others are
compared with it alone, so a group ships as many texts as it has members. Confirmed links are contracted to components by alternating large-star
and small-star steps over tables in the shared folder. Buckets whose members are then of one component are done; in others a new
pivot is taken from the smallest component, and compared with the members of the others. What still stands apart after ``ROUNDS`` is refuted
where it can be from what a set shares with no other one, and else compared pair by pair, in tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from barwright.llm.shared import forget, keep, spare

SHINGLE, CHUNKS, WIDTH, ERRORS = 5, 10, 4, 1
PERCENT = 75
TILE = 128
ROUNDS, CENTRAL = 4, 2  # rounds of pivots, of which the first take central ones
NO_ID = -(1 << 63)  # stands for a null doc_id where texts are fetched; text_key tells such rows apart
_draw = np.random.default_rng(20240607)
_PLACE = _draw.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MUL = _draw.integers(1, 1 << 63, CHUNKS * WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _draw.integers(0, 1 << 63, CHUNKS * WIDTH, dtype=np.uint64)


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a UTF-8 text; ASCII case folded, words cut at ASCII white space."""
    words = text.lower().split() if text else []
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64) if words else np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - SHINGLE + 1
    s = h[:n] * _PLACE[0]
    for k in range(1, SHINGLE):
        s += h[k:k + n] * _PLACE[k]
    s ^= s >> np.uint64(31)
    s *= np.uint64(0x9E3779B97F4A7C15)
    s ^= s >> np.uint64(29)
    s.sort()
    return s[np.r_[True, s[1:] != s[:-1]]]


def signature(shingles: np.ndarray) -> np.ndarray:
    """16 bits of each smallest value, for a set that is not empty."""
    k = len(_MUL)
    least = np.empty(k, np.uint64)
    step = max(1, (1 << 20) // len(shingles))
    for i in range(0, k, step):
        least[i:i + step] = (shingles * _MUL[i:i + step, None] + _ADD[i:i + step, None]).min(axis=1)
    return (least >> np.uint64(24)).astype(np.uint16)


def entries(signatures: np.ndarray) -> np.ndarray:
    """Keys of each signature: the chunk, the value left out, and the values that stay, in one 64-bit integer."""
    s = signatures.reshape(-1, CHUNKS, WIDTH).astype(np.int64)
    keys = []
    for out in range(WIDTH):  # ERRORS = 1: one value left out
        left = [j for j in range(WIDTH) if j != out]
        key = np.arange(CHUNKS)[None, :] * WIDTH + out
        for j in left:
            key = key << 16 | s[:, :, j]
        keys.append(key)
    return np.concatenate(keys, axis=1)


def profiles(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, text_key, n_shingles, set_id (128-bit hash of the set; null without words), signature."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ids, signs = [], [], []
            for text in batch.column(2).cast(pa.binary()):
                s = shingle_set(text.as_py())
                sizes.append(len(s))
                ids.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                signs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(signs, pa.binary())],
                ["doc_id", "text_key", "n_shingles", "set_id", "signature"])

    return docs.select(F.col("doc_id").cast("long"), text_key(F.col("text")), F.col("text").cast("string")).mapInArrow(
        each, "doc_id long, text_key long, n_shingles long, set_id binary, signature binary")


def text_key(text):
    return F.xxhash64(text.cast("string")).alias("text_key")


def buckets(nodes: DataFrame) -> DataFrame:
    """(key, node, rank): entries that more than one node has; the pivot of a bucket is the member of least rank.

    The rank falls with the number of nodes met in all buckets: copies with few changes of their own meet the most.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 4096) for i in range(0, batch.num_rows, 4096)):
                raw = b"".join(part.column(1).to_pylist())
                keys = entries(np.frombuffer(raw, np.uint16))
                ids = np.repeat(part.column(0).to_numpy(zero_copy_only=False), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(ids)], ["key", "node"])

    spark = nodes.sparkSession
    keys, path = keep(nodes.select("node", "signature").mapInArrow(spread, "key long, node long"), "keys")
    many = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members, where = keep(keys.join(many, "key"), "members")
    met = members.groupBy("node").agg(F.sum("n").alias("met"))
    out, _ = keep(members.drop("n").join(met, "node").select("key", "node", F.struct((-F.col("met")).alias("met"), "node").alias("rank")), "buckets")
    forget(spark, [path, where])
    return out


def apart(members: DataFrame, found: DataFrame | None, central: bool) -> DataFrame:
    """(key, node, rank, root, pivot, at): members of the buckets that still hold more than one component; ``at`` is the root of the pivot.

    The pivot is the most central member, or that of the smallest component, so that one that stands apart is compared with all others at once.
    """
    if found is None:
        rooted = members.withColumn("root", F.col("node"))
        each = rooted.select("key", F.lit(1).cast("long").alias("n"), "rank", "root")
    else:
        rooted = members.join(found, "node", "left").select("key", "node", "rank", F.coalesce("root", "node").alias("root"))
        each = rooted.groupBy("key", "root").agg(F.lit(0).alias("n") if central else F.count(F.lit(1)).alias("n"), F.min("rank").alias("rank"))
    of = each.groupBy("key").agg(F.min(F.struct("n", "rank", "root")).alias("first"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
    return rooted.join(of.select("key", F.col("first.rank.node").alias("pivot"), F.col("first.root").alias("at")), "key")


def spokes(pairs: DataFrame) -> DataFrame:
    """(pivot, tile, node, spoke) from distinct (pivot, node): groups of at most about TILE members, each with a row for the pivot itself."""
    # a table of its own, so that the join below can split a pivot that has many members
    tiles, _ = keep(pairs.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / F.lit(TILE)).cast("int").alias("tiles")), "tiles")
    dealt = pairs.join(tiles, "pivot").select("pivot", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int").alias("tile"), "node", F.lit(1).alias("spoke"))
    hubs = tiles.select("pivot", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), F.col("pivot").alias("node"), F.lit(0).alias("spoke"))
    return dealt.union(hubs)


def sets_of(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles): the sets of the ``wanted`` nodes, from the text of one of the documents that have it."""
    at = nodes.join(wanted.hint("merge"), "node").select("node", "id", "text_key")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), text_key(F.col("text")), F.col("text").cast("string").alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text.as_py()).tobytes() for text in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "shingles"])

    # the wanted rows grow with the documents, hence never a broadcast; of repeated rows one counts
    chosen = texts.join(at.hint("merge"), ["id", "text_key"]).dropDuplicates(["id", "text_key"])
    return chosen.select("node", "text").mapInArrow(each, "node long, shingles binary")


def tied(grouped: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (u, v) of members to the pivot of their group. A task holds the pivot's set and that of one member."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hub = None, None
        for batch in batches:
            u, v = [], []
            for pivot, tile, node, spoke, raw in zip(*(c.to_pylist() for c in batch.columns)):
                own = np.frombuffer(raw, np.uint64)
                if not spoke:
                    at, hub = (pivot, tile), own
                elif at == (pivot, tile) and similar(hub, own, percent):
                    u.append(node)
                    v.append(pivot)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return (grouped.select("pivot", "tile", "node", "spoke", "shingles").repartition("pivot", "tile").sortWithinPartitions("pivot", "tile", "spoke")
            .mapInArrow(walk, "u long, v long"))


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def hopeful(sets: DataFrame, left: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Rows of ``left`` (key, node, ...) without those nodes that cannot be linked in their bucket.

    A set of n shingles, u of which no other set of ``left`` has, shares at most n - u with another one of m shingles, so a link needs
    100 (n - u) >= percent * (u + m). It is refuted where the smallest m of the bucket is too large.
    """
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, raw in zip(*(c.to_pylist() for c in batch.columns)):
                x = np.frombuffer(raw, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(np.full(len(x), node)), pa.array(np.full(len(x), len(x)))], ["shingle", "node", "n"])

    own = sets.join(left.select("node").distinct(), "node").select("node", "shingles").mapInArrow(each, "shingle long, node long, n long")
    alone = own.groupBy("shingle").agg(F.count(F.lit(1)).alias("k"), F.min("node").alias("node")).filter("k = 1").groupBy("node").agg(F.count(F.lit(1)).alias("u"))
    size = own.groupBy("node").agg(F.max("n").alias("n")).join(alone, "node", "left").select("node", "n", F.coalesce("u", F.lit(0)).alias("u"))
    sized, _ = keep(size, "sized")
    known = left.join(sized, "node")
    return known.join(known.groupBy("key").agg(F.min("n").alias("least")), "key").filter(
        F.lit(100) * (F.col("n") - F.col("u")) >= F.lit(percent) * (F.col("u") + F.col("least"))).select(*left.columns)


def odd_ones(left: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every comparison still to be made inside the buckets of ``left`` (key, node, root), as distinct (pivot, node) of spokes and of groups.

    Where at most one member in ``TILE`` stands outside the largest component of its bucket, each such one is a pivot for the members of other
    components. Other buckets are groups of which all pairs count; those with the same first member are one group.
    """
    roots = left.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    most, _ = keep(roots.groupBy("key").agg(F.max(F.struct("n", "root")).alias("big"), F.sum("n").alias("all")), "largest")
    few = (F.col("all") - F.col("big.n")) * TILE <= F.col("all")
    known = left.join(most.select("key", F.col("big.root").alias("big"), few.alias("few")), "key")
    odd = known.filter("few AND root <> big").select("key", F.col("node").alias("pivot"), F.col("root").alias("at"))
    pairs = known.filter("few").select("key", "node", "root").join(odd, "key").filter("root <> at").select("pivot", "node").distinct()
    dense = known.filter("NOT few").select("key", "node")
    return pairs, dense.join(dense.groupBy("key").agg(F.min("node").alias("pivot")), "key").select("pivot", "node").distinct()


def in_tiles(members: DataFrame) -> DataFrame:
    """(pivot, a, b, node) from distinct (pivot, node): members of a group, dealt to pairs of tiles a <= b."""
    tiles = F.ceil(F.count(F.lit(1)) / F.lit(TILE)).cast("int")
    sizes, _ = keep(members.groupBy("pivot").agg(tiles.alias("tiles")), "sizes")
    own = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    dealt = (members.join(sizes, "pivot").withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))))
    return dealt.select("pivot", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "node")


def linked(sets: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """For each set the smallest index it reaches over links with 100 * intersection >= percent * union."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.float64)
    if m == 2:
        both = np.array([[sizes[0], 0.0], [0.0, sizes[1]]])
        both[0, 1] = both[1, 0] = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
    else:
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(m), sizes.astype(np.int64))
        _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
        shared = count > 1  # a shingle of one set alone is in no intersection
        number = np.cumsum(shared) - 1
        use = shared[column]
        column, owner = number[column[use]], owner[use]
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        both = np.zeros((m, m))
        width = 8192
        for low in range(0, int(shared.sum()), width):
            i, j = np.searchsorted(column, (low, low + width))
            x = np.zeros((m, width), np.float32)
            x[owner[i:j], column[i:j] - low] = 1
            both += x @ x.T
    link = (100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)) & (sizes > 0)[:, None] & (sizes > 0)[None, :]
    np.fill_diagonal(link, True)
    label = np.arange(m)
    while True:
        new = np.where(link, label[None, :], m).min(axis=1)
        if (new == label).all():
            return label
        label = new


def confirm(grouped: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (u, v) that span the confirmed similarity graph inside each pair of tiles.

    ``grouped`` has pivot, a, b, node and shingles. Rows arrive sorted by group, so a task holds one pair of tiles at a time.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sets = None, {}

        def out() -> pa.RecordBatch | None:
            names, label = list(sets), linked(list(sets.values()), percent) if len(sets) > 1 else []
            pairs = [(names[i], names[k]) for i, k in enumerate(label) if i != k]
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())],
                                              ["u", "v"]) if pairs else None

        for batch in batches:
            for pivot, a, b, node, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if (pivot, a, b) != at:
                    if (done := out()) is not None:
                        yield done
                    at, sets = (pivot, a, b), {}
                sets[node] = np.frombuffer(raw, np.uint64)
        if (done := out()) is not None:
            yield done

    return (grouped.select("pivot", "a", "b", "node", "shingles").repartition("pivot", "a", "b").sortWithinPartitions("pivot", "a", "b")
            .mapInArrow(walk, "u long, v long"))


def joined(docs: DataFrame, nodes: DataFrame, percent: int = PERCENT) -> DataFrame | None:
    """(node, root) of every node that is linked with another one; None where there is none."""
    members, found = buckets(nodes), None
    sets, _ = keep(sets_of(docs, nodes, members.select("node").distinct()), "sets")

    def contract(new: DataFrame) -> DataFrame | None:
        more, _ = keep(new, "links-of-round")
        if more.isEmpty():
            return found
        known = more if found is None else more.union(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
        return keep(components(known), "components")[0]

    for k in range(ROUNDS):
        left, _ = keep(apart(members, found, central=k < CENTRAL), "apart")
        pairs, _ = keep(left.filter("root <> at").select("pivot", "node").distinct(), "pairs")
        if pairs.isEmpty():
            return found
        # the first round's groups grow with the documents; later ones are mostly small, and their measured size decides
        groups = spokes(pairs)
        found = contract(tied(sets.join(groups if k else groups.hint("merge"), "node"), percent))
        members = left.filter("node <> pivot").select("key", "node", "rank")
    left, _ = keep(apart(members, found, central=True), "apart")
    if left.isEmpty():
        return found
    left, _ = keep(apart(hopeful(sets, left.select("key", "node", "rank"), percent), found, central=True), "hopeful")
    pairs, dense = (keep(t, "rest")[0] for t in odd_ones(left))
    if not pairs.isEmpty():
        found = contract(tied(sets.join(spokes(pairs), "node"), percent))
    return found if dense.isEmpty() else contract(confirm(sets.join(in_tiles(dense), "node"), percent))


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node; the root is the smallest node of its component.

    Alternates large-star and small-star until nothing changes. Each round is a table in the shared folder.
    """
    spark = links.sparkSession
    edges, path = keep(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "links")
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    last = mark(edges)
    while last[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # a table of its own, so that the join can split a node with many neighbours
        least, old = keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least", 2 * last[0])
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            low.select("u", F.col("m").alias("v"))).distinct()
        edges, new = keep(small, "links", 2 * last[0])
        forget(spark, [path, old])
        now, path = mark(edges), new
        if now == last:
            break
        last = now
    if not last[0]:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())


def components_of(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, text_key, n_shingles, component_id, kept.

    Rows without words (null and empty texts too) have n_shingles 0 and are linked with nothing. Repeated rows share a set
    and so a component. ``component_id`` is the smallest doc_id of the component; ``kept`` is true where doc_id equals it
    (both null, where no row of the component has an id). Extra columns are left out; an empty table gives no rows.
    """
    rows, _ = keep(profiles(docs), "profiles")
    filled = rows.filter("n_shingles > 0")
    one = F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "text_key")).alias("one")
    grouped = filled.groupBy("set_id").agg(one, F.min("doc_id").alias("doc_id"), F.any_value("signature").alias("signature"))
    nodes, _ = keep(grouped.select(F.monotonically_increasing_id().alias("node"), "set_id", "one.id", "one.text_key", "doc_id", "signature"), "nodes", rows.count())
    found = joined(docs, nodes.select("node", "id", "text_key", "signature"), percent)
    ids = nodes.select("set_id", "node", "doc_id")
    root = F.col("node") if found is None else F.coalesce("root", "node")
    of_set = (ids if found is None else ids.join(found, "node", "left")).select("set_id", root.alias("root"), "doc_id")
    least, _ = keep(of_set.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least", rows.count())
    labels, _ = keep(of_set.join(least, "root").select("set_id", "component_id"), "labels", rows.count())
    named = filled.join(labels, "set_id").select("doc_id", "text_key", "n_shingles", "component_id")
    alone = rows.filter("n_shingles = 0").select("doc_id", "text_key", "n_shingles", F.col("doc_id").alias("component_id"))
    return named.union(alone).withColumn("kept", F.expr("doc_id <=> component_id"))


def drop_near(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component, that with the smallest doc_id; rows without words all stay."""
    key, number, void, stay = spare(docs, "text_key", "row_number", "void", "doc_key")
    chosen = components_of(docs, percent).filter("kept").select(
        F.col("doc_id").alias(stay), F.col("text_key").alias(key), (F.col("n_shingles") == 0).alias(void)).distinct()
    marked = docs.withColumn(key, text_key(F.col("text"))).withColumn(stay, F.col("doc_id").cast("long"))
    joined = marked.alias("d").join(chosen.alias("c"), F.expr(f"d.`{stay}` <=> c.`{stay}` AND d.`{key}` = c.`{key}`"))
    once = Window.partitionBy(f"d.{stay}", f"d.{key}").orderBy(f"d.{stay}")
    return joined.withColumn(number, F.row_number().over(once)).filter((F.col(number) == 1) | F.col(f"c.{void}")).select("d.*").drop(key, stay)
