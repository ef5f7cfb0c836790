"""Merkle manifest of a dataset: every row a leaf, a tree per source, a tree over the sources.

A node is the SHA-256, in hex text, of its up to ``WAYS`` children one after the other. Leaves of a source are numbered in the order of their
ids and cut into aligned blocks of WAYS ** DEPTH. A block keeps each of its levels as one string of 64 hex digits a node: a parent is the hash of
a fixed-width substring, and the siblings of a node are the two substrings that flank it in its run. Block roots are the leaves of the next
round, until a source has one root; the roots of the sources then form a tree in the same way. Going down again, each block hands its own path to
its nodes. Only DataFrame functions; a block holds at most WAYS ** DEPTH nodes, whatever the size of its source.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from barwright.llm.shared import forget, keep

WAYS, DEPTH, HEX = 3, 6, 64
BLOCK = WAYS ** DEPTH
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf(values: Mapping[str, Column] | None = None) -> Column:
    """The leaf of a document: each field as UTF-8 byte count, colon and value, or ``-`` if null. ``values`` replace columns."""
    parts = []
    for name in FIELDS:
        v = ((values or {}).get(name, F.col(name))).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")))
    return digest(F.concat(*parts))


def _order(columns: list[str]) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in columns]


def numbered(nodes: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``nodes`` with ``at``, the place of each row in its group from 0, and ``total``, the rows of the group.

    Rows are dealt by ranges of the whole order, so a large group lies in many partitions; what a partition must know of those before it
    is one count a group.
    """
    by = _order([group, *order])
    row = F.monotonically_increasing_id()
    dealt, _ = keep(nodes.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("row", row), "ordered")
    part, first = F.shiftrightunsigned("row", 33).alias("part"), F.min("row").alias("first")
    counts = dealt.groupBy(group, part).agg(first, F.count(F.lit(1)).alias("rows"))
    whole = Window.partitionBy(group)
    before = F.sum("rows").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts, _ = keep(counts.withColumn("before", F.coalesce(before, F.lit(0))).withColumn("total", F.sum("rows").over(whole)).drop("rows"), "starts")
    joined = dealt.alias("d").join(starts.alias("s"), F.expr(f"d.`{group}` <=> s.`{group}` AND shiftrightunsigned(d.row, 33) = s.part"))
    return joined.select("d.*", F.expr("s.before + d.row - s.first").alias("at"), "s.total").drop("row")


def _parents(level: Column) -> Column:
    """The level above: a hash of each run of nodes. Levels are binary, where a substring costs its own length."""
    width = HEX * WAYS
    runs = F.sequence(F.lit(0), F.floor((F.octet_length(level) - 1) / width).cast("int"))
    return F.array_join(F.transform(runs, lambda k: F.sha2(F.substring(level, k * width + 1, F.lit(width)), 256)), "").cast("binary")


def blocks(nodes: DataFrame) -> DataFrame:
    """(grp, block, total, items, levels, top) from (grp, at, total, node, item): one row for each aligned block.

    ``levels`` holds the strings from the nodes up to the block's root, ``top``. A source of one block ends where one node is left;
    in any other every block has DEPTH levels, also a last one with few nodes.
    """
    inside = F.struct((F.col("at") % BLOCK).cast("int").alias("at"), "node", "item")
    cut = nodes.groupBy("grp", F.floor(F.col("at") / BLOCK).cast("long").alias("block"), "total").agg(F.array_sort(F.collect_list(inside)).alias("inside"))
    powers = F.array(*(F.lit(WAYS ** k) for k in range(DEPTH)))
    levels = F.aggregate(F.filter(powers, lambda p: F.col("total") > p), F.array(F.array_join("inside.node", "").cast("binary")),
                         lambda done, _: F.concat(done, F.array(_parents(F.element_at(done, -1)))))
    return (cut.withColumn("levels", levels)
            .select("grp", "block", "total", F.col("inside.item").alias("items"), "levels", F.element_at("levels", -1).cast("string").alias("top")))


def _siblings(at: Column, levels: Column) -> Column:
    """For each level below the root of a block: what stands before and after the node in its run."""
    def flanks(level: Column, k: Column) -> Column:
        own = F.floor(at / F.element_at(F.array(*(F.lit(WAYS ** j) for j in range(DEPTH))), k + 1)).cast("int")
        start = own - own % WAYS
        return F.struct(F.substring(level, start * HEX + 1, (own - start) * HEX).cast("string").alias("left"),
                        F.substring(level, (own + 1) * HEX + 1, (WAYS - 1 - own % WAYS) * HEX).cast("string").alias("right"))
    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), flanks)


def _down(level: DataFrame) -> DataFrame:
    """(grp, block, item, path, *) of each node of a round: its siblings inside the block, then the block's own."""
    own = F.transform("items", lambda item, k: F.struct(item.alias("item"), F.concat(_siblings(k, F.col("levels")), F.col("up")).alias("path")))
    more = [c for c in ("subroot", "root") if c in level.columns]
    return level.select("grp", "block", F.explode(own).alias("n"), *more).select("grp", "block", "n.item", "n.path", *more)


def _rounds(nodes: DataFrame, name: str) -> list[DataFrame]:
    """Tables of blocks, from the nodes up to the round in which every group has one block."""
    tables = []
    while True:
        table, _ = keep(blocks(nodes), f"{name}-{len(tables)}")
        tables.append(table)
        if table.filter("block > 0").isEmpty():
            return tables
        above = F.ceil(F.col("total") / BLOCK).cast("long")
        nodes = table.select("grp", F.col("block").alias("at"), above.alias("total"), F.col("top").alias("node"), F.col("block").alias("item"))


def _paths(tables: list[DataFrame], last: DataFrame) -> DataFrame:
    """Paths of the nodes of the first table; ``last`` is the last one with ``up``, the path of its root."""
    for below in reversed(tables[:-1]):
        up = _down(last).drop("block").withColumnRenamed("item", "block").withColumnRenamed("path", "up")
        keys = F.expr("b.grp <=> u.grp AND b.block = u.block")
        last = below.alias("b").join(up.alias("u"), keys).select("b.*", *(f"u.{c}" for c in up.columns if c not in ("grp", "block")))
    return _down(last)


def manifest(docs: DataFrame, carry: Mapping[str, Column] | None = None) -> DataFrame:
    """Per row: doc_id, source, leaf, subroot, root, path, and the columns of ``carry``, computed from ``docs``.

    ``path`` lists for each level the siblings before (left) and after (right) the node, as hex text, from the leaf to the root. A level whose
    run has one node has an empty pair: the node is hashed once more. A null source is a source, the first; within one, a null doc_id
    comes first, and rows that share an id stand by their leaf. Rows equal in all fields are leaves of their own, and their paths, in no set
    order, go to these rows. Extra columns are left out; an empty table gives no rows.
    """
    carried = dict(carry or {})
    leaves, scratch = keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("grp"), leaf().alias("node"),
                                       F.monotonically_increasing_id().alias("tie"), *(v.alias(f"carry_{k}") for k, v in carried.items())), "leaves")
    placed = numbered(leaves, "grp", ["doc_id", "node", "tie"])
    tree = _rounds(placed.select("grp", "at", "total", "node", F.struct("doc_id", F.col("node").alias("leaf"), *(f"carry_{k}" for k in carried)).alias("item")), "tree")
    forget(docs.sparkSession, [scratch])
    sources = tree[-1].select(F.lit(0).alias("all"), F.col("grp").alias("source"), F.col("top").alias("node"))
    over = numbered(sources, "all", ["source"]).select(F.col("all").alias("grp"), "at", "total", "node", F.struct("source", F.col("node").alias("subroot")).alias("item"))
    top = _rounds(over, "sources")
    root = top[-1].withColumn("up", F.expr("cast(array() AS array<struct<left: string, right: string>>)")).withColumn("root", F.col("top"))
    up, _ = keep(_paths(top, root).select(F.col("item.source").alias("source"), F.col("item.subroot").alias("subroot"), "root", F.col("path").alias("up")), "roots")
    last = tree[-1].alias("t").join(up.alias("u"), F.expr("t.grp <=> u.source")).select("t.*", "u.up", "u.subroot", "u.root")
    done = _paths(tree, last)
    return done.select("item.doc_id", F.col("grp").alias("source"), "item.leaf", "subroot", "root", "path", *(F.col(f"item.carry_{k}").alias(k) for k in carried))


def proof(path: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def fold(node: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path lead to."""
    return F.aggregate(path, node, lambda at, s: digest(F.concat(s["left"], at, s["right"])))


def audit(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Of documents with an even CRC-32 of their decimal id a copy without line feeds is checked against the path of the stored leaf; others, and
    those without an id, are checked as they are. A copy that says the same (no line feed, null text) verifies.
    """
    tampered = F.when(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 2 == 0,
                      leaf({"text": F.regexp_replace("text", "\n", "")})).otherwise(leaf())
    made = manifest(docs, {"checked": tampered})
    out = made.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), fold(F.col("checked"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _leaf_sql(text: str) -> str:
    part = lambda v: f"coalesce(strlen({v}::VARCHAR)::VARCHAR || ':' || {v}::VARCHAR, '-')"
    return f"sha256({' || '.join(part(v) for v in ('doc_id', 'source', 'lang', 'n_chars', text))})"


def _tree_sql(name: str, rows: str) -> str:
    """Levels of the trees of ``rows`` (grp, pos, node, total) and the flanks of each node, as tables ``name`` and ``name``_side."""
    run = "PARTITION BY grp, level, pos // 3 ORDER BY pos"
    return f"""{name} AS (SELECT grp, 0 AS level, pos, node, total FROM {rows} UNION ALL
    SELECT grp, level + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), (total + 2) // 3 FROM {name} WHERE total > 1 GROUP BY grp, level, pos // 3, total),
  {name}_side AS (SELECT grp, level, pos, {{'l': coalesce(lag(node, 2) OVER w, '') || coalesce(lag(node, 1) OVER w, ''),
    'r': coalesce(lead(node, 1) OVER w, '') || coalesce(lead(node, 2) OVER w, '')}} AS side FROM {name} WHERE total > 1 WINDOW w AS ({run})),
  {name}_path AS (SELECT r.grp, r.pos, coalesce(list(side ORDER BY level) FILTER (side IS NOT NULL), []) AS path FROM {rows} r LEFT JOIN {name}_side s
    ON r.grp IS NOT DISTINCT FROM s.grp AND s.pos = r.pos // power(3, level)::BIGINT GROUP BY r.grp, r.pos)"""


CRC = ("""xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda c, b: """
       """list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))""")

ORACLE = f"""WITH RECURSIVE f AS (SELECT doc_id, source AS grp, {_leaf_sql('text')} AS node,
    CASE WHEN doc_id IS NOT NULL AND {CRC} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql('text')} END AS checked FROM documents),
  n AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, node) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS total FROM f),
  {_tree_sql('t', 'n')},
  s AS (SELECT 0 AS grp, grp AS source, node, row_number() OVER (ORDER BY grp NULLS FIRST) - 1 AS pos, count(*) OVER () AS total FROM t WHERE total = 1),
  {_tree_sql('u', 's')},
  p AS (SELECT n.doc_id, n.node AS leaf, n.checked, s.node AS subroot, (SELECT node FROM u WHERE total = 1) AS root, list_concat(t_path.path, u_path.path) AS path
    FROM n JOIN t_path ON n.grp IS NOT DISTINCT FROM t_path.grp AND n.pos = t_path.pos JOIN s ON n.grp IS NOT DISTINCT FROM s.source JOIN u_path ON u_path.pos = s.pos),
  d AS (SELECT *, list_reduce(list_prepend({{'l': checked, 'r': ''}}, path), lambda x, y: {{'l': sha256(y.l || x.l || y.r), 'r': ''}}).l AS folded_root FROM p)
  SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(path, lambda x: x.l || x.r), ''), '')) AS proof_sha256, folded_root,
    folded_root = root AS verified FROM d"""
