"""The factor build as one flow: screen, views within budgets, screen of the views, decorrelation of all, month sink."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, functions as F

from barwright.operators import factors, views
from barwright.plans import blocks
from barwright.plans.blocks import Block
from barwright.plans.staging import stage
from barwright.plans.xsec import Groups
from barwright.sources import bars

c_ = F.col


def vocabulary_report(panel: DataFrame, rows: int, keep: Sequence[str] = ("symbol", "datetime")) -> DataFrame:
    """factor, n, mean, sd of every column of the vocabulary; one aggregate per group of families."""
    out: DataFrame | None = None
    for frame in factors.factor_groups(panel, keep, rows):
        names = [c for c in frame.columns if c not in keep]
        # one array of structs a statistic keeps the aggregate flat: three sums a column
        wide = frame.agg(*[f(n).alias(f"{p}_{n}") for n in names for p, f in (("n", F.count), ("m", F.avg), ("s", F.stddev_pop))])
        part = wide.select(F.inline(F.array(*[F.struct(F.lit(n).alias("factor"), c_(f"n_{n}").alias("n"), c_(f"m_{n}").alias("mean"),
                                                       c_(f"s_{n}").alias("sd")) for n in names])))
        part = stage(part, "vocabulary")  # some dozen rows; keeps the plans of the groups apart
        out = part if out is None else out.unionByName(part)
    return out


VIEW_COLUMNS = 40
BUDGETS = {"tsz_": 300, "csz_": 900, "csr_": 900}


def view_blocks(raw: Sequence[Block], names: set[str], view: str, g: Groups, meta: Sequence[str], rows: int, keep: Sequence[str]) -> list[Block]:
    """One view of the named columns, in blocks of at most VIEW_COLUMNS."""
    out = []
    for block in raw:
        mine = [n for n in block.names if n in names]
        for low in range(0, len(mine), VIEW_COLUMNS):
            cols = mine[low:low + VIEW_COLUMNS]
            frame = block.columns(cols, meta)
            if view == "tsz_":
                frame = views.tsz(frame, cols, **({"rows": rows} if rows else {}))
            else:
                frame = (views.csz if view == "csz_" else views.csr)(frame, g, cols)
            out.append(blocks.block_of(frame, [view + c for c in cols], keep, view + "block"))
    return out


def decorrelate(order: Sequence[int], edges: Iterable[tuple[int, int]]) -> list[int]:
    """Walk the columns in ``order``; one is kept if no kept one is joined to it by an edge."""
    near: dict[int, set[int]] = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    kept: dict[int, None] = {}
    for j in order:
        if not near.get(j, set()) & kept.keys():
            kept[j] = None
    return list(kept)


def factor_build(groups: Iterable[DataFrame], g: Groups, path: str, budgets: dict[str, int] | None = None,
                 meta: Sequence[str] = ("symbol", "datetime", "label", "bar_no", "session_id"), limit: float = 0.9, min_coverage: float = 0.3,
                 min_ic: float = 1e-4, rows: int = 0, y: str = "label") -> DataFrame:
    """Build the selected factors into a month-partitioned table at ``path``; the table of those: name, place, ic, coverage.

    ``groups`` are frames of ``meta`` and some raw columns each. All raw columns are screened by coverage; those with the largest |IC| get views
    (``budgets``: view -> how many), and the views are screened as well. Then raw columns and views stand in one order of |IC|, and one is kept if
    its |corr| with every kept one is below ``limit``. Columns with an |IC| below ``min_ic`` are left out. Scores and pairs of columns above
    the limit reach the driver, rows do not.
    """
    keys, keep = meta[:2], [*meta[:2], y]
    raw = [blocks.block_of(f, [c for c in f.columns if c not in meta], meta) for f in groups]
    scored = [(b, [s for s in blocks.column_scores(b, y) if s.coverage >= min_coverage]) for b in raw]
    best = [s.name for s in sorted((s for _, t in scored for s in t), key=lambda s: -abs(s.ic))]
    for view, n in (BUDGETS if budgets is None else budgets).items():
        for b in view_blocks(raw, set(best[:n]), view, g, meta, rows, keep):
            scored.append((b, [s for s in blocks.column_scores(b, y) if s.coverage >= min_coverage]))
    chosen = [[s for s in t if abs(s.ic) >= min_ic] for _, t in scored]
    flat = [s for t in chosen for s in t]
    if not flat:
        raise ValueError("no column passes the screen")
    edges = blocks.correlated([b for b, _ in scored], chosen, keys, y, limit, max(s.n for s in flat))
    order = sorted(range(len(flat)), key=lambda j: -abs(flat[j].ic))
    kept = decorrelate(order, ((r.a, r.b) for r in edges.collect()))  # pairs of columns
    names = {flat[j].name for j in kept}
    table = blocks.together([b for b, _ in scored], [[s.name for s in t if s.name in names] for t in chosen], keys)
    bars.materialise_panel(table.select(*keys, *[views.bounded(n).alias(n) for n in table.columns if n not in keys]), path)
    rows_ = [(flat[j].name, k + 1, float(flat[j].ic), float(flat[j].coverage)) for k, j in enumerate(kept)]
    return raw[0].df.sparkSession.createDataFrame(rows_, "name string, place long, ic double, coverage double")
