"""Staged construction of rolling statistics.

Requests are collected first and then planned together, so that any number of windows over one
chunked frame costs a single shuffle and a single sort:

* sums, means, deviations and correlations come from one running sum per input and a lag per
  window length (constant work per bar instead of one update per bar of the window);
* long minima and maxima are built by doubling: the extreme over 2k bars is the extreme of two
  neighbouring k-bar extremes;
* exponential averages are built by the same doubling with weights, over as many bars as change a
  double.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, Window, functions as F

from barwright.plans import chunks

DIRECT_EXTREME = 32
EWM_TAIL = 40.0
ULP = 2.0 ** -52


def _once(method: Callable) -> Callable:
    """Build a requested expression once per stage: families share most of their statistics."""

    @wraps(method)
    def cached(self, *args):
        key = (method.__name__, *args)
        if key not in self._built:
            self._built[key] = method(self, *args)
        return self._built[key]

    return cached


def ewm_bars(span: int) -> int:
    """Bars after which the weight of an exponential average is below exp(-40)."""
    return int(math.ceil(EWM_TAIL * (span + 1) / 2.0))


class Rolling:
    """``session=True`` keeps every frame inside the bar's session."""

    def __init__(self, df: DataFrame, lookback: int, lookahead: int = 0, rows: int = chunks.CHUNK_ROWS,
                 session: bool = False):
        self.df = chunks.open_chunks(df, lookback, lookahead, rows)
        self.win = chunks.bars(session)
        self._reset()

    def _reset(self) -> None:
        self._built: dict[tuple, object] = {}
        self._terms: dict[str, Column] = {}
        self._lags: dict[str, tuple[str, int]] = {}
        self._pyramids: dict[tuple[str, str], int] = {}
        self._ewms: dict[tuple[str, int], str] = {}
        self._centred: dict[str, str] = {}

    # ---- columns -------------------------------------------------------------------------
    def define(self, **cols: Column) -> "Rolling":
        """Add plain columns, evaluated before the rolling statistics requested next."""
        self.df = self.df.withColumns(cols)
        return self

    def lag(self, x: str, k: int = 1) -> Column:
        return F.lag(x, k).over(self.win)

    @_once
    def prev(self, x: str, k: int = 1) -> Column:
        return F.lag(x, k).over(self.win)

    # ---- running-sum statistics ----------------------------------------------------------
    def _run(self, name: str, term: Callable[[], Column], w: int, shift: int = 0) -> Column:
        """Sum of ``term`` over the ``w`` bars that end ``shift`` bars ago."""
        total = f"__s_{name}"
        if total not in self._terms:
            self._terms[total] = term()
        back = f"{total}__{w + shift}"
        self._lags[back] = (total, w + shift)
        top = F.col(total)
        if shift:
            self._lags[f"{total}__{shift}"] = (total, shift)
            top = F.coalesce(F.col(f"{total}__{shift}"), F.lit(0.0))
        return top - F.coalesce(F.col(back), F.lit(0.0))

    @_once
    def sum(self, x: str, w: int, shift: int = 0) -> Column:
        return self._run(x, lambda: F.coalesce(F.col(x).cast("double"), F.lit(0.0)), w, shift)

    @_once
    def count(self, x: str, w: int, shift: int = 0) -> Column:
        return self._run(f"n_{x}", lambda: F.col(x).isNotNull().cast("double"), w, shift)

    @_once
    def stats(self, x: str, w: int, shift: int = 0) -> tuple[Column, Column, Column]:
        """Count, mean and population variance of the non-null values."""
        c = self._centre(x)
        n = self.count(x, w, shift)
        s1 = self.sum(c, w, shift)
        s2 = self._run(f"{c}_x_{c}", lambda: F.coalesce(F.col(c) * F.col(c), F.lit(0.0)), w, shift)
        m = F.try_divide(s1, n)
        var = F.greatest(F.try_divide(s2, n) - m * m, F.lit(0.0))
        return n, m + F.col(f"__f_{x}"), var

    @_once
    def covariance(self, x: str, y: str, w: int) -> Column:
        """Population covariance over bars that have both values (no value may be missing)."""
        a, b = self._centre(x), self._centre(y)
        n = self.count(x, w)
        ab = self._run(f"{a}_x_{b}", lambda: F.coalesce(F.col(a) * F.col(b), F.lit(0.0)), w)
        return F.try_divide(ab, n) - F.try_divide(self.sum(a, w), n) * F.try_divide(self.sum(b, w), n)

    @_once
    def mean(self, x: str, w: int, nullable: bool = False) -> Column:
        n = self.count(x, w) if nullable else F.lit(float(w))
        return F.try_divide(self.sum(x, w), n)

    def _centre(self, x: str) -> str:
        """Shift by the first value of the piece: keeps squared sums free of cancellation."""
        self._centred[x] = f"__c_{x}"
        return self._centred[x]

    def _moment(self, x: str, y: str, w: int) -> Column:
        return self._run(f"{x}_x_{y}", lambda: F.coalesce(F.col(x) * F.col(y), F.lit(0.0)), w)

    @_once
    def std(self, x: str, w: int, ddof: int = 1, nullable: bool = False) -> Column:
        n = self.count(x, w) if nullable else F.lit(float(w))
        c = self._centre(x)
        s1, s2 = self.sum(c, w), self._moment(c, c, w)
        var = F.try_divide(s2 - F.try_divide(s1 * s1, n), n - F.lit(float(ddof)))
        floor = F.lit(1e-13) * (F.try_divide(s2, n) + F.lit(1e-12))
        return F.when(var.isNotNull(), F.when(var > floor, F.sqrt(F.greatest(var, F.lit(0.0))))
                      .otherwise(F.lit(0.0)))

    @_once
    def power_sums(self, x: str, w: int) -> tuple[Column, Column, Column, Column]:
        v = F.col(x)
        return (self.sum(x, w),
                self._run(f"{x}_p2", lambda: v * v, w),
                self._run(f"{x}_p3", lambda: v * v * v, w),
                self._run(f"{x}_p4", lambda: v * v * v * v, w))

    @_once
    def corr(self, x: str, y: str, w: int, min_pairs: int | None = None) -> Column:
        """Correlation over the pairs that have both values; NULL where a sum of squares is within the rounding error of its running sums."""
        a, b = self._centre(x), self._centre(y)
        both = F.col(x).isNotNull() & F.col(y).isNotNull()
        tag = f"{x}_and_{y}"
        n = self._run(f"n_{tag}", lambda: both.cast("double"), w)

        def s(name: str, term: Callable[[], Column]) -> Column:
            return self._run(f"{tag}_{name}", lambda: F.when(both, term()).otherwise(F.lit(0.0)), w)

        sa, sb = s("a", lambda: F.col(a)), s("b", lambda: F.col(b))
        saa, sbb = s("aa", lambda: F.col(a) * F.col(a)), s("bb", lambda: F.col(b) * F.col(b))
        sab = s("ab", lambda: F.col(a) * F.col(b))
        va, vb = saa - F.try_divide(sa * sa, n), sbb - F.try_divide(sb * sb, n)
        cov = sab - F.try_divide(sa * sb, n)

        def rounding(name: str, frame: Column) -> Column:
            # each of the w additions rounds by half an ulp of the running sum
            top = F.col(f"__s_{tag}_{name}")
            return F.lit(4.0 * w * ULP) * (F.col(f"__s_{tag}_{name * 2}") + F.abs(F.try_divide(frame, n)) * (F.abs(top) + F.abs(top - frame)))

        ok = (n >= F.lit(float(min_pairs if min_pairs else w))) & (va > rounding("a", sa)) & (vb > rounding("b", sb))
        return F.try_divide(cov, F.when(ok, F.sqrt(va * vb)))

    # ---- extremes ------------------------------------------------------------------------
    def _extreme(self, kind: str, x: str, w: int) -> Column:
        if w <= DIRECT_EXTREME:
            fn = F.max if kind == "max" else F.min
            name = f"__{kind}_{x}__{w}"
            self._terms[name + "!"] = fn(x).over(self.win.rowsBetween(-(w - 1), 0))
            return F.col(name)
        level = int(math.floor(math.log2(w)))
        key = (kind, x)
        self._pyramids[key] = max(self._pyramids.get(key, 0), level)
        base, rest = f"__{kind}_{x}_p{level}", w - (1 << level)
        pick = F.greatest if kind == "max" else F.least
        if not rest:
            return F.col(base)
        back = f"{base}__{rest}"
        self._lags[back] = (base, rest)
        return pick(F.col(base), F.col(back))

    @_once
    def max(self, x: str, w: int) -> Column:
        return self._extreme("max", x, w)

    @_once
    def min(self, x: str, w: int) -> Column:
        return self._extreme("min", x, w)

    # ---- exponential average -------------------------------------------------------------
    @_once
    def ewm(self, x: str, span: int) -> Column:
        """Recursive average seeded with the symbol's first value (no weight adjustment).

        The frame must have been opened with ``lookback >= ewm_bars(span)``.
        """
        name = f"__ewm_{x}_{span}"
        self._ewms[(x, span)] = name
        decay = 1.0 - 2.0 / (span + 1.0)
        seed = F.when((F.col("__first_bar") == 0) & (F.col("bar_no") <= ewm_bars(span)),
                      F.pow(F.lit(decay), F.col("bar_no")) * F.lit(decay) * F.col(f"__first_{x}"))
        return F.col(name) + F.coalesce(seed, F.lit(0.0))

    # ---- planning ------------------------------------------------------------------------
    def _plan(self) -> None:
        df, run = self.df, self.win.rowsBetween(Window.unboundedPreceding, 0)
        firsts: dict[str, Column] = {}
        for x in self._centred:
            firsts[f"__f_{x}"] = F.first(x, ignorenulls=True).over(run)
        for x, _ in self._ewms:
            firsts[f"__first_{x}"] = F.first(x).over(run)
            firsts["__first_bar"] = F.first("bar_no").over(run)
        if firsts:
            df = df.withColumns(firsts)
        if self._centred:
            # running first value: constant from the first known value of the piece on
            df = df.withColumns({c: F.col(x) - F.col(f"__f_{x}") for x, c in self._centred.items()})
        direct = {k[:-1]: v for k, v in self._terms.items() if k.endswith("!")}
        sums = {k: F.sum(v).over(run) for k, v in self._terms.items() if not k.endswith("!")}
        if direct or sums:
            df = df.withColumns({**direct, **sums})
        if self._pyramids:
            for level in range(max(self._pyramids.values()) + 1):
                step: dict[str, Column] = {}
                for (kind, x), top in self._pyramids.items():
                    if level > top:
                        continue
                    if level == 0:
                        step[f"__{kind}_{x}_p0"] = F.col(x)
                        continue
                    below = f"__{kind}_{x}_p{level - 1}"
                    pick = F.greatest if kind == "max" else F.least
                    step[f"__{kind}_{x}_p{level}"] = pick(
                        F.col(below), F.lag(below, 1 << (level - 1)).over(self.win))
                df = df.withColumns(step)
        if self._ewms:
            df = df.withColumns({n: F.lit(2.0 / (s + 1.0)) * F.col(x) for (x, s), n in self._ewms.items()})
            need = {n: ewm_bars(s) for (x, s), n in self._ewms.items()}
            span_of = {n: s for (x, s), n in self._ewms.items()}
            width = 1
            while any(width < bars for bars in need.values()):
                df = df.withColumns({
                    n: F.col(n) + F.lit((1.0 - 2.0 / (span_of[n] + 1.0)) ** width)
                    * F.coalesce(F.lag(n, width).over(self.win), F.lit(0.0))
                    for n, bars in need.items() if width < bars})
                width *= 2
        if self._lags:
            df = df.withColumns({n: F.lag(c, k).over(self.win) for n, (c, k) in self._lags.items()})
        self.df = df

    def emit(self, **cols: Column) -> "Rolling":
        """Evaluate the pending statistics, add ``cols`` and drop the helper columns."""
        return self.emit_all(cols)

    def emit_all(self, cols: dict[str, Column]) -> "Rolling":
        keep = [c for c in self.df.columns if c not in cols]
        self._plan()
        self.df = self.df.select(*keep, *[c.alias(n) for n, c in cols.items()])
        self._reset()
        return self

    def close(self) -> DataFrame:
        return chunks.close_chunks(self.df)
