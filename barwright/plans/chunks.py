"""Moving windows over bounded pieces of a symbol.

``bar_no`` cuts each symbol into pieces of ``rows`` bars. The bars just before (and after) a piece
are copied into it, so every bounded frame of a bar lies inside the bar's own piece and results are
exact. One shuffle on (symbol, piece); a symbol that holds a third of all bars is spread like any
other. Copied bars are dropped at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec, functions as F

CHUNK_ROWS = 16384
CHUNK_KEYS = ("symbol", "_chunk")


def open_chunks(df: DataFrame, before: int, after: int = 0, rows: int = CHUNK_ROWS) -> DataFrame:
    rows = max(rows, before, after)
    own = F.expr(f"bar_no div {rows}")
    places = [F.struct(own.alias("_chunk"), F.lit(True).alias("_own"))]
    if before:
        places.append(F.when(F.col("bar_no") % rows >= rows - before,
                             F.struct((own + 1).alias("_chunk"), F.lit(False).alias("_own"))))
    if after:
        places.append(F.when((F.col("bar_no") % rows < after) & (own > 0),
                             F.struct((own - 1).alias("_chunk"), F.lit(False).alias("_own"))))
    if len(places) == 1:
        return df.withColumn("_chunk", own).withColumn("_own", F.lit(True))
    return (df.withColumn("_place", F.explode(F.filter(F.array(*places), lambda p: p.isNotNull())))
            .withColumns({"_chunk": F.col("_place._chunk"), "_own": F.col("_place._own")})
            .drop("_place"))


def bars(session: bool = False) -> WindowSpec:
    """All bars of a piece in time order (of one session if asked); all frames derive from it."""
    keys = (*CHUNK_KEYS, "session_id") if session else CHUNK_KEYS
    return Window.partitionBy(*keys).orderBy("bar_no")


def trailing(k: int) -> WindowSpec:
    return bars().rowsBetween(-(k - 1), 0)


def prior(k: int) -> WindowSpec:
    return bars().rowsBetween(-k, -1)


def ahead(h: int) -> WindowSpec:
    return bars().rowsBetween(1, h)


def close_chunks(df: DataFrame) -> DataFrame:
    return df.where("_own").drop("_chunk", "_own")
