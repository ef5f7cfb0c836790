"""Registry of queries, shared Spark inputs and shared SQL text of the oracles."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barwright.operators import factors, labels, sessions
from barwright.plans import xsec
from barwright.plans.staging import stage
from barwright.sources import bars as src

GAP_D, GAP_H = 4320.0, 180.0          # long break: three days, three hours
HORIZON = 3                           # label horizon in bars
YEAR, MONTH = 31536000, 2592000       # calendar buckets of daily and hourly bars
ROWS = 1024                           # bars per chunk: several chunks a symbol on these panels
COMPONENTS = ("p1", "p2", "p3")


class Tables:
    """The given tables of one folder and the panels derived from them.

    Panels are written once per session to the shared folder, like the panel files of a research
    run; every query then starts from a pruned Parquet scan.
    """

    _open: dict[tuple[str, str], "Tables"] = {}

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @classmethod
    def of(cls, spark: SparkSession, folder: str) -> "Tables":
        key = (spark.sparkContext.applicationId, str(folder))
        if key not in cls._open:
            cls._open[key] = cls(spark, str(folder))
        return cls._open[key]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def daily(self) -> DataFrame:
        return src.daily_bars(self.table("lineitem"))

    def hourly(self) -> DataFrame:
        return src.hourly_bars(self.table("events"))

    @cached_property
    def d(self) -> DataFrame:
        """Daily panel: bars, sessions, label."""
        p = sessions.add_sessions(stage(self.daily(), "bars_d"), GAP_D, YEAR)  # the raw table is read once
        return stage(labels.simple_label(p, HORIZON, ROWS), "panel_d")

    @cached_property
    def h(self) -> DataFrame:
        """Hourly panel: bars, sessions, label."""
        p = sessions.add_sessions(stage(self.hourly(), "bars_h"), GAP_H, MONTH)
        return stage(labels.simple_label(p, HORIZON, ROWS), "panel_h")

    @cached_property
    def g(self) -> xsec.Groups:
        """Measured cross-section size of the daily panel."""
        return xsec.measure(self.d, ["datetime"])

    @cached_property
    def gh(self) -> xsec.Groups:
        return xsec.measure(self.h, ["datetime"])

    @cached_property
    def dim(self) -> DataFrame:
        return src.symbol_dimension(self.d, known=11)

    @cached_property
    def preds(self) -> DataFrame:
        """Prediction frame: three factors used as component predictions, with sector and calendar."""
        f = factors.factor_panel(self.d, ["mom", "activity_z", "stoch"],
                                 windows=(5, 13), keep=("symbol", "datetime", "label", "session_id", "close"),
                                 rows=ROWS)
        f = f.select("symbol", "datetime", "label", "session_id", "close",
                     F.col("mom_5").alias("p1"), F.col("volz_13").alias("p2"),
                     (F.col("stoch_13") - F.lit(0.5)).alias("p3"))
        f = f.where(F.col("label").isNotNull() & F.col("p1").isNotNull() & F.col("p2").isNotNull()
                    & F.col("p3").isNotNull())
        f = src.enrich(f, self.dim, ["sector", "grp"])
        return stage(f.withColumn("month", F.date_format("datetime", "yyyy-MM")), "preds")


Query = Callable[[Tables], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


TRAIN = "datetime < TIMESTAMP '1999-01-01'"


def train_rows() -> Column:
    """Rows the fits may see."""
    return F.col("datetime") < F.lit("1999-01-01").cast("timestamp_ntz")


# ---- output of the Spark side -------------------------------------------------------------------
def rnd(c: str | Column, digits: int = 4) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def out(df: DataFrame, values: Sequence[str], keys: Sequence[str] = ("symbol", "dt"), digits: int = 4) -> DataFrame:
    if "dt" in keys and "dt" not in df.columns:
        df = df.withColumn("dt", F.date_format("datetime", "yyyy-MM-dd HH:mm"))
    kinds = dict(df.dtypes)
    cols = []
    for k in keys:
        cols.append(F.col(k).cast("long").alias(k) if kinds[k] in ("int", "smallint", "tinyint") else F.col(k))
    for v in values:
        if kinds[v] in ("double", "float") or kinds[v].startswith("decimal"):
            cols.append(rnd(v, digits).alias(v))
        elif kinds[v] in ("int", "smallint", "tinyint", "bigint"):
            cols.append(F.col(v).cast("long").alias(v))
        else:
            cols.append(F.col(v))
    return df.select(*cols)


# ---- SQL text shared by the oracles ---------------------------------------------------------------
def r(expr: str, name: str | None = None, digits: int = 4) -> str:
    return f"round(({expr})::DOUBLE, {digits}) + 0.0 AS {name or expr}"


def rs(names: Sequence[str], digits: int = 4) -> str:
    return ", ".join(r(n, None, digits) for n in names)


def i(expr: str, name: str | None = None) -> str:
    return f"({expr})::BIGINT AS {name or expr}"


KEY = "symbol, strftime(datetime, '%Y-%m-%d %H:%M') AS dt"

BARS_D = """bars AS (
  SELECT symbol, datetime, first(p ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, p) AS open,
         max(p) AS high, min(p) AS low,
         last(p ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, p) AS close,
         sum(l_quantity) AS volume, sum(l_extendedprice) AS amount, count(*)::DOUBLE AS oi
  FROM (SELECT *, 'S' || (l_suppkey % 12) AS symbol, l_shipdate AS datetime,
               l_extendedprice / l_quantity AS p FROM lineitem)
  GROUP BY symbol, datetime)"""

BARS_H = """bars AS (
  SELECT symbol, datetime, first(value ORDER BY ts, event_id, value) AS open, max(value) AS high,
         min(value) AS low, last(value ORDER BY ts, event_id, value) AS close, count(*)::DOUBLE AS volume,
         sum(value) AS amount, sum(json_extract_string(props, '$.k')::DOUBLE) AS oi
  FROM (SELECT *, 'U' || (user_id % 12) AS symbol, date_trunc('hour', ts) AS datetime FROM events)
  GROUP BY symbol, datetime)"""


def sessions_sql(gap: float, op: str = ">=") -> str:
    return f"""gaps AS (
  SELECT *, row_number() OVER s - 1 AS bar_no, count(*) OVER (PARTITION BY symbol) AS symbol_bars,
         coalesce(date_diff('second', lag(datetime) OVER s, datetime) / 60.0, 0.0) AS gap_min
  FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY datetime)),
flags AS (SELECT *, gap_min {op} {gap} AS is_long_break_before FROM gaps),
ids AS (SELECT *, (sum(is_long_break_before::INT) OVER (PARTITION BY symbol ORDER BY datetime))::BIGINT AS session_id
        FROM flags),
sess AS (
  SELECT *, row_number() OVER s - 1 AS session_pos,
         count(*) OVER (PARTITION BY symbol, session_id) - row_number() OVER s AS bars_to_next_long_break
  FROM ids WINDOW s AS (PARTITION BY symbol, session_id ORDER BY datetime))"""


def panel_sql(gap: float, h: int = HORIZON) -> str:
    return sessions_sql(gap) + f""",
panel AS (
  SELECT *, session_pos + (session_id = 0)::INT AS bss,
         CASE WHEN bars_to_next_long_break >= {h} AND close <> 0
              THEN lead(close, {h}) OVER (PARTITION BY symbol ORDER BY datetime) / close - 1 END AS label
  FROM sess)"""


SESS_D = BARS_D + ",\n" + sessions_sql(GAP_D)
SESS_H = BARS_H + ",\n" + sessions_sql(GAP_H)
PANEL_D = BARS_D + ",\n" + panel_sql(GAP_D)
PANEL_H = BARS_H + ",\n" + panel_sql(GAP_H)

BASE_D = PANEL_D + """,
b0 AS (SELECT *, lag(close) OVER s AS pc, (high + low + close) / 3.0 AS typ, greatest(high - low, 1e-9) AS hl,
              lag(oi) OVER s AS poi
       FROM panel WINDOW s AS (PARTITION BY symbol ORDER BY datetime)),
b1 AS (SELECT *, lag(typ) OVER (PARTITION BY symbol ORDER BY datetime) AS pt,
         CASE WHEN pc IS NULL OR is_long_break_before THEN 0.0 ELSE ln(close / pc) END AS lr,
         CASE WHEN poi IS NULL OR is_long_break_before THEN 0.0 ELSE ln(greatest(oi, 1) / greatest(poi, 1)) END AS dloi,
         ln(1 + volume) AS logv, ln(1 + amount) AS loga, ln(1 + greatest(oi, 1)) AS logoi,
         CASE WHEN close > pc THEN close - pc ELSE 0.0 END AS up, CASE WHEN close < pc THEN pc - close ELSE 0.0 END AS dn,
         CASE WHEN pc IS NULL THEN 0.0 ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr,
         (close - open) / hl AS bop, abs(close - open) / hl AS body, (high - greatest(open, close)) / hl AS upsh,
         (least(open, close) - low) / hl AS losh, (close - low) / hl AS cpos,
         CASE WHEN volume > 0 THEN amount / volume ELSE close END AS vwap
       FROM b0),
base AS (SELECT *, lag(lr, 1) OVER s AS lr1, lag(lr, 2) OVER s AS lr2, loga - logv AS turn,
                CASE WHEN typ > pt THEN typ * volume ELSE 0.0 END AS fu,
                CASE WHEN typ < pt THEN typ * volume ELSE 0.0 END AS fd
         FROM b1 WINDOW s AS (PARTITION BY symbol ORDER BY datetime))"""


def w_(k: int) -> str:
    return f"(PARTITION BY symbol ORDER BY datetime ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"


def m_(expr: str, w: int) -> str:
    """Session mask in SQL."""
    return f"CASE WHEN bss >= {w} THEN {expr} END"


def preds_cte() -> str:
    return BASE_D + f""",
pr0 AS (SELECT symbol, datetime, label, session_id, close,
          {m_(f"sum(lr) OVER {w_(5)}", 5)} AS p1,
          {m_(f"(logv - avg(logv) OVER {w_(13)}) / (stddev_samp(logv) OVER {w_(13)} + 1e-9)", 13)} AS p2,
          {m_(f"(close - min(low) OVER {w_(13)}) / (max(high) OVER {w_(13)} - min(low) OVER {w_(13)} + 1e-9) - 0.5", 13)} AS p3
        FROM base),
preds AS (SELECT *, strftime(datetime, '%Y-%m') AS month,
            CASE WHEN symbol = 'S11' THEN 'unknown' ELSE 'sector' || (substr(symbol, 2)::INT % 4) END AS sector,
            CASE WHEN symbol = 'S11' THEN 'unknown' ELSE 'g' || (substr(symbol, 2)::INT % 3) END AS grp
          FROM pr0 WHERE label IS NOT NULL AND p1 IS NOT NULL AND p2 IS NOT NULL AND p3 IS NOT NULL)"""


PREDS = preds_cte()


def avg_rank(x: str, part: str) -> str:
    """Average-tie rank among non-null values."""
    return (f"CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY {part} ORDER BY {x} ASC NULLS LAST) "
            f"+ (count(*) OVER (PARTITION BY {part}, {x}) - 1) / 2.0 END")


def pct_rank(x: str, part: str) -> str:
    return f"({avg_rank(x, part)}) / nullif(count({x}) OVER (PARTITION BY {part}), 0)"


def z_sql(x: str, part: str, eps: str = "1e-8") -> str:
    return (f"({x} - avg({x}) OVER (PARTITION BY {part})) / "
            f"(stddev_samp({x}) OVER (PARTITION BY {part}) + {eps})")


def clip_sql(x: str, b: float) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN least(greatest({x}, -{b}), {b}) END"


def probit_sql(p: str) -> str:
    """Acklam's approximation written out once more for the oracle."""
    a = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02, 1.383577518672690e+02,
         -3.066479806614716e+01, 2.506628277459239e+00]
    b = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02, 6.680131188771972e+01,
         -1.328068155288572e+01]
    c = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00, -2.549732539343734e+00,
         4.374664141464968e+00, 2.938163982698783e+00]
    d = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00]

    def poly(co: list[float], x: str) -> str:
        s = repr(co[0])
        for v in co[1:]:
            s = f"({s} * {x} + {v!r})"
        return s.replace("+ -", "- ")

    def tail(q: str) -> str:
        return f"{poly(c, q)} / {poly(d + [1.0], q)}"

    lo, hi, mid = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - ({p})))", f"(({p}) - 0.5)"
    return (f"CASE WHEN ({p}) < 0.02425 THEN {tail(lo)} WHEN ({p}) > 0.97575 THEN -({tail(hi)}) "
            f"ELSE {poly(a, f'({mid} * {mid})')} * {mid} / {poly(b + [1.0], f'({mid} * {mid})')} END")


def uniform_sql(seed: int, *keys: str) -> str:
    text = " || '|' || ".join(f"({k})::VARCHAR" for k in keys)
    return f"(('0x' || substr(md5({text} || '|{seed}'), 1, 13))::BIGINT / 4503599627370496.0)"


def ic_sql(a: str, y: str) -> str:
    return (f"sum({a} * {y}) / nullif(sqrt(sum({a} * {a}) FILTER (WHERE {y} IS NOT NULL) "
            f"* sum({y} * {y}) FILTER (WHERE {a} IS NOT NULL)), 0)")
