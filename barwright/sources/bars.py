"""Bar sources and sinks: CSV files, Parquet panels, and bars resampled from raw tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

VALUES = ("open", "high", "low", "close", "volume", "amount", "oi")
OI_ALIASES = ("open interest", "openinterest", "open_interest")
# Index and bond futures that are never part of the universe.
EXCLUDED = ("T", "TF", "TS", "IF", "IC", "IH")
UNKNOWN = "unknown"


def discover_symbols(bars: DataFrame, excluded: Sequence[str] = EXCLUDED, only: Sequence[str] | None = None,
                     cap: int | None = None) -> DataFrame:
    """Distinct symbols in order, without the excluded ones, optionally restricted and capped."""
    names = bars.select(F.upper("symbol").alias("symbol")).distinct()
    names = names.where(~F.col("symbol").isin(*excluded)) if excluded else names
    if only is not None:
        names = names.where(F.col("symbol").isin(*[s.upper() for s in only]))
    names = names.orderBy("symbol")
    return names.limit(cap) if cap else names


def normalise_bars(raw: DataFrame, fill_missing: float | None = None, position: str | None = None) -> DataFrame:
    """Lower-cased headers, aliases, minute-floored time, numeric coercion, one row a key.

    ``raw`` has string columns and a ``symbol``. Unparsable numbers become NULL; absent columns
    become ``fill_missing``. Of rows that share a key the one with the lowest ``position`` stays;
    without a position, the one that is lowest by its values, so that every run keeps the same row.
    """
    df = raw.withColumnsRenamed({c: c.lower().strip() for c in raw.columns})
    df = df.withColumnsRenamed({a: "oi" for a in OI_ALIASES if a in df.columns})
    own = {"symbol", position}
    named = [c for c in df.columns if c not in own and ("time" in c or "date" in c or c == "dt")]
    time = named[0] if named else next(c for c in df.columns if c not in own)
    stamp = F.try_to_timestamp(F.substring(F.col(time).cast("string"), 1, 16), F.lit("yyyy-MM-dd HH:mm"))
    absent = F.lit(fill_missing).cast("double")
    rows = df.select("symbol", stamp.cast("timestamp_ntz").alias("datetime"),
                     F.struct(*[(F.expr(f"try_cast(`{c}` AS double)") if c in df.columns else absent).alias(c) for c in VALUES]).alias("v"),
                     *([F.col(position)] if position else [])).where(F.col("datetime").isNotNull())
    first = F.min_by("v", position) if position else F.min("v")
    return rows.groupBy("symbol", "datetime").agg(first.alias("v")).select("symbol", "datetime", "v.*")


def _csv_part(spark: SparkSession, files: str | Sequence[str], names: Sequence[str], fill_missing: float | None, symbol: str) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    raw = (spark.read.schema(schema).option("header", True).csv(files if isinstance(files, str) else list(files))
           .select("*", F.upper(F.regexp_extract(F.input_file_name(), symbol, 1)).alias("symbol"), place.alias("_place")))
    return normalise_bars(raw, fill_missing, "_place")


def read_csv_bars(spark: SparkSession, path: str, fill_missing: float | None = None,
                  columns: Sequence[str] | None = None, symbol: str = r"([^/]+)\.csv$") -> DataFrame:
    """Bar files, one or more per symbol; the symbol is what the pattern finds in the file's path (its stem), in upper case.

    With ``columns`` all files share one layout and are read in a single scan. Otherwise the first line of
    every file is its header, whatever it says, and files with the same header are read together. A file
    without a header line (an empty one) raises an error; none is left out. The driver holds the file names,
    as Spark's own file index does.
    """
    if columns:
        return _csv_part(spark, path, columns, fill_missing, symbol)
    # rows of a block stand in file order
    heads = (spark.read.text(path).select(F.col("_metadata.file_path").alias("f"), "value", F.col("_metadata.file_block_start").alias("at"),
                                          F.monotonically_increasing_id().alias("i"))
             .where("at = 0").groupBy("f").agg(F.min_by("value", "i").alias("head")).groupBy("head").agg(F.collect_set("f").alias("files"))).collect()
    listed = len(set(spark.read.text(path).inputFiles()))
    read = sum(len(h["files"]) for h in heads)
    if not read or read != listed:
        raise ValueError(f"{listed - read} of {listed} bar files under {path} have no header line")
    parts: DataFrame | None = None
    for head in sorted(heads, key=lambda h: h["head"]):  # one row per distinct header line
        names = [c.strip() for c in head["head"].lstrip("\ufeff").split(",")]
        part = _csv_part(spark, sorted(head["files"]), names, fill_missing, symbol)
        parts = part if parts is None else parts.unionByName(part)
    return parts


def load_range(bars: DataFrame, start: str, end: str, warmup_days: int = 7, pad_end_days: int = 0) -> DataFrame:
    """Rows of [start - warm-up, end + pad); literals are typed so the filter reaches the scan."""
    lo = F.expr(f"TIMESTAMP_NTZ'{start}' - INTERVAL '{warmup_days}' DAY")
    hi = F.expr(f"TIMESTAMP_NTZ'{end}' + INTERVAL '{pad_end_days}' DAY")
    return bars.where((F.col("datetime") >= lo) & (F.col("datetime") < hi))


def trim(df: DataFrame, start: str, end: str) -> DataFrame:
    """Drop the warm-up once the windows are computed."""
    return load_range(df, start, end, 0, 0)


def symbol_dimension(bars: DataFrame, known: int | None = None) -> DataFrame:
    """Symbol attributes derived from the symbol number: sector, exchange, group and chain.

    Symbols numbered ``known`` or above stay out, as in a map kept by hand.
    """
    n = F.regexp_extract("symbol", "([0-9]+)$", 1).cast("int")
    dim = bars.select("symbol").distinct().select(
        "symbol",
        F.concat(F.lit("sector"), n % 4).alias("sector"),
        F.concat(F.lit("X"), n % 2).alias("exchange"),
        F.concat(F.lit("g"), n % 3).alias("grp"),
        F.when(n % 5 == 0, F.lit("chain0")).when(n % 5 == 1, F.lit("chain1")).alias("chain"))
    return dim if known is None else dim.where(n < known)


def enrich(bars: DataFrame, dim: DataFrame, columns: Sequence[str], default: str = UNKNOWN) -> DataFrame:
    """Left join of a dimension with a default; the optimizer broadcasts it when its size allows."""
    small = dim.select("symbol", *columns)
    joined = bars.join(small, "symbol", "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(default)) for c in columns})


def group_of(bars: DataFrame, dim: DataFrame) -> DataFrame:
    """``grp`` with default 'other' and ``chain`` falling back to the group."""
    joined = bars.join(dim.select("symbol", "grp", "chain"), "symbol", "left")
    grp = F.coalesce(F.col("grp"), F.lit("other"))
    return joined.withColumns({"chain": F.coalesce(F.col("chain"), grp), "grp": grp})


def resample(rows: DataFrame, symbol: Column, time: Column, order: Sequence[str], price: Column,
             volume: Column, amount: Column, oi: Column) -> DataFrame:
    """Raw rows to bars: one partial aggregate, no sort of a bar's rows."""
    key = F.struct(*order, price.alias("_p"))
    return (rows.groupBy(symbol.alias("symbol"), time.cast("timestamp_ntz").alias("datetime"))
            .agg(F.min_by(price, key).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
                 F.max_by(price, key).alias("close"), volume.alias("volume"), amount.alias("amount"),
                 oi.alias("oi")))


def daily_bars(lineitem: DataFrame, symbols: int = 12) -> DataFrame:
    return resample(
        lineitem, F.concat(F.lit("S"), F.col("l_suppkey") % symbols), F.col("l_shipdate"),
        ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
        F.col("l_extendedprice") / F.col("l_quantity"), F.sum("l_quantity"), F.sum("l_extendedprice"),
        F.count(F.lit(1)).cast("double"))


def hourly_bars(events: DataFrame, symbols: int = 12) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double")
    return resample(
        events, F.concat(F.lit("U"), F.col("user_id") % symbols), F.date_trunc("hour", "ts"),
        ("ts", "event_id"), F.col("value"), F.count(F.lit(1)).cast("double"), F.sum("value"), F.sum(k))


def write_month_parts(panel: DataFrame, path: str, mode: str = "overwrite", rows_per_file: int = 4_000_000) -> None:
    """Month-partitioned sink. Months are counted first, and a month is cut into as many parts as its rows need."""
    marked = panel.withColumn("month_key", F.date_format("datetime", "yyyy-MM"))
    sizes = marked.groupBy("month_key").agg(F.ceil(F.count(F.lit(1)) / F.lit(rows_per_file)).alias("_parts"))  # one row a month
    part = F.pmod(F.xxhash64("symbol", "datetime"), F.col("_parts"))
    (marked.join(sizes, "month_key").withColumn("_part", part).repartition("month_key", "_part").drop("_parts", "_part")
     .write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("month_key").parquet(path))


def read_months(spark: SparkSession, path: str, columns: Sequence[str], start: str, end: str) -> DataFrame:
    """Projection and time range reach the scan; the month filter prunes folders."""
    df = spark.read.parquet(path)
    months = F.col("month_key").between(start[:7], end[:7])
    return load_range(df.where(months), start, end, 0, 0).select(*columns)


def materialise_panel(views: DataFrame, path: str, start: str | None = None, end: str | None = None) -> None:
    """Write selected factor views by month, whole or for a range of months.

    The caller's plan keeps the warm-up bars before ``start`` (see ``load_range``); they feed the
    windows and are cut here, so a rerun of some months replaces exactly those folders.
    """
    write_month_parts(trim(views, start, end) if start and end else views, path)


def write_metrics(tables: dict[str, DataFrame], path: str) -> None:
    """Metric tables as CSV folders with a header; they are small, so each is one file."""
    for name, df in tables.items():
        df.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/{name}")


def factor_columns(df: DataFrame, meta: Sequence[str], accepted: Sequence[str] | None = None,
                   top_n: int | None = None) -> list[str]:
    """Factor columns of a frame: those accepted first and in their order, then schema order."""
    have = [c for c in df.columns if c not in set(meta)]
    first = [c for c in (accepted or []) if c in set(have)]
    names = first + [c for c in have if c not in set(first)]
    return names[:top_n] if top_n else names


def audit_files(spark: SparkSession, paths: Sequence[str], deep: bool = False) -> DataFrame:
    """Per path: readable, column count, row count. Unreadable paths become a row, not an error.

    Every path is read on its own, so damage to one does not hide the others. Footers are read; with ``deep``, all columns of all rows.
    """
    rows = []
    for p in paths:  # a short list of assets, not of rows
        name = p.rsplit("/", 1)[-1]
        try:
            df = spark.read.parquet(p)
            if deep:
                df.write.format("noop").mode("overwrite").save()
            rows.append((name, True, len(df.columns), df.count()))
        except Exception:
            rows.append((name, False, None, None))
    return spark.createDataFrame(rows, "asset string, readable boolean, n_columns long, n_rows long")
