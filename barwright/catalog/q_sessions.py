"""Sources, sessions, masks and labels."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from barwright.catalog.base import (BARS_D, BARS_H, GAP_D, GAP_H, HORIZON, KEY, MONTH, PANEL_D, PANEL_H, ROWS, SESS_D,
                                    SESS_H, YEAR, Tables, avg_rank, clip_sql, i, out, pct_rank, probit_sql, query, r,
                                    rs, sessions_sql, train_rows, uniform_sql, z_sql)
from barwright.operators import labels, sessions
from barwright.plans import xsec
from barwright.plans.staging import shared_dir
from barwright.sources import bars as src

OHLC = ("open", "high", "low", "close", "volume", "amount", "oi")
DIM_SQL = """dim AS (SELECT DISTINCT symbol, 'sector' || (substr(symbol, 2)::INT % 4) AS sector,
   'X' || (substr(symbol, 2)::INT % 2) AS exchange, 'g' || (substr(symbol, 2)::INT % 3) AS grp,
   CASE substr(symbol, 2)::INT % 5 WHEN 0 THEN 'chain0' WHEN 1 THEN 'chain1' END AS chain
   FROM bars WHERE substr(symbol, 2)::INT < 11)"""


@query("io13_bars_daily", f"WITH {BARS_D} SELECT {KEY}, {rs(OHLC, 8)} FROM bars")
def _(t: Tables):
    return out(t.daily(), OHLC, digits=8)


@query("io13_bars_hourly", f"WITH {BARS_H} SELECT {KEY}, {rs(OHLC, 8)} FROM bars")
def _(t: Tables):
    return out(t.hourly(), OHLC, digits=8)


@query("io01_symbols", f"""WITH {BARS_D} SELECT symbol FROM (SELECT DISTINCT symbol FROM bars)
   WHERE symbol NOT IN ('S3', 'S7')""")
def _(t: Tables):
    return src.discover_symbols(t.daily(), excluded=("S3", "S7"))


@query("io02_text_bars", """SELECT DISTINCT symbol, strftime(ts, '%Y-%m-%d %H:%M') AS dt, n_rows, lo, hi FROM (
   SELECT symbol, date_trunc('minute', ts) AS ts, count(*) AS n_rows, round(min(value), 4) + 0.0 AS lo,
          round(max(value), 4) + 0.0 AS hi
   FROM (SELECT 'U' || (user_id % 12) AS symbol, ts, value FROM events) GROUP BY 1, 2)""")
def _(t: Tables):
    # the loader on raw text columns: aliases, minute floor, coercion, one row a key
    e = t.table("events").select(
        F.concat(F.lit("U"), F.col("user_id") % 12).alias("symbol"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias(" Trade Time"), F.col("value").cast("string").alias("Close"))
    one = src.normalise_bars(e, 0.0).select("symbol", "datetime")
    rows = e.select("symbol", F.substring(" Trade Time", 1, 16).alias("dt"), F.expr("try_cast(Close AS double)").alias("v"))
    agg = rows.groupBy("symbol", "dt").agg(F.count(F.lit(1)).alias("n_rows"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    keys = one.withColumn("dt", F.date_format("datetime", "yyyy-MM-dd HH:mm")).drop("datetime")
    return out(agg.join(keys, ["symbol", "dt"], "inner"), ("n_rows", "lo", "hi"))


@query("io02_csv_bars", f"""WITH {BARS_D} SELECT {KEY}, {rs(OHLC, 8)} FROM bars""")
def _(t: Tables):
    """Bars as CSV files in two layouts, read back by the loader."""
    bars = t.daily()
    odd = F.regexp_extract("symbol", "([0-9]+)$", 1).cast("int") % 2 == 1
    text = lambda c: F.col(c).cast("string")
    stamp = F.date_format("datetime", "yyyy-MM-dd HH:mm:ss")
    path = f"{shared_dir(t.spark)}/csv-{uuid.uuid4().hex}"
    one = bars.where(odd).select("symbol", stamp.alias("datetime"), *[text(c) for c in src.VALUES])
    two = bars.where(~odd).select("symbol", text("close").alias(" Close "), stamp.alias("Trade Time"), text("oi").alias("Open Interest"),
                                  *[text(c).alias(c.upper()) for c in src.VALUES if c not in ("close", "oi")])
    for k, part in enumerate((one, two)):
        part.write.option("header", True).partitionBy("symbol").csv(f"{path}/{k}")
    return out(src.read_csv_bars(t.spark, f"{path}/*/*/*.csv", symbol="symbol=([^/]+)/"), OHLC, digits=8)


@query("io03_range_with_warmup", f"""WITH {BARS_D}, f AS (SELECT * FROM bars WHERE datetime >= TIMESTAMP '1996-05-25'
   AND datetime < TIMESTAMP '1998-01-01'), x AS (SELECT *, avg(ln(close)) OVER (PARTITION BY symbol ORDER BY datetime
   ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS sma FROM f)
   SELECT {KEY}, {r('sma')} FROM x WHERE datetime >= TIMESTAMP '1996-06-01'""")
def _(t: Tables):
    from barwright.plans.rolling import Rolling
    rows = src.load_range(t.d, "1996-06-01", "1998-01-01", warmup_days=7)
    first = rows.groupBy("symbol").agg(F.min("bar_no").alias("_b"))
    rows = rows.join(first, "symbol").withColumn("bar_no", F.col("bar_no") - F.col("_b"))
    roll = Rolling(rows.select("symbol", "datetime", "bar_no", F.ln("close").alias("x")), 6, 0, ROWS)
    roll.emit(sma=F.try_divide(roll.sum("x", 5), roll.count("x", 5)))
    return out(src.trim(roll.close(), "1996-06-01", "1998-01-01"), ("sma",))


@query("io04_sector_enrichment", f"""WITH {BARS_D}, {DIM_SQL} SELECT coalesce(sector, 'unknown') AS sector,
   coalesce(exchange, 'unknown') AS exchange, count(*) AS n_rows, {r('avg(close)', 'avg_close')}
   FROM bars LEFT JOIN dim USING (symbol) GROUP BY 1, 2""")
def _(t: Tables):
    e = src.enrich(t.daily(), t.dim, ["sector", "exchange"])
    return out(e.groupBy("sector", "exchange").agg(F.count(F.lit(1)).alias("n_rows"), F.avg("close").alias("avg_close")),
               ("n_rows", "avg_close"), ("sector", "exchange"))


@query("io05_group_chain", f"""WITH {BARS_D}, {DIM_SQL} SELECT coalesce(grp, 'other') AS grp,
   coalesce(chain, grp, 'other') AS chain, count(*) AS n_rows FROM bars LEFT JOIN dim USING (symbol) GROUP BY 1, 2""")
def _(t: Tables):
    return src.group_of(t.daily(), t.dim).groupBy("grp", "chain").agg(F.count(F.lit(1)).alias("n_rows"))


@query("io06_month_slice", f"""WITH {BARS_D} SELECT {KEY}, {rs(('close', 'volume'), 8)} FROM bars
   WHERE datetime >= TIMESTAMP '1997-02-01' AND datetime < TIMESTAMP '1997-05-01'""")
def _(t: Tables):
    from barwright.plans.staging import shared_dir
    import uuid
    path = f"{shared_dir(t.spark)}/months-{uuid.uuid4().hex}"
    src.write_month_parts(t.d.select("symbol", "datetime", "close", "volume"), path)
    return out(src.read_months(t.spark, path, ["symbol", "datetime", "close", "volume"], "1997-02-01", "1997-05-01"),
               ("close", "volume"), digits=8)


@query("io07_month_sink", f"""WITH {BARS_D} SELECT strftime(datetime, '%Y-%m') AS month_key, count(*) AS n_rows,
   count(DISTINCT symbol) AS n_symbols FROM bars GROUP BY 1""")
def _(t: Tables):
    from barwright.plans.staging import shared_dir
    import uuid
    path = f"{shared_dir(t.spark)}/sink-{uuid.uuid4().hex}"
    src.write_month_parts(t.d.select("symbol", "datetime", "close"), path)
    back = t.spark.read.parquet(path).select(F.col("month_key").cast("string").alias("month_key"), "symbol")
    per = back.groupBy("month_key", "symbol").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("month_key").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_symbols"))


@query("io08_materialised_panel", f"""WITH {BARS_D}, x AS (SELECT symbol, datetime, CASE WHEN count(close) OVER f >= 20 THEN (close - avg(close) OVER f) / (stddev_samp(close) OVER f + 1e-9) END AS z,
     {z_sql('volume', 'datetime')} AS v FROM bars WINDOW f AS (PARTITION BY symbol ORDER BY datetime ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))
   SELECT {KEY}, {r(f"coalesce({clip_sql('z', 20.0)}, 0)", 'tsz_close')}, {r(f"coalesce({clip_sql('v', 20.0)}, 0)", 'csz_volume')} FROM x WHERE datetime >= TIMESTAMP '1998-03-01' AND datetime < TIMESTAMP '1998-09-01'""")
def _(t: Tables):
    from barwright.operators import views
    from barwright.plans.staging import shared_dir
    import uuid
    names, path = ["tsz_close", "csz_volume"], f"{shared_dir(t.spark)}/panel-{uuid.uuid4().hex}"
    src.materialise_panel(views.selected_views(t.d, t.g, names, 20.0, 60, 20, ROWS), path, "1998-03-01", "1998-09-01")
    return out(src.read_months(t.spark, path, ["symbol", "datetime", *names], "1998-03-01", "1998-09-01"), names)


@query("io11_metric_files", f"""WITH {PANEL_D} SELECT strftime(datetime, '%Y') AS year, count(label) AS n, {r('avg(label)', 'mean_label', 6)} FROM panel GROUP BY 1""")
def _(t: Tables):
    from barwright.plans.staging import shared_dir
    import uuid
    path = f"{shared_dir(t.spark)}/metrics-{uuid.uuid4().hex}"
    m = t.d.groupBy(F.date_format("datetime", "yyyy").alias("year")).agg(F.count("label").alias("n"), F.avg("label").alias("mean_label"))
    src.write_metrics({"yearly": m}, path)
    back = t.spark.read.schema("year string, n long, mean_label double").option("header", True).csv(f"{path}/yearly")
    return out(back, ("n", "mean_label"), ("year",), 6)


@query("io12_cache_reuse", f"""WITH {PANEL_D} SELECT {KEY}, {r('ln(volume)', 'feature')}, {r('label * label', 'target')} FROM panel""")
def _(t: Tables):
    from barwright.plans.staging import reuse
    meta = {"folder": t.folder, "columns": ["feature"], "app": t.spark.sparkContext.applicationId}
    make = lambda: t.d.select("symbol", "datetime", "label", F.ln("volume").alias("feature"))
    reuse(t.spark, "features", meta, make)
    features, _ = reuse(t.spark, "features", meta, make)  # the second call only reads
    return out(features.withColumn("target", F.col("label") * F.col("label")), ("feature", "target"))


_PICK = ("close", "volume", "open")


@query("io09_factor_columns", f"WITH {BARS_D} " + " UNION ALL ".join(
    f"SELECT {k + 1}::BIGINT AS pos, '{c}' AS factor, count({c}) AS n, {r(f'avg(ln({c}))', 'mean_log', 6)} FROM bars" for k, c in enumerate(_PICK)))
def _(t: Tables):
    d = t.d.select("symbol", "datetime", *OHLC)
    names = src.factor_columns(d, ("symbol", "datetime"), accepted=("close", "missing", "volume"), top_n=3)
    one = d.select(*names).agg(*[e for c in names for e in (F.count(c).alias(f"n_{c}"), F.avg(F.ln(c)).alias(f"m_{c}"))])
    rows = [F.struct(F.lit(k + 1).cast("long").alias("pos"), F.lit(c).alias("factor"), F.col(f"n_{c}").alias("n"), F.col(f"m_{c}").alias("mean_log"))
            for k, c in enumerate(names)]
    return out(one.select(F.inline(F.array(*rows))), ("n", "mean_log"), ("pos", "factor"), 6)


@query("io10_asset_audit", """SELECT * FROM (SELECT 'lineitem.parquet' AS asset, TRUE AS readable, 11::BIGINT AS n_columns,
   (SELECT count(*) FROM lineitem) AS n_rows UNION ALL SELECT 'events.parquet', TRUE, 6, (SELECT count(*) FROM events)
   UNION ALL SELECT 'absent.parquet', FALSE, NULL, NULL)""")
def _(t: Tables):
    return src.audit_files(t.spark, [f"{t.folder}/{n}.parquet" for n in ("lineitem", "events", "absent")])


SESS_COLS = ("gap_min", "is_long_break_before", "session_id", "session_pos", "bars_to_next_long_break")
SESS_SEL = (f"{r('gap_min')}, is_long_break_before, session_id, {i('session_pos')}, {i('bars_to_next_long_break')}")


@query("se01_05_sessions_daily", f"WITH {SESS_D} SELECT {KEY}, {SESS_SEL} FROM sess")
def _(t: Tables):
    return out(sessions.add_sessions(t.daily(), GAP_D, YEAR), SESS_COLS)


@query("se01_05_sessions_hourly", f"WITH {SESS_H} SELECT {KEY}, {SESS_SEL} FROM sess")
def _(t: Tables):
    return out(sessions.add_sessions(t.hourly(), GAP_H, MONTH), SESS_COLS)


@query("se06_calendar", f"""WITH {BARS_H} SELECT {KEY}, CASE WHEN hour(datetime) >= 20 OR hour(datetime) < 8 THEN 'night'
   ELSE 'day' END AS session_type, {i('hour(datetime) * 60 + minute(datetime)', 'minute_of_day')},
   {i('month(datetime)', 'month')} FROM bars""")
def _(t: Tables):
    return out(sessions.add_calendar(t.hourly()), ("session_type", "minute_of_day", "month"))


@query("se07_session_key", f"""WITH {BARS_H}, {sessions_sql(GAP_H, '>')} SELECT {KEY},
   ((dense_rank() OVER (ORDER BY symbol) - 1) * 4294967296 + session_id)::BIGINT AS session_key FROM sess""")
def _(t: Tables):
    return out(sessions.session_key(sessions.add_sessions(t.hourly(), GAP_H, MONTH, strict=True)), ("session_key",))


@query("se08_09_mask", f"""WITH {PANEL_D} SELECT {KEY}, {i('bss')},
   {r('CASE WHEN bss >= 5 THEN close END', 'masked_close', 8)} FROM panel""")
def _(t: Tables):
    return out(t.d.withColumns({"bss": sessions.bars_since_break(), "masked_close": sessions.masked(F.col("close"), 5)}),
               ("bss", "masked_close"), digits=8)


@query("se10_bars_to_month_end", f"""WITH {BARS_D} SELECT {KEY}, {i('''row_number() OVER (PARTITION BY symbol,
   date_trunc('month', datetime) ORDER BY datetime DESC) - 1''', 'bars_to_month_end')} FROM bars""")
def _(t: Tables):
    return out(sessions.bars_to_month_end(t.d), ("bars_to_month_end",))


JW, JMIN = 40, 15
JUMP_CTE = PANEL_H + f""",
j1 AS (SELECT *, CASE WHEN NOT is_long_break_before AND close > 0 AND pcl > 0 THEN ln(close / pcl) END AS ret_1
       FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY datetime) AS pcl FROM panel)),
j2 AS (SELECT *, CASE WHEN count(ret_1) OVER p >= {JMIN} THEN quantile_cont(ret_1, 0.5) OVER p END AS med,
              lag(ret_1) OVER (PARTITION BY symbol ORDER BY datetime) AS lret
       FROM j1 WINDOW p AS (PARTITION BY symbol ORDER BY datetime ROWS BETWEEN {JW} PRECEDING AND 1 PRECEDING)),
j3 AS (SELECT *, abs(lret - med) AS dev FROM j2),
j4 AS (SELECT *, CASE WHEN count(dev) OVER p >= {JMIN} THEN 1.4826 * quantile_cont(dev, 0.5) OVER p END AS mad
       FROM j3 WINDOW p AS (PARTITION BY symbol ORDER BY datetime ROWS BETWEEN {JW - 1} PRECEDING AND CURRENT ROW)),
jump AS (SELECT *, (ret_1 - med) / (mad + 1e-8) AS ret_robust_z,
         coalesce(abs((ret_1 - med) / (mad + 1e-8)) > 2, false) AS jump_risk_2,
         coalesce(abs((ret_1 - med) / (mad + 1e-8)) > 3, false) AS jump_risk_3 FROM j4)"""


def jumps(t: Tables):
    return sessions.add_jump_risk(t.h, JW, JMIN, (2, 3), ROWS)


@query("se11_jump_risk", f"WITH {JUMP_CTE} SELECT {KEY}, {rs(('ret_1', 'ret_robust_z'))}, jump_risk_2, jump_risk_3 FROM jump")
def _(t: Tables):
    return out(jumps(t), ("ret_1", "ret_robust_z", "jump_risk_2", "jump_risk_3"))


def _ok(h: int, thr: int) -> str:
    return (f"(coalesce(sum(jump_risk_{thr}::INT) OVER (PARTITION BY symbol ORDER BY datetime ROWS BETWEEN 1 FOLLOWING "
            f"AND {h} FOLLOWING), 0) = 0 AND bars_to_next_long_break >= {h}) AS jump_ok_h{h}_thr{thr}")


@query("se12_horizon_masks", f"""WITH {JUMP_CTE} SELECT {KEY}, {', '.join(_ok(h, k) for k in (2, 3) for h in (2, 5))} FROM jump""")
def _(t: Tables):
    return out(sessions.add_horizon_masks(jumps(t), (2, 5), (2, 3), ROWS),
               [f"jump_ok_h{h}_thr{k}" for k in (2, 3) for h in (2, 5)])


@query("se13_jump_summary", f"""WITH {JUMP_CTE} SELECT 'no_filter' AS threshold, 0::BIGINT AS jump_bars, 0.0::DOUBLE AS jump_bar_pct
   UNION ALL SELECT '2', sum(jump_risk_2::INT)::BIGINT, round(avg(jump_risk_2::INT), 6) FROM jump
   UNION ALL SELECT '3', sum(jump_risk_3::INT)::BIGINT, round(avg(jump_risk_3::INT), 6) FROM jump""")
def _(t: Tables):
    return out(sessions.jump_summary(jumps(t), (2, 3)), ("jump_bars", "jump_bar_pct"), ("threshold",), 6)


@query("se14_raw_vwap", f"WITH {BARS_D} SELECT {KEY}, {r('ln(amount / nullif(volume, 0))', 'log_vwap')} FROM bars")
def _(t: Tables):
    return out(t.d.withColumn("log_vwap", F.ln(sessions.raw_vwap())), ("log_vwap",))


ROLL_CTE = PANEL_D + """,
f1 AS (SELECT *, ln((amount / volume) / close) AS lf FROM panel),
f2 AS (SELECT *, lf - lag(lf) OVER (PARTITION BY symbol ORDER BY datetime) AS log_factor_jump FROM f1),
f3 AS (SELECT *, median(log_factor_jump) OVER (PARTITION BY symbol) AS med FROM f2),
f4 AS (SELECT *, greatest(0.015, {m} * 1.4826 * median(abs(log_factor_jump - med)) OVER (PARTITION BY symbol)) AS roll_threshold FROM f3),
rolls AS (SELECT *, abs(log_factor_jump) AS abs_log_factor_jump, coalesce(abs(log_factor_jump) > roll_threshold, false) AS roll FROM f4)"""


@query("se15_roll_candidates", f"""WITH {ROLL_CTE.format(m=2.0)} SELECT {KEY}, {rs(('gap_min', 'log_factor_jump',
   'abs_log_factor_jump', 'roll_threshold'))} FROM rolls WHERE roll""")
def _(t: Tables):
    c = sessions.roll_candidates(t.d, mad_multiplier=2.0, largest=None, rows=ROWS)
    return out(c.orderBy(F.desc("abs_log_factor_jump")), ("gap_min", "log_factor_jump", "abs_log_factor_jump", "roll_threshold"))


@query("se16_invalid_near_roll", f"""WITH {ROLL_CTE.format(m=4.0)} SELECT {KEY}, max(roll::INT) OVER (PARTITION BY symbol
   ORDER BY datetime ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) = 1 AS near_roll FROM rolls""")
def _(t: Tables):
    longest = xsec.measure(t.d, ["symbol"]).largest
    c = sessions.roll_candidates(t.d, mad_multiplier=4.0, largest=longest, rows=ROWS).select("symbol", "datetime", F.lit(True).alias("roll"))
    p = t.d.join(c, ["symbol", "datetime"], "left").withColumn("roll", F.coalesce("roll", F.lit(False)))
    return out(sessions.invalid_near(p, "roll", 6, ROWS), ("near_roll",))


@query("se17_valid_rows", f"""WITH {PANEL_D} SELECT {KEY}, {r('label')} FROM panel WHERE datetime >= TIMESTAMP '1997-01-01'
   AND datetime < TIMESTAMP '1999-01-01' AND label IS NOT NULL""")
def _(t: Tables):
    return out(src.load_range(t.d, "1997-01-01", "1999-01-01", 0).where(F.col("label").isNotNull()), ("label",))


@query("se18_periods", f"""WITH {BARS_D} SELECT strftime(datetime, '%Y') AS year, strftime(datetime, '%Y-%m') AS month,
   strftime(date_trunc('week', datetime), '%Y-%m-%d') AS week, count(*) AS n_rows FROM bars GROUP BY 1, 2, 3""")
def _(t: Tables):
    p = t.d.select(F.date_format("datetime", "yyyy").alias("year"), F.date_format("datetime", "yyyy-MM").alias("month"),
                   F.date_format(F.date_trunc("week", "datetime"), "yyyy-MM-dd").alias("week"))
    return p.groupBy("year", "month", "week").agg(F.count(F.lit(1)).alias("n_rows"))


@query("se19_scrub", f"""WITH {PANEL_D}, x AS (SELECT *, lag(close, 3) OVER (PARTITION BY symbol ORDER BY datetime) AS c3 FROM panel)
   SELECT {KEY}, {r('coalesce(close / c3 - 1, 0)', 'clean')}, {r('coalesce(label, 0)', 'label0')} FROM x""")
def _(t: Tables):
    from barwright.functions.expr import scrub
    from barwright.plans import chunks
    d = chunks.open_chunks(t.d, 3, 0, ROWS)
    raw = F.coalesce(F.col("close") / F.lag("close", 3).over(chunks.bars()) - 1, F.lit(float("inf")))
    d = chunks.close_chunks(d.withColumn("raw", raw))
    return out(d.withColumns({"clean": scrub("raw"), "label0": scrub("label")}), ("clean", "label0"))


@query("se20_quality", f"""WITH k AS (SELECT 'S' || (l_suppkey % 12) AS symbol, l_shipdate AS datetime, count(*) AS n,
     count(l_extendedprice) AS closes, sum((l_extendedprice < l_quantity)::INT) AS crossed FROM lineitem GROUP BY 1, 2)
   SELECT symbol, sum(n)::BIGINT AS n_rows, sum(n - 1)::BIGINT AS duplicate_keys, sum((second(datetime) <> 0)::INT)::BIGINT AS off_minute,
     sum(crossed)::BIGINT AS crossed_bars, {r('sum(closes) / sum(n)', 'close_coverage')}, sum(closes) / sum(n) > 0.5 AS coverage_ok
   FROM k GROUP BY 1""")
def _(t: Tables):
    rows = t.table("lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey") % 12).alias("symbol"), F.col("l_shipdate").alias("datetime"),
        F.col("l_extendedprice").alias("close"), F.col("l_extendedprice").alias("high"), F.col("l_quantity").alias("low"))
    return out(sessions.quality_report(rows), ("n_rows", "duplicate_keys", "off_minute", "crossed_bars", "close_coverage",
                                               "coverage_ok"), ("symbol",))


@query("se20_bar_contract", f"""WITH x AS (SELECT *, row_number() OVER () AS k FROM lineitem), b AS (SELECT k, 'S' || (l_suppkey % 12) AS symbol, l_shipdate AS datetime, l_extendedprice AS close, l_quantity AS amount FROM x),
   f AS (SELECT symbol, sum((datetime < coalesce(p, datetime))::INT)::BIGINT AS falls FROM (SELECT *, lag(datetime) OVER (PARTITION BY symbol ORDER BY k) AS p FROM b) GROUP BY symbol),
   g AS (SELECT symbol, datetime, count(*) AS n, count(close) AS c, count(amount) AS a FROM b GROUP BY 1, 2)
   SELECT symbol, sum(n)::BIGINT AS n_rows, strftime(min(datetime), '%Y-%m-%d %H:%M') AS first_bar, strftime(max(datetime), '%Y-%m-%d %H:%M') AS last_bar, sum(n - 1)::BIGINT AS duplicate_keys,
     0::BIGINT AS off_minute, 0::BIGINT AS off_second, {r('sum(c) / sum(n)', 'close_share')}, {r('sum(a) / sum(n)', 'amount_share')}, any_value(falls) AS falls,
     'open,high,low,volume,oi' AS missing_columns, FALSE AS holds FROM g JOIN f USING (symbol) GROUP BY symbol""")
def _(t: Tables):
    """The raw table as it is stored, read as bars without prices other than the close."""
    raw = t.table("lineitem").select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    rows = raw.select(F.concat(F.lit("S"), F.col("l_suppkey") % 12).alias("symbol"), F.col("l_shipdate").cast("timestamp_ntz").alias("datetime"),
                      F.col("l_extendedprice").alias("close"), F.col("l_quantity").alias("amount"), "file", "row")
    d = sessions.bar_contract(rows, ("file", "row"))
    d = d.withColumns({n: F.date_format(c, "yyyy-MM-dd HH:mm") for n, c in (("first_bar", "start"), ("last_bar", "end"))})
    return out(d, ("n_rows", "first_bar", "last_bar", "duplicate_keys", "off_minute", "off_second", "close_share", "amount_share", "falls", "missing_columns", "holds"), ("symbol",))


@query("se20_panel_contract", f"""WITH {PANEL_D}, n AS (SELECT *, CASE WHEN label IS NOT NULL THEN {uniform_sql(42, 'symbol', "strftime(datetime, '%Y-%m-%d %H:%M')")} - 0.5 END AS p FROM panel)
   SELECT symbol, count(*) AS n_rows, (max(session_id) - min(session_id) + 1)::BIGINT AS sessions, sum((gap_min >= {GAP_D})::INT)::BIGINT AS long_breaks,
     sum((gap_min > 1 AND gap_min < {GAP_D})::INT)::BIGINT AS short_breaks, {r('max(gap_min)', 'max_gap_min')}, {r('count(label) / count(*)', 'label_coverage')},
     sum((bars_to_next_long_break < {HORIZON} AND label IS NOT NULL)::INT)::BIGINT AS labels_over_break, {r('sum(p * label) / sqrt(sum(p * p) * sum(label * label))', 'random_ic', 6)} FROM n GROUP BY symbol""")
def _(t: Tables):
    d = sessions.panel_contract(t.d, HORIZON, GAP_D)
    return out(d.withColumn("random_ic", F.round("random_ic", 6)), ("n_rows", "sessions", "long_breaks", "short_breaks", "max_gap_min", "label_coverage", "labels_over_break", "random_ic"),
               ("symbol",), 6).withColumns({c: F.round(c, 4) for c in ("max_gap_min", "label_coverage")})


# ---- labels ---------------------------------------------------------------------------------------
@query("lb01_simple_label", f"WITH {PANEL_D} SELECT {KEY}, {r('label')} FROM panel")
def _(t: Tables):
    return out(labels.simple_label(t.d.drop("label"), HORIZON, ROWS), ("label",))


def _lead(h: int) -> str:
    return (f"CASE WHEN bars_to_next_long_break >= {h} AND close > 0 THEN ln(lead(close, {h}) OVER (PARTITION BY symbol "
            f"ORDER BY datetime) / close) END")


@query("lb02_log_label", f"WITH {PANEL_D} SELECT {KEY}, {r(_lead(4), 'y_4')} FROM panel")
def _(t: Tables):
    return out(labels.log_label(t.d, 4, ROWS), ("y_4",))


FWD = "(PARTITION BY symbol ORDER BY datetime ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"


@query("lb03_multi_horizon", f"""WITH {JUMP_CTE} SELECT {KEY}, {', '.join(r(_lead(h), f'y_{h}') for h in (2, 5))},
   {', '.join(f'''(({_lead(h)}) IS NOT NULL AND coalesce(sum(jump_risk_3::INT) OVER {FWD.format(h=h)}, 0) = 0
      AND bars_to_next_long_break >= {h}) AS mask_{h}''' for h in (2, 5))} FROM jump""")
def _(t: Tables):
    p = sessions.add_horizon_masks(jumps(t), (2, 5), (3,), ROWS)
    return out(labels.multi_horizon_labels(p, (2, 5), 3, rows=ROWS), ("y_2", "y_5", "mask_2", "mask_5"))


LR_CTE = """, q1 AS (SELECT *, CASE WHEN NOT is_long_break_before AND close > 0 AND pcl > 0 THEN ln(close / pcl) END AS lr_
   FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY datetime) AS pcl FROM panel))"""


@query("lb04_forward_rv", f"""WITH {PANEL_D}{LR_CTE} SELECT {KEY}, {r(f'''CASE WHEN bars_to_next_long_break >= 5 AND count(lr_) OVER
   {FWD.format(h=5)} = 5 THEN ln(sum(lr_ * lr_) OVER {FWD.format(h=5)} + 1e-12) END''', 'log_rv')} FROM q1""")
def _(t: Tables):
    return out(labels.forward_rv(t.d, 5, ROWS), ("log_rv",))


@query("lb05_forward_range", f"""WITH {PANEL_D} SELECT {KEY}, {r(f'''CASE WHEN bars_to_next_long_break >= 5 THEN
   ln(max(high) OVER {FWD.format(h=5)} / min(low) OVER {FWD.format(h=5)}) END''', 'log_range')} FROM panel""")
def _(t: Tables):
    return out(labels.forward_range(t.d, 5, ROWS), ("log_range",))


@query("lb06_07_xs_targets", f"""WITH {PANEL_D}, x AS (SELECT *, CASE WHEN volume > 30 THEN label END AS y FROM panel)
   SELECT {KEY}, {r(clip_sql(z_sql('y', 'datetime'), 5.0), 'label_xsz')},
   {r('2 * ' + pct_rank('y', 'datetime') + ' - 1', 'label_xrank')} FROM x""")
def _(t: Tables):
    return out(labels.xs_targets(t.d, t.g, "label", F.col("volume") > 30), ("label_xsz", "label_xrank"))


@query("lb08_train_standardised", f"""WITH {PANEL_D}, s AS (SELECT avg(volume) AS m1, stddev_samp(volume) AS s1, avg(high - low) AS m2,
   stddev_samp(high - low) AS s2 FROM panel WHERE datetime < TIMESTAMP '1999-01-01')
   SELECT {KEY}, {r(clip_sql('(volume - m1) / (s1 + 1e-8)', 8.0), 'volume_norm')},
   {r(clip_sql('(high - low - m2) / (s2 + 1e-8)', 8.0), 'rng_norm')} FROM panel, s""")
def _(t: Tables):
    d = t.d.withColumn("rng", F.col("high") - F.col("low"))
    train = train_rows()
    return out(labels.standardise_on_train(d, ["volume", "rng"], train), ("volume_norm", "rng_norm"))


LBN = "count(label) OVER (PARTITION BY datetime)"
LBP = f"(({avg_rank('label', 'datetime')}) - 0.5) / {LBN}"


@query("lb09_target_modes", f"""WITH {PANEL_D}, x AS (SELECT *, {LBN} AS n, {LBP} AS p, label - avg(label) OVER (PARTITION BY datetime) AS e,
     stddev_samp(label) OVER (PARTITION BY datetime) AS s FROM panel),
   y AS (SELECT *, least(greatest(p, 1e-4), 1 - 1e-4) AS pc FROM x)
   SELECT {KEY}, {r('CASE WHEN n >= 8 THEN ' + clip_sql('e / nullif(s, 0)', 4.0) + ' END', 't_xsz')},
     {r('CASE WHEN n >= 8 THEN 2 * p - 1 END', 't_xrank')}, {r('CASE WHEN n >= 8 AND p IS NOT NULL THEN ' + probit_sql('pc') + ' END', 't_gauss')}
   FROM y""")
def _(t: Tables):
    d = t.d.select("symbol", "datetime", "label")
    for mode, name in (("xsz", "t_xsz"), ("xrank", "t_xrank"), ("xrank_gauss", "t_gauss")):
        d = labels.target_transform(d, t.g, mode).withColumnRenamed("target", name)
    return out(d, ("t_xsz", "t_xrank", "t_gauss"))


AUXP = pct_rank("label", "datetime")


@query("lb10_auxiliary_targets", f"""WITH {PANEL_D}{LR_CTE}, x AS (SELECT *, {AUXP} AS p FROM q1), y AS (SELECT *, least(greatest(p, 0.01), 0.99) AS pc FROM x)
   SELECT {KEY}, {r('abs(label)', 'aux_abs')}, {r('label * label', 'aux_sq')},
   {r('stddev_samp(label) OVER (PARTITION BY datetime)', 'aux_xs_std')}, {r('avg(abs(label)) OVER (PARTITION BY datetime)', 'aux_xs_mean_abs')},
   {r('(label - avg(label) OVER (PARTITION BY datetime)) / nullif(stddev_samp(label) OVER (PARTITION BY datetime), 0)', 'aux_xsz')},
   {r('p - 0.5', 'aux_xrank')}, {r('CASE WHEN p IS NOT NULL THEN ' + probit_sql('pc') + ' END', 'aux_rank_gauss')},
   {r(f'CASE WHEN bars_to_next_long_break >= 4 THEN sqrt(sum(lr_ * lr_) OVER {FWD.format(h=4)}) END', 'aux_rv')},
   {r(f'CASE WHEN bars_to_next_long_break >= 4 THEN avg((high - low) / close) OVER {FWD.format(h=4)} END', 'aux_range')} FROM y""")
def _(t: Tables):
    return out(labels.auxiliary_targets(t.d, t.g, 4, rows=ROWS), (
        "aux_abs", "aux_sq", "aux_xs_std", "aux_xs_mean_abs", "aux_xsz", "aux_xrank", "aux_rank_gauss", "aux_rv", "aux_range"))


@query("lb11_label_views", f"""WITH {PANEL_D}, x AS (SELECT *, {AUXP} AS p FROM panel), y AS (SELECT *, least(greatest(p, 0.01), 0.99) AS pc FROM x)
   SELECT {KEY}, {r(clip_sql(z_sql('label', 'datetime', '1e-9'), 8.0), 'label_xsz')}, {r('p - 0.5', 'label_xrank')},
   {r('CASE WHEN p IS NOT NULL THEN ' + probit_sql('pc') + ' END', 'label_ranknorm')} FROM y""")
def _(t: Tables):
    return out(labels.label_views(t.d, t.g), ("label_xsz", "label_xrank", "label_ranknorm"))


@query("lb12_time_targets", f"""WITH {PANEL_D}, x AS (SELECT *, {', '.join(f'ln(lead(close, {h}) OVER (PARTITION BY symbol ORDER BY datetime) / close) AS fwd_{h}' for h in (5, 15))} FROM panel)
   SELECT {KEY}, {rs(('fwd_5', 'fwd_15'))}, {', '.join(r(z_sql(f'fwd_{h}', 'datetime', '1e-9'), f'fwd_{h}_xsz') for h in (5, 15))} FROM x""")
def _(t: Tables):
    return out(labels.time_targets(t.d, t.g, (5, 15), ROWS), ("fwd_5", "fwd_15", "fwd_5_xsz", "fwd_15_xsz"))


from barwright.catalog.base import PREDS  # noqa: E402


@query("lb13_residual_target", f"""WITH {PREDS}, b AS (SELECT sum(p3 * label) / sum(p3 * p3) AS beta FROM preds WHERE datetime < TIMESTAMP '1999-01-01')
   SELECT {KEY}, {r('beta')}, {r(clip_sql('label - beta * p3', 8.0), 'residual')} FROM preds, b""")
def _(t: Tables):
    train = train_rows()
    return out(labels.residual_target(t.preds, "p3", "label", train), ("beta", "residual"))


@query("lb14_residual_label", f"WITH {PREDS} SELECT {KEY}, {r(clip_sql('label - p3', 0.8), 'residual')} FROM preds")
def _(t: Tables):
    return out(t.preds.withColumn("residual", labels.residual_label("p3", "label", 0.8)), ("residual",))


@query("lb15_winsorised", f"""WITH {PREDS}, e AS (SELECT quantile_cont(label, 0.05) AS lo, quantile_cont(label, 0.95) AS hi FROM preds
     WHERE datetime < TIMESTAMP '1999-01-01'), x AS (SELECT *, least(greatest(label, lo), hi) AS tw FROM preds, e),
   m AS (SELECT avg(tw) AS m, stddev_pop(tw) AS s FROM x WHERE datetime < TIMESTAMP '1999-01-01')
   SELECT {KEY}, {r('tw', 'target_w')}, {r('(tw - m) / greatest(s, 1e-8)', 'target_std')} FROM x, m""")
def _(t: Tables):
    train = train_rows()
    return out(labels.winsorised_target(t.preds, "label", train, 0.05), ("target_w", "target_std"))
