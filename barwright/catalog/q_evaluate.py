"""Evaluation scores, join shapes, set shapes and ordered picks."""

from __future__ import annotations

from pyspark.sql import functions as F

from barwright.catalog.base import (BARS_D, KEY, PANEL_D, PREDS, ROWS, TRAIN, Tables, avg_rank, clip_sql, i, ic_sql, out, pct_rank, query, r, rs,
                                    train_rows, uniform_sql, z_sql)
from barwright.catalog.q_features import VARIANTS
from barwright.functions.expr import hash_uniform
from barwright.operators import evaluate as ev, relational as rel, views
from barwright.plans.xsec import scalars

IC = ic_sql("p1", "label")
NS = "(PARTITION BY symbol ORDER BY datetime)"


@query("ev01_pooled_ic", f"WITH {PREDS} SELECT {r(IC, 'ic', 6)}, count(*) AS n FROM preds")
def _(t: Tables):
    return out(ev.pooled_ic(t.preds, "p1"), ("ic", "n"), (), 6)


@query("ev02_monthly_ic", f"WITH {PREDS} SELECT month, {r(IC, 'ic', 6)}, count(*) AS n FROM preds GROUP BY month")
def _(t: Tables):
    return out(ev.ic_by_period(t.preds, "p1"), ("ic", "n"), ("month",), 6)


@query("ev02_yearly_ic", f"WITH {PREDS} SELECT strftime(datetime, '%Y') AS year, {r(IC, 'ic', 6)}, count(*) AS n FROM preds GROUP BY 1")
def _(t: Tables):
    return out(ev.ic_by_period(t.preds, "p1", period=F.date_format("datetime", "yyyy"), name="year"), ("ic", "n"), ("year",), 6)


@query("ev03_ic_summary", f"""WITH {PREDS}, m AS (SELECT month, {IC} AS ic, count(*) AS n FROM preds GROUP BY month)
   SELECT {r(f'(SELECT {IC} FROM preds)', 'ic', 6)}, {r('avg(ic)', 'monthly_mean', 6)}, {r('stddev_samp(ic)', 'monthly_std', 6)},
   {r('avg(ic) / stddev_samp(ic)', 'monthly_ir', 6)}, 1.0::DOUBLE AS coverage, sum(n)::BIGINT AS n,
   {', '.join(r(f"(SELECT {IC} FROM preds WHERE strftime(datetime, '%Y') = '{v}')", f'ic_{v}', 6) for v in (1996, 1999))} FROM m""")
def _(t: Tables):
    return out(ev.ic_summary(t.preds, "p1", years=("1996", "1999")),
               ("ic", "monthly_mean", "monthly_std", "monthly_ir", "coverage", "n", "ic_1996", "ic_1999"), (), 6)


def rank_ic_sql(part: str = "1") -> str:
    return f"SELECT *, {avg_rank('p1', part)} AS rp, {avg_rank('label', part)} AS ry FROM preds"


@query("ev04_rank_ic", f"WITH {PREDS}, k AS ({rank_ic_sql()}) SELECT {r('corr(rp, ry)', 'rank_ic', 6)}, count(*) AS n FROM k")
def _(t: Tables):
    return out(ev.rank_ic(t.preds, "p1"), ("rank_ic", "n"), (), 6)


@query("ev05_merged_ic", f"WITH {PREDS} SELECT {r('corr(p1, label)', 'merged_ic', 6)}, count(*) AS n FROM preds")
def _(t: Tables):
    return out(ev.merged_ic(t.preds, "p1"), ("merged_ic", "n"), (), 6)


@query("ev06_metric_by_symbol", f"WITH {PREDS}, k AS ({rank_ic_sql('symbol')}) SELECT symbol, count(*) AS n, {r(IC, 'ic', 6)}, {r('corr(rp, ry)', 'rank_ic', 6)} FROM k GROUP BY symbol")
def _(t: Tables):
    return out(ev.metric_by_group(t.preds, ["symbol"], "p1"), ("n", "ic", "rank_ic"), ("symbol",), 6)


@query("ev06_metric_by_month", f"WITH {PREDS}, k AS ({rank_ic_sql('month')}) SELECT month, count(*) AS n, {r(IC, 'ic', 6)}, {r('corr(rp, ry)', 'rank_ic', 6)} FROM k GROUP BY month")
def _(t: Tables):
    return out(ev.metric_by_group(t.preds, ["month"], "p1"), ("n", "ic", "rank_ic"), ("month",), 6)


VAR_OK = "CASE WHEN var_pop({a}) > 1e-18 AND var_pop({b}) > 1e-18 THEN corr({a}, {b}) END"


@query("ev07_ic_series", f"WITH {PREDS} SELECT strftime(datetime, '%Y-%m-%d') AS day, count(*) AS n, {r(VAR_OK.format(a='p1', b='label'), 'ic')} FROM preds GROUP BY datetime HAVING count(*) >= 6")
def _(t: Tables):
    s = ev.ic_series(t.preds, t.g, "p1", min_symbols=6).withColumn("day", F.date_format("datetime", "yyyy-MM-dd"))
    return out(s, ("n", "ic"), ("day",))


@query("ev07_rank_ic_series_stride", f"""WITH {PREDS}, k AS ({rank_ic_sql('datetime')}), s AS (SELECT datetime, count(*) AS n, {VAR_OK.format(a='rp', b='ry')} AS ic
   FROM k GROUP BY datetime HAVING count(*) >= 6), x AS (SELECT *, row_number() OVER (ORDER BY datetime) - 1 AS i FROM s)
   SELECT strftime(datetime, '%Y-%m-%d') AS day, n, {r('ic')} FROM x WHERE i % 5 = 0""")
def _(t: Tables):
    s = ev.ic_series(t.preds, t.g, "p1", min_symbols=6, rank=True, stride=5).withColumn("day", F.date_format("datetime", "yyyy-MM-dd"))
    return out(s, ("n", "ic"), ("day",))


@query("ev08_stride_ics", f"""WITH {PREDS}, a AS (SELECT *, p1 - avg(p1) OVER (PARTITION BY datetime, sector) AS sn FROM preds),
   x AS (SELECT datetime, corr(p1, label) AS raw, CASE WHEN sqrt(var_pop(sn) * var_pop(label)) > 1e-15 THEN corr(sn, label) END AS s,
         sqrt(var_pop(p1) * var_pop(label)) AS v, row_number() OVER (ORDER BY datetime) - 1 AS i FROM a GROUP BY datetime),
   y AS (SELECT *, CASE WHEN v > 1e-15 THEN raw END AS rr FROM x)
   SELECT {r(f'(SELECT {IC} FROM preds)', 'pooled_ic', 6)}, {r('avg(s) FILTER (WHERE i % 30 = 0)', 'sn_nonoverlap_ic', 6)}, {r('avg(rr) FILTER (WHERE i % 30 = 0)', 'raw_nonoverlap_ic', 6)},
   {r('avg(rr)', 'dense_cs_ic', 6)}, count(rr) FILTER (WHERE i % 30 = 0) AS n_nonoverlap, count(rr) AS n_dense FROM y""")
def _(t: Tables):
    return out(ev.stride_ics(t.preds, t.g, "p1"), ("pooled_ic", "sn_nonoverlap_ic", "raw_nonoverlap_ic", "dense_cs_ic", "n_nonoverlap", "n_dense"), (), 6)


SERIES = f"s AS (SELECT datetime, strftime(datetime, '%Y-%m') AS month, {VAR_OK.format(a='p1', b='label')} AS ic FROM preds GROUP BY datetime HAVING count(*) >= 6)"


def series(t: Tables):
    return ev.ic_series(t.preds, t.g, "p1", min_symbols=6)


@query("ev09_series_summary", f"WITH {PREDS}, {SERIES} SELECT month, count(ic) AS n, {r('avg(ic)', 'mean')}, {r('stddev_samp(ic)', 'std')}, {r('avg(ic) / nullif(stddev_samp(ic), 0)', 'icir')} FROM s GROUP BY month")
def _(t: Tables):
    return out(ev.summarise_series(series(t), ["month"]), ("n", "mean", "std", "icir"), ("month",))


@query("ev10_newey_west", f"""WITH {PREDS}, {SERIES}, x AS (SELECT ic - avg(ic) OVER () AS a, avg(ic) OVER () AS mu, count(*) OVER () AS n, row_number() OVER (ORDER BY datetime) AS i FROM s WHERE ic IS NOT NULL),
   g AS (SELECT a, mu, n, {', '.join(f'lag(a, {k}) OVER (ORDER BY i) AS a{k}' for k in range(1, 6))} FROM x),
   v AS (SELECT any_value(mu) AS mean, any_value(n) AS n, avg(a * a) + {' + '.join(f'2 * (1 - {k} / 6.0) * (sum(a * a{k}) / (any_value(n) - {k}))' for k in range(1, 6))} AS v FROM g)
   SELECT n, {r('mean', 'mean', 6)}, {r('mean / sqrt(greatest(v, 1e-18) / n)', 't_stat')} FROM v""")
def _(t: Tables):
    d = ev.newey_west(series(t))
    return out(d, ("t_stat",), ()).transform(scalars(out(d, ("n", "mean"), (), 6)))


BLOCK = 20
@query("ev11_bootstrap_ci", f"""WITH {PREDS}, {SERIES}, x AS (SELECT ic, row_number() OVER (ORDER BY datetime) - 1 AS i, count(*) OVER () AS n FROM s WHERE ic IS NOT NULL),
   c AS (SELECT i, sum(ic) OVER (ORDER BY i) AS cum FROM x), nn AS (SELECT max(n) AS n FROM x),
   g AS (SELECT d, b, n, floor({uniform_sql(11, 'd', 'b')} * n)::BIGINT AS st FROM nn, range(200) t(d), LATERAL (SELECT unnest(range(ceil(n / {BLOCK}.0)::BIGINT)) AS b)),
   h AS (SELECT *, least(st + {BLOCK}, n) AS en FROM g),
   m AS (SELECT d, sum(e.cum - coalesce(f.cum, 0)) / sum(en - st) AS m FROM h JOIN c e ON e.i = en - 1 LEFT JOIN c f ON f.i = st - 1 GROUP BY d)
   SELECT (SELECT n FROM nn) AS n, {r('quantile_cont(m, 0.025)', 'lo', 6)}, {r('quantile_cont(m, 0.975)', 'hi', 6)} FROM m""")
def _(t: Tables):
    return out(ev.bootstrap_ci(series(t), draws=200), ("n", "lo", "hi"), (), 6)


def _sn_series(rank: bool) -> str:
    base = VARIANTS
    a, b = ("rp", "ry") if rank else ("snz", "label")
    k = f", k AS (SELECT *, {avg_rank('snz', 'datetime')} AS rp, {avg_rank('label', 'datetime')} AS ry FROM v1 WHERE snz IS NOT NULL)"
    return f"{base}{k}, s AS (SELECT datetime, {VAR_OK.format(a=a, b=b)} AS ic, row_number() OVER (ORDER BY datetime) - 1 AS i FROM k GROUP BY datetime HAVING count(*) >= 6)"


@query("ev12_bundle_sn_rank", f"WITH {_sn_series(True)} SELECT count(ic) AS n, {r('avg(ic)', 'mean', 5)}, {r('stddev_samp(ic)', 'std', 5)} FROM s WHERE i % 10 = 0")
def _(t: Tables):
    b = ev.evaluation_bundle(t.preds, t.g, "p1", min_symbols=6, stride=10, sectors=False)
    return out(b["metrics"].where("metric = 'nonoverlap_sector_neutral_cs_rankic'"), ("n", "mean", "std"), (), 5)


@query("ev12_bundle_monthly", f"WITH {_sn_series(False)} SELECT strftime(datetime, '%Y-%m') AS month, count(ic) AS n, {r('avg(ic)', 'mean')} FROM s WHERE i % 10 = 0 GROUP BY 1")
def _(t: Tables):
    return out(ev.evaluation_bundle(t.preds, t.g, "p1", min_symbols=6, stride=10, sectors=False)["monthly"], ("n", "mean"), ("month",))


@query("ev12_bundle_sector", f"""WITH {VARIANTS}, v2 AS (SELECT *, round(snz, 9) + 0.0 AS sr FROM v1), k AS (SELECT *, {avg_rank('sr', 'sector')} AS rp, {avg_rank('label', 'sector')} AS ry FROM v2 WHERE snz IS NOT NULL)
   SELECT sector, count(*) AS n, {r(VAR_OK.format(a='snz', b='label'), 'merged_ic', 6)}, {r('CASE WHEN var_pop(rp) > 1e-18 THEN corr(rp, ry) END', 'rank_ic', 5)} FROM k GROUP BY sector""")
def _(t: Tables):
    b = ev.evaluation_bundle(t.preds, t.g, "p1", min_symbols=6, stride=10)["sector"]
    return out(b, ("n", "merged_ic"), ("sector",), 6).join(out(b, ("rank_ic",), ("sector",), 5), "sector")


@query("ev13_cross_section_summary", f"""WITH {PREDS}, s AS (SELECT {IC} AS ic FROM preds GROUP BY datetime HAVING count(*) >= 6)
   SELECT {r('avg(ic)', 'mean')}, {r('stddev_samp(ic)', 'std')}, {r('avg(ic) / stddev_samp(ic)', 'ir')}, {r('avg((ic > 0)::INT)', 'positive_frac')}, count(ic) AS n FROM s""")
def _(t: Tables):
    return out(ev.cross_section_summary(t.preds, t.g, "p1", min_count=6), ("mean", "std", "ir", "positive_frac", "n"), ())


@query("ev14_bin_returns", f"""WITH {PREDS}, b AS (SELECT label, row_number() OVER (PARTITION BY datetime ORDER BY p1, {uniform_sql(0, 'symbol')}, symbol) / count(*) OVER (PARTITION BY datetime)::DOUBLE AS s FROM preds)
   SELECT least(floor(s * 20), 19)::BIGINT + 1 AS bin, {r('avg(label)', 'mean_return')}, count(*) AS rows FROM b GROUP BY 1""")
def _(t: Tables):
    return out(ev.bin_returns(t.preds, t.g, "p1"), ("mean_return", "rows"), ("bin",))


@query("ev15_quantile_bins", f"""WITH {PREDS}, e AS (SELECT quantile_cont(p2, [{', '.join(f'{k / 30!r}' for k in range(31))}]) AS e FROM preds), d AS (SELECT list_distinct(e) AS e FROM e)
   SELECT greatest(len(list_filter(e, lambda v: v < p2)), 1)::BIGINT AS bin, {r('avg(p2)', 'pred')}, {r('avg(label)', 'label')}, count(*) AS n FROM preds, d GROUP BY 1""")
def _(t: Tables):
    return out(ev.quantile_bins(t.preds, "p2"), ("pred", "label", "n"), ("bin",))


@query("ev16_histogram", f"""WITH {PREDS}, e AS (SELECT min(p2) AS lo, max(p2) AS hi FROM preds), b AS (SELECT least(floor((p2 - lo) / (hi - lo) * 40), 39)::BIGINT AS bin, lo, hi FROM preds, e)
   SELECT bin, {r('any_value(lo) + (any_value(hi) - any_value(lo)) * bin / 40', 'left_edge')}, count(*) AS n FROM b GROUP BY bin""")
def _(t: Tables):
    return out(ev.histogram(t.preds, "p2", 40), ("left_edge", "n"), ("bin",))


@query("ev17_weekly_cumulative", f"""WITH {PREDS}, w AS (SELECT strftime(date_trunc('week', datetime), '%Y-%m-%d') AS week, {IC} AS ic, count(*) AS n FROM preds GROUP BY 1)
   SELECT week, {r('ic', 'ic', 5)}, n, {r('sum(ic) OVER (ORDER BY week)', 'cum_ic', 5)} FROM w""")
def _(t: Tables):
    return out(ev.weekly_cumulative(t.preds, "p1"), ("ic", "n", "cum_ic"), ("week",), 5)


def _xsz_ic(x: str) -> str:
    return f"SELECT '{x}' AS factor, round(sum(z * label) / sqrt(sum(z * z) * sum(label * label)), 6) AS ic FROM (SELECT *, {z_sql(x, 'datetime', '1e-9')} AS z, count(*) OVER (PARTITION BY datetime) AS m FROM preds) WHERE m >= 2"


@query("ev18_xsz_ic", f"WITH {PREDS} " + " UNION ALL ".join(_xsz_ic(x) for x in ("p1", "p2", "p3")))
def _(t: Tables):
    return out(ev.xsz_ic(t.preds, t.g, ("p1", "p2", "p3")), ("ic",), ("factor",), 6)


EXT = "ext AS (SELECT symbol, datetime, p1 AS pred FROM preds WHERE symbol <> 'S3'), al AS (SELECT p.symbol, p.datetime, p.label, coalesce(e.pred, 0) AS pred, (e.pred IS NULL) AS missing FROM preds p LEFT JOIN ext e USING (symbol, datetime))"


@query("ev19_align_audit", f"""WITH {PREDS}, {EXT}, m AS (SELECT strftime(datetime, '%Y-%m') AS month, {ic_sql('pred', 'label')} AS ic FROM al GROUP BY 1)
   SELECT {r(f"(SELECT {ic_sql('pred', 'label')} FROM al)", 'ic', 6)}, {r('avg(ic)', 'monthly_mean', 6)}, {r('stddev_samp(ic)', 'monthly_std', 6)}, (SELECT sum(missing::INT) FROM al)::BIGINT AS missing_filled,
   (SELECT count(*) FROM al) AS rows FROM m""")
def _(t: Tables):
    ext = t.preds.where("symbol <> 'S3'").select("symbol", "datetime", F.col("p1").alias("pred"))
    return out(ev.audit(ev.align_external(t.preds, ext)), ("ic", "monthly_mean", "monthly_std", "missing_filled", "rows"), (), 6)


def _gate_row(x: str) -> str:
    return f"SELECT '{x}' AS name, {ic_sql(x, 'label')} AS ic, corr({x}, label) AS merged FROM preds"


@query("ev20_keep_gate", f"""WITH {PREDS}, m AS ({' UNION ALL '.join(_gate_row(x) for x in ('p1', 'p2', 'p3'))}), b AS (SELECT * FROM m WHERE name = 'p1')
   SELECT m.name, {r('m.ic', 'ic', 6)}, {r('m.merged', 'merged', 6)}, CASE WHEN m.ic > b.ic AND m.merged > b.merged THEN 'keep' ELSE 'reject' END AS decision FROM m, b WHERE m.name <> 'p1'""")
def _(t: Tables):
    rows = F.array(*[F.struct(F.lit(x).alias("name"), F.col(f"i_{x}").alias("ic"), F.col(f"m_{x}").alias("merged")) for x in ("p1", "p2", "p3")])
    one = t.preds.agg(*[e for x in ("p1", "p2", "p3") for e in (ev.ic(x, "label").alias(f"i_{x}"), ev.pearson(x, "label").alias(f"m_{x}"))])
    return out(ev.keep_gate(one.select(F.inline(rows)), "p1", "ic", "merged"), ("ic", "merged", "decision"), ("name",), 6)


def _hub(p: str, y: str) -> str:
    return f"CASE WHEN abs({p} - {y}) <= 1 THEN 0.5 * ({p} - {y}) ^ 2 ELSE abs({p} - {y}) - 0.5 END"


@query("ev21_huber", f"""WITH {PREDS} SELECT {r(f"(sum({_hub('p1', 'label')}) + 0.5 * sum(CASE WHEN p2 > 0 THEN {_hub('p3', 'label')} ELSE 0 END)) / (count(*) + 0.5 * sum((p2 > 0)::INT))", 'huber', 5)} FROM preds""")
def _(t: Tables):
    d = t.preds.withColumns({"m1": F.lit(True), "m2": F.col("p2") > 0})
    return out(ev.huber(d, (("p1", "label", "m1", 1.0), ("p3", "label", "m2", 0.5))), ("huber",), (), 5)


@query("ev21_tail_mse", f"""WITH {PREDS}, e AS (SELECT (p3 - label) * (p3 - label) AS e, row_number() OVER (ORDER BY (p3 - label) * (p3 - label) DESC) AS k, count(*) OVER () AS n FROM preds)
   SELECT {r('avg(e)', 'tail_mse')} FROM e WHERE k <= ceil(0.1 * n)""")
def _(t: Tables):
    return out(ev.tail_mse(t.preds, "p3", "label", 0.1), ("tail_mse",), ())


@query("ev21_group_losses", f"""WITH {PREDS}, a AS (SELECT p1 - avg(p1) OVER w AS p, label - avg(label) OVER w AS y, stddev_pop(p1) OVER w AS sp, stddev_pop(label) OVER w AS sy, avg(p1) OVER w AS mp, avg(label) OVER w AS my,
     datetime, count(*) OVER w AS n FROM preds WINDOW w AS (PARTITION BY datetime)),
   g AS (SELECT avg((p / (sp + 1e-8) - y / (sy + 1e-8)) ^ 2) AS s, avg((p - y) ^ 2) AS c, any_value((mp - my) ^ 2) AS m FROM a WHERE n >= 6 GROUP BY datetime)
   SELECT {r('avg(s)', 'standardised_mse')}, {r('avg(c)', 'centred_mse')}, {r('avg(m)', 'mean_mse')} FROM g""")
def _(t: Tables):
    return out(ev.group_losses(t.preds, "p1", "label", 6), ("standardised_mse", "centred_mse", "mean_mse"), ())


# ---- joins, sets, ordered picks ---------------------------------------------------------------------------
@query("jn01_components", f"""WITH {PREDS} SELECT {KEY}, {rs(('p1', 'p2', 'p3'))} FROM (SELECT symbol, datetime, p1 FROM preds) JOIN (SELECT symbol, datetime, p2 FROM preds) USING (symbol, datetime)
   JOIN (SELECT symbol, datetime, p3 FROM preds) USING (symbol, datetime)""")
def _(t: Tables):
    f = [t.preds.select("symbol", "datetime", "p1"), t.preds.select("symbol", "datetime", "p2"), t.preds.select("symbol", "datetime", "p3")]
    return out(rel.join_components(f), ("p1", "p2", "p3"))


@query("jn02_checked_left", f"WITH {PREDS} SELECT {KEY}, {r('p1')}, {r('CASE WHEN p2 > 0 THEN p2 END', 'q')} FROM preds")
def _(t: Tables):
    right = t.preds.where("p2 > 0").select("symbol", "datetime", F.col("p2").alias("q"))
    return out(rel.checked_left_join(t.preds.select("symbol", "datetime", "p1"), right), ("p1", "q"))


@query("jn03_lookup_default", f"WITH {PREDS}, m AS (SELECT sector, avg(p1) AS mult FROM preds WHERE sector <> 'sector2' GROUP BY sector) SELECT {KEY}, {r('p1 * coalesce(mult, 1.0)', 'scaled')} FROM preds LEFT JOIN m USING (sector)")
def _(t: Tables):
    m = t.preds.where("sector <> 'sector2'").groupBy("sector").agg(F.avg("p1").alias("mult"))
    return out(rel.lookup(t.preds, m, ["sector"], "mult", 1.0).withColumn("scaled", F.col("p1") * F.col("mult")), ("scaled",))


STRIDE = "ts AS (SELECT datetime FROM (SELECT datetime, row_number() OVER (ORDER BY datetime) - 1 AS i FROM (SELECT DISTINCT datetime FROM preds)) WHERE i % 7 = 0)"


@query("jn04_sr03_stride_semi", f"WITH {PREDS}, {STRIDE} SELECT {KEY}, {r('p1')} FROM preds WHERE datetime IN (SELECT datetime FROM ts)")
def _(t: Tables):
    return out(rel.every_kth_time(t.preds, 7), ("p1",))


@query("jn05_anti", f"WITH {PREDS} SELECT {KEY}, {r('p1')} FROM preds WHERE symbol NOT IN ('S1', 'S2')")
def _(t: Tables):
    drop = t.preds.select("symbol").distinct().where("symbol IN ('S1', 'S2')")
    return out(t.preds.join(drop, "symbol", "left_anti"), ("p1",))


@query("jn06_prior_months", f"""WITH {PREDS}, m AS (SELECT month, sum(p1 * label) AS xy, sum(p1 * p1) AS xx, count(*) AS n FROM preds GROUP BY month), s AS (SELECT DISTINCT month AS split FROM preds)
   SELECT split, {r('coalesce(sum(xy), 0)', 'xy')}, {r('coalesce(sum(xx), 0)', 'xx')}, {i('coalesce(sum(n), 0)', 'n')} FROM s LEFT JOIN m ON m.month < split AND m.month >= strftime((split || '-01')::DATE - INTERVAL 6 MONTH, '%Y-%m') GROUP BY split""")
def _(t: Tables):
    st = t.preds.groupBy("month").agg(F.sum(F.col("p1") * F.col("label")).alias("xy"), F.sum(F.col("p1") * F.col("p1")).alias("xx"), F.count(F.lit(1)).alias("n"))
    sp = t.preds.select(F.col("month").alias("split")).distinct().select(
        "split", F.col("split").alias("eval_start"), F.date_format(F.add_months(F.concat("split", F.lit("-01")).cast("date"), -6), "yyyy-MM").alias("tr_start"))
    return out(rel.prior_sums(st, sp, ("xy", "xx", "n")).na.fill(0), ("xy", "xx", "n"), ("split",))


@query("jn07_market_state", f"""WITH {PREDS}, st AS (SELECT symbol, datetime, (high - low) / close AS state_range, ln(1 + volume) AS state_logvol, close / lag(close) OVER {NS} - 1 AS state_ret1 FROM panel)
   SELECT p.symbol, strftime(p.datetime, '%Y-%m-%d %H:%M') AS dt, {r('p1')}, {rs(('state_range', 'state_logvol', 'state_ret1'))} FROM preds p LEFT JOIN st USING (symbol, datetime)""")
def _(t: Tables):
    return out(rel.attach_state(t.preds.select("symbol", "datetime", "p1"), t.d, ROWS), ("p1", "state_range", "state_logvol", "state_ret1"))


@query("jn08_union_libraries", f"WITH {PREDS} SELECT {KEY}, {rs(('p1', 'p2'))}, {r('p3', 'mined_p1')} FROM preds")
def _(t: Tables):
    a, b = t.preds.select("symbol", "datetime", "p1", "p2"), t.preds.select("symbol", "datetime", F.col("p3").alias("p1"))
    return out(rel.union_libraries(a, b), ("p1", "p2", "mined_p1"))


@query("jn09_key_alignment", f"WITH {PREDS} SELECT {KEY}, 'left' AS side FROM preds WHERE p1 <= 0 AND p2 > 0 UNION ALL SELECT {KEY}, 'right' FROM preds WHERE p1 > 0 AND p2 <= 0")
def _(t: Tables):
    return out(rel.same_keys(t.preds.where("p2 > 0"), t.preds.where("p1 > 0")), ("side",))


@query("jn10_lookup_chain", f"""WITH {PREDS}, a AS (SELECT symbol, month, avg(label) AS v FROM preds WHERE {TRAIN} GROUP BY 1, 2), b AS (SELECT symbol, avg(label) AS v FROM preds WHERE {TRAIN} AND symbol <> 'S4' GROUP BY 1),
   c AS (SELECT sector, avg(label) AS v FROM preds WHERE {TRAIN} GROUP BY 1)
   SELECT {KEY}, {r('coalesce(a.v, b.v, c.v, 0)', 'memory')} FROM preds p LEFT JOIN a USING (symbol, month) LEFT JOIN b USING (symbol) LEFT JOIN c USING (sector)""".replace("SELECT symbol, strftime(datetime", "SELECT p.symbol AS symbol, strftime(p.datetime"))
def _(t: Tables):
    d = t.preds.where(train_rows())
    tabs = [(d.groupBy("symbol", "month").agg(F.avg("label").alias("v")), ("symbol", "month")),
            (d.where("symbol <> 'S4'").groupBy("symbol").agg(F.avg("label").alias("v")), ("symbol",)),
            (d.groupBy("sector").agg(F.avg("label").alias("v")), ("sector",))]
    return out(rel.lookup_chain(t.preds, tabs, "v", "memory", 0.0), ("memory",))


@query("st01_union_parts", f"WITH {PREDS} SELECT {KEY}, {r('p1')} FROM preds")
def _(t: Tables):
    a, b = t.preds.where("month < '1998-06'").select("symbol", "datetime", "p1"), t.preds.where("month >= '1998-06'").select("p1", "datetime", "symbol")
    return out(a.unionByName(b), ("p1",))


NAMES = "a AS (SELECT DISTINCT symbol AS factor, substr(symbol, 2)::BIGINT AS pos FROM preds WHERE p1 > 1), b AS (SELECT DISTINCT symbol AS factor, 100 - substr(symbol, 2)::BIGINT AS pos FROM preds WHERE p2 < -2)"


def _names(t: Tables):
    n = F.substring("symbol", 2, 9).cast("long")
    return (t.preds.where("p1 > 1").select(F.col("symbol").alias("factor"), n.alias("pos")).distinct(),
            t.preds.where("p2 < -2").select(F.col("symbol").alias("factor"), (F.lit(100) - n).alias("pos")).distinct())


@query("st02_feature_union", f"WITH {PREDS}, {NAMES} SELECT factor, 0::BIGINT AS list, pos FROM a UNION ALL SELECT factor, 1, pos FROM b WHERE factor NOT IN (SELECT factor FROM a)")
def _(t: Tables):
    return out(rel.set_of_names(*_names(t), "union"), ("list", "pos"), ("factor",))


@query("st02_feature_intersect", f"WITH {PREDS}, {NAMES} SELECT factor, pos FROM a WHERE factor IN (SELECT factor FROM b)")
def _(t: Tables):
    return out(rel.set_of_names(*_names(t), "intersect"), ("pos",), ("factor",))


@query("st03_distinct", f"WITH {PREDS} SELECT DISTINCT symbol, month FROM preds")
def _(t: Tables):
    return t.preds.select("symbol", "month").distinct()


@query("sr01_top_n", f"WITH {PREDS} SELECT {KEY}, {r('p1')} FROM preds ORDER BY abs(p1) DESC, symbol, datetime LIMIT 50")
def _(t: Tables):
    return out(t.preds.orderBy(F.abs("p1").desc(), "symbol", "datetime").limit(50), ("p1",))


@query("sr02_drop_tail", f"WITH {PANEL_D} SELECT {KEY}, {i('bar_no')} FROM panel WHERE symbol_bars - 1 - bar_no >= 25")
def _(t: Tables):
    return out(rel.drop_tail(t.d, 25), ("bar_no",))


@query("uv01_unique_visitors", """WITH v AS (SELECT strftime(ts, '%Y-%m-%d') AS day, substr(sha256('pepper|' || user_id), 1, 16) AS h FROM events),
   f AS (SELECT h, min(day) AS day FROM v GROUP BY h), n AS (SELECT day, count(*) AS k FROM f GROUP BY day),
   d AS (SELECT day, count(*) AS visits, count(DISTINCT h) AS unique_visitors FROM v GROUP BY day)
   SELECT day, visits, unique_visitors, coalesce(k, 0)::BIGINT AS new_visitors, (sum(coalesce(k, 0)) OVER (ORDER BY day))::BIGINT AS total FROM d LEFT JOIN n USING (day)""")
def _(t: Tables):
    return out(rel.unique_visitors(t.table("events"), "pepper", "user_id", "ts"), ("visits", "unique_visitors", "new_visitors", "total"), ("day",))
