"""Crosses, pattern search, simulation, overfitting and models as queries (state machines and models without SQL twins)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import crosses, folds, models, simulate, validate
from barloom.plans import features, relational
from barloom.plans.relational import f32
from barloom.session import stored
from barloom.sources.bars import DUCK_BARS, bars

ROW = ["series", "us"]
#: The features crossed: query -> (its column, name of the feature). Names decide the signal group.
CROSSED = {
    "ta_exponential": (("rsi_14", "rsi_14"), ("macd_histogram", "macd_histogram"), ("close_vs_ema_50", "close_vs_ema_50"), ("rsi_14_ob", "rsi_14_ob"), ("rsi_14_os", "rsi_14_os")),
    "ta_bands": (("stoch_k_14", "stoch_k_14"), ("cci_20", "cci_20"), ("bb_pctb_20", "bb_pctb_20"), ("bb_width_20", "bb_width_20")),
    "ta_ranges": (("atr_14_pct", "atr_14_pct"), ("supertrend_bullish", "supertrend_bullish")),
    "ta_volume": (("volume_ratio", "volume_ratio"), ("mfi_14", "mfi_14"), ("obv_trend", "obv_trend")),
    "sky": (("phase_i", "moon_phase"), ("double_power", "planetary_hour_double"), ("tzolkin_i", "tzolkin_sign")),
    "calendar_numerology": (("price_dr_i", "price_dr"), ("date_dr_i", "dr_date"), ("price_is_master", "price_master"), ("day_13", "contains_13")),
    "layer_price_numbers": (("price_angel", "price_angel"), ("price_near_round", "price_near_round")),
    "layer_sessions": (("session_asia", "session_asia"), ("session_london", "session_london"), ("session_ny", "session_ny")),
    "macro_columns": (("macro_vix_roc_5", "vix_roc_5"), ("macro_dxy_roc_5", "dxy_roc_5"), ("spx_corr_20", "spx_corr_20")),
    "flow_columns": (("funding_z30", "funding_z30"), ("liq_z", "liq_z"), ("whale_z", "whale_z"), ("fg_f", "fear_greed")),
    "layer_regimes": (("regime_i", "regime_state"),),
    "ephemeris_columns": (("asp_hard", "asp_hard"), ("asp_soft", "asp_soft"), ("moon_fire", "moon_fire"), ("moon_earth", "moon_earth"), ("moon_air", "moon_air"), ("moon_water", "moon_water"), ("kp_max", "kp_max"), ("tithi", "tithi")),
}
NAMES = [n for cs in CROSSED.values() for _, n in cs]
_ALL = lambda: features.QUERIES | relational.QUERIES


def crossed_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a bar with every feature of CROSSED, stored."""
    out = None
    for q, cs in CROSSED.items():
        part = _ALL()[q](spark, sf_dir).select(*ROW, *(F.col(c).cast("double").alias(n) for c, n in cs))
        out = part if out is None else out.join(part, ROW, "left")
    return stored(out)


def _crossing(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list, dict[int, str]]:
    wide = crossed_features(spark, sf_dir)
    contexts = crosses.binarise(wide, NAMES)
    doy, regime = F.dayofyear(F.timestamp_micros("us")), F.when(F.col("regime_state") == 1, 1).when(F.col("regime_state") == 2, 2).otherwise(0)
    rows = crosses.sides(wide, contexts, ROW, doy, regime)
    combos: dict[int, str] = {}
    known = {c.id: c.name for c in contexts}
    for name, group, tag, most, first, start in (("astro_pairs", "astro", "a2", 50, None, crosses.PAIR), ("ta_pairs", "ta", "ta2", 30, 60, crosses.PAIR + 1000)):
        pairs = crosses.pair_combos(rows, group, contexts, most, first)
        rows = crosses.with_pairs(rows, name, group, pairs, start)
        combos |= {start + i: f"{tag}_{known[a][:15]}_{known[b][:15]}" for i, (a, b) in enumerate(pairs)}
    return rows, contexts, combos


def cross_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Support and group of every binarised context."""
    rows, contexts, _ = _crossing(spark, sf_dir)
    table = spark.createDataFrame([(c.id, c.name, c.group) for c in contexts], "ctx_id int, ctx string, signal_group string")
    n = rows.select(F.explode("all").alias("ctx_id")).groupBy("ctx_id").agg(F.count(F.lit(1)).alias("n"))
    return n.join(F.broadcast(table), "ctx_id").select("ctx", "signal_group", "n")


def cross_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of the thirteen families that holds on at least three rows, with its support."""
    rows, contexts, combos = _crossing(spark, sf_dir)
    return crosses.named(crosses.supports(rows), contexts, combos)


def cross_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One column a cut name, the first pair in the families' order keeps it; how many pairs share the name."""
    rows, contexts, combos = _crossing(spark, sf_dir)
    pairs = crosses.supports(rows)
    at = F.struct(F.col("family").alias("k"), F.col("l").alias("a"), F.col("r").alias("b"))
    n = crosses.named(pairs.withColumn("at", at), contexts, combos)
    return n.groupBy("cross").agg(F.min_by("n", "at").alias("n"), F.count(F.lit(1)).alias("pairs"))


def cross_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supported crosses that hold on each series' last bar; names cut to 40 characters as offline."""
    rows, contexts, combos = _crossing(spark, sf_dir)
    rows = stored(rows)
    last = rows.groupBy("series").agg(F.max(F.struct("us", *[c for c in rows.columns if c not in ROW])).alias("_r")).select("series", "_r.*")
    live = last.select(*ROW, F.inline(crosses.all_pairs()))
    return crosses.named(live.join(crosses.supports(rows), ["family", "l", "r"]), contexts, combos).select(*ROW, "family", "cross", "n")


def pattern_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.pattern_columns(bars(spark, sf_dir))


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series with the regime's size multiplier."""
    return simulate.prepared(bars(spark, sf_dir), relational.QUERIES["layer_regimes"](spark, sf_dir))


def simulated_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate.trade_log(_series(spark, sf_dir))


def grid_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four winners a series over the whole grid of seven parameters (1,296 sets)."""
    return simulate.winners(simulate.grid_results(_series(spark, sf_dir)))


def genetic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate.genetic_search(_series(spark, sf_dir))


def portfolio_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simulated trades of every collector's series as one portfolio under the portfolio rules."""
    trades = simulate.trade_log(_series(spark, sf_dir)).withColumn("collector", F.split_part("series", F.lit(":"), F.lit(1)))
    return simulate.portfolio(trades, "collector")


def knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.knn_patterns(bars(spark, sf_dir))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Barrier labels with the uniqueness of their intervals."""
    q = relational.QUERIES
    return q["labels_triple_barrier"](spark, sf_dir).join(q["sample_uniqueness"](spark, sf_dir), ["series", "us"], "left")


def knn_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pattern search's answer for the last bar of every series."""
    got = knn(spark, sf_dir)
    rest = [c for c in got.columns if c not in ("series", "us")]
    return got.groupBy("series").agg(F.max(F.struct("us", *rest)).alias("_l")).select("series", "_l.*")


def overfitting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of backtest overfitting over months as paths: mean return in the first and second half of each month."""
    b = bars(spark, sf_dir)
    from pyspark.sql import Window

    w = Window.partitionBy("series").orderBy("us")
    r = b.select("tf", "symbol", F.timestamp_micros("us").alias("ts"), (F.col("close") / F.lag("close").over(w) - 1).alias("ret")).where("abs(ret) < 0.5")
    half = F.when(F.dayofmonth("ts") <= 15, "a").otherwise("b")
    per = r.groupBy(F.col("tf").alias("metric"), F.date_format("ts", "yyyy-MM").alias("path")).agg(
        F.round(F.avg(F.when(half == "a", F.col("ret"))), 9).alias("in_sample"), F.round(F.avg(F.when(half == "b", F.col("ret"))), 9).alias("out_sample")
    )
    out = validate.overfitting(per.where("in_sample is not null and out_sample is not null"))
    return out.select("metric", F.col("pbo").cast("float").cast("double").alias("pbo"), F.col("mean_logit").cast("float").cast("double").alias("mean_logit"), "verdict")


def _cross_sql() -> str:
    """CTEs up to `pairs` (family, k, l, r, left, right, n) from the features' own SQL."""
    sql = features.SQL | relational.SQL
    subs = [f"s{i} AS MATERIALIZED (SELECT series, us, {', '.join(f'CAST({c} AS DOUBLE) AS {n}' for c, n in cs)} FROM ({sql[q]}))" for i, (q, cs) in enumerate(CROSSED.items())]
    wide = "wide AS MATERIALIZED (SELECT * FROM s0 " + " ".join(f"LEFT JOIN s{i} USING (series, us)" for i in range(1, len(CROSSED))) + ")"
    tall = "tall AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT series, us, {i} AS ord, '{n}' AS feature, {n} AS value FROM wide WHERE {n} IS NOT NULL" for i, n in enumerate(NAMES)) + ")"
    groups = "CASE " + " ".join(f"WHEN {' OR '.join(f"contains(lower(name), '{k}')" for k in keys.split())} THEN '{g}'" for g, keys in crosses.GROUPS) + " ELSE 'ta' END"
    tags = " UNION ALL ".join(f"SELECT t.series, t.us, t.ord * 4 + {i} AS c, t.feature || '{tag}' AS name FROM tall t JOIN stats s USING (feature) WHERE s.kinds > 3 AND s.live > 100 AND t.value {'>' if i < 2 else '<'} s.q[{i + 1}]" for i, tag in enumerate(crosses.TAGS))
    base = f"""{', '.join(subs)}, {wide}, {tall},
stats AS (SELECT feature, count(DISTINCT value) AS kinds, count(CASE WHEN value <> 0 THEN 1 END) AS live, quantile_cont(CASE WHEN value <> 0 THEN value END, {list(crosses.QUANTILES)}) AS q FROM tall GROUP BY feature),
hits AS ({tags} UNION ALL SELECT t.series, t.us, t.ord * 4, t.feature FROM tall t JOIN stats s USING (feature) WHERE s.kinds IN (2, 3) AND t.value > 0),
kept AS (SELECT c, name, count(*) AS n, {groups} AS grp FROM hits GROUP BY c, name HAVING count(*) > 5 AND (regexp_matches(name, '_(XH|H|L|XL)$') OR count(*) < 0.98 * (SELECT count(*) FROM wide))),
ctx AS MATERIALIZED (SELECT h.series, h.us, h.c, h.name, k.grp FROM hits h JOIN kept k USING (c)),
bars_doy AS (SELECT series, us, dayofyear(make_timestamp(us)) AS d, CASE regime_state WHEN 1 THEN 'B' WHEN 2 THEN 'R' ELSE 'S' END AS g FROM wide),
days AS MATERIALIZED (SELECT series, us, ((d - 1 + x) % 365 + 365) % 365 + 1 AS d, g FROM bars_doy, (SELECT unnest([-2, -1, 0, 1, 2]) AS x)),
doy AS (SELECT series, us, {crosses.DOY} + d AS c, 'doy_' || d AS name FROM days),
rdoy AS (SELECT series, us, {crosses.REGIME_DOY} + 1000 * (CASE g WHEN 'S' THEN 0 WHEN 'B' THEN 1 ELSE 2 END) + d AS c, 'doy_' || g || '_' || d AS name FROM days)"""
    for name, group, tag, most, first, start in (("astro_pairs", "astro", "a2", 50, 10**6, crosses.PAIR), ("ta_pairs", "ta", "ta2", 30, 60, crosses.PAIR + 1000)):
        base += f""",
{name}_k AS (SELECT c, row_number() OVER (ORDER BY c) AS rn FROM kept WHERE grp = '{group}'),
{name}_n AS (SELECT a.c AS a, b.c AS b, '{tag}_' || left(min(a.name), 15) || '_' || left(min(b.name), 15) AS name FROM ctx a JOIN ctx b ON a.series = b.series AND a.us = b.us AND a.c < b.c
 WHERE a.c IN (SELECT c FROM {name}_k WHERE rn <= {first}) AND b.c IN (SELECT c FROM {name}_k WHERE rn <= {first}) GROUP BY 1, 2 HAVING count(*) >= 2 ORDER BY 1, 2 LIMIT {most}),
{name} AS (SELECT a.series, a.us, {start} - 1 + n.rn AS c, n.name FROM (SELECT *, row_number() OVER (ORDER BY a, b) AS rn FROM {name}_n) n JOIN ctx a ON a.c = n.a JOIN ctx b ON b.c = n.b AND a.series = b.series AND a.us = b.us)"""
    side = lambda s: {"*": "SELECT series, us, c, name FROM ctx", "doy": "SELECT * FROM doy", "regime_doy": "SELECT * FROM rdoy"}.get(s, f"SELECT * FROM {s}" if s.endswith("_pairs") else f"SELECT series, us, c, name FROM ctx WHERE grp = '{s}'")
    both = " UNION ALL ".join(
        f"SELECT {k} AS k, '{p}' AS family, l.c AS l, r.c AS r, min(l.name) AS \"left\", min(r.name) AS \"right\", count(*) AS n FROM ({side(left)}) l JOIN ({' UNION ALL '.join(side(x) for x in right)}) r ON l.series = r.series AND l.us = r.us GROUP BY l.c, r.c HAVING count(*) >= 3"
        for k, (p, left, right) in enumerate(crosses.FAMILIES)
    )
    return f"WITH {base}, pairs AS ({both}), named AS (SELECT *, family || '_' || left(\"left\", 40) || '_' || left(\"right\", 40) AS \"cross\" FROM pairs)"


def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overfitting probability and deflated Sharpe ratio together: deploy only if both agree."""
    o = overfitting(spark, sf_dir).withColumnRenamed("verdict", "pbo_verdict")
    s = relational.QUERIES["deflated_sharpe"](spark, sf_dir).withColumnRenamed("tf", "metric")
    sound = F.col("p_value") < 0.05
    verdict = F.when((F.col("pbo_verdict") == "DEPLOY") & sound, "DEPLOY").when((F.col("pbo_verdict") == "REJECT") | ~sound, "REJECT").otherwise("INVESTIGATE")
    return o.join(s.select("metric", "sharpe", "dsr", "p_value"), "metric").withColumn("verdict", verdict)


_HEAD = DUCK_BARS.partition("--body--")[0]
_CROSS = _cross_sql()
SQL = {
    "cross_contexts": f"{_CROSS.partition(', pairs AS (')[0]} SELECT name AS ctx, grp AS signal_group, n FROM kept",
    "cross_families": f'{_CROSS} SELECT family, "left", "right", "cross", n FROM named',
    "cross_names": f'{_CROSS} SELECT "cross", arg_min(n, (k, l, r)) AS n, count(*) AS pairs FROM named GROUP BY "cross"',
    "overfitting": f"""{_HEAD}, r AS (SELECT tf, symbol, make_timestamp(us) AS ts, close / lag(close) OVER (PARTITION BY series ORDER BY us) - 1 AS ret FROM bars),
p AS (SELECT tf AS metric, strftime(ts, '%Y-%m') AS path, round(avg(CASE WHEN day(ts) <= 15 THEN ret END), 9) AS i, round(avg(CASE WHEN day(ts) > 15 THEN ret END), 9) AS o FROM r WHERE abs(ret) < 0.5 GROUP BY 1, 2),
k AS (SELECT *, rank() OVER (PARTITION BY metric ORDER BY i) + (count(*) OVER (PARTITION BY metric, i) - 1) / 2.0 AS ir, rank() OVER (PARTITION BY metric ORDER BY o) + (count(*) OVER (PARTITION BY metric, o) - 1) / 2.0 AS orr,
 count(*) OVER (PARTITION BY metric) AS n FROM p WHERE i IS NOT NULL AND o IS NOT NULL),
z AS (SELECT metric, avg(CASE WHEN orr / (n + 1) <= 0.5 THEN 1.0 ELSE 0.0 END) AS pbo, avg(ln(orr / (n + 1) / (1 - orr / (n + 1)))) AS ml FROM k WHERE ir > n / 2.0 GROUP BY 1)
SELECT metric, {f32('pbo')} AS pbo, {f32('ml')} AS mean_logit, CASE WHEN pbo < 0.15 THEN 'DEPLOY' WHEN pbo < 0.30 THEN 'INVESTIGATE' ELSE 'REJECT' END AS verdict FROM z""",
}
SQL["validation_report"] = f"""SELECT o.metric, o.pbo, o.mean_logit, o.verdict AS pbo_verdict, s.sharpe, s.dsr, s.p_value, CASE WHEN o.verdict = 'DEPLOY' AND s.p_value < 0.05 THEN 'DEPLOY' WHEN o.verdict = 'REJECT' OR NOT s.p_value < 0.05 THEN 'REJECT' ELSE 'INVESTIGATE' END AS verdict
 FROM ({SQL['overfitting']}) o JOIN ({relational.SQL['deflated_sharpe']}) s ON s.tf = o.metric"""
QUERIES = {
    "cross_contexts": cross_contexts,
    "cross_families": cross_families,
    "cross_names": cross_names,
    "cross_live": cross_live,
    "pattern_folds": pattern_folds,
    "simulated_trades": simulated_trades,
    "grid_winners": grid_winners,
    "genetic_search": genetic_search,
    "portfolio_decisions": portfolio_decisions,
    "knn_patterns": knn,
    "knn_live": knn_live,
    "validation_report": validation_report,
    "platt_blend": models.platt_blend(bars),
    "dual_importance": models.dual_importance(bars),
    "overfitting": overfitting,
    "direction_models": models.direction_models(bars),
    "three_class_models": models.three_class(bars, _labels),
    "meta_label": models.meta_label(bars, _labels),
    "regime_mixture": models.regime_mixture(bars),
    "mutual_information": models.mutual_information(bars),
}
