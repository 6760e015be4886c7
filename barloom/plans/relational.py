"""Scans, joins, roll-ups, market columns and reports as queries, each with its DuckDB twin."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions import ciphers
from barloom.operators import align, context, layers, quantiles, validate
from barloom.plans import core_sql
from barloom.plans.core_problems import timed
from barloom.plans.portable import DUCK, SPARK, Dialect, feature_query
from barloom.sources.bars import DUCK_BARS, bars, keep_last
from barloom.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_BARS = DUCK_BARS.partition("--body--")[0].strip().removeprefix("WITH ")

#: Inputs by name: how Spark makes them and which CTE gives them in DuckDB. Tables not named here are read as they are.
INPUTS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "bars": (bars, _BARS),
    "wind": (lambda s, d: timed(s, d, "space_weather"), core_sql.WIND + ", wind_clean AS (SELECT 1)"),
    "chain": (lambda s, d: timed(s, d, "onchain_data"), core_sql.CHAIN),
    "tweeted": (lambda s, d: timed(s, d, "tweets"), core_sql.TWEETS),
}


def f32(x: str) -> str:
    return f"CAST(CAST({x} AS FLOAT) AS DOUBLE)"


def common(name: str, text: Callable[[Dialect], str]) -> None:
    """Register one query text for both engines; {input} names a table or one of INPUTS."""
    names = list(dict.fromkeys(re.findall(r"\{(\w+)\}", text(DUCK))))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(text(SPARK), **{n: INPUTS[n][0](spark, sf_dir) if n in INPUTS else read_table(spark, sf_dir, n) for n in names})

    ctes = [INPUTS[n][1] for n in names if n in INPUTS]
    QUERIES[name] = run
    SQL[name] = (f"WITH {', '.join(ctes)} " if ctes else "") + text(DUCK).format(**{n: n for n in names})


def clean(x: str, d: Dialect) -> str:
    return f"CASE WHEN isnan({x}) THEN NULL ELSE {x} END" if d.duck else x


# ---------------------------------------------------------------- scans and sinks
common("scan_filtered", lambda d: "SELECT row_id, collector, open_time, trades FROM {ohlcv} WHERE symbol = 'BTC' AND timeframe = '1d'")
common("latest_100_bars_per_symbol", lambda d: f"""SELECT symbol, series, us, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY us DESC, series) AS rn FROM {{bars}}) t WHERE rn <= 100""")
common("distinct_symbols_top2", lambda d: "SELECT symbol, us, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY us DESC, series) AS rn FROM {bars}) t WHERE rn <= 2")
common("dedupe_keep_last", lambda d: "SELECT collector, tweet_id, row_id, retweet_count FROM (SELECT *, row_number() OVER (PARTITION BY collector, tweet_id ORDER BY row_id DESC) AS rn FROM {tweets}) t WHERE rn = 1")
common("trim_zero_volume_head", lambda d: """SELECT series, us, volume FROM (SELECT *, min(CASE WHEN volume > 0 THEN us END) OVER (PARTITION BY series) AS start_us FROM {bars}) t WHERE us >= start_us""")
def pivot_macro_all(spark: SparkSession, sf_dir: str, limit: int = 1000) -> DataFrame:
    """Every series of macro as a column: the last delivery of each (collector, series, date); refused beyond `limit` series."""
    macro = read_table(spark, sf_dir, "macro").where("series is not null")
    names = sorted(r[0] for r in macro.select("series").distinct().limit(limit + 1).collect())
    if len(names) > limit:
        raise ValueError(f"more than {limit} macro series")
    return macro.groupBy("collector", "date").pivot("series", names).agg(F.max_by("value", "row_id"))


QUERIES["pivot_macro_all"] = pivot_macro_all
#: The series of the test tables, for the SQL twin only.
_SERIES = ("BROADUSD", "CRUDE", "CURVE102", "GOLDFIX", "HYSPREAD", "VOLINDEX", "YIELD10", "YIELD2")
SQL["pivot_macro_all"] = f"""SELECT collector, date, {', '.join(f"arg_max(CASE WHEN NOT isnan(value) THEN value END, row_id) FILTER (WHERE series = '{s}' AND rn = 1) AS \"{s}\"" for s in _SERIES)} FROM
 (SELECT *, row_number() OVER (PARTITION BY collector, series, date ORDER BY row_id DESC) AS rn FROM macro WHERE series IS NOT NULL) t GROUP BY collector, date"""
common("funding_daily_mean", lambda d: f"SELECT symbol, {d.div('ts_unix', '86400000')} AS day, {f32('avg(' + clean('funding_rate', d) + ')')} AS funding, count(*) AS n FROM {{funding_rates}} WHERE ts_unix IS NOT NULL GROUP BY 1, 2")
common("insert_ignore", lambda d: """SELECT f.collector, f.symbol, f.ts_unix, min(f.row_id) AS row_id FROM {funding_rates} f LEFT JOIN
 (SELECT DISTINCT collector, symbol, ts_unix * 1000 AS t FROM {open_interest}) o ON o.collector = f.collector AND o.symbol = f.symbol AND o.t = f.ts_unix
 WHERE o.t IS NULL AND f.ts_unix IS NOT NULL GROUP BY 1, 2, 3""")
common("backfill_update", lambda d: f"""SELECT a.series, a.us, {f32('coalesce(a.taker_buy_volume, a.volume * b.share)')} AS taker_buy_volume FROM {{bars}} a LEFT JOIN
 (SELECT symbol, sum(taker_buy_volume) / nullif(sum(CASE WHEN taker_buy_volume IS NOT NULL THEN volume END), 0) AS share FROM {{bars}} GROUP BY symbol) b ON a.symbol = b.symbol""")
common("upsert_latest", lambda d: """SELECT collector, symbol, t, row_id FROM (SELECT *, row_number() OVER (PARTITION BY collector, symbol, t ORDER BY row_id DESC) AS rn FROM (
 SELECT collector, symbol, ts_unix * 1000 AS t, row_id FROM {open_interest} WHERE ts_unix IS NOT NULL UNION ALL SELECT collector, symbol, ts_unix, row_id FROM {funding_rates} WHERE ts_unix IS NOT NULL) u) v WHERE rn = 1""")

# ---------------------------------------------------------------- filters
common("null_share_constant_columns", lambda d: "SELECT " + ", ".join(
    f"avg(CASE WHEN {clean(c, d)} IS NULL THEN 1e0 ELSE 0e0 END) AS {c}_null, {f32(d.quantile(clean(c, d), 0.5, ''))} AS {c}_median, CASE WHEN max({clean(c, d)}) = min({clean(c, d)}) THEN 1 ELSE 0 END AS {c}_constant"
    for c in context.TICKERS) + " FROM {macro_data}")


def clean_columns(df: DataFrame, most_null: float = 0.9) -> DataFrame:
    """Double columns with a share of NULL of `most_null` or more, and constant ones, leave; the rest is filled with the median."""
    names = [c for c, kind in df.dtypes if kind == "double"]
    parts = {"null": lambda c: F.avg(F.isnull(c).cast("double")), "least": F.min, "most": F.max}
    if not names:
        return df
    got = df.agg(*(f(c).alias(f"{c} {p}") for c in names for p, f in parts.items())).first()
    gone = [c for c in names if got[f"{c} null"] is None or got[f"{c} null"] >= most_null or got[f"{c} least"] == got[f"{c} most"]]
    kept = [c for c in names if c not in gone]
    tall = df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("c"), F.col(f"`{c}`").alias("v")) for c in kept)))) if kept else None
    median = {r["c"]: r["q"][0] for r in quantiles.percentiles(tall, "c", "v", (0.5,)).collect()} if kept else {}  # one row a column
    return df.drop(*gone).fillna(median) if median else df.drop(*gone)


def macro_data_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_columns(read_table(spark, sf_dir, "macro_data"))


QUERIES["macro_data_clean"] = macro_data_clean
PERIODS = (("autumn_23", "2023-09-01", "2023-11-30"), ("winter_23", "2023-12-01", "2024-02-29"), ("spring_24", "2024-03-01", "2024-05-31"), ("all_24", "2024-01-01", "2024-12-31"))
common("named_periods", lambda d: "SELECT p.name, count(*) AS bars, min(b.us) AS first_us, max(b.us) AS last_us FROM {bars} b JOIN (" + " UNION ALL ".join(
    f"SELECT '{n}' AS name, DATE '{a}' AS a, DATE '{z}' AS z" for n, a, z in PERIODS) + f") p ON CAST({d.ts('b.us')} AS DATE) BETWEEN p.a AND p.z GROUP BY p.name")

# ---------------------------------------------------------------- roll-ups
common("event_buckets", lambda d: f"""SELECT collector, {d.div('utc_us', '3600000000')} AS hour, count(*) AS tweets, max(is_retweet) AS any_retweet, CAST(sum(retweet_count) AS BIGINT) AS retweets,
 {f32('avg(favorite_count)')} AS favorites, min(user_handle) AS first_handle FROM {{tweeted}} GROUP BY 1, 2""")
common("event_mode", lambda d: """SELECT collector, day_of_year FROM (SELECT collector, day_of_year, row_number() OVER (PARTITION BY collector ORDER BY n DESC, day_of_year) AS rn FROM
 (SELECT collector, day_of_year, count(*) AS n FROM {tweets} WHERE day_of_year IS NOT NULL GROUP BY 1, 2) c) t WHERE rn = 1""")
common("daily_tweets", lambda d: f"""SELECT {d.day('utc_us')} AS day, count(DISTINCT user_handle) AS handles, count(CASE WHEN lower(full_text) LIKE '%caution%' THEN 1 END) AS caution,
 {f32('avg(length(full_text))')} AS mean_length, count(DISTINCT tweet_id) AS tweets FROM {{tweeted}} GROUP BY 1""")
common("last_in_bucket", lambda d: f"""SELECT collector, {d.day('utc_us')} AS day, {', '.join(f"{d.arg_max(d.clean(c) if c in ('hash_rate', 'open_interest', 'coinbase_premium') else c, 'utc_us', 'id')} AS {c}" for c in ('fear_greed', 'mempool_size', 'hash_rate', 'open_interest', 'coinbase_premium', 'block_height'))}
 FROM {{chain}} GROUP BY 1, 2""")
common("sum_in_bucket", lambda d: f"""SELECT collector, {d.day('utc_us')} AS day, {f32(f"coalesce(sum({clean('whale_volume_btc', d)}), 0)")} AS whale, {f32(f"coalesce(sum({clean('liq_long_vol', d)}), 0)")} AS liq_long,
 {f32(f"coalesce(sum({clean('liq_short_vol', d)}), 0)")} AS liq_short, count(CASE WHEN liq_long_count > liq_short_count THEN 1 END) AS long_heavy FROM {{chain}} GROUP BY 1, 2""")
#: Trades of the 20-bar mean: entered at the first close on one side of it, left at the first close on the other side.
#: (series, symbol, tf, us and ts of the exit, direction, pnl, held bars, distance from the mean at entry)
_TRADES = lambda d: f"""(SELECT series, symbol, tf, exit_us AS us, {d.ts('exit_us')} AS ts, side AS direction, side * (exit_px / entry_px - 1) AS pnl, exit_pos - entry_pos AS held, dist FROM (
 SELECT series, symbol, tf, side, px AS entry_px, pos AS entry_pos, dist, lead(px) OVER w AS exit_px, lead(pos) OVER w AS exit_pos, lead(us) OVER w AS exit_us FROM (
 SELECT *, lag(side) OVER (PARTITION BY series ORDER BY us) AS was FROM (SELECT series, symbol, tf, us, close AS px, row_number() OVER (PARTITION BY series ORDER BY us) AS pos, abs(close / m - 1) AS dist,
 CASE WHEN round(close - m, 10) > 0 THEN 1 WHEN round(close - m, 10) < 0 THEN -1 END AS side FROM (SELECT *, CASE WHEN count(close) OVER v >= 20 THEN avg(close) OVER v END AS m FROM {{bars}} WINDOW v AS (PARTITION BY series ORDER BY us ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) a) b WHERE side IS NOT NULL) c
 WHERE was IS NULL OR was <> side WINDOW w AS (PARTITION BY series ORDER BY us)) e WHERE exit_px IS NOT NULL)"""  # noqa: E731
common("monthly_heatmap", lambda d: "SELECT CAST(year(ts) AS BIGINT) AS y, " + ", ".join(
    f"{f32(f'coalesce(sum(CASE WHEN month(ts) = {m} THEN pnl END), 0)')} AS pnl_{m}, count(CASE WHEN month(ts) = {m} THEN 1 END) AS n_{m}, coalesce({f32(f'avg(CASE WHEN month(ts) = {m} THEN CASE WHEN pnl > 0 THEN 1e0 ELSE 0e0 END END)')}, 0e0) AS wins_{m}" for m in range(1, 13)) + f" FROM {_TRADES(d)} t GROUP BY 1")
common("weekly_performance", lambda d: f"""SELECT CAST(y AS BIGINT) AS y, CAST(w AS BIGINT) AS w, n, {f32('pnl')} AS pnl, {f32('sum(pnl) OVER (ORDER BY y, w)')} AS cumulative FROM (SELECT {'isoyear(ts)' if d.duck else 'extract(YEAROFWEEK FROM ts)'} AS y, weekofyear(ts) AS w,
 count(*) AS n, sum(pnl) AS pnl FROM {_TRADES(d)} t GROUP BY 1, 2) u""")
common("breakdown", lambda d: f"""SELECT symbol, direction, count(*) AS trades, {f32('avg(pnl)')} AS mean_pnl, {f32('avg(CASE WHEN pnl > 0 THEN 1e0 ELSE 0e0 END)')} AS win_rate,
 {"array_to_string(list_sort(list(DISTINCT tf)), ',')" if d.duck else "array_join(sort_array(collect_set(tf)), ',')"} AS timeframes FROM {_TRADES(d)} t GROUP BY 1, 2""")
common("timeframe_summary", lambda d: f"""SELECT a.tf, a.trades, a.roi, a.win_rate, a.worst_drawdown, m.best_month, m.worst_month FROM (
 SELECT tf, count(*) AS trades, {f32('sum(pnl)')} AS roi, {f32('avg(CASE WHEN pnl > 0 THEN 1e0 ELSE 0e0 END)')} AS win_rate, {f32('min(equity - peak)')} AS worst_drawdown FROM (
 SELECT *, max(equity) OVER (PARTITION BY series ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak FROM (
 SELECT *, sum(pnl) OVER (PARTITION BY series ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS equity FROM {_TRADES(d)} t) u) v GROUP BY tf) a JOIN (
 SELECT tf, {d.arg_max('ym', 'pnl', 'ym')} AS best_month, {d.arg_max('ym', '-pnl', 'ym')} AS worst_month FROM (SELECT tf, year(ts) * 100 + month(ts) AS ym, round(sum(pnl), 8) AS pnl FROM {_TRADES(d)} t2 GROUP BY 1, 2) x GROUP BY tf) m ON m.tf = a.tf""")
common("distribution", lambda d: "SELECT symbol, " + ", ".join(f"{f32(d.quantile('close', q, ''))} AS q{round(q * 100)}" for q in (0.05, 0.25, 0.5, 0.75, 0.95))
       + f", {f32('avg(close)')} AS mean, {f32('stddev_samp(close)')} AS sd, count(DISTINCT series) AS series FROM {{bars}} GROUP BY symbol")


def distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five exact percentiles, mean, deviation and series of every symbol's closes; no symbol's closes meet in one task."""
    at = (0.05, 0.25, 0.5, 0.75, 0.95)
    b = bars(spark, sf_dir)
    single = lambda e: e.cast("float").cast("double")
    q = quantiles.percentiles(b, "symbol", "close", at).select(F.col("symbol").alias("_s"), *(single(F.col("q")[i]).alias(f"q{round(p * 100)}") for i, p in enumerate(at)))
    rest = b.groupBy("symbol").agg(single(F.avg("close")).alias("mean"), single(F.stddev_samp("close")).alias("sd"), F.count_distinct("series").alias("series"))
    return rest.join(q, F.col("symbol") == F.col("_s")).drop("_s")


QUERIES["distribution"] = distribution
common("correlation", lambda d: f"SELECT tf, {f32('corr(ln(high), ln(low))')} AS r, count(*) AS n FROM {{bars}} GROUP BY tf")
common("value_counts", lambda d: "SELECT lower(trim(source)) AS source, lang, count(*) AS n FROM {documents} GROUP BY 1, 2")
common("average_tie_ranks", lambda d: """SELECT t.doc_id, CAST(c.rnk AS DOUBLE) AS rnk FROM {documents} t JOIN (SELECT lang, n_chars, sum(n) OVER (PARTITION BY lang ORDER BY n_chars ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n + (n + 1) / 2e0 AS rnk
 FROM (SELECT lang, n_chars, count(*) AS n FROM {documents} GROUP BY 1, 2) g) c ON c.lang IS NOT DISTINCT FROM t.lang AND c.n_chars IS NOT DISTINCT FROM t.n_chars""")
common("accuracy", lambda d: f"""SELECT tf, count(*) AS n, {f32('avg(CASE WHEN hit THEN 1e0 ELSE 0e0 END)')} AS accuracy, {f32('avg(-ln(CASE WHEN hit THEN p ELSE 1 - p END))')} AS log_loss FROM (
 SELECT tf, pnl > 0 AS hit, 0.5e0 + 0.3e0 * (dist / (dist + 0.02e0)) AS p FROM {_TRADES(d)} t) u GROUP BY tf""")

#: Bars held up to which a trade is a scalp, a day trade, a swing, by timeframe.
HELD = {"1h": (1, 24, 72), "4h": (1, 6, 84), "1d": (0, 1, 30)}
common("trade_types", lambda d: "SELECT tf, CASE " + " ".join(f"WHEN tf = '{t}' THEN CASE WHEN h <= {a} THEN 'scalp' WHEN h <= {b} THEN 'day_trade' WHEN h <= {c} THEN 'swing' ELSE 'position' END" for t, (a, b, c) in HELD.items())
    + f" END AS trade_type, count(*) AS trades, {f32('avg(pnl)')} AS mean_pnl FROM (SELECT tf, pnl, held AS h FROM {_TRADES(d)} t) u GROUP BY 1, 2")


def _deflated(d: Dialect) -> str:
    """Sharpe, its standard error for skew and kurtosis, the expected best of N trials, deflated Sharpe and p-value."""
    x = "abs(dsr) / sqrt(2e0)"
    t = f"(1 / (1 + 0.3275911e0 * {x}))"
    # normal distribution by the five-term rational approximation of erf (error below 1.5e-7)
    tail = f"0.5e0 * {t} * (0.254829592e0 + {t} * (-0.284496736e0 + {t} * (1.421413741e0 + {t} * (-1.453152027e0 + {t} * 1.061405429e0)))) * exp(-{x} * {x})"
    best = "(sqrt(2 * ln(1000e0)) - (0.5772156649e0 + ln(ln(1000e0))) / (2 * sqrt(2 * ln(1000e0))))"
    return f"""SELECT tf, n, {f32('sharpe')} AS sharpe, {f32('se')} AS se, {f32('dsr')} AS dsr, {f32(f'CASE WHEN dsr > 0 THEN {tail} ELSE 1 - {tail} END')} AS p_value FROM (
 SELECT *, (sharpe - {best}) / se AS dsr FROM (SELECT *, sqrt((1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe) / (n - 1)) AS se FROM (
 SELECT tf, n, sharpe, (e3 - 3 * m * e2 + 2 * m * m * m) / power(e2 - m * m, 1.5e0) AS skew, (e4 - 4 * m * e3 + 6 * m * m * e2 - 3 * m * m * m * m) / power(e2 - m * m, 2) AS kurt FROM (
 SELECT tf, count(*) AS n, avg(pnl) / stddev_samp(pnl) AS sharpe, avg(pnl) AS m, avg(pnl * pnl) AS e2, avg(pnl * pnl * pnl) AS e3, avg(pnl * pnl * pnl * pnl) AS e4 FROM {_TRADES(d)} t GROUP BY tf) a) b) c) e"""


common("deflated_sharpe", _deflated)

# ---------------------------------------------------------------- joins
common("bucket_align", lambda d: f"""SELECT b.series, b.us, coalesce(e.n, 0) AS tweets FROM {{bars}} b LEFT JOIN (SELECT collector, {d.div('utc_us', '14400000000')} AS bucket, count(*) AS n FROM {{tweeted}} GROUP BY 1, 2) e
 ON e.bucket = {d.div('b.us', '14400000000')} AND b.series LIKE e.collector || ':%' """ if d.duck else """SELECT b.series, b.us, coalesce(e.n, 0) AS tweets FROM {bars} b LEFT JOIN
 (SELECT collector, utc_us div 14400000000 AS bucket, count(*) AS n FROM {tweeted} GROUP BY 1, 2) e ON e.bucket = b.us div 14400000000 AND substring_index(b.series, ':', 1) = e.collector""")
common("parameter_grid", lambda d: "SELECT a AS lev, b AS risk, c AS hold, CAST(row_number() OVER (ORDER BY a, b, c) AS BIGINT) AS idx FROM (SELECT 1 AS a UNION ALL SELECT 2 UNION ALL SELECT 5) x CROSS JOIN (SELECT 5e-1 AS b UNION ALL SELECT 1e0) y CROSS JOIN (SELECT 12 AS c UNION ALL SELECT 24) z")
common("token_lexicon", lambda d: f"""SELECT t.doc_id, count(*) AS tokens, count(CASE WHEN l.side = 1 THEN 1 END) AS bull, count(CASE WHEN l.side = -1 THEN 1 END) AS bear FROM
 (SELECT doc_id, {"unnest(regexp_extract_all(lower(text), '[a-z]+'))" if d.duck else "explode(regexp_extract_all(lower(text), '([a-z]+)', 1))"} AS word FROM {{documents}}) t LEFT JOIN
 ({' UNION ALL '.join(f"SELECT '{w}' AS w, {s} AS side" for ws, s in ((ciphers.BULL, 1), (ciphers.BEAR, -1)) for w in ws)}) l ON l.w = t.word GROUP BY t.doc_id""")
common("date_spine", lambda d: f"""SELECT s.source, s.day, coalesce(n, 0) AS docs FROM (SELECT source, {'unnest(range(a, z + 1))' if d.duck else 'explode(sequence(a, z))'} AS day FROM
 (SELECT lower(trim(source)) AS source, min({'epoch_us(published_at)' if d.duck else 'unix_micros(published_at)'} {'//' if d.duck else 'div'} 86400000000) AS a, max({'epoch_us(published_at)' if d.duck else 'unix_micros(published_at)'} {'//' if d.duck else 'div'} 86400000000) AS z
  FROM {{documents}} WHERE published_at IS NOT NULL AND source IS NOT NULL GROUP BY 1) r) s LEFT JOIN
 (SELECT lower(trim(source)) AS source, {'epoch_us(published_at)' if d.duck else 'unix_micros(published_at)'} {'//' if d.duck else 'div'} 86400000000 AS day, count(*) AS n FROM {{documents}} WHERE published_at IS NOT NULL GROUP BY 1, 2) c
 ON c.source = s.source AND c.day = s.day""")
common("longest_text_in_interval", lambda d: f"""SELECT collector, bucket, row_id, CAST(len AS BIGINT) AS len FROM (SELECT collector, {d.div('utc_us', '14400000000')} AS bucket, row_id, length(full_text) AS len,
 row_number() OVER (PARTITION BY collector, {d.div('utc_us', '14400000000')} ORDER BY length(full_text) DESC, row_id) AS rn FROM {{tweeted}} WHERE full_text IS NOT NULL) t WHERE rn = 1""")
common("quintiles", lambda d: f"""SELECT q, count(*) AS n, {f32('avg(x)')} AS mean_x, {f32('avg(y)')} AS mean_y FROM (SELECT least({d.div('rn - 1', f"greatest({d.div('n', '5')}, 1)")}, 4) AS q, x, y FROM (
 SELECT x, y, row_number() OVER (ORDER BY x, row_id) AS rn, count(*) OVER () AS n FROM (SELECT row_id, {clean('spx', d)} AS x, {clean('gold', d)} AS y FROM {{macro_data}}) m WHERE x IS NOT NULL AND y IS NOT NULL) t) u GROUP BY q""")
common("correlation_significance", lambda d: f"""SELECT {f32('r')} AS r, n, {f32('r * sqrt((n - 2) / (1 - r * r))')} AS t, CASE WHEN abs(r * sqrt((n - 2) / (1 - r * r))) > 2.576 THEN '***' WHEN abs(r * sqrt((n - 2) / (1 - r * r))) > 1.96 THEN '**' ELSE '' END AS stars
 FROM (SELECT corr(x, y) AS r, count(*) AS n FROM (SELECT {clean('spx', d)} AS x, {clean('dxy', d)} AS y FROM {{macro_data}}) m WHERE x IS NOT NULL AND y IS NOT NULL) c""")
common("liquidations_by_side", lambda d: f"""SELECT collector, CAST(sum(liq_long_count) AS BIGINT) AS longs, CAST(sum(liq_short_count) AS BIGINT) AS shorts, {f32('sum(' + clean('liq_long_vol', d) + ')')} AS long_volume, count(CASE WHEN liq_long_count IS NULL AND liq_short_count IS NULL THEN 1 END) AS unknown FROM {{chain}} GROUP BY collector""")
common("lunar_mansions", lambda d: f"SELECT moon_mansion, count(*) AS days, {f32('avg(digital_root)')} AS mean_root, {f32('avg(planetary_strength)')} AS strength FROM {{ephemeris}} GROUP BY moon_mansion")
_PLANETS = ("sun", "moon", "mercury", "venus", "mars", "jupiter", "saturn", "uranus", "neptune", "pluto")


def _aspects(d: Dialect) -> str:
    gap = lambda a, b: f"(180 - abs(180 - abs({a}_lon - {b}_lon)))"
    pairs = [(a, b) for i, a in enumerate(_PLANETS) for b in _PLANETS[i + 1 :]]
    near = lambda a, b, x: f"abs({gap(a, b)} - {x}) <= 8"
    hard = " + ".join(f"CASE WHEN {near(a, b, 0)} OR {near(a, b, 90)} OR {near(a, b, 180)} THEN 1 ELSE 0 END" for a, b in pairs)
    soft = " + ".join(f"CASE WHEN ({near(a, b, 60)} OR {near(a, b, 120)}) AND NOT ({near(a, b, 0)} OR {near(a, b, 90)} OR {near(a, b, 180)}) THEN 1 ELSE 0 END" for a, b in pairs)
    return f"SELECT row_id, date, {hard} AS hard, {soft} AS soft, CAST(floor(moon_lon / 30) AS INT) AS moon_sign, CAST(floor(((moon_lon - sun_lon + 360) - 360 * floor((moon_lon - sun_lon + 360) / 360)) / 12) AS INT) + 1 AS tithi FROM {{ephemeris}}"


common("planetary_aspects", _aspects)


def _ephemeris(d: Dialect) -> str:
    """Per bar, by the day of the last computed row: moon sign with element and modality, ten pairs in five aspects of eight
    degrees, tithi and karana, and the collector's greatest kp of the day; NULL without a row of the day."""
    pairs = [("sun", "moon"), ("sun", "mercury"), ("sun", "venus"), ("sun", "mars"), ("sun", "jupiter"), ("sun", "saturn"), ("moon", "mars"), ("mars", "saturn"), ("jupiter", "saturn"), ("venus", "mars")]
    near = lambda a, b, x: f"CASE WHEN e.{a}_lon IS NULL OR e.{b}_lon IS NULL THEN NULL WHEN abs(180 - abs(180 - abs(e.{a}_lon - e.{b}_lon)) - {x}) <= 8 THEN 1 ELSE 0 END"
    each = {f"asp_{a}_{b}_{n}": near(a, b, x) for a, b in pairs for n, x in (("conj", 0), ("sext", 60), ("square", 90), ("trine", 120), ("opp", 180))}
    elong = "(e.moon_lon - e.sun_lon + 360 - 360 * floor((e.moon_lon - e.sun_lon + 360) / 360))"
    sign = "CAST(floor(e.moon_lon / 30) AS INT) % 12"
    flag01 = lambda c: f"CASE WHEN e.moon_lon IS NULL THEN NULL WHEN {c} THEN 1 ELSE 0 END"
    cols = {"moon_sign": sign, **{f"moon_{n}": flag01(f"({sign}) % 4 = {k}") for k, n in enumerate(("fire", "earth", "air", "water"))}, **{f"moon_{n}": flag01(f"({sign}) % 3 = {k}") for k, n in enumerate(("cardinal", "fixed", "mutable"))},
            **each, "asp_hard": "e.hard_aspects", "asp_soft": "e.soft_aspects", "mercury_retrograde": "e.mercury_retrograde", "tithi": f"CAST(floor({elong} / 12) AS INT) + 1", "karana": f"CAST(floor({elong} / 6) AS INT) + 1", "kp_max": "k.kp_max"}
    day = "CAST(substr(trim(date), 1, 10) AS DATE)"
    since = f"datediff('day', DATE '1970-01-01', {day})" if d.duck else f"datediff({day}, DATE '1970-01-01')"
    lons = ", ".join(f"{d.clean(f'{p}_lon')} AS {p}_lon" for p in _PLANETS)
    return f"""SELECT b.series, b.us, {', '.join(f'{e} AS {n}' for n, e in cols.items())} FROM {{bars}} b LEFT JOIN
 (SELECT day_n, hard_aspects, soft_aspects, mercury_retrograde, {lons} FROM (SELECT *, {since} AS day_n, row_number() OVER (PARTITION BY {day} ORDER BY row_id DESC) AS rn FROM {{ephemeris}}) x WHERE rn = 1) e ON e.day_n = {d.day('b.us')}
 LEFT JOIN (SELECT collector, {d.day('utc_us')} AS day_n, max({d.clean('kp_index')}) AS kp_max FROM {{wind}} GROUP BY 1, 2) k ON k.collector = split_part(b.series, ':', 1) AND k.day_n = {d.day('b.us')}"""


common("ephemeris_columns", _ephemeris)

# ---------------------------------------------------------------- market columns over ordered side tables
def _series(table: str, key: str, time: str, cols: str) -> tuple[Callable, str]:
    body = f"SELECT {key} AS series, {time} AS us, {cols} FROM {{t}} WHERE {time} IS NOT NULL"
    one = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series, us ORDER BY row_id DESC) AS rn FROM ({b}) x) y WHERE rn = 1"
    text = lambda d: one.format(b=body.replace("~", "isnan" if d.duck else "isnan"))
    return lambda s, d: s.sql(text(SPARK), t=read_table(s, d, table)), "--body-- " + text(DUCK).format(t=table)


def _funding(d: Dialect):
    from barloom.plans.portable import flag, over, rolling

    z = lambda n: f"CASE WHEN count(x) {over(n)} >= {n // 4} THEN (x - avg(x) {over(n)}) / nullif(stddev_samp(x) {over(n)}, 0) END"
    s1 = {"mean_9": rolling("avg", "x", 9, 3), "z_30": z(30), "z_90": z(90)}
    return [s1, {"regime_i": "CASE WHEN z_30 > 2 THEN 2 WHEN z_30 > 1 THEN 1 WHEN z_30 < -2 THEN -2 WHEN z_30 < -1 THEN -1 ELSE 0 END", "positive": flag("x > 0")}]


_src, _duck = _series("funding_rates", "collector || ':' || symbol", "ts_unix", "CASE WHEN NOT isnan(funding_rate) THEN funding_rate END AS x, row_id")
QUERIES["funding_regime"], SQL["funding_regime"] = feature_query(_funding, _src, _duck, ["mean_9", "z_30", "z_90", "regime_i", "positive"])


def _interest(d: Dialect):
    from barloom.plans.portable import change, lag, over

    s1 = {"filled": d.last("x", over())}
    s2 = {"oi_change_5": change("filled", 5), "value_change_5": change("v", 5)}
    return [s1, s2, {"divergence_i": "CASE WHEN oi_change_5 > 0 AND value_change_5 < 0 THEN 1 WHEN oi_change_5 < 0 AND value_change_5 > 0 THEN -1 ELSE 0 END", "prev_filled": lag("filled")}]


_src, _duck = _series("open_interest", "collector || ':' || symbol", "ts_unix", "CASE WHEN NOT isnan(sum_open_interest) THEN sum_open_interest END AS x, CASE WHEN NOT isnan(sum_open_interest_value) THEN sum_open_interest_value / 1e6 END AS v, row_id")
QUERIES["interest_divergence"], SQL["interest_divergence"] = feature_query(_interest, _src, _duck, ["filled", "oi_change_5", "value_change_5", "divergence_i", "prev_filled"])


def _context(build: Callable[[Dialect], list], show: list[str]) -> tuple[Callable, str]:
    """A feature group over bars joined with the slower tables."""
    tables = lambda s, d: {"bars": bars(s, d), "macro": read_table(s, d, "macro_data"), "chain": timed(s, d, "onchain_data"), "funding": read_table(s, d, "funding_rates")}
    source = lambda s, d: s.sql(context.joined(SPARK, "{bars}", "{macro}", "{chain}", "{funding}"), **tables(s, d))
    duck = f"WITH {_BARS}, {core_sql.CHAIN} --body-- {context.joined(DUCK, 'bars', 'macro_data', 'chain', 'funding_rates')}"
    return feature_query(build, source, duck, show)


QUERIES["macro_columns"], SQL["macro_columns"] = _context(context.macro, context.MACRO)
QUERIES["flow_columns"], SQL["flow_columns"] = _context(context.flows, context.FLOWS)
common("higher_timeframes", lambda d: context.parents(d, "{bars}"))
QUERIES["labels_targets"], SQL["labels_targets"] = feature_query(validate.targets, bars, DUCK_BARS, ["next_return_pct", "next_direction", "return_5_ahead", "return_10_ahead"])
QUERIES["labels_triple_barrier"], SQL["labels_triple_barrier"] = feature_query(validate.triple_barrier, bars, DUCK_BARS, ["label_i"])


for _name, _build, _show in (
    ("layer_price_numbers", layers.price_numbers, ["price_root_i", "price_angel", "price_near_round", "price_repeating", "price_master_11", "price_master_22", "price_master_33"]),
    ("layer_sessions", layers.sessions, ["session_asia", "session_london", "session_ny", "session_dead", "killzone_asian", "killzone_london", "killzone_ny_pm", "doy_sin", "doy_cos", "moon_sin", "moon_cos", "dow_sin", "dow_cos", "dom_sin", "dom_cos", "animal_i", "element_i", "sixty_i"]),
    ("layer_entropy", layers.entropy, ["entropy_20", "entropy_high", "entropy_low", "diff_sd"]),
    ("layer_rates_of_change", layers.rates_of_change, layers.RATES),
):
    QUERIES[_name], SQL[_name] = feature_query(_build, bars, DUCK_BARS, _show)

for _name, _build in {"layer_memory": layers.memory, "layer_cycles": layers.cycles, "layer_regimes": layers.regimes, "layer_multi_timeframe": layers.multi_timeframe}.items():
    _show = [c for st in _build(DUCK) for c in st if c not in ("price_text", "day_n")]
    QUERIES[_name], SQL[_name] = feature_query(_build, bars, DUCK_BARS, _show)


def _timed_series(tab: str, key: str, cols: str, cte: str, name: str) -> tuple[Callable, str]:
    """The last delivery per instant of a timed table as a series of its collector."""
    body = f"SELECT * FROM (SELECT collector AS series, utc_us AS us, {cols}, row_number() OVER (PARTITION BY collector, utc_us ORDER BY {key} DESC) AS rn FROM {{t}}) x WHERE rn = 1"
    return lambda s, d: s.sql(body, t=timed(s, d, tab)), f"WITH {cte} --body-- {body.format(t=name)}"


_n = lambda c, out: f"CASE WHEN NOT isnan({c}) THEN {c} END AS {out}"
_src, _duck = _timed_series("onchain_data", "id", ", ".join(["fear_greed", _n("hash_rate", "hash_rate"), _n("whale_volume_btc", "whale"), _n("coinbase_premium", "premium"), _n("liq_long_vol", "liq_long_vol"), _n("liq_short_vol", "liq_short_vol")]), core_sql.CHAIN, "chain")
QUERIES["onchain_columns"], SQL["onchain_columns"] = feature_query(layers.onchain, _src, _duck, [c for st in layers.onchain(DUCK) for c in st])
_src, _duck = _timed_series("space_weather", "row_id", ", ".join([_n("kp_index", "kp_index"), _n("solar_wind_speed", "speed")]), core_sql.WIND, "wind")
QUERIES["space_columns"], SQL["space_columns"] = feature_query(layers.space, _src, _duck, [c for st in layers.space(DUCK) for c in st if c not in ("storm_us",)])


# ---------------------------------------------------------------- text
def text_ciphers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ciphers.with_ciphers(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "text", ciphers.CIPHERS).drop("text")
    return out.withColumns({f"{n}_root": ciphers.digital_root(F.col(n)) for n in ("ordinal", "reverse")})


QUERIES["text_ciphers"] = text_ciphers
SQL["text_ciphers"] = "SELECT *, CASE WHEN ordinal = 0 THEN 0 ELSE 1 + (ordinal - 1) % 9 END AS ordinal_root, CASE WHEN reverse = 0 THEN 0 ELSE 1 + (reverse - 1) % 9 END AS reverse_root FROM (SELECT doc_id, " + ", ".join(
    f"CAST({ciphers.cipher_sql('text', n)} AS BIGINT) AS {n}" for n in ciphers.CIPHERS) + " FROM documents) t"


def text_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ciphers.sentiment(F.col("full_text"))
    return read_table(spark, sf_dir, "tweets").select("row_id", *(e.alias(n) for n, e in s.items()))


QUERIES["text_sentiment"] = text_sentiment
_LIST = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
SQL["text_sentiment"] = f"""SELECT row_id, bull, bear, bull - bear AS score, caps_words, exclamations, questions, urgency, len(words) AS words FROM (SELECT row_id, words,
 len(list_filter(words, lambda w: list_contains({_LIST(ciphers.BULL)}, w))) AS bull, len(list_filter(words, lambda w: regexp_matches(w, '^({'|'.join(ciphers.BEAR)})'))) AS bear,
 len(list_filter(regexp_split_to_array(t, '\\s+'), lambda w: length(w) > 1 AND regexp_matches(w, '\\p{{Lu}}') AND NOT regexp_matches(w, '\\p{{Ll}}'))) AS caps_words,
 length(t) - length(replace(t, '!', '')) AS exclamations, length(t) - length(replace(t, '?', '')) AS questions, {' + '.join(f"CASE WHEN contains(lower(t), '{u}') THEN 1 ELSE 0 END" for u in ciphers.URGENT)} AS urgency
 FROM (SELECT row_id, coalesce(full_text, '') AS t, regexp_extract_all(lower(coalesce(full_text, '')), '\\w+') AS words FROM tweets) q) r"""


# ---------------------------------------------------------------- as-of joins
def _funding_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = read_table(spark, sf_dir, "funding_rates").where("ts_unix is not null")
    one = keep_last(f, ["collector", "symbol", "ts_unix"], "row_id", ["funding_rate"])
    return one.select(F.concat_ws(":", "collector", F.regexp_replace("symbol", "USDT$", "")).alias("series"), (F.col("ts_unix") * 1000).alias("t"), "funding_rate")


def asof_funding(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = align.asof(bars(spark, sf_dir).select("series", "us"), _funding_points(spark, sf_dir), ["series"], "us", "t", ["funding_rate"])
    return got.select("series", "us", "matched_us", "funding_rate")


_POINTS = """points AS (SELECT collector || ':' || regexp_replace(symbol, 'USDT$', '') AS series, ts_unix * 1000 AS t, arg_max(CASE WHEN NOT isnan(funding_rate) THEN funding_rate END, row_id) AS funding_rate,
 max(row_id) AS row_id FROM funding_rates WHERE ts_unix IS NOT NULL GROUP BY 1, 2),
latest AS (SELECT series, t, CASE WHEN isnan(f.funding_rate) THEN NULL ELSE f.funding_rate END AS funding_rate FROM points JOIN funding_rates f ON f.row_id = points.row_id AND f.ts_unix * 1000 = t AND f.collector || ':' || regexp_replace(f.symbol, 'USDT$', '') = series)"""
QUERIES["asof_funding"] = asof_funding
SQL["asof_funding"] = f"WITH {_BARS}, {_POINTS} SELECT b.series, b.us, p.t AS matched_us, p.funding_rate FROM bars b ASOF LEFT JOIN latest p ON b.series = p.series AND b.us >= p.t"


def asof_nearest_funding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.asof_nearest(bars(spark, sf_dir).select("series", "us"), _funding_points(spark, sf_dir), ["series"], "us", "t", "funding_rate", 7_200_000_000)


QUERIES["asof_nearest_funding"] = asof_nearest_funding
SQL["asof_nearest_funding"] = f"""WITH {_BARS}, {_POINTS} SELECT series, us, CASE WHEN gap <= 7200000000 THEN funding_rate END AS funding_rate FROM (SELECT b.series, b.us, p.funding_rate, abs(p.t - b.us) AS gap,
 row_number() OVER (PARTITION BY b.series, b.us ORDER BY abs(p.t - b.us) NULLS LAST, p.t) AS rn FROM bars b LEFT JOIN latest p ON p.series = b.series) q WHERE rn = 1"""


def date_align_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    eph = keep_last(read_table(spark, sf_dir, "ephemeris").withColumn("d", F.col("date").try_cast("date")), ["d"], "row_id", ["moon_mansion", "planetary_strength"])
    return align.by_date(bars(spark, sf_dir).select("series", "us"), eph, "d", ["moon_mansion", "planetary_strength"])


QUERIES["date_align_filled"] = date_align_filled
SQL["date_align_filled"] = f"""WITH {_BARS}, e AS (SELECT CAST(date AS DATE) AS d, moon_mansion, CASE WHEN NOT isnan(planetary_strength) THEN planetary_strength END AS planetary_strength FROM ephemeris
 QUALIFY row_number() OVER (PARTITION BY CAST(date AS DATE) ORDER BY row_id DESC) = 1), j AS (SELECT series, us, moon_mansion, planetary_strength FROM bars LEFT JOIN e ON CAST(make_timestamp(us) AS DATE) = d)
 SELECT series, us, {', '.join(f'last_value({c} IGNORE NULLS) OVER (PARTITION BY series ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {c}' for c in ('moon_mansion', 'planetary_strength'))} FROM j"""


# ---------------------------------------------------------------- validation
HELD_US = 5 * 86_400_000_000


def cpcv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every path and role after purge and embargo, for labels that end five days later."""
    b = bars(spark, sf_dir)
    rows = b.select("series", "us", F.col("us").alias("t0"), (F.col("us") + HELD_US).alias("t1"))
    s = validate.cpcv_splits(rows)
    return s.groupBy("path", "role").agg(F.count(F.lit(1)).alias("n"))


SQL["cpcv_splits"] = f"""WITH {_BARS}, r AS (SELECT us AS t0, us + {HELD_US} AS t1 FROM bars), q AS (SELECT quantile_cont(t0, [1/6, 2/6, 3/6, 4/6, 5/6]) AS c, (max(t0) - min(t0)) * 0.01 AS gap FROM r),
g AS (SELECT t0, t1, len(list_filter(q.c, lambda x: x <= t0)) AS g, q.gap FROM r, q), b AS (SELECT g, min(t0) AS a, max(t1) AS z FROM g GROUP BY g),
p AS (SELECT row_number() OVER (ORDER BY x.i, y.i) - 1 AS path, x.i AS g1, y.i AS g2 FROM (SELECT unnest(range(6)) AS i) x, (SELECT unnest(range(6)) AS i) y WHERE x.i < y.i),
e AS (SELECT p.path, CASE WHEN g.g IN (p.g1, p.g2) THEN 'test' WHEN g.t0 <= b1.z + g.gap AND g.t1 >= b1.a OR g.t0 <= b2.z + g.gap AND g.t1 >= b2.a THEN NULL ELSE 'train' END AS role
 FROM g, p JOIN b b1 ON b1.g = p.g1 JOIN b b2 ON b2.g = p.g2) SELECT path, role, count(*) AS n FROM e WHERE role IS NOT NULL GROUP BY 1, 2"""


_TOUCH = lambda show: feature_query(validate.triple_barrier, bars, DUCK_BARS, show)
_touched, _touch_sql = _TOUCH(["pos_i", "held_i"])


def sample_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of 1 / concurrency over every label's bars: from its bar to the barrier touched first, or the last bar held."""
    rows = _touched(spark, sf_dir).where("held_i is not null").select("series", "us", F.col("us").alias("id"), F.col("pos_i").alias("t0"), (F.col("pos_i") + F.col("held_i")).alias("t1"))
    return validate.uniqueness(rows).select("series", "us", F.col("uniqueness").cast("float").cast("double").alias("uniqueness"))


QUERIES["cpcv_splits"] = cpcv
QUERIES["sample_uniqueness"] = sample_uniqueness
SQL["sample_uniqueness"] = f"""WITH r AS MATERIALIZED (SELECT series, us, pos_i AS t0, pos_i + held_i AS t1 FROM ({_touch_sql}) x WHERE held_i IS NOT NULL),
g AS (SELECT series, unnest(range(min(t0), max(t1) + 1)) AS pos FROM r GROUP BY series), c AS MATERIALIZED (SELECT g.series, g.pos, count(*) AS k FROM g JOIN r b ON g.series = b.series AND b.t0 <= g.pos AND b.t1 >= g.pos GROUP BY 1, 2)
SELECT r.series, r.us, {f32('avg(1.0 / k)')} AS uniqueness FROM r JOIN c ON c.series = r.series AND c.pos BETWEEN r.t0 AND r.t1 GROUP BY 1, 2"""
