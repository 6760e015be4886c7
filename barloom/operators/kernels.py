"""Sequence kernels: exponential averages by block scan, runs, bars-since, decay, OLS slope, fractional differences."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.plans.portable import Dialect, Stages, change, flag, lag, over, rolling


def kernels(d: Dialect) -> Stages:
    """Bars since an event and its decays, rolling OLS slope, rolling quantile of the past."""
    s1 = {
        "pos": "row_number() OVER (PARTITION BY series ORDER BY us)", "ret": f"round({change('close')}, 8)",
        "event": flag(f"high > 1.02 * {lag('high')}"),
    }
    s2 = {
        "event_pos": d.last("CASE WHEN event = 1 THEN pos END", over()),
        "sy": rolling("sum", "close", 10), "sxy": rolling("sum", "close * (pos % 1000000)", 10),
        "past": d.sort(d.filter(d.collect("ret", over(200, skip=1)), "v", "v IS NOT NULL")),
    }
    s3 = {
        "bars_since_i": "pos - event_pos", "return_since_event": f"(close - {d.last('CASE WHEN event = 1 THEN close END', over())}) / close",
        "slope_10": "round((sxy - (pos % 1000000 - 4.5) * sy) / 82.5, 6)",
        "q95_past": f"CASE WHEN {d.size('past')} >= 50 THEN {d.at('past', f'CAST(least(floor({d.size("past")} * 0.95), {d.size("past")} - 1) AS INT) + 1')} END",
    }
    s4 = {"decay_fast": "exp(-0.1 * bars_since_i)", "decay_slow": "exp(-0.05 * bars_since_i)", "ret_extreme": flag("ret > q95_past")}
    return [s1, s2, s3, s4]


def fracdiff_weights(order: float, least: float = 1e-5, longest: int = 100) -> list[float]:
    """w0 = 1, wk = -w(k-1) (d - k + 1) / k, until |w| < least or `longest` terms."""
    w = [1.0]
    while len(w) < longest:
        k = len(w)
        nxt = -w[-1] * (order - k + 1) / k
        if abs(nxt) < least:
            break
        w.append(nxt)
    return w


#: The columns of fractional differences, each with its input and order.
FRACTIONAL = {
    "close_02": ("close", 0.2), "close_04": ("close", 0.4), "close_06": ("close", 0.6), "log_close_04": ("log_close", 0.4), "volume_03": ("volume", 0.3), "obv_03": ("obv", 0.3),
}


def fractional_differences(bars: DataFrame) -> DataFrame:
    """(series, us, fracdiff_...): every column of FRACTIONAL with its full weights, over one collected window.

    NULL for the first bars without a full window and where under half of its values are present; else a missing value
    counts as 0."""
    w = Window.partitionBy("series").orderBy("us")
    step = F.signum(F.col("close") - F.lag("close").over(w)) * F.col("volume")
    b = bars.withColumn("_step", F.coalesce(step, F.lit(0.0)))
    obv = F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))
    inputs = {"close": F.col("close"), "log_close": F.when(F.col("close") > 0, F.ln("close")), "volume": F.col("volume"), "obv": obv}
    b = b.select("series", "us", *(e.cast("double").alias(n) for n, e in inputs.items()))
    weights = {n: fracdiff_weights(order) for n, (_, order) in FRACTIONAL.items()}
    window = F.collect_list(F.struct(*inputs)).over(w.rowsBetween(-(max(map(len, weights.values())) - 1), 0))
    b = b.select("series", "us", window.alias("_w"))
    out = []
    for n, (source, _) in FRACTIONAL.items():
        size = len(weights[n])
        held = F.slice("_w", -size, size)[source]
        terms = F.zip_with(held, F.array(*map(F.lit, reversed(weights[n]))), lambda v, x: F.coalesce(v * x, F.lit(0.0)))
        present = F.size(F.filter(held, lambda v: v.isNotNull()))
        full = (F.size("_w") >= size) & (present * 2 >= size)
        total = F.aggregate(terms, F.lit(0.0), lambda a, v: a + v)
        out.append(F.when(full, total).alias(f"fracdiff_{n}"))
    return b.select("series", "us", *out)


def fractional_sql(head: str, body: str) -> str:
    """The same columns in DuckDB over the bars of `body`."""
    lists = {x: f"list({x}) OVER (PARTITION BY series ORDER BY us ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)" for x in ("close", "log_close", "volume", "obv")}
    cols = []
    for n, (x, order) in FRACTIONAL.items():
        w = list(reversed(fracdiff_weights(order)))
        k = len(w)
        held = f"l_{x}[len(l_{x}) - {k - 1}:]"
        cols.append(f"CASE WHEN len(l_{x}) >= {k} AND len(list_filter({held}, lambda v: v IS NOT NULL)) * 2 >= {k} THEN CAST(CAST(list_sum(list_transform(list_zip({held}, {w}), lambda p: coalesce(p[1] * p[2], 0))) AS FLOAT) AS DOUBLE) END AS fracdiff_{n}")
    return f"""{head}, s AS (SELECT *, coalesce(sign(close - lag(close) OVER (PARTITION BY series ORDER BY us)) * volume, 0) AS step, CASE WHEN close > 0 THEN ln(close) END AS log_close FROM ({body}) b),
o AS (SELECT *, sum(step) OVER (PARTITION BY series ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS obv FROM s), l AS (SELECT series, us, {', '.join(f'{e} AS l_{x}' for x, e in lists.items())} FROM o) SELECT series, us, {', '.join(cols)} FROM l"""
