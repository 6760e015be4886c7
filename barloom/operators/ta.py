"""Technical analysis over bar series as windows (no Python): each function returns the stages of one group."""

from __future__ import annotations

from barloom.plans.portable import Dialect, Stages, change, flag, lag, over, ratio, rolling

SMA = (5, 10, 20, 50, 100, 200)


def moving_averages(d: Dialect) -> Stages:
    """Simple averages, distance to them, slopes, 50/200 crossings, ordering score of all pairs."""
    s1 = {f"sma_{n}": rolling("avg", "close", n) for n in SMA}
    s2 = {f"close_vs_sma_{n}": ratio(f"close - sma_{n}", f"sma_{n}") for n in SMA}
    s2 |= {f"sma_{n}_slope": change(f"sma_{n}", 5) for n in (20, 50, 200)}
    s2 |= {
        "golden_cross": flag(f"sma_50 > sma_200 AND {lag('sma_50')} <= {lag('sma_200')}"),
        "death_cross": flag(f"sma_50 < sma_200 AND {lag('sma_50')} >= {lag('sma_200')}"),
        "above_sma200": flag("close > sma_200"),
    }
    pairs = [(a, b) for i, a in enumerate(SMA) for b in SMA[i + 1 :]]
    s2["consensio_score"] = " + ".join(f"({flag(f'sma_{a} > sma_{b}')})" for a, b in pairs)
    s3 = {"consensio_green": flag("consensio_score = 15"), "consensio_red": flag("consensio_score = 0"), "consensio_wave": "2 * consensio_score - 15"}
    return [s1, s2, s3]


def bands(d: Dialect) -> Stages:
    """Bollinger bands and squeeze, Donchian channel, stochastic, Williams %R, commodity channel index."""
    s1 = {
        "m20": rolling("avg", "close", 20), "sd20": rolling("stddev_samp", "close", 20), "hi14": rolling("max", "high", 14),
        "lo14": rolling("min", "low", 14), "donchian_high": rolling("max", "high", 20), "donchian_low": rolling("min", "low", 20),
        "tp": "(high + low + close) / 3",
    }
    s2 = {
        "bb_upper_20": "m20 + 2 * sd20", "bb_lower_20": "m20 - 2 * sd20", "bb_width_20": "round(" + ratio("4 * sd20", "m20") + ", 10)",
        "stoch_k_14": ratio("100 * (close - lo14)", "hi14 - lo14"), "williams_r_14": ratio("-100 * (hi14 - close)", "hi14 - lo14"),
        "tp_m20": rolling("avg", "tp", 20), "tp_sd20": rolling("stddev_samp", "tp", 20),
    }
    s3 = {
        "bb_pctb_20": ratio("close - bb_lower_20", "bb_upper_20 - bb_lower_20"),
        "squeeze_at": f"CASE WHEN count(bb_width_20) {over(500)} >= 100 THEN round({d.quantile('bb_width_20', 0.1, over(500))}, 8) END",
        "stoch_d_14": rolling("avg", "stoch_k_14", 3),
        "cci_20": ratio("tp - tp_m20", "0.015 * tp_sd20"),
    }
    return [s1, s2, s3, {"bb_squeeze_20": flag("bb_width_20 < squeeze_at")}]


def ranges(d: Dialect) -> Stages:
    """True range, ATR, returns, volatilities, drawdown, supertrend (unratcheted), pivots."""
    s1 = {
        "tr": f"greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')}))",
        "return_1bar": change("close"), "return_5bar": change("close", 5), "return_10bar": change("close", 10),
        "peak": f"max(close) {over()}", "pivot_p": f"({lag('high')} + {lag('low')} + {lag('close')}) / 3",
        "prev_high": lag("high"), "prev_low": lag("low"),
    }
    s2 = {
        "atr_14": rolling("avg", "tr", 14), "atr_10": rolling("avg", "tr", 10),
        "volatility_5bar": rolling("stddev_samp", "return_1bar", 5), "volatility_20bar": rolling("stddev_samp", "return_1bar", 20),
        "current_dd_depth": ratio("close - peak", "peak"),
        "pivot_r1": "2 * pivot_p - prev_low", "pivot_s1": "2 * pivot_p - prev_high", "pivot_r2": "pivot_p + (prev_high - prev_low)",
        "pivot_s2": "pivot_p - (prev_high - prev_low)", "close_vs_pivot": ratio("close - pivot_p", "pivot_p"),
    }
    s3 = {
        "atr_14_pct": ratio("atr_14", "close"), "volatility_ratio": ratio("volatility_5bar", "volatility_20bar"),
        "st_up": "round((high + low) / 2 + 3 * atr_10, 10)", "st_dn": "round((high + low) / 2 - 3 * atr_10, 10)",
    }
    s4 = {"st_event": f"CASE WHEN close > {lag('st_up')} THEN 1 WHEN close < {lag('st_dn')} THEN -1 END"}
    s5 = {"supertrend_dir": f"coalesce({d.last('st_event', over())}, 1)"}
    s6 = {
        "supertrend_value": "CASE WHEN supertrend_dir = 1 THEN st_dn ELSE st_up END",
        "supertrend_flip": flag(f"supertrend_dir <> {lag('supertrend_dir')}"), "supertrend_bullish": flag("supertrend_dir = 1"),
    }
    return [s1, s2, s3, s4, s5, s6]


def volume(d: Dialect) -> Stages:
    """Volume ratio and spike, taker ratio, on-balance volume, rolling VWAP, money flow, Chaikin flow, cumulative delta."""
    s1 = {
        "volume_sma_20": rolling("avg", "volume", 20, digits=None), "taker_buy_ratio": ratio("taker_buy_volume", "volume"),
        "signed": f"CASE WHEN close > {lag('close')} THEN volume WHEN close < {lag('close')} THEN -volume ELSE 0 END",
        "tp": "(high + low + close) / 3", "clv": f"coalesce({ratio('(close - low) - (high - close)', 'high - low')}, 0) * volume",
        "delta": "2 * taker_buy_volume - volume",
    }
    s2 = {
        "volume_ratio": ratio("volume", "volume_sma_20"), "obv": f"sum(coalesce(signed, 0)) {over()}",
        "vwap_20": ratio(rolling("sum", "tp * volume", 20, digits=None), rolling("sum", "volume", 20, digits=None)),
        "flow_up": f"CASE WHEN tp > {lag('tp')} THEN tp * volume WHEN tp IS NOT NULL THEN 0.0 END",
        "flow_down": f"CASE WHEN tp < {lag('tp')} THEN tp * volume WHEN tp IS NOT NULL THEN 0.0 END",
        "cmf_20": ratio(rolling("sum", "clv", 20, digits=None), rolling("sum", "volume", 20, digits=None)),
        "cvd": f"sum(coalesce(delta, 0)) {over()}", "delta_ratio": ratio("delta", "volume"),
    }
    s3 = {
        "volume_spike": flag("volume_ratio > 2"), "obv_sma_20": rolling("avg", "obv", 20, digits=None), "close_vs_vwap": ratio("close - vwap_20", "vwap_20"),
        "mfi_up": rolling("sum", "flow_up", 14, digits=None), "mfi_down": rolling("sum", "flow_down", 14, digits=None),
        "cvd_cross": flag(f"(cvd > 0) <> ({lag('cvd')} > 0)"),
    }
    s4 = {"obv_trend": flag("obv - obv_sma_20 > 0.000001"), "mfi_14": f"100 - 100 / (1 + {ratio('mfi_up', 'mfi_down')})"}
    return [s1, s2, s3, s4]


def candles(d: Dialect) -> Stages:
    """Bodies, wicks, one- and two-bar patterns, run lengths, gaps, structure breaks, sweeps."""
    rng = "nullif(high - low, 0)"
    s1 = {
        "body_pct": f"abs(close - open) / {rng}", "upper_wick": f"(high - greatest(open, close)) / {rng}", "lower_wick": f"(least(open, close) - low) / {rng}",
        "prev_open": lag("open"), "prev_close": lag("close"), "green": flag("close > open"), "red": flag("close < open"),
        "fvg_bullish": flag(f"{lag('high', 2)} < low"), "fvg_bearish": flag(f"{lag('low', 2)} > high"),
        "hi20": rolling("max", "high", 20, skip=1), "lo20": rolling("min", "low", 20, skip=1),
        "pos": "row_number() OVER (PARTITION BY series ORDER BY us)",
    }
    s2 = {
        "doji": flag("body_pct < 0.1"), "hammer": flag("lower_wick > 0.6 AND body_pct < 0.3"), "shooting_star": flag("upper_wick > 0.6 AND body_pct < 0.3"),
        "bull_engulfing": flag("close > open AND prev_close < prev_open AND close > prev_open AND open < prev_close"),
        "bear_engulfing": flag("close < open AND prev_close > prev_open AND close < prev_open AND open > prev_close"),
        "green_reset": f"max(CASE WHEN green = 0 OR pos = 1 THEN pos ELSE 0 END) {over()}",
        "red_reset": f"max(CASE WHEN red = 0 OR pos = 1 THEN pos ELSE 0 END) {over()}",
        "bos_direction": "CASE WHEN close > hi20 THEN 1 WHEN close < lo20 THEN -1 ELSE 0 END",
        "liquidity_sweep": "CASE WHEN pos >= 21 AND high > hi20 AND close < hi20 THEN -1 WHEN pos >= 21 AND low < lo20 AND close > lo20 THEN 1 ELSE 0 END",
        "last_red": d.last("CASE WHEN close < open THEN (open + close) / 2 END", over(20, skip=1)),
        "last_green": d.last("CASE WHEN close > open THEN (open + close) / 2 END", over(20, skip=1)),
    }
    s3 = {
        "consec_green_i": "pos - green_reset", "consec_red_i": "pos - red_reset",
        "block": "CASE WHEN bos_direction = 1 THEN last_red WHEN bos_direction = -1 THEN last_green END",
    }
    s4 = {"order_block_distance": ratio(f"close - {d.last('block', over())}", "close")}
    return [s1, s2, s3, s4]


def channels(d: Dialect) -> Stages:
    """Ichimoku, golden-ratio extensions, Gann square of nine, anchored VWAP from the 51-bar swing points."""
    mid = lambda n: f"({rolling('max', 'high', n)} + {rolling('min', 'low', n)}) / 2"
    s1 = {
        "tenkan": mid(9), "kijun": mid(26), "senkou_b_now": mid(52), "hi200": rolling("max", "high", 200, 50), "lo200": rolling("min", "low", 200, 50),
        "root": "sqrt(close)", "pos": "row_number() OVER (PARTITION BY series ORDER BY us)",
        # whole millionths, so that differences of long running sums are exact
        "pv_sum": f"sum(CAST(round((high + low + close) / 3 * coalesce(volume, 0) * 1000000) AS DECIMAL(38, 0))) {over()}", "v_sum": f"sum(CAST(round(coalesce(volume, 0) * 1000000) AS DECIMAL(38, 0))) {over()}",
        "lo51": f"min(low) {over(51)}", "hi51": f"max(high) {over(51)}",
    }
    s2 = {
        "senkou_a": lag("(tenkan + kijun) / 2", 26), "senkou_b": lag("senkou_b_now", 26),
        "tk_cross": flag(f"tenkan > kijun AND {lag('tenkan')} <= {lag('kijun')}"),
        "gann_lower": "power(floor(root), 2)", "gann_upper": "power(ceil(root), 2)",
        "fib_ext_1618": "lo200 + 1.618 * (hi200 - lo200)", "fib_618": "hi200 - 0.618 * (hi200 - lo200)",
        "pv_before": f"coalesce({lag('pv_sum')}, 0)", "v_before": f"coalesce({lag('v_sum')}, 0)",
    }
    s3 = {
        "above_cloud": flag("close > greatest(senkou_a, senkou_b)"), "below_cloud": flag("close < least(senkou_a, senkou_b)"),
        "gann_level": "CASE WHEN close - gann_lower <= gann_upper - close THEN gann_lower ELSE gann_upper END",
        "golden_ratio_dist": ratio("close - fib_618", "close"),
        "low_pv": _arg(d, "min", "low", "pv_before", 51),
        "low_v": _arg(d, "min", "low", "v_before", 51), "high_pv": _arg(d, "max", "high", "pv_before", 51), "high_v": _arg(d, "max", "high", "v_before", 51),
    }
    s4 = {
        "gann_distance": ratio("close - gann_level", "close"),
        **{f"avwap_{s}": ratio(f"CAST(pv_sum - {s}_pv AS DOUBLE)", f"CAST(v_sum - {s}_v AS DOUBLE)") for s in ("low", "high")},
        "fib_21": "lo200 + 0.21 * (hi200 - lo200)", "fib_13": "lo200 + 0.13 * (hi200 - lo200)", "near_golden": flag("abs(close - fib_618) / close < 0.01"), "near_ext": flag("abs(close - fib_ext_1618) / close < 0.01"),
    }
    return [s1, s2, s3, s4, {"avwap_position": ratio("close - avwap_low", "avwap_high - avwap_low"), "near_fib_21": flag("abs(close - fib_21) / close < 0.01"), "near_fib_13": flag("abs(close - fib_13) / close < 0.01")}]


def _arg(d: Dialect, best: str, by: str, value: str, n: int) -> str:
    """`value` at the first row of the frame where `by` is least (or greatest)."""
    key = by if best == "min" else f"-{by}"
    if d.duck:
        return f"(min({{'k': {key}, 'p': pos, 'v': {value}}}) {over(n)}).v"
    return f"(min(named_struct('k', {key}, 'p', pos, 'v', {value})) {over(n)}).v"
