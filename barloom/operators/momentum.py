"""Exponential averages as windows, and the feature groups that stand on them.

An exponential average is sum(w x) / sum(w) with weights falling by r = 1 - alpha a bar. Bars are numbered once and cut
into blocks; inside a block both sums are running window sums of x r^-i, and what the blocks before contribute is read
from their last rows by fixed lags and spread over the block. Two orders of windows serve any number of columns: no
fold, no join, no Python, and no power beyond one block's length. Weights follow positions, as usual: a missing value
keeps the average and lets its weight decay (for adjust=False the weights are normalised but not reset after a gap)."""

from __future__ import annotations

import math

from barloom.plans.portable import Dialect, Stages, change, flag, lag, over, ratio, rolling

BLOCK = 256


def ewm(d: Dialect, columns: dict[str, tuple[str, float, bool, int]], tag: str, part: str = "series", order: str = "us") -> Stages:
    """Stages adding name -> (input column, alpha, adjust, least): NULL until `least` values are present.

    adjust=False starts from the first value with full weight, adjust=True weights all values alike. Helper columns begin
    with `tag`."""
    block = min(BLOCK, *(max(8, int(300 / -math.log(1 - a))) for _, a, _, _ in columns.values()))
    inputs = list(dict.fromkeys(x for x, *_ in columns.values()))
    s1 = {f"{tag}pos": f"row_number() OVER (PARTITION BY {part} ORDER BY {order})"} | {f"{tag}n{i}": f"count({x}) {over()}" for i, x in enumerate(inputs)}
    s2 = {f"{tag}blk": d.div(f"{tag}pos - 1", str(block)), f"{tag}i": f"({tag}pos - 1) % {block} + 1"}
    inside = f"OVER (PARTITION BY {part}, {tag}blk ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    s3, s4, s5, s6 = {}, {}, {}, {}
    for k, (name, (x, alpha, adjust, least)) in enumerate(columns.items()):
        r, n = 1 - alpha, f"{tag}n{inputs.index(x)}"
        grow = f"power({r!r}, -{tag}i)"
        w = grow if adjust else f"CASE WHEN {n} = 1 THEN 1e0 ELSE {alpha!r} END * {grow}"
        s3[f"{tag}s{k}"] = f"sum(CASE WHEN {x} IS NOT NULL THEN {w} * {x} END) {inside}"
        s3[f"{tag}q{k}"] = f"sum(CASE WHEN {x} IS NOT NULL THEN {w} END) {inside}"
        reach = max(1, math.ceil(math.log(1e-18) / (block * math.log(r))))
        for c in "sq":
            terms = " + ".join(f"coalesce({lag(f'{tag}{c}{k}', 1 + block * j)}, 0) * {r ** (block * (j + 1))!r}" for j in range(reach))
            s4[f"{tag}c{c}{k}"] = f"CASE WHEN {tag}i = 1 THEN {terms} END"
            s5[f"{tag}b{c}{k}"] = f"first_value({tag}c{c}{k}) {inside}"
        top, bottom = (f"coalesce({tag}{c}{k}, 0) + {tag}b{c}{k}" for c in "sq")
        s6[name] = f"CASE WHEN {n} >= {max(least, 1)} THEN ({top}) / nullif({bottom}, 0) END"
    return [s1, s2, s3, s4, s5, s6]


SPANS = (5, 10, 20, 50, 100, 200)
PERIODS = (7, 14, 21)
#: Bars of the daily timeframe's lags.
LAGS = (1, 3, 7, 14, 30)


def _rsi(gain: str, loss: str) -> str:
    """100 where there are gains and no losses."""
    return f"CASE WHEN {loss} = 0 AND {gain} > 0 THEN 100e0 ELSE 100 - 100 / (1 + {gain} / nullif({loss}, 0)) END"


def _snap(x: str) -> str:
    """x, or 0 where it is nothing beside the price but what is left of a difference of equal values."""
    return f"CASE WHEN abs({x}) < 1e-9 * close THEN 0e0 ELSE {x} END"


def _moves() -> Stages:
    return [{"d": f"close - {lag('close')}"}, {"gain": "CASE WHEN d IS NOT NULL THEN greatest(d, 0e0) END", "loss": "CASE WHEN d IS NOT NULL THEN greatest(-d, 0e0) END"}]


def averages(d: Dialect) -> Stages:
    """Exponential averages and the close's distance to them, Wilder's RSI with its zones, MACD with its crossings."""
    first = {f"ema_{n}": ("close", 2 / (n + 1), False, 1) for n in (*SPANS, 12, 26)}
    first |= {f"g_{n}": ("gain", 1 / n, True, n) for n in PERIODS} | {f"l_{n}": ("loss", 1 / n, True, n) for n in PERIODS}
    s = {f"close_vs_ema_{n}": f"round({ratio(f'close - ema_{n}', f'ema_{n}')}, 8) + 0e0" for n in SPANS} | {f"rsi_{n}": f"round({_rsi(f'g_{n}', f'l_{n}')}, 8)" for n in PERIODS}
    s |= {"macd_line": _snap("ema_12 - ema_26")}
    flags = {"rsi_14_ob": flag("rsi_14 > 70"), "rsi_14_os": flag("rsi_14 < 30"), "macd_histogram": _snap("macd_line - signal_raw"), "gap": "round(macd_line - signal_raw, 8)"}
    cross = {"macd_cross_up": flag(f"gap > 0 AND {lag('gap')} <= 0"), "macd_cross_down": flag(f"gap < 0 AND {lag('gap')} >= 0")}
    return [*_moves(), *ewm(d, first, "e_"), s, *ewm(d, {"signal_raw": ("macd_line", 2 / 10, False, 1)}, "f_"), {"macd_signal": _snap("signal_raw")}, flags, cross]


AVERAGES = [f"ema_{n}" for n in SPANS] + [f"close_vs_ema_{n}" for n in SPANS] + [f"rsi_{n}" for n in PERIODS] + ["rsi_14_ob", "rsi_14_os", "macd_line", "macd_signal", "macd_histogram", "macd_cross_up", "macd_cross_down"]


def directional(d: Dialect) -> Stages:
    """Directional movement index, Keltner channel, slope regime of the 50-bar average, breakout side, up and down volatility."""
    s1 = {"up": f"high - {lag('high')}", "dn": f"{lag('low')} - low", "tr": f"greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')}))", "ret": change("close"), "log_ret": f"ln(close / {lag('close')})"}
    s2 = {
        "pdm": "CASE WHEN up > dn AND up > 0 THEN up WHEN up IS NOT NULL THEN 0e0 END", "mdm": "CASE WHEN dn > up AND dn > 0 THEN dn WHEN up IS NOT NULL THEN 0e0 END",
        "down_ret": "CASE WHEN ret IS NULL THEN NULL WHEN ret < 0 THEN ret ELSE 0e0 END", "up_ret": "CASE WHEN ret IS NULL THEN NULL WHEN ret > 0 THEN ret ELSE 0e0 END",
        "atr_14": rolling("avg", "tr", 14), "atr_10": rolling("avg", "tr", 10), "rv": rolling("stddev_samp", "log_ret", 10, digits=None),
        "hi480": rolling("max", "high", 480, 10), "lo480": rolling("min", "low", 480, 10),
    }
    first = {"p": ("pdm", 2 / 15, True, 1), "m": ("mdm", 2 / 15, True, 1), "keltner_mid": ("close", 2 / 21, True, 1), "ema50": ("close", 2 / 51, True, 1)}
    s3 = {"pdi": ratio("100 * p", "atr_14"), "mdi": ratio("100 * m", "atr_14"), "keltner_upper": "keltner_mid + 2 * atr_10", "keltner_lower": "keltner_mid - 2 * atr_10",
          "ema50_slope": f"round(100 * {change('ema50', 5)}, 8)", "rv_mean": rolling("avg", "rv", 50, digits=None), "rv_sd": rolling("stddev_samp", "rv", 50, digits=None),
          "down_vol": rolling("stddev_samp", "down_ret", 30, digits=None), "up_vol": rolling("stddev_samp", "up_ret", 30, digits=None)}
    s4 = {"dx": ratio("100 * abs(pdi - mdi)", "pdi + mdi"), "ema50_rising": flag("ema50_slope > 3"), "ema50_declining": flag("ema50_slope < -3"),
          "breakout_side_i": "CASE WHEN round(close - ema50, 6) > 0 THEN 1 WHEN round(close - ema50, 6) < 0 THEN -1 ELSE 0 END", "volatility_z": ratio("rv - rv_mean", "rv_sd"),
          "volatility_asymmetry": ratio("down_vol", "up_vol"), "range_position": f"least(1e0, greatest(0e0, {ratio('close - lo480', 'hi480 - lo480')}))"}
    return [s1, s2, *ewm(d, first, "e_"), s3, s4, *ewm(d, {"adx_14": ("dx", 2 / 15, True, 1)}, "f_")]


DIRECTIONAL = ["adx_14", "keltner_mid", "keltner_upper", "keltner_lower", "ema50_slope", "ema50_rising", "ema50_declining", "breakout_side_i", "volatility_z", "volatility_asymmetry", "range_position"]


def signals(d: Dialect) -> Stages:
    """Interactions, bullish divergence, lags, counts of bullish and bearish signals, crossings remembered over lags."""
    s0 = {
        "tr": f"greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')}))", "m20": rolling("avg", "close", 20), "sd20": rolling("stddev_samp", "close", 20),
        "v20": rolling("avg", "volume", 20, digits=None), "red": flag("close < open"), "sma_50": rolling("avg", "close", 50), "sma_200": rolling("avg", "close", 200),
        "prev_open": lag("open"), "prev_close": lag("close"), "price_low": flag(f"close = min(close) {over(480)} AND count(close) {over(480)} >= 480"), "bar": "row_number() OVER (PARTITION BY series ORDER BY us)",
    }
    s1 = {
        "atr_14": rolling("avg", "tr", 14), "bb_pctb_20": "round(" + ratio("close - m20 + 2 * sd20", "4 * sd20") + ", 8)", "volume_ratio": ratio("volume", "v20"),
        "red_reset": f"max(CASE WHEN red = 0 OR bar = 1 THEN bar ELSE 0 END) {over()}", "body": "abs(close - open) / nullif(high - low, 0)",
        "lower_wick": "(least(open, close) - low) / nullif(high - low, 0)", "upper_wick": "(high - greatest(open, close)) / nullif(high - low, 0)",
        "golden_cross": flag(f"sma_50 > sma_200 AND {lag('sma_50')} <= {lag('sma_200')}"), "death_cross": flag(f"sma_50 < sma_200 AND {lag('sma_50')} >= {lag('sma_200')}"),
        "above_sma200": flag("close > sma_200"), "bull_engulfing": flag("close > open AND prev_close < prev_open AND close > prev_open AND open < prev_close"),
        "bear_engulfing": flag("close < open AND prev_close > prev_open AND close < prev_open AND open > prev_close"),
    }
    first = {"g_14": ("gain", 1 / 14, True, 14), "l_14": ("loss", 1 / 14, True, 14), "ema_12": ("close", 2 / 13, False, 1), "ema_26": ("close", 2 / 27, False, 1)}
    s2 = {"rsi_14": f"round({_rsi('g_14', 'l_14')}, 8)", "macd_line": "ema_12 - ema_26", "hammer": flag("lower_wick > 0.6 AND body < 0.3"), "shooting_star": flag("upper_wick > 0.6 AND body < 0.3")}
    s3 = {
        "gap": "round(macd_line - macd_signal, 8)", "macd_histogram": "macd_line - macd_signal", "rsi_14_ob": flag("rsi_14 > 70"), "rsi_14_os": flag("rsi_14 < 30"), "volume_spike": flag("volume_ratio > 2"),
        "rsi_x_bbpctb": "rsi_14 * bb_pctb_20", "volume_x_atr": f"volume_ratio * {ratio('atr_14', 'close')}", "consec_red_x_bb_os_i": "CASE WHEN bb_pctb_20 < 0 THEN bar - red_reset ELSE 0 END",
        "rsi_low": flag(f"rsi_14 = min(rsi_14) {over(480)} AND count(rsi_14) {over(480)} >= 480"),
    }
    s4 = {"macd_cross_up": flag(f"gap > 0 AND {lag('gap')} <= 0"), "macd_cross_down": flag(f"gap < 0 AND {lag('gap')} >= 0"), "rsi_bullish_div": flag("price_low = 1 AND rsi_low = 0")}
    s4 |= {f"{x}_lag{k}": lag(x, k) for x in ("rsi_14", "bb_pctb_20", "volume_ratio", "macd_histogram") for k in LAGS}
    s4 |= {f"was_overbought_{k}_i": lag("rsi_14_ob", k) for k in (3, 7)} | {f"was_oversold_{k}_i": lag("rsi_14_os", k) for k in (3, 7)} | {f"had_volume_spike_{k}_i": lag("volume_spike", k) for k in (1, 3)}
    s4 |= {f"{x}_lag{k}_i": lag(x, k) for x in ("golden_cross", "death_cross", "bull_engulfing", "bear_engulfing") for k in (1, 3, 5, 7)}
    s5 = {f"{x}_lag{k}_i": lag(x, k) for x in ("macd_cross_up", "macd_cross_down") for k in (1, 3, 5, 7)}
    s5 |= {"num_bullish_i": "above_sma200 + golden_cross + macd_cross_up + bull_engulfing + hammer", "num_bearish_i": "death_cross + macd_cross_down + bear_engulfing + shooting_star + rsi_14_ob"}
    return [*_moves(), s0, s1, *ewm(d, first, "e_"), s2, *ewm(d, {"macd_signal": ("macd_line", 2 / 10, False, 1)}, "f_"), s3, s4, s5, {"signal_agreement_i": "num_bullish_i - num_bearish_i"}]


SIGNALS = (
    ["rsi_x_bbpctb", "volume_x_atr", "consec_red_x_bb_os_i", "rsi_bullish_div", "num_bullish_i", "num_bearish_i", "signal_agreement_i"]
    + [f"{x}_lag{k}" for x in ("rsi_14", "bb_pctb_20", "volume_ratio", "macd_histogram") for k in LAGS]
    + [f"was_{x}_{k}_i" for x in ("overbought", "oversold") for k in (3, 7)] + [f"had_volume_spike_{k}_i" for k in (1, 3)]
    + [f"{x}_lag{k}_i" for x in ("golden_cross", "death_cross", "bull_engulfing", "bear_engulfing", "macd_cross_up", "macd_cross_down") for k in (1, 3, 5, 7)]
)


def variants(d: Dialect) -> Stages:
    """Conditional-mean RSI (mean of gains only over mean of losses only), ATR whose first range is 0, average seeded by a simple mean."""
    s1 = {"bar": "row_number() OVER (PARTITION BY series ORDER BY us)", "d": f"close - {lag('close')}", "seed12": rolling("avg", "close", 12, digits=None),
          "tr0": f"CASE WHEN {lag('close')} IS NULL THEN 0e0 ELSE greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) END"}
    s2 = {"mean_gain": f"avg(CASE WHEN d > 0 THEN d END) {over(14)}", "mean_loss": f"avg(CASE WHEN d < 0 THEN -d END) {over(14)}", "changes": f"count(d) {over(14)}",
          "atr_zero_start": rolling("avg", "tr0", 14), "seeded": "CASE WHEN bar = 12 THEN seed12 WHEN bar > 12 THEN close END"}
    s3 = {"rsi_conditional": "CASE WHEN changes >= 14 THEN 100 - 100 / (1 + coalesce(mean_gain, 0) / nullif(coalesce(mean_loss, 0), 0)) END"}
    return [s1, s2, s3, *ewm(d, {"ema_seeded_12": ("seeded", 2 / 13, False, 1)}, "e_")]


VARIANTS = ["rsi_conditional", "atr_zero_start", "ema_seeded_12"]
