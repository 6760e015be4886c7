"""Market columns of a bar from slower tables: macro series, on-chain values, funding, and higher timeframes.

`joined` gives bars with the day's last macro row, the collector's day of on-chain values (last present value, or sum) and
the mean funding rate of the day, by equality of day; the stages fill forward over the bars. `parents` aggregates the
bars of a series to a wider bucket, computes features on those, and gives every bar the ones of the last closed bucket:
the bucket before its own, so no running bucket is seen."""

from __future__ import annotations

from barloom.operators import momentum
from barloom.plans.portable import Dialect, Stages, change, compile_stages, flag, lag, over, ratio, rolling

#: The columns of the macro table.
TICKERS = ("spx", "nasdaq", "dxy", "gold", "vix", "us10y", "russell", "oil", "silver", "mstr", "coin", "hyg", "tlt", "ibit")


def joined(d: Dialect, bars: str, macro: str, chain: str, funding: str) -> str:
    """The bars with macro columns, on-chain day values and the day's mean funding rate."""
    last = ", ".join(f"{d.arg_max(d.clean(c), 'utc_us', 'id')} AS {o}" for c, o in (("fear_greed", "fg"), ("hash_rate", "hash"), ("open_interest", "oi"), ("coinbase_premium", "premium")))
    last = last.replace("CASE WHEN NOT isnan(fear_greed) THEN fear_greed END", "fear_greed")
    sums = ", ".join(f"coalesce(sum({d.clean(c)}), 0) AS {o}" for c, o in (("whale_volume_btc", "whale"), ("liq_long_vol", "liq_l"), ("liq_short_vol", "liq_s")))
    day = "CAST(substr(trim(date), 1, 10) AS DATE)"
    epoch = "DATE '1970-01-01'"
    since = f"datediff('day', {epoch}, {day})" if d.duck else f"datediff({day}, {epoch})"
    return f"""SELECT b.series, b.tf, b.us, b.close, b.high, b.low, b.volume, {', '.join(f'm.{c}' for c in TICKERS)}, c.fg, c.hash, c.oi, c.premium, c.whale, c.liq_l, c.liq_s, f.funding
 FROM {bars} b LEFT JOIN (SELECT day_n, {', '.join(f'{d.clean(c)} AS {c}' for c in TICKERS)} FROM (SELECT *, {since} AS day_n, row_number() OVER (PARTITION BY {day} ORDER BY row_id DESC) AS rn FROM {macro}) x WHERE rn = 1) m
  ON m.day_n = {d.day('b.us')}
 LEFT JOIN (SELECT collector, {d.day('utc_us')} AS day_n, {last}, {sums} FROM {chain} GROUP BY collector, {d.day('utc_us')}) c
  ON c.collector = split_part(b.series, ':', 1) AND c.day_n = {d.day('b.us')}
 LEFT JOIN (SELECT collector || ':' || regexp_replace(symbol, 'USDT$', '') AS key, {d.div('ts_unix', '86400000')} AS day_n, avg({d.clean('funding_rate')}) AS funding FROM {funding} WHERE ts_unix IS NOT NULL GROUP BY 1, 2) f
  ON f.key = b.series AND f.day_n = {d.day('b.us')}"""


def macro(d: Dialect) -> Stages:
    """Filled tickers with 5- and 20-bar changes, correlations of returns over 20, 30 and 90 bars, sign flips, decorrelation."""
    s1 = {f"macro_{c}": d.last(c, over()) for c in TICKERS} | {"ret": f"round({change('close')}, 10)"}
    s2 = {f"macro_{c}_roc_{k}": change(f"macro_{c}", k) for c in TICKERS for k in (5, 20)} | {f"r_{c}": f"round({change(f'macro_{c}')}, 10)" for c in ("spx", "dxy", "gold", "vix")}
    s3 = {f"{c}_corr_20": d.corr("ret", f"r_{c}", 20, 20) for c in ("dxy", "gold", "spx", "vix")}
    s3 |= {f"{c}_corr_{n}": d.corr("ret", f"r_{c}", n, n // 4) for c in ("spx", "dxy", "vix") for n in (30, 90)}
    s4 = {f"{c}_corr_shift": flag(f"sign({c}_corr_30) <> sign({c}_corr_90)") for c in ("spx", "dxy", "vix")}
    present = " + ".join(f"CASE WHEN {c}_corr_30 IS NULL THEN 0 ELSE 1 END" for c in ("spx", "dxy", "vix"))
    mean = " + ".join(f"coalesce(abs({c}_corr_30), 0)" for c in ("spx", "dxy", "vix"))
    s4 |= {"macro_decorrelation": flag(f"({mean}) / nullif({present}, 0) < 0.15"), "inverse_correlated": flag("vix_corr_30 < -0.2 OR dxy_corr_30 < -0.2"), "coupled": flag("abs(spx_corr_30) > 0.7")}
    return [s1, s2, s3, s4]


MACRO = [f"macro_{c}" for c in TICKERS] + [f"macro_{c}_roc_{k}" for c in TICKERS for k in (5, 20)] + [f"{c}_corr_20" for c in ("dxy", "gold", "spx", "vix")] + [f"{c}_corr_{n}" for c in ("spx", "dxy", "vix") for n in (30, 90)]
MACRO += [f"{c}_corr_shift" for c in ("spx", "dxy", "vix")] + ["macro_decorrelation", "inverse_correlated", "coupled"]


def _z(x: str, n: int, least: int) -> str:
    return f"CASE WHEN count({x}) {over(n)} >= {least} THEN ({x} - avg({x}) {over(n)}) / nullif(stddev_samp({x}) {over(n)}, 0) END"


def flows(d: Dialect) -> Stages:
    """Fear and greed, funding regime, liquidation cascade, open interest against price, whales, premium, hash rate."""
    fill = {f"{c}_f": d.last(c, over()) for c in ("fg", "hash", "oi", "premium", "funding")}
    s1 = fill | {"liq": "liq_l + liq_s", "price_5": f"round({change('close', 5)}, 10)", "price_z": _z("close", 30, 30), "whale_mid": rolling("sum", "whale", 5, 5, digits=None)}
    pos = "row_number() OVER (PARTITION BY series ORDER BY us)"
    s2 = {
        "fg_roc_5": change("fg_f", 5), "fg_fear": flag("fg_f < 20"), "fg_greed": flag("fg_f > 80"), "fg_z": _z("fg_f", 30, 30), **{f"fg_lag_{k}_i": lag("fg_f", k) for k in (1, 3, 5, 10)},
        "funding_high": flag("funding_f > 0.001"), "funding_neg": flag("funding_f < 0"), "funding_z30": f"round({_z('funding_f', 30, 7)}, 6)", "funding_z90": f"round({_z('funding_f', 90, 22)}, 6)",
        "liq_ratio": ratio("liq_l", "liq_s"), "liq_z": f"round({_z('liq', 20, 5)}, 6)", "liq_asymmetry": ratio("abs(liq_l - liq_s)", "liq"), "oi_change_5": f"round({change('oi_f', 5)}, 10)",
        "whale_z": f"round({_z('whale', 30, 5)}, 6)", "premium_positive": flag("premium_f > 0"), "premium_z": _z("premium_f", 20, 5), "hash_roc_7": f"round({change('hash_f', 7)}, 8)", "pos": pos,
    }
    s3 = {
        "fg_vs_price": "fg_z - price_z", "spike": flag("liq_z > 2"), "hash_capitulation": flag("hash_roc_7 < -0.1"),
        "funding_regime_i": "CASE WHEN funding_z30 > 2 THEN 2 WHEN funding_z30 > 0.5 THEN 1 WHEN funding_z30 < -2 THEN -2 WHEN funding_z30 < -0.5 THEN -1 ELSE 0 END",
        "oi_price": "CASE WHEN price_5 > 0 AND oi_change_5 < 0 THEN -1e0 WHEN price_5 < 0 AND oi_change_5 < 0 THEN 1e0 WHEN price_5 > 0 AND oi_change_5 > 0 THEN 0.5e0 WHEN price_5 < 0 AND oi_change_5 > 0 THEN -0.5e0 ELSE 0e0 END",
        "oi_funding_combo_i": "2 * CASE WHEN funding_f > 0 THEN 1 ELSE 0 END + CASE WHEN oi_change_5 > 0 THEN 1 ELSE 0 END - 1", "funding_x_oi": "funding_f * oi_change_5",
        "whale_x_price_i": "CASE WHEN whale_z > 1.5 AND price_5 > 0 THEN 1 WHEN whale_z > 1.5 AND price_5 < 0 THEN -1 ELSE 0 END",
        "whale_trend": f"CASE WHEN count(whale) {over(5)} >= 2 AND pos >= 5 THEN (sum(coalesce(whale, 0) * (pos % 1000000)) {over(5)} - ((pos % 1000000) - 2) * sum(coalesce(whale, 0)) {over(5)}) / 10 END",
    }
    decay = " + ".join(["spike", *(f"coalesce({lag('spike', k)}, 0) * {1 - k / 6!r}" for k in range(1, 6))])
    return [s1, s2, s3, {"post_liq": decay}, {"post_liq_flag": flag("post_liq > 0")}]


FLOWS = ["fg_f", "fg_roc_5", "fg_fear", "fg_greed", "fg_vs_price", "fg_lag_1_i", "fg_lag_3_i", "fg_lag_5_i", "fg_lag_10_i", "funding_high", "funding_neg", "funding_z30", "funding_z90", "funding_regime_i", "liq_ratio", "liq_z",
         "liq_asymmetry", "post_liq", "post_liq_flag", "oi_change_5", "oi_price", "oi_funding_combo_i", "funding_x_oi", "whale_z", "whale_x_price_i", "whale_trend", "premium_positive", "premium_z", "hash_roc_7", "hash_capitulation"]

#: The parents' prefixes and bucket lengths in seconds (weeks counted from the epoch's Thursday).
PARENTS = {"h4": 14_400, "d": 86_400, "w": 604_800}
PARENT_COLUMNS = ("trend", "ema50_dist", "rsi_14", "bb_pctb", "macd", "return", "volatility", "atr_pct", "vol_ratio")


def parent_features(d: Dialect) -> Stages:
    """Nine features of wider bars, then those of the bar before (the last closed one)."""
    s1 = {"d": f"close - {lag('close')}", "tr": f"greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')}))", "ret": change("close"), "m20": rolling("avg", "close", 20), "sd20": rolling("stddev_samp", "close", 20), "v20": rolling("avg", "volume", 20, digits=None)}
    s2 = {"gain": "CASE WHEN d IS NOT NULL THEN greatest(d, 0e0) END", "loss": "CASE WHEN d IS NOT NULL THEN greatest(-d, 0e0) END", "atr": rolling("avg", "tr", 14), "vol": rolling("stddev_samp", "ret", 20, digits=None)}
    first = {"ema50": ("close", 2 / 51, False, 1), "e12": ("close", 2 / 13, False, 1), "e26": ("close", 2 / 27, False, 1), "g": ("gain", 1 / 14, True, 14), "l": ("loss", 1 / 14, True, 14)}
    now = {
        "trend_n": "CASE WHEN round(close - ema50, 8) > 0 THEN 1 WHEN round(close - ema50, 8) < 0 THEN -1 ELSE 0 END", "ema50_dist_n": f"round({ratio('close - ema50', 'ema50')}, 8) + 0e0",
        "rsi_14_n": "CASE WHEN l = 0 AND g > 0 THEN 100e0 ELSE 100 - 100 / (1 + g / nullif(l, 0)) END", "bb_pctb_n": ratio("close - m20 + 2 * sd20", "4 * sd20"), "macd_n": "CASE WHEN abs(e12 - e26) < 1e-9 * close THEN 0e0 ELSE e12 - e26 END",
        "return_n": "ret", "volatility_n": "vol", "atr_pct_n": ratio("atr", "close"), "vol_ratio_n": ratio("volume", "v20"),
    }
    return [s1, s2, *momentum.ewm(d, first, "e_"), now, {f"{c}_p": lag(f"{c}_n") for c in PARENT_COLUMNS}]


def parents(d: Dialect, bars: str) -> str:
    """Every bar with the nine features of its last closed 4-hour, daily and weekly bucket."""
    joins, cols = [], []
    for p, width in PARENTS.items():
        b = d.div("us", str(width * 1_000_000))
        wide = f"""SELECT series, {b} AS us, {d.arg_max('close', 'us')} AS close, max(high) AS high, min(low) AS low, sum(volume) AS volume FROM {bars} GROUP BY series, {b}"""
        body = compile_stages(parent_features(d), wide, ["series", "us AS bucket"], [f"{c}_p" for c in PARENT_COLUMNS], hold=not d.duck)
        joins.append(f"LEFT JOIN ({body}) {p} ON {p}.series = b.series AND {p}.bucket = {d.div('b.us', str(width * 1_000_000))}")
        cols += [f"{p}.{c}_p AS {p}_{c}" for c in PARENT_COLUMNS]
    return f"SELECT b.series, b.us, {', '.join(cols)} FROM {bars} b {' '.join(joins)}"
