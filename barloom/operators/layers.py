"""Further layers over bar, on-chain and space-weather series, all as windows."""

from __future__ import annotations

from barloom.plans.portable import Dialect, Stages, change, flag, lag, lead, over, ratio, rolling, whole

#: Round price levels; Fibonacci and Gann counts of bars with their tolerances.
ROUND_LEVELS = (10000, 20000, 25000, 30000, 40000, 50000, 60000, 69000, 75000, 80000, 90000, 100000, 125000, 150000, 200000)
FIBONACCI, GANN = (21, 34, 55, 89, 144, 233, 377), (90, 180, 270, 360)


def memory(d: Dialect) -> Stages:
    """Lags and streaks of binary events, return streaks, ten-bar maxima."""
    s1 = {"ret": f"round({change('close')}, 10)", "pos": "row_number() OVER (PARTITION BY series ORDER BY us)", "green": flag("close > open"), "red": flag("close < open")}
    s2 = {
        "big_up": flag("ret > 0.02"), "big_down": flag("ret < -0.02"), "up": flag("ret > 0"), "ret_max_10": rolling("max", "ret", 10),
        "green_reset": f"max(CASE WHEN green = 0 THEN pos ELSE 0 END) {over()}", "red_reset": f"max(CASE WHEN red = 0 THEN pos ELSE 0 END) {over()}",
    }
    s3 = {f"{e}_lag_{k}": lag(e, k) for e in ("big_up", "big_down") for k in (1, 3, 5, 7)}
    s3 |= {"up_reset": f"max(CASE WHEN up = 0 THEN pos ELSE 0 END) {over()}"}
    return [s1, s2, s3, {"up_streak_i": "pos - up_reset", "streak_green_i": "pos - green_reset", "streak_red_i": "pos - red_reset"}]


def price_numbers(d: Dialect) -> Stages:
    """Digital root, triples, round levels, repeated digits and master numbers of the whole part of the close."""
    s1 = {"n_i": "CAST(floor(abs(close)) AS BIGINT)"}
    s2 = {"t": "CAST(n_i AS STRING)", "price_root_i": "CASE WHEN n_i = 0 THEN 0 ELSE 1 + (n_i - 1) % 9 END"}
    s3 = {
        "price_angel": flag(" OR ".join(f"t LIKE '%{str(k) * 3}%'" for k in range(1, 10))), "price_near_round": flag(" OR ".join(f"abs(close - {x}) / {x}e0 < 0.01" for x in ROUND_LEVELS)),
        "price_repeating": flag(" OR ".join(f"length(t) - length(replace(t, '{k}', '')) >= 3" for k in range(10))), **{f"price_master_{m}": flag(f"n_i % 100 = {m}") for m in (11, 22, 33)},
    }
    return [s1, s2, s3]


def sessions(d: Dialect) -> Stages:
    """Sessions (London overlaps Asia by an hour) and kill zones by UTC hour, harmonics of the calendar, animal and element years."""
    tau = "6.283185307179586e0"
    s1 = {"ts": d.ts("us")}
    s2 = {"h": "hour(ts)", "y": "year(ts)", "doy": "dayofyear(ts)", "dow": d.weekday("ts"), "dom": "day(ts)", "days": "us / 86400000000e0"}
    s3 = {
        "session_asia": flag("h < 8"), "session_london": flag("h >= 7 AND h < 12"), "session_ny": flag("h >= 12 AND h < 20"), "session_dead": flag("h >= 20"),
        "killzone_asian": flag("h >= 7 AND h < 10"), "killzone_london": flag("h >= 12 AND h < 15"), "killzone_ny_pm": flag("h >= 18 AND h < 20"),
        "doy_sin": f"sin({tau} * doy / 365.25e0)", "doy_cos": f"cos({tau} * doy / 365.25e0)", "moon_sin": f"sin({tau} * days / 29.53e0)", "moon_cos": f"cos({tau} * days / 29.53e0)",
        "dow_sin": f"sin({tau} * dow / 7e0)", "dow_cos": f"cos({tau} * dow / 7e0)", "dom_sin": f"sin({tau} * dom / 30.44e0)", "dom_cos": f"cos({tau} * dom / 30.44e0)",
        "animal_i": "((y - 4) % 12 + 12) % 12", "element_i": d.div("((y - 4) % 10 + 10) % 10", "2"), "sixty_i": "((y - 4) % 60 + 60) % 60",
    }
    return [s1, s2, s3]


def entropy(d: Dialect) -> Stages:
    """Shannon entropy of 20 returns in ten bins between the series' least and greatest return, spread of differences, rescaled range."""
    s1 = {"ret": f"round({change('close')}, 10)"}
    s2 = {"least": f"min(ret) {whole()}", "most": f"max(ret) {whole()}", "diff": f"ret - {lag('ret')}", "n20": f"count(ret) {over(20)}", "mean20": f"avg(ret) {over(20)}", "sd20": f"stddev_samp(ret) {over(20)}"}
    s3 = {"bin": "CASE WHEN ret IS NULL THEN NULL ELSE least(floor((ret - least) / nullif(most - least, 0) * 10), 9) END", "diff_sd": rolling("stddev_samp", "diff", 20, digits=None), "dev": "ret - mean20"}
    s4 = {f"b{k}": f"count(CASE WHEN bin = {k} THEN 1 END) {over(20)}" for k in range(10)}
    term = lambda k: f"CASE WHEN b{k} > 0 THEN b{k} / 20e0 * ln(b{k} / 20e0) ELSE 0e0 END"
    s5 = {"entropy_20": "CASE WHEN n20 >= 20 THEN round(-(" + " + ".join(term(k) for k in range(10)) + "), 8) + 0e0 END"}
    return [s1, s2, s3, s4, s5, {"entropy_high": flag("entropy_20 > 1.8"), "entropy_low": flag("entropy_20 < 1.0")}]


def rates_of_change(d: Dialect) -> Stages:
    """Binary tiers of four indicators by past percentiles (200 bars before the current one, 50 at least, index floor(n q)),
    and how a tier was entered or left: rising into, peaked, falling into, bottomed."""
    s0 = {"m20": rolling("avg", "close", 20), "sd20": rolling("stddev_samp", "close", 20), "hi14": rolling("max", "high", 14), "lo14": rolling("min", "low", 14), "v20": rolling("avg", "volume", 20, digits=None)}
    s1 = {"pctb": "round((close - m20 + 2 * sd20) / nullif(4 * sd20, 0), 8)", "stoch": "round(100 * (close - lo14) / nullif(hi14 - lo14, 0), 8)", "vratio": "round(volume / nullif(v20, 0), 8)", "ret": f"round({change('close')}, 8)"}
    names = ("pctb", "stoch", "vratio", "ret")
    s2 = {f"past_{c}": d.sort(d.filter(d.collect(c, over(200, skip=1)), "v", "v IS NOT NULL")) for c in names}
    pick = lambda c, q: f"CASE WHEN {d.size(f'past_{c}')} >= 50 THEN {d.at(f'past_{c}', f'CAST(least(floor({d.size(f'past_{c}')} * {q}), {d.size(f'past_{c}')} - 1) AS INT) + 1')} END"
    s3 = {f"{c}_q{k}": pick(c, q) for c in names for k, q in ((5, 0.05), (20, 0.2), (80, 0.8), (95, 0.95))}
    s4 = {f"{c}{tag}": flag(f"{c} {op} {c}_q{k}") for c in names for tag, op, k in (("_xh", ">", 95), ("_h", ">", 80), ("_l", "<", 20), ("_xl", "<", 5))}
    s5 = {f"{c}_crossed": flag(f"{c}_h = 1 AND {lag(c + '_h')} = 0") for c in names} | {f"{c}_fell": flag(f"{c}_l = 1 AND {lag(c + '_l')} = 0") for c in names}
    s5 |= {f"{c}_peaked": flag(f"{c}_h = 0 AND {lag(c + '_h')} = 1") for c in names} | {f"{c}_bottomed": flag(f"{c}_l = 0 AND {lag(c + '_l')} = 1") for c in names}
    s6 = {f"{c}_rising_into_i": f"max({c}_crossed) {over(3)}" for c in names} | {f"{c}_falling_into_i": f"max({c}_fell) {over(3)}" for c in names}
    return [s0, s1, s2, s3, s4, s5, s6]


RATES = [f"{c}{x}" for c in ("pctb", "stoch", "vratio", "ret") for x in ("_xh", "_h", "_l", "_xl", "_peaked", "_bottomed", "_rising_into_i", "_falling_into_i")]


def cycles(d: Dialect) -> Stages:
    """Bars since running high and low, Fibonacci and Gann counts, swing retracements, root of price, golden ratio, index cycles."""
    s1 = {
        "pos": "row_number() OVER (PARTITION BY series ORDER BY us)", "ath": f"max(close) {over()}", "atl": f"min(close) {over()}",
        "hi20": rolling("max", "high", 20), "lo20": rolling("min", "low", 20), "root": "sqrt(close)", "c20": lag("close", 20),
    }
    s2 = {"ath_pos": d.last("CASE WHEN close = ath THEN pos END", over()), "atl_pos": d.last("CASE WHEN close = atl THEN pos END", over())}
    s3 = {"since_ath_i": "pos - ath_pos", "since_atl_i": "pos - atl_pos", "retrace_20": ratio("hi20 - close", "hi20 - lo20"), "phi_dist": "abs(close / nullif(c20, 0) - 1.618)"}
    s3 |= {f"cycle_{n}_sin": f"sin(6.283185307179586e0 * (pos - 1) / {n}e0)" for n in (7, 14, 28, 90)}
    s4 = {f"fib_{n}d_{a}": flag(f"abs(since_{a}_i - {n}) <= 2") for n in FIBONACCI for a in ("ath", "atl")} | {f"gann_{n}d_{a}": flag(f"abs(since_{a}_i - {n}) <= 3") for n in GANN for a in ("ath", "atl")}
    s4 |= {"near_618": flag("abs(retrace_20 - 0.618) < 0.02")}
    return [s1, s2, s3, s4]


#: Multipliers (leverage, risk, stop, reward, hold) by regime, of the audit and of the live trader.
#: Regimes: 0 sideways, 1 bull, 2 bear, 3 crash, 4 transition, 5 unknown.
MULTIPLIERS = ("lev", "risk", "stop", "reward", "hold")
AUDIT = {1: (1.0, 1.0, 1.0, 1.5, 1.0), 2: (0.47, 1.0, 0.75, 0.75, 0.17), 0: (0.67, 0.47, 0.5, 0.5, 1.0), 3: (0.2, 0.25, 0.5, 0.5, 0.1)}
LIVE = {
    1: (1.0, 1.0, 1.0, 1.0, 1.0), 2: (0.47, 1.0, 0.75, 0.75, 0.17), 0: (0.67, 0.47, 0.5, 0.5, 1.0), 3: (0.07, 1.0, 1.5, 0.25, 2.0),
    4: (0.8, 0.8, 0.8, 0.8, 0.8), 5: (1.0, 1.0, 1.0, 1.0, 1.0),
}


def regimes(d: Dialect) -> Stages:
    """Trend by the 100-bar mean and its slope, crash by volatility and drawdown, with the audit's and the live trader's
    multipliers; range position, rescaled-range exponent. The audit's slope is central (it sees one bar ahead, as
    specified), the live one looks back only and is unknown before 100 bars."""
    s1 = {"ret": f"round(ln(close / {lag('close')}), 10)", "m100": f"round(avg(close) {over(100)}, 10)", "n100": f"count(close) {over(100)}", "peak30": f"max(close) {over(30)}", "hi20": rolling("max", "high", 20), "lo20": rolling("min", "low", 20)}
    ahead, behind = lead("m100"), lag("m100")
    s2 = {
        "slope": f"round((coalesce({ahead}, m100) - coalesce({behind}, m100)) / (CASE WHEN {ahead} IS NULL OR {behind} IS NULL THEN 1 ELSE 2 END) / m100, 7)", "slope_back": f"round((m100 - {behind}) / m100, 7)",
        "vol20": rolling("stddev_samp", "ret", 20, 2, digits=None), "dd30": "1 - close / peak30", "dev": f"ret - avg(ret) {over(20)}", "r_sd": rolling("stddev_samp", "ret", 20),
    }
    s3 = {"vol_mean": f"avg(vol20) {over(90)}", "range_pos": f"least(1.0, greatest(0.0, {ratio('close - lo20', 'hi20 - lo20')}))", "cum": f"sum(dev) {over(20)}"}
    crash = "round(vol20 - 2 * vol_mean, 9) > 0 AND dd30 > 0.15"
    s4 = {
        "regime_i": f"CASE WHEN {crash} AND close <= m100 THEN 3 WHEN slope > 0.001 AND close > m100 THEN 1 WHEN slope < -0.001 AND close <= m100 THEN 2 ELSE 0 END",
        "live_regime_i": f"CASE WHEN n100 < 100 OR slope_back IS NULL THEN 5 WHEN {crash} AND close < m100 THEN 3 WHEN close > m100 AND slope_back > 0.001 THEN 1 WHEN close <= m100 AND slope_back < -0.001 THEN 2"
                         " WHEN abs(close - m100) / m100 < 0.05 OR abs(slope_back) <= 0.001 THEN 0 ELSE 4 END",
        "rs": f"(max(cum) {over(20)} - min(cum) {over(20)}) / nullif(r_sd, 0)",
    }
    pick = lambda col, table, k: f"CASE {col} " + " ".join(f"WHEN {r} THEN {v[k]!r}e0" for r, v in table.items()) + " END"
    s5 = {"hurst": "CASE WHEN rs > 0 THEN ln(rs) / ln(20) END", "size": pick("regime_i", AUDIT, 0)}
    s5 |= {f"audit_{m}": pick("regime_i", AUDIT, k) for k, m in enumerate(MULTIPLIERS)} | {f"live_{m}": pick("live_regime_i", LIVE, k) for k, m in enumerate(MULTIPLIERS)}
    return [s1, s2, s3, s4, s5]


def _z(x: str, n: int, least: int) -> str:
    return f"CASE WHEN count({x}) {over(n)} >= {least} THEN ({x} - avg({x}) {over(n)}) / nullif(stddev_samp({x}) {over(n)}, 0) END"


def onchain(d: Dialect) -> Stages:
    """Fear and greed, hash-rate change, whale flow, liquidation cascade with decay, coinbase premium."""
    s1 = {
        "fg": d.last("fear_greed", over()), "hash": d.last("hash_rate", over()), "liq": "coalesce(liq_long_vol, 0) + coalesce(liq_short_vol, 0)",
        "whale_z": _z("whale", 30, 5), "premium_z": _z("premium", 20, 5), "premium_positive": flag("premium > 0"),
        "asymmetry": ratio("coalesce(liq_long_vol, 0) - coalesce(liq_short_vol, 0)", "coalesce(liq_long_vol, 0) + coalesce(liq_short_vol, 0)"),
    }
    s2 = {"fg_fear": flag("fg < 20"), "fg_greed": flag("fg > 80"), "fg_change_5": f"fg - {lag('fg', 5)}", "hash_change_7": change("hash", 7), "liq_z": _z("liq", 20, 5)}
    s3 = {"capitulation": flag("hash_change_7 < -0.1"), "cascade": flag("liq_z > 2")}
    s4 = {"after_cascade": " + ".join(f"coalesce({lag('cascade', k)}, 0) * {(6 - k) / 5}" for k in range(1, 6))}
    return [s1, s2, s3, s4]


def space(d: Dialect) -> Stages:
    """Storm levels, change over a day's readings, readings since a storm with decay, post-storm days, wind and field."""
    s1 = {
        "kp": d.last("kp_index", over()), "wind": d.last("speed", over()), "pos": "row_number() OVER (PARTITION BY series ORDER BY us)",
        "storm": "CASE WHEN kp_index IS NULL THEN NULL WHEN kp_index >= 5 THEN 1 ELSE 0 END", "severe": "CASE WHEN kp_index IS NULL THEN NULL WHEN kp_index >= 7 THEN 1 ELSE 0 END",
    }
    s2 = {"kp_change": f"kp - {lag('kp', 8)}", "storm_pos": d.last("CASE WHEN storm = 1 THEN pos END", over()), "storm_us": d.last("CASE WHEN storm = 1 THEN us END", over()), "wind_mean": rolling("avg", "wind", 8, 3)}
    return [s1, s2, {"since_storm_i": "pos - storm_pos", "post_storm": flag("us - storm_us <= 604800000000")}, {"decay": "exp(-0.1 * since_storm_i)"}]


def multi_timeframe(d: Dialect) -> Stages:
    """Parent context on daily grid of the same series: last closed day's trend and range, never the running day's."""
    day = d.day("us")
    s1 = {"day_n": day, "m5": rolling("avg", "close", 5)}
    s2 = {"day_last": "last_value(close) OVER (PARTITION BY series, day_n ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)", "first_of_day": "CASE WHEN row_number() OVER (PARTITION BY series, day_n ORDER BY us) = 1 THEN 1 ELSE 0 END"}
    s3 = {"prev_day_close": lag("close")}
    s4 = {"htf_close": d.last("CASE WHEN first_of_day = 1 THEN prev_day_close END", over())}
    s5 = {"htf_trend": "CASE WHEN close > htf_close THEN 1 WHEN close < htf_close THEN -1 ELSE 0 END", "htf_dist": ratio("close - htf_close", "htf_close"),
          "confluence": "CASE WHEN (close - htf_close) * (close - m5) > 0 THEN 1.0 WHEN (close - htf_close) * (close - m5) < 0 THEN 0.0 ELSE 0.5 END"}
    return [s1, s2, s3, s4, s5]
