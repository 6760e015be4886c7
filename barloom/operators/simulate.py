"""Trading simulation over bar series: many parameter sets side by side, winners, genetic search, portfolio rules.

A series (one bar an instant, so its length is bounded by the calendar) travels once as one row of arrays; blocks of
parameter sets are exploded beside it, so every (series, block) is a unit of work of its own, and a task decodes its
block's sets from their index (mixed radix): there is no join, no list of sets on the driver and no largest grid. In a
unit, NumPy carries the state of all sets of the block from bar to bar.

Rules of a position: entry at the close of the signal's bar; stop, then target, then time are looked at on each later
bar in this order; with a partial share the target realises that share, moves the stop to the entry and stays open;
after one unit of risk in favour the stop trails the best price by `trail` true ranges and only tightens. Size is
balance x risk / stop distance, at most leverage x balance, scaled by the regime, by 1 - 2 x drawdown (nothing at 15 per
cent and more) and by Kelly's share of the trades so far. Defined results: a series without a signal has no trades."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.session import stored

#: The seven parameters in the order of the mixed radix index (the last changes fastest).
PARAMETERS = ("leverage", "risk", "stop_atr", "reward", "hold", "trail", "partial")
GRID = {"leverage": (1.0, 3.0, 5.0), "risk": (0.005, 0.01, 0.02), "stop_atr": (1.0, 1.5, 2.5), "reward": (1.0, 1.5, 2.0, 3.0), "hold": (6, 24, 72), "trail": (0.0, 1.5), "partial": (0.0, 0.5)}
FEE, SLIPPAGE, LEAST_FOR_KELLY = 0.0005, 0.0002, 20


def kelly(p: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(p b - q) / b."""
    return (p * b - (1 - p)) / b


def kelly_scale(fraction: np.ndarray) -> np.ndarray:
    """1 + fraction / 4, at least 0 and at most 3."""
    return np.clip(1 + 0.25 * fraction, 0.0, 3.0)


def drawdown_scale(dd: np.ndarray) -> np.ndarray:
    return np.where(dd >= 0.15, 0.0, np.maximum(0.0, 1 - 2 * dd))


def decode(index: np.ndarray, grid: dict[str, Sequence[float]]) -> dict[str, np.ndarray]:
    """Parameter arrays of flat indexes of the grid."""
    out, rest = {}, np.asarray(index, np.int64)
    for name in reversed(PARAMETERS):
        rest, digit = np.divmod(rest, len(grid[name]))
        out[name] = np.asarray(grid[name], float)[digit]
    return out


def run(high, low, close, signal, atr, scale, params: dict[str, np.ndarray], log: bool = False):
    """State of every set after the last bar: trades, wins, balance (from 1), greatest drawdown, Sortino ratio; with `log`
    the trades too: (set, entry bar, exit bar, side, entry, exit, reason, held, size, pnl, balance, drawdown)."""
    lev, risk, stop_atr, reward, hold, trail, partial = (np.asarray(params[n], float) for n in PARAMETERS)
    p = len(lev)
    zero = lambda: np.zeros(p)
    side, entry, stop, target, best, unit, age, size, share, began, gained = (zero() for _ in range(11))
    balance, peak, worst = np.ones(p), np.ones(p), zero()
    n, wins, total, down = zero(), zero(), zero(), zero()
    trades = []
    for i in range(len(close)):
        live = side != 0
        if live.any():
            age += live
            up = side > 0
            stopped = live & np.where(up, low[i] <= stop, high[i] >= stop)
            reached = live & ~stopped & (target != 0) & np.where(up, high[i] >= target, low[i] <= target)
            part = reached & (partial > 0) & (share == 1)
            full = reached & ~part
            timed = live & ~stopped & ~full & (age >= hold)
            price = np.where(stopped, stop, np.where(reached, target, close[i]))
            leave = stopped | full | timed
            moved = leave | part
            out_share = np.where(part & ~timed, partial, share)
            slip = np.where(stopped | timed, SLIPPAGE, 0.0)
            pnl = np.where(moved, size * out_share * (side * (np.where(timed & ~reached, close[i], price) / np.where(entry == 0, 1, entry) - 1) - 2 * FEE - slip), 0.0)
            balance = balance + pnl
            gained = gained + pnl
            share = np.where(part, share - partial, share)
            stop, target = np.where(part, entry, stop), np.where(part, 0.0, target)
            peak = np.maximum(peak, balance)
            worst = np.maximum(worst, 1 - balance / peak)
            if leave.any():
                ret = np.where(leave, gained / np.maximum(balance - gained, 1e-12), 0.0)
                n, wins, total, down = n + leave, wins + (leave & (gained > 0)), total + ret, down + np.where(ret < 0, ret * ret, 0.0)
                if log:
                    for k in np.flatnonzero(leave):
                        reason = "stop" if stopped[k] else "target" if full[k] else "time"
                        trades.append((int(k), int(began[k]), i, int(side[k]), entry[k], float(price[k]), reason, int(age[k]), size[k], float(gained[k]), float(balance[k]), float(1 - balance[k] / peak[k])))
                side = np.where(leave, 0.0, side)
            still = side != 0
            best = np.where(still, np.where(side > 0, np.maximum(best, high[i]), np.minimum(best, low[i])), best)
            if np.isfinite(atr[i]):
                follow = still & (trail > 0) & (side * (best - entry) >= unit)
                new = best - side * trail * atr[i]
                stop = np.where(follow, np.where(side > 0, np.maximum(stop, new), np.minimum(stop, new)), stop)
        if signal[i] != 0 and np.isfinite(atr[i]) and atr[i] > 0 and scale[i] > 0 and i < len(close) - 1:
            rate = np.where(n >= LEAST_FOR_KELLY, wins / np.maximum(n, 1), 0.5)
            bet = np.where(n >= LEAST_FOR_KELLY, kelly_scale(kelly(rate, reward)), 1.0)
            far = stop_atr * atr[i]
            wanted = balance * risk * scale[i] * drawdown_scale(1 - balance / peak) * bet / (far / close[i])
            wanted = np.minimum(wanted, lev * balance)
            enter = (side == 0) & (wanted > 0)
            side = np.where(enter, signal[i], side)
            entry, unit = np.where(enter, close[i], entry), np.where(enter, far, unit)
            stop, target = np.where(enter, close[i] - signal[i] * far, stop), np.where(enter, close[i] + signal[i] * reward * far, target)
            best, age, size, share, began, gained = np.where(enter, close[i], best), np.where(enter, 0, age), np.where(enter, wanted, size), np.where(enter, 1.0, share), np.where(enter, i, began), np.where(enter, 0.0, gained)
    mean = total / np.maximum(n, 1)
    dev = np.sqrt(down / np.maximum(n, 1))
    sortino = np.where(dev > 0, mean / np.where(dev > 0, dev, 1), 0.0)
    return {"trades": n.astype(np.int64), "wins": wins.astype(np.int64), "balance": balance, "drawdown": worst, "sortino": sortino}, trades


_SERIES = "series string, tf string, us array<bigint>, high array<double>, low array<double>, close array<double>, signal array<int>, atr array<double>, scale array<double>"


def as_series(bars: DataFrame, scale: DataFrame | None = None) -> DataFrame:
    """One row a series: arrays in order of time. The signal follows the 20-bar mean; scale: (series, us, size) by regime, 1
    where missing."""
    w = Window.partitionBy("series").orderBy("us")
    last = lambda n: w.rowsBetween(-(n - 1), 0)
    b = bars.withColumn("_tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.lag("close").over(w)), F.abs(F.col("low") - F.lag("close").over(w))))
    full = F.count(F.lit(1)).over(last(20)) >= 20
    b = b.withColumns({"atr": F.when(F.count("_tr").over(last(14)) >= 14, F.avg("_tr").over(last(14))), "signal": F.when(full, F.signum(F.round(F.col("close") - F.avg("close").over(last(20)), 10))).otherwise(0).cast("int")})
    b = b.join(scale.select("series", "us", F.col("size").alias("scale")), ["series", "us"], "left") if scale is not None else b.withColumn("scale", F.lit(1.0))
    cols = ("us", "high", "low", "close", "signal", "atr", "scale")
    row = F.struct("us", "high", "low", "close", "signal", F.coalesce("atr", F.lit(float("nan"))).alias("atr"), F.coalesce("scale", F.lit(1.0)).alias("scale"))
    got = b.groupBy("series", "tf").agg(F.sort_array(F.collect_list(row)).alias("_r"))
    return got.select("series", "tf", *(F.col(f"_r.{c}").alias(c) for c in cols))


def _arrays(row: pd.Series) -> list[np.ndarray]:
    return [np.asarray(row[c], float) for c in ("high", "low", "close", "signal", "atr", "scale")]


def grid_results(series: DataFrame, grid: dict[str, Sequence[float]] = GRID, block: int = 512) -> DataFrame:
    """(series, idx, trades, wins, balance, drawdown, sortino) of every set of the grid on every series."""
    sets = int(np.prod([len(grid[n]) for n in PARAMETERS]))
    units = series.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit((sets - 1) // block)))).repartition("series", "_block")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, row in pdf.iterrows():
                idx = np.arange(row["_block"] * block, min(sets, (row["_block"] + 1) * block))
                got, _ = run(*_arrays(row), decode(idx, grid))
                yield pd.DataFrame({"series": row["series"], "idx": idx, **got})

    return units.mapInPandas(work, "series string, idx bigint, trades bigint, wins bigint, balance double, drawdown double, sortino double")


def winners(results: DataFrame, least_trades: int = 10) -> DataFrame:
    """Per series the best balance and the best Sortino ratio under 10 and under 15 per cent drawdown (first index on ties)."""
    kept = results.where(F.col("trades") >= least_trades)
    aggs = []
    for most in (10, 15):
        under = F.col("drawdown") <= most / 100
        for score in ("balance", "sortino"):
            key = F.when(under, F.struct(F.col(score), -F.col("idx")))
            aggs += [F.max_by("idx", key).alias(f"{score}_{most}_idx"), F.max(F.when(under, F.col(score))).alias(f"{score}_{most}")]
    return kept.groupBy("series").agg(F.count(F.lit(1)).alias("sets"), *aggs)


def trade_log(series: DataFrame, **params: float) -> DataFrame:
    """Twelve columns a trade of one parameter set on every series, with instants."""
    one = {n: np.array([float(params.get(n, d))]) for n, d in zip(PARAMETERS, (3.0, 0.01, 1.5, 2.0, 24, 1.5, 0.5), strict=True)}

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["set", "entry_bar", "exit_bar", "side", "entry", "exit", "reason", "held", "size", "pnl", "balance", "drawdown"]
        for pdf in batches:
            for _, row in pdf.iterrows():
                _, trades = run(*_arrays(row), one, log=True)
                out = pd.DataFrame(trades, columns=names).drop(columns="set")
                us = np.asarray(row["us"])
                out.insert(0, "series", row["series"])
                out.insert(1, "tf", row["tf"])
                out["entry_us"], out["exit_us"] = us[out["entry_bar"].to_numpy(int)], us[out["exit_bar"].to_numpy(int)]
                yield out

    return series.mapInPandas(
        work, "series string, tf string, entry_bar bigint, exit_bar bigint, side int, entry double, exit double, reason string, held bigint, size double, pnl double, balance double, drawdown double, entry_us bigint, exit_us bigint"
    )


def genetic_search(series: DataFrame, grid: dict[str, Sequence[float]] = GRID, population: int = 24, generations: int = 4, seed: int = 5) -> DataFrame:
    """(generation, idx, fitness, ...): the best set of every generation. Genomes are the grid's digits; tournaments of five,
    crossover at two points, five per cent mutation; fitness roi x (1 - drawdown) x max(win rate / 50, 1/2), averaged over
    the series. Each generation is one job over all series; only the population's scores come back."""
    rng = np.random.default_rng(seed)
    sizes = np.array([len(grid[n]) for n in PARAMETERS])
    flat = lambda g: np.ravel_multi_index(tuple(g.T), tuple(sizes))
    genes = np.column_stack([rng.integers(0, s, population) for s in sizes])
    spark, best = series.sparkSession, []
    for generation in range(generations):
        idx = np.unique(flat(genes))

        def work(batches: Iterator[pd.DataFrame], idx: np.ndarray = idx) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for _, row in pdf.iterrows():
                    got, _ = run(*_arrays(row), decode(idx, grid))
                    rate = 100 * got["wins"] / np.maximum(got["trades"], 1)
                    yield pd.DataFrame({"idx": idx, "fitness": (got["balance"] - 1) * (1 - got["drawdown"]) * np.maximum(rate / 50, 0.5)})

        scores = {r["idx"]: r["f"] for r in series.mapInPandas(work, "idx bigint, fitness double").groupBy("idx").agg(F.avg("fitness").alias("f")).collect()}
        fit = np.array([scores.get(int(k), 0.0) for k in flat(genes)])
        top = int(fit.argmax())
        best.append((generation, int(flat(genes[top : top + 1])[0]), float(fit[top]), *(float(v[0]) for v in decode(flat(genes[top : top + 1]), grid).values())))
        pick = lambda: genes[max(rng.integers(0, population, 5), key=lambda k: fit[k])]
        nxt = [genes[top]]
        while len(nxt) < population:
            a, b = pick(), pick()
            lo, hi = sorted(rng.integers(0, len(sizes) + 1, 2))
            child = np.where((np.arange(len(sizes)) >= lo) & (np.arange(len(sizes)) < hi), b, a)
            mutate = rng.random(len(sizes)) < 0.05
            nxt.append(np.where(mutate, rng.integers(0, sizes), child))
        genes = np.array(nxt)
    names = list(reversed(PARAMETERS))
    return spark.createDataFrame(best, "generation int, idx bigint, fitness double, " + ", ".join(f"{n} double" for n in names))


def portfolio(trades: DataFrame, key: str, heat: float = 0.03, per_tf: int = 2, halt: float = 0.15, resume: float = 0.10, suspend: float = 0.25, risk: float = 0.01) -> DataFrame:
    """Trades admitted by the portfolio's rules, per portfolio in order of entry: at most `per_tf` open a timeframe, open risk
    at most `heat`, size x 0.75 and x 0.5 beside one and more open ones of the same side, no entry while the portfolio is
    halted (drawdown over `halt` until under `resume`) or its timeframe suspended (over `suspend`)."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["entry_us", "series"], kind="stable")
        balance = peak = 1.0
        halted, tf_balance, tf_peak, open_, out = False, {}, {}, [], []
        for r in rows.itertuples(index=False):
            for x in sorted((o for o in open_ if o[0] <= r.entry_us), key=lambda o: o[0]):
                open_.remove(x)
                balance += x[4]
                peak = max(peak, balance)
                tf_balance[x[1]] = tf_balance.get(x[1], 1.0) + x[4]
                tf_peak[x[1]] = max(tf_peak.get(x[1], 1.0), tf_balance[x[1]])
            dd = 1 - balance / peak
            halted = dd > halt or (halted and dd >= resume)
            tf_dd = 1 - tf_balance.get(r.tf, 1.0) / tf_peak.get(r.tf, 1.0)
            beside = sum(o[2] == r.side for o in open_)
            scale = 1.0 if beside == 0 else 0.75 if beside == 1 else 0.5
            why = "halted" if halted else "suspended" if tf_dd > suspend else "full" if sum(o[1] == r.tf for o in open_) >= per_tf else "heat" if sum(o[3] for o in open_) + risk * scale > heat + 1e-12 else "taken"
            if why == "taken":
                open_.append((r.exit_us, r.tf, r.side, risk * scale, r.pnl * scale))
            out.append((getattr(r, key), r.series, r.entry_us, r.exit_us, why, scale if why == "taken" else 0.0, balance, dd))
        return pd.DataFrame(out, columns=["portfolio", "series", "entry_us", "exit_us", "decision", "scale", "balance", "drawdown"])

    return trades.groupBy(key).applyInPandas(fold, "portfolio string, series string, entry_us bigint, exit_us bigint, decision string, scale double, balance double, drawdown double")


def prepared(bars: DataFrame, scale: DataFrame | None = None) -> DataFrame:
    """as_series, stored: every search reads it again."""
    return stored(as_series(bars, scale))
