import numpy as np
import pytest

from barloom.operators import folds, simulate


def test_state_machines():
    c = np.array([100, 101, 102, 101, 97, 96, 99.5, 103, 104, 100.0])
    turned, leg = folds.zigzag(c)
    assert list(np.flatnonzero(turned)) == [4, 6, 9] and list(turned[[4, 6, 9]]) == [-1, 1, -1] and list(leg) == [1, 1, 1, 1, -1, -1, 1, 1, 1, -1]
    # by hand: 99, then 99 + .02 (101 - 99), 99.04 + .04 (102 - 99.04), 99.1584 + .06 (103 - 99.1584), passed by 96
    sar, up, flip = folds.parabolic_sar(c + 1, c - 1)
    assert sar[:4] == pytest.approx([99, 99.04, 99.1584, 99.388896]) and sar[4] == 103 and list(up[:5]) == [1, 1, 1, 1, 0] and list(flip[:5]) == [1, 0, 0, 0, 1]
    gap = folds.fair_value_gap(np.array([1, 2, 5, 6.0]), np.array([0.5, 1.5, 4, 5.0]), np.array([1, 2, 4.5, 5.5]))
    assert np.isnan(gap[1]) and gap[2] == pytest.approx((2.5 - 4.5) / 4.5)
    assert len(folds.zigzag(np.array([]))[0]) == 0 and len(folds.parabolic_sar(np.array([]), np.array([]))[2]) == 0


def test_volume_profile_by_loops():
    rng = np.random.default_rng(2)
    c = 100 + np.cumsum(rng.normal(0, 1, 80))
    h, lo, v = c + rng.uniform(0.2, 2, 80), c - rng.uniform(0.2, 2, 80), rng.uniform(1, 9, 80)
    got = folds.volume_profile(h, lo, c, v)
    for i in range(20, 80):
        w = slice(i - 20, i + 1)
        edges = np.linspace(lo[w].min(), h[w].max(), 21)
        hist = np.zeros(20)
        for a, b, x in zip(lo[w], h[w], v[w]):
            k, z = np.clip(np.searchsorted(edges, [a, b]) - 1, 0, 19)
            hist[k : z + 1] += x / (z - k + 1)
        centre = (edges[:-1] + edges[1:]) / 2
        p = hist.round(9).argmax()
        assert got["vpoc"][i] == pytest.approx(centre[p])
        under = [b for b in range(20) if centre[b] < c[i]]
        if under:
            assert got["hvn_distance"][i] == pytest.approx((c[i] - centre[max(under, key=lambda b: (round(hist[b], 9), -b))]) / c[i])
        a = b = p
        while hist[a : b + 1].sum() < 0.7 * hist.sum() - 1e-9:
            below, above = hist[a - 1] if a else 0, hist[b + 1] if b < 19 else 0
            a, b = (a - 1, b) if a and (below >= above or b == 19) else (a, b + 1)
        assert got["value_area_position"][i] == (-1 if c[i] < edges[a] else 1 if c[i] > edges[b + 1] else 0)
    assert all(np.isnan(x).all() for x in folds.volume_profile(h[:5], lo[:5], c[:5], v[:5]).values())


def test_range_phases_by_hand():
    """A climax, a rally, a test, a spring, a sign of strength and a breakout."""
    n = 60
    c, v = np.full(n, 100.0), np.full(n, 10.0)
    h, lo, o = c + 1, c - 1, c - 0.1
    h[35], lo[35], c[35], v[35] = 100, 90, 95, 100  # climax on ten times the volume
    c[36:40], h[36:40], lo[36:40] = [98, 100, 103, 106], [99, 101, 104, 107], [96, 98, 101, 104]
    c[40:44], h[40:44], lo[40:44] = [104, 101, 98, 95], [106, 103, 100, 97], [102, 99, 96, 92]  # back at the low: the test
    c[44], h[44], lo[44], v[44] = 91, 95, 89, 5  # below 90 and closed above it on light volume
    c[45:50], h[45:50], lo[45:50] = [97, 102, 105, 106, 120], [98, 103, 106, 107, 121], [94, 97, 102, 104, 106]
    v[46] = 90
    w = folds.wyckoff(o, h, lo, c, v)
    assert list(np.flatnonzero(w["phase"] == 1))[0] == 35 and w["phase"][34] == 0
    assert w["phase"][43] == 2 and w["spring"][44] == 1 and w["phase"][44] == 3 and w["sos"][46] == 1 and w["phase"][46] == 4 and w["phase"][49] == 5
    assert w["sc_bars_ago"][46] == 11 and w["in_range"][46] == 1 and w["directional_score"][46] > 50
    assert len(folds.wyckoff(*[np.array([])] * 5)["phase"]) == 0


ONE = {"leverage": 5.0, "risk": 0.01, "stop_atr": 2.0, "reward": 1.0, "hold": 24, "trail": 0.0, "partial": 0.0}


def params(*changes):
    return {k: np.array([c.get(k, v) for c in changes], float) for k, v in ONE.items()}


def test_simulator_by_hand():
    """Stop before target on one bar; partial target with the stop moved to the entry; trailing stop; time; drawdown halt."""
    cost = 2 * simulate.FEE
    flat, ones = np.array([100.0, 100, 100, 100]), np.ones(4)
    sig = np.array([1, 0, 0, 0])
    _, t = simulate.run(np.array([100, 103, 100, 100.0]), np.array([100, 97, 100, 100.0]), flat, sig, ones, ones, params({}), log=True)
    assert t[0][6] == "stop" and t[0][5] == 98 and t[0][9] == pytest.approx(0.5 * (-0.02 - cost - simulate.SLIPPAGE))  # size 0.01 / 0.02
    _, t = simulate.run(np.array([100, 102, 101, 100.0]), np.array([100, 100.5, 99, 100.0]), flat, sig, ones, ones, params({"partial": 0.5}), log=True)
    assert t[0][6] == "stop" and t[0][2] == 2 and t[0][9] == pytest.approx(0.25 * (0.02 - cost) + 0.25 * (0 - cost - simulate.SLIPPAGE))
    _, t = simulate.run(np.array([100, 103, 102, 100.0]), np.array([100, 101, 101.2, 100.0]), flat, sig, ones, ones, params({"reward": 9.0, "trail": 1.5}), log=True)
    assert t[0][6] == "stop" and t[0][2] == 2 and t[0][5] == 101.5  # 103 - 1.5, tightened on the bar of the best price
    _, t = simulate.run(flat, flat, flat, sig, ones, ones, params({"hold": 2}), log=True)
    assert t[0][6] == "time" and t[0][7] == 2
    assert list(simulate.drawdown_scale(np.array([0.0, 0.1, 0.15, 0.3]))) == [1.0, 0.8, 0.0, 0.0]
    assert simulate.kelly(np.array([0.6]), np.array([2.0]))[0] == pytest.approx(0.4) and simulate.kelly_scale(np.array([0.4, 99.0]))[1] == 3.0


def test_sets_side_by_side_equal_each_alone():
    rng = np.random.default_rng(1)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 600)))
    high, low = close * 1.006, close * 0.994
    signal, atr, scale = np.sign(rng.normal(size=600)), np.full(600, 1.2), np.ones(600)
    idx = np.arange(0, 1296, 61)
    got, _ = simulate.run(high, low, close, signal, atr, scale, simulate.decode(idx, simulate.GRID))
    for k, i in enumerate(idx):
        one, trades = simulate.run(high, low, close, signal, atr, scale, simulate.decode(np.array([i]), simulate.GRID), log=True)
        assert all(got[c][k] == one[c][0] for c in got) and one["trades"][0] == len(trades)
        assert one["balance"][0] == pytest.approx(1 + sum(t[9] for t in trades), abs=0.02)  # less an open position's part
    every = simulate.decode(np.arange(1296), simulate.GRID)
    assert len({tuple(every[n][i] for n in simulate.PARAMETERS) for i in range(1296)}) == 1296


def test_winners_and_portfolio(spark):
    rows = [("s", 0, 12, 6, 1.2, 0.05, 0.3), ("s", 1, 12, 6, 1.2, 0.05, 0.5), ("s", 2, 12, 6, 1.9, 0.12, 0.1), ("s", 3, 5, 5, 9.0, 0.01, 9.0)]
    r = simulate.winners(spark.createDataFrame(rows, "series string, idx bigint, trades bigint, wins bigint, balance double, drawdown double, sortino double")).first()
    assert (r["balance_10_idx"], r["sortino_10_idx"], r["balance_15_idx"], r["sortino_15_idx"], r["sets"]) == (0, 1, 2, 1, 3)
    trades = [("p", f"s{i}", "1h", 10 * i, 1000, 1 if i != 2 else -1, -0.01) for i in range(5)] + [("p", "t0", "4h", 60, 2000, 1, 0.01), ("p", "t1", "1h", 1500, 1600, 1, 0.01)]
    got = {x["series"]: (x["decision"], x["scale"]) for x in simulate.portfolio(spark.createDataFrame(trades, "who string, series string, tf string, entry_us bigint, exit_us bigint, side int, pnl double"), "who").collect()}
    assert got["s0"] == ("taken", 1.0) and got["s1"] == ("taken", 0.75) and got["s2"][0] == "full" and got["t0"] == ("taken", 0.5) and got["t1"][0] == "taken"


def test_nearest_patterns_by_loops():
    rng = np.random.default_rng(4)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 300)))
    got = folds.nearest_patterns(close, length=4, k=5, lookback=60, rows=37)
    change = np.diff(close) / close[:-1]
    pattern = lambda w: (change[w : w + 4] - change[w : w + 4].mean()) / (change[w : w + 4].std() + 1e-12)
    for i in range(300):
        w = i - 4
        if i < 4 + 5 + 1:
            assert np.isnan(got[i]).all()
            continue
        d = sorted((np.sqrt(((pattern(w) - pattern(c)) ** 2).sum() + 1e-8), c) for c in range(max(0, w - 60), w))[:5]
        wt = [1 / (x + 1e-8) * np.exp(-0.001 * (w - c)) for x, c in d]
        nxt = [change[c + 4] for _, c in d]
        up = sum(a for a, r in zip(wt, nxt) if r > 0) / sum(wt)
        assert got[i][0] == float(up > 0.5) and got[i][1] == pytest.approx(max(up, 1 - up)) and got[i][2] == pytest.approx(sum(a * r for a, r in zip(wt, nxt)) / sum(wt)) and got[i][3] == pytest.approx(d[0][0])
    assert np.isnan(folds.nearest_patterns(close[:8])).all()
