"""Layers by hand: regimes with their multipliers, round levels and counts of bars, roots of names."""

import pandas as pd

from barloom.operators import layers
from barloom.plans.portable import SPARK, compile_stages


def run(spark, build, rows, show):
    df = spark.createDataFrame([("s", i, float(o), float(h), float(lo), float(c), 1.0) for i, (o, h, lo, c) in enumerate(rows)], "series string, us bigint, open double, high double, low double, close double, volume double")
    return spark.sql(compile_stages(build(SPARK), "SELECT * FROM {src}", ["us"], show, hold=True), src=df).orderBy("us").toPandas()


def test_regimes(spark):
    up = [100 * 1.004**i for i in range(150)]
    flat = [up[-1]] * 150
    down = [up[-1] * 0.996**i for i in range(1, 151)]
    crash = [down[-1] * (0.9 if i % 2 else 0.72) ** (1 + i // 2) for i in range(4)]
    got = run(spark, layers.regimes, [(c, c, c, c) for c in up + flat + down + crash], ["regime_i", "live_regime_i", "audit_lev", "audit_hold", "live_lev", "live_risk"])
    r, live = got["regime_i"], got["live_regime_i"]
    assert r[140] == 1 and live[140] == 1 and live[50] == 5 and (live[:99] == 5).all() and r[290] == 0 and live[290] == 0 and r[440] == 2 and live[440] == 2 and r.iloc[-1] == 3 and live.iloc[-1] == 3
    assert tuple(got.loc[140, ["audit_lev", "audit_hold", "live_lev"]]) == (1.0, 1.0, 1.0)
    f32 = lambda x: float(pd.Series([x], dtype="float32")[0])
    assert tuple(got.loc[440, ["audit_lev", "audit_hold"]]) == (f32(0.47), f32(0.17)) and tuple(got.iloc[-1][["audit_lev", "live_lev", "live_risk"]]) == (f32(0.2), f32(0.07), 1.0)


def test_price_numbers_and_counts(spark):
    closes = [111.5, 10099.0, 10101.0, 9899.0, 555.0, 122.0, 1333.0]
    got = run(spark, layers.price_numbers, [(c, c, c, c) for c in closes], ["price_root_i", "price_angel", "price_near_round", "price_repeating", "price_master_11", "price_master_22", "price_master_33"])
    assert list(got["price_root_i"]) == [3, 1, 3, 8, 6, 5, 1] and list(got["price_angel"]) == [1, 0, 0, 0, 1, 0, 1] and list(got["price_near_round"]) == [0, 1, 0, 0, 0, 0, 0]
    assert list(got["price_repeating"]) == [1, 0, 1, 1, 1, 0, 1] and list(got["price_master_11"]) == [1, 0, 0, 0, 0, 0, 0] and list(got["price_master_33"]) == [0, 0, 0, 0, 0, 0, 1]
    fall = [200.0 - i for i in range(60)]
    c = run(spark, layers.cycles, [(x, x, x, x) for x in fall], ["since_ath_i", "since_atl_i", "fib_21d_ath", "fib_34d_ath", "fib_55d_ath"])
    assert list(c["since_ath_i"]) == list(range(60)) and set(c["since_atl_i"]) == {0}
    assert list(c.index[c["fib_21d_ath"] == 1]) == [19, 20, 21, 22, 23] and list(c.index[c["fib_55d_ath"] == 1]) == [53, 54, 55, 56, 57]
