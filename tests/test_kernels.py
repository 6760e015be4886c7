"""Kernels against plain loops."""

import math
import random

import numpy as np
import pandas as pd
import pytest

from barloom.operators import kernels


def test_fractional_differences(spark):
    rnd = random.Random(2)
    rows = [("s", i, 50_000 + 100 * rnd.random(), None if i % 7 == 0 else rnd.random()) for i in range(130)]
    bars = spark.createDataFrame(rows, "series string, us bigint, close double, volume double")
    got = {r["us"]: r for r in kernels.fractional_differences(bars).collect()}
    obv, total = [], 0.0
    for i, r in enumerate(rows):
        if i and r[3] is not None:
            total += math.copysign(1, r[2] - rows[i - 1][2]) * r[3]
        obv.append(total)
    inputs = {"close": [r[2] for r in rows], "log_close": [math.log(r[2]) for r in rows], "volume": [r[3] for r in rows], "obv": obv}
    for name, (source, order) in kernels.FRACTIONAL.items():
        w = [1.0]
        for k in range(1, 100):
            w.append(-w[-1] * (order - k + 1) / k)
        for i in (0, 98, 99, 100, 129):
            want = sum(w[k] * (inputs[source][i - k] or 0.0) for k in range(100)) if i >= 99 else None
            assert got[i][f"fracdiff_{name}"] == (None if want is None else pytest.approx(want, rel=1e-9, abs=1e-9))


@pytest.mark.parametrize("adjust", [True, False])
@pytest.mark.parametrize("alpha", [0.15, 2 / 201, 2 / 6])
def test_exponential_averages_equal_pandas(spark, monkeypatch, adjust, alpha):
    """Across blocks, with leading and inner missing values, against pandas' position weights."""
    from barloom.operators import momentum
    from barloom.plans.portable import SPARK, compile_stages

    monkeypatch.setattr(momentum, "BLOCK", 32)
    rnd = random.Random(4)
    x = [None, None] + [None if adjust and i in (40, 41, 77) else rnd.random() * 10 for i in range(400)]
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(x)], "series string, us bigint, x double")
    sql = compile_stages(momentum.ewm(SPARK, {"y_t": ("x", alpha, adjust, 3)}, "e_"), "SELECT * FROM {src}", ["us"], ["y_t"], hold=True)
    got = spark.sql(sql, src=df).orderBy("us").toPandas()["y_t"].to_numpy(float)
    want = pd.Series(x, dtype=float).ewm(alpha=alpha, adjust=adjust, min_periods=3).mean().to_numpy()
    assert np.allclose(got, want, equal_nan=True, rtol=1e-9)
