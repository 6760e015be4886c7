"""Models against values known beforehand."""

import math
import random

from barloom.operators import models


def test_mutual_information_with_the_size_of_the_next_move(spark):
    """The range of a bar is twice the size of the next move, whose sign is a coin: all ten classes of size are known, the direction is not."""
    rnd = random.Random(5)
    rows, close = [], 100.0
    for i in range(3000):
        move = rnd.choice((-1, 1)) * rnd.uniform(0.001, 0.02)
        rows.append(("s", i, close, close * (1 + abs(move)), close * (1 - abs(move))))
        close *= 1 + move
    bars = spark.createDataFrame(rows, "series string, us bigint, close double, high double, low double")
    got = {r["feature"]: r for r in models.mutual_information(lambda *_: bars)(spark, "").collect()}
    assert got["rng"]["mi_vol"] > 0.95 * math.log(10) and got["rng"]["kind"] == "VOLATILITY"
    assert got["rng"]["mi_dir"] < 0.01 and got["r1"]["mi_vol"] < 0.05


def test_meta_features_and_weights(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([([0.2, 0.5, 0.3],), ([1.0, 0.0, 0.0],)], "p array<double>")
    a, b = df.select(*(e.alias(n) for n, e in models.meta_features("p").items())).collect()
    assert (a["p_max"], a["p_up"], a["p_down"]) == (0.5, 0.3, 0.2) and abs(a["margin"] - 0.2) < 1e-12
    assert abs(a["entropy"] + sum(x * math.log(x) for x in (0.2, 0.5, 0.3))) < 1e-12 and b["entropy"] == 0 and b["margin"] == 1
    rnd, close, rows = random.Random(2), 100.0, []
    for i in range(200):
        close *= 1 + rnd.gauss(0, 0.01)
        rows.append(("s", i, close, close * 1.01, close * 0.99))
    labels = spark.createDataFrame([("s", i, 2 if i % 4 == 0 else 0 if i % 4 == 1 else 1, 0.5 if i % 2 else None) for i in range(200)], "series string, us bigint, label_i int, uniqueness double")
    w = models.labelled(spark.createDataFrame(rows, "series string, us bigint, close double, high double, low double"), labels)
    got = {(r["label"], r["uniqueness"]): r["weight"] for r in w.collect()}
    n = {r["label"]: r["count"] for r in w.groupBy("label").count().collect()}
    assert got[(1.0, None)] == 1.0 and got[(1.0, 0.5)] == 0.5 and got[(2.0, None)] == n[1.0] / n[2.0] and w.where(F.col("weight") <= 0).count() == 0
