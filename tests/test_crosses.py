"""Crosses and exact percentiles against plain loops."""

import random

import numpy as np
from pyspark.sql import functions as F

from barloom.operators import crosses, quantiles


def test_exact_percentiles(spark):
    rnd = random.Random(3)
    data = {"many": [rnd.gauss(0, 1) for _ in range(5000)], "ties": [rnd.choice((1.0, 2.0, 3.0)) for _ in range(3000)], "one": [7.0], "two": [1.0, 4.0]}
    rows = [(k, v) for k, vs in data.items() for v in vs] + [("many", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    at = (0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0)
    got = {r["k"]: r for r in quantiles.percentiles(df, "k", "v", at).collect()}
    assert set(got) == set(data)
    for k, vs in data.items():
        assert got[k]["n"] == len(vs) and np.allclose(got[k]["q"], np.quantile(vs, at), rtol=1e-12)
    assert quantiles.percentiles(df.limit(0), "k", "v", at).count() == 0


def test_families_against_loops(spark):
    """Contexts, groups and supports of every family, long names that share their first 40 characters kept apart."""
    rnd = random.Random(5)
    long = "moon_phase_" + "x" * 40
    names = [long + "a", long + "b", "rsi_14", "kp_level", "price_near_x"]
    rows = [("s", i, *(rnd.random() if n == "rsi_14" else float(rnd.random() < 0.3) for n in names)) for i in range(400)]
    df = spark.createDataFrame(rows, "series string, us bigint, " + ", ".join(f"{n} double" for n in names))
    contexts = crosses.binarise(df, names)
    assert [c.name for c in contexts] == [*names[:2], "rsi_14_XH", "rsi_14_H", "rsi_14_L", "rsi_14_XL", *names[3:]]
    assert [c.group for c in contexts] == ["astro", "astro", "ta", "ta", "ta", "ta", "space", "price_num"]
    r14 = [r[4] for r in rows]
    cut = dict(zip(crosses.TAGS, np.quantile(r14, crosses.QUANTILES)))
    holds = lambda r, c: (r[4] > cut[c.name[6:]] if "H" in c.name[6:] else r[4] < cut[c.name[6:]]) if c.name.startswith("rsi") else r[2 + names.index(c.name)] > 0
    sides = crosses.sides(df, contexts, ["series", "us"], F.lit(364), F.lit(1))
    pairs = crosses.pair_combos(sides, "astro", contexts, 50)
    assert pairs == [(0, 1)]
    sides = crosses.with_pairs(crosses.with_pairs(sides, "astro_pairs", "astro", pairs, crosses.PAIR), "ta_pairs", "ta", [], crosses.PAIR + 1000)
    got = crosses.named(crosses.supports(sides), contexts, {crosses.PAIR: "a2_pair"}).collect()
    count = lambda *cs: sum(all(holds(r, c) for c in cs) for r in rows)
    n = {(r["family"], r["left"], r["right"]): r["n"] for r in got}
    assert len(n) == len(got)
    for prefix, left in (("ax", "astro"), ("sw", "space"), ("pn", "price_num")):
        for a in contexts:
            for b in contexts:
                if a.group == left and (prefix != "ax" or b.group == "ta"):
                    assert n.get((prefix, a.name, b.name), 0) == (count(a, b) if count(a, b) >= 3 else 0)
    assert n[("ax2", "a2_pair", "rsi_14_H")] == count(contexts[0], contexts[1], contexts[3])
    assert {left for f, left, _ in n if f == "dx"} == {f"doy_{d}" for d in (362, 363, 364, 365, 1)}
    assert {left for f, left, _ in n if f == "rdx"} == {f"doy_B_{d}" for d in (362, 363, 364, 365, 1)}
    assert {r["cross"] for r in got if r["family"] == "ax" and r["right"] == "rsi_14_H"} == {"ax_" + long[:40] + "_rsi_14_H"}
