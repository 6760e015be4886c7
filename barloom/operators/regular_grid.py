"""Irregular readings onto a regular grid (problem 4): Kalman smoother with a continuous-time local trend per source.

Readings are first reduced to one observation a slot (mean value at mean time, with its count), by partial aggregation:
a stream then has at most one row a slot, so its length is bounded by the calendar however many readings a hot source
holds. A stream's slots travel as one array; Arrow batches of streams are smoothed side by side in NumPy, one vectorised
step per node. State: level and slope; between times dt apart the slope is a Wiener process of intensity q (per day).
Observation noise comes from the stream's second differences, q from the best likelihood over a fixed set of ratios.
Every slot's middle is a node of its own without observation, beside the node of the slot's reading, so value and
standard error are the smoother's at the grid time itself, not carried over from the reading.

Defined results: NULL/NaN values and rows without an instant are no readings; repeated deliveries of one instant count
once (highest version). A stream with one slot yields that slot with its own value; one without readings yields nothing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Candidate ratios of process intensity (per day) to observation variance.
RATIOS = (1e-3, 1e-2, 1e-1, 1.0, 10.0)
#: Elements of the padded (streams x slots) arrays worked on at once; bounds a worker's memory to some 30 MB.
CELLS = 60_000


def slot_observations(rows: DataFrame, keys: Sequence[str], version: str, value: Column, width_s: int) -> DataFrame:
    """(keys, slot, mean value, mean offset in the slot, count) over distinct instants; slot = floor(seconds / width)."""
    slot = F.floor(F.col("utc_us") / (width_s * 1_000_000)).cast("bigint")
    r = rows.withColumns({"_slot": slot, "_x": value.cast("double")}).where("_x is not null and not isnan(_x) and utc_us is not null")
    r = r.select(*keys, "_slot", "utc_us", F.col(version).alias("_ver"), "_x").repartition(*[F.col(c) for c in (*keys, "_slot")])
    once = r.groupBy(*keys, "_slot", "utc_us").agg(F.max(F.struct("_ver", "_x")).alias("m"))
    inside = (F.col("utc_us") - F.col("_slot") * width_s * 1_000_000) / 86_400e6
    return once.groupBy(*keys, F.col("_slot").alias("slot")).agg(
        F.avg("m._x").alias("x"), F.avg(inside).alias("t"), F.count(F.lit(1)).alias("n")
    )


def _smooth(t: np.ndarray, x: np.ndarray, noise: np.ndarray, q: np.ndarray, backward: bool = True, prior: tuple[float, float] = (1e8, 1e4)):
    """Forward filter and (optionally) RTS smoother over (streams, nodes); noise inf where there is no observation.

    Nodes are at times t (days, not falling); returns level and variance at every node, or the log likelihood."""
    s, n = t.shape
    seen = np.isfinite(noise)
    m0, v0 = np.zeros(s), np.zeros(s)
    p00, p01, p11 = np.full(s, prior[0]), np.zeros(s), np.full(s, prior[1])
    store = np.empty((10, n, s)) if backward else None
    like = np.zeros(s)
    first = np.ones(s, bool)
    for i in range(n):
        dt = t[:, i] - t[:, i - 1] if i else np.zeros(s)
        a0, a1 = m0 + dt * v0, v0
        b00 = p00 + 2 * dt * p01 + dt * dt * p11 + q * dt**3 / 3
        b01 = p01 + dt * p11 + q * dt**2 / 2
        b11 = p11 + q * dt
        ok = seen[:, i]
        r = np.where(ok, noise[:, i], 1.0)
        var = b00 + r
        e = np.where(ok, x[:, i] - a0, 0.0)
        k0, k1 = np.where(ok, b00 / var, 0.0), np.where(ok, b01 / var, 0.0)
        like -= np.where(ok & ~first, 0.5 * (np.log(var) + e * e / var), 0.0)
        first &= ~ok
        m0, v0 = a0 + k0 * e, a1 + k1 * e
        p00, p01, p11 = b00 * (1 - k0), b01 * (1 - k0), b11 - k1 * b01
        if backward:
            store[:, i] = m0, v0, p00, p01, p11, a0, a1, b00, b01, b11
    if not backward:
        return like
    level, var = np.empty((s, n)), np.empty((s, n))
    s0, s1, c00, c01, c11 = store[:5, n - 1]
    for i in range(n - 1, -1, -1):
        dt = t[:, i + 1] - t[:, i] if i < n - 1 else np.zeros(s)
        if dt.any():
            m0, v0, p00, p01, p11 = store[:5, i]
            a0, a1, b00, b01, b11 = store[5:, i + 1]
            det = b00 * b11 - b01 * b01
            det = np.where(np.abs(det) < 1e-300, 1.0, det)
            f00, f01, f10, f11 = p00 + dt * p01, p01, p01 + dt * p11, p11  # P F'
            g00, g01 = (f00 * b11 - f01 * b01) / det, (f01 * b00 - f00 * b01) / det
            g10, g11 = (f10 * b11 - f11 * b01) / det, (f11 * b00 - f10 * b01) / det
            d0, d1, e00, e01, e11 = s0 - a0, s1 - a1, c00 - b00, c01 - b01, c11 - b11
            moved = dt > 0  # at one instant both nodes have one state
            n0, n1 = m0 + g00 * d0 + g01 * d1, v0 + g10 * d0 + g11 * d1
            h00, h01, h10, h11 = g00 * e00 + g01 * e01, g00 * e01 + g01 * e11, g10 * e00 + g11 * e01, g10 * e01 + g11 * e11
            z00, z01, z11 = p00 + h00 * g00 + h01 * g01, p01 + h00 * g10 + h01 * g11, p11 + h10 * g10 + h11 * g11
            s0, s1 = np.where(moved, n0, s0), np.where(moved, n1, s1)
            c00, c01, c11 = np.where(moved, z00, c00), np.where(moved, z01, c01), np.where(moved, z11, c11)
        level[:, i] = s0
        var[:, i] = np.maximum(c00, 0.0)
    return level, var


def smooth_stream_batch(slots: list, x: list, t: list, n: list, width_days: float):
    """Per stream: (slot, value, std_error, missing) arrays over every slot from its first to its last."""
    size = [int(a[-1] - a[0]) + 1 for a in slots]
    s, length = len(slots), max(size)
    middle = np.tile((np.arange(length) + 0.5) * width_days, (s, 1))
    xs, times, counts = np.zeros((s, length)), middle.copy(), np.zeros((s, length))
    base, spread = np.zeros(s), np.ones(s)
    r, drift = np.ones(s), np.ones(s)
    for k in range(s):
        at = np.asarray(slots[k]) - slots[k][0]
        v = np.asarray(x[k], float)
        base[k] = v[0]
        spread[k] = np.median(np.abs(v - np.median(v))) or np.abs(v - v[0]).max() or 1.0
        z = (v - base[k]) / spread[k]
        xs[k, at], times[k, at], counts[k, at] = z, at * width_days + np.asarray(t[k]), n[k]
        if len(z) > 2:
            r[k] = max((1.4826 * np.median(np.abs(np.diff(z, 2)))) ** 2 / 6, 1e-4)
    noise = np.where(counts > 0, r[:, None] / np.maximum(counts, 1), np.inf)
    best = np.full(s, -np.inf)
    for ratio in RATIOS:
        like = _smooth(times, xs, noise, r * ratio / width_days**3, backward=False)
        drift, best = np.where(like > best, r * ratio / width_days**3, drift), np.maximum(like, best)
    # two nodes a slot, in order of time: the reading's and the grid's
    early = times <= middle
    weave = lambda a, b: np.stack([np.where(early, a, b), np.where(early, b, a)], axis=2).reshape(s, 2 * length)
    level, var = _smooth(weave(times, middle), weave(xs, np.zeros_like(xs)), weave(noise, np.full_like(noise, np.inf)), drift)
    grid = 2 * np.arange(length) + early
    level, var = np.take_along_axis(level, grid, 1), np.take_along_axis(var, grid, 1)
    for k in range(s):
        m = size[k]
        missing = counts[k, :m] == 0
        value, err = level[k, :m] * spread[k] + base[k], np.sqrt(var[k, :m]) * spread[k]
        if m == 1:
            value, err = np.array([x[k][0]], float), np.sqrt(r[k : k + 1]) * 0
        yield np.arange(m) + slots[k][0], value, err, missing


def on_grid(rows: DataFrame, keys: Sequence[str], version: str, value: Column, width_s: int) -> DataFrame:
    """keys, slot_start (epoch s), value (smoothed at the slot's middle), std_error, missing."""
    keys = list(keys)
    obs = slot_observations(rows, keys, version, value, width_s)
    streams = obs.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("slot", "x", "t", "n"))).alias("o")).select(
        *keys, *(F.col(f"o.{c}").alias(f"_{c}") for c in ("slot", "x", "t", "n"))
    )
    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in streams.select(*keys).schema.fields)
    width_days = width_s / 86400

    def work(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            order = np.argsort([a[-1] - a[0] for a in pdf["_slot"]], kind="stable")
            start = 0
            while start < len(order):
                end = start + 1
                while end < len(order) and (end - start + 1) * (pdf["_slot"].iloc[order[end]][-1] - pdf["_slot"].iloc[order[end]][0] + 1) <= CELLS:
                    end += 1
                part = pdf.iloc[order[start:end]]
                start = end
                got = list(smooth_stream_batch(*(list(part[f"_{c}"]) for c in ("slot", "x", "t", "n")), width_days))
                yield pd.DataFrame(
                    {k: part[k].to_numpy() for k in keys}
                    | {name: [g[i] for g in got] for i, name in enumerate(("slot", "value", "std_error", "missing"))}
                )

    smoothed = streams.mapInPandas(
        work, f"{key_schema}, slot array<bigint>, value array<double>, std_error array<double>, missing array<boolean>"
    )
    z = F.explode(F.arrays_zip("slot", "value", "std_error", "missing"))
    return smoothed.select(*keys, z.alias("z")).select(
        *keys, (F.col("z.slot") * width_s).alias("slot_start"), F.col("z.value").alias("value"),
        F.col("z.std_error").alias("std_error"), F.col("z.missing").alias("missing"),
    )
