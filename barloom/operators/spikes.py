"""Implausible readings per stream (problem 2): Hampel filter, run-length detection and physical bounds.

A stream is one source's readings in order of time. Per reading: the rolling median of the seven readings around it and
their median absolute deviation (Hampel filter; on the logarithm for relative fields; a second filter of five readings); runs of equal values from five
neighbours either side; and the stream's usual step (median of |x - previous|). The filter proposes: only readings
further from their rolling median than `hampel` scaled deviations, and the readings next to these, are candidates. Each
candidate is then compared exactly with both sides against the usual step.

Streams are cut into time blocks: rows are distributed by (stream, block), so no stream ever sits in one task. Rows are
normalised once and readings are deduplicated once, each stored as a compressed table that the passes scan by column.
The usual step is the exact median: a mergeable sketch brackets it, a second aggregation counts below the bracket and
orders only what lies inside (some 4 in 10,000 steps).

Defined results: NULL/NaN readings and rows without an instant are no readings. Repeated deliveries of one instant
count once (the first delivered row gives the value) and every delivered row is listed. NULL keys count as empty text. A reading at the start or end
of a stream has no neighbour on one side and is no excursion. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.neighbours import BLOCK, in_blocks, with_neighbours
from barloom.session import hold, small_side, stored

DAY_US = 86_400_000_000


@dataclass(frozen=True)
class Rule:
    """How one field is judged. low/high: physical bounds (low exclusive unless low_ok)."""

    low: float
    high: float
    low_ok: bool = False
    relative: bool = False
    step_factor: float = 12.0
    ratio: float | None = None
    run: int = 6
    hampel: float = 1.5
    block_days: int = 60


#: Bounds are scales no market or wind reaches: a price of 1e9, a bar of 1e14 units, 5,000 km/s.
CLOSE = Rule(low=0, high=1e9, relative=True)
VOLUME = Rule(low=0, high=1e14, low_ok=True, ratio=15.0)
WIND = Rule(low=0, high=5000)


def _at(a: Column, i: int) -> Column:
    return F.try_element_at(a, F.lit(i))


def impossible(x: Column, rule: Rule) -> Column:
    return (x < rule.low if rule.low_ok else x <= rule.low) | (x > rule.high)


def _centre(v: np.ndarray) -> np.ndarray:
    """Row medians of a matrix, NaN cells left out (mean of the middle two)."""
    s, n = np.sort(v, axis=1), np.count_nonzero(~np.isnan(v), axis=1)
    take = lambda k: np.take_along_axis(s, np.maximum(k, 0)[:, None], 1)[:, 0]
    return (take((n - 1) // 2) + take(n // 2)) / 2


def verdicts(line: np.ndarray, deviations: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(median, mad, rejected, proposed) of the middle one of seven readings in order, rows of `line`; NaN where none is."""

    def reject(lo: int, hi: int, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        v = line[:, lo:hi]
        median = _centre(v)
        mad = _centre(np.abs(v - median[:, None]))
        with np.errstate(invalid="ignore"):
            return median, mad, np.abs(line[:, at] - median) > 1.4826 * deviations * mad

    if not len(line):
        return (np.empty(0), np.empty(0), np.empty(0, bool), np.empty(0, bool))
    median, mad, far = reject(0, 7, 3)
    near = reject(1, 6, 3)[2] | reject(0, 5, 2)[2] | reject(2, 7, 4)[2]
    return median, mad, far, far | near


def lifts(line: np.ndarray, relative: bool) -> np.ndarray:
    """How far the middle one of seven readings (alone, or with the one before or after it) lies off its neighbours on both
    sides in the same direction, in steps' unit (relative or absolute); 0 if it does not or a neighbour is missing."""
    p2, p1, x, n1, n2 = line[:, 1:6].T

    def least(values: list[np.ndarray], sides: list[np.ndarray]) -> np.ndarray:
        gaps = np.array([(v - s) / (s if relative else 1.0) for v in values for s in sides])
        return np.nan_to_num(np.maximum(gaps.min(0), -gaps.max(0)), nan=0.0)

    with np.errstate(invalid="ignore"):
        off = np.maximum.reduce([least([x], [p1, n1]), least([x, n1], [p1, n2]), least([x, p1], [p2, n1])])
    return np.maximum(off, 0.0)


def _hampel(near: DataFrame, x: Column, before: Sequence[Column], after: Sequence[Column], rule: Rule, log: bool) -> DataFrame:
    """Add local_median and local_mad of seven readings, `hampel` (further from its rolling median than rule.hampel scaled
    deviations), `proposed`: so, or so in the window of five, or the window of five rejects a reading next to it, as for a
    reading between two spikes; and the `lift` of proposed readings. Medians of small windows are NumPy's work: Arrow
    batches, sorted rows at once."""
    deviations, relative = rule.hampel, rule.relative

    @F.pandas_udf("struct<local_median:double,local_mad:double,hampel:boolean,proposed:boolean,lift:double>")
    def judged(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series, e: pd.Series, f: pd.Series, g: pd.Series) -> pd.DataFrame:
        line = np.column_stack([s.to_numpy(float, na_value=np.nan) for s in (a, b, c, d, e, f, g)])
        median, mad, far, proposed = verdicts(np.log(line) if log else line, deviations)
        lift = np.where(proposed, lifts(line, relative), 0.0)
        return pd.DataFrame({"local_median": median, "local_mad": mad, "hampel": far, "proposed": proposed, "lift": lift})

    near = near.withColumn("_judged", judged(*reversed(before[:3]), x, *after[:3]))
    return near.select("*", "_judged.*").drop("_judged")


def _near(df: DataFrame, keys: Sequence[str], value: str, rule: Rule, busy: str) -> DataFrame:
    """Plausible readings of a blocked frame with Hampel's columns, `lift`, step from the reading before, and `stuck`."""
    x = F.col(value)
    plain = df.where(x.isNotNull() & ~impossible(x, rule))
    near = with_neighbours(plain, keys, "utc_us", F.struct(x.alias("x"), F.col(busy).alias("busy")), rule.run - 1)
    side = lambda i: _at(F.col("prev" if i < 0 else "next"), i)
    near = near.withColumns({"_p1": side(-1)["x"], "_n1": side(1)["x"], "_pb": side(-1)["busy"]})
    same = lambda s: (s["x"] == x) & s["busy"]
    length = lambda a: F.coalesce(F.nullif(F.array_position(F.transform(a, same), F.lit(False)), F.lit(0)) - 1, F.size(a))
    # only a busy reading equal to a busy one before it can be stuck; only then the arrays are looked through
    level = F.col(busy) & F.col("_pb") & (F.col("_p1") == x)
    run = length(F.reverse("prev")) + length(F.col("next")) + 1
    step = F.when(F.col(busy) & F.col("_pb"), F.abs(x - F.col("_p1")) / (F.col("_p1") if rule.relative else F.lit(1.0)))
    near = near.withColumns({"stuck": F.coalesce(F.when(level, run >= rule.run), F.lit(False)), "step": step})
    near = _hampel(near, x, [F.col("_p1"), side(-2)["x"], side(-3)["x"]], [F.col("_n1"), side(2)["x"], side(3)["x"]], rule, rule.relative)
    return near.select(*keys, "utc_us", value, "local_median", "local_mad", "hampel", "proposed", "lift", "step", "stuck")


def _usual_steps(steps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The stream's exact median step, one row a stream; `steps` is scanned twice."""
    keys = list(keys)
    known = steps.where("step is not null").select(*keys, "step")
    sketch = known.groupBy(*keys).agg(F.percentile_approx("step", F.array(F.lit(0.4998), F.lit(0.5002)), 10_000).alias("_q"), F.count(F.lit(1)).alias("_n"))
    sketch = small_side(stored(sketch))
    j = known.join(sketch, keys)
    lo, hi = F.col("_q")[0], F.col("_q")[1]
    got = j.groupBy(*keys).agg(
        F.max("_n").alias("_n"), F.count(F.when(F.col("step") < lo, 1)).alias("_below"),
        F.sort_array(F.collect_list(F.when((F.col("step") >= lo) & (F.col("step") <= hi), F.col("step")))).alias("_in"),
    )
    nth = lambda k: F.element_at("_in", (k - F.col("_below")).cast("int"))
    middle = (nth(F.floor((F.col("_n") + 1) / 2)) + nth(F.floor(F.col("_n") / 2) + 1)) / 2
    return got.select(*keys, middle.alias("usual_step"))


def _over(rule: Rule) -> Column:
    return F.coalesce(F.col("proposed") & (F.col("lift") > rule.step_factor * F.col("usual_step")), F.lit(False))


def stepped(readings: DataFrame, keys: Sequence[str], value: str, rule: Rule) -> DataFrame:
    """Every plausible reading with local_median, local_mad, hampel, stuck, usual_step and `excursion`."""
    near = stored(_near(readings, keys, value, rule, "_busy"))
    usual = small_side(stored(_usual_steps(near, keys)))
    return near.join(usual, list(keys), "left").withColumn("excursion", _over(rule)).drop("lift", "step")


def surges(readings: DataFrame, keys: Sequence[str], value: str, rule: Rule) -> DataFrame:
    """Every positive plausible reading with Hampel's columns on the logarithm and `excursion`: proposed by the filter and
    more than rule.ratio times both neighbours that are positive."""
    x = F.col(value)
    near = with_neighbours(readings.where((x > 0) & ~impossible(x, rule)), keys, "utc_us", x, 3)
    before, after = [_at(F.col("prev"), -i) for i in (1, 2, 3)], [_at(F.col("next"), i) for i in (1, 2, 3)]
    near = _hampel(near, x, before, after, rule, True)
    over = F.col("proposed") & (x > rule.ratio * before[0]) & (x > rule.ratio * after[0])
    near = near.withColumn("excursion", F.coalesce(over, F.lit(False)))
    return near.select(*keys, "utc_us", value, "local_median", "local_mad", "hampel", "proposed", "excursion")


def levels(readings: DataFrame, keys: Sequence[str], value: str, rule: Rule) -> DataFrame:
    """Plausible busy readings in runs of rule.run and more equal successive ones, without the first of each."""
    x = F.col(value)
    plain = readings.where(x.isNotNull() & ~impossible(x, rule))
    near = with_neighbours(plain, keys, "utc_us", F.struct(x.alias("x"), F.col("_busy").alias("busy")), rule.run - 1)
    same = lambda s: (s["x"] == x) & s["busy"]
    near = near.where(F.col("_busy") & F.coalesce(same(_at(F.col("prev"), -1)), F.lit(False)))
    length = lambda a: F.coalesce(F.nullif(F.array_position(F.transform(a, same), F.lit(False)), F.lit(0)) - 1, F.size(a))
    near = hold(near, {"_before": length(F.reverse("prev")), "_after": length(F.col("next"))})
    return near.where(F.col("_before") + F.col("_after") + 1 >= rule.run).select(*keys, "utc_us")


def _block(days: int) -> Column:
    return F.floor(F.col("utc_us") / (DAY_US * days)).cast("int")


def blocked_readings(rows: DataFrame, keys: Sequence[str], version: str, values: Sequence[str], days: int, active: str | None) -> DataFrame:
    """One row per (keys, utc_us), values of the first delivery, distributed by (keys, time block) in a single shuffle."""
    keys = list(keys)
    df = rows.select(*(F.coalesce(k, F.lit("")).alias(k) for k in keys), "utc_us", version, *values)
    df = in_blocks(df, keys, _block(days))
    got = df.groupBy(*keys, BLOCK, "utc_us").agg(F.min(F.struct(version, *values)).alias("_f"))
    busy = F.coalesce(F.col(f"_f.{active}") > 0, F.lit(False)) if active else F.lit(True)
    return got.select(*keys, BLOCK, "utc_us", *(F.col(f"_f.{v}").alias(v) for v in values), busy.alias("_busy"))


def judge(rows: DataFrame, keys: Sequence[str], version: str, fields: dict[str, Rule], active: str | None = None) -> DataFrame:
    """(keys, utc_us, field, reason) of every implausible reading; `active`: field that must be positive in stuck runs."""
    keys = list(keys)
    values = list(dict.fromkeys([*fields, *([active] if active else [])]))
    bars = stored(blocked_readings(rows, keys, version, values, max(r.block_days for r in fields.values()), active).drop(BLOCK))
    reasons = F.array(*(F.struct(F.lit(f).alias("field"), F.coalesce(impossible(F.col(f), r), F.lit(False)).alias("bad")) for f, r in fields.items()))
    bad = bars.select(*keys, "utc_us", F.inline(F.filter(reasons, lambda r: r["bad"])))
    parts = [bad.select(*keys, "utc_us", "field", F.lit("impossible").alias("reason"))]
    for field, rule in fields.items():
        tag = lambda d, reason, f=field: d.select(*keys, "utc_us", F.lit(f).alias("field"), reason.alias("reason"))
        blocks = in_blocks(bars.select(*keys, "utc_us", field, "_busy"), keys, _block(rule.block_days))
        if rule.ratio is not None:
            parts += [tag(levels(blocks, keys, field, rule), F.lit("stuck")), tag(surges(blocks, keys, field, rule).where("excursion"), F.lit("excursion"))]
            continue
        found = stepped(blocks, keys, field, rule).where("stuck or excursion")
        parts.append(tag(found, F.when(F.col("excursion"), "excursion").otherwise("stuck")))
    return reduce(DataFrame.unionByName, parts)


def flagged_rows(rows: DataFrame, keys: Sequence[str], row_id: str, judged: DataFrame) -> DataFrame:
    """Every delivered row of a judged reading: (row_id, field), once."""
    keys = list(keys)
    right = small_side(stored(judged.select(*keys, "utc_us", "field").distinct()))
    left = rows.select(*(F.coalesce(k, F.lit("")).alias(k) for k in keys), "utc_us", F.col(row_id).alias("row_id"))
    return left.join(right, [*keys, "utc_us"]).select("row_id", "field")
