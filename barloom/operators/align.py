"""Alignment of slow or irregular side tables to an ordered series (backward, forward, nearest, date, bucket, interval).

The as-of joins are union + last value, cut into time blocks: rows are hashed by (keys, block), and the last value of the
blocks before comes through a table of one row a block, so a hot key spreads over many tasks. No range join, no pairs.

Defined results: right rows with NULL time or values never match; at equal times the right row counts for the left one;
of right rows at one instant the greatest (by their columns in order) counts; an empty side gives NULLs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def asof(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, values: Sequence[str],
    block_us: int = 30 * DAY_US, forward: bool = False,
) -> DataFrame:
    """`left` plus the `values` (and `matched_us`) of the last right row at or before (forward: first at or after)."""
    keys, sign = list(keys), -1 if forward else 1
    clash = set(values) & set(left.columns)
    if clash:
        raise ValueError(f"rename the right columns {sorted(clash)}")
    v = F.struct(F.col(right_time).alias("matched_us"), *values)
    r = right.where(F.col(right_time).isNotNull()).groupBy(*keys, (F.col(right_time) * sign).alias("_t")).agg(F.max(v).alias("_v"))
    none = F.lit(None)
    rows = left.select(*keys, (F.col(left_time) * sign).alias("_t"), F.struct(*left.columns).alias("_l"), F.lit(1).alias("_side"))
    rows = rows.withColumn("_v", none.cast(r.schema["_v"].dataType))
    marks = r.select(*keys, "_t", none.cast(rows.schema["_l"].dataType).alias("_l"), F.lit(0).alias("_side"), "_v")
    both = rows.unionByName(marks).withColumn("_b", F.floor(F.col("_t") / block_us))
    inside = Window.partitionBy(*keys, "_b").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    blocks = both.groupBy(*keys, "_b").agg(F.max(F.when(F.col("_side") == 0, F.struct("_t", "_v"))).alias("_m"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = blocks.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_b").alias("_cb"), F.last("_m", ignorenulls=True).over(before).alias("_c"))
    cond = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_b").eqNullSafe(F.col("_cb"))]
    found = both.withColumn("_w", F.last("_v", ignorenulls=True).over(inside)).where("_side = 1").join(carry, cond, "left")
    got = F.coalesce(F.col("_w"), F.col("_c._v"))
    return found.select("_l.*", got["matched_us"].alias("matched_us"), *(got[c].alias(c) for c in values))


def asof_nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, value: str, tolerance_us: int) -> DataFrame:
    """`left` plus the value nearest in time on either side within the tolerance; the earlier one at equal distance."""
    back = asof(left, right, keys, left_time, right_time, [value]).withColumnsRenamed({"matched_us": "_bt", value: "_bv"})
    both = asof(back, right, keys, left_time, right_time, [value], forward=True).withColumnsRenamed({"matched_us": "_ft", value: "_fv"})
    db, df = F.col(left_time) - F.col("_bt"), F.col("_ft") - F.col(left_time)
    take_back = F.col("_bt").isNotNull() & (F.col("_ft").isNull() | (db <= df))
    gap = F.when(take_back, db).otherwise(df)
    return both.withColumn(value, F.when(gap <= tolerance_us, F.when(take_back, F.col("_bv")).otherwise(F.col("_fv")))).drop("_bt", "_bv", "_ft", "_fv")


def by_date(bars: DataFrame, side: DataFrame, date_col: str, values: Sequence[str], fill: bool = True) -> DataFrame:
    """Exact date match of a daily side table (one row a date), then forward fill over the bars of each series."""
    d = F.date_from_unix_date(F.floor(F.col("us") / DAY_US).cast("int"))
    j = bars.withColumn("_d", d).join(side.select(F.col(date_col).alias("_sd"), *values), F.col("_d") == F.col("_sd"), "left").drop("_d", "_sd")
    if not fill:
        return j
    w = Window.partitionBy("series").orderBy("us").rowsBetween(Window.unboundedPreceding, 0)
    return j.withColumns({v: F.last(v, ignorenulls=True).over(w) for v in values})


def longest_text_per_bar(bars: DataFrame, texts: DataFrame, keys: Sequence[str], width_us: int) -> DataFrame:
    """Assign each text to the bar whose interval holds it; keep the longest (the first on ties). bars: keys, us; texts: keys, us, id, text."""
    best = texts.withColumn("_bar", F.floor(F.col("us") / width_us) * width_us).groupBy(*keys, "_bar").agg(
        F.max_by("text", F.struct(F.length("text"), -F.col("id"))).alias("text")
    )
    return bars.join(best, [*(bars[k] == best[k] for k in keys), bars["us"] == best["_bar"]], "left").select(bars["*"], best["text"])
