"""Matching records by nearest time (problem 6): expanding-ring joins.

The finest ring: left and right rows of a key are laid into buckets of the finest width and ordered by time inside each;
the nearest right row of the own bucket on either side is carried to the left row by ordered windows (spilling, no
arrays). Every bucket of right rows also has one summary row: its first and last instant. One equality join with the
summaries of the adjacent buckets then gives the nearest candidate in three adjacent buckets. Anything within one
bucket width of the left row lies in those three, so a candidate at most one width away is provably nearest: the row is
accepted and leaves. Only rows still open go on to buckets of double width, up to the tolerance. In a coarser ring the
row's own bucket has been searched already (its halves were among the last ring's adjacent buckets), so one equality
join with the neighbours' nearest ends suffices.

Rows are spread by (key, finest bucket), so a hot key is as many groups as it has buckets; all summaries are one
fixed-size row a bucket. Equal distances take the lowest id, limits are included. Defined results: NULL times, keys or an
empty side match nothing; repeated left rows each get their match. Left and right columns cannot clash: only the
match's id is added.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.session import cut_lineage, small_side


def _summary(own: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per (key, bucket) next to one with right rows: the last instant before it and the first after it."""
    none = F.lit(None).cast(own.schema["lo"].dataType)
    roles = F.array(
        F.struct((F.col("_b") - 1).alias("b"), none.alias("prev"), F.col("lo").alias("next")),
        F.struct((F.col("_b") + 1).alias("b"), F.col("hi").alias("prev"), none.alias("next")),
    )
    return own.select(*keys, F.inline(roles)).groupBy(*(F.col(k).alias(f"_r_{k}") for k in keys), F.col("b").alias("_rb")).agg(
        F.max("prev").alias("_prev"), F.max("next").alias("_next")
    )


def _in_own_bucket(left: DataFrame, right: DataFrame, keys: Sequence[str], t: str) -> DataFrame:
    """The left rows with `_back` and `_ahead`: the nearest right (t, id) of their own bucket on either side."""
    pair = "struct<t:bigint,id:bigint>"
    rows = left.select(*keys, "_b", F.col(t).alias("_at"), F.struct(*left.columns).alias("_l"), F.lit(1).alias("_side"), F.lit(None).cast(pair).alias("_p"))
    marks = right.select(*keys, "_b", F.col("t").alias("_at"), F.lit(None).cast(rows.schema["_l"].dataType).alias("_l"), F.lit(0).alias("_side"), F.struct("t", "id").alias("_p"))
    both = rows.unionByName(marks).repartition(*[F.col(k) for k in (*keys, "_b")])
    # right rows of one instant stand before the left ones, the lowest id nearest to them, in either direction
    w = Window.partitionBy(*keys, "_b")
    back = w.orderBy("_at", "_side", F.col("_p.id").desc()).rowsBetween(Window.unboundedPreceding, 0)
    ahead = w.orderBy(F.col("_at").desc(), "_side", F.col("_p.id").desc()).rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("_back", F.last("_p", ignorenulls=True).over(back)).withColumn("_ahead", F.last("_p", ignorenulls=True).over(ahead))
    return near.where("_side = 1").select("_l.*", "_back", "_ahead")


def nearest(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_us: str, right_us: str, right_id: str, tolerance_us: int, out: str, rings: int = 4
) -> DataFrame:
    """`left` plus `out`: the id of the right row of the same key nearest in time within the tolerance, else NULL."""
    keys, columns = list(keys), left.columns
    finest = -(-tolerance_us // 2 ** (rings - 1))
    t = F.col("_t")

    def best(*found: Column) -> Column:
        gaps = [F.when(p.isNotNull(), F.struct(F.abs(p["t"] - t).alias("gap"), p["id"].alias("id"))) for p in found]
        return F.array_min(F.array_compact(F.array(F.col("_best"), *gaps)))

    wanted = small_side(left.select(*keys).distinct())
    points = right.where(f"{right_us} is not null").join(wanted, keys, "left_semi")
    points = points.select(*keys, F.floor(F.col(right_us) / finest).cast("bigint").alias("_b"), F.col(right_us).alias("t"), F.col(right_id).alias("id"))
    # the first instant of a bucket with its lowest id, and the last one with its lowest id
    own = points.groupBy(*keys, "_b").agg(F.min(F.struct("t", "id")).alias("lo"), F.max(F.struct("t", (-F.col("id")).alias("id"))).alias("hi"))
    own = cut_lineage(own.withColumn("hi", F.struct(F.col("hi.t").alias("t"), (-F.col("hi.id")).alias("id"))))
    none = F.lit(None).cast("struct<gap:bigint,id:bigint>")
    rows = left.select(F.struct(*columns).alias("_row"), *(F.col(k) for k in keys), F.col(left_us).alias("_t"), none.alias("_best"))
    open_ = rows.where(t.isNotNull())
    parts = [rows.where(t.isNull()).select("_row", "_best")]
    for ring in range(rings):
        width = finest * 2**ring
        if ring:  # widths double, so a coarser bucket is a run of finest ones
            coarse = F.call_function("div", F.col("_b") - F.pmod(F.col("_b"), F.lit(2**ring)), F.lit(2**ring))
            buckets = own.groupBy(*keys, coarse.alias("_b")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        else:
            buckets = own
        at = open_.withColumn("_b", F.floor(t / width).cast("bigint"))
        if not ring:
            at = _in_own_bucket(at, points, keys, "_t")
            at = at.withColumn("_best", best(F.col("_back"), F.col("_ahead"))).drop("_back", "_ahead")
        cond = [F.col(k) == F.col(f"_r_{k}") for k in keys] + [F.col("_b") == F.col("_rb")]
        j = at.join(_summary(buckets, keys), cond, "left").withColumn("_best", best(F.col("_prev"), F.col("_next")))
        j = cut_lineage(j.select(*rows.columns))
        done = F.coalesce(F.col("_best.gap") <= width, F.lit(False))
        parts.append(j.where(done).select("_row", "_best"))
        open_ = j.where(~done)
    parts.append(open_.select("_row", "_best"))
    hit = F.when(F.col("_best.gap") <= tolerance_us, F.col("_best.id"))
    return reduce(DataFrame.unionByName, parts).select("_row.*", hit.alias(out))
