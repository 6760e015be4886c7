"""Ordered neighbours of every row without putting a whole series into one task.

A series is cut into time blocks; rows are hashed by (keys, block) once, so a hot series spreads over many tasks, and
every window below works on that one distribution. The first and last k rows of each block travel to the adjacent blocks
through a small per-block table (k rows a block)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.session import hold

BLOCK = "_block"


def in_blocks(df: DataFrame, keys: Sequence[str], block: Column) -> DataFrame:
    """Add _block and distribute by (keys, block). NULL keys must be filled before."""
    return df.withColumn(BLOCK, block).repartition(*[F.col(c) for c in (*keys, BLOCK)])


def with_neighbours(df: DataFrame, keys: Sequence[str], order: str, value: Column, k: int) -> DataFrame:
    """Add `prev` and `next` to a frame from in_blocks(): arrays of `value` of up to k rows before and after, in order.

    `value` must not be NULL, `order` must be unique within keys. Exact across blocks: a block that exists holds at
    least one row, so k blocks either side suffice. The frame is sorted once and not shuffled again; only the k rows a
    block are."""
    keys, part = list(keys), [*keys, BLOCK]
    w = Window.partitionBy(*part).orderBy(order)
    placed = df.withColumns({"_v": value, "_a": F.row_number().over(w), "_n": F.count(F.lit(1)).over(Window.partitionBy(*part))})
    ends = placed.where(f"_a <= {k} or _a > _n - {k}").groupBy(*part).agg(
        F.sort_array(F.collect_list(F.when(F.col("_a") <= k, F.struct("_a", "_v")))).alias("_head"),
        F.sort_array(F.collect_list(F.when(F.col("_a") > F.col("_n") - k, F.struct("_a", "_v")))).alias("_tail"),
    )
    blocks = Window.partitionBy(*keys).orderBy(BLOCK)
    flat = lambda c: F.transform(F.flatten(c), lambda x: x["_v"])
    around = ends.select(
        *part,
        F.reverse(flat(F.collect_list("_tail").over(blocks.rowsBetween(-k, -1)))).alias("_before"),
        flat(F.collect_list("_head").over(blocks.rowsBetween(1, k))).alias("_after"),
    ).repartition(*[F.col(c) for c in part])
    inner = placed.withColumns({"_p": F.collect_list("_v").over(w.rowsBetween(-k, -1)), "_q": F.collect_list("_v").over(w.rowsBetween(1, k))})
    j = inner.join(around.hint("shuffle_merge"), part, "left")
    edge_before = F.reverse(F.slice(F.concat(F.reverse("_p"), "_before"), 1, k))
    edge_after = F.slice(F.concat("_q", "_after"), 1, k)
    out = hold(j, {"prev": F.when(F.col("_a") > k, F.col("_p")).otherwise(edge_before), "next": F.when(F.col("_a") <= F.col("_n") - k, F.col("_q")).otherwise(edge_after)})
    return out.drop("_v", "_a", "_n", "_p", "_q", "_before", "_after")
