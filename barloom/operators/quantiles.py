"""Exact percentiles per key without any key's values in one task.

A mergeable sketch brackets every percentile; a second aggregation counts the values below the bracket, and only the
distinct values inside (some thousandths of a key's ranks, ties counted, not repeated) are put in order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.session import small_side, stored

#: A key with no more values is put in order whole; beyond it the bracket spans ranks enough to hold the wanted ones.
SMALL = 50_000


def percentiles(values: DataFrame, key: str, value: str, at: Sequence[float], margin: float = 2e-4) -> DataFrame:
    """(key, n, q): q the array of linearly interpolated percentiles `at` of the known values; one row a key.

    NULL values are left out; a key without values has no row."""
    known = values.where(F.col(value).isNotNull()).select(key, F.col(value).cast("double").alias("_v"))
    edges = [min(1.0, max(0.0, p + s)) for p in at for s in (-margin, margin)]
    sketch = known.groupBy(key).agg(F.percentile_approx("_v", F.array(*map(F.lit, edges)), 10_000).alias("_e"), F.count(F.lit(1)).alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    spans = [
        F.struct(F.lit(i).alias("i"), (F.when(F.lit(p - margin <= 0) | (F.col("n") <= SMALL), F.col("_lo")).otherwise(F.col("_e")[2 * i])).alias("lo"), (F.when(F.lit(p + margin >= 1) | (F.col("n") <= SMALL), F.col("_hi")).otherwise(F.col("_e")[2 * i + 1])).alias("hi"))
        for i, p in enumerate(at)
    ]
    sketch = small_side(stored(sketch.select(F.col(key).alias("_k"), "n", F.array(*spans).alias("_s"))))
    j = known.join(sketch, F.col(key) == F.col("_k"))
    below = j.groupBy("_k").agg(F.max("n").alias("n"), *(F.count(F.when(F.col("_v") < F.col("_s")[i]["lo"], 1)).alias(f"_b{i}") for i in range(len(at))))
    inside = j.select("_k", "_v", F.explode("_s").alias("s")).where("_v >= s.lo and _v <= s.hi").groupBy("_k", F.col("s.i").alias("_i"), "_v").agg(F.count(F.lit(1)).alias("_c"))
    lists = inside.groupBy("_k").pivot("_i", list(range(len(at)))).agg(F.sort_array(F.collect_list(F.struct("_v", "_c"))))
    got = below.join(lists, "_k")

    def nth(i: int, rank: Column) -> Column:
        """The value of (zero-based) rank: walk the counted values of the bracket."""
        walked = F.aggregate(
            F.col(str(i)), F.struct(F.col(f"_b{i}").cast("bigint").alias("seen"), F.lit(None).cast("double").alias("v")),
            lambda a, x: F.struct((a["seen"] + x["_c"]).alias("seen"), F.when(a["v"].isNull() & (rank < a["seen"] + x["_c"]), x["_v"]).otherwise(a["v"]).alias("v")),
        )
        return walked["v"]

    out = []
    for i, p in enumerate(at):
        exact = (F.col("n") - 1) * F.lit(float(p))
        lo, hi = nth(i, F.floor(exact)), nth(i, F.ceil(exact))
        out.append(lo + (hi - lo) * (exact - F.floor(exact)))
    return got.select(F.col("_k").alias(key), "n", F.array(*out).alias("q"))
