"""Labels, purged combinatorial splits, sample uniqueness, overfitting statistics."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.quantiles import percentiles
from barloom.plans.portable import Dialect, Stages, lag, lead, over, rolling


def targets(d: Dialect) -> Stages:
    """Next return, direction, returns over several bars ahead."""
    s1 = {f"next_{k}": lead("close", k) for k in (1, 5, 10)}
    return [s1, {"next_return_pct": "100 * (next_1 - close) / close", "next_direction": "CASE WHEN next_1 > close THEN 1 WHEN next_1 <= close THEN 0 END",
                 **{f"return_{k}_ahead": f"(next_{k} - close) / close" for k in (5, 10)}}]


def triple_barrier(d: Dialect, width: float = 2.0, hold: int = 24) -> Stages:
    """2 if the upper barrier is hit first (tested before the lower on one bar), 0 if the lower, else 1; NULL on the last bar."""
    s1 = {"tr": f"greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')}))"}
    s2 = {"atr": rolling("avg", "tr", 14), "n_ahead": f"count(close) {over(ahead=hold)}",
          "highs": d.collect("high", over(ahead=hold)), "lows": d.collect("low", over(ahead=hold))}
    ups = d.map("highs", "h", f"h >= close + {width} * atr")
    downs = d.map("lows", "l", f"l <= close - {width} * atr")
    find = "list_position" if d.duck else "array_position"
    s3 = {"up_at": f"nullif(coalesce({find}({ups}, TRUE), 0), 0)", "down_at": f"nullif(coalesce({find}({downs}, TRUE), 0), 0)"}
    label = "CASE WHEN n_ahead = 0 OR atr IS NULL THEN NULL WHEN up_at IS NOT NULL AND (down_at IS NULL OR up_at <= down_at) THEN 2 WHEN down_at IS NOT NULL THEN 0 ELSE 1 END"
    held = "CASE WHEN n_ahead = 0 OR atr IS NULL THEN NULL ELSE least(coalesce(up_at, n_ahead), coalesce(down_at, n_ahead)) END"
    return [s1, s2, s3, {"label_i": label, "held_i": held, "pos_i": "row_number() OVER (PARTITION BY series ORDER BY us)"}]


def cpcv_splits(rows: DataFrame, groups: int = 6, tests: int = 2, embargo: float = 0.01) -> DataFrame:
    """rows: ..., t0, t1 (event interval) -> (path, role, all columns): test rows, and train rows after purge and embargo.

    Groups are contiguous in t0, cut at exact quantiles. A train row is purged if its interval meets any test group's, or
    starts within the embargo after it (per group, so rows between two test groups stay). What is read first is one row
    a group; the paths (15 for two of six) are emitted by a generator, without a join."""
    at = [i / groups for i in range(1, groups)]
    cut = percentiles(rows.select(F.lit(0).alias("k"), "t0"), "k", "t0", at).select("q").first()
    span = rows.agg(F.min("t0"), F.max("t0")).first()
    if cut is None:
        return rows.limit(0).select(F.lit(0).alias("path"), F.lit("").alias("role"), "*")
    gap = (span[1] - span[0]) * embargo
    group = sum(((F.col("t0") >= F.lit(c)).cast("int") for c in cut[0]), F.lit(0))
    numbered = rows.withColumn("_g", group)
    bounds = {r["_g"]: (r["a"], r["z"]) for r in numbered.groupBy("_g").agg(F.min("t0").alias("a"), F.max("t1").alias("z")).collect()}
    roles = []
    for path, chosen in enumerate(combinations(range(groups), tests)):
        test = F.col("_g").isin(*chosen)
        clash = F.lit(False)
        for g in chosen:
            if g in bounds:
                a, z = bounds[g]
                clash = clash | ((F.col("t0") <= F.lit(z + gap)) & (F.col("t1") >= F.lit(a)))
        roles.append(F.struct(F.lit(path).alias("path"), F.when(test, "test").when(clash, None).otherwise("train").alias("role")))
    return numbered.select(F.inline(F.filter(F.array(*roles), lambda r: r["role"].isNotNull())), *rows.columns)


def uniqueness(rows: DataFrame) -> DataFrame:
    """rows: series, id, t0, t1 (bar positions, inclusive). Mean of 1/concurrency over the interval, counting itself once."""
    deltas = rows.select("series", F.explode(F.array(F.struct(F.col("t0").alias("p"), F.lit(1).alias("d")), F.struct((F.col("t1") + 1).alias("p"), F.lit(-1).alias("d")))).alias("x"))
    steps = deltas.groupBy("series", F.col("x.p").alias("p")).agg(F.sum("x.d").alias("d"))
    w = Window.partitionBy("series").orderBy("p")
    level = steps.withColumn("c", F.sum("d").over(w)).withColumn("to", F.lead("p").over(w))
    area = F.when(F.col("c") > 0, (F.col("to") - F.col("p")) / F.col("c")).otherwise(0.0)
    summed = level.withColumn("before", F.coalesce(F.sum(area).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    at = summed.select(F.col("series").alias("_s"), F.col("p").alias("_p"), "before")
    j = rows.join(at, (F.col("series") == F.col("_s")) & (F.col("t0") == F.col("_p"))).withColumnRenamed("before", "_a").drop("_s", "_p")
    j = j.join(at, (F.col("series") == F.col("_s")) & (F.col("t1") + 1 == F.col("_p"))).withColumnRenamed("before", "_z").drop("_s", "_p")
    return j.withColumn("uniqueness", (F.col("_z") - F.col("_a")) / (F.col("t1") - F.col("t0") + 1)).drop("_a", "_z")


def average_ranks(scores: DataFrame, by: str, score: str, out: str) -> DataFrame:
    """Ranks with ties averaged (1 is least); few rows: one per path."""
    w = Window.partitionBy(by).orderBy(score)
    ties = Window.partitionBy(by, score)
    return scores.withColumn("_r", F.row_number().over(w)).withColumn(out, F.avg("_r").over(ties)).drop("_r")


def overfitting(paths: DataFrame) -> DataFrame:
    """paths: metric, path, in_sample, out_sample -> probability that the better half in sample falls under the median out of sample."""
    r = average_ranks(average_ranks(paths, "metric", "in_sample", "is_rank"), "metric", "out_sample", "oos_rank")
    n = F.count(F.lit(1)).over(Window.partitionBy("metric"))
    r = r.withColumn("n", n).where("is_rank > n / 2.0")
    rel = F.col("oos_rank") / (F.col("n") + 1)
    return r.groupBy("metric").agg(F.avg((rel <= 0.5).cast("int")).alias("pbo"), F.avg(F.log(rel / (1 - rel))).alias("mean_logit")).withColumn(
        "verdict", F.when(F.col("pbo") < 0.15, "DEPLOY").when(F.col("pbo") < 0.30, "INVESTIGATE").otherwise("REJECT")
    )
