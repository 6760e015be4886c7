"""Written tables that are built once, and the column rules a frame is checked by."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def built(spark: SparkSession, path: str) -> bool:
    """Whether a table at `path` was written to its end (its success mark exists)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def build_once(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at `path`, made only if it is not there whole; a half-written one is written again."""
    if not built(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def select_names(columns: Sequence[str], prefixes: Sequence[str] = (), suffixes: Sequence[str] = (), skip: Sequence[str] = ()) -> list[str]:
    """Columns that begin or end so (all if neither is given) and do not begin with a skipped prefix, in their order."""
    wanted = [c for c in columns if not (prefixes or suffixes) or c.startswith(tuple(prefixes) or ("\0",)) or c.endswith(tuple(suffixes) or ("\0",))]
    return [c for c in wanted if not c.startswith(tuple(skip) or ("\0",))]


def require(df: DataFrame, protected: Sequence[str]) -> DataFrame:
    """The frame, if it has every protected column once; else an error that names the missing and doubled ones."""
    missing, doubled = [c for c in protected if c not in df.columns], sorted({c for c in df.columns if df.columns.count(c) > 1})
    if missing or doubled:
        raise ValueError(f"missing columns {missing}, repeated columns {doubled}")
    return df


def numeric_only(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Numeric columns as doubles; texts that read as a number in at least one row are coerced (others NULL), the rest leave."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in keep]
    found = df.agg(*(F.count(F.col(f"`{c}`").try_cast("double")).alias(c) for c in texts)).first() if texts else {}
    out = [F.col(f"`{c}`") for c in keep]
    for f in df.schema.fields:
        if f.name in keep:
            continue
        if isinstance(f.dataType, (T.NumericType, T.BooleanType)):
            out.append(F.col(f"`{f.name}`").cast("double").alias(f.name))
        elif f.name in texts and found[f.name]:
            out.append(F.col(f"`{f.name}`").try_cast("double").alias(f.name))
    return df.select(*out)


def survivors(crosses: DataFrame) -> DataFrame:
    """signal, context, confidence -> the best confidence of every pair (rows without one leave)."""
    return crosses.where("confidence is not null").groupBy("signal", "context").agg(F.max("confidence").alias("confidence"))
