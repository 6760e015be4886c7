"""Session defaults and the few helpers that need a session."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side whose measured bytes stay at or under this is broadcast; beyond it the join shuffles (AQE splits skewed keys).
BROADCAST_BYTES = 32 << 20


def session(app: str = "barloom", master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with the settings every plan here assumes: UTC, AQE, skew-join handling."""
    b = SparkSession.builder.appName(app).master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in (base | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and written intermediate tables: the one the session has or names in spark.checkpoint.dir.

    On one machine (master local[...]) a temporary folder is set where none is named; on a cluster that is an error, since
    executors cannot share it."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="barloom-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint into the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write to a table of its own in the shared folder and read it back: lineage is cut, and later uses scan only the
    columns they need (compressed, unlike a checkpoint)."""
    path = f"{shared_folder(df.sparkSession)}/{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def row_bytes(df: DataFrame) -> Column:
    """About the bytes a row takes: eight a column, plus texts, arrays and nested values by their printed length."""
    size = F.lit(8 * len(df.columns))
    for f in df.schema.fields:
        kind, c = f.dataType.simpleString(), F.col(f"`{f.name}`")
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(c), F.lit(0))
        elif kind.startswith(("array", "struct", "map")):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
    return size.cast("bigint")


def is_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether all rows together stay within `limit` bytes (one aggregation over the side)."""
    return (df.agg(F.sum(row_bytes(df))).first()[0] or 0) <= limit


def small_side(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """`df` with a broadcast hint if its measured bytes are within the bound, else unhinted (shuffled join)."""
    return F.broadcast(df) if is_small(df, limit) else df


def hold(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """withColumns behind a one-row generator: filters and projections above cannot copy the expressions into
    themselves, which would write nested expressions out again and again."""
    return df.select("*", F.inline(F.array(F.struct(*(e.alias(n) for n, e in columns.items())))))
