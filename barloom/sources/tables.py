"""Typed scans. NaN and NULL both mean missing; here NULL is the only missing marker."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The span the test tables' readings fall in, with a month either side; times outside are unusable ones of these tables.
READINGS = (datetime(2023, 7, 1, tzinfo=UTC), datetime(2025, 3, 1, tzinfo=UTC))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL in every double/float column, in one projection."""
    return df.select(
        *(
            F.when(~F.isnan(f"`{f.name}`"), F.col(f"`{f.name}`")).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        )
    )


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """`{sf_dir}/{name}.parquet` with NaN as NULL and zone-less timestamps read as UTC."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    ntz = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    if ntz:
        df = df.withColumns({c: F.col(c).cast("timestamp") for c in ntz})
    return nan_to_null(df)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, null_value: str = ".") -> DataFrame:
    """Header CSV under an explicit schema; unparsable cells become NULL."""
    return spark.read.csv(path, header=True, schema=schema, nullValue=null_value, mode="PERMISSIVE")
