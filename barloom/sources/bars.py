"""The bar series every series operator works on: one row per (collector, symbol, timeframe, open instant)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import instants
from barloom.sources.tables import READINGS, read_table

COLUMNS = ("open", "high", "low", "close", "volume", "taker_buy_volume")


def keep_last(df: DataFrame, keys: list[str], arrival: str, values: list[str]) -> DataFrame:
    """Deduplicate: per key the row that arrived last (ties cannot occur on a unique arrival id)."""
    got = df.groupBy(*keys).agg(F.max(F.struct(arrival, *values)).alias("_l"))
    return got.select(*keys, *(F.col(f"_l.{v}").alias(v) for v in values))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series, tf, us, OHLC, volume: last delivery of every bar, impossible prices and volumes dropped or NULL."""
    clocks = instants.collector_clocks(spark, read_table(spark, sf_dir, "collectors"), READINGS)
    raw = instants.normalise(read_table(spark, sf_dir, "ohlcv"), "ohlcv", clocks, READINGS).where("utc_us is not null")
    one = keep_last(raw, ["collector", "symbol", "timeframe", "utc_us"], "row_id", list(COLUMNS))
    ok = " and ".join(f"{c} > 0 and {c} < 1e9" for c in ("open", "high", "low", "close"))
    size = lambda c: F.when((F.col(c) >= 0) & (F.col(c) < 1e14), F.col(c) / 1e6).alias(c)
    return one.where(ok).select(
        F.concat_ws(":", "collector", "symbol").alias("series"), "symbol", F.col("timeframe").alias("tf"), F.col("utc_us").alias("us"),
        "open", "high", "low", "close", size("volume"), size("taker_buy_volume"),
    )


DUCK_BARS = """WITH b_raw AS (SELECT o.*, c.epoch_basis, c.zone_name,
 CASE WHEN open_time < 100000000000 THEN open_time * 1000000 WHEN open_time < 100000000000000 THEN open_time * 1000
  WHEN open_time < 100000000000000000 THEN open_time ELSE open_time // 1000 END AS wall FROM ohlcv o LEFT JOIN collectors c USING (collector)),
b_timed AS (SELECT *, CASE WHEN epoch_basis = 'local' THEN epoch_us(timezone(zone_name, make_timestamp(wall))) ELSE wall END AS us FROM b_raw
 WHERE wall >= 1688169600000000 AND wall < 1740787200000000),
b_last AS (SELECT * FROM b_timed QUALIFY row_number() OVER (PARTITION BY collector, symbol, timeframe, us ORDER BY row_id DESC) = 1),
bars AS (SELECT collector || ':' || symbol AS series, symbol, timeframe AS tf, us, open, high, low, close,
 CASE WHEN NOT isnan(volume) AND volume >= 0 AND volume < 1e14 THEN volume / 1e6 END AS volume,
 CASE WHEN NOT isnan(taker_buy_volume) AND taker_buy_volume >= 0 AND taker_buy_volume < 1e14 THEN taker_buy_volume / 1e6 END AS taker_buy_volume
 FROM b_last WHERE open > 0 AND open < 1e9 AND high > 0 AND high < 1e9 AND low > 0 AND low < 1e9 AND close > 0 AND close < 1e9)
--body-- SELECT * FROM bars"""
