"""Feature-group queries over bars: stages compiled for Spark, the same stages in DuckDB as oracle, and EWM groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import calendar, sky
from barloom.operators import kernels, momentum, ta
from barloom.plans.portable import DUCK, feature_query
from barloom.sources.bars import DUCK_BARS, bars

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Helpers, and differences of long running sums, whose last bits depend on the order of summation.
_HIDE = {"low_pv", "low_v", "high_pv", "high_v", "pv_sum", "v_sum", "pv_before", "v_before", "m20", "sd20", "hi14", "lo14", "tp", "tp_m20", "tp_sd20", "prev_high", "prev_low", "prev_open", "prev_close", "ts", "past", "age0", "dow", "md", "hour_n", "first_planet", "day_n", "r1", "r1k", "r2k", "text_n"}


def _add(name: str, build) -> None:
    shown = list(dict.fromkeys(c for s in build(DUCK) for c in s if c not in _HIDE and c not in ("block", "last_red", "last_green")))
    QUERIES[name], SQL[name] = feature_query(build, bars, DUCK_BARS, shown)


for _name, _build in {
    "ta_moving_averages": ta.moving_averages,
    "ta_bands": ta.bands,
    "ta_ranges": ta.ranges,
    "ta_volume": ta.volume,
    "ta_candles": ta.candles,
    "ta_channels": ta.channels,
    "kernels": kernels.kernels,
    "calendar_time": calendar.time_columns,
    "calendar_numerology": calendar.numerology,
    "sky": sky.sky,
    "numbers": sky.numbers,
}.items():
    _add(_name, _build)


def fractional_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fractional differences of close, log close, volume and on-balance volume with the full weights."""
    got = kernels.fractional_differences(bars(spark, sf_dir))
    return got.select("series", "us", *(F.col(c).cast("float").cast("double").alias(c) for c in got.columns[2:]))


QUERIES["fractional_differences"] = fractional_differences
_HEAD, _, _BODY = DUCK_BARS.partition("--body--")
SQL["fractional_differences"] = kernels.fractional_sql(_HEAD, _BODY)


for _name, _build, _show in (
    ("ta_exponential", momentum.averages, momentum.AVERAGES),
    ("ta_directional", momentum.directional, momentum.DIRECTIONAL),
    ("ta_signals", momentum.signals, momentum.SIGNALS),
    ("ta_variants", momentum.variants, momentum.VARIANTS),
):
    QUERIES[_name], SQL[_name] = feature_query(_build, bars, DUCK_BARS, _show)
