"""The general problems' queries (p1 to p5) over whole tables, and their SQL twins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import as_known, instants, regular_grid, rolling_totals, spikes
from barloom.plans import core_sql
from barloom.session import stored
from barloom.sources.tables import READINGS, read_table


def clocks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return instants.collector_clocks(spark, read_table(spark, sf_dir, "collectors"), READINGS)


def timed(spark: SparkSession, sf_dir: str, tab: str, clocks: DataFrame | None = None) -> DataFrame:
    """A timed table with utc_us; rows without an instant are dropped."""
    clocks = clocks_of(spark, sf_dir) if clocks is None else clocks
    return instants.normalise(read_table(spark, sf_dir, tab), tab, clocks, READINGS).where("utc_us is not null")


def p3_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of the four timed tables with its instant, whether it was standard, ambiguous or nonexistent."""
    parts, clocks = [], clocks_of(spark, sf_dir)
    for tab, (key, col, _) in instants.TIMED.items():
        df = instants.normalise(read_table(spark, sf_dir, tab), tab, clocks, READINGS)
        standard = F.coalesce(instants.in_standard_form(tab, F.col(col), F.col("utc_us")), F.lit(False))
        parts.append(df.select(F.lit(tab).alias("tab"), F.col(key).alias("row_id"), "utc_us", standard.alias("standard"), "ambiguous", "nonexistent"))
    return reduce(DataFrame.unionByName, parts)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_normalised(spark, sf_dir).where("utc_us is not null and not standard").select("tab", "row_id", "utc_us")


PERIODS = (7, 30)
VOLUMES = ("volume", "taker_buy_volume")


def _day_text(day) -> object:
    return F.date_format(F.date_from_unix_date(day.cast("int")), "yyyy-MM-dd")


def _rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling_totals.rolling_totals(
        timed(spark, sf_dir, "ohlcv"), ["collector", "symbol"], ["timeframe"], "row_id", VOLUMES, active="volume", periods=PERIODS
    )


def p1_rolling_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and daily averages of the last 7 and 30 days for every collector, symbol and UTC day."""
    state = rolling_totals.with_averages(_rolling(spark, sf_dir), VOLUMES, PERIODS)
    return state.select(
        "collector", "symbol", _day_text(F.col("day")).alias("day_utc"),
        *(f"{v}_{k}{w}" for v in VOLUMES for k in ("", "avg_") for w in PERIODS),
        *(f"{c}_{w}" for c in rolling_totals.COUNTS for w in PERIODS),
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rolling(spark, sf_dir).where("active_7 = 0").select("collector", "symbol", _day_text(F.col("day")).alias("day_utc"))


STREAM = ["collector", "symbol", "timeframe"]


def _p2_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Bars and space weather with their instants, normalised once and stored."""
    clocks = clocks_of(spark, sf_dir)
    bars = timed(spark, sf_dir, "ohlcv", clocks).select(*STREAM, "utc_us", "row_id", "close", "volume")
    wind = timed(spark, sf_dir, "space_weather", clocks).select("collector", "utc_us", "row_id", "solar_wind_speed")
    return stored(bars), stored(wind)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, wind = _p2_rows(spark, sf_dir)
    judged = spikes.judge(bars, STREAM, "row_id", {"close": spikes.CLOSE, "volume": spikes.VOLUME}, active="volume")
    blown = spikes.judge(wind, ["collector"], "row_id", {"solar_wind_speed": spikes.WIND})
    out = [
        spikes.flagged_rows(rows, keys, "row_id", j).select(F.lit(tab).alias("tab"), "row_id", "field")
        for tab, rows, keys, j in (("ohlcv", bars, STREAM, judged), ("space_weather", wind, ["collector"], blown))
    ]
    return out[0].unionByName(out[1])


def p2_hampel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every plausible reading of the three fields with its rolling median, median absolute deviation and the filter's
    verdict: the value's logarithm for close and volume, the value itself for the wind speed."""
    bars, wind = _p2_rows(spark, sf_dir)
    readings = spikes.blocked_readings(bars, STREAM, "row_id", ["close", "volume"], spikes.CLOSE.block_days, "volume")
    blown = spikes.blocked_readings(wind, ["collector"], "row_id", ["solar_wind_speed"], spikes.WIND.block_days, None)
    single = lambda c: F.col(c).cast("float").cast("double").alias(c)
    parts = []
    for field, df in (
        ("close", spikes.stepped(readings, STREAM, "close", spikes.CLOSE)),
        ("volume", spikes.surges(readings, STREAM, "volume", spikes.VOLUME)),
        ("solar_wind_speed", spikes.stepped(blown, ["collector"], "solar_wind_speed", spikes.WIND)),
    ):
        keys = [F.col(k) if k in df.columns else F.lit("").alias(k) for k in STREAM]
        parts.append(df.select(*keys, F.lit(field).alias("field"), "utc_us", F.col(field).alias("value"), single("local_median"), single("local_mad"), "hampel", "excursion"))
    return reduce(DataFrame.unionByName, parts)


def _grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    macro = read_table(spark, sf_dir, "macro").withColumn("utc_us", F.unix_date(F.trim("date").try_cast("date")).cast("bigint") * 86_400_000_000)
    none, clocks = F.lit(""), clocks_of(spark, sf_dir)
    streams = (
        ("space_weather", timed(spark, sf_dir, "space_weather", clocks).withColumn("series", none), "row_id", "kp_index", 3 * 3600),
        ("onchain_data", timed(spark, sf_dir, "onchain_data", clocks).withColumn("series", none), "id", "funding_rate", 8 * 3600),
        ("macro", macro, "row_id", "value", 86400),
    )
    parts = [
        regular_grid.on_grid(df, ["collector", "series"], key, F.col(col), width).select(F.lit(tab).alias("tab"), "*")
        for tab, df, key, col, width in streams
    ]
    return reduce(DataFrame.unionByName, parts)


def p4_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One value per slot, collector and series with its standard error and whether the slot had no reading."""
    return _grids(spark, sf_dir)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grids(spark, sf_dir).where("missing").select("tab", "collector", "series", "slot_start")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = read_table(spark, sf_dir, "ohlcv").where("symbol = 'BTC'").select("row_id", "collector", "open_time")
    events = instants.normalise(bars, "ohlcv", clocks_of(spark, sf_dir), READINGS).where("utc_us is not null").select("row_id", "utc_us")
    for tab, out in (("macro_data", "macro_row_id"), ("ephemeris", "ephemeris_row_id")):
        events = as_known.as_known(events, read_table(spark, sf_dir, tab), "row_id", out)
    return events.select("row_id", "macro_row_id", "ephemeris_row_id")


QUERIES = {
    "p1_found": p1_found,
    "p1_rolling_totals": p1_rolling_totals,
    "p2_found": p2_found,
    "p2_hampel": p2_hampel,
    "p3_found": p3_found,
    "p3_normalised": p3_normalised,
    "p4_found": p4_found,
    "p4_grid": p4_grid,
    "p5_found": p5_found,
}
SQL: dict[str, str] = dict(core_sql.SQL)
