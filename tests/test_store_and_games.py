import datetime as dt

import pytest
from pyspark.sql import functions as F

from barloom.operators import games
from barloom.sources import store, tables


def test_tables_are_built_once(spark, tmp_path):
    path, made = str(tmp_path / "t"), []

    def make():
        made.append(1)
        return spark.range(3)

    assert store.build_once(spark, path, make).count() == 3 and store.build_once(spark, path, make).count() == 3 and len(made) == 1
    (tmp_path / "t" / "_SUCCESS").unlink()
    assert store.build_once(spark, path, make).count() == 3 and len(made) == 2


def test_column_rules(spark):
    df = spark.createDataFrame([("a", "1.5", 2, True), ("b", "x", 3, None)], "name string, n string, i int, b boolean")
    assert store.numeric_only(df).columns == ["n", "i", "b"] and [r["n"] for r in store.numeric_only(df).orderBy("i").collect()] == [1.5, None]
    assert store.numeric_only(df, keep=["name"]).columns[0] == "name"
    assert store.select_names(["sw_a", "rsi", "x_HIGH", "tx_1"], suffixes=["_HIGH"], prefixes=["r"]) == ["rsi", "x_HIGH"] and store.select_names(["sw_a", "rsi"], skip=["sw_"]) == ["rsi"]
    assert store.require(df, ["name"]) is df
    with pytest.raises(ValueError, match="gone"):
        store.require(df, ["gone"])
    s = store.survivors(spark.createDataFrame([("a", "b", 0.2), ("a", "b", 0.7), ("a", "c", None)], "signal string, context string, confidence double")).collect()
    assert [tuple(r) for r in s] == [("a", "b", 0.7)]


def test_csv_scan(spark, tmp_path):
    from pyspark.sql import types as T

    (tmp_path / "f.csv").write_text("date,value\n2024-01-02,3.5\n2024-01-03,.\n2024-01-04,x\n")
    schema = T.StructType([T.StructField("date", T.DateType()), T.StructField("value", T.DoubleType())])
    assert [r["value"] for r in tables.read_csv(spark, str(tmp_path / "f.csv"), schema).orderBy("date").collect()] == [3.5, None, None]


GAMES = "game_date date, league string, home string, away string, home_score int, away_score int, home_seed int, away_seed int, periods int, regular_periods int, venue string"


def test_games_and_races(spark):
    d = dt.date(2024, 1, 1)
    rows = [(d, "x", "ab", "c", 10, 7, 8, 1, 5, 4, "v"), (d, "x", "ab", "c", 3, 7, 1, 2, 4, 4, None), (d, "y", "d", "e", 5, 5, 1, 2, 4, 4, "v"), (d, "y", "d", None, None, None, 1, 2, 4, 4, "v")]
    df = spark.createDataFrame(rows, GAMES)
    g = {(r["league"], r["home_score"]): r for r in games.enriched(df).collect()}
    assert g[("x", 10)]["winner"] == "ab" and g[("x", 10)]["is_upset"] == 1 and g[("x", 10)]["is_overtime"] == 1 and g[("x", 10)]["total_root"] == 8 and g[("x", 10)]["winner_ordinal"] == 3
    assert g[("x", 3)]["winner"] == "c" and g[("x", 3)]["is_upset"] == 1 and g[("y", 5)]["winner"] is None and len({r["game_id"] for r in g.values()}) == 3
    day = games.games_daily(df).first()
    assert (day["games"], day["upsets"], day["overtimes"], day["decided"]) == (4, 2, 1, 2) and day["winner_mean"] == (3 + 3 + 0 + 0) / 4 and day["winner_root_mode"] == 0
    r = games.races_daily(spark.createDataFrame([(d, "a", "b", "c", "t", 12.0), (d, "a", None, "c", "t", None)], "race_date date, winner string, jockey string, trainer string, track string, odds double")).first()
    assert (r["races"], r["long_shots"], r["mean_odds"]) == (2, 1, 12.0)
    us = int(dt.datetime(2024, 1, 2, 5, tzinfo=dt.UTC).timestamp() * 1e6)
    bars = spark.createDataFrame([("s", us), ("s", us - 86_400_000_000)], "series string, us bigint")
    assert [x["games"] for x in games.on_bars(bars, games.games_daily(df)).orderBy(F.col("us").desc()).collect()] == [4, None]
