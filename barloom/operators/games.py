"""Game results and races: enrichment on arrival and daily roll-ups with ciphers of names.

Defined results: a game without both scores has no winner and counts in `games` only; equal scores have no winner; NULL
names count as empty texts; a day without games has no row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions import ciphers


def _sum(name: str, text: str) -> Column:
    return ciphers.cipher(F.col(text), ciphers.CIPHERS[name])


def enriched(games: DataFrame) -> DataFrame:
    """game_date, league, home, away, home_score, away_score, home_seed, away_seed, periods, regular_periods, venue -> the
    winner and loser, upset (the winner's seed number is the higher one), overtime, digit roots, and a composite id."""
    decided = F.col("home_score") != F.col("away_score")
    home_won = F.col("home_score") > F.col("away_score")
    side = lambda h, a: F.when(decided, F.when(home_won, F.col(h)).otherwise(F.col(a)))
    g = games.withColumns({"winner": side("home", "away"), "loser": side("away", "home")})
    seeds = F.when(decided, F.when(home_won, F.col("home_seed") > F.col("away_seed")).otherwise(F.col("away_seed") > F.col("home_seed")))
    total = F.col("home_score") + F.col("away_score")
    return g.withColumns(
        {
            "is_upset": F.coalesce(seeds, F.lit(False)).cast("int"), "is_overtime": F.coalesce(F.col("periods") > F.col("regular_periods"), F.lit(False)).cast("int"), "total_root": ciphers.digital_root(total),
            "margin_root": ciphers.digital_root(F.abs(F.col("home_score") - F.col("away_score"))), "winner_ordinal": _sum("ordinal", "winner"), "loser_ordinal": _sum("ordinal", "loser"), "venue_ordinal": _sum("ordinal", "venue"),
            "game_id": F.sha2(F.concat_ws("|", F.col("game_date").cast("string"), "league", "home", "away"), 256),
        }
    )


def _daily(df: DataFrame, day: str, names: tuple[str, ...], sums: dict[str, Column]) -> DataFrame:
    """Per day: mean cipher of every name, its root's mode (the smallest on ties), and sums."""
    roots = {f"_{n}": ciphers.digital_root(_sum("ordinal", n)) for n in names}
    aggs = [F.avg(_sum("ordinal", n)).alias(f"{n}_mean") for n in names] + [F.mode(F.col(f"_{n}"), True).alias(f"{n}_root_mode") for n in names]
    return df.withColumns(roots).groupBy(F.col(day).alias("day")).agg(*aggs, *(e.alias(k) for k, e in sums.items()))


def games_daily(games: DataFrame) -> DataFrame:
    g = enriched(games)
    return _daily(g, "game_date", ("winner", "loser", "venue"), {"games": F.count(F.lit(1)), "upsets": F.sum("is_upset"), "overtimes": F.sum("is_overtime"), "decided": F.count("winner")})


def races_daily(races: DataFrame) -> DataFrame:
    """race_date, winner, jockey, trainer, track, odds."""
    long_shot = F.coalesce(F.col("odds") >= 10, F.lit(False)).cast("int")
    return _daily(races, "race_date", ("winner", "jockey", "trainer", "track"), {"races": F.count(F.lit(1)), "long_shots": F.sum(long_shot), "mean_odds": F.avg("odds")})


def on_bars(bars: DataFrame, daily: DataFrame) -> DataFrame:
    """Bars with the figures of the day before their own, so nothing of a running day is seen."""
    day = F.date_from_unix_date(F.floor(F.col("us") / 86_400_000_000).cast("int"))
    return bars.join(daily.withColumnRenamed("day", "_day"), F.date_sub(day, 1) == F.col("_day"), "left").drop("_day")
