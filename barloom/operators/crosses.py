"""Sparse feature crosses: binarised contexts, signal groups, thirteen families of pairs with support, never wide columns.

A row's contexts are arrays of small integers, one array a signal group, made by plain expressions from the row's own
columns: the thresholds are one row a feature (bounded by the schema) and become literals. Pairs are exploded within a
row and counted with partial aggregation, so what is shuffled is distinct pairs, not pairs of rows. Pairs are counted
by their ids; names are cut for display only, after counting."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.quantiles import percentiles

#: Name fragments of the signal groups, first match wins, anything else is ta.
GROUPS = (
    ("astro", "moon_phase moon_illumination moon_distance new_moon full_moon retro eclipse nakshatra void_of_course planetary_hour planetary_day bazi tzolkin equinox solstice tithi karana"),
    ("esoteric", "gem_ dr_ gematria digital_root tweet caution pump misdirection sentiment onchain oi_ funding liq_ whale mempool hash_rate block_height coinbase_premium cvd hebrew shmita "
                 "fibonacci_time gann_time tesla master_ angel contains_ palindrome friday_13 caps_ excl_ word_count fear_greed f_g_"),
    ("volatility", "atr bb_width realized_vol vol_ keltner donchian true_range natr bb_"),
    ("ta", "rsi macd stoch volume_ ema sma obv ichimoku supertrend vwap adx cci mfi entropy hurst"),
    ("space", "kp_ solar sunspot"),
    ("macro", "vix dxy yield spx dominance tvl cot_"),
    ("regime", "regime bull bear sideways"),
    ("session", "session_ kill_zone hod_"),
    ("aspect", "asp_"),
    ("price_num", "price_dr price_angel price_near price_master"),
    ("moon", "moon_in_ moon_fire moon_earth moon_air moon_water moon_sign moon_cardinal moon_fixed moon_mutable"),
)
#: Prefix, left side and right side of the families, in order; * is every context.
FAMILIES = (
    ("dx", "doy", ("*",)), ("ax", "astro", ("ta",)), ("ax2", "astro_pairs", ("ta",)), ("ta2", "ta_pairs", ("doy", "astro")), ("ex2", "esoteric", ("ta",)), ("sw", "space", ("*",)),
    ("hod", "session", ("*",)), ("mx", "macro", ("*",)), ("vx", "volatility", ("*",)), ("asp", "aspect", ("*",)), ("pn", "price_num", ("*",)), ("mn", "moon", ("*",)), ("rdx", "regime_doy", ("*",)),
)
TAGS = ("_XH", "_H", "_L", "_XL")
QUANTILES = (0.95, 0.75, 0.25, 0.05)


def group_of(name: str) -> str:
    low = name.lower()
    return next((g for g, keys in GROUPS if any(k in low for k in keys.split())), "ta")


@dataclass(frozen=True)
class Context:
    """One binary signal: id in order of features and tags, its name, the group, and the condition on its feature."""

    id: int
    name: str
    group: str
    condition: str


def binarise(wide: DataFrame, features: Sequence[str], least: int = 5, live: int = 100) -> list[Context]:
    """The contexts of the features: a feature with two or three values gives the flag `> 0` if it holds on more than `least`
    rows and under 98 per cent; others give XH, H, L and XL beyond the exact percentiles of their non-zero values (more
    than `live` of them), each if it holds on more than `least` rows. What is read here has one row a feature."""
    pairs = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features))
    tall = wide.select(F.inline(F.filter(pairs, lambda p: p["value"].isNotNull())))
    cuts = {r["feature"]: (r["n"], r["q"]) for r in percentiles(tall.where("value <> 0"), "feature", "value", QUANTILES).collect()}
    few = {r["feature"]: r["n"] for r in tall.groupBy("feature").agg(F.approx_count_distinct("value", 0.01).alias("n")).collect()}
    wanted: list[tuple[str, str, str]] = []
    for c in features:
        if 1 < few.get(c, 0) <= 3:
            wanted.append((c, c, f"`{c}` > 0"))
        elif few.get(c, 0) > 3 and cuts.get(c, (0,))[0] > live:
            q = cuts[c][1]
            wanted += [(c, c + t, f"`{c}` {'>' if i < 2 else '<'} {q[i]!r}D") for i, t in enumerate(TAGS)]
    counts = wide.agg(F.count(F.lit(1)).alias("_n"), *(F.count(F.when(F.expr(e), 1)).alias(n) for _, n, e in wanted)).first() if wanted else None
    kept = [(c, n, e) for c, n, e in wanted if counts[n] > least and (n != c or counts[n] < 0.98 * counts["_n"])]
    return [Context(i, n, group_of(n), e) for i, (_, n, e) in enumerate(kept)]


def _held(contexts: Sequence[Context]) -> Column:
    """The ids of the contexts that hold on a row."""
    if not contexts:
        return F.array().cast("array<int>")
    return F.array_compact(F.array(*(F.expr(f"CASE WHEN {c.condition} THEN {c.id} END") for c in contexts)))


def day_windows(doy: Column, reach: int = 2) -> Column:
    """The days of the year (1 to 365, wrapping) whose window of `reach` days either side holds the day."""
    return F.transform(F.sequence(F.lit(-reach), F.lit(reach)), lambda k: F.pmod(doy - 1 + k, F.lit(365)) + 1).cast("array<int>")


#: Ids of day-of-year contexts start here, of regime-split ones there (three regimes), of pairs of contexts after that.
DOY, REGIME_DOY, PAIR = 1_000_000, 2_000_000, 3_000_000


def sides(wide: DataFrame, contexts: Sequence[Context], row: Sequence[str], doy: Column, regime: Column) -> DataFrame:
    """Rows with one array of context ids a group, days of the year and regime-split days; regime 0, 1, 2."""
    groups = [g for g, _ in GROUPS]
    arrays = {g: _held([c for c in contexts if c.group == g]) for g in groups} | {"all": _held(contexts)}
    days = day_windows(doy)
    return wide.select(
        *row, *(e.alias(n) for n, e in arrays.items()), F.transform(days, lambda x: x + DOY).alias("doy"), F.transform(days, lambda x: x + REGIME_DOY + 1000 * regime).alias("regime_doy")
    )


def pair_combos(rows: DataFrame, group: str, contexts: Sequence[Context], most: int, first: int | None = None) -> list[tuple[int, int]]:
    """The first `most` pairs (in order of ids) of a group's (first `first`) contexts that hold together on two rows or more."""
    ids = [c.id for c in contexts if c.group == group][:first]
    if len(ids) < 2:
        return []
    held = F.filter(F.col(group), lambda x: x <= ids[-1])
    both = F.flatten(F.transform(held, lambda a: F.transform(F.filter(held, lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    n = rows.select(F.inline(both)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").orderBy("a", "b").limit(most)
    return [(r["a"], r["b"]) for r in n.collect()]


def with_pairs(rows: DataFrame, name: str, group: str, pairs: Sequence[tuple[int, int]], start: int) -> DataFrame:
    """Add the array `name` of the ids (from `start`) of the pairs that hold on a row."""
    if not pairs:
        return rows.withColumn(name, F.array().cast("array<int>"))
    has = lambda k: F.array_contains(group, F.lit(k))
    return rows.withColumn(name, F.array_compact(F.array(*(F.when(has(a) & has(b), F.lit(start + i)) for i, (a, b) in enumerate(pairs)))))


def all_pairs() -> Column:
    """The (family, l, r) of every family that hold on a row."""

    def product(k: int, left: str, right: tuple[str, ...]) -> Column:
        other = F.col("all") if right == ("*",) else F.concat(*(F.col(c) for c in right))
        return F.flatten(F.transform(F.col(left), lambda a: F.transform(other, lambda b: F.struct(F.lit(k).alias("family"), a.alias("l"), b.alias("r")))))

    return F.concat(*(product(k, left, right) for k, (_, left, right) in enumerate(FAMILIES)))


def supports(rows: DataFrame, least: int = 3) -> DataFrame:
    """(family, l, r, n): pairs of ids of every family holding together on at least `least` rows, in one pass over the rows."""
    pairs = rows.select(F.inline(all_pairs()))
    return pairs.groupBy("family", "l", "r").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def named(pairs: DataFrame, contexts: Sequence[Context], combos: dict[int, str]) -> DataFrame:
    """(family, left, right, cross, n, ...): ids to names; `cross` is cut to 40 characters a side for display."""
    names = {c.id: c.name for c in contexts} | combos
    table = F.create_map(*(F.lit(x) for kv in names.items() for x in kv)) if names else F.create_map().cast("map<int,string>")

    def name(c: str) -> Column:
        split = F.array(*(F.lit(f"doy{s}_") for s in ("_S", "_B", "_R")))
        return F.when(F.col(c) >= PAIR, F.try_element_at(table, F.col(c))).when(F.col(c) >= REGIME_DOY, F.concat(split[F.floor((F.col(c) - REGIME_DOY) / 1000).cast("int")], F.pmod(F.col(c), F.lit(1000)).cast("string"))).when(
            F.col(c) >= DOY, F.concat(F.lit("doy_"), (F.col(c) - DOY).cast("string"))
        ).otherwise(F.try_element_at(table, F.col(c)))

    prefix = F.array(*(F.lit(f[0]) for f in FAMILIES))[F.col("family")]
    out = pairs.withColumns({"left": name("l"), "right": name("r"), "_f": prefix})
    cross = F.concat_ws("_", "_f", F.substring("left", 1, 40), F.substring("right", 1, 40))
    rest = [c for c in pairs.columns if c not in ("family", "l", "r")]
    return out.select(F.col("_f").alias("family"), "left", "right", cross.alias("cross"), *rest)
