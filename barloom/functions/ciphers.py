"""Letter ciphers and lexicon sentiment of texts as built-in expressions (no Python per row).

Defined results: NULL text counts as empty; letters are matched after lower-casing, characters outside a-z count nothing."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.session import hold

LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: The Hebrew-style letter values a..z of the fifth cipher.
JEWISH = dict(zip(LETTERS, (1, 2, 3, 4, 5, 6, 7, 8, 9, 600, 10, 20, 30, 40, 50, 60, 70, 80, 90, 100, 200, 700, 900, 300, 400, 500), strict=True))
CIPHERS: dict[str, Mapping[str, int]] = {
    "ordinal": {c: i + 1 for i, c in enumerate(LETTERS)},
    "reverse": {c: 26 - i for i, c in enumerate(LETTERS)},
    "reduction": {c: i % 9 + 1 for i, c in enumerate(LETTERS)},
    "english": {c: 6 * (i + 1) for i, c in enumerate(LETTERS)},
    "jewish": JEWISH,
    "satanic": {c: i + 36 for i, c in enumerate(LETTERS)},
}


def cipher(text: Column, table: Mapping[str, int]) -> Column:
    """Sum of letter values: occurrences of every letter (by length difference, inside codegen) times its value."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda x, y: x + y, ((F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))) * v for c, v in table.items()))


def with_ciphers(df: DataFrame, text: str, tables: Mapping[str, Mapping[str, int]]) -> DataFrame:
    """Add one sum per table: letters are counted once and weighted for every cipher."""
    df = hold(df, {"_t": F.lower(F.coalesce(F.col(text), F.lit("")))})
    df = hold(df, {f"_n_{c}": F.length("_t") - F.length(F.replace(F.col("_t"), F.lit(c), F.lit(""))) for c in LETTERS})
    sums = {n: reduce(lambda x, y: x + y, (F.col(f"_n_{c}") * v for c, v in table.items())).cast("bigint") for n, table in tables.items()}
    return hold(df, sums).drop("_t", *(f"_n_{c}" for c in LETTERS))


def digital_root(n: Column) -> Column:
    return F.when(n == 0, 0).otherwise(1 + (F.abs(n) - 1) % 9).cast("int")


def cipher_sql(text: str, name: str) -> str:
    """The same sum in common SQL: occurrences of every letter times its value."""
    t = f"lower(coalesce({text}, ''))"
    return " + ".join(f"{v} * (length({t}) - length(replace({t}, '{c}', '')))" for c, v in CIPHERS[name].items())


#: The lexicon. Bullish words count whole, a bearish word counts as a beginning, urgent phrases anywhere.
BULL = tuple(
    """bull bullish moon pump rally surge soar gain rise rising breakout ath record high buy long boom explode skyrocket green recover recovery up
    upgrade adoption approve approved approval etf institutional accumulate hodl hold support uptrend optimistic positive strong strength outperform
    profit inflow demand milestone parabolic launch partnership integration mainstream halving scarcity golden breakthrough""".split()
)
BEAR = tuple(
    """bear bearish crash dump plunge collapse fear sell selloff short drop decline fall falling tank red panic capitulate liquidat ban hack scam fraud
    regulate crackdown warning risk bubble overvalued reject rejection resistance downtrend weak loss correction negative trouble bankrupt insolvency
    default recession inflation outflow sec lawsuit investigation exploit vulnerability death dead worthless ponzi""".split()
)
URGENT = ("breaking", "urgent", "alert", "emergency", "flash", "just in", "developing", "live", "now", "imminent", "critical", "warning")
#: Cipher values of the three sets (any cipher but the reduction).
TARGETS = {
    "caution": (93, 39, 43, 48, 223, 322, 17, 113, 11, 19, 13, 22, 33, 44, 66, 77, 88, 99, 666, 911, 47),
    "pump": (27, 72, 127, 721, 37, 73),
    "energy": (213, 231, 312, 321, 132, 123, 68),
}


def sentiment(text: Column, bull: Sequence[str] = BULL, bear: Sequence[str] = BEAR, urgent: Sequence[str] = URGENT) -> dict[str, Column]:
    """Whole-word bullish hits, words with a bearish beginning, their difference, shouted words (split at blanks, two
    characters or more, no small letter), marks, urgent phrases and words, by the caller's lexicon."""
    t = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(F.lower(t), F.lit(r"(\w+)"), 1)
    bulls = F.size(F.filter(words, lambda w: w.isin(*bull)))
    starts: Callable[[Column], Column] = lambda w: w.rlike(f"^({'|'.join(bear)})")
    bears = F.size(F.filter(words, starts))
    shouted = F.size(F.filter(F.split(t, r"\s+"), lambda w: (F.length(w) > 1) & w.rlike(r"\p{Lu}") & ~w.rlike(r"\p{Ll}")))
    count = lambda c: F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))
    return {
        "bull": bulls, "bear": bears, "score": bulls - bears, "caps_words": shouted, "exclamations": count("!"), "questions": count("?"),
        "urgency": reduce(lambda a, b: a + b, (F.contains(F.lower(t), F.lit(u)).cast("int") for u in urgent)), "words": F.size(words),
    }
