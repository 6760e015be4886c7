"""Mixed time spellings, units and zones to one UTC instant (problem 3).

Method: spellings are parsed to a wall clock plus, where written, an offset or a zone abbreviation. A wall clock
without offset is joined as of its local time to the offset intervals of its zone: one matching interval gives the
offset, two mean an ambiguous wall clock (its first occurrence is taken, flag `ambiguous`), none means a wall clock
that never existed (no instant, flag `nonexistent`).

Defined results: NULL, empty and placeholder texts and impossible dates have no instant (NULL), nor have instants outside
the plausible span where the caller gives one; without one nothing is dropped. Wall clocks are resolved within the years
the zone offsets are tabulated for. An unknown collector has no zone: only spellings carrying their own offset get an instant. A
collector listed twice would multiply rows, so the collector table is reduced to one row per name first.
Everything is built-in expressions; the only join is to the collector table, one row per row.
"""

from __future__ import annotations

from datetime import UTC, datetime, timedelta
from functools import lru_cache
from zoneinfo import ZoneInfo, available_timezones

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.session import hold, small_side

#: A plausible span of instants, or None for any.
Span = tuple[datetime, datetime] | None
#: Where no span is given, zone offsets are tabulated over these years.
ZONE_YEARS = (datetime(1970, 1, 1, tzinfo=UTC), datetime(2050, 1, 1, tzinfo=UTC))
SECOND = 1_000_000
#: Abbreviations the zone database spells as digits, and the zone-neutral ones; seconds east of UTC.
ABBREVIATIONS = {"UTC": 0, "GMT": 0, "Z": 0, "BRT": -10800}
#: English month names.
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def _us(t: datetime) -> int:
    return int((t - datetime(1970, 1, 1, tzinfo=UTC)) / timedelta(microseconds=1))


@lru_cache(maxsize=4096)
def _intervals(name: str, lo: datetime, hi: datetime) -> list[tuple[int, int, int, str]]:
    """(local_from, local_to, offset, abbreviation) of one zone, in microseconds."""
    out = []
    zone = ZoneInfo(name)
    at = lambda t: (t.astimezone(zone).utcoffset(), t.astimezone(zone).tzname())
    start = lo - timedelta(days=2)
    end, t = hi + timedelta(days=2), start
    while t < end:
        nxt = min(t + timedelta(days=7), end)
        if at(nxt) != at(t):
            a, b = t, nxt
            while b - a > timedelta(seconds=1):
                m = (a + (b - a) / 2).replace(microsecond=0)
                a, b = (m, b) if at(m) == at(t) else (a, m)
            off, abbr = at(t)
            s = int(off.total_seconds()) * SECOND
            out.append((_us(start) + s, _us(b) + s, s, abbr))
            start = t = b
        else:
            t = nxt
    off, abbr = at(end)
    s = int(off.total_seconds()) * SECOND
    out.append((_us(start) + s, _us(end) + s, s, abbr))
    return out


def zone_offsets(spark: SparkSession, zones: list[str], span: Span = None) -> DataFrame:
    """One row per zone: its exploded offset intervals as an array of (local_from, local_to, offset_us, abbr)."""
    known = sorted(set(zones) & available_timezones())
    return spark.createDataFrame(
        [(z, _intervals(z, *(span or ZONE_YEARS))) for z in known],
        "zone_name string, offsets array<struct<local_from:bigint,local_to:bigint,offset_us:bigint,abbr:string>>",
    )


def collector_clocks(spark: SparkSession, collectors: DataFrame, span: Span = None) -> DataFrame:
    """One row per collector: basis, date order and its zone's intervals; broadcast only within a measured bound.

    The distinct zones read first are at most those of the zone database (some 600)."""
    one = collectors.groupBy("collector").agg(
        F.min("zone_name").alias("zone_name"), F.min("epoch_basis").alias("epoch_basis"), F.min("date_order").alias("date_order")
    )
    names = sorted(available_timezones())
    used = [r[0] for r in collectors.where(F.col("zone_name").isin(names)).select("zone_name").distinct().collect()]
    clocks = one.join(F.broadcast(zone_offsets(spark, used, span)), "zone_name", "left")
    return small_side(clocks.select(F.col("collector").alias("_c"), "epoch_basis", "date_order", "offsets"))


def epoch_us(v: Column) -> Column:
    """Microseconds of an integer epoch in s, ms, us or ns, told apart by magnitude; NULL under 1e9 or over ~1e20."""
    return (
        F.when(v < 1_000_000_000, None)
        .when(v < 100_000_000_000, v * SECOND)
        .when(v < 100_000_000_000_000, v * 1000)
        .when(v < 100_000_000_000_000_000, v)
        .otherwise(_div1000(v))
    )


def _div1000(v: Column) -> Column:
    return F.call_function("div", v, F.lit(1000))


def plausible(us: Column, span: Span) -> Column:
    return us if span is None else F.when((us >= _us(span[0])) & (us < _us(span[1])), us)


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970 of a proleptic Gregorian date, NULL for a date that does not exist; no session zone involved."""
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    length = F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    y2 = F.when(m <= 2, y - 1).otherwise(y)
    mp = (m + 9) % 12
    era_days = y2 * 365 + F.floor(y2 / 4) - F.floor(y2 / 100) + F.floor(y2 / 400)
    return F.when(
        m.between(1, 12) & (d >= 1) & (d <= length) & (y >= 1), era_days + F.floor((mp * 153 + 2) / 5) + d - 1 - 719468
    ).cast("bigint")


class _Spelling:
    """One spelling: a pattern and which part each group is.

    Parts: y m d h i s f as in dates, b month name, p q two numbers whose order the collector fixes, a am/pm, o offset,
    z zone abbreviation."""

    FIELDS = "ymdhisfaoz"

    def __init__(self, pattern: str, parts: str):
        self.pattern = pattern
        at = {c: f"${k}" for k, c in enumerate(parts.split(), 1)}
        flag = "S" if "p" in at else "B" if "b" in at else "N"
        at |= {"m": at.get("b", at.get("p", at.get("m"))), "d": at.get("q", at.get("d"))}
        self.template = "|".join([*(at.get(c, "") for c in self.FIELDS), flag])


def _parts(text: Column) -> Column:
    """array of the parts named in FIELDS plus the flag, NULL for a text of no known spelling."""
    canon = F.lit(None).cast("string")
    for s in reversed(SPELLINGS):
        canon = F.when(text.rlike(s.pattern), F.regexp_replace(text, s.pattern, s.template)).otherwise(canon)
    return F.split(canon, r"\|")


def _with_wall(df: DataFrame, parts: str, dmy: Column) -> DataFrame:
    """Add _wall: wall-clock microseconds of the parts, NULL for a date or time that does not exist.

    Numbers, then date, then clock in successive projections, so no expression is written out more than once."""
    part = lambda c: F.col(parts)[_Spelling.FIELDS.index(c)]
    num = lambda c: part(c).try_cast("int")
    flag = F.col(parts)[len(_Spelling.FIELDS)]
    named = F.instr(F.lit(" ".join(MONTHS)), part("m"))
    month = F.when(flag == "B", F.when((F.length(part("m")) == 3) & (named % 4 == 1), ((named + 3) / 4).cast("int"))).otherwise(num("m"))
    swap = F.coalesce((flag == "S") & dmy, F.lit(False))
    year = num("y") + F.when(F.length(part("y")) == 2, 2000).otherwise(0)
    df = hold(
        df,
        {"_y": year, "_a": month, "_b": num("d"), "_swap": swap, "_h": num("h"), "_i": num("i"), "_s": F.coalesce(num("s"), F.lit(0)),
         "_half": F.lower(part("a")), "_f": F.rpad(part("f"), 6, "0").try_cast("bigint")},
    )
    hour = F.when(F.col("_half") == "", F.col("_h")).when(F.col("_h").between(1, 12), F.col("_h") % 12 + F.when(F.col("_half") == "pm", 12).otherwise(0))
    df = hold(df, {"_m": F.when(F.col("_swap"), F.col("_b")).otherwise(F.col("_a")), "_d": F.when(F.col("_swap"), F.col("_a")).otherwise(F.col("_b")), "_hour": hour})
    ok = F.col("_hour").between(0, 23) & F.col("_i").between(0, 59) & F.col("_s").between(0, 59)
    clock = _days(F.col("_y"), F.col("_m"), F.col("_d")) * 86400 + F.col("_hour") * 3600 + F.col("_i") * 60 + F.col("_s")
    df = hold(df, {"_wall": F.when(ok, clock * SECOND + F.col("_f")).cast("bigint")})
    return df.drop("_y", "_a", "_b", "_swap", "_h", "_i", "_s", "_half", "_f", "_m", "_d", "_hour")


_T = r"(\d{1,2}):(\d{2})(?::(\d{2}))?"
_O = r"(Z|[+-]\d{2}:?\d{2})"
SPELLINGS = [
    _Spelling(rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})[T ]{_T}(?:\.(\d{{1,6}})\d*)? ?{_O}?$", "y m d h i s f o"),
    _Spelling(rf"^(\d{{4}})(\d{{2}})(\d{{2}})T(\d{{2}})(\d{{2}})(\d{{2}}) ?{_O}?$", "y m d h i s o"),
    _Spelling(rf"^(\d{{4}})/(\d{{2}})/(\d{{2}}) {_T}(?: ([A-Z]{{1,5}}))?$", "y m d h i s z"),
    _Spelling(rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}) {_T}$", "p q y h i s"),
    _Spelling(rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{2}}) {_T} ?([AaPp][Mm])$", "p q y h i s a"),
    _Spelling(rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}) {_T}$", "d m y h i s"),
    _Spelling(rf"^(\d{{1,2}}) ([A-Z][a-z]{{2}}) (\d{{4}}) {_T}$", "d b y h i s"),
    _Spelling(rf"^[A-Z][a-z]{{2}}, (\d{{1,2}}) ([A-Z][a-z]{{2}}) (\d{{4}}) {_T} (?:([A-Z]{{1,5}})|{_O})$", "d b y h i s z o"),
    _Spelling(rf"^[A-Z][a-z]{{2}} ([A-Z][a-z]{{2}}) (\d{{1,2}}) {_T} {_O} (\d{{4}})$", "b d h i s o y"),
    _Spelling(rf"^([A-Z][a-z]{{2}}) (\d{{1,2}}), (\d{{4}}) {_T} ([AaPp][Mm])(?: ([A-Z]{{1,5}}))?$", "b d y h i s a z"),
]


def _offset_us(off: Column) -> Column:
    """Microseconds of '+HH:MM', '+HHMM' or 'Z'; NULL for an empty text."""
    digits = F.regexp_replace(off, "[^0-9]", "")
    size = (F.substring(digits, 1, 2).try_cast("int") * 3600 + F.substring(digits, 3, 2).try_cast("int") * 60).cast("bigint") * SECOND
    return F.when(off == "Z", F.lit(0).cast("bigint")).when(off.startswith("-"), -size).when(off.startswith("+"), size)


def _from_wall(wall: Column, offsets: Column) -> tuple[Column, Column]:
    """(instant of the first occurrence, number of matching intervals) by the as-of join to the zone's intervals."""
    hits = F.filter(offsets, lambda o: (o["local_from"] <= wall) & (wall < o["local_to"]))
    return F.array_min(F.transform(hits, lambda o: wall - o["offset_us"])), F.size(hits)


def _from_abbreviation(wall: Column, abbr: Column, offsets: Column) -> Column:
    named = F.filter(offsets, lambda o: o["abbr"] == abbr)
    holding = F.filter(named, lambda o: (o["local_from"] <= wall) & (wall < o["local_to"]))
    off = F.coalesce(F.try_element_at(holding, F.lit(1))["offset_us"], F.try_element_at(named, F.lit(1))["offset_us"])
    for name, s in ABBREVIATIONS.items():
        off = F.coalesce(off, F.when(abbr == name, F.lit(s * SECOND).cast("bigint")))
    return wall - off


def with_integer_instants(df: DataFrame, col: str, clocks: DataFrame, span: Span = None) -> DataFrame:
    """Add utc_us, ambiguous, nonexistent for an integer epoch column of unknown unit and basis."""
    j = df.join(clocks, F.col("collector") == F.col("_c"), "left")
    j = hold(j, {"_wall": plausible(epoch_us(F.col(col)), span)})
    local = F.coalesce(F.col("epoch_basis") == "local", F.lit(False))
    first, n = _from_wall(F.col("_wall"), F.col("offsets"))
    return hold(
        j,
        {
            "utc_us": F.when(local, first).otherwise(F.col("_wall")),
            "ambiguous": F.coalesce(local & (n > 1), F.lit(False)),
            "nonexistent": F.coalesce(local & F.col("_wall").isNotNull() & (n == 0), F.lit(False)),
        },
    ).drop("_c", "_wall", "epoch_basis", "date_order", "offsets")


def with_text_instants(df: DataFrame, col: str, clocks: DataFrame, span: Span = None) -> DataFrame:
    """Add utc_us, ambiguous, nonexistent for a text column of mixed spellings."""
    text = F.trim(F.col(col))
    number = r"^(\d{10})(?:\.(\d{1,6})\d*)?$"
    epoch = F.when(
        text.rlike(number),
        F.regexp_extract(text, number, 1).try_cast("bigint") * SECOND
        + F.coalesce(F.rpad(F.regexp_extract(text, number, 2), 6, "0").try_cast("bigint"), F.lit(0)),
    ).when(text.rlike(r"^\d{13}$|^\d{16}$|^\d{19}$"), epoch_us(text.try_cast("bigint")))
    j = df.join(clocks, F.col("collector") == F.col("_c"), "left")
    j = hold(j, {"_epoch": epoch, "_p": _parts(text)})
    part = lambda c: F.coalesce(F.col("_p")[_Spelling.FIELDS.index(c)], F.lit(""))
    j = hold(_with_wall(j, "_p", F.col("date_order") == "dmy"), {"_off": part("o"), "_abbr": part("z")})
    wall, off, abbr = F.col("_wall"), F.col("_off"), F.col("_abbr")
    first, n = _from_wall(wall, F.col("offsets"))
    plain = wall.isNotNull() & (off == "") & (abbr == "")
    us = (
        F.when(F.col("_epoch").isNotNull(), F.col("_epoch"))
        .when(off != "", wall - _offset_us(off))
        .when(abbr != "", _from_abbreviation(wall, abbr, F.col("offsets")))
        .otherwise(first)
    )
    return hold(
        j,
        {
            "utc_us": plausible(us, span),
            "ambiguous": F.coalesce(plain & (n > 1), F.lit(False)),
            "nonexistent": F.coalesce(plain & (n == 0) & plausible(wall, span or ZONE_YEARS).isNotNull(), F.lit(False)),
        },
    ).drop("_c", "_epoch", "_p", "_wall", "_off", "_abbr", "epoch_basis", "date_order", "offsets")


#: table -> (id column, time column, text?, standard form of the stored time as a test against utc_us)
TIMED = {
    "ohlcv": ("row_id", "open_time", False),
    "space_weather": ("row_id", "timestamp", False),
    "onchain_data": ("id", "timestamp", True),
    "tweets": ("row_id", "created_at", True),
}
STANDARD_TEXT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\+00:00$"


def in_standard_form(tab: str, stored: Column, us: Column) -> Column:
    """True where the stored time already is the table's standard form of the instant."""
    if TIMED[tab][2]:
        return stored.rlike(STANDARD_TEXT)
    unit = F.lit(1000 if tab == "ohlcv" else SECOND)
    return (us % unit == 0) & (stored == F.call_function("div", us, unit))


def normalise(df: DataFrame, tab: str, clocks: DataFrame, span: Span = None) -> DataFrame:
    """The rows of one of the timed tables with utc_us (bigint, NULL if the stored time denotes no instant).

    clocks: collector_clocks of the collector table, made once and used for every table of a query."""
    _, col, text = TIMED[tab]
    return (with_text_instants if text else with_integer_instants)(df, col, clocks, span)
