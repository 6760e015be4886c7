"""Rolling totals over trailing periods (problem 1): versioned daily rolling state.

The stored state has one row per entity and day: totals of every period. `advance` joins yesterday's row of every entity
with the days' arrivals and the amounts of the days that expire, and returns the rows of the new days; one call may carry
the state over one day (the daily job) or over a stretch of days (a backfill, where each stretch is stored before the
next starts from it). `apply_corrections` joins the stored state with the changes of restated or late days and
recomputes only the affected dates, under the next version. Amounts are decimals, so adding and expiring leave no
residue. Rows are pre-aggregated to (entity, day) before any ordered step: an entity has at most one row a day, whatever
share of the data it holds, and a stretch orders only its own days and the longest period before them.

Defined results: NULL/NaN amounts count as nothing; a day without rows is a day of zero; |amounts| of 1e24 and more
do not fit the decimal and count as nothing, and `unfit_{w}` tells how many of them the period has. Averages divide by
the days of the period that lie at or after the entity's first day. NULL entities form an entity of their own. An empty
table gives no rows. An entity's rows end at its last day with rows; `idle=True` carries them on.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.session import stored

MONEY = "decimal(38,6)"
DAY_US = 86_400_000_000


def _amount(c: Column) -> Column:
    return F.coalesce(F.when(F.abs(c) < 1e24, c).try_cast("decimal(30,6)"), F.lit(0).cast("decimal(30,6)"))


def ledgers(rows: DataFrame, entity: Sequence[str], natural: Sequence[str], version: str, values: Sequence[str], active: str) -> DataFrame:
    """Per (entity, day): amounts of first deliveries (a_*), changes by later deliveries (c_*), and active bars likewise.

    rows need utc_us; `natural` completes the key of one bar. The shuffle is by (entity, day), both aggregates use it."""
    entity = list(entity)
    day = F.floor(F.col("utc_us") / DAY_US).cast("int")
    base = rows.withColumns({"_day": day, "_on": F.coalesce(F.col(active) > 0, F.lit(False)).cast("int")}).select(
        *entity, "_day", *natural, "utc_us", F.col(version).alias("_ver"), "_on", *values
    )
    base = base.repartition(*[F.col(c) for c in (*entity, "_day")])
    v = F.struct("_ver", "_on", *values)
    bars = base.groupBy(*entity, "_day", *natural, "utc_us").agg(F.min(v).alias("f"), F.max(v).alias("l"), F.max("_on").alias("_any"))
    aggs, big = [], lambda r: sum((F.coalesce(F.abs(F.col(f"{r}.{c}")) >= 1e24, F.lit(False)).cast("bigint") for c in values), F.lit(0).cast("bigint"))
    for c in values:
        first, last = _amount(F.col(f"f.{c}")), _amount(F.col(f"l.{c}"))
        aggs += [F.sum(first).cast(MONEY).alias(f"a_{c}"), F.sum(last - first).cast(MONEY).alias(f"c_{c}")]
    return bars.groupBy(*entity, F.col("_day").alias("day")).agg(
        *aggs, F.sum("f._on").alias("a_active"), F.sum(F.col("_any") - F.col("f._on")).alias("c_active"), F.sum(big("f")).alias("a_unfit"), F.sum(big("l") - big("f")).alias("c_unfit")
    )


COUNTS = ("active", "unfit")


def _kind(name: str) -> str:
    return "bigint" if name in COUNTS else MONEY


def _same(entity: Sequence[str], prefix: str) -> list[Column]:
    return [F.col(c).eqNullSafe(F.col(f"{prefix}{c}")) for c in entity]


def newest(state: DataFrame, entity: Sequence[str]) -> DataFrame:
    """Yesterday's row of every entity: its latest stored one."""
    rest = [c for c in state.columns if c not in (*entity, "day")]
    return state.groupBy(*entity).agg(F.max(F.struct("day", *rest)).alias("_s")).select(*entity, "_s.*")


def advance(
    yesterday: DataFrame | None, ledger: DataFrame, entity: Sequence[str], values: Sequence[str], periods: Sequence[int], until: int, version: int = 1, idle: bool = False
) -> DataFrame:
    """The state rows of the days after each entity's stored one, up to day `until`.

    yesterday: newest() of the stored state, None to begin. ledger: (entity, day, a_*) from the longest period before the
    oldest of these rows on; a job that stores idle entities too (idle=True) needs the longest period before today only.
    Today = yesterday + arrivals - what expires, for every total."""
    entity, names, longest = list(entity), [*values, *COUNTS], max(periods)
    totals = [f"{n}_{w}" for n in names for w in periods]
    led = ledger.select(*entity, "day", *(f"a_{n}" for n in names))
    ends = ledger.groupBy(*entity).agg(F.min("day").alias("_lo"), F.max("day").alias("_hi"))
    if yesterday is None:
        known = ends.select(*entity, F.lit(None).cast("int").alias("_yday"), F.col("_lo").alias("first_day"), "_lo", "_hi", *(F.lit(0).cast(_kind(c.rsplit("_", 1)[0])).alias(f"_y_{c}") for c in totals))
    else:
        y = yesterday.select(*(F.col(c).alias(f"_e_{c}") for c in entity), F.col("day").alias("_yday"), F.col("first_day").alias("_yfirst"), *(F.col(c).alias(f"_y_{c}") for c in totals))
        both = ends.join(y, _same(entity, "_e_"), "full")
        here = F.col("_yday").isNotNull()
        known = both.select(
            *(F.when(here, F.col(f"_e_{c}")).otherwise(F.col(c)).alias(c) for c in entity), "_yday", F.coalesce("_yfirst", "_lo").alias("first_day"), "_lo", F.coalesce("_hi", "_yday").alias("_hi"),
            *(F.coalesce(f"_y_{c}", F.lit(0)).cast(_kind(c.rsplit("_", 1)[0])).alias(f"_y_{c}") for c in totals),
        )
    stop = F.lit(until) if idle else F.least(F.col("_hi"), F.lit(until))
    known = known.withColumn("_stop", stop.cast("int")).where("_stop >= coalesce(_yday + 1, _lo)").withColumnsRenamed({c: f"_k_{c}" for c in entity})
    rows = led.join(known, _same(entity, "_k_")).where(f"day <= _stop and (_yday is null or day > _yday - {longest})")
    start = known.where("_yday is not null").select(  # the first new day of a known entity, whether or not anything arrives
        *(F.col(f"_k_{c}").alias(c) for c in entity), (F.col("_yday") + 1).alias("day"), *(F.lit(0).cast(led.schema[f"a_{n}"].dataType).alias(f"a_{n}") for n in names),
        *(F.col(c) for c in known.columns),
    )
    side = [c for c in known.columns if not c.startswith("_k_")]
    moves = rows.select(start.columns).unionByName(start).groupBy(*entity, "day").agg(*(F.sum(f"a_{n}").alias(f"a_{n}") for n in names), *(F.first(c).alias(c) for c in side))
    by = Window.partitionBy(*entity).orderBy("day")
    to = moves.withColumn("_to", F.coalesce(F.lead("day").over(by) - 1, F.col("_stop")))
    dense = to.withColumn("_d", F.explode(F.sequence("day", F.greatest("day", "_to"))))
    new = F.col("_d") == F.col("day")
    dense = dense.select(*entity, F.col("_d").alias("day"), *side, *(F.when(new, F.col(f"a_{n}")).otherwise(F.lit(0)).alias(f"a_{n}") for n in names))
    today = F.col("_yday").isNull() | (F.col("day") > F.col("_yday"))
    net = {f"_net_{n}_{w}": F.when(today, F.col(f"a_{n}") - F.coalesce(F.lag(f"a_{n}", w, 0).over(by), F.lit(0))).otherwise(F.lit(0)) for n in names for w in periods}
    running = by.rowsBetween(Window.unboundedPreceding, 0)
    out = dense.withColumns(net).select(
        *entity, "first_day", "day", F.lit(version).alias("version"), today.alias("_today"),
        *((F.col(f"_y_{c}") + F.sum(f"_net_{c}").over(running)).cast(_kind(c.rsplit("_", 1)[0])).alias(c) for c in totals),
    )
    return out.where("_today").drop("_today")


def apply_corrections(state: DataFrame, changes: DataFrame, entity: Sequence[str], values: Sequence[str], periods: Sequence[int], version: int) -> DataFrame:
    """The next version: `changes` (entity, day, c_*) spread over the dates whose period holds that day, joined to the state.

    A change touches at most max(periods) dates. A change before an entity's first stored day moves that day back and adds
    the days between; one after its newest stored day, or of an unknown entity, enters by advance() instead."""
    entity, names, longest = list(entity), [*values, *COUNTS], max(periods)
    totals = [f"{n}_{w}" for n in names for w in periods]
    real = changes.where(" or ".join(f"c_{n} <> 0" for n in names))
    spread = real.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(longest - 1)))).withColumn("_date", F.col("day") + F.col("_k"))
    hit = spread.groupBy(*(F.col(c).alias(f"_e_{c}") for c in entity), "_date").agg(
        *(F.sum(F.when(F.col("_k") < w, F.col(f"c_{n}"))).alias(f"_x_{n}_{w}") for n in names for w in periods)
    )
    reach = real.groupBy(*(F.col(c).alias(f"_r_{c}") for c in entity)).agg(F.min("day").alias("_reach"))
    back = state.join(reach, _same(entity, "_r_"), "left").withColumn("_first", F.least("first_day", "_reach"))
    early = F.sequence(F.col("_first"), F.col("first_day") - 1)
    older = back.where("day = first_day and _first < first_day").select(
        *entity, F.explode(early).alias("day"), F.col("_first").alias("first_day"), F.lit(version).alias("version"), *(F.lit(0).cast(_kind(c.rsplit("_", 1)[0])).alias(c) for c in totals)
    )
    rows = back.select(*entity, "day", F.col("_first").alias("first_day"), "version", *totals).unionByName(older)
    j = rows.join(hit, [*_same(entity, "_e_"), F.col("day") == F.col("_date")], "left")
    new = {c: (F.col(c) + F.coalesce(F.col(f"_x_{c}"), F.lit(0))).cast(_kind(c.rsplit("_", 1)[0])) for c in totals}
    return j.select(
        *entity, "first_day", "day", F.when(F.col("_date").isNotNull(), version).otherwise(F.col("version")).alias("version"), *(e.alias(c) for c, e in new.items())
    )


def rolling_totals(
    rows: DataFrame, entity: Sequence[str], natural: Sequence[str], version: str, values: Sequence[str], active: str, periods: Sequence[int] = (7, 30), stretch: int = 366
) -> DataFrame:
    """Totals of the latest deliveries: version 1 from first deliveries, version 2 where later ones changed a day.

    The state is carried over stretches of `stretch` days, each stored in the shared folder before the next starts from it."""
    ledger = stored(ledgers(rows, entity, natural, version, values, active))
    lo, hi = ledger.agg(F.min("day"), F.max("day")).first()
    if lo is None:
        lo = hi = 0
    last, parts = None, []
    for until in range(lo + stretch - 1, hi + stretch, stretch):
        part = advance(last, ledger, entity, values, periods, until)
        if until < hi:  # stored: the next stretch starts from it
            part = stored(part)
            last = newest(part if last is None else last.unionByName(part), entity)
        parts.append(part)
    state = reduce(DataFrame.unionByName, parts)
    changes = ledger.select(*entity, "day", *(f"c_{n}" for n in [*values, *COUNTS]))
    return apply_corrections(state, changes, entity, values, periods, version=2)


def with_averages(state: DataFrame, values: Sequence[str], periods: Sequence[int]) -> DataFrame:
    """Totals as doubles plus {value}_avg_{w} per day of the period since the entity's first day."""
    out = {}
    for n in values:
        for w in periods:
            days = F.least(F.lit(w), F.col("day") - F.col("first_day") + 1)
            out[f"{n}_avg_{w}"] = F.col(f"{n}_{w}").cast("double") / days
            out[f"{n}_{w}"] = F.col(f"{n}_{w}").cast("double")
    return state.withColumns(out)
