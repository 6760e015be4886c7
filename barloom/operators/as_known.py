"""Attributes as known at event time (problem 5): periodic as-known snapshots plus change logs.

An attribute row counts from the instant it is both known and in force (the later of known_at and 00:00 UTC of its
date). The valid row of an entity at an instant is, among its rows that count, the one with the latest date, then the
latest known_at, then the highest id - a running maximum, so only rows that exceed everything before them are changes.
Per entity and period (a week) there is one snapshot, the valid row at its start, and a log of the changes inside it.
An event is joined to its entity's and period's snapshot by equality and replays only the changes up to its instant.
Without entity columns all events share one history.

The snapshots are broadcast only within a measured bound; beyond it the join shuffles by (entity, period, salt), the
snapshots repeated once a salt, so a hot entity's week spreads over tasks.

Defined results: NULL known_at, NULL or unreadable dates never qualify; events without instant are dropped by the
caller; an event before the first qualifying row, or of an unknown entity, gets NULL. NULL entities form an entity of
their own. Equal rows tie on the highest id. No attribute column of the event can clash: the attribute side contributes
one column, named by the caller. The log of a period holds only record-setting rows of that period, which are bounded by
its distinct (date, known_at) pairs in rising order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.session import is_small

WEEK_US = 7 * 86_400_000_000
#: Salts a shuffled snapshot is repeated over.
SALTS = 16


def change_log(attributes: DataFrame, row_id: str, period_us: int = WEEK_US, entity: Sequence[str] = ()) -> DataFrame:
    """Record-setting rows: entity, period, at (us), key struct(date, known, id). First maxima inside a period, then across."""
    day = F.unix_date(F.substring(F.trim("date"), 1, 10).try_cast("date"))
    known = F.unix_micros("known_at")
    rows = attributes.select(*entity, day.cast("bigint").alias("_d"), known.alias("_k"), F.col(row_id).alias("_i")).where("_d is not null and _k is not null")
    at = F.greatest(F.col("_k"), F.col("_d") * 86_400_000_000)
    log = rows.select(
        *entity, F.floor(at / period_us).cast("bigint").alias("period"), at.alias("at"),
        F.struct(F.col("_d").alias("date"), F.col("_k").alias("known"), F.col("_i").alias("id")).alias("key"),
    ).groupBy(*entity, "period", "at").agg(F.max("key").alias("key"))
    before = Window.partitionBy(*entity, "period").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return log.withColumn("_m", F.max("key").over(before)).where("_m is null or key > _m").drop("_m")


def snapshots(log: DataFrame, periods: DataFrame, entity: Sequence[str] = ()) -> DataFrame:
    """Per entity and period of `periods` or of the log: the snapshot at its start and the changes within it, in order."""
    entity = list(entity)
    per = log.groupBy(*entity, "period").agg(F.max("key").alias("last"), F.sort_array(F.collect_list(F.struct("at", "key"))).alias("changes"))
    wanted = periods.select(*(F.col(c).alias(f"_e_{c}") for c in entity), F.col("period").alias("_period")).distinct()
    same = [F.col(c).eqNullSafe(F.col(f"_e_{c}")) for c in entity] + [F.col("period") == F.col("_period")]
    both = per.join(wanted, same, "full")
    here = F.col("_period").isNotNull()
    both = both.select(*(F.when(here, F.col(f"_e_{c}")).otherwise(F.col(c)).alias(c) for c in entity), F.coalesce("period", "_period").alias("period"), "last", "changes")
    # one row per entity and period: the calendar bounds this window, not the data
    before = Window.partitionBy(*(entity or [F.lit(0)])).orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
    return both.select(*entity, "period", F.max("last").over(before).alias("snapshot"), "changes")


def as_known(
    events: DataFrame, attributes: DataFrame, row_id: str, out: str, period_us: int = WEEK_US, entity: Sequence[str] = (), small: bool | None = None
) -> DataFrame:
    """Events (with utc_us) plus `out`: the id of the attribute row of the event's entity valid and known at the event.

    small: whether the snapshots are broadcast; measured if not given."""
    entity = list(entity)
    e = events.withColumn("_period", F.floor(F.col("utc_us") / period_us).cast("bigint"))
    snap = snapshots(change_log(attributes, row_id, period_us, entity), e.select(*entity, F.col("_period").alias("period")), entity)
    snap = snap.withColumnsRenamed({c: f"_s_{c}" for c in (*entity, "period", "snapshot", "changes")})
    same = [F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in entity] + [F.col("_period") == F.col("_s_period")]
    if is_small(snap) if small is None else small:
        j = e.join(F.broadcast(snap), same, "left")
    else:
        e = e.withColumn("_salt", F.pmod(F.xxhash64(*events.columns), F.lit(SALTS)))
        snap = snap.withColumn("_of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
        j = e.join(snap, [*same, F.col("_salt") == F.col("_of")], "left")
    replayed = F.array_max(F.transform(F.filter("_s_changes", lambda c: c["at"] <= F.col("utc_us")), lambda c: c["key"]))
    got = F.greatest(F.col("_s_snapshot"), replayed)["id"]
    return j.select(*(F.col(f"`{c}`") for c in events.columns), got.alias(out))
