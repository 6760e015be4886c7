"""Structured Streaming versions: bars by tumbling window, deduplication, enrichment, late upserts, keyed state."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barloom.functions import ciphers


def tick_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Event files as a stream; zone-less times are read as UTC, since watermarks need an instant."""
    schema = spark.read.parquet(path).schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def bars_stream(ticks: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Open, high, low, close and count per key and tumbling window; emitted when the watermark passes the window."""
    at = F.struct("ts", "event_id")
    return ticks.withWatermark("ts", late).groupBy("event_type", F.window("ts", width)).agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count(F.lit(1)).alias("volume")
    ).select("event_type", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume")


def deduplicated(stream: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def sessions(ticks: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Activity sessions per user (an addition beside tumbling windows)."""
    g = ticks.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total"))
    return g.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events", "total")


def enriched(stream: DataFrame, static: DataFrame, on: str) -> DataFrame:
    """Stream-static left join; the static side is read anew by each query start and broadcast only if small (AQE decides)."""
    return stream.join(static, on, "left")


def enriched_texts(stream: DataFrame, text: str) -> DataFrame:
    """Ciphers with their roots, sentiment, urgency and a hash key of the normalised text added to texts as they arrive."""
    out = ciphers.with_ciphers(stream, text, ciphers.CIPHERS)
    roots = {f"{n}_root": ciphers.digital_root(F.col(n)) for n in ciphers.CIPHERS}
    return out.withColumns(roots | ciphers.sentiment(F.col(text)) | {"text_hash": F.sha2(F.lower(F.trim(F.col(text))), 256)})


def deduplicated_texts(stream: DataFrame, text: str, row_id: str, late: str = "1 day") -> DataFrame:
    """One row per hash of the normalised text within the watermark; rows without a text are told apart by their id."""
    keyed = stream.withColumn("_key", F.coalesce(F.sha2(F.lower(F.trim(F.col(text))), 256), F.concat(F.lit("row "), F.col(row_id).cast("string"))))
    return keyed.withWatermark("ts", late).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


_POINTER = "CURRENT"


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p, jvm


def current_version(spark: SparkSession, target: str) -> str | None:
    """The folder the target's pointer names, None before the first batch. A missing pointer is told apart from a failed
    read by asking whether it exists; every other error is raised."""
    fs, p, jvm = _fs(spark, f"{target}/{_POINTER}")
    if not fs.exists(p):
        return None
    return spark.read.text(f"{target}/{_POINTER}").first()[0]


def read_current(spark: SparkSession, target: str) -> DataFrame:
    name = current_version(spark, target)
    if name is None:
        raise FileNotFoundError(f"{target} has no version yet")
    return spark.read.parquet(f"{target}/{name}")


def upsert_sink(batch: DataFrame, target: str, keys: list[str], version: str, batch_id: int | None = None) -> None:
    """foreachBatch body: the latest version per key over stored and new rows.

    Rows go to a new version folder; only when it is complete a new pointer file is renamed over the old one. The version
    before stays until then, so a batch that dies leaves the target as it was; the same batch run again gives the same
    rows. The version before the current one is kept for readers that still hold it, older ones are deleted."""
    spark = batch.sparkSession
    now = current_version(spark, target)
    rows = batch if now is None else spark.read.parquet(f"{target}/{now}").unionByName(batch, allowMissingColumns=True)
    rest = [c for c in rows.columns if c not in (*keys, version)]
    one = rows.groupBy(*keys).agg(F.max(F.struct(version, *rest)).alias("_r")).select(*keys, "_r.*")
    new = f"v{(int(now[1:]) if now else 0) + 1:012d}"
    one.write.mode("overwrite").parquet(f"{target}/{new}")  # left over from a batch that died: written again
    fs, pointer, jvm = _fs(spark, f"{target}/{_POINTER}")
    fresh = jvm.org.apache.hadoop.fs.Path(f"{target}/{_POINTER}.{new}")
    out = fs.create(fresh, True)
    out.write(bytearray(new.encode()))
    out.close()
    options = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri(), spark._jsc.hadoopConfiguration()).rename(fresh, pointer, options)
    for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(target)):
        name = s.getPath().getName()
        if name.startswith("v") and name < (now or new):
            fs.delete(s.getPath(), True)


def rolling_state(stream: DataFrame, size: int = 20) -> DataFrame:
    """Row-count windows per event type across micro-batches: mean, least and greatest of the last `size` values, from a ring
    buffer in the key's state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ring = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for i, v in zip(rows["event_id"], rows["value"], strict=True):
            ring = (ring + [float(v)])[-size:]
            full = len(ring) == size
            out.append((key[0], i, sum(ring) / size if full else None, min(ring) if full else None, max(ring) if full else None))
        state.update((ring,))
        yield pd.DataFrame(out, columns=["event_type", "event_id", "mean", "least", "most"])

    return stream.groupBy("event_type").applyInPandasWithState(
        step, "event_type string, event_id bigint, mean double, least double, most double", "ring array<double>", "append", GroupStateTimeout.NoTimeout
    )


def positions(stream: DataFrame, stop: float = 0.1, target: float = 0.2, trail: float = 0.1) -> DataFrame:
    """Keyed positions across micro-batches: opened at the first value of a key without one, closed by stop, then trailing stop
    (after one unit in favour), then target; the best value so far is part of the state. One row a closed position."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        entry, best, opened = state.get if state.exists else (0.0, 0.0, -1)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for i, v in zip(rows["event_id"], rows["value"].astype(float), strict=True):
            if v <= 0:
                continue
            if opened < 0:
                entry, best, opened = v, v, int(i)
                continue
            reason = "stop" if v <= entry * (1 - stop) else "trail" if best >= entry * (1 + stop) and v <= best * (1 - trail) else "target" if v >= entry * (1 + target) else ""
            best = max(best, v)
            if reason:
                out.append((key[0], opened, int(i), entry, v, best, reason))
                opened = -1
        state.update((entry, best, opened))
        yield pd.DataFrame(out, columns=["event_type", "opened", "closed", "entry", "exit", "best", "reason"])

    return stream.groupBy("event_type").applyInPandasWithState(
        step, "event_type string, opened bigint, closed bigint, entry double, exit double, best double, reason string", "entry double, best double, opened bigint", "append", GroupStateTimeout.NoTimeout
    )


#: Seconds to wait before the first, second, third and every later restart.
BACK_OFF = (5, 15, 60, 300)


def supervise(start: Callable[[], StreamingQuery], restarts: int, wait: Callable[[float], None] = time.sleep, alarm: Callable[[str], None] = print, stale_s: float = 900.0) -> StreamingQuery | None:
    """Start a query and start it again when it fails, waiting longer each time; an alarm for every failure and for progress
    older than `stale_s`. Returns the query once it ends without error, None after `restarts` failures."""
    for attempt in range(restarts + 1):
        query = None
        try:
            query = start()
            while not query.awaitTermination(timeout=max(1, int(stale_s))):
                last = query.lastProgress
                if last is None or pd.Timestamp.now(tz="UTC") - pd.Timestamp(last["timestamp"]) > pd.Timedelta(seconds=stale_s):
                    alarm(f"{query.name or query.id}: no progress for {stale_s:.0f} s")
            return query
        except Exception as e:  # noqa: BLE001 - whatever ends a query is reported and answered by a restart
            alarm(f"{(query.name or query.id) if query else 'start'} failed: {str(e)[:200]}")
            if attempt < restarts:
                wait(BACK_OFF[min(attempt, len(BACK_OFF) - 1)])
    return None


def bars_since_event(stream: DataFrame, threshold: float) -> DataFrame:
    """Keyed state: events seen since the last value at or over `threshold`, per event type, across micro-batches."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        since = state.get[0] if state.exists else -1
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for i, v in zip(rows["event_id"], rows["value"], strict=True):
            since = 0 if v >= threshold else (since + 1 if since >= 0 else -1)
            out.append((key[0], i, since))
        state.update((since,))
        yield pd.DataFrame(out, columns=["event_type", "event_id", "since"])

    return stream.groupBy("event_type").applyInPandasWithState(
        step, "event_type string, event_id bigint, since bigint", "since bigint", "append", GroupStateTimeout.NoTimeout
    )


def run_available(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Process what is there and return the memory table (tests and small jobs)."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
