import glob
import shutil

import pytest
from pyspark.sql import functions as F

from barloom.streaming import jobs


@pytest.fixture()
def ticks(spark, sf_dir, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    shutil.copy(glob.glob(f"{sf_dir}/events.parquet")[0], src / "a.parquet")
    return jobs.tick_stream(spark, str(src))


def test_bars_equal_batch(spark, sf_dir, ticks, tmp_path):
    got = jobs.run_available(jobs.bars_stream(ticks), "bars_t", "append", str(tmp_path / "c")).toPandas()
    batch = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    at = F.struct("ts", "event_id")
    want = batch.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.min_by("value", at).alias("open"), F.max_by("value", at).alias("close"), F.count(F.lit(1)).alias("volume")).toPandas()
    want = {(r.event_type, r.w["start"]): (r.open, r.close, r.volume) for r in want.itertuples()}
    have = {(r.event_type, r.ts): (r.open, r.close, r.volume) for r in got.itertuples()}
    assert have and all(want[k] == v for k, v in have.items())  # windows past the watermark, none wrong
    assert len(have) > 0.9 * len(want)


def test_deduplication_and_state(spark, sf_dir, ticks, tmp_path):
    twice = ticks.unionByName(ticks)
    n = jobs.run_available(jobs.deduplicated(twice, ["event_id"]), "dedup_t", "append", str(tmp_path / "c")).count()
    assert n == spark.read.parquet(f"{sf_dir}/events.parquet").count()
    s = jobs.run_available(jobs.bars_since_event(ticks, 400.0), "since_t", "append", str(tmp_path / "d"))
    assert s.where("since < -1").count() == 0 and s.where("since = 0").count() == spark.read.parquet(f"{sf_dir}/events.parquet").where("value >= 400").count()


def test_sessions_and_upsert(spark, ticks, tmp_path):
    assert jobs.run_available(jobs.sessions(ticks), "sess_t", "append", str(tmp_path / "c")).count() > 0
    target = str(tmp_path / "t")
    for rows in ([("a", 1, 1.0), ("b", 1, 2.0)], [("a", 2, 9.0), ("c", 1, 3.0)], [("a", 1, 5.0)]):
        jobs.upsert_sink(spark.createDataFrame(rows, "k string, ver bigint, x double"), target, ["k"], "ver")
    want = {"a": 9.0, "b": 2.0, "c": 3.0}
    assert {r["k"]: r["x"] for r in jobs.read_current(spark, target).collect()} == want
    bad = spark.createDataFrame([("a", 9, 0.0)], "k string, ver bigint, x double").withColumn("x", F.expr("raise_error('lost')"))
    with pytest.raises(Exception):
        jobs.upsert_sink(bad, target, ["k"], "ver")  # a batch that dies leaves the target as it was
    assert {r["k"]: r["x"] for r in jobs.read_current(spark, target).collect()} == want
    jobs.upsert_sink(spark.createDataFrame([("d", 1, 4.0)], "k string, ver bigint, x double"), target, ["k"], "ver")
    assert {r["k"]: r["x"] for r in jobs.read_current(spark, target).collect()} == want | {"d": 4.0}
    shutil.rmtree(glob.glob(f"{target}/v*4")[0])
    with pytest.raises(Exception):  # a lost version is an error, not an empty target
        jobs.upsert_sink(spark.createDataFrame([("e", 1, 4.0)], "k string, ver bigint, x double"), target, ["k"], "ver")


def test_ring_buffer_and_positions(spark, sf_dir, ticks, tmp_path):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").toPandas().sort_values(["event_type", "ts", "event_id"])
    got = jobs.run_available(jobs.rolling_state(ticks, 5), "ring_t", "append", str(tmp_path / "c")).toPandas().set_index("event_id")
    want = e.groupby("event_type")["value"].rolling(5).mean().droplevel(0)
    want.index = e.loc[want.index, "event_id"]
    assert len(got) == len(e) and (got["mean"] - want.reindex(got.index)).abs().max() < 1e-6
    closed = jobs.run_available(jobs.positions(ticks), "pos_t", "append", str(tmp_path / "d")).toPandas()
    assert len(closed) and set(closed["reason"]) <= {"stop", "trail", "target"} and (closed["closed"] != closed["opened"]).all()
    assert (closed.loc[closed["reason"] == "stop", "exit"] <= 0.9 * closed.loc[closed["reason"] == "stop", "entry"] + 1e-9).all()


def test_texts_are_enriched_and_deduplicated(spark, sf_dir, tmp_path):
    src = tmp_path / "texts"
    rows = [(1, "Bitcoin surge!", "2024-01-01 00:00:00"), (2, " bitcoin SURGE! ", "2024-01-01 00:01:00"), (3, None, "2024-01-01 00:02:00"), (4, None, "2024-01-01 00:03:00")]
    spark.createDataFrame(rows, "id bigint, body string, t string").withColumn("ts", F.to_timestamp("t")).drop("t").coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema("id bigint, body string, ts timestamp").parquet(str(src))
    got = {r["id"]: r for r in jobs.run_available(jobs.enriched_texts(stream, "body"), "enr_t", "append", str(tmp_path / "e")).collect()}
    assert got[1]["ordinal"] == got[2]["ordinal"] > 0 and got[1]["text_hash"] == got[2]["text_hash"] and got[1]["bull"] == 1 and got[3]["ordinal"] == 0
    assert len(jobs.run_available(jobs.deduplicated_texts(stream, "body", "id"), "ded_t", "append", str(tmp_path / "f")).collect()) == 3


def test_supervision():
    class Query:
        name, id, lastProgress = "q", "1", None

        def __init__(self, fails):
            self.fails = fails

        def awaitTermination(self, timeout=None):  # noqa: N802
            if self.fails:
                raise RuntimeError("lost")
            return True

    runs, waits, alarms = iter([True, True, False]), [], []
    q = jobs.supervise(lambda: Query(next(runs)), restarts=5, wait=waits.append, alarm=alarms.append)
    assert q is not None and waits == [5, 15] and len(alarms) == 2
    waits.clear()
    assert jobs.supervise(lambda: Query(True), restarts=4, wait=waits.append, alarm=alarms.append) is None and waits == [5, 15, 60, 300]
