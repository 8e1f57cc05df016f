import json
import random
import time
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import functions as F

from trailmesh.operators import clean
from trailmesh.streaming.ingest import Ingest, changed_recordings
from trailmesh.streaming import live
from trailmesh.streaming.live import live_points

BASE = 1_767_268_800


def iso(t):
    return datetime.fromtimestamp(BASE + t, timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.000Z")


def fix(t, north, accuracy=5.0):
    return {"latitude": 45.75 + north * 1e-5, "longitude": 4.8, "timestamp": iso(t), "accuracy": accuracy}


def drop(folder, name, points, version=2, owner=1, preferred=7, created=0):
    doc = {"id": name, "createdAt": iso(created), "version": version, "ownerId": owner, "points": points,
           "preferredSessionId": preferred}
    (folder / f"{name}.json").write_text(json.dumps(doc))


def test_journal_to_points(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    ingest = Ingest(str(tmp_path / "store"))
    table = [(1, 7, datetime.fromtimestamp(BASE, timezone.utc), datetime.fromtimestamp(BASE + 1000, timezone.utc))]
    sessions = spark.createDataFrame(table, "owner_id long, session_id long, started_at timestamp, ended_at timestamp")
    as_of = F.timestamp_seconds(F.lit(BASE + 200))

    def run():
        ingest.start(spark, str(inbox), lambda: sessions, lambda: as_of, str(tmp_path / "ck"), True).awaitTermination()

    drop(inbox, "a", [fix(t, 2 * t) for t in range(0, 40, 2)])
    (inbox / "bad.json").write_text('{"id": "x", "version": 9')
    drop(inbox, "outside", [fix(5000, 0)], version=1, created=100)
    drop(inbox, "old", [fix(6000, 0)], version=1, created=-2000)
    run()
    assert ingest.points(spark).count() == 20
    assert spark.read.parquet(ingest.table("dead_letters")).count() == 1
    assert spark.read.parquet(ingest.table("pending")).count() == 1
    assert spark.read.parquet(ingest.table("ignored")).count() == 1
    # Late fixes, one of them a repeat: the recording is rebuilt from everything.
    drop(inbox, "b", [fix(t, 2 * t) for t in range(1, 40, 2)] + [fix(0, 0)])
    run()
    points = ingest.points(spark)
    assert points.count() == 40
    assert [r.point_index for r in points.orderBy("ts").collect()] == list(range(40))
    assert changed_recordings(spark, ingest, 0).count() == 1


def test_batches_read_touched_buckets_only(spark, tmp_path):
    """Files of a bucket do not grow with the batches, and a batch that broke off is made good."""
    ingest = Ingest(str(tmp_path / "store"), buckets=16)
    start, end = (datetime.fromtimestamp(BASE + t, timezone.utc) for t in (0, 1000))
    sessions = spark.createDataFrame(
        [(1, s, start, end) for s in range(1, 5)],
        "owner_id long, session_id long, started_at timestamp, ended_at timestamp")

    def lines(batch, session):
        doc = {"id": f"d{batch}", "createdAt": iso(0), "version": 2, "ownerId": 1, "preferredSessionId": session,
               "points": [fix(t, 2 * t) for t in range(batch, 60, 6)]}
        return spark.createDataFrame([(json.dumps(doc),)], "value string")

    def process(batch, session):
        ingest.process(lines(batch, session), batch, sessions, F.timestamp_seconds(F.lit(BASE + 200)))

    for batch, session in enumerate((1, 2, 1, 1)):
        process(batch, session)
    stored = ingest.observations(spark)
    assert stored.count() == 40
    spots = {r.session_id: r.bucket for r in stored.select("session_id", "bucket").distinct().collect()}
    mine = stored.filter(F.col("bucket") == spots[1])
    assert len({r.f for r in mine.select(F.input_file_name().alias("f")).collect()}) == 1
    # The last batch ended after it had emptied its bucket: run again, it finds all rows in what it merged.
    stored.filter("false").drop("bucket").write.mode("overwrite").parquet(f"{ingest.table('observations')}/bucket={spots[1]}")
    process(3, 1)
    assert ingest.observations(spark).count() == 40
    assert ingest.points(spark).filter("session_id = 1").count() == 30


def test_live_state_equals_batch(spark, tmp_path):
    rng = random.Random(4)
    rows = [(1, s, BASE + 3 * i, 45.75 + (i * 2 + (900 if rng.random() < 0.1 else 0)) * 1e-5, 4.8,
             rng.choice([None, 6.0, 45.0]), i) for s in (1, 2) for i in range(40)]
    rng.shuffle(rows)
    schema = "owner_id long, session_id long, sec long, lat double, lon double, accuracy double, arrival long"
    fixes = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("sec")).drop("sec")
    source = str(tmp_path / "fixes")
    fixes.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(fixes.schema).parquet(source)
    # Timers keep such a query awake, so it is watched and stopped.
    query = live_points(stream, reorder_ms=0).writeStream.format("memory").queryName("live").option(
        "checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="500 milliseconds").start()
    deadline = time.time() + 90
    while time.time() < deadline and spark.table("live").filter("state = 'live'").count() == 0:
        time.sleep(1)
    rows = spark.table("live").filter("state = 'live'").collect()
    query.stop()
    live = {(r.session_id, r.ts, r.point_index) for r in rows}
    batch = {(r.session_id, r.ts, r.point_index) for r in clean.canonical_points(fixes).collect()}
    assert live == batch and len(live) > 40


class Clock:
    """A group state with a clock that the test moves."""

    def __init__(self):
        self.value, self.now, self.timeout, self.hasTimedOut = None, 0, None, False

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def getCurrentProcessingTimeMs(self):  # noqa: N802
        return self.now

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutDuration(self, ms):  # noqa: N802
        assert ms > 0
        self.timeout = self.now + ms

    def feed(self, run, fixes):
        frame = pd.DataFrame([(pd.Timestamp(BASE + t, unit="s"), 45.75 + n * 1e-5, 4.8, 5.0) for t, n in fixes],
                             columns=["ts", "lat", "lon", "accuracy"])
        self.hasTimedOut = False
        return pd.concat(list(run((1, 7), [frame], self)), ignore_index=True)

    def wait(self, run):
        self.now, self.hasTimedOut = self.timeout, True
        found = list(run((1, 7), [], self))
        return pd.concat(found, ignore_index=True) if found else None


def test_fixes_are_sent_while_more_arrive():
    clock, run, sent = Clock(), live._follow(750), []
    for k in range(0, 100, 2):  # every trigger brings a pair in the wrong order
        sent += clock.feed(run, [(3 * (k + 1), 2 * (k + 1)), (3 * k, 2 * k)]).point_index.tolist()
        clock.now += 500
        assert len(clock.value[7]) <= 4
    assert len(sent) >= 94 and sent == list(range(len(sent)))


def test_silence_is_told_once_and_forgotten():
    clock, run = Clock(), live._follow(750)
    clock.feed(run, [(0, 0), (3, 2)])
    assert clock.wait(run).state.tolist() == ["live", "live"]
    assert clock.wait(run).state.tolist() == ["stale"]
    back = clock.feed(run, [(30, 20)])
    assert len(back) == 0 and clock.wait(run).point_index.tolist() == [2]
    assert clock.wait(run).state.tolist() == ["stale"]
    assert clock.wait(run) is None and clock.value is None


def test_stream_with_waiting_time_equals_batch(spark, tmp_path):
    schema = "owner_id long, session_id long, sec long, lat double, lon double, accuracy double, arrival long"
    rows = [(1, 1, BASE + 3 * (i ^ 1), 45.75 + 2e-5 * (i ^ 1), 4.8, 5.0, i) for i in range(40)]
    source = str(tmp_path / "fixes")
    fixes = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("sec")).drop("sec")
    for k in range(4):
        fixes.filter(f"arrival div 10 = {k}").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(fixes.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = live_points(stream, reorder_ms=300).writeStream.format("memory").queryName("held").option(
        "checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="700 milliseconds").start()
    deadline = time.time() + 120
    while time.time() < deadline and spark.table("held").filter("state = 'live'").count() < 40:
        time.sleep(1)
    rows = spark.table("held").filter("state = 'live'").collect()
    query.stop()
    assert {(r.ts, r.point_index) for r in rows} == {(r.ts, r.point_index) for r in clean.canonical_points(fixes).collect()}
