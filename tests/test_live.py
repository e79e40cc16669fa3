"""Streams that follow changing rules, live series, state of reassembly, commit logs."""
import random
import shutil
import threading
import time
from collections import defaultdict
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from packetloom.operators.rules import match_rules
from packetloom.operators.telemetry import recent_series
from packetloom.schemas import RULE_TABLE
from packetloom.sources import commit_log, sinks
from packetloom.sources.rule_store import change_rules, current_version, publish_rules, read_version
from packetloom.streaming import jobs
from packetloom.streaming.sinks import latest_update, read_batches, start_batches
from test_robustness import events, rule

CHANGE = "change_ts long, op string, id string, action string, match_type string, value string, priority int, enabled boolean, description string"


def toggle(spark, name):
    return spark.createDataFrame([(1, "toggle", name, None, None, None, None, None, None)], CHANGE)


def judge(rows, rules):
    return match_rules(rows, rules).selectExpr("id", "rule.id AS rule_id")


def ids(spark, path):
    return {r.id: (r.rule_id, r.rule_version) for r in read_batches(spark, path).collect()}


def test_a_toggle_acts_on_later_rows_of_a_running_stream(spark, tmp_path):
    store, source, out = (str(tmp_path / n) for n in ("rules", "in", "out"))
    # More rules than a stream could hold before.
    many = [rule(f"r{i}", f"word{i}.", i) for i in range(12_000)]
    publish_rules(spark.createDataFrame([*many, rule("a", "alpha", 12_000)], RULE_TABLE), store)
    first = events(spark, ["alpha", "word11999."])
    first.write.parquet(source)
    stream = spark.readStream.schema(first.schema).parquet(source)
    query = jobs.start_live_verdicts(stream, store, out, str(tmp_path / "state"), judge, trigger={"processingTime": "0 seconds"})
    try:
        query.processAllAvailable()
        assert ids(spark, out) == {0: ("a", 1), 1: ("r11999", 1)}
        assert change_rules(toggle(spark, "a"), store) == 2
        first.withColumn("id", F.col("id") + 10).write.mode("append").parquet(source)
        query.processAllAvailable()
        assert change_rules(toggle(spark, "a"), store) == 3
        first.withColumn("id", F.col("id") + 20).write.mode("append").parquet(source)
        query.processAllAvailable()
    finally:
        query.stop()
    assert ids(spark, out) == {0: ("a", 1), 1: ("r11999", 1), 10: (None, 2), 11: ("r11999", 2), 20: ("a", 3), 21: ("r11999", 3)}


def test_a_replayed_batch_keeps_its_rules(spark, tmp_path):
    store, source, out, state = (str(tmp_path / n) for n in ("rules", "in", "out", "state"))
    publish_rules(spark.createDataFrame([rule("a", "alpha", 0)], RULE_TABLE), store)
    rows = events(spark, ["alpha"])
    rows.write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    jobs.start_live_verdicts(stream, store, out, state, judge).awaitTermination()
    change_rules(toggle(spark, "a"), store)
    # As if the stream had failed after writing the batch and before committing it.
    shutil.rmtree(f"{state}/commits")
    jobs.start_live_verdicts(stream, store, out, state, judge).awaitTermination()
    assert ids(spark, out) == {0: ("a", 1)}


def test_rules_without_a_version(spark, tmp_path):
    store = str(tmp_path / "rules")
    assert current_version(spark, store) == 0 and read_version(spark, store, 0).count() == 0
    added = spark.createDataFrame([(1, "add", "n", "block", "keyword", "x", 1, True, "")], CHANGE)
    assert change_rules(added, store) == 1
    assert [r.id for r in read_version(spark, store, 1).collect()] == ["n"]
    with pytest.raises(ValueError):
        read_version(spark, store, 9)


def test_one_writer_creates_an_entry(spark, tmp_path):
    folder, won = str(tmp_path / "log"), []
    assert commit_log.numbers(spark, folder) == [] and commit_log.read_entry(spark, folder, 1) is None
    for number in range(1, 4):
        threads = [threading.Thread(target=lambda n=number, w=w: won.append((n, w)) if commit_log.create_entry(spark, folder, n, f"é{w}") else None)
                   for w in range(2)]
        threads[0].start()
        threads[0].join()
        threads[1].start()
        threads[1].join()
    assert won == [(1, 0), (2, 0), (3, 0)] and commit_log.numbers(spark, folder) == [1, 2, 3]
    assert commit_log.read_entry(spark, folder, 2) == "é0" == commit_log.pinned_entry(spark, folder, 2, "later")


@pytest.mark.parametrize("files", [1, 7])
def test_live_series_equal_the_series_of_the_table(spark, tmp_path, files):
    rng = random.Random(files)
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(milliseconds=i * 700 + rng.randint(0, 40_000)), rng.choice(["BLOCK", "ALLOW", "WARN"]),
             None if rng.random() < 0.1 else rng.random() * 50) for i in range(1200)]
    rng.shuffle(rows)
    log = spark.createDataFrame(rows, "id long, ts timestamp_ntz, level string, ms double")
    for part in range(files):
        log.filter(F.col("id") * files / 1200 >= part).filter(F.col("id") * files / 1200 < part + 1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    start_batches(jobs.stream_live_series(stream), str(tmp_path / "out"), str(tmp_path / "state"), mode="update").awaitTermination()
    found = latest_update(read_batches(spark, str(tmp_path / "out")).drop("key"), "bucket")
    expected = recent_series(log, latencies=log.filter("ms IS NOT NULL").select("id", "ts", "ms")).collect()
    newest = {r.bucket: r for r in found.collect()}
    assert len(expected) == 48
    for r in expected:
        assert newest[r.bucket].asDict() == r.asDict()


class Handle:
    """State that counts the bytes written to it."""

    def __init__(self):
        self.written, self.timers = 0, []

    def size(self, row):
        return sum(len(x) if isinstance(x, bytes) else 8 for x in row)

    def getValueState(self, name, schema, *_):
        handle = self

        class Value:
            value = None
            exists = lambda s: s.value is not None
            get = lambda s: s.value

            def update(s, row):
                s.value, handle.written = row, handle.written + handle.size(row)

            def clear(s):
                s.value = None
        return Value()

    def getListState(self, name, schema, *_):
        handle = self

        class Rows:
            rows = ()
            get = lambda s: iter(s.rows)

            def appendList(s, rows):
                s.rows = [*s.rows, *rows]
                handle.written += sum(map(handle.size, rows))

            def clear(s):
                s.rows = ()
        return Rows()

    listTimers = lambda s: iter(s.timers)
    deleteTimer = lambda s, t: s.timers.remove(t)
    registerTimer = lambda s, t: s.timers.append(t)


class Clock:
    getCurrentProcessingTimeInMs = lambda s: 1000


def test_state_of_a_long_message_grows_with_its_chunks(spark):
    handle, processor = Handle(), jobs._Reassembly(10**9, 500)
    processor.init(handle)
    chunk, count, found = b"x" * 1000, 1000, []
    for seq in range(count):
        missing = (count - 1) * len(chunk) if seq == 0 else -1
        rows = pd.DataFrame([(7, "outbound", seq, len(chunk), missing, chunk)], columns=["conn_id", "direction", "seq", "size", "missing", "data"])
        found += [len(d) for out in processor.handleInputRows((7, "outbound"), iter([rows]), Clock()) for d in out["data"]]
    assert found == [count * len(chunk)] and handle.timers == [1500]
    assert handle.written < 1.2 * count * len(chunk)
    assert not list(processor.parts.get())
    list(processor.handleExpiredTimer((7, "outbound"), Clock(), None))
    assert not processor.open.exists()


@pytest.mark.parametrize("idle", [None, 3_600_000])
def test_reassembly_over_many_batches(spark, tmp_path, idle):
    body, size = b"b" * 2500, 100
    data = b"POST / HTTP/1.1\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    cuts = [data[i:i + size] for i in range(0, len(data), size)] * 2
    rows = [(c, "outbound", seq, bytearray(cut)) for c in range(3) for seq, cut in enumerate(cuts)]
    frame = spark.createDataFrame(rows, "conn_id long, direction string, seq long, data binary")
    for part in range(4):
        frame.filter(F.floor(F.col("seq") * 4 / len(cuts)) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    # With timers Spark goes on after the last row, so that stream is stopped here.
    query = start_batches(jobs.stream_reassembly(stream, idle_ms=idle), str(tmp_path / "out"), str(tmp_path / "state"),
                          trigger={"processingTime": "0 seconds"} if idle else None)
    end = time.time() + 90
    while query.isActive and time.time() < end and (not idle or (query.lastProgress or {"batchId": 0})["batchId"] < 5):
        time.sleep(0.5)
    query.stop()
    found = defaultdict(list)
    for r in read_batches(spark, str(tmp_path / "out")).collect():
        found[r.conn_id].append((r.message, r.first_seq, r.last_seq, bytes(r.data)))
    half = len(cuts) // 2
    assert all(sorted(found[c]) == [(0, 0, half - 1, data), (1, half, 2 * half - 1, data)] for c in range(3))


def test_rolling_p95_with_missing_values(spark):
    rows = [("a", i, datetime(2024, 1, 1) + timedelta(seconds=i), None if i % 3 else float(i)) for i in range(30)]
    rows += [(None, 100 + i, datetime(2024, 1, 1) + timedelta(seconds=i), None) for i in range(3)]
    from packetloom.operators.telemetry import rolling_p95
    frame = spark.createDataFrame(rows, "service string, id long, ts timestamp_ntz, ms double")
    found = {r.id: r.p95 for r in rolling_p95(frame, 10, 12).collect()}
    for i in range(30):
        seen = sorted(x for x in range(max(0, i - 9), i + 1) if x % 3 == 0)
        assert found[i] == seen[max(0, int(len(seen) * 0.95) - 1)]
    assert [found[100 + i] for i in range(3)] == [None] * 3


def blocked_log(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "id long").selectExpr(
        "id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(id % 3, 0, 0, id) AS ts", "IF(id % 4 = 0, 'ALLOW', 'BLOCK') AS level", "'1.2.3.4' AS src", "'d' AS dst",
        "'r' AS rule", "'malware' AS reason", "'block' AS status", "'high' AS risk_level", "'TCP' AS proto", "'-' AS bytes", "'m' AS msg")


def test_threat_numbers_of_several_writers_and_a_replay(spark, tmp_path):
    sink = str(tmp_path / "threats")
    assert sinks.last_threat(spark, sink) == 0
    sinks.write_threats(blocked_log(spark, range(0, 20)), sink)
    sinks.write_threats(blocked_log(spark, range(20, 30)), sink, "one", 0)
    sinks.write_threats(blocked_log(spark, range(30, 40)), sink, "two", 0)
    sinks.write_threats(blocked_log(spark, [40, 44]), sink, "two", 1)  # nothing blocked
    before = {r.event_id: r.threat_id for r in spark.read.parquet(sink).collect()}
    # Replays, also of a stream that another one has overtaken.
    sinks.write_threats(blocked_log(spark, range(20, 30)), sink, "one", 0)
    sinks.write_threats(blocked_log(spark, [40, 44]), sink, "two", 1)
    sinks.write_threats(blocked_log(spark, range(50, 60)), sink, "one", 1)
    rows = spark.read.parquet(sink).collect()
    after = {r.event_id: r.threat_id for r in rows}
    assert len(rows) == len(after) == sum(i % 4 > 0 for i in [*range(40), *range(50, 60)])
    assert before.items() <= after.items()
    assert sorted(after.values()) == [f"T-{n:05d}" for n in range(1, len(rows) + 1)]
    assert sinks.last_threat(spark, sink) == len(rows)
    with pytest.raises(ValueError):
        sinks.write_threats(blocked_log(spark, [1]), sink, "one", 1)
