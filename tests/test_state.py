"""Split state machines against a plain replay of every key."""
import random
from collections import deque
from datetime import datetime, timedelta

import pytest

from packetloom.operators import telemetry as tm
from packetloom.operators.flows import _sliced, flow_rescan
from packetloom.operators.reassembly import reassemble

START = datetime(2024, 1, 1)


def replay(packets):
    """Rescan flag and deciding packet of every packet of one flow."""
    left, expiry, scan, out = 0, 0, None, {}
    for ts, i in sorted(packets):
        second = int((ts - START).total_seconds() // 1)
        served = left > 0 and second < expiry
        if served:
            left -= 1
        else:
            left, expiry, scan = 50, second + 10, i
        out[i] = (not served, scan)
    return out


@pytest.mark.parametrize("slice_packets", [1, 7, 60, 100_000])
def test_flow_rescan(spark, slice_packets):
    rng = random.Random(slice_packets)
    rows, number = [], 0
    for flow, gap in (("hot", 0.05), ("mixed", None), ("sparse", 6.0), (None, 40.0)):
        at = rng.random() * 30
        for _ in range(900 if flow == "hot" else 250):
            at += rng.expovariate(1 / (gap or rng.choice([0.01, 0.2, 3, 15])))
            rows.append((flow, number, START + timedelta(microseconds=int(at * 1e6))))
            number += 1
    # One early packet, and then a burst.
    rows += [("burst", number + i, START + timedelta(seconds=0 if i == 0 else 3600, microseconds=i)) for i in range(500)]
    frame = spark.createDataFrame(rows, "k string, id long, ts timestamp_ntz")
    sizes = _sliced(frame, ("k",), slice_packets).groupBy("k", "_slice").count().agg({"count": "max"}).first()[0]
    assert sizes <= slice_packets
    found = {r["id"]: (r["rescan"], r["scan_id"]) for r in flow_rescan(frame, ("k",), slice_packets).collect()}
    wanted = {}
    for flow in {r[0] for r in rows}:
        wanted |= replay([(ts, i) for k, i, ts in rows if k == flow])
    assert found == wanted


def messages_of(chunks, limit):
    """Plain reassembly of one ordered list of (seq, data)."""
    out, number, first, held, body, missing, live = [], 0, None, 0, b"", 0, False
    for seq, data in sorted(chunks):
        first = seq if first is None else first
        if live:
            missing -= len(data)
        elif b"\r\n\r\n" in data:
            head, tail = data.split(b"\r\n\r\n", 1)
            length = [line.split(b":", 1)[1] for line in head.split(b"\r\n")[1:] if line.lower().startswith(b"content-length:")]
            live, missing = True, max(0, (int(length[-1]) if length else 0) - len(tail))
        if live:
            body += data
        if live and missing <= 0:
            flushed = held > limit
            out.append((number, first, seq, flushed, body))
            number, first, held, body, live = number + 1, None, 0, b"", False
        else:
            held += len(data)
    return out


@pytest.mark.parametrize("run,limit", [(1, 10**7), (3, 10**7), (5, 60), (4096, 60)])
def test_reassembly(spark, run, limit):
    rng = random.Random(run)
    rows, streams = [], {}
    for conn in range(6):
        stream = []
        for seq in range(rng.randint(1, 120 if conn == 0 else 25)):
            body = bytes(rng.choices(b"ab\r\n\xff", k=rng.randint(1, 30)))
            kind = rng.random()
            head = b"POST / HTTP/1.1\r\nContent-Length: %d\r\n\r\n" % rng.choice([0, 3, 40, 90, 200])
            stream.append((seq, head + body if kind < 0.35 else body))
        streams[conn] = stream
        rows += [(conn, "outbound", seq, data) for seq, data in stream]
    frame = spark.createDataFrame(rows, "conn_id long, direction string, seq long, data binary")
    found = {}
    for r in reassemble(frame, run, limit).collect():
        found.setdefault(r["conn_id"], []).append((r["message"], r["first_seq"], r["last_seq"], r["flushed"], r["data"] and bytes(r["data"])))
    wanted = {conn: m for conn, stream in streams.items() if (m := messages_of(stream, limit))}
    assert {k: sorted(v, key=lambda m: m[0]) for k, v in found.items()} == wanted


@pytest.mark.parametrize("slice_rows", [1, 50, 10_000])
def test_rolling_p95(spark, slice_rows):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "a", "b"]), i, START + timedelta(seconds=rng.randint(0, 60)), rng.random() * 100) for i in range(500)]
    frame = spark.createDataFrame(rows, "service string, id long, ts timestamp_ntz, ms double")
    found = {r["id"]: r["p95"] for r in tm.rolling_p95(frame, 20, slice_rows).collect()}
    recent = {"a": deque(maxlen=20), "b": deque(maxlen=20)}
    for service, i, _, ms in sorted(rows, key=lambda r: (r[2], r[1])):
        recent[service].append(round(ms, 1))
        ordered = sorted(recent[service])
        assert found[i] == pytest.approx(ordered[max(0, int(len(ordered) * 0.95) - 1)])


def test_numbering_with_one_hot_timestamp(spark):
    rows = [(i, START if i % 3 else START + timedelta(seconds=i)) for i in range(1000)]
    frame = spark.createDataFrame(rows, "id long, ts timestamp_ntz").repartition(7)
    found = {r["id"]: r["n"] for r in tm.number_rows(frame, "n", "ts", "id").collect()}
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    assert found == {row[0]: n for n, row in enumerate(ordered, 1)}


def test_totals_and_deltas(spark):
    rows = [(b * 3, b % 4) for b in range(200)]
    frame = spark.createDataFrame(rows, "bucket long, n long")
    totals = tm.running_totals(frame, ["n"], 30)
    running, wanted = 0, {}
    for bucket, n in rows:
        running += n
        wanted[bucket] = running
    assert {r["bucket"]: r["n"] for r in totals.collect()} == wanted
    assert {r["bucket"]: r["n"] for r in tm.deltas(totals, ["n"], 30).collect()} == dict(rows)


@pytest.mark.parametrize("n,wanted", [(1, 1), (20, 19), (30, 28), (100, 95)])
def test_p95_rank(spark, n, wanted):
    frame = spark.createDataFrame([("s", float(i)) for i in range(1, n + 1)], "service string, ms double")
    assert tm.p95_latency(frame).first()["p95"] == wanted
