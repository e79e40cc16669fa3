"""Streaming jobs: the batch plans over unbounded input, and keyed state."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from packetloom import fixed_values as fv
from packetloom.functions.timestamps import bucket_start, epoch_micros
from packetloom.operators.flows import FLOW
from packetloom.operators.reassembly import missing_after_header
from packetloom.plans.inspect import traffic_verdict
from packetloom.sources.commit_log import pinned_entry
from packetloom.sources.rule_store import current_version, read_version

# Spark also starts stateful processors in a worker on the driver, which does
# not see shipped packages; their code therefore travels with the query.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state with lists and timers needs the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)


def stream_verdicts(traffic: DataFrame, rules: DataFrame, image_verdicts: DataFrame | None = None) -> DataFrame:
    """Verdicts of a traffic stream; the batch plan, which keeps no state.

    The rule table is read when the query starts; ``start_live_verdicts``
    follows one that changes.
    """
    return traffic_verdict(traffic, rules, image_verdicts)


Judge = Callable[[DataFrame, DataFrame], DataFrame]


def start_live_verdicts(traffic: DataFrame, rules_path: str, path: str, checkpoint: str, judge: Judge = traffic_verdict,
                        trigger: dict | None = None) -> StreamingQuery:
    """Write the verdicts of a traffic stream by the rules that are in force when a micro-batch starts.

    ``rules_path`` is a store of ``sources.rule_store``. Every micro-batch
    reads its newest version, of any number of rules, and judges its rows with
    ``judge(rows, rules)``; a change acts on the next micro-batch without a
    restart. The version is noted per batch before it is used, so a replayed
    batch is judged by the same rules and overwrites its own folder below
    ``path``. Output rows carry ``rule_version``.
    """
    spark = traffic.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        version = int(pinned_entry(spark, f"{path}/_rule_versions", batch_id, str(current_version(spark, rules_path))))
        judged = judge(batch, read_version(spark, rules_path, version))
        judged.withColumn("rule_version", F.lit(version)).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = traffic.writeStream.option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).foreachBatch(write).start()


def stream_flow_totals(packets: DataFrame, keys: tuple[str, ...] = FLOW, idle: str | None = None) -> DataFrame:
    """Running totals per flow, for update mode.

    With ``idle`` (such as ``10 minutes``) flows become sessions that end and
    leave the state after that time without packets.
    """
    if idle is None:
        grouped = packets.groupBy(*keys)
    else:
        grouped = packets.withWatermark("ts", idle).groupBy(*keys, F.session_window("ts", idle))
    return grouped.agg(F.min("ts").alias("start_time"), F.max("ts").alias("last_seen"),
                       F.sum("length").cast("long").alias("byte_count"), F.count("*").alias("packets"))


def stream_series(log: DataFrame, seconds: int = fv.SERIES_SECONDS, late: str | None = None) -> DataFrame:
    """(bucket, events, blocked, allowed) per tumbling window of a log stream.

    Without ``late`` no row is ever too late and all windows stay in the
    state; with it (such as ``10 minutes``) windows leave the state, and rows
    that come later than that are dropped.
    """
    window = F.window("ts", f"{seconds} seconds")
    counts = (log.withWatermark("ts", late) if late else log).groupBy(window).agg(
        F.count("*").alias("events"), F.count_if(F.col("level") == "BLOCK").alias("blocked"),
        F.count_if(F.col("level") != "BLOCK").alias("allowed"))
    start = F.col("window")["start"].cast("timestamp_ntz")
    return counts.select(bucket_start(start, seconds).alias("bucket"), "events", "blocked", "allowed")


PARTIAL = "key string, kind int, bucket bigint, a bigint, b bigint, c bigint, ms double"
_COUNTS, _LATENCY = 0, 1


def _newest(counts: pd.DataFrame, latencies: pd.DataFrame, points: int, seconds: int, samples: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Per key: counts and last samples of the newest ``points`` buckets, and of all older ones as one bucket before them."""
    oldest = counts.groupby("key")["bucket"].max() - points * seconds

    def clipped(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.assign(bucket=rows["bucket"].clip(lower=rows["key"].map(oldest)))

    counts = clipped(counts).groupby(["key", "bucket"], as_index=False).sum()
    return counts, clipped(latencies).sort_values(["a", "b"]).groupby(["key", "bucket"]).tail(samples)


def _partial_series(points: int, seconds: int, samples: int):
    """Task: what its rows add to the newest buckets; at most ``points + 1`` buckets of ``samples`` latencies leave it."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = latencies = None
        for batch in batches:
            if not len(batch):
                continue
            new = batch.groupby(["key", "bucket"], as_index=False).agg(a=("blocked", "size"), b=("blocked", "sum"))
            new["c"] = new["a"] - new["b"]
            timed = batch.loc[batch["ms"].notna(), ["key", "bucket", "micros", "id", "ms"]].rename(columns={"micros": "a", "id": "b"})
            both = (new, timed) if counts is None else (pd.concat([counts, new]), pd.concat([latencies, timed]))
            counts, latencies = _newest(*both, points, seconds, samples)
        if counts is not None:
            yield counts.assign(kind=_COUNTS, ms=0.0)[["key", "kind", "bucket", "a", "b", "c", "ms"]]
            yield latencies.assign(kind=_LATENCY, c=0)[["key", "kind", "bucket", "a", "b", "c", "ms"]]
    return run


class _Series(StatefulProcessor):
    """The newest points of four series: state is bounded by the number of points and samples."""

    def __init__(self, points: int, seconds: int, samples: int, share: float):
        self.points, self.seconds, self.samples, self.share = points, seconds, samples, share

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.before = handle.getValueState("before", "sessions bigint")
        self.counts = handle.getListState("counts", "bucket bigint, a bigint, b bigint, c bigint")
        self.latencies = handle.getListState("latencies", "bucket bigint, a bigint, b bigint, ms double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        held = pd.DataFrame(list(self.counts.get()) if self.counts.exists() else [], columns=["bucket", "a", "b", "c"], dtype="int64")
        ring = pd.DataFrame(list(self.latencies.get()) if self.latencies.exists() else [], columns=["bucket", "a", "b", "ms"], dtype="float64")
        counts = pd.concat([held, new.loc[new["kind"] == _COUNTS, ["bucket", "a", "b", "c"]]]).assign(key="")
        ring = pd.concat([ring, new.loc[new["kind"] == _LATENCY, ["bucket", "a", "b", "ms"]]]).astype(
            {"bucket": "int64", "a": "int64", "b": "int64", "ms": "float64"}).assign(key="")
        counts, ring = _newest(counts, ring, self.points, self.seconds, self.samples)
        last = int(counts["bucket"].max())
        first = last - (self.points - 1) * self.seconds
        sessions = (int(self.before.get()[0]) if self.before.exists() else 0) + int(counts.loc[counts["bucket"] < first, "c"].sum())
        counts = counts[counts["bucket"] >= first]
        self.before.update((sessions,))
        self.counts.put([tuple(map(int, r)) for r in counts[["bucket", "a", "b", "c"]].itertuples(index=False)])
        ring = ring.sort_values(["a", "b"])
        self.latencies.put([(int(r.bucket), int(r.a), int(r.b), float(r.ms)) for r in ring.itertuples(index=False)])
        out, known = [], counts.set_index("bucket")[["a", "b", "c"]].to_dict("index")
        buckets, ms = ring["bucket"].to_numpy(), ring["ms"].to_numpy()
        for bucket in range(first, last + 1, self.seconds):
            at = known.get(bucket, {"a": 0, "b": 0, "c": 0})
            sessions += at["c"]
            recent = sorted(ms[:buckets.searchsorted(bucket, side="right")][-self.samples:])
            latency = recent[max(1, int(len(recent) * self.share)) - 1] if recent else 0.0
            out.append((key[0], bucket, int(at["a"]), int(at["b"]), sessions, float(latency)))
        yield pd.DataFrame(out, columns=["key", "bucket", "throughput", "blocked", "sessions", "latency"])

    def close(self) -> None:
        pass


def stream_live_series(log: DataFrame, points: int = fv.SERIES_POINTS, seconds: int = fv.SERIES_SECONDS,
                       samples: int = fv.LATENCY_SAMPLES, key: str | None = None) -> DataFrame:
    """The newest points of throughput, blocked, running sessions and p95 latency, for update mode.

    ``log`` is a stream of (ts, id, level, ms); ``ms`` is null where no
    latency was measured. Each micro-batch with rows gives all ``points``
    buckets anew, (key, bucket, throughput, blocked, sessions, latency), so
    rows that come late within these buckets are counted where they belong;
    older ones only count as sessions. Tasks reduce their rows first: what
    meets under a ``key`` (one for the whole log, if not given) is bounded.
    """
    use_rocksdb(log.sparkSession)
    rows = log.select(
        (F.col(key).cast("string") if key else F.lit("all")).alias("key"), bucket_start(F.col("ts"), seconds).cast("long").alias("bucket"),
        epoch_micros(F.col("ts")).alias("micros"), F.col("id").cast("long").alias("id"), (F.col("level") == "BLOCK").alias("blocked"),
        F.bround("ms", 1).alias("ms"))
    partial = rows.mapInPandas(_partial_series(points, seconds, samples), PARTIAL)
    return partial.groupBy("key").transformWithStateInPandas(
        _Series(points, seconds, samples, fv.P95),
        "key string, bucket bigint, throughput bigint, blocked bigint, sessions bigint, latency double", "Update", "None")


class _FlowCache(StatefulProcessor):
    """Serve packets from the last scan of their flow while it is valid."""

    def __init__(self, keys: tuple[str, ...], packets: int, ttl: int, evict_ms: int | None):
        self.keys, self.packets, self.ttl, self.evict_ms = keys, packets, ttl, evict_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = "left int, expiry bigint, scan bigint"
        self.cache = handle.getValueState("cache", schema, self.evict_ms) if self.evict_ms else handle.getValueState("cache", schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["micros", "id"], kind="stable")
        left, expiry, scan = self.cache.get() if self.cache.exists() else (0, 0, None)
        rescans, scans = [], []
        for packet, second in zip(batch["id"], batch["micros"] // 1_000_000):
            served = left > 0 and second < expiry
            left, expiry, scan = (left - 1, expiry, scan) if served else (self.packets, int(second) + self.ttl, int(packet))
            rescans.append(not served)
            scans.append(scan)
        self.cache.update((int(left), int(expiry), scan))
        yield batch[[*self.keys, "id", "micros"]].assign(rescan=rescans, scan_id=scans)

    def close(self) -> None:
        pass


def stream_flow_cache(packets: DataFrame, keys: tuple[str, ...] = FLOW, rescan_packets: int = fv.RESCAN_PACKETS,
                      ttl: int = fv.CACHE_TTL_SECONDS, evict_ms: int | None = None) -> DataFrame:
    """(keys, id, micros, rescan, scan_id) for a stream of (keys, id, ts).

    ``evict_ms`` drops the state of a flow that was not touched for that many
    milliseconds of processing time; use it on live traffic, where an expired
    entry and no entry mean the same.
    """
    use_rocksdb(packets.sparkSession)
    rows = packets.select(*keys, "id", epoch_micros(F.col("ts")).alias("micros"))
    fields = [T.StructField(f.name, f.dataType) for f in rows.schema.fields]
    schema = T.StructType([*fields, T.StructField("rescan", T.BooleanType()), T.StructField("scan_id", T.LongType())])
    return rows.groupBy(*keys).transformWithStateInPandas(
        _FlowCache(keys, rescan_packets, ttl, evict_ms), schema, "Append", "ProcessingTime" if evict_ms else "None")


class _Reassembly(StatefulProcessor):
    """Collect the chunks of a connection until a message is complete.

    Chunks of the open message are appended to a list one by one, so each is
    written to the state once; what is rewritten per batch is a few numbers.
    """

    def __init__(self, limit: int, idle_ms: int | None):
        self.limit, self.idle_ms = limit, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "message bigint, missing bigint, held bigint, first bigint, live boolean")
        self.parts = handle.getListState("parts", "data binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        message, missing, held, first, live = self.open.get() or (0, 0, 0, None, False)
        # Whether parts of the open message are stored, and what this batch adds to them.
        stored, new, done = bool(live), [], []
        for chunk in pd.concat(list(rows)).sort_values("seq").itertuples(index=False):
            first = chunk.seq if first is None else first
            if live:
                missing -= chunk.size
            elif chunk.missing >= 0:
                live, missing = True, chunk.missing
            if live:
                new.append(bytes(chunk.data))
            if not live or missing > 0:
                held += chunk.size
                continue
            before = [bytes(part[0]) for part in self.parts.get()] if stored else []
            done.append((*key, message, first, chunk.seq, held > self.limit, b"".join(before + new)))
            if stored:
                self.parts.clear()
            stored, new = False, []
            message, missing, held, first, live = message + 1, 0, 0, None, False
        if new:
            self.parts.appendList([(part,) for part in new])
        self.open.update((int(message), int(missing), int(held), None if first is None else int(first), bool(live)))
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + self.idle_ms)
        if done:
            yield pd.DataFrame(done, columns=["conn_id", "direction", "message", "first_seq", "last_seq", "flushed", "data"])

    def handleExpiredTimer(self, key, timer_values, expired_timer_info) -> Iterator[pd.DataFrame]:
        """A connection without chunks for long is dead; its open message will never be complete."""
        self.open.clear()
        self.parts.clear()
        yield pd.DataFrame([], columns=["conn_id", "direction", "message", "first_seq", "last_seq", "flushed", "data"])

    def close(self) -> None:
        pass


def stream_reassembly(chunks: DataFrame, limit: int = fv.BUFFER_LIMIT_BYTES, idle_ms: int | None = None) -> DataFrame:
    """Complete messages of a stream of chunks (conn_id, direction, seq, data).

    ``idle_ms`` drops the state of a connection that had no chunk for that
    many milliseconds of processing time; its messages count from 0 again.
    With it Spark runs on for its timers, also under ``availableNow``.
    """
    use_rocksdb(chunks.sparkSession)
    rows = chunks.select("conn_id", "direction", "seq", F.octet_length("data").alias("size"),
                         missing_after_header(F.col("data")).alias("missing"), "data")
    schema = "conn_id bigint, direction string, message bigint, first_seq bigint, last_seq bigint, flushed boolean, data binary"
    return rows.groupBy("conn_id", "direction").transformWithStateInPandas(
        _Reassembly(limit, idle_ms), schema, "Append", "None" if idle_ms is None else "ProcessingTime")
