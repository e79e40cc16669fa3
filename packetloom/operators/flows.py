"""Packet flows: per-flow totals and the rescan cache.

The cache is a fold over the ordered packets of a flow: after a scan, packets
are served until 50 were served or 10 whole seconds passed; then the next
packet is scanned. One flow may hold a large part of all packets, so a busy
flow is cut into time slices which are processed apart:

1. every slice computes where it would leave the cache for each way in which
   the cache can enter it (the first scan falls on one of its first 51 packets);
2. these small summaries are chained per flow to get the true entry states;
3. every slice is replayed from its entry state.

The result is the same as one pass over the whole flow.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom import fixed_values as fv
from packetloom.functions.timestamps import epoch_micros, from_epoch_micros
from packetloom.operators.telemetry import number_rows
from packetloom.session import cut_lineage

FLOW = ("src", "sport", "dst", "dport", "proto")
_TCP_UDP = (6, 17)


def flow_table(packets: DataFrame, keys: tuple[str, ...] = FLOW) -> DataFrame:
    """Start, last packet, bytes and packets of every flow."""
    return packets.groupBy(*keys).agg(
        F.min("ts").alias("start_time"), F.max("ts").alias("last_seen"),
        F.sum("length").cast("long").alias("byte_count"), F.count("*").alias("packets"))


def zero_ports(packets: DataFrame) -> DataFrame:
    """Ports of protocols other than TCP (6) and UDP (17) count as 0."""
    ported = F.col("proto").isin(*_TCP_UDP)
    return packets.withColumns({c: F.when(ported, F.col(c)).otherwise(0) for c in ("sport", "dport")})


def _jumps(seconds: np.ndarray, packets: int, ttl: int) -> np.ndarray:
    """Index of the scan that follows a scan at each index."""
    by_count = np.arange(len(seconds)) + packets + 1
    by_time = np.searchsorted(seconds, seconds + ttl, side="left")
    return np.minimum(by_count, by_time)


def _slices(packed: pa.Array):
    """(seconds, ids) of every list of (micros, id) structs."""
    flat, offsets = packed.flatten(), np.concatenate([[0], np.cumsum(packed.value_lengths().to_numpy(zero_copy_only=False))])
    micros, ids = flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False)
    for start, end in zip(offsets[:-1], offsets[1:]):
        yield micros[start:end] // 1_000_000, ids[start:end]


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(arrays) if arrays else [], kind))


def _summary_udf(packets: int, ttl: int):
    @F.arrow_udf("struct<first: bigint, n: int, served: array<int>, left: array<int>, expiry: array<bigint>, scan: array<bigint>>")
    def summarise(packed: pa.Array) -> pa.Array:
        first, count, served, left, expiry, scan = [], [], [], [], [], []
        for seconds, ids in _slices(packed):
            n = len(seconds)
            jump = _jumps(seconds, packets, ttl)
            last = np.arange(min(packets + 1, n))
            while (inside := jump[last] < n).any():
                last = np.where(inside, jump[np.minimum(last, n - 1)], last)
            first.append(int(seconds[0]))
            count.append(n)
            served.append(np.searchsorted(seconds, seconds[0] + np.arange(1, ttl + 1), side="left"))
            left.append(packets - (n - 1 - last))
            expiry.append(seconds[last] + ttl)
            scan.append(ids[last])
        return pa.StructArray.from_arrays(
            [pa.array(first, pa.int64()), pa.array(count, pa.int32()), _lists(served, pa.int32()),
             _lists(left, pa.int32()), _lists(expiry, pa.int64()), _lists(scan, pa.int64())],
            names=["first", "n", "served", "left", "expiry", "scan"])
    return summarise


def _replay_udf(packets: int, ttl: int):
    @F.arrow_udf("array<struct<rescan: boolean, scan_id: bigint>>")
    def replay(packed: pa.Array, left: pa.Array, expiry: pa.Array, scan: pa.Array) -> pa.Array:
        rescans, scan_ids = [], []
        entries = zip(left.to_pylist(), expiry.to_pylist(), scan.to_pylist())
        for (seconds, ids), (left_in, expiry_in, scan_in) in zip(_slices(packed), entries):
            n = len(seconds)
            jump = _jumps(seconds, packets, ttl)
            at = min(left_in, int(np.searchsorted(seconds, expiry_in, side="left")))
            flags, owner = np.zeros(n, dtype=bool), np.full(n, -1 if scan_in is None else scan_in, dtype=np.int64)
            while at < n:
                flags[at] = True
                end = min(int(jump[at]), n)
                owner[at:end] = ids[at]
                at = end
            rescans.append(flags)
            scan_ids.append(owner)
        flat = pa.StructArray.from_arrays(
            [pa.array(np.concatenate(rescans) if rescans else [], pa.bool_()),
             pa.array(np.concatenate(scan_ids) if scan_ids else [], pa.int64())], names=["rescan", "scan_id"])
        offsets = np.concatenate([[0], np.cumsum([len(a) for a in rescans])]).astype(np.int32)
        return pa.ListArray.from_arrays(offsets, flat)
    return replay


def _chain(width: int, ttl: int):
    """Task: what enters each slice, from the summaries in order of flow and slice."""
    def run(batches):
        flow, left, expiry, scan = None, 0, 0, None
        for batch in batches:
            keys = list(zip(*[c.to_pylist() for c in batch.columns[:width]]))
            entering = []
            for key, s in zip(keys, batch.select(batch.schema.names[width + 1:]).to_pylist()):
                if key != flow:
                    flow, left, expiry, scan = key, 0, 0, None
                # Number of packets of this slice that the entering cache still serves.
                alive = expiry > s["first"]
                at = min(left, s["served"][min(expiry - s["first"], ttl) - 1]) if alive else 0
                entering.append((left if alive else 0, expiry, scan))
                if at >= s["n"]:
                    left -= s["n"]
                else:
                    left, expiry, scan = s["left"][at], s["expiry"][at], s["scan"][at]
            columns = zip(*entering) if entering else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:width + 1], *[pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()))]],
                names=[*batch.schema.names[:width + 1], "left", "expiry", "scan"])
    return run


def _sliced(packets: DataFrame, keys: tuple[str, ...], slice_packets: int) -> DataFrame:
    """(keys, _slice, _cut, micros, id): slices of busy flows, others whole.

    A flow with more than ``slice_packets`` packets is cut by the rank of its
    packets, so that no slice is larger, however the packets lie in time.
    """
    rows = packets.select(*keys, epoch_micros(F.col("ts")).alias("micros"), "id")
    busy = rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > slice_packets)
    busy = cut_lineage(busy.select(*[F.col(k).alias(f"_key_{k}") for k in keys]))
    whole = rows.withColumns({"_slice": F.lit(0).cast("long"), "_cut": F.lit(False)})
    if not busy.take(1):
        return whole
    numbered = number_rows(rows.join(busy, _same(keys), "left_semi"), "_n", *keys, "micros", "id")
    first = numbered.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys]).agg(F.min("_n").alias("_first"))
    cut = numbered.join(first, _same(keys)).withColumns(
        {"_slice": F.floor((F.col("_n") - F.col("_first")) / slice_packets), "_cut": F.lit(True)})
    return whole.join(busy, _same(keys), "left_anti").unionByName(cut.select(*whole.columns))


def _same(keys: tuple[str, ...]) -> Column:
    """Equality with the renamed keys of the other side; null equals null."""
    return reduce(and_, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys])


def flow_rescan(packets: DataFrame, keys: tuple[str, ...] = FLOW, slice_packets: int = 100_000,
                rescan_packets: int = fv.RESCAN_PACKETS, ttl: int = fv.CACHE_TTL_SECONDS) -> DataFrame:
    """(keys, id, ts, rescan, scan_id) for every packet (keys, id, ts).

    ``scan_id`` is the id of the packet whose scan decides this packet. One
    task group is one slice of a flow; the chain of a flow has one small row
    per slice.
    """
    slices = _sliced(packets, keys, slice_packets).groupBy(*keys, "_slice") \
        .agg(F.array_sort(F.collect_list(F.struct("micros", "id"))).alias("_packets"), F.max("_cut").alias("_cut"))
    # A flow in one piece starts with an empty cache; only cut flows are chained.
    summaries = slices.filter("_cut").select(*keys, "_slice", _summary_udf(rescan_packets, ttl)("_packets").alias("_s")) \
        .select(*keys, "_slice", "_s.*")
    kinds = ", ".join(f"{k} {summaries.schema[k].dataType.simpleString()}" for k in keys)
    entries = summaries.repartition(*keys).sortWithinPartitions(*keys, "_slice").mapInArrow(
        _chain(len(keys), ttl), f"{kinds}, _slice bigint, left int, expiry bigint, scan bigint")
    entries = entries.select(*[F.col(k).alias(f"_key_{k}") for k in (*keys, "_slice")], "left", "expiry", "scan")
    entered = slices.join(entries, _same((*keys, "_slice")), "left") \
        .withColumns({"left": F.coalesce("left", F.lit(0)), "expiry": F.coalesce("expiry", F.lit(0))})
    replayed = entered.select(
        *keys, F.inline(F.arrays_zip(F.col("_packets"), _replay_udf(rescan_packets, ttl)(
            "_packets", "left", "expiry", "scan").alias("_flags"))))
    return replayed.select(*keys, F.col("_packets.id").alias("id"),
                           from_epoch_micros(F.col("_packets.micros")).alias("ts"),
                           F.col("_flags.rescan").alias("rescan"), F.col("_flags.scan_id").alias("scan_id"))


def with_scan_verdicts(rescans: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Give every packet the verdict of its scan; (id, status) per scan."""
    scanned = verdicts.select(F.col("id").alias("scan_id"), "status")
    return rescans.join(scanned, "scan_id", "left").withColumn("status", F.coalesce("status", F.lit("allow")))
