"""HTTP messages from the chunks of a connection.

A message ends at the chunk with which its body reaches the announced length;
the next chunk starts a new message. Header lines are looked for in the chunk
that holds the blank line; chunks before it belong to the message but not to
its body. A message of which more than the buffer limit had to be held back is
marked as flushed; its body is kept all the same.

A connection may be very long, so its chunks are cut into runs of ``run``
chunks. What enters a run is one number, the body bytes still missing. Each
run states what leaves it for every such number (a short step function), the
steps are chained per connection, and each run is then marked on its own.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from packetloom import fixed_values as fv
from packetloom.functions.network import http_message
from packetloom.functions.payload import as_latin1
from packetloom.session import cut_lineage

KEY = ("conn_id", "direction")
RUN = 65_536


def missing_after_header(data: Column) -> Column:
    """Body bytes missing after a chunk with a blank line, -1 without one."""
    cut = F.instr(as_latin1(data), "\r\n\r\n")
    tail = F.octet_length(data) - cut - 3
    missing = F.greatest(F.lit(0).cast("bigint"), http_message(data)["content_length"] - tail)
    return F.when(cut > 0, missing).otherwise(F.lit(-1).cast("bigint"))


def _runs(packed: pa.Array):
    """(end offset of every chunk, header positions, missing bytes) per run."""
    flat = packed.flatten()
    sizes = flat.field(1).to_numpy(zero_copy_only=False)
    missing = flat.field(2).to_numpy(zero_copy_only=False)
    stops = np.cumsum(packed.value_lengths().to_numpy(zero_copy_only=False))
    for start, stop in zip(np.concatenate([[0], stops[:-1]]), stops):
        yield np.cumsum(sizes[start:stop]), np.flatnonzero(missing[start:stop] >= 0), missing[start:stop]


def _end_of(ends: np.ndarray, header: int, missing: np.ndarray) -> int:
    """Chunk with which the message of a header chunk is complete."""
    if missing[header] == 0:
        return header
    return int(np.searchsorted(ends, ends[header] + missing[header], side="left"))


def _steps(ends: np.ndarray, headers: np.ndarray, missing: np.ndarray) -> tuple[list[int], list[int]]:
    """Step function: entering with up to limits[i] missing bytes leaves leaving[i]."""
    leaving = [0] * len(headers)
    for i in range(len(headers) - 1, -1, -1):
        end = _end_of(ends, headers[i], missing)
        if end >= len(ends):
            leaving[i] = int(ends[headers[i]] + missing[headers[i]] - ends[-1])
        else:
            following = int(np.searchsorted(headers, end + 1))
            leaving[i] = leaving[following] if following < len(headers) else 0
    limits = [int(ends[h - 1]) if h else 0 for h in headers]
    keep = [i for i in range(len(headers)) if i + 1 == len(headers) or leaving[i] != leaving[i + 1]]
    return [limits[i] for i in keep], [leaving[i] for i in keep]


def _summary_udf():
    @F.arrow_udf("struct<total: bigint, limits: array<bigint>, leaving: array<bigint>>")
    def summarise(packed: pa.Array) -> pa.Array:
        rows = []
        for ends, headers, missing in _runs(packed):
            limits, leaving = _steps(ends, headers, missing)
            rows.append({"total": int(ends[-1]), "limits": limits, "leaving": leaving})
        return pa.array(rows, pa.struct([("total", pa.int64()), ("limits", pa.list_(pa.int64())), ("leaving", pa.list_(pa.int64()))]))
    return summarise


def _mark_udf():
    @F.arrow_udf("array<struct<number: int, live: boolean, last: boolean>>")
    def mark(packed: pa.Array, entering: pa.Array) -> pa.Array:
        numbers, lives, lasts, lengths = [], [], [], []
        for (ends, headers, missing), open_bytes in zip(_runs(packed), entering.to_pylist()):
            n = len(ends)
            live, last = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
            start = 0
            if open_bytes:
                end = int(np.searchsorted(ends, open_bytes, side="left"))
                live[:end + 1] = True
                last[end:end + 1] = True
                start = end + 1
            while (at := int(np.searchsorted(headers, start))) < len(headers):
                end = _end_of(ends, headers[at], missing)
                live[headers[at]:end + 1] = True
                last[end:end + 1] = True
                start = end + 1
            numbers.append(np.concatenate([[0], np.cumsum(last)[:-1]]))
            lives.append(live)
            lasts.append(last)
            lengths.append(n)
        flat = pa.StructArray.from_arrays(
            [pa.array(np.concatenate(numbers) if numbers else [], pa.int32()), pa.array(np.concatenate(lives) if lives else [], pa.bool_()),
             pa.array(np.concatenate(lasts) if lasts else [], pa.bool_())], names=["number", "live", "last"])
        return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32), flat)
    return mark


def _chain(batches):
    """Task: body bytes missing before each run, from the summaries in order of connection and run."""
    connection, missing = None, 0
    for batch in batches:
        entering = []
        for row in batch.to_pylist():
            key = tuple(row[k] for k in KEY)
            if key != connection:
                connection, missing = key, 0
            entering.append(missing)
            step = bisect.bisect_left(row["limits"], missing)
            missing = missing - row["total"] if missing > row["total"] else row["leaving"][step] if step < len(row["leaving"]) else 0
        yield pa.RecordBatch.from_arrays([batch.column(n) for n in (*KEY, "_run")] + [pa.array(entering, pa.int64())],
                                         names=[*KEY, "_run", "_entering"])


def mark_chunks(chunks: DataFrame, run: int = RUN) -> DataFrame:
    """(key, seq, size, message, live, last) for chunks (key, seq, data).

    ``message`` numbers the messages of a connection and direction, ``live``
    chunks carry its header or body, ``last`` completes it.
    """
    facts = chunks.select(*KEY, "seq", F.octet_length("data").cast("bigint").alias("size"), missing_after_header(F.col("data")).alias("missing"))
    runs = facts.groupBy(*KEY, F.floor(F.col("seq") / F.lit(run)).alias("_run")) \
        .agg(F.array_sort(F.collect_list(F.struct("seq", "size", "missing"))).alias("_chunks"))
    summaries = runs.select(*KEY, "_run", _summary_udf()("_chunks").alias("s")).select(*KEY, "_run", "s.*")
    entries = summaries.repartition(*KEY).sortWithinPartitions(*KEY, "_run").mapInArrow(
        _chain, "conn_id bigint, direction string, _run bigint, _entering bigint")
    # A few bytes per chunk, read several times below.
    marked = cut_lineage(runs.join(entries, [*KEY, "_run"]).withColumn("_marks", _mark_udf()("_chunks", "_entering")))
    # One narrow row per run: messages completed in the runs before it.
    order = W.partitionBy(*KEY).orderBy("_run")
    done = marked.select(*KEY, "_run", F.size(F.filter("_marks", lambda m: m["last"])).alias("_n")) \
        .select(*KEY, "_run", (F.sum("_n").over(order) - F.col("_n")).alias("_before"))
    rows = marked.join(done, [*KEY, "_run"]).select(*KEY, "_before", F.inline(F.arrays_zip("_chunks", "_marks")))
    return rows.select(*KEY, F.col("_chunks.seq").alias("seq"), F.col("_chunks.size").alias("size"),
                       (F.col("_before") + F.col("_marks.number")).alias("message"),
                       F.col("_marks.live").alias("live"), F.col("_marks.last").alias("last"))


def reassemble(chunks: DataFrame, run: int = RUN, limit: int = fv.BUFFER_LIMIT_BYTES) -> DataFrame:
    """Complete messages (key, message, first_seq, last_seq, flushed, data).

    ``data`` is header chunk plus body. ``flushed`` marks messages of which
    more than ``limit`` bytes were held back before the last chunk.
    """
    marks = mark_chunks(chunks, run)
    messages = marks.groupBy(*KEY, "message").agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.max("last").alias("complete"),
        (F.coalesce(F.sum(F.when(~F.col("last"), F.col("size"))), F.lit(0)) > limit).alias("flushed")) \
        .filter("complete").drop("complete")
    # Chunks of messages that never end are not collected.
    parts = marks.filter("live").join(chunks.select(*KEY, "seq", "data"), [*KEY, "seq"]).join(
        messages.select(*KEY, "message"), [*KEY, "message"], "left_semi")
    ordered = F.array_sort(F.collect_list(F.struct("seq", F.col("data").cast("string").alias("data"))))
    bodies = parts.groupBy(*KEY, "message").agg(
        F.array_join(F.transform(ordered, lambda p: p["data"]), "").cast("binary").alias("data"))
    return messages.join(bodies, [*KEY, "message"], "left")
