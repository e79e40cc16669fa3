"""Event log, threat feed, counters and time series."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from packetloom import fixed_values as fv
from packetloom.functions.events import classify_threat, first_filled, log_level, short_msg, source_region
from packetloom.functions.timestamps import bucket_start, epoch_micros
from packetloom.session import cut_lineage


# --- event log and threats ------------------------------------------------
def to_log(verdicts: DataFrame) -> DataFrame:
    """Log rows of (id, ts, source_ip, destination_ip, status, reason, ...)."""
    def given(name: str, default: str) -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in verdicts.columns else F.lit(default)

    return verdicts.select(
        "id", "ts", log_level(F.col("status")).alias("level"),
        F.col("source_ip").alias("src"), F.col("destination_ip").alias("dst"),
        given("proto", "TCP").alias("proto"), given("rule_label", "AI-ANALYSIS").alias("rule"),
        given("bytes", fv.NO_BYTES).alias("bytes"), F.lower("status").alias("status"),
        "risk_level", "reason", short_msg(F.col("reason")).alias("msg"))


def number_rows(df: DataFrame, name: str, *order: str) -> DataFrame:
    """Number all rows from 1 in a total order without one global task.

    Rows are range-partitioned and sorted, their partition and position are
    frozen by a checkpoint, and the sizes of the partitions (one row each)
    give the offsets.
    """
    placed = cut_lineage(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    # One row per partition of the sorted table, so its size is bounded.
    return placed.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(
        name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_part", "_at", "_before")


def number_blocked(log: DataFrame) -> DataFrame:
    """The blocked rows of a log, numbered ``n`` in log order."""
    return number_rows(log.filter("level = 'BLOCK'"), "n", "ts", "id")


def threat_rows(numbered: DataFrame, after: int = 0) -> DataFrame:
    """Threat rows of numbered blocked rows, from number ``after + 1`` on."""
    return numbered.withColumn("t", classify_threat(F.col("reason"))).select(
        F.format_string("T-%05d", F.col("n") + after).alias("threat_id"), F.col("id").alias("event_id"), "ts",
        F.col("t.severity").alias("severity"), F.col("t.type").alias("type"), "src",
        source_region(F.col("src")).alias("src_region"), "dst", "rule",
        F.lit("Blocked").alias("action"), F.col("t.confidence").alias("confidence"))


def to_threats(log: DataFrame, after: int = 0) -> DataFrame:
    """Threat rows of the blocked log rows, numbered in log order from ``after`` on."""
    return threat_rows(number_blocked(log), after)


def latest(df: DataFrame, n: int, ts: str = "ts", key: str = "id") -> DataFrame:
    """Newest ``n`` rows; a per-task top-k, not a full sort."""
    return df.orderBy(F.desc(ts), F.desc(key)).limit(n)


# --- views of the log -----------------------------------------------------
def normalise_log(rows: DataFrame) -> DataFrame:
    """Display rows; older names of a field are used when the new is empty."""
    def pick(*names: str, default: str) -> Column:
        return first_filled(*[F.col(n) for n in names], default)

    return rows.select(
        "id", pick("t", "timestamp", default="").alias("t"), pick("level", default="ALLOW").alias("level"),
        pick("src", "source", default="unknown").alias("src"), pick("dst", "destination", default="unknown").alias("dst"),
        pick("proto", default="TCP").alias("proto"), pick("rule", default="AI").alias("rule"),
        pick("bytes", default=fv.NO_BYTES).alias("bytes"), pick("msg", "reason", default="").alias("msg"))


def search_log(log: DataFrame, query: str = "", level: str = "All", with_proto: bool = False) -> DataFrame:
    """Rows of a level whose joined fields contain the query text."""
    fields = ["src", "dst", "msg", "rule"] + (["proto"] if with_proto else [])
    found = log if level == "All" else log.filter(F.col("level") == level)
    return found.filter(F.contains(F.lower(F.concat(*fields)), F.lit(query.lower()))) if query else found


def threats_of_severity(threats: DataFrame, severity: str = "All") -> DataFrame:
    return threats if severity == "All" else threats.filter(F.col("severity") == severity)


# --- counters -------------------------------------------------------------
def kpi_counters(log: DataFrame) -> DataFrame:
    blocked = F.count_if(F.col("level") == "BLOCK")
    total = F.count("*")
    return log.agg(total.alias("total"), (total - blocked).alias("allowed"), blocked.alias("blocked"), blocked.alias("threats"),
                   F.bround(F.greatest(F.lit(0.1), total / F.lit(60.0)), 2).alias("throughput"),
                   blocked.alias("blocked_24h"), (total - blocked).alias("active_sessions"))


def overview_kpis(log: DataFrame, latencies: DataFrame) -> DataFrame:
    """The headline numbers with the p95 of the last measured latencies."""
    recent = latest(latencies, fv.LATENCY_SAMPLES).withColumn("service", F.lit("all"))
    p95 = p95_latency(recent).select("p95").scalar()
    return kpi_counters(log).select("throughput", "blocked_24h", "active_sessions", F.coalesce(p95, F.lit(0.0)).alias("p95_latency"))


def top_counts(df: DataFrame, key: str, k: int, *extra: Column) -> DataFrame:
    """The k most frequent values; the value seen last wins a tie.

    Adds ``pct``: share of all rows with one decimal, ties to even. The total
    is a scalar subquery that reads no columns, so a key with many distinct
    values never meets in one task.
    """
    grouped = df.groupBy(key).agg(F.count("*").alias("hits"), F.max("ts").alias("_last"), *extra)
    total = df.agg(F.count("*").alias("total")).scalar()
    top = grouped.orderBy(F.desc("hits"), F.desc("_last"), key).limit(k).drop("_last")
    return top.withColumn("pct", F.bround(F.col("hits") * 100 / total, 1))


def protocol_breakdown(log: DataFrame, k: int = fv.PROTOCOL_ROWS) -> DataFrame:
    names = F.create_map(*[F.lit(x) for pair in fv.PROTOCOL_NAMES.items() for x in pair])
    return top_counts(log, "proto", k).select(
        F.coalesce(F.element_at(names, F.col("proto")), "proto").alias("name"), "pct",
        F.concat((F.col("hits") * 12).cast("string"), F.lit(" KB")).alias("bytes"))


def region_breakdown(log: DataFrame, k: int = fv.REGION_ROWS) -> DataFrame:
    blocked = F.max(F.col("level") == "BLOCK").alias("_blocked")
    rows = log.select("ts", "level", source_region(F.col("src")).alias("code"))
    return top_counts(rows, "code", k, blocked).select(
        "code", F.col("code").alias("name"), "pct", "hits",
        F.when(F.col("_blocked"), "block").otherwise("allow").alias("kind"))


def severity_counts(threats: DataFrame) -> DataFrame:
    return threats.agg(F.count_if(F.col("severity") == "critical").alias("critical"),
                       F.count_if(F.col("severity") == "high").alias("high"))


def level_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("level").agg(F.count("*").alias("rows"))


def intake_summary(uploads: DataFrame) -> DataFrame:
    return uploads.agg(F.count("*").alias("items"), F.count_if(F.col("status") == "indexed").alias("indexed"),
                       F.count_if(F.col("status") == "flagged").alias("flagged"))


def threats_by_category(threats: DataFrame, seconds: int = 3600) -> DataFrame:
    return threats.groupBy(bucket_start(F.col("ts"), seconds).alias("bucket"), "type").agg(F.count("*").alias("blocks"))


# --- latency --------------------------------------------------------------
def _p95_rank(n: Column) -> Column:
    return F.greatest(F.lit(1).cast("bigint"), F.floor(n * F.lit(fv.P95)).cast("bigint"))


def p95_latency(latencies: DataFrame) -> DataFrame:
    """(service, samples, p95) as an order statistic.

    Latencies are rounded to 0.1 ms first; the rank is found on the histogram
    of the rounded values, so no service is collected or sorted as a whole.
    """
    histogram = latencies.groupBy("service", F.bround("ms", 1).alias("ms")).agg(F.count("*").alias("n"))
    by_value = W.partitionBy("service").orderBy("ms")
    ranked = histogram.select("service", "ms", F.sum("n").over(by_value).alias("upto"),
                              F.sum("n").over(W.partitionBy("service")).alias("samples"))
    return ranked.filter(F.col("upto") >= _p95_rank(F.col("samples"))).groupBy("service", "samples").agg(F.min("ms").alias("p95"))


SLICE_ROWS = 100_000
_WINDOWS_AT_ONCE = 8192


def _sliding_p95(ms: np.ndarray, samples: int) -> np.ndarray:
    """p95 of the last ``samples`` values at each value; missing ones (NaN) do not count."""
    known = np.concatenate([np.zeros(samples, np.int64), np.cumsum(~np.isnan(ms))])
    rank = np.maximum(1, np.floor((known[samples:] - known[:-samples]) * fv.P95).astype(np.int64))
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(samples - 1, np.nan), ms]), samples)
    out = np.empty(len(ms))
    for at in range(0, len(ms), _WINDOWS_AT_ONCE):
        part, place = windows[at:at + _WINDOWS_AT_ONCE], rank[at:at + _WINDOWS_AT_ONCE] - 1
        # Missing values go last; nearly all windows are full and have the same rank.
        ordered = np.partition(part, np.unique(place), axis=1)
        out[at:at + len(part)] = ordered[np.arange(len(part)), place]
    return out


def rolling_p95(latencies: DataFrame, samples: int = fv.LATENCY_SAMPLES, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(service, id, ts, p95) of the last ``samples`` latencies at each row.

    All rows are numbered by service and time and cut into slices of equal
    numbers, so neither a busy service nor a burst makes a large slice. The
    last ``samples - 1`` rows of a slice also go to the next one. A task slides
    one window over a slice.
    """
    slice_rows = max(slice_rows, samples)
    rows = latencies.select("service", "id", "ts", F.bround("ms", 1).alias("ms"))
    numbered = number_rows(rows, "_n", "service", "ts", "id")
    own = F.floor((F.col("_n") - 1) / slice_rows)
    halo = (F.col("_n") - 1) % slice_rows >= slice_rows - (samples - 1)
    entry = lambda at, mine: F.struct(at.alias("_slice"), F.lit(mine).alias("_own"))
    dealt = numbered.select("*", F.inline(F.when(halo, F.array(entry(own, True), entry(own + 1, False))).otherwise(F.array(entry(own, True)))))

    def slide(table: pa.Table) -> pa.Table:
        table = table.sort_by("_n")
        service = table.column("service").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        ms = table.column("ms").to_numpy().astype(np.float64)
        edges = [0, *(np.nonzero(service[1:] != service[:-1])[0] + 1).tolist(), len(service)]
        p95 = np.concatenate([_sliding_p95(ms[a:b], samples) for a, b in zip(edges[:-1], edges[1:], strict=True)])
        out = table.select(["service", "id", "ts"]).append_column("p95", pa.array(p95, from_pandas=True))
        return out.filter(table.column("_own"))

    schema = T.StructType([rows.schema[n] for n in ("service", "id", "ts")] + [T.StructField("p95", T.DoubleType())])
    return dealt.groupBy("_slice").applyInArrow(slide, schema)


# --- time series ----------------------------------------------------------
def bucket_counts(log: DataFrame, seconds: int = fv.SERIES_SECONDS) -> DataFrame:
    """(bucket, events, blocked, allowed) per tumbling bucket."""
    return log.groupBy(bucket_start(F.col("ts"), seconds).alias("bucket")).agg(
        F.count("*").alias("events"), F.count_if(F.col("level") == "BLOCK").alias("blocked"),
        F.count_if(F.col("level") != "BLOCK").alias("allowed"))


def recent_series(log: DataFrame, points: int = fv.SERIES_POINTS, seconds: int = fv.SERIES_SECONDS,
                  latencies: DataFrame | None = None) -> DataFrame:
    """The last ``points`` buckets: events, blocked, sessions and latency.

    Everything before them is one group that only carries the number of
    sessions, so the log is read once and reduces to ``points + 1`` rows.
    """
    newest = log.agg(F.max(bucket_start(F.col("ts"), seconds)).alias("b")).first()["b"]
    if newest is None:
        return bucket_counts(log, seconds).limit(0).selectExpr(
            "bucket", "events throughput", "blocked", "allowed sessions", "0D latency")
    first = newest - (points - 1) * seconds
    bucket = F.greatest(bucket_start(F.col("ts"), seconds), F.lit(first - seconds))
    counts = log.groupBy(bucket.alias("bucket")).agg(
        F.count("*").alias("events"), F.count_if(F.col("level") == "BLOCK").alias("blocked"),
        F.count_if(F.col("level") != "BLOCK").alias("allowed"))
    spine = log.sparkSession.range(first - seconds, newest + 1, seconds).select(F.col("id").alias("bucket"))
    filled = spine.join(counts, "bucket", "left").na.fill(0, ["events", "blocked", "allowed"])
    series = filled.withColumn("sessions", F.sum("allowed").over(W.orderBy("bucket")))
    if latencies is None:
        series = series.withColumn("latency", F.lit(0.0))
    else:
        series = series.join(_latency_at(latencies, first, newest, seconds), "bucket", "left")
        series = series.withColumn("latency", F.coalesce(F.last("latency", ignorenulls=True).over(W.orderBy("bucket")), F.lit(0.0)))
    return series.filter(F.col("bucket") >= first).select("bucket", F.col("events").alias("throughput"), "blocked", "sessions", "latency")


def _latency_at(latencies: DataFrame, first: int, newest: int, seconds: int) -> DataFrame:
    """(bucket, latency): p95 of the last samples at the end of each bucket."""
    bucket = bucket_start(F.col("ts"), seconds)
    rows = latencies.withColumn("bucket", F.greatest(bucket, F.lit(first - seconds)))
    older = latest(rows.filter(F.col("bucket") < first), fv.LATENCY_SAMPLES)
    recent = rows.filter(F.col("bucket") >= first).unionByName(older)
    every = rolling_p95(recent.withColumn("service", F.lit("all")))
    return every.groupBy(F.greatest(bucket, F.lit(first - seconds)).alias("bucket")) \
        .agg(F.max_by("p95", F.struct("ts", "id")).alias("latency"))


def running_totals(buckets: DataFrame, columns: list[str], slice_seconds: int = 86_400) -> DataFrame:
    """Replace counts per bucket by running totals over all buckets.

    Two levels: totals per slice give the offsets, sums within a slice are
    windows of bounded size.
    """
    sliced = buckets.withColumn("_slice", F.col("bucket") - F.pmod("bucket", F.lit(slice_seconds)))
    order = W.orderBy("_slice")
    offsets = sliced.groupBy("_slice").agg(*[F.sum(c).alias(f"_{c}") for c in columns]) \
        .select("_slice", *[(F.sum(f"_{c}").over(order) - F.col(f"_{c}")).alias(f"_{c}") for c in columns])
    within = W.partitionBy("_slice").orderBy("bucket")
    return sliced.join(offsets, "_slice").withColumns(
        {c: F.sum(c).over(within) + F.col(f"_{c}") for c in columns}).drop("_slice", *[f"_{c}" for c in columns])


def deltas(samples: DataFrame, columns: list[str], slice_seconds: int = 86_400) -> DataFrame:
    """Growth of running totals since the sample before, at least 0."""
    sliced = samples.withColumn("_slice", F.col("bucket") - F.pmod("bucket", F.lit(slice_seconds)))
    order = W.orderBy("_slice")
    carried = sliced.groupBy("_slice").agg(*[F.max_by(c, "bucket").alias(f"_{c}") for c in columns]) \
        .select("_slice", *[F.lag(f"_{c}").over(order).alias(f"_{c}") for c in columns])
    within = W.partitionBy("_slice").orderBy("bucket")
    return sliced.join(carried, "_slice").withColumns({
        c: F.greatest(F.lit(0).cast("bigint"), F.col(c) - F.coalesce(F.lag(c).over(within), F.col(f"_{c}"), F.lit(0)))
        for c in columns}).drop("_slice", *[f"_{c}" for c in columns])


def latency_sampled(latencies: DataFrame, seconds: int = fv.SERIES_SECONDS) -> DataFrame:
    """(service, bucket, p95) at the last sample of every bucket."""
    return rolling_p95(latencies).groupBy("service", bucket_start(F.col("ts"), seconds).alias("bucket")) \
        .agg(F.max_by("p95", F.struct(epoch_micros(F.col("ts")), "id")).alias("p95"))
