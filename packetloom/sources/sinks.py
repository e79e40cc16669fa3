"""Sinks: event log, threat feed and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.operators.rules import union_all
from packetloom.operators.telemetry import number_blocked, threat_rows
from packetloom.sources.commit_log import create_entry, numbers, read_entry


def append_by_day(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append rows partitioned by the day of ``ts``.

    Rows are rebalanced by day first: a small day gives one file, a large day
    is split over several tasks.
    """
    dated = df.withColumn("day", F.to_date("ts"))
    dated.hint("rebalance", "day").write.mode("append").partitionBy("day").format(fmt).save(path)


def write_log(log: DataFrame, path: str) -> None:
    append_by_day(log, path)


def last_threat(spark: SparkSession, path: str) -> int:
    """Number of the last threat that was reserved for the sink, 0 before the first."""
    log = f"{path}/{_NUMBERS}"
    taken = numbers(spark, log)
    if not taken:
        return 0
    first, count, *_ = _reserved(read_entry(spark, log, taken[-1]))
    return first + count - 1


# Commit log of a sink: which numbers each append takes. Readers of the sink pass over it.
_NUMBERS = "_numbers"


def _reserved(entry: str) -> tuple[int, int, str, int]:
    """First number, how many, and the stream and batch that they are for (-1: none)."""
    first, count, batch, source = entry.split(" ", 3)
    return int(first), int(count), source, int(batch)


def _batch_entry(spark: SparkSession, log: str, source: str, batch: int) -> tuple[int, int, int] | None:
    """Entry, first number and count of a batch that was numbered before.

    A stream writes its batches in order, so looking back ends at its batch before.
    """
    for entry in reversed(numbers(spark, log)):
        first, count, by, number = _reserved(read_entry(spark, log, entry))
        if by == source and number <= batch:
            return (entry, first, count) if number == batch else None
    return None


def write_threats(log: DataFrame, path: str, source: str = "", batch: int = -1) -> None:
    """Append the threats of a log; numbers go on where the last append ended.

    Numbers are reserved in a commit log beside the rows, which one writer at
    a time extends, so several writers get distinct numbers without gaps and
    the rows written before are not read. Every append has a folder of its
    own, named by its entry. A micro-batch, given by its stream's name
    (``source``) and number, that is replayed takes the numbers and the folder
    it had.
    """
    spark, entries = log.sparkSession, f"{path}/{_NUMBERS}"
    blocked = number_blocked(log)
    count = blocked.count()
    known = _batch_entry(spark, entries, source, batch) if batch >= 0 else None
    if known and known[2] != count:
        raise ValueError(f"batch {batch} of {source} had {known[2]} threats and now has {count}")
    while not known:
        taken, first = numbers(spark, entries), last_threat(spark, path) + 1
        entry = max(taken, default=0) + 1
        if create_entry(spark, entries, entry, f"{first} {count} {batch} {source}"):
            known = (entry, first, count)
    rows = threat_rows(blocked, known[1] - 1).withColumn("day", F.to_date("ts"))
    rows.hint("rebalance", "day").write.mode("overwrite").partitionBy("day").parquet(f"{path}/append={known[0]}")


def report_tables(log: DataFrame, uploads: DataFrame) -> dict[str, DataFrame]:
    """The downloadable reports by name."""
    day = F.to_date("ts").alias("day")
    blocked = log.filter("level = 'BLOCK'")
    return {
        "Rule Hit Report": log.groupBy(day, "rule").agg(F.count("*").alias("hits")),
        "Blocked Traffic Export": blocked.select(day, "id", "src", "dst", "rule", "reason"),
        "AI Intake Audit": uploads.groupBy(day, "status").agg(F.count("*").alias("files")),
        "Weekly Threat Summary": blocked.groupBy(F.to_date(F.date_trunc("week", "ts")).alias("day"), "risk_level")
        .agg(F.count("*").alias("blocks")),
    }


def report_index(log: DataFrame, uploads: DataFrame, as_of: Column) -> DataFrame:
    """(name, scope, period, size, status) of every report."""
    def row(counted: DataFrame, name: str, scope: str, period: Column | str, unit: str) -> DataFrame:
        size = F.concat(F.count("*").cast("string"), F.lit(f" {unit}"))
        period = F.lit(period) if isinstance(period, str) else period
        return counted.agg(size.alias("size")).select(F.lit(name).alias("name"), F.lit(scope).alias("scope"), period.alias("period"), "size",
                                                      F.lit("ready").alias("status"))

    week = F.concat(F.date_format(F.timestamp_add("DAY", F.lit(-7), as_of), "MMM dd"), F.lit(" – "), F.date_format(as_of, "MMM dd"))
    blocked = log.filter("level = 'BLOCK'")
    return union_all([
        row(blocked, "Weekly Threat Summary", "All gateways", week, "events"),
        row(log, "Rule Hit Report", "Static rules", "Last 24h", "rows"),
        row(blocked, "Blocked Traffic Export", "Blocked only", "Last 24h", "events"),
        row(uploads, "AI Intake Audit", "Uploads", "Session", "files"),
    ])


def export_reports(log: DataFrame, uploads: DataFrame, path: str, fmt: str = "parquet") -> dict[str, str]:
    """Write every report below ``path`` and return where each one is."""
    written = {}
    for name, table in report_tables(log, uploads).items():
        target = f"{path}/{name.lower().replace(' ', '_')}"
        table.hint("rebalance", "day").write.mode("overwrite").partitionBy("day").format(fmt).save(target)
        written[name] = target
    return written
