"""URL filtering by a sort-merge range join.

A host's key is its labels in reverse, each ended by a dot, so the hosts a
rule covers are one interval of keys and intervals of rules are nested or
apart. URLs are range-partitioned and sorted by (key, path). Every rule is
filed with the partitions that its interval touches: one, plus one for every
partition border inside it, and a border lies inside at most as many rule
hosts as it has labels. A sorted pass over rules and URLs of a partition then
keeps a stack of the rule hosts that enclose the current key, and within a
host a stack of the rule paths that are prefixes of the current path. A hot
host is spread over many partitions by path and page id.

Among the rules that fit, the longest wins (characters of host and path, then
of the host, then the greater text).

Defined cases: a null url or one without ``://`` has empty host and path and
gets the default verdict unless a rule has an empty host and path; repeated
rows are judged each for itself; of equal rules the one with the greater
verdict text holds; empty tables are fine; only the named columns are read.
"""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.session import cut_lineage

DEFAULT_VERDICT = "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = "://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def host_key(host: Column) -> Column:
    """``www.example.com`` as ``com.example.www.``"""
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.", -1)), "."), F.lit("."))


class _Sweep:
    """State of the sorted pass: enclosing rule hosts, and enclosing paths of the current host."""

    def __init__(self) -> None:
        self.part = self.key = None
        self.hosts: list[tuple[str, list]] = []
        self.active: list = []
        self.paths: list = []
        self.next = 0

    def move(self, part: int, key: str) -> None:
        if part != self.part:
            self.part, self.hosts = part, []
        while self.hosts and not key.startswith(self.hosts[-1][0]):
            self.hosts.pop()
        self.key = None

    def rule(self, part: int, key: str, rule: tuple) -> None:
        self.move(part, key)
        if not self.hosts or self.hosts[-1][0] != key:
            self.hosts.append((key, []))
        self.hosts[-1][1].append(rule)

    def url(self, part: int, key: str, path: str) -> tuple | None:
        if part != self.part or key != self.key:
            self.move(part, key)
            self.key = key
            self.active = sorted((r for _, rules in self.hosts for r in rules), key=lambda r: (r[0].encode(), r[1]))
            self.paths, self.next = [], 0
        raw = path.encode()
        while self.next < len(self.active) and self.active[self.next][0].encode() <= raw:
            rule = self.active[self.next]
            while self.paths and not rule[0].startswith(self.paths[-1][0]):
                self.paths.pop()
            best = max(self.paths[-1][1], rule, key=lambda r: r[1]) if self.paths else rule
            self.paths.append((rule[0], best))
            self.next += 1
        while self.paths and not path.startswith(self.paths[-1][0]):
            self.paths.pop()
        return self.paths[-1][1] if self.paths else None


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT,
                page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict of every row; rules have host, path, verdict."""
    spark = pages.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    urls = pages.select(F.col(page_id).alias("page_id"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    urls = urls.withColumn("key", host_key(F.col("host")))
    urls = cut_lineage(urls.repartitionByRange(parts, "key", "path", F.xxhash64("page_id")).withColumn(
        "part", F.spark_partition_id()))
    # One row per partition of the sorted table.
    ends = sorted((r.low.encode(), r.high.encode(), r.part) for r in urls.groupBy("part").agg(
        F.min("key").alias("low"), F.max("key").alias("high")).collect())
    lows, highs, numbers = [e[0] for e in ends], [e[1] for e in ends], [e[2] for e in ends]

    def file(batches):
        for batch in batches:
            at, to = [], []
            for i, key in enumerate(batch.column("key").to_pylist()):
                for p in range(bisect.bisect_left(highs, key.encode()), bisect.bisect_right(lows, key.encode() + b"\xff")):
                    at.append(i)
                    to.append(numbers[p])
            taken = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), *taken.columns], names=["part", *taken.schema.names])

    known = rules.select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").filter(
        "host IS NOT NULL").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    filed = known.select(host_key(F.col("host")).alias("key"), "path", "host", "verdict").mapInArrow(
        file, "part int, key string, path string, host string, verdict string")
    kind = pages.schema[page_id].dataType.simpleString()
    rows = filed.select("part", "key", F.lit(0).alias("kind"), "path", F.lit(None).cast(kind).alias("page_id"), "host", "verdict").unionByName(
        urls.select("part", "key", F.lit(1).alias("kind"), "path", "page_id", "host", F.lit(None).cast("string").alias("verdict")))
    rows = rows.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "key", "kind", "path")

    def sweep(batches):
        state = _Sweep()
        for batch in batches:
            part, key, kinds, path, _, host, verdict = (c.to_pylist() for c in batch.columns)
            at, rule, result = [], [], []
            for i in range(len(part)):
                if kinds[i] == 0:
                    text = host[i] + path[i]
                    state.rule(part[i], key[i], (path[i], (len(text), len(host[i]), text), verdict[i]))
                else:
                    found = state.url(part[i], key[i], path[i])
                    at.append(i)
                    rule.append(found[1][2] if found else None)
                    result.append(found[2] if found else default)
            taken = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [taken.column("page_id"), taken.column("host"), taken.column("path"),
                 pa.array(rule, pa.string()), pa.array(result, pa.string())],
                names=["page_id", "host", "path", "rule", "verdict"])

    return rows.mapInArrow(sweep, f"page_id {kind}, host string, path string, rule string, verdict string")
