"""Allowlisted hosts: matching, pinned-TLS blocks and list changes."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.functions.strings import glob_literal, glob_to_regex, strip
from packetloom.operators.rules import anchored_texts, filed_by_anchor
from packetloom.session import rows_if_small

_GLOB = r"[*?\[]"
# A glob that is "*." followed by plain text is answered by host suffixes.
_SUFFIX_GLOB = r"^\*\.[^*?\[]*$"
LITERAL_LIMIT = 2_000


def clean_hosts(hosts: Column) -> Column:
    return F.lower(strip(hosts))


def dot_suffixes(host: Column) -> Column:
    """All ends of a host that begin with a dot: a.b.c -> .b.c, .c"""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(2), F.greatest(F.size(labels), F.lit(2))), lambda i: F.concat(
        F.lit("."), F.array_join(F.slice(labels, i, F.size(labels)), ".")))


def host_allowed(host: Column, patterns: list[str]) -> Column:
    """Condition for a short list of hosts and globs; needs no join."""
    low = F.lower(strip(host))
    plain = [p for p in patterns]
    suffixes = [p[1:] for p in patterns if p.startswith("*.") and not any(c in p[1:] for c in "*?[")]
    globs = [p for p in patterns if any(c in p for c in "*?[") and p[1:] not in suffixes]
    test = low.isin(*plain) if plain else F.lit(False)
    if suffixes:
        test = test | (F.contains(low, F.lit(".")) & F.exists(dot_suffixes(low), lambda s: s.isin(*suffixes)))
    if globs:
        test = test | F.rlike(low, F.lit("|".join(f"(?:{glob_to_regex(g)})" for g in globs)))
    return F.coalesce((low != "") & test, F.lit(False))


@F.arrow_udf(T.StructType([T.StructField("literal", T.StringType()), T.StructField("regex", T.StringType())]))
def _glob_parts(globs: pa.Array) -> pa.Array:
    """What every match of a glob holds, and its regex."""
    globs = globs.to_pylist()
    return pa.StructArray.from_arrays([pa.array([glob_literal(g) for g in globs], pa.string()),
                                       pa.array([glob_to_regex(g) for g in globs], pa.string())], names=["literal", "regex"])


def _allowed_by_glob(names: DataFrame, globs: DataFrame) -> DataFrame:
    """The ``names`` (_h) that match one of ``globs`` (_p), for any number of globs.

    A glob is filed under the rarest characters of its longest literal piece.
    A host meets only the globs whose anchor it holds, and their regexes are
    tested after the join. Globs without a literal piece meet every host.
    """
    parts = globs.select(_glob_parts("_p").alias("_parts"))
    filed = filed_by_anchor(parts.select(F.col("_parts.literal").alias("_v"), F.col("_parts.regex").alias("_rank")))
    once = names.select(F.col("_h").alias("_text"), F.md5("_h").alias("_hash"))
    pairs = anchored_texts(once, filed).join(filed, "_key").select("_hash", F.col("_rank").alias("_regex"))
    return pairs.join(once, "_hash").filter(F.rlike("_text", F.col("_regex"))).select(F.col("_text").alias("_h"))


def _allowed_by_join(df: DataFrame, host: str, hosts: DataFrame) -> DataFrame:
    """Same answer for a list of any size.

    Events are first reduced to distinct hosts, so a popular host costs one
    row. Names and suffix globs are equality joins; the remaining globs are
    joined by an index of their literal pieces.
    """
    listed = hosts.select(F.col("host").alias("_p")).filter("_p IS NOT NULL").distinct()
    names = df.select(F.lower(strip(F.col(host))).alias("_h")).filter("_h <> ''").distinct()
    exact = names.join(listed, F.col("_h") == F.col("_p"), "left_semi")
    suffix = listed.filter(F.rlike("_p", F.lit(_SUFFIX_GLOB))).select(F.expr("substring(_p, 2)").alias("_s"))
    by_suffix = names.filter(F.contains("_h", F.lit("."))).select("_h", F.explode(dot_suffixes(F.col("_h"))).alias("_s")) \
        .join(suffix, "_s", "left_semi").select("_h")
    odd = listed.filter(F.rlike("_p", F.lit(_GLOB)) & ~F.rlike("_p", F.lit(_SUFFIX_GLOB)))
    allowed = exact.union(by_suffix).union(_allowed_by_glob(names, odd)).distinct().withColumn("_ok", F.lit(True))
    return df.withColumn("_h", F.lower(strip(F.col(host)))).join(allowed, "_h", "left") \
        .withColumn("allowed", F.coalesce("_ok", F.lit(False))).drop("_h", "_ok")


def with_allowed(df: DataFrame, host: str, hosts: DataFrame, literal_limit: int = LITERAL_LIMIT) -> DataFrame:
    """Add ``allowed``: the host is listed or matches a listed glob."""
    rows = rows_if_small(hosts.select("host"), literal_limit)
    if rows is None:
        return _allowed_by_join(df, host, hosts)
    return df.withColumn("allowed", host_allowed(F.col(host), [r["host"] for r in rows]))


def bypass_inspection(df: DataFrame, hosts: DataFrame) -> DataFrame:
    """TLS events that skip inspection; needs columns host and is_tls."""
    return with_allowed(df, "host", hosts).filter("is_tls and allowed").drop("allowed")


def pinned_tls_blocks(handshakes: DataFrame, hosts: DataFrame) -> DataFrame:
    """Block events for failed handshakes of hosts that are not allowlisted.

    ``handshakes`` has (source_ip, destination_ip, host, port, error); error
    is null when the handshake worked.
    """
    failed = with_allowed(handshakes.filter(F.col("error").isNotNull()), "host", hosts).filter("not allowed")
    destination = F.coalesce(F.nullif("host", F.lit("")), "destination_ip")
    return failed.drop("allowed").withColumns({
        "destination_ip": destination, "status": F.lit("block"), "risk_level": F.lit("high"),
        "rule": F.lit("PINNED-TLS"), "proto": F.lit("TCP"),
        "reason": F.concat(F.lit("Client rejected MITM cert ("), "error", F.lit(") — add host to allowlist to bypass")),
    })


def apply_allowlist_changes(base: DataFrame, changes: DataFrame) -> DataFrame:
    """Hosts after a log of (change_ts, op, host) with op add or remove.

    Only the latest change of a host counts; adding twice has no effect.
    """
    log = changes.select(clean_hosts(F.col("host")).alias("host"), "op", "change_ts").filter("host <> ''")
    last = log.groupBy("host").agg(F.max_by("op", "change_ts").alias("op"))
    both = base.select("host", F.lit(True).alias("listed")).distinct().join(last, "host", "full")
    return both.filter("op = 'add' or (op is null and listed)").select("host")
