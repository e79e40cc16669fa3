"""Row types of the tables the operators read and write."""

from __future__ import annotations

from pyspark.sql import types as T

RULE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("match_type", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("priority", T.IntegerType()),
    T.StructField("enabled", T.BooleanType()),
    T.StructField("description", T.StringType()),
    T.StructField("hits24h", T.LongType()),
    T.StructField("updated", T.StringType()),
])

RULES_FILE = T.StructType([T.StructField("rules", T.ArrayType(RULE))])

# A rule table is RULE plus the position in its file, which breaks ties.
RULE_TABLE = T.StructType(RULE.fields + [T.StructField("seq", T.IntegerType())])

TRAFFIC = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("source_ip", T.StringType()),
    T.StructField("destination_ip", T.StringType()),
    T.StructField("port", T.StringType()),
    T.StructField("proto", T.StringType()),
    T.StructField("content_type", T.StringType()),
    T.StructField("text_content", T.StringType()),
    T.StructField("payload", T.BinaryType()),
])

CONNECTION_EVENT = T.StructType([
    T.StructField(name, T.StringType())
    for name in ("source_ip", "destination_ip", "port", "status", "risk_level",
                 "reason", "rule", "proto", "bytes")
])

# Long form of detector output: one row per (event, module).
MODULE_SCORE = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("module", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("findings", T.ArrayType(T.StringType())),
])
