"""Sources: traffic, rules, allowlists, connection events and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom import fixed_values as fv
from packetloom.functions.events import normal_status
from packetloom.operators.allowlist import clean_hosts
from packetloom.schemas import CONNECTION_EVENT, RULES_FILE, TRAFFIC


def normal_traffic(raw: DataFrame) -> DataFrame:
    """Traffic rows with every missing field replaced by its default."""
    defaults = {"source_ip": "unknown", "destination_ip": "unknown", "port": "", "proto": "TCP",
                "content_type": "unknown", "text_content": ""}
    kinds = {f.name: f.dataType for f in TRAFFIC.fields}
    return raw.select(*[
        (F.coalesce(F.col(n), F.lit(defaults[n])) if n in defaults and n in raw.columns
         else F.lit(defaults[n]) if n in defaults
         else F.col(n) if n in raw.columns else F.lit(None)).cast(kinds[n]).alias(n)
        for n in kinds])


def read_traffic(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return normal_traffic(spark.read.schema(TRAFFIC).format(fmt).load(path))


def stream_traffic(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return normal_traffic(spark.readStream.schema(TRAFFIC).format(fmt).load(path))


def parse_rules(configs: DataFrame, text: str, *keep: str) -> DataFrame:
    """Rules of JSON documents ``{"rules": [...]}`` with defaults and position.

    Unknown fields are dropped; a document that cannot be read has no rules.
    """
    parsed = configs.select(*keep, F.from_json(text, RULES_FILE).alias("c"))
    return _rule_defaults(parsed.select(*keep, F.posexplode("c.rules").alias("seq", "r")), *keep)


def _rule_defaults(rules: DataFrame, *keep: str) -> DataFrame:
    return rules.select(
        *keep, "r.id", "r.action", "r.match_type", "r.value",
        F.coalesce("r.priority", F.lit(fv.DEFAULT_PRIORITY)).alias("priority"),
        F.coalesce("r.enabled", F.lit(True)).alias("enabled"),
        F.coalesce("r.description", F.lit("")).alias("description"),
        F.coalesce("r.hits24h", F.lit(0)).cast("long").alias("hits24h"),
        F.coalesce("r.updated", F.lit("")).alias("updated"), "seq")


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rule table of one JSON file."""
    files = spark.read.schema(RULES_FILE).json(path, multiLine=True)
    return _rule_defaults(files.select(F.posexplode("rules").alias("seq", "r")))


def parse_allowlist(configs: DataFrame, text: str, *keep: str) -> DataFrame:
    """Hosts of JSON documents ``{"hosts": [...]}``; only non-blank strings."""
    listed = configs.select(*keep, F.explode(F.from_json(F.get_json_object(text, "$.hosts"), "array<variant>")).alias("v"))
    return listed.filter(F.schema_of_variant("v") == "STRING") \
        .select(*keep, clean_hosts(F.try_variant_get("v", "$", "string")).alias("host")).filter("host <> ''")


def read_allowlist(spark: SparkSession, path: str) -> DataFrame:
    return parse_allowlist(spark.read.text(path, wholetext=True), "value")


def parse_connections(raw: DataFrame, text: str, *keep: str) -> DataFrame:
    """Connection events of JSON texts with a default for every key."""
    defaults = {"source_ip": "unknown", "destination_ip": "unknown", "port": "", "risk_level": "safe",
                "reason": "connection observed", "rule": "PROXY", "proto": "TCP", "bytes": fv.NO_BYTES}
    event = F.from_json(text, CONNECTION_EVENT)
    rows = raw.select(*keep, event.alias("e"))

    def field(name: str) -> Column:
        return F.coalesce(F.col("e")[name], F.lit(defaults[name])).alias(name)

    return rows.select(*keep, *[field(n) for n in ("source_ip", "destination_ip", "port")],
                       normal_status(F.coalesce(F.col("e")["status"], F.lit("allow"))).alias("status"),
                       *[field(n) for n in ("risk_level", "reason", "rule", "proto", "bytes")])


def connection_reason(is_tls: Column) -> Column:
    return F.when(is_tls, "HTTPS connection").otherwise("HTTP connection")


def read_files(spark: SparkSession, path: str, glob: str = "*", with_content: bool = True) -> DataFrame:
    """(name, length, modified, content) of files; content only if asked for."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    columns = [F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "length", F.col("modificationTime").alias("modified")]
    return files.select(*columns, *(["content"] if with_content else []))
