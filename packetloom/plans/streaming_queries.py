"""Streaming jobs run over a table until it is exhausted."""

from pyspark.sql import functions as F

from packetloom import fixed_values as fv
from packetloom.functions.events import log_level
from packetloom.functions.network import http_message
from packetloom.operators.rules import match_rules
from packetloom.plans import sql_parts as sp
from packetloom.plans.payload_queries import REASSEMBLY_SQL
from packetloom.plans.registry import ORACLES, query
from packetloom.plans.verdict_queries import RESCAN_SQL, VERDICT_SQL, image_verdicts
from packetloom.session import scratch_path
from packetloom.sources import derived as dv
from packetloom.sources.rule_store import change_rules, publish_rules
from packetloom.streaming import jobs
from packetloom.streaming.sinks import latest_update, read_batches, start_batches, start_log, start_threats


def _run(spark, stream, name, mode="append", start=start_batches, **options):
    """Run a stream to the end of its input and read back what it wrote."""
    path = scratch_path(spark, name)
    arguments = {} if start is start_log else {"mode": mode}
    start(stream, f"{path}/out", f"{path}/checkpoint", **arguments, **options).awaitTermination()
    return read_batches(spark, f"{path}/out")


@query("stream_inspect", f"""WITH {VERDICT_SQL} SELECT id, CASE status WHEN 'block' THEN 'BLOCK' ELSE 'ALLOW' END AS level, source_ip AS src,
  destination_ip AS dst, rule_label AS rule, status, risk_level, reason FROM tv""")
def stream_inspect(spark, sf):
    verdicts = jobs.stream_verdicts(dv.traffic(spark, sf, stream=True), dv.rules(spark), image_verdicts(spark, sf))
    log = _run(spark, verdicts, "stream-log", start=start_log)
    return log.select("id", "level", "src", "dst", "rule", "status", "risk_level", "reason")


# Events come in four parts; these rules are switched before the part of the number.
_SWITCHED = [("dom-ex", 1), ("port-21", 2), ("kw-off", 3), ("dom-ex", 3)]
_PARTS = 4
_IN_FORCE = "(VALUES " + ", ".join(
    f"({part}, '{i}', '{a}', '{m}', '{v}', {p}, {n})" for part in range(_PARTS) for n, (i, a, m, v, p, on) in enumerate(dv.RULES)
    if on ^ (sum(name == i and at <= part for name, at in _SWITCHED) % 2 == 1)) + ")"


@query("stream_live_rules", f"""WITH {sp.EVENTS}, x AS (SELECT *, reason AS text_content, event_id % {_PARTS} AS part FROM e),
  r(part, id, action, match_type, value, priority, seq) AS {_IN_FORCE},
  m AS (SELECT x.id AS eid, r.id AS rule_id, r.action, row_number() OVER (PARTITION BY x.id ORDER BY r.priority, r.seq) AS nth
    FROM x JOIN r ON r.part = x.part AND {sp.RULE_TEST})
  SELECT x.id, rule_id, action AS status, CAST(part + 1 AS INT) AS rule_version FROM x LEFT JOIN m ON eid = id AND nth = 1""")
def stream_live_rules(spark, sf):
    path = scratch_path(spark, "live-rules")
    events = dv.events_x(spark, sf).select("id", "source_ip", "destination_ip", "port", F.col("reason").alias("text_content"))
    publish_rules(dv.rules(spark), f"{path}/rules")

    def judge(rows, rules):
        matched = match_rules(rows, rules)
        return matched.select("id", F.col("rule.id").alias("rule_id"), F.col("rule.action").alias("status"))

    for part in range(_PARTS):
        switched = [(n, "toggle", name) for n, (name, at) in enumerate(_SWITCHED) if at == part]
        if switched:
            toggles = spark.createDataFrame(switched, "change_ts long, op string, id string").selectExpr(
                "*", *(f"CAST(null AS {kind}) AS {name}" for name, kind in (
                    ("action", "string"), ("match_type", "string"), ("value", "string"), ("priority", "int"), ("enabled", "boolean"), ("description", "string"))))
            change_rules(toggles, f"{path}/rules")
        events.filter(F.col("id") % _PARTS == part).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{path}/in")
        jobs.start_live_verdicts(stream, f"{path}/rules", f"{path}/out", f"{path}/checkpoint", judge).awaitTermination()
    return read_batches(spark, f"{path}/out").select("id", "rule_id", "status", "rule_version")


@query("stream_threats", f"""WITH {sp.EVENTS}, {sp.LOG} SELECT printf('T-%05d', row_number() OVER (ORDER BY id % {_PARTS}, ts, id)) AS threat_id, id AS event_id,
  {sp.threat('severity')} AS severity, {sp.threat('type')} AS type FROM l WHERE level = 'BLOCK'""")
def stream_threats(spark, sf):
    """Four appends to one sink, in turn by two streams."""
    path = scratch_path(spark, "stream-threats")
    verdicts = dv.events_x(spark, sf).select("id", "ts", "source_ip", "destination_ip", "proto", "status", F.lit("high").alias("risk_level"), "reason")
    for part in range(_PARTS):
        name = f"{path}/in-{part % 2}"
        verdicts.filter(F.col("id") % _PARTS == part).write.mode("append").parquet(name)
        stream = spark.readStream.schema(verdicts.schema).parquet(name)
        start_threats(stream, f"{path}/threats", f"{path}/checkpoint-{part % 2}").awaitTermination()
    return spark.read.parquet(f"{path}/threats").select("threat_id", "event_id", "severity", "type")


@query("stream_live_series", ORACLES["series_48"])
def stream_live_series(spark, sf):
    log = dv.events_x(spark, sf, stream=True).select("ts", "id", log_level(F.col("status")).alias("level"), F.col("value").alias("ms"))
    points = latest_update(_run(spark, jobs.stream_live_series(log), "live-series", "update").drop("key"), "bucket")
    newest = points.agg(F.max("bucket")).first()[0]
    return points.filter(F.col("bucket") > (newest or 0) - fv.SERIES_POINTS * fv.SERIES_SECONDS)


@query("stream_flow_cache", f"WITH {RESCAN_SQL} SELECT k, id, rescan, scan_id FROM st")
def stream_flow_cache(spark, sf):
    return _run(spark, jobs.stream_flow_cache(dv.flow_packets(spark, sf, stream=True), ("k",)), "stream-cache").select("k", "id", "rescan", "scan_id")


@query("stream_flow_stats", ORACLES["flow_table"])
def stream_flow_stats(spark, sf):
    from packetloom.operators.flows import FLOW, zero_ports
    updates = _run(spark, jobs.stream_flow_totals(zero_ports(dv.packets(spark, sf, stream=True))), "stream-flows", "update")
    return latest_update(updates, *FLOW)


@query("stream_series", ORACLES["bucket_counts"])
def stream_series(spark, sf):
    log = dv.events_x(spark, sf, stream=True).select(F.col("ts").cast("timestamp").alias("ts"), log_level(F.col("status")).alias("level"))
    return latest_update(_run(spark, jobs.stream_series(log), "stream-series", "update"), "bucket")


@query("stream_reassembly", REASSEMBLY_SQL)
def stream_reassembly(spark, sf):
    messages = _run(spark, jobs.stream_reassembly(dv.chunks(spark, sf, stream=True)), "stream-http").withColumn("m", http_message(F.col("data")))
    return messages.select("conn_id", "direction", "message", F.element_at("m.headers", "host").alias("host"), "m.content_length",
                           F.col("m.body").cast("string").alias("body"), "flushed")
