"""Queries over the event log, threats, uploads, latencies and time series."""

from pyspark.sql import functions as F

from packetloom.functions import events as ev
from packetloom.functions.timestamps import age_text, epoch_micros
from packetloom.operators import telemetry as tm
from packetloom.operators.rules import union_all
from packetloom.plans import sql_parts as sp
from packetloom.plans.registry import query
from packetloom.session import scratch_path
from packetloom.sources import derived as dv
from packetloom.sources.sinks import export_reports, report_index, write_log, write_threats

_L = f"WITH {sp.EVENTS}, {sp.LOG}"
_T = f"{_L}, {sp.THREATS}"


@query("log_level", f"WITH {sp.EVENTS} SELECT id, {sp.LEVEL} AS level FROM e")
def log_level(spark, sf):
    return dv.events_x(spark, sf).select("id", ev.log_level(F.upper("status")).alias("level"))


@query("threat_classify", f"WITH {sp.EVENTS} SELECT id, {sp.threat('type')} AS type, {sp.threat('severity')} AS severity, {sp.threat('confidence')} AS confidence FROM e")
def threat_classify(spark, sf):
    return dv.events_x(spark, sf).select("id", ev.classify_threat(F.col("reason")).alias("t")).select("id", "t.*")


@query("source_region", f"""WITH {sp.EVENTS}, x AS (SELECT id, CASE id % 9 WHEN 0 THEN 'unknown' WHEN 1 THEN 'host.name' ELSE source_ip END AS ip FROM e)
  SELECT id, {sp.region('ip')} AS region FROM x""")
def source_region(spark, sf):
    ip = F.expr("CASE id % 9 WHEN 0 THEN 'unknown' WHEN 1 THEN 'host.name' ELSE source_ip END")
    return dv.events_x(spark, sf).select("id", ev.source_region(ip).alias("region"))


@query("short_msg", f"WITH {sp.DOCS} SELECT doc_id, left(trim(text, ' ' || chr(10) || chr(9) || chr(13)), 100) AS msg, left(trim(text, ' ' || chr(10) || chr(9) || chr(13)), 60) AS tag FROM d")
def short_msg(spark, sf):
    return dv.documents_x(spark, sf).select("doc_id", ev.short_msg(F.col("text")).alias("msg"), ev.short_msg(F.col("text"), 60).alias("tag"))


_NAME = """CASE id % 5 WHEN 0 THEN 'scan_' || CAST(id AS STRING) || '.PNG' WHEN 1 THEN 'report.final.docx' WHEN 2 THEN 'noext'
 WHEN 3 THEN 'a.jpeg' ELSE 'mail.eml.pdf' END"""
_UP_SQL = f"""u AS (SELECT id, ts, {_NAME} AS name, CAST(floor(value * 20480) AS BIGINT) AS size_bytes, status, trim(reason) AS reason,
  CASE WHEN status = 'block' THEN 'high' ELSE 'safe' END AS risk_level FROM e)"""


def _uploads(spark, sf):
    raw = dv.events_x(spark, sf).withColumns({
        "name": F.expr(_NAME), "size_bytes": F.floor(F.col("value") * 20480).cast("long"),
        "risk_level": F.when(F.col("status") == "block", "high").otherwise("safe")})
    return raw.select("id", "ts", "name", ev.upload_size(F.col("size_bytes")).alias("size"), ev.upload_type(F.col("name"), F.lit("DOC")).alias("type"),
                      ev.upload_status(F.col("status")).alias("status"), ev.upload_tags(F.col("risk_level"), F.col("reason")).alias("tags"))


@query("upload_record", f"""WITH {sp.EVENTS}, {_UP_SQL} SELECT id, name, CASE WHEN size_bytes > 1048576 THEN printf('%.1f', size_bytes / 1048576.0::DOUBLE) || ' MB'
  ELSE CAST(round_even(size_bytes / 1024.0::DOUBLE, 0) AS BIGINT) || ' KB' END AS size,
  CASE id % 5 WHEN 0 THEN 'PNG' WHEN 1 THEN 'DOCX' WHEN 2 THEN 'DOC' WHEN 3 THEN 'JPEG' ELSE 'PDF' END AS type,
  CASE status WHEN 'block' THEN 'flagged' WHEN 'allow' THEN 'indexed' ELSE 'analyzing' END AS status,
  'risk=' || risk_level || '|' || left(reason, 60) AS tags FROM u""")
def upload_record(spark, sf):
    return _uploads(spark, sf).select("id", "name", "size", "type", "status", F.array_join("tags", "|").alias("tags"))


@query("detect_upload_kind", f"""WITH {sp.EVENTS}, x AS (SELECT id, CASE id % 3 WHEN 0 THEN 'image/x' ELSE '' END AS mime, id % 5 AS k FROM e)
  SELECT id, CASE WHEN mime <> '' OR k IN (0, 3) THEN 'IMG' WHEN k = 1 THEN 'DOCX' WHEN k = 2 THEN 'NOEX' ELSE 'PDF' END AS kind,
  CASE WHEN mime <> '' OR k IN (0, 3) THEN 'image' ELSE 'document' END AS content_type FROM x""")
def detect_upload_kind(spark, sf):
    rows = dv.events_x(spark, sf).select("id", F.expr(_NAME).alias("name"), F.expr("if(id % 3 = 0, 'image/x', null)").alias("mime"))
    return rows.select("id", ev.upload_kind(F.col("name"), F.col("mime")).alias("k")).select("id", "k.*")


@query("intake_summary", f"""WITH {sp.EVENTS} SELECT count(*) AS items, count(*) FILTER (status = 'allow') AS indexed, count(*) FILTER (status = 'block') AS flagged FROM e""")
def intake_summary(spark, sf):
    return tm.intake_summary(_uploads(spark, sf))


@query("log_normalise", f"""{_L} SELECT id, CASE WHEN id % 2 = 0 THEN 't1' ELSE 'old' END AS t, CASE WHEN id % 3 = 0 THEN 'ALLOW' ELSE level END AS level,
  CASE WHEN id % 4 = 0 THEN 'unknown' ELSE src END AS src, dst, CASE WHEN id % 5 = 0 THEN 'TCP' ELSE proto END AS proto,
  CASE WHEN id % 6 = 0 THEN 'AI' ELSE rule END AS rule, bytes, CASE WHEN id % 2 = 0 THEN msg ELSE reason END AS msg FROM l""")
def log_normalise(spark, sf):
    log = dv.log_rows(spark, sf)
    raw = log.select(
        "id", F.expr("if(id % 2 = 0, 't1', '')").alias("t"), F.lit("old").alias("timestamp"), F.expr("if(id % 3 = 0, null, level)").alias("level"),
        F.expr("if(id % 4 = 0, '', src)").alias("src"), F.lit(None).cast("string").alias("source"),
        F.lit("").alias("dst"), F.col("dst").alias("destination"), F.expr("if(id % 5 = 0, '', proto)").alias("proto"),
        F.expr("if(id % 6 = 0, '', rule)").alias("rule"), F.lit(None).cast("string").alias("bytes"), F.expr("if(id % 2 = 0, msg, '')").alias("msg"), "reason")
    return tm.normalise_log(raw)


@query("age_bucket", f"""WITH x AS (SELECT event_id AS id, epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(ts) AS us FROM events)
  SELECT id, CASE WHEN us < 60000000 THEN greatest(1, CAST(floor(us / 1000000) AS BIGINT)) || 's ago' WHEN us < 3600000000 THEN CAST(floor(us / 60000000) AS BIGINT) || 'm ago'
  WHEN us < 86400000000 THEN CAST(floor(us / 3600000000) AS BIGINT) || 'h ago' ELSE CAST(floor(us / 86400000000) AS BIGINT) || 'd ago' END AS age FROM x""")
def age_bucket(spark, sf):
    as_of = epoch_micros(F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"))
    return dv.table(spark, sf, "events").select(F.col("event_id").alias("id"), age_text((as_of - epoch_micros(F.col("ts"))) / F.lit(1_000_000)).alias("age"))


@query("log_search", f"{_L} SELECT id, level, src, dst, msg FROM l WHERE level = 'BLOCK' AND contains(lower(src || dst || msg || rule), 'whatsapp')")
def log_search(spark, sf):
    return tm.search_log(dv.log_rows(spark, sf), "WhatsApp", "BLOCK").select("id", "level", "src", "dst", "msg")


@query("log_search_global", f"{_L} SELECT id, proto FROM l WHERE contains(lower(src || dst || msg || rule || proto), 'udp')")
def log_search_global(spark, sf):
    return tm.search_log(dv.log_rows(spark, sf), "udp", with_proto=True).select("id", "proto")


@query("threat_feed", f"{_T} SELECT * FROM t")
def threat_feed(spark, sf):
    return tm.to_threats(dv.log_rows(spark, sf))


@query("threat_ids", f"{_T} SELECT threat_id, event_id FROM t")
def threat_ids(spark, sf):
    return tm.to_threats(dv.log_rows(spark, sf)).select("threat_id", "event_id")


@query("threat_filter", f"{_T} SELECT threat_id, severity, type FROM t WHERE severity = 'critical'")
def threat_filter(spark, sf):
    return tm.threats_of_severity(tm.to_threats(dv.log_rows(spark, sf)), "critical").select("threat_id", "severity", "type")


@query("event_log_sink", f"{_L} SELECT id, ts, level, src, dst, rule, status, msg FROM l")
def event_log_sink(spark, sf):
    path = scratch_path(spark, "log")
    write_log(dv.log_rows(spark, sf), path)
    return spark.read.parquet(path).select("id", "ts", "level", "src", "dst", "rule", "status", "msg")


@query("threat_sink", f"{_T} SELECT threat_id, event_id, ts, severity, type, dst FROM t")
def threat_sink(spark, sf):
    path = scratch_path(spark, "threats")
    write_threats(dv.log_rows(spark, sf), path)
    return spark.read.parquet(path).select("threat_id", "event_id", "ts", "severity", "type", "dst")


@query("report_export", f"""{_L}, {_UP_SQL} SELECT 'Rule Hit Report' AS report, count(DISTINCT (ts::DATE, rule)) AS rows FROM l UNION ALL
  SELECT 'Blocked Traffic Export', count(*) FROM l WHERE level = 'BLOCK' UNION ALL SELECT 'AI Intake Audit', count(DISTINCT (ts::DATE, status)) FROM u UNION ALL
  SELECT 'Weekly Threat Summary', count(DISTINCT (date_trunc('week', ts), risk_level)) FROM l WHERE level = 'BLOCK'""")
def report_export(spark, sf):
    written = export_reports(dv.log_rows(spark, sf), _uploads(spark, sf), scratch_path(spark, "reports"))
    return union_all([spark.read.parquet(path).agg(F.count("*").alias("rows")).select(F.lit(name).alias("report"), "rows") for name, path in written.items()])


@query("report_list", f"""{_L}, n AS (SELECT count(*) AS a, count(*) FILTER (level = 'BLOCK') AS b FROM l)
  SELECT 'Weekly Threat Summary' AS name, 'All gateways' AS scope, 'Jan 24 – Jan 31' AS period, b || ' events' AS size, 'ready' AS status FROM n
  UNION ALL SELECT 'Rule Hit Report', 'Static rules', 'Last 24h', a || ' rows', 'ready' FROM n UNION ALL SELECT 'Blocked Traffic Export', 'Blocked only', 'Last 24h', b || ' events', 'ready' FROM n
  UNION ALL SELECT 'AI Intake Audit', 'Uploads', 'Session', a || ' files', 'ready' FROM n""")
def report_list(spark, sf):
    return report_index(dv.log_rows(spark, sf), _uploads(spark, sf), F.lit("2024-01-31 12:00:00").cast("timestamp_ntz"))


@query("overview_kpis", f"""{_L}, n AS (SELECT count(*) AS total, count(*) FILTER (level = 'BLOCK') AS b FROM l),
  x AS (SELECT round_even(value, 1) AS ms FROM events ORDER BY ts DESC, event_id DESC LIMIT 100), o AS (SELECT ms, row_number() OVER (ORDER BY ms) AS nth, count(*) OVER () AS c FROM x)
  SELECT round_even(greatest(0.1::DOUBLE, total / 60.0::DOUBLE), 2) AS throughput, b AS blocked_24h, total - b AS active_sessions,
  (SELECT ms FROM o WHERE nth = greatest(1, floor(c * 0.95::DOUBLE))) AS p95_latency FROM n""")
def overview_kpis(spark, sf):
    return tm.overview_kpis(dv.log_rows(spark, sf), dv.latencies(spark, sf))


@query("kpi_counters", f"""{_L}, n AS (SELECT count(*) AS total, count(*) FILTER (level = 'BLOCK') AS b FROM l)
  SELECT total, total - b AS allowed, b AS blocked, b AS threats, round_even(greatest(0.1::DOUBLE, total / 60.0::DOUBLE), 2) AS throughput, b AS blocked_24h, total - b AS active_sessions FROM n""")
def kpi_counters(spark, sf):
    return tm.kpi_counters(dv.log_rows(spark, sf))


@query("protocol_breakdown", f"""{_L}, g AS (SELECT proto, count(*) AS hits, max(ts) AS last FROM l GROUP BY proto ORDER BY hits DESC, last DESC, proto LIMIT 6)
  SELECT CASE proto WHEN 'TCP' THEN 'HTTPS / TLS 1.3' WHEN 'UDP' THEN 'DNS / UDP' WHEN 'HTTP' THEN 'HTTP / 1.1' ELSE proto END AS name,
  round_even(hits * 100 / (SELECT count(*) FROM l)::DOUBLE, 1) AS pct, (hits * 12) || ' KB' AS bytes FROM g""")
def protocol_breakdown(spark, sf):
    return tm.protocol_breakdown(dv.log_rows(spark, sf))


@query("region_breakdown", f"""{_L}, x AS (SELECT *, {sp.region('src')} AS code FROM l), g AS (SELECT code, count(*) AS hits, max(ts) AS last,
  bool_or(level = 'BLOCK') AS b FROM x GROUP BY code ORDER BY hits DESC, last DESC, code LIMIT 8)
  SELECT code, code AS name, round_even(hits * 100 / (SELECT count(*) FROM l)::DOUBLE, 1) AS pct, hits, CASE WHEN b THEN 'block' ELSE 'allow' END AS kind FROM g""")
def region_breakdown(spark, sf):
    return tm.region_breakdown(dv.log_rows(spark, sf))


@query("top_k_counts", f"""{_L}, g AS (SELECT dst, count(*) AS hits, max(ts) AS last FROM l GROUP BY dst ORDER BY hits DESC, last DESC, dst LIMIT 6)
  SELECT dst, hits, round_even(hits * 100 / (SELECT count(*) FROM l)::DOUBLE, 1) AS pct FROM g""")
def top_k_counts(spark, sf):
    return tm.top_counts(dv.log_rows(spark, sf), "dst", 6)


@query("severity_counts", f"{_T} SELECT count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high FROM t")
def severity_counts(spark, sf):
    return tm.severity_counts(dv.log_rows(spark, sf).filter("level = 'BLOCK'").select(ev.classify_threat(F.col("reason"))["severity"].alias("severity")))


@query("level_counts", f"{_L} SELECT level, count(*) AS rows FROM l GROUP BY level")
def level_counts(spark, sf):
    return tm.level_counts(dv.log_rows(spark, sf))


@query("threat_by_category", f"{_L} SELECT {sp.EPOCH} // 3600 * 3600 AS bucket, {sp.threat('type')} AS type, count(*) AS blocks FROM l WHERE level = 'BLOCK' GROUP BY ALL")
def threat_by_category(spark, sf):
    blocked = dv.log_rows(spark, sf).filter("level = 'BLOCK'")
    return tm.threats_by_category(blocked.select("ts", ev.classify_threat(F.col("reason"))["type"].alias("type")))


@query("p95_latency", """WITH x AS (SELECT event_type AS service, round_even(value, 1) AS ms FROM events), n AS (SELECT service, count(*) AS samples FROM x GROUP BY service),
  o AS (SELECT service, ms, row_number() OVER (PARTITION BY service ORDER BY ms) AS nth FROM x)
  SELECT o.service, samples, ms AS p95 FROM o JOIN n USING (service) WHERE nth = greatest(1, floor(samples * 0.95::DOUBLE))""")
def p95_latency(spark, sf):
    return tm.p95_latency(dv.latencies(spark, sf))


_ROLL = """x AS (SELECT event_type AS service, event_id AS id, ts, round_even(value, 1) AS ms FROM events),
  w AS (SELECT service, id, ts, list_sort(list(ms) OVER (PARTITION BY service ORDER BY ts, id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)) AS a FROM x),
  rp AS (SELECT service, id, ts, a[greatest(1, floor(len(a) * 0.95::DOUBLE)::BIGINT)] AS p95 FROM w)"""


@query("rolling_p95", f"WITH {_ROLL} SELECT * FROM rp")
def rolling_p95(spark, sf):
    return tm.rolling_p95(dv.latencies(spark, sf))


@query("latency_sampled", f"WITH {_ROLL} SELECT service, {sp.EPOCH} // 3 * 3 AS bucket, arg_max(p95, (ts, id)) AS p95 FROM rp GROUP BY ALL")
def latency_sampled(spark, sf):
    return tm.latency_sampled(dv.latencies(spark, sf))


_B = f"""{_L}, b AS (SELECT {sp.EPOCH} // 3 * 3 AS bucket, count(*) AS events, count(*) FILTER (level = 'BLOCK') AS blocked,
  count(*) FILTER (level <> 'BLOCK') AS allowed FROM l GROUP BY ALL)"""


@query("series_48", f"""{_B}, x AS (SELECT ts, event_id AS id, round_even(value, 1) AS ms FROM events),
  w AS (SELECT {sp.EPOCH} // 3 * 3 AS bucket, ts, id, list_sort(list(ms) OVER (ORDER BY ts, id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)) AS a FROM x),
  la AS (SELECT bucket, arg_max(a[greatest(1, floor(len(a) * 0.95::DOUBLE)::BIGINT)], (ts, id)) AS p95 FROM w GROUP BY bucket),
  s AS (SELECT unnest(range((SELECT max(bucket) FROM b) - 141, (SELECT max(bucket) FROM b) + 1, 3)) AS bucket)
  SELECT s.bucket, coalesce(events, 0) AS throughput, coalesce(blocked, 0) AS blocked, (SELECT sum(allowed)::BIGINT FROM b b2 WHERE b2.bucket <= s.bucket) AS sessions,
  (SELECT arg_max(p95, la.bucket) FROM la WHERE la.bucket <= s.bucket) AS latency FROM s LEFT JOIN b USING (bucket)""")
def series_48(spark, sf):
    return tm.recent_series(dv.log_rows(spark, sf), latencies=dv.latencies(spark, sf))


@query("sessions_running", f"{_B} SELECT bucket, sum(allowed) OVER (ORDER BY bucket)::BIGINT AS sessions FROM b")
def sessions_running(spark, sf):
    totals = tm.running_totals(tm.bucket_counts(dv.log_rows(spark, sf)), ["allowed"])
    return totals.select("bucket", F.col("allowed").alias("sessions"))


@query("delta_blocked", f"{_B}, c AS (SELECT bucket, sum(events) OVER (ORDER BY bucket) AS te, sum(blocked) OVER (ORDER BY bucket) AS tb FROM b) SELECT bucket, greatest(0, te - coalesce(lag(te) OVER (ORDER BY bucket), 0))::BIGINT AS events, greatest(0, tb - coalesce(lag(tb) OVER (ORDER BY bucket), 0))::BIGINT AS blocked FROM c")
def delta_blocked(spark, sf):
    totals = tm.running_totals(tm.bucket_counts(dv.log_rows(spark, sf)), ["events", "blocked"])
    return tm.deltas(totals, ["events", "blocked"]).select("bucket", "events", "blocked")


@query("latest_n", f"{_L} SELECT id, ts, level, msg FROM l ORDER BY ts DESC, id DESC LIMIT 1000")
def latest_n(spark, sf):
    return tm.latest(dv.log_rows(spark, sf), 1000).select("id", "ts", "level", "msg")


@query("union_events", f"""WITH {sp.EVENTS} SELECT 'connection' AS kind, id, 'http' AS text_content, destination_ip FROM e
  UNION ALL SELECT 'dns', id, 'DNS_QUERY:' || destination_ip, NULL FROM e WHERE port = '53'
  UNION ALL SELECT 'upload', doc_id, NULL, NULL FROM documents UNION ALL SELECT 'http', conv_id, text, NULL FROM conversations""")
def union_events(spark, sf):
    events = dv.events_x(spark, sf)
    return union_all([
        events.select(F.lit("connection").alias("kind"), "id", F.lit("http").alias("text_content"), "destination_ip"),
        events.filter("port = '53'").select(F.lit("dns").alias("kind"), "id", F.concat(F.lit("DNS_QUERY:"), "destination_ip").alias("text_content")),
        dv.table(spark, sf, "documents").select(F.lit("upload").alias("kind"), F.col("doc_id").alias("id")),
        dv.table(spark, sf, "conversations").select(F.lit("http").alias("kind"), F.col("conv_id").alias("id"), F.col("text").alias("text_content")),
    ])


@query("bucket_counts", f"{_B} SELECT * FROM b")
def bucket_counts(spark, sf):
    return tm.bucket_counts(dv.log_rows(spark, sf))
