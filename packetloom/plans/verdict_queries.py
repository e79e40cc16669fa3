"""End-to-end queries: traffic, gateway and packet verdicts, flows."""

from pyspark.sql import functions as F

from packetloom.operators.flows import flow_rescan, flow_table, zero_ports
from packetloom.operators.reassembly import reassemble
from packetloom.plans import sql_parts as sp
from packetloom.plans.image_queries import IMAGE_VERDICT_SQL, image_results
from packetloom.plans.inspect import gateway_verdict, http_verdict, packet_verdict, traffic_verdict
from packetloom.plans.registry import query
from packetloom.sources import derived as dv

_TEXT_SCORES = f"""{sp.CODE}, {sp.PII}, {sp.CONTENT}, ts AS (SELECT c.doc_id, greatest({sp.CODE_SCORE}, {sp.PII_SCORE}, 0.1::DOUBLE) AS text_hi,
  CASE WHEN {sp.EICAR.replace('text', 'c.text')} THEN 0.95::DOUBLE ELSE 0.0::DOUBLE END AS mal, content_score FROM c JOIN p USING (doc_id) JOIN content USING (doc_id))"""
_TEXT_JUDGE = """CASE WHEN text_hi > 0.8 THEN 'critical' WHEN text_hi > 0.5 THEN 'medium' ELSE 'safe' END"""
_BY_RULE = "CASE action WHEN 'block' THEN 'critical' WHEN 'allow' THEN 'safe' END"
VERDICT_SQL = f"""{sp.DOCS}, {sp.EVENTS}, {sp.TRAFFIC_IDS}, {sp.RULE_ROWS}, {sp.MATCHED_IDS}, {_TEXT_SCORES}, {IMAGE_VERDICT_SQL},
  j AS (SELECT m.*, text_hi, greatest(mal, content_score) AS doc_hi, mal * 0.4::DOUBLE + content_score * 0.2::DOUBLE AS doc_w, i.status AS istatus, i.risk_level AS irisk, i.reason AS ireason
    FROM m JOIN ts USING (doc_id) LEFT JOIN image_v i ON i.image_id = m.id),
  tv AS (SELECT id, ts, source_ip, destination_ip, proto, content_type, rule_id,
    CASE WHEN rule_id IS NOT NULL THEN action WHEN content_type = 'text' THEN CASE WHEN text_hi > 0.5 THEN 'block' ELSE 'allow' END
      WHEN content_type = 'document' THEN CASE WHEN doc_hi > 0.8 OR doc_w > 0.5 THEN 'block' ELSE 'allow' END WHEN content_type = 'image' THEN coalesce(istatus, 'allow') ELSE 'allow' END AS status,
    CASE WHEN rule_id IS NOT NULL THEN {_BY_RULE} WHEN content_type = 'text' THEN {_TEXT_JUDGE}
      WHEN content_type = 'document' THEN CASE WHEN doc_hi > 0.8 THEN 'critical' WHEN doc_w > 0.5 THEN 'medium' ELSE 'safe' END WHEN content_type = 'image' THEN coalesce(irisk, 'safe') ELSE 'safe' END AS risk_level,
    CASE WHEN rule_id IS NOT NULL THEN 'Static rule match (' || match_type || '=' || rule_value || '): ' || upper(action) WHEN content_type = 'text' THEN 'Max threat score ' || text_hi
      WHEN content_type = 'document' THEN CASE WHEN doc_hi > 0.8 THEN 'Critical document threat (max=' || printf('%.2f', doc_hi) || ')' ELSE 'Safe' END
      WHEN content_type = 'image' THEN coalesce(ireason, 'No threats detected') ELSE 'No threats detected' END AS reason,
    CASE WHEN rule_id IS NOT NULL THEN 'R-' || rule_id ELSE 'AI-ANALYSIS' END AS rule_label FROM j)"""


def image_verdicts(spark, sf):
    return image_results(spark, sf).select(F.col("image_id").alias("id"), "status", "risk_level", "reason")


def judged_traffic(spark, sf):
    return traffic_verdict(dv.traffic(spark, sf), dv.rules(spark), image_verdicts(spark, sf))


@query("traffic_verdict", f"WITH {VERDICT_SQL} SELECT id, status, risk_level, reason, rule_label FROM tv")
def traffic_verdict_query(spark, sf):
    return judged_traffic(spark, sf).select("id", "status", "risk_level", "reason", "rule_label")


@query("verdict_summary", f"WITH {VERDICT_SQL} SELECT content_type, status, risk_level, count(*) AS events FROM tv GROUP BY ALL")
def verdict_summary(spark, sf):
    return judged_traffic(spark, sf).groupBy("content_type", "status", "risk_level").agg(F.count("*").alias("events"))




@query("gateway_verdict", f"""WITH {sp.DOCS}, {sp.EVENTS}, g AS (SELECT e.*, doc_id, CASE WHEN event_id % 9 = 0 THEN 'MZ' || text WHEN event_id % 9 = 1 THEN '' ELSE text END AS body
    FROM e JOIN d ON d.doc_id = e.event_id % (SELECT count(*) FROM documents)),
  kn AS (SELECT *, CASE WHEN body = '' THEN 'empty' WHEN starts_with(body, 'MZ') THEN 'executable'
    WHEN octet_length(encode(body)) <= 1024 OR substr(hex(encode(body)), 2049, 1) NOT IN ('8','9','A','B') THEN 'text' ELSE 'binary_unknown' END AS kind FROM g),
  tr AS (SELECT id, ts, source_ip, destination_ip, port, doc_id, body AS text_content FROM kn WHERE kind = 'text'), {sp.RULE_ROWS}, {sp.MATCHED}, {_TEXT_SCORES}
  SELECT id, CASE kind WHEN 'executable' THEN 'block' ELSE 'allow' END AS status, CASE kind WHEN 'executable' THEN 'high' ELSE 'safe' END AS risk_level,
    CASE kind WHEN 'executable' THEN 'Executable detected' ELSE 'No threats detected' END AS reason, 'GATEWAY' AS rule_label FROM kn WHERE kind <> 'text'
  UNION ALL SELECT id, CASE WHEN rule_id IS NOT NULL THEN action WHEN text_hi > 0.5 THEN 'block' ELSE 'allow' END, CASE WHEN rule_id IS NOT NULL THEN {_BY_RULE} ELSE {_TEXT_JUDGE} END,
    CASE WHEN rule_id IS NOT NULL THEN 'Static rule match (' || match_type || '=' || rule_value || '): ' || upper(action) ELSE 'Max threat score ' || text_hi END,
    CASE WHEN rule_id IS NOT NULL THEN 'R-' || rule_id ELSE 'AI-ANALYSIS' END FROM m JOIN ts USING (doc_id)""")
def gateway_verdict_query(spark, sf):
    body = F.expr("CASE WHEN id % 9 = 0 THEN concat('MZ', text_content) WHEN id % 9 = 1 THEN '' ELSE text_content END").cast("binary")
    messages = dv.traffic(spark, sf).withColumn("payload", body).withColumn("text_content", F.lit(""))
    return gateway_verdict(messages, dv.rules(spark)).select("id", "status", "risk_level", "reason", "rule_label")


@query("flow_table", f"""WITH f AS (SELECT {dv.SOURCE_IP} AS src, CASE WHEN event_id % 5 = 4 THEN 0 ELSE user_id % 50 END AS sport, {dv.DESTINATION} AS dst,
  CASE WHEN event_id % 5 = 4 THEN 0 ELSE ({dv.PORT})::INT END AS dport, CASE event_id % 5 WHEN 3 THEN 17 WHEN 4 THEN 1 ELSE 6 END AS proto, CAST(trunc(value * 10) AS INT) AS length, ts FROM events)
  SELECT src, sport, dst, dport, proto, min(ts) AS start_time, max(ts) AS last_seen, sum(length)::BIGINT AS byte_count, count(*) AS packets FROM f GROUP BY ALL""")
def flow_table_query(spark, sf):
    return flow_table(zero_ports(dv.packets(spark, sf)))


RESCAN_SQL = f"""RECURSIVE fp AS (SELECT user_id % 10 AS k, event_id AS id, TIMESTAMP '2024-01-01' + to_milliseconds({dv.FLOW_MS}) AS ts FROM events),
  sq AS (SELECT *, {sp.EPOCH} AS sec, row_number() OVER (PARTITION BY k ORDER BY ts, id) AS rn FROM fp),
  st AS (SELECT k, rn, id, ts, true AS rescan, id AS scan_id, 50 AS rem, sec + 10 AS expiry FROM sq WHERE rn = 1
   UNION ALL SELECT s.k, s.rn, s.id, s.ts, NOT (rem > 0 AND s.sec < expiry), CASE WHEN rem > 0 AND s.sec < expiry THEN scan_id ELSE s.id END,
     CASE WHEN rem > 0 AND s.sec < expiry THEN rem - 1 ELSE 50 END, CASE WHEN rem > 0 AND s.sec < expiry THEN expiry ELSE s.sec + 10 END FROM st JOIN sq s ON s.k = st.k AND s.rn = st.rn + 1)"""


@query("flow_rescan", f"WITH {RESCAN_SQL} SELECT k, id, ts, rescan, scan_id FROM st")
def flow_rescan_query(spark, sf):
    return flow_rescan(dv.flow_packets(spark, sf), ("k",))


@query("packet_verdict", f"""WITH {RESCAN_SQL}, {sp.DOCS}, {sp.EVENTS}, {sp.TRAFFIC}, {sp.RULE_ROWS}, {sp.MATCHED}, {_TEXT_SCORES},
  sv AS (SELECT m.id, CASE WHEN contains(text_content, 'malware') OR contains(text_content, 'cmd.exe') THEN 'block' WHEN rule_id IS NOT NULL THEN action WHEN text_hi > 0.5 THEN 'block' ELSE 'allow' END AS status
    FROM m JOIN ts USING (doc_id)) SELECT st.id, rescan, scan_id, sv.status FROM st JOIN sv ON sv.id = scan_id""")
def packet_verdict_query(spark, sf):
    packets = dv.traffic(spark, sf).drop("ts").join(dv.flow_packets(spark, sf), "id")
    return packet_verdict(packets, dv.rules(spark), ("k",)).select("id", "rescan", "scan_id", "status")


# Reassembled turns of the conversations, some with planted code, through allowlist, triage and inspection.
_HTTP_TEXT = "CASE WHEN (conv_id * 100 + turn) % 5 = 1 THEN text || ' eval(b)' ELSE text END"


@query("http_verdict", f"""WITH d AS (SELECT conv_id * 100 + turn AS doc_id, conv_id, turn, {_HTTP_TEXT} AS text FROM conversations),
  kn AS (SELECT doc_id AS id, doc_id, 'h' || (conv_id % 7) || '.shop.com' AS destination_ip, text AS body, CASE WHEN text = '' THEN 'empty' WHEN starts_with(text, 'MZ') THEN 'executable'
    WHEN octet_length(encode(text)) <= 1024 OR substr(hex(encode(text)), 2049, 1) NOT IN ('8','9','A','B') THEN 'text' ELSE 'binary_unknown' END AS kind
    FROM d WHERE NOT (turn % 2 = 0 AND doc_id % 3 = 0)),
  tr AS (SELECT id, '192.168.1.9' AS source_ip, destination_ip, '443' AS port, doc_id, body AS text_content FROM kn WHERE kind = 'text'), {sp.RULE_ROWS}, {sp.MATCHED}, {_TEXT_SCORES}
  SELECT id, destination_ip, CASE kind WHEN 'executable' THEN 'block' ELSE 'allow' END AS status,
    CASE kind WHEN 'executable' THEN 'Executable detected' ELSE 'No threats detected' END AS reason FROM kn WHERE kind <> 'text'
  UNION ALL SELECT id, destination_ip, CASE WHEN rule_id IS NOT NULL THEN action WHEN text_hi > 0.5 THEN 'block' ELSE 'allow' END,
    CASE WHEN rule_id IS NOT NULL THEN 'Static rule match (' || match_type || '=' || rule_value || '): ' || upper(action) ELSE 'Max threat score ' || text_hi END
    FROM m JOIN ts USING (doc_id)""")
def http_verdict_query(spark, sf):
    turns = dv.table(spark, sf, "conversations").select("conv_id", "turn", F.expr(_HTTP_TEXT).alias("text"))
    id_ = F.col("conv_id") * 100 + F.col("turn")
    crlf = "\r\n"
    head = F.concat(F.lit(f"POST /x HTTP/1.1{crlf}Host: h"), F.col("conv_id") % 7, F.lit(f".shop.com{crlf}Content-Length: "),
                    F.octet_length("text"), F.lit(crlf * 2))
    # Two chunks per message: the header, then the body.
    chunks = turns.select(id_.alias("conn_id"), F.lit("outbound").alias("direction"), F.posexplode(
        F.array(head.cast("binary"), F.col("text").cast("binary"))).alias("seq", "data"))
    whole = reassemble(chunks.withColumn("seq", F.col("seq").cast("long"))).select("conn_id", "data")
    facts = turns.select(id_.alias("id"), F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit("192.168.1.9").alias("client_ip"),
                         F.lit("93.1.1.1").alias("dest_ip"), F.expr("if(turn % 2 = 0, concat('h', conv_id % 7, '.google.com'), '')").alias("server_name"),
                         F.lit(443).alias("port"), (id_ % 3 == 0).alias("is_tls"))
    messages = facts.join(whole, F.col("id") == F.col("conn_id")).drop("conn_id")
    return http_verdict(messages, dv.allowlist(spark), dv.rules(spark)).select("id", "destination_ip", "status", "reason")
