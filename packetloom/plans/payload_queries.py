"""Queries over payload bytes, packets, handshakes and HTTP messages."""

from pyspark.sql import functions as F

from packetloom.functions.network import dns_text, endpoints, http_message, ipv4_tuple, is_tls, real_destination, tls_sni
from packetloom.functions.payload import (byte_entropy, is_obfuscated, mentions_ftp_credentials, needs_entropy, route_payload,
                                          sniff_type, triage)
from packetloom.operators.reassembly import reassemble
from packetloom.plans import sql_parts as sp
from packetloom.plans.registry import query
from packetloom.sources import derived as dv
from packetloom.sources.tables import normal_traffic, parse_connections, read_files

# Bodies whose first characters are a file signature, for nine document groups.
_BODY = """CASE doc_id % 9 WHEN 0 THEN '%PDF' || text WHEN 1 THEN 'GIF8' || text WHEN 2 THEN 'MZ' || text
 WHEN 3 THEN 'PK' || chr(3) || chr(4) || text WHEN 4 THEN chr(127) || 'ELF' || text WHEN 5 THEN '' ELSE text END"""
_KIND = """CASE doc_id % 9 WHEN 0 THEN 'document' WHEN 1 THEN 'image' WHEN 2 THEN 'executable' WHEN 3 THEN 'document' WHEN 4 THEN 'executable'
 ELSE CASE WHEN octet_length(encode(body)) <= 1024 OR substr(hex(encode(body)), 2049, 1) NOT IN ('8','9','A','B') THEN 'text' ELSE 'binary_unknown' END END"""
_BODIES = f"{sp.DOCS}, b AS (SELECT doc_id, {_BODY} AS body FROM d), kinds AS (SELECT doc_id, body, {_KIND} AS kind FROM b)"
_ENTROPY = f"""{sp.DOCS}, h AS (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS x FROM d),
 f AS (SELECT doc_id, x, count(*) AS n FROM h GROUP BY ALL), s AS (SELECT doc_id, sum(n) AS total FROM f GROUP BY doc_id),
 en AS (SELECT doc_id, round(-sum((n / total) * log2(n / total)), 9) + 0.0 AS entropy FROM f JOIN s USING (doc_id) GROUP BY doc_id)"""


def _bodies(spark, sf):
    return dv.documents_x(spark, sf).select("doc_id", F.expr(_BODY).cast("binary").alias("payload"))


@query("sniff_type", f"WITH {_BODIES} SELECT doc_id, kind FROM kinds")
def sniff(spark, sf):
    return _bodies(spark, sf).select("doc_id", sniff_type(F.col("payload")).alias("kind"))


@query("byte_entropy", f"WITH {_ENTROPY} SELECT doc_id, entropy FROM en")
def entropy(spark, sf):
    return dv.documents_x(spark, sf).select("doc_id", F.round(byte_entropy(F.col("payload")), 9).alias("entropy"))


@query("is_obfuscated", f"WITH {_ENTROPY} SELECT doc_id, entropy > 7.5 AS obfuscated, entropy > 4.2 AS above_4_2 FROM en")
def obfuscated(spark, sf):
    rated = dv.documents_x(spark, sf).select("doc_id", byte_entropy(F.col("payload")).alias("e"))
    return rated.select("doc_id", is_obfuscated(F.col("e")).alias("obfuscated"), is_obfuscated(F.col("e"), 4.2).alias("above_4_2"))


@query("gateway_triage", f"""WITH {_BODIES} SELECT doc_id, CASE WHEN body = '' THEN 'allow' WHEN kind = 'executable' THEN 'block'
  WHEN kind IN ('image', 'text', 'document') THEN 'inspect' ELSE 'allow' END AS decision,
  CASE WHEN body = '' OR kind NOT IN ('image', 'text', 'document') THEN '' WHEN kind = 'image' THEN 'image' ELSE 'text' END AS service FROM kinds""")
def gateway_triage(spark, sf):
    kinds = _bodies(spark, sf).withColumn("kind", sniff_type(F.col("payload")))
    rated = kinds.withColumn("entropy", byte_entropy(needs_entropy(F.col("payload"), F.col("kind"))))
    decision, service = triage(F.col("payload"), F.col("kind"), F.col("entropy"))
    return rated.select("doc_id", decision.alias("decision"), F.coalesce(service, F.lit("")).alias("service"))


@query("route_payload", f"""WITH {sp.DOCS} SELECT doc_id, CASE WHEN contains(text, 'malware') OR contains(text, 'cmd.exe') OR doc_id % 12 IN (0, 1) THEN 'block'
  WHEN doc_id % 12 = 2 THEN 'document' ELSE 'text' END AS route FROM d""")
def route(spark, sf):
    tail = F.expr("CASE doc_id % 12 WHEN 0 THEN cast(' malware' as binary) WHEN 1 THEN cast(' cmd.exe' as binary) WHEN 2 THEN unhex('FF') ELSE unhex('') END")
    return dv.documents_x(spark, sf).select("doc_id", route_payload(F.concat("payload", tail)).alias("route"))


@query("traffic_source", f"""WITH {sp.EVENTS} SELECT id, ts, CASE WHEN id % 7 = 0 THEN 'unknown' ELSE source_ip END AS source_ip,
  CASE WHEN id % 8 = 0 THEN 'unknown' ELSE destination_ip END AS destination_ip, CASE WHEN id % 9 = 0 THEN '' ELSE port END AS port,
  proto, content_type, '' AS text_content FROM e""")
def traffic_source(spark, sf):
    raw = dv.events_x(spark, sf).withColumns({
        "source_ip": F.expr("if(id % 7 = 0, null, source_ip)"), "destination_ip": F.expr("if(id % 8 = 0, null, destination_ip)"),
        "port": F.expr("if(id % 9 = 0, null, port)"), "text_content": F.lit(None).cast("string")})
    return normal_traffic(raw).drop("payload")


@query("connection_events", f"""WITH {sp.EVENTS} SELECT id, CASE WHEN id % 7 = 0 THEN 'unknown' ELSE source_ip END AS source_ip,
  destination_ip, port, CASE WHEN id % 5 = 0 THEN 'allow' WHEN status = 'block' THEN 'block' ELSE 'allow' END AS status, 'safe' AS risk_level,
  CASE WHEN id % 3 = 0 THEN 'connection observed' WHEN port = '443' THEN 'HTTPS connection' ELSE 'HTTP connection' END AS reason,
  'PROXY' AS rule, proto, '—' AS bytes FROM e""")
def connection_events(spark, sf):
    body = F.to_json(F.struct(
        F.expr("if(id % 7 = 0, null, source_ip)").alias("source_ip"), "destination_ip", "port",
        F.expr("if(id % 5 = 0, null, upper(status))").alias("status"),
        F.expr("if(id % 3 = 0, null, if(port = '443', 'HTTPS connection', 'HTTP connection'))").alias("reason"), "proto"))
    raw = dv.events_x(spark, sf).select("id", body.alias("body"))
    return parse_connections(raw, "body", "id")


@query("binary_payloads")
def binary_payloads(spark, sf):
    return read_files(spark, sf, "*.parquet", with_content=False).select("name", "length")


_CRLF = "chr(13) || chr(10)"
_MESSAGE = f"""CASE turn % 5 WHEN 4 THEN 'POST /c HTTP/1.1' || {_CRLF} || text
 WHEN 3 THEN 'BROKEN' || {_CRLF} || 'Host: x' || {_CRLF} || {_CRLF} || text
 ELSE 'POST /c/' || CAST(conv_id AS STRING) || ' HTTP/1.1' || {_CRLF} || 'HOST:  h' || CAST(conv_id % 7 AS STRING) || '.example.com:80 ' || {_CRLF}
   || 'no colon here' || {_CRLF} || 'Content-Length: ' || CAST(length(role) + 7 AS STRING) || {_CRLF} || {_CRLF} || text END"""


@query("http_message", """SELECT conv_id, turn, turn % 5 <> 4 AS complete, CASE WHEN turn % 5 < 3 THEN 'POST' ELSE '' END AS method,
  CASE WHEN turn % 5 < 3 THEN '/c/' || conv_id ELSE '' END AS path, CASE WHEN turn % 5 < 3 THEN 'HTTP/1.1' ELSE '' END AS protocol,
  CASE turn % 5 WHEN 4 THEN '' WHEN 3 THEN 'x' ELSE 'h' || (conv_id % 7) || '.example.com:80' END AS host,
  CASE WHEN turn % 5 < 3 THEN length(role) + 7 ELSE 0 END AS content_length, CASE WHEN turn % 5 = 4 THEN '' ELSE text END AS body FROM conversations""")
def http(spark, sf):
    data = dv.table(spark, sf, "conversations").select("conv_id", "turn", F.expr(_MESSAGE).cast("binary").alias("data"))
    parsed = data.withColumn("m", http_message(F.col("data")))
    return parsed.select("conv_id", "turn", "m.complete", "m.method", "m.path", "m.protocol",
                         F.coalesce(F.element_at("m.headers", "host"), F.lit("")).alias("host"), "m.content_length",
                         F.col("m.body").cast("string").alias("body"))


def client_hello(host):
    """ClientHello record of a host, as a hex string expression."""
    def size(value, width):
        return F.lpad(F.hex(value), width, "0")

    n = F.length(host)
    return F.concat(F.lit("160301"), size(n + 58, 4), F.lit("01"), size(n + 54, 6), F.lit("0303" + "00" * 32 + "00" + "0002" + "1301" + "01" + "00"),
                    size(n + 13, 4), F.lit("00170000"), F.lit("0000"), size(n + 5, 4), size(n + 3, 4), F.lit("00"), size(n, 4), F.hex(host))


@query("tls_sni", f"""WITH {sp.EVENTS} SELECT id, CASE WHEN id % 9 IN (0, 1) THEN NULL ELSE destination_ip END AS sni, id % 9 <> 2 OR port = '443' AS tls FROM e""")
def sni(spark, sf):
    events = dv.events_x(spark, sf)
    hello = client_hello(F.col("destination_ip"))
    broken = F.when(F.col("id") % 9 == 0, F.substring(hello, 1, 80)).when(F.col("id") % 9 == 1, F.replace(hello, F.lit("001700000000"), F.lit("001700000010"))).otherwise(hello)
    data = events.select("id", "port", F.unhex(broken).alias("hello"))
    first = F.when(F.col("id") % 9 == 2, F.unhex(F.lit("00"))).otherwise(F.col("hello"))
    return data.select("id", tls_sni("hello").alias("sni"), is_tls(first, F.col("port")).alias("tls"))


@query("real_destination", f"""WITH {sp.EVENTS}, x AS (SELECT id, source_ip, CASE id % 4 WHEN 0 THEN 'www.shop.com' WHEN 1 THEN coalesce(nullif(
  CASE WHEN id % 3 = 0 THEN '' ELSE 'sni.example.org' END, ''), destination_ip) WHEN 2 THEN destination_ip ELSE 'sni.example.org' END AS real_dst FROM e)
  SELECT id, real_dst, CASE WHEN id % 2 = 0 THEN source_ip ELSE real_dst END AS src, CASE WHEN id % 2 = 0 THEN real_dst ELSE source_ip END AS dst FROM x""")
def destination(spark, sf):
    events = dv.events_x(spark, sf)
    host = F.expr("CASE id % 4 WHEN 0 THEN ' www.shop.com:8080' WHEN 1 THEN '' WHEN 2 THEN null ELSE ':80' END")
    name = F.expr("CASE WHEN id % 4 = 3 THEN 'sni.example.org' WHEN id % 4 = 1 AND id % 3 <> 0 THEN 'sni.example.org' ELSE '' END")
    found = events.withColumn("real_dst", real_destination(host, name, F.col("destination_ip")))
    src, dst = endpoints(F.expr("if(id % 2 = 0, 'outbound', 'inbound')"), F.col("source_ip"), F.col("real_dst"))
    return found.select("id", "real_dst", src.alias("src"), dst.alias("dst"))


@query("ipv4_tuple", """SELECT event_id AS id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE '10.' || (user_id % 256) || '.200.' || (event_id % 256) END AS src,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE '172.16.9.' || (user_id % 256) END AS dst,
  CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 3 = 2 THEN 0 ELSE event_id % 65536 END AS sport,
  CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 3 = 2 THEN 0 ELSE 443 END AS dport,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE [6, 17, 1][event_id % 3 + 1] END AS proto FROM events""")
def ipv4(spark, sf):
    packet = F.expr("""concat('4500002800004000', '40', element_at(array('06', '11', '01'), cast(event_id % 3 + 1 as int)), '0000',
      '0A', lpad(hex(user_id % 256), 2, '0'), 'C8', lpad(hex(event_id % 256), 2, '0'), 'AC1009', lpad(hex(user_id % 256), 2, '0'),
      lpad(hex(event_id % 65536), 4, '0'), '01BB', '0000000000000000')""")
    data = F.unhex(F.when(F.col("event_id") % 13 == 0, F.substring(packet, 1, 38)).otherwise(packet))
    packets = dv.table(spark, sf, "events").select(F.col("event_id").alias("id"), data.alias("data"))
    return packets.select("id", ipv4_tuple(F.col("data")).alias("t")).select("id", "t.*")


@query("dns_text", f"""WITH {sp.EVENTS} SELECT id, 'DNS_QUERY:' || destination_ip AS text_content FROM e WHERE port = '53' AND id % 5 <> 0""")
def dns(spark, sf):
    queries = dv.events_x(spark, sf).filter("port = '53'").withColumn("qr", F.expr("if(id % 5 = 0, 1, 0)"))
    return queries.filter("qr = 0").select("id", dns_text(F.col("destination_ip")).alias("text_content"))


@query("ftp_credentials", f"""WITH {sp.DOCS} SELECT doc_id, doc_id % 14 < 2 OR contains(text, 'USER ') OR contains(text, 'PASS ') AS credentials FROM d""")
def ftp(spark, sf):
    tail = F.expr("CASE doc_id % 14 WHEN 0 THEN 'USER bob' WHEN 1 THEN 'PASS x' WHEN 2 THEN 'user bob' ELSE '' END").cast("binary")
    return dv.documents_x(spark, sf).select("doc_id", mentions_ftp_credentials(F.concat("payload", tail)).alias("credentials"))


REASSEMBLY_SQL = """SELECT conv_id AS conn_id, CASE WHEN role = 'user' THEN 'outbound' ELSE 'inbound' END AS direction,
  row_number() OVER (PARTITION BY conv_id, role = 'user' ORDER BY turn) - 1 AS message, 'h' || (conv_id % 7) || '.example.com' AS host,
  octet_length(encode(text)) AS content_length, text AS body, false AS flushed FROM conversations"""


@query("http_reassembly", REASSEMBLY_SQL)
def http_reassembly(spark, sf):
    messages = reassemble(dv.chunks(spark, sf)).withColumn("m", http_message(F.col("data")))
    return messages.select("conn_id", "direction", "message", F.element_at("m.headers", "host").alias("host"), "m.content_length",
                           F.col("m.body").cast("string").alias("body"), "flushed")
