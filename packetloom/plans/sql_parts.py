"""SQL fragments shared by the SQL counterparts of the queries."""

from packetloom import fixed_values as fv
from packetloom.sources import derived as dv

DOCS = f"d AS (SELECT doc_id, {dv.TEXT_X} AS text FROM documents)"

CODE = r"""c AS (SELECT doc_id, text,
  regexp_matches(text, 'AKIA[0-9A-Z]{16}') AS aws,
  regexp_matches(text, 'AIza[0-9A-Za-z\\-_]{35}') AS google,
  regexp_matches(text, '-----BEGIN (RSA|DSA|EC|OPENSSH) PRIVATE KEY-----') AS pkey,
  regexp_matches(text, '(?i)(api_key|secret|password)[\s]*=[\s]*[''"][0-9a-zA-Z\-_]{16,}[''"]') AS generic,
  contains(text, 'eval(') OR contains(text, 'exec(') OR contains(text, 'os.system(') AS rce FROM d)"""
CODE_SCORE = "CASE WHEN aws OR google OR pkey OR generic THEN 1.0::DOUBLE WHEN rce THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END"
CODE_FINDINGS = """concat_ws('|', CASE WHEN aws THEN 'Secret Detected: AWS Access Key' END,
  CASE WHEN google THEN 'Secret Detected: Google API Key' END, CASE WHEN pkey THEN 'Secret Detected: Private Key Header' END,
  CASE WHEN generic THEN 'Secret Detected: Generic Secret' END, CASE WHEN rce THEN 'Potential RCE (Remote Code Execution) pattern' END)"""

_LUHN = r"""list_sum(list_transform(range(1, length(regexp_replace(x, '[^0-9]', '', 'g')) + 1), lambda i:
   CASE WHEN i % 2 = 1 THEN substr(reverse(regexp_replace(x, '[^0-9]', '', 'g')), i, 1)::INT
   ELSE (substr(reverse(regexp_replace(x, '[^0-9]', '', 'g')), i, 1)::INT * 2) // 10
      + (substr(reverse(regexp_replace(x, '[^0-9]', '', 'g')), i, 1)::INT * 2) % 10 END)) % 10 = 0"""
_IBAN = r"""list_reduce(list_transform(string_split(substr(x, 5) || substr(x, 1, 4), ''), lambda ch:
   CASE WHEN ch BETWEEN '0' AND '9' THEN ascii(ch) - 48 ELSE ascii(ch) - 55 END),
   lambda a, v: CASE WHEN v < 10 THEN (a * 10 + v) % 97 ELSE (a * 100 + v) % 97 END, 0) = 1"""
PII = rf"""p AS (SELECT doc_id, text,
  regexp_extract_all(text, '(?:\+1[ .-]?)?\([0-9]{{3}}\) ?[0-9]{{3}}[ .-][0-9]{{4}}\b|\b(?:\+?1[ .-])?[0-9]{{3}}[.-][0-9]{{3}}[.-][0-9]{{4}}\b') AS phones,
  regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}') AS emails,
  list_filter(regexp_extract_all(text, '\b[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}\b'), lambda x: {_IBAN}) AS ibans,
  list_filter(regexp_extract_all(text, '\b[0-9](?:[ -]?[0-9]){{12,18}}\b'), lambda x: {_LUHN}) AS cards,
  regexp_extract_all(text, '\b[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}\b') AS ssns FROM d)"""
PII_SCORE = """CASE WHEN len(ibans) + len(cards) + len(ssns) > 0 THEN 0.9::DOUBLE
  WHEN len(phones) + len(emails) > 0 THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END"""
PII_FINDINGS = """array_to_string(list_transform(phones, lambda x: 'PII Detected: PHONE_NUMBER (0.40)')
  || list_transform(emails, lambda x: 'PII Detected: EMAIL_ADDRESS (1.00)') || list_transform(ibans, lambda x: 'PII Detected: IBAN (1.00)')
  || list_transform(cards, lambda x: 'PII Detected: CREDIT_CARD (1.00)') || list_transform(ssns, lambda x: 'PII Detected: US_SSN (0.50)'), '|')"""


def _hits(*patterns: str) -> str:
    return " + ".join(f"regexp_matches(low, '{p}')::INT" for p in patterns)


# Patterns that are not written in lower case match the lower-cased text without regard to case.
_BUCKETS = [(label, [p if p == p.lower() else f"(?i){p}" for p in patterns]) for label, patterns in fv.KEYWORD_BUCKETS]
_MOST = "greatest(" + ", ".join(f"s{i}" for i in range(len(_BUCKETS))) + ")"
CONTENT = f"""k AS (SELECT doc_id, {", ".join(f"{_hits(*patterns)} AS h{i}" for i, (_, patterns) in enumerate(_BUCKETS))}
  FROM (SELECT doc_id, lower(text) AS low FROM d)),
ks AS (SELECT *, {", ".join(f"CASE WHEN h{i} > 0 THEN least(0.95::DOUBLE, 0.5::DOUBLE + 0.15::DOUBLE * (h{i} - 1)) ELSE 0.0::DOUBLE END AS s{i}" for i in range(len(_BUCKETS)))} FROM k),
content AS (SELECT *, {_MOST} AS content_score, CASE WHEN {_MOST} = 0 THEN NULL
  {" ".join(f"WHEN s{i} = {_MOST} THEN '{label}'" for i, (label, _) in enumerate(_BUCKETS))} END AS label FROM ks)"""
CONTENT_FINDINGS = "concat_ws('|', " + ", ".join(
    f"CASE WHEN h{i} > 0 THEN 'Keyword bucket ''{label}'' matched ' || h{i} || ' pattern(s)' END" for i, (label, _) in enumerate(_BUCKETS)) + \
    ", CASE WHEN label IS NOT NULL THEN 'Sensitive content (keywords): ' || label || ' (' || printf('%.2f', content_score) || ')' END)"

EICAR = "contains(text, 'X5O!P%@AP[4' || chr(92) || 'PZX54(P^)7CC)7}$EICAR-STANDARD-ANTIVIRUS-TEST-FILE!$H+H*')"

EVENTS = f"""e AS (SELECT event_id AS id, event_id, user_id, ts, value, {dv.SOURCE_IP} AS source_ip, {dv.DESTINATION} AS destination_ip,
  {dv.PORT} AS port, {dv.PROTO} AS proto, {dv.CONTENT_TYPE} AS content_type, {dv.STATUS} AS status, {dv.REASON} AS reason FROM events)"""

THREAT_WORDS = [word for word, *_ in fv.THREAT_LABELS]


def threat(field: str) -> str:
    at = ("type", "severity", "confidence").index(field)

    def lit(v) -> str:
        return f"{v}::DOUBLE" if isinstance(v, float) else f"'{v}'"

    return "CASE " + " ".join(f"WHEN contains(lower(reason), '{word}') THEN {lit(labels[at])}" for word, *labels in fv.THREAT_LABELS) \
        + f" ELSE {lit(fv.THREAT_DEFAULT[at])} END"


def region(ip: str) -> str:
    lan = " OR ".join(f"starts_with({ip}, '{prefix}')" for prefix in fv.LAN_PREFIXES)
    return f"""CASE WHEN {ip} IS NULL OR {ip} IN ('', 'unknown') THEN '??' WHEN {lan} THEN 'LAN'
  WHEN try_cast(split_part({ip}, '.', 1) AS INT) IS NULL THEN '??'
  ELSE ({list(fv.REGION_BUCKETS)})[try_cast(split_part({ip}, '.', 1) AS INT) % {len(fv.REGION_BUCKETS)} + 1] END"""


LEVEL = "CASE status WHEN 'block' THEN 'BLOCK' WHEN 'censor' THEN 'WARN' ELSE 'ALLOW' END"
LOG = f"""l AS (SELECT id, ts, {LEVEL} AS level, source_ip AS src, destination_ip AS dst, proto, 'AI-ANALYSIS' AS rule, '—' AS bytes,
  status, CASE WHEN status = 'block' THEN 'high' ELSE 'safe' END AS risk_level, reason, left(trim(reason), 100) AS msg FROM e)"""
THREATS = f"""t AS (SELECT printf('T-%05d', row_number() OVER (ORDER BY ts, id)) AS threat_id, id AS event_id, ts, {threat('severity')} AS severity,
  {threat('type')} AS type, src, {region('src')} AS src_region, dst, rule, 'Blocked' AS action, {threat('confidence')} AS confidence
  FROM l WHERE level = 'BLOCK')"""
EPOCH = "(epoch_us(ts) // 1000000)"

RULE_ROWS = "r(id, action, match_type, value, priority, seq) AS (VALUES " + ", ".join(
    f"('{i}', '{a}', '{m}', '{v}', {p}, {n})" for n, (i, a, m, v, p, on) in enumerate(dv.RULES) if on) + ")"
RULE_TEST = """CASE r.match_type WHEN 'ip_src' THEN lower(source_ip) = r.value WHEN 'ip_dst' THEN lower(destination_ip) = r.value
  WHEN 'port' THEN port = r.value WHEN 'domain' THEN contains(lower(destination_ip), r.value) ELSE contains(lower(text_content), r.value) END"""
TRAFFIC = """tr AS (SELECT e.*, doc_id, text AS text_content FROM e JOIN d ON d.doc_id = e.event_id % (SELECT count(*) FROM documents))"""
MATCHED = f"""m AS (SELECT tr.*, w.rule_id, w.action, w.match_type, w.rule_value FROM tr LEFT JOIN (
  SELECT tr.id AS eid, r.id AS rule_id, r.action, r.match_type, r.value AS rule_value,
    row_number() OVER (PARTITION BY tr.id ORDER BY r.priority, r.seq) AS nth FROM tr JOIN r ON {RULE_TEST}) w ON w.eid = tr.id AND w.nth = 1)"""
# The same over ids alone: each document meets the keyword rules once, and events carry no texts.
TRAFFIC_IDS = "tr AS (SELECT e.*, doc_id FROM e JOIN (SELECT doc_id FROM documents) ON doc_id = e.event_id % (SELECT count(*) FROM documents))"
MATCHED_IDS = """kw AS (SELECT doc_id AS kd, r.id AS kr FROM d JOIN r ON r.match_type = 'keyword' AND contains(lower(text), r.value)),
w AS (SELECT tr.id AS eid, r.id AS rule_id, r.action, r.match_type, r.value AS rule_value, row_number() OVER (PARTITION BY tr.id ORDER BY r.priority, r.seq) AS nth
  FROM tr CROSS JOIN r LEFT JOIN kw ON kd = tr.doc_id AND kr = r.id WHERE CASE r.match_type WHEN 'ip_src' THEN lower(source_ip) = r.value
    WHEN 'ip_dst' THEN lower(destination_ip) = r.value WHEN 'port' THEN port = r.value WHEN 'domain' THEN contains(lower(destination_ip), r.value) ELSE kr IS NOT NULL END),
m AS (SELECT tr.*, rule_id, action, match_type, rule_value FROM tr LEFT JOIN w ON eid = tr.id AND nth = 1)"""
ALLOWED = r"""regexp_matches(host, '^.*\.(whatsapp\.net|whatsapp\.com|snapchat\.com|sc-cdn\.net|fortinet\.net|google\.com|wicar\.org)$')"""
