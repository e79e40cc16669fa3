"""Queries over rules and allowlists."""

from pyspark.sql import functions as F

from packetloom.operators import rules as ru
from packetloom.operators.allowlist import apply_allowlist_changes, bypass_inspection, pinned_tls_blocks
from packetloom.plans import sql_parts as sp
from packetloom.plans.registry import query
from packetloom.sources import derived as dv
from packetloom.sources.tables import parse_allowlist, parse_rules

_HOST = "split_part(url, '/', 3)"
# One configuration document per page: two rules, the second with gaps.
_RULE_CONFIG = f"""concat('{{"rules":[{{"id":"a', page_id, '","action":"block","match_type":"domain","value":"', {_HOST},
 '","priority":', page_id % 7, ',"enabled":', if(page_id % 3 = 0, 'false', 'true'), ',"unknown_key":1}},{{"id":"b', page_id,
 '","action":"allow","match_type":"port","value":" 80 "}}]}}')"""


@query("rule_table", f"""SELECT page_id, 'a' || page_id AS id, 'block' AS action, 'domain' AS match_type, {_HOST} AS value, page_id % 7 AS priority,
  page_id % 3 <> 0 AS enabled, '' AS description, 0 AS hits24h, '' AS updated, 0 AS seq FROM pages UNION ALL
  SELECT page_id, 'b' || page_id, 'allow', 'port', ' 80 ', 100, true, '', 0, '', 1 FROM pages""")
def rule_table(spark, sf):
    configs = dv.table(spark, sf, "pages").select("page_id", F.expr(_RULE_CONFIG).alias("config"))
    return parse_rules(configs, "config", "page_id")


@query("allowlist_table", f"""SELECT page_id, lower({_HOST}) AS host FROM pages UNION ALL SELECT page_id, '*.' || (page_id % 5) || '.net' FROM pages""")
def allowlist_table(spark, sf):
    config = F.expr(f"""concat('{{"hosts":["  ', upper({_HOST}), ' ", "", 5, null, "   ", "*.', page_id % 5, '.net"]}}')""")
    return parse_allowlist(dv.table(spark, sf, "pages").select("page_id", config.alias("config")), "config", "page_id")


def _page_rules(spark, sf):
    """One rule per page, in page order."""
    return dv.table(spark, sf, "pages").select(
        F.expr("concat('p', page_id)").alias("id"), F.expr("if(page_id % 2 = 0, 'allow', 'block')").alias("action"),
        F.expr("element_at(array('ip_src', 'ip_dst', 'port', 'domain', 'keyword', 'other'), cast(page_id % 6 + 1 as int))").alias("match_type"),
        F.expr(_HOST).alias("value"), F.expr("cast(page_id % 7 as int)").alias("priority"), F.expr("page_id % 3 <> 0").alias("enabled"),
        F.expr("if(page_id % 4 = 0, concat('Rule for ', page_id), '')").alias("description"),
        F.expr("if(page_id % 5 = 0, null, page_id)").alias("hits24h"),
        F.expr("if(page_id % 9 = 0, null, timestamp_ntz'2024-01-31 00:00:00' - make_dt_interval(0, 0, 0, page_id * page_id))").alias("updated"),
        F.col("page_id").cast("int").alias("seq"))


_PAGE_RULES = f"""pr AS (SELECT 'p' || page_id AS id, CASE WHEN page_id % 2 = 0 THEN 'allow' ELSE 'block' END AS action,
  (['ip_src', 'ip_dst', 'port', 'domain', 'keyword', 'other'])[page_id % 6 + 1] AS match_type, {_HOST} AS value, page_id % 7 AS priority,
  page_id % 3 <> 0 AS enabled, CASE WHEN page_id % 4 = 0 THEN 'Rule for ' || page_id ELSE '' END AS description,
  CASE WHEN page_id % 5 = 0 THEN 0 ELSE page_id END AS hits24h, CASE WHEN page_id % 9 = 0 THEN NULL ELSE page_id * page_id END AS age, page_id AS seq FROM pages)"""
_VIEW = f"""{_PAGE_RULES}, rv AS (SELECT 'R-' || id AS id, CASE WHEN description <> '' THEN description ELSE match_type || ' ' || action || ' ' || value END AS name,
  CASE match_type WHEN 'domain' THEN 'Allowlist' WHEN 'keyword' THEN 'WAF' WHEN 'other' THEN 'Custom' ELSE 'Network' END AS category,
  CASE action WHEN 'allow' THEN 'Allow' ELSE 'Block' END AS action, match_type || '=' || value AS targets, hits24h, enabled,
  CASE WHEN age IS NULL THEN 'just now' WHEN age < 60 THEN greatest(1, age) || 's ago' WHEN age < 3600 THEN (age // 60) || 'm ago'
    WHEN age < 86400 THEN (age // 3600) || 'h ago' ELSE (age // 86400) || 'd ago' END AS updated FROM pr)"""


def _view(spark, sf):
    return ru.rule_view(_page_rules(spark, sf), F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"))


@query("rule_view", f"WITH {_VIEW} SELECT * FROM rv")
def rule_view(spark, sf):
    return _view(spark, sf)


@query("rule_search", f"WITH {_VIEW} SELECT id, name, category FROM rv WHERE category = 'Network' AND (contains(lower(name), 'blog') OR contains(lower(id), 'blog'))")
def rule_search(spark, sf):
    return ru.search_rules(_view(spark, sf), "BLOG", "Network").select("id", "name", "category")


@query("rule_categories", f"WITH {_VIEW} SELECT DISTINCT category FROM rv")
def rule_categories(spark, sf):
    return ru.rule_categories(_view(spark, sf))


@query("rule_activity", f"WITH {_PAGE_RULES} SELECT count(*) FILTER (enabled) AS active, count(*) AS total FROM pr")
def rule_activity(spark, sf):
    return ru.rule_activity(_page_rules(spark, sf))


@query("rules_by_priority", f"WITH {_PAGE_RULES} SELECT id, priority, seq, row_number() OVER (ORDER BY priority, seq) AS place FROM pr")
def rules_by_priority(spark, sf):
    from packetloom.operators.telemetry import number_rows
    return number_rows(ru.rules_by_priority(_page_rules(spark, sf)), "place", "priority", "seq").select("id", "priority", "seq", "place")


@query("rule_first_match", f"""WITH {sp.DOCS}, {sp.EVENTS}, {sp.TRAFFIC_IDS}, {sp.RULE_ROWS}, {sp.MATCHED_IDS}
  SELECT id, rule_id, CASE action WHEN 'block' THEN 'block' WHEN 'allow' THEN 'allow' END AS status,
  CASE action WHEN 'block' THEN 'critical' WHEN 'allow' THEN 'safe' END AS risk_level,
  'Static rule match (' || match_type || '=' || rule_value || '): ' || upper(action) AS reason, 'R-' || rule_id AS rule_label FROM m""")
def rule_first_match(spark, sf):
    matched = ru.match_rules(dv.traffic(spark, sf), dv.rules(spark))
    verdict = ru.rule_verdict(F.col("rule"))
    return matched.select("id", F.col("rule.id").alias("rule_id"), *[column.alias(name) for name, column in verdict.items()])


@query("rule_hits", f"""WITH {sp.DOCS}, {sp.EVENTS}, {sp.TRAFFIC}, {sp.RULE_ROWS}, {sp.MATCHED}
  SELECT a.id, count(m.id) AS hits FROM (SELECT id FROM r UNION ALL SELECT 'kw-off') a LEFT JOIN m ON m.rule_id = a.id GROUP BY a.id""")
def rule_hits(spark, sf):
    rules = dv.rules(spark)
    return ru.rule_hits(ru.match_rules(dv.traffic(spark, sf), rules), rules)


@query("rule_hits_24h", f"""WITH {sp.DOCS}, {sp.EVENTS}, {sp.TRAFFIC}, {sp.RULE_ROWS}, {sp.MATCHED}
  SELECT a.id, count(m.id) AS hits FROM (SELECT id FROM r UNION ALL SELECT 'kw-off') a
  LEFT JOIN m ON m.rule_id = a.id AND m.ts >= TIMESTAMP '2024-01-30 00:00:00' GROUP BY a.id""")
def rule_hits_24h(spark, sf):
    rules = dv.rules(spark)
    since = F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")
    return ru.rule_hits(ru.match_rules(dv.traffic(spark, sf), rules), rules, since)


# Every event is a change of one of the page rules or of a new rule.
_CHANGES = f"""SELECT event_id AS change_ts, CASE event_id % 4 WHEN 0 THEN 'add' WHEN 1 THEN 'delete' ELSE 'toggle' END AS op,
  'p' || CAST(user_id * 5 + event_id % 3 AS STRING) AS id, CASE WHEN event_id % 5 = 0 THEN 'drop' ELSE ' BLOCK' END AS action, 'Domain ' AS match_type,
  ' h' || CAST(event_id AS STRING) || ' ' AS value, CAST(event_id % 50 AS INT) AS priority, event_id % 2 = 0 AS enabled, ' d ' AS description FROM events"""


@query("rule_changes", f"""WITH {_PAGE_RULES}, ch AS ({_CHANGES}),
  ok AS (SELECT * FROM ch WHERE op <> 'add' OR trim(action) <> 'drop'),
  st AS (SELECT id, max(change_ts) FILTER (op = 'delete') AS del, max(change_ts) FILTER (op = 'add') AS ad FROM ok GROUP BY id),
  live AS (SELECT st.id, 'block' AS action, 'domain' AS match_type, trim(ok.value) AS value, ok.priority, ok.enabled, 'd' AS description, st.ad AS since
      FROM st JOIN ok ON ok.id = st.id AND ok.op = 'add' AND ok.change_ts = st.ad WHERE del IS NULL OR ad > del
    UNION ALL SELECT pr.id, pr.action, pr.match_type, pr.value, pr.priority, pr.enabled, pr.description, NULL FROM pr LEFT JOIN st ON st.id = pr.id
      WHERE st.del IS NULL AND st.ad IS NULL),
  tg AS (SELECT live.id, count(*) AS flips, max(change_ts) AS last FROM live JOIN ok ON ok.id = live.id AND ok.op = 'toggle' AND (since IS NULL OR change_ts > since) GROUP BY live.id)
  SELECT live.id, live.action, live.match_type, live.value, live.priority, CASE WHEN coalesce(flips, 0) % 2 = 1 THEN NOT live.enabled ELSE live.enabled END AS enabled,
    live.description, CASE WHEN since IS NULL THEN hits24h ELSE 0 END AS hits24h,
    coalesce(CAST(coalesce(last, since) AS VARCHAR), CAST(TIMESTAMP '2024-01-31 00:00:00' - to_seconds(age) AS VARCHAR)) AS updated,
    CAST(CASE WHEN since IS NULL THEN seq ELSE (SELECT max(seq) FROM pr) + row_number() OVER (PARTITION BY since IS NULL ORDER BY since, live.id) END AS INT) AS seq
  FROM live LEFT JOIN tg ON tg.id = live.id LEFT JOIN pr ON pr.id = live.id AND since IS NULL""")
def rule_changes(spark, sf):
    changes = spark.sql(_CHANGES.replace("FROM events", "FROM {events}"), events=dv.table(spark, sf, "events"))
    return ru.apply_rule_changes(_page_rules(spark, sf), changes)


@query("allowlist_changes", f"""WITH ch AS (SELECT event_id AS change_ts, CASE WHEN event_id % 3 = 0 THEN 'remove' ELSE 'add' END AS op,
    'h' || (user_id % 97) || '.example.net' AS host FROM events WHERE user_id % 11 <> 0),
  last AS (SELECT host, arg_max(op, change_ts) AS op FROM ch GROUP BY host), base AS (SELECT DISTINCT {_HOST} AS host FROM pages)
  SELECT coalesce(base.host, last.host) AS host FROM base FULL JOIN last ON base.host = last.host WHERE op = 'add' OR op IS NULL""")
def allowlist_changes(spark, sf):
    base = dv.table(spark, sf, "pages").select(F.expr(_HOST).alias("host")).distinct()
    changes = dv.table(spark, sf, "events").select(
        F.col("event_id").alias("change_ts"), F.expr("if(event_id % 3 = 0, 'remove', 'add')").alias("op"),
        F.expr("if(user_id % 11 = 0, '  ', concat(' H', user_id % 97, '.Example.net'))").alias("host"))
    return apply_allowlist_changes(base, changes)


@query("allowlist_bypass", f"""WITH {sp.EVENTS}, h AS (SELECT id, destination_ip AS host, port FROM e) SELECT id, host FROM h WHERE port = '443' AND {sp.ALLOWED}""")
def allowlist_bypass(spark, sf):
    events = dv.events_x(spark, sf).select("id", F.col("destination_ip").alias("host"), (F.col("port") == "443").alias("is_tls"))
    return bypass_inspection(events, dv.allowlist(spark)).select("id", "host")


@query("pinned_tls_blocks", f"""WITH {sp.EVENTS}, h AS (SELECT id, source_ip, CASE WHEN id % 7 = 0 THEN '' ELSE destination_ip END AS host, destination_ip, port, status FROM e)
  SELECT id, source_ip, destination_ip, port, 'block' AS status, 'high' AS risk_level, 'PINNED-TLS' AS rule,
  'Client rejected MITM cert (SSLError) — add host to allowlist to bypass' AS reason FROM h WHERE status <> 'allow' AND NOT {sp.ALLOWED}""")
def pinned(spark, sf):
    shakes = dv.events_x(spark, sf).select("id", "source_ip", F.expr("if(id % 7 = 0, '', destination_ip)").alias("host"), "destination_ip", "port",
                                           F.expr("if(status = 'allow', null, 'SSLError')").alias("error"))
    return pinned_tls_blocks(shakes, dv.allowlist(spark)).select(
        "id", "source_ip", "destination_ip", "port", "status", "risk_level", "rule", "reason")
