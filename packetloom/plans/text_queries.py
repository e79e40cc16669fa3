"""Queries over text: detectors, personal data, concepts, redaction."""

from pyspark.sql import functions as F

from packetloom.functions.payload import markup_text, plain_document_text
from packetloom.operators.content import best_label, bucket_hits
from packetloom.operators.detector import detect
from packetloom.operators.text import best_concept, pii_table, redact
from packetloom.operators.verdict import text_verdict
from packetloom.plans import sql_parts as sp
from packetloom.plans.inspect import inspect_text
from packetloom.plans.registry import query
from packetloom.sources import derived as dv


def _joined(module):
    return F.array_join(f"{module}_findings", "|")


@query("secret_scan", f"""WITH {sp.DOCS}, {sp.CODE} SELECT doc_id, {sp.CODE_SCORE} AS score, {sp.CODE_FINDINGS} AS findings FROM c""")
def secret_scan(spark, sf):
    return detect(dv.documents_x(spark, sf), {"code": F.col("text")}).select(
        "doc_id", F.col("code_score").alias("score"), _joined("code").alias("findings"))


@query("rce_scan", f"""WITH {sp.DOCS}, {sp.CODE} SELECT doc_id, CASE WHEN aws OR google OR pkey OR generic THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END AS score
  FROM c WHERE rce""")
def rce_scan(spark, sf):
    found = detect(dv.documents_x(spark, sf), {"code": F.col("text")})
    return found.filter(F.array_contains(F.col("code_findings"), "Potential RCE (Remote Code Execution) pattern")) \
        .select("doc_id", F.col("code_score").alias("score"))


@query("pii_scan", f"""WITH {sp.DOCS}, {sp.PII} SELECT doc_id, {sp.PII_SCORE} AS score, {sp.PII_FINDINGS} AS findings FROM p""")
def pii_scan(spark, sf):
    return detect(dv.documents_x(spark, sf), {"pattern": F.col("text")}).select(
        "doc_id", F.col("pattern_score").alias("score"), _joined("pattern").alias("findings"))


@query("pii_spans", f"""WITH {sp.DOCS}, {sp.PII}
  SELECT doc_id, 'PHONE_NUMBER' AS entity, unnest(phones) AS span FROM p UNION ALL SELECT doc_id, 'EMAIL_ADDRESS', unnest(emails) FROM p
  UNION ALL SELECT doc_id, 'IBAN', unnest(ibans) FROM p UNION ALL SELECT doc_id, 'CREDIT_CARD', unnest(cards) FROM p
  UNION ALL SELECT doc_id, 'US_SSN', unnest(ssns) FROM p""")
def pii_spans(spark, sf):
    return pii_table(dv.documents_x(spark, sf), "doc_id", F.col("text"))


@query("semantic_match", """WITH c AS (SELECT 'concept-' || label AS concept, arg_min(embedding, vec_id)::DOUBLE[] AS vec FROM embeddings GROUP BY label),
  s AS (SELECT vec_id, concept, list_cosine_similarity(embedding::DOUBLE[], vec) AS sim FROM embeddings CROSS JOIN c),
  b AS (SELECT vec_id, max(sim) AS sim, arg_max(concept, sim) AS concept FROM s GROUP BY vec_id)
  SELECT vec_id, round(sim, 9) AS similarity, concept, CASE WHEN sim > 0.5 THEN 0.8::DOUBLE WHEN sim > 0.35 THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END AS score,
  CASE WHEN sim > 0.5 THEN 'Semantic Threat Detected: ''' || concept || ''' (Confidence: ' || printf('%.2f', sim) || ')'
    WHEN sim > 0.35 THEN 'Potential Semantic Risk (' || printf('%.2f', sim) || ')' ELSE '' END AS findings FROM b""")
def semantic_match(spark, sf):
    vectors = dv.table(spark, sf, "embeddings")
    concepts = vectors.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("vec")) \
        .select(F.concat(F.lit("concept-"), "label").alias("concept"), "vec")
    matched = best_concept(vectors.select("vec_id", "embedding"), "embedding", concepts)
    return detect(matched, {"nlp": {"similarity": F.col("similarity"), "concept": F.col("concept")}}).select(
        "vec_id", F.round("similarity", 9).alias("similarity"), "concept", F.col("nlp_score").alias("score"), _joined("nlp").alias("findings"))


@query("context_score", """SELECT doc_id, 0.1::DOUBLE AS max_score, 'allow' AS status FROM documents""")
def context_score(spark, sf):
    return text_verdict(detect(dv.table(spark, sf, "documents"), {"context": F.col("text")})).select("doc_id", "max_score", "status")


@query("keyword_buckets", f"""WITH {sp.DOCS}, {sp.CONTENT} SELECT doc_id, h0, h1, h2, h3, h4, coalesce(label, '') AS label, content_score AS score,
  {sp.CONTENT_FINDINGS} AS findings FROM content""")
def keyword_buckets(spark, sf):
    docs = dv.documents_x(spark, sf).withColumn("low", F.lower("text"))
    counted = docs.withColumns(bucket_hits(F.col("low")))
    hits = {f"h{i}": F.col(f"h{i}") for i in range(5)}
    found = detect(counted, {"content": F.col("text")})
    return found.select("doc_id", *hits, F.coalesce(best_label(**hits), F.lit("")).alias("label"),
                        F.col("content_score").alias("score"), _joined("content").alias("findings"))


@query("text_verdict", f"""WITH {sp.DOCS}, {sp.CODE}, {sp.PII},
  s AS (SELECT c.doc_id, {sp.CODE_SCORE} AS code, {sp.PII_SCORE} AS pattern, concat_ws('|', nullif({sp.CODE_FINDINGS}, ''), nullif({sp.PII_FINDINGS}, '')) AS findings
    FROM c JOIN p USING (doc_id)), v AS (SELECT *, greatest(code, pattern, 0.1::DOUBLE) AS hi FROM s)
  SELECT doc_id, CASE WHEN hi > 0.5 THEN 'block' ELSE 'allow' END AS status, CASE WHEN hi > 0.8 THEN 'critical' WHEN hi > 0.5 THEN 'medium' ELSE 'safe' END AS risk_level,
  'Max threat score ' || hi AS reason, code AS score_code, pattern AS score_pattern, 0.1::DOUBLE AS score_context, findings FROM v""")
def text_verdict_query(spark, sf):
    judged = inspect_text(dv.documents_x(spark, sf), F.col("text"))
    return judged.select("doc_id", "status", "risk_level", "reason",
                         *[F.element_at("scores", m).alias(f"score_{m}") for m in ("code", "pattern", "context")],
                         F.array_join("findings", "|").alias("findings"))


@query("document_text", f"""WITH {sp.DOCS} SELECT doc_id AS id, 'plain' AS kind, length(text) AS chars, md5(text) AS digest FROM d
  UNION ALL SELECT page_id, 'markup', length(regexp_replace(html, '<[^>]+>', ' ', 'g')), md5(regexp_replace(html, '<[^>]+>', ' ', 'g')) FROM pages""")
def document_text(spark, sf):
    plain = dv.documents_x(spark, sf).select(F.col("doc_id").alias("id"), F.lit("plain").alias("kind"), plain_document_text(F.col("payload")).alias("t"))
    markup = dv.table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.lit("markup").alias("kind"), markup_text(F.col("html")).alias("t"))
    return plain.unionByName(markup).select("id", "kind", F.length("t").alias("chars"), F.md5("t").alias("digest"))


_REDACTED = "text"
for _regex, _mask in (("AKIA[0-9A-Z]{16}", "AWS_ACCESS_KEY"), (r"AIza[0-9A-Za-z\\-_]{35}", "GOOGLE_API_KEY"),
                      ("-----BEGIN (RSA|DSA|EC|OPENSSH) PRIVATE KEY-----", "PRIVATE_KEY_HEADER"),
                      (r"(?i)(api_key|secret|password)[\s]*=[\s]*[''\"][0-9a-zA-Z\-_]{16,}[''\"]", "GENERIC_SECRET"),
                      (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "EMAIL_ADDRESS"), (r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b", "IBAN"),
                      (r"\b[0-9](?:[ -]?[0-9]){12,18}\b", "CREDIT_CARD"), (r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "US_SSN"),
                      (r"(?:\+1[ .-]?)?\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}\b|\b(?:\+?1[ .-])?[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}\b", "PHONE_NUMBER")):
    _REDACTED = f"regexp_replace({_REDACTED}, '{_regex}', '<{_mask}>', 'g')"


@query("redact", f"""WITH {sp.DOCS} SELECT doc_id, {_REDACTED} AS text FROM d""")
def redact_query(spark, sf):
    return dv.documents_x(spark, sf).select("doc_id", redact(F.col("text")).alias("text"))
