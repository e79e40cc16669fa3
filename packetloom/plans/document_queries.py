"""Queries over documents: signatures, reputation, metadata, structure, verdicts."""

from pyspark.sql import functions as F

from packetloom import fixed_values as fv
from packetloom.functions.payload import byte_entropy
from packetloom.operators.content import content  # noqa: F401
from packetloom.operators.detector import detect, long_form
from packetloom.operators.forest import fit_forest, forest_anomaly
from packetloom.operators.metadata import metadata  # noqa: F401
from packetloom.operators.pdf import pdf_parts
from packetloom.operators.signatures import with_hash_intel
from packetloom.operators import structure as st
from packetloom.operators.verdict import DOCUMENT_MODULES, document_verdict, verdict_of_long
from packetloom.plans import sql_parts as sp
from packetloom.plans.inspect import inspect_documents
from packetloom.plans.registry import query
from packetloom.sources import derived as dv

# --- signatures and reputation -------------------------------------------
_SIG_BODY = """CASE doc_id % 7 WHEN 0 THEN '%PDF-1.4 /OpenAction /JS ' || text WHEN 1 THEN '%PDF-1.4 /EmbeddedFile MZ ' || text
 WHEN 2 THEN 'PK' || chr(3) || chr(4) || 'word/vbaProject.bin ' || text WHEN 3 THEN 'Equation Native ' || text WHEN 4 THEN ' /Launch ' || text ELSE text END"""
_FLAGS = f"""{sp.DOCS}, s AS (SELECT doc_id, {sp.EICAR} AS eicar, doc_id % 7 AS k FROM d)"""
_SIG_TESTS = {"EICAR_Test_String": "eicar", "Office_VBA_Macro_Project": "k = 2", "PDF_JavaScript_Launcher": "k = 0",
              "PDF_Embedded_Executable": "k = 1", "Office_Equation_Editor_CVE_2017_11882": "k = 3"}
_SIG_FINDINGS = "concat_ws('|', " + ", ".join(
    f"CASE WHEN {_SIG_TESTS[s['name']]} THEN 'YARA: {s['name']} ({s['severity']}) — {s['description']}' END"
    for s in fv.SIGNATURES if s["name"] in _SIG_TESTS) + ")"


@query("signature_scan", f"""WITH {_FLAGS} SELECT doc_id, CASE WHEN k IN (1, 3) THEN 0.99::DOUBLE WHEN eicar OR k IN (0, 2) THEN 0.95::DOUBLE ELSE 0.0::DOUBLE END AS score,
  {_SIG_FINDINGS} AS findings FROM s""")
def signature_scan(spark, sf):
    docs = dv.documents_x(spark, sf).select("doc_id", F.expr(_SIG_BODY).cast("binary").alias("payload"))
    return detect(docs, {"malware": F.col("payload")}).select(
        "doc_id", F.col("malware_score").alias("score"), F.array_join(F.col("malware_findings"), "|").alias("findings"))


_INTEL = "intel AS (SELECT sha256(text) AS sha, max(toxic) AS malicious FROM d JOIN labels USING (doc_id) GROUP BY 1)"


def _intel(spark, sf):
    return dv.documents_x(spark, sf).join(dv.table(spark, sf, "labels"), "doc_id").select(
        F.sha2("payload", 256).alias("sha256"), F.col("toxic").alias("malicious"))


@query("hash_intel", f"""WITH {sp.DOCS}, {_INTEL} SELECT doc_id, CASE WHEN coalesce(malicious, 0) > 0 THEN 0.99::DOUBLE ELSE 0.0::DOUBLE END AS intel_score,
  greatest(CASE WHEN coalesce(malicious, 0) > 0 THEN 0.99::DOUBLE ELSE 0.0::DOUBLE END, CASE WHEN {sp.EICAR} THEN 0.95::DOUBLE ELSE 0.0::DOUBLE END) AS score
  FROM d LEFT JOIN intel ON sha = sha256(text)""")
def hash_intel(spark, sf):
    scanned = detect(dv.documents_x(spark, sf), {"malware": F.col("payload")})
    return with_hash_intel(scanned, F.col("payload"), _intel(spark, sf)).select("doc_id", "intel_score", F.col("malware_score").alias("score"))


# --- metadata -------------------------------------------------------------
_PRODUCER = "CASE doc_id % 5 WHEN 0 THEN 'Microsoft Word 16' WHEN 1 THEN 'msfvenom payload generator' WHEN 2 THEN 'Foo Writer' WHEN 3 THEN '' ELSE NULL END"
_AUTHOR = """CASE doc_id % 4 WHEN 0 THEN 'C:' || chr(92) || 'Users' || chr(92) || 'victim' || chr(92) || 'Desktop' WHEN 1 THEN '/home/bob/x /Users/eve/y'
 WHEN 2 THEN 'bob' ELSE NULL END"""
_META_SQL = f"""{sp.DOCS}, x AS (SELECT doc_id, {_PRODUCER} AS producer, {_AUTHOR} AS author, doc_id % 10 = 2 AS gps, doc_id % 6 = 2 AS rev FROM d),
  mt AS (SELECT *, CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS leaks, CASE WHEN producer LIKE 'msf%' THEN 1 ELSE 0 END AS susp,
    CASE WHEN producer IN ('Foo Writer', '') THEN 1 ELSE 0 END AS unk FROM x),
  meta AS (SELECT *, least(0.9::DOUBLE, 0.25::DOUBLE * (leaks + gps::INT + susp + rev::INT) + 0.1::DOUBLE * unk) AS meta_score FROM mt)"""


def _with_meta(df):
    pairs = F.array_compact(F.array(*[
        F.when(value.isNotNull(), F.struct(F.lit(key).alias("key"), value.alias("value")))
        for key, value in (("author", F.expr(_AUTHOR)), ("producer", F.expr(_PRODUCER)), ("GPSLatitude", F.expr("if(doc_id % 10 = 2, '1.5', null)")),
                           ("has_revisions", F.expr("if(doc_id % 6 = 2, 'True', null)")))]))
    return df.withColumn("meta", F.map_from_entries(pairs))


@query("metadata_forensics", f"""WITH {_META_SQL} SELECT doc_id, meta_score AS score, concat_ws('|',
  CASE doc_id % 4 WHEN 0 THEN 'Local path leak: C:' || chr(92) || 'Users' || chr(92) || 'victim' WHEN 1 THEN 'Local path leak: /home/bob/|Local path leak: /Users/eve/' END,
  CASE WHEN gps THEN 'GPS coordinates embedded in document metadata' END, CASE WHEN susp = 1 THEN 'Suspicious producer: ' || producer END,
  CASE WHEN unk = 1 THEN 'Unrecognised producer/creator: ' || producer END, CASE WHEN rev THEN 'Document contains tracked changes / revision history' END) AS findings FROM meta""")
def metadata_forensics(spark, sf):
    docs = _with_meta(dv.documents_x(spark, sf))
    return detect(docs, {"metadata": F.col("meta")}).select(
        "doc_id", F.col("metadata_score").alias("score"), F.array_join(F.col("metadata_findings"), "|").alias("findings"))


# --- structure ------------------------------------------------------------
@query("zip_entries", """WITH g AS (SELECT doc_id, text FROM documents WHERE doc_id % 11 <> 0)
  SELECT doc_id, '[Content_Types].xml' AS entry_name, 0 AS chars FROM g
  UNION ALL SELECT doc_id, 'word/document.xml', length('<w:document><w:t>' || text || '</w:t></w:document>') + CASE WHEN doc_id % 5 = 0 THEN 8 ELSE 0 END FROM g
  UNION ALL SELECT doc_id, 'docProps/core.xml', length('<cp><dc:creator>/home/bob/x</dc:creator></cp>') FROM g WHERE doc_id % 4 = 0
  UNION ALL SELECT doc_id, 'word/vbaProject.bin', 0 FROM g WHERE doc_id % 7 = 0 UNION ALL SELECT doc_id, 'word/embeddings/oleObject1.bin', 0 FROM g WHERE doc_id % 6 = 0
  UNION ALL SELECT doc_id, 'word/_rels/document.xml.rels', length('<Relationships />') + 22 * (doc_id % 3) FROM g""")
def zip_entries(spark, sf):
    entries = st.zip_entries(dv.office_files(spark, sf), "doc_id", F.col("payload"))
    return entries.select("doc_id", "entry_name", F.coalesce(F.length("entry_text"), F.lit(0)).alias("chars"))


@query("office_structure", """SELECT doc_id, doc_id % 11 <> 0 AS readable, CASE WHEN doc_id % 11 = 0 THEN 0.0::DOUBLE ELSE
    (3 + (doc_id % 4 = 0)::INT + (doc_id % 7 = 0)::INT + (doc_id % 6 = 0)::INT)::DOUBLE END AS object_count,
  (doc_id % 11 <> 0 AND doc_id % 7 = 0)::INT::DOUBLE AS vba_project, (doc_id % 11 <> 0 AND doc_id % 6 = 0)::INT::DOUBLE AS ole_object,
  (doc_id % 11 <> 0 AND doc_id % 6 = 0)::INT::DOUBLE AS embedded_files, CASE WHEN doc_id % 11 = 0 THEN 0.0::DOUBLE ELSE (doc_id % 3)::DOUBLE END AS external_rels,
  CASE WHEN doc_id % 11 <> 0 AND doc_id % 7 = 0 THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END AS score FROM documents""")
def office_structure(spark, sf):
    files = dv.office_files(spark, sf).withColumn("entries", st.container_entries(F.col("payload")))
    featured = files.withColumn("features", st.structure_features(F.col("payload"), F.col("entries")))
    scored = detect(featured, {"structure": {"features": F.col("features"), "anomaly": F.lit(0.0)}})
    return scored.select("doc_id", F.col("entries").isNotNull().alias("readable"),
                         *[F.coalesce(F.element_at("features", n), F.lit(0.0)).alias(n)
                           for n in ("object_count", "vba_project", "ole_object", "embedded_files", "external_rels")],
                         F.col("structure_score").alias("score"))


@query("pdf_structure", """SELECT doc_id, (5 + (doc_id % 8 = 0)::INT)::DOUBLE AS object_count, 1.0::DOUBLE AS stream_count, 1.0::DOUBLE AS page_count,
  (2 * (doc_id % 8 = 0)::INT)::DOUBLE AS javascript, ((doc_id % 4 = 0)::INT)::DOUBLE AS openaction, ((doc_id % 6 = 0)::INT)::DOUBLE AS acroform,
  CASE WHEN doc_id % 4 = 0 THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END AS score, concat_ws('|', 'Structural features: '
   || CASE WHEN doc_id % 8 = 0 THEN 'javascript=2, ' ELSE '' END || CASE WHEN doc_id % 4 = 0 THEN 'openaction=1, ' ELSE '' END || CASE WHEN doc_id % 6 = 0 THEN 'acroform=1, ' ELSE '' END
   || 'object_count=' || (5 + (doc_id % 8 = 0)::INT) || ', stream_count=1, page_count=1',
   CASE WHEN doc_id % 4 = 0 THEN 'Hard-rule structure trigger: ' || CASE WHEN doc_id % 8 = 0 THEN 'javascript, ' ELSE '' END || 'openaction' END) AS findings FROM documents""")
def pdf_structure(spark, sf):
    featured = dv.pdf_files(spark, sf).withColumn("features", st.pdf_features(F.col("payload")))
    scored = detect(featured, {"structure": {"features": F.col("features"), "anomaly": F.lit(0.0)}})
    return scored.select("doc_id", *[F.element_at("features", n).alias(n) for n in ("object_count", "stream_count", "page_count", "javascript", "openaction", "acroform")],
                         F.col("structure_score").alias("score"), F.array_join(F.col("structure_findings"), "|").alias("findings"))


# Per document: objects 4 and 6, two for each line, and the packed ones; entry 0 is free.
@query("pdf_packed_structure", """WITH p AS (SELECT doc_id, len(string_split(coalesce(text, ''), chr(10))) AS pages, doc_id % 11 <> 5 AS whole FROM documents),
  f AS (SELECT doc_id, (3 + 2 * pages + CASE WHEN whole THEN 3 + (doc_id % 4 = 0)::INT ELSE 0 END)::DOUBLE AS object_count, (2 + pages)::DOUBLE AS stream_count,
    pages::DOUBLE AS page_count, CASE WHEN whole AND doc_id % 4 = 0 THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END AS javascript,
    CASE WHEN whole AND doc_id % 3 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS openaction FROM p)
  SELECT *, CASE WHEN javascript + openaction > 0 THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END AS score FROM f""")
def pdf_packed_structure(spark, sf):
    files = dv.packed_pdf_files(spark, sf).withColumn("parts", pdf_parts(F.col("payload")))
    featured = files.withColumn("features", st.pdf_features(F.col("payload"), F.col("parts.packed")))
    scored = detect(featured, {"structure": {"features": F.col("features"), "anomaly": F.lit(0.0)}})
    return scored.select("doc_id", *[F.element_at("features", n).alias(n) for n in ("object_count", "stream_count", "page_count", "javascript", "openaction")],
                         F.col("structure_score").alias("score"))


# Texts of the first five pages; in files with one-byte codes other letters are question marks.
# With a damaged object stream there is no map to Unicode, so those with two-byte codes are left out.
@query("pdf_text", """WITH l AS (SELECT doc_id, array_to_string(string_split(coalesce(text, ''), chr(10))[1:5], chr(10)) AS shown FROM documents
    WHERE doc_id % 11 <> 5 OR doc_id % 2 = 0),
  t AS (SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN shown ELSE regexp_replace(shown, '[^\x00-\xFF]', '?', 'g') END AS text FROM l)
  SELECT doc_id, length(text) AS n_chars, sha256(text) AS text_sha256 FROM t""")
def pdf_text(spark, sf):
    read = dv.packed_pdf_files(spark, sf).filter("doc_id % 11 <> 5 OR doc_id % 2 = 0").select("doc_id", pdf_parts(F.col("payload"))["text"].alias("text"))
    return read.select("doc_id", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


@query("isolation_forest")
def isolation_forest(spark, sf):
    files = dv.pdf_files(spark, sf).unionByName(dv.office_files(spark, sf).withColumn("doc_id", -F.col("doc_id") - 1))
    featured = files.withColumn("features", st.structure_features(
        F.col("payload"), st.container_entries(F.col("payload")), byte_entropy(F.col("payload"))))
    return featured.select("doc_id", forest_anomaly(spark, fit_forest(spark), F.col("features")).alias("anomaly"))


@query("structure_score", """SELECT doc_id, greatest(CASE WHEN doc_id % 3 = 0 THEN 0.25::DOUBLE ELSE 0.9::DOUBLE END, CASE WHEN doc_id % 5 = 0 OR doc_id % 7 = 0 THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END) AS score,
  concat_ws('|', 'Structural features: ' || CASE WHEN doc_id % 5 = 0 THEN 'openaction=1, ' ELSE '' END || 'object_count=' || (doc_id % 9 + 1) || ', entropy=4.125' || CASE WHEN doc_id % 7 = 0 THEN ', vba_project=1' ELSE '' END,
  CASE WHEN doc_id % 5 = 0 OR doc_id % 7 = 0 THEN 'Hard-rule structure trigger: ' || concat_ws(', ', CASE WHEN doc_id % 5 = 0 THEN 'openaction' END, CASE WHEN doc_id % 7 = 0 THEN 'vba_project' END) END) AS findings FROM documents""")
def structure_score(spark, sf):
    features = F.expr("map('object_count', cast(doc_id % 9 + 1 as double), 'entropy', 4.125D, 'openaction', if(doc_id % 5 = 0, 1D, 0D), 'vba_project', if(doc_id % 7 = 0, 1D, 0D))")
    table = dv.table(spark, sf, "documents").select("doc_id", features.alias("features"), F.expr("if(doc_id % 3 = 0, 0.25D, 0.9D)").alias("anomaly"))
    return detect(table, {"structure": {"features": F.col("features"), "anomaly": F.col("anomaly")}}).select(
        "doc_id", F.col("structure_score").alias("score"), F.array_join(F.col("structure_findings"), "|").alias("findings"))


# --- verdicts -------------------------------------------------------------
_DOC_SCORES = f"""{_META_SQL}, {sp.CONTENT}, {_INTEL}, sc AS (SELECT d.doc_id, meta_score AS metadata, content_score AS content,
  CASE WHEN coalesce(malicious, 0) > 0 THEN 0.99::DOUBLE WHEN {sp.EICAR} THEN 0.95::DOUBLE ELSE 0.0::DOUBLE END AS malware,
  CASE WHEN d.doc_id % 5 = 0 THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END AS structure FROM d JOIN meta USING (doc_id) JOIN content USING (doc_id) LEFT JOIN intel ON sha = sha256(text)),
  v AS (SELECT *, greatest(metadata, content, malware, structure) AS hi, malware * 0.4::DOUBLE + structure * 0.25::DOUBLE + content * 0.2::DOUBLE + metadata * 0.15::DOUBLE AS weighted FROM sc)"""
_DOC_JUDGE = """CASE WHEN hi > 0.8 OR weighted > 0.5 THEN 'block' ELSE 'allow' END AS status, CASE WHEN hi > 0.8 THEN 'critical' WHEN weighted > 0.5 THEN 'medium' ELSE 'safe' END AS risk_level,
  CASE WHEN hi > 0.8 THEN 'Critical document threat (max=' || printf('%.2f', hi) || ')' WHEN weighted > 0.5 THEN 'Combined document risk threshold exceeded (weighted=' || printf('%.2f', weighted) || ')' ELSE 'Safe' END AS reason,
  hi AS max_score, round(weighted, 9) AS weighted_score"""


def _document_results(spark, sf):
    docs = _with_meta(dv.documents_x(spark, sf))
    features = F.expr("map('openaction', if(doc_id % 5 = 0, 1D, 0D))")
    found = detect(docs, {"structure": {"features": features, "anomaly": F.lit(0.0)}, "content": F.col("text"),
                          "malware": F.col("payload"), "metadata": F.col("meta")})
    return with_hash_intel(found, F.col("payload"), _intel(spark, sf))


@query("document_verdict", f"WITH {_DOC_SCORES} SELECT doc_id, {_DOC_JUDGE}, structure AS score_structure, content AS score_content, malware AS score_malware, metadata AS score_metadata FROM v")
def document_verdict_query(spark, sf):
    judged = document_verdict(_document_results(spark, sf))
    return judged.select("doc_id", "status", "risk_level", "reason", "max_score", F.round("weighted_score", 9).alias("weighted_score"),
                         *[F.element_at("scores", m).alias(f"score_{m}") for m in DOCUMENT_MODULES])


@query("module_verdict", f"WITH {_DOC_SCORES} SELECT doc_id, {_DOC_JUDGE} FROM v")
def module_verdict(spark, sf):
    results = long_form(_document_results(spark, sf), "doc_id", list(DOCUMENT_MODULES))
    return verdict_of_long(results, "doc_id", fv.DOCUMENT_WEIGHTS, "document")


@query("pdf_verdict", """WITH v AS (SELECT doc_id, CASE WHEN doc_id % 8 = 0 THEN 0.95::DOUBLE WHEN doc_id % 4 = 0 THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END AS hi FROM documents)
  SELECT doc_id, hi AS max_score, CASE WHEN hi > 0.8 THEN 'block' ELSE 'allow' END AS status, CASE WHEN hi > 0.8 THEN 'Critical document threat (max=0.95)' ELSE 'Safe' END AS reason FROM v""")
def pdf_verdict(spark, sf):
    return inspect_documents(dv.pdf_files(spark, sf)).select("doc_id", "max_score", "status", "reason")


@query("office_verdict", """WITH v AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 0.0::DOUBLE WHEN doc_id % 7 = 0 THEN 0.95::DOUBLE ELSE 0.0::DOUBLE END AS malware,
  CASE WHEN doc_id % 11 = 0 THEN 0.0::DOUBLE ELSE 0.25::DOUBLE * ((doc_id % 4 = 0)::INT + (doc_id % 5 = 0)::INT) END AS metadata FROM documents)
  SELECT doc_id, malware AS score_malware, metadata AS score_metadata, CASE WHEN malware > 0.8 THEN 'block' ELSE 'allow' END AS status FROM v""")
def office_verdict(spark, sf):
    judged = inspect_documents(dv.office_files(spark, sf))
    return judged.select("doc_id", F.element_at("scores", "malware").alias("score_malware"), F.element_at("scores", "metadata").alias("score_metadata"), "status")
