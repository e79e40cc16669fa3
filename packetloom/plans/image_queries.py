"""Queries over the outputs of image models."""

from pyspark.sql import functions as F

from packetloom import fixed_values as fv
from packetloom.operators import image as im
from packetloom.operators.detector import detect
from packetloom.operators.verdict import image_verdict
from packetloom.plans import sql_parts as sp
from packetloom.plans.registry import query
from packetloom.sources import derived as dv

_PLAIN_LABELS = ("standard photo of nature or animals", "generic bar chart or graph", "plain photograph with no logos or branding")
_LABELS = [*fv.SENSITIVE_IMAGE_LABELS, *_PLAIN_LABELS]
_LABEL_LIST = "[" + ", ".join(f"'{label}'" for label in _LABELS) + "]"
_OCR_WORDS = fv.OCR_KEYWORDS
_OCR_HIT = " OR ".join(f"contains(lower(text), '{w}')" for w in _OCR_WORDS)


@query("ocr_keywords", f"""WITH {sp.DOCS} SELECT doc_id, CASE WHEN {_OCR_HIT} THEN 0.9::DOUBLE ELSE 0.0::DOUBLE END AS score,
  concat_ws('|', {", ".join(f"CASE WHEN contains(lower(text), '{w}') THEN 'Sensitive keyword detected: {w}' END" for w in _OCR_WORDS)}) AS findings FROM d""")
def ocr_keywords(spark, sf):
    return detect(dv.documents_x(spark, sf), {"ocr": F.col("text")}).select(
        "doc_id", F.col("ocr_score").alias("score"), F.array_join(F.col("ocr_findings"), "|").alias("findings"))


def _labels(spark, sf):
    """(image_id, label, logit): the vector components, dealt to the labels in turn, as logits."""
    part = lambda i: F.coalesce(F.get("embedding", i).cast("double"), F.lit(0.0))
    logit = F.transform(F.sequence(F.lit(0), F.lit(len(_LABELS) - 1)), lambda i: (
        part(i) + part(i + len(_LABELS)) + part(i + 2 * len(_LABELS))) * 20)
    pairs = dv.table(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode(logit).alias("i", "logit"))
    return pairs.select("image_id", F.get(F.array(*[F.lit(x) for x in _LABELS]), F.col("i")).alias("label"), "logit")


_BEST = f"""lg AS (SELECT vec_id AS image_id, unnest({_LABEL_LIST}) AS label, unnest(list_transform(range(1, {len(_LABELS) + 1}), lambda i:
    (coalesce(embedding[i]::DOUBLE, 0) + coalesce(embedding[i + {len(_LABELS)}]::DOUBLE, 0) + coalesce(embedding[i + {2 * len(_LABELS)}]::DOUBLE, 0)) * 20)) AS logit FROM embeddings),
  best AS (SELECT image_id, arg_max(label, logit) AS label, exp(max(logit)) / sum(exp(logit)) AS confidence, CASE WHEN image_id % 2 = 0 THEN 0.9::DOUBLE ELSE 0.0::DOUBLE END AS ocr_score FROM lg GROUP BY image_id)"""
_IDENTITY = "(" + " OR ".join(f"contains(label, '{term}')" for term in fv.IDENTITY_TERMS) + ")"
_SENSITIVE = "label NOT IN (" + ", ".join(f"'{x}'" for x in _PLAIN_LABELS) + ")"
_CLIP = f"CASE WHEN {_IDENTITY} AND confidence > 0.4 THEN 0.95::DOUBLE WHEN {_SENSITIVE} AND confidence > 0.6 THEN CASE WHEN ocr_score > 0.5 THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END ELSE 0.0::DOUBLE END"


@query("image_label_risk", f"""WITH {_BEST}, r AS (SELECT *, {_CLIP} AS score FROM best) SELECT image_id, label, round(confidence, 9) AS confidence, score,
  'Classified as: ' || label || ' (' || printf('%.2f', confidence) || ')' || CASE score WHEN 0.95 THEN '|CRITICAL: PII/NSFW Detected ''' || label || ''' (Strict Block)'
   WHEN 0.9 THEN '|CRITICAL: Sensitive Visual ''' || label || ''' + Sensitive Text Match' WHEN 0.5 THEN '|WARNING: Sensitive Visual ''' || label || ''' detected (No text confirmation)' ELSE '' END AS findings FROM r""")
def image_label_risk(spark, sf):
    best = im.best_labels(_labels(spark, sf)).withColumn("ocr_score", F.expr("if(image_id % 2 = 0, 0.9D, 0D)"))
    return detect(best, {"semantic_clip": {c: F.col(c) for c in ("label", "confidence", "ocr_score")}}).select(
        "image_id", "label", F.round("confidence", 9).alias("confidence"), F.col("semantic_clip_score").alias("score"),
        F.array_join(F.col("semantic_clip_findings"), "|").alias("findings"))


_BOX_SQL = """bx AS (SELECT l_orderkey AS image_id, l_linenumber AS box, l_partkey % 80 AS class_id, 'class-' || (l_partkey % 80) AS name, l_discount::DOUBLE * 10 AS conf FROM lineitem),
  bf AS (SELECT image_id, box, CASE WHEN class_id IN (63, 67) AND conf > 0.5 THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END AS score,
    CASE WHEN class_id IN (63, 67) AND conf > 0.5 THEN 'Detected Risky Device: ' || name || ' (' || printf('%.2f', conf) || ')' WHEN conf > 0.6 THEN 'Detected Object: ' || name END AS finding FROM bx),
  ob AS (SELECT image_id, max(score) AS score, string_agg(finding, '|' ORDER BY box, finding) AS findings FROM bf WHERE finding IS NOT NULL GROUP BY image_id)"""


def _boxes(spark, sf):
    return dv.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("box"), (F.col("l_partkey") % 80).alias("class_id"),
        F.concat(F.lit("class-"), F.col("l_partkey") % 80).alias("name"), (F.col("l_discount").cast("double") * 10).alias("conf"))


@query("object_risk", f"WITH {_BOX_SQL} SELECT * FROM ob")
def object_risk(spark, sf):
    return im.object_results(_boxes(spark, sf)).select(
        "image_id", F.col("object_detection_score").alias("score"), F.array_join(F.col("object_detection_findings"), "|").alias("findings"))


_PIXELS = "transform(embedding, x -> cast(floor(abs(cast(x as double)) * 1000) as int))"
_DENSITY = "list_sum(list_transform(embedding, lambda x: floor(abs(x::DOUBLE) * 1000)::INT % 2)) / 64.0::DOUBLE"


@query("lsb_stego", f"SELECT vec_id AS image_id, {_DENSITY} AS density, CASE WHEN abs({_DENSITY} - 0.5) < 0.005 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END AS score FROM embeddings")
def lsb_stego(spark, sf):
    pixels = dv.table(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id"), F.expr(_PIXELS).alias("px"))
    return detect(pixels, {"stego": F.col("px")}).select("image_id", im.lsb_density(F.col("px")).alias("density"), F.col("stego_score").alias("score"))


IMAGE_VERDICT_SQL = f"""{_BEST}, {_BOX_SQL}, px AS (SELECT vec_id, {_DENSITY} AS density FROM embeddings), iv AS (SELECT best.image_id, ocr_score AS ocr, {_CLIP} AS clip, coalesce(ob.score, 0.0::DOUBLE) AS obj,
    CASE WHEN abs(density - 0.5) < 0.005 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END AS steg FROM best JOIN px ON vec_id = best.image_id LEFT JOIN ob ON ob.image_id = best.image_id),
  jv AS (SELECT *, greatest(ocr, clip, obj, steg) AS hi, clip * 0.4::DOUBLE + ocr * 0.3::DOUBLE + steg * 0.2::DOUBLE + obj * 0.1::DOUBLE AS weighted FROM iv),
  image_v AS (SELECT image_id, hi AS max_score, round(weighted, 9) AS weighted_score, CASE WHEN hi > 0.8 OR weighted > 0.5 THEN 'block' ELSE 'allow' END AS status,
   CASE WHEN hi > 0.8 THEN 'critical' WHEN weighted > 0.5 THEN 'medium' ELSE 'safe' END AS risk_level,
   CASE WHEN hi > 0.8 THEN 'Critical Threat Detected (Score: ' || hi || ')' WHEN weighted > 0.5 THEN 'Combined Risk Threshold Exceeded (Score: ' || printf('%.2f', weighted) || ')' ELSE 'Safe' END AS reason FROM jv)"""


def image_results(spark, sf):
    """Judged images: labels, boxes, pixels and a text score by number."""
    ocr_text = F.expr("if(image_id % 2 = 0, 'Top SECRET', 'hello')")
    best = im.best_labels(_labels(spark, sf))
    pixels = dv.table(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id"), F.expr(_PIXELS).alias("px"))
    joined = best.join(pixels, "image_id").join(im.object_results(_boxes(spark, sf)), "image_id", "left").withColumn("text", ocr_text)
    found = detect(joined, {"ocr": F.col("text"), "stego": F.col("px")})
    found = detect(found, {"semantic_clip": {c: F.col(c) for c in ("label", "confidence", "ocr_score")}})
    return image_verdict(found)


@query("image_verdict", f"WITH {IMAGE_VERDICT_SQL} SELECT * FROM image_v")
def image_verdict_query(spark, sf):
    return image_results(spark, sf).select("image_id", "max_score", F.round("weighted_score", 9).alias("weighted_score"), "status", "risk_level", "reason")
