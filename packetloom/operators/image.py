"""Risk of images from the outputs of image models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom import fixed_values as fv
from packetloom.functions.strings import contains_any, fixed2
from packetloom.operators.detector import Detector, register

_NONE = "array<string>"

# --- text read from the image --------------------------------------------
ocr = register(Detector(
    "ocr",
    lambda words: F.when(F.size(words) > 0, fv.OCR_SCORE).otherwise(0.0),
    lambda words: F.transform(words, lambda w: F.concat(F.lit("Sensitive keyword detected: "), w)),
    lambda low: {"words": F.filter(F.array(*[F.lit(w) for w in fv.OCR_KEYWORDS]), lambda w: F.contains(low, w))},
    lambda input: {"low": F.lower(input)},
))


# --- hidden data ----------------------------------------------------------
def lsb_density(pixels: Column) -> Column:
    """Share of odd values in the red channel."""
    odd = F.aggregate(pixels, F.lit(0).cast("bigint"), lambda n, p: n + p.bitwiseAND(1).cast("bigint"))
    return F.when(F.size(pixels) > 0, odd / F.size(pixels))


stego = register(Detector(
    "stego",
    lambda distance: F.when(distance < fv.STEGO_DISTANCE, fv.STEGO_SCORE).otherwise(0.0),
    lambda distance: F.when(distance < fv.STEGO_DISTANCE, F.array(F.lit(fv.STEGO_FINDING))).otherwise(F.array().cast(_NONE)),
    lambda input: {"distance": F.abs(lsb_density(input) - F.lit(0.5))},
))


# --- classifier labels ----------------------------------------------------
def best_labels(labels: DataFrame) -> DataFrame:
    """(image_id, label, confidence) of the likeliest label per image.

    ``labels`` has (image_id, label, logit). The softmax of the best label is
    1 / sum(exp(logit - max)), which no logit can overflow.
    """
    most = labels.groupBy("image_id").agg(F.max("logit").alias("_most"), F.collect_list("logit").alias("_logits"),
                                          F.max_by("label", F.struct("logit", "label")).alias("label"))
    # One logit per label of the model: the list has a fixed length.
    total = F.aggregate("_logits", F.lit(0.0), lambda sum_, x: sum_ + F.exp(x - F.col("_most")))
    return most.select("image_id", "label", (F.lit(1.0) / total).alias("confidence"))


def label_score(label: Column, confidence: Column, ocr_score: Column) -> Column:
    identity = contains_any(label, fv.IDENTITY_TERMS)
    sensitive = label.isin(*fv.SENSITIVE_IMAGE_LABELS)
    return (F.when(identity & (confidence > fv.IDENTITY_MIN), fv.IDENTITY_SCORE)
            .when(sensitive & (confidence > fv.SENSITIVE_MIN),
                  F.when(F.coalesce(ocr_score, F.lit(0.0)) > 0.5, fv.SENSITIVE_CONFIRMED).otherwise(fv.SENSITIVE_ALONE))
            .otherwise(0.0))


def _label_findings(label: Column, confidence: Column, ocr_score: Column) -> Column:
    score = label_score(label, confidence, ocr_score)
    seen = F.concat(F.lit("Classified as: "), label, F.lit(" ("), fixed2(confidence), F.lit(")"))
    risk = (F.when(score == fv.IDENTITY_SCORE, F.concat(F.lit("CRITICAL: PII/NSFW Detected '"), label, F.lit("' (Strict Block)")))
            .when(score == fv.SENSITIVE_CONFIRMED, F.concat(F.lit("CRITICAL: Sensitive Visual '"), label, F.lit("' + Sensitive Text Match")))
            .when(score == fv.SENSITIVE_ALONE, F.concat(F.lit("WARNING: Sensitive Visual '"), label, F.lit("' detected (No text confirmation)"))))
    return F.when(label.isNotNull(), F.array_compact(F.array(seen, risk)))


# Inputs: label, confidence and ocr_score.
semantic_clip = register(Detector("semantic_clip", label_score, _label_findings))


# --- detected objects -----------------------------------------------------
def object_results(boxes: DataFrame) -> DataFrame:
    """Object score and findings from (image_id, box, class_id, name, conf).

    Only boxes that give a finding are kept before the shuffle. The boxes of
    one image come from one model call, so a group is small by nature.
    """
    risky = F.col("class_id").isin(*fv.RISKY_DEVICE_CLASSES) & (F.col("conf") > fv.DEVICE_MIN)
    finding = (F.when(risky, F.concat(F.lit("Detected Risky Device: "), "name", F.lit(" ("), fixed2(F.col("conf")), F.lit(")")))
               .when(F.col("conf") > fv.OBJECT_MIN, F.concat(F.lit("Detected Object: "), "name")))
    hits = boxes.select("image_id", "box", F.when(risky, fv.DEVICE_SCORE).otherwise(0.0).alias("score"),
                        finding.alias("finding")).filter("finding is not null")
    return hits.groupBy("image_id").agg(
        F.max("score").alias("object_detection_score"),
        F.transform(F.array_sort(F.collect_list(F.struct("box", "finding"))), lambda b: b["finding"]).alias("object_detection_findings"))
