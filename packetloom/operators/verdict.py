"""Verdicts: detector results combined into status, risk and reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom import fixed_values as fv
from packetloom.functions.strings import fixed2

TEXT_MODULES = ("nlp", "code", "pattern", "context")
DOCUMENT_MODULES = ("structure", "content", "malware", "metadata")
IMAGE_MODULES = ("ocr", "semantic_clip", "object_detection", "stego")


def _score(df: DataFrame, module: str) -> Column:
    name = f"{module}_score"
    return F.coalesce(F.col(name), F.lit(0.0)) if name in df.columns else F.lit(0.0)


def _weighted(df: DataFrame, weights: dict[str, float]) -> Column:
    total = None
    for module, weight in weights.items():
        part = _score(df, module) * F.lit(weight)
        total = part if total is None else total + part
    return total


def with_scores(df: DataFrame, modules: tuple[str, ...], weights: dict[str, float] | None = None) -> DataFrame:
    """Add max_score, weighted_score, findings and scores of the modules."""
    present = [m for m in modules if f"{m}_score" in df.columns]
    scores = [_score(df, m) for m in present]
    none = F.array().cast("array<string>")
    return df.withColumns({
        "max_score": F.greatest(F.lit(0.0), *scores),
        "weighted_score": _weighted(df, weights) if weights else F.lit(None).cast("double"),
        "findings": F.concat(*[F.coalesce(F.col(f"{m}_findings"), none) for m in present]),
        "scores": F.create_map(*[part for m, s in zip(present, scores) for part in (F.lit(m), s)]),
    })


def judge(df: DataFrame, style: str, block_above: float = fv.BLOCK_ABOVE, warn_above: float = fv.WARN_ABOVE) -> DataFrame:
    """Add status, risk_level and reason; ``style`` is text, document or image.

    Text is judged by its highest score alone; documents and images block on
    the highest score or on the weighted one. All limits are exclusive.
    """
    high, weighted = F.col("max_score"), F.col("weighted_score")
    critical, medium = high > block_above, (high if style == "text" else weighted) > warn_above
    if style == "text":
        reason = F.concat(F.lit("Max threat score "), high.cast("string"))
    elif style == "document":
        reason = (F.when(critical, F.concat(F.lit("Critical document threat (max="), fixed2(high), F.lit(")")))
                  .when(medium, F.concat(F.lit("Combined document risk threshold exceeded (weighted="), fixed2(weighted), F.lit(")")))
                  .otherwise("Safe"))
    else:
        reason = (F.when(critical, F.concat(F.lit("Critical Threat Detected (Score: "), high.cast("string"), F.lit(")")))
                  .when(medium, F.concat(F.lit("Combined Risk Threshold Exceeded (Score: "), fixed2(weighted), F.lit(")")))
                  .otherwise("Safe"))
    return df.withColumns({
        "status": F.when(critical | medium, "block").otherwise("allow"),
        "risk_level": F.when(critical, "critical").when(medium, "medium").otherwise("safe"),
        "reason": reason,
    })


def text_verdict(df: DataFrame) -> DataFrame:
    return judge(with_scores(df, TEXT_MODULES), "text")


def document_verdict(df: DataFrame, weights: dict[str, float] = fv.DOCUMENT_WEIGHTS) -> DataFrame:
    return judge(with_scores(df, DOCUMENT_MODULES, weights), "document")


def image_verdict(df: DataFrame, weights: dict[str, float] = fv.IMAGE_WEIGHTS) -> DataFrame:
    return judge(with_scores(df, IMAGE_MODULES, weights), "image")


def verdict_of_long(results: DataFrame, key: str, weights: dict[str, float], style: str) -> DataFrame:
    """Verdict of results in long form (key, module, score).

    The weights are a small literal map, so no join is needed; max and sum
    are combined map-side.
    """
    table = F.create_map(*[part for m, w in weights.items() for part in (F.lit(m), F.lit(w))])
    weight = F.coalesce(F.element_at(table, F.col("module")), F.lit(0.0))
    totals = results.groupBy(key).agg(
        F.max("score").alias("max_score"),
        F.round(F.sum(F.col("score") * weight), 9).alias("weighted_score"))
    return judge(totals, style)
