"""Byte signatures and hash reputation."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom import fixed_values as fv
from packetloom.functions.payload import byte_literal, has_bytes
from packetloom.functions.strings import fixed2, labels_where
from packetloom.operators.detector import Columns, Detector, register


def signature_test(payload: Column, rule: dict) -> Column:
    """Condition of one signature as a byte-search expression."""
    found = reduce(or_, [reduce(and_, [has_bytes(payload, text) for text in group]) for group in rule["any_of"]])
    if rule.get("starts"):
        found = F.startswith(payload, byte_literal(rule["starts"])) & found
    return found


def signature_pack(rules: list[dict], module: str = "malware") -> Detector:
    """Detector that applies a list of signatures.

    A rule is a dict with name, severity, description, starts and any_of; see
    ``fixed_values.SIGNATURES``. Packs can be joined by adding the lists.
    """
    def signals(input: Column) -> Columns:
        return {f"rule{i}": signature_test(input, rule) for i, rule in enumerate(rules)}

    def score(**flags: Column) -> Column:
        critical = [flag for flag, rule in zip(flags.values(), rules) if rule["severity"] == "critical"]
        result = F.when(reduce(or_, critical), fv.SIGNATURE_CRITICAL_SCORE) if critical else F
        return result.when(reduce(or_, flags.values()), fv.SIGNATURE_SCORE).otherwise(0.0)

    def findings(**flags: Column) -> Column:
        return labels_where(*[
            (flag, f"YARA: {rule['name']} ({rule['severity'] or 'match'}) — {rule['description']}")
            for flag, rule in zip(flags.values(), rules)])

    return Detector(module, score, findings, signals)


malware = register(signature_pack(fv.SIGNATURES))


def with_hash_intel(df: DataFrame, payload: Column, intel: DataFrame) -> DataFrame:
    """Raise the ``malware`` result by a reputation table (sha256, malicious).

    The intel side is reduced to one row per malicious hash, so the join never
    multiplies rows. Adaptive execution broadcasts it while it is small and
    splits partitions of a frequent hash when it is not.
    """
    known = intel.groupBy(F.lower("sha256").alias("_sha")).agg(F.max("malicious").alias("_malicious"))
    bad = known.filter(F.col("_malicious") > 0).select("_sha", F.lit(fv.HASH_INTEL_SCORE).alias("_intel"))
    joined = df.withColumn("_sha", F.sha2(payload, 256)).join(bad, "_sha", "left").drop("_sha")
    score = F.coalesce(F.col("_intel"), F.lit(0.0))
    note = F.concat(F.lit("VirusTotal: malicious detections found (score="), fixed2(score), F.lit(")"))
    return joined.withColumns({
        "malware_score": F.greatest("malware_score", score),
        "malware_findings": F.when(score > 0, F.array_append("malware_findings", note)).otherwise(F.col("malware_findings")),
        "intel_score": score,
    }).drop("_intel")
