"""End-to-end plans: traffic, packets and HTTP messages to verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom import fixed_values as fv
from packetloom.functions.network import http_message, real_destination
from packetloom.functions.payload import (byte_entropy, byte_literal, markup_text, needs_entropy, plain_document_text,
                                          route_payload, sniff_type, triage)
from packetloom.operators.allowlist import with_allowed
from packetloom.operators.content import content  # noqa: F401  (registers the detector)
from packetloom.operators.detector import detect
from packetloom.operators.flows import flow_rescan, with_scan_verdicts
from packetloom.operators.forest import IsolationForest, forest_anomaly
from packetloom.operators.metadata import office_metadata
from packetloom.operators.pdf import pdf_parts
from packetloom.operators.rules import match_rules, rule_verdict
from packetloom.operators.signatures import with_hash_intel
from packetloom.operators.structure import container_entries, structure_features
from packetloom.operators.text import best_concept, code, context, pattern  # noqa: F401
from packetloom.operators.verdict import document_verdict, text_verdict
from packetloom.session import SMALL_TABLE_ROWS, cut_lineage

_FIELDS = ("status", "risk_level", "reason", "findings")


def inspect_text(df: DataFrame, text: Column, vector_match: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """Text verdict columns; ``vector_match`` has similarity and concept."""
    inputs = {"code": text, "pattern": text, "context": text}
    if vector_match is not None:
        inputs = {"nlp": vector_match, **inputs}
    return text_verdict(detect(df, inputs, where))


def inspect_documents(df: DataFrame, payload: str = "payload", meta: str | None = None, extracted: str | None = None,
                      intel: DataFrame | None = None, forest: IsolationForest | None = None,
                      where: Column | None = None, entries: str | None = None, parts: str | None = None) -> DataFrame:
    """Document verdict columns for a payload column.

    ``meta`` is an optional metadata map, ``extracted`` an optional column
    with the text of PDFs where another reader gave it, ``entries`` and
    ``parts`` columns with the listed container and the read PDF. Without ``forest`` the structure score is its hard
    rule alone, and no entropy has to be computed.
    """
    # Rows outside `where` carry a null payload, so nothing is computed for them.
    df = df.withColumn("_data", F.col(payload) if where is None else F.when(where, F.col(payload)))
    data = F.col("_data")
    df = df.withColumns({"_entries": F.col(entries) if entries else container_entries(data),
                         "_parts": F.col(parts) if parts else pdf_parts(data)})
    body = F.get(F.filter("_entries", lambda e: e["entry_name"] == "word/document.xml"), F.lit(0))["entry_text"]
    is_pdf, is_zip = F.startswith(data, byte_literal("%PDF")), F.startswith(data, byte_literal("PK\x03\x04"))
    shown = F.coalesce(F.col("_parts.text"), F.lit(""))
    text = (F.when(is_pdf, F.coalesce(F.col(extracted), shown) if extracted else shown)
            .when(is_zip, F.coalesce(markup_text(body), F.lit(""))).otherwise(plain_document_text(data)))
    office = office_metadata(F.col("_entries"))
    features = structure_features(data, F.col("_entries"), byte_entropy(data) if forest else None, F.col("_parts.packed"))
    df = df.withColumns({"_doc_text": text, "_meta": F.coalesce(F.col(meta), office) if meta else office,
                         "_features": F.when(data.isNotNull(), features)})
    anomaly = forest_anomaly(df.sparkSession, forest, F.col("_features")) if forest else F.lit(0.0)
    df = df.withColumn("_anomaly", anomaly)
    df = detect(df, {
        "structure": {"features": F.col("_features"), "anomaly": F.col("_anomaly")},
        "content": F.col("_doc_text"), "malware": data, "metadata": F.col("_meta")})
    if intel is not None:
        df = with_hash_intel(df, data, intel).drop("intel_score")
    return document_verdict(df).drop("_data", "_entries", "_parts", "_doc_text", "_meta", "_features", "_anomaly")


def traffic_verdict(traffic: DataFrame, rules: DataFrame, image_verdicts: DataFrame | None = None, *,
                    vector: str | None = None, concepts: DataFrame | None = None, meta: str | None = None,
                    extracted: str | None = None, intel: DataFrame | None = None, forest: IsolationForest | None = None) -> DataFrame:
    """Verdict of every traffic row: rule, else detectors by content type.

    Detectors run only on rows that no rule decided. ``image_verdicts`` has
    (id, status, risk_level, reason) computed from image-model outputs. With
    ``concepts`` texts are also compared by their ``vector``; ``meta``,
    ``extracted``, ``intel`` and ``forest`` are passed to ``inspect_documents``.
    The plan is free of shuffles while rules, image verdicts and reputation
    table are small, and usable on a stream.
    """
    # Python runs first, below all native stages, so that those stay apart.
    document = F.when(F.col("content_type") == "document", F.col("payload"))
    ready, match = traffic.withColumns({"_listed": container_entries(document), "_read": pdf_parts(document)}), None
    if concepts is not None:
        matched = best_concept(ready.withColumn("_vector", F.when(F.col("content_type") == "text", F.col(vector))), "_vector", concepts)
        ready = matched.withColumnsRenamed({"similarity": "_similarity", "concept": "_concept"}).drop("_vector")
        match = {"similarity": F.col("_similarity"), "concept": F.col("_concept")}
    base = match_rules(ready, rules)
    undecided = F.col("rule").isNull()
    text_row = undecided & (F.col("content_type") == "text")
    document_row = undecided & (F.col("content_type") == "document") & F.col("payload").isNotNull()
    kept = [*traffic.columns, "_listed", "_read", "rule"]

    # One flat column per kind of row and verdict field; see operators.detector.
    def keep(df: DataFrame, row: Column, prefix: str, earlier: list[str]) -> DataFrame:
        return df.select(*kept, *earlier, *[F.when(row, F.col(name)).alias(f"{prefix}_{name}") for name in _FIELDS])

    done = keep(inspect_text(base, F.col("text_content"), match, text_row), text_row, "_text", [])
    text_fields = [f"_text_{name}" for name in _FIELDS]
    documents = inspect_documents(done, meta=meta, extracted=extracted, intel=intel, forest=forest, where=document_row, entries="_listed", parts="_read")
    done = keep(documents, document_row, "_document", text_fields)
    prefixes = ["_text", "_document"]
    if image_verdicts is not None:
        images = image_verdicts.select("id", *[F.col(name).alias(f"_image_{name}") for name in ("status", "risk_level", "reason")])
        image_row = undecided & (F.col("content_type") == "image")
        # Broadcast behind a check of the row count, so that payloads are not shuffled for it.
        images = F.broadcast(images) if images.limit(SMALL_TABLE_ROWS + 1).count() <= SMALL_TABLE_ROWS else images
        done = done.join(images, "id", "left").withColumns(
            {f"_image_{name}": F.when(image_row, F.col(f"_image_{name}")) for name in ("status", "risk_level", "reason")})
        prefixes.append("_image")
    by_rule = rule_verdict(F.col("rule"))

    def first(name: str, default: str) -> Column:
        return F.coalesce(by_rule[name], *[F.col(f"{p}_{name}") for p in prefixes], F.lit(default)).alias(name)

    return done.select(
        *traffic.columns,
        first("status", "allow"), first("risk_level", "safe"), first("reason", fv.DEFAULT_REASON),
        F.coalesce(by_rule["rule_label"], F.lit("AI-ANALYSIS")).alias("rule_label"),
        F.col("rule")["id"].alias("rule_id"),
        F.coalesce("_text_findings", "_document_findings", F.array().cast("array<string>")).alias("findings"))


def gateway_verdict(messages: DataFrame, rules: DataFrame, image_verdicts: DataFrame | None = None, **options) -> DataFrame:
    """Verdict of captured message bodies: triage first, then inspection.

    ``messages`` is traffic with the body as ``payload``. Bodies blocked by
    triage are written with rule GATEWAY; document bodies take the text path.
    ``image_verdicts`` and ``options`` are those of ``traffic_verdict``.
    """
    sniffed = messages.withColumn("_kind", sniff_type(F.col("payload")))
    sniffed = sniffed.withColumn("_entropy", byte_entropy(needs_entropy(F.col("payload"), F.col("_kind"))))
    decision, service = triage(F.col("payload"), F.col("_kind"), F.col("_entropy"))
    decided = sniffed.withColumns({"_gateway": decision, "content_type": F.coalesce(service, F.lit("unknown"))})
    decided = decided.withColumn("text_content", F.when(F.col("content_type") == "text", plain_document_text(F.col("payload"))).otherwise(""))
    # One pass over all rows: what triage decided replaces the later verdict.
    judged = traffic_verdict(decided, rules, image_verdicts, **options)
    stopped, passed = F.col("_gateway") == "block", F.col("_gateway") == "allow"
    reason = F.when(F.col("_kind") == "executable", "Executable detected").otherwise("High entropy text")

    def final(name: str, when_stopped: Column | str, when_passed: str) -> Column:
        return F.when(stopped, when_stopped).when(passed, when_passed).otherwise(F.col(name)).alias(name)

    return judged.select(
        "id", "ts", "source_ip", "destination_ip", "proto", final("status", "block", "allow"), final("risk_level", "high", "safe"),
        final("reason", reason, fv.DEFAULT_REASON), final("rule_label", "GATEWAY", "GATEWAY"))


def packet_verdict(packets: DataFrame, rules: DataFrame, keys: tuple[str, ...], image_verdicts: DataFrame | None = None,
                   **options) -> DataFrame:
    """Verdict of every packet; only the packets that a flow rescans are inspected.

    ``packets`` is traffic plus the flow ``keys``; ``image_verdicts`` and
    ``options`` are those of ``traffic_verdict``.
    """
    # Narrow rows that are read twice below.
    rescans = cut_lineage(flow_rescan(packets, keys))
    scans = packets.join(rescans.filter("rescan").select("id"), "id", "left_semi")
    routed = scans.withColumn("_route", route_payload(F.col("payload")))
    routed = routed.withColumns({"content_type": F.col("_route"), "text_content": F.when(
        F.col("_route") == "text", F.col("payload").cast("string")).otherwise("")})
    # One pass: packets that the route blocks go along without content.
    blocked = F.col("_route") == "block"
    judged = traffic_verdict(routed.withColumn("content_type", F.when(blocked, "unknown").otherwise(F.col("content_type"))), rules,
                             image_verdicts, **options)
    status = F.when(blocked, "block").otherwise(F.col("status")).alias("status")
    return with_scan_verdicts(rescans, judged.select("id", status))


def http_verdict(messages: DataFrame, hosts: DataFrame, rules: DataFrame, image_verdicts: DataFrame | None = None, **options) -> DataFrame:
    """Verdict of reassembled HTTP messages.

    ``messages`` has (id, ts, client_ip, dest_ip, server_name, port, is_tls,
    data). TLS connections to allowlisted hosts are not inspected.
    """
    open_only = with_allowed(messages, "server_name", hosts).filter(~(F.col("is_tls") & F.col("allowed")))
    parsed = open_only.withColumn("_m", http_message(F.col("data"))).filter("_m.complete")
    traffic = parsed.select(
        "id", "ts", F.col("client_ip").alias("source_ip"),
        real_destination(F.element_at("_m.headers", "host"), F.col("server_name"), F.col("dest_ip")).alias("destination_ip"),
        F.col("port").cast("string").alias("port"), F.lit("TCP").alias("proto"), F.lit("unknown").alias("content_type"),
        F.lit("").alias("text_content"), F.col("_m.body").alias("payload"))
    return gateway_verdict(traffic, rules, image_verdicts, **options)
