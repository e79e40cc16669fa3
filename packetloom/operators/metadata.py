"""Forensics over document metadata maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from packetloom import fixed_values as fv
from packetloom.functions.strings import contains_any
from packetloom.operators.detector import Columns, Detector, register


def _haystack(input: Column) -> Columns:
    lines = F.transform(F.map_entries(input), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return {"meta": input, "haystack": F.array_join(lines, "\n")}


def metadata_signals(meta: Column, haystack: Column) -> Columns:
    """Path leaks, GPS, odd producers and tracked changes of a metadata map.

    The map entry ``has_revisions`` holds the text ``True`` when the document
    has tracked changes.
    """
    none = F.array().cast("array<string>")
    low = F.lower(haystack)
    leaks = [F.when(F.contains(low, F.lit(guard)), F.regexp_extract_all(haystack, F.lit(regex), F.lit(0))).otherwise(none)
             for regex, guard in fv.PATH_LEAK_PATTERNS]
    values = F.array_compact(F.array(*[F.element_at(meta, key) for key in fv.PRODUCER_KEYS]))
    judged = F.transform(values, lambda value: F.struct(
        value.alias("value"),
        contains_any(F.lower(value), fv.SUSPICIOUS_PRODUCERS).alias("suspicious"),
        contains_any(F.lower(value), fv.KNOWN_PRODUCERS).alias("known")))
    return {
        "leaks": F.concat(*leaks),
        "gps": F.contains(haystack, F.lit("GPSLatitude")) | F.contains(haystack, F.lit("GPSLongitude")),
        "producers": F.filter(judged, lambda p: p["suspicious"] | ~p["known"]),
        "revisions": F.coalesce(F.element_at(meta, "has_revisions") == "True", F.lit(False)),
    }


def _score(leaks: Column, gps: Column, producers: Column, revisions: Column) -> Column:
    suspicious = F.size(F.filter(producers, lambda p: p["suspicious"]))
    hits = F.size(leaks) + gps.cast("int") + suspicious + revisions.cast("int")
    unknown = F.size(producers) - suspicious
    score = F.least(F.lit(fv.METADATA_CAP), F.lit(fv.METADATA_HIT) * hits + F.lit(fv.METADATA_UNKNOWN) * unknown)
    return F.when(leaks.isNotNull() & producers.isNotNull(), score)


def _findings(leaks: Column, gps: Column, producers: Column, revisions: Column) -> Column:
    def only(test: Column, text: str) -> Column:
        return F.when(test, F.array(F.lit(text))).otherwise(F.array().cast("array<string>"))

    return F.concat(
        F.transform(leaks, lambda hit: F.concat(F.lit("Local path leak: "), hit)),
        only(gps, "GPS coordinates embedded in document metadata"),
        F.transform(producers, lambda p: F.concat(
            F.when(p["suspicious"], "Suspicious producer: ").otherwise("Unrecognised producer/creator: "), p["value"])),
        only(revisions, "Document contains tracked changes / revision history"),
    )


metadata = register(Detector("metadata", _score, _findings, metadata_signals, _haystack))


def office_metadata(entries: Column) -> Column:
    """Metadata map of an Office container from its listed parts."""
    def part(name: str) -> Column:
        return F.get(F.filter(entries, lambda e: e["entry_name"] == name), F.lit(0))["entry_text"]

    body = part("word/document.xml")
    revised = F.contains(body, F.lit("w:ins")) | F.contains(body, F.lit("w:del"))
    pairs = F.array_compact(F.array(*[
        F.when(value.isNotNull(), F.struct(F.lit(key).alias("key"), value.alias("value")))
        for key, value in (("core_xml", part("docProps/core.xml")), ("app_xml", part("docProps/app.xml")),
                           ("has_revisions", F.when(revised, "True").when(~revised, "False")))]))
    return F.map_from_entries(pairs)
