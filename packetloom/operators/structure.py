"""Structure of PDF and Office documents and its score."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom import fixed_values as fv
from packetloom.functions.payload import as_latin1, byte_literal
from packetloom.operators.detector import Detector, register

_ENTRIES = pa.list_(pa.struct([("entry_name", pa.string()), ("entry_text", pa.string())]))
_UNREADABLE = (zipfile.BadZipFile, OSError, EOFError, ValueError, RuntimeError, NotImplementedError, zipfile.zlib.error)
_READ_PARTS = ("word/document.xml", "docProps/core.xml", "docProps/app.xml")


def _list_container(data: bytes) -> list[dict] | None:
    """Names of all parts; text of the parts the detectors read.

    A part that cannot be read is listed without text; the others count.
    """
    def text(archive: zipfile.ZipFile, name: str) -> str | None:
        try:
            return archive.read(name).decode("utf-8", errors="ignore")
        except _UNREADABLE:
            return None

    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            return [{"entry_name": name, "entry_text": text(archive, name) if name in _READ_PARTS or name.endswith(".rels") else None}
                    for name in archive.namelist()]
    except _UNREADABLE:
        return None


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("entry_name", T.StringType()), T.StructField("entry_text", T.StringType())])))
def _container_entries(payload: pa.Array) -> pa.Array:
    return pa.array([_list_container(value.as_py()) if value.is_valid else None for value in payload], _ENTRIES)


def container_entries(payload: Column) -> Column:
    """Array of (entry_name, entry_text); null unless a readable ZIP.

    Only payloads with the ZIP signature are sent to the Python worker.
    """
    return _container_entries(F.when(F.startswith(payload, byte_literal("PK\x03\x04")), payload))


def zip_entries(df: DataFrame, key: str, payload: Column) -> DataFrame:
    """One row (key, entry_name, entry_text) per part of every container."""
    return df.select(key, F.inline(container_entries(payload)))


def office_features(entries: Column) -> Column:
    """Feature map of an Office container from its listed parts."""
    def count(test) -> Column:
        return F.size(F.filter(entries, test)).cast("double")

    marker = 'targetmode="external"'
    external = F.aggregate(
        F.filter(entries, lambda e: F.endswith(e["entry_name"], F.lit(".rels"))), F.lit(0),
        lambda n, e: n + F.size(F.split(F.lower(F.coalesce(e["entry_text"], F.lit(""))), marker)) - 1).cast("double")
    return F.when(entries.isNotNull(), F.create_map(
        F.lit("object_count"), count(lambda e: F.lit(True)),
        F.lit("vba_project"), count(lambda e: F.endswith(e["entry_name"], F.lit("vbaProject.bin"))),
        F.lit("ole_object"), count(lambda e: F.contains(e["entry_name"], F.lit("oleObject"))
                                   & F.endswith(e["entry_name"], F.lit(".bin"))),
        F.lit("embedded_files"), count(lambda e: F.startswith(e["entry_name"], F.lit("word/embeddings/"))),
        F.lit("external_rels"), external,
    ))


def pdf_features(payload: Column, packed: Column | None = None) -> Column:
    """Feature map of a PDF from its objects.

    The bytes are cut at ``endobj``; of an object with a stream only what
    stands before the stream is searched for keys. ``packed`` has the sources
    of the objects in compressed object streams (``operators.pdf``); without
    it they are not seen. The object count includes the free entry 0.
    """
    written = F.filter(F.split(as_latin1(payload), "endobj"), lambda o: F.contains(o, F.lit(" obj")))
    streams = F.size(F.filter(written, lambda o: F.contains(o, F.lit("stream")))).cast("double")
    objects = F.transform(written, lambda o: F.substring_index(o, "stream", 1))
    if packed is not None:
        objects = F.concat(objects, F.coalesce(packed, F.array().cast("array<string>")))

    def count(test) -> Column:
        return F.size(F.filter(objects, test)).cast("double")

    def containing(needle: str) -> Column:
        return count(lambda o: F.contains(o, F.lit(needle)))

    keys: dict[str, Column] = {}
    for needle, feature in fv.PDF_KEYS:
        hits = containing(needle)
        keys[feature] = keys[feature] + hits if feature in keys else hits
    pairs = {
        "object_count": F.size(objects).cast("double") + 1.0,
        "page_count": count(lambda o: F.rlike(o, F.lit(r"/Type\s*/Page(?![A-Za-z])"))),
        "stream_count": streams,
        **keys,
    }
    flat = [part for name, value in pairs.items() for part in (F.lit(name), value)]
    return F.when(F.startswith(payload, byte_literal("%PDF")), F.create_map(*flat))


def structure_features(payload: Column, entries: Column, entropy: Column | None = None, packed: Column | None = None) -> Column:
    """Feature map of any payload; other kinds only have their entropy."""
    found = F.coalesce(pdf_features(payload, packed), office_features(entries), F.create_map().cast("map<string,double>"))
    if entropy is None:
        return found
    return F.map_concat(found, F.create_map(F.lit("entropy"), F.coalesce(entropy, F.lit(0.0))))


def _shown(value: Column) -> Column:
    whole = value == F.floor(value)
    return F.when(whole, value.cast("long").cast("string")).otherwise(F.bround(value, 3).cast("string"))


def _listed(features: Column) -> Column:
    """``name=value`` of the non-zero features, in the fixed order."""
    return F.array_compact(F.array(*[
        F.when(F.element_at(features, name) != 0, F.concat(F.lit(f"{name}="), _shown(F.element_at(features, name))))
        for name in fv.STRUCTURE_FEATURES]))


def _triggered(features: Column) -> Column:
    return F.array_compact(F.array(*[
        F.when(F.element_at(features, name) != 0, F.lit(name)) for name in sorted(fv.HARD_STRUCTURE_FEATURES)]))


def _score(features: Column, anomaly: Column) -> Column:
    hard = F.when(F.size(_triggered(features)) > 0, fv.HARD_STRUCTURE_SCORE).otherwise(0.0)
    return F.greatest(F.coalesce(anomaly, F.lit(0.0)), hard)


def _findings(features: Column, anomaly: Column) -> Column:
    listed, hard = _listed(features), _triggered(features)
    none = F.array().cast("array<string>")
    return F.concat(
        F.when(F.size(listed) > 0, F.array(F.concat(F.lit("Structural features: "), F.array_join(listed, ", ")))).otherwise(none),
        F.when(F.size(hard) > 0, F.array(F.concat(F.lit("Hard-rule structure trigger: "), F.array_join(hard, ", ")))).otherwise(none))


# Inputs: features (map) and anomaly (double or null).
structure = register(Detector("structure", _score, _findings))
