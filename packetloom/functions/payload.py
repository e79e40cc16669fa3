"""Column functions over raw payload bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom import fixed_values as fv


def byte_literal(text: str) -> Column:
    """Binary literal of latin-1 ``text``."""
    return F.unhex(F.lit(text.encode("latin-1").hex()))


def has_bytes(payload: Column, text: str) -> Column:
    return F.contains(payload, byte_literal(text))


def as_latin1(payload: Column) -> Column:
    """One character per byte, so that string positions are byte positions."""
    return F.decode(payload, "ISO-8859-1")


def sniff_type(payload: Column) -> Column:
    """Kind of content by leading bytes, zero bytes and UTF-8 validity."""
    head = F.substring(payload, 1, fv.SNIFF_WINDOW_BYTES)
    kind = None
    for magic, name in fv.FILE_MAGIC:
        test = F.startswith(payload, F.unhex(F.lit(magic)))
        kind = F.when(test, name) if kind is None else kind.when(test, name)
    return (
        kind.when(F.contains(head, F.unhex(F.lit("00"))), "binary_unknown")
        .when(F.is_valid_utf8(head.cast("string")), "text")
        .otherwise("binary_unknown")
    )


@F.arrow_udf(T.DoubleType())
def byte_entropy(payload: pa.Array) -> pa.Array:
    """Shannon entropy in bits per byte; 0 for empty, null for null."""
    payload = payload.cast(pa.large_binary())
    if len(payload) == 0:
        return pa.array([], pa.float64())
    offsets = np.frombuffer(payload.buffers()[1], np.int64)[payload.offset:payload.offset + len(payload) + 1]
    data = payload.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    result = np.zeros(len(payload))
    for row in range(len(payload)):
        start, end = offsets[row], offsets[row + 1]
        if end > start:
            counts = np.bincount(data[start:end], minlength=256)
            share = counts[counts > 0] / (end - start)
            result[row] = -(share * np.log2(share)).sum()
    return pa.array(result, pa.float64(), mask=np.asarray(payload.is_null()))


def is_obfuscated(entropy: Column, limit: float = fv.ENTROPY_LIMIT) -> Column:
    return entropy > F.lit(limit)


def needs_entropy(payload: Column, kind: Column, limit: float = fv.ENTROPY_LIMIT) -> Column:
    """The payload where its entropy can exceed ``limit``, else null.

    Entropy is at most log2 of the number of bytes, so short payloads and
    payloads that are not text never have to be sent to the Python worker.
    """
    shortest = int(2 ** limit) + 1
    return F.when((kind == "text") & (F.octet_length(payload) >= shortest), payload)


def triage(payload: Column, kind: Column, entropy: Column) -> tuple[Column, Column]:
    """Gateway decision (allow / block / inspect) and the service to ask.

    ``entropy`` may be null where :func:`needs_entropy` ruled it out.
    """
    empty = F.coalesce(F.octet_length(payload), F.lit(0)) == 0
    dense_text = (kind == "text") & F.coalesce(is_obfuscated(entropy), F.lit(False))
    decision = (
        F.when(empty, "allow").when(kind == "executable", "block").when(dense_text, "block")
        .when(kind.isin("image", "text", "document"), "inspect").otherwise("allow")
    )
    service = F.when(kind == "image", "image").otherwise("text")
    return decision, F.when(decision == "inspect", service)


def route_payload(payload: Column) -> Column:
    """``block`` by the packet fast path, else the detector family to run."""
    return (
        F.when(has_bytes(payload, "malware") | has_bytes(payload, "cmd.exe"), "block")
        .when(F.is_valid_utf8(payload.cast("string")), "text")
        .otherwise("document")
    )


def mentions_ftp_credentials(payload: Column) -> Column:
    return has_bytes(payload, "USER ") | has_bytes(payload, "PASS ")


def plain_document_text(payload: Column, max_bytes: int | None = None) -> Column:
    """UTF-8 text of a payload without its undecodable bytes.

    The whole payload is read unless ``max_bytes`` is given.
    """
    data = payload if max_bytes is None else F.substring(payload, 1, max_bytes)
    text = data.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(
        F.replace(F.make_valid_utf8(text), F.lit("�"), F.lit("")))


def markup_text(markup: Column) -> Column:
    """Text of XML or HTML with every tag replaced by one blank."""
    return F.regexp_replace(markup, "<[^>]+>", " ")
