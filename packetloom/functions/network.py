"""Column functions over packets, handshakes and HTTP messages."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.functions.payload import as_latin1
from packetloom.functions.strings import strip


def _number(packet: Column, first_byte: int, length: int) -> Column:
    """Unsigned big-endian number at a 0-based byte offset."""
    return F.conv(F.hex(F.substring(packet, first_byte + 1, length)), 16, 10).cast("int")


def ipv4_tuple(packet: Column) -> Column:
    """Protocol, addresses and ports of an IPv4 packet.

    Ports are read at the fixed offset 20 and only for TCP and UDP. A packet
    of fewer than 20 bytes gives null, which callers accept unseen.
    """
    proto = _number(packet, 9, 1)
    has_ports = proto.isin(6, 17) & (F.octet_length(packet) >= 24)

    def address(first: int) -> Column:
        return F.concat_ws(".", *[_number(packet, first + i, 1).cast("string") for i in range(4)])

    return F.when(F.octet_length(packet) >= 20, F.struct(
        address(12).alias("src"),
        F.when(has_ports, _number(packet, 20, 2)).otherwise(0).alias("sport"),
        address(16).alias("dst"),
        F.when(has_ports, _number(packet, 22, 2)).otherwise(0).alias("dport"),
        proto.alias("proto"),
    ))


def is_tls(first_bytes: Column, port: Column) -> Column:
    """Handshake record type 22 or the well-known port."""
    return F.coalesce(F.startswith(first_bytes, F.unhex(F.lit("16"))), F.lit(False)) | (port.cast("string") == "443")


def _server_name(hello: bytes | None) -> str | None:
    """Host in the server-name extension of a ClientHello record, if any."""
    if hello is None or len(hello) < 44:
        return None

    def number(at: int, size: int) -> int:
        return int.from_bytes(hello[at:at + size], "big")

    # Skip three length-prefixed fields: session id, cipher suites, compression.
    at = 43
    for size in (1, 2, 1):
        if at + size > len(hello):
            return None
        at += size + number(at, size)
    if at + 2 >= len(hello):
        return None
    stop = at + 2 + number(at, 2)
    at += 2
    while at < stop and at + 4 <= len(hello):
        kind, size = number(at, 2), number(at + 2, 2)
        at += 4
        if kind == 0:
            if at + 5 > len(hello):
                return None
            name = hello[at + 5:at + 5 + number(at + 3, 2)]
            try:
                return name.decode("utf-8")
            except UnicodeDecodeError:
                return None
        at += size
    return None


@F.arrow_udf(T.StringType())
def tls_sni(hello: pa.Array) -> pa.Array:
    """Server name of a TLS ClientHello; null when absent or malformed."""
    return pa.array([_server_name(value.as_py()) for value in hello], pa.string())


def http_message(data: Column) -> Column:
    """Parse one HTTP message held in a binary column.

    ``complete`` is false while the blank line after the headers is missing.
    A first line that is not ``METHOD path protocol`` leaves all three empty;
    the last of several equal header names wins.
    """
    text = as_latin1(data)
    cut = F.instr(text, "\r\n\r\n")

    def utf8(value: Column) -> Column:
        return F.encode(value, "ISO-8859-1").cast("string")

    lines = F.split(F.substring(text, F.lit(1), cut - 1), "\r\n")
    request = F.split(utf8(F.get(lines, F.lit(0))), " ", -1)
    is_request = F.size(request) == 3
    pairs = F.transform(
        F.filter(F.slice(lines, F.lit(2), F.greatest(F.size(lines), F.lit(1))), lambda line: F.contains(line, F.lit(":"))),
        lambda line: F.struct(
            F.lower(strip(utf8(F.substring_index(line, ":", 1)))).alias("key"),
            strip(utf8(F.substring(line, F.instr(line, ":") + 1, F.length(line)))).alias("value"),
        ),
    )
    last_of_name = F.filter(pairs, lambda pair, i: ~F.exists(
        F.slice(pairs, i + 2, F.size(pairs)), lambda later: later["key"] == pair["key"]))
    headers = F.map_from_entries(last_of_name)
    length = F.coalesce(F.element_at(headers, "content-length").try_cast("bigint"), F.lit(0))
    return F.when(cut > 0, F.struct(
        F.lit(True).alias("complete"),
        F.when(is_request, F.get(request, F.lit(0))).otherwise("").alias("method"),
        F.when(is_request, F.get(request, F.lit(1))).otherwise("").alias("path"),
        F.when(is_request, F.get(request, F.lit(2))).otherwise("").alias("protocol"),
        headers.alias("headers"),
        length.alias("content_length"),
        F.substring(data, cut + 4, F.octet_length(data)).alias("body"),
    )).otherwise(F.struct(
        F.lit(False).alias("complete"), F.lit("").alias("method"), F.lit("").alias("path"),
        F.lit("").alias("protocol"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("headers"),
        F.lit(0).cast("long").alias("content_length"), F.unhex(F.lit("")).alias("body"),
    ))


def real_destination(host_header: Column, server_name: Column, dest_ip: Column) -> Column:
    """Host header without port, else server name, else address."""
    def filled(value: Column) -> Column:
        return F.nullif(value, F.lit(""))

    return F.coalesce(filled(strip(F.substring_index(host_header, ":", 1))), filled(server_name), dest_ip)


def endpoints(direction: Column, client_ip: Column, destination: Column) -> tuple[Column, Column]:
    """(source, destination); inbound messages travel the other way round."""
    outbound = direction == "outbound"
    return (F.when(outbound, client_ip).otherwise(destination),
            F.when(outbound, destination).otherwise(client_ip))


def dns_text(qname: Column) -> Column:
    return F.concat(F.lit("DNS_QUERY:"), qname)
