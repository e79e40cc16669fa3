"""What PDF files hold in compressed streams: packed objects and page text.

Objects outside of streams are counted natively (``operators.structure``).
Here tasks read what only an inflater can: the objects of object streams, and
the text that the content streams of the first pages show. A stream that is
damaged, encrypted or filtered otherwise is passed over; the others count.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom import fixed_values as fv
from packetloom.functions.payload import byte_literal

# What a stream may inflate to; the rest of a longer one is not read.
INFLATED_BYTES = 64 << 20
# A gap in a line, in thousandths of the font size, that is shown as a blank.
_GAP = -200

_OBJECT = re.compile(rb"(?<!\d)(\d{1,10})\s+\d{1,5}\s+obj\b")
_LENGTH = re.compile(rb"/Length\s+(\d{1,12})(?!\s+\d+\s+R)")
_REFERENCE = re.compile(rb"(\d{1,10})\s+\d{1,5}\s+R\b")
_NAMED = re.compile(rb"/([^\s/<>\[\]()]+)\s+(\d{1,10})\s+\d{1,5}\s+R\b")
_HEX = re.compile(rb"<([0-9A-Fa-f\s]*)>")
_PAGE = re.compile(rb"/Type\s*/Page(?![A-Za-z])")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b""}
_BLANK, _END = b" \t\r\n\f\0", b" \t\r\n\f\0()<>[]{}/%"

Objects = dict[int, tuple[bytes, bytes | None]]


def _inflate(source: bytes, raw: bytes | None) -> bytes | None:
    """Content of a stream without filter or with Flate; what can be read of a damaged one."""
    if raw is None or b"/Filter" not in source:
        return raw
    if source.count(b"Decode") - source.count(b"/DecodeParms") > 1 or not re.search(rb"/FlateDecode|/Fl\b", source):
        return None
    try:
        return zlib.decompressobj().decompress(raw, INFLATED_BYTES)
    except zlib.error:
        return None


def _number(pattern: bytes, source: bytes) -> int | None:
    found = re.search(pattern + rb"\s+(\d{1,10})", source)
    return int(found[1]) if found else None


def written_objects(data: bytes) -> Objects:
    """Source and raw stream of each indirect object; the last one of a number counts."""
    found, at = {}, 0
    while head := _OBJECT.search(data, at):
        start, end = head.end(), data.find(b"endobj", head.end())
        end = len(data) if end < 0 else end
        stream = data.find(b"stream", start, end)
        if stream < 0:
            found[int(head[1])] = (data[start:end], None)
            at = end
            continue
        source, begin = data[start:stream], stream + 6
        begin += 2 if data[begin:begin + 2] == b"\r\n" else 1
        size = _LENGTH.search(source)
        stop = begin + int(size[1]) if size else -1
        if not (size and data[stop:stop + 12].lstrip().startswith(b"endstream")):
            stop = data.find(b"endstream", begin)
            stop = len(data) if stop < 0 else stop
        found[int(head[1])] = (source, data[begin:stop])
        at = stop
    return found


def packed_objects(objects: Objects) -> dict[int, bytes]:
    """Sources of the objects inside object streams."""
    found = {}
    for source, raw in objects.values():
        if b"/ObjStm" not in source:
            continue
        body, first, count = _inflate(source, raw), _number(rb"/First", source), _number(rb"/N", source)
        if body is None or first is None or count is None:
            continue
        head = [int(x) for x in body[:first].split()[:2 * count] if x.isdigit()]
        starts = [first + s for s in head[1::2]]
        for number, a, b in zip(head[::2], starts, [*starts[1:], len(body)]):
            found[number] = body[a:b]
    return found


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    """Literal string that starts behind ``(``, and where it ends."""
    out, depth = bytearray(), 1
    while at < len(data):
        char = data[at:at + 1]
        at += 1
        if char == b"\\":
            octal = re.compile(rb"[0-7]{1,3}").match(data, at)
            if octal:
                out.append(int(octal[0], 8) & 255)
                at = octal.end()
                continue
            out += _ESCAPES.get(data[at:at + 1], data[at:at + 1])
            at += 1
            continue
        depth += (char == b"(") - (char == b")")
        if not depth:
            break
        out += char
    return bytes(out), at


def _unhex(digits: bytes) -> bytes:
    digits = b"".join(digits.split())
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


def _tokens(data: bytes) -> Iterator[tuple[str, bytes]]:
    """(kind, value) of a content stream: string, name or word (numbers and operators)."""
    at, size = 0, len(data)
    while at < size:
        char = data[at:at + 1]
        if char in _BLANK or char in b"[]{}>)":
            at += 1
        elif char == b"(":
            text, at = _string(data, at + 1)
            yield "string", text
        elif char == b"<" and data[at + 1:at + 2] != b"<":
            found = _HEX.match(data, at)
            if found:
                yield "string", _unhex(found[1])
            at = found.end() if found else at + 1
        elif char == b"<":
            at += 2
        elif char == b"%":
            at = min(x for x in (data.find(b"\n", at), data.find(b"\r", at), size) if x >= 0)
        else:
            stop = at + 1
            while stop < size and data[stop] not in _END:
                stop += 1
            word, at = data[at:stop], stop
            if word == b"ID":  # pixels of an inline image
                stop = data.find(b"EI", at)
                at = size if stop < 0 else stop + 2
            yield ("name", word[1:]) if char == b"/" else ("word", word)


class _CodeMap(dict):
    """Text of each code of a font; codes in ranges are looked up when they are met."""

    def __init__(self, cmap: bytes) -> None:
        super().__init__()
        space = re.search(rb"begincodespacerange\s*<([0-9A-Fa-f]+)>", cmap)
        self.width = max(1, (len(space[1]) + 1) // 2 if space else 1)
        self.ranges: list[tuple[int, int, bytes]] = []
        for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
            pairs = _HEX.findall(block)
            self.update((int.from_bytes(_unhex(a)), _utf16(_unhex(b))) for a, b in zip(pairs[::2], pairs[1::2]))
        for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
            for low, high, first, several in re.findall(rb"<(\w+)>\s*<(\w+)>\s*(?:<(\w+)>|\[(.*?)\])", block, re.S):
                if first:
                    self.ranges.append((int(low, 16), int(high, 16), _unhex(first)))
                else:
                    self.update(zip(range(int(low, 16), int(high, 16) + 1), (_utf16(_unhex(x)) for x in _HEX.findall(several))))

    def __missing__(self, code: int) -> str:
        text = ""
        for low, high, first in self.ranges:
            if low <= code <= high:
                # The last unit of the first text counts on.
                last = int.from_bytes(first[-2:]) + code - low
                text = _utf16(first[:-2] + (last & 0xFFFF).to_bytes(2))
                break
        self[code] = text
        return text


def _utf16(raw: bytes) -> str:
    return raw.decode("utf-16-be", errors="ignore")


class _Pages:
    """The pages of a file and what they show."""

    def __init__(self, data: bytes) -> None:
        self.objects = written_objects(data)
        self.packed = packed_objects(self.objects)
        for number, source in self.packed.items():
            self.objects.setdefault(number, (source, None))
        self.fonts: dict[int | None, _CodeMap | None] = {}

    def source(self, number: int) -> bytes:
        return self.objects.get(number, (b"", None))[0]

    def pages(self, limit: int) -> list[list[int]]:
        """Numbers of the first pages in reading order, each behind its ancestors."""
        roots = [int(found[1]) for source, _ in self.objects.values() if b"/Catalog" in source
                 and (found := re.search(rb"/Pages\s+(\d{1,10})\s+\d+\s+R", source))]
        found, open_, seen = [], [[number] for number in roots[-1:]], set()
        while open_ and len(found) < limit:
            path = open_.pop()
            number = path[-1]
            if number in seen:
                continue
            seen.add(number)
            kids = re.search(rb"/Kids\s*\[(.*?)\]", self.source(number), re.S)
            if kids:
                open_ += [[*path, int(kid)] for kid in reversed(_REFERENCE.findall(kids[1]))]
            elif _PAGE.search(self.source(number)):
                found.append(path)
        return found or [[number] for number in sorted(self.objects) if _PAGE.search(self.source(number))][:limit]

    def entry(self, source: bytes, name: bytes) -> bytes:
        """Rest of a source from the value of a key on, following a reference."""
        found = re.search(rb"/" + name + rb"(?![A-Za-z])\s*", source)
        if not found:
            return b""
        rest = source[found.end():]
        reference = _REFERENCE.match(rest)
        return self.source(int(reference[1])) if reference else rest

    def page_fonts(self, path: list[int]) -> dict[bytes, int]:
        for number in reversed(path):
            resources = self.entry(self.source(number), b"Resources")
            if resources:
                listed = self.entry(resources, b"Font")
                return {name: int(ref) for name, ref in _NAMED.findall(listed.split(b">>", 1)[0])}
        return {}

    def code_map(self, font: int | None) -> _CodeMap | None:
        if font not in self.fonts:
            found = re.search(rb"/ToUnicode\s+(\d{1,10})\s+\d+\s+R", self.source(font)) if font is not None else None
            cmap = _inflate(*self.objects.get(int(found[1]), (b"", None))) if found else None
            self.fonts[font] = _CodeMap(cmap) if cmap else None
        return self.fonts[font]

    def shown(self, raw: bytes, font: int | None) -> str:
        known = self.code_map(font)
        if known is None:
            return raw.decode("cp1252", errors="ignore")
        return "".join(known[int.from_bytes(raw[i:i + known.width])] for i in range(0, len(raw), known.width))

    def text(self, path: list[int]) -> str:
        source = self.source(path[-1])
        found = re.search(rb"/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", source, re.S)
        numbers = [int(n) for n in _REFERENCE.findall(found[1])] if found else []
        fonts, font, lines, moved, operands = self.page_fonts(path), None, [""], False, []
        content = b"\n".join(_inflate(*self.objects.get(n, (b"", None))) or b"" for n in numbers)
        for kind, value in _tokens(content):
            if kind != "word" or re.fullmatch(rb"[-+.\d]+", value):
                operands.append((kind, value))
                continue
            if value == b"Tf":
                font = next((fonts.get(v) for k, v in reversed(operands) if k == "name"), None)
            elif value in (b"T*", b"Tm", b"BT") or (value in (b"Td", b"TD") and operands and float(operands[-1][1] or 0) != 0):
                moved = True
            elif value in (b"Tj", b"TJ", b"'", b'"'):
                if (moved or value in (b"'", b'"')) and lines != [""]:
                    lines.append("")
                moved = False
                for k, v in operands:
                    if k == "string":
                        lines[-1] += self.shown(v, font)
                    elif value == b"TJ" and k == "word" and float(v) < _GAP:
                        lines[-1] += " "
            operands = []
        return "\n".join(lines)


def _read(data: bytes) -> dict:
    pages = _Pages(data)
    texts = []
    for path in pages.pages(fv.PDF_PAGES):
        try:
            texts.append(pages.text(path))
        except ValueError:  # an operand that is no number
            texts.append("")
    return {"packed": [source.decode("latin-1") for source in pages.packed.values()], "text": "\n".join(texts)}


_PARTS = T.StructType([T.StructField("packed", T.ArrayType(T.StringType())), T.StructField("text", T.StringType())])


@F.arrow_udf(_PARTS)
def _pdf_parts(payload: pa.Array) -> pa.Array:
    # Of the same kind as the function of the containers, so that one worker runs both.
    kind = pa.struct([("packed", pa.list_(pa.string())), ("text", pa.string())])
    return pa.array([_read(value.as_py()) if value.is_valid else None for value in payload], kind)


def pdf_parts(payload: Column) -> Column:
    """Struct of ``packed`` (sources of objects in object streams) and ``text`` (of the first pages); null unless a PDF."""
    return _pdf_parts(F.when(F.startswith(payload, byte_literal("%PDF")), payload))
