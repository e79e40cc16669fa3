"""Objects and text of PDF files."""
import zlib

import pytest
from pyspark.sql import functions as F

from packetloom.operators import pdf
from packetloom.operators.structure import pdf_features
from packetloom.plans.inspect import inspect_documents


def stream(number, entries, body, flate=True):
    body = zlib.compress(body) if flate else body
    return b"%d 0 obj\n<< %s%s /Length %d >>\nstream\n%s\nendstream\nendobj\n" % (
        number, entries, b" /Filter /FlateDecode" if flate else b"", len(body), body)


def page_file(*contents, extra=b"", resources=b""):
    kids = b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(len(contents)))
    out = b"%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Type /Pages /Kids [" + kids + b"]" + resources + b" >>\nendobj\n"
    for i, content in enumerate(contents):
        out += b"%d 0 obj\n<< /Type /Page /Contents %d 0 R >>\nendobj\n" % (10 + 2 * i, 11 + 2 * i) + stream(11 + 2 * i, b"", content, i % 2 == 0)
    return out + extra + b"%%EOF"


def test_text_operators():
    content = rb"""BT /F1 12 Tf 72 700 Td (Hello \(big\) w\157rld) Tj 0 -14 Td [(Ker) -20 (ned) -300 (apart)] TJ T* <414243> Tj
        (next) ' 1 2 (last\
line) " ET BT 1 0 0 1 0 0 Tm (a (nested) b) Tj 5 0 Td (same line) Tj ET % (no text)
        BI /W 1 ID xx(y)Tj EI q Q (end\tend) Tj"""
    text = pdf._read(page_file(content))["text"]
    assert text == "Hello (big) world\nKerned apart\nABC\nnext\nlastline\na (nested) bsame lineend\tend"


def test_first_pages_in_tree_order():
    file = page_file(*[b"BT (page %d) Tj ET" % i for i in range(7)])
    assert pdf._read(file)["text"] == "\n".join(f"page {i}" for i in range(5))
    turned = file.replace(b"[10 0 R 12 0 R", b"[12 0 R 10 0 R")
    assert pdf._read(turned)["text"].startswith("page 1\npage 0\npage 2")
    # A tree that runs in circles, and none at all.
    assert pdf._read(file.replace(b"[10 0 R", b"[2 0 R 10 0 R"))["text"].startswith("page 0")
    assert pdf._read(file.replace(b"/Catalog", b"/Nothing"))["text"].startswith("page 0\npage 1")


def test_codes_with_a_map():
    cmap = b"begincodespacerange <00> <FF> endcodespacerange 2 beginbfchar <01> <0048> <02> <00E9> endbfchar 1 beginbfrange <10> <12> <0061> <20> <21> [<0078> <D83DDE00>] endbfrange"
    extra = b"5 0 obj\n<< /Type /Font /ToUnicode 6 0 R >>\nendobj\n" + stream(6, b"", cmap)
    file = page_file(b"BT /F9 1 Tf <0102101112202199> Tj ET", extra=extra, resources=b" /Resources << /Font << /F9 5 0 R >> >>")
    assert pdf._read(file)["text"] == "Hé" "abc" "x😀"


def test_objects():
    data = b"%PDF-1.4\n3 0 obj << /A 1 >> endobj 3 0 obj << /A 2 >> endobj " + stream(4, b"", b"x endobj 9 0 obj endstream y", flate=False) + b"5 0 obj << /Length 7 0 R >>\nstream\r\nabc\nendstream endobj 6 0 obj << /cut"
    found = pdf.written_objects(data)
    assert sorted(found) == [3, 4, 5, 6] and b"/A 2" in found[3][0] and found[4][1] == b"x endobj 9 0 obj endstream y" and found[5][1].strip() == b"abc"


@pytest.mark.parametrize("harm", ["none", "bytes", "head", "filter", "cut"])
def test_packed_keys_are_counted(spark, harm):
    head, body = b"7 0 8 30 ", b"<< /S /JavaScript /JS (x) >>  << /OpenAction 1 0 R >>"
    file = b"%PDF-1.5\n" + stream(1, b"/Type /ObjStm /N 2 /First %d" % len(head), head + body) + b"2 0 obj\n<< /Type /Page >>\nendobj\n%%EOF"
    file = {"none": file, "bytes": file.replace(b"\x78\x9c", b"\xff\xff"), "head": file.replace(b"/First", b"/Worst"),
            "filter": file.replace(b"/FlateDecode", b"/LZWDecode"), "cut": file[:30]}[harm]
    frame = spark.createDataFrame([(1, bytearray(file)), (2, None), (3, bytearray(b"no pdf /JS"))], "id long, payload binary")
    read = frame.withColumn("p", pdf.pdf_parts(F.col("payload"))).select("id", pdf_features(F.col("payload"), F.col("p.packed")).alias("f"))
    found = {r.id: r.f for r in read.collect()}
    assert found[2] is None and found[3] is None
    keys = (found[1]["javascript"], found[1]["openaction"], found[1]["object_count"])
    assert keys == {"none": (2.0, 1.0, 5.0), "cut": (0.0, 0.0, 2.0 if b" obj" in file else 1.0)}.get(harm, (0.0, 0.0, 3.0))
    status = {r.id: r.max_score for r in inspect_documents(frame).select("id", "max_score").collect()}
    assert status[1] == (0.7 if harm == "none" else 0.0)


def test_text_of_pages_is_inspected(spark):
    file = page_file(b"BT (strictly confidential nda) Tj T* (non-disclosure attorney-client) Tj ET")
    frame = spark.createDataFrame([(1, bytearray(file), None), (2, bytearray(file), "harmless")], "id long, payload binary, other string")
    found = {r.id: r["scores"]["content"] for r in inspect_documents(frame).collect()}
    assert found[1] > 0.8 and found[1] == found[2]
    given = {r.id: r["scores"]["content"] for r in inspect_documents(frame, extracted="other").collect()}
    assert given[1] > 0.8 and given[2] == 0.0
