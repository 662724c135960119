from __future__ import annotations

import re
import zlib

from lectern.sources import pdf
from lectern.sources.pdf import page_texts, pdf_bytes, pdf_documents, pdf_pages, wrapped


def test_written_files_read_back():
    texts = ["One (two) \\ three\n\nfour – é", "", "long " * 2000, "a" * 300, "tab\tx"]
    got = page_texts(pdf_bytes(texts))
    squash = lambda x: re.sub(r"\s", "", x)
    assert squash("".join(got)) == squash("".join(texts)) and len(got) > len(texts)
    assert got[0].startswith("One (two) \\ three\n") and page_texts(pdf_bytes(["漢x"])) == ["?x"]
    assert wrapped("aa bb cc", 5) == ["aa bb", "cc"] and wrapped("", 5) == [""]


def made(*bodies: bytes) -> bytes:
    return b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n" % n + b + b"\nendobj\n" for n, b in enumerate(bodies, 1)) + b"trailer << /Root 1 0 R >>"


def stream(data: bytes, head: bytes = b"", deflate: bool = False) -> bytes:
    data = zlib.compress(data) if deflate else data
    return b"<< /Length %d %s %s >>\nstream\n" % (len(data), b"/Filter /FlateDecode" if deflate else b"", head) + data + b"\nendstream"


def test_operators_and_fonts():
    cmap = b"2 beginbfchar <0001> <0051> <0002> <00660069> endbfchar 1 beginbfrange <0010> <0012> <0061> endbfrange 1 beginbfrange <0020> <0021> [<0078> <0079>] endbfrange"
    content = b"BT /F1 12 Tf 1 0 0 1 50 700 Tm (Q1. De) Tj [(fine) -300 (it\\051 \\(x)] TJ 0 -14 Td (next) Tj 3 0 Td (same) Tj T* (third) ' /F2 12 Tf 0 -20 TD <00010002> Tj <0010001200200021> Tj ET"
    file = made(
        b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R 8 0 R] /Count 2 >>", b"<< /Type /Page /Contents [4 0 R] /Resources 5 0 R >>", stream(content, deflate=True),
        b"<< /Font << /F1 6 0 R /F2 7 0 R >> >>", b"<< /Type /Font >>", b"<< /Type /Font /ToUnicode 9 0 R >>", b"<< /Type /Page /MediaBox [0 0 1 1] >>", stream(cmap, deflate=True),
    )
    assert page_texts(file) == ["Q1. Define it) (x\nnext same\nthird\nQfiacxy", ""]


def test_objects_in_streams_and_damage():
    inner = [b"<< /Type /Catalog /Pages 11 0 R >>", b"<< /Type /Pages /Kids [12 0 R] >>", b"<< /Type /Page /Contents 2 0 R >>"]
    head, data = b"", b""
    for number, body in zip((10, 11, 12), inner):
        head += b"%d %d " % (number, len(data))
        data += body + b" "
    file = made(stream(head + data, b"/Type /ObjStm /N 3 /First %d" % len(head), deflate=True), stream(b"BT (in) Tj ET"))
    assert page_texts(file) == ["in"]
    whole = pdf_bytes(["some text"] * 3)
    for n in range(0, len(whole), 7):
        assert isinstance(page_texts(whole[:n]), list)
    assert page_texts(None) == page_texts(b"") == page_texts(b"text") == page_texts(whole + b"/Encrypt 9 0 R") == []


def test_tables(spark):
    notes = spark.createDataFrame([(2, 1, 20, "second"), (2, 1, 19, "first"), (2, 2, 5, None), (1, 1, 1, "other"), (None, 1, 1, "x")], "document_id int, page int, note_id int, markdown string")
    files = pdf_documents(notes.selectExpr("*", "1 as content")).selectExpr("cast(document_id as string) as path", "content")
    got = sorted(map(tuple, pdf_pages(files).collect()))
    assert got == [("1", 1, 1, "other"), ("2", 1, 3, "first"), ("2", 2, 3, "second"), ("2", 3, 3, "")]
    assert pdf_documents(notes.where("false")).count() == 0 and pdf_pages(files.where("false")).count() == 0
    assert pdf.page_texts(pdf_bytes([])) == [""]
