"""Text layers of PDF files, and PDF files of text: what the exam papers come in and the notes leave in.

Reading follows the page tree, inflates content streams and object streams, and takes text operators in their order; a
font's ToUnicode map is used where there is one. Files that are encrypted or damaged beyond their page tree give no pages,
and pages of pictures give empty texts, which sends them to the scanner. Writing sets plain lines in a standard font.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+(\d+)\s+obj\b")
_STREAM = re.compile(rb"stream\r?\n")
_REFERENCE = re.compile(rb"(\d+)\s+\d+\s+R")
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\))*\)|<[0-9A-Fa-f\s]*>|<<|>>|[\[\]]|/[^\s()<>\[\]{}/%]*|[-+.\w*'\"]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b""}
#: A move down of less than this share of the font's size stays on the line.
LINE_SHARE = 0.3


def _inflated(body: bytes) -> bytes:
    """The bytes of a stream object; of filters only deflate is known, others leave nothing."""
    found = _STREAM.search(body)
    if not found:
        return b""
    head, data = body[: found.start()], body[found.end() :]
    end = data.rfind(b"endstream")
    data = data[:end] if end >= 0 else data
    if b"/Filter" not in head:
        return data
    if b"/FlateDecode" not in head or re.search(rb"/(?:LZW|ASCII85|ASCIIHex|DCT|JPX|CCITTFax|RunLength|JBIG2)", head):
        return b""
    try:
        return zlib.decompressobj().decompress(data)
    except zlib.error:
        return b""


def objects(content: bytes) -> dict[int, bytes]:
    """Bodies of all objects by number, those in object streams included; of a number used twice the last."""
    starts = list(_OBJECT.finditer(content))
    out = {}
    for found, after in zip(starts, [*starts[1:], None]):
        body = content[found.end() : after.start() if after else len(content)]
        end = body.rfind(b"endobj")
        out[int(found[1])] = body[:end] if end >= 0 else body
    for body in [b for b in out.values() if b"/ObjStm" in b[:400]]:
        first, data = re.search(rb"/First\s+(\d+)", body), _inflated(body)
        if first and data:
            numbers = [int(x) for x in data[: int(first[1])].split() if x.isdigit()]
            places = [int(first[1]) + p for p in numbers[1::2]]
            for number, at, end in zip(numbers[::2], places, [*places[1:], len(data)]):
                out.setdefault(number, data[at:end])
    return out


def _entry(body: bytes, name: bytes, held: dict[int, bytes]) -> bytes:
    """What stands behind a name in a dictionary, a reference followed; up to the end of the dictionary."""
    found = re.search(rb"/" + name + rb"(?![A-Za-z0-9])\s*", body)
    if not found:
        return b""
    rest = body[found.end() :]
    to = _REFERENCE.match(rest)
    return held.get(int(to[1]), b"") if to else rest


def page_bodies(held: dict[int, bytes]) -> list[bytes]:
    """Page objects in the order of the page tree."""
    root = next((b for b in held.values() if re.search(rb"/Type\s*/Catalog", b)), b"")
    out, seen = [], set()
    found = re.search(rb"/Pages\s+(\d+)\s+\d+\s+R", root)
    todo = [int(found[1])] if found else []
    while todo:
        number = todo.pop(0)
        if number in seen:
            continue
        seen.add(number)
        body = held.get(number, b"")
        kids = re.search(rb"/Kids\s*\[(.*?)\]", body, re.S)
        if kids:
            todo = [int(x) for x in _REFERENCE.findall(kids[1])] + todo
        elif body:
            out.append(body)
    return out or [b for _, b in sorted(held.items()) if re.search(rb"/Type\s*/Page(?![s\w])", b)]


def _code_map(stream: bytes) -> dict[bytes, str]:
    """Character codes to text, from a ToUnicode map."""
    out: dict[bytes, str] = {}
    text = lambda h: bytes.fromhex(re.sub(r"\s", "", h.decode())).decode("utf-16-be", "replace")
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", stream, re.S):
        for code, to in re.findall(rb"<([0-9A-Fa-f\s]+)>\s*<([0-9A-Fa-f\s]+)>", block):
            out[bytes.fromhex(code.decode())] = text(to)
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", stream, re.S):
        for low, high, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(<[0-9A-Fa-f\s]+>|\[.*?\])", block, re.S):
            n, width = int(low, 16), len(low) // 2
            each = [text(x) for x in re.findall(rb"<([0-9A-Fa-f\s]+)>", to)]
            for k in range(min(int(high, 16) - n, 0xFFFF) + 1):
                if to[:1] == b"<" and each:
                    out[(n + k).to_bytes(width, "big")] = each[0][:-1] + chr(min(ord(each[0][-1]) + k, 0x10FFFF))
                elif k < len(each):
                    out[(n + k).to_bytes(width, "big")] = each[k]
    return out


def _fonts(page: bytes, held: dict[int, bytes]) -> dict[bytes, dict[bytes, str]]:
    """Maps of the fonts a page names."""
    resources = _entry(page, b"Resources", held)
    fonts = _entry(resources, b"Font", held) if resources else b""
    out = {}
    for name, number in re.findall(rb"/([^\s/<>\[\]]+)\s+(\d+)\s+\d+\s+R", fonts):
        stream = _entry(held.get(int(number), b""), b"ToUnicode", held)
        out[name] = _code_map(_inflated(stream)) if stream else {}
    return out


def _string(token: bytes) -> bytes:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    octal = lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() and int(m[1][:1]) < 8 else _ESCAPES.get(m[1], m[1])
    return re.sub(rb"\\([0-7]{1,3}|.)", octal, token[1:-1], flags=re.S)


def _decoded(data: bytes, codes: dict[bytes, str]) -> str:
    if not codes:
        return data.decode("cp1252", "replace")
    width = max(map(len, codes))
    return "".join(codes.get(data[k : k + width], "") for k in range(0, len(data), width))


def page_text(page: bytes, held: dict[int, bytes]) -> str:
    """The text of a page: strings in their order, a line end wherever the text moves down or up."""
    found = re.search(rb"/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", page, re.S)
    stream = b"\n".join(_inflated(held.get(int(n), b"")) for n in _REFERENCE.findall(found[1])) if found else b""
    fonts, codes, size = _fonts(page, held), {}, 12.0
    out: list[str] = []
    operands: list[bytes] = []
    leading = height = 0.0
    number = lambda k: float(operands[k]) if len(operands) >= -k and re.fullmatch(rb"[-+]?\d*\.?\d+|[-+]?\d+\.", operands[k]) else 0.0

    def line() -> None:
        if out and not out[-1].endswith("\n"):
            out.append("\n")

    for token in _TOKEN.findall(stream):
        if token[:1] in b"(</[]" or re.fullmatch(rb"[-+.\d]+", token):
            operands.append(token)
            continue
        if token == b"Tf" and len(operands) > 1:
            codes, size = fonts.get(operands[-2][1:], {}), abs(number(-1)) or size
        elif token in (b"Tj", b"'", b'"') and operands:
            if token != b"Tj":
                line()
            out.append(_decoded(_string(operands[-1]), codes))
        elif token == b"TJ":
            for x in operands:
                if x[:1] in b"(<":
                    out.append(_decoded(_string(x), codes))
                elif x not in (b"[", b"]") and re.fullmatch(rb"-\d+\.?\d*", x) and float(x) < -200:
                    out.append(" ")  # a wide gap within a line
        elif token in (b"Td", b"TD"):
            leading = -number(-1) if token == b"TD" else leading
            if abs(number(-1)) > LINE_SHARE * size:
                line()
            elif number(-2) > 0 and out and not out[-1].endswith((" ", "\n")):
                out.append(" ")
        elif token == b"Tm":
            if abs(number(-1) - height) > LINE_SHARE * size:
                line()
            height = number(-1)
        elif token == b"T*":
            line()
        operands = []
    return "".join(out).rstrip("\n")


def page_texts(content: bytes | None) -> list[str]:
    """The text layer of each page; no pages where there is no file, or an encrypted one."""
    if not content or b"/Encrypt" in content[-2048:] or b"%PDF-" not in content[:1024]:
        return []
    held = objects(content)
    return [page_text(p, held) for p in page_bodies(held)]


def pdf_pages(files: DataFrame) -> DataFrame:
    """(path, page_number, total_pages, embedded_text) of (path, content): a row a page, numbered from 1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                texts = page_texts(bytes(content) if content is not None else None)
                yield pd.DataFrame({"path": [path] * len(texts), "page_number": range(1, len(texts) + 1), "total_pages": len(texts), "embedded_text": texts})

    return files.select("path", "content").mapInPandas(run, "path string, page_number int, total_pages int, embedded_text string")


#: A4 in points, margins, size and leading of the lines, and characters that fit one.
PAGE_SIZE, MARGIN, FONT_SIZE, LEADING, LINE_CHARS = (595, 842), 56, 10, 14, 92


def wrapped(text: str, width: int = LINE_CHARS) -> list[str]:
    """Lines of a text, cut at blanks where they are too long for the page."""
    out = []
    for line in text.replace("\r\n", "\n").replace("\t", "    ").split("\n"):
        while len(line) > width:
            at = line.rfind(" ", 0, width + 1)
            at = at if at > 0 else width
            out.append(line[:at])
            line = line[at:].removeprefix(" ")
        out.append(line)
    return out


def pdf_bytes(texts: list[str]) -> bytes:
    """A PDF file in which each text begins a page and runs on over as many as it needs. Characters that the standard
    encoding lacks are set as question marks."""
    per_page = (PAGE_SIZE[1] - 2 * MARGIN) // LEADING
    sheets = [lines[k : k + per_page] for lines in map(wrapped, texts or [""]) for k in range(0, len(lines), per_page)]
    bodies = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % (4 + 2 * k) for k in range(len(sheets))) + b"] /Count %d >>" % len(sheets), b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"]
    for k, lines in enumerate(sheets):
        shown = b"\n".join(b"(" + re.sub(rb"([\\()])", rb"\\\1", x.encode("cp1252", "replace").replace(b"\r", b"\\r")) + b") Tj T*" for x in lines)
        data = zlib.compress(b"BT /F1 %d Tf %d TL %d %d Td\n" % (FONT_SIZE, LEADING, MARGIN, PAGE_SIZE[1] - MARGIN) + shown + b"\nET")
        bodies.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %d %d] /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (*PAGE_SIZE, 5 + 2 * k))
        bodies.append(b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(data) + data + b"\nendstream")
    out, places = bytearray(b"%PDF-1.4\n"), []
    for n, body in enumerate(bodies, 1):
        places.append(len(out))
        out += b"%d 0 obj\n" % n + body + b"\nendobj\n"
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(bodies) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out + b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(bodies) + 1, start))


def pdf_documents(parts: DataFrame) -> DataFrame:
    """(document_id, content) of (document_id, page, note_id, markdown): one PDF file a document, a page a note, in order
    of page and note. Documents stream sorted through the tasks; one is held at a time. Null texts are empty pages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        document, texts = None, []
        for b in batches:
            for doc, text in zip(b["document_id"], b["markdown"]):
                if texts and doc != document:
                    yield pd.DataFrame({"document_id": [document], "content": [pdf_bytes(texts)]})
                    texts = []
                document = doc
                texts.append(text or "")
        if texts:
            yield pd.DataFrame({"document_id": [document], "content": [pdf_bytes(texts)]})

    rows = parts.where(F.col("document_id").isNotNull()).select("document_id", "page", "note_id", "markdown").repartition("document_id")
    return rows.sortWithinPartitions("document_id", "page", "note_id").select("document_id", "markdown").mapInPandas(run, "document_id long, content binary")
