"""The time at which a photograph was taken, read from the EXIF block of its bytes."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tags and types of the TIFF structure that EXIF uses, fixed values: original time, time of digitisation, time of the file,
#: and the pointer to the EXIF directory.
ORIGINAL, DIGITISED, CHANGED, EXIF_DIRECTORY = 0x9003, 0x9004, 0x0132, 0x8769
ASCII, LONG = 2, 4


def exif_block(content: bytes) -> bytes | None:
    """The TIFF structure within a JPEG's APP1 segment or a PNG's eXIf chunk, or a bare TIFF file."""
    if content[:4] in (b"II*\0", b"MM\0*"):
        return content
    at = 2
    if content[:2] == b"\xff\xd8":
        while at + 4 <= len(content) and content[at] == 0xFF and content[at + 1] not in (0xD9, 0xDA):
            size = int.from_bytes(content[at + 2 : at + 4], "big")
            if content[at + 1] == 0xE1 and content[at + 4 : at + 10] == b"Exif\0\0":
                return content[at + 10 : at + 2 + size]
            at += 2 + max(2, size)
    elif content[:8] == b"\x89PNG\r\n\x1a\n":
        at = 8
        while at + 8 <= len(content):
            size = int.from_bytes(content[at : at + 4], "big")
            if content[at + 4 : at + 8] == b"eXIf":
                return content[at + 8 : at + 8 + size]
            at += 12 + size
    return None


def directory(block: bytes, order: str, at: int) -> dict[int, bytes]:
    """Values of the text and pointer entries of one directory; entries that point outside the block are left out."""
    out: dict[int, bytes] = {}
    if at < 8 or at + 2 > len(block):
        return out
    (n,) = struct.unpack_from(order + "H", block, at)
    for k in range(min(n, (len(block) - at - 2) // 12)):
        tag, kind, count = struct.unpack_from(order + "HHL", block, at + 2 + 12 * k)
        if kind not in (ASCII, LONG):
            continue
        size, place = count * (1 if kind == ASCII else 4), at + 2 + 12 * k + 8
        if size > 4:
            (place,) = struct.unpack_from(order + "L", block, place)
        if place + size <= len(block):
            out[tag] = block[place : place + size]
    return out


def taken_at(content: bytes | None) -> str | None:
    """The time as ``yyyy-mm-ddThh:mm:ss``: the original one, else that of digitisation, else that of the file."""
    block = exif_block(content or b"")
    if not block or len(block) < 8:
        return None
    order = "<" if block[:2] == b"II" else ">"
    first = directory(block, order, struct.unpack_from(order + "L", block, 4)[0])
    pointer = first.get(EXIF_DIRECTORY, b"")
    exif = directory(block, order, struct.unpack(order + "L", pointer[:4])[0]) if len(pointer) >= 4 else {}
    for value in (exif.get(ORIGINAL), exif.get(DIGITISED), first.get(CHANGED)):
        text = (value or b"").split(b"\0")[0].decode("ascii", "replace").strip()
        if len(text) >= 19 and text[:19].translate({ord(c): None for c in ": "}).isdigit() and text[:4] != "0000":
            return f"{text[:4]}-{text[5:7]}-{text[8:10]}T{text[11:19]}"
    return None


def with_taken_at(files: DataFrame) -> DataFrame:
    """``files`` (path, ..., content) with ``content`` replaced by taken_at; null where the image tells no time."""
    kept = [f for f in files.schema.fields if f.name not in ("content", "taken_at")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[[f.name for f in kept]].assign(taken_at=[taken_at(c) for c in b["content"]])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", taken_at string"
    return files.select(*(F.col(f"`{f.name}`") for f in kept), "content").mapInPandas(run, schema)
