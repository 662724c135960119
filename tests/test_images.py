from __future__ import annotations

import struct

import pytest

from lectern.sources.images import taken_at, with_taken_at
from lectern.sources.readers import binary_files


def tiff(order, original=None, changed=None):
    """A TIFF structure with a time of the file and an EXIF directory with an original time."""
    head = b"II*\0" if order == "<" else b"MM\0*"
    entries, data, base = [], b"", 8 + 2 + 12 * (bool(changed) + bool(original)) + 4
    if changed:
        entries.append((0x0132, 2, 20, base + len(data)))
        data += changed.encode() + b"\0"
    if original:
        place = base + len(data)
        entries.append((0x8769, 4, 1, place))
        data += struct.pack(order + "H", 1) + struct.pack(order + "HHLL", 0x9003, 2, 20, place + 18) + b"\0" * 4 + original.encode() + b"\0"
    return head + struct.pack(order + "L", 8) + struct.pack(order + "H", len(entries)) + b"".join(struct.pack(order + "HHLL", *e) for e in entries) + b"\0" * 4 + data


def jpeg(block):
    return b"\xff\xd8\xff\xe0\x00\x04ab\xff\xe1" + struct.pack(">H", len(block) + 8) + b"Exif\0\0" + block + b"\xff\xda"


@pytest.mark.parametrize("order", ["<", ">"])
def test_times(order):
    assert taken_at(jpeg(tiff(order, "2024:03:05 10:11:12", "2025:01:01 00:00:00"))) == "2024-03-05T10:11:12"
    assert taken_at(tiff(order, None, "2025:01:01 00:00:00")) == "2025-01-01T00:00:00"
    assert taken_at(jpeg(tiff(order, "0000:00:00 00:00:00"))) is None and taken_at(jpeg(tiff(order))) is None
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">L", 1) + b"IHDRx" + b"\0" * 4
    block = tiff(order, "2024:03:05 10:11:12")
    assert taken_at(png + struct.pack(">L", len(block)) + b"eXIf" + block + b"\0" * 4) == "2024-03-05T10:11:12"


def test_damaged_images_have_no_time():
    whole = jpeg(tiff("<", "2024:03:05 10:11:12"))
    for n in range(len(whole)):
        assert taken_at(whole[:n]) in (None, "2024-03-05T10:11:12")
    assert taken_at(None) is None and taken_at(b"") is None and taken_at(b"text") is None


def test_files(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(jpeg(tiff("<", "2024:03:05 10:11:12")))
    (tmp_path / "b.jpg").write_bytes(b"no image")
    got = {r["path"].rsplit("/", 1)[1]: r["taken_at"] for r in with_taken_at(binary_files(spark, str(tmp_path), "*.jpg")).collect()}
    assert got == {"a.jpg": "2024-03-05T10:11:12", "b.jpg": None}
