"""Sizes of images from their headers."""

from __future__ import annotations

import base64
import binascii


def image_size(encoded: str | None) -> tuple[int, int] | None:
    """Width and height of a base64 PNG, GIF, WebP or JPEG, or None."""
    try:
        data = base64.b64decode(encoded or "", validate=True)
    except (binascii.Error, ValueError):
        return None
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return int.from_bytes(data[16:20], "big"), int.from_bytes(data[20:24], "big")
    if data[:4] == b"GIF8" and len(data) >= 10:
        return int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little")
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP" and len(data) >= 30:
        if data[12:16] == b"VP8X":
            return 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
        if data[12:16] == b"VP8 ":
            return int.from_bytes(data[26:28], "little") & 0x3FFF, int.from_bytes(data[28:30], "little") & 0x3FFF
        if data[12:16] == b"VP8L":
            bits = int.from_bytes(data[21:25], "little")
            return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    return _jpeg(data) if data[:2] == b"\xff\xd8" else None


def _jpeg(data: bytes) -> tuple[int, int] | None:
    at = 2
    while at + 9 <= len(data):
        if data[at] != 0xFF:
            return None
        marker = data[at + 1]
        if marker in range(0xC0, 0xD0) and marker not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
        at += 2 + (0 if marker == 0xFF or 0xD0 <= marker <= 0xD9 else int.from_bytes(data[at + 2 : at + 4], "big"))
    return None
