"""Decoders of bytes as plain functions, for readers and UDFs alike."""

from __future__ import annotations

import html
import re
import struct
from html.entities import name2codepoint
from urllib.parse import unquote

_ENTITY = re.compile(r"&(#x[0-9a-fA-F]+|#\d+|\w+);")


def _entity(m: re.Match) -> str:
    name = m.group(1)
    return html.unescape(m.group()) if name[0] == "#" or name in name2codepoint or name == "apos" else ""


def entities_resolved(s: str) -> str:
    """Named and numeric entities resolved; unknown ones dropped."""
    return _ENTITY.sub(_entity, s)


def percent_decoded(s: str) -> str:
    """Percent escapes of path and fragment, each on its own; a plus stays, invalid escapes too."""
    return "#".join(unquote(p, errors="replace") for p in s.split("#", 1))


def decode_bytes(raw: bytes | None, declared: str | None) -> str | None:
    """UTF-8, by its mark or as it is valid; else the declared encoding; else windows-1252."""
    if raw is None:
        return None
    raw = bytes(raw)
    if raw.startswith(b"\xef\xbb\xbf"):
        return raw[3:].decode("utf-8", "replace")
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return raw.decode("utf-16", "replace")
    for encoding in ("utf-8", declared):
        try:
            return raw.decode(encoding) if encoding else None or raw.decode("cp1252")
        except (UnicodeDecodeError, LookupError):
            continue
    return raw.decode("cp1252", "replace")


def image_size(raw: bytes | None) -> tuple[int | None, int | None]:
    """Width and height out of a PNG's, GIF's or JPEG's header; none where it isn't one."""
    raw = bytes(raw or b"")
    if raw[:8] == b"\x89PNG\r\n\x1a\n" and len(raw) >= 24:
        return struct.unpack(">II", raw[16:24])
    if raw[:4] == b"GIF8" and len(raw) >= 10:
        return struct.unpack("<HH", raw[6:10])
    if raw[:2] == b"\xff\xd8":
        at = 2
        while at + 9 <= len(raw):
            if raw[at] != 0xFF:
                at += 1
                continue
            marker = raw[at + 1]
            if marker == 0xFF:
                at += 1
                continue
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack(">HH", raw[at + 5 : at + 9])
                return width, height
            if marker in (0x01, *range(0xD0, 0xDA)):
                at += 2
                continue
            at += 2 + struct.unpack(">H", raw[at + 2 : at + 4])[0]
    return None, None


def lz77_decompress(raw: bytes) -> bytes:
    """PalmDoc's text compression, undone; references before the start give what is there."""
    out, i = bytearray(), 0
    while i < len(raw):
        c = raw[i]
        i += 1
        if 1 <= c <= 8:
            out += raw[i : i + c]
            i += c
        elif c < 0x80:
            out.append(c)
        elif c >= 0xC0:
            out += bytes((0x20, c ^ 0x80))
        elif i < len(raw):
            pair = (c << 8 | raw[i]) & 0x3FFF
            i += 1
            back, n = pair >> 3, (pair & 7) + 3
            for _ in range(n if 0 < back <= len(out) else 0):
                out.append(out[-back])
    return bytes(out)


def deobfuscated(raw: bytes, key: bytes, length: int) -> bytes:
    """The first bytes of a font, XORed with a key that repeats."""
    head = bytes(b ^ key[i % len(key)] for i, b in enumerate(raw[:length]))
    return head + raw[length:]


def lz77_compress(raw: bytes) -> bytes:
    """PalmDoc's text compression: back references of 3 to 10 bytes up to 2,047 back, space and letter in
    one, other bytes as they are or behind a count. The latest place of each three bytes is tried."""
    out, held, i, n = bytearray(), bytearray(), 0, len(raw)
    seen: dict[bytes, int] = {}

    def flush() -> None:
        for at in range(0, len(held), 8):
            part = held[at : at + 8]
            out.append(len(part))
            out.extend(part)
        held.clear()

    while i < n:
        key = raw[i : i + 3]
        at = seen.get(key) if len(key) == 3 else None
        size = 1
        if at is not None and i - at < 2048:
            size = 3
            while size < 10 and i + size < n and raw[at + size] == raw[i + size]:
                size += 1
            flush()
            out += ((0x8000 | (i - at) << 3 | (size - 3)).to_bytes(2, "big"))
        elif raw[i] == 0x20 and i + 1 < n and 0x40 <= raw[i + 1] <= 0x7F:
            flush()
            out.append(raw[i + 1] ^ 0x80)
            size = 2
        elif raw[i] == 0 or 9 <= raw[i] < 0x80:
            flush()
            out.append(raw[i])
        else:
            held.append(raw[i])
        for k in range(i, min(i + size, n - 2)):
            seen[raw[k : k + 3]] = k
        i += size
    flush()
    return bytes(out)
