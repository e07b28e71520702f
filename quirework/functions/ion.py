"""Ion's binary form, read and written: values of Python for values of Ion, symbols by number or name."""

from __future__ import annotations

import struct
from dataclasses import dataclass
from decimal import Decimal

MARK = b"\xe0\x01\x00\xea"
# The symbols of every Ion text, by number from 1.
SYSTEM = ("$ion", "$ion_1_0", "$ion_symbol_table", "name", "version", "imports", "symbols", "max_id", "$ion_shared_symbol_table")


@dataclass(frozen=True)
class Symbol:
    """A symbol by its number, and by its name where that is known."""

    number: int
    name: str | None = None

    def __str__(self) -> str:
        return self.name or f"${self.number}"


@dataclass(frozen=True)
class Annotated:
    names: tuple[Symbol, ...]
    value: object


class SExp(list):
    """A list that is an s-expression."""


@dataclass(frozen=True)
class Timestamp:
    """The parts of a time as far as they are given: year, month, day, hour, minute, second; offset in minutes."""

    parts: tuple[int, ...]
    offset: int | None = None
    fraction: Decimal | None = None


def var_uint(raw: bytes, at: int) -> tuple[int, int]:
    """(value, place behind it): seven bits a byte, the last one marked."""
    value = 0
    while True:
        b = raw[at]
        at += 1
        value = value << 7 | b & 0x7F
        if b & 0x80:
            return value, at


def var_int(raw: bytes, at: int) -> tuple[int, int]:
    b = raw[at]
    at += 1
    sign, value = -1 if b & 0x40 else 1, b & 0x3F
    while not b & 0x80:
        b = raw[at]
        at += 1
        value = value << 7 | b & 0x7F
    return sign * value, at


def to_var_uint(n: int) -> bytes:
    out = [n & 0x7F | 0x80]
    while n := n >> 7:
        out.append(n & 0x7F)
    return bytes(reversed(out))


def to_var_int(n: int) -> bytes:
    m = abs(n)
    groups = [m & 0x7F]
    while m := m >> 7:
        groups.append(m & 0x7F)
    if groups[-1] & 0x40:
        groups.append(0)
    groups[-1] |= 0x40 * (n < 0)
    groups[0] |= 0x80
    return bytes(reversed(groups))


def _signed(raw: bytes) -> int:
    return (-1 if raw and raw[0] & 0x80 else 1) * int.from_bytes(bytes((raw[0] & 0x7F,)) + raw[1:], "big") if raw else 0


def _to_signed(n: int) -> bytes:
    if n == 0:
        return b""
    raw = abs(n).to_bytes((abs(n).bit_length() + 8) // 8, "big")
    raw = raw[1:] if raw[0] == 0 and len(raw) > 1 and raw[1] < 0x80 else raw
    return bytes((raw[0] | 0x80 * (n < 0),)) + raw[1:]


def _decimal(n: int, exponent: int) -> Decimal:
    """n times ten to the exponent, to the last digit whatever the context's precision."""
    return Decimal((int(n < 0), tuple(map(int, str(abs(n)))), exponent))


class Reader:
    def __init__(self, raw: bytes, shared: tuple[str, ...] = ()):
        self.raw, self.names = raw, [*SYSTEM, *shared]

    def symbol(self, n: int) -> Symbol:
        return Symbol(n, self.names[n - 1] if 0 < n <= len(self.names) else None)

    def values(self) -> list:
        """The values of the whole text; symbol tables take effect and aren't among them."""
        out, at = [], 0
        while at < len(self.raw):
            if self.raw[at : at + 4] == MARK:
                at += 4
                continue
            value, at, pad = self.value(at)
            if pad:
                continue
            if isinstance(value, Annotated) and value.names[0].number == 3 and isinstance(value.value, list):
                for name, x in value.value:
                    if name.number == 7 and isinstance(x, list):
                        self.names += [y if isinstance(y, str) else "" for y in x]
                continue
            out.append(value)
        return out

    def value(self, at: int) -> tuple[object, int, bool]:
        kind, size = self.raw[at] >> 4, self.raw[at] & 15
        at += 1
        if kind == 15:
            raise ValueError("reserved type")
        if size == 15:
            return None, at, False
        if kind == 1:
            return bool(size), at, False
        ordered = kind == 13 and size == 1
        if size == 14 or ordered:
            size, at = var_uint(self.raw, at)
        end = at + size
        if end > len(self.raw):
            raise ValueError("value beyond the end")
        body = self.raw[at:end]
        return self._of(kind, body, at, end), end, kind == 0

    def _of(self, kind: int, body: bytes, at: int, end: int) -> object:
        if kind in (2, 3):
            return (-1 if kind == 3 else 1) * int.from_bytes(body, "big")
        if kind == 4:
            return struct.unpack(">f" if len(body) == 4 else ">d", body)[0] if body else 0.0
        if kind == 5:
            if not body:
                return Decimal(0)
            exponent, n = var_int(body, 0)
            return _decimal(_signed(body[n:]), exponent)
        if kind == 6:
            return _timestamp(body)
        if kind == 7:
            return self.symbol(int.from_bytes(body, "big"))
        if kind == 8:
            return body.decode()
        if kind in (9, 10):
            return bytes(body)
        if kind in (11, 12):
            return (SExp if kind == 12 else list)(self._items(at, end))
        if kind == 13:
            out = []
            while at < end:
                name, at = var_uint(self.raw, at)
                value, at, pad = self.value(at)
                if not pad:
                    out.append((self.symbol(name), value))
            return Struct(out)
        if kind == 14:
            n, at = var_uint(self.raw, at)
            stop, names = at + n, []
            while at < stop:
                name, at = var_uint(self.raw, at)
                names.append(self.symbol(name))
            return Annotated(tuple(names), self.value(at)[0])
        return None

    def _items(self, at: int, end: int) -> list:
        out = []
        while at < end:
            value, at, pad = self.value(at)
            if not pad:
                out.append(value)
        return out


class Struct(list):
    """The (symbol, value) fields of a struct in their order; a name may come again."""

    def get(self, key: int | str, default: object = None) -> object:
        return next((v for k, v in self if key in (k.number, k.name)), default)


def _timestamp(body: bytes) -> Timestamp:
    offset, at = (None, 1) if body[0] == 0xC0 else var_int(body, 0)
    parts: list[int] = []
    while at < len(body) and len(parts) < 6:
        n, at = var_uint(body, at)
        parts.append(n)
    fraction = None
    if at < len(body):
        exponent, at = var_int(body, at)
        fraction = _decimal(_signed(body[at:]), exponent)
    return Timestamp(tuple(parts), offset, fraction)


def _sized(kind: int, body: bytes) -> bytes:
    return (bytes((kind << 4 | len(body),)) if len(body) < 14 else bytes((kind << 4 | 14,)) + to_var_uint(len(body))) + body


def encode(value: object) -> bytes:
    """One value in binary; symbols by their numbers."""
    if value is None:
        return b"\x0f"
    if isinstance(value, bool):
        return bytes((0x10 | value,))
    if isinstance(value, int):
        return _sized(3 if value < 0 else 2, abs(value).to_bytes((abs(value).bit_length() + 7) // 8, "big"))
    if isinstance(value, float):
        return b"\x40" if value == 0 and str(value)[0] != "-" else b"\x48" + struct.pack(">d", value)
    if isinstance(value, Decimal):
        sign, digits, exponent = value.as_tuple()
        n = int("".join(map(str, digits))) * (-1 if sign else 1)
        return b"\x50" if n == 0 and exponent == 0 else _sized(5, to_var_int(exponent) + _to_signed(n))
    if isinstance(value, Timestamp):
        body = (b"\xc0" if value.offset is None else to_var_int(value.offset)) + b"".join(map(to_var_uint, value.parts))
        if value.fraction is not None:
            sign, digits, exponent = value.fraction.as_tuple()
            body += to_var_int(exponent) + _to_signed(int("".join(map(str, digits))) * (-1 if sign else 1))
        return _sized(6, body)
    if isinstance(value, Symbol):
        return _sized(7, value.number.to_bytes((value.number.bit_length() + 7) // 8, "big"))
    if isinstance(value, str):
        return _sized(8, value.encode())
    if isinstance(value, (bytes, bytearray)):
        return _sized(10, bytes(value))
    if isinstance(value, Annotated):
        names = b"".join(to_var_uint(n.number) for n in value.names)
        return _sized(14, to_var_uint(len(names)) + names + encode(value.value))
    if isinstance(value, Struct):
        body = b"".join(to_var_uint(k.number) + encode(v) for k, v in value)
        return _sized(13, body) if len(body) != 1 else b"\xde" + to_var_uint(len(body)) + body
    if isinstance(value, list):
        return _sized(12 if isinstance(value, SExp) else 11, b"".join(map(encode, value)))
    raise TypeError(type(value).__name__)


def dumps(*values: object) -> bytes:
    return MARK + b"".join(map(encode, values))


def loads(raw: bytes, shared: tuple[str, ...] = ()) -> list:
    return Reader(raw, shared).values()


def plain(value: object) -> object:
    """A value as lists, dicts, numbers and texts; of a name that comes again the last one counts."""
    if isinstance(value, Struct):
        return {str(k): plain(v) for k, v in value}
    if isinstance(value, list):
        return [plain(x) for x in value]
    if isinstance(value, Annotated):
        return plain(value.value)
    if isinstance(value, (Symbol, Decimal)):
        return str(value)
    if isinstance(value, bytes):
        return value.hex()
    if isinstance(value, Timestamp):
        return "-".join(map(str, value.parts))
    return value
