"""A small MessagePack codec for documents (None, bool, int, float, str, bytes, list, dict)."""

from __future__ import annotations

import struct
from typing import Any

# Fixed values of the format: type byte -> (kind, struct of the value or of its length).
SCALARS = {0xCA: ">f", 0xCB: ">d", 0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q"}
LENGTHS = {0xC4: ("bin", ">B"), 0xC5: ("bin", ">H"), 0xC6: ("bin", ">I"), 0xD9: ("str", ">B"), 0xDA: ("str", ">H"), 0xDB: ("str", ">I"), 0xDC: ("list", ">H"), 0xDD: ("list", ">I"), 0xDE: ("map", ">H"), 0xDF: ("map", ">I")}
CONSTANTS = {0xC0: None, 0xC2: False, 0xC3: True}


def loads(data: bytes) -> Any:
    value, end = _value(data, 0)
    if end != len(data):
        raise ValueError("bytes after the value")
    return value


def _value(data: bytes, at: int) -> tuple[Any, int]:
    head = data[at]
    at += 1
    if head in CONSTANTS:
        return CONSTANTS[head], at
    if head in SCALARS:
        size = struct.calcsize(SCALARS[head])
        return struct.unpack_from(SCALARS[head], data, at)[0], at + size
    if head < 0x80 or head >= 0xE0:
        return head if head < 0x80 else head - 256, at
    if head in LENGTHS:
        kind, fmt = LENGTHS[head]
        n = struct.unpack_from(fmt, data, at)[0]
        at += struct.calcsize(fmt)
    elif head < 0xC0:
        kind, n = ("map", head & 15) if head < 0x90 else ("list", head & 15) if head < 0xA0 else ("str", head & 31)
    else:
        raise ValueError(f"unknown type byte {head:#x}")
    if kind in ("bin", "str"):
        raw = data[at : at + n]
        if len(raw) < n:
            raise ValueError("the value is cut off")
        return (raw.decode() if kind == "str" else raw), at + n
    items = []
    for _ in range(n * (2 if kind == "map" else 1)):
        x, at = _value(data, at)
        items.append(x)
    return (dict(zip(items[::2], items[1::2])) if kind == "map" else items), at


def _sized(n: int, fixed: int, room: int, wide: dict[int, str]) -> bytes:
    if n < room:
        return bytes([fixed | n])
    for code, fmt in wide.items():
        if n < 1 << 8 * struct.calcsize(fmt):
            return bytes([code]) + struct.pack(fmt, n)
    raise ValueError("too long")


def dumps(x: Any) -> bytes:
    if x is None or isinstance(x, bool):
        return bytes([next(k for k, v in CONSTANTS.items() if v is x)])
    if isinstance(x, int):
        if -32 <= x < 128:
            return struct.pack(">b" if x < 0 else ">B", x)
        return bytes([0xD3]) + struct.pack(">q", x) if x < 1 << 63 else bytes([0xCF]) + struct.pack(">Q", x)
    if isinstance(x, float):
        return bytes([0xCB]) + struct.pack(">d", x)
    if isinstance(x, str):
        raw = x.encode()
        return _sized(len(raw), 0xA0, 32, {0xD9: ">B", 0xDA: ">H", 0xDB: ">I"}) + raw
    if isinstance(x, bytes):
        return _sized(len(x), 0, 0, {0xC4: ">B", 0xC5: ">H", 0xC6: ">I"}) + x
    if isinstance(x, dict):
        return _sized(len(x), 0x80, 16, {0xDE: ">H", 0xDF: ">I"}) + b"".join(dumps(k) + dumps(v) for k, v in x.items())
    return _sized(len(x), 0x90, 16, {0xDC: ">H", 0xDD: ">I"}) + b"".join(map(dumps, x))
