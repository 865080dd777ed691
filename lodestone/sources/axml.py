"""Binary XML and resource tables: chunked formats decoded to elements and string resources."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.sax.saxutils import escape, quoteattr

# Fixed values of the public chunk format.
STRING_POOL, XML, XML_START, XML_END, XML_TEXT, TABLE, PACKAGE, TYPE = 0x0001, 0x0003, 0x0102, 0x0103, 0x0104, 0x0002, 0x0200, 0x0201
UTF8 = 1 << 8
DIMENSIONS = ("px", "dp", "sp", "pt", "in", "mm")
RADIX = (1.0, 1 / (1 << 7), 1 / (1 << 15), 1 / (1 << 23))


@dataclass
class Element:
    line: int
    depth: int
    element: str
    attrs: dict[str, str] = field(default_factory=dict)


def string_pool(b: bytes, at: int) -> list[str]:
    _, head, _, count, _, flags, strings, _ = struct.unpack_from("<2H6I", b, at)
    out = []
    for (off,) in struct.iter_unpack("<I", b[at + head : at + head + 4 * count]):
        p = at + strings + off
        if flags & UTF8:
            p += 2 if b[p] & 0x80 else 1  # characters
            n = b[p]
            p += 1
            if n & 0x80:
                n = (n & 0x7F) << 8 | b[p]
                p += 1
            out.append(b[p : p + n].decode("utf-8", "replace"))
        else:
            (n,) = struct.unpack_from("<H", b, p)
            p += 2
            if n & 0x8000:
                n = (n & 0x7FFF) << 16 | struct.unpack_from("<H", b, p)[0]
                p += 2
            out.append(b[p : p + 2 * n].decode("utf-16-le", "replace"))
    return out


def value(kind: int, data: int, pool: list[str]) -> str:
    signed = data - (1 << 32) if data >> 31 else data
    if kind == 0x03:
        return pool[data] if data < len(pool) else ""
    if kind in (0x01, 0x07):
        return f"@0x{data:08x}"
    if kind in (0x02, 0x08):
        return f"?0x{data:08x}"
    if kind == 0x04:
        return f"{struct.unpack('<f', struct.pack('<I', data))[0]:g}"
    if kind in (0x05, 0x06):
        number = (signed >> 8) * RADIX[data >> 4 & 3]
        return f"{number:g}{DIMENSIONS[data & 15] if kind == 5 and data & 15 < len(DIMENSIONS) else ''}" if kind == 5 else f"{number * 100:g}%{'p' if data & 15 else ''}"
    if kind == 0x12:
        return "true" if data else "false"
    if kind == 0x11:
        return f"0x{data:x}"
    if 0x1C <= kind <= 0x1F:
        return f"#{data:08x}"
    return str(signed)


def elements(b: bytes) -> Iterator[Element | str | None]:
    """Elements and texts in document order; None closes the innermost element."""
    kind, head, total = struct.unpack_from("<2HI", b, 0)
    if kind != XML:
        raise ValueError("not binary XML")
    at, pool, names, depth = head, [], {}, 0
    while at + 8 <= min(total, len(b)):
        kind, head, size = struct.unpack_from("<2HI", b, at)
        if size < 8:
            raise ValueError("bad chunk")
        if kind == STRING_POOL:
            pool = string_pool(b, at)
        elif kind == 0x0100:  # a namespace
            prefix, uri = struct.unpack_from("<2I", b, at + head)
            names[uri] = pool[prefix] if prefix < len(pool) else ""
        elif kind == XML_START:
            (line,) = struct.unpack_from("<I", b, at + 8)
            _, name, start, width, count = struct.unpack_from("<2I3H", b, at + head)
            e = Element(line, depth, pool[name])
            for k in range(count):
                ns, key, text, _, _, t, data = struct.unpack_from("<3IHBBI", b, at + head + start + k * width)
                label = pool[key] if key < len(pool) else f"attr{k}"
                label = f"{names.get(ns) or 'android'}:{label}" if ns != 0xFFFFFFFF else label
                e.attrs[label] = pool[text] if t == 3 and text < len(pool) else value(t, data, pool)
            depth += 1
            yield e
        elif kind == XML_TEXT:
            (text,) = struct.unpack_from("<I", b, at + head)
            if text < len(pool):
                yield pool[text]
        elif kind == XML_END:
            depth -= 1
            yield None
        at += size


def to_xml(b: bytes) -> str:
    """Text form with two spaces a level."""
    out, stack, open_ = ['<?xml version="1.0" encoding="utf-8"?>'], [], False
    for e in elements(b):
        if isinstance(e, str):
            if text := e.strip():
                out[-1] += ">" if open_ else ""
                out.append(f"{'  ' * len(stack)}{escape(text)}")
                open_ = False
        elif e is not None:
            if open_:
                out[-1] += ">"
            attrs = "".join(f" {k}={quoteattr(v)}" for k, v in e.attrs.items())
            out.append(f"{'  ' * e.depth}<{e.element}{attrs}")
            stack.append(e)
            open_ = True
        else:
            top = stack.pop()
            if open_:
                out[-1] += "/>"
            else:
                out.append(f"{'  ' * top.depth}</{top.element}>")
            open_ = False
    return "\n".join(out) + "\n"


def string_resources(b: bytes) -> Iterator[tuple[int, int, int, str]]:
    """(package, type, entry, text) of string-valued resources; the first configuration that has an entry wins."""
    kind, head, _ = struct.unpack_from("<2HI", b, 0)
    if kind != TABLE:
        raise ValueError("not a resource table")
    at, pool, seen = head, [], set()
    while at + 8 <= len(b):
        kind, head, size = struct.unpack_from("<2HI", b, at)
        if size < 8:
            break
        if kind == STRING_POOL and not pool:
            pool = string_pool(b, at)
        elif kind == PACKAGE:
            (package,) = struct.unpack_from("<I", b, at + 8)
            inner = at + head
            while inner + 8 <= at + size:
                k, h, n = struct.unpack_from("<2HI", b, inner)
                if n < 8:
                    break
                if k == TYPE:
                    for entry, off in _entries(b, inner, h):
                        width, flags = struct.unpack_from("<2H", b, off)
                        if flags & 1 or width < 8:  # a map
                            continue
                        _, _, t, data = struct.unpack_from("<HBBI", b, off + width)
                        key = (package, b[inner + 8], entry)
                        if t == 3 and data < len(pool) and key not in seen:
                            seen.add(key)
                            yield (*key, pool[data])
                inner += n
        at += size


def _entries(b: bytes, at: int, head: int) -> Iterator[tuple[int, int]]:
    flags, _, count, start = b[at + 9], 0, *struct.unpack_from("<2I", b, at + 12)
    if flags & 1:  # sparse
        for k in range(count):
            entry, off = struct.unpack_from("<2H", b, at + head + 4 * k)
            yield entry, at + start + 4 * off
    else:
        for k in range(count):
            (off,) = struct.unpack_from("<I", b, at + head + 4 * k)
            if off != 0xFFFFFFFF:
                yield k, at + start + off
