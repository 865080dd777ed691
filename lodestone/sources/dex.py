"""Decoder of bytecode images (DEX 035-041) into relational rows.

The header and id tables are read with numpy views; code is decoded only when a table needs it.
Indexes are resolved to text here, since every later query would join them back.
"""

from __future__ import annotations

import contextlib
import hashlib
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np

NO_INDEX = 0xFFFFFFFF
VERSIONS = {b"035", b"037", b"038", b"039", b"040", b"041"}
ENDIAN = 0x12345678


class CorruptImage(ValueError):
    pass


# ---------------------------------------------------------------- text and integers
def uleb128(b: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        x = b[at]
        at += 1
        out |= (x & 0x7F) << shift
        if x < 0x80:
            return out & NO_INDEX, at
        shift += 7
        if shift > 28:
            raise CorruptImage("uleb128 too long")


def uleb128p1(b: bytes, at: int) -> tuple[int, int]:
    v, at = uleb128(b, at)
    return v - 1, at


def sleb128(b: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        x = b[at]
        at += 1
        out |= (x & 0x7F) << shift
        shift += 7
        if x < 0x80:
            return (out - (1 << shift) if x & 0x40 else out), at
        if shift > 28:
            raise CorruptImage("sleb128 too long")


def mutf8_decode(b: bytes) -> str:
    """Modified UTF-8: surrogate pairs as two three-byte forms, NUL as C0 80; lone surrogates become U+FFFD."""
    try:
        if b"\xc0\x80" not in b and b"\xed" not in b:
            return b.decode("utf-8")
        units = b.replace(b"\xc0\x80", b"\0").decode("utf-8", "surrogatepass")
        return units.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")
    except UnicodeDecodeError:
        return b.decode("utf-8", "replace")


def mutf8_encode(s: str) -> bytes:
    out = bytearray()
    for c in s:
        o = ord(c)
        if o == 0:
            out += b"\xc0\x80"
        elif o > 0xFFFF:
            o -= 0x10000
            out += chr(0xD800 + (o >> 10)).encode("utf-8", "surrogatepass") + chr(0xDC00 + (o & 0x3FF)).encode("utf-8", "surrogatepass")
        else:
            out += c.encode("utf-8", "surrogatepass")
    return bytes(out)


class Inflating:
    """Raw deflate data of a known size, read like bytes; it is inflated as far as it is read."""

    STEP = 1 << 14  # of the packed data at once

    def __init__(self, packed: bytes, size: int):
        self.packed, self.size, self.out = packed, size, bytearray()
        self._at, self._d = 0, zlib.decompressobj(-15)

    @property
    def inflated(self) -> int:
        return len(self.out)

    def upto(self, n: int) -> None:
        n = min(n, self.size)
        while len(self.out) < n:
            chunk = self._d.unconsumed_tail
            if not chunk:
                chunk = self.packed[self._at : self._at + self.STEP]
                self._at += self.STEP
            if not chunk or self._d.eof:
                raise CorruptImage("packed data ends early")
            self.out += self._d.decompress(chunk, n - len(self.out))

    def whole(self) -> bytes:
        self.upto(self.size)
        return bytes(self.out)

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, i: int | slice):
        if isinstance(i, slice):
            self.upto(self.size if i.stop is None else i.stop)
            return bytes(self.out[i])
        if i >= self.size:
            raise IndexError(i)
        self.upto(i + 1)
        return self.out[i]

    def index(self, what: bytes, at: int) -> int:
        self.upto(at + 64)
        while (found := self.out.find(what, at)) < 0:
            if len(self.out) >= self.size:
                raise ValueError(f"{what!r} is not found")
            self.upto(len(self.out) + 256)
        return found


@contextlib.contextmanager
def sound():
    """Whatever a damaged image makes a decoder stumble over is one error, CorruptImage."""
    try:
        yield
    except CorruptImage:
        raise
    except (LookupError, ValueError, ArithmeticError, TypeError, RecursionError, struct.error, zlib.error, EOFError, NotImplementedError, zipfile.BadZipFile) as e:
        raise CorruptImage(f"{type(e).__name__}: {e}"[:200]) from e


def quote(s: str) -> str:
    """A double-quoted literal: the usual escapes, other control characters by number."""
    return '"' + s.translate(ESCAPES) + '"'


#: Fixed values of the literal syntax.
ESCAPES = {i: f"\\u{{{i:x}}}" for i in (*range(0x20), *range(0x7F, 0xA0))} | {0: "\\0", 9: "\\t", 10: "\\n", 13: "\\r", 34: '\\"', 92: "\\\\"}


# ---------------------------------------------------------------- opcodes
# Fixed values of the public instruction format: mnemonic and format of each opcode, by ranges.
def _opcodes() -> dict[int, tuple[str, str]]:
    t: dict[int, tuple[str, str]] = {}

    def put(first: int, fmt: str, names: str) -> None:
        for i, n in enumerate(names.split()):
            t[first + i] = (n, fmt)

    put(0x00, "10x", "nop")
    for i, n in enumerate(("move", "move-wide", "move-object")):
        put(0x01 + 3 * i, "12x", n)
        put(0x02 + 3 * i, "22x", f"{n}/from16")
        put(0x03 + 3 * i, "32x", f"{n}/16")
    put(0x0A, "11x", "move-result move-result-wide move-result-object move-exception")
    put(0x0E, "10x", "return-void")
    put(0x0F, "11x", "return return-wide return-object")
    put(0x12, "11n", "const/4")
    put(0x13, "21s", "const/16")
    put(0x14, "31i", "const")
    put(0x15, "21h", "const/high16")
    put(0x16, "21s", "const-wide/16")
    put(0x17, "31i", "const-wide/32")
    put(0x18, "51l", "const-wide")
    put(0x19, "21h", "const-wide/high16")
    put(0x1A, "21c:string", "const-string")
    put(0x1B, "31c:string", "const-string/jumbo")
    put(0x1C, "21c:type", "const-class")
    put(0x1D, "11x", "monitor-enter monitor-exit")
    put(0x1F, "21c:type", "check-cast")
    put(0x20, "22c:type", "instance-of")
    put(0x21, "12x", "array-length")
    put(0x22, "21c:type", "new-instance")
    put(0x23, "22c:type", "new-array")
    put(0x24, "35c:type", "filled-new-array")
    put(0x25, "3rc:type", "filled-new-array/range")
    put(0x26, "31t", "fill-array-data")
    put(0x27, "11x", "throw")
    put(0x28, "10t", "goto")
    put(0x29, "20t", "goto/16")
    put(0x2A, "30t", "goto/32")
    put(0x2B, "31t", "packed-switch sparse-switch")
    put(0x2D, "23x", "cmpl-float cmpg-float cmpl-double cmpg-double cmp-long")
    put(0x32, "22t", "if-eq if-ne if-lt if-ge if-gt if-le")
    put(0x38, "21t", "if-eqz if-nez if-ltz if-gez if-gtz if-lez")
    kinds = ("", "-wide", "-object", "-boolean", "-byte", "-char", "-short")
    for first, fmt, verb in ((0x44, "23x", "aget"), (0x4B, "23x", "aput"), (0x52, "22c:field", "iget"), (0x59, "22c:field", "iput"), (0x60, "21c:field", "sget"), (0x67, "21c:field", "sput")):
        put(first, fmt, " ".join(verb + k for k in kinds))
    calls = [f"invoke-{k}" for k in ("virtual", "super", "direct", "static", "interface")]
    put(0x6E, "35c:method", " ".join(calls))
    put(0x74, "3rc:method", " ".join(f"{c}/range" for c in calls))
    put(0x7B, "12x", "neg-int not-int neg-long not-long neg-float neg-double")
    put(0x81, "12x", "int-to-long int-to-float int-to-double long-to-int long-to-float long-to-double float-to-int float-to-long float-to-double double-to-int double-to-long double-to-float int-to-byte int-to-char int-to-short")
    whole = "add sub mul div rem and or xor shl shr ushr".split()
    real = "add sub mul div rem".split()
    arith = [f"{o}-{k}" for k, ops in (("int", whole), ("long", whole), ("float", real), ("double", real)) for o in ops]
    put(0x90, "23x", " ".join(arith))
    put(0xB0, "12x", " ".join(f"{a}/2addr" for a in arith))
    put(0xD0, "22s", "add-int/lit16 rsub-int mul-int/lit16 div-int/lit16 rem-int/lit16 and-int/lit16 or-int/lit16 xor-int/lit16")
    put(0xD8, "22b", "add-int/lit8 rsub-int/lit8 mul-int/lit8 div-int/lit8 rem-int/lit8 and-int/lit8 or-int/lit8 xor-int/lit8 shl-int/lit8 shr-int/lit8 ushr-int/lit8")
    put(0xFA, "45cc:method", "invoke-polymorphic")
    put(0xFB, "4rcc:method", "invoke-polymorphic/range")
    put(0xFC, "35c:call_site", "invoke-custom")
    put(0xFD, "3rc:call_site", "invoke-custom/range")
    put(0xFE, "21c:method_handle", "const-method-handle")
    put(0xFF, "21c:proto", "const-method-type")
    return t


OPCODES = _opcodes()
SIZES = [int(OPCODES[i][1][0]) if i in OPCODES else 1 for i in range(256)]


@dataclass
class Instruction:
    pc: int  # in 16-bit units
    op: int
    mnemonic: str
    size: int
    ref_kind: str | None
    ref_idx: int | None
    registers: list[int]
    literal: int | None
    target: int | None  # pc of a branch or of a payload
    payload: tuple | None = None


def _signed(v: int, bits: int) -> int:
    return v - (1 << bits) if v >> (bits - 1) else v


def decode_one(u: np.ndarray, pc: int) -> Instruction:
    """The instruction at a place of a method's 16-bit units."""
    w = int(u[pc])
    op, high = w & 0xFF, w >> 8
    if op == 0 and high in (1, 2, 3):
        return _payload(u, pc, high)
    name, spec = OPCODES.get(op, (f"unused-{op:02x}", "10x"))
    fmt, _, kind = spec.partition(":")
    size = SIZES[op]
    if pc + size > len(u):
        raise CorruptImage("instruction runs over the end")
    a, b = high & 15, high >> 4
    x = int(u[pc + 1]) if size > 1 else 0
    y = int(u[pc + 2]) if size > 2 else 0
    regs, lit, tgt, ref = [], None, None, None
    match fmt:
        case "12x":
            regs = [a, b]
        case "11n":
            regs, lit = [a], _signed(b, 4)
        case "11x":
            regs = [high]
        case "10t":
            tgt = pc + _signed(high, 8)
        case "20t":
            tgt = pc + _signed(x, 16)
        case "30t":
            tgt = pc + _signed(x | y << 16, 32)
        case "22x":
            regs = [high, x]
        case "32x":
            regs = [x, y]
        case "21t":
            regs, tgt = [high], pc + _signed(x, 16)
        case "22t":
            regs, tgt = [a, b], pc + _signed(x, 16)
        case "31t":
            regs, tgt = [high], pc + _signed(x | y << 16, 32)
        case "21s":
            regs, lit = [high], _signed(x, 16)
        case "21h":
            regs, lit = [high], _signed(x, 16) << (48 if op == 0x19 else 16)
        case "31i":
            regs, lit = [high], _signed(x | y << 16, 32)
        case "51l":
            regs, lit = [high], _signed(sum(int(u[pc + 1 + k]) << 16 * k for k in range(4)), 64)
        case "23x":
            regs = [high, x & 255, x >> 8]
        case "22b":
            regs, lit = [high, x & 255], _signed(x >> 8, 8)
        case "22s":
            regs, lit = [a, b], _signed(x, 16)
        case "21c":
            regs, ref = [high], x
        case "22c":
            regs, ref = [a, b], x
        case "31c":
            regs, ref = [high], x | y << 16
        case "35c" | "45cc":
            ref = x
            regs = [y & 15, y >> 4 & 15, y >> 8 & 15, y >> 12, a][:b]
        case "3rc" | "4rcc":
            ref, regs = x, list(range(y, y + high))
    return Instruction(pc, op, name, size, kind or None, ref, regs, lit, tgt)


def _payload(u: np.ndarray, pc: int, kind: int) -> Instruction:
    i32 = lambda k: _signed(int(u[k]) | int(u[k + 1]) << 16, 32)
    n = int(u[pc + 1])
    if kind == 1:
        data = ("packed-switch", i32(pc + 2), [i32(pc + 4 + 2 * k) for k in range(n)])
        size = 4 + 2 * n
    elif kind == 2:
        data = ("sparse-switch", [i32(pc + 2 + 2 * k) for k in range(n)], [i32(pc + 2 + 2 * (n + k)) for k in range(n)])
        size = 2 + 4 * n
    else:
        count = int(u[pc + 2]) | int(u[pc + 3]) << 16
        raw = u[pc + 4 :].astype("<u2").tobytes()[: n * count]
        data, size = ("array-data", n, raw), 4 + (n * count + 1) // 2
    if pc + size > len(u):
        raise CorruptImage("payload runs over the end")
    return Instruction(pc, int(u[pc]), f"{data[0]}-payload", size, None, None, [], None, None, data)


def decode_all(u: np.ndarray) -> Iterator[Instruction]:
    pc = 0
    while pc < len(u):
        ins = decode_one(u, pc)
        yield ins
        pc += ins.size


# ---------------------------------------------------------------- the image
class Image:
    """One image: id tables as arrays, text decoded when asked for.  Of data that is still packed no
    more is inflated than is read."""

    WIDTHS = {"strings": 1, "types": 1, "protos": 3, "fields": 2, "methods": 2, "classes": 8}  # 32-bit words of a row

    def __init__(self, data: bytes | Inflating):
        if len(data) < 0x70 or data[:4] != b"dex\n" or data[7:8] != b"\0":
            raise CorruptImage("not a bytecode image")
        if data[4:7] not in VERSIONS:
            raise CorruptImage(f"version {data[4:7]!r} is not supported")
        self.data = data
        h = self._unpack("<20I", 0x20)
        if h[2] != ENDIAN:
            raise CorruptImage("unexpected byte order")
        self.map_off = h[5]
        self.counts = dict(zip(self.WIDTHS, h[6:18:2], strict=True))
        self.offsets = dict(zip(self.WIDTHS, h[7:18:2], strict=True))
        self.version = data[4:7].decode()
        for name, width in self.WIDTHS.items():
            if self.counts[name] and self.offsets[name] + 4 * width * self.counts[name] > len(data):
                raise CorruptImage(f"{name} run over the end")
        self._text: dict[int, str] = {}

    def _unpack(self, fmt: str, at: int) -> tuple:
        if isinstance(self.data, bytes):
            return struct.unpack_from(fmt, self.data, at)
        return struct.unpack(fmt, self.data[at : at + struct.calcsize(fmt)])

    def _table(self, name: str) -> np.ndarray:
        n, off, width = self.counts[name], self.offsets[name], self.WIDTHS[name]
        return np.frombuffer(self.data[off : off + 4 * width * n] if n else b"", "<u4").reshape(n, width).astype(np.int64)

    def _split(self, name: str) -> np.ndarray:
        """Rows of two 16-bit numbers and a 32-bit one."""
        t = self._table(name)
        return np.stack([t[:, 0] & 0xFFFF, t[:, 0] >> 16, t[:, 1]], 1)

    @cached_property
    def string_offs(self) -> np.ndarray:
        return self._table("strings")[:, 0]

    @cached_property
    def type_ids(self) -> np.ndarray:
        return self._table("types")[:, 0]

    @cached_property
    def proto_ids(self) -> np.ndarray:
        return self._table("protos")

    @cached_property
    def field_ids(self) -> np.ndarray:
        return self._split("fields")  # class, type, name

    @cached_property
    def method_ids(self) -> np.ndarray:
        return self._split("methods")  # class, proto, name

    @cached_property
    def class_defs(self) -> np.ndarray:
        return self._table("classes")

    def whole(self) -> bytes:
        """All of the data; what reads most of an image is quicker over bytes."""
        if isinstance(self.data, Inflating):
            self.data = self.data.whole()
        return self.data

    # text
    def string(self, i: int) -> str:
        if i not in self._text:
            _, at = uleb128(self.data, int(self.string_offs[i]))
            self._text[i] = mutf8_decode(self.data[at : self.data.index(b"\0", at)])
        return self._text[i]

    def type(self, i: int) -> str:
        return self.string(int(self.type_ids[i]))

    def internal(self, i: int) -> str:
        t = self.type(i)
        return t[1:-1] if t.startswith("L") and t.endswith(";") else t

    def type_list(self, off: int) -> list[str]:
        if not off:
            return []
        (n,) = self._unpack("<I", off)
        return [self.type(x) for x in self._unpack(f"<{n}H", off + 4)]

    def proto(self, i: int) -> tuple[str, list[str]]:
        _, ret, params = self.proto_ids[i]
        return self.type(int(ret)), self.type_list(int(params))

    def proto_descriptor(self, i: int) -> str:
        ret, params = self.proto(i)
        return f"({''.join(params)}){ret}"

    def method(self, i: int) -> tuple[str, str, str]:
        """Owner descriptor, name, descriptor."""
        c, p, n = (int(x) for x in self.method_ids[i])
        return self.type(c), self.string(n), self.proto_descriptor(p)

    def field(self, i: int) -> tuple[str, str, str]:
        c, t, n = (int(x) for x in self.field_ids[i])
        return self.type(c), self.string(n), self.type(t)

    def reference(self, kind: str, i: int) -> str:
        """How a reference is shown."""
        if kind == "string":
            return quote(self.string(i))
        if kind == "type":
            return self.type(i)
        if kind == "field":
            c, n, t = self.field(i)
            return f"{c}->{n}:{t}"
        if kind == "method":
            c, n, d = self.method(i)
            return f"{c}->{n}{d}"
        if kind == "proto":
            return self.proto_descriptor(i)
        return f"{kind}@{i}"

    # classes
    def class_data(self, off: int) -> tuple[list[tuple[int, int, bool]], list[tuple[int, int, int]]]:
        """Fields (idx, access, static) and methods (idx, access, code offset); index deltas start anew in each list."""
        if not off:
            return [], []
        d, sizes = self.data, []
        for _ in range(4):
            n, off = uleb128(d, off)
            sizes.append(n)
        fields, methods = [], []
        for part, n in enumerate(sizes):
            idx = 0
            for _ in range(n):
                delta, off = uleb128(d, off)
                access, off = uleb128(d, off)
                idx += delta
                if part < 2:
                    fields.append((idx, access, part == 0))
                else:
                    code, off = uleb128(d, off)
                    methods.append((idx, access, code))
        return fields, methods

    def code_head(self, off: int) -> tuple[int, int, int, int, int, int]:
        """Registers, ins, outs, try blocks, debug offset and units of a code item."""
        head = self._unpack("<4H2I", off)
        if off + 16 + 2 * head[5] > len(self.data):
            raise CorruptImage("code runs over the end")
        return head

    def code(self, off: int) -> dict | None:
        """Registers, units and try blocks of a code item."""
        if not off:
            return None
        regs, ins, outs, tries, debug, size = self.code_head(off)
        units = np.frombuffer(self.data[off + 16 : off + 16 + 2 * size], "<u2")
        blocks = []
        at = off + 16 + 2 * size + (2 if tries and size % 2 else 0)
        base = at + 8 * tries
        for k in range(tries):
            start, n, handler = self._unpack("<I2H", at + 8 * k)
            pos = base + handler
            count, pos = sleb128(self.data, pos)
            catches = []
            for _ in range(abs(count)):
                t, pos = uleb128(self.data, pos)
                addr, pos = uleb128(self.data, pos)
                catches.append({"type": self.type(t), "addr": addr})
            every = uleb128(self.data, pos)[0] if count <= 0 else None
            blocks.append({"start_addr": start, "insn_count": n, "catches": catches, "catch_all": every})
        return {"registers": regs, "ins": ins, "outs": outs, "debug": debug, "units": units, "tries": blocks}

    def methods_of(self, seq: int) -> Iterator[tuple[int, int, int, int]]:
        """method_seq, method_idx, access, code_off of a class."""
        _, methods = self.class_data(int(self.class_defs[seq, 6]))
        for k, (idx, access, code) in enumerate(methods):
            yield k, idx, access, code

    # encoded values
    def value(self, at: int) -> tuple[object, int]:
        """An encoded value as plain data: arrays are lists, annotations ("@type", {name: value})."""
        head = self.data[at]
        arg, kind = head >> 5, head & 31
        at += 1
        if kind == 0x1C:
            return self.array(at)
        if kind == 0x1D:
            t, elements, at = self.annotation(at)
            return (f"@{t}", elements), at
        if kind == 0x1E:
            return None, at
        if kind == 0x1F:
            return bool(arg), at
        raw = self.data[at : at + arg + 1]
        at += arg + 1
        if kind in (0x00, 0x02, 0x04, 0x06):
            return int.from_bytes(raw, "little", signed=True), at
        if kind == 0x10:
            return struct.unpack("<f", raw.rjust(4, b"\0"))[0], at
        if kind == 0x11:
            return struct.unpack("<d", raw.rjust(8, b"\0"))[0], at
        n = int.from_bytes(raw, "little")
        if kind == 0x03:
            return chr(n), at
        shown = {0x15: "proto", 0x16: "method_handle", 0x18: "type", 0x19: "field", 0x1A: "method", 0x1B: "field"}
        if kind == 0x17:
            return self.string(n), at
        if kind in shown:
            return self.reference(shown[kind], n), at
        raise CorruptImage(f"encoded value {kind:#x}")

    def array(self, at: int) -> tuple[list, int]:
        n, at = uleb128(self.data, at)
        out = []
        for _ in range(n):
            v, at = self.value(at)
            out.append(v)
        return out, at

    def annotation(self, at: int) -> tuple[str, dict, int]:
        t, at = uleb128(self.data, at)
        n, at = uleb128(self.data, at)
        out = {}
        for _ in range(n):
            name, at = uleb128(self.data, at)
            out[self.string(name)], at = self.value(at)
        return self.type(t), out, at

    def class_annotations(self, seq: int) -> list[tuple[int, str, dict]]:
        """(visibility, type, elements) on the class itself."""
        off = int(self.class_defs[seq, 5])
        if not off:
            return []
        (s,) = self._unpack("<I", off)
        if not s:
            return []
        (n,) = self._unpack("<I", s)
        out = []
        for item in self._unpack(f"<{n}I", s + 4):
            t, elements, _ = self.annotation(item + 1)
            out.append((self.data[item], t, elements))
        return out

    def map_items(self) -> dict[int, tuple[int, int]]:
        """Kind -> (count, offset) of the map list."""
        if not self.map_off:
            return {}
        (n,) = self._unpack("<I", self.map_off)
        return {k: (c, o) for k, _, c, o in (self._unpack("<2H2I", self.map_off + 4 + 12 * i) for i in range(n))}

    def debug(self, off: int, registers: int) -> tuple[list[str | None], list[dict]]:
        """Parameter names, and local variables with their ranges, of a debug stream."""
        if not off:
            return [], []
        d = self.data
        _, at = uleb128(d, off)
        n, at = uleb128(d, at)
        names: list[str | None] = []
        for _ in range(n):
            i, at = uleb128p1(d, at)
            names.append(self.string(i) if i >= 0 else None)
        live: dict[int, dict] = {}
        last: dict[int, tuple] = {}
        out: list[dict] = []
        addr = 0

        def close(reg: int) -> None:
            if reg in live:
                out.append(live.pop(reg) | {"end": addr})

        while True:
            op = d[at]
            at += 1
            if op == 0:
                break
            if op == 1:
                k, at = uleb128(d, at)
                addr += k
            elif op == 2:
                _, at = sleb128(d, at)
            elif op in (3, 4):
                reg, at = uleb128(d, at)
                name, at = uleb128p1(d, at)
                t, at = uleb128p1(d, at)
                if op == 4:
                    _, at = uleb128p1(d, at)
                close(reg)
                last[reg] = (self.string(name) if name >= 0 else None, self.type(t) if t >= 0 else None)
                live[reg] = {"reg": reg, "start": addr, "name": last[reg][0], "type": last[reg][1]}
            elif op == 5:
                reg, at = uleb128(d, at)
                close(reg)
            elif op == 6:
                reg, at = uleb128(d, at)
                if reg in last:
                    close(reg)
                    live[reg] = {"reg": reg, "start": addr, "name": last[reg][0], "type": last[reg][1]}
            elif op == 9:
                _, at = uleb128p1(d, at)
            elif op >= 10:
                addr += (op - 10) // 15
        for reg in list(live):
            close(reg)
        return names, out


def operands(img: Image, ins: Instruction) -> str:
    """The operand text of a listing."""
    if ins.payload:
        return str(len(ins.payload[2]))
    regs = [f"v{r}" for r in ins.registers]
    if ins.mnemonic.startswith(("invoke", "filled-new-array")):
        parts = ["{" + ", ".join(regs) + "}"]
    else:
        parts = regs
    if ins.literal is not None:
        parts.append(f"#{ins.literal}")
    if ins.ref_kind:
        parts.append(img.reference(ins.ref_kind, ins.ref_idx))
    if ins.target is not None:
        parts.append(f":{2 * ins.target:04x}")
    return ", ".join(parts)


def md5(data: bytes) -> str:
    return hashlib.md5(data).hexdigest()
