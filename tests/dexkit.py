"""A small writer of bytecode images, binary XML and resource tables for tests."""

import struct
import zlib

from lodestone.sources.dex import mutf8_encode


def uleb(n):
    out = bytearray()
    while True:
        b = n & 0x7F
        n >>= 7
        out.append(b | (0x80 if n else 0))
        if not n:
            return bytes(out)


class Dex:
    """classes: dicts(name, super, interfaces, access, fields=[(name, type, access, static)], methods=[(name, params, ret, access, code)]);
    code: None or (registers, ins, outs, units function of this writer)."""

    def __init__(self, classes, extra_strings=(), extra_methods=(), extra_fields=(), version=b"038"):
        self.classes, self.version = classes, version
        strings, types, protos, fields, methods = set(extra_strings), set(), set(), set(extra_fields), set(extra_methods)
        for c in classes:
            types.add(c["name"])
            types.update(t for t in [c.get("super")] if t)
            types.update(c.get("interfaces", ()))
            if c.get("source"):
                strings.add(c["source"])
            for n, t, *_ in c.get("fields", ()):
                fields.add((c["name"], n, t))
            for n, p, r, *_ in c.get("methods", ()):
                methods.add((c["name"], n, tuple(p), r))
        for owner, n, t in fields:
            types.update((owner, t))
            strings.add(n)
        for owner, n, p, r in methods:
            types.update((owner, r, *p))
            strings.add(n)
            protos.add((r, tuple(p)))
        short = lambda t: t[0] if len(t) == 1 else "L"
        shorty = lambda r, p: short(r) + "".join(map(short, p))
        strings.update(types)
        strings.update(shorty(r, p) for r, p in protos)
        self.strings = sorted(strings, key=lambda s: s.encode("utf-16-be", "surrogatepass"))
        self.s = {x: i for i, x in enumerate(self.strings)}
        self.types = sorted(types, key=lambda t: self.s[t])
        self.t = {x: i for i, x in enumerate(self.types)}
        self.protos = sorted(protos, key=lambda x: (self.t[x[0]], [self.t[p] for p in x[1]]))
        self.p = {x: i for i, x in enumerate(self.protos)}
        self.fields = sorted(fields, key=lambda f: (self.t[f[0]], self.s[f[1]], self.t[f[2]]))
        self.f = {x: i for i, x in enumerate(self.fields)}
        self.methods = sorted(methods, key=lambda m: (self.t[m[0]], self.s[m[1]], self.p[m[3], m[2]]))
        self.m = {x: i for i, x in enumerate(self.methods)}
        self.shorty = shorty

    def build(self, strings_first=False):
        n = [len(x) for x in (self.strings, self.types, self.protos, self.fields, self.methods, self.classes)]
        width = (4, 4, 12, 8, 8, 32)
        offs, at = [], 0x70
        for k, w in zip(n, width):
            offs.append(at if k else 0)
            at += k * w
        base, data = at, bytearray()

        def put(b, align=1):
            while (base + len(data)) % align:
                data.append(0)
            pos = base + len(data)
            data.extend(b)
            return pos

        type_list = {}
        for want in [p for _, p in self.protos] + [tuple(c.get("interfaces", ())) for c in self.classes]:
            if want and want not in type_list:
                type_list[want] = put(struct.pack(f"<I{len(want)}H", len(want), *(self.t[x] for x in want)), 4)
        text = lambda: [put(uleb(len(x.encode("utf-16-le", "surrogatepass")) // 2) + mutf8_encode(x) + b"\0") for x in self.strings]
        string_at = text() if strings_first else None
        codes = {}
        for c in self.classes:
            for name, p, r, _, code in c.get("methods", ()):
                if code:
                    regs, ins, outs, make = code
                    units = make(self)
                    codes[c["name"], name, tuple(p), r] = put(struct.pack("<4H2I", regs, ins, outs, 0, 0, len(units)) + struct.pack(f"<{len(units)}H", *units), 4)
        class_data, statics = {}, {}
        for c in self.classes:
            fs = sorted((self.f[c["name"], f, t], a, st) for f, t, a, st in c.get("fields", ()))
            ms = sorted((self.m[c["name"], m, tuple(p), r], a, codes.get((c["name"], m, tuple(p), r), 0), m) for m, p, r, a, _ in c.get("methods", ()))
            parts = [[x for x in fs if x[2]], [x for x in fs if not x[2]], [x for x in ms if x[3] in ("<init>", "<clinit>") or x[1] & 0xA], [x for x in ms if not (x[3] in ("<init>", "<clinit>") or x[1] & 0xA)]]
            b = b"".join(uleb(len(p)) for p in parts)
            for k, part in enumerate(parts):
                last = 0
                for row in part:
                    b += uleb(row[0] - last) + uleb(row[1]) + (uleb(row[2]) if k > 1 else b"")
                    last = row[0]
            class_data[c["name"]] = put(b)
            if c.get("statics"):
                statics[c["name"]] = put(uleb(len(c["statics"])) + b"".join(bytes([0x04, v]) for v in c["statics"]))
        string_at = string_at or text()
        ids = b"".join(struct.pack("<I", x) for x in string_at)
        ids += b"".join(struct.pack("<I", self.s[t]) for t in self.types)
        ids += b"".join(struct.pack("<3I", self.s[self.shorty(r, p)], self.t[r], type_list.get(p, 0)) for r, p in self.protos)
        ids += b"".join(struct.pack("<2HI", self.t[o], self.t[t], self.s[f]) for o, f, t in self.fields)
        ids += b"".join(struct.pack("<2HI", self.t[o], self.p[r, p], self.s[m]) for o, m, p, r in self.methods)
        no = 0xFFFFFFFF
        for c in self.classes:
            ids += struct.pack("<8I", self.t[c["name"]], c.get("access", 1), self.t[c["super"]] if c.get("super") else no, type_list.get(tuple(c.get("interfaces", ())), 0), self.s[c["source"]] if c.get("source") else no, 0, class_data[c["name"]], statics.get(c["name"], 0))
        size = base + len(data)
        sizes = [x for pair in zip(n, offs) for x in pair]
        head = struct.pack("<20I", size, 0x70, 0x12345678, 0, 0, 0, *sizes, len(data), base)
        body = bytes(20) + head + ids + bytes(data)
        magic = b"dex\n" + self.version + b"\0"
        return magic + struct.pack("<I", zlib.adler32(body)) + body


S, O, SB, PS = "Ljava/lang/String;", "Ljava/lang/Object;", "Ljava/lang/StringBuilder;", "Ljava/io/PrintStream;"


def invoke(op, idx, *regs):
    r = [*regs, 0, 0, 0, 0][:4]
    return [op | len(regs) << 12, idx, r[0] | r[1] << 4 | r[2] << 8 | r[3] << 12]


def hello():
    init = (O, "<init>", (), "V")
    sb_init, append, to_s = (SB, "<init>", (S,), "V"), (SB, "append", (S,), SB), (SB, "toString", (), S)
    println, greet, g_init = (PS, "println", (S,), "V"), ("LGreeter;", "greet", (), S), ("LGreeter;", "<init>", (S,), "V")
    name, out, counter = ("LGreeter;", "name", S), ("Ljava/lang/System;", "out", PS), ("LHello;", "counter", "I")
    code_g_init = (2, 2, 1, lambda d: [*invoke(0x70, d.m[init], 0), 0x5B | 0 << 12 | 1 << 8, d.f[name], 0x0E])
    code_greet = (3, 1, 2, lambda d: [0x22 | 0 << 8, d.t[SB], 0x1A | 1 << 8, d.s["hi "], *invoke(0x70, d.m[sb_init], 0, 1), 0x54 | 2 << 12 | 1 << 8, d.f[name], *invoke(0x6E, d.m[append], 0, 1), 0x0C, *invoke(0x6E, d.m[to_s], 0), 0x0C, 0x11])
    code_clinit = (1, 0, 0, lambda d: [0x12 | 3 << 12, 0x67, d.f[counter], 0x0E])
    code_main = (4, 1, 2, lambda d: [0x22 | 0 << 8, d.t["LGreeter;"], 0x1A | 1 << 8, d.s["world"], *invoke(0x70, d.m[g_init], 0, 1), 0x62 | 1 << 8, d.f[out], *invoke(0x6E, d.m[greet], 0), 0x0C, *invoke(0x6E, d.m[println], 1, 0), 0x38 | 2 << 8, 3, 0x28 | 0xFF << 8, 0x0E])
    code_init = (1, 1, 1, lambda d: [*invoke(0x70, d.m[init], 0), 0x0E])
    return Dex(
        [
            {"name": "LGreeter;", "super": O, "fields": [("name", S, 0x12, False)], "methods": [("<init>", (S,), "V", 0x10001, code_g_init), ("greet", (), S, 1, code_greet)], "source": "Hello.java"},
            {"name": "LHello;", "super": O, "fields": [("counter", "I", 0xA, True)], "statics": [7], "methods": [("<clinit>", (), "V", 0x10008, code_clinit), ("<init>", (), "V", 0x10001, code_init), ("main", ("[" + S,), "V", 9, code_main)], "source": "Hello.java"},
        ],
        extra_strings=("hi ", "world", "a\0b", "\U0001f600"), extra_methods=(init, sb_init, append, to_s, println), extra_fields=(out,),
    )


def axml(tree):
    """tree: (name, {attr: text or int}, [children])."""
    pool = []

    def idx(s):
        if s not in pool:
            pool.append(s)
        return pool.index(s)

    def walk(node):
        name, attrs, kids = node
        b = b""
        for k, v in attrs.items():
            ns = 0xFFFFFFFF
            kind, data, text = (3, idx(v), idx(v)) if isinstance(v, str) and not v.startswith("@0x") else (1, int(v[3:], 16), 0xFFFFFFFF) if isinstance(v, str) else (16, v, 0xFFFFFFFF)
            if k.startswith("android:"):
                k, ns = k[8:], idx("ns")
            b += struct.pack("<3IHBBI", ns, idx(k), text, 8, 0, kind, data)
        head = struct.pack("<2I", 1, 0xFFFFFFFF)
        out = struct.pack("<2HI", 0x0102, 16, 16 + 20 + len(b)) + head + struct.pack("<2I6H", 0xFFFFFFFF, idx(name), 20, 20, len(attrs), 0, 0, 0) + b
        for k in kids:
            out += walk(k)
        return out + struct.pack("<2HI", 0x0103, 16, 24) + head + struct.pack("<2I", 0xFFFFFFFF, idx(name))

    body = walk(tree)
    ns = struct.pack("<2HI", 0x0100, 16, 24) + struct.pack("<4I", 1, 0xFFFFFFFF, idx("android"), idx("ns"))
    p = string_pool(pool)
    body = p + ns + body
    return struct.pack("<2HI", 3, 8, 8 + len(body)) + body


def string_pool(strings):
    blob, offs = b"", []
    for s in strings:
        offs.append(len(blob))
        u = s.encode("utf-16-le")
        blob += struct.pack("<H", len(u) // 2) + u + b"\0\0"
    blob += b"\0" * (-len(blob) % 4)
    head = 28 + 4 * len(offs)
    return struct.pack("<2H6I", 1, 28, head + len(blob), len(offs), 0, 0, head, 0) + struct.pack(f"<{len(offs)}I", *offs) + blob


def arsc(texts, package=0x7F, type_=1, sparse=False):
    """String resources 0.. of one type."""
    n = len(texts)
    if sparse:
        index = b"".join(struct.pack("<2H", k, 4 * k) for k in range(n))
    else:
        index = struct.pack(f"<{n}I", *(16 * k for k in range(n)))
    entries = b"".join(struct.pack("<2HI", 8, 0, k) + struct.pack("<HBBI", 8, 0, 3, k) for k in range(n))
    head = 20 + 56
    chunk = struct.pack("<2HI", 0x0201, head, head + len(index) + len(entries)) + bytes([type_, int(sparse), 0, 0]) + struct.pack("<2I", n, head + len(index)) + bytes(56) + index + entries
    pkg = struct.pack("<2HI", 0x0200, 288, 288 + len(chunk)) + struct.pack("<I", package) + bytes(276) + chunk
    body = string_pool(texts) + pkg
    return struct.pack("<2HI", 2, 12, 12 + len(body)) + struct.pack("<I", 1) + body


def manifest():
    act = lambda name, launcher: ("activity", {"android:name": name}, [("intent-filter", {}, [("action", {"android:name": "android.intent.action.MAIN"}, []), ("category", {"android:name": "android.intent.category.LAUNCHER"}, [])])] if launcher else [])
    return axml(("manifest", {"package": "com.app", "android:versionName": "1.2", "android:versionCode": 12}, [("uses-sdk", {"android:minSdkVersion": 21, "android:targetSdkVersion": 35}, []), ("application", {"android:name": ".App", "android:label": "@0x7f010001"}, [act(".Other", False), act("Hello", True), ("activity-alias", {"android:name": ".Alias"}, [])])]))
