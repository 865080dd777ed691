"""Containers: which images, entries, manifests and resource tables an input holds."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, replace
from typing import BinaryIO

from .dex import CorruptImage, Inflating

EXTENSIONS = ("dex", "apk", "jar", "zip", "xapk", "apks", "apkm")


@dataclass
class Place:
    """Where an image lies: its bytes in a file, or in an archive that is itself packed in the file."""

    label: str
    entry: str
    begin: int  # of the local header; of the data where raw
    packed: int
    size: int
    deflated: bool = False
    raw: bool = False
    within: Place | None = None


class Window(io.RawIOBase):
    """A part of a file that can be searched, as a file: a stored archive inside another."""

    def __init__(self, file: BinaryIO, begin: int, size: int):
        self.file, self.begin, self.size, self.at = file, begin, size, 0

    def seekable(self) -> bool:
        return True

    def readable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = 0) -> int:
        self.at = max(0, offset + (0, self.at, self.size)[whence])
        return self.at

    def read(self, n: int = -1) -> bytes:
        n = max(0, self.size - self.at) if n is None or n < 0 else min(n, max(0, self.size - self.at))
        self.file.seek(self.begin + self.at)
        out = self.file.read(n)
        self.at += len(out)
        return out


def stem(path: str) -> str:
    return re.sub(r"\.[^.]*$", "", path.rstrip("/").rsplit("/", 1)[-1])


def _order(name: str) -> tuple:
    """classes.dex, classes2.dex, ... by number, then other images by name."""
    m = re.fullmatch(r"classes(\d*)\.dex", name)
    return (0, int(m[1] or 1), "") if m else (1, 0, name)


def open_zip(data: bytes) -> zipfile.ZipFile:
    return zipfile.ZipFile(io.BytesIO(data))


def readable(info: zipfile.ZipInfo) -> bool:
    return info.compress_type in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) and not info.is_dir()


def inner_archives(z: zipfile.ZipFile) -> list[zipfile.ZipInfo]:
    """Of a container (it has packages and no image of its own): the packages, the base first."""
    infos = [i for i in z.infolist() if readable(i)]
    if any(i.filename.lower().endswith(".dex") for i in infos):
        return []
    apks = [i for i in infos if i.filename.lower().endswith(".apk")]
    return sorted(apks, key=lambda i: (i.filename.rsplit("/", 1)[-1].lower() != "base.apk", i.filename))


def plan(path: str, file: BinaryIO) -> Iterator[Place]:
    """The images of one input in their order, from its first bytes and directories; of the input only
    these are read.  A package that is itself packed is inflated for its directory."""
    name = stem(path)
    file.seek(0)
    head = file.read(4)
    if head == b"dex\n":
        size = file.seek(0, 2)
        yield Place(name, path.rsplit("/", 1)[-1], 0, size, size, raw=True)
    elif head[:2] == b"PK":
        z = zipfile.ZipFile(file)
        apks = inner_archives(z)
        if not apks:
            yield from (_place(f"{name}!{i.filename}", i) for i in _dex(z))
        for info in apks:
            own = _place(f"{name}!{info.filename}", info)
            inner = zipfile.ZipFile(z.open(info) if own.deflated else Window(file, data_begin(own, file), own.packed))
            yield from (replace(_place(f"{own.label}!{i.filename}", i), within=own) for i in _dex(inner))


def _place(label: str, info: zipfile.ZipInfo) -> Place:
    return Place(label, info.filename, info.header_offset, info.compress_size, info.file_size, info.compress_type == zipfile.ZIP_DEFLATED)


def data_begin(p: Place, file: BinaryIO) -> int:
    """The byte after an entry's local header."""
    if p.raw:
        return p.begin
    file.seek(p.begin)
    head = file.read(30)
    if len(head) < 30 or head[:4] != b"PK\3\4":
        raise CorruptImage("no entry where the directory says")
    return p.begin + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little")


def packed(p: Place, file: BinaryIO) -> bytes:
    """The bytes of a place as they lie there, deflated or not."""
    if p.within:
        outer = p.within
        if outer.deflated:
            file = io.BytesIO(Inflating(packed(outer, file), outer.size).whole())
        else:
            file = Window(file, data_begin(outer, file), outer.packed)
    file.seek(data_begin(p, file))
    out = file.read(p.packed)
    if len(out) < p.packed:
        raise CorruptImage("entry runs over the end")
    return out


def opened(data: bytes, size: int, deflated: bool) -> bytes | Inflating:
    """The bytes of an image, inflated as they are read."""
    return Inflating(data, size) if deflated else data


def _dex(z: zipfile.ZipFile) -> list[zipfile.ZipInfo]:
    return sorted((i for i in z.infolist() if readable(i) and i.filename.lower().endswith(".dex")), key=lambda i: _order(i.filename))


def entries(path: str, data: bytes) -> Iterator[tuple[str, str, str, int]]:
    """(container, name, method, compressed size); packages inside a container are listed one level down."""
    name = path.rsplit("/", 1)[-1]
    if data[:2] != b"PK":
        return
    z = open_zip(data)
    methods = {zipfile.ZIP_STORED: "stored", zipfile.ZIP_DEFLATED: "deflate"}
    for i in z.infolist():
        if i.is_dir():
            continue
        yield name, i.filename, methods.get(i.compress_type, f"method{i.compress_type}"), i.compress_size
        if i.filename.lower().endswith(".apk") and readable(i):
            for k in open_zip(z.read(i)).infolist():
                if not k.is_dir():
                    yield name, f"{i.filename}!{k.filename}", methods.get(k.compress_type, f"method{k.compress_type}"), k.compress_size


def member(path: str, data: bytes, name: str) -> bytes | None:
    """The bytes of a top-level entry, else of the first package inside that has it."""
    if data[:2] != b"PK":
        return None
    z = open_zip(data)
    if name in z.namelist():
        return z.read(name)
    for info in inner_archives(z):
        inner = open_zip(z.read(info))
        if name in inner.namelist():
            return inner.read(name)
    return None


def read_entry(data: bytes, name: str) -> bytes:
    """The bytes of apk!entry or entry."""
    head, _, tail = name.partition("!")
    z = open_zip(data)
    return open_zip(z.read(head)).read(tail) if tail else z.read(name)
