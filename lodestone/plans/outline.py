"""Source outlines: declarations of a class in source syntax, method bodies as listings."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.names import java_identifier, java_type
from ..sources.archive import opened
from ..sources.artifact import rows_of
from ..sources.dex import NO_INDEX, CorruptImage, Image, decode_all, operands, sound

# Fixed values of the public format.
FLAGS = ((0x1, "public"), (0x2, "private"), (0x4, "protected"), (0x8, "static"), (0x10, "final"), (0x400, "abstract"))
METHOD_FLAGS = (*FLAGS, (0x20, "synchronized"), (0x100, "native"), (0x800, "strictfp"))
FIELD_FLAGS = (*FLAGS, (0x40, "volatile"), (0x80, "transient"))


def words(access: int, flags) -> str:
    return "".join(f"{w} " for bit, w in flags if access & bit)


def literal(v: object, descriptor: str) -> str:
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, str) and descriptor == "Ljava/lang/String;":
        return '"' + v.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'
    if v is None:
        return "null"
    return f"{v}L" if descriptor == "J" else f"{v}f" if descriptor == "F" else str(v)


def method_text(img: Image, idx: int, access: int, off: int, own: str, listing: bool = True) -> str:
    _, name, _ = img.method(idx)
    ret, params = img.proto(int(img.method_ids[idx, 1]))
    code = img.code(off)
    names = img.debug(code["debug"], code["registers"])[0] if code else []
    args = ", ".join(f"{java_type(t)} {(names[i] if i < len(names) and names[i] else f'p{i}')}" for i, t in enumerate(params))
    if name == "<clinit>":
        head = "static"
    elif name == "<init>":
        head = f"{words(access, METHOD_FLAGS)}{own}({args})"
    else:
        head = f"{words(access, METHOD_FLAGS)}{java_type(ret)} {java_identifier(name)}({args})"
    if code is None:
        return f"    {head};\n"
    body = "".join(f"        // {2 * i.pc:04x}: {i.mnemonic} {operands(img, i)}".rstrip() + "\n" for i in decode_all(code["units"])) if listing else ""
    return f"    {head} {{\n{body}    }}\n"


def class_text(img: Image, seq: int, only: str | None = None, own: str | None = None) -> str:
    """A class as text; own: how it is called in it (its own name, made safe)."""
    row = img.class_defs[seq].tolist()
    cls, access = img.internal(row[0]), row[1]
    own = own or java_identifier(cls.rsplit("/", 1)[-1])
    fields, methods = img.class_data(row[6])
    parts = []
    for idx, acc, off in methods:
        _, name, desc = img.method(idx)
        if only is None or (name + desc == only if "(" in only else name == only):
            parts.append(method_text(img, idx, acc, off, own))
    if only is not None:
        return "\n".join(parts)
    package = cls.rpartition("/")[0]
    kind = "@interface" if access & 0x2000 else "interface" if access & 0x200 else "enum" if access & 0x4000 else "class"
    shown = words(access & ~0x400 if access & 0x200 else access, FLAGS)
    sup = None if row[2] == NO_INDEX else img.internal(row[2])
    head = f"{shown}{kind} {own}"
    if sup and sup != "java/lang/Object" and kind == "class":
        head += f" extends {sup.replace('/', '.')}"
    faces = [t[1:-1].replace("/", ".") for t in img.type_list(row[3])]
    if faces and kind != "@interface":
        head += f" {'extends' if kind == 'interface' else 'implements'} {', '.join(faces)}"
    values = img.array(row[7])[0] if row[7] else []
    lines, static = [], 0
    for idx, acc, is_static in fields:
        _, name, t = img.field(idx)
        init = ""
        if is_static:
            if static < len(values):
                init = f" = {literal(values[static], t)}"
            static += 1
        lines.append(f"    {words(acc, FIELD_FLAGS)}{java_type(t)} {java_identifier(name)}{init};\n")
    top = f"package {package.replace('/', '.')};\n\n" if package else ""
    return f"{top}{head} {{\n{''.join(lines)}{chr(10) if lines and parts else ''}{chr(10).join(parts)}}}\n"


def outlines(images: DataFrame, names: list[str] | None, method: str | None, package: str | None = None, own: str | None = None) -> DataFrame:
    """class, source of the named classes, or of all below a package; the first definition wins.
    own: what stands for the simple name of a class in its source."""
    from pyspark.sql import functions as F

    wanted = set(names or [])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for seq, data, size, deflated in rows_of(b, "image_seq", "data", "size", "deflated"):
                rows = []
                try:
                    with sound():
                        img = Image(opened(data, size, deflated))
                        for k in range(len(img.class_defs)):
                            cls = img.internal(int(img.class_defs[k, 0]))
                            if cls in wanted if names is not None else (not package or cls.startswith(package + "/")):
                                img.whole()
                                rows.append((seq, cls, class_text(img, k, method, own)))
                except CorruptImage:
                    continue  # Artifacts.failures lists it
                if rows:
                    seqs, classes, sources = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(seqs, pa.int32()), pa.array(classes), pa.array(sources)], ["image_seq", "class", "source"])

    got = images.mapInArrow(run, "image_seq int, class string, source string")
    return got.groupBy("class").agg(F.min_by("source", "image_seq").alias("source"))
