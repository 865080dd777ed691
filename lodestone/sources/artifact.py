"""Artifacts as tables.

`Artifacts(spark, path)` reads files with Spark's own binary reader (so any store that Spark reads
will do) and cuts the containers once into one row per image, still packed.  Each table is decoded from
those rows in parallel, one image at a time, and only the columns asked for: an image is inflated as
far as they need.  `ArtifactSource` is the same behind `spark.read.format("artifact").option("table",
...)` for paths that Python can open; it plans one partition per image from the directories of the
archives, and a task reads the bytes of its own entry.

An image gives all its rows of a table or none: what does not decode to its end is listed by
`failures`, with the reason, and no error of a decoder ends a query.
"""

from __future__ import annotations

import io
import json
import os
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.names import any_label
from ..operators.rounds import settled
from . import archive, axml, walk
from .archive import Place
from .dex import NO_INDEX, CorruptImage, Image, decode_all, md5, operands, sound
from .schema import arrow_schema, chosen

SCHEMAS: dict[str, str] = {
    "images": "image_seq int, label string, entry string, dex_version string, classes long, methods long, fields long, strings long, size_bytes long, md5 string",
    "strings": "image_seq int, string_idx int, value string",
    "types": "image_seq int, type_idx int, descriptor string",
    "protos": "image_seq int, proto_idx int, return_type string, params array<string>, descriptor string",
    "field_ids": "image_seq int, field_idx int, class string, name string, type string",
    "method_ids": "image_seq int, method_idx int, class string, name string, proto string",
    "class_defs": "image_seq int, class_seq int, class string, access int, super string, interfaces array<string>, source_file string",
    "encoded_fields": "image_seq int, class_seq int, field_idx int, is_static boolean, access int",
    "encoded_methods": "image_seq int, class_seq int, method_seq int, method_idx int, access int, code_off int, insns_size int, registers int, ins int, outs int",
    "tries": "image_seq int, class_seq int, method_seq int, start_addr int, insn_count int, catches array<struct<type: string, addr: int>>, catch_all int",
    "instructions": "image_seq int, class_seq int, method_seq int, pc int, op int, mnemonic string, size int, ref_kind string, ref_idx int, operands string",
    "refs": "image_seq int, class_seq int, method_seq int, pc int, op int, mnemonic string, ref_kind string, ref_idx int",
    "payloads": "image_seq int, class_seq int, method_seq int, pc int, kind string, first_key int, keys array<int>, targets array<int>, elem_width int, data binary",
    "blocks": "image_seq int, class_seq int, method_seq int, start_pc int, end_pc int, successors array<int>",
    "annotations": "image_seq int, class_seq int, visibility int, type string, elements string",
    "static_values": "image_seq int, class_seq int, ord int, value string",
    "method_handles": "image_seq int, handle_idx int, kind int, target string",
    "call_sites": "image_seq int, site_idx int, arguments string",
    "debug_locals": "image_seq int, class_seq int, method_seq int, reg int, start int, end int, name string, type string",
    "archive_entries": "container string, name string, method string, compressed_size long",
    "manifest_elements": "input string, line int, depth int, nr int, parent int, element string, attrs map<string,string>",
    "resources": "input string, pkg int, type int, entry int, value string",
}
FILE_TABLES = ("archive_entries", "manifest_elements", "resources")


#: Tables that read most of an image.
DEEP = ("instructions", "refs", "payloads", "blocks", "tries", "debug_locals")


# ---------------------------------------------------------------- one image
def _inner(t: str) -> str:
    return t[1:-1] if t.startswith("L") else t


def id_columns(table: str, img: Image, label: str, entry: str) -> tuple[int, dict[str, Callable]] | None:
    """Rows and columns of a table of ids; a column that is not called reads nothing."""
    n = img.counts
    each = lambda name, f: lambda: [f(i) for i in range(n[name])]
    rows = lambda name: lambda: range(n[name])
    match table:
        case "images":
            one = {"label": label, "entry": entry, "dex_version": img.version, "classes": n["classes"], "methods": n["methods"], "fields": n["fields"], "strings": n["strings"], "size_bytes": len(img.data)}
            return 1, {k: (lambda v=v: [v]) for k, v in one.items()} | {"md5": lambda: [md5(img.whole())]}
        case "strings":
            return n["strings"], {"string_idx": rows("strings"), "value": each("strings", img.string)}
        case "types":
            return n["types"], {"type_idx": rows("types"), "descriptor": each("types", img.type)}
        case "protos":
            return n["protos"], {"proto_idx": rows("protos"), "return_type": each("protos", lambda i: img.type(int(img.proto_ids[i, 1]))), "params": each("protos", lambda i: img.proto(i)[1]), "descriptor": each("protos", img.proto_descriptor)}
        case "field_ids":
            ids = lambda k: lambda: img.field_ids[:, k].tolist()
            return n["fields"], {"field_idx": rows("fields"), "class": lambda: [_inner(img.type(i)) for i in ids(0)()], "type": lambda: [img.type(i) for i in ids(1)()], "name": lambda: [img.string(i) for i in ids(2)()]}
        case "method_ids":
            ids = lambda k: lambda: img.method_ids[:, k].tolist()
            return n["methods"], {"method_idx": rows("methods"), "class": lambda: [_inner(img.type(i)) for i in ids(0)()], "proto": lambda: [img.proto_descriptor(i) for i in ids(1)()], "name": lambda: [img.string(i) for i in ids(2)()]}
        case "class_defs":
            col = lambda k: img.class_defs[:, k].tolist()
            return n["classes"], {
                "class_seq": rows("classes"), "class": lambda: [img.internal(i) for i in col(0)], "access": lambda: col(1),
                "super": lambda: [None if i == NO_INDEX else img.internal(i) for i in col(2)],
                "interfaces": lambda: [[t[1:-1] for t in img.type_list(off)] for off in col(3)],
                "source_file": lambda: [None if i == NO_INDEX else img.string(i) for i in col(4)],
            }
    return None


def method_columns(img: Image) -> tuple[int, dict[str, Callable]]:
    """Of encoded_methods: the lists of the classes, and the heads of the code only if they are asked for."""
    rows = [(k, *m) for k in range(len(img.class_defs)) for m in img.methods_of(k)]
    cols = {c: (lambda i=i: [r[i] for r in rows]) for i, c in enumerate(("class_seq", "method_seq", "method_idx", "access", "code_off"))}

    def head(i: int) -> Callable:
        return lambda: [img.code_head(r[4])[i] if r[4] else 0 for r in rows]

    return len(rows), cols | {"registers": head(0), "ins": head(1), "outs": head(2), "insns_size": head(5)}


def decoded(table: str, seq: int, label: str, entry: str, data, schema: pa.Schema) -> list[pa.RecordBatch]:
    """All rows of one image with the columns in schema, or CorruptImage."""
    with sound():
        img = Image(data)
        if table in DEEP:
            img.whole()
        if got := id_columns(table, img, label, entry):
            n, columns = got
        elif table == "encoded_methods":
            n, columns = method_columns(img)
        elif table == "refs":
            columns = {k: (lambda v=v: v) for k, v in walk.references(img).items()}
            n = len(columns["pc"]())
        else:
            return list(batches(image_rows(table, seq, img), schema, arrow(table)))
        cols = {"image_seq": lambda: np.full(n, seq)} | columns
        whole = pa.RecordBatch.from_arrays([pa.array(cols[f.name](), f.type) for f in schema], schema=schema)
        return [whole.slice(i, BATCH) for i in range(0, n, BATCH)]


def image_rows(table: str, seq: int, img: Image) -> Iterator[tuple]:
    match table:
        case "method_handles":
            count, off = img.map_items().get(0x0008, (0, 0))
            for i in range(count):
                kind, _, idx, _ = img._unpack("<4H", off + 8 * i)
                yield seq, i, kind, img.reference("field" if kind < 4 else "method", idx)
        case "call_sites":
            count, off = img.map_items().get(0x0007, (0, 0))
            for i in range(count):
                (at,) = img._unpack("<I", off + 4 * i)
                yield seq, i, json.dumps(img.array(at)[0], default=str)
        case _:
            yield from _class_rows(table, seq, img)


def _class_rows(table: str, seq: int, img: Image) -> Iterator[tuple]:
    for k, row in enumerate(img.class_defs.tolist()):
        if table == "annotations":
            yield from ((seq, k, vis, t, json.dumps(e, default=str)) for vis, t, e in img.class_annotations(k))
            continue
        if table == "static_values":
            if row[7]:
                yield from ((seq, k, i, json.dumps(v, default=str)) for i, v in enumerate(img.array(row[7])[0]))
            continue
        fields, methods = img.class_data(row[6])
        if table == "encoded_fields":
            yield from ((seq, k, idx, static, access) for idx, access, static in fields)
            continue
        for m, (idx, access, off) in enumerate(methods):
            code = img.code(off)
            if code is None:
                continue
            if table == "tries":
                yield from ((seq, k, m, t["start_addr"], t["insn_count"], t["catches"], t["catch_all"]) for t in code["tries"])
            elif table == "debug_locals":
                yield from ((seq, k, m, x["reg"], x["start"], x["end"], x["name"], x["type"]) for x in img.debug(code["debug"], code["registers"])[1])
            elif table == "instructions":
                yield from ((seq, k, m, i.pc, i.op, i.mnemonic, i.size, i.ref_kind, i.ref_idx, operands(img, i)) for i in decode_all(code["units"]))
            elif table == "payloads":
                for i in decode_all(code["units"]):
                    if p := i.payload:
                        if p[0] == "packed-switch":
                            yield seq, k, m, i.pc, p[0], p[1], None, p[2], None, None
                        elif p[0] == "sparse-switch":
                            yield seq, k, m, i.pc, p[0], None, p[1], p[2], None, None
                        else:
                            yield seq, k, m, i.pc, p[0], None, None, None, p[1], p[2]
            elif table == "blocks":
                yield from ((seq, k, m, a, b, s) for a, b, s in blocks(code))


def blocks(code: dict) -> list[tuple[int, int, list[int]]]:
    """Basic blocks of a method: first pc, pc after the last, successors (branches, switches and handlers)."""
    ins = list(decode_all(code["units"]))
    by_pc = {i.pc: i for i in ins}
    jumps: dict[int, list[int]] = {}
    heads, ends = {0}, set()
    for i in ins:
        if i.payload:
            continue
        out: list[int] = []
        if i.mnemonic.endswith("-switch"):
            load = by_pc.get(i.target)
            out = [i.pc + t for t in load.payload[2]] + [i.pc + i.size] if load and load.payload else [i.pc + i.size]
        elif i.mnemonic.startswith("goto"):
            out = [i.target]
        elif i.mnemonic.startswith("if-"):
            out = [i.target, i.pc + i.size]
        elif not i.mnemonic.startswith(("return", "throw")):
            continue
        jumps[i.pc] = out
        ends.add(i.pc)
        heads.update(out, {i.pc + i.size})
    for t in code["tries"]:
        heads.update({t["start_addr"], t["start_addr"] + t["insn_count"], *(c["addr"] for c in t["catches"])}, {t["catch_all"]} - {None})
    out, start, last = [], None, None
    for i in [x for x in ins if not x.payload]:
        if start is not None and i.pc in heads:
            out.append((start, last))
            start = None
        start = i.pc if start is None else start
        last = i
        if i.pc in ends:
            out.append((start, last))
            start = None
    if start is not None:
        out.append((start, last))
    rows = []
    for a, z in out:
        end = z.pc + z.size
        succ = list(jumps[z.pc]) if z.pc in jumps else [end] if end in by_pc and not by_pc[end].payload else []
        for t in code["tries"]:
            if t["start_addr"] <= a < t["start_addr"] + t["insn_count"]:
                succ += [c["addr"] for c in t["catches"]] + ([t["catch_all"]] if t["catch_all"] is not None else [])
        rows.append((a, end, list(dict.fromkeys(succ))))
    return rows


def file_rows(table: str, path: str, data: bytes) -> Iterator[tuple]:
    name = path.rsplit("/", 1)[-1]
    if table == "archive_entries":
        yield from archive.entries(path, data)
    elif table == "manifest_elements":
        raw = data if data[:2] == b"\x03\x00" else archive.member(path, data, "AndroidManifest.xml")
        if raw:
            stack: list[int] = []
            nr = 0
            for e in axml.elements(raw):
                if isinstance(e, str):
                    continue
                if e is None:
                    stack.pop()
                    continue
                yield name, e.line, e.depth, nr, stack[-1] if stack else None, e.element, e.attrs
                stack.append(nr)
                nr += 1
    elif table == "resources":
        raw = archive.member(path, data, "resources.arsc")
        if raw:
            yield from ((name, *r) for r in axml.string_resources(raw))


BATCH = 5000


def batches(rows: Iterator[tuple], schema: pa.Schema, full: pa.Schema | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of the schema full (by default schema) as batches of the columns in schema."""
    names = (full or schema).names
    picked = [names.index(f.name) for f in schema]
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) >= BATCH:
            yield _batch(held, schema, picked)
            held = []
    if held:
        yield _batch(held, schema, picked)


def _batch(rows: list[tuple], schema: pa.Schema, picked: list[int]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    plain = lambda c, f: [list(v.items()) if isinstance(v, dict) else v for v in c] if pa.types.is_map(f.type) else c
    return pa.RecordBatch.from_arrays([pa.array(plain(cols[i], f), f.type) for i, f in zip(picked, schema, strict=True)], schema=schema)


def arrow(table: str, columns: list[str] | None = None) -> pa.Schema:
    return arrow_schema(chosen(SCHEMAS[table], columns))


# ---------------------------------------------------------------- over Spark
IMAGE = "image_seq int, label string, entry string, size long, deflated boolean, data binary"
FOUND = "path string, k int, label string, entry string, size long, deflated boolean, data binary, reason string"
IMAGE_TABLES = tuple(t for t in SCHEMAS if t not in FILE_TABLES)
FEW_NAMES = 200_000


def cut_file(path: str, content: bytes) -> Iterator[tuple]:
    """Rows of FOUND of one file: its images, still packed; or one row with the reason why there are none."""
    try:
        with sound():
            file = io.BytesIO(content)
            rows = []
            for k, p in enumerate(archive.plan(path, file)):
                rows.append((path, k, p.label, p.entry, p.size, p.deflated, archive.packed(p, file), None))
    except CorruptImage as e:
        rows = [(path, 0, archive.stem(path), path.rsplit("/", 1)[-1], None, None, None, str(e))]
    yield from rows


def verified(data, label: str, entry: str, tables: tuple[str, ...] = IMAGE_TABLES) -> str | None:
    """Why an image does not decode, table by table; None if it does."""
    for t in tables:
        try:
            decoded(t, 0, label, entry, data, arrow(t))
        except CorruptImage as e:
            return f"{t}: {e}"
    return None


def rows_of(b: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """The rows of a batch one after another, so that no two images are held as Python bytes."""
    for i in range(b.num_rows):
        yield tuple(b.column(n)[i].as_py() for n in names)


class Artifacts:
    """The tables of all inputs below a path.  dex: only images whose label has one of these texts.
    whole: an image that does not decode in every table gives rows in none."""

    def __init__(self, spark: SparkSession, path: str, dex: list[str] | None = None, whole: bool = False):
        self.spark, self.path, self.dex, self.whole = spark, path, dex or [], whole
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        ext = F.lower(F.substring_index("path", ".", -1))
        self.files = files.where(ext.isin(*archive.EXTENSIONS, "axml", "xml")).select("path", "content")
        self._found: DataFrame | None = None
        self._ranked: DataFrame | None = None
        self._bad: DataFrame | None = None

    def found(self) -> DataFrame:
        """FOUND of all files: containers are read once; all tables are decoded from this copy."""
        if self._found is None:

            def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                schema = arrow_schema(FOUND)
                for b in it:
                    for path, content in rows_of(b, "path", "content"):
                        for r in cut_file(path, content):
                            yield _batch([r], schema, list(range(len(schema))))

            self._found = settled(self.files.mapInArrow(run, FOUND))
        return self._found

    def ranked(self) -> DataFrame:
        """IMAGE: one row per image that dex lets through, still packed.  Ranks are taken over names only."""
        if self._ranked is None:
            found = self.found().where("reason is null")
            part = settled(found.select("path", "k", "label").repartitionByRange("path", "k").withColumn("p", F.spark_partition_id()))
            inside = F.row_number().over(Window.partitionBy("p").orderBy("path", "k")) - 1
            before = F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            starts = part.groupBy("p").agg(F.count("*").alias("n")).select("p", before.alias("before"))  # one row a partition of names
            rank = part.withColumn("inside", inside).join(starts, "p").where(any_label(F.col("label"), self.dex))
            rank = rank.select("path", "k", (F.col("inside") + F.col("before")).cast("int").alias("image_seq"))
            few = rank.count() <= FEW_NAMES  # then the bytes stay where they are
            self._ranked = found.join(F.broadcast(rank) if few else rank, ["path", "k"]).select(*arrow_schema(IMAGE).names)
        return self._ranked

    def images_raw(self) -> DataFrame:
        """ranked(), without the images that do not decode if whole is asked for."""
        if not self.whole:
            return self.ranked()
        if self._bad is None:
            self._bad = settled(self._failed(self.ranked(), IMAGE_TABLES).select("image_seq"))
        bad = F.broadcast(self._bad) if self._bad.count() <= FEW_NAMES else self._bad
        return self.ranked().join(bad, "image_seq", "left_anti")

    def table(self, name: str, columns: list[str] | None = None, images: DataFrame | None = None) -> DataFrame:
        """A table, or those of its columns that are named: no more of an image is inflated than they need.
        images(image_seq): of these alone; they are counted, so a table of its own is best."""
        kinds = chosen(SCHEMAS[name], columns)
        if name in FILE_TABLES:

            def of_files(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                schema = arrow(name, columns)
                for b in it:
                    for path, content in rows_of(b, "path", "content"):
                        try:
                            with sound():
                                got = list(batches(file_rows(name, path, content), schema, arrow(name)))
                        except CorruptImage:
                            continue  # it shows in failures()
                        yield from got

            return self.files.mapInArrow(of_files, kinds)

        def of_images(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            schema = arrow(name, columns)
            for b in it:
                for seq, label, entry, size, deflated, data in rows_of(b, "image_seq", "label", "entry", "size", "deflated", "data"):
                    try:
                        got = decoded(name, seq, label, entry, archive.opened(data, size, deflated), schema)
                    except CorruptImage:
                        continue  # it shows in failures()
                    yield from got

        src = self.images_raw()
        if images is not None:
            some = images.select("image_seq").distinct()
            src = src.join(F.broadcast(some) if some.count() <= FEW_NAMES else some, "image_seq", "left_semi")
        return src.mapInArrow(of_images, kinds)

    @staticmethod
    def _failed(images: DataFrame, tables: tuple[str, ...]) -> DataFrame:
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            schema = arrow_schema("image_seq int, label string, entry string, reason string")
            for b in it:
                for seq, label, entry, size, deflated, data in rows_of(b, "image_seq", "label", "entry", "size", "deflated", "data"):
                    if why := verified(archive.opened(data, size, deflated), label, entry, tables):
                        yield _batch([(seq, label, entry, why)], schema, [0, 1, 2, 3])

        return images.mapInArrow(run, "image_seq int, label string, entry string, reason string")

    def failures(self, *tables: str) -> DataFrame:
        """image_seq, label, entry, reason: images that do not decode in one of the tables (by default in any),
        and, without image_seq, files that cannot be taken apart or whose manifest or resources cannot be read."""
        of_files = tuple(t for t in tables or FILE_TABLES if t in FILE_TABLES)

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            schema = arrow_schema("image_seq int, label string, entry string, reason string")
            for b in it:
                for path, content in rows_of(b, "path", "content"):
                    t = None
                    try:
                        with sound():
                            for _ in archive.plan(path, io.BytesIO(content)):
                                pass
                            for t in of_files:
                                list(file_rows(t, path, content))
                    except CorruptImage as e:
                        if t:  # what cannot be taken apart is in found()
                            yield _batch([(None, archive.stem(path), path.rsplit("/", 1)[-1], f"{t}: {e}")], schema, [0, 1, 2, 3])

        out = self._failed(self.ranked(), tuple(t for t in tables or IMAGE_TABLES if t not in FILE_TABLES))
        out = out.unionByName(self.found().where("reason is not null").select(F.lit(None).cast("int").alias("image_seq"), "label", "entry", "reason"))
        return out.unionByName(self.files.mapInArrow(run, "image_seq int, label string, entry string, reason string")) if of_files else out

    def views(self) -> None:
        for name in SCHEMAS:
            self.table(name).createOrReplaceTempView(name)

    def save(self, path: str, tables: list[str] | None = None) -> None:
        """Parquet copies, partitioned by image: later queries prune images and columns."""
        for name in tables or list(SCHEMAS):
            w = self.table(name).write.mode("overwrite")
            (w if name in FILE_TABLES else w.partitionBy("image_seq")).parquet(f"{path}/{name}")


# ---------------------------------------------------------------- the data source
class _Part(InputPartition):
    """A file, or the images of it that one task reads: a place each, with its rank."""

    def __init__(self, path: str, places: list[tuple[int, Place]]):
        self.path, self.places = path, places


class ArtifactSource(DataSource):
    """format("artifact").option("table", name): one partition per image (or file).

    Options: table; columns, a comma-separated choice (a schema given to the reader is one too); dex,
    comma-separated texts of which a label must have one."""

    @classmethod
    def name(cls) -> str:
        return "artifact"

    def schema(self) -> str:
        names = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        return chosen(SCHEMAS[self.options.get("table", "images")], names or None)

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options, schema.names)


class _Reader(DataSourceReader):
    def __init__(self, options, columns: list[str]):
        self.table, self.path = options.get("table", "images"), options["path"]
        self.dex = [p.lower() for p in options.get("dex", "").split(",") if p]
        self.columns = columns

    def paths(self) -> list[str]:
        if os.path.isfile(self.path):
            return [self.path]
        if not os.path.isdir(self.path):
            raise FileNotFoundError(self.path)
        got = sorted(os.path.join(d, f) for d, _, fs in os.walk(self.path) for f in fs if f.lower().rsplit(".", 1)[-1] in (*archive.EXTENSIONS, "axml"))
        if not got:
            raise FileNotFoundError(f"no artifact below {self.path}")
        return got

    def partitions(self):
        """From directories alone; the images of a packed package go to one task, which inflates it once."""
        parts, seq = [], 0
        for path in self.paths():
            if self.table in FILE_TABLES:
                parts.append(_Part(path, []))
                continue
            places = []
            try:
                with sound(), open(path, "rb") as f:
                    places = list(archive.plan(path, f))
            except CorruptImage:
                pass  # Artifacts.failures lists it
            ranked = list(enumerate(places, seq))
            seq += len(places)
            ranked = [(k, p) for k, p in ranked if not self.dex or any(d in p.label.lower() for d in self.dex)]
            shared = lambda x: (x[1].within.begin,) if x[1].within and x[1].within.deflated else (x[0], x[0])
            parts += [_Part(path, list(g)) for _, g in groupby(ranked, key=shared)]
        return parts

    def read(self, part: _Part):
        schema = arrow(self.table, self.columns)
        with open(part.path, "rb") as f:
            if self.table in FILE_TABLES:
                try:
                    with sound():
                        got = list(batches(file_rows(self.table, part.path, f.read()), schema, arrow(self.table)))
                except CorruptImage:
                    return
                yield from got
                return
            inner = outer = None
            for seq, p in part.places:
                try:
                    with sound():
                        if p.within and p.within.deflated:
                            if outer != p.within:
                                inner, outer = io.BytesIO(archive.opened(archive.packed(p.within, f), p.within.size, True).whole()), p.within
                            data = archive.packed(archive.replace(p, within=None), inner)
                        else:
                            data = archive.packed(p, f)
                    got = decoded(self.table, seq, p.label, p.entry, archive.opened(data, p.size, p.deflated), schema)
                except CorruptImage:
                    continue
                yield from got
