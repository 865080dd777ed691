"""The reader: what it inflates, what it plans from, what damage does to it."""

import io
import random
import struct
import zipfile
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lodestone.plans.commands import Session
from lodestone.sources import archive, dex, walk
from lodestone.sources.artifact import DEEP, FILE_TABLES, SCHEMAS, ArtifactSource, Artifacts, _Reader, arrow, decoded, verified
from lodestone.sources.schema import chosen, fields
from lodestone.streaming.ingest import failed, ingest, ingested

from . import dexkit as K
from .test_artifacts import zipped

TABLES = [t for t in SCHEMAS if t not in FILE_TABLES]


def large(classes=40, units=3000, strings_first=True, seed=1):
    """Code that does not pack well, behind the strings."""
    r = random.Random(seed)
    make = lambda d: [x for _ in range(units) for x in (0x14 | r.randrange(256) << 8, r.randrange(65536), r.randrange(65536))] + [0x0E]
    return K.Dex([{"name": f"Lp/C{i};", "super": K.O, "interfaces": ("Lp/I;",), "source": f"C{i}.java", "fields": [("f", "I", 1, False)], "methods": [("run", (K.S,), "V", 1, (2, 1, 0, make))]} for i in range(classes)]).build(strings_first)


def deflated(data):
    c = zlib.compressobj(9, zlib.DEFLATED, -15)
    return c.compress(data) + c.flush()


# ---------------------------------------------------------------- only what is asked for
def test_inflated_as_far_as_the_columns_need():
    data = large()
    packed = deflated(data)

    def inflated(table, *columns):
        src = dex.Inflating(packed, len(data))
        got = decoded(table, 3, "l", "e", src, arrow(table, list(columns) or None))
        want = decoded(table, 3, "l", "e", data, arrow(table, list(columns) or None))
        assert [b.to_pylist() for b in got] == [b.to_pylist() for b in want]
        return src.inflated

    assert inflated("images", "image_seq", "label", "classes", "size_bytes") <= 0x80
    assert inflated("images") == len(data)  # the digest
    names = inflated("class_defs", "class")
    assert 0x70 < names < len(data) / 20
    assert inflated("class_defs", "class_seq") < names
    for t in ("strings", "types", "protos", "field_ids", "method_ids", "class_defs"):
        assert inflated(t) < len(data) / 10, t
    assert inflated("encoded_methods", "method_idx") == len(data) or inflated("encoded_methods", "method_idx") > names
    for t in DEEP:
        assert inflated(t) == len(data)


@given(st.binary(max_size=3000), st.lists(st.integers(0, 3100), max_size=8), st.integers(1, 700))
def test_inflating_reads_like_bytes(data, places, step):
    src = dex.Inflating(deflated(data), len(data))
    src.STEP = step
    assert len(src) == len(data)
    for p in places:
        assert src[p : p + 9] == data[p : p + 9]
        if p < len(data):
            assert src[p] == data[p]
            found = data.find(b"\0", p)
            if found >= 0:
                assert src.index(b"\0", p) == found
    assert src.whole() == data and src.inflated == len(data)
    with pytest.raises(dex.CorruptImage):
        dex.Inflating(deflated(data)[:-1], len(data) + 1).whole()


def test_chosen_columns_of_every_table(spark, tmp_path):
    (tmp_path / "a.apk").write_bytes(zipped([("classes.dex", large(5, 5)), ("classes2.dex", K.hello().build())]))
    spark.dataSource.register(ArtifactSource)
    a = Artifacts(spark, str(tmp_path))
    for t in ("images", "class_defs", "method_ids", "encoded_methods", "refs", "static_values"):
        names = list(fields(SCHEMAS[t]))[::-2]
        want = sorted(map(str, a.table(t).select(*names).collect()))
        assert sorted(map(str, a.table(t, names).collect())) == want
        got = spark.read.format("artifact").option("table", t).option("columns", ",".join(names)).load(str(tmp_path))
        assert got.columns == names and sorted(map(str, got.collect())) == want
        assert sorted(map(str, spark.read.format("artifact").schema(chosen(SCHEMAS[t], names)).option("table", t).load(str(tmp_path)).collect())) == want
    with pytest.raises(ValueError, match="no column nope"):
        a.table("images", ["nope"])


# ---------------------------------------------------------------- planning
class Counted(io.BytesIO):
    def __init__(self, data):
        super().__init__(data)
        self.got = 0

    def read(self, n=-1):
        out = super().read(n)
        self.got += len(out)
        return out


def test_plans_from_directories(monkeypatch):
    img = large(3, 4000)
    apk = zipped([(f"classes{i or ''}.dex", img) for i in range(2, 4)] + [("classes.dex", img), ("big.bin", bytes(200_000))])
    inner = zipped([("base.apk", apk), ("split.apk", apk)], zipfile.ZIP_STORED)
    for data, n in ((apk, 3), (inner, 6)):
        f = Counted(data)
        with monkeypatch.context() as m:
            m.setattr(zlib, "decompressobj", None)
            places = list(archive.plan("x/app.apk", f))
        assert len(places) == n and f.got < 3000 < len(data)
        assert [p.entry for p in places[:3]] == ["classes.dex", "classes2.dex", "classes3.dex"]
        for p in places:
            f = Counted(data)
            assert bytes(archive.opened(archive.packed(p, f), p.size, p.deflated)[:]) == img
            assert f.got < p.packed + 100  # its own bytes and two local headers
    packed = zipped([("base.apk", apk)])
    p = list(archive.plan("c.xapk", io.BytesIO(packed)))
    assert [x.label for x in p] == [f"c!base.apk!classes{k}.dex" for k in ("", 2, 3)]
    assert all(archive.opened(archive.packed(x, io.BytesIO(packed)), x.size, x.deflated)[:] == img for x in p)


def test_partitions_read_their_entry_once(tmp_path, monkeypatch):
    img = large(3, 2000)
    apk = zipped([("classes.dex", img), ("classes2.dex", img)])
    (tmp_path / "a.apk").write_bytes(apk)
    (tmp_path / "b.xapk").write_bytes(zipped([("base.apk", apk), ("config.apk", zipped([("classes.dex", img)]))]))
    (tmp_path / "broken.apk").write_bytes(apk[:-30])
    reader = _Reader({"path": str(tmp_path), "table": "class_defs"}, ["image_seq", "class"])
    parts = reader.partitions()
    assert [[k for k, _ in p.places] for p in parts] == [[0], [1], [2, 3], [4]]
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert len(rows) == 5 * 3 and {r["image_seq"] for r in rows} == set(range(5))
    only = _Reader({"path": str(tmp_path), "table": "class_defs", "dex": "CLASSES2,config"}, ["class"]).partitions()
    assert [[k for k, _ in p.places] for p in only] == [[1], [3], [4]]
    opened = []
    monkeypatch.setattr(archive, "packed", lambda p, f, real=archive.packed: opened.append(p.label) or real(p, f))
    for p in parts:
        list(reader.read(p))
    assert opened == ["a!classes.dex", "a!classes2.dex", "b!base.apk", "b!base.apk!classes.dex", "b!base.apk!classes2.dex", "b!config.apk", "b!config.apk!classes.dex"]


# ---------------------------------------------------------------- the boundary walker
def instruction(r):
    op = r.choice([o for o in dex.OPCODES if o])
    return [op | r.randrange(256) << 8, *(r.randrange(65536) for _ in range(dex.SIZES[op] - 1))]


def payload(r):
    n = r.randrange(5)
    some = lambda k: [r.randrange(65536) for _ in range(k)]
    kind = r.randrange(3)
    if kind == 0:
        return [0x0100, n, *some(2), *some(2 * n)]
    if kind == 1:
        return [0x0200, n, *some(4 * n)]
    width = r.choice([1, 2, 4, 8])
    return [0x0300, width, n, 0, *some((n * width + 1) // 2)]


def method(r, n):
    return [x for _ in range(n) for x in (payload(r) if r.random() < 0.2 else [0] if r.random() < 0.1 else instruction(r))]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**9))
def test_walker_equals_the_decoder(seed):
    r = random.Random(seed)
    methods = [method(r, r.choice([0, 1, 2, 5, 90])) for _ in range(r.randrange(1, 8))]
    u = np.array([x for m in methods for x in m], np.int64)
    first = np.cumsum([0, *map(len, methods)])
    want = [first[k] + i.pc for k, m in enumerate(methods) for i in dex.decode_all(np.array(m, np.uint16))]
    assert walk.boundaries(u, first).tolist() == want
    if len(u) and r.random() < 0.5 and methods[-1]:  # cut short: both fail, or both end there
        cut = methods[-1][:-1]
        short = np.concatenate([u[: first[-2]], np.array(cut, np.int64)]), np.append(first[:-1], first[-1] - 1)
        try:
            plain = [i.pc for i in dex.decode_all(np.array(cut, np.uint16))]
        except (dex.CorruptImage, IndexError):
            with pytest.raises(dex.CorruptImage):
                walk.boundaries(*short)
        else:
            assert [x - first[-2] for x in walk.boundaries(*short).tolist() if x >= first[-2]] == plain


def test_refs_equal_the_instructions(spark, tmp_path):
    r = random.Random(4)
    some = [x for x in dex.OPCODES if dex.OPCODES[x][1].endswith((":method", ":field", ":type", ":string"))]

    def make(d):
        limit = {"method": len(d.m), "field": len(d.f), "type": len(d.t), "string": len(d.s)}
        out = []
        for _ in range(30):
            op = r.choice(some)
            idx = r.randrange(limit[dex.OPCODES[op][1].split(":")[1]])
            out += [op | r.randrange(16) << 8, idx, *([0] * (dex.SIZES[op] - 2))]
            out += payload(r) if r.random() < 0.2 else []
        return out

    classes = [{"name": f"Lq/C{i};", "super": K.O, "fields": [("f", "I", 1, False)], "methods": [(f"m{k}", (), "V", 1, (4, 1, 2, make) if k else None) for k in range(3)]} for i in range(20)]
    (tmp_path / "x.dex").write_bytes(K.Dex(classes).build())
    a = Artifacts(spark, str(tmp_path))
    cols = ["image_seq", "class_seq", "method_seq", "pc", "op", "mnemonic", "ref_kind", "ref_idx"]
    want = sorted(map(tuple, a.table("instructions").where("ref_kind is not null").select(*cols).collect()))
    assert len(want) == 20 * 2 * 30 and sorted(map(tuple, a.table("refs").select(*cols).collect())) == want


# ---------------------------------------------------------------- damage
def full(seed=0):
    """An image that uses every table: code with tries is not written by the kit, so blocks and payloads stand for it."""
    r = random.Random(seed)
    return K.Dex([{"name": "La/B;", "super": K.O, "interfaces": ("La/I;",), "fields": [("x", "I", 9, True), ("y", K.S, 1, False)], "statics": [3], "methods": [("run", (K.S, "I"), "V", 1, (3, 1, 1, lambda d: [0x1A, d.s["hey"], *K.invoke(0x6E, 0, 1), *payload(r), 0x0E])), ("go", (), "V", 1, (3, 1, 1, lambda d: [0x1A, d.s["hey"], 0x0E]))]}], extra_strings=("hey",)).build()


def test_any_flipped_byte_is_one_kind_of_error():
    good = full()
    assert verified(good, "l", "e") is None
    whole = {t: [b.to_pylist() for b in decoded(t, 0, "l", "e", good, arrow(t))] for t in TABLES}
    lost = 0
    for at in range(0x20, len(good)):
        for bit in (0x80, 0x01, 0xFF):
            bad = bytearray(good)
            bad[at] ^= bit
            why = verified(bytes(bad), "l", "e", ("class_defs", "encoded_methods", "refs", "instructions", "tries", "debug_locals", "static_values", "annotations", "method_ids"))  # raises nothing
            lost += why is not None
    assert lost > 300 and whole["refs"]


@pytest.fixture(scope="module")
def damaged(tmp_path_factory):
    """Sound images beside one whose last method runs over its end, a broken archive and a broken manifest."""
    d = tmp_path_factory.mktemp("damaged")
    good = full()
    bad = bytearray(good)
    at = good.rindex(struct.pack("<2I", 0, 3)) + 8  # the units of the last code item
    bad[at + 4 : at + 6] = struct.pack("<H", 0x18)  # five units long
    (d / "a.apk").write_bytes(zipped([("classes.dex", good), ("classes2.dex", bytes(bad)), ("classes3.dex", b"encrypted" * 30)]))
    (d / "b.dex").write_bytes(good)
    (d / "c.apk").write_bytes(zipped([("classes.dex", good)])[:-9])
    (d / "d.apk").write_bytes(zipped([("AndroidManifest.xml", K.manifest()[:-900]), ("classes.dex", good)]))
    (d / "e.dex").write_bytes(b"dex\n035\0" + b"\0" * 200)
    return d


def test_an_image_gives_all_its_rows_or_none(spark, damaged):
    a = Artifacts(spark, str(damaged))
    labels = {r.image_seq: r.label for r in a.ranked().select("image_seq", "label").collect()}
    per = lambda df: {labels[r.image_seq]: r["count"] for r in df.groupBy("image_seq").count().collect()}
    ins, good = per(a.table("instructions")), ["a!classes.dex", "b", "d!classes.dex"]
    assert sorted(ins) == good and len(set(ins.values())) == 1
    assert sorted(per(a.table("refs"))) == good and sorted(per(a.table("class_defs"))) == ["a!classes.dex", "a!classes2.dex", "b", "d!classes.dex"]
    bad = {r.label: r.reason for r in a.failures().collect()}
    assert sorted(bad) == ["a!classes2.dex", "a!classes3.dex", "c", "d", "e"] and a.failures().count() == 5
    assert bad["a!classes2.dex"].startswith("instructions: ") and bad["c"].startswith("BadZipFile")
    assert {r.label: r.reason.split(":")[0] for r in a.failures("manifest_elements").collect()} == {"d": "manifest_elements", "c": "BadZipFile"}
    assert a.table("manifest_elements").count() == 0 and a.table("archive_entries").count() == 5
    whole = Artifacts(spark, str(damaged), whole=True)
    for t in ("class_defs", "instructions", "images"):
        assert sorted(per(whole.table(t))) == good
    assert sorted(r.label for r in whole.failures().collect()) == sorted(bad)
    s = Session(spark, str(damaged))
    assert s.findrefs("string", "hey", full=True).count() == 6 and s.listclasses(full=True).count() == 1


def test_a_stream_goes_on_over_damage(spark, damaged, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for f in damaged.iterdir():
        (src / f.name).write_bytes(f.read_bytes())
    run = lambda: ingest(spark, str(src), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    run()
    assert sorted(r.label for r in ingested(spark, str(tmp_path / "out")).collect()) == ["a!classes.dex", "b", "d!classes.dex"]
    bad = failed(spark, str(tmp_path / "out"))
    assert sorted(r.label for r in bad.where("reason is not null").collect()) == ["a!classes2.dex", "a!classes3.dex", "c", "e"]
    (src / "late.dex").write_bytes(full(3))
    run()
    assert sorted(r.label for r in ingested(spark, str(tmp_path / "out")).collect()) == ["a!classes.dex", "b", "d!classes.dex", "late"] and bad.count() == 4
