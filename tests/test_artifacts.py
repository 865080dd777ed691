import io
import json
import zipfile

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from lodestone.plans.commands import BadQuery, NotFound, Session, View
from lodestone.plans import render
from lodestone.operators import page as W
from lodestone.sources import archive, axml, dex
from lodestone.sources.artifact import SCHEMAS, ArtifactSource, Artifacts
from lodestone.streaming.ingest import ingest

from . import dexkit as K


def zipped(entries, method=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for n, b in entries:
            z.writestr(n, b)
    return out.getvalue()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("in")
    img = K.hello().build()
    apk = zipped([("AndroidManifest.xml", K.manifest()), ("resources.arsc", K.arsc(["zero", "My App"])), ("assets/note.txt", b"hi"), ("classes2.dex", img), ("classes.dex", img), ("lib/x.so", b"123")])
    (d / "app.apk").write_bytes(apk)
    return d


@pytest.fixture(scope="module")
def one(tmp_path_factory):
    d = tmp_path_factory.mktemp("one")
    (d / "hello.dex").write_bytes(K.hello().build())
    return d


@given(st.integers(0, 2**28 - 1))
def test_uleb(n):
    assert dex.uleb128(K.uleb(n), 0)[0] == n


@given(st.text(alphabet=st.characters(exclude_categories=["Cs"])))
def test_mutf8_round_trip(s):
    assert dex.mutf8_decode(dex.mutf8_encode(s)) == s


def test_mutf8_lone_surrogate():
    assert dex.mutf8_decode(b"\xed\xa0\x80") == "�"
    assert dex.mutf8_decode(b"\xc0\x80") == "\0"


def test_sleb():
    assert [dex.sleb128(bytes([x]), 0)[0] for x in (0, 1, 0x7F, 0x3F, 0x40)] == [0, 1, -1, 63, -64]


def test_every_opcode_has_its_size():
    for op, (name, fmt) in dex.OPCODES.items():
        u = np.zeros(6, np.uint16)
        u[0] = op
        assert dex.decode_one(u, 0).size == int(fmt[0]), name
    assert dex.SIZES[0xFA] == dex.SIZES[0xFB] == 4


def test_payloads():
    u = np.array([0x0100, 2, 5, 0, 7, 0, 9, 0], np.uint16)
    assert dex.decode_one(u, 0).payload == ("packed-switch", 5, [7, 9])
    u = np.array([0x0200, 1, 5, 0, 7, 0], np.uint16)
    assert dex.decode_one(u, 0).payload == ("sparse-switch", [5], [7])
    u = np.array([0x0300, 1, 3, 0, 0x0201, 3], np.uint16)
    i = dex.decode_one(u, 0)
    assert i.payload == ("array-data", 1, b"\1\2\3") and i.size == 6


def test_corrupt_images():
    good = K.hello().build()
    for bad in (b"", good[:50], b"dex\n036\0" + good[8:], good[:0x100]):
        with pytest.raises(dex.CorruptImage):
            dex.Image(bad)


def test_image_tables(spark, one):
    a = Artifacts(spark, str(one))
    row = a.table("images").collect()[0]
    assert (row.label, row.dex_version, row.classes, row.methods, row.fields) == ("hello", "038", 2, 10, 3)
    assert {r["class"]: r.super for r in a.table("class_defs").collect()} == {"Greeter": "java/lang/Object", "Hello": "java/lang/Object"}
    values = {r.value for r in a.table("strings").collect()}
    assert {"hi ", "a\0b", "\U0001f600"} <= values
    assert [r.value for r in a.table("static_values").collect()] == ["7"]
    for name in SCHEMAS:
        a.table(name).collect()


def test_greet_listing(spark, one):
    rows = Session(spark, str(one)).disasm("Greeter.greet").collect()
    assert [r.offset for r in rows] == [0x00, 0x04, 0x08, 0x0E, 0x12, 0x18, 0x1A, 0x20, 0x22]
    assert rows[1].operands == 'v1, "hi "' and rows[-1].mnemonic == "return-object"


def test_largest_is_in_code_units(spark, one):
    got = [(r.units, r["class"], r.method.split("(")[0]) for r in Session(spark, str(one)).largest(3).collect()]
    assert got[0][1:] == ("Hello", "main") and got[1] == (18, "Greeter", "greet") and got[2][0] == 6


def test_findrefs(spark, one):
    s = Session(spark, str(one))
    r = s.findrefs("string", "hi", full=True).collect()
    assert [(x.kind, x["class"], x.method, x.refs) for x in r] == [("const-string", "Greeter", "greet()Ljava/lang/String;", ['"hi "'])]
    r = s.callers("greet", full=True).collect()
    assert [(x.kind, x["class"], x.method, x.refs) for x in r] == [("invoke", "Hello", "main([Ljava/lang/String;)V", ["LGreeter;->greet()Ljava/lang/String;"])]
    assert s.findrefs("string", "", full=True).count() == 0
    assert s.findrefs("string", "HI", full=True).count() == 0
    assert s.callers("", full=True).count() > 0
    with pytest.raises(BadQuery):
        s.findrefs("thing", "x")


def test_counts_are_the_groups_of_hits(spark, one):
    s = Session(spark, str(one))
    full = {}
    for r in s.callers("", full=True).collect():
        full[r["class"]] = full.get(r["class"], 0) + 1
    assert {r.path: r["count"] for r in s.callers("").collect()} == full


def test_members_hierarchy_strings(spark, one):
    s = Session(spark, str(one))
    assert [(r.kind, r["class"], r.member) for r in s.members("name", full=True).collect()] == [("field", "Greeter", "name Ljava/lang/String;")]
    assert {(r.relation, r["class"]) for r in s.hierarchy("java.lang.Object", full=True).collect()} == {("sub", "Greeter"), ("sub", "Hello")}
    assert {(r.relation, r["class"]) for r in s.hierarchy("Hello", full=True).collect()} == {("class", "Hello"), ("extends", "Ljava/lang/Object;")}
    with pytest.raises(NotFound):
        s.hierarchy("no.Such")
    assert {r["class"] for r in s.subtypes("java/lang/Object").collect()} == {"Greeter", "Hello"}
    got = s.strings("hi ", locations=True).collect()
    assert got[0].used_by == ["Greeter.greet()Ljava/lang/String;"]
    with pytest.raises(BadQuery):
        s.strings("x", view=View(depth=1))


def test_containers_and_order(spark, folder, tmp_path):
    img = K.hello().build()
    inner = zipped([("classes.dex", img)])
    (tmp_path / "b.xapk").write_bytes(zipped([("config.apk", inner), ("base.apk", inner), ("manifest.json", b"{}")]))
    (tmp_path / "a.dex").write_bytes(img)
    (tmp_path / "broken.dex").write_bytes(b"dex\n039\0" + b"\0" * 200)
    (tmp_path / "note.txt").write_bytes(b"no")
    a = Artifacts(spark, str(tmp_path))
    assert [r.label for r in a.table("images").orderBy("image_seq").collect()] == ["a", "b!base.apk!classes.dex", "b!config.apk!classes.dex"]
    assert [r.label for r in a.failures().collect()] == ["broken"]
    labels = [r.label for r in Artifacts(spark, str(folder)).table("images").orderBy("image_seq").collect()]
    assert labels == ["app!classes.dex", "app!classes2.dex"]
    assert [r.label for r in Artifacts(spark, str(folder), ["CLASSES2"]).table("images").collect()] == ["app!classes2.dex"]
    with pytest.raises(NotFound):
        Session(spark, str(folder), ["nothing"]).check()


def test_first_definition_wins(spark, folder):
    rows = Session(spark, str(folder)).listclasses(full=True).collect()
    assert [(r["class"], r.dex) for r in rows] == [("Greeter", "classes.dex"), ("Hello", "classes.dex")]
    assert [r["class"] for r in Session(spark, str(folder)).listclasses("HEL", full=True).collect()] == ["Hello"]


def test_context(spark, folder):
    s = Session(spark, str(folder))
    f = s.facts()
    assert (f["package"], f["version"], f["application"], f["launcher"], f["label"]) == ("com.app", "1.2", "com.app.App", "com.app.Hello", "My App")
    assert s.mainactivity()["dex"] == "-"
    assert s.info()["total_images"] == 2
    assert [r.attrs["android:name"] for r in s.manifest("activities").collect()] == [".Other", "Hello"]
    assert [r.attrs["android:name"] for r in s.manifest("launchers").collect()] == ["Hello"]
    assert '<activity android:name="Hello">' in s.manifest()
    assert {r.path for r in s.res().collect()} >= {"assets/note.txt", "classes.dex"}
    assert s.dump("note") == b"hi" and s.dump("AndroidManifest.xml").startswith("<?xml")
    with pytest.raises(BadQuery):
        s.dump("classes")
    with pytest.raises(NotFound):
        s.dump("zzz")


def test_sparse_resources():
    assert [r[3] for r in axml.string_resources(K.arsc(["a", "b"], sparse=True))] == ["a", "b"]


def test_entries_of_containers():
    inner = zipped([("x.txt", b"1")])
    names = [n for _, n, _, _ in archive.entries("c.xapk", zipped([("base.apk", inner), ("m.json", b"{}")]))]
    assert names == ["base.apk", "base.apk!x.txt", "m.json"]


def test_outlines(spark, folder):
    s = Session(spark, str(folder))
    src = s.getclass("Hello").collect()[0]
    assert "public class Hello {" in src.source and "static int counter = 7;" in src.source and src.images == ["classes.dex", "classes2.dex"]
    assert "java.lang.String greet()" in s.getmethod("Greeter", "greet").collect()[0].source
    assert {r.path for r in s.pkg("").collect()} == {"Hello.java", "Greeter.java"}


def test_blocks(spark, one):
    rows = [r for r in Artifacts(spark, str(one)).table("blocks").collect() if r.class_seq == 1 and len(r.successors) == 2]
    assert rows and all(s > r.start_pc for r in rows for s in r.successors)


def test_data_source_equals_reader(spark, folder):
    spark.dataSource.register(ArtifactSource)
    for t in ("images", "method_ids", "archive_entries"):
        a = spark.read.format("artifact").option("table", t).load(str(folder)).collect()
        b = Artifacts(spark, str(folder)).table(t).collect()
        assert sorted(map(str, a)) == sorted(map(str, b))


def test_stream_ingest(spark, folder, tmp_path):
    q = ingest(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_pages_and_envelopes(spark):
    ids = list(range(3, 40, 3))
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    for offset in (0, 2, len(ids) - 1, len(ids), 99):
        for limit in (0, 1, 6):
            p = W.fetch(df, ["id"], offset, limit)
            want = ids[offset : offset + limit] if limit else ids[offset:]
            end = offset + len(want)
            assert ([r.id for r in p.rows], p.next_offset, p.total) == (want, end if want and end < len(ids) else None, len(ids))
    p = W.fetch(df, ["id"], 1, 2)
    assert json.loads(render.to_json(p, "rows", view="full")) == {"view": "full", "total": 13, "offset": 1, "limit": 2, "returned": 2, "next_offset": 3, "rows": [{"id": 6}, {"id": 9}]}
    assert render.table(p.rows).splitlines()[0].strip() == "id"
    assert [json.loads(x) for x in render.json_lines(p.rows).splitlines()] == [{"id": 6}, {"id": 9}]
    assert {r.truncated for r in W.capped(df, ["id"], 5).collect()} == {True} and {r.truncated for r in W.capped(df, ["id"], 13).collect()} == {False}


def test_inputs_that_cannot_be_used(spark, tmp_path):
    (tmp_path / "bad.dex").write_bytes(b"dex\n039\0" + b"\0" * 200)
    with pytest.raises(NotFound, match="no image decodes: bad"):
        Session(spark, str(tmp_path)).listclasses()
    (tmp_path / "good.dex").write_bytes(K.hello().build())
    with pytest.raises(NotFound, match="no image matches; there are: .*good"):
        Session(spark, str(tmp_path), ["zzz"]).listclasses()
    assert Session(spark, str(tmp_path)).listclasses(full=True).count() == 2


def test_components(spark, folder):
    s = Session(spark, str(folder))
    assert s.manifest("application").count() == 1 == s.manifest("applications").count() and s.manifest("activity-aliases").columns == s.manifest("activity-alias").columns
    for bad in ("activitie", "servicess", "thing"):
        with pytest.raises(BadQuery):
            s.manifest(bad)
    page = s.info(limit=1)
    assert len(page["images"]) == 1 and page["next_offset"] == 1 and page["total_images"] == 2 and s.info()["next_offset"] is None
