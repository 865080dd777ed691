"""Forests, closures, access, file names and trees against plain models."""

import os
import random
from collections import defaultdict

import pytest
from lodestone.functions.names import JAVA_KEYWORDS, java_identifier
from lodestone.operators import access, closure, forest, frontier, naming, page, rank, rounds
from lodestone.plans.commands import NotFound, Session, View
from lodestone.sources.tree import write_tree
from pyspark.sql import functions as F

from . import dexkit as K


def names_of(spark, names, more=()):
    return spark.createDataFrame([(n,) for n in names], "name string")


# ---------------------------------------------------------------- nesting
def plain_outer(name, names, said):
    if said.get(name) in names and said[name] != name:
        return said[name], "said"
    rest = name
    while "$" in rest:
        at = rest.rindex("$")
        rest, after = rest[:at], name[at + 1 : at + 2]
        if after != "/" and rest in names:
            return rest, "named"
    return None, None


def clean(name, outer):
    if not name.startswith(outer + "$"):
        return False
    rest = name[len(outer) + 1 :]
    tail = rest.split("$")[-1]
    return not (rest.startswith("-") or "/" in rest or rest.startswith("$ExternalSynthetic") or tail == "" or tail[0] in "0123456789")


def plain_forest(names, said):
    outer = {n: plain_outer(n, names, said) for n in names}
    up = {n: o for n, (o, _) in outer.items()}
    how = {n: h for n, (_, h) in outer.items()}
    for n in names:  # cycles are cut before their least name
        seen, at = [], n
        while at is not None and at not in seen:
            seen.append(at)
            at = up[at]
        if at is not None:
            least = min(seen[seen.index(at) :])
            up[least], how[least] = None, "cut"
    out = {}
    for n in names:
        chain = [n]
        while up[chain[-1]] is not None:
            chain.append(up[chain[-1]])
        unit = chain[-1]
        for child, parent in reversed(list(zip(chain, chain[1:]))):
            unit = unit if clean(child, parent) else child
        out[n] = (up[n], how[n], chain[-1], len(chain) - 1, unit)
    return out


def test_forest_equals_the_plain_walk(spark):
    r = random.Random(2)
    parts = ["A", "B", "1", "x2", "", "-d", "$ExternalSynthetic0", "k"]
    names = {"/".join(r.choice(["p", "q$", "j$"]) for _ in range(r.randint(0, 2))) + "/" + "$".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(150)} | {"$", "a$", "$b", "j", "j$/util/X", "a", "a$b$c", "c1", "c2", "c3", "c1$in", "self", "t1", "t2"}
    some = sorted(names)
    said = {r.choice(some): r.choice([*some, "gone"]) for _ in range(40)} | {"c1": "c2", "c2": "c3", "c3": "c1", "self": "self", "t1": "t2", "t2": "c1"}
    got = forest.forest(names_of(spark, [*some, "a"]), spark.createDataFrame(list(said.items()), "name string, outer string"))
    rows = {x.name: tuple(x)[1:] for x in got.collect()}
    want = plain_forest(names, said)
    assert rows == want and "cut" in {v[1] for v in want.values()}
    assert {x.name for x in forest.top_level(got).collect()} == {n for n, v in want.items() if v[4] == n}
    kids = defaultdict(list)
    for x in forest.children(got).collect():
        kids[x.outer].append(x.child)
    assert all(v == sorted(v) for v in kids.values()) and sum(map(len, kids.values())) == sum(v[0] is not None for v in want.values())
    assert forest.forest(names_of(spark, []), None).count() == 0


# ---------------------------------------------------------------- closure
def test_closure_ends_where_nearly_all_images_are_needed(spark):
    edges = lambda rows: spark.createDataFrame(rows, "src string, dst string")
    body = edges([("T", "R$id"), ("T$in", "facade__part"), ("T", "nowhere"), ("other", "zzz")])
    head = edges([("R", "Base"), ("Base", "Base2"), ("Base2", "Base3"), ("Base3", "Base4"), ("nowhere", "Hidden")])
    at = {"T": "i0", "T$in": "i0", "R": "i1", "R$id": "i1", "facade": "i2", "facade__part": "i3", "Base": "i4", "Base2": "i5", "Base3": "i6", "Hidden": "i7"}
    defined = spark.createDataFrame(list(at.items()), "name string, image string")
    start = closure.family(defined, "T")
    c = closure.closure(start, body, head, defined, 20)
    assert {(x.name, x.image, x.round) for x in c.found.collect()} == {("T", "i0", 0), ("T$in", "i0", 0), ("R$id", "i1", 1), ("R", "i1", 1), ("facade__part", "i3", 1), ("facade", "i2", 1), ("nowhere", None, 1), ("Base", "i4", 2), ("Base2", "i5", 3)}
    assert {x.image for x in c.images.collect()} == {f"i{k}" for k in range(6)} and not c.all_images
    c = closure.closure(start, body, head, defined, 4)
    assert c.all_images and c.found.agg(F.max("round")).first()[0] == 1 and c.images.count() == 8


# ---------------------------------------------------------------- access
def test_levels_let_every_reference_through(spark):
    members = [("p/A", "f", 0), ("p/A", "g", 1), ("p/A", "h", 0), ("p/A", "k", 3), ("p/A", "alone", 0), ("p/A", "sub", 1)]
    refs = [("p/A", "f", "p/A$In"), ("p/A", "g", "q/X"), ("p/A", "h", "p/B"), ("p/A", "k", "q/X"), ("p/A", "sub", "q/Sub"), ("p/A", "sub", "p/B")]
    rows = [(o, m, u, o.rpartition("/")[0], u.rpartition("/")[0], o.split("$")[0], u.split("$")[0]) for o, m, u in refs]
    got = access.levels(
        spark.createDataFrame(members, "owner string, member string, declared int"),
        spark.createDataFrame(rows * 3, "owner string, member string, user string, owner_package string, user_package string, owner_unit string, user_unit string"),
        spark.createDataFrame([("q/Sub", "p/A"), ("q/Sub", "p/A")], "child string, ancestor string"),
    )
    assert {x.member: (x.declared, x.needed, x.widened, x.changed) for x in got.collect()} == {
        "f": ("private", "private", "private", False), "g": ("package", "public", "public", True), "h": ("private", "package", "package", True),
        "k": ("public", "public", "public", False), "alone": ("private", "private", "private", False), "sub": ("package", "protected", "protected", True),
    }


# ---------------------------------------------------------------- names of files
def test_paths_stay_apart(spark):
    r = random.Random(9)
    names = {"".join(r.choice("aAbB") for _ in range(r.randint(1, 3))) + r.choice(["", "_2", "_3", "_02", "_2_2"]) for _ in range(120)} | {"p/class", "p/_class", "9", "_9", "é", "ü", "_", "", "p/é/x", "p/ü/x"}
    names |= {"clash", "Clash", "CLASH", "clash_2", "CLASH_3", "clash_5"}  # a new name would collide again
    got = {x.name: x.path for x in naming.unique_paths(names_of(spark, [*sorted(names), "clash"]), naming.safe_path(F.col("name"), JAVA_KEYWORDS)).collect()}
    assert got.keys() == names and len({p.lower() for p in got.values()}) == len(names)
    assert [got[n] for n in ("CLASH", "Clash", "clash", "clash_2", "CLASH_3")] == ["CLASH", "Clash_4", "clash_6", "clash_2", "CLASH_3"]
    for n in names:
        base = "/".join(java_identifier(s) for s in n.split("/"))
        assert got[n] == base or got[n].startswith(base + "_")


def test_tree_of_files(spark, tmp_path):
    rows = [(f"a/b{i % 5}/C{i}.java", f"class C{i} é\n") for i in range(40)] + [("top.java", None)]
    df = spark.createDataFrame(rows, "path string, source string").withColumn("more", F.lit(1))
    for _ in range(2):  # another run writes the same
        write_tree(df, str(tmp_path / "out"))
    found = {os.path.relpath(os.path.join(d, f), tmp_path / "out"): open(os.path.join(d, f), encoding="utf-8").read() for d, _, fs in os.walk(tmp_path / "out") for f in fs}
    assert found.pop("_SUCCESS") == "41" and found == {p: s or "" for p, s in rows}
    for bad in ("../x", "a//b", "/etc/x", ""):
        with pytest.raises(Exception, match="no path below a folder"):
            write_tree(spark.createDataFrame([(bad, "x")], "path string, source string"), str(tmp_path / "out"))
    assert not (tmp_path / "x").exists()


# ---------------------------------------------------------------- places, pages, rounds
def test_places_in_an_order(spark):
    r = random.Random(1)
    rows = [(r.choice("aab"), k) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, k int").repartition(7)
    assert [x.nr for x in rank.numbered(df, ["g", "k"]).orderBy("g", "k").collect()] == list(range(500))
    within = defaultdict(list)
    for x in rank.numbered_within(df, ["g"], ["k"]).orderBy("k").collect():
        within[x.g].append(x.nr)
    assert all(v == list(range(len(v))) for v in within.values())
    first = {(x.g, x.nr): x.k for x in rank.least(df, ["g"], ["k"], 3, lanes=4).collect()}
    want = {g: sorted(k for h, k in rows if h == g)[:3] for g in "ab"}
    assert first == {(g, i + 1): k for g, ks in want.items() for i, k in enumerate(ks)}


def test_a_page_makes_its_rows_once(spark):
    made = spark.sparkContext.accumulator(0)

    def run(it):
        for b in it:
            made.add(b.num_rows)
            yield b

    df = spark.range(100).mapInArrow(run, "id long")
    p = page.fetch(df, ["id"], 10, 5)
    assert ([x.id for x in p.rows], p.total, made.value) == ([10, 11, 12, 13, 14], 100, 100)
    assert [(x.id, x.total) for x in page.with_total(df, [F.desc("id")], 0, 2).collect()] == [(99, 100), (98, 100)] and made.value == 200


def test_tables_of_rounds_go(spark):
    before = set(rounds._WRITTEN)
    a = rounds.settled(spark.range(3))
    path = a._round_path.removeprefix("file://")
    assert os.path.isdir(path)
    rounds.forget(a, None, spark.range(1))
    assert not os.path.exists(path) and set(rounds._WRITTEN) == before


def test_samples_keep_their_relation(spark):
    rows = [("r1", "a.b.c"), ("r1", "a.b.d"), ("r1", "a.e"), ("r2", "a.b.z"), ("r2", "a.b.z.q"), ("r2", "a.x")]
    df = spark.createDataFrame(rows, "rel string, k string")
    got = {(x.rel, x.path): x.samples for x in frontier.frontier(df, "k", by=["rel"], samples=2).collect()}
    assert got == {("r1", "a"): ["a.b.c", "a.b.d"], ("r2", "a"): ["a.b.z", "a.b.z.q"]}


# ---------------------------------------------------------------- over images
def app():
    """A family, its base and a class that shares a name but for case, in two images."""
    call = lambda owner, name: (1, 1, 1, lambda d: [*K.invoke(0x6E, d.m[owner, name, (), "V"], 0), 0x0E])
    one = K.Dex([
        {"name": "Lp/T;", "super": "Lq/Base;", "fields": [("r", "Lp/R$id;", 2, False)], "methods": [("go", (), "V", 2, call("Lq/Far;", "hid"))]},
        {"name": "Lp/T$In;", "super": K.O, "methods": [("in", (), "V", 1, call("Lp/T;", "go"))]},
        {"name": "Lp/t;", "super": K.O, "methods": [("x", (), "V", 1, call("Lp/T;", "go"))]},
    ], extra_methods=[("Lq/Far;", "hid", (), "V")])
    two = K.Dex([
        {"name": "Lq/Base;", "super": "Lq/Root;", "methods": []}, {"name": "Lq/Root;", "super": K.O, "methods": []}, {"name": "Lp/R;", "super": K.O, "methods": []},
        {"name": "Lp/R$id;", "super": K.O, "methods": []}, {"name": "Lq/Far;", "super": K.O, "methods": [("hid", (), "V", 0, (1, 1, 0, lambda d: [0x0E]))]}, {"name": "Lz/Unrelated;", "super": K.O, "methods": []},
    ])
    return one.build(), two.build(), K.hello().build()


def test_structure_of_images(spark, tmp_path):
    for name, data in zip(("a", "b", "c"), app()):
        (tmp_path / f"{name}.dex").write_bytes(data)
    s = Session(spark, str(tmp_path))
    c = s.dependencies("p.T")
    assert {(x.name, x.image, x.round) for x in c.found.where("image is not null").collect()} == {("p/T", 0, 0), ("p/T$In", 0, 0), ("q/Base", 1, 1), ("p/R$id", 1, 1), ("p/R", 1, 1), ("q/Far", 1, 1), ("q/Root", 1, 2)}
    assert {x.image for x in c.images.collect()} == {0, 1}
    row = s.getclass("p/T", dependencies=True).collect()[0]
    assert row.dependencies == ["p.R", "p.R$id", "q.Base", "q.Far", "q.Root"] and row.dex == "a"
    with pytest.raises(NotFound):
        s.dependencies("no.Such")
    got = {(x.owner, x.member): (x.declared, x.widened) for x in s.access().where("changed").collect()}
    assert got == {("p/T", "go()V"): ("private", "package"), ("q/Far", "hid()V"): ("package", "public")}
    f = {x.name: (x.outer, x.unit) for x in s.forest().collect()}
    assert f["p/T$In"] == ("p/T", "p/T") and f["p/R$id"] == ("p/R", "p/R") and f["Hello"] == (None, "Hello")
    s.export_tree(str(tmp_path / "out"), "p")
    assert {x: open(tmp_path / "out" / "p" / x).read().split("{")[0].split()[-1] if "extends" not in open(tmp_path / "out" / "p" / x).read() else "ext" for x in os.listdir(tmp_path / "out" / "p")} == {"T.java": "ext", "T$In.java": "T$In", "t_2.java": "t_2", "R.java": "R", "R$id.java": "R$id"}
    tree = s.hierarchy("java.lang.Object", view=View(samples=1, sort="count")).collect()
    assert tree[0].samples and tree[0]["count"] == max(x["count"] for x in tree)
