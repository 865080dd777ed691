import json
import random

import pytest
from lodestone.functions import names as N
from lodestone.operators import frontier as P
from lodestone.operators import hierarchy as H
from lodestone.operators import page as W
from lodestone.operators import tables as J
from pyspark.sql import functions as F

def forest(seed, n=60):
    """Dotted keys of a random tree, chains and keys above other keys among them."""
    r = random.Random(seed)
    return sorted({".".join(r.choice("klm") + r.choice(["", "x", "-"]) for _ in range(r.randint(1, 5))) for _ in range(n)})


def rolled_up(keys, prefix="", depth=None):
    """The same view in plain Python: {(path, kind): count}."""
    scope = tuple(prefix.split(".")) if prefix else ()
    mine = [p for k in keys if (p := tuple(k.split(".")))[: len(scope)] == scope]
    below = lambda node: [p for p in mine if p[: len(node)] == node]
    branches = lambda node: len({p[: len(node) + 1] for p in below(node) if len(p) > len(node)})
    out = {}
    for p in mine:
        for lvl in range(max(1, len(scope)), len(p) + 1):
            node = p[:lvl]
            if depth is not None and lvl > len(scope) + depth:
                break
            if node == p:
                out[".".join(p), "class"] = 1
            stops = lvl > len(scope) and (branches(node) > 1 if depth is None else lvl == len(scope) + depth and node != p)
            if stops:
                out[".".join(node), "package"] = len(below(node))
                break
    return out


def view(spark, keys, **options):
    rows = P.frontier(spark.createDataFrame([(k,) for k in keys], "k string"), "k", **options).collect()
    assert len(rows) == len({(r.path, r.kind) for r in rows})
    return {(r.path, r.kind): r["count"] for r in rows}


@pytest.mark.parametrize(("seed", "options"), [(1, {}), (2, {}), (3, {"depth": 1}), (4, {"depth": 2}), (5, {"prefix": "k"}), (6, {"prefix": "k.lx"}), (7, {"prefix": "l", "depth": 2}), (8, {"prefix": "absent"})])
def test_frontier_equals_a_plain_roll_up(spark, seed, options):
    keys = forest(seed)
    assert view(spark, keys, **options) == rolled_up(keys, **options)


def test_order_of_a_tree(spark):
    keys = forest(9)
    tree = P.frontier(spark.createDataFrame([(k,) for k in keys], "k string"), "k", depth=2)
    by_name = [r.path.split(".") for r in P.in_order(tree, "name").collect()]
    assert by_name == sorted(by_name)  # by segments, not by text
    by_count = [r["count"] for r in P.in_order(tree, "count").collect()]
    assert by_count == sorted(by_count, reverse=True)


def test_samples(spark):
    keys = forest(10)
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    for r in P.frontier(df, "k", samples=2).collect():
        under = sorted((k.split(".") for k in keys if (k + ".").startswith(r.path + ".")))[:2] if r.kind == "package" else []
        assert r.samples == [".".join(k) for k in under]


def test_normalisation():
    assert [N.normalize_prefix(p) for p in ("org/app.ui/ ", "\torg.app..", "/")] == ["org.app.ui", "org.app", ""]
    assert {N.normalize_type(x) for x in ("a.b.C", "a/b/C", "La/b/C;")} == {"La/b/C;"}
    assert N.normalize_type("LLogger") == "LLLogger;"
    assert [N.java_identifier(x) for x in ("class", "1-a", "_", "支", "ok")] == ["_class", "_1_a", "__", "__", "ok"]
    assert N.java_type("[[I") == "int[][]"


def test_predicates(spark):
    df = spark.createDataFrame([("LLogger;", "aÄb.C"), ("La/b/C;", "x")], "d string, n string")
    assert [r[0] for r in df.select(N.class_name(F.col("d"))).collect()] == ["Logger", "a/b/C"]
    assert df.where(N.contains_ignoring_case(F.col("n"), "AÄB")).count() == 1
    assert df.where(N.contains_ignoring_case(F.col("n"), "aäb")).count() == 0
    assert df.where(N.contains(F.col("n"), "")).count() == 2


def test_first_wins_and_defining(spark):
    df = spark.createDataFrame([("A", 2, "y"), ("A", 1, "x"), ("B", 3, "y")], "c string, o int, i string")
    assert sorted((r.c, r.o) for r in J.first_wins(df, "c", ["o"]).collect()) == [("A", 1), ("B", 3)]
    d = {r.c: (r.images, r.n, r.first) for r in J.defining(df, "c", "i", "o").collect()}
    assert d == {"A": (["x", "y"], 2, "x"), "B": (["y"], 1, "y")}


def test_closures(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "b")], "child string, parent string")
    assert sorted((r.ancestor, r.depth) for r in H.closure(e).where("child = 'a'").collect()) == [("b", 1), ("c", 2), ("d", 3)]
    assert {r["class"]: r.depth for r in H.subtypes(e, "c").collect()} == {"b": 1, "a": 2, "x": 2}
    r = H.reachable(spark.createDataFrame([("a",)], "name string"), e.select(F.col("child").alias("src"), F.col("parent").alias("dst")), 2)
    assert {x.name: x.round for x in r.collect()} == {"a": 0, "b": 1, "c": 2}


def test_closure_of_diamonds_and_cycles(spark):
    diamonds = [(f"{i}", f"{i}{s}") for i in range(22) for s in "lr"] + [(f"{i}{s}", f"{i + 1}") for i in range(22) for s in "lr"]
    got = H.closure(spark.createDataFrame(diamonds, "child string, parent string")).where("child = '0'").collect()
    assert len(got) == 22 * 3 and max(r.depth for r in got) == 44
    ring = spark.createDataFrame([(i, (i + 1) % 5) for i in range(5)], "child long, parent long")
    assert sorted((r.ancestor, r.depth) for r in H.closure(ring).where("child = 2").collect()) == [(0, 3), (1, 4), (2, 5), (3, 1), (4, 2)]
    assert {r["class"]: r.depth for r in H.subtypes(ring, 2).collect()} == {1: 1, 0: 2, 4: 3, 3: 4, 2: 5}
    assert H.closure(ring.limit(0)).count() == 0


def test_closure_of_many_types(spark):
    n = 400_000
    e = spark.range(n).selectExpr("id AS child", f"{n} + id % 1000 AS parent").union(spark.range(1000).selectExpr(f"{n} + id", f"{n} + 1000 + id % 10")).union(spark.range(10).selectExpr(f"{n} + 1000 + id", "-1"))
    got = H.closure(e).groupBy("depth").count().collect()
    assert {r.depth: r["count"] for r in got} == {1: n + 1010, 2: n + 1000, 3: n}
    assert H.subtypes(e, -1).count() == n + 1010


def test_assignable(spark):
    closed = H.closure(spark.createDataFrame([("p/A", "p/B"), ("p/B", "q/I")], "child string, parent string"))
    cases = {
        ("p/A", "p/A"): True, ("p/A", "q/I"): True, ("q/I", "p/A"): False, ("p/X", "java/lang/Object"): True, ("I", "java/lang/Object"): False, ("p/X", "p/B"): False,
        ("[Lp/A;", "[Lq/I;"): True, ("[[Lp/A;", "[[Lq/I;"): True, ("[[Lp/A;", "[Lq/I;"): False, ("[Lp/A;", "[[Lp/A;"): False, ("[[Lp/A;", "[Ljava/lang/Object;"): True,
        ("[Lp/A;", "java/lang/Object"): True, ("[I", "[I"): True, ("[I", "[J"): False, ("[[I", "[Ljava/lang/Object;"): True, ("[I", "[Ljava/lang/Object;"): False, ("[I", "java/lang/Object"): True,
    }
    got = H.assignable(spark.createDataFrame(list(cases), "sub string, sup string"), closed).collect()
    assert {(r.sub, r["sup"]): r.ok for r in got} == cases


def test_nesting_evidence(spark):
    note = lambda k, kind, **e: (0, k, f"Ldalvik/annotation/{kind};", json.dumps(e))
    rows = [note(1, "EnclosingClass", value="La/B;"), note(1, "InnerClass", name="C", accessFlags=8), note(2, "EnclosingMethod", value="La/B;->m()V"), note(3, "MemberClasses", value=["La/B$C;", "La/B$D;"]), (0, 4, "Lx/Other;", "{}"), note(5, "Signature", value=["x"])]
    got = {r.class_seq: tuple(r)[2:] for r in J.nesting_evidence(spark.createDataFrame(rows, "image_seq int, class_seq int, type string, elements string")).collect()}
    assert got == {1: ("La/B;", None, "C", None), 2: (None, "La/B;->m()V", None, None), 3: (None, None, None, ["La/B$C;", "La/B$D;"])}


def test_entry_and_collisions(spark):
    df = spark.createDataFrame([("a/b",), ("a/bc",), ("A/b",)], "p string")
    assert [r.p for r in J.entry(df, "p", "a/b").collect()] == ["a/b"]
    assert sorted(r.p for r in J.entry(df, "p", "/b").collect()) == ["A/b", "a/b", "a/bc"]
    assert [(r.folded, r.paths) for r in J.case_collisions(df, "p").collect()] == [("a/b", ["A/b", "a/b"])]


def test_unique_value_and_nesting(spark):
    d = spark.createDataFrame([("k", 1, "ONE"), ("k", 2, "TWO"), ("k", 2, "ZWEI")], "k string, v int, name string")
    rows = spark.createDataFrame([("k", 1), ("k", 2), ("k", 3)], "k string, v int")
    assert {r.v: r.name for r in J.unique_value(rows, d, ["k"], "v", "name").collect()} == {1: "ONE", 2: None, 3: None}
    n = J.nesting(spark.createDataFrame([("A",), ("A$B",), ("X$Y",)], "name string"), "name")
    assert {r.name: r.outer for r in n.collect()} == {"A": None, "A$B": "A", "X$Y": None}
    assert {r.name for r in J.top_level(n).collect()} == {"A", "X$Y"}


def test_largest_needs_a_number(spark):
    with pytest.raises(ValueError):
        W.largest(spark.range(1).toDF("s"), "s", [], 0)


def test_sizes_and_lines(spark):
    from lodestone.plans import render
    from lodestone.plans.commands import BadQuery, NotFound, outcome

    sizes = [0, 1023, 1024, 1280, 1 << 20, (1 << 30) - 1, 5 << 40]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in sizes], "n long").select(N.human_size(F.col("n"))).collect()]
    assert got == ["0 B", "1023 B", "1.0 KB", "1.2 KB", "1.0 MB", "1024.0 MB", "5120.0 GB"]
    df = spark.createDataFrame([(12, "classes.dex", "a/B", "run()V"), (1234567890, "x", None, "m")], "units long, dex string, class string, method string")
    assert [r.line for r in render.lines(df, "largest").collect()] == ["     12  classes.dex  a/B run()V", "1234567890  x           - m"]
    assert render.header("largest") == "  insns  dex         class method" and set(render.LAYOUTS) >= {"findrefs", "members"}
    tree = spark.createDataFrame([("p", "package", 3, ["p.a", "p.b"]), ("q", "class", 1, [])], "path string, kind string, count int, samples array<string>").collect()
    assert render.tree(tree) == "p/ (3)  e.g. p.a, p.b\nq\n"
    assert (outcome(NotFound()), outcome(BadQuery()), outcome(OSError())) == ((2, 404), (1, 400), (1, 500))
