"""The registered queries: every operator over plain tables, with the same in SQL beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import access as A
from ..operators import closure as C
from ..operators import forest as T
from ..operators import frontier as P
from ..operators import hierarchy as H
from ..operators import naming as G
from ..operators import page as W
from ..operators import refs as R
from ..operators import tables as J
from . import render as V
from .roles import SQL_CLASSES, SQL_EDGES, SQL_MEMBERS, SQL_PATHS, SQL_REFS, Tables, sql_frontier

NEEDLE, NEEDLE2 = "bolt", "gear"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
TREE = ["path", "kind", "count"]


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _found(t: Tables, needle: str = NEEDLE, refs: DataFrame | None = None) -> DataFrame:
    want = R.targets(t.part.select(F.col("p_partkey").alias("ref_idx"), "p_name"), N.contains(F.col("p_name"), needle), ["ref_idx"], F.col("p_name"))
    return R.hits(t.refs() if refs is None else refs, want, ["ref_idx"])


def _sql_found(needle: str = NEEDLE, where: str = "true") -> str:
    return f"(SELECT r.*, p_name AS target FROM {SQL_REFS} r JOIN part ON p_partkey = ref_idx WHERE contains(p_name, '{needle}') AND {where})"


def _sql_methods(found: str) -> str:
    return f"""WITH f AS (SELECT * FROM {found}),
 o AS (SELECT image, class, method, target, min(struct_pack(a := pc, b := ref_idx, c := kind)) AS hd FROM f GROUP BY ALL)
 SELECT image AS dex, struct_extract(min(hd), 'c') AS kind, class, method, string_agg(target, '; ' ORDER BY hd, target) AS refs FROM o GROUP BY image, class, method"""


def _methods(found: DataFrame) -> DataFrame:
    return R.by_method(found, ["pc", "ref_idx", "kind"]).withColumn("refs", F.array_join("refs", "; "))


# ------------------------------------------------------------------ references
@query(_sql_methods(_sql_found()))
def findrefs_full(t: Tables) -> DataFrame:
    return _methods(_found(t))


@query(f"SELECT class, count(*) AS methods FROM (SELECT DISTINCT image, class, method FROM {_sql_found()}) GROUP BY class")
def findrefs_counts(t: Tables) -> DataFrame:
    return R.by_class(_found(t))


@query(sql_frontier(f"(SELECT class AS key, count(*) AS w FROM (SELECT DISTINCT image, class, method FROM {_sql_found()}) GROUP BY class)", "."))
def findrefs_summary(t: Tables) -> DataFrame:
    return P.frontier(R.by_class(_found(t)), "class", F.col("methods")).select(*TREE)


@query(_sql_methods(_sql_found(NEEDLE, "class = (SELECT min(class) FROM " + SQL_REFS + ")")))
def findrefs_class_exact(t: Tables) -> DataFrame:
    one = t.refs().agg(F.min("class").alias("class"))  # one row
    return _methods(_found(t, NEEDLE, t.refs().join(F.broadcast(one), "class", "left_semi")))


@query(_sql_methods(_sql_found(NEEDLE, "contains(class, 'BUILDING')")))
def findrefs_class_fuzzy(t: Tables) -> DataFrame:
    return _methods(_found(t, NEEDLE, t.refs().where(N.contains(F.col("class"), "BUILDING"))))


@query(_sql_methods(_sql_found(NEEDLE, "(contains(lower(image), 'asia') OR contains(lower(image), 'euro'))")))
def findrefs_image_filter(t: Tables) -> DataFrame:
    return _methods(_found(t, NEEDLE, t.refs().where(N.any_label(F.col("image"), ["Asia", "EURO"]))))


@query(f"WITH m AS ({_sql_methods(_sql_found(NEEDLE2))}) SELECT *, (SELECT count(*) FROM m) AS total FROM m ORDER BY class, method, dex LIMIT 20 OFFSET 40")
def findrefs_page(t: Tables) -> DataFrame:
    return W.with_total(_methods(_found(t, NEEDLE2)), ["class", "method", "dex"], 40, 20)


@query(f"WITH m AS ({_sql_methods(_sql_found(NEEDLE2))}) SELECT *, (SELECT count(*) FROM m) > 500 AS truncated FROM m ORDER BY class, method, dex LIMIT 500")
def findrefs_capped(t: Tables) -> DataFrame:
    return W.capped(_methods(_found(t, NEEDLE2)), ["class", "method", "dex"])


@query(_sql_methods(f"(SELECT r.*, p_name AS target FROM {SQL_REFS} r JOIN part ON p_partkey = ref_idx WHERE p_name = (SELECT min(p_name) FROM part))"))
def callers(t: Tables) -> DataFrame:
    name = t.part.agg(F.min("p_name").alias("p_name"))
    want = t.part.join(F.broadcast(name), "p_name", "left_semi").select(F.col("p_partkey").alias("ref_idx"), F.col("p_name").alias("target"))
    return _methods(R.hits(t.refs(), want, ["ref_idx"]))


@query(f"SELECT class, count(*) AS sites FROM {_sql_found()} GROUP BY class")
def string_site_counts(t: Tables) -> DataFrame:
    return R.sites_by_class(_found(t))


@query("SELECT l_returnflag AS ref_kind, count(*) AS sites, count(DISTINCT l_partkey) AS targets FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1")
def ref_kind_mask(t: Tables) -> DataFrame:
    return R.kinds(t.lineitem, ["A", "R"], "l_returnflag", "l_partkey")


# ------------------------------------------------------------------ strings
@query(f"SELECT p_partkey AS string_idx, p_name AS string FROM part WHERE contains(p_name, '{NEEDLE}')")
def strings_table(t: Tables) -> DataFrame:
    return t.part.where(N.contains(F.col("p_name"), NEEDLE)).select(F.col("p_partkey").alias("string_idx"), F.col("p_name").alias("string"))


@query(f"SELECT p_partkey AS string_idx, p_name AS string, (SELECT count(*) FROM part WHERE contains(p_name, '{NEEDLE}')) AS total FROM part WHERE contains(p_name, '{NEEDLE}') ORDER BY p_partkey LIMIT 10 OFFSET 5")
def strings_page(t: Tables) -> DataFrame:
    return W.with_total(strings_table(t), ["string_idx"], 5, 10)


@query(f"""WITH s AS (SELECT p_partkey AS string_idx, p_name AS string FROM part WHERE contains(p_name, '{NEEDLE2}') ORDER BY p_partkey LIMIT 10),
 u AS (SELECT DISTINCT string_idx, string, class FROM s LEFT JOIN {SQL_REFS} r ON ref_idx = string_idx)
 SELECT string_idx, string, coalesce(string_agg(class, '; ' ORDER BY class), '') AS used_by FROM u GROUP BY ALL""")
def strings_locations(t: Tables) -> DataFrame:
    page = W.window(t.part.where(N.contains(F.col("p_name"), NEEDLE2)).select(F.col("p_partkey").alias("string_idx"), F.col("p_name").alias("string")), ["string_idx"], 0, 10)
    mine = t.refs().join(F.broadcast(page.select(F.col("string_idx").alias("ref_idx"))), "ref_idx", "left_semi")  # a page of ten
    used = mine.select(F.col("ref_idx").alias("string_idx"), "class").distinct()
    got = page.join(used, "string_idx", "left").groupBy("string_idx", "string").agg(F.array_sort(F.collect_list("class")).alias("used_by"))
    return got.withColumn("used_by", F.array_join("used_by", "; "))


@query(sql_frontier(f"(SELECT class AS key, count(*) AS w FROM {_sql_found(NEEDLE2)} GROUP BY class)", ".", depth=3))
def strings_summary(t: Tables) -> DataFrame:
    return P.frontier(R.sites_by_class(_found(t, NEEDLE2)), "class", F.col("sites"), depth=3).select(*TREE)


# ------------------------------------------------------------------ members
@query(f"SELECT class, kind, seq, member FROM {SQL_MEMBERS} WHERE contains(name, '{NEEDLE}') OR contains(name, 'Supplier')")
def members_full(t: Tables) -> DataFrame:
    m = t.members()
    return m.where(N.contains(F.col("name"), NEEDLE) | N.contains(F.col("name"), "Supplier")).select("class", "kind", "seq", "member")


@query(f"SELECT class, kind, seq, member, (SELECT count(*) FROM {SQL_MEMBERS} WHERE contains(name, '0')) AS total FROM {SQL_MEMBERS} WHERE contains(name, '0') ORDER BY CASE kind WHEN 'method' THEN 0 ELSE 1 END, seq LIMIT 25 OFFSET 10")
def members_page(t: Tables) -> DataFrame:
    rows = t.members().where(N.contains(F.col("name"), "0")).select("class", "kind", "seq", "member")
    return W.with_total(rows, [F.when(F.col("kind") == "method", 0).otherwise(1), "seq"], 10, 25)


@query(f"SELECT class, seq, member FROM {SQL_MEMBERS} WHERE kind = 'field' AND starts_with(class, 'supplier.')")
def members_kind(t: Tables) -> DataFrame:
    return t.members().where((F.col("kind") == "field") & N.under_prefix(F.col("class"), "supplier")).select("class", "seq", "member")


@query(sql_frontier(f"(SELECT class AS key, count(*) AS w FROM {SQL_MEMBERS} GROUP BY class)", "."))
def members_summary(t: Tables) -> DataFrame:
    return P.frontier(t.members(), "class").select(*TREE)


# ------------------------------------------------------------------ paths
@query(sql_frontier(f"(SELECT path AS key, 1 AS w FROM {SQL_PATHS})", "/"))
def path_frontier(t: Tables) -> DataFrame:
    return P.frontier(t.paths(), "path", sep="/").select(*TREE)


@query(sql_frontier(f"(SELECT path AS key, 1 AS w FROM {SQL_PATHS})", "/", depth=2))
def path_fixed_depth(t: Tables) -> DataFrame:
    return P.frontier(t.paths(), "path", sep="/", depth=2).select(*TREE)


@query(sql_frontier(f"(SELECT class AS key, 1 AS w FROM {SQL_CLASSES})", ".", prefix="ASIA", depth=2))
def path_prefix_scope(t: Tables) -> DataFrame:
    return P.frontier(t.classes(), "class", prefix=N.normalize_prefix("ASIA/"), depth=2).select(*TREE)


@query(
    f"""WITH g AS (SELECT * FROM ({sql_frontier(f"(SELECT class AS key, 1 AS w FROM {SQL_CLASSES})", ".", depth=2)}) WHERE kind = 'package'),
 r AS (SELECT g.path, c.class AS sample, row_number() OVER (PARTITION BY g.path ORDER BY string_split(c.class, '.')) AS nr FROM g JOIN {SQL_CLASSES} c ON starts_with(c.class, g.path || '.'))
 SELECT path, sample, CAST(nr AS INT) AS nr FROM r WHERE nr <= 3"""
)
def path_samples(t: Tables) -> DataFrame:
    return P.samples(t.classes(), "class", 3, depth=2)


_SQL_RELATIONS = "(SELECT 'sub' AS relation, n_name || '.' || c_mktsegment || '.' || c_name AS key, 1 AS w FROM " + SQL_CLASSES + " UNION ALL SELECT 'impl', c_mktsegment || '.' || c_name, 1 FROM " + SQL_CLASSES + " WHERE c_custkey % 2 = 0 UNION ALL SELECT 'extends', 'ROOT', 1)"


@query(
    f"""WITH t AS ({sql_frontier(_SQL_RELATIONS, ".", depth=None, by="relation")}),
 r AS (SELECT t.relation, t.path, t.kind, key, row_number() OVER (PARTITION BY t.relation, t.path ORDER BY string_split(key, '.')) AS nr FROM t JOIN {_SQL_RELATIONS} k ON k.relation = t.relation AND (key = t.path OR starts_with(key, t.path || '.')) WHERE kind = 'package'),
 s AS (SELECT relation, path, kind, string_agg(key, '; ' ORDER BY nr) AS samples FROM r WHERE nr <= 4 GROUP BY ALL)
 SELECT relation, path, kind, count, coalesce(samples, '') AS samples FROM t LEFT JOIN s USING (relation, path, kind)"""
)
def hierarchy_samples(t: Tables) -> DataFrame:
    c = t.classes()
    rows = c.select(F.lit("sub").alias("relation"), F.concat_ws(".", "n_name", "c_mktsegment", "c_name").alias("class"))
    rows = rows.union(c.where("c_custkey % 2 = 0").select(F.lit("impl"), F.concat_ws(".", "c_mktsegment", "c_name"))).union(t.region.limit(1).select(F.lit("extends"), F.lit("ROOT")))
    tree = P.frontier(rows, "class", by=["relation"], samples=4)
    return tree.select("relation", *TREE, F.array_join("samples", "; ").alias("samples"))


@query(f"SELECT * FROM ({sql_frontier(f'(SELECT class AS key, 1 AS w FROM {SQL_CLASSES})', '.', depth=2)}) ORDER BY count DESC, path LIMIT 10")
def tree_by_count(t: Tables) -> DataFrame:
    return P.in_order(P.frontier(t.classes(), "class", depth=2), "count").select(*TREE).limit(10)


@query(f"SELECT class, image FROM {SQL_CLASSES} WHERE contains(lower(class), 'nation_1') ORDER BY class_seq LIMIT 50")
def listclasses_pattern(t: Tables) -> DataFrame:
    return W.window(t.classes().where(N.contains_ignoring_case(F.col("class"), "NaTion_1")).select("class", "image", "class_seq"), ["class_seq"], 0, 50).select("class", "image")


@query(sql_frontier(f"(SELECT class AS key, 1 AS w FROM {SQL_CLASSES})", "."))
def listclasses_frontier(t: Tables) -> DataFrame:
    return P.frontier(t.classes(), "class").select(*TREE)


@query(f"SELECT class_seq, class FROM {SQL_CLASSES} ORDER BY class_seq LIMIT 30 OFFSET 100")
def class_page(t: Tables) -> DataFrame:
    return W.window(t.classes().select("class_seq", "class"), ["class_seq"], 100, 30)


@query(f"SELECT path, count(*) AS copies FROM {SQL_PATHS} WHERE contains(path, '1') GROUP BY path")
def entry_lookup(t: Tables) -> DataFrame:
    return J.entry(t.paths().groupBy("path").agg(F.count("*").alias("copies")), "path", "1").select("path", "copies")


# ------------------------------------------------------------------ hierarchy
_SQL_DIRECT = f"""(SELECT 'class' AS relation, n_name AS class FROM nation WHERE n_name = (SELECT min(n_name) FROM nation)
 UNION ALL SELECT 'extends', parent FROM {SQL_EDGES} WHERE child = (SELECT min(n_name) FROM nation)
 UNION ALL SELECT 'sub', child FROM {SQL_EDGES} WHERE parent = (SELECT min(n_name) FROM nation)
 UNION ALL SELECT 'impl', s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name = (SELECT min(n_name) FROM nation))"""


@query(f"SELECT relation, class FROM {_SQL_DIRECT}")
def hierarchy_direct(t: Tables) -> DataFrame:
    none, nations = F.array().cast("array<string>"), t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    kinds = t.classes().select(F.lit("a").alias("dex"), F.col("c_name").alias("class"), F.col("n_name").alias("super"), none.alias("interfaces"))
    above = nations.select(F.lit("a"), "n_name", "r_name", none)
    makers = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.lit("a"), "s_name", F.lit(None).cast("string"), F.array("n_name"))
    first = t.nation.agg(F.min("n_name")).first()[0]  # one row
    return H.direct(kinds.union(above).union(makers), first).select("relation", "class")


@query(sql_frontier("(SELECT 'sub' AS relation, n_name || '.' || c_mktsegment || '.' || c_name AS key, 1 AS w FROM " + SQL_CLASSES + " UNION ALL SELECT 'impl', c_mktsegment || '.' || c_name, 1 FROM " + SQL_CLASSES + ")", ".", depth=2, by="relation"))
def hierarchy_frontier(t: Tables) -> DataFrame:
    c = t.classes()
    rows = c.select(F.lit("sub").alias("relation"), F.concat_ws(".", "n_name", "c_mktsegment", "c_name").alias("class")).union(c.select(F.lit("impl"), F.concat_ws(".", "c_mktsegment", "c_name")))
    return P.frontier(rows, "class", depth=2, by=["relation"]).select("relation", *TREE)


_SQL_CLOSURE = f"""WITH RECURSIVE up(child, ancestor, depth) AS (SELECT child, parent, 1 FROM {SQL_EDGES}
 UNION SELECT up.child, e.parent, up.depth + 1 FROM up JOIN {SQL_EDGES} e ON e.child = up.ancestor WHERE up.depth < 64)"""


@query(f"{_SQL_CLOSURE} SELECT child, ancestor, min(depth) AS depth FROM up GROUP BY ALL")
def hierarchy_closure(t: Tables) -> DataFrame:
    return H.closure(t.edges())


@query(f"{_SQL_CLOSURE} SELECT child AS class, min(depth) AS depth FROM up WHERE ancestor = 'ASIA' GROUP BY ALL")
def subtypes_of(t: Tables) -> DataFrame:
    return H.subtypes(t.edges(), "ASIA")


_SQL_SHAPES = """(SELECT c_name, n_name, c_custkey % 3 AS d1, c_custkey % 4 AS d2, c_custkey % 5 AS k,
 CASE c_custkey % 5 WHEN 0 THEN n_name WHEN 1 THEN r_name WHEN 2 THEN 'ROOT' WHEN 3 THEN 'java/lang/Object' ELSE 'NATION_0' END AS up
 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


@query(f"""SELECT CASE WHEN d1 = 0 THEN c_name ELSE repeat('[', d1) || 'L' || c_name || ';' END AS sub, CASE WHEN d2 = 0 THEN up ELSE repeat('[', d2) || 'L' || up || ';' END AS sup,
 CASE WHEN d1 = d2 THEN k < 4 OR n_name = 'NATION_0' WHEN d1 > d2 THEN k = 3 ELSE false END AS ok FROM {_SQL_SHAPES}""")
def assignable_types(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    up = F.when(k % 5 == 0, F.col("n_name")).when(k % 5 == 1, F.col("r_name")).when(k % 5 == 2, F.lit("ROOT")).when(k % 5 == 3, F.lit("java/lang/Object")).otherwise(F.lit("NATION_0"))
    wrap = lambda name, d: F.when(d == 0, name).otherwise(F.concat(F.rpad(F.lit(""), d, F.lit("[")), F.lit("L"), name, F.lit(";")))
    pairs = t.classes().select(wrap(F.col("c_name"), (k % 3).cast("int")).alias("sub"), wrap(up, (k % 4).cast("int")).alias("sup"))
    return H.assignable(pairs, H.closure(t.edges()))


@query("""SELECT l_orderkey, l_linenumber, p_partkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linestatus = 'O' AND p_size < 20
 AND (p_size % 4 <> l_linenumber % 4 OR l_returnflag NOT IN ('A', 'N'))""")
def final_field_writes(t: Tables) -> DataFrame:
    method = F.when(F.col("l_returnflag") == "A", "<init>").when(F.col("l_returnflag") == "N", "<clinit>").otherwise("run")
    refs = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"), (F.col("l_linenumber") % 4).cast("string").alias("writer"), method.alias("method"), (F.col("l_linestatus") == "O").alias("is_write"))
    fields = t.part.select("p_partkey", (F.col("p_size") % 4).cast("string").alias("owner"), (F.col("p_size") < 20).alias("is_final"))
    return J.outside_writes(refs, fields, ["p_partkey"], "owner", "writer", "method").select("l_orderkey", "l_linenumber", "p_partkey")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS src, l_suppkey AS dst FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
 r(name, round) AS (SELECT 1::BIGINT, 0 UNION SELECT dst, round + 1 FROM r JOIN e ON e.src = r.name WHERE round < 3)
 SELECT name, min(round) AS round FROM r GROUP BY name""")
def dependency_closure(t: Tables) -> DataFrame:
    edges = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()
    start = t.spark.createDataFrame([(1,)], "name long")
    return H.reachable(start, edges, 3)


# ------------------------------------------------------------------ top-k, dedup, joins
@query("SELECT o_orderkey AS method, CAST(round(o_totalprice) AS BIGINT) AS size FROM orders ORDER BY size DESC, o_orderkey LIMIT 20")
def largest_topn(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_orderkey").alias("method"), F.round("o_totalprice").cast("long").alias("size"))
    return W.largest(rows, "size", ["method"], 20)


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies, md5(text) AS digest FROM documents GROUP BY text")
def first_wins(t: Tables) -> DataFrame:
    copies = t.documents.groupBy("text").agg(F.count("*").alias("copies"), F.min_by("doc_id", "doc_id").alias("doc_id"))
    return copies.select("doc_id", "copies", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("""SELECT doc_id, source, lang FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1""")
def first_definition_rows(t: Tables) -> DataFrame:
    return J.first_wins(t.documents.select("doc_id", "source", "lang", "text"), "text", ["doc_id"]).select("doc_id", "source", "lang")


@query("""WITH d AS (SELECT text, source, min(doc_id) AS o FROM documents GROUP BY ALL)
 SELECT md5(text) AS name, count(*) AS n, string_agg(source, '; ' ORDER BY o) AS images, arg_min(source, o) AS first FROM d GROUP BY text HAVING count(*) > 1""")
def defining_images(t: Tables) -> DataFrame:
    got = J.defining(t.documents.select("text", "source", "doc_id"), "text", "source", "doc_id").where("n > 1")
    return got.select(F.md5(F.col("text").cast("binary")).alias("name"), F.col("n").cast("long").alias("n"), F.array_join("images", "; ").alias("images"), "first")


@query("""SELECT c_name AS launcher, coalesce((SELECT min(o_orderpriority) FROM orders WHERE o_custkey = c_custkey), '-') AS dex FROM customer""")
def missing_launcher(t: Tables) -> DataFrame:
    want = t.customer.select("c_custkey", F.col("c_name").alias("launcher"))
    have = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    return J.located(want, have, "c_custkey", "o_orderpriority").select("launcher", "dex")


@query("""SELECT o_orderkey AS candidate FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')""")
def anti_family(t: Tables) -> DataFrame:
    refs = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag")
    return J.all_inside(t.orders, refs, "o_orderkey", F.col("l_returnflag") == "R").select(F.col("o_orderkey").alias("candidate"))


@query("""SELECT c.n_regionkey AS source, s.n_regionkey AS target, count(*) AS refs FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
 JOIN nation c ON c_nationkey = c.n_nationkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation s ON s_nationkey = s.n_nationkey WHERE c.n_regionkey <> s.n_regionkey GROUP BY ALL""")
def cross_package(t: Tables) -> DataFrame:
    n = t.nation.select("n_nationkey", "n_regionkey")
    cust = t.customer.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_regionkey").alias("source"))
    supp = t.supplier.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_regionkey").alias("target"))
    rows = t.lineitem.select("l_orderkey", "l_suppkey").join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(cust, F.col("o_custkey") == F.col("c_custkey")).join(supp, F.col("l_suppkey") == F.col("s_suppkey"))
    return J.crossing(rows, F.col("source"), F.col("target")).groupBy("source", "target").agg(F.count("*").alias("refs"))


@query("""WITH d AS (SELECT p_brand, p_size, min(p_name) AS constant FROM part GROUP BY ALL HAVING count(*) = 1)
 SELECT p_partkey, constant FROM part LEFT JOIN d USING (p_brand, p_size)""")
def unique_constant_lookup(t: Tables) -> DataFrame:
    rows, domain = t.part.select("p_partkey", "p_brand", "p_size"), t.part.select("p_brand", "p_size", F.col("p_name").alias("constant"))
    return J.unique_value(rows, domain, ["p_brand"], "p_size", "constant").select("p_partkey", "constant")


_SQL_CASES = "(SELECT r_name AS path FROM region UNION ALL SELECT lower(r_name) FROM region WHERE r_regionkey < 3 UNION ALL SELECT n_name FROM nation)"


@query(f"SELECT lower(path) AS folded, count(DISTINCT path) AS n, string_agg(DISTINCT path, '; ' ORDER BY path) AS paths FROM {_SQL_CASES} GROUP BY 1 HAVING count(DISTINCT path) > 1")
def case_collisions(t: Tables) -> DataFrame:
    p = t.region.select(F.col("r_name").alias("path")).union(t.region.where("r_regionkey < 3").select(F.lower("r_name"))).union(t.nation.select("n_name"))
    return J.case_collisions(p, "path").withColumn("paths", F.array_join("paths", "; "))


_SQL_NEST = "(SELECT p_brand AS name FROM part UNION SELECT p_brand || '$' || p_size FROM part WHERE p_size < 10 UNION SELECT 'X$' || p_size FROM part)"


@query(f"WITH n AS (SELECT * FROM {_SQL_NEST}) SELECT a.name, b.name AS outer FROM n a LEFT JOIN n b ON b.name = regexp_extract(a.name, '^(.*)\\$[^$]*$', 1) AND contains(a.name, '$')")
def nesting(t: Tables) -> DataFrame:
    return J.nesting(_nested(t), "name")


def _nested(t: Tables) -> DataFrame:
    p = t.part
    return p.select(F.col("p_brand").alias("name")).union(p.where("p_size < 10").select(F.concat("p_brand", F.lit("$"), F.col("p_size").cast("string")))).union(p.select(F.concat(F.lit("X$"), F.col("p_size").cast("string")))).distinct()


@query(f"WITH n AS (SELECT * FROM {_SQL_NEST}) SELECT name FROM n a WHERE NOT contains(name, '$') OR NOT EXISTS (SELECT 1 FROM n b WHERE b.name = regexp_extract(a.name, '^(.*)\\$[^$]*$', 1))")
def top_level_classes(t: Tables) -> DataFrame:
    return J.top_level(J.nesting(_nested(t), "name"))


@query("SELECT s_name, coalesce(n_name, CAST(s_nationkey AS VARCHAR)) AS label FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON s_nationkey = n_nationkey")
def label_join(t: Tables) -> DataFrame:
    res = t.nation.where("n_regionkey < 3")
    return J.labelled(t.supplier.select("s_name", "s_nationkey"), "s_nationkey", res, "n_nationkey", "n_name").select("s_name", "label")


@query("SELECT p_brand AS owner, string_agg(DISTINCT p_type, '; ' ORDER BY p_type) AS signatures FROM part GROUP BY 1")
def signatures_by_owner(t: Tables) -> DataFrame:
    return R.signatures(t.part.withColumnRenamed("p_brand", "owner"), "owner", "p_type").withColumn("signatures", F.array_join("signatures", "; "))


# ------------------------------------------------------------------ nesting, closures, access, names
#: Names that nest by their text, and what some say instead: a class that exists elsewhere, one that does not, itself.
_SQL_FOREST = """n AS (SELECT p_brand AS name FROM part UNION SELECT p_brand || '$' || p_size FROM part WHERE p_size < 10 UNION SELECT p_brand || '$' || p_size || '$' || (p_partkey % 7) || 'T' FROM part WHERE p_partkey % 3 = 0
  UNION SELECT p_brand || '$' || p_size || '$T' || (p_partkey % 7) FROM part WHERE p_partkey % 3 = 1 UNION SELECT 'X$' || p_size FROM part),
 e AS (SELECT p_brand || '$' || p_size || '$T' || (p_partkey % 7) AS name, 'X$' || p_size AS "outer" FROM part WHERE p_partkey % 3 = 1 AND p_size % 2 = 0 UNION SELECT 'X$' || p_size, 'Gone' FROM part WHERE p_size % 3 = 0
  UNION SELECT 'X$' || p_size, (SELECT min(p_brand) FROM part) FROM part WHERE p_size % 3 = 1 UNION SELECT p_brand, p_brand FROM part),
 s AS (SELECT e.name, min(e."outer") AS said FROM e JOIN n ON n.name = e."outer" WHERE e.name <> e."outer" GROUP BY e.name),
 h AS (SELECT a.name, max_by(b.name, length(b.name)) AS named FROM n a JOIN n b ON starts_with(a.name, b.name || '$') GROUP BY a.name),
 o AS (SELECT n.name, coalesce(said, named) AS "outer", CASE WHEN said IS NOT NULL THEN 'said' WHEN named IS NOT NULL THEN 'named' END AS how FROM n LEFT JOIN s USING (name) LEFT JOIN h USING (name)),
 f AS (SELECT name, "outer", how, name AS root, 0 AS depth, name AS unit FROM o WHERE "outer" IS NULL UNION ALL
  SELECT o.name, o."outer", o.how, f.root, f.depth + 1, CASE WHEN starts_with(o.name, o."outer" || '$') AND NOT regexp_matches(o.name[length(o."outer") + 2:], '(^|[$])[0-9][^$]*$') THEN f.unit ELSE o.name END FROM o JOIN f ON o."outer" = f.name)"""


def _forest(t: Tables) -> DataFrame:
    p, k = t.part, F.col("p_partkey")
    join = lambda *c: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in c])
    brand, size, seven = F.col("p_brand"), F.col("p_size").cast("string"), (k % 7).cast("string")
    other, deep = join("X$", size), join(brand, "$", size, "$T", seven)
    names = p.select(brand.alias("name")).union(p.where("p_size < 10").select(join(brand, "$", size))).union(p.where(k % 3 == 0).select(join(brand, "$", size, "$", seven, "T"))).union(p.where(k % 3 == 1).select(deep)).union(p.select(other))
    said = p.where((k % 3 == 1) & (F.col("p_size") % 2 == 0)).select(deep.alias("name"), other.alias("outer"))
    said = said.union(p.where("p_size % 3 = 0").select(other, F.lit("Gone"))).union(p.select(brand, brand))
    said = said.union(p.where("p_size % 3 = 1").select(other).crossJoin(F.broadcast(p.agg(F.min("p_brand")))))  # one row
    return T.forest(names, said)


@query(f"WITH RECURSIVE {_SQL_FOREST} SELECT name, \"outer\", how, root, depth, unit FROM f")
def nesting_forest(t: Tables) -> DataFrame:
    return _forest(t).select("name", "outer", "how", "root", "depth", "unit")


@query(f"WITH RECURSIVE {_SQL_FOREST} SELECT unit, count(*) AS classes, count(DISTINCT \"outer\") AS outers, max(depth) AS depth FROM f GROUP BY unit")
def nesting_units(t: Tables) -> DataFrame:
    return _forest(t).groupBy("unit").agg(F.count("*").alias("classes"), F.count_distinct("outer").alias("outers"), F.max("depth").alias("depth"))


@query("""WITH RECURSIVE b AS (SELECT DISTINCT 'C' || o_custkey || '$' || o_orderkey AS src, 'P' || l_partkey || '$' || l_linenumber AS dst FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
 u AS (SELECT DISTINCT 'P' || l_partkey AS src, 'S' || l_suppkey AS dst FROM lineitem UNION SELECT 'S' || s_suppkey, 'N' || s_nationkey FROM supplier UNION SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation),
 d AS (SELECT 'P' || p_partkey AS name, p_brand || ' ' || p_size AS image FROM part UNION ALL SELECT 'S' || s_suppkey, 'S' || s_suppkey FROM supplier UNION ALL SELECT 'N' || n_nationkey, 'N' || n_nationkey FROM nation
  UNION ALL SELECT 'R' || r_regionkey, 'R' FROM region UNION ALL SELECT 'C' || o_custkey || '$' || o_orderkey, 'C' FROM orders),
 s AS (SELECT DISTINCT src AS name FROM b WHERE starts_with(src, 'C1$')),
 r(name, round) AS (SELECT name, 0 FROM s UNION SELECT x.name, 1 FROM s JOIN b ON b.src = s.name, unnest([dst, split_part(dst, '$', 1)]) AS x(name)
  UNION SELECT u.dst, r.round + 1 FROM r JOIN u ON u.src = r.name WHERE r.round BETWEEN 1 AND 2)
 SELECT name, image, min(round) AS round FROM r LEFT JOIN d USING (name) GROUP BY name, image""")
def dependency_images(t: Tables) -> DataFrame:
    tag = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    order = F.concat(tag("C", "o_custkey"), F.lit("$"), F.col("o_orderkey").cast("string"))
    lines = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    body = t.orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey")).select(order.alias("src"), F.concat(tag("P", "l_partkey"), tag("$", "l_linenumber")).alias("dst"))
    head = lines.select(tag("P", "l_partkey").alias("src"), tag("S", "l_suppkey").alias("dst")).union(t.supplier.select(tag("S", "s_suppkey"), tag("N", "s_nationkey"))).union(t.nation.select(tag("N", "n_nationkey"), tag("R", "n_regionkey")))
    own = lambda letter, c: (tag(letter, c), tag(letter, c))
    defined = t.part.select(tag("P", "p_partkey").alias("name"), F.concat("p_brand", F.lit(" "), F.col("p_size").cast("string")).alias("image"))
    defined = defined.union(t.supplier.select(*own("S", "s_suppkey"))).union(t.nation.select(*own("N", "n_nationkey"))).union(t.region.select(tag("R", "r_regionkey"), F.lit("R"))).union(t.orders.select(order, F.lit("C")))
    total = defined.select("image").distinct().count()
    return C.closure(C.family(body.select(F.col("src").alias("name")), "C1"), body, head, defined, total).found


@query("""WITH m AS (SELECT 'K' || p_size AS owner, p_partkey AS member, CAST(p_partkey % 4 AS INT) AS declared FROM part),
 r AS (SELECT DISTINCT p_size, p_partkey AS member, l_suppkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE (l_suppkey + p_size) % 5 < p_partkey % 6),
 a AS (SELECT 'K' || p_size AS owner, member, max(CASE WHEN p_size % 17 = l_suppkey % 17 THEN 0 WHEN p_size % 5 = l_suppkey % 5 THEN 1 WHEN l_suppkey % 3 > 0 AND l_suppkey % 7 = p_size % 7 THEN 2 ELSE 3 END) AS level FROM r GROUP BY ALL),
 l AS (SELECT owner, member, declared, coalesce(level, 0) AS level FROM m LEFT JOIN a USING (owner, member))
 SELECT owner, member, ['private', 'package', 'protected', 'public'][declared + 1] AS declared, ['private', 'package', 'protected', 'public'][level + 1] AS needed,
  ['private', 'package', 'protected', 'public'][greatest(declared, level) + 1] AS widened, level > declared AS changed FROM l""")
def access_levels(t: Tables) -> DataFrame:
    p = t.part.select(F.concat(F.lit("K"), F.col("p_size").cast("string")).alias("owner"), F.col("p_partkey").alias("member"), (F.col("p_partkey") % 4).cast("int").alias("declared"), "p_size")
    user = F.concat(F.lit("U"), F.col("l_suppkey").cast("string"))
    rows = t.lineitem.select("l_partkey", "l_suppkey").join(p, F.col("member") == F.col("l_partkey")).where((F.col("l_suppkey") + F.col("p_size")) % 5 < F.col("member") % 6)
    mod = lambda c, n, name: (F.col(c) % n).cast("string").alias(name)
    refs = rows.select("owner", "member", user.alias("user"), mod("p_size", 5, "owner_package"), mod("l_suppkey", 5, "user_package"), mod("p_size", 17, "owner_unit"), mod("l_suppkey", 17, "user_unit"))
    below = t.supplier.where("s_suppkey % 3 > 0").select("s_suppkey").join(p.select("owner", "p_size").distinct(), F.col("s_suppkey") % 7 == F.col("p_size") % 7)
    closed = below.select(F.concat(F.lit("U"), F.col("s_suppkey").cast("string")).alias("child"), F.col("owner").alias("ancestor"))
    return A.levels(p.drop("p_size"), refs, closed)


_SQL_FILES = """n AS (SELECT r_name AS name FROM region UNION SELECT lower(r_name) FROM region UNION SELECT lower(r_name) || '_2' FROM region WHERE r_regionkey < 3 UNION SELECT r_name || '_4' FROM region UNION SELECT substr(r_name, 1, 2) || lower(substr(r_name, 3)) FROM region
  UNION SELECT p_name FROM part UNION SELECT replace(p_name, ' ', '-') FROM part UNION SELECT n_name || '/' || lower(n_name) FROM nation UNION SELECT lower(n_name) || '/' || n_name FROM nation)"""


@query(f"""WITH {_SQL_FILES}, b AS (SELECT name, regexp_replace(name, '[^A-Za-z0-9_$/]', '_', 'g') AS base FROM n), f AS (SELECT *, lower(base) AS fold FROM b),
 r AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY CAST(base <> name AS INT), name) - 1 AS r FROM f),
 h AS (SELECT regexp_replace(fold, '_[1-9][0-9]*$', '') AS fold, list(DISTINCT CAST(regexp_extract(fold, '_([1-9][0-9]*)$', 1) AS INT)) AS taken FROM f WHERE regexp_matches(fold, '_[1-9][0-9]*$') GROUP BY 1)
 SELECT name, CASE WHEN r = 0 THEN base ELSE base || '_' || list_filter(range(2, 50), lambda k: NOT list_contains(coalesce(taken, []), k))[r] END AS path FROM r LEFT JOIN h USING (fold)""")
def unique_paths(t: Tables) -> DataFrame:
    r, name = t.region, F.col("r_name")
    names = r.select(name.alias("name")).union(r.select(F.lower(name))).union(r.where("r_regionkey < 3").select(F.concat(F.lower(name), F.lit("_2")))).union(r.select(F.concat(name, F.lit("_4")))).union(r.select(F.concat(F.substring(name, 1, 2), F.lower(F.substring(name, F.lit(3), F.length(name))))))
    names = names.union(t.part.select("p_name")).union(t.part.select(F.translate("p_name", " ", "-"))).union(t.nation.select(F.concat("n_name", F.lit("/"), F.lower("n_name")))).union(t.nation.select(F.concat(F.lower("n_name"), F.lit("/"), "n_name")))
    return G.unique_paths(names, G.safe_path(F.col("name"), N.JAVA_KEYWORDS))


# ------------------------------------------------------------------ info, scalars
@query("""SELECT source AS image, count(*) AS classes, sum(n_chars)::BIGINT AS strings, count(DISTINCT lang) AS fields, (SELECT count(*) FROM documents) AS total_classes FROM documents GROUP BY source""")
def info_counts(t: Tables) -> DataFrame:
    return J.image_counts(t.documents, "source", {"strings": F.sum("n_chars"), "fields": F.count_distinct("lang")})


@query("""WITH s AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) * power(7, doc_id % 9) AS BIGINT) AS n FROM documents)
 SELECT doc_id, n, CASE WHEN n >= 1073741824 THEN printf('%.1f GB', n / 1073741824.0::DOUBLE) WHEN n >= 1048576 THEN printf('%.1f MB', n / 1048576.0::DOUBLE) WHEN n >= 1024 THEN printf('%.1f KB', n / 1024.0::DOUBLE) ELSE n || ' B' END AS size FROM s""")
def entry_sizes(t: Tables) -> DataFrame:
    n = (F.octet_length(F.coalesce("text", F.lit(""))) * F.pow(F.lit(7), F.col("doc_id") % 9)).cast("long")
    return t.documents.select("doc_id", n.alias("n")).withColumn("size", N.human_size(F.col("n")))


@query("""SELECT p_partkey, 'L' || replace(p_brand, '#', '/') || ';' AS descriptor, replace(replace(p_brand, '#', '/'), '/', '.') AS dotted,
 'L' || replace(p_brand, '#', '/') || ';->' || p_name || '(' || 'I' || 'J' || ')V' AS member FROM part""")
def descriptor_render(t: Tables) -> DataFrame:
    d = F.concat(F.lit("L"), F.replace(F.col("p_brand"), F.lit("#"), F.lit("/")), F.lit(";"))
    member = N.method_ref(d, F.col("p_name"), N.proto(F.array(F.lit("I"), F.lit("J")), F.lit("V")))
    return t.part.select("p_partkey", d.alias("descriptor"), N.dotted(N.class_name(d)).alias("dotted"), member.alias("member"))


@query("""SELECT item_id, '"' || replace(replace(replace(replace(replace(text, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t') || '"' AS quoted FROM benchmark""")
def quote_string(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", N.quoted(F.col("text")).alias("quoted"))


@query(f"SELECT class, image FROM {SQL_CLASSES} WHERE starts_with(class, 'ASIA.NATION_2.')")
def prefix_normalize(t: Tables) -> DataFrame:
    return t.classes().where(N.under_prefix(F.col("class"), N.normalize_prefix(" ASIA/NATION_2/ "))).select("class", "image")


@query("""SELECT n_name, CASE WHEN starts_with(x, '.') THEN 'com.app' || x WHEN contains(x, '.') THEN x ELSE 'com.app.' || x END AS resolved
 FROM (SELECT n_name, CASE n_nationkey % 3 WHEN 0 THEN '.' || n_name WHEN 1 THEN n_name ELSE 'org.x.' || n_name END AS x FROM nation)""")
def relative_names(t: Tables) -> DataFrame:
    k = F.col("n_nationkey") % 3
    x = F.when(k == 0, F.concat(F.lit("."), "n_name")).when(k == 1, F.col("n_name")).otherwise(F.concat(F.lit("org.x."), "n_name"))
    return t.nation.select("n_name", N.resolve_name(F.lit("com.app"), x).alias("resolved"))


@query("""WITH u AS (SELECT user_id, min(ts) AS ts, min(event_id) AS event_id, count(*) AS events FROM events GROUP BY user_id HAVING bool_or(event_type = 'click') AND bool_or(event_type = 'purchase'))
 SELECT user_id, event_id, events FROM u""")
def launcher_facts(t: Tables) -> DataFrame:
    has = lambda x: F.bool_or(F.col("event_type") == x)
    got = t.events.groupBy("user_id").agg(F.min("event_id").alias("event_id"), F.count("*").alias("events"), has("click").alias("a"), has("purchase").alias("b"))
    return got.where("a and b").select("user_id", "event_id", "events")


@query("SELECT doc_id, md5(text) AS md5, length(text) AS chars, (n_chars & 7) AS flags FROM documents")
def digests(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", N.digest(F.col("text")).alias("md5"), F.length("text").cast("long").alias("chars"), N.flags(F.col("n_chars"), 7).alias("flags"))


@query("""SELECT rpad(x.dex, CAST(greatest(10, length(x.dex)) AS INT), ' ') || '  ' || rpad(x.kind, CAST(greatest(12, length(x.kind)) AS INT), ' ') || '  ' || x.class || ' ' || x.method || '  ' || x.refs AS line
 FROM (SELECT dex, kind, class, CAST(method AS VARCHAR) AS method, refs FROM (""" + _sql_methods(_sql_found(NEEDLE)) + ")) x")
def findrefs_lines(t: Tables) -> DataFrame:
    return V.lines(R.by_method(_found(t), ["pc", "ref_idx", "kind"]), "findrefs")


@query("SELECT s_name FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) EXCEPT SELECT s_name FROM supplier WHERE s_acctbal < 0")
def set_difference(t: Tables) -> DataFrame:
    inside = t.supplier.join(t.nation.where("n_regionkey = 1"), F.col("s_nationkey") == F.col("n_nationkey"), "left_semi")
    return J.without(inside, t.supplier.where("s_acctbal < 0"), ["s_name"])
