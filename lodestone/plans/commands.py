"""The query commands over artifacts, each a DataFrame; only pages come to the driver.

A command composes the operators over the tables of `Artifacts`.  Options follow one rule each:
--dex filters ignore case; `full` wins over the view options; views need a summary.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
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
from ..operators.rounds import settled
from ..sources import archive, axml
from ..sources.artifact import FILE_TABLES, Artifacts
from ..sources.tree import write_tree

KINDS = ("string", "type", "field", "method")
SHORT = {"string": "const-string", "type": "type", "field": "field", "method": "invoke"}


METHOD = ["image_seq", "image", "class", "method"]  # entries of different archives have the same names


class NotFound(LookupError):
    """What was asked for is not in the input."""

    exit_code, status = 2, 404


class BadQuery(ValueError):
    """The question itself is wrong."""

    exit_code, status = 1, 400


def outcome(error: Exception) -> tuple[int, int]:
    """(exit code, HTTP status) of an error."""
    return getattr(error, "exit_code", 1), getattr(error, "status", 500)


@dataclass
class View:
    """How a tree is shown."""

    prefix: str = ""
    depth: int | None = None
    sort: str = "name"
    samples: int = 0
    sep: str = "."

    def of(self, rows: DataFrame, key: str, weight=None, by: list[str] | None = None) -> DataFrame:
        if self.sort not in ("name", "count"):
            raise BadQuery(f"unknown sort {self.sort}")
        prefix = N.normalize_prefix(self.prefix, self.sep) if self.prefix else ""
        return P.frontier(rows, key, weight, self.sep, prefix, self.depth, by, self.samples)


@dataclass
class Session:
    """Artifacts below a path, with the images that `dex` names."""

    spark: SparkSession
    path: str
    dex: list[str] = field(default_factory=list)

    def __post_init__(self):
        self.a = Artifacts(self.spark, self.path, self.dex)
        self._checked = False

    def t(self, name: str, *columns: str) -> DataFrame:
        """A table, or some of its columns; the first one of images checks that there are any."""
        if name not in FILE_TABLES and not self._checked:
            self._checked = True
            self.check()
        return self.a.table(name, list(columns) or None)

    def images(self) -> DataFrame:
        """image_seq and dex, the part of the label after the last `!`."""
        return self.t("images", "image_seq", "label").select("image_seq", F.substring_index("label", "!", -1).alias("dex"), "label")

    def check(self) -> None:
        """Fails if no image is left: none there, none that decodes, or none that --dex names."""
        if self.a.table("images", ["image_seq"]).isEmpty():
            bad = self.a.failures("images").orderBy("image_seq").limit(20).collect()
            if bad:
                raise NotFound("no image decodes: " + "; ".join(f"{r.label}: {r.reason}" for r in bad))
            labels = [r.label for r in Artifacts(self.spark, self.path).images_raw().select("label").orderBy("image_seq").limit(20).collect()]
            raise NotFound(f"no image matches; there are: {', '.join(labels) or 'none'}")

    # ------------------------------------------------------------ classes
    def classes(self) -> DataFrame:
        """image_seq, class_seq, class, dex: of every name its first definition."""
        rows = self.t("class_defs", "image_seq", "class_seq", "class").join(self.images().select("image_seq", "dex"), "image_seq")
        return J.first_wins(rows, "class", ["image_seq", "class_seq"])

    def listclasses(self, pattern: str = "", full: bool = False, view: View | None = None, offset: int = 0, limit: int = 0) -> DataFrame:
        view = view or View()
        rows = self.classes().withColumn("name", N.dotted(F.col("class")))
        rows = rows.where(N.contains_ignoring_case(F.col("name"), pattern)) if pattern else rows
        if full:
            rows = rows.where(N.under_prefix(F.col("name"), N.normalize_prefix(view.prefix)))
            return W.window(rows.select("name", "dex", "image_seq", "class_seq"), ["image_seq", "class_seq"], offset, limit).select(F.col("name").alias("class"), "dex")
        return self._tree(view.of(rows, "name"), view, offset, limit, "classes")

    def _tree(self, tree: DataFrame, view: View, offset: int, limit: int, count: str = "count", by: list[str] | None = None) -> DataFrame:
        by = by or []
        keys = [*by, "segs", "rank"] if view.sort == "name" else [*by, F.desc("count"), "path", "rank"]
        more = ["samples"] if view.samples else []
        return W.window(tree, keys, offset, limit).select(*by, "path", "kind", F.col("count").alias(count), *more)

    # ------------------------------------------------------------ references
    def refs(self) -> DataFrame:
        """Every reference of every method: image, class, method, pc, kind, ref_kind, ref_idx."""
        m = self.t("encoded_methods", "image_seq", "class_seq", "method_seq", "method_idx")
        names = self.t("method_ids").select("image_seq", "method_idx", "class", F.concat("name", "proto").alias("method"))
        owner = m.join(names, ["image_seq", "method_idx"]).join(self.images().select("image_seq", "dex"), "image_seq")
        rows = self.t("refs", "image_seq", "class_seq", "method_seq", "pc", "mnemonic", "ref_kind", "ref_idx").join(owner, ["image_seq", "class_seq", "method_seq"])
        kind = F.when(F.col("mnemonic").startswith("invoke"), "invoke").otherwise(F.col("mnemonic"))
        return rows.select(F.col("dex").alias("image"), "image_seq", "class", "method", "pc", kind.alias("kind"), "ref_kind", "ref_idx")

    def targets(self, kind: str, text: str, owner: str | None = None, fuzzy: bool = False) -> DataFrame:
        """image_seq, ref_kind, ref_idx, target of the dictionary entries that match; an empty string query matches nothing."""
        if kind not in KINDS:
            raise BadQuery(f"unknown kind {kind}; one of {', '.join(KINDS)}")
        keys = ["image_seq", "ref_kind", "ref_idx"]
        if kind == "string":
            rows = self.t("strings").withColumn("ref_kind", F.lit("string")).withColumn("ref_idx", F.col("string_idx"))
            hit = N.contains(F.col("value"), text) if text else F.lit(False)
            return R.targets(rows, hit, keys, N.quoted(F.col("value")))
        if kind == "type":
            rows = self.t("types").withColumn("ref_kind", F.lit("type")).withColumn("ref_idx", F.col("type_idx"))
            return R.targets(rows, F.col("descriptor") == N.normalize_type(text), keys, F.col("descriptor"))
        cls = F.concat(F.lit("L"), "class", F.lit(";"))
        if kind == "method":
            rows = self.t("method_ids").withColumn("ref_kind", F.lit("method")).withColumn("ref_idx", F.col("method_idx"))
            shown = N.method_ref(cls, F.col("name"), F.col("proto"))
        else:
            rows = self.t("field_ids").withColumn("ref_kind", F.lit("field")).withColumn("ref_idx", F.col("field_idx"))
            shown = N.field_ref(cls, F.col("name"), F.col("type"))
        return R.targets(rows, N.contains(F.col("name"), text) & N.owner_is(F.col("class"), owner, fuzzy), keys, shown)

    def findrefs(self, kind: str, text: str, owner: str | None = None, fuzzy: bool = False, full: bool = False, view: View | None = None, offset: int = 0, limit: int = 0) -> DataFrame:
        view = view or View()
        found = R.hits(self.refs(), self.targets(kind, text, owner, fuzzy), ["image_seq", "ref_kind", "ref_idx"])
        found = found.withColumn("class", N.dotted(F.col("class")))
        if full:
            rows = R.by_method(found.where(N.under_prefix(F.col("class"), N.normalize_prefix(view.prefix))), ["pc", "ref_idx"], METHOD)
            return W.window(rows, ["class", "method", "dex"], offset, limit)
        return self._tree(view.of(R.by_class(found, METHOD), "class", F.col("methods")), view, offset, limit)

    def callers(self, name: str, owner: str | None = None, **options) -> DataFrame:
        return self.findrefs("method", name, owner, **options)

    # ------------------------------------------------------------ strings, members
    def strings(self, filter: str = "", locations: bool = False, summary: bool = False, view: View | None = None, offset: int = 0, limit: int = 0) -> DataFrame:
        if view and not summary:
            raise BadQuery("view options need summary")
        rows = self.t("strings").where(N.contains(F.col("value"), filter)).join(self.images().select("image_seq", "dex"), "image_seq")
        if summary:
            view = view or View()
            want = rows.select("image_seq", F.lit("string").alias("ref_kind"), F.col("string_idx").alias("ref_idx"), F.col("value").alias("target"))
            found = R.hits(self.refs(), want, ["image_seq", "ref_kind", "ref_idx"]).withColumn("class", N.dotted(F.col("class")))
            return self._tree(view.of(R.sites_by_class(found), "class", F.col("sites")), view, offset, limit)
        page = W.window(rows.select("image_seq", "string_idx", "dex", F.col("value").alias("string")), ["image_seq", "string_idx"], offset, limit)
        if not locations:
            return page.select("dex", "string")
        page = settled(page)
        mine = page.select("image_seq", F.col("string_idx").alias("ref_idx"))
        asked = self.refs().where("ref_kind = 'string'").join(F.broadcast(mine) if 0 < limit <= 10_000 else mine, ["image_seq", "ref_idx"], "left_semi")
        used = asked.select("image_seq", F.col("ref_idx").alias("string_idx"), F.concat(N.dotted(F.col("class")), F.lit("."), "method").alias("u")).distinct()
        got = page.join(used, ["image_seq", "string_idx"], "left").groupBy("image_seq", "string_idx", "dex", "string").agg(F.array_sort(F.collect_list("u")).alias("used_by"))
        return got.orderBy("image_seq", "string_idx").select("dex", "string", "used_by")

    def members(self, name: str, owner: str | None = None, fuzzy: bool = False, kind: str | None = None, full: bool = False, view: View | None = None, offset: int = 0, limit: int = 0) -> DataFrame:
        m = self.t("method_ids").select("image_seq", F.lit("method").alias("kind"), F.lit(0).alias("r"), F.col("method_idx").alias("idx"), "class", "name", F.concat("name", "proto").alias("member"))
        f = self.t("field_ids").select("image_seq", F.lit("field").alias("kind"), F.lit(1).alias("r"), F.col("field_idx").alias("idx"), "class", "name", F.concat("name", F.lit(" "), "type").alias("member"))
        rows = m.unionByName(f).where(N.contains(F.col("name"), name) & N.owner_is(F.col("class"), owner, fuzzy))
        rows = rows.where(F.col("kind") == kind) if kind else rows
        rows = rows.join(self.images().select("image_seq", "dex"), "image_seq").withColumn("class", N.dotted(F.col("class")))
        view = view or View()
        if full:
            return W.window(rows.where(N.under_prefix(F.col("class"), N.normalize_prefix(view.prefix))), ["image_seq", "r", "idx"], offset, limit).select("dex", "kind", "class", "member")
        return self._tree(view.of(rows, "class"), view, offset, limit)

    # ------------------------------------------------------------ hierarchy, size, listing
    def hierarchy(self, name: str, full: bool = False, view: View | None = None, offset: int = 0, limit: int = 0) -> DataFrame:
        want = N.class_literal(name)
        if self.t("types").where(F.col("descriptor") == f"L{want};").limit(1).count() == 0:
            raise NotFound(f"class {name} is in no image")
        rows = self.t("class_defs").join(self.images().select("image_seq", "dex"), "image_seq")
        rel = H.direct(rows.select("dex", "class", "super", "interfaces"), want)
        shown = F.when(F.col("relation").isin("extends", "implements"), F.concat(F.lit("L"), "class", F.lit(";"))).otherwise(F.col("class"))
        if full:
            return W.window(rel.withColumn("class", shown), [H.relation_rank(), "class", "dex"], offset, limit)
        view = view or View()
        tree = view.of(rel.withColumn("class", N.dotted(F.col("class"))), "class", by=["relation"]).withColumn("o", H.relation_rank())
        keys = ["o", "path", "rank"] if view.sort == "name" else [F.desc("count"), "path", "o", "rank"]
        return W.window(tree, keys, offset, limit).select("relation", "path", "kind", "count", *(["samples"] if view.samples else []))

    def edges(self) -> DataFrame:
        """child, parent over supers and interfaces."""
        c = self.t("class_defs", "class", "super", "interfaces")
        return c.where(F.col("super").isNotNull()).select(F.col("class").alias("child"), F.col("super").alias("parent")).union(c.select("class", F.explode("interfaces")))

    def subtypes(self, name: str) -> DataFrame:
        return H.subtypes(self.edges(), N.class_literal(name))

    def largest(self, n: int = 20) -> DataFrame:
        """The methods of most code units."""
        names = self.t("method_ids").select("image_seq", "method_idx", "class", F.concat("name", "proto").alias("method"))
        rows = self.t("encoded_methods").where("insns_size > 0").join(names, ["image_seq", "method_idx"]).join(self.images().select("image_seq", "dex"), "image_seq")
        return W.largest(rows, "insns_size", ["image_seq", "class_seq", "method_seq"], n).select(F.col("insns_size").alias("units"), "dex", N.dotted(F.col("class")).alias("class"), "method")

    def disasm(self, target: str) -> DataFrame:
        """class, method, pc, mnemonic, operands of a class, or of its methods named by what follows the last dot."""
        known = self.t("class_defs", "class")
        head = target.split("(")[0]
        whole = N.class_literal(head)
        method = None
        if "(" in target or known.where(F.col("class") == whole).limit(1).count() == 0:
            whole, _, name = head.replace("/", ".").rpartition(".")
            whole, method = whole.replace(".", "/"), name + target[len(head) :]
            if known.where(F.col("class") == whole).limit(1).count() == 0:
                raise NotFound(f"no class for {target}")
        names = self.t("method_ids").select("image_seq", "method_idx", "class", F.concat("name", "proto").alias("method"))
        rows = self.t("encoded_methods", "image_seq", "class_seq", "method_seq", "method_idx").join(names.where(F.col("class") == whole), ["image_seq", "method_idx"])
        if method:
            rows = rows.where(F.col("method") == method if "(" in method else F.col("method").startswith(method))
        ins = self.t("instructions").join(rows, ["image_seq", "class_seq", "method_seq"])
        order = ["image_seq", "class_seq", "method_seq", "pc"]
        return ins.orderBy(*order).select(N.dotted(F.col("class")).alias("class"), "method", (F.col("pc") * 2).alias("offset"), "mnemonic", "operands")

    # ------------------------------------------------------------ context
    def facts(self) -> dict:
        """Package, version, application, launcher and sdk of the manifest."""
        every = self.t("manifest_elements")
        first = every.agg(F.min("input")).first()[0]
        if first is None:
            raise NotFound("no manifest")
        get = lambda r, k: r.attrs.get(f"android:{k}", r.attrs.get(k))
        rows = every.where(F.col("input") == first).orderBy("nr").collect()  # one document
        root = rows[0]
        pkg = root.attrs.get("package", "")
        out = {"package": pkg, "version": get(root, "versionName"), "version_code": get(root, "versionCode"), "application": None, "label": None, "launcher": None, "min_sdk": None, "target_sdk": None}
        by_nr = {r.nr: r for r in rows}

        def within(r, element):
            while r.parent is not None:
                r = by_nr[r.parent]
                if r.element == element:
                    return r
            return None

        seen: dict[int, set[str]] = {}
        for r in rows:
            if r.element == "uses-sdk":
                out |= {"min_sdk": get(r, "minSdkVersion"), "target_sdk": get(r, "targetSdkVersion")}
            elif r.element == "application":
                name = get(r, "name")
                out |= {"application": resolve(pkg, name) if name else None, "label": self.label(get(r, "label"))}
            elif r.element in ("action", "category") and (f := within(r, "intent-filter")) and (a := within(r, "activity") or within(r, "activity-alias")):
                names = seen.setdefault(f.nr, set())
                names.add(get(r, "name"))
                if {"android.intent.action.MAIN", "android.intent.category.LAUNCHER"} <= names and out["launcher"] is None:
                    out["launcher"] = resolve(pkg, get(a, "targetActivity") or get(a, "name"))
        return out

    def label(self, text: str | None) -> str | None:
        if not text or not text.startswith("@0x"):
            return text
        n = int(text[3:], 16)
        row = self.t("resources").where((F.col("pkg") == n >> 24) & (F.col("type") == (n >> 16 & 255)) & (F.col("entry") == (n & 0xFFFF))).first()
        return row.value if row else text

    def info(self, offset: int = 0, limit: int = W.DEFAULT_CAP) -> dict:
        """Facts of the manifest, totals, and a page of the images; next_offset says that there are more."""
        per = self.t("images", "image_seq", "label", "dex_version", "classes", "methods", "fields", "strings").orderBy("image_seq")  # headers alone
        total = per.agg(F.count("*").alias("n"), F.sum("classes").alias("c")).first()
        try:
            facts = self.facts()
        except NotFound:
            facts = {}
        page = W.fetch(per.select("image_seq", "label", "dex_version", "classes", "methods", "fields", "strings"), ["image_seq"], offset, limit)
        images = [{k: v for k, v in r.asDict().items() if k != "image_seq"} for r in page.rows]
        return facts | {"images": images, "total_images": total.n, "total_classes": total.c or 0, "next_offset": page.next_offset}

    def mainactivity(self) -> dict:
        f = self.facts()
        want = (f["launcher"] or "").replace(".", "/")
        row = self.classes().where(F.col("class") == want).select("dex").first() if want else None
        return {"package": f["package"], "application": f["application"], "launcher": f["launcher"], "dex": row.dex if row else "-"}

    def _bytes(self, name: str) -> bytes:
        """The member of that name of the first input that has one."""

        def find(batches):
            for b in batches:
                for path, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                    got = data if name == "AndroidManifest.xml" and data[:2] == b"\x03\x00" else archive.member(path, data, name)
                    if got:
                        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([got], pa.binary())], ["path", "data"])

        row = self.a.files.mapInArrow(find, "path string, data binary").orderBy("path").first()
        if row is None:
            raise NotFound(f"no {name}")
        return bytes(row.data)

    def manifest(self, component: str | None = None) -> str | DataFrame:
        """The manifest as text, or the elements of one kind (plural or singular; launcher: the activity that starts)."""
        if component is None:
            return axml.to_xml(self._bytes("AndroidManifest.xml"))
        plural = {"activities": "activity", "activity-aliases": "activity-alias"} | {f"{k}s": k for k in ("service", "receiver", "provider", "permission", "application", "launcher")}
        kind = plural.get(component, component)
        known = {"activity": "activity", "activity-alias": "activity-alias", "service": "service", "receiver": "receiver", "provider": "provider", "application": "application", "permission": "uses-permission", "launcher": "activity"}
        if kind not in known:
            raise BadQuery(f"unknown component {component}; one of {', '.join(known)}")
        rows = self.t("manifest_elements").where(F.col("element") == known[kind])
        if kind == "launcher":
            f = self.facts()
            name = F.coalesce(F.col("attrs")["android:name"], F.col("attrs")["name"])
            rows = rows.where(N.resolve_name(F.lit(f["package"]), name) == (f["launcher"] or ""))
        return rows.orderBy("input", "nr")

    def res(self, name: str | None = None, view: View | None = None, full: bool = False, offset: int = 0, limit: int = 0) -> DataFrame:
        rows = self.t("archive_entries")
        if name is None:
            if full:
                return W.window(rows, ["container", "name"], offset, limit)
            view = view or View(sep="/")
            return self._tree(view.of(rows, "name"), view, offset, limit)
        return J.entry(rows, "name", name).drop("exact")

    def dump(self, name: str) -> bytes | str:
        """The one entry that a text names; binary XML as text."""
        got = self.res(name).limit(6).collect()
        if not got:
            raise NotFound(f"no entry {name}")
        if len(got) > 1:
            raise BadQuery("ambiguous: " + ", ".join(r.name for r in got[:5]))
        row = self.a.files.where(F.col("path").endswith("/" + got[0].container)).first()
        data = archive.read_entry(bytes(row.content), got[0].name)
        return axml.to_xml(data) if data[:2] == b"\x03\x00" else data

    # ------------------------------------------------------------ source outlines
    def getclass(self, name: str, dependencies: bool = False) -> DataFrame:
        """class, dex, images, source: declarations with bodies as listings (no statement recovery).
        dependencies: also the names it needs that some image defines, in order."""
        from .outline import outlines

        want = N.class_literal(name)
        rows = J.defining(self.t("class_defs", "image_seq", "class").join(self.images().select("image_seq", "dex"), "image_seq"), "class", "dex", "image_seq").where(F.col("class") == want)
        src = outlines(self.a.images_raw(), [want], None)
        out = src.join(rows.select("class", "images", F.col("first").alias("dex")), "class").select(N.dotted(F.col("class")).alias("class"), "dex", "images", "source")
        if not dependencies:
            return out
        needs = self.dependencies(name).found.where("round > 0 and image is not null")
        return out.crossJoin(F.broadcast(needs.agg(F.array_sort(F.collect_list(N.dotted(F.col("name")))).alias("dependencies"))))  # one row: what one class needs

    def dependencies(self, name: str, rounds: int = 3) -> C.Closure:
        """What a class and those nested in it need, and the images that hold it."""
        want = N.class_literal(name)
        defs = settled(self.t("class_defs", "image_seq", "class_seq", "class", "super", "interfaces"))
        defined = defs.groupBy(F.col("class").alias("name")).agg(F.min("image_seq").alias("image"))
        head = defs.where(F.col("super").isNotNull()).select(F.col("class").alias("src"), F.col("super").alias("dst")).union(defs.select("class", F.explode("interfaces")))
        family = settled(C.family(defs.select(F.col("class").alias("name")), want))
        if family.isEmpty():
            raise NotFound(f"class {name} is in no image")
        mine = settled(defs.join(family.withColumnRenamed("name", "class"), "class", "left_semi").select("image_seq", "class_seq", F.col("class").alias("src")))
        t = lambda table, *columns: self.a.table(table, list(columns), images=mine)
        ids = ("image_seq", "ref_kind", "ref_idx")
        used = t("refs", "image_seq", "class_seq", "ref_kind", "ref_idx")
        used = used.unionByName(t("encoded_methods", "image_seq", "class_seq", "method_idx").select("image_seq", "class_seq", F.lit("method").alias("ref_kind"), F.col("method_idx").alias("ref_idx")))
        used = used.unionByName(t("encoded_fields", "image_seq", "class_seq", "field_idx").select("image_seq", "class_seq", F.lit("field").alias("ref_kind"), F.col("field_idx").alias("ref_idx")))
        owner = F.when(F.col("class").startswith("["), F.col("class")).otherwise(F.concat(F.lit("L"), "class", F.lit(";")))
        shown = t("types", "image_seq", "type_idx", "descriptor").select("image_seq", F.lit("type").alias("ref_kind"), F.col("type_idx").alias("ref_idx"), F.col("descriptor").alias("text"))
        shown = shown.unionByName(t("method_ids", "image_seq", "method_idx", "class", "proto").select("image_seq", F.lit("method").alias("ref_kind"), F.col("method_idx").alias("ref_idx"), F.concat(owner, "proto").alias("text")))
        shown = shown.unionByName(t("field_ids", "image_seq", "field_idx", "class", "type").select("image_seq", F.lit("field").alias("ref_kind"), F.col("field_idx").alias("ref_idx"), F.concat(owner, "type").alias("text")))
        hits = used.join(mine, ["image_seq", "class_seq"]).select("src", *ids).distinct().join(shown, list(ids))
        body = hits.select("src", F.explode(F.regexp_extract_all("text", F.lit("L([^;]+);"), 1)).alias("dst")).union(head).distinct()
        return C.closure(family, body, head, defined, self.images().count(), rounds)

    def getmethod(self, name: str, method: str) -> DataFrame:
        from .outline import outlines

        return outlines(self.a.images_raw(), [N.class_literal(name)], method).select(N.dotted(F.col("class")).alias("class"), "source")

    def pkg(self, package: str | None = None) -> DataFrame:
        """path, source of every class below a package (the launcher's if none is given); paths differ even where
        case does not count, and a class is called in its source as its file is."""
        from .outline import outlines

        if package is None:
            launcher = self.facts()["launcher"] or ""
            package = launcher.rpartition(".")[0]
        mark = "\ue000"  # stands for the class's own name until its path is known
        src = settled(outlines(self.a.images_raw(), None, None, package.replace(".", "/"), mark))
        paths = G.unique_paths(src.select(F.col("class").alias("name")), G.safe_path(F.col("name"), N.JAVA_KEYWORDS)).withColumnRenamed("name", "class")
        own = F.replace(F.col("source"), F.lit(mark), F.substring_index("path", "/", -1))
        return src.join(paths, "class").select(F.concat("path", F.lit(".java")).alias("path"), own.alias("source"))

    def nesting(self) -> DataFrame:
        """image_seq, class, enclosing_class, enclosing_method, inner_name, members: what the system
        annotations of a class say about where it is nested."""
        owner = self.t("class_defs", "image_seq", "class_seq", "class")
        return J.nesting_evidence(self.t("annotations")).join(owner, ["image_seq", "class_seq"]).drop("class_seq")

    def forest(self) -> DataFrame:
        """name, outer, how, root, depth, unit of every class: what it says of itself before what its name says."""
        said = self.nesting()
        inside = F.coalesce("enclosing_class", F.substring_index("enclosing_method", "->", 1))
        said = said.select(F.col("class").alias("name"), N.class_name(inside).alias("outer")).where("outer is not null")
        return T.forest(self.classes().select(F.col("class").alias("name")), said)

    def access(self) -> DataFrame:
        """owner, member, declared, needed, widened, changed: the least access that lets every reference of all images through."""
        names = {}
        for kind, idx, tail in (("method", "method_idx", F.concat("name", "proto")), ("field", "field_idx", F.concat("name", F.lit(" "), "type"))):
            names[kind] = self.t(f"{kind}_ids").select("image_seq", F.lit(kind).alias("ref_kind"), F.col(idx).alias("ref_idx"), F.col("class").alias("owner"), tail.alias("member"))
        ids = settled(names["method"].unionByName(names["field"]))
        own = [self.t(f"encoded_{kind}s", "image_seq", f"{kind}_idx", "access").select("image_seq", F.lit(kind).alias("ref_kind"), F.col(f"{kind}_idx").alias("ref_idx"), A.level_of(F.col("access")).alias("declared")) for kind in ("method", "field")]
        members = own[0].unionByName(own[1]).join(ids, ["image_seq", "ref_kind", "ref_idx"]).groupBy("owner", "member").agg(F.min("declared").alias("declared"))
        refs = self.refs().select("image_seq", "ref_kind", "ref_idx", F.col("class").alias("user")).join(ids, ["image_seq", "ref_kind", "ref_idx"]).select("owner", "member", "user").distinct()
        unit = self.forest().select("name", "unit")
        for side in ("owner", "user"):
            refs = refs.join(unit.select(F.col("name").alias(side), F.col("unit").alias(f"{side}_unit")), side, "left")
            refs = refs.withColumn(f"{side}_unit", F.coalesce(f"{side}_unit", side)).withColumn(f"{side}_package", A.package_of(F.col(side)))
        return A.levels(members, refs, H.closure(self.edges()))

    def export(self, out: str, package: str | None = None) -> None:
        """A Parquet table (path, source) below out, one row per class."""
        self.pkg(package if package is not None else "").write.mode("overwrite").parquet(out)

    def export_tree(self, out: str, package: str | None = None) -> None:
        """A file for every class below out, a folder that all executors share."""
        write_tree(self.pkg(package if package is not None else ""), out)


def resolve(package: str, name: str | None) -> str | None:
    if not name:
        return name
    if name.startswith("."):
        return package + name
    return name if "." in name else f"{package}.{name}"
