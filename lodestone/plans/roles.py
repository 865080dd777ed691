"""Which columns of plain tables play the roles of the artifact tables.

image: region; class path: region.nation.segment.customer; method: an order; instruction: a line
item (pc: line number, kind: return flag, reference: part); dictionary: parts; members: parts and
suppliers; hierarchy: customer -> nation -> region -> ROOT; archive path: page address;
definitions that repeat: document texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def classes(self) -> DataFrame:
        """image, class, class_seq, c_custkey, parts of the path."""
        c = self.customer.join(self.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(self.region, F.col("n_regionkey") == F.col("r_regionkey"))
        path = F.concat_ws(".", "r_name", "n_name", "c_mktsegment", "c_name")
        return c.select(F.col("r_name").alias("image"), path.alias("class"), F.col("c_custkey").alias("class_seq"), "c_custkey", "c_name", "n_name", "r_name", "c_mktsegment")

    def refs(self) -> DataFrame:
        """image, class, method, pc, kind, ref_idx."""
        o = self.orders.select("o_orderkey", "o_custkey").join(self.classes().select("image", "class", "c_custkey"), F.col("o_custkey") == F.col("c_custkey"))
        rows = self.lineitem.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
        return rows.select("image", "class", F.col("o_orderkey").alias("method"), F.col("l_linenumber").alias("pc"), F.col("l_returnflag").alias("kind"), F.col("l_partkey").alias("ref_idx"))

    def members(self) -> DataFrame:
        """owner, kind, seq, member: parts as methods owned by brand, suppliers as fields owned by nation."""
        p = self.part.select(F.concat_ws(".", F.lit("part"), "p_brand").alias("class"), F.lit("method").alias("kind"), F.col("p_partkey").alias("seq"), F.concat("p_name", F.lit("("), "p_type", F.lit(")")).alias("member"), F.col("p_name").alias("name"))
        s = self.supplier.join(self.nation, F.col("s_nationkey") == F.col("n_nationkey"))
        s = s.select(F.concat_ws(".", F.lit("supplier"), "n_name").alias("class"), F.lit("field").alias("kind"), F.col("s_suppkey").alias("seq"), F.concat("s_name", F.lit(" I")).alias("member"), F.col("s_name").alias("name"))
        return p.unionByName(s)

    def edges(self) -> DataFrame:
        """child, parent of the hierarchy."""
        c = self.classes()
        top = self.region.select(F.col("r_name").alias("child"), F.lit("ROOT").alias("parent"))
        return c.select(F.col("c_name").alias("child"), F.col("n_name").alias("parent")).union(c.select(F.col("n_name").alias("child"), F.col("r_name").alias("parent")).distinct()).union(top)

    def paths(self) -> DataFrame:
        """path of each page: its address without scheme, query and fragment."""
        return self.pages.select("page_id", F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", ""), r"[?#].*$", "").alias("path"))


SQL_CLASSES = """(SELECT r_name AS image, r_name || '.' || n_name || '.' || c_mktsegment || '.' || c_name AS class, c_custkey AS class_seq, c_custkey, c_name, n_name, r_name, c_mktsegment
 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
SQL_REFS = f"""(SELECT image, class, o_orderkey AS method, l_linenumber AS pc, l_returnflag AS kind, l_partkey AS ref_idx
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN {SQL_CLASSES} c ON o_custkey = c.c_custkey)"""
SQL_MEMBERS = """(SELECT 'part.' || p_brand AS class, 'method' AS kind, p_partkey AS seq, p_name || '(' || p_type || ')' AS member, p_name AS name FROM part
 UNION ALL SELECT 'supplier.' || n_name, 'field', s_suppkey, s_name || ' I', s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
SQL_EDGES = f"""(SELECT c_name AS child, n_name AS parent FROM {SQL_CLASSES} UNION ALL SELECT DISTINCT n_name, r_name FROM {SQL_CLASSES} UNION ALL SELECT r_name, 'ROOT' FROM region)"""
SQL_PATHS = r"""(SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages)"""


def sql_frontier(keys: str, sep: str, prefix: str = "", depth: int | None = None, by: str = "") -> str:
    """The frontier view over a relation keys(key, w[, by]) as portable SQL: path, kind, count."""
    sd = len(prefix.split(sep)) if prefix else 0
    b, bj = (f"{by}, ", f" AND a.{by} = b.{by}") if by else ("", "")
    scope = f"WHERE key = '{prefix}' OR starts_with(key, '{prefix}{sep}')" if prefix else ""
    head = f"""WITH k AS (SELECT {b}key, sum(w) AS w FROM {keys} {scope} GROUP BY {b}key),
 s AS (SELECT {b}string_split(key, '{sep}') AS segs, w FROM k),
 x AS (SELECT {b}segs, w, unnest(range(1, len(segs) + 1)) AS lvl FROM s),
 e AS (SELECT {b}segs[1:lvl] AS path, lvl, CASE WHEN lvl < len(segs) THEN segs[lvl + 1] END AS nxt, w FROM x),
 n AS (SELECT {b}path, lvl, sum(w) AS count, sum(w) FILTER (nxt IS NULL) AS self, count(DISTINCT nxt) AS kids FROM e GROUP BY {b}path, lvl)"""
    if depth is None:
        return f"""{head},
 v AS (SELECT * FROM n a WHERE NOT EXISTS (SELECT 1 FROM n b WHERE b.kids > 1 AND b.lvl > {sd} AND b.lvl < a.lvl AND a.path[1:b.lvl] = b.path{bj}))
 SELECT {b}array_to_string(path, '{sep}') AS path, 'class' AS kind, CAST(self AS BIGINT) AS count FROM v WHERE self IS NOT NULL AND lvl >= {max(sd, 1)}
 UNION ALL SELECT {b}array_to_string(path, '{sep}'), 'package', CAST(count AS BIGINT) FROM v WHERE kids > 1 AND lvl > {sd} AND lvl >= {max(sd, 1)}"""
    return f"""{head}
 SELECT {b}array_to_string(path, '{sep}') AS path, 'class' AS kind, CAST(self AS BIGINT) AS count FROM n WHERE self IS NOT NULL AND lvl <= {sd + depth} AND lvl >= {max(sd, 1)}
 UNION ALL SELECT {b}array_to_string(path, '{sep}'), 'package', CAST(count AS BIGINT) FROM n WHERE kids > 0 AND lvl = {sd + depth}"""
