"""The driver's tables seen as facts; each view's expressions read the same in Spark and in the SQL beside the queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkscope.operators.parts import dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def calls(spark, sf_dir):
    l, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return dealt(l, "l_partkey").join(p, l.l_partkey == p.p_partkey).selectExpr("l_suppkey % 10 as project", "l_orderkey as file", "l_linenumber as caller", "concat('s', cast(l_partkey % 500 as string)) as symbol", "cast(l_quantity as int) as line", "concat(l_returnflag, l_linestatus) as args", "p_brand as category")


CALLS = """calls AS (SELECT l_suppkey % 10 AS project, l_orderkey AS file, l_linenumber AS caller, 's' || (l_partkey % 500)::VARCHAR AS symbol, l_quantity::INT AS line,
  l_returnflag || l_linestatus AS args, p_brand AS category FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def mapping(spark, sf_dir):
    p = table(spark, sf_dir, "part").selectExpr("p_partkey % 500 as k").distinct().where("k % 4 <> 3")
    return p.selectExpr("concat('s', cast(k as string)) as symbol", "case k % 4 when 0 then 'available' when 1 then 'partial' else 'not_available' end as status")


MAPPING = """mapping AS (SELECT DISTINCT 's' || (p_partkey % 500)::VARCHAR AS symbol, CASE p_partkey % 500 % 4 WHEN 0 THEN 'available' WHEN 1 THEN 'partial' ELSE 'not_available' END AS status
  FROM part WHERE p_partkey % 500 % 4 <> 3)"""


def components(spark, sf_dir):
    c, n, o = (table(spark, sf_dir, t) for t in ("customer", "nation", "orders"))
    l, p = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    joined = dealt(l, "l_orderkey").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    joined = dealt(joined, "o_custkey").join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(n.select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    joined = dealt(joined, "l_partkey").join(p, F.col("l_partkey") == F.col("p_partkey"))
    return joined.selectExpr("n_name as component", "c_custkey as executable", "l_partkey as symbol", "p_brand as category")


COMPONENTS = """facts AS (SELECT n_name AS component, c_custkey AS executable, l_partkey AS symbol, p_brand AS category FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey)"""


_SITE = ["l_suppkey % 7 as project", "l_suppkey as file", "l_linenumber as caller", "p_brand as symbol"]
_OLD, _OLD_SITE = "l_orderkey % 40 <> 0", ["cast(l_quantity as int) as line", "concat(l_returnflag, l_linestatus) as args"]
_NEW = "l_orderkey % 50 <> 1 and not (l_suppkey % 17 = 0 and l_linenumber = 7)"
_NEW_SITE = ["cast(l_quantity as int) + case when l_suppkey % 3 = 0 then 2 else 0 end as line", "concat(l_returnflag, l_linestatus, case when l_suppkey % 4 = 0 and l_orderkey % 11 = 0 then 'x' else '' end) as args"]


def _call_rows(spark, sf_dir):
    l, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return l.join(p, l.l_partkey == p.p_partkey)


def snapshots(spark, sf_dir):
    both = _call_rows(spark, sf_dir)
    return both.where(_OLD).selectExpr(*_SITE, *_OLD_SITE), both.where(_NEW).selectExpr(*_SITE, *_NEW_SITE)


def sides(spark, sf_dir):
    """Both snapshots in one frame, from one reading of the rows: o and n say which one a row is of."""
    row = lambda which, site, o, n: f"if({which}, struct({', '.join(site)}, {o} as o, {n} as n), null)"
    return _call_rows(spark, sf_dir).selectExpr(*_SITE, f"inline(array({row(_OLD, _OLD_SITE, 1, 0)}, {row(_NEW, _NEW_SITE, 0, 1)}))").where("o is not null")


SNAPSHOTS = """old AS (SELECT l_suppkey % 7 AS project, l_suppkey AS file, l_linenumber AS caller, p_brand AS symbol, l_quantity::INT AS line, l_returnflag || l_linestatus AS args FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey % 40 <> 0),
new AS (SELECT l_suppkey % 7 AS project, l_suppkey AS file, l_linenumber AS caller, p_brand AS symbol, l_quantity::INT + CASE WHEN l_suppkey % 3 = 0 THEN 2 ELSE 0 END AS line,
  l_returnflag || l_linestatus || CASE WHEN l_suppkey % 4 = 0 AND l_orderkey % 11 = 0 THEN 'x' ELSE '' END AS args FROM lineitem JOIN part ON l_partkey = p_partkey
  WHERE l_orderkey % 50 <> 1 AND NOT (l_suppkey % 17 = 0 AND l_linenumber = 7)),
sides AS (SELECT *, 1 AS o, 0 AS n FROM old UNION ALL SELECT *, 0, 1 FROM new)"""


# Graph views of all rows: orders are files, each part is the file of 40 times its key, so few files are both and the number of paths stays in proportion to the rows


def all_edges(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as src", "l_partkey * 40 as dst").transform(dealt, "src", "dst").distinct()


def all_targets(spark, sf_dir):
    return table(spark, sf_dir, "part").where("p_partkey % 50 = 0").selectExpr("p_partkey * 40 as node")


def all_file_symbols(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as src", "l_partkey as symbol").distinct()


#: Hops that the reference follows.
HOPS = 10
ALL_EDGES = "edges AS (SELECT DISTINCT l_orderkey AS src, l_partkey * 40 AS dst FROM lineitem), targets AS (SELECT p_partkey * 40 AS node FROM part WHERE p_partkey % 50 = 0)"
ALL_PATHS = f"""{ALL_EDGES}, walk AS (
  SELECT src, [src, dst] AS path, dst AS tip, dst IN (FROM targets) AS hit, 1 AS depth FROM edges WHERE src NOT IN (FROM targets) AND src <> dst
  UNION ALL SELECT w.src, list_append(w.path, e.dst), e.dst, e.dst IN (FROM targets), w.depth + 1 FROM walk w JOIN edges e ON e.src = w.tip WHERE NOT w.hit AND w.depth < {HOPS} AND NOT list_contains(w.path, e.dst)),
paths AS (SELECT src, path, depth::BIGINT AS depth FROM walk WHERE hit)"""
ALL_FILE_SYMBOLS = "fs AS (SELECT DISTINCT l_orderkey AS src, l_partkey AS symbol FROM lineitem)"
