"""Queries over the driver's tables, by name, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkscope.functions import categories, text
from linkscope.operators import classify, diff, graph, intervals, layering, ordering, path_search, prefixes, substrings, usage
from linkscope.plans import adapters as a

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


# Usage roll-ups

query("component_ranking", f"""WITH {a.COMPONENTS}, s AS (SELECT component, count(DISTINCT symbol) AS n_symbols, count(DISTINCT executable) AS n_executables, count(DISTINCT category) AS n_categories FROM facts GROUP BY 1)
SELECT *, row_number() OVER (ORDER BY n_symbols DESC, component) AS rank, round_even(n_symbols / (SELECT sum(n_symbols) FROM s) * 100, 2)::DOUBLE AS share FROM s QUALIFY rank <= 20""")(
    lambda s, d: usage.ranking(usage.component_stats(a.components(s, d)), 20))
query("component_stats", f"WITH {a.COMPONENTS} SELECT component, count(DISTINCT symbol) AS n_symbols, count(DISTINCT executable) AS n_executables, count(DISTINCT category) AS n_categories FROM facts GROUP BY 1")(
    lambda s, d: usage.component_stats(a.components(s, d)))
query("component_drill_down", f"""WITH {a.COMPONENTS}, t AS (SELECT component, executable, count(DISTINCT symbol) AS n_total FROM facts GROUP BY 1, 2)
SELECT component, executable, category, count(DISTINCT symbol) AS n_symbols, any_value(n_total) AS n_total FROM facts JOIN t USING (component, executable) GROUP BY 1, 2, 3""")(
    lambda s, d: usage.drill_down(a.components(s, d)))
query("assigned_components", f"""WITH {a.COMPONENTS}, m AS (SELECT executable, arg_max(component, ord) AS component FROM (SELECT c_custkey AS executable, c_mktsegment AS component, 0 AS ord FROM customer WHERE c_custkey % 3 = 0
  UNION ALL SELECT c_custkey, 'late', 1 FROM customer WHERE c_custkey % 6 = 0) GROUP BY 1)
SELECT coalesce(m.component, 'unclassified') AS component, count(DISTINCT symbol) AS n_symbols, count(DISTINCT executable) AS n_executables, count(DISTINCT category) AS n_categories FROM facts LEFT JOIN m USING (executable) GROUP BY 1""")(
    lambda s, d: usage.component_stats(usage.assigned(a.components(s, d).drop("component"), a.table(s, d, "customer").where("c_custkey % 3 = 0").selectExpr("c_custkey as executable", "c_mktsegment as component", "0 as ord").unionByName(a.table(s, d, "customer").where("c_custkey % 6 = 0").selectExpr("c_custkey as executable", "'late' as component", "1 as ord")))))
query("symbols_by_category", f"WITH {a.CALLS} SELECT category, count(DISTINCT symbol) AS n_symbols, count(*) AS n_references FROM calls GROUP BY 1")(
    lambda s, d: usage.by_category(a.calls(s, d)))
query("symbol_summary", f"WITH {a.CALLS} SELECT symbol, min(category) AS category, count(*) AS n_calls, count(DISTINCT file) AS n_files FROM calls GROUP BY 1")(
    lambda s, d: usage.symbol_summary(a.calls(s, d)))
query("merged_symbol_summary", f"""WITH {a.CALLS} SELECT symbol, min(category) AS category, count(*) AS n_calls, count(DISTINCT file) AS n_files, count(DISTINCT project) AS n_projects,
  string_agg(DISTINCT project::VARCHAR, ',' ORDER BY project::VARCHAR) AS projects FROM calls GROUP BY 1""")(lambda s, d: usage.merged_symbol_summary(a.calls(s, d)))
query("project_stats", """WITH """ + a.CALLS + """, c AS (SELECT project, category, count(DISTINCT symbol) AS n FROM calls GROUP BY 1, 2), t AS (SELECT * FROM c JOIN (SELECT project, category, min({'f': file, 'c': caller}) AS first FROM calls GROUP BY 1, 2) USING (project, category) QUALIFY row_number() OVER (PARTITION BY project ORDER BY n DESC, first, category) = 1)
SELECT project, count(*) AS n_calls, count(DISTINCT symbol) AS n_symbols, count(DISTINCT file) AS n_files, any_value(t.category) AS top_category, any_value(t.n) AS top_count FROM calls JOIN t USING (project) GROUP BY 1""")(
    lambda s, d: usage.project_stats(a.calls(s, d), ["file", "caller"]))
query("project_totals", f"""WITH {a.CALLS} SELECT project::VARCHAR AS project, count(*) AS n_calls, count(DISTINCT symbol) AS n_symbols, count(DISTINCT file) AS n_files FROM calls GROUP BY 1
UNION ALL SELECT 'TOTAL', count(*), count(DISTINCT symbol), count(DISTINCT file) FROM calls""")(lambda s, d: usage.with_total(a.calls(s, d)))
query("category_share", f"""WITH {a.CALLS}, c AS (SELECT category, count(DISTINCT symbol) AS n_symbols FROM calls GROUP BY 1)
SELECT category, n_symbols, printf('%.1f%%', n_symbols / (SELECT sum(n_symbols) FROM c) * 100) AS share FROM c""")(lambda s, d: usage.category_share(a.calls(s, d)))
query("scan_totals", f"WITH {a.CALLS} SELECT count(DISTINCT file) AS n_files, count(DISTINCT file) FILTER (symbol IS NOT NULL) AS n_with_symbols, count(symbol) AS n_references, count(DISTINCT symbol) AS n_symbols FROM calls")(
    lambda s, d: usage.scan_totals(a.calls(s, d)))
query("most_common_symbols", f"WITH {a.CALLS} SELECT symbol, count(DISTINCT file) AS n_files FROM calls GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")(
    lambda s, d: usage.most_common(a.calls(s, d)))
query("known_symbols", f"WITH {a.CALLS}, {a.MAPPING} SELECT symbol, category, count(*) AS n_calls FROM calls WHERE symbol IN (SELECT symbol FROM mapping) GROUP BY 1, 2")(
    lambda s, d: usage.known(a.calls(s, d), a.mapping(s, d)).groupBy("symbol", "category").agg(F.count("*").alias("n_calls")))
query("library_calls", f"WITH {a.CALLS}, l AS (SELECT DISTINCT file, symbol FROM calls WHERE line < 10) SELECT file, symbol, count(*) AS n_calls FROM calls c WHERE NOT EXISTS (FROM l WHERE l.file = c.file AND l.symbol = c.symbol) GROUP BY 1, 2")(
    lambda s, d: usage.without_local(c := a.calls(s, d), c.where("line < 10")).groupBy("file", "symbol").agg(F.count("*").alias("n_calls")))
query("coverage", f"""WITH {a.CALLS}, {a.MAPPING}, s AS (SELECT DISTINCT project, symbol, coalesce(status, 'unknown') AS status FROM calls LEFT JOIN mapping USING (symbol)),
n AS (SELECT count(*) AS n_total, count(*) FILTER (status = 'available') AS n_available, count(*) FILTER (status = 'partial') AS n_partial, count(*) FILTER (status = 'not_available') AS n_not_available, count(*) FILTER (status = 'unknown') AS n_unknown FROM s)
SELECT *, round_even(n_available / n_total * 100, 2)::DOUBLE AS available_pct, round_even((n_available + n_partial) / n_total * 100, 2)::DOUBLE AS covered_pct FROM n""")(
    lambda s, d: usage.coverage(usage.compat_status(a.calls(s, d).select("project", "symbol").distinct(), a.mapping(s, d))))
_BLOCKERS = f"""{a.CALLS}, {a.MAPPING}, b AS (SELECT project, symbol, coalesce(status, 'unknown') AS status, count(*) AS n_calls, count(DISTINCT file) AS n_files, count(DISTINCT category) AS n_categories FROM calls LEFT JOIN mapping USING (symbol)
  WHERE coalesce(status, 'unknown') IN ('not_available', 'unknown') GROUP BY 1, 2, 3)"""
query("blockers", f"WITH {_BLOCKERS} SELECT * FROM b")(lambda s, d: usage.blockers(usage.compat_status(a.calls(s, d), a.mapping(s, d))))
query("top_blockers", f"WITH {_BLOCKERS} SELECT *, row_number() OVER (PARTITION BY project ORDER BY n_calls DESC, symbol, status) AS rank FROM b QUALIFY rank <= 5")(
    lambda s, d: usage.top_blockers(usage.blockers(usage.compat_status(a.calls(s, d), a.mapping(s, d)))))

# Snapshot differences

_GROUPS = """line AS (SELECT {k}, args, line, sum(o) AS o, sum(n) AS n FROM sides GROUP BY ALL),
args AS (SELECT {k}, args, sum(o) AS o, sum(n) AS n, sum(least(o, n)) AS u FROM line GROUP BY ALL),
g AS (SELECT {k}, sum(o)::BIGINT AS o, sum(n)::BIGINT AS n, sum(u)::BIGINT AS u, sum(least(o, n))::BIGINT AS a FROM args GROUP BY ALL)
SELECT {out}, CASE WHEN o = 0 THEN 'added' WHEN n = 0 THEN 'removed' WHEN u = o AND u = n THEN 'unchanged' WHEN a = o AND a = n THEN 'moved' ELSE 'changed' END AS status,
  o AS old_count, n AS new_count, u AS n_unchanged, a - u AS n_moved, least(o, n) - a AS n_changed, greatest(o - n, 0) AS n_removed, greatest(n - o, 0) AS n_added FROM g"""
query("diff_call_sites", f"WITH {a.SNAPSHOTS}, " + _GROUPS.format(k="file, caller, symbol", out="file::VARCHAR AS file, caller::VARCHAR AS caller, symbol"))(lambda s, d: diff.call_sites(*a.snapshots(s, d)))
query("diff_call_sites_by_project", f"WITH {a.SNAPSHOTS}, " + _GROUPS.format(k="project, file, caller, symbol", out="project::VARCHAR AS project, file::VARCHAR AS file, caller::VARCHAR AS caller, symbol"))(
    lambda s, d: diff.call_sites(*a.snapshots(s, d), ["project", *diff.KEY]))
_COUNTED = "CASE WHEN old_calls = 0 THEN 'added' WHEN new_calls = 0 THEN 'removed' WHEN old_calls = new_calls THEN 'unchanged' ELSE 'changed' END"
query("diff_symbols", f"WITH {a.SNAPSHOTS}, g AS (SELECT symbol, sum(o)::BIGINT AS old_calls, sum(n)::BIGINT AS new_calls FROM sides GROUP BY 1) SELECT *, {_COUNTED} AS status FROM g")(lambda s, d: diff.symbols(*a.snapshots(s, d)))
query("diff_symbols_by_project", f"WITH {a.SNAPSHOTS}, g AS (SELECT project, symbol, sum(o)::BIGINT AS old_calls, sum(n)::BIGINT AS new_calls FROM sides GROUP BY 1, 2) SELECT *, {_COUNTED} AS status FROM g")(
    lambda s, d: diff.symbols(*a.snapshots(s, d), ["project"]))
query("diff_files", f"""WITH {a.SNAPSHOTS}, p AS (SELECT file, symbol, sum(o) AS o, sum(n) AS n FROM sides GROUP BY 1, 2),
g AS (SELECT file, sum(o)::BIGINT AS old_calls, sum(n)::BIGINT AS new_calls, count(*) FILTER (o = 0) AS n_added_symbols, count(*) FILTER (n = 0) AS n_removed_symbols FROM p GROUP BY 1)
SELECT *, CASE WHEN old_calls = new_calls AND old_calls > 0 AND n_added_symbols + n_removed_symbols > 0 THEN 'changed' ELSE {_COUNTED} END AS status FROM g""")(lambda s, d: diff.files(*a.snapshots(s, d)))
query("diff_metrics", f"""WITH {a.SNAPSHOTS}, m AS (SELECT 'calls' AS metric, (SELECT count(*) FROM old) AS old_value, (SELECT count(*) FROM new) AS new_value
UNION ALL SELECT 'files', (SELECT count(DISTINCT file) FROM old), (SELECT count(DISTINCT file) FROM new) UNION ALL SELECT 'symbols', (SELECT count(DISTINCT symbol) FROM old), (SELECT count(DISTINCT symbol) FROM new))
SELECT *, new_value - old_value AS delta FROM m""")(lambda s, d: diff.metrics(*a.snapshots(s, d)))
_KEY = "file, caller, symbol"
_GONE = "news[: j - 1] || news[j + 1 :]"
query("diff_pairs", f"""WITH RECURSIVE {a.SNAPSHOTS}, n AS (SELECT file::VARCHAR AS file, caller::VARCHAR AS caller, symbol, args, line, sum(o)::INT AS o, sum(n)::INT AS n FROM sides GROUP BY ALL),
same AS (SELECT {_KEY}, line AS old_line, args AS old_args, line AS new_line, args AS new_args, 'unchanged' AS status, unnest(range(least(o, n))) AS i FROM n),
l AS (SELECT {_KEY}, args, line, o > n AS is_old, unnest(range(abs(o - n))) AS i FROM n),
g AS (SELECT {_KEY}, args, coalesce(list(line ORDER BY line) FILTER (is_old), []) AS olds, coalesce(list(line ORDER BY line) FILTER (NOT is_old), []) AS news FROM l GROUP BY ALL),
w AS (SELECT *, 0 AS i, NULL::INT AS old_line, NULL::INT AS new_line FROM g
  UNION ALL SELECT {_KEY}, args, olds, {_GONE}, i + 1, olds[i + 1], news[j] FROM (SELECT *, list_position(far, list_min(far)) AS j FROM (SELECT *, list_transform(news, lambda v: abs(v - olds[i + 1])) AS far FROM w WHERE i < len(olds) AND len(news) > 0))),
r AS (SELECT {_KEY}, args, unnest(olds[i + 1 :]) AS line, true AS is_old FROM w WHERE i = len(olds) OR len(news) = 0 UNION ALL SELECT {_KEY}, args, unnest(news), false FROM w WHERE i = len(olds) OR len(news) = 0),
q AS (SELECT *, row_number() OVER (PARTITION BY {_KEY}, line, is_old ORDER BY args) AS k FROM r),
beside AS (SELECT {_KEY}, line, k, max(args) FILTER (is_old) AS old_args, max(args) FILTER (NOT is_old) AS new_args FROM q GROUP BY {_KEY}, line, k HAVING count(*) = 2),
h AS (SELECT {_KEY}, coalesce(list({{'line': line, 'args': args}} ORDER BY line, args) FILTER (is_old), []) AS olds, coalesce(list({{'line': line, 'args': args}} ORDER BY line, args) FILTER (NOT is_old), []) AS news FROM q ANTI JOIN beside USING (file, caller, symbol, line, k) GROUP BY ALL),
x AS (SELECT *, 0 AS i, NULL::STRUCT(line INT, args VARCHAR) AS a, NULL::STRUCT(line INT, args VARCHAR) AS b FROM h
  UNION ALL SELECT {_KEY}, olds, {_GONE}, i + 1, olds[i + 1], news[j] FROM (SELECT *, list_position(far, list_min(far)) AS j FROM (SELECT *, list_transform(news, lambda v: abs(v.line - olds[i + 1].line)) AS far FROM x WHERE i < len(olds) AND len(news) > 0))),
e AS (SELECT * FROM x WHERE i = len(olds) OR len(news) = 0)
SELECT * EXCLUDE (i) FROM same UNION ALL SELECT {_KEY}, old_line, args, new_line, args, 'moved' FROM w WHERE i > 0 UNION ALL SELECT {_KEY}, line, old_args, line, new_args, 'changed' FROM beside
UNION ALL SELECT {_KEY}, a.line, a.args, b.line, b.args, 'changed' FROM x WHERE i > 0
UNION ALL SELECT {_KEY}, v.line, v.args, NULL, NULL, 'removed' FROM (SELECT *, unnest(olds[i + 1 :]) AS v FROM e) UNION ALL SELECT {_KEY}, NULL, NULL, v.line, v.args, 'added' FROM (SELECT *, unnest(news) AS v FROM e)""")(
    lambda s, d: diff.pairs_of(a.sides(s, d).drop("project")))
_CATEGORISED = f"{a.SNAPSHOTS}, s AS (SELECT *, 'c' || line % 3 AS category FROM sides)"
_FIRST = "coalesce(min(CASE WHEN n > 0 THEN {'l': line, 'a': args, 'c': category} END).c, min(CASE WHEN o > 0 THEN {'l': line, 'a': args, 'c': category} END).c, '')"


def _categorised(s, d):
    return [x.withColumn("category", F.concat(F.lit("c"), (F.col("line") % 3).cast("string"))) for x in a.snapshots(s, d)]


query("diff_call_site_details", f"""WITH {_CATEGORISED} SELECT file::VARCHAR AS file, caller::VARCHAR AS caller, symbol, coalesce(string_agg(line::VARCHAR, ',' ORDER BY line) FILTER (o > 0), '') AS old_lines,
  coalesce(string_agg(line::VARCHAR, ',' ORDER BY line) FILTER (n > 0), '') AS new_lines, {_FIRST} AS category FROM s GROUP BY ALL""")(
    lambda s, d: (x := diff.call_site_details(*_categorised(s, d))).select(*diff.KEY, *[F.array_join(F.transform(c, lambda v: v.cast("string")), ",").alias(c) for c in ("old_lines", "new_lines")], "category"))
query("diff_symbol_categories", f"WITH {_CATEGORISED}, g AS (SELECT symbol, sum(o)::BIGINT AS old_calls, sum(n)::BIGINT AS new_calls, {_FIRST} AS category FROM s GROUP BY 1) SELECT *, {_COUNTED} AS status FROM g")(
    lambda s, d: diff.symbol_categories(*_categorised(s, d)))
_LISTED = f"""p AS (SELECT project, file, symbol, sum(o) AS o, sum(n) AS n FROM sides GROUP BY ALL), g AS (SELECT project, file, sum(o)::BIGINT AS old_calls, sum(n)::BIGINT AS new_calls, count(*) FILTER (o > 0) AS old_symbols, count(*) FILTER (n > 0) AS new_symbols,
  coalesce(string_agg(symbol, ',' ORDER BY symbol) FILTER (o = 0), '') AS added_symbols, coalesce(string_agg(symbol, ',' ORDER BY symbol) FILTER (n = 0), '') AS removed_symbols FROM p GROUP BY 1, 2)
SELECT *, CASE WHEN old_calls = new_calls AND old_calls > 0 AND added_symbols || removed_symbols <> '' THEN 'changed' ELSE {_COUNTED} END AS status FROM g"""
query("diff_files_by_project", f"WITH {a.SNAPSHOTS}, {_LISTED}")(
    lambda s, d: (x := diff.file_symbols(*a.snapshots(s, d), ["project"])).select(*[F.array_join(c, ",").alias(c) if c.endswith("ed_symbols") else c for c in x.columns]))
query("diff_categories", f"""WITH {_CATEGORISED}, g AS (SELECT category, symbol, max(o) AS o, max(n) AS n FROM s GROUP BY ALL), t AS (SELECT category, sum(o)::BIGINT AS old_symbols, sum(n)::BIGINT AS new_symbols FROM g GROUP BY 1) SELECT *, new_symbols - old_symbols AS delta FROM t""")(
    lambda s, d: diff.category_metrics(*_categorised(s, d)))

# Order of all rows

_PLACE = ["project", "file", "line", "caller", "symbol", "args"]
query("calls_in_order", f"WITH {a.CALLS} SELECT {', '.join(_PLACE)}, row_number() OVER (ORDER BY {', '.join(_PLACE)}) - 1 AS place FROM calls")(
    lambda s, d: ordering.numbered(a.calls(s, d).select(*_PLACE), _PLACE, "place"))

# Graphs

query("project_boundaries", r"""WITH m AS (SELECT string_split(regexp_replace(url, '^[a-z]+://', ''), '/') AS p FROM pages), e AS (SELECT p[1] AS top, min(p) AS a, max(p) AS b FROM m GROUP BY 1),
k AS (SELECT *, coalesce(list_min(list_filter(range(1, len(a) + 1), lambda i: a[i] IS DISTINCT FROM b[i])), len(a) + 1) AS k FROM e)
SELECT top, array_to_string(a[1 : k - 1], '/') AS project FROM k""")(lambda s, d: graph.boundaries(a.table(s, d, "pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("path"))))

# Paths over all rows, ten hops

_chain = lambda: F.array_join(F.transform("path", lambda x: x.cast("string")), " -> ").alias("chain")


def _all_paths(s, d):
    return graph.paths_to(a.all_edges(s, d), a.all_targets(s, d), a.HOPS)


query("graph_paths", f"WITH RECURSIVE {a.ALL_PATHS} SELECT src, array_to_string(path, ' -> ') AS chain, depth FROM paths")(lambda s, d: _all_paths(s, d).select("src", _chain(), "depth"))
query("graph_first_paths", f"WITH RECURSIVE {a.ALL_PATHS} SELECT src, array_to_string(path, ' -> ') AS chain, depth, row_number() OVER (PARTITION BY src ORDER BY depth, path) AS rank FROM paths QUALIFY rank <= 50")(
    lambda s, d: path_search.first_paths_to(a.all_edges(s, d), a.all_targets(s, d), 50, a.HOPS).select("src", _chain(), "depth", "rank"))
query("graph_reachable", f"""WITH RECURSIVE {a.ALL_EDGES}, r AS (SELECT node, 0 AS depth FROM targets UNION SELECT e.src, r.depth + 1 FROM r JOIN edges e ON e.dst = r.node WHERE r.depth < {a.HOPS})
SELECT node, min(depth)::BIGINT AS depth FROM r GROUP BY 1""")(lambda s, d: graph.reachable(a.all_edges(s, d), a.all_targets(s, d), a.HOPS))
query("graph_chains", f"WITH RECURSIVE {a.ALL_PATHS}, {a.ALL_FILE_SYMBOLS} SELECT src, symbol, array_to_string(path, ' -> ') AS chain, depth FROM paths JOIN fs USING (src)")(
    lambda s, d: graph.chains(_all_paths(s, d), a.all_file_symbols(s, d)))
query("graph_by_depth", f"WITH RECURSIVE {a.ALL_PATHS}, {a.ALL_FILE_SYMBOLS}, l AS (SELECT src, min(depth) AS depth FROM paths GROUP BY 1) SELECT depth, count(DISTINCT symbol) AS n_symbols, count(DISTINCT src) AS n_files FROM l JOIN fs USING (src) GROUP BY 1")(
    lambda s, d: graph.by_depth(_all_paths(s, d), a.all_file_symbols(s, d)))
query("graph_stats", f"WITH {a.ALL_EDGES} SELECT (SELECT count(*) FROM (SELECT src FROM edges UNION SELECT dst FROM edges)) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges")(lambda s, d: graph.stats(a.all_edges(s, d)))
query("graph_fans", f"WITH {a.ALL_EDGES}, b AS (SELECT src AS node, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges) SELECT node, sum(i)::BIGINT AS fan_in, sum(o)::BIGINT AS fan_out FROM b GROUP BY 1")(lambda s, d: graph.fans(a.all_edges(s, d)))
query("graph_chain_edges", f"WITH RECURSIVE {a.ALL_PATHS}, i AS (SELECT path, unnest(range(1, len(path))) AS k FROM paths) SELECT DISTINCT path[k] AS src, path[k + 1] AS dst FROM i")(
    lambda s, d: graph.chain_edges(_all_paths(s, d)))
query("graph_layers", f"""WITH RECURSIVE {a.ALL_EDGES}, nodes AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges), first AS (SELECT node FROM nodes WHERE node NOT IN (SELECT dst FROM edges)),
queue AS MATERIALIZED (SELECT * FROM (WITH RECURSIVE q(node, turn) USING KEY (node) AS (
  SELECT node, [node] FROM (SELECT node FROM first UNION SELECT min(node) FROM nodes WHERE NOT EXISTS (FROM first)) WHERE node IS NOT NULL
  UNION SELECT dst, min(list_append(turn, dst)) FROM q JOIN edges ON src = node WHERE dst NOT IN (SELECT node FROM recurring.q) GROUP BY dst) FROM q)),
onward AS MATERIALIZED (SELECT e.src, e.dst FROM edges e JOIN queue a ON a.node = e.src JOIN queue b ON b.node = e.dst WHERE len(a.turn) < len(b.turn) OR len(a.turn) = len(b.turn) AND a.turn < b.turn),
walk(node, l) AS (SELECT node, 0 FROM queue WHERE len(turn) = 1 UNION SELECT dst, l + 1 FROM walk JOIN onward ON src = node), taken AS (SELECT node, max(l) AS l FROM walk GROUP BY 1),
told AS (SELECT dst AS node, max(l) + 1 AS l FROM edges JOIN taken ON src = node GROUP BY 1),
layered AS MATERIALIZED (SELECT n.node, coalesce(greatest(t.l, r.l), 0)::BIGINT AS layer FROM nodes n LEFT JOIN taken t USING (node) LEFT JOIN told r USING (node)),
placed(node, layer, place) AS (SELECT node, layer, row_number() OVER (ORDER BY node) - 1 FROM layered WHERE layer = 0
  UNION ALL SELECT y.node, any_value(y.layer), row_number() OVER (ORDER BY coalesce(sum(p.place)::DOUBLE / count(p.place), 0), y.node) - 1
  FROM layered y LEFT JOIN edges e ON e.dst = y.node LEFT JOIN placed p ON p.node = e.src AND p.layer = y.layer - 1
  WHERE y.layer = (SELECT min(layer) FROM layered WHERE layer > (SELECT max(layer) FROM placed)) GROUP BY y.node)
SELECT node, layer, place FROM placed""")(lambda s, d: layering.layers(a.all_edges(s, d)))
query("graph_induced", f"WITH {a.ALL_EDGES}, n AS (SELECT DISTINCT src AS node FROM edges) SELECT src, dst FROM edges WHERE src IN (FROM n) AND dst IN (FROM n)")(
    lambda s, d: graph.induced(e := a.all_edges(s, d), e.select(F.col("src").alias("node"))))

# Detection and classification

query("string_clusters", """WITH l AS (SELECT l_suppkey AS file, l_orderkey AS "offset", l_orderkey - lag(l_orderkey) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) > 256 AS new FROM lineitem),
i AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY "offset") AS island FROM l)
SELECT file, min("offset") AS start, max("offset") AS "end", count(*) AS n FROM i GROUP BY file, island HAVING count(*) >= 3""")(
    lambda s, d: classify.clusters(a.table(s, d, "lineitem").selectExpr("l_suppkey as file", "l_orderkey as offset")))
query("fingerprint_scores", """WITH m AS (SELECT p_partkey AS string, p_partkey % 6 AS category, 0.75 AS per_point, 3.0 + p_partkey % 6 AS max_points FROM part),
h AS (SELECT DISTINCT l_suppkey AS file, l_partkey AS string FROM lineitem), e AS (SELECT file, category, least(count(*) * max(per_point), max(max_points)) AS points, count(*) AS k FROM h JOIN m USING (string) GROUP BY 1, 2),
r AS (SELECT file, sum(points) AS raw, sum(k)::BIGINT AS matched FROM e GROUP BY 1)
SELECT file, matched, round_even((raw / 106 * 100)::DOUBLE, 1) AS score, CASE WHEN raw >= 60 THEN 'high' WHEN raw >= 35 THEN 'medium' WHEN raw >= 15 THEN 'low' ELSE 'none' END AS confidence FROM r""")(
    lambda s, d: classify.fingerprint_scores(a.table(s, d, "lineitem").selectExpr("l_suppkey as file", "l_partkey as string"), a.table(s, d, "part").selectExpr("p_partkey as string", "p_partkey % 6 as category", "0.75D as per_point", "cast(3 + p_partkey % 6 as double) as max_points")))
_NAMES = "names AS (SELECT l_suppkey AS file, l_partkey AS name, CASE l_linenumber % 3 WHEN 0 THEN 'und' WHEN 1 THEN 'def' ELSE 'rodata' END AS place FROM lineitem), pats AS (SELECT p_brand AS \"group\", p_partkey AS pattern FROM part WHERE p_size < 10), hits AS (SELECT file, \"group\", pattern, arg_min(place, CASE place WHEN 'und' THEN 0 WHEN 'def' THEN 1 ELSE 2 END) AS place FROM names JOIN pats ON name = pattern GROUP BY 1, 2, 3)"


def _hits(s, d):
    names = a.table(s, d, "lineitem").selectExpr("l_suppkey as file", "l_partkey as name", "case l_linenumber % 3 when 0 then 'und' when 1 then 'def' else 'rodata' end as place")
    return classify.pattern_hits(names, a.table(s, d, "part").where("p_size < 10").selectExpr("p_brand as group", "p_partkey as pattern"))


query("pattern_hits", f"WITH {_NAMES} SELECT * FROM hits")(_hits)
query("pattern_summary", f"WITH {_NAMES}, n AS (SELECT file, \"group\", count(*) AS n FROM hits GROUP BY 1, 2) SELECT file, string_agg(\"group\" || ' (' || n || ')', ', ' ORDER BY \"group\") AS summary FROM n GROUP BY 1")(
    lambda s, d: classify.pattern_summary(_hits(s, d)))
_TIER = "CASE WHEN category IN ({}) THEN 1 WHEN category IN ({}) THEN 3 ELSE 2 END".format(*(", ".join(f"'{c}'" for c in t) for t in (categories.TIER_1, categories.TIER_3)))
_CATEGORY = list(categories.PREFIXES)
#: The reason by the same rules; of hit, named, v (version), library, t1 to t3, total, k (categories) and category.
_REASON = """CASE WHEN hit AND named THEN 'version_banner: ' || v || ' (' || total || ' exported)' WHEN hit AND t1 >= 2 THEN '_detected: ' || t1 || ' tier1, ' || total || ' total'
  WHEN t1 >= 5 THEN 'tier1_symbols: ' || t1 || ' tier1, ' || total || ' total' WHEN total >= 50 AND t1 >= 1 THEN 'large_surface: ' || total || ' total, ' || t1 || ' tier1'
  WHEN hit THEN 'ssl_detected:  (' || total || ' exported)' WHEN t1 >= 2 AND total >= 5 THEN 'moderate_tier1: ' || t1 || ' tier1, ' || total || ' total'
  WHEN t2 >= 5 AND total >= 20 THEN 'strong_tier2: ' || t2 || ' tier2, ' || total || ' total' WHEN t1 >= 1 THEN 'minimal_tier1: ' || t1 || ' tier1, ' || total || ' total'
  WHEN t2 >= 1 AND total >= 5 THEN 'weak_tier2: ' || t2 || ' tier2, ' || total || ' total' WHEN total >= 10 THEN 'large_count: ' || total || ' total (t1=' || t1 || ' t2=' || t2 || ' t3=' || t3 || ')'
  WHEN total <= 2 AND t2 = 0 THEN 'insufficient: ' || total || ' total, all tier3' WHEN k > 1 THEN 'mixed_categories: ' || k || ' categories, ' || total || ' total'
  WHEN total BETWEEN 3 AND 5 AND t2 = 0 THEN 'single_primitive: ' || category || ' only, ' || t3 || ' symbols' ELSE 'default: ' || t1 || ' tier1, ' || t2 || ' tier2, ' || t3 || ' tier3, ' || total || ' total' END"""
query("static_confidence", f"""WITH f AS (SELECT l_orderkey AS file, ({_CATEGORY!r})[l_partkey % {len(_CATEGORY)} + 1] AS category, l_returnflag = 'R' AND l_linenumber = 1 AS detected, CASE WHEN l_linestatus = 'F' AND l_suppkey % 2 = 0 THEN '1.1' ELSE '' END AS version FROM lineitem),
n AS (SELECT file, count(*) FILTER ({_TIER} = 1) AS t1, count(*) FILTER ({_TIER} = 2) AS t2, count(*) FILTER ({_TIER} = 3) AS t3, count(*) AS total, count(DISTINCT category) AS k, min(category) AS category, bool_or(detected) AS hit, max(version) AS v, max(version) <> '' AS named FROM f GROUP BY 1)
SELECT file, t1, t2, t3, total, CASE WHEN hit AND (named OR t1 >= 2) OR t1 >= 5 OR total >= 50 AND t1 >= 1 THEN 'high' WHEN hit OR t1 >= 2 AND total >= 5 OR t2 >= 5 AND total >= 20 THEN 'medium'
  WHEN t1 >= 1 OR t2 >= 1 AND total >= 5 OR total >= 10 THEN 'low' WHEN total <= 2 AND t2 = 0 THEN 'none' WHEN k > 1 THEN 'low' WHEN total BETWEEN 3 AND 5 AND t2 = 0 THEN 'none' ELSE 'low' END AS confidence, {_REASON} AS reason FROM n""")(
    lambda s, d: classify.static_confidence(a.table(s, d, "lineitem").select(F.col("l_orderkey").alias("file"), F.get(F.array(*map(F.lit, _CATEGORY)), (F.col("l_partkey") % len(_CATEGORY)).cast("int")).alias("category"), F.expr("l_returnflag = 'R' and l_linenumber = 1").alias("detected"), F.expr("case when l_linestatus = 'F' and l_suppkey % 2 = 0 then '1.1' else '' end").alias("version"))))
query("resolved_packages", """WITH n AS (SELECT DISTINCT l_orderkey AS package, l_suppkey % 4 AS library FROM lineitem WHERE l_linenumber <= 3), b AS (SELECT DISTINCT l_orderkey AS package, l_partkey % 4 AS library FROM lineitem)
SELECT package, bool_and(b.library IS NOT NULL) AS resolved FROM n LEFT JOIN b USING (package, library) GROUP BY 1""")(
    lambda s, d: classify.all_resolved(a.table(s, d, "lineitem").where("l_linenumber <= 3").selectExpr("l_orderkey as package", "l_suppkey % 4 as library"), a.table(s, d, "lineitem").selectExpr("l_orderkey as package", "l_partkey % 4 as library")))
query("usage_labels", """SELECT c_custkey, CASE WHEN b LIKE 'Yes%' THEN CASE WHEN trim(substr(b, 4)) <> '' THEN 'Bundled ' || trim(substr(b, 4)) ELSE 'Bundled' END WHEN b = 'true' THEN 'Bundled' WHEN k IN ('System-Link', 'In-APP-Link') THEN k ELSE 'None' END AS label
FROM (SELECT c_custkey, (['Yes (static)', 'Yes', 'true', 'false'])[c_custkey % 4 + 1] AS b, (['System-Link', 'In-APP-Link', 'Self-Contained'])[c_custkey % 3 + 1] AS k FROM customer)""")(
    lambda s, d: a.table(s, d, "customer").selectExpr("c_custkey", "element_at(array('Yes (static)', 'Yes', 'true', 'false'), cast(c_custkey % 4 + 1 as int)) as b", "element_at(array('System-Link', 'In-APP-Link', 'Self-Contained'), cast(c_custkey % 3 + 1 as int)) as k").select("c_custkey", classify.usage_label("b", "k").alias("label")))

# Scalar functions and sources

_HEADS = [p for v in categories.PREFIXES.values() for p in v]
query("prefix_categories", f"SELECT symbol, {categories.sql_category('symbol')} AS category FROM (SELECT DISTINCT ({[*_HEADS, 'zz_']!r})[p_partkey % {len(_HEADS) + 1} + 1] || p_brand AS symbol FROM part)")(
    lambda s, d: a.table(s, d, "part").select(F.concat(F.get(F.array(*map(F.lit, [*_HEADS, "zz_"])), (F.col("p_partkey") % (len(_HEADS) + 1)).cast("int")), "p_brand").alias("symbol")).distinct().select("symbol", categories.category_of(F.col("symbol")).alias("category")))
query("path_functions", r"""SELECT page_id, regexp_extract(url, '[^/]*$') AS base, CASE WHEN contains(url, '/') THEN regexp_replace(url, '/[^/]*$', '') ELSE '' END AS dir,
  CASE WHEN starts_with(url, 'https:/') THEN substr(url, 9) ELSE url END AS below, trim(regexp_replace(html, '\s+', ' ', 'g')) AS blanks,
  CASE WHEN left(html, 1) IN ('=', '+', '-', '@') THEN '''' || html ELSE html END AS cell FROM pages""")(
    lambda s, d: a.table(s, d, "pages").select("page_id", text.basename(F.col("url")).alias("base"), text.dirname(F.col("url")).alias("dir"), F.when(F.col("url").startswith("https:/"), F.expr("substring(url, 9)")).otherwise(F.col("url")).alias("below"), text.collapse_blanks(F.col("html")).alias("blanks"), text.safe_cell(F.col("html")).alias("cell")))
query("figure_functions", """SELECT p_partkey, round_even(p_size / 50 * 100, 2)::DOUBLE AS ratio, printf('%.1f%%', p_size::DOUBLE) AS label, floor((p_partkey - 1) / 1048575)::BIGINT AS sheet, coalesce(TRY_CAST(CASE WHEN p_size % 2 = 0 THEN p_size::VARCHAR ELSE 'x' END AS BIGINT), 0) AS whole,
  TRY_CAST(regexp_replace(CASE WHEN p_size % 3 = 0 THEN 'depth_' || p_size ELSE 'depth_x' END, '^depth_', '') AS BIGINT) AS depth FROM part""")(
    lambda s, d: a.table(s, d, "part").select("p_partkey", text.ratio(F.col("p_size"), F.lit(50)).alias("ratio"), text.percent_label(F.col("p_size")).alias("label"), text.sheet_of(F.col("p_partkey")).alias("sheet"), text.lenient_int(F.expr("case when p_size % 2 = 0 then cast(p_size as string) else 'x' end")).alias("whole"), text.depth_of_key(F.expr("case when p_size % 3 = 0 then concat('depth_', p_size) else 'depth_x' end")).alias("depth")))
query("event_properties", """SELECT event_type, (props->>'$.k')::BIGINT % 10 AS k, count(*) AS n FROM events GROUP BY 1, 2""")(
    lambda s, d: a.table(s, d, "events").select("event_type", (F.from_json("props", "k long")["k"] % 10).alias("k")).groupBy("event_type", "k").agg(F.count("*").alias("n")))
query("first_mapped", "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")(
    lambda s, d: usage.first_of(a.table(s, d, "events").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).drop("ts"))

# Joins by parts of strings, by places and by beginnings

query("contained_marks", "WITH m AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]{3,}')) AS mark FROM benchmark) SELECT page_id, mark FROM pages JOIN m ON contains(html, mark)")(
    lambda s, d: substrings.occurrences(a.table(s, d, "pages").select("page_id", "html"), "html", a.table(s, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), F.lit(0))).alias("mark")), "mark"))
_PARTS = """m AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]{3,}')) AS string FROM benchmark)"""
query("fingerprint_parts", f"""WITH {_PARTS}, e AS (SELECT page_id AS file, len(string) % 6 AS category, least(count(*) * 0.75, 3.0 + len(string) % 6) AS points, count(*) AS k FROM pages JOIN m ON contains(html, string) GROUP BY 1, 2),
r AS (SELECT file, sum(points) AS raw, sum(k)::BIGINT AS matched FROM e GROUP BY 1)
SELECT file, matched, round_even((raw / 106 * 100)::DOUBLE, 1) AS score, CASE WHEN raw >= 60 THEN 'high' WHEN raw >= 35 THEN 'medium' WHEN raw >= 15 THEN 'low' ELSE 'none' END AS confidence FROM r""")(
    lambda s, d: classify.fingerprint_scores(a.table(s, d, "pages").selectExpr("page_id as file", "html as string"), a.table(s, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), F.lit(0))).alias("string")).distinct().selectExpr("string", "length(string) % 6 as category", "0.75D as per_point", "cast(3 + length(string) % 6 as double) as max_points", "'substring' as mode")))
query("innermost_spans", """WITH i AS (SELECT p_partkey % 50 AS "group", p_partkey * 7 % 20000 AS start, p_partkey * 7 % 20000 + CASE p_size % 5 WHEN 0 THEN 0 WHEN 1 THEN 40 ELSE p_size * p_size END AS "end", p_partkey AS label FROM part),
p AS (SELECT DISTINCT l_suppkey % 50 AS "group", l_orderkey % 20000 AS place FROM lineitem),
h AS (SELECT p."group", place, label, row_number() OVER (PARTITION BY p."group", place ORDER BY start DESC NULLS LAST, "end", label) AS k FROM p LEFT JOIN i ON i."group" = p."group" AND start <= place AND place < "end")
SELECT "group", place, label FROM h WHERE k = 1""")(
    lambda s, d: intervals.innermost(a.table(s, d, "lineitem").selectExpr("l_suppkey % 50 as group", "l_orderkey % 20000 as place").distinct(), a.table(s, d, "part").selectExpr("p_partkey % 50 as group", "p_partkey * 7 % 20000 as start", "p_partkey * 7 % 20000 + case p_size % 5 when 0 then 0 when 1 then 40 else p_size * p_size end as end", "p_partkey as label"), "group", "place"))
_FILE = "concat('/lib/', replace(p_name, ' ', ''), cast(p_partkey % 50 as varchar(9)), '.so.', cast(p_size as varchar(9)))"
_NODE = f"case when p_size % 11 = 0 then {_FILE} else concat('/usr/', replace(p_name, ' ', ''), cast(p_partkey % 70 as varchar(9)), case p_size % 3 when 0 then '.so' when 1 then concat('.so.', cast(p_size as varchar(9)), '.1') else '' end) end"
query("nodes_by_prefix", f"""WITH f AS (SELECT {_FILE} AS path, p_partkey AS ord FROM part), g AS (SELECT path, min(ord) AS ord, regexp_extract(path, '[^/]*$') AS name FROM f GROUP BY 1), n AS (SELECT DISTINCT {_NODE} AS path FROM part),
h AS (SELECT n.path, g.path AS file, row_number() OVER (PARTITION BY n.path ORDER BY g.path <> n.path, ord) AS k FROM n LEFT JOIN g ON g.path = n.path OR starts_with(name, regexp_extract(n.path, '[^/]*$')) OR starts_with(regexp_extract(n.path, '[^/]*$'), string_split(name, '.so')[1] || '.so'))
SELECT path, file FROM h WHERE k = 1""")(
    lambda s, d: prefixes.first_by_prefix(a.table(s, d, "part").selectExpr(f"{_NODE} as path"), a.table(s, d, "part").selectExpr(f"{_FILE} as path", "p_partkey as ord")))
