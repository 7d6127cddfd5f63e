"""Queries of whole scans: results of files, packages and releases, process trees, and small rules, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkscope.functions import categories, text
from linkscope.operators import classify, graph, scan, summary, trees, usage
from linkscope.plans import adapters as a
from linkscope.plans.registry import query

_HEAD = "^(" + "|".join(p.replace(".", r"\.") for p in categories.LIBRARY_PREFIXES) + ")"
_SSL = lambda x: f"regexp_matches(lower({x}), '{_HEAD}')"

# Files of a scan: lineitem rows, with arrays that follow from their keys

_FILE_COLUMNS = {
    "path": "l_orderkey || '/' || l_linenumber",
    "position": "l_orderkey * 10 + l_linenumber",
    "arch": "case when l_orderkey % 3 = 0 then 'unknown' else concat('arch', l_suppkey % 4) end",
    "und": "case l_partkey % 4 when 1 then array('SSL_new', 'BN_x') when 2 then array('EVP_a') when 3 then array('SHA1_b', 'AES_c', 'AES_d') else {none} end",
    "defs": "case l_suppkey % 5 when 1 then array('SSL_a', 'SSL_b', 'EVP_c', 'BIO_d', 'PEM_e', 'SSL_new') when 2 then array('AES_x') when 3 then array('AES_x', 'AES_y', 'AES_z') when 4 then array('AES_x', 'SHA1_y', 'RSA_z', 'EC_q', 'DSA_w') else {none} end",
    "libs": "case when l_linenumber % 3 = 0 then array('libssl.so.3') else {none} end",
    "banner_library": "case l_returnflag when 'A' then 'OpenSSL' when 'N' then case when l_linenumber % 2 = 0 then 'BoringSSL' end end",
    "banner_version": "case when l_returnflag = 'A' and l_suppkey % 2 = 0 then '1.1.1' end",
    "weak": "l_orderkey % 7 = 0",
    "has_loader": "l_linestatus = 'F'",
    "dl_found": "l_partkey % 2 = 0",
    "dl_symbols": "array('SSL_new', 'EVP_q')",
    "dl_libs": "case when l_suppkey % 3 = 0 then array('libcrypto.so') else {none} end",
    "dl_confidence": "case when l_partkey % 6 = 0 then 'inferred' else 'high' end",
    "hidden": "case when l_partkey % 3 = 0 then array('EVP_h', 'BN_h') else {none} end",
    "print_confidence": "case l_suppkey % 4 when 0 then 'medium' when 1 then '' end",
    "print_library": "case when l_orderkey % 2 = 0 then 'BoringSSL' end",
    "print_score": "cast(l_suppkey % 100 as double)",
    "print_matched": "l_suppkey % 30",
    "print_total": "186",
}
_spark = lambda e: e.replace("{none}", scan.NONE)
_duck = lambda e: e.replace("{none}", "[]::VARCHAR[]").replace("array(", "list_value(")


def _files(s, d):
    return a.table(s, d, "lineitem").selectExpr(*[f"{_spark(e)} as {n}" for n, e in _FILE_COLUMNS.items()])


_TIERS = {k: ", ".join(f"'{c}'" for c in v) for k, v in (("1", categories.TIER_1), ("3", categories.TIER_3))}
_REASON = """CASE WHEN hit AND v <> '' THEN 'version_banner: ' || v || ' (' || total || ' exported)' WHEN hit AND t1 >= 2 THEN library || '_detected: ' || t1 || ' tier1, ' || total || ' total'
  WHEN t1 >= 5 THEN 'tier1_symbols: ' || t1 || ' tier1, ' || total || ' total' WHEN hit THEN 'ssl_detected: ' || library || ' (' || total || ' exported)' WHEN t1 >= 2 AND total >= 5 THEN 'moderate_tier1: ' || t1 || ' tier1, ' || total || ' total'
  WHEN t1 >= 1 THEN 'minimal_tier1: ' || t1 || ' tier1, ' || total || ' total' WHEN t2 >= 1 AND total >= 5 THEN 'weak_tier2: ' || t2 || ' tier2, ' || total || ' total'
  WHEN total <= 2 AND t2 = 0 THEN 'insufficient: ' || total || ' total, all tier3' WHEN k > 1 THEN 'mixed_categories: ' || k || ' categories, ' || total || ' total'
  WHEN total BETWEEN 3 AND 5 AND t2 = 0 THEN 'single_primitive: ' || category || ' only, ' || t3 || ' symbols' ELSE 'default: ' || t1 || ' tier1, ' || t2 || ' tier2, ' || t3 || ' tier3, ' || total || ' total' END"""
_LEVEL = """CASE WHEN hit AND (v <> '' OR t1 >= 2) OR t1 >= 5 THEN 'high' WHEN hit OR t1 >= 2 AND total >= 5 THEN 'medium' WHEN t1 >= 1 OR t2 >= 1 AND total >= 5 THEN 'low'
  WHEN total <= 2 AND t2 = 0 THEN 'none' WHEN k > 1 THEN 'low' WHEN total BETWEEN 3 AND 5 AND t2 = 0 THEN 'none' ELSE 'low' END"""
_RESULTS = f"""files AS (SELECT {", ".join(f"{_duck(e)} AS {n}" for n, e in _FILE_COLUMNS.items())} FROM lineitem),
own AS (SELECT *, list_transform(list_filter(defs, lambda x: NOT list_contains(und, x)), lambda s: {categories.sql_category('s')}) AS kinds FROM files),
cnt AS (SELECT *, len(list_filter(kinds, lambda x: x IN ({_TIERS['1']}))) AS t1, len(list_filter(kinds, lambda x: x IN ({_TIERS['3']}))) AS t3, len(kinds) AS total, len(list_distinct(kinds)) AS k, list_min(kinds) AS category,
  banner_library IS NOT NULL OR weak AS hit, CASE WHEN banner_library IS NOT NULL THEN coalesce(banner_version, '') ELSE '' END AS v, coalesce(banner_library, CASE WHEN weak THEN 'BoringSSL' END) AS library FROM own),
cnt2 AS (SELECT *, total - t1 - t3 AS t2 FROM cnt), lev AS (SELECT *, {_LEVEL} AS level, {_REASON} AS why FROM cnt2),
b1 AS (SELECT *, total > 0 AND level <> 'none' AS by_exports, hit AND len(libs) = 0 AS by_banner FROM lev),
b2 AS (SELECT *, by_banner AND len(defs) = 0 AS bare, NOT by_exports AND NOT by_banner AND len(libs) = 0 AND coalesce(print_confidence <> '', false) AS by_print FROM b1),
b3 AS (SELECT *, CASE WHEN (bare OR by_print) AND len(hidden) > 0 THEN hidden WHEN by_exports THEN und || list_filter(defs, lambda x: NOT list_contains(und, x)) ELSE und END AS inside,
  len(libs) > 0 OR by_exports OR bare OR by_print AS is_direct, has_loader AND NOT (bare OR by_print) AND dl_found AS seen FROM b2),
b4 AS (SELECT *, seen AND (NOT is_direct OR len(dl_libs) > 0) AS uses_dlopen FROM b3),
b5 AS (SELECT *, CASE WHEN uses_dlopen THEN list_filter(dl_symbols, lambda x: NOT list_contains(inside, x)) ELSE []::VARCHAR[] END AS dlsym, CASE WHEN seen THEN dl_libs ELSE []::VARCHAR[] END AS dlopen_libs FROM b4),
results AS (SELECT path, position, arch, is_direct, libs, inside || dlsym AS symbols, by_exports OR by_banner OR by_print AS is_static, CASE WHEN by_banner THEN library WHEN by_print THEN coalesce(print_library, 'OpenSSL') ELSE '' END AS static_library,
  CASE WHEN by_banner AND banner_library IS NOT NULL THEN banner_version END AS static_version, CASE WHEN by_exports THEN level WHEN by_print THEN print_confidence WHEN by_banner AND level <> 'none' THEN level ELSE '' END AS confidence,
  CASE WHEN by_exports THEN why WHEN by_print THEN printf('fingerprint: score=%.1f matched=%d/%d', print_score, print_matched, print_total) WHEN by_banner AND level <> 'none' THEN why ELSE '' END AS reason,
  defs AS exported, uses_dlopen, dlsym, dlopen_libs, CASE WHEN uses_dlopen THEN dl_confidence END AS dlopen_confidence FROM b5)"""
_ARRAYS = ["libs", "symbols", "exported", "dlsym", "dlopen_libs"]
query("file_results", f"WITH {_RESULTS} SELECT * EXCLUDE (position, arch) REPLACE ({', '.join(f'''array_to_string({c}, ',') AS {c}''' for c in _ARRAYS)}) FROM results")(
    lambda s, d: scan.file_results(_files(s, d)).withColumns({c: F.array_join(c, ",") for c in _ARRAYS}))
query("scan_roll_up", f"""WITH {_RESULTS}, y AS (SELECT DISTINCT unnest(dlsym) AS s FROM results), z AS (SELECT DISTINCT unnest(dlopen_libs) AS s FROM results)
SELECT (SELECT count(*) FROM results WHERE is_static) AS n_static, (SELECT count(*) FROM results WHERE uses_dlopen) AS n_dlopen, (SELECT count(*) FROM y) AS n_loaded_symbols, (SELECT coalesce(string_agg(s, ',' ORDER BY s), '') FROM y) AS loaded_symbols,
  (SELECT count(*) FROM z) AS n_loaded_libraries, (SELECT coalesce(string_agg(s, ',' ORDER BY s), '') FROM z) AS loaded_libraries""")(lambda s, d: scan.roll_up(scan.file_results(_files(s, d))))
query("scan_file_totals", f"""WITH {_RESULTS} SELECT count(*) AS n_files, count(*) FILTER (len(symbols) > 0) AS n_with_symbols, sum(len(symbols))::BIGINT AS n_references, (SELECT count(DISTINCT x) FROM (SELECT unnest(symbols) AS x FROM results)) AS n_symbols,
  coalesce(arg_min(arch, position) FILTER (arch <> 'unknown'), 'unknown') AS arch FROM results""")(lambda s, d: scan.totals(scan.file_results(f := _files(s, d)), f))
query("symbol_detection", f"""WITH {_RESULTS}, e AS (SELECT path, dlsym, dlopen_confidence, is_static, unnest(list_distinct(symbols)) AS symbol FROM results)
SELECT path, symbol, CASE WHEN list_contains(dlsym, symbol) THEN CASE WHEN dlopen_confidence = 'inferred' THEN 'dlopen-infer' ELSE 'dlopen' END WHEN is_static THEN 'static-link' ELSE 'dynamic-link' END AS detection FROM e""")(
    lambda s, d: scan.detection(scan.file_results(_files(s, d))))
query("file_link_types", f"""WITH {_RESULTS} SELECT path, CASE WHEN uses_dlopen THEN CASE WHEN dlopen_confidence = 'inferred' THEN 'dlopen-infer' ELSE 'dlopen' END WHEN is_static THEN 'static-link' WHEN is_direct THEN 'dynamic-link' ELSE '' END AS link FROM results""")(
    lambda s, d: scan.link_type(scan.file_results(_files(s, d))))
query("transitive_files", f"""WITH RECURSIVE {a.ALL_EDGES}, r AS (SELECT node, 0 AS depth FROM targets UNION SELECT e.src, r.depth + 1 FROM r JOIN edges e ON e.dst = r.node WHERE r.depth < {a.HOPS}),
low AS (SELECT node, min(depth) AS depth FROM r GROUP BY 1) SELECT o_orderkey AS path, o_orderstatus = 'F' AS is_direct, o_orderstatus <> 'F' AND coalesce(low.depth > 0, false) AS is_transitive FROM orders LEFT JOIN low ON node = o_orderkey""")(
    lambda s, d: scan.mark_transitive(a.table(s, d, "orders").selectExpr("o_orderkey as path", "o_orderstatus = 'F' as is_direct"), a.all_edges(s, d), a.all_targets(s, d), a.HOPS))

# Packages: orders, whose lines are their files

_FACTS = {
    "package": "l_orderkey",
    "path": "concat('libs/x/lib', l_partkey % 6, '.so')",
    "symbols": "case when l_linenumber % 4 = 0 then {none} else array(concat('s', l_partkey % 50), concat('t', l_suppkey % 50)) end",
    "dlsym": "case when l_returnflag = 'A' and l_linenumber % 2 = 1 then array(concat('t', l_suppkey % 50)) else {none} end",
    "is_static": "l_linestatus = 'F' and l_linenumber = 2",
    "confidence": "case l_partkey % 3 when 0 then 'high' when 1 then 'medium' else 'low' end",
    "uses_dlopen": "l_returnflag = 'A'",
    "dlopen_libs": "case l_suppkey % 3 when 0 then array('libcrypto.so.3') when 1 then array('libz.so') else {none} end",
    "libs": "case when l_partkey % 2 = 0 then array('libssl.so.1.1') else {none} end",
    "deps": "array(concat('lib', l_suppkey % 6, '.so'))",
}
_BUNDLED = "SELECT o_orderkey AS package, 'libcrypto.so' AS library FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT o_orderkey, 'libssl.so' FROM orders WHERE o_orderkey % 2 = 0"


def _package_files(s, d):
    return a.table(s, d, "lineitem").selectExpr(*[f"{_spark(e)} as {n}" for n, e in _FACTS.items()])


def _bundled(s, d):
    o = a.table(s, d, "orders")
    return o.where("o_orderkey % 5 = 0").selectExpr("o_orderkey as package", "'libcrypto.so' as library").unionByName(o.where("o_orderkey % 2 = 0").selectExpr("o_orderkey as package", "'libssl.so' as library"))


def _releases(s, d):
    return a.table(s, d, "orders").selectExpr("o_orderkey as package", "concat(o_custkey, '/', o_orderpriority) as release")


def _kinds(name: str, source: str) -> str:
    """CTEs that end in one of that name: method and kind of the packages of a relation with stems and providers."""
    resolved = lambda x: f"(len(list_filter({x}, lambda y: {_SSL('y')})) > 0 AND len(list_filter({x}, lambda y: {_SSL('y')} AND NOT list_contains(stems, lower(string_split(y, '.so')[1])))) = 0)"
    return f"""{name}1 AS (SELECT *, len(dlsym) > 0 OR len(list_filter(dlopen_libs, lambda y: {_SSL('y')})) > 0 AS ev, len(symbols) > 0 AS has FROM {source}),
{name}2 AS (SELECT *, uses_dlopen AND (ev OR NOT is_static AND has) AS loads, NOT is_static AND NOT uses_dlopen AND has AS directly FROM {name}1),
{name}3 AS (SELECT *, CASE WHEN loads THEN list_filter(symbols, lambda y: NOT list_contains(dlsym, y)) ELSE symbols END AS rest, CASE WHEN loads THEN NOT {resolved('dlopen_libs')} WHEN is_static THEN len(libs) > 0 AND NOT {resolved('libs')}
  WHEN directly AND len(libs) > 0 THEN NOT {resolved('libs')} WHEN directly THEN NOT list_has_any(deps, providers) ELSE false END AS lacking FROM {name}2),
{name}4 AS (SELECT package, 'static' AS way, unnest(rest) AS s FROM {name}3 WHERE is_static UNION SELECT package, 'dynamic', unnest(rest) FROM {name}3 WHERE NOT is_static AND (loads OR directly) UNION SELECT package, 'dlopen', unnest(dlsym) FROM {name}3 WHERE loads),
{name}5 AS (SELECT package, count(DISTINCT s) FILTER (way = 'static') AS n_static, count(DISTINCT s) FILTER (way = 'dynamic') AS n_dynamic, count(DISTINCT s) FILTER (way = 'dlopen') AS n_dlopen, count(DISTINCT s) AS n_symbols FROM {name}4 GROUP BY 1),
{name}6 AS (SELECT package, bool_or(is_static) AS st, bool_or(loads) AS dl, bool_or(loads AND NOT is_static AND len(rest) > 0 OR directly) AS dy, bool_or(lacking) AS op FROM {name}3 GROUP BY 1),
{name} AS (SELECT package, CASE st::INT + dl::INT + dy::INT WHEN 0 THEN 'None' WHEN 1 THEN CASE WHEN dy THEN 'Dynamic' WHEN st THEN 'Static' ELSE 'dlopen' END ELSE 'Mixed' END AS method,
  CASE WHEN coalesce(n_symbols, 0) = 0 AND NOT dl THEN 'No-OpenSSL' WHEN NOT op THEN 'Self-Contained' ELSE 'System-Link' END AS kind, coalesce(n_static, 0) AS n_static, coalesce(n_dynamic, 0) AS n_dynamic, coalesce(n_dlopen, 0) AS n_dlopen, coalesce(n_symbols, 0) AS n_symbols
  FROM {name}6 LEFT JOIN {name}5 USING (package))"""


_PACKAGES = f"""pf AS (SELECT {", ".join(f"{_duck(e)} AS {n}" for n, e in _FACTS.items())} FROM lineitem), bundled AS ({_BUNDLED}),
held AS (SELECT package, library, false AS provider FROM bundled UNION ALL SELECT package, regexp_extract(path, '[^/]*$'), true FROM pf WHERE is_static AND confidence IN ('high', 'medium')),
st AS (SELECT package, list(DISTINCT lower(string_split(library, '.so')[1])) AS stems FROM held GROUP BY 1),
first_source AS (SELECT pf.*, coalesce(stems, []) AS stems, []::VARCHAR[] AS providers FROM pf LEFT JOIN st USING (package)), {_kinds('alone', 'first_source')}"""
query("package_methods", f"WITH {_PACKAGES} SELECT * FROM alone")(lambda s, d: classify.package_methods(_package_files(s, d), _bundled(s, d)))
query("release_packages", f"""WITH {_PACKAGES}, rel AS (SELECT o_orderkey AS package, o_custkey || '/' || o_orderpriority AS release FROM orders),
rh AS (SELECT release, list(DISTINCT lower(string_split(library, '.so')[1])) AS stems, list(CASE WHEN provider THEN {{'p': package, 'l': library}} END) AS held FROM held JOIN rel USING (package) GROUP BY 1),
wait AS (SELECT alone.package, rh.stems, list_transform(list_filter(rh.held, lambda x: x.p <> alone.package), lambda x: x.l) AS providers FROM alone JOIN rel USING (package) JOIN rh USING (release)
  WHERE kind = 'System-Link' AND release IN (SELECT release FROM rel GROUP BY 1 HAVING count(*) > 1)),
again_source AS (SELECT pf.*, stems, providers FROM pf JOIN wait USING (package)), {_kinds('again', 'again_source')}
SELECT alone.* REPLACE (CASE WHEN again.kind = 'Self-Contained' THEN 'In-APP-Link' ELSE alone.kind END AS kind) FROM alone LEFT JOIN again USING (package)""")(
    lambda s, d: classify.in_release(_package_files(s, d), _bundled(s, d), _releases(s, d)))
query("package_batch", f"""WITH {_PACKAGES} SELECT count(DISTINCT package) AS n_packages, count(*) AS n_files, count(*) FILTER (len(symbols) > 0) AS n_with_symbols, count(*) FILTER (is_static) AS n_static, count(*) FILTER (uses_dlopen) AS n_dlopen,
  (SELECT count(DISTINCT x) FROM (SELECT unnest(symbols) AS x FROM pf)) AS n_symbols, (SELECT count(DISTINCT x) FROM (SELECT unnest(dlsym) AS x FROM pf)) AS n_loaded FROM pf""")(lambda s, d: scan.package_batch(_package_files(s, d)))
_NAMED = {"package": "l_orderkey", "path": "concat('libs/', case l_partkey % 5 when 0 then 'libcrypto.so.3' when 1 then 'LibSSL.so' when 2 then 'libcrypto.a' else 'libmine.so' end)"}
query("bundled_libraries", r"""SELECT DISTINCT l_orderkey AS package, CASE l_partkey % 5 WHEN 0 THEN 'libcrypto.so.3' ELSE 'LibSSL.so' END AS library FROM lineitem WHERE l_partkey % 5 < 2""")(
    lambda s, d: scan.without_bundled(a.table(s, d, "lineitem").selectExpr(*[f"{e} as {n}" for n, e in _NAMED.items()]))[1])
query("files_to_scan", "SELECT l_orderkey AS package, CASE l_partkey % 5 WHEN 2 THEN 'libs/libcrypto.a' ELSE 'libs/libmine.so' END AS path, count(*) AS n FROM lineitem WHERE l_partkey % 5 >= 2 GROUP BY 1, 2")(
    lambda s, d: scan.without_bundled(a.table(s, d, "lineitem").selectExpr(*[f"{e} as {n}" for n, e in _NAMED.items()]))[0].groupBy("package", "path").agg(F.count("*").alias("n")))
query("bundled_texts", f"""WITH b AS ({_BUNDLED}) SELECT o_orderkey AS package, CASE WHEN o_orderkey IN (SELECT package FROM b) THEN 'true' WHEN o_custkey % 3 = 0 THEN 'Yes (static)' ELSE 'false' END AS bundled FROM orders""")(
    lambda s, d: scan.bundled_text(a.table(s, d, "orders").selectExpr("o_orderkey as package"), _bundled(s, d), a.table(s, d, "orders").where("o_custkey % 3 = 0").selectExpr("o_orderkey as package", "'Yes (static)' as label")))

# Processes

query("runtime_only", """WITH m AS (SELECT DISTINCT user_id AS pid, '/lib/' || event_id % 20 AS path FROM events), t AS (SELECT DISTINCT user_id AS pid, '/lib/' || event_id % 7 AS path FROM events)
SELECT m.pid, m.path, t.path IS NULL AS runtime_only FROM m LEFT JOIN t ON t.pid = m.pid AND t.path = m.path""")(
    lambda s, d: scan.runtime_only(a.table(s, d, "events").selectExpr("user_id as pid", "concat('/lib/', event_id % 20) as path").distinct(), a.table(s, d, "events").selectExpr("user_id as pid", "concat('/lib/', event_id % 7) as path")))


def tree(s, d):
    """What trees of all customers' orders are made of: order to part, part to the smaller part at half its key; the roots; the files that exist."""
    l = a.table(s, d, "lineitem").selectExpr("concat('o', l_orderkey) as src", "concat('p', l_partkey) as dst", "l_linenumber as position")
    p = a.table(s, d, "part").where("p_partkey > 1").selectExpr("concat('p', p_partkey) as src", "concat('p', floor(p_partkey / 2)) as dst", "1 as position")
    files = l.select(F.col("src").alias("path")).union(a.table(s, d, "part").where("p_partkey <> 3").selectExpr("concat('p', p_partkey)"))
    return l.unionByName(p), a.table(s, d, "orders").selectExpr("concat('o', o_orderkey) as node"), files


query("dependency_trees")(lambda s, d: trees.trees(*tree(s, d)))
query("tree_places")(lambda s, d: trees.first_places_of(*tree(s, d)))
query("tree_files")(lambda s, d: trees.collected_of(*tree(s, d)))
query("tree_symbols_by_depth")(lambda s, d: trees.symbols_by_depth_of(*tree(s, d), a.table(s, d, "part").selectExpr("concat('p', p_partkey) as name", "p_brand as symbol")))
query("tree_chains")(lambda s, d: trees.import_chains_of(*tree(s, d), a.table(s, d, "part").where("p_size < 5").selectExpr("concat('p', p_partkey) as name", "p_brand as symbol")))
query("tree_transitive")(lambda s, d: trees.has_library_below_of(*tree(s, d), a.table(s, d, "part").where("p_size < 5").selectExpr("concat('p', p_partkey) as name")))

# Small rules

query("fallback_counts", f"WITH {a.CALLS} SELECT count(*) FILTER (line % 5 = 0) AS n_fallback_calls, count(DISTINCT file) FILTER (line % 5 = 0) AS n_fallback_files FROM calls")(
    lambda s, d: usage.fallback_counts(a.calls(s, d).withColumn("confidence", F.expr("case when line % 5 = 0 then 'fallback' else 'high' end"))))
query("symbol_dimension", """SELECT symbol, min(origin) AS origin FROM (SELECT p_brand AS symbol, 'library' AS origin FROM part UNION ALL SELECT p_type, 'macro' FROM part UNION ALL SELECT p_brand, 'custom' FROM part WHERE p_size < 20 UNION ALL SELECT '', 'custom') WHERE symbol <> '' GROUP BY 1""")(
    lambda s, d: usage.symbol_dimension(*[(p := a.table(s, d, "part")).where(w).selectExpr(f"{c} as symbol", f"'{o}' as origin") for c, o, w in (("p_brand", "library", "true"), ("p_type", "macro", "true"), ("p_brand", "custom", "p_size < 20"), ("''", "custom", "true"))]))
query("excluded_projects", "SELECT page_id, url FROM pages WHERE NOT contains(url, 'a1') AND NOT contains(url, '/b')")(
    lambda s, d: usage.excluded(a.table(s, d, "pages").select("page_id", "url"), ["a1", "/b"], "url"))
query("symbol_files", f"""WITH {a.CALLS}, e AS (SELECT symbol, project AS file, min(category) AS category, count(*) AS n FROM calls GROUP BY 1, 2)
SELECT symbol, min(category) AS category, sum(n)::BIGINT AS n_calls, count(*) AS n_files, string_agg(file::VARCHAR, ';' ORDER BY file::VARCHAR) AS files FROM e GROUP BY 1""")(
    lambda s, d: usage.summary_with_files(a.calls(s, d).drop("file").withColumnRenamed("project", "file")))
query("library_names", rf"""SELECT p_partkey, string_split(n, '.so')[1] AS stem, contains(lower(n), '.so') AND {_SSL('n')} AS is_library, {_SSL('n')} AS is_named FROM (SELECT p_partkey, (['libcrypto.so.3', 'libssl-x.so', 'LIBSSL.SO.1', 'libcrypto', 'libz.so', 'libopenssl_a.so', 'mylibssl.so'])[p_partkey % 7 + 1] AS n FROM part)""")(
    lambda s, d: a.table(s, d, "part").select("p_partkey", F.get(F.array(*map(F.lit, ["libcrypto.so.3", "libssl-x.so", "LIBSSL.SO.1", "libcrypto", "libz.so", "libopenssl_a.so", "mylibssl.so"])), (F.col("p_partkey") % 7).cast("int")).alias("n")).select("p_partkey", text.library_stem(F.col("n")).alias("stem"), text.is_library(F.col("n"), categories.LIBRARY_PREFIXES).alias("is_library"), text.is_ssl_name(F.col("n")).alias("is_named")))
query("relative_paths", r"""WITH u AS (SELECT page_id, (['/work/out/a/b.c', '/work/outer/a.c', '/else/out/x/y.c', 'plain.c', '/work/out'])[page_id % 5 + 1] AS p FROM pages)
SELECT page_id, CASE WHEN starts_with(p, '/work/out/') THEN substr(p, 11) ELSE p END AS below, CASE WHEN starts_with(p, '/work/out/') THEN substr(p, 11) WHEN contains(p, '/out/') THEN string_split(p, '/out/')[-1] ELSE regexp_extract(p, '[^/]*$') END AS relative, len(string_split(replace(p, '/', ' -> '), ' -> ')) - 1 AS depth FROM u""")(
    lambda s, d: a.table(s, d, "pages").select("page_id", F.get(F.array(*map(F.lit, ["/work/out/a/b.c", "/work/outer/a.c", "/else/out/x/y.c", "plain.c", "/work/out"])), (F.col("page_id") % 5).cast("int")).alias("p")).select("page_id", text.strip_prefix(F.col("p"), "/work/out").alias("below"), text.relative_path(F.col("p"), "/work/out").alias("relative"), text.chain_depth(F.replace("p", F.lit("/"), F.lit(" -> "))).alias("depth")))

# Tables of reports

_PROCESS_EDGES = ["l_orderkey as process", "concat('/x/', l_linenumber, '/a', l_suppkey) as src", "concat('/y/b', l_partkey) as dst"]
query("symbol_components", f"WITH {a.COMPONENTS} SELECT symbol, count(DISTINCT component) AS n_components, string_agg(DISTINCT component, ',' ORDER BY component) AS components FROM facts GROUP BY 1")(
    lambda s, d: summary.symbol_components(a.components(s, d)))
query("shared_libraries", "SELECT 'b' || l_partkey AS library, count(DISTINCT l_orderkey) AS n_processes FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey) > 1")(
    lambda s, d: summary.shared_libraries(a.table(s, d, "lineitem").selectExpr(*_PROCESS_EDGES)))
query("shared_graph", """WITH e AS (SELECT l_orderkey AS process, 'a' || l_suppkey AS src, 'b' || l_partkey AS dst FROM lineitem), n AS (SELECT node FROM (SELECT process, src AS node FROM e UNION SELECT process, dst FROM e) GROUP BY 1 HAVING count(*) > 1)
SELECT DISTINCT src, dst FROM e WHERE src IN (FROM n) AND dst IN (FROM n)""")(lambda s, d: summary.shared_graph(a.table(s, d, "lineitem").selectExpr(*_PROCESS_EDGES)))
query("chain_graph", f"""WITH RECURSIVE {a.ALL_PATHS}, i AS (SELECT path, unnest(range(1, len(path))) AS k FROM paths), n AS (SELECT path[k] AS node FROM i UNION SELECT path[k + 1] FROM i)
SELECT src, dst FROM edges WHERE src IN (FROM n) AND dst IN (FROM n)""")(lambda s, d: summary.chain_graph(e := a.all_edges(s, d), graph.chain_edges(graph.paths_to(e, a.all_targets(s, d), a.HOPS))))
query("error_rows", "SELECT o_orderkey, upper(coalesce(CASE WHEN o_custkey % 3 = 0 THEN NULL WHEN o_custkey % 3 = 1 THEN 'error' ELSE 'Info' END, 'warning')) AS severity FROM orders")(
    lambda s, d: summary.error_rows(a.table(s, d, "orders").selectExpr("o_orderkey", "case when o_custkey % 3 = 0 then null when o_custkey % 3 = 1 then 'error' else 'Info' end as severity")))
query("first_errors", """WITH e AS (SELECT 'f' || o_orderkey AS file, o_orderpriority AS message FROM orders WHERE o_orderstatus = 'P') SELECT * FROM (SELECT * FROM e ORDER BY file, message LIMIT 10)
UNION ALL SELECT '', printf('... and %d more', count(*) - 10) FROM e HAVING count(*) > 10""")(
    lambda s, d: summary.first_errors(a.table(s, d, "orders").where("o_orderstatus = 'P'").selectExpr("concat('f', o_orderkey) as file", "o_orderpriority as message")))
query("manifest_rows", """WITH m AS (SELECT 'p/' || s_suppkey % 60 AS path, max(s_name) AS name, max('http://h/' || s_suppkey) AS url FROM supplier GROUP BY 1)
SELECT c_custkey, path, coalesce(name, '') AS name, coalesce(url, '') AS url FROM (SELECT c_custkey, 'p/' || c_custkey % 90 AS path FROM customer) LEFT JOIN m USING (path)""")(
    lambda s, d: summary.manifest_rows(a.table(s, d, "customer").selectExpr("c_custkey", "concat('p/', c_custkey % 90) as path"), a.table(s, d, "supplier").selectExpr("concat('p/', s_suppkey % 60) as path", "s_name as name", "concat('http://h/', s_suppkey) as url")))
query("used_repositories", f"""WITH {a.CALLS}, r AS (SELECT project, count(*) AS n_calls, count(DISTINCT symbol) AS n_symbols FROM calls GROUP BY 1 UNION ALL SELECT s_suppkey + 1000, 0, 0 FROM supplier)
SELECT *, row_number() OVER (ORDER BY n_symbols DESC, n_calls DESC, project) AS place FROM r WHERE n_calls > 0""")(
    lambda s, d: summary.used_repositories(a.calls(s, d).groupBy("project").agg(F.count("*").alias("n_calls"), F.countDistinct("symbol").alias("n_symbols")).unionByName(a.table(s, d, "supplier").selectExpr("s_suppkey + 1000 as project", "0L as n_calls", "0L as n_symbols"))))
query("searched_symbols", f"WITH {a.CALLS} SELECT symbol, min(category) AS category, count(*) AS n_calls, count(DISTINCT file) AS n_files FROM calls GROUP BY 1 HAVING contains(lower(symbol), 's1') ORDER BY symbol LIMIT 500")(
    lambda s, d: summary.searched_symbols(usage.symbol_summary(a.calls(s, d)), "S1"))
query("category_total", f"""WITH {a.CALLS}, c AS (SELECT category, count(DISTINCT symbol) AS n_symbols FROM calls GROUP BY 1)
SELECT category, n_symbols, printf('%.1f%%', n_symbols / (SELECT sum(n_symbols) FROM c) * 100) AS share FROM c UNION ALL SELECT 'TOTAL', sum(n_symbols)::BIGINT, '100.0%' FROM c""")(
    lambda s, d: summary.category_total(usage.by_category(a.calls(s, d)).select("category", "n_symbols")))
query("shared_objects", "SELECT l_partkey AS name, 'd/f' || l_suppkey || CASE l_linenumber % 4 WHEN 0 THEN '.so' WHEN 1 THEN '.so.1' WHEN 2 THEN '.sox' ELSE '' END AS file FROM lineitem WHERE l_linenumber % 4 < 2")(
    lambda s, d: classify.shared_objects(a.table(s, d, "lineitem").selectExpr("l_partkey as name", "concat('d/f', l_suppkey, case l_linenumber % 4 when 0 then '.so' when 1 then '.so.1' when 2 then '.sox' else '' end) as file")))
