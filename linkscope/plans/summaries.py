"""Queries of detection by strings, resolution by name, and summary tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkscope.operators import banners, diff, resolve, summary, usage
from linkscope.plans import adapters as a
from linkscope.plans.registry import query
from linkscope.sources import repositories

STRINGS = ["OpenSSL 1.1.1k  25 Mar 2021", "OpenSSL 3.0.2", "BoringSSL", "OpenSSL 1.1.1 (compatible; BoringSSL)", "LibreSSL 3.3.6", "boringssl/src/crypto/a.c", "boringssl/src/ssl/b.c", "boringssl/src/crypto/c.c", "boringssl/src/tool/d.c", "-fvisibility=hidden", "OPENSSLDIR: /usr", "ENGINESDIR: /e", "ECH_REJECTED", "COULD_NOT_PARSE_HINTS", "SSL_CTX_new", "SSL_connect", "RAND_bytes", "BN_CTX_new", "plain text", "x OpenSSL y", "OpenSSL 0.9.8zh-beta"]


def _strings(s, d):
    at = ((F.col("l_partkey") * 7 + F.col("l_linenumber")) % (4 * len(STRINGS))).cast("int")
    return a.table(s, d, "lineitem").select(F.col("l_orderkey").alias("file"), F.coalesce(F.get(F.array(*map(F.lit, STRINGS)), at), F.lit("other")).alias("text"))


query("banner_detection", rf"""WITH s AS (SELECT DISTINCT l_orderkey AS file, coalesce(({STRINGS!r})[(l_partkey * 7 + l_linenumber) % {4 * len(STRINGS)} + 1], 'other') AS t FROM lineitem),
k AS (SELECT *, regexp_extract(t, '{banners.KEYWORDS}') AS kw, t IN ({", ".join(f"'{e}'" for e in banners.ERRORS)}) AS err, t IN ({", ".join(f"'{e}'" for e in banners.SENTINELS)}) AS probe FROM s),
n AS (SELECT file, min(nullif(regexp_extract(t, '{banners.STRICT}', 1), '')) FILTER (kw = 'OpenSSL') AS strict, min(nullif(regexp_extract(t, '{banners.LOOSE}', 1), '')) FILTER (kw = 'OpenSSL') AS loose,
  min(nullif(regexp_extract(t, '{banners.LIBRE}', 1), '')) FILTER (kw = 'LibreSSL') AS libre, bool_or(kw = 'BoringSSL' OR kw = 'OpenSSL' AND contains(t, 'BoringSSL')) AS boring,
  count(*) FILTER (kw = 'boringssl/src/' AND regexp_matches(t, '{banners.SOURCE}')) AS src, count(*) FILTER (err) AS err, count(*) FILTER (probe) AS k,
  bool_or(kw = '-fvisibility=hidden') AS hid, bool_or(kw = 'OPENSSLDIR:' OR kw = 'ENGINESDIR:') AS dirs FROM k WHERE kw <> '' OR err OR probe GROUP BY 1)
SELECT file, CASE WHEN strict IS NOT NULL THEN 'OpenSSL' WHEN src >= 3 OR err >= 2 OR boring AND (k >= 3 OR hid) THEN 'BoringSSL' WHEN libre IS NOT NULL AND (k >= 3 OR hid) THEN 'LibreSSL'
  WHEN loose IS NOT NULL AND (k >= 3 OR (hid OR dirs) AND k >= 1) THEN 'OpenSSL' END AS library,
  CASE WHEN strict IS NOT NULL THEN strict WHEN src >= 3 OR err >= 2 OR boring AND (k >= 3 OR hid) THEN NULL WHEN libre IS NOT NULL AND (k >= 3 OR hid) THEN libre
  WHEN loose IS NOT NULL AND (k >= 3 OR (hid OR dirs) AND k >= 1) THEN loose END AS version, k AS n_corroborating FROM n""")(
    lambda s, d: banners.banners(_strings(s, d), s.createDataFrame([(x,) for x in banners.SENTINELS], "symbol string")).select("file", "library", "version", "n_corroborating"))
query("library_vote", """WITH p AS (SELECT l_orderkey AS file, CASE l_partkey % 4 WHEN 0 THEN 'OpenSSL' WHEN 1 THEN 'BoringSSL' WHEN 2 THEN 'LibreSSL' END AS library, l_linenumber AS points FROM lineitem),
s AS (SELECT file, library, sum(points) AS n FROM p WHERE library IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY file ORDER BY n DESC, library) = 1)
SELECT DISTINCT file, coalesce(s.library, 'OpenSSL') AS library FROM p LEFT JOIN s USING (file)""")(
    lambda s, d: banners.library_vote(a.table(s, d, "lineitem").selectExpr("l_orderkey as file", "case l_partkey % 4 when 0 then 'OpenSSL' when 1 then 'BoringSSL' when 2 then 'LibreSSL' end as library", "l_linenumber as points")))
query("weak_symbols", f"""SELECT l_orderkey AS file FROM lineitem WHERE l_partkey % 9 < 3 GROUP BY 1 HAVING count(DISTINCT ({banners.WEAK!r})[l_partkey % 9 + 1]) >= 2""")(
    lambda s, d: banners.weak_symbols(a.table(s, d, "lineitem").select(F.col("l_orderkey").alias("file"), F.get(F.array(*map(F.lit, banners.WEAK)), (F.col("l_partkey") % 9).cast("int")).alias("symbol"))))
query("probe_symbols", f"""SELECT symbol FROM (SELECT DISTINCT p_name || p_partkey AS symbol, p_brand AS category FROM part WHERE length(p_name || p_partkey) >= 12 QUALIFY row_number() OVER (PARTITION BY category ORDER BY symbol) <= 2)
UNION SELECT unnest({banners.SENTINELS!r})""")(lambda s, d: banners.probes(a.table(s, d, "part").selectExpr("concat(p_name, cast(p_partkey as string)) as symbol", "p_brand as category")))

query("resolved_libraries", """WITH f AS (SELECT DISTINCT '/' || (['opt', 'usr', 'lib', 'app/lib'])[s_suppkey % 4 + 1] || '/lib' || s_suppkey % 25 || '.so' AS path FROM supplier),
r AS (SELECT p_partkey AS id, 'lib' || p_size || '.so' AS library, CASE p_partkey % 3 WHEN 0 THEN ['/opt', '/app/lib'] WHEN 1 THEN ['/none'] ELSE [] END || CASE p_partkey % 2 WHEN 0 THEN ['/lib'] ELSE [] END || ['/usr', '/lib'] AS dirs FROM part),
e AS (SELECT id, unnest(range(1, len(dirs) + 1)) AS i, dirs, library FROM r), h AS (SELECT id, arg_min(path, i) AS path FROM e JOIN f ON path = dirs[i] || '/' || library GROUP BY 1)
SELECT r.id, library, path FROM r LEFT JOIN h USING (id)""")(
    lambda s, d: resolve.resolve(
        a.table(s, d, "part").selectExpr("p_partkey as id", "concat('lib', p_size, '.so') as library", "case p_partkey % 3 when 0 then '/opt:$ORIGIN/lib' when 1 then '/none' end as rpath", "case p_partkey % 2 when 0 then '/lib' end as runpath", "'/app' as origin"),
        a.table(s, d, "supplier").selectExpr("concat('/', element_at(array('opt', 'usr', 'lib', 'app/lib'), cast(s_suppkey % 4 + 1 as int)), '/lib', s_suppkey % 25, '.so') as path"), ["/usr", "/lib"]).select("id", "library", "path"))
query("library_folders", """SELECT DISTINCT '/r/' || p_brand || CASE WHEN p_size % 3 = 0 THEN '/x' || p_size ELSE '' END AS folder, CASE WHEN p_size % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS depth FROM part WHERE p_partkey % 4 <> 3 AND p_size % 5 <> 0""")(
    lambda s, d: resolve.library_folders(a.table(s, d, "part").selectExpr("concat('/r/', p_brand, case when p_size % 5 = 0 then '/share' else '' end, case when p_size % 3 = 0 then concat('/x', p_size) else '' end, '/lib', case p_partkey % 4 when 3 then '.txt' when 2 then '.so.1' else '.so' end) as path"), "/r"))
query("static_providers", """WITH f AS (SELECT l_orderkey AS package, 'l' || l_linenumber AS name, l_suppkey || '/l' || l_linenumber AS path, CASE l_partkey % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' END AS confidence,
  CASE WHEN l_suppkey % 2 = 0 THEN 'fingerprint: x' ELSE 'banner' END AS reason, l_partkey % 50 AS n_symbols, 'l' || (l_linenumber + 1) AS needs FROM lineitem),
b AS (SELECT * FROM f WHERE confidence IN ('high', 'medium') QUALIFY row_number() OVER (PARTITION BY package, name ORDER BY n_symbols DESC, path) = 1),
u AS (SELECT b.package, b.name, b.confidence, b.n_symbols, starts_with(b.reason, 'fingerprint:') AS hidden, coalesce(string_agg(DISTINCT f.name, ',' ORDER BY f.name), '') AS consumers FROM b LEFT JOIN f ON f.package = b.package AND f.needs = b.name AND f.name <> b.name GROUP BY ALL)
SELECT *, CASE WHEN bool_or(consumers <> '') OVER (PARTITION BY package) THEN 'Yes (static, shared)' WHEN bool_and(hidden) OVER (PARTITION BY package) THEN 'Yes (static, hidden)' ELSE 'Yes (static)' END AS label FROM u""")(
    lambda s, d: resolve.static_providers(a.table(s, d, "lineitem").selectExpr("l_orderkey as package", "concat(l_suppkey, '/l', l_linenumber) as path", "case l_partkey % 5 when 0 then 'high' when 1 then 'medium' when 2 then 'low' end as confidence", "case when l_suppkey % 2 = 0 then 'fingerprint: x' else 'banner' end as reason", "l_partkey % 50 as n_symbols", "array(concat('l', l_linenumber + 1)) as needs")).withColumn("consumers", F.array_join("consumers", ",")))
query("planned_packages", """SELECT container, entry, 'box' || container_key || '_m' || m || CASE WHEN k > 1 THEN '_' || k ELSE '' END || '.hap' AS display_name FROM (SELECT l_orderkey AS container_key, 'in/box' || l_orderkey || '.app' AS container,
  l_linenumber || '/m' || l_partkey % 3 || '.hap' AS entry, l_partkey % 3 AS m, row_number() OVER (PARTITION BY l_orderkey, l_partkey % 3 ORDER BY l_linenumber) AS k FROM lineitem WHERE l_suppkey % 4 <> 0)""")(
    lambda s, d: resolve.planned(a.table(s, d, "lineitem").selectExpr("concat('in/box', l_orderkey, '.app') as container", "concat(l_linenumber, '/m', l_partkey % 3, case when l_suppkey % 4 = 0 then '.txt' else '.hap' end) as entry", "l_linenumber as position")))
query("free_package_names", """WITH RECURSIVE v AS (SELECT l_orderkey AS o, l_linenumber || '/m' || l_partkey % 2 || CASE l_suppkey % 3 WHEN 0 THEN '_2' WHEN 1 THEN '_3' ELSE '' END || '.hap' AS entry, 'box' || l_orderkey || '_m' || l_partkey % 2 || CASE l_suppkey % 3 WHEN 0 THEN '_2' WHEN 1 THEN '_3' ELSE '' END AS stem,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, entry) AS i FROM lineitem),
w AS (SELECT DISTINCT o, 0::BIGINT AS i, []::VARCHAR[] AS taken, '' AS entry FROM v
  UNION ALL SELECT w.o, v.i, list_append(w.taken, list_filter(list_transform(range(1, len(w.taken) + 2), lambda n: v.stem || CASE WHEN n > 1 THEN '_' || n ELSE '' END), lambda x: NOT list_contains(w.taken, x))[1]), v.entry FROM w JOIN v ON v.o = w.o AND v.i = w.i + 1)
SELECT 'in/box' || o || '.app' AS container, entry, taken[-1] || '.hap' AS display_name FROM w WHERE i > 0""")(
    lambda s, d: resolve.planned(a.table(s, d, "lineitem").selectExpr("concat('in/box', l_orderkey, '.app') as container", "concat(l_linenumber, '/m', l_partkey % 2, case l_suppkey % 3 when 0 then '_2' when 1 then '_3' else '' end, '.hap') as entry", "l_linenumber as position")))
query("symbol_probe", r"""WITH s AS (SELECT unnest(['the', 'license', 'password', 'token']) AS symbol), w AS (SELECT source || '/' || lang AS folder, source || '/' || lang || '/' || lpad(doc_id::VARCHAR, 9, '0') AS path, unnest(list_distinct(regexp_extract_all(text, '\w+'))) AS symbol FROM documents)
SELECT folder, count(DISTINCT path) AS n_files, min(path) AS sample FROM w WHERE symbol IN (SELECT symbol FROM s) GROUP BY 1""")(
    lambda s, d: resolve.probe(a.table(s, d, "documents").selectExpr("concat(source, '/', lang, '/', lpad(doc_id, 9, '0')) as path", "text"), s.createDataFrame([(x,) for x in ("the", "license", "password", "token")], "symbol string")))
query("edges_by_name", """WITH f AS (SELECT s_suppkey AS ord, '/d' || s_suppkey % 3 || '/n' || s_suppkey % 40 AS path FROM supplier), n AS (SELECT regexp_extract(path, '[^/]*$') AS dep, arg_max(path, ord) AS path FROM f GROUP BY 1),
e AS (SELECT DISTINCT l_orderkey AS src, CASE WHEN l_linenumber % 2 = 0 THEN '/d1/n' ELSE 'n' END || l_partkey % 50 AS dep FROM lineitem)
SELECT src, e.dep, coalesce((SELECT any_value(path) FROM f WHERE f.path = e.dep), n.path) AS path FROM e LEFT JOIN n USING (dep)""")(
    lambda s, d: resolve.by_basename(a.table(s, d, "lineitem").selectExpr("l_orderkey as src", "concat(case when l_linenumber % 2 = 0 then '/d1/n' else 'n' end, l_partkey % 50) as dep").distinct(), a.table(s, d, "supplier").selectExpr("concat('/d', s_suppkey % 3, '/n', s_suppkey % 40) as path", "s_suppkey as ord")))

# Packages

_SHOWN = ["crypto_ec", "ssl_core"]
_FACTS = """f AS (SELECT l_suppkey AS package, l_partkey AS symbol, (['ssl_core', 'crypto_ec', 'crypto_pem', 'other'])[l_partkey % 4 + 1] AS category, (['static', 'dynamic', 'dlopen'])[l_linenumber % 3 + 1] AS way FROM lineitem),
c AS (SELECT package, category, count(DISTINCT symbol) AS n FROM f GROUP BY 1, 2), t AS (SELECT package, arg_max(category, (n, category)) AS top_category, coalesce(max(n) FILTER (category = 'crypto_ec'), 0) AS crypto_ec,
  coalesce(max(n) FILTER (category = 'ssl_core'), 0) AS ssl_core, coalesce(sum(n) FILTER (category NOT IN ('crypto_ec', 'ssl_core')), 0)::BIGINT AS other_cats FROM c GROUP BY 1),
p AS (SELECT package, count(DISTINCT symbol) FILTER (way = 'static') AS static_syms, count(DISTINCT symbol) FILTER (way = 'dynamic') AS dynamic_syms, count(DISTINCT symbol) FILTER (way = 'dlopen') AS dlopen_syms, count(DISTINCT symbol) AS total_syms FROM f GROUP BY 1)"""


def _facts(s, d):
    return a.table(s, d, "lineitem").selectExpr("l_suppkey as package", "l_partkey as symbol", "element_at(array('ssl_core', 'crypto_ec', 'crypto_pem', 'other'), cast(l_partkey % 4 + 1 as int)) as category", "element_at(array('static', 'dynamic', 'dlopen'), cast(l_linenumber % 3 + 1 as int)) as way")


query("package_rows", f"WITH {_FACTS} SELECT * FROM p JOIN t USING (package)")(lambda s, d: summary.package_rows(_facts(s, d), _SHOWN))
query("package_total", f"""WITH {_FACTS}, u AS (SELECT string_agg(n || ' ' || u, ', ' ORDER BY u) AS usage FROM (SELECT CASE WHEN package % 3 = 0 THEN 'Bundled' ELSE 'System-Link' END AS u, count(*) AS n FROM p GROUP BY 1)),
g AS (SELECT arg_max(category, (n, category)) AS top_category FROM (SELECT category, count(DISTINCT symbol) AS n FROM f GROUP BY 1))
SELECT 'TOTAL' AS package, sum(static_syms)::BIGINT AS static_syms, sum(dynamic_syms)::BIGINT AS dynamic_syms, sum(dlopen_syms)::BIGINT AS dlopen_syms, sum(total_syms)::BIGINT AS total_syms, sum(other_cats)::BIGINT AS other_cats,
  sum(crypto_ec)::BIGINT AS crypto_ec, sum(ssl_core)::BIGINT AS ssl_core, (SELECT usage FROM u) AS usage, (SELECT top_category FROM g) AS top_category FROM p JOIN t USING (package)""")(
    lambda s, d: summary.package_total(summary.package_rows(f := _facts(s, d), _SHOWN).withColumn("usage", F.expr("case when package % 3 = 0 then 'Bundled' else 'System-Link' end")), f, _SHOWN))

# Repositories, compared projects, display

_PCT = lambda x, n: f"round_even({x} / {n} * 100, 2)::DOUBLE"
query("repository_rows", f"""WITH {a.CALLS}, {a.MAPPING}, n AS (SELECT project, symbol, coalesce(status, 'unknown') AS status, count(*) AS n FROM calls LEFT JOIN mapping USING (symbol) GROUP BY ALL),
w AS (SELECT project, string_agg(symbol || '[' || status || '](' || n || ')', ', ' ORDER BY n DESC, symbol, status) AS top_blockers FROM (SELECT * FROM n WHERE status IN ('not_available', 'unknown') QUALIFY row_number() OVER (PARTITION BY project ORDER BY n DESC, symbol, status) <= 5) GROUP BY 1),
g AS (SELECT project, sum(n)::BIGINT AS n_calls, count(*) AS n_symbols, {", ".join(f"count(*) FILTER (status = '{k}') AS {k}_symbols, coalesce(sum(n) FILTER (status = '{k}'), 0)::BIGINT AS {k}_calls" for k in ("available", "partial", "not_available", "unknown"))} FROM n GROUP BY 1)
SELECT g.*, {", ".join(f"{_PCT(f'available_{w}', f'n_{w}')} AS direct_{w}_pct, {_PCT(f'(available_{w} + partial_{w})', f'n_{w}')} AS covered_{w}_pct" for w in ("symbols", "calls"))}, coalesce(top_blockers, '') AS top_blockers FROM g LEFT JOIN w USING (project)""")(
    lambda s, d: summary.repository_rows(usage.compat_status(a.calls(s, d), a.mapping(s, d))))
_DELTAS = f"""{a.SNAPSHOTS}, t AS (SELECT project, symbol, 'c' || (length(symbol) + project) % 4 AS category, sum(o)::BIGINT AS old_calls, sum(n)::BIGINT AS new_calls FROM sides GROUP BY 1, 2),
st AS (SELECT *, CASE WHEN old_calls = 0 THEN 'added' WHEN new_calls = 0 THEN 'removed' WHEN old_calls = new_calls THEN 'unchanged' ELSE 'changed' END AS status FROM t)"""


def _deltas(s, d):
    return diff.symbols(*a.snapshots(s, d), ["project"]).withColumn("category", F.expr("concat('c', (length(symbol) + project) % 4)"))


query("combined_symbols", f"WITH {_DELTAS}, g AS (SELECT symbol, arg_max(category, project) AS category, sum(old_calls)::BIGINT AS old_calls, sum(new_calls)::BIGINT AS new_calls FROM st GROUP BY 1) SELECT *, CASE WHEN old_calls = 0 THEN 'added' WHEN new_calls = 0 THEN 'removed' WHEN old_calls = new_calls THEN 'unchanged' ELSE 'changed' END AS status FROM g")(
    lambda s, d: summary.combined_symbols(_deltas(s, d)))
query("combined_categories", f"WITH {_DELTAS}, g AS (SELECT category, count(DISTINCT symbol) FILTER (old_calls > 0) AS old_symbols, count(DISTINCT symbol) FILTER (new_calls > 0) AS new_symbols FROM st GROUP BY 1) SELECT *, new_symbols - old_symbols AS delta FROM g")(
    lambda s, d: summary.combined_categories(_deltas(s, d)))
query("project_deltas", f"""WITH {_DELTAS} SELECT project, sum(old_calls)::BIGINT AS old_calls, sum(new_calls)::BIGINT AS new_calls, count(*) FILTER (old_calls > 0) AS old_symbols, count(*) FILTER (new_calls > 0) AS new_symbols,
  CASE WHEN bool_and(status = 'added') THEN 'added' WHEN bool_and(status = 'removed') THEN 'removed' WHEN bool_and(status = 'unchanged') THEN 'unchanged' ELSE 'changed' END AS status FROM st GROUP BY 1""")(
    lambda s, d: summary.project_deltas(_deltas(s, d)))
query("category_bars", f"""WITH c AS (SELECT coalesce(({summary.DISPLAY!r})[p_size], CASE WHEN p_size % 2 = 0 THEN 'other' ELSE 'mine' END) AS category, count(*) AS n_symbols FROM part GROUP BY 1)
SELECT category, n_symbols, CASE WHEN category = 'other' THEN {len(summary.DISPLAY) + 2} ELSE coalesce(nullif(list_position({summary.DISPLAY!r}, category), 0), {len(summary.DISPLAY) + 1}) END::BIGINT AS place,
  repeat('#', floor(n_symbols / (SELECT max(n_symbols) FROM c) * 30)::INT) AS bar FROM c""")(
    lambda s, d: summary.category_bars(a.table(s, d, "part").select(F.coalesce(F.get(F.array(*map(F.lit, summary.DISPLAY)), F.col("p_size").cast("int") - 1), F.expr("case when p_size % 2 = 0 then 'other' else 'mine' end")).alias("category")).groupBy("category").agg(F.count("*").alias("n_symbols"))))
query("ranked_groups", f"""WITH RECURSIVE {a.ALL_EDGES}, r AS (SELECT DISTINCT src AS root, src AS node, 0 AS depth FROM edges UNION SELECT r.root, e.dst, r.depth + 1 FROM r JOIN edges e ON e.src = r.node WHERE r.depth < 20),
b AS (SELECT root, node, min(depth) AS depth FROM r GROUP BY 1, 2), k AS (SELECT l_orderkey AS node, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1)
SELECT root, sum(CASE WHEN depth = 0 THEN coalesce(n, 0) ELSE 0 END)::BIGINT AS own_symbols, count(*) FILTER (depth = 1) AS n_libraries, count(*) FILTER (depth > 1 AND n > 0) AS n_deep, sum(coalesce(n, 0))::BIGINT AS group_total FROM b LEFT JOIN k USING (node) GROUP BY 1""")(
    lambda s, d: summary.ranked_groups(e := a.all_edges(s, d), e.selectExpr("src as node"), a.table(s, d, "lineitem").selectExpr("l_orderkey as node", "l_partkey").groupBy("node").agg(F.countDistinct("l_partkey").alias("n_symbols"))))
query("merged_graph", "SELECT 'a' || l_suppkey % 40 AS src, 'b' || l_partkey % 40 AS dst, count(DISTINCT l_orderkey) AS n_processes FROM lineitem GROUP BY 1, 2")(
    lambda s, d: summary.merged_graph(a.table(s, d, "lineitem").selectExpr("l_orderkey as process", "concat('/x/', l_linenumber, '/a', l_suppkey % 40) as src", "concat('/y/b', l_partkey % 40) as dst")))
query("node_tiers", f"""SELECT p_partkey, CASE WHEN p_size < 5 THEN 'application' WHEN p_size < 9 THEN 'crypto' WHEN p_size % 7 > 0 THEN 'middleware' WHEN p_partkey % 8 < 6 THEN 'system' ELSE 'normal' END AS tier FROM part""")(
    lambda s, d: a.table(s, d, "part").select("p_partkey", summary.tier(F.coalesce(F.get(F.array(*map(F.lit, summary.SYSTEM)), (F.col("p_partkey") % 8).cast("int")), F.lit("x")), F.col("p_size") < 5, F.col("p_size") < 9, F.col("p_size") % 7).alias("tier")))

_PLACES = ["third_party/x", "vendor/a/b", "device/c", "productdefine/p", "kernel/linux", "base/tee/tee_os_kernel", "applications/sample/s", "applications/standard/app_samples", "applications/standard/x_wrapper", "applications/standard/mail", "foundation/f", "napi_generator/n", "elsewhere/e", "single", ""]
_TAGS = ["第三方", "厂商/芯片", "厂商/芯片", "设备预装(产品相关)", "内核/上游移植", "内核/上游移植", "HM自研组件", "HM自研组件", "HM自研组件", "HM预置应用", "HM自研组件", "HM自研组件", "待人工确认", "", ""]
query("repository_tags", f"SELECT p_partkey, ({_PLACES!r})[p_partkey % {len(_PLACES)} + 1] AS path, ({_TAGS!r})[p_partkey % {len(_PLACES)} + 1] AS tag FROM part")(
    lambda s, d: a.table(s, d, "part").select("p_partkey", F.get(F.array(*map(F.lit, _PLACES)), (F.col("p_partkey") % len(_PLACES)).cast("int")).alias("path")).withColumn("tag", repositories.tag_of(F.col("path"))["tag"]))
