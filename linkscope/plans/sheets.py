"""The fixed sheets of the scan's and the difference's workbooks, one table each, in the order of their rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkscope.functions.categories import LIBRARY_PREFIXES, category_of
from linkscope.functions.text import basename, is_library
from linkscope.operators import diff, graph, scan
from linkscope.plans.workbook import Sheet

# Labels of the overview, and what an empty sheet says.
META = ["Report Type", "Tool Version", "Scan Time", "Scan Root", "Target Architecture"]
FIGURES = ["Total Files Scanned", "Total ELF Files", "Files with OpenSSL Deps", "Total OpenSSL Symbols (refs)", "Unique OpenSSL Symbols"]
NO_FILES, NO_SYMBOLS, NO_CHAINS = "No file data available", "No file-symbol data available", "No import chain data available"
NO_DEPTHS, NO_TREE, NEEDS_TREE, NO_ERRORS = "No depth data available", "No dependency tree data available", "(Dependency tree requires single-binary scan mode)", "No errors"
# What a depth means; {} is a number of hops.
DEPTHS = {1: "Direct OpenSSL dependency (depth 1)", 2: "One hop to OpenSSL (depth 2)", 3: "Two hops to OpenSSL (depth 3)"}
# Names of the metrics.
METRICS = {"scanned": "Files Scanned", "files": "Files with Calls", "calls": "Call Sites", "symbols": "Unique Symbols"}


def _titled(rows: DataFrame, columns: dict[str, Column], order: list[tuple[Column, bool]]) -> DataFrame:
    """Columns under their titles, in order: pairs of a column and whether it descends."""
    keys = [c.desc() if down else c.asc() for c, down in order]
    return rows.orderBy(*keys).select(*[c.alias(t) for t, c in columns.items()])


def _or(sheet: DataFrame, messages: list[str]) -> DataFrame:
    """The sheet, or its messages in the first column where it has no row."""
    if not sheet.isEmpty():
        return sheet
    first, *rest = sheet.columns
    return sheet.sparkSession.createDataFrame([(m,) for m in messages], f"`{first}` string").select("*", *[F.lit(None).cast("string").alias(c) for c in rest]).coalesce(1)


def _texts(c: str) -> Column:
    return F.coalesce(F.array_join(c, ", "), F.lit(""))


def overview(meta: dict[str, str], totals: DataFrame, elf_files: DataFrame, libraries: DataFrame) -> DataFrame:
    """Labels and values: meta by label, the figures of a scan's totals, and the libraries found (library); zeros are left blank.

    totals: n_files, n_with_symbols, n_references, n_symbols, arch; elf_files: one number, n_elf.
    """
    spark = totals.sparkSession
    one = totals.crossJoin(elf_files)
    shown = lambda c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("0")), F.lit(""))
    values = {"Target Architecture": F.col("arch")} | dict(zip(FIGURES, map(shown, ["n_files", "n_elf", "n_with_symbols", "n_references", "n_symbols"]), strict=True))
    labels = ["REPORT METADATA", *META, "", "SUMMARY STATISTICS", *FIGURES, ""]
    lines = [F.struct(F.lit(i).alias("place"), F.lit(label).alias("label"), values.get(label, F.lit(meta.get(label, ""))).alias("value")) for i, label in enumerate(labels)]
    rows = one.select(F.inline(F.array(*lines)))
    found = libraries.select(F.lit(len(labels) + 1).alias("place"), F.lit("").alias("label"), F.col("library").alias("value")).distinct()
    title = found.limit(1).select(F.lit(len(labels)).alias("place"), F.lit("DETECTED OPENSSL LIBRARIES").alias("label"), F.lit("").alias("value"))
    return spark.createDataFrame([], "place int, label string, value string").unionByName(rows).unionByName(title).unionByName(found).orderBy("place", "value").select("label", "value")


def scan_files(results: DataFrame, facts: DataFrame) -> DataFrame:
    """Every file that was read, with its kind of link; results have is_transitive too."""
    r = results.join(scan.link_type(results), "path")
    rows = facts.select("path", "kind", "arch", "needed").join(r, "path", "left")
    loaded = F.coalesce(F.size("dlsym"), F.lit(0))
    columns = {
        "File Path": F.col("path"), "File Name": basename(F.col("path")), "Type": F.coalesce("kind", F.lit("")), "Arch": F.coalesce("arch", F.lit("")),
        "Link Type": F.coalesce("link", F.lit("")), "OpenSSL Transitive": F.when(F.col("is_transitive"), "Yes").otherwise("No"), "OpenSSL Libs": _texts("libs"),
        "Symbol Count": F.coalesce(F.size("symbols"), F.lit(0)), "Direct Dependencies": _texts("needed"), "dlopen Symbols": _texts("dlsym"), "dlopen Count": F.when(loaded > 0, loaded),
    }
    return _titled(rows, columns, [(F.col("path"), False)])


def file_symbols(results: DataFrame, custom: list[str] | None = None) -> DataFrame:
    """A row for each file and symbol, with how the file comes by it."""
    rows = scan.detection(results).withColumn("category", category_of(F.col("symbol"), custom=custom or []))
    return _titled(rows, {"Component": F.col("path"), "Binary": basename(F.col("path")), "Symbol": F.col("symbol"), "Category": F.col("category"), "Detection": F.col("detection")}, [(F.col("path"), False), (F.col("symbol"), False)])


def import_chains(chains: DataFrame, custom: list[str] | None = None) -> DataFrame:
    """Chains (src, symbol, chain, depth) by symbol."""
    columns = {"Source File": F.col("src"), "File Name": basename(F.col("src")), "Symbol": F.col("symbol"), "Category": category_of(F.col("symbol"), custom=custom or []), "Import Chain": F.col("chain"), "Depth": F.col("depth")}
    return _titled(chains, columns, [(F.col(c), False) for c in ("symbol", "src", "depth", "chain")])


def categories(facts: DataFrame) -> DataFrame:
    """Distinct symbols of each category (category, symbol), the largest first, and their total."""
    each = facts.select("category", "symbol").distinct().groupBy("category").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("symbol")).alias("symbols"))
    total = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total")).select(F.greatest("total", F.lit(1)).alias("total"))
    rows = each.crossJoin(F.broadcast(total)).select(F.lit(0).alias("last"), "category", "n", F.format_string("%.1f%%", F.col("n") * 100 / F.col("total")).alias("share"), _texts("symbols").alias("symbols"))
    end = total.select(F.lit(1).alias("last"), F.lit("TOTAL").alias("category"), F.col("total").alias("n"), F.lit("100%").alias("share"), F.lit(None).cast("string").alias("symbols"))
    return _titled(rows.unionByName(end), {"Category": F.col("category"), "Symbol Count": F.col("n"), "Percentage": F.col("share"), "Symbols": F.col("symbols")}, [(F.col("last"), False), (F.col("n"), True), (F.col("category"), False)])


def depths(paths: DataFrame, symbols: DataFrame) -> DataFrame:
    """Symbols and files at each least depth."""
    said = F.element_at(F.create_map(*[F.lit(x) for pair in DEPTHS.items() for x in pair]), F.col("depth").cast("int"))
    other = F.format_string("%d hops to OpenSSL (depth %d)", F.col("depth") - 1, F.col("depth"))
    columns = {"Depth": F.col("depth"), "Description": F.coalesce(said, other), "Symbol Count": F.col("n_symbols"), "File Count": F.col("n_files"), "Symbols": _texts("symbols")}
    return _titled(graph.by_depth(paths, symbols, names=True), columns, [(F.col("depth"), False)])


def dependency_tree(tree: DataFrame, symbols: DataFrame) -> DataFrame:
    """Nodes of trees in depth-first order; symbols: path, symbol."""
    n = symbols.distinct().groupBy(F.col("path").alias("name")).agg(F.count("*").alias("n"))
    rows = tree.join(n, "name", "left")
    columns = {"Parent": F.coalesce(basename(F.col("parent")), F.lit("(root)")), "Child": basename(F.col("name")), "Depth": F.col("depth"), "Is OpenSSL Lib": F.when(is_library(basename(F.col("name")), LIBRARY_PREFIXES), "Yes").otherwise("No"), "Symbol Count": F.coalesce("n", F.lit(0)), "Full Path": F.col("name")}
    return _titled(rows, columns, [(F.col("root"), False), (F.col("position"), False)])


def fingerprints(scores: DataFrame, parts: DataFrame, total: DataFrame) -> DataFrame:
    """Scores of files, a row for each category: the file's own figures stand in its first row; the greatest score ends the sheet.

    scores: path, score, confidence, matched; parts: path, category, matched, total, raw, capped; total: one number, total.
    """
    first = F.row_number().over(Window.partitionBy("path").orderBy("category")) == 1
    rows = scores.crossJoin(F.broadcast(total)).join(parts.select("path", "category", F.col("matched").alias("c_matched"), F.col("total").alias("c_total"), "raw", "capped"), "path", "left")
    top = lambda c: F.when(first, c)
    own = {"SO File": top(basename(F.col("path"))), "Score": top(F.col("score")), "Confidence": top(F.col("confidence")), "Matched": top(F.col("matched")), "Total": top(F.col("total"))}
    each = {"Category": F.col("category"), "Cat Matched": F.col("c_matched"), "Cat Total": F.col("c_total"), "Cat Raw": F.col("raw"), "Cat Capped": F.col("capped")}
    found = rows.select(F.lit(0).alias("last"), "path", F.col("category").alias("by"), *[c.cast("string").alias(t) for t, c in (own | each).items()])
    best = scores.where("score > 0").agg(F.max("score").alias("score"), F.min_by("path", F.struct(-F.col("score"), "path")).alias("path")).where("path is not null")
    end = best.select(F.explode(F.array(F.lit(1), F.lit(2))).alias("last"), "score", "path")
    said = lambda c: F.when(F.col("last") == 2, c)
    last = end.select("last", "path", F.lit("").alias("by"), said(F.lit("HAP Max Score")).alias("SO File"), said(F.col("score").cast("string")).alias("Score"), said(basename(F.col("path"))).alias("Confidence"), *[F.lit(None).cast("string").alias(t) for t in list(own | each)[3:]])
    return found.unionByName(last).orderBy("last", "path", "by").select(*(own | each))


def errors(rows: DataFrame) -> DataFrame:
    """Errors of files: path, error."""
    return _titled(rows, {"Severity": F.lit("WARNING"), "File": F.col("path"), "Error Message": F.col("error")}, [(F.col("path"), False), (F.col("error"), False)])


def scan_sheets(parts: dict[str, DataFrame], meta: dict[str, str], custom: list[str] | None = None) -> dict[str, Sheet]:
    """The sheets of a scan from its parts.

    parts: results (with is_transitive), facts, totals, paths, chains, symbols (src, symbol), and where they are known
    tree and tree_symbols (path, symbol), scores, score_parts and marks (one number, total).
    """
    facts, results = parts["facts"], parts["results"]
    elf = facts.agg(F.count_if(F.col("error").isNull()).alias("n_elf"))
    found = facts.select(basename(F.col("path")).alias("library")).where(is_library(F.col("library"), LIBRARY_PREFIXES))
    each = parts["symbols"].select("symbol", category_of(F.col("symbol"), custom=custom or []).alias("category"))
    out = {
        "Overview": Sheet(overview(meta, parts["totals"], elf, found), False, [30, 60]),
        "Files": Sheet(_or(scan_files(results, facts), [NO_FILES]), widths=[60, 25, 15, 10, 15, 18, 40, 12, 60, 50, 12]),
        "File-Symbol": Sheet(_or(file_symbols(results, custom), [NO_SYMBOLS]), widths=[60, 25, 35, 18, 12]),
        "Import Chains": Sheet(_or(import_chains(parts["chains"], custom), [NO_CHAINS]), widths=[60, 25, 35, 18, 80, 8]),
        "By Category": Sheet(categories(each), widths=[20, 15, 12, 100]),
        "By Depth": Sheet(_or(depths(parts["paths"], parts["symbols"]), [NO_DEPTHS]), widths=[10, 40, 15, 12, 100]),
    }
    if "tree" in parts:
        out["Dep Tree"] = Sheet(dependency_tree(parts["tree"], parts["tree_symbols"]), widths=[40, 40, 10, 15, 15, 80])
    else:
        none = facts.limit(0).select(*[F.lit("").alias(t) for t in ("Parent", "Child", "Depth", "Is OpenSSL Lib", "Symbol Count", "Full Path")])
        out["Dep Tree"] = Sheet(_or(none, [NO_TREE, NEEDS_TREE]), widths=[40, 40, 10, 15, 15, 80])
    if "scores" in parts and not parts["scores"].isEmpty():
        out["Fingerprint"] = Sheet(fingerprints(parts["scores"], parts["score_parts"], parts["marks"]))
    out["Errors"] = Sheet(_or(errors(facts.where("error is not null")), [NO_ERRORS]), widths=[12, 60, 80])
    return out


def project_names(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both sides of each project, with its status by those of its symbols, and the symbols that came and went."""
    each = diff.symbols(old, new, ["project"])
    status = lambda s: F.count_if(F.col("status") == s)
    names = lambda s: F.array_sort(F.collect_list(F.when(F.col("status") == s, F.col("symbol"))))
    n = each.groupBy("project").agg(
        F.count("*").alias("n"), status("added").alias("n_added"), status("removed").alias("n_removed"), status("unchanged").alias("n_same"), F.sum("old_calls").alias("old_calls"), F.sum("new_calls").alias("new_calls"),
        F.count_if(F.col("old_calls") > 0).alias("old_symbols"), F.count_if(F.col("new_calls") > 0).alias("new_symbols"), names("added").alias("added_symbols"), names("removed").alias("removed_symbols"),
    )
    whole = F.when(F.col("n_added") == F.col("n"), "added").when(F.col("n_removed") == F.col("n"), "removed").when(F.col("n_same") == F.col("n"), "unchanged").otherwise("changed")
    return n.withColumn("status", whole).drop("n", "n_added", "n_removed", "n_same")


def diff_sheets(old: DataFrame, new: DataFrame, several: bool, unchanged: bool = False, scanned: tuple[DataFrame, DataFrame] | None = None) -> dict[str, Sheet]:
    """The sheets of a difference between call sites (project, file, line, caller, symbol, category, args).

    several: keys hold the project; scanned: files scanned on both sides (n_scanned).  Rows whose status is unchanged are shown on demand only.
    """
    spark = old.sparkSession
    shown = lambda d: d.where(F.lit(unchanged) | (F.col("status") != "unchanged"))
    place = F.element_at(F.create_map(*[F.lit(x) for pair in diff.ORDER.items() for x in pair]), F.col("status"))
    delta = F.col("new_calls") - F.col("old_calls")
    key = ["project", *diff.KEY] if several else diff.KEY
    counted = {"Old Calls": F.col("old_calls"), "New Calls": F.col("new_calls"), "Delta": delta}
    named = {"Old Symbols": F.col("old_symbols"), "New Symbols": F.col("new_symbols"), "Added Symbols": _texts("added_symbols"), "Removed Symbols": _texts("removed_symbols")}

    label = F.element_at(F.create_map(*[F.lit(x) for pair in METRICS.items() for x in pair]), F.col("metric"))
    rank = F.array_position(F.array(*map(F.lit, METRICS)), F.col("metric"))
    figures = diff.metrics(old, new, ["project"] if several else None, scanned).select(rank.alias("place"), label.alias("Metric"), F.col("old_value").alias("Old"), F.col("new_value").alias("New"), F.col("delta").alias("Delta"))
    groups = diff.category_metrics(old, new).select(F.lit(9).alias("place"), F.concat(F.lit("["), F.coalesce("category", F.lit("")), F.lit("]")).alias("Metric"), F.col("old_symbols").alias("Old"), F.col("new_symbols").alias("New"), F.col("delta").alias("Delta"))
    gap = spark.range(1).select(F.lit(8).alias("place"), *[F.lit(None).cast(t).alias(c) for c, t in (("Metric", "string"), ("Old", "long"), ("New", "long"), ("Delta", "long"))])
    parts = [figures, *([] if groups.isEmpty() else [gap, groups])]
    summary = reduce(DataFrame.unionByName, parts).orderBy("place", "Metric").drop("place")

    symbols = shown(diff.symbol_categories(old, new))
    path = F.concat_ws("/", "project", "file") if several else F.col("file")
    files = shown(diff.file_symbols(old, new, ["project"] if several else None)).withColumn("path", path)
    partners = shown(diff.pairs(old, new, key)).join(diff.call_site_details(old, new, key).select(*key, "category"), key)
    sites = diff.call_sites(old, new, key).select(*key, F.col("status").alias("group_status"))
    group_place = F.element_at(F.create_map(*[F.lit(x) for pair in diff.ORDER.items() for x in pair]), F.col("group_status"))
    project = {"Project": F.col("project")} if several else {}
    calls = project | {"Status": F.col("status"), "File Path": F.col("file"), "Caller Function": F.col("caller"), "OpenSSL Symbol": F.col("symbol"), "Category": F.col("category"), "Old Line": F.col("old_line"), "New Line": F.col("new_line"), "Old Args": F.col("old_args"), "New Args": F.col("new_args")}
    site_order = [(group_place, False), *[(F.col(c), False) for c in (*(["project"] if several else []), "file", "symbol", "caller")], (F.coalesce("new_line", "old_line"), False), (place, False), (F.coalesce("old_line", F.lit(0)), False), (F.coalesce("new_args", "old_args"), False)]
    out = {
        "Summary Delta": Sheet(summary, widths=[30, 12, 12, 12]),
        "Symbol Delta": Sheet(_titled(symbols, {"OpenSSL Symbol": F.col("symbol"), "Category": F.col("category"), "Status": F.col("status"), **counted}, [(place, False), (F.col("category"), False), (F.col("symbol"), False)]), widths=[35, 20, 12, 12, 12, 10]),
        "File Delta": Sheet(_titled(files, {"File Path": F.col("path"), "Status": F.col("status"), **counted, **named}, [(place, False), (F.abs(delta), True), (F.col("path"), False)]), widths=[60, 12, 12, 12, 10, 12, 12, 40, 40]),
        "Call Site Delta": Sheet(_titled(partners.join(sites, key), calls, site_order), widths=([20] if several else []) + [12, 50, 30, 35, 20, 10, 10, 30, 30]),
    }
    if several:
        projects = shown(project_names(old, new))
        out["Project Delta"] = Sheet(_titled(projects, {"Project": F.col("project"), "Status": F.col("status"), **counted, **named}, [(F.col("project"), False)]), widths=[30, 12, 12, 12, 10, 12, 12, 40, 40])
    return out
