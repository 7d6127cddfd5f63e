"""Command line: each command reads files through Spark, runs an operator, and writes its tables to a folder.

python -m linkscope COMMAND ... -o FOLDER; a first word that is no command is taken as a path to scan.
"""

from __future__ import annotations

import argparse
import sys
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkscope.functions import text
from linkscope.functions.categories import CUSTOM, LIBRARY_PREFIXES, category_of
from linkscope.functions.text import is_library
from linkscope.operators import banners, classify, diff, graph, resolve, summary, trees, usage
from linkscope.operators import scan as operators_scan
from linkscope.operators.lineage import cut
from linkscope.plans import sheets, sinks
from linkscope.sources import archives, calls, diagnostics, elf, files, headers, machine_code, packages, processes, reports, repositories, text_tables


def named(spark: SparkSession, a) -> DataFrame:
    """The dimension: names of a text file or of a JSON file's list `symbols`, those that given libraries export, and the users' own."""
    parts = []
    if a.symbols:
        parts.append(reports.symbol_json(spark, a.symbols) if a.symbols.lower().endswith(".json") else text_tables.symbol_list(spark, a.symbols).withColumn("origin", F.lit("list")))
    for path in a.openssl_lib or []:
        parts.append(elf.facts(elf.files(spark, path)).select(F.explode("symbols").alias("s")).where("s.defined").select(F.col("s.name").alias("symbol"), F.lit("library").alias("origin")))
    if a.add:
        own = text_tables.symbol_list(spark, a.add).withColumn("origin", F.lit(CUSTOM))
        if own.isEmpty():
            raise ValueError(f"no names in {a.add}")
        parts.append(own)
    if not parts:
        raise ValueError("one of --symbols, --openssl-lib and --add is needed")
    return usage.symbol_dimension(*parts)


def custom_names(spark: SparkSession, a) -> list[str]:
    """The users' own names, a bounded list."""
    return [r["symbol"] for r in text_tables.symbol_list(spark, a.add).collect()] if a.add else []


def results_of(contents: DataFrame, dimension: DataFrame, marks: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Results of ELF files (path, content), and their facts."""
    facts = elf.facts(contents)
    symbols = facts.select("path", F.explode("symbols").alias("s")).select("path", "s.name", "s.defined")
    strings = elf.strings(contents)
    imports = F.filter("symbols", lambda s: ~s["defined"] & s["name"].isin("dlopen", "dlsym"))
    needed = facts.where("error is null").select("path", "arch", F.filter("needed", lambda x: is_library(x, LIBRARY_PREFIXES)).alias("libs"), (F.size(imports) > 0).alias("has_loader"), F.col("path").alias("position"))
    probes = banners.probes(dimension.select("symbol", category_of(F.col("symbol")).alias("category")))
    found = banners.banners(strings.select(F.col("path").alias("file"), "text"), probes).withColumnRenamed("file", "path")
    resolved = machine_code.dlsym_arguments(contents)
    resolved = resolved.toDF("path", "symbol").join(dimension.select("symbol").distinct(), "symbol", "left_semi").select("path", "symbol")
    inputs = operators_scan.file_facts(symbols, needed, strings, found, dimension, resolved, marks)
    return operators_scan.file_results(inputs), facts


# Folders of libraries below a sysroot, in the order in which they are searched.
SYSROOT = ["lib64", "lib", "usr/lib64", "usr/lib", "usr/local/lib64", "usr/local/lib", "lib/x86_64-linux-gnu", "lib/aarch64-linux-gnu", "lib/arm-linux-gnueabihf", "usr/lib/x86_64-linux-gnu", "usr/lib/aarch64-linux-gnu", "usr/lib/arm-linux-gnueabihf"]


def bare(path: str):
    """A path without the name of the local file system."""
    return F.regexp_replace(path, "^file:/*", "/")


def tree_of(spark: SparkSession, a, facts: DataFrame) -> DataFrame:
    """Dependency trees of the programs of a scan, of all its files if it has none; libraries are looked up by rpath, runpath, the given folders, then by name."""
    folders = [*(a.library_path or []), *([a.sysroot] if a.sysroot else [])]
    search = [f.rstrip("/") for f in a.library_path or []] + ([f"{a.sysroot.rstrip('/')}/{f}" for f in SYSROOT] if a.sysroot else [])
    plain = lambda d: d.where("error is null").select(bare("path").alias("path"), "kind", "needed", "rpath", "runpath")
    own = plain(facts)
    every = cut(reduce(DataFrame.unionByName, [own, *[plain(elf.facts(elf.files(spark, f))) for f in folders]]).dropDuplicates(["path"]))
    asked = every.select(F.col("path").alias("src"), text.dirname(F.col("path")).alias("origin"), "rpath", "runpath", F.posexplode("needed").alias("position", "library"))
    found = cut(resolve.resolve(asked, every.select("path"), search))
    named = resolve.by_basename(found.where("path is null").select("src", F.col("library").alias("dep")).distinct(), every.select("path", F.col("path").alias("ord")))
    edges = found.join(named.select("src", F.col("dep").alias("library"), F.col("path").alias("other")), ["src", "library"], "left").select("src", F.coalesce("path", "other", "library").alias("dst"), "position")
    programs = own.where("kind = 'executable'")
    roots = own if programs.isEmpty() else programs
    return cut(trees.trees(edges, roots.select(F.col("path").alias("node")), every))


def scan_parts(spark: SparkSession, a) -> dict[str, DataFrame]:
    """What a scan finds: results, facts, edges, paths to libraries, chains, symbols by file, totals, and on demand trees and marks."""
    names = named(spark, a)
    contents = elf.files(spark, a.path, not a.no_recursive)
    if a.from_file:
        lines = spark.read.text(a.from_file).withColumn("position", F.lit(0)).withColumnRenamed("value", "line")
        contents = contents.join(resolve.target_list(lines).select(F.regexp_replace("target", "^file:/*", "/").alias("t")), bare("path") == F.col("t"), "left_semi")
    marks = reports.fingerprints(spark, a.fingerprints) if a.fingerprints else None
    results, facts = results_of(contents, names, marks)
    results = cut(results)
    edges = resolve.by_basename(facts.select(F.col("path").alias("src"), F.explode("needed").alias("dep")), facts.select("path", F.col("path").alias("ord"))).select("src", F.coalesce("path", "dep").alias("dst"))
    targets = edges.where(is_library(text.basename(F.col("dst")), LIBRARY_PREFIXES)).select(F.col("dst").alias("node")).distinct()
    paths = graph.paths_to(edges, targets, 10)
    symbols = results.select(F.col("path").alias("src"), F.explode("symbols").alias("symbol")).distinct()
    totals = operators_scan.totals(results, facts.select("path", "arch", F.col("path").alias("position")))
    out = {"results": operators_scan.mark_transitive(results, edges, targets), "facts": facts, "edges": edges, "paths": paths, "symbols": symbols, "totals": totals, "chains": graph.chains(graph.first_paths(paths), symbols)}
    if a.tree:
        out["tree"] = tree_of(spark, a, facts)
    if marks is not None:
        strings, bare_marks = elf.strings(contents).select("path", F.col("text").alias("string")), marks.drop("library")
        out |= {"scores": classify.fingerprint_scores(strings, bare_marks, "path"), "score_parts": classify.fingerprint_parts(strings, bare_marks, "path"), "marks": marks.agg(F.count("*").alias("total"))}
    return out


def scan(spark, a):
    parts = scan_parts(spark, a)
    results, facts, symbols = parts["results"], parts["facts"], parts["symbols"]
    each = results.select(F.col("path").alias("file"), F.explode("symbols").alias("symbol")).withColumn("category", category_of(F.col("symbol"), custom=custom_names(spark, a)))
    out = {"files": results, "symbols": operators_scan.detection(results), "by_category": usage.by_category(each), "totals": parts["totals"], "roll_up": operators_scan.roll_up(results), "most_common": usage.most_common(each), "edges": parts["edges"]}
    out |= {"chains": parts["chains"], "by_depth": graph.by_depth(parts["paths"], symbols)}
    if "tree" in parts:
        own = symbols.select(bare("src").alias("name"), "symbol")
        out |= {"tree": parts["tree"], "tree_depths": trees.symbols_by_depth(parts["tree"], own), "tree_chains": trees.import_chains(parts["tree"], own)}
    return out | {"report": operators_scan.report_rows(results, facts), "errors": facts.where("error is not null").select("path", "error")}


def scan_workbook(spark, a):
    """The sheets of a scan."""
    parts = scan_parts(spark, a)
    meta = {"Report Type": "single", "Scan Time": datetime.now(UTC).isoformat(timespec="seconds"), "Scan Root": a.path}
    own = parts["symbols"].select(bare("src").alias("path"), "symbol")
    return sheets.scan_sheets(parts | {"tree_symbols": own}, meta, custom_names(spark, a))


def hap(spark, a):
    members = archives.members(spark, a.path)
    libraries = packages.native_libraries(members)
    if a.abi:
        libraries = packages.of_interface(libraries, a.abi)
    inside = libraries.select("package", F.concat("package", F.lit("!libs/"), "abi", F.lit("/"), "library").alias("path"), "content")
    files, bundled = operators_scan.without_bundled(inside)
    results, facts = results_of(files.select("path", "content"), named(spark, a))
    results = cut(results.join(facts.select("path", F.col("needed").alias("deps")), "path").withColumn("package", F.substring_index("path", "!libs/", 1)))
    about = packages.metadata(members)
    release = about.select("package", F.concat_ws("/", F.when(F.col("bundle") == "", F.col("package")).otherwise(F.col("bundle")), F.when(F.col("version_code") == 0, F.col("package")).otherwise(F.col("version_code").cast("string")), "version").alias("release")).dropDuplicates(["package"])
    providers = resolve.static_providers(results.select("package", "path", F.when(F.col("is_static"), F.col("confidence")).alias("confidence"), "reason", F.size("symbols").alias("n_symbols"), F.col("deps").alias("needs")))
    kinds = classify.in_release(results, bundled, release)
    rows = operators_scan.bundled_text(kinds, bundled, providers.select("package", "label")).withColumn("usage", classify.usage_label("bundled", "kind"))
    return {"metadata": about, "interfaces": packages.interfaces(libraries), "libraries": libraries.drop("content"), "bundled": bundled, "files": results, "packages": rows, "providers": providers, "first_libraries": archives.first_libraries(members), "errors": archives.errors(members), "batch": operators_scan.package_batch(results), "batch_categories": operators_scan.batch_categories(results)}


def hap_summary(spark, a):
    """Rows of packages and their total from earlier reports."""
    files = cut(reports.package_files(spark, a.path))
    bundled = files.select("package", F.explode("bundled_files").alias("library")).distinct()
    releases = files.select("package", "release").distinct()
    kinds = classify.in_release(files, bundled, releases)
    texts = files.groupBy("package").agg(F.max("bundled").alias("bundled"), F.max("score").alias("fingerprint"))
    rows = kinds.join(texts, "package").withColumn("usage", classify.usage_label("bundled", "kind"))
    ways = F.when(F.array_contains("dlsym", F.col("symbol")), "dlopen").when(F.col("is_static"), "static").otherwise("dynamic")
    facts = files.select("package", "dlsym", "is_static", F.explode("symbols").alias("symbol")).select("package", "symbol", ways.alias("way")).withColumn("category", category_of(F.col("symbol")))
    counted = summary.package_rows(facts)
    return {"packages": rows.join(counted.drop("static_syms", "dynamic_syms", "dlopen_syms", "total_syms"), "package", "left"), "total": summary.package_total(counted.join(rows.select("package", "usage"), "package"), facts)}


def proc(spark, a):
    """Libraries of saved map files, or of what runs now if no path is given."""
    if not a.path:
        found = cut(processes.running(spark, a.pid or None, a.name or None))
        mapped = processes.libraries_of(found)
        return {"processes": found.drop("maps"), "libraries": mapped if a.include_deleted else mapped.where("not deleted")}
    # a line's place is its number in its file, so it does not depend on how files are cut
    maps = spark.read.text(a.path, wholetext=True).select(F.lit(a.pid).alias("pid"), F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("at", "line"))
    found = text_tables.mapped_libraries(maps.select("pid", F.struct("file", "at").alias("position"), F.regexp_replace("line", "\r$", "").alias("line"))).withColumn("position", F.col("position.at").cast("long"))
    return {"libraries": found if a.include_deleted else found.where("not deleted")}


def source(spark, a):
    dimension = named(spark, a)
    read = files.texts(spark, a.path, not a.no_recursive)
    known, custom = [r["symbol"] for r in dimension.select("symbol").collect()], custom_names(spark, a)
    found = calls.extract(read, known).withColumn("category", category_of(F.col("symbol"), custom=custom))
    out = {"call_sites": found, "symbol_summary": usage.summary_with_files(found), "rejected": files.rejected(spark, a.path, list(calls.LANGUAGES))}
    if a.recover_parser_diagnostics:
        seen = diagnostics.diagnostics(read, diagnostics.RECOVERY_LIMIT)
        recovered = diagnostics.recovered(seen, dimension, found)
        out |= {"diagnostics": seen, "recovered": recovered, "fallback": usage.fallback_counts(recovered)}
    if a.compat:
        status = usage.compat_status(found, reports.compatibility(spark, a.compat))
        out |= {"coverage": usage.coverage(status.select("symbol", "status").distinct())}
    return out


def projects_of(read: DataFrame, dimension: DataFrame, root: str, exclude: list[str]) -> DataFrame:
    """Projects below a root (path) that name any symbol, by the boundary rule; excluded ones left out."""
    below = F.substring_index(F.col("folder"), root.rstrip("/") + "/", -1)
    folders = resolve.probe(read.withColumnRenamed("file", "path"), dimension).select(below.alias("path"))
    return usage.excluded(graph.boundaries(folders), exclude).select(F.col("project").alias("path")).distinct()


def combo_scan(spark, a):
    """Probe, scan of every project, and one merged report."""
    dimension, read = named(spark, a), files.texts(spark, a.path, not a.no_recursive)
    projects = cut(projects_of(read, dimension, a.path, a.exclude or []))
    known = [r["symbol"] for r in dimension.select("symbol").collect()]
    below = F.substring_index(F.col("file"), a.path.rstrip("/") + "/", -1)
    found = calls.extract(read, known).withColumn("below", below)
    # the folders above each file are few, so projects are found by equality
    above = F.transform(F.sequence(F.lit(1), F.size("parts") - 1), lambda i: F.array_join(F.slice("parts", 1, i), "/"))
    folders = found.select("below", F.split("below", "/").alias("parts")).distinct().where(F.size("parts") > 1).select("below", F.explode(above).alias("path"))
    inside = found.join(folders.join(projects.distinct(), "path"), "below")
    rows = cut(inside.withColumnRenamed("path", "project").drop("below").withColumn("category", category_of(F.col("symbol"), custom=custom_names(spark, a))))
    out = {"projects": usage.with_total(rows), "call_sites": rows, "symbol_summary": usage.merged_symbol_summary(rows), "project_stats": usage.project_stats(rows, ["file", "line"])}
    if a.compat:
        status = usage.compat_status(rows, reports.compatibility(spark, a.compat))
        out |= {"coverage": usage.coverage(status.select("symbol", "status").distinct()), "blockers": usage.blockers(status)}
    return out


def source_merge(spark, a):
    raw = spark.read.format("binaryFile").load(a.path)
    rows = reports.spreadsheet_calls(raw).withColumnRenamed("file_path", "file")
    return {"call_sites": rows, "symbol_summary": usage.merged_symbol_summary(rows), "projects": usage.with_total(rows)}


def sides_of(spark: SparkSession, a) -> tuple[DataFrame, DataFrame, bool]:
    """Call sites of both reports of a difference, and whether any has a project."""
    old, new = (text_tables.call_reports(spark, p) for p in (a.old, a.new))
    old, new = (x.withColumn("file", text.strip_prefix(F.col("file"), prefix)) for x, prefix in ((old, a.old_prefix), (new, a.new_prefix)))
    if a.ignore_categories:
        old, new = (x.where(~F.coalesce(F.col("category"), F.lit("")).isin(a.ignore_categories.split(","))) for x in (old, new))
    several = not old.where("project <> ''").isEmpty() or not new.where("project <> ''").isEmpty()
    return old, new, several


def scanned_of(spark: SparkSession, a) -> tuple[DataFrame, DataFrame]:
    """Files scanned by both reports of a difference."""
    return text_tables.files_scanned(spark, a.old), text_tables.files_scanned(spark, a.new)


def diff_workbook(spark, a):
    """The sheets of a difference."""
    return sheets.diff_sheets(*sides_of(spark, a), a.include_unchanged, scanned_of(spark, a))


def source_diff(spark, a):
    old, new, several = sides_of(spark, a)
    out = {"metrics": diff.metrics(old, new, ["project"] if several else None, scanned_of(spark, a)), "categories": diff.category_metrics(old, new), "files": diff.in_order(diff.file_symbols(old, new), F.desc(F.abs(F.col("new_calls") - F.col("old_calls"))), "file"), "symbols": diff.in_order(diff.symbol_categories(old, new), "category", "symbol")}
    if several:
        deltas = diff.symbols(old, new, ["project"])
        out |= {"projects": summary.project_deltas(deltas), "project_files": diff.file_symbols(old, new, ["project"])}
    if a.summary_only:
        return out
    key = ["project", *diff.KEY] if several else diff.KEY
    sites = diff.call_sites(old, new, key).join(diff.call_site_details(old, new, key), key)
    sites = sites.where(F.lit(a.include_unchanged) | (F.col("status") != "unchanged"))
    return out | {"call_sites": diff.in_order(sites, *key), "pairs": diff.pairs(old, new, key).where(F.lit(a.include_unchanged) | (F.col("status") != "unchanged"))}


def source_probe(spark, a):
    read, dimension = files.texts(spark, a.path), named(spark, a)
    return {"folders": resolve.probe(read.withColumnRenamed("file", "path"), dimension), "projects": projects_of(read, dimension, a.path, a.exclude or [])}


def source_summary(spark, a):
    folder, name = a.manifest.rsplit("/", 1) if "/" in a.manifest else (".", a.manifest)
    found = repositories.manifest(spark, folder, name)
    return {"repositories": found.withColumn("tag", repositories.tag_of(F.col("path"))["tag"])}


def update_data(spark, a):
    read = files.texts(spark, a.path)
    return {"macros": headers.macros(read), "version": headers.version(read, a.path)}


def aggregate(spark, a):
    each = reports.package_reports(spark, a.path)
    facts = each.select(F.element_at(F.split("scan_root", "/"), -1).alias("executable"), F.explode("symbols").alias("symbol")).withColumn("category", category_of(F.col("symbol")))
    mapping = reports.component_mapping(spark, a.mapping).withColumn("ord", F.lit(0))
    return {"ranking": usage.ranking(usage.component_stats(usage.assigned(facts, mapping)), a.top)}


def export(spark, a):
    return {"table": spark.read.parquet(a.path)}


COMMANDS = {"scan": scan, "hap": hap, "hap-summary": hap_summary, "combo-scan": combo_scan, "proc": proc, "source": source, "source-merge": source_merge, "source-diff": source_diff, "source-probe": source_probe, "source-summary": source_summary, "update-data": update_data, "aggregate": aggregate, "export": export}
#: Commands whose workbooks have fixed sheets.
WORKBOOKS = {"scan": scan_workbook, "source-diff": diff_workbook}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="linkscope", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    for name in COMMANDS:
        p = sub.add_parser(name)
        p.add_argument("-o", "--output", required=True)
        p.add_argument("-f", "--format", default="parquet", choices=["parquet", "json", "tsv", "xlsx", "html", "document"])
        if name == "source-diff":
            p.add_argument("old")
            p.add_argument("new")
            p.add_argument("--ignore-categories", default="")
            p.add_argument("--summary-only", action="store_true")
            p.add_argument("--include-unchanged", action="store_true")
            p.add_argument("--old-prefix", default="")
            p.add_argument("--new-prefix", default="")
        elif name == "source-summary":
            p.add_argument("manifest")
        elif name == "proc":
            p.add_argument("path", nargs="?", default="", help="saved map files; what runs now if left out")
        else:
            p.add_argument("path")
        if name in ("scan", "hap", "source", "source-probe", "combo-scan"):
            p.add_argument("--symbols", default="", help="file of symbol names, one a line")
            p.add_argument("--openssl-lib", action="append", help="library whose exports are the symbols")
            p.add_argument("--add", default="", help="file of names of the user's own")
        if name in ("scan", "source", "combo-scan"):
            p.add_argument("--no-recursive", action="store_true")
        if name == "scan":
            p.add_argument("--from-file", default="", help="file of the paths to scan, one a line")
            p.add_argument("--fingerprints", default="")
            p.add_argument("--tree", action="store_true", help="dependency trees of the programs")
            p.add_argument("-L", "--library-path", action="append", help="folder of libraries that trees may lead to")
            p.add_argument("--sysroot", default="", help="root of a system whose library folders are searched")
        if name == "hap":
            p.add_argument("--abi", default="")
        if name in ("source-probe", "combo-scan"):
            p.add_argument("--exclude", nargs="+")
        if name in ("source", "combo-scan"):
            p.add_argument("--compat", default="")
        if name == "source":
            p.add_argument("--recover-parser-diagnostics", action="store_true")
        if name == "proc":
            p.add_argument("--pid", type=int, default=0)
            p.add_argument("--name", default="", help="name of running processes")
            p.add_argument("--include-deleted", action="store_true")
        if name == "aggregate":
            p.add_argument("-m", "--mapping", required=True)
            p.add_argument("--top", type=int, default=20)
    return top


def main(words: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Exit code 0; for source-diff 1 where something differs; for proc 2 where no such process runs."""
    words = sys.argv[1:] if words is None else words
    if words and words[0] not in COMMANDS and not words[0].startswith("-"):
        words = ["scan", *words]
    a = parser().parse_args(words)
    spark = spark or SparkSession.builder.appName("linkscope").getOrCreate()
    book = WORKBOOKS.get(a.command) if a.format == "xlsx" else None
    if book:
        sinks.spreadsheet(a.output, book(spark, a))
        if a.command != "source-diff":
            return 0
    tables = COMMANDS[a.command](spark, a)
    if a.format in ("xlsx", "html", "document"):
        tables = {name: df.orderBy(*order) if (order := sinks.order_of(name, df)) and a.command != "source-diff" else df for name, df in tables.items()}
    if a.format == "xlsx":
        if not book:
            sinks.spreadsheet(a.output, tables)
    elif a.format == "html":
        sinks.page(a.output, a.command, tables)
    elif a.format == "document":
        sinks.document(a.output, {"meta": {"report_type": a.command, "target": getattr(a, "path", "")}, **tables})
    else:
        for name, df in tables.items():
            path, order = f"{a.output.rstrip('/')}/{name}", sinks.order_of(name, df)
            # the status comes first in a difference, which is in order already
            if order and not (a.command == "source-diff" and name == "call_sites"):
                sinks.write_ordered(df, path, a.format, order)
            else:
                sinks.write(df, path, a.format)
    if a.command == "proc" and "processes" in tables and tables["processes"].isEmpty():
        return 2
    changed = a.command == "source-diff" and not diff.is_empty(tables["symbols"], tables["files"], *[tables[t] for t in ("call_sites",) if t in tables])
    return int(changed)


if __name__ == "__main__":
    sys.exit(main())
