"""A binary scan put together: what each file links to, has built in and loads at run time, and the totals of all files.

The columns of a file, from which the phases decide (arrays are never null):

path, und and defs (names that the dimension knows, imported and exported), libs (needed libraries that are named like
the library), banner_library and banner_version, weak (whether the weak symbols are there), has_loader (imports
dlopen or dlsym), dl_found (whether strings or code showed names or libraries), dl_symbols, dl_libs, dl_confidence,
hidden (strings that are exports of the library), print_confidence, print_library, print_score, print_matched, print_total.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkscope.functions.categories import LIBRARY_PREFIXES, PREFIXES, category_of
from linkscope.functions.text import basename, is_library
from linkscope.operators import banners, classify, graph

NONE = "cast(array() as array<string>)"


def _tiers(files: DataFrame, rules) -> DataFrame:
    """Numbers of exported names by tier, from the arrays alone: no row leaves its file."""
    own = F.array_except("defs", "und")
    kinds = F.transform(own, lambda s: category_of(s, rules))
    tier = lambda i: F.size(F.filter("kinds", lambda k: classify.tier_of(k) == i)).cast("long")
    out = files.withColumn("kinds", kinds)
    out = out.withColumns({"t1": tier(1), "t3": tier(3), "total": F.size("kinds").cast("long"), "n_categories": F.size(F.array_distinct("kinds")).cast("long"), "category": F.array_min("kinds")})
    return out.withColumn("t2", F.col("total") - F.col("t1") - F.col("t3"))


def static_phase(files: DataFrame, rules=None) -> DataFrame:
    """files with is_static, library, version, confidence, reason, forced (counts as direct), concealed, and symbols.

    Exported names decide first; a banner counts only where no library of that name is needed, and without exports it
    conceals what is inside; the fingerprint is the last resort.
    """
    hit = F.col("banner_library").isNotNull() | F.coalesce("weak", F.lit(False))
    named = F.coalesce("banner_library", F.when(F.coalesce("weak", F.lit(False)), F.lit("BoringSSL")))
    f = _tiers(files, rules or PREFIXES).withColumns({"detected": hit, "version": F.when(F.col("banner_library").isNotNull(), F.col("banner_version")), "library": named})
    level, reason = classify.confidence()
    f = f.withColumns({"level": level, "why": reason})
    no_libs = F.size("libs") == 0
    by_exports = (F.col("total") > 0) & (F.col("level") != "none")
    by_banner = F.col("detected") & no_libs
    bare = by_banner & (F.size("defs") == 0)
    by_print = ~by_exports & ~by_banner & no_libs & F.coalesce(F.col("print_confidence") != "", F.lit(False))
    f = f.withColumns({"by_exports": by_exports, "by_banner": by_banner, "bare": bare, "by_print": by_print})
    inside = F.when((F.col("bare") | F.col("by_print")) & (F.size("hidden") > 0), F.col("hidden")).when(F.col("by_exports"), F.array_distinct(F.concat("und", "defs"))).otherwise(F.col("und"))
    printed = F.format_string("fingerprint: score=%.1f matched=%d/%d", "print_score", "print_matched", "print_total")
    sure = F.col("level") != "none"
    return f.select(
        *files.columns,
        (F.col("by_exports") | F.col("by_banner") | F.col("by_print")).alias("is_static"),
        F.when(F.col("by_banner"), F.col("library")).when(F.col("by_print"), F.coalesce("print_library", F.lit("OpenSSL"))).otherwise("").alias("static_library"),
        F.when(F.col("by_banner"), F.col("version")).alias("static_version"),
        F.when(F.col("by_exports"), F.col("level")).when(F.col("by_print"), F.col("print_confidence")).when(F.col("by_banner") & sure, F.col("level")).otherwise("").alias("confidence"),
        F.when(F.col("by_exports"), F.col("why")).when(F.col("by_print"), printed).when(F.col("by_banner") & sure, F.col("why")).otherwise("").alias("reason"),
        (F.col("by_exports") | F.col("bare") | F.col("by_print")).alias("forced"),
        (F.col("bare") | F.col("by_print")).alias("concealed"),
        inside.alias("symbols"),
    )


def file_results(files: DataFrame, rules=None) -> DataFrame:
    """One row per file: path, is_direct, libs, symbols, static columns, uses_dlopen, dlsym, dlopen_libs, dlopen_confidence.

    Names that are loaded at run time count where the loader is imported and nothing is concealed; a file that links
    directly needs names of libraries among its strings too.
    """
    s = static_phase(files, rules)
    direct = (F.size("libs") > 0) | F.col("forced")
    seen = F.coalesce("has_loader", F.lit(False)) & ~F.col("concealed") & F.coalesce("dl_found", F.lit(False))
    uses = seen & (~direct | (F.size("dl_libs") > 0))
    none = F.expr(NONE)
    s = s.withColumns({"is_direct": direct, "uses_dlopen": uses, "dlopen_libs": F.when(seen, F.col("dl_libs")).otherwise(none), "dlsym": F.when(uses, F.filter("dl_symbols", lambda x: ~F.array_contains(F.col("symbols"), x))).otherwise(none)})
    return s.select("path", "is_direct", "libs", F.concat("symbols", "dlsym").alias("symbols"), "is_static", "static_library", "static_version", "confidence", "reason", F.col("defs").alias("exported"), "uses_dlopen", "dlsym", "dlopen_libs", F.when(F.col("uses_dlopen"), F.col("dl_confidence")).alias("dlopen_confidence"))


def roll_up(results: DataFrame) -> DataFrame:
    """Files with something built in, files that load at run time, and the distinct names and libraries that they load, as text."""
    # a file is read once: itself (0) and its names and libraries (1, 2), which are made distinct first;
    # an inner explode would have Spark filter by the array's size, and work out all of it once more for that
    of = lambda i, c: F.transform(c, lambda x: F.struct(F.lit(i).alias("of"), x.alias("name")))
    itself = F.array(F.struct(F.lit(0).alias("of"), F.lit(None).cast("string").alias("name")))
    rows = results.select("is_static", "uses_dlopen", F.explode_outer(F.concat(itself, of(1, "dlsym"), of(2, "dlopen_libs"))).alias("x")).select("is_static", "uses_dlopen", "x.*")
    each = rows.groupBy("of", "name").agg(F.count_if("is_static").alias("s"), F.count_if("uses_dlopen").alias("d"))
    number = lambda c, v: F.coalesce(F.sum(F.when(F.col("of") == 0, F.col(c))), F.lit(0)).alias(v)
    names = lambda i, v: [F.count_if(F.col("of") == i).alias(f"n_{v}"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("of") == i, F.col("name")))), ",").alias(v)]
    return each.agg(number("s", "n_static"), number("d", "n_dlopen"), *names(1, "loaded_symbols"), *names(2, "loaded_libraries"))


def totals(results: DataFrame, machines: DataFrame) -> DataFrame:
    """Files, files with symbols, references, distinct symbols, and the first known machine; machines: path, arch, position."""
    first = F.min_by("arch", F.when(F.col("arch") != "unknown", F.col("position")))
    arch = machines.where("arch <> 'unknown'").agg(F.coalesce(first, F.lit("unknown")).alias("arch"), F.lit(1).alias("one"))
    # a file is read once: itself, at 0, and its symbols behind, which are made distinct first; outer as in roll_up
    rows = results.select(F.size("symbols").alias("n"), F.posexplode_outer(F.concat(F.array(F.lit(None).cast("string")), "symbols")).alias("at", "s"))
    itself = F.col("at") == 0
    each = rows.groupBy("s").agg(F.count_if(itself).alias("files"), F.count_if(itself & (F.col("n") > 0)).alias("some"), F.sum(F.when(itself, F.col("n"))).alias("n"))
    total = lambda c, v: F.coalesce(F.sum(c), F.lit(0)).alias(v)
    return each.agg(total("files", "n_files"), total("some", "n_with_symbols"), total("n", "n_references"), F.count("s").alias("n_symbols")).crossJoin(arch.drop("one"))


def without_bundled(files: DataFrame, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """Files to scan, and the distinct names of the libraries left out because they are bundled (package, library)."""
    name = basename(F.col(path))
    hit = is_library(name, LIBRARY_PREFIXES)
    return files.where(~hit), files.where(hit).select("package", name.alias("library")).distinct()


def bundled_text(packages: DataFrame, bundled: DataFrame, providers: DataFrame) -> DataFrame:
    """packages with bundled: `true` where a library lies in the package, else the label of its providers, else `false`.

    bundled: package, library; providers: package, label.
    """
    have = bundled.select("package", F.lit(True).alias("have")).distinct()
    return packages.join(have, "package", "left").join(providers.select("package", "label").distinct(), "package", "left").withColumn("bundled", F.when(F.col("have"), "true").otherwise(F.coalesce("label", F.lit("false")))).drop("have", "label")


def mark_transitive(results: DataFrame, edges: DataFrame, targets: DataFrame, depth: int = 10) -> DataFrame:
    """results with is_transitive: not direct, but a library is in reach; edges: src, dst of paths; targets: node."""
    near = graph.reachable(edges, targets, depth).where("depth > 0").select(F.col("node").alias("path"), F.lit(True).alias("near")).distinct()
    return results.join(near, "path", "left").withColumn("is_transitive", ~F.col("is_direct") & F.coalesce("near", F.lit(False))).drop("near")


def runtime_only(mapped: DataFrame, tree: DataFrame) -> DataFrame:
    """Mapped libraries (pid, path) with whether the dependency tree (pid, path) lacks them."""
    known = tree.select("pid", "path").distinct().withColumn("known", F.lit(True))
    return mapped.join(known, ["pid", "path"], "left").withColumn("runtime_only", F.col("known").isNull()).drop("known")


def detection(results: DataFrame) -> DataFrame:
    """path, symbol and how the file comes by it: dlopen-infer, dlopen, static-link or dynamic-link."""
    label = F.when(F.array_contains("dlsym", F.col("symbol")), F.when(F.col("dlopen_confidence") == "inferred", "dlopen-infer").otherwise("dlopen")).when(F.col("is_static"), "static-link").otherwise("dynamic-link")
    return results.select("path", "dlsym", "dlopen_confidence", "is_static", F.explode(F.array_distinct("symbols")).alias("symbol")).select("path", "symbol", label.alias("detection"))


def link_type(results: DataFrame) -> DataFrame:
    """path and the file's kind of link."""
    kind = F.when(F.col("uses_dlopen"), F.when(F.col("dlopen_confidence") == "inferred", "dlopen-infer").otherwise("dlopen")).when(F.col("is_static"), "static-link").when(F.col("is_direct"), "dynamic-link").otherwise("")
    return results.select("path", kind.alias("link"))


def package_batch(files: DataFrame) -> DataFrame:
    """Packages as one: files, files with symbols, static and loading ones, distinct symbols and loaded names.

    files: package, symbols, dlsym, is_static, uses_dlopen.
    """
    n = files.agg(F.countDistinct("package").alias("n_packages"), F.count("*").alias("n_files"), F.count_if(F.size("symbols") > 0).alias("n_with_symbols"), F.count_if("is_static").alias("n_static"), F.count_if("uses_dlopen").alias("n_dlopen"))
    one = lambda c, v: files.select(F.explode(c).alias("s")).agg(F.countDistinct("s").alias(v))
    return n.crossJoin(one("symbols", "n_symbols")).crossJoin(one("dlsym", "n_loaded"))


def batch_categories(files: DataFrame) -> DataFrame:
    """Distinct symbols of each category over all packages."""
    symbol = F.col("symbol")
    return files.select(F.explode("symbols").alias("symbol")).distinct().select(category_of(symbol).alias("category")).groupBy("category").agg(F.count("*").alias("n_symbols"))


def file_facts(symbols: DataFrame, needed: DataFrame, strings: DataFrame, found: DataFrame, dimension: DataFrame, resolved: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """The columns of a file from facts of its parts.

    symbols: path, name, defined; needed: path, libs, has_loader, arch, position; strings: path, offset, text; found:
    banners' rows (path, library, version); dimension: symbol; resolved: path, symbol (from machine code); marks: a fingerprint.
    """
    known = symbols.join(dimension.select(F.col("symbol").alias("name")).distinct(), "name", "left_semi")
    names = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("name"))))
    own = known.groupBy("path").agg(names(~F.col("defined")).alias("und"), names(F.col("defined")).alias("defs"))
    weak = banners.weak_symbols(symbols.select(F.col("path").alias("file"), F.col("name").alias("symbol"))).select(F.col("file").alias("path"), F.lit(True).alias("weak"))
    texts = strings.join(dimension.select(F.col("symbol").alias("text")).distinct(), "text", "left_semi")
    hidden = texts.groupBy("path").agg(F.array_sort(F.collect_set("text")).alias("hidden"))
    raw = texts.select("path", F.col("text").alias("symbol"), "offset").join(known.select("path", F.col("name").alias("symbol")).distinct(), ["path", "symbol"], "left_anti")
    runs = classify.clusters(raw, "path").select("path", "start", F.col("end").alias("stop"))
    near = raw.join(runs, "path").where("offset between start and stop").select("path", "symbol").distinct()
    loaded = banners.dlopen_symbols(raw.select("path", "symbol"), near, resolved, "path", strict=True)
    loaded = loaded.groupBy("path").agg(F.array_sort(F.collect_set("symbol")).alias("dl_symbols"), F.max("confidence").alias("dl_confidence"))
    libs = strings.where(is_library(basename(F.col("text")), LIBRARY_PREFIXES)).groupBy("path").agg(F.array_sort(F.collect_set("text")).alias("dl_libs"))
    out = needed.join(own, "path", "left").join(found.select("path", F.col("library").alias("banner_library"), F.col("version").alias("banner_version")), "path", "left").join(weak, "path", "left").join(hidden, "path", "left").join(loaded, "path", "left").join(libs, "path", "left")
    if marks is None:
        out = out.withColumns({"print_confidence": F.lit(""), "print_library": F.lit(None).cast("string"), "print_score": F.lit(0.0), "print_matched": F.lit(0).cast("long"), "print_total": F.lit(0)})
    else:
        total = marks.agg(F.count("*").alias("print_total"))
        scored = classify.fingerprint_scores(strings.select("path", F.col("text").alias("string")), marks.drop("library"), "path").select("path", F.nullif("confidence", F.lit("none")).alias("print_confidence"), F.lit(None).cast("string").alias("print_library"), F.col("score").alias("print_score"), F.col("matched").alias("print_matched"))
        out = out.join(scored, "path", "left").crossJoin(total)
    none = F.expr(NONE)
    lists = {c: F.coalesce(c, none) for c in ("und", "defs", "hidden", "dl_symbols", "dl_libs")}
    return out.withColumns(lists | {"dl_found": (F.size(F.coalesce("dl_symbols", none)) > 0) | (F.size(F.coalesce("dl_libs", none)) > 0)})


def report_rows(results: DataFrame, facts: DataFrame) -> DataFrame:
    """Files as the rows of a report: nested as readers of reports ask for; facts: path, kind, arch, needed, error."""
    loading = F.when(F.col("uses_dlopen"), F.struct(F.lit(True).alias("uses_dlopen"), F.col("dlsym").alias("dlopen_symbols"), "dlopen_libs", F.col("dlopen_confidence").alias("confidence")))
    own = facts.select("path", F.col("kind").alias("type"), "arch", F.col("needed").alias("direct_deps"), "error")
    found = results.select("path", F.struct(F.col("is_direct").alias("direct"), F.col("is_transitive").alias("transitive"), "libs").alias("openssl_deps"), F.col("symbols").alias("openssl_symbols_used"), F.col("is_static").alias("static_openssl"), F.col("static_version").alias("static_openssl_version"), F.col("static_library").alias("static_ssl_library"), F.col("confidence").alias("static_openssl_confidence"), F.col("reason").alias("static_openssl_confidence_reason"), F.col("exported").alias("openssl_exported"), loading.alias("dlopen_detection"))
    return own.join(found, "path", "left")
