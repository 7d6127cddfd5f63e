"""Detection and classification rules over facts: confidence, fingerprints, clusters, patterns, packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkscope.functions.categories import tier_of
from linkscope.functions.text import basename, is_ssl_name, library_stem
from linkscope.operators.lineage import cut
from linkscope.operators.parts import dealt
from linkscope.operators.substrings import occurrences


def static_confidence(symbols: DataFrame, by: str = "file") -> DataFrame:
    """Confidence that a file has the library built in, by the tiers of the symbols it exports, and the reason as text.

    symbols: by, symbol, category, detected (boolean), version of the banner found, if any, and library, if named.
    """
    t = tier_of(F.col("category"))
    named = "library" in symbols.columns
    n = symbols.groupBy(by).agg(*[F.count_if(t == i).alias(f"t{i}") for i in (1, 2, 3)], F.count("*").alias("total"), F.countDistinct("category").alias("n_categories"), F.min("category").alias("category"), F.max("detected").alias("detected"), F.max("version").alias("version"), (F.max("library") if named else F.lit(None).cast("string")).alias("library"))
    return n.select(by, "t1", "t2", "t3", "total", *confidence())


def confidence() -> list[Column]:
    """Level and reason from the columns t1, t2, t3, total, n_categories, category, detected, version and library: the first rule that fits."""
    t1, t2, t3, total = (F.col(c) for c in ("t1", "t2", "t3", "total"))
    hit, library = F.coalesce("detected", F.lit(False)), F.coalesce("library", F.lit(""))
    version = hit & F.coalesce(F.col("version") != "", F.lit(False))
    # Texts of the reasons.
    rules = [
        (version, "high", ["version_banner: ", F.col("version"), " (", total, " exported)"]),
        (hit & (t1 >= 2), "high", [library, "_detected: ", t1, " tier1, ", total, " total"]),
        (t1 >= 5, "high", ["tier1_symbols: ", t1, " tier1, ", total, " total"]),
        ((total >= 50) & (t1 >= 1), "high", ["large_surface: ", total, " total, ", t1, " tier1"]),
        (hit, "medium", ["ssl_detected: ", library, " (", total, " exported)"]),
        ((t1 >= 2) & (total >= 5), "medium", ["moderate_tier1: ", t1, " tier1, ", total, " total"]),
        ((t2 >= 5) & (total >= 20), "medium", ["strong_tier2: ", t2, " tier2, ", total, " total"]),
        (t1 >= 1, "low", ["minimal_tier1: ", t1, " tier1, ", total, " total"]),
        ((t2 >= 1) & (total >= 5), "low", ["weak_tier2: ", t2, " tier2, ", total, " total"]),
        (total >= 10, "low", ["large_count: ", total, " total (t1=", t1, " t2=", t2, " t3=", t3, ")"]),
        ((total <= 2) & (t2 == 0), "none", ["insufficient: ", total, " total, all tier3"]),
        (F.col("n_categories") > 1, "low", ["mixed_categories: ", F.col("n_categories"), " categories, ", total, " total"]),
        (total.between(3, 5) & (t2 == 0), "none", ["single_primitive: ", F.col("category"), " only, ", t3, " symbols"]),
    ]
    level, reason = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    written = lambda parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    for fits, name, parts in rules:
        level, reason = level.when(fits, name), reason.when(fits, written(parts))
    rest = written(["default: ", t1, " tier1, ", t2, " tier2, ", t3, " tier3, ", total, " total"])
    return [level.otherwise("low").alias("confidence"), reason.otherwise(rest).alias("reason")]


def fingerprint_parts(strings: DataFrame, marks: DataFrame, by: str = "file") -> DataFrame:
    """Known strings of each category that a file has, of how many, and its points before and after the category's limit."""
    own = strings.select(by, "string").distinct()
    if "mode" in marks.columns:
        exact = own.join(marks.where("mode <> 'substring'").drop("mode"), "string")
        parts = marks.where("mode = 'substring'").drop("mode")
        inside = occurrences(own.withColumnRenamed("string", "whole"), "whole", parts, "string").distinct().join(parts, "string").distinct()
        hit = exact.unionByName(inside)
    else:
        hit = own.join(marks, "string")
    every = marks.select("category", "string").distinct().groupBy("category").agg(F.count("*").alias("total"))
    each = hit.groupBy(by, "category").agg(F.count("*").alias("matched"), (F.count("*") * F.max("per_point")).alias("raw"), F.max("max_points").alias("most"))
    return each.join(every, "category").select(by, "category", "matched", "total", "raw", F.least("raw", "most").alias("capped"))


def fingerprint_scores(strings: DataFrame, marks: DataFrame, by: str = "file", max_score: float = 106, levels: tuple[float, float, float] = (60, 35, 15)) -> DataFrame:
    """Scores by categories of known strings: each counts per_point a string and max_points at most.

    marks: category, string, per_point, max_points and, if some are parts of strings, mode (exact or substring).
    Thresholds hold for the raw score; the reported one is of 100.
    """
    each = fingerprint_parts(strings, marks, by)
    raw = each.groupBy(by).agg(F.sum("capped").alias("raw"), F.sum("matched").alias("matched"))
    level = F.when(F.col("raw") >= levels[0], "high").when(F.col("raw") >= levels[1], "medium").when(F.col("raw") >= levels[2], "low").otherwise("none")
    return raw.select(by, "matched", F.bround(F.col("raw") / max_score * 100, 1).alias("score"), level.alias("confidence"))


def clusters(strings: DataFrame, by: str = "file", gap: int = 256, least: int = 3) -> DataFrame:
    """Runs of offsets with no gap above the limit that have enough members: by, start, end, n."""
    order = Window.partitionBy(by).orderBy("offset")
    new = F.when(F.col("offset") - F.lag("offset").over(order) > gap, 1).otherwise(0)
    island = dealt(strings, by).withColumn("new", new).withColumn("island", F.sum("new").over(order.rangeBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(by, "island").agg(F.min("offset").alias("start"), F.max("offset").alias("end"), F.count("*").alias("n")).where(F.col("n") >= least).drop("island")


def pattern_hits(names: DataFrame, patterns: DataFrame) -> DataFrame:
    """Where each pattern of a group occurs in a file first: undefined symbols before defined ones before strings.

    names: file, name, place (und, def or rodata).
    """
    rank = F.when(F.col("place") == "und", 0).when(F.col("place") == "def", 1).otherwise(2)
    return names.join(patterns, names["name"] == patterns["pattern"]).groupBy("file", "group", "pattern").agg(F.min_by("place", rank).alias("place"))


def shared_objects(names: DataFrame, file: str = "file") -> DataFrame:
    """Names of files that are shared objects, the only ones in which patterns are looked for."""
    return names.where(basename(F.col(file)).rlike(r"\.so($|\.)"))


def pattern_summary(hits: DataFrame) -> DataFrame:
    """`group (n), ...` of each file, groups in order."""
    n = hits.groupBy("file", "group").agg(F.count("*").alias("n"))
    return n.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("group", "n"))), lambda x: F.concat(x["group"].cast("string"), F.lit(" ("), x["n"].cast("string"), F.lit(")"))), ", ").alias("summary"))


FILE_FACTS = """package, path, symbols, dlsym, dlopen_libs, libs, deps (arrays), is_static, uses_dlopen (booleans), confidence"""


def package_libraries(files: DataFrame, bundled: DataFrame) -> DataFrame:
    """What a package brings along (package, library, provider): its bundled libraries, and files that have one built in."""
    sure = F.col("is_static") & F.col("confidence").isin("high", "medium")
    own = files.where(sure).select("package", basename(F.col("path")).alias("library"), F.lit(True).alias("provider"))
    return bundled.select("package", basename(F.col("library")).alias("library"), F.lit(False).alias("provider")).unionByName(own)


#: What a row of a package tells of: a file, a symbol in use, or the stem of a library that is needed or at hand.
FILE, SYMBOL, STEM = 0, 1, 2
#: Bits of files and symbols: ways of use; of files only: needs no library that could be named, or one that only a sibling can have.
STATIC, DYNAMIC, DLOPEN, STUCK, SIBLING = 1, 2, 4, 8, 16
#: Bits of a stem.
NEEDED, HELD = 1, 2


def _file_ways(files: DataFrame) -> DataFrame:
    """What a file tells by itself: package, bits, used and loaded (symbols), needed (stems), held (stem or null), deps (base names, of direct needs without libraries)."""
    lists, none = ("symbols", "dlsym", "dlopen_libs", "libs", "deps"), F.array().cast("array<string>")
    sure = F.col("is_static") & F.col("confidence").isin("high", "medium")
    files = files.select("package", F.when(sure, F.lower(library_stem(F.col("path")))).alias("held"), F.coalesce("is_static", F.lit(False)).alias("static"), F.coalesce("uses_dlopen", F.lit(False)).alias("dlopen"), *[F.coalesce(c, none).alias(c) for c in lists])
    static, dlopen, some = F.col("static"), F.col("dlopen"), F.size("symbols") > 0
    evidence = (F.size("dlsym") > 0) | F.exists("dlopen_libs", is_ssl_name)
    # a file that loads at run time counts as such only with evidence or symbols
    files = files.withColumns({"loads": F.when(static, dlopen & evidence).otherwise(dlopen & (evidence | some)), "directly": ~static & ~dlopen & some})
    loads, directly = F.col("loads"), F.col("directly")
    rest = F.when(loads, F.array_except("symbols", "dlsym")).otherwise(F.col("symbols"))
    asks = F.when(loads, F.col("dlopen_libs")).when((static | directly) & (F.size("libs") > 0), F.col("libs"))
    files = files.withColumns({"rest": rest, "needed": F.transform(F.filter(asks, is_ssl_name), lambda x: F.lower(library_stem(x)))})
    sibling = directly & F.col("needed").isNull()
    flags = {STATIC: static, DYNAMIC: (loads & ~static & (F.size("rest") > 0)) | directly, DLOPEN: loads, STUCK: F.col("needed").isNotNull() & (F.size(F.coalesce("needed", none)) == 0), SIBLING: sibling}
    bits = sum((F.when(c, bit).otherwise(0) for bit, c in flags.items()), F.lit(0))
    only = lambda c, of: F.when(c, of).otherwise(none)
    return files.select("package", bits.alias("bits"), only(static | loads | directly, F.col("rest")).alias("used"), only(loads, F.col("dlsym")).alias("loaded"), F.coalesce("needed", none).alias("needed"), "held", only(sibling, F.transform("deps", basename)).alias("deps"))


def _alone(files: DataFrame, bundled: DataFrame) -> DataFrame:
    """package_methods() and stuck: no library of a sibling can help.

    A package's files meet once, with the stems that it brings along; symbols and stems are made distinct there.
    """
    row = lambda what, name, bits: F.struct(F.lit(what).alias("what"), name.alias("name"), bits.alias("bits"))
    each = lambda what, c, bits: F.transform(c, lambda x: row(what, x, bits))
    has = lambda c, bit: F.col(c).bitwiseAND(F.lit(bit)) != 0
    way = F.when(has("bits", STATIC), STATIC).otherwise(DYNAMIC)
    tells = F.concat(F.array(row(FILE, F.lit(None).cast("string"), F.col("bits"))), each(SYMBOL, "used", way), each(SYMBOL, "loaded", F.lit(DLOPEN)), each(STEM, "needed", F.lit(NEEDED)), each(STEM, F.array_compact(F.array("held")), F.lit(HELD)))
    brought = bundled.select("package", F.array(row(STEM, F.lower(library_stem(F.col("library"))), F.lit(HELD))).alias("tells"))
    rows = _file_ways(files).select("package", tells.alias("tells")).unionByName(brought)
    met = dealt(rows, "package")
    met = rows.repartition("package") if met is rows else met
    # no array is empty; for an inner explode Spark would filter by the array's size, and work out all of it once more for that
    one = met.select("package", F.explode_outer("tells").alias("t")).select("package", "t.*").groupBy("package", "what", "name").agg(F.bit_or("bits").alias("bits"))
    of = lambda what, bit: (F.col("what") == what) & has("bits", bit)
    flag = lambda what, bit, name: F.bool_or(of(what, bit)).alias(name)
    counts = {"n_static": of(SYMBOL, STATIC), "n_dynamic": of(SYMBOL, DYNAMIC), "n_dlopen": of(SYMBOL, DLOPEN), "n_symbols": F.col("what") == SYMBOL}
    lacking = of(FILE, STUCK | SIBLING) | ((F.col("what") == STEM) & (F.col("bits") == NEEDED))
    full = one.groupBy("package").agg(flag(FILE, STATIC, "has_static"), flag(FILE, DYNAMIC, "has_dynamic"), flag(FILE, DLOPEN, "has_dlopen"), flag(FILE, STUCK, "stuck"), F.bool_or(lacking).alias("open"), F.bool_or(F.col("what") == FILE).alias("has_files"), *[F.count_if(c).alias(n) for n, c in counts.items()]).where("has_files")
    number = sum((F.col(c).cast("int") for c in ("has_static", "has_dlopen", "has_dynamic")), F.lit(0))
    method = F.when(number == 0, "None").when(number > 1, "Mixed").when(F.col("has_dynamic"), "Dynamic").when(F.col("has_static"), "Static").otherwise("dlopen")
    kind = F.when((F.col("n_symbols") == 0) & ~F.col("has_dlopen"), "No-OpenSSL").when(~F.col("open"), "Self-Contained").otherwise("System-Link")
    return full.select("package", method.alias("method"), kind.alias("kind"), *counts, "stuck")


def package_methods(files: DataFrame, bundled: DataFrame) -> DataFrame:
    """How each package uses the library, and whether all that it needs is inside; bundled: package, library.

    files: see FILE_FACTS.  A file that loads at run time and has other symbols too counts as both.
    """
    return _alone(files, bundled).drop("stuck")


def in_release(files: DataFrame, bundled: DataFrame, releases: DataFrame) -> DataFrame:
    """package_methods() with `In-APP-Link` for a package whose needs the packages of its release meet together.

    releases: package, release.  Names of files with a library built in count for direct needs only if a sibling has them.
    Packages by themselves are found once and written; of files only those with a need are read again.
    """
    alone = cut(_alone(files, bundled))
    held = package_libraries(files, bundled).join(releases, "package").select("release", F.struct("package", "library", "provider").alias("h"))
    # a release counts with several packages and some library
    both = releases.select("release", F.lit(None).cast(held.schema["h"].dataType).alias("h")).unionByName(held)
    own = both.groupBy("release").agg(F.count_if(F.col("h").isNull()).alias("n"), F.count("h").alias("some"), F.collect_set(F.lower(library_stem(F.col("h.library")))).alias("stems"), F.collect_set(F.when(F.col("h.provider"), F.struct("h.package", "h.library"))).alias("held"))
    waiting = alone.where("kind = 'System-Link' and not stuck").select("package").join(releases, "package").join(own.where("n > 1 and some > 0"), "release")
    siblings = F.transform(F.filter("held", lambda x: x["package"] != F.col("package")), lambda x: x["library"])
    needs = _file_ways(files).select("package", "needed", "deps", (F.col("bits").bitwiseAND(F.lit(SIBLING)) != 0).alias("sibling")).where((F.size("needed") > 0) | F.col("sibling"))
    lacking = (F.size(F.array_except("needed", "stems")) > 0) | (F.col("sibling") & ~F.arrays_overlap("deps", "providers"))
    met = dealt(needs, "package").join(waiting.select("package", "stems", siblings.alias("providers")), "package").groupBy("package").agg(F.bool_or(lacking).alias("open"))
    better = met.where(~F.col("open")).select("package", F.lit("In-APP-Link").alias("better"))
    return alone.drop("stuck").join(better, "package", "left").withColumn("kind", F.coalesce("better", "kind")).drop("better")


def all_resolved(needs: DataFrame, bundled: DataFrame) -> DataFrame:
    """Whether a package has every library that it needs; needs and bundled: package, library."""
    have = bundled.select("package", "library").distinct().withColumn("here", F.lit(True))
    return needs.distinct().join(have, ["package", "library"], "left").groupBy("package").agg(F.bool_and(F.coalesce("here", F.lit(False))).alias("resolved"))


def usage_label(bundled: str, kind: str):
    """Bundled text, then bundled flag, then the kind of link."""
    b, k = F.col(bundled), F.col(kind)
    rest = F.trim(F.substring(b, 4, 1 << 20))
    return F.when(b.startswith("Yes"), F.when(rest != "", F.concat(F.lit("Bundled "), rest)).otherwise("Bundled")).when(b == "true", "Bundled").when(k.isin("System-Link", "In-APP-Link"), k).otherwise("None")
