"""Libraries and files found by name: search paths, providers inside packages, planned packages, and symbols in trees of sources."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkscope.functions.text import basename, dirname, ending, without_ending
from linkscope.operators.free_names import free_names

# Folders without libraries.
SKIPPED = """python python2 python2.7 python3 python3.8 python3.9 python3.10 python3.11 python3.12 python3.13 python3.14 site-packages
dist-packages __pycache__ share locale man doc docs info help include headers icons themes fonts src test tests examples samples .git .svn
node_modules cargo rustlib""".split()
INNER = [".hap", ".har", ".hsp"]


def resolve(requests: DataFrame, files: DataFrame, search: list[str]) -> DataFrame:
    """requests (library, rpath, runpath, origin) with the path of the first folder that has the library, or null.

    Folders: rpath, then runpath, `$ORIGIN` put in, then the search paths.  files: path.  The folders of a request are
    exploded and joined with the files by path, so nothing is listed on the driver.
    """
    key = ["library", "rpath", "runpath", "origin"]
    # a path depends on these four alone, so equal requests are asked once
    asked = requests.select(*[F.col(c).alias(f"_{c}") for c in key]).distinct()
    own = lambda c: F.filter(F.split(F.replace(F.coalesce(c, F.lit("")), F.lit("$ORIGIN"), F.coalesce("_origin", F.lit(""))), ":"), lambda x: x != "")
    folders = F.concat(own("_rpath"), own("_runpath"), F.array(*map(F.lit, search)).cast("array<string>"))
    tried = asked.select("*", F.posexplode(folders).alias("_at", "_folder")).withColumn("path", F.concat(F.regexp_replace("_folder", "/$", ""), F.lit("/"), "_library"))
    hit = tried.join(files.select("path").distinct(), "path").groupBy(*[f"_{c}" for c in key]).agg(F.min_by("path", "_at").alias("path"))
    same = [requests[c].eqNullSafe(hit[f"_{c}"]) for c in key]
    return requests.join(hit, reduce(and_, same), "left").drop(*[f"_{c}" for c in key])


def library_folders(files: DataFrame, root: str, max_depth: int = 50) -> DataFrame:
    """Folders below a root that hold shared libraries, with their depth; hidden and skipped folders and all below them do not count."""
    at = root.rstrip("/")
    below = F.substring("folder", len(at) + 2, 1 << 20)
    parts = F.filter(F.split(below, "/"), lambda x: x != "")
    held = files.where(basename(F.col("path")).rlike(r"\.so$|\.so\.")).select(dirname(F.col("path")).alias("folder")).distinct()
    inside = held.where((F.col("folder") == at) | F.col("folder").startswith(at + "/"))
    usual = F.forall(parts, lambda x: ~x.startswith(".") & ~x.isin(SKIPPED))
    return inside.withColumn("depth", F.size(parts).cast("long")).where(usual & (F.col("depth") < max_depth))


def by_basename(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Edges (src, dep) with the known file of that path, else the last of that name; files: path, ord."""
    exact = files.select(F.col("path").alias("dep"), F.col("path").alias("same")).distinct()
    last = files.groupBy(basename(F.col("path")).alias("dep")).agg(F.max_by("path", "ord").alias("named"))
    return edges.join(exact, "dep", "left").join(last, "dep", "left").select("src", "dep", F.coalesce("same", "named").alias("path"))


def static_providers(files: DataFrame) -> DataFrame:
    """Libraries of a package that have the library built in with some confidence, with what uses them.

    files: package, path, confidence (null or none if it is not built in), reason, n_symbols, needs (names).  Of files of
    one name the one of most symbols counts, then the smallest path.  label is the package's.
    """
    name = basename(F.col("path"))
    f = files.withColumn("name", name)
    best = f.where(F.col("confidence").isin("high", "medium")).groupBy("package", "name").agg(F.min(F.struct((-F.col("n_symbols")).alias("n"), "path", "confidence", "reason")).alias("b"))
    needs = f.select("package", F.col("name").alias("consumer"), F.explode("needs").alias("name")).where("consumer <> name").distinct()
    used = best.join(needs, ["package", "name"], "left").groupBy("package", "name").agg(F.first("b").alias("b"), F.array_sort(F.collect_set("consumer")).alias("consumers"))
    hidden = F.coalesce(F.col("b.reason").startswith("fingerprint:"), F.lit(False))
    label = used.groupBy("package").agg(F.max(F.size("consumers")).alias("c"), F.bool_and(hidden).alias("h")).select("package", F.when(F.col("c") > 0, "Yes (static, shared)").when(F.col("h"), "Yes (static, hidden)").otherwise("Yes (static)").alias("label"))
    return used.join(label, "package").select("package", "name", F.col("b.confidence").alias("confidence"), (-F.col("b.n")).alias("n_symbols"), "consumers", hidden.alias("hidden"), "label")


def planned(entries: DataFrame) -> DataFrame:
    """Packages inside containers (container, entry, position) with their display names; those that are taken get the least free number."""
    name = basename(F.col("entry"))
    inner = entries.where(~F.col("entry").startswith("__MACOSX") & (name != "") & F.lower(ending(name)).isin(INNER))
    stem = F.concat(without_ending(basename(F.col("container"))), F.lit("_"), without_ending(name))
    named = free_names(inner.select("container", "entry", "position", stem.alias("stem"), ending(name).alias("ending")), "container", "stem", "ending", ["position", "entry"])
    return named.select("container", "entry", F.concat("stem", F.coalesce(F.concat(F.lit("_"), F.col("number").cast("string")), F.lit("")), "ending").alias("display_name"))


def probe(sources: DataFrame, symbols: DataFrame) -> DataFrame:
    """Folders of sources (path, text) that name any symbol as a word: folder, files that do, and the first of them."""
    words = sources.select("path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\w+"), F.lit(0)))).alias("symbol"))
    hit = words.join(symbols.select("symbol").distinct(), "symbol", "left_semi").select("path").distinct()
    return hit.groupBy(dirname(F.col("path")).alias("folder")).agg(F.count("*").alias("n_files"), F.min("path").alias("sample"))


def target_list(lines: DataFrame) -> DataFrame:
    """Targets of a list (position, line): comments and blank lines dropped, the first of equal ones kept."""
    t = F.trim("line")
    return lines.select("position", t.alias("target")).where((F.col("target") != "") & ~F.col("target").startswith("#")).groupBy("target").agg(F.min("position").alias("position"))


def discovered(files: DataFrame) -> DataFrame:
    """The first library file of each kind (crypto, ssl) among files (path, ord)."""
    kind = F.when(F.lower(basename(F.col("path"))).startswith("libcrypto"), "crypto").when(F.lower(basename(F.col("path"))).startswith("libssl"), "ssl")
    return files.where(basename(F.col("path")).contains(".so")).select("path", "ord", kind.alias("kind")).where("kind is not null").groupBy("kind").agg(F.min_by("path", F.struct("ord", "path")).alias("path"))
