"""Roll-ups of symbol usage: semi-joins with the symbol dimension, summaries, coverage, components, rankings.

Distinct counts are exact, as everywhere here.  Dimensions are joined without a forced broadcast; adaptive
execution broadcasts a side whose measured size allows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkscope.functions.text import percent_label, ratio
from linkscope.operators.parts import dealt


def known(facts: DataFrame, dimension: DataFrame, on: str = "symbol") -> DataFrame:
    """Facts whose symbol is in the dimension."""
    return facts.join(dimension.select(on).distinct(), on, "left_semi")


def without_local(calls: DataFrame, local: DataFrame) -> DataFrame:
    """Calls but those of a function that the same file defines."""
    own = dealt(local.select("file", "symbol"), "file", "symbol").distinct()
    return dealt(calls, "file", "symbol").join(own, ["file", "symbol"], "left_anti")


def by_category(facts: DataFrame) -> DataFrame:
    return facts.groupBy("category").agg(F.countDistinct("symbol").alias("n_symbols"), F.count("*").alias("n_references"))


def symbol_summary(calls: DataFrame, file: str = "file") -> DataFrame:
    """Calls, files and the smallest category of each symbol."""
    return calls.groupBy("symbol").agg(F.min("category").alias("category"), F.count("*").alias("n_calls"), F.countDistinct(file).alias("n_files"))


def merged_symbol_summary(calls: DataFrame) -> DataFrame:
    """The same over several projects, which are counted and listed."""
    return calls.groupBy("symbol").agg(
        F.min("category").alias("category"),
        F.count("*").alias("n_calls"),
        F.countDistinct("file").alias("n_files"),
        F.countDistinct("project").alias("n_projects"),
        F.array_join(F.array_sort(F.transform(F.collect_set("project"), lambda x: x.cast("string"))), ",").alias("projects"),
    )


def top_category(facts: DataFrame, by: str, order: list[str] | None = None) -> DataFrame:
    """For each group the category of most distinct symbols; ties go to the category whose first row in the order comes first.

    Without an order ties go to the smaller name.
    """
    first = F.min(F.struct(*order)) if order else F.lit(0)
    n = facts.groupBy(by, "category", "symbol").agg(first.alias("o")).groupBy(by, "category").agg(F.count("symbol").alias("n"), F.min("o").alias("o"))
    return n.groupBy(by).agg(F.min(F.struct((-F.col("n")).alias("n"), "o", "category")).alias("m")).select(by, F.col("m.category").alias("top_category"), (-F.col("m.n")).alias("top_count"))


def project_stats(calls: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Calls, distinct symbols and files, and the top category of each project; symbols and files are counted over distinct pairs."""
    n = calls.groupBy("project", "symbol").agg(F.count("*").alias("n")).groupBy("project").agg(F.sum("n").alias("n_calls"), F.count("symbol").alias("n_symbols"))
    files = calls.select("project", "file").distinct().groupBy("project").agg(F.count("file").alias("n_files"))
    return n.join(files, "project").join(top_category(calls, "project", order), "project")


def with_total(calls: DataFrame) -> DataFrame:
    """Project statistics with a TOTAL row, whose distinct counts are over everything, not sums."""
    cols = [F.count("*").alias("n_calls"), F.countDistinct("symbol").alias("n_symbols"), F.countDistinct("file").alias("n_files")]
    each = calls.groupBy(F.col("project").cast("string").alias("project")).agg(*cols)
    return each.unionByName(calls.agg(*cols).withColumn("project", F.lit("TOTAL")))


def compat_status(symbols: DataFrame, mapping: DataFrame) -> DataFrame:
    """Each symbol with its status, `unknown` if the mapping lacks it."""
    return symbols.join(mapping.select("symbol", F.col("status").alias("known")), "symbol", "left").withColumn("status", F.coalesce("known", F.lit("unknown"))).drop("known")


def coverage(symbols: DataFrame) -> DataFrame:
    """Counts by status in one row, and the share available and that with partial ones."""
    one = lambda s: F.count_if(F.col("status") == s).alias(f"n_{s}")
    n = symbols.agg(F.count("*").alias("n_total"), one("available"), one("partial"), one("not_available"), one("unknown"))
    return n.withColumn("available_pct", ratio(F.col("n_available"), F.col("n_total"))).withColumn("covered_pct", ratio(F.col("n_available") + F.col("n_partial"), F.col("n_total")))


def blockers(calls: DataFrame, by: str = "project") -> DataFrame:
    """Symbols that are not available or not known, with their calls and files."""
    return calls.where(F.col("status").isin("not_available", "unknown") & (F.col("symbol") != "")).groupBy(by, "symbol", "status").agg(F.count("*").alias("n_calls"), F.countDistinct("file").alias("n_files"), F.countDistinct("category").alias("n_categories"))


def top_blockers(found: DataFrame, by: str = "project", n: int = 5) -> DataFrame:
    """The n worst of each group, ranked, ties by name."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n_calls"), "symbol", "status"))
    return found.withColumn("rank", rank.cast("long")).where(F.col("rank") <= n)


def component_stats(facts: DataFrame) -> DataFrame:
    """Distinct symbols, executables and categories of each component, each counted over its own distinct pairs.

    The facts are reduced to distinct (component, executable, category, symbol) first, which one partial aggregate does.
    """
    once = dealt(facts.select("component", "executable", "category", "symbol"), "component", "executable", "category", "symbol").distinct()
    ids = [F.count(F.when(F.col("what") == i, F.lit(1))).alias(n) for i, n in enumerate(("n_symbols", "n_executables", "n_categories"))]
    values = F.array(*[F.struct(F.lit(i).alias("what"), F.col(c).cast("string").alias("value")) for i, c in enumerate(("symbol", "executable", "category"))])
    each = once.select("component", F.explode(values).alias("v")).select("component", "v.*").where("value is not null").distinct()
    return once.select("component").distinct().join(each.groupBy("component").agg(*ids), "component", "left").select("component", *[F.coalesce(n, F.lit(0)).alias(n) for n in ("n_symbols", "n_executables", "n_categories")])


def assigned(facts: DataFrame, mapping: DataFrame) -> DataFrame:
    """Facts with the component of their executable, `unclassified` without one; the last entry of a mapping counts."""
    last = mapping.groupBy("executable").agg(F.max_by("component", "ord").alias("found"))
    return dealt(facts, "executable").join(last, "executable", "left").withColumn("component", F.coalesce("found", F.lit("unclassified"))).drop("found")


def ranking(stats: DataFrame, n: int | None = None) -> DataFrame:
    """Components by symbols, ties by name, with rank and the share of all. The components are few: a dimension's rows."""
    order, whole = Window.orderBy(F.desc("n_symbols"), "component"), Window.partitionBy()
    out = stats.withColumn("rank", F.row_number().over(order).cast("long")).withColumn("share", ratio(F.col("n_symbols"), F.sum("n_symbols").over(whole)))
    return out if n is None else out.where(F.col("rank") <= n)


def category_share(facts: DataFrame) -> DataFrame:
    """Distinct symbols of each category, with a label of their share of the sum."""
    n = facts.groupBy("category").agg(F.countDistinct("symbol").alias("n_symbols"))
    return n.crossJoin(n.agg(F.sum("n_symbols").alias("s"))).select("category", "n_symbols", percent_label(F.col("n_symbols") / F.col("s") * 100).alias("share"))


def scan_totals(facts: DataFrame) -> DataFrame:
    """Files, those with symbols, references and distinct symbols."""
    return facts.agg(F.countDistinct("file").alias("n_files"), F.countDistinct(F.when(F.col("symbol").isNotNull(), F.col("file"))).alias("n_with_symbols"), F.count("symbol").alias("n_references"), F.countDistinct("symbol").alias("n_symbols"))


def most_common(facts: DataFrame, n: int = 10) -> DataFrame:
    """The n symbols of most files, ties by name."""
    return facts.groupBy("symbol").agg(F.countDistinct("file").alias("n_files")).orderBy(F.desc("n_files"), "symbol").limit(n)


def drill_down(facts: DataFrame) -> DataFrame:
    """Component, executable and category with their distinct symbols, and the executable's total beside.

    Both counts come from one distinct table: a symbol that an executable has in several categories counts once in its total.
    """
    key = ["component", "executable"]
    once = facts.select(*key, "category", "symbol").distinct()
    first = F.row_number().over(Window.partitionBy(*key, "symbol").orderBy("category"))
    n = once.withColumn("first", ((first == 1) & F.col("symbol").isNotNull()).cast("long")).groupBy(*key, "category").agg(F.count("symbol").alias("n_symbols"), F.sum("first").alias("n_first"))
    return n.withColumn("n_total", F.sum("n_first").over(Window.partitionBy(*key))).drop("n_first")


def first_of(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def fallback_counts(calls: DataFrame) -> DataFrame:
    """Call sites that were recovered from text, and the files that hold them; calls: file, confidence."""
    fallback = F.col("confidence") == "fallback"
    return calls.agg(F.count_if(fallback).alias("n_fallback_calls"), F.countDistinct(F.when(fallback, F.col("file"))).alias("n_fallback_files"))


def symbol_dimension(*parts: DataFrame) -> DataFrame:
    """One dimension from several lists of symbols (symbol, origin): each name once, with the first of its origins by name."""
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.where("symbol is not null and symbol <> ''").groupBy("symbol").agg(F.min("origin").alias("origin"))


def excluded(projects: DataFrame, patterns: list[str], path: str = "project") -> DataFrame:
    """Projects but those whose path holds one of the patterns."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.col(path).contains(p)
    return projects.where(~F.coalesce(hit, F.lit(False)))


def summary_with_files(calls: DataFrame, file: str = "file") -> DataFrame:
    """symbol_summary() with the list of files as text, in order of category and symbol when sorted by them."""
    each = calls.groupBy("symbol", file).agg(F.min("category").alias("category"), F.count("*").alias("n"))
    names = F.array_join(F.array_sort(F.collect_list(F.col(file).cast("string"))), ";")
    return each.groupBy("symbol").agg(F.min("category").alias("category"), F.sum("n").alias("n_calls"), F.count(file).alias("n_files"), names.alias("files"))
