"""Summary tables over packages, repositories, compared projects and process trees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkscope.functions.text import basename, ratio
from linkscope.operators.diff import counted_status
from linkscope.operators.lineage import counted, cut

# Categories with a column of their own in package summaries.
SHOWN = ["ssl_core", "crypto_evp", "crypto_x509", "crypto_ec", "crypto_hash", "crypto_sm", "crypto_bio"]
# Order in which categories are shown; others come after them and `other` last.
DISPLAY = """ssl_core ssl_tls crypto_evp crypto_rsa crypto_dsa crypto_dh crypto_ec crypto_aes crypto_des crypto_chacha crypto_hash
crypto_hmac crypto_bn crypto_bio crypto_pem crypto_asn1 crypto_x509 crypto_x509_ext crypto_pkcs crypto_cms crypto_ocsp crypto_ts crypto_ct
crypto_rand crypto_err crypto_obj crypto_engine crypto_provider crypto_kdf crypto_sm crypto_conf crypto_ui crypto_srp crypto_async crypto_comp
crypto_smime crypto_legacy crypto_netscape crypto_dso openssl_util""".split()

# Libraries of the system.
SYSTEM = ["libc.so.6", "ld-linux-aarch64.so.1", "libm.so.6", "libpthread.so.0", "libdl.so.2", "librt.so.1"]


def package_rows(facts: DataFrame, shown: list[str] = SHOWN) -> DataFrame:
    """One row per package: distinct symbols by way of use, in all, by shown category and in the others, and the top category.

    facts: package, symbol, category, way (static, dynamic or dlopen).  A tie of categories goes to the larger name.
    """
    c = facts.groupBy("package", "category").agg(F.countDistinct("symbol").alias("n"))
    top = c.groupBy("package").agg(F.max(F.struct("n", "category"))["category"].alias("top_category"), *[F.coalesce(F.max(F.when(F.col("category") == s, F.col("n"))), F.lit(0)).alias(s) for s in shown], F.coalesce(F.sum(F.when(~F.col("category").isin(shown), F.col("n"))), F.lit(0)).alias("other_cats"))
    ways = facts.groupBy("package").agg(*[F.countDistinct(F.when(F.col("way") == w, F.col("symbol"))).alias(f"{w}_syms") for w in ("static", "dynamic", "dlopen")], F.countDistinct("symbol").alias("total_syms"))
    return ways.join(top, "package")


def package_total(rows: DataFrame, facts: DataFrame, shown: list[str] = SHOWN) -> DataFrame:
    """The row TOTAL: figures are sums over packages, the top category is that of the union; rows has usage too."""
    c = facts.groupBy("category").agg(F.countDistinct("symbol").alias("n")).agg(F.max(F.struct("n", "category"))["category"].alias("top_category"))
    usage = rows.where("usage <> ''").groupBy("usage").agg(F.count("*").alias("n")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("usage", "n"))), lambda x: F.concat(x["n"].cast("string"), F.lit(" "), x["usage"])), ", ").alias("usage"))
    sums = rows.agg(*[F.sum(x).alias(x) for x in ("static_syms", "dynamic_syms", "dlopen_syms", "total_syms", "other_cats", *shown)])
    return sums.crossJoin(usage).crossJoin(c).withColumn("package", F.lit("TOTAL"))


def repository_rows(calls: DataFrame, by: str = "project") -> DataFrame:
    """Coverage of each repository by symbols and by call sites, and its five worst blockers as text; calls: by, symbol, status."""
    status = F.when(F.col("status").isin("available", "partial", "not_available"), F.col("status")).otherwise("unknown")
    n = calls.select(by, "symbol", status.alias("status")).groupBy(by, "symbol", "status").agg(F.count("*").alias("n"))
    kinds = ("available", "partial", "not_available", "unknown")
    bad = F.col("status").isin("not_available", "unknown") & (F.col("symbol") != "")
    worst = n.where(bad).groupBy(by).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "symbol", "status"))), 1, 5).alias("w"))
    text = F.array_join(F.transform("w", lambda x: F.concat(x["symbol"], F.lit("["), x["status"], F.lit("]("), (-x["n"]).cast("string"), F.lit(")"))), ", ")
    sums = n.groupBy(by).agg(F.sum("n").alias("n_calls"), F.count("*").alias("n_symbols"), *[F.count_if(F.col("status") == k).alias(f"{k}_symbols") for k in kinds], *[F.coalesce(F.sum(F.when(F.col("status") == k, F.col("n"))), F.lit(0)).alias(f"{k}_calls") for k in kinds])
    both = lambda what: F.col(f"available_{what}") + F.col(f"partial_{what}")
    full = sums.join(worst, by, "left")
    return full.select(*sums.columns, *[f(what) for what in ("symbols", "calls") for f in (lambda w: ratio(F.col(f"available_{w}"), F.col(f"n_{w}")).alias(f"direct_{w}_pct"), lambda w: ratio(both(w), F.col(f"n_{w}")).alias(f"covered_{w}_pct"))], F.coalesce(text, F.lit("")).alias("top_blockers"))


def combined_symbols(deltas: DataFrame) -> DataFrame:
    """Symbol deltas of all projects (project, symbol, category, old_calls, new_calls) as one; the category is the last project's."""
    g = deltas.groupBy("symbol").agg(F.max_by("category", "project").alias("category"), F.sum("old_calls").alias("old_calls"), F.sum("new_calls").alias("new_calls"))
    return g.withColumn("status", counted_status("old_calls", "new_calls"))


def combined_categories(deltas: DataFrame) -> DataFrame:
    """Distinct symbols of each category before and after, over all projects."""
    side = lambda c: F.countDistinct(F.when(F.col(c) > 0, F.col("symbol")))
    return deltas.groupBy("category").agg(side("old_calls").alias("old_symbols"), side("new_calls").alias("new_symbols")).withColumn("delta", F.col("new_symbols") - F.col("old_symbols"))


def project_deltas(deltas: DataFrame) -> DataFrame:
    """Status of each project from its symbols' statuses, with calls before and after."""
    one = lambda s: F.bool_and(F.col("status") == s)
    status = F.when(F.col("added"), "added").when(F.col("removed"), "removed").when(F.col("unchanged"), "unchanged").otherwise("changed")
    g = deltas.groupBy("project").agg(F.sum("old_calls").alias("old_calls"), F.sum("new_calls").alias("new_calls"), F.count_if(F.col("old_calls") > 0).alias("old_symbols"), F.count_if(F.col("new_calls") > 0).alias("new_symbols"), *[one(s).alias(s) for s in ("added", "removed", "unchanged")])
    return g.select("project", "old_calls", "new_calls", "old_symbols", "new_symbols", status.alias("status"))


def category_bars(counts: DataFrame, width: int = 30) -> DataFrame:
    """Categories (category, n_symbols) with their place in the display and a bar in proportion to the greatest."""
    place = F.array_position(F.array(*map(F.lit, DISPLAY)), F.col("category")).cast("long")
    most = counts.agg(F.max("n_symbols").alias("most"))
    ordinal = F.when(F.col("category") == "other", len(DISPLAY) + 2).when(place == 0, len(DISPLAY) + 1).otherwise(place)
    return counts.crossJoin(F.broadcast(most)).select("category", "n_symbols", ordinal.cast("long").alias("place"), F.repeat(F.lit("#"), F.floor(F.col("n_symbols") / F.col("most") * width).cast("int")).alias("bar"))


#: A level is held against all found before if these are at most so many times its rows; what is met again at a smaller level goes on, and is dropped at the end.
AGAIN = 4


def descendants(edges: DataFrame, roots: DataFrame, depth: int = 20) -> DataFrame:
    """root, node and least depth of all that is below each root (src of roots), level by level, each level checkpointed."""
    step = edges.select(F.col("src").alias("node"), "dst").distinct()
    front = cut(roots.select(F.col("node").alias("root"), "node").distinct())
    levels, n_front = [front], counted(front)
    n_found = n_front
    for i in range(1, depth + 1):
        near = front.join(step, "node").select("root", F.col("dst").alias("node")).distinct()
        if n_found <= AGAIN * n_front:
            for level in levels:
                near = near.join(level, ["root", "node"], "left_anti")
        front = cut(near)
        if (n_front := counted(front)) == 0:
            break
        levels.append(front)
        n_found += n_front
        if i == 1:
            # from here on only nodes that some edge leads to are met
            step = cut(step.join(step.select(F.col("dst").alias("node")).distinct(), "node", "left_semi"))
    found = [level.withColumn("depth", F.lit(i).cast("long")) for i, level in enumerate(levels)]
    return reduce(DataFrame.unionByName, found).groupBy("root", "node").agg(F.min("depth").alias("depth"))


def ranked_groups(edges: DataFrame, roots: DataFrame, counts: DataFrame, depth: int = 20) -> DataFrame:
    """Each executable with its own symbols, its direct libraries and the symbols of all that it pulls in; counts: node, n_symbols."""
    below = descendants(edges, roots, depth).join(counts, "node", "left").withColumn("n", F.coalesce("n_symbols", F.lit(0)))
    at = lambda i: F.col("depth") == i
    return below.groupBy("root").agg(F.sum(F.when(at(0), F.col("n")).otherwise(0)).alias("own_symbols"), F.count_if(at(1)).alias("n_libraries"), F.count_if((F.col("depth") > 1) & (F.col("n") > 0)).alias("n_deep"), F.sum("n").alias("group_total"))


def tier(name: Column, is_root: Column, is_target: Column, n_symbols: Column) -> Column:
    """Place of a node in the global graph."""
    return F.when(is_root, "application").when(is_target, "crypto").when(n_symbols > 0, "middleware").when(name.isin(SYSTEM), "system").otherwise("normal")


def merged_graph(edges: DataFrame) -> DataFrame:
    """Edges of all processes (process, src, dst as paths) merged by file names: src, dst, number of processes."""
    return edges.select("process", basename(F.col("src")).alias("src"), basename(F.col("dst")).alias("dst")).groupBy("src", "dst").agg(F.countDistinct("process").alias("n_processes"))


def symbol_components(facts: DataFrame) -> DataFrame:
    """Components that use each symbol, as text in order, and their number; facts: component, symbol."""
    each = facts.select("symbol", F.col("component").cast("string").alias("component")).distinct()
    return each.groupBy("symbol").agg(F.count("*").alias("n_components"), F.array_join(F.array_sort(F.collect_list("component")), ",").alias("components"))


def shared_libraries(edges: DataFrame) -> DataFrame:
    """Libraries that several processes load: edges of processes (process, src, dst); dst and the number of processes."""
    return edges.select("process", basename(F.col("dst")).alias("library")).distinct().groupBy("library").agg(F.count("*").alias("n_processes")).where("n_processes > 1")


def shared_graph(edges: DataFrame) -> DataFrame:
    """Merged edges between nodes that more than one process has."""
    named = edges.select("process", basename(F.col("src")).alias("src"), basename(F.col("dst")).alias("dst"))
    both = named.select("process", F.col("src").alias("node")).union(named.select("process", "dst")).distinct().groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node")
    kept = named.select("src", "dst").distinct().join(both.withColumnRenamed("node", "src"), "src", "left_semi")
    return kept.join(both.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")


def chain_graph(edges: DataFrame, chain_edges: DataFrame) -> DataFrame:
    """The edges whose ends both lie on any chain."""
    node = chain_edges.select(F.col("src").alias("node")).union(chain_edges.select("dst")).distinct()
    return edges.select("src", "dst").distinct().join(node.withColumnRenamed("node", "src"), "src", "left_semi").join(node.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")


def error_rows(errors: DataFrame) -> DataFrame:
    """Errors with their severity in capitals, `WARNING` without one."""
    return errors.withColumn("severity", F.upper(F.coalesce("severity", F.lit("warning"))))


def first_errors(errors: DataFrame, n: int = 10) -> DataFrame:
    """The first n errors in order of file and message, and a row that counts the rest, if there are more."""
    first = errors.select("file", "message").orderBy("file", "message").limit(n)
    more = errors.agg((F.count("*") - n).alias("rest")).where("rest > 0").select(F.lit("").alias("file"), F.format_string("... and %d more", "rest").alias("message"))
    return first.unionByName(more)


def manifest_rows(projects: DataFrame, manifest: DataFrame) -> DataFrame:
    """Projects (path) with name and address of the manifest's entry of that path; empty without one."""
    known = manifest.groupBy("path").agg(F.max("name").alias("name"), F.max("url").alias("url"))
    return projects.join(known, "path", "left").withColumns({"name": F.coalesce("name", F.lit("")), "url": F.coalesce("url", F.lit(""))})


def used_repositories(rows: DataFrame) -> DataFrame:
    """Repositories with any use, most symbols first, then most calls, then by name, with their place."""
    order = Window.orderBy(F.desc("n_symbols"), F.desc("n_calls"), "project")
    return rows.where("n_calls > 0").withColumn("place", F.row_number().over(order).cast("long"))


def searched_symbols(counts: DataFrame, part: str = "", category: str = "", n: int = 500) -> DataFrame:
    """The first n symbols whose name holds a part, upper and lower case alike, and whose category fits."""
    hit = F.lower("symbol").contains(part.lower())
    return counts.where(hit & (F.lit(category == "") | (F.col("category") == category))).orderBy("symbol").limit(n)


def category_total(counts: DataFrame) -> DataFrame:
    """Categories with their symbols and share, and a row TOTAL of the sum."""
    whole = Window.partitionBy()
    share = F.format_string("%.1f%%", F.col("n_symbols") / F.sum("n_symbols").over(whole) * 100)
    total = counts.agg(F.sum("n_symbols").alias("n_symbols")).select(F.lit("TOTAL").alias("category"), "n_symbols", F.lit("100.0%").alias("share"))
    return counts.select("category", "n_symbols", share.alias("share")).unionByName(total)
