"""Line-based inputs: process maps, symbol lists, headers, manifests, and earlier reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def mapped_libraries(lines: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Libraries of process maps (pid, position, line): path, whether deleted; the first line of a path counts.  by: what tells processes apart, pid unless given."""
    by = by or ["pid"]
    path = F.get(F.split(F.trim("line"), r"\s+", 6), 5)
    m = lines.select(*by, "position", path.alias("raw")).where(F.col("raw").startswith("/"))
    m = m.select(*by, "position", F.regexp_replace("raw", r" \(deleted\)$", "").alias("path"), F.col("raw").endswith(" (deleted)").alias("deleted"))
    m = m.where(F.element_at(F.split("path", "/"), -1).contains(".so"))
    return m.groupBy(*by, "path").agg(F.min_by("deleted", "position").alias("deleted"), F.min("position").alias("position"))


def symbol_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct names of a text file, comments and blank lines dropped."""
    name = F.trim(F.regexp_replace("value", "^﻿", ""))
    return spark.read.text(path).select(name.alias("symbol")).where((F.col("symbol") != "") & ~F.col("symbol").startswith("#")).distinct()


def manifest_projects(texts: DataFrame) -> DataFrame:
    """Projects of manifest files (text): path, name, remote, or the file's default remote."""
    attribute = lambda tag, name: F.regexp_extract(tag, rf'\b{name}="([^"]*)"', 1)
    default = attribute(F.regexp_extract("text", r"<default\b[^>]*>", 0), "remote")
    tags = texts.select(default.alias("default"), F.explode(F.regexp_extract_all("text", F.lit(r"<project\b[^>]*>"), F.lit(0))).alias("tag"))
    row = tags.select(attribute("tag", "name").alias("name"), attribute("tag", "path").alias("path"), attribute("tag", "remote").alias("remote"), "default")
    return row.select("name", F.when(F.col("path") == "", F.col("name")).otherwise(F.col("path")).alias("path"), F.when(F.col("remote") == "", F.col("default")).otherwise(F.col("remote")).alias("remote"))


CALLS = "array<struct<file_path:string,file_name:string,caller_function:string,line_number:int,column:int,ossl_symbol:string,category:string,call_args:string,language:string>>"
REPORT = f"meta struct<report_type:string,tool_version:string,target:string>, call_sites {CALLS}, projects array<struct<project:string,target:string,call_sites:{CALLS}>>"


def call_reports(spark: SparkSession, path: str) -> DataFrame:
    """Call sites of single and merged source reports: report, project, file, caller, symbol, line, args, category."""
    r = spark.read.schema(REPORT).option("multiLine", "true").option("mode", "PERMISSIVE").json(path).withColumn("report", F.input_file_name())
    r = r.where(F.col("meta.report_type").isin("source_scan", "combo_scan"))
    single = r.where("meta.report_type = 'source_scan'").select("report", F.lit("").alias("project"), F.explode("call_sites").alias("c"))
    merged = r.where("meta.report_type = 'combo_scan'").select("report", F.explode("projects").alias("p")).select("report", F.col("p.project").alias("project"), F.explode("p.call_sites").alias("c"))
    return single.unionByName(merged).select("report", "project", F.col("c.file_path").alias("file"), F.col("c.caller_function").alias("caller"), F.col("c.ossl_symbol").alias("symbol"), F.col("c.line_number").alias("line"), F.col("c.call_args").alias("args"), F.col("c.category").alias("category"))


SCANNED = "meta struct<report_type:string>, summary struct<total_files_scanned:long>, projects array<struct<project:string,total_files_scanned:long>>"


def files_scanned(spark: SparkSession, path: str) -> DataFrame:
    """One number, n_scanned: the files that single and merged source reports say were scanned, 0 where they do not say."""
    r = spark.read.schema(SCANNED).option("multiLine", "true").option("mode", "PERMISSIVE").json(path)
    merged = F.aggregate(F.coalesce("projects", F.array().cast("array<struct<project:string,total_files_scanned:long>>")), F.lit(0).cast("long"), lambda n, p: n + F.coalesce(p["total_files_scanned"], F.lit(0)))
    own = F.when(F.col("meta.report_type") == "combo_scan", merged).when(F.col("meta.report_type") == "source_scan", F.col("summary.total_files_scanned"))
    return r.agg(F.coalesce(F.sum(own), F.lit(0)).alias("n_scanned"))
