"""Tables that users supply or earlier runs wrote: mappings, patterns, package reports, and spreadsheets of call sites."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Title of the sheets and of their columns, with the names they get here.
SHEET = "OpenSSL Call Sites"
COLUMNS = {"file_path": "File Path", "file_name": "File Name", "caller": "Caller Function", "line": "Line", "symbol": "OpenSSL Symbol", "category": "Category", "args": "Call Arguments"}


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE").json(path)


def component_mapping(spark: SparkSession, path: str) -> DataFrame:
    """executable (file name) and component of a mapping file; of equal names the last in the file counts."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    each = whole.select(F.posexplode(F.map_entries("m")).alias("i", "e")).select("i", F.col("e.key").alias("component"), F.posexplode("e.value").alias("j", "x"))
    return each.groupBy(F.element_at(F.split("x", "/"), -1).alias("executable")).agg(F.max_by("component", F.struct("i", "j")).alias("component"))


def compatibility(spark: SparkSession, path: str) -> DataFrame:
    """symbol and status of a compatibility file; a file without the object `mapping` is an error."""
    m = _json(spark, path, "mapping map<string,struct<status:string>>").select("mapping")
    if m.where("mapping is not null").isEmpty():
        raise ValueError(f"no object 'mapping' in {path}")
    return m.select(F.explode("mapping").alias("symbol", "v")).select("symbol", F.coalesce("v.status", F.lit("unknown")).alias("status"))


def pattern_groups(spark: SparkSession, path: str) -> DataFrame:
    """group and pattern of a pattern file; a group that is no list gives no rows, an unreadable file none at all."""
    groups = _json(spark, path, "groups map<string,string>").select(F.explode("groups").alias("group", "v"))
    return groups.select("group", F.explode(F.from_json("v", "array<string>")).alias("pattern")).where("pattern is not null").distinct()


def package_reports(spark: SparkSession, path: str) -> DataFrame:
    """Files of earlier single scans (folder of JSON): report, scan_root, path, symbols; files without tool version or of another kind are left out."""
    schema = "meta struct<tool_version:string,report_type:string,scan_root:string>, openssl_symbols struct<by_file:map<string,struct<count:int,symbols:array<string>>>>"
    r = _json(spark, path, schema).withColumn("report", F.input_file_name())
    valid = r.where(F.col("meta.tool_version").isNotNull() & (F.coalesce("meta.report_type", F.lit("single")) == "single"))
    return valid.select("report", F.col("meta.scan_root").alias("scan_root"), F.explode("openssl_symbols.by_file").alias("path", "v")).select("report", "scan_root", "path", F.coalesce("v.symbols", F.array().cast("array<string>")).alias("symbols"))


def _plain(node: ET.Element) -> ET.Element:
    for x in node.iter():
        x.tag = x.tag.rsplit("}", 1)[-1]
    return node


def sheets(content: bytes):
    """(title, rows) of a workbook; a row is the list of its cells, empty ones None."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter("t")) for si in _plain(ET.fromstring(z.read("xl/sharedStrings.xml"))).iter("si")]
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in _plain(ET.fromstring(z.read("xl/workbook.xml"))).iter("sheet"):
            target = targets[next(v for k, v in sheet.attrib.items() if k.endswith("}id"))]
            rows = []
            for row in _plain(ET.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}"))).iter("row"):
                cells: list[str | None] = []
                for c in row.iter("c"):
                    if letters := re.match("[A-Z]+", c.get("r", "")):
                        at = 0
                        for letter in letters[0]:
                            at = at * 26 + ord(letter) - 64
                        cells += [None] * (at - 1 - len(cells))
                    value, inline = c.find("v"), "".join(t.text or "" for t in c.iter("t"))
                    text = inline if c.get("t") == "inlineStr" else None if value is None else shared[int(value.text)] if c.get("t") == "s" else value.text
                    cells.append(text)
                rows.append(cells)
            yield sheet.get("name"), rows


def spreadsheet_calls(contents: DataFrame) -> DataFrame:
    """Call sites of workbooks (path, content): columns are found by title, blank rows dropped, continued sheets read too."""
    schema = "project string, " + ", ".join(f"{c} string" for c in COLUMNS)

    def run(frames):
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                project = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                for title, found in sheets(bytes(content)):
                    if found and (title == SHEET or title.startswith(SHEET + " (")):
                        at = [found[0].index(t) if t in found[0] else None for t in COLUMNS.values()]
                        rows += [(project, *[r[i] if i is not None and i < len(r) else "" for i in at]) for r in found[1:] if any(v is not None for v in r)]
            yield pd.DataFrame(rows, columns=["project", *COLUMNS])

    return contents.select("path", "content").mapInPandas(run, schema).withColumn("line", F.expr("try_cast(line as int)"))


def package_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of earlier package reports, one row each, with the columns that the rules for packages ask for.

    Reports of another kind and unreadable files give no rows; what a report lacks has its default.
    """
    loading = "dlopen_detection struct<uses_dlopen:boolean,dlopen_symbols:array<string>,dlopen_libs:array<string>,confidence:string>"
    file = f"struct<path:string,type:string,arch:string,direct_deps:array<string>,openssl_deps:struct<direct:boolean,transitive:boolean,libs:array<string>>,openssl_symbols_used:array<string>,static_openssl:boolean,static_ssl_library:string,static_openssl_confidence:string,static_openssl_confidence_reason:string,{loading.replace(' struct', ':struct', 1)},fingerprint_detail:struct<score:double>>"
    package = "struct<package_path:string,bundle_name:string,version_name:string,version_code:int,bundled_openssl:string,bundled_openssl_files:array<string>>"
    r = _json(spark, path, f"meta struct<report_type:string,package:{package}>, files_detail array<{file}>").withColumn("report", F.input_file_name())
    r = r.where(F.col("meta.report_type") == "package").select("report", "meta.package.*", F.explode_outer("files_detail").alias("f"))
    none, p = F.array().cast("array<string>"), F.coalesce("package_path", "report")
    release = F.concat_ws("/", F.coalesce("bundle_name", p), F.coalesce(F.col("version_code").cast("string"), p), F.coalesce("version_name", F.lit("")))
    return r.select(
        "report", p.alias("package"), release.alias("release"), F.coalesce("bundled_openssl", F.lit("false")).alias("bundled"), F.coalesce("bundled_openssl_files", none).alias("bundled_files"),
        F.coalesce("f.path", F.lit("")).alias("path"), F.coalesce("f.openssl_symbols_used", none).alias("symbols"), F.coalesce("f.dlopen_detection.dlopen_symbols", none).alias("dlsym"),
        F.coalesce("f.static_openssl", F.lit(False)).alias("is_static"), F.coalesce("f.static_openssl_confidence", F.lit("")).alias("confidence"), F.coalesce("f.static_openssl_confidence_reason", F.lit("")).alias("reason"),
        F.coalesce("f.dlopen_detection.uses_dlopen", F.lit(False)).alias("uses_dlopen"), F.coalesce("f.dlopen_detection.dlopen_libs", none).alias("dlopen_libs"), F.coalesce("f.openssl_deps.libs", none).alias("libs"),
        F.coalesce("f.direct_deps", none).alias("deps"), F.col("f.fingerprint_detail.score").alias("score"),
    )


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """Marks of a fingerprint file: category, string, per_point, max_points, mode, library; an unreadable file gives none."""
    one = "struct<per_point:double,max_points:double,strings:array<string>,match_mode:string,library:string>"
    r = _json(spark, path, f"categories map<string,{one}>").select(F.explode("categories").alias("category", "v"))
    return r.select("category", F.explode("v.strings").alias("string"), F.coalesce("v.per_point", F.lit(0.0)).alias("per_point"), F.coalesce("v.max_points", F.lit(0.0)).alias("max_points"), F.coalesce("v.match_mode", F.lit("exact")).alias("mode"), "v.library")


def symbol_json(spark: SparkSession, path: str, key: str = "symbols") -> DataFrame:
    """symbol and origin of a file that lists names under a key (symbols or macros)."""
    return _json(spark, path, f"{key} array<string>").select(F.explode(key).alias("symbol"), F.lit(key).alias("origin")).distinct()
