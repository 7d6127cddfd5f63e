"""Repositories: manifests with their includes, descriptions of purpose, and tags by place."""

from __future__ import annotations

import xml.etree.ElementTree as ET

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Files that describe a repository, in the order in which they are asked.
READMES = ["README.md", "README_zh.md", "README.en.md", "README_CN.md", "Readme.md", "readme.md"]
METADATA = ["package.json", "Cargo.toml", "bundle.json", "bundle.json5", "oh-package.json5", "module.json", "module.json5"]
# Tag and reason by beginnings of the path, first match first.
TAGS = [
    ("^third_party/", "第三方", "路径前缀 third_party/"),
    ("^(?:vendor|device)/", "厂商/芯片", "路径前缀 vendor/ 或 device/"),
    ("^productdefine/", "设备预装(产品相关)", "路径前缀 productdefine/"),
    ("^(?:kernel/|base/tee/tee_os_kernel$)", "内核/上游移植", "路径前缀 kernel/ 或精确路径 base/tee/tee_os_kernel"),
    ("^applications/sample(?:/|$)", "HM自研组件", "路径前缀 applications/sample/"),
    ("^applications/standard/(?:app_samples$|.*_wrapper$)", "HM自研组件", "applications/standard 下的 samples/wrapper 仓"),
    ("^applications/standard(?:/|$)", "HM预置应用", "路径前缀 applications/standard/ 且非 samples/wrapper"),
    ("^(?:arkcompiler|base|build|commonlibrary|developtools|docs|docs_cangjie|domains|drivers|foundation|ide|interface|napi_generator|test)/", "HM自研组件", "OpenHarmony 自有子系统路径前缀"),
]
OPEN_TAG = ("待人工确认", "未命中当前规则，需人工判定")


def tag_of(path: Column) -> Column:
    """Struct of tag and basis of a relative path; both empty for a path of one part."""
    pair = lambda tag, basis: F.struct(F.lit(tag).alias("tag"), F.lit(basis).alias("basis"))
    chain = F.when(path.isNull() | ~path.contains("/"), pair("", ""))
    for pattern, tag, basis in TAGS:
        chain = chain.when(path.rlike(pattern), pair(tag, basis))
    return chain.otherwise(pair(*OPEN_TAG))


def short(text: Column) -> Column:
    """Blanks collapsed, at most 300 characters."""
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, 300)


def first_paragraph(text: Column) -> Column:
    """First paragraph of the first 200 lines, without code blocks, headings, badges, tables and rules; null if there is none."""
    lines = F.transform(F.slice(F.split(text, r"\r\n|\r|\n"), 1, 200), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", "")))
    noise = lambda x: x.startswith("#") | x.startswith("![](") | x.startswith("[![") | (x.startswith("|") & x.endswith("|")) | x.rlike("^[-=]{3,}$")
    start = F.struct(F.lit("").alias("said"), F.lit(False).alias("code"), F.lit(False).alias("over"))

    def step(state: Column, x: Column) -> Column:
        fence = x.startswith("```")
        reading = ~state["over"] & ~state["code"] & ~fence
        said = F.when(reading & (x != "") & ~noise(x), F.concat(state["said"], F.lit(" "), x)).otherwise(state["said"])
        over = state["over"] | (reading & (x == "") & (state["said"] != ""))
        return F.struct(said.alias("said"), (state["code"] != (fence & ~state["over"])).alias("code"), over.alias("over"))

    return F.nullif(short(F.aggregate(lines, start, step)["said"]), F.lit(""))


def json_description(text: Column) -> Column:
    """description, summary or name of a JSON object, else its package's description; only where that is text."""
    parsed = F.try_parse_json(text)

    def at(path: str) -> Column:
        is_text = F.schema_of_variant(F.try_variant_get(parsed, path, "variant")) == "STRING"
        return F.nullif(short(F.when(is_text, F.try_variant_get(parsed, path, "string"))), F.lit(""))

    return F.coalesce(*[at(p) for p in ("$.description", "$.summary", "$.name", "$.package.description")])


def toml_description(text: Column) -> Column:
    return F.nullif(short(F.regexp_extract(text, r'(?m)^\s*description\s*=\s*"(.*)"\s*$', 1)), F.lit(""))


def json5_description(text: Column) -> Column:
    pattern = lambda key, quote: rf"{key}\s*:\s*{quote}([^{quote}]+){quote}"
    return F.coalesce(*[F.nullif(short(F.regexp_extract(text, pattern(key, q), 1)), F.lit("")) for q in "\"'" for key in ("description", "summary")])


def descriptions(files: DataFrame) -> DataFrame:
    """repo and purpose from files (repo, name, text): of its describing files the first in order that says something.

    Other files are dropped before any text is parsed; a repository without such a file has no row.
    """
    order = [*READMES, *METADATA]
    name, text = F.col("name"), F.col("text")
    said = F.when(name.isin(READMES), first_paragraph(text)).when(name.endswith(".json"), json_description(text)).when(name.endswith(".toml"), toml_description(text)).otherwise(json5_description(text))
    rank = F.array_position(F.array(*map(F.lit, order)), name)
    asked = files.where(name.isin(order)).select("repo", rank.alias("rank"), said.alias("said"))
    return asked.groupBy("repo").agg(F.coalesce(F.min_by("said", F.when(F.col("said").isNotNull(), F.col("rank"))), F.lit("")).alias("purpose"))


def manifest(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """path, repo_name and repo_url of a manifest and all that it includes; of a path's entries the last read counts.

    Included files inherit remotes and the default remote.  Manifests are configuration, read on the driver one by
    one through Spark's readers; a file that includes itself is not followed.
    """
    found: dict[str, tuple[str, str]] = {}
    waiting = [(name, {}, "", ())]
    while waiting:
        file, remotes, default, above = waiting.pop()
        if file in above:
            continue
        try:
            content = spark.read.format("binaryFile").load(f"{folder.rstrip('/')}/{file}").select("content").first()
        except Exception as e:
            if above and "PATH_NOT_FOUND" in str(e):
                continue
            raise
        node = ET.fromstring(bytes(content["content"]))
        remotes = remotes | {r.get("name"): r.get("fetch").rstrip("/") for r in node.findall("remote") if r.get("name") and r.get("fetch")}
        if (own := node.find("default")) is not None:
            default = own.get("remote", default)
        for p in node.findall("project"):
            if p.get("path") and p.get("name"):
                fetch = remotes.get(p.get("remote", default), "")
                found[p.get("path")] = (p.get("name"), f"{fetch}/{p.get('name')}" if fetch else "")
        waiting += [(i.get("name"), remotes, default, (*above, file)) for i in reversed(node.findall("include")) if i.get("name")]
    return spark.createDataFrame([(path, *row) for path, row in found.items()], "path string, repo_name string, repo_url string")
