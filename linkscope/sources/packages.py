"""Application packages (zip files, nested too) as facts, read in memory on the executors."""

from __future__ import annotations

import io
import json
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkscope.sources.files import decoded

# File name endings of packages, the depth of nesting that is followed, and the largest member.
NESTED, DEPTH, LARGEST = (".hap", ".har", ".hsp", ".zip", ".app"), 20, 20 << 30
# Order of the binary interfaces, and the machine of each.
ORDER = ["arm64-v8a", "armeabi-v7a", "armeabi", "x86_64", "x86"]
MACHINES = {"arm64-v8a": 0xB7, "armeabi-v7a": 0x28, "armeabi": 0x28, "x86_64": 0x3E, "x86": 0x03}
ENTRIES = "package string, container string, depth int, entry string, size long, content binary"


def entries(data: bytes, package: str, container: str | None = None, depth: int = 0):
    """(package, container, depth, entry, size, content) of libraries and module files, through nested packages."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile:
        return
    for info in archive.infolist():
        name = info.filename
        if info.is_dir() or name.startswith("__MACOSX") or ".." in name.split("/"):
            continue
        if info.file_size > LARGEST:
            raise ValueError(f"{package}!{name}: {info.file_size} bytes are more than a member may have")
        if name.lower().endswith(NESTED):
            if depth < DEPTH:
                yield from entries(archive.read(info), f"{package}!{name}", package, depth + 1)
        elif name.startswith("libs/") or name.rsplit("/", 1)[-1] == "module.json":
            yield package, container, depth, name, info.file_size, archive.read(info)


def expand(contents: DataFrame) -> DataFrame:
    """Members of all packages of a table of path and content."""

    def run(frames):
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                if rows := list(entries(bytes(content), path)):
                    yield pd.DataFrame(rows, columns=[c.split()[0] for c in ENTRIES.split(", ")])

    return contents.select("path", "content").mapInPandas(run, ENTRIES)


def native_libraries(members: DataFrame) -> DataFrame:
    """Members below libs/<abi>/ that are ELF files: package, abi, library, content."""
    parts = F.split("entry", "/")
    found = members.where(F.col("entry").like("libs/%/%") & (F.substring("content", 1, 4) == F.lit(b"\x7fELF"))).select("package", F.get(parts, 1).alias("abi"), F.element_at(parts, -1).alias("library"), "content")
    # the machine is two bytes at 18, in the order that byte 5 names
    byte = lambda i: F.conv(F.hex(F.substring("content", i + 1, 1)), 16, 10).cast("int")
    machine = F.when(byte(5) == 2, byte(18) * 256 + byte(19)).otherwise(byte(19) * 256 + byte(18))
    expected = F.element_at(F.create_map(*[F.lit(x) for pair in MACHINES.items() for x in pair]), F.col("abi"))
    return found.withColumn("fits", F.coalesce(machine == expected, expected.isNull()))


def interfaces(libraries: DataFrame) -> DataFrame:
    """Binary interfaces of each package, the usual ones first in their order, then others by name: package, abi, place."""
    known = F.array_position(F.array(*map(F.lit, ORDER)), F.col("abi"))
    order = Window.partitionBy("package").orderBy(F.when(known == 0, len(ORDER) + 1).otherwise(known), "abi")
    return libraries.select("package", "abi").distinct().withColumn("place", F.row_number().over(order).cast("long"))


def of_interface(libraries: DataFrame, abi: str) -> DataFrame:
    """Libraries of one binary interface; it is an error if no package has it."""
    found = libraries.where(F.col("abi") == abi)
    if found.isEmpty():
        raise ValueError(f"no library for {abi}")
    return found


def distinct_names(libraries: DataFrame) -> DataFrame:
    """libraries with a name of its own inside the package for each: the second of a name ends in `_2` and so on."""
    order = Window.partitionBy("package", "library").orderBy("abi")
    stem, ending = F.regexp_replace("library", r"\.[^.]*$", ""), F.regexp_extract("library", r"\.[^.]*$", 0)
    n = F.row_number().over(order)
    return libraries.withColumn("name", F.when(n == 1, F.col("library")).otherwise(F.concat(stem, F.lit("_"), n.cast("string"), ending)))


def metadata(members: DataFrame) -> DataFrame:
    """Package names and versions from module files; what is missing or malformed has its default."""
    schema = "app struct<bundleName:string,versionName:string,versionCode:int>, module struct<name:string,type:string,deviceTypes:array<string>>"
    m = members.where(F.col("entry").endswith("module.json")).withColumn("j", F.from_json(decoded(F.col("content")), schema))
    none = F.lit(json.dumps([]))
    return m.select("package", F.coalesce("j.app.bundleName", F.lit("")).alias("bundle"), F.coalesce("j.app.versionName", F.lit("0.0.0")).alias("version"), F.coalesce("j.app.versionCode", F.lit(0)).alias("version_code"), F.coalesce("j.module.name", F.lit("")).alias("module"), F.coalesce("j.module.deviceTypes", F.from_json(none, "array<string>")).alias("devices"))
