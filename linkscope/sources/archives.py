"""Application packages read member by member: tasks list the directories of the archives by seeks, then read single members.

No package is ever a cell or in memory as a whole, so one may be larger than a cell can be, and the members of one package
are read by many tasks.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkscope.functions.categories import LIBRARY_PREFIXES
from linkscope.functions.text import is_library
from linkscope.operators.lineage import cut
from linkscope.sources.packages import DEPTH, LARGEST, ORDER

# Endings of packages, and which packages inside a package of an ending are followed.
ENDINGS = [".hap", ".har", ".hsp", ".app", ".zip"]
FOLLOWED = {".app": (".hap", ".hsp"), ".zip": (".hap", ".har", ".hsp", ".zip")}
#: Most bytes of a cell, bytes that a task reads, bytes that are fetched at once, and rows of a batch.
CELL, SHARE, FETCH, ROWS = (1 << 31) - (1 << 20), 64 << 20, 1 << 20, 1024
LISTED = "outer string, package string, container string, depth int, chain array<int>, place int, entry string, size long, error string"
READ = LISTED + ", content binary"
ENTRY = pa.schema([("outer", pa.string()), ("package", pa.string()), ("container", pa.string()), ("depth", pa.int32()), ("chain", pa.list_(pa.int32())), ("place", pa.int32()), ("entry", pa.string()), ("size", pa.int64()), ("error", pa.string())])
BROKEN = (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError)


def opened(path: str) -> io.BufferedReader:
    """A file of any file system for reading at any place; characters of the path count as they are."""
    far = re.match(r"([a-z0-9]+)://([^/]+)(/.*)", path)
    if far and far[1] != "file":
        files, base = pyarrow.fs.FileSystem.from_uri(f"{far[1]}://{far[2]}/")
        return io.BufferedReader(files.open_input_file(base.rstrip("/") + far[3]), FETCH)
    return open(re.sub("^file:/*", "/", path), "rb", buffering=FETCH)  # noqa: SIM115  (the caller closes it)


class Archives:
    """The archive that was asked for last stays open, with those around it."""

    def __init__(self) -> None:
        self.key, self.held = None, []

    def of(self, outer: str, chain: list[int]) -> zipfile.ZipFile:
        """The package inside outer that is reached by the places of packages in each other's directories."""
        if self.key != (outer, tuple(chain)):
            self.close()
            self.held.append(opened(outer))
            self.held.append(zipfile.ZipFile(self.held[-1]))
            for place in chain:
                self.held.append(self.held[-1].open(self.held[-1].infolist()[place]))
                self.held.append(zipfile.ZipFile(self.held[-1]))
            self.key = outer, tuple(chain)
        return self.held[-1]

    def close(self) -> None:
        for x in reversed(self.held):
            x.close()
        self.key, self.held = None, []


def ending(name: str) -> str:
    return name[name.rfind(".") :].lower() if "." in name.rsplit("/", 1)[-1] else ""


def directory(archives: Archives, outer: str, package: str, container: str | None = None, chain: tuple[int, ...] = ()) -> Iterator[tuple]:
    """Rows of the libraries and module files of a package and, by the rules of its ending, of those inside it.

    Of an .app only the packages inside have libraries.  What cannot be read is a row with an error and no entry.
    """
    kind = ending(package)
    try:
        members = list(enumerate(archives.of(outer, list(chain)).infolist()))
    except BROKEN as e:
        archives.close()
        yield outer, package, container, len(chain), list(chain), None, None, None, f"{type(e).__name__}: {e}"
        return
    inside = []
    for place, info in members:
        name = info.filename
        if info.is_dir() or name.startswith("__MACOSX") or ".." in name.split("/"):
            continue
        nested = ending(name) in FOLLOWED.get(kind, ()) and len(chain) < DEPTH
        module = name.rsplit("/", 1)[-1] == "module.json"
        if not nested and not module and (kind == ".app" or not name.startswith("libs/")):
            continue
        if info.file_size > LARGEST:
            raise ValueError(f"{package}!{name}: {info.file_size} bytes are more than a member may have")
        if nested:
            inside.append((place, name))
        else:
            yield outer, package, container, len(chain), list(chain), place, name, info.file_size, None
    for place, name in inside:
        yield from directory(archives, outer, f"{package}!{name}", package, (*chain, place))


def found(spark: SparkSession, path: str) -> DataFrame:
    """Packages below a folder, or the one at a path, by the endings of names: path, length; their contents are not read, and empty files are not seen.

    It is an error if a path that is a file has no ending of a package.
    """
    every = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    if "." in path.rsplit("/", 1)[-1] and ending(path) not in ENDINGS and not every.where(F.regexp_replace("path", "^file:/*", "/") == re.sub("^file:/*", "/", path)).isEmpty():
        raise ValueError(f"{path}: expected one of {', '.join(ENDINGS)}")
    return every.where(F.lower(F.regexp_extract("path", r"\.[^./]*$", 0)).isin(ENDINGS))


def listed(packages: DataFrame) -> DataFrame:
    """Directories of packages (path), one row for each library or module file."""
    tasks = packages.sparkSession.sparkContext.defaultParallelism

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archives = Archives()
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = directory(archives, path, path)
                while some := list(islice(rows, ROWS)):
                    yield pa.RecordBatch.from_pylist([dict(zip(ENTRY.names, r, strict=True)) for r in some], schema=ENTRY)
                archives.close()

    return packages.select("path").repartition(tasks, "path").mapInArrow(run, LISTED)


def read(entries: DataFrame) -> DataFrame:
    """Contents of listed members, each read by itself: entries with content.

    A member below libs/ that is no ELF file is not read and its content is null; so is that of one that is damaged
    or larger than a cell, with an error.  A package that lies compressed in another one is uncompressed again by each
    task that reads of it, without being kept.
    """
    whole = cut(entries)
    n, size = whole.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    tasks = max(1, min(n, max(whole.sparkSession.sparkContext.defaultParallelism, -(-size // SHARE))))

    def content(archives: Archives, row: dict) -> tuple[bytes | None, str | None]:
        if row["error"] is not None:
            return None, row["error"]
        try:
            archive = archives.of(row["outer"], row["chain"])
            with archive.open(archive.infolist()[row["place"]]) as f:
                start = f.read(4)
                if row["entry"].startswith("libs/") and start != b"\x7fELF":
                    return None, None
                if row["size"] > CELL:
                    return None, f"{row['size']} bytes do not fit a cell"
                return start + f.read(), None
        except BROKEN as e:
            archives.close()
            return None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archives = Archives()
        for batch in batches:
            for row in batch.to_pylist():
                data, error = content(archives, row)
                yield pa.RecordBatch.from_pylist([row | {"error": error, "content": data}], schema=ENTRY.append(pa.field("content", pa.binary())))
        archives.close()

    # sorted, so that a task opens each package once
    return whole.repartition(tasks).sortWithinPartitions("outer", "chain", "place").mapInArrow(run, READ)


def members(spark: SparkSession, path: str) -> DataFrame:
    """Members of all packages below a folder, as packages.expand gives them, with place, chain and error."""
    return read(listed(found(spark, path)))


def errors(rows: DataFrame) -> DataFrame:
    """Packages and members that could not be read: package, entry, error."""
    return rows.where("error is not null").select("package", "entry", "error")


def own_names(rows: DataFrame) -> DataFrame:
    """ELF libraries of members (outer, package, chain, place, entry, content): outer, package, abi, library, content, and `at`, by which the libraries of an outer package come in order."""
    parts = F.split("entry", "/")
    known = F.array_position(F.array(*map(F.lit, ORDER)), F.get(parts, 1))
    at = F.struct("chain", F.when(known == 0, len(ORDER) + 1).otherwise(known).alias("rank"), F.get(parts, 1).alias("abi"), "place")
    return rows.where(F.col("entry").like("libs/%/%") & F.col("content").isNotNull()).select("outer", "package", F.get(parts, 1).alias("abi"), F.element_at(parts, -1).alias("library"), at.alias("at"), "content")


def first_libraries(rows: DataFrame) -> DataFrame:
    """The first crypto and the first ssl library of each outer package, its own before those of packages inside: outer, crypto, ssl as package!library."""
    name = F.lower("library")
    libraries = own_names(rows).where(is_library(F.col("library"), LIBRARY_PREFIXES, needs_so=False)).select("outer", "at", F.concat_ws("!", "package", "library").alias("full"), name.contains("crypto").alias("is_crypto"), name.contains("ssl").alias("is_ssl"))
    first = lambda c: F.min_by("full", F.when(c, F.col("at")))
    return libraries.groupBy("outer").agg(first(F.col("is_crypto")).alias("crypto"), first(~F.col("is_crypto") & F.col("is_ssl")).alias("ssl"))
