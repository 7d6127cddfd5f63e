"""Workbooks whose rows are written by tasks: a data source makes compressed blocks of rows, which are joined to sheets.

A task writes one file of blocks and sends sizes and checksums with its commit; the commit of a table writes the
list of the blocks of those attempts that count, so what a lost or doubled attempt left behind is never read.  As a
workbook is one file, its bytes pass one process, as they are: the driver copies blocks of compressed bytes and sees no row.
"""

from __future__ import annotations

import json
import math
import os
import re
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from xml.sax.saxutils import escape

import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Rows of a sheet below its head, most rows of a block, and bytes that are copied at once.
ROWS, BLOCK, PIECE = 1_048_575, 1 << 14, 1 << 20
# Names of the file format.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELATIONS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
KIND = "application/vnd.openxmlformats-officedocument.spreadsheetml"
#: Style 1 is that of heads: bold on grey.
STYLES = f'<?xml version="1.0"?><styleSheet xmlns="{MAIN}"><fonts count="2"><font/><font><b/></font></fonts><fills count="3"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill><fill><patternFill patternType="solid"><fgColor rgb="FFD9D9D9"/></patternFill></fill></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fontId="1" fillId="2" applyFont="1" applyFill="1"/></cellXfs></styleSheet>'
# What may not stand in the format at all.
BARRED = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff￾￿]")


@dataclass
class Sheet:
    """A table for a workbook: its rows in the order of its partitions; without a head its column names are not written."""

    rows: DataFrame
    head: bool = True
    widths: list[int] = field(default_factory=list)


@dataclass
class Block:
    """Rows that follow each other in a file of blocks, compressed so that blocks can be put one behind the other."""

    file: str
    start: int
    packed: int
    size: int
    crc: int
    n_rows: int


@dataclass
class Written(WriterCommitMessage):
    partition: int
    blocks: list[Block]


def sheet_names(titles: list[str]) -> list[str]:
    """Legal, distinct names of at most 31 characters."""
    out: list[str] = []
    for t in titles:
        base = "".join("_" if c in "[]:*?/\\" else c for c in t)[:31] or "Sheet"
        name, n = base, 1
        while name.lower() in {x.lower() for x in out}:
            n += 1
            name = f"{base[: 31 - len(str(n)) - 1]}_{n}"
        out.append(name)
    return out


def column_letter(n: int) -> str:
    """Letters of a sheet's n-th column, from 1."""
    out = ""
    while n > 0:
        n, rest = divmod(n - 1, 26)
        out = chr(65 + rest) + out
    return out


def cell(value, style: str = "") -> str:
    """A cell; numbers stay numbers if they are finite, a text that starts like a formula gets a quote in front."""
    if value is None:
        return "<c/>"
    if isinstance(value, int | float) and not isinstance(value, bool) and math.isfinite(value):
        return f"<c{style}><v>{value}</v></c>"
    text = BARRED.sub("", str(value))
    if text[:1] in ("=", "+", "-", "@"):
        text = "'" + text
    return f'<c t="inlineStr"{style}><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def packed(data: bytes, last: bool = False) -> bytes:
    """A piece of a deflate stream that starts and ends at a byte and refers to nothing before it."""
    run = zlib.compressobj(6, zlib.DEFLATED, -15)
    return run.compress(data) + run.flush(zlib.Z_FINISH if last else zlib.Z_FULL_FLUSH)


def joined_crc(a: int, b: int, size: int) -> int:
    """Checksum of two byte strings one behind the other, from that of each and the size of the second."""

    # polynomials over two elements, the highest power in the lowest bit
    def product(x: int, y: int) -> int:
        out = 0
        for _ in range(32):
            out ^= y if x & 0x80000000 else 0
            x, y = x << 1 & 0xFFFFFFFF, y >> 1 ^ (0xEDB88320 if y & 1 else 0)
        return out

    power, shift, n = 0x00800000, 0x80000000, size
    while n:
        if n & 1:
            shift = product(power, shift)
        power, n = product(power, power), n >> 1
    return product(shift, a) ^ b


class BlockWriter(DataSourceWriter):
    """Files of blocks below a folder, one for each attempt of a task that has rows, and a list of those that count."""

    def __init__(self, options: dict[str, str]):
        self.folder, self.most = options["path"], int(options["most"])

    def write(self, iterator: Iterator) -> Written:
        files, root = pyarrow.fs.FileSystem.from_uri(self.folder)
        name, blocks, waiting, at, out = uuid.uuid4().hex, [], [], 0, None

        def put() -> None:
            nonlocal at, out
            data = "".join(waiting).encode()
            piece = packed(data)
            out = out or files.open_output_stream(f"{root}/{name}")
            out.write(piece)
            blocks.append(Block(name, at, len(piece), len(data), zlib.crc32(data), len(waiting)))
            at += len(piece)
            waiting.clear()

        for row in iterator:
            waiting.append("<row>" + "".join(map(cell, row)) + "</row>")
            if len(waiting) == self.most:
                put()
        if waiting:
            put()
        if out:
            out.close()
        return Written(TaskContext.get().partitionId(), blocks)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = pyarrow.fs.FileSystem.from_uri(self.folder)
        found = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        with files.open_output_stream(f"{root}/list") as f:
            f.write(json.dumps([asdict(b) for m in found for b in m.blocks]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        files, root = pyarrow.fs.FileSystem.from_uri(self.folder)
        for m in messages:
            for name in {b.file for b in m.blocks} if m is not None else ():
                files.delete_file(f"{root}/{name}")


class Blocks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sheet_blocks"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema, overwrite: bool) -> BlockWriter:
        return BlockWriter(self.options)


def _uri(path: str) -> str:
    return path if re.match(r"[a-z0-9]+:/", path) else f"file://{os.path.abspath(path)}"


def _work(spark: SparkSession, target: str) -> str:
    """A folder for blocks: below that of spark.checkpoint.dir, beside the target only where all runs on this machine."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return f"{_uri(shared).rstrip('/')}/workbook-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return f"{target}.blocks-{uuid.uuid4().hex}"


def _placed(blocks: list[Block], rows: int) -> list[list[Block]]:
    """Blocks in their order, as many for each sheet as it holds; one sheet at least."""
    out, room = [[]], rows
    for b in blocks:
        if b.n_rows > room:
            out.append([])
            room = rows
        out[-1].append(b)
        room -= b.n_rows
    return out


def _append(z: zipfile.ZipFile, name: str, ends: tuple[str, str], blocks: list[Block], files: pyarrow.fs.FileSystem, folder: str) -> None:
    """Adds a file of the archive made of a beginning, blocks as they are, and an end."""
    first, last = (e.encode() for e in ends)
    front, back = packed(first), packed(last, last=True)
    info = zipfile.ZipInfo(name)
    info.compress_type, info.header_offset = zipfile.ZIP_DEFLATED, z.fp.tell()
    info.CRC = zlib.crc32(first)
    for b in blocks:
        info.CRC = joined_crc(info.CRC, b.crc, b.size)
    info.CRC = joined_crc(info.CRC, zlib.crc32(last), len(last))
    info.file_size = len(first) + len(last) + sum(b.size for b in blocks)
    info.compress_size = len(front) + len(back) + sum(b.packed for b in blocks)
    z.fp.write(info.FileHeader())
    z.fp.write(front)
    for b in blocks:
        with files.open_input_file(f"{folder}/{b.file}") as f:
            f.seek(b.start)
            left = b.packed
            while left:
                piece = f.read(min(left, PIECE))
                if not piece:
                    raise OSError(f"{folder}/{b.file}: {left} bytes are missing")
                z.fp.write(piece)
                left -= len(piece)
    z.fp.write(back)
    # the archive's list of contents takes the file as one of its own
    z.filelist.append(info)
    z.NameToInfo[name] = info
    z.start_dir = z.fp.tell()


def spreadsheet(path: str, sheets: dict[str, DataFrame | Sheet], rows: int = ROWS) -> None:
    """A workbook of tables; a table with more rows than a sheet holds goes on in `title (2)` and so on.

    Rows come in the order of their table.  A sheet that goes on may hold up to a block fewer rows than fit, as blocks are
    not cut.  Heads are repeated, stay in view and have a filter.  Null is an empty cell, lists are written as text,
    characters that the format bars are left out, an empty table has its head only.
    """
    if not sheets:
        raise ValueError("a workbook has at least one sheet")
    target = _uri(path)
    given = {t: s if isinstance(s, Sheet) else Sheet(s) for t, s in sheets.items()}
    spark = next(iter(given.values())).rows.sparkSession
    spark.dataSource.register(Blocks)
    work = _work(spark, target)
    files, root = pyarrow.fs.FileSystem.from_uri(work)
    ours, out = pyarrow.fs.FileSystem.from_uri(target)
    try:
        parts: list[tuple[str, Sheet, str, list[Block]]] = []
        for i, (title, sheet) in enumerate(given.items()):
            files.create_dir(f"{root}/{i}")
            # names may be repeated in a workbook, but not in a table that is written
            plain = sheet.rows.toDF(*[f"c{j}" for j in range(len(sheet.rows.columns))])
            plain.write.format("sheet_blocks").option("path", f"{work}/{i}").option("most", min(BLOCK, rows)).mode("append").save()
            with files.open_input_file(f"{root}/{i}/list") as f:
                blocks = [Block(**b) for b in json.loads(f.read())]
            parts += [(title if n == 1 else f"{title} ({n})", sheet, f"{root}/{i}", some) for n, some in enumerate(_placed(blocks, rows), 1)]
        with ours.open_output_stream(f"{out}.part") as stream, zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED) as z:
            for i, (_, sheet, folder, blocks) in enumerate(parts, 1):
                _append(z, f"xl/worksheets/sheet{i}.xml", _ends(sheet, sum(b.n_rows for b in blocks)), blocks, files, folder)
            for name, text in _frame(sheet_names([p[0] for p in parts])).items():
                z.writestr(name, text)
        ours.move(f"{out}.part", out)
    finally:
        if files.get_file_info(root).type == pyarrow.fs.FileType.Directory:
            files.delete_dir(root)


def _ends(sheet: Sheet, n: int) -> tuple[str, str]:
    """What stands before and after the rows of a sheet."""
    columns = sheet.rows.columns
    view = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>' if sheet.head else ""
    widths = "".join(f'<col min="{i}" max="{i}" width="{w}" customWidth="1"/>' for i, w in enumerate(sheet.widths, 1))
    head = "<row>" + "".join(cell(c, ' s="1"') for c in columns) + "</row>" if sheet.head else ""
    span = f'<autoFilter ref="A1:{column_letter(len(columns))}{n + 1}"/>' if sheet.head and columns else ""
    return f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{MAIN}">{view}' + (f"<cols>{widths}</cols>" if widths else "") + f"<sheetData>{head}", f"</sheetData>{span}</worksheet>"


def _frame(names: list[str]) -> dict[str, str]:
    """The files of a workbook beside its sheets."""
    top = '<?xml version="1.0"?>'
    sheets = "".join(f'<sheet name="{escape(t, {chr(34): "&quot;"})}" sheetId="{i}" r:id="r{i}"/>' for i, t in enumerate(names, 1))
    links = "".join(f'<Relationship Id="r{i}" Type="{RELATIONS}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1))
    types = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{KIND}.worksheet+xml"/>' for i in range(1, len(names) + 1))
    return {
        "xl/workbook.xml": f'{top}<workbook xmlns="{MAIN}" xmlns:r="{RELATIONS}"><sheets>{sheets}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'{top}<Relationships xmlns="{PACKAGE}/relationships">{links}<Relationship Id="styles" Type="{RELATIONS}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": STYLES,
        "_rels/.rels": f'{top}<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="r1" Type="{RELATIONS}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "[Content_Types].xml": f'{top}<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{KIND}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{KIND}.styles+xml"/>{types}</Types>',
    }
