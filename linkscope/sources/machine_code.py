"""Names that a binary hands to dlsym, read from its machine code.

A call of dlsym goes through its entry in the procedure linkage table; the second argument is an address that the
instructions just before it put into a register.  Whole text sections are searched with numpy; only
the places that call dlsym are looked at one by one.  Runs map-side over binary contents.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from linkscope.sources import elf

# Names of the function, table layout by machine, and how far back the argument is looked for.
NAMES = ("dlsym", "__libc_dlsym", "dlvsym")
HEADER, ENTRY = {183: 32, 62: 16}, 16
BACK_INSTRUCTIONS, BACK_BYTES = 16, 64
LEA_RSI = b"\x48\x8d\x35"


def entry_address(own: dict[str, tuple[int, bytes]], machine: int) -> int | None:
    """Address of the linkage table's entry for dlsym, if the file imports it."""
    strings = own.get(".dynstr", (0, b""))[1]
    wanted = [i for i, row in enumerate(struct.iter_unpack("<IBBHQQ", own.get(".dynsym", (0, b""))[1])) if row[3] == 0 and elf.cstring(strings, row[0]) in NAMES]
    relocations, width = (own[".rela.plt"][1], 24) if ".rela.plt" in own else (own.get(".rel.plt", (0, b""))[1], 16)
    if not wanted or ".plt" not in own or not relocations:
        return None
    info = np.frombuffer(relocations[: len(relocations) // width * width], dtype="<u8").reshape(-1, width // 8)[:, 1] >> np.uint64(32)
    at = np.flatnonzero(info == wanted[0])
    return own[".plt"][0] + HEADER[machine] + int(at[0]) * ENTRY if len(at) else None


def arm_arguments(code: bytes, base: int, target: int) -> set[int]:
    """Addresses in x1 at the calls of target: a page by ADRP and an offset by ADD, each the nearest before the call."""
    words = np.frombuffer(code[: len(code) // 4 * 4], dtype="<u4").astype(np.int64)
    jump = ((words & 0x3FFFFFF) ^ 0x2000000) - 0x2000000
    calls = np.flatnonzero(((words & 0xFC000000) == 0x94000000) & (base + 4 * (np.arange(len(words)) + jump) == target))
    found = set()
    for i in calls.tolist():
        first = max(0, i - BACK_INSTRUCTIONS)
        near = words[first:i]
        adds = np.flatnonzero(((near & 0xFF800000) == 0x91000000) & ((near & 0x3FF) == 0x21))
        pages = np.flatnonzero(((near & 0x9F000000) == 0x90000000) & ((near & 0x1F) == 1))
        if len(adds) and len(pages):
            add, page, place = int(near[adds[-1]]), int(near[pages[-1]]), base + 4 * (first + int(pages[-1]))
            high = (((page >> 5 & 0x7FFFF) << 2 | page >> 29 & 3) ^ 0x100000) - 0x100000
            found.add((place & ~0xFFF) + (high << 12) + ((add >> 10 & 0xFFF) << (12 if add >> 22 & 3 == 1 else 0)))
    return found


def intel_arguments(code: bytes, base: int, target: int) -> set[int]:
    """Addresses in rsi at the calls of target, by the nearest LEA before each."""
    raw = np.frombuffer(code, dtype=np.uint8).astype(np.int64)
    if len(raw) < 5:
        return set()
    at = np.flatnonzero(raw[:-4] == 0xE8)
    jump = sum(raw[at + 1 + k] << (8 * k) for k in range(4))
    jump = (jump ^ (1 << 31)) - (1 << 31)
    found = set()
    for i in at[base + at + 5 + jump == target].tolist():
        j = code.rfind(LEA_RSI, max(0, i - BACK_BYTES), max(0, i - 4))
        if j >= 0:
            found.add(base + j + 7 + struct.unpack_from("<i", code, j + 3)[0])
    return found


def dlsym_names(data: bytes) -> set[str]:
    """The strings at the addresses that dlsym is called with; none for other machines or files without the import."""
    machine = struct.unpack_from("<H", data, 18)[0]
    if machine not in HEADER or data[4] != 2 or data[5] != 1:
        return set()
    own = elf.placed_sections(data)
    target = entry_address(own, machine)
    if target is None or ".text" not in own:
        return set()
    base, code = own[".text"]
    out = set()
    for address in (arm_arguments if machine == 183 else intel_arguments)(code, base, target):
        for name in elf.STRING_SECTIONS:
            start, content = own.get(name, (0, b""))
            if start <= address < start + len(content):
                out.add(elf.printable_at(content, address - start))
                break
    return out - {""}


def dlsym_arguments(contents: DataFrame) -> DataFrame:
    """path and symbol of every name handed to dlsym; to be joined with the candidates."""

    def run(frames):
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows += [(path, name) for name in sorted(dlsym_names(bytes(content)))]
                except (struct.error, IndexError):
                    continue
            yield pd.DataFrame(rows, columns=["path", "symbol"])

    return contents.select("path", "content").mapInPandas(run, "path string, symbol string")
