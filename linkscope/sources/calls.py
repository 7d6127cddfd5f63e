"""Call sites from C-like and Rust sources by a small lexer: calls of known symbols with the function around them."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkscope.operators.intervals import around_all

# File name endings by language.
LANGUAGES = {".c": "c", ".h": "c", ".cpp": "cpp", ".hpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hxx": "cpp", ".rs": "rust"}
# Words at the start of a file that tell a source from an array of figures.
WORDS = ["#include", "#define", "#ifndef", "#pragma", "typedef", "struct", "enum", "extern", "static", "const ", "void ", "int ", "char "]
KEYWORDS = frozenset("if for while switch return sizeof do else catch case fn match loop".split())
SCHEMA = "file string, caller string, line int, symbol string, args string, language string"
_NOISE = re.compile(r'//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])\'', re.S)
_CALL = re.compile(r"(?<![\w.>:])([A-Za-z_]\w*)\s*\(")
_SCOPED = re.compile(r"(?<![\w.])((?:[A-Za-z_]\w*::)*)([A-Za-z_]\w*)\s*\(")


def blanked(text: str) -> str:
    """The text with comments and literals as blanks, places unchanged; quotes stay."""

    def blank(m):
        s = m[0]
        keep = s[0] in "\"'"
        return "".join(c if c == "\n" or keep and i in (0, len(s) - 1) else " " for i, c in enumerate(s))

    return _NOISE.sub(blank, text)


def closing(text: str, at: int) -> int:
    """Place of the bracket that closes the one at a place, or the end."""
    depth = 0
    for i in range(at, len(text)):
        depth += {"(": 1, ")": -1}.get(text[i], 0)
        if depth == 0:
            return i
    return len(text)


def call_sites(text: str, language: str, symbols: frozenset[str]) -> list[tuple[str, int, str, str]]:
    """(caller, line, symbol, args) of the calls; functions that the file defines itself are no library calls."""
    code = blanked(text)
    pattern = _SCOPED if language == "rust" else _CALL
    found, defined, scopes = [], set(), []
    for m in pattern.finditer(code):
        scope, name = (m[1], m[2]) if language == "rust" else ("", m[1])
        if name in KEYWORDS:
            continue
        end = closing(code, m.end() - 1)
        body = re.compile(r"[^;{}()=]*\{").match(code, end + 1)
        before = code[: m.start()].rstrip()
        starts = re.search(r"\bfn$", before) if language == "rust" else not before or before[-1] not in "=(,;{}&|!+?:" or before.endswith("}")
        if body and starts and (language == "rust" or re.search(r"[\w*&>]$", before)) and not re.search(r"\b(?:return|else)$", before):
            depth, stop = 0, len(code)
            for i in range(body.end() - 1, len(code)):
                depth += {"{": 1, "}": -1}.get(code[i], 0)
                if depth == 0:
                    stop = i
                    break
            defined.add(name)
            scopes.append((m.start(), stop, name))
        elif name in symbols:
            args = re.sub(r"\s+", " ", text[m.end() : end]).strip()
            found.append((m.start(), name, args, bool(scope)))
    out = []
    line, last = 1, 0
    for (at, name, args, scoped), caller in zip(found, around_all([f[0] for f in found], scopes), strict=True):
        line, last = line + code.count("\n", last, at), at
        if name not in defined or scoped:
            out.append((caller or "<file_scope>", line, name, args))
    return out


def extract(sources: DataFrame, symbols: list[str]) -> DataFrame:
    """Call sites of a table of file and text; symbols: the names of the dimension (a bounded list)."""
    shared = sources.sparkSession.sparkContext.broadcast(frozenset(symbols))

    def run(frames):
        for frame in frames:
            rows = [(f, c, n, s, a, lang) for f, t, lang in zip(frame["file"], frame["text"], frame["language"], strict=True) for c, n, s, a in call_sites(t, lang, shared.value)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    ending = F.concat(F.lit("."), F.lower(F.element_at(F.split("file", r"\."), -1)))
    language = F.element_at(F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair]), ending)
    head = F.substring("text", 1, 512)
    blob = (F.octet_length("text") > 50 * 1024) & F.ltrim(F.regexp_replace(head, r"^\s+", "")).startswith("0x") & ~F.exists(F.array(*map(F.lit, WORDS)), lambda w: F.contains(head, w))
    return sources.select("file", "text", language.alias("language")).where(F.col("language").isNotNull() & F.col("text").isNotNull() & ~blob).mapInPandas(run, SCHEMA)
