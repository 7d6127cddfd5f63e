"""Places where a source's brackets do not close, their kinds, and symbols named around them.

A lexer stands in for a grammar: an unclosed or stray bracket is a diagnostic.  Names found around one are call
sites of a lesser kind, marked as a fallback, and only where the plain extraction has none of that symbol and line.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkscope.sources.calls import blanked

PAIRS = {")": "(", "]": "[", "}": "{"}
# Diagnostics per file without and with recovery, lines around one, and most lines of a window.
LIMIT, RECOVERY_LIMIT, AROUND, WINDOW = 5, 50, 3, 80
FIELDS = ["file", "line", "column", "end_line", "snippet", "window", "window_start"]
SCHEMA = "file string, line int, column int, end_line int, snippet string, window string, window_start int"


def unbalanced(text: str, limit: int = LIMIT) -> list[tuple[int, int]]:
    """Spans (start, end) from each bracket that does not close to the end of its statement, or of each stray one."""
    code, opened, found = blanked(text), [], []
    for m in re.finditer(r"[()\[\]{}]", code):
        if m[0] not in PAIRS:
            opened.append((m.start(), m[0]))
        elif opened and opened[-1][1] == PAIRS[m[0]]:
            opened.pop()
        elif m[0] == "}" and any(kind == "{" for _, kind in opened):
            while opened[-1][1] != "{":
                found.append(opened.pop()[0])
            opened.pop()
        else:
            found.append(m.start())
    spans = []
    for at in sorted(found + [at for at, _ in opened])[:limit]:
        start = code.rfind("\n", 0, at) + 1
        stop = re.compile(r"[;\n]").search(code, at)
        spans.append((start + len(code[start:at]) - len(code[start:at].lstrip()), stop.start() if stop else len(code)))
    return spans


def kind_of(snippet: Column) -> Column:
    """Class of a diagnostic by its text, first rule first."""
    more = lambda a, b: F.length(F.regexp_replace(snippet, f"[^{a}]", "")) > F.length(F.regexp_replace(snippet, f"[^{b}]", ""))
    return (
        F.when(snippet.startswith("#") | snippet.contains("#if") | snippet.contains("#endif"), "preprocessor-fragment")
        .when(snippet.contains("\\"), "macro-continuation-fragment")
        .when(more(r"\(", r"\)"), "unclosed-call-or-parameter-list")
        .when(more(r"\{", r"\}"), "unclosed-compound-block")
        .when(more(r"\[", r"\]"), "unclosed-index-or-attribute")
        .when(snippet.rlike("(?:class|struct|enum|typedef|namespace) "), "declaration-fragment")
        .when(snippet.rlike(r"(?:,|=|&&|\|\|)$"), "incomplete-expression")
        .otherwise("syntax-recovery")
    )


def diagnostics(sources: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Diagnostics of sources (file, text): place, snippet, class, and the lines around it."""

    def run(frames):
        for frame in frames:
            rows = []
            for file, text in zip(frame["file"], frame["text"], strict=True):
                lines = text.splitlines()
                for start, end in unbalanced(text, limit):
                    line, last = text.count("\n", 0, start) + 1, text.count("\n", 0, end) + 1
                    first = max(1, line - AROUND)
                    stop = min(len(lines), last + AROUND, first + WINDOW - 1)
                    rows.append((file, line, start - text.rfind("\n", 0, start), last, " ".join(text[start:end][:160].split()), "\n".join(lines[first - 1 : stop]), first))
            yield pd.DataFrame(rows, columns=FIELDS)

    found = sources.select("file", "text").where("file is not null and text is not null").mapInPandas(run, SCHEMA)
    return found.withColumn("class", kind_of(F.col("snippet")))


def recovered(found: DataFrame, symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """Call sites named in the windows of diagnostics, the first place of a symbol in each; those that calls has are left out.

    Words are joined with the symbols by name, so no window is searched for every symbol.
    """
    word = F.regexp_extract_all("line_text", F.lit("[A-Za-z0-9_]+"), F.lit(0))
    lines = found.select("file", "class", "window", "window_start", F.posexplode(F.split("window", "\n")).alias("k", "line_text"))
    words = lines.select("file", "class", "window", (F.col("window_start") + F.col("k")).alias("line"), F.explode(F.array_distinct(word)).alias("symbol"))
    known = words.join(symbols.select("symbol").distinct(), "symbol", "left_semi")
    first = known.groupBy("file", "symbol", "window").agg(F.min(F.struct("line", "class")).alias("m")).groupBy("file", "symbol", F.col("m.line").alias("line")).agg(F.min("m.class").alias("class"), F.min(F.trim(F.regexp_replace("window", r"\s+", " "))).alias("args"))
    new = first.join(calls.select("file", "symbol", "line").distinct(), ["file", "symbol", "line"], "left_anti")
    return new.select("file", F.lit("<parser_diagnostic>").alias("caller"), "line", "symbol", "args", F.lit("parser-diagnostic-text").alias("extraction_source"), F.lit("fallback").alias("confidence"), "class")
