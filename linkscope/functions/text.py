"""Scalar functions over names, paths and figures, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkscope.functions.categories import LIBRARY_PREFIXES

def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """All before the last slash, empty without one."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def ending(name: Column) -> Column:
    """The last dot and what follows it, empty without one."""
    return F.when(F.instr(name, ".") > 0, F.concat(F.lit("."), F.substring_index(name, ".", -1))).otherwise(F.lit(""))


def without_ending(name: Column) -> Column:
    return F.when(F.instr(name, ".") > 0, F.left(name, F.length(name) - F.length(F.substring_index(name, ".", -1)) - 1)).otherwise(name)


def library_stem(name: Column) -> Column:
    """Base name up to the first `.so`."""
    return F.substring_index(basename(name), ".so", 1)


def is_ssl_name(name: Column) -> Column:
    """Whether a base name starts like one of the libraries, with or without `.so`."""
    return is_library(basename(name), LIBRARY_PREFIXES, needs_so=False)


def is_library(name: Column, prefixes: list[str], needs_so: bool = True) -> Column:
    """Whether a file name in lower case starts with one of the prefixes and, if asked for, contains `.so`."""
    # one pattern: a name is put in lower case once, not for each prefix
    low = F.lower(name)
    hit = low.rlike(f"^(?:{'|'.join(map(re.escape, prefixes))})") if prefixes else F.lit(False)
    return hit & low.contains(".so") if needs_so else hit


def strip_prefix(path: Column, prefix: str) -> Column:
    """path below the prefix, which must end at a slash; unchanged otherwise."""
    p = prefix.rstrip("/")
    return F.when(F.lit(bool(p)) & path.startswith(p + "/"), F.substring(path, len(p) + 2, 1 << 30)).otherwise(path)


def collapse_blanks(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def safe_cell(text: Column) -> Column:
    """A spreadsheet would read a text that starts like a formula as one; a quote in front prevents it."""
    return F.when(F.substring(text, 1, 1).isin("=", "+", "-", "@"), F.concat(F.lit("'"), text)).otherwise(text)


def ratio(part: Column, whole: Column) -> Column:
    """Percentage to two places, ties to even; 0 without a whole."""
    return F.when(whole > 0, F.bround(part / F.when(whole > 0, whole) * 100, 2)).otherwise(0.0)


def percent_label(value: Column) -> Column:
    return F.format_string("%.1f%%", value.cast("double"))


def chain_depth(chain: Column) -> Column:
    """Hops of a chain written with ` -> ` between its members."""
    return (F.size(F.split(chain, " -> ")) - 1).cast("long")


def depth_of_key(key: Column) -> Column:
    """Number of a `depth_N` key, null if it has none."""
    return F.regexp_replace(key, "^depth_", "").try_cast("long")


def lenient_int(value: Column) -> Column:
    """Whole number of a text, 0 if it is none."""
    return F.coalesce(value.try_cast("long"), F.lit(0).cast("long"))


def sheet_of(position: Column, rows: int = 1_048_575) -> Column:
    """Number, from 0, of the continuation sheet that a data row (from 1) falls on."""
    return F.floor((position - 1) / rows).cast("long")


def relative_path(path: Column, root: str) -> Column:
    """path below the root; else below the last folder that has the root's name; else its base name."""
    name = root.rstrip("/").rsplit("/", 1)[-1]
    return F.when(path.startswith(root.rstrip("/") + "/"), F.substring(path, len(root.rstrip("/")) + 2, 1 << 30)).when(path.contains(f"/{name}/"), F.substring_index(path, f"/{name}/", -1)).otherwise(basename(path))
