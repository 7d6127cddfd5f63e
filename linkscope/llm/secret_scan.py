"""Secret scan: patterns, and sliding-window Shannon entropy per character class.

All of it is DataFrame functions.  Three patterns give the base spans (assign, access, hex).
Candidate strings for the entropy test are unbroken runs over `[A-Za-z0-9+/_=-]` of at least
WINDOW characters with a digit in them.  A candidate's class is hex if it has hexadecimal digits alone, else
mixed; runs of decimal digits alone are no candidates.  A window of WINDOW characters slides over it; entering and
leaving characters change their counts and with them the sum of n log2 n, from which each
window's entropy follows at once.  The candidate is a span of kind entropy if any window
reaches its class's threshold, unless the allow-list of harmless forms suppresses it.  Base
spans are never suppressed.

Defined cases: a null text is empty; no span gives counts of 0, the hash of the empty string and empty spans; equal spans
of different kinds all stay, in the order start, kind; repeated rows give a row each; null ids pass
through; an empty table gives no rows; texts are scanned whole, places count code points.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkscope.llm.common import fresh

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
WINDOW = 20
_RUN = "A-Za-z0-9+/_=-"
CANDIDATE = rf"(?<![{_RUN}])(?=[{_RUN}]{{{WINDOW}}})[A-Za-z+/_=-]*+[0-9][{_RUN}]*+"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Bits from which a window of random characters is told from text, by class.
HEX_BITS, MIXED_BITS = 3.0, 3.7
#: Harmless forms: universal ids, dates and times, placeholders, runs of one character.
ALLOW = [
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}",
    r"(?i)example|placeholder|changeme|dummy|your[_-]|xxxx|0{6}|123456789",
    r"(.)\1{7}",
]
KINDS = ["assign", "access", "hex", "entropy"]


def bound(value: Column, use) -> Column:
    """use(value), where the value is computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, op) -> Column:
    """For each of an array's numbers from 0 up the fold of those before it, by an associative op.

    Appending to an array copies it, so folds are taken in blocks of the square root of their number and then over the blocks.
    """
    none = F.expr("cast(array() as array<int>)")
    start = F.struct(F.lit(0).alias("all"), none.alias("before"))

    def fold(numbers):
        return F.aggregate(numbers, start, lambda a, x: F.struct(op(a["all"], x).alias("all"), F.concat(a["before"], F.array(a["all"])).alias("before")))

    def whole(v):
        width = F.ceil(F.sqrt(F.size(v))).cast("int")
        blocks = F.transform(F.sequence(F.lit(1), F.size(v), width), lambda i: fold(F.slice(v, i, width)))
        return bound(blocks, lambda b: F.flatten(F.zip_with(b, fold(F.transform(b, lambda x: x["all"]))["before"], lambda x, o: F.transform(x["before"], lambda y: op(o, y)))))

    return bound(values, lambda v: F.when(F.size(v) > 0, whole(v)).otherwise(none))


def located(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """Spans (start, rank of the kind, end) of the pattern's leftmost non-overlapping matches that keep() accepts."""
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")
    rank = F.lit(KINDS.index(kind))

    def spans(found):
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        sizes = F.zip_with(gaps, found, lambda gap, x: F.struct(F.length(gap).alias("gap"), F.length(x).alias("size"), x.alias("found")))

        def places(s):
            before = running(F.transform(s, lambda x: x["gap"] + x["size"]), lambda a, b: a + b)
            return F.zip_with(s, before, lambda x, at: F.struct((at + x["gap"]).alias("start"), rank.alias("kind"), (at + x["gap"] + x["size"]).alias("end"), x["found"].alias("found")))

        all = bound(sizes, places)
        return F.transform(all if keep is None else F.filter(all, lambda x: keep(x["found"])), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))

    return bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, spans(found)).otherwise(none))


#: Characters of a candidate that are gone through at a time.
STEPS = 4096


def peak_entropy(candidate: Column, window: int = WINDOW) -> Column:
    """Highest entropy in bits of any window, by counts that each step changes for one character in and one out.

    The counts are one byte for each character of the alphabet, and the candidate is read as bytes, so a step costs
    the same at any place of a candidate of any length.
    """
    table = F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(window + 2)])
    byte = lambda data, i: F.ascii(F.substring(data, i, F.lit(1)).cast("string"))
    # counts are kept from 1 up, as a zero byte reads like no byte
    written = F.array(*[F.lit(bytes([n + 1])) for n in range(window + 2)])
    letters = F.array(*[F.lit(ALPHABET.find(chr(c)) + 1) for c in range(128)])

    def peak(data):
        place = lambda i: F.get(letters, byte(data, i))

        def step(a, i):
            def moved(x):
                change = F.get(table, x["more"] + 1) - F.get(table, x["more"]) + F.when(x["go"] > 0, F.get(table, x["less"] - 1) - F.get(table, x["less"])).otherwise(0.0)
                s = a["s"] + F.when(x["come"] == x["go"], 0.0).otherwise(change)
                up = F.overlay(a["n"], F.get(written, x["more"] + 1), x["come"], F.lit(1))
                n = F.when(x["come"] == x["go"], a["n"]).when(x["go"] > 0, F.overlay(up, F.get(written, x["less"] - 1), x["go"], F.lit(1))).otherwise(up)
                best = F.when(i >= window, F.greatest(a["best"], F.lit(math.log2(window)) - s / window)).otherwise(a["best"])
                return F.struct(n.alias("n"), s.alias("s"), best.alias("best"))

            two = F.struct(place(i).alias("come"), F.when(i > window, place(i - window)).otherwise(0).alias("go"))
            counted = lambda x: F.struct(x["come"].alias("come"), x["go"].alias("go"), (byte(a["n"], x["come"]) - 1).alias("more"), F.when(x["go"] > 0, byte(a["n"], x["go"]) - 1).otherwise(0).alias("less"))
            return bound(bound(two, counted), moved)

        size = F.length(data)
        pieces = F.sequence(F.lit(1), F.greatest(size, F.lit(1)), F.lit(STEPS))
        start = F.struct(F.lit(bytes([1]) * len(ALPHABET)).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("best"))
        return F.aggregate(pieces, start, lambda a, i: F.aggregate(F.sequence(i, F.least(i + STEPS - 1, size)), a, step), lambda a: a["best"])

    return bound(candidate.cast("binary"), peak)


def secret_like(candidate: Column) -> Column:
    harmless = F.lit(False)
    for pattern in ALLOW:
        harmless = harmless | candidate.rlike(pattern)
    least = F.when(candidate.rlike("^[0-9a-fA-F]+$"), F.lit(HEX_BITS)).otherwise(F.lit(MIXED_BITS))
    return F.when(candidate.rlike("^[0-9]+$") | harmless, F.lit(False)).otherwise(peak_entropy(candidate) >= least)


def scan(docs: DataFrame, text: str = "text", into: str = "secrets") -> DataFrame:
    """docs with an array column of spans (start, kind, end), sorted; kind is the place in KINDS."""
    whole = F.coalesce(F.col(text), F.lit(""))
    value = lambda found: F.length(F.regexp_extract(found, ASSIGN, 1)) >= 6
    spans = F.concat(located(whole, ASSIGN, "assign", value), located(whole, ACCESS, "access"), located(whole, HEX, "hex"), located(whole, CANDIDATE, "entropy", secret_like))
    return docs.withColumn(into, F.array_sort(spans))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(found: DataFrame, into: str = "secrets") -> DataFrame:
    spans = F.col(into)
    base = F.filter(spans, lambda x: x["kind"] < 3)
    number = lambda k: F.size(F.filter(spans, lambda x: x["kind"] == k)).cast("long")
    return found.select("doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"), F.sha2(written(base), 256).alias("base_sha256"), written(spans).alias("spans"), number(3).alias("n_entropy"))


def redact(docs: DataFrame, text: str = "text", length: str | None = None, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of the text replaced by the mark; overlapping spans by one.

    The text is cut in a coding of four bytes a character, so a place needs no scan from the start, and pieces are joined once.
    length: a column that is to hold the new length, where the text has changed.
    """
    into = fresh("secrets", docs.columns)
    wide_column = fresh("wide", [*docs.columns, into])
    found = scan(docs, text, into).withColumn(wide_column, F.when(F.size(into) > 0, F.encode(F.col(text), "UTF-32")))

    def cleaned(spans, wide):
        cut_out = lambda start, end: F.decode(F.substring(wide, start * 4 + 1, (end - start) * 4), "UTF-32")
        reached = running(F.transform(spans, lambda x: x["end"]), F.greatest)
        # a span that begins inside what is gone already only lengthens it
        new = F.filter(F.zip_with(spans, reached, lambda x, at: F.struct(at.alias("at"), x["start"].alias("start"))), lambda x: x["start"] >= x["at"])
        kept = F.transform(new, lambda x: cut_out(x["at"], x["start"]))
        last = F.array_max(F.transform(spans, lambda x: x["end"]))
        return F.array_join(F.concat(kept, F.array(cut_out(last, (F.length(wide) / 4).cast("int")))), mark)

    # bound, as a row's bytes are copied each time they are read
    out = found.withColumn(text, F.when(F.size(into) > 0, bound(F.col(wide_column), lambda wide: cleaned(F.col(into), wide))).otherwise(F.col(text)))
    if length is not None:
        out = out.withColumn(length, F.when(F.size(into) > 0, F.length(text).cast(docs.schema[length].dataType)).otherwise(F.col(length)))
    return out.drop(into, wide_column)
