import itertools
import random
import zipfile
from collections import Counter

import pytest

import __spark_entry__
from linkscope.functions import categories
from linkscope.operators import diff, graph, matching, trees
from linkscope.plans import sinks
from linkscope.sources import calls, elf, packages, text_tables
from linkscope.streaming import rescan


def test_entry_and_oracles_have_the_same_names(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() == 20


def greedy(old, new):
    """Plain matching inside one group: equal pairs, equal args by nearest line, equal line, nearest line."""
    left, right, out = list(old), list(new), Counter()
    for status, fits in (("unchanged", lambda a, b: a == b), ("moved", lambda a, b: a[1] == b[1]), ("changed", lambda a, b: a[0] == b[0]), ("changed", lambda a, b: True)):
        for a in list(left):
            found = [b for b in right if fits(a, b)]
            if found:
                right.remove(min(found, key=lambda b: abs(a[0] - b[0])))
                left.remove(a)
                out[status] += 1
    out["removed"], out["added"] = len(left), len(right)
    return out


def test_diff_counts_equal_greedy_matching(spark):
    r = random.Random(1)
    groups = {g: tuple([(r.randrange(4), r.choice("xyz")) for _ in range(r.randrange(4))] for _ in range(2)) for g in range(200)}
    side = lambda i: spark.createDataFrame([(f"f{g}", "c", "s", line, args) for g, v in groups.items() for line, args in v[i]], "file string, caller string, symbol string, line int, args string")
    old, new = side(0), side(1)
    got = {x.file: x for x in diff.call_sites(old, new).collect()}
    paired = Counter((x.file, x.status) for x in diff.pairs(old, new).collect())
    for g, (a, b) in groups.items():
        if a or b:
            n, x = greedy(a, b), got[f"f{g}"]
            assert (x.n_unchanged, x.n_moved, x.n_changed, x.n_removed, x.n_added) == tuple(n[k] for k in ("unchanged", "moved", "changed", "removed", "added"))
            assert all(paired[f"f{g}", k] == n[k] for k in diff.ORDER)


def partners(old, new):
    """Plain greedy matching of a group's rows (line, args) in order, one old row at a time."""
    left, right, out = sorted(old), sorted(new), []
    for status, fits in (("unchanged", lambda a, b: a == b), ("moved", lambda a, b: a[1] == b[1]), ("changed", lambda a, b: a[0] == b[0]), ("changed", lambda a, b: True)):
        for a in list(left):
            found = [b for b in right if fits(a, b)]
            if found:
                b = min(found, key=lambda b: abs(a[0] - b[0]))
                right.remove(b)
                left.remove(a)
                out.append((*a, *b, status))
    return sorted(map(str, out + [(*a, None, None, "removed") for a in left] + [(None, None, *b, "added") for b in right]))


@pytest.mark.parametrize("lines,size", [(4, 6), (30, 12), (1000, 25)])
def test_partners_equal_plain_greedy(spark, lines, size):
    r = random.Random(lines)
    groups = {f"f{g}": tuple([(r.randrange(lines), r.choice("xyz")) for _ in range(r.randrange(size))] for _ in range(2)) for g in range(150)}
    groups["hot"] = tuple([(r.randrange(5 * lines), r.choice("xyzuvw")) for _ in range(700)] for _ in range(2))
    side = lambda i: spark.createDataFrame([(g, "c", "s", line, args) for g, v in groups.items() for line, args in v[i]], "file string, caller string, symbol string, line int, args string")
    got = {}
    for x in diff.pairs(side(0), side(1)).collect():
        got.setdefault(x.file, []).append((x.old_line, x.old_args, x.new_line, x.new_args, x.status))
    assert {g: sorted(map(str, v)) for g, v in got.items()} == {g: partners(*v) for g, v in groups.items() if any(v)}


def test_nearest_partner_takes_time_in_proportion():
    import time

    n, start = 200_000, time.perf_counter()
    found = list(matching.nearest([(3 * i, "a", 1) for i in range(n)], [(3 * i + 1, "a", 1) for i in range(n)]))
    assert len(found) == n and time.perf_counter() - start < 10


def test_first_category_in_order_decides(spark):
    names = ["SSL_new", "OSSL_PARAM_get", "OSSL_x", "SHA1", "zz", "mine", "MAC_ro"]
    rows = spark.createDataFrame([(n,) for n in names], "symbol string").select("symbol", categories.category_of(rows_col(), custom=["mine"], macros=["MAC_ro"]).alias("c")).collect()
    assert [r.c for r in rows] == ["ssl_core", "crypto_provider", "openssl_util", "crypto_hash", "other", "COSTOM", "macro"]


def rows_col():
    from pyspark.sql import functions as F

    return F.col("symbol")


def test_boundaries(spark):
    for paths, expected in ((["curl/lib", "curl/src"], ["curl"]), (["nginx/src/http", "nginx/src/core"], ["nginx/src"]), (["a/b/c"], ["a/b/c"]), (["a", "a/b"], ["a"]), (["a/b", "c"], ["a/b", "c"])):
        got = graph.boundaries(spark.createDataFrame([(p,) for p in paths], "path string")).collect()
        assert sorted(r.project for r in got) == expected


def test_paths_and_reach(spark):
    edges = [("a", "b"), ("b", "c"), ("b", "t"), ("c", "b"), ("c", "t"), ("d", "d2")]
    e, t = spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([("t",)], "node string")
    assert sorted(r.path for r in graph.paths_to(e, t).collect()) == [["a", "b", "c", "t"], ["a", "b", "t"], ["b", "c", "t"], ["b", "t"], ["c", "b", "t"], ["c", "t"]]
    assert {r.node: r.depth for r in graph.reachable(e, t).collect()} == {"t": 0, "b": 1, "c": 1, "a": 2}
    tree = [(name, parent, depth, error) for name, parent, depth, _, error in trees.walk("r", {"r": ["a", "b"], "a": ["x"], "b": ["x"]}, {"r", "a", "b", "x"})]
    assert tree == [("r", None, 0, None), ("a", "r", 1, None), ("x", "a", 2, None), ("b", "r", 1, None), ("x", "b", 2, "circular dependency")]


def small_elf(needed, symbols, rodata):
    """A little-endian 64-bit shared object with just the sections that are read."""
    import struct

    names, strings = b"\0", b"\0"

    def put(text):
        nonlocal strings
        at = len(strings)
        strings += text.encode() + b"\0"
        return at

    dynamic = b"".join(struct.pack("<qQ", 1, put(n)) for n in needed) + struct.pack("<qQ", 0, 0)
    dynsym = bytes(24) + b"".join(struct.pack("<IBBHQQ", put(n), 0x12, 0, int(defined), 0, 0) for n, defined in symbols)
    body, rows, place = b"", [(0,) * 6], 64
    for name, kind, content in ((".dynamic", 6, dynamic), (".dynsym", 11, dynsym), (".rodata", 1, rodata), (".dynstr", 3, strings)):
        rows.append((len(names), kind, 0, 0, place + len(body), len(content)))
        names += name.encode() + b"\0"
        body += content
    rows.append((len(names), 3, 0, 0, place + len(body), len(names) + 10))
    names += b".shstrtab\0"
    body += names
    head = b"\x7fELF" + bytes([2, 1, 1]) + bytes(9) + struct.pack("<HHIQQQIHHHHHH", 3, 183, 1, 0, 0, 64 + len(body), 0, 64, 0, 0, 64, len(rows), len(rows) - 1)
    return head + body + b"".join(struct.pack("<IIQQQQ", *r) + bytes(24) for r in rows)


def test_elf_and_packages(spark, tmp_path):
    data = small_elf(["libx.so.1", "liby.so"], [("A_new", False), ("B_new", True), ("A_new", True)], b"\0hello world\0abc\0\x01text")
    (tmp_path / "libs").mkdir()
    (tmp_path / "libs" / "a.so").write_bytes(data)
    (tmp_path / "libs" / "bad.so").write_bytes(b"\x7fELF\x02\x01")
    (tmp_path / "libs" / "no.txt").write_bytes(b"text")
    files = elf.files(spark, str(tmp_path / "libs"))
    good, bad = sorted(elf.facts(files).collect(), key=lambda r: r.path)
    assert (good.arch, good.kind, good.needed, [(s.name, s.defined) for s in good.symbols]) == ("aarch64", "shared", ["libx.so.1", "liby.so"], [("A_new", False), ("B_new", True)])
    assert bad.error
    assert [(r.offset, r.text) for r in elf.strings(files).collect()] == [(1, "hello world"), (18, "text")]
    assert elf.delimited(b"\0one1\0two2") == ["one1"]
    inner, outer = tmp_path / "in.hap", tmp_path / "out.app"
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("libs/arm64-v8a/a.so", data)
        z.writestr("module.json", '{"app": {"bundleName": "b", "versionCode": 3}, "module": {"name": "m"}}')
    with zipfile.ZipFile(outer, "w") as z:
        z.write(inner, "in.hap")
    members = packages.expand(spark.createDataFrame([("out.app", outer.read_bytes()), ("broken.hap", b"x")], "path string, content binary"))
    assert [(r.package, r.abi, r.library) for r in packages.native_libraries(members).collect()] == [("out.app!in.hap", "arm64-v8a", "a.so")]
    assert [(r.bundle, r.version, r.version_code, r.devices) for r in packages.metadata(members).collect()] == [("b", "0.0.0", 3, [])]


def test_call_sites(spark):
    c = 'int own(int a) {\n  // A_new(1)\n  return A_new(a,\n     "A_new(2)") + own2(1);\n}\nstatic int own2(int x) { if (x) { B_new(x); } own(3); return 0; }\nint g = B_new(4);\n'
    rust = "fn run() { ffi::A_new(1); let x = B_new(2); }"
    src = spark.createDataFrame([("a.c", c), ("b.rs", rust), ("c.txt", c), ("d.c", None)], "file string, text string")
    got = {(r.file, r.caller, r.line, r.symbol, r.args) for r in calls.extract(src, ["A_new", "B_new", "own"]).collect()}
    assert got == {("a.c", "own", 3, "A_new", 'a, "A_new(2)"'), ("a.c", "own2", 6, "B_new", "x"), ("a.c", "<file_scope>", 7, "B_new", "4"), ("b.rs", "run", 1, "A_new", "1"), ("b.rs", "run", 1, "B_new", "2")}


def test_text_tables(spark):
    maps = ["7f00-7f01 r-xp 00000000 fd:00 1 /lib/a.so", "7f01-7f02 r-xp 0 fd:00 1 /lib/b.so.1 (deleted)", "7f03-7f04 rw-p 0 00:00 0 [heap]", "7f05-7f06 r-xp 0 fd:00 1 /lib/a.so"]
    rows = text_tables.mapped_libraries(spark.createDataFrame([(1, i, t) for i, t in enumerate(maps)], "pid int, position int, line string")).collect()
    assert sorted((r.path, r.deleted) for r in rows) == [("/lib/a.so", False), ("/lib/b.so.1", True)]
    xml = '<manifest><default remote="d"/><project name="n" path="p/q"/><project name="m" remote="r"/></manifest>'
    assert sorted(tuple(r) for r in text_tables.manifest_projects(spark.createDataFrame([(xml,)], "text string")).collect()) == [("m", "m", "r"), ("n", "p/q", "d")]


def test_sinks_and_rescan(spark, tmp_path):
    df = spark.range(5).selectExpr("id", "concat('=', id) as t")
    sinks.spreadsheet(str(tmp_path / "w.xlsx"), {"A/b": df, "none": df.limit(0)}, rows=2)
    with zipfile.ZipFile(tmp_path / "w.xlsx") as z:
        sheets = [n for n in z.namelist() if n.startswith("xl/worksheets/")]
        assert len(sheets) == 4 and "'=0" in z.read("xl/worksheets/sheet1.xml").decode()
    assert sinks.sheet_names(["x" * 40, "x" * 40, "a:b"]) == ["x" * 31, "x" * 29 + "_2", "a_b"]
    sinks.write(df, str(tmp_path / "p"), "parquet")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 5
    with pytest.raises(ValueError):
        sinks.write(df, str(tmp_path / "q"), "doc")
    src = spark.createDataFrame([("a", 5), ("b", 5), ("c", 1)], "name string, modified int")
    assert sorted(r.name for r in rescan.stale(src, spark.createDataFrame([("a", 4), ("b", 6)], "name string, modified int")).collect()) == ["a", "c"]
    assert list(itertools.islice(iter(sheets), 1))
