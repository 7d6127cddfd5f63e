import struct
import zipfile

import pytest

from linkscope import __main__ as command
from linkscope.operators import banners, resolve, summary
from linkscope.plans import sinks
from linkscope.sources import diagnostics, headers, machine_code, reports, repositories


def placed_elf(machine, sections, imports):
    """A 64-bit file of sections (name, kind, address, content), with imported symbols in its dynamic table."""
    strings, dynsym = b"\0", bytes(24)
    for name in imports:
        dynsym += struct.pack("<IBBHQQ", len(strings), 0x12, 0, 0, 0, 0)
        strings += name.encode() + b"\0"
    rows, names, body = [(0,) * 6], b"\0", b""
    for name, kind, address, content in [*sections, (".dynsym", 11, 0, dynsym), (".dynstr", 3, 0, strings)]:
        rows.append((len(names), kind, 0, address, 64 + len(body), len(content)))
        names += name.encode() + b"\0"
        body += content
    rows.append((len(names), 3, 0, 0, 64 + len(body), len(names) + 10))
    body += names + b".shstrtab\0"
    head = b"\x7fELF" + bytes([2, 1, 1]) + bytes(9) + struct.pack("<HHIQQQIHHHHHH", 3, machine, 1, 0, 0, 64 + len(body), 0, 64, 0, 0, 64, len(rows), len(rows) - 1)
    return head + body + b"".join(struct.pack("<IIQQQQ", *r) + bytes(24) for r in rows)


def test_names_handed_to_dlsym(spark):
    relocation = struct.pack("<QQq", 0, 1 << 32 | 7, 0) + struct.pack("<QQq", 0, 2 << 32 | 7, 0)
    rodata = b"\0\0\0\0SSL_new\0EVP_x\0bad\x01name\0"
    # entry 1 of the table, after its header: adrp x1, add x1, bl
    page, place = 0x5000, 0x1000
    adrp = 0x90000000 | ((page - place) >> 12 & 3) << 29 | ((page - place) >> 14) << 5 | 1
    add = 0x91000000 | 4 << 10 | 1 << 5 | 1
    target = 0x2000 + 32 + 16
    bl = 0x94000000 | ((target - (place + 12)) // 4 & 0x3FFFFFF)
    code = struct.pack("<IIII", adrp, 0xD503201F, add, bl)
    arm = placed_elf(183, [(".text", 1, place, code), (".plt", 1, 0x2000, bytes(64)), (".rela.plt", 4, 0, relocation), (".rodata", 1, page, rodata)], ["free", "dlsym"])
    lea = b"\x48\x8d\x35" + struct.pack("<i", page + 12 - (place + 7))
    call = b"\xe8" + struct.pack("<i", 0x2000 + 16 + 16 - (place + 8 + 5))
    intel = placed_elf(62, [(".text", 1, place, lea + b"\x90" + call), (".plt", 1, 0x2000, bytes(64)), (".rela.plt", 4, 0, relocation), (".rodata", 1, page, rodata)], ["free", "dlsym"])
    without = placed_elf(62, [(".text", 1, place, lea + call)], ["free"])
    files = spark.createDataFrame([("arm", arm), ("intel", intel), ("none", without), ("bad", arm[:30])], "path string, content binary")
    assert sorted(tuple(r) for r in machine_code.dlsym_arguments(files).collect()) == [("arm", "SSL_new"), ("intel", "EVP_x")]
    assert machine_code.intel_arguments(b"\xe8", 0, 0) == set() and machine_code.arm_arguments(b"", 0, 0) == set()


def test_macros_and_version(spark):
    text = '#define SSL_set(a) a\n# define _hidden(a) a\n#define EVP_old EVP_new\n#define mine other\n#define STACK_OF(t) t\nstatic ossl_unused ossl_inline int BIO_go(int a)\nDEFINE_STACK_OF(X509)\nDEFINE_STACK_OF(t1)\ngenerate_lhash_macros("ERR_S")\n#define OPENSSL_VERSION_STR "3.1.0"\n'
    h = spark.createDataFrame([("i/opensslv.h", text), ("i/b.h", None)], "file string, text string")
    got = {(r.kind, r.name) for r in headers.macros(h).collect()}
    plain = {g for g in got if not g[0].endswith("template")}
    assert plain == {("explicit_define", "SSL_set"), ("alias_define", "EVP_old"), ("inline_function", "BIO_go")}
    assert {n for k, n in got if k == "sk_template"} == {f"sk_X509_{e}" for e in headers.STACK}
    assert {n for k, n in got if k == "lh_template"} == {f"lh_ERR_S_{e}" for e in headers.HASH}
    assert headers.version(h).first().version == "3.1.0"
    assert headers.version(h.where("file = 'i/b.h'"), "/src/openssl-1.1.1k/include").first().version == "1.1.1k"
    assert headers.version(h.limit(0), "/src").first().version == "unknown"


def test_descriptions(spark):
    readme = "# Title\n\n[![badge](x)](y)\n```\ncode\n```\n| a | b |\n----\nFirst   line\nsecond line\n\nnext paragraph"
    rows = [
        ("a", "README.md", readme), ("a", "package.json", '{"description": "no"}'),
        ("b", "README.md", "# only\n```\nopen code\n"), ("b", "package.json", '{"description": 5, "name": " n  m "}'),
        ("c", "package.json", "{broken"), ("c", "Cargo.toml", '[package]\ndescription = "from toml"\n'),
        ("d", "bundle.json5", "{ summary: 'json five' }"), ("e", "main.c", "int x;"), ("f", "README.md", None),
        ("g", "package.json", '{"package": {"description": "inner"}}'), ("h", "Readme.md", "x" * 400),
    ]
    got = {r.repo: r.purpose for r in repositories.descriptions(spark.createDataFrame(rows, "repo string, name string, text string")).collect()}
    assert got == {"a": "First line second line", "b": "n m", "c": "from toml", "d": "json five", "f": "", "g": "inner", "h": "x" * 300}


def test_manifest_follows_includes(spark, tmp_path):
    (tmp_path / "m.xml").write_text('<manifest><remote name="o" fetch="http://h/"/><default remote="o"/><project name="n" path="p"/><project name="x"/><include name="i.xml"/><include name="gone.xml"/></manifest>')
    (tmp_path / "i.xml").write_text('<manifest><remote name="r" fetch="http://r"/><project name="q" path="p2" remote="r"/><project name="n2" path="p"/><project name="z" path="p3" remote="no"/><include name="m.xml"/></manifest>')
    got = {tuple(r) for r in repositories.manifest(spark, str(tmp_path), "m.xml").collect()}
    assert got == {("p", "n2", "http://h/n2"), ("p2", "q", "http://r/q"), ("p3", "z", "")}


def test_supplied_tables(spark, tmp_path):
    (tmp_path / "map.json").write_text('{"one": ["/bin/a", "b"], "two": ["a"]}')
    assert {tuple(r) for r in reports.component_mapping(spark, str(tmp_path / "map.json")).collect()} == {("a", "two"), ("b", "one")}
    (tmp_path / "c.json").write_text('{"mapping": {"S": {"status": "partial", "notes": "n"}, "T": {}}}')
    assert {tuple(r) for r in reports.compatibility(spark, str(tmp_path / "c.json")).collect()} == {("S", "partial"), ("T", "unknown")}
    (tmp_path / "no.json").write_text('{"other": 1}')
    with pytest.raises(ValueError):
        reports.compatibility(spark, str(tmp_path / "no.json"))
    (tmp_path / "p.json").write_text('{"groups": {"g": ["a", "b", "a"], "h": "text"}}')
    assert {tuple(r) for r in reports.pattern_groups(spark, str(tmp_path / "p.json")).collect()} == {("g", "a"), ("g", "b")}


def test_spreadsheets_read_back(spark, tmp_path):
    titles = dict(zip(reports.COLUMNS.values(), ["f.c", "f.c", "main", 3, "SSL_new", "ssl_core", "a, b"], strict=True))
    df = spark.createDataFrame([tuple(titles.values()), ("g.c", "g.c", "go", 4, "EVP_x", "crypto_evp", "")], [f"`{t}`".strip("`") for t in titles])
    sinks.spreadsheet(str(tmp_path / "w.xlsx"), {"OpenSSL Call Sites": df, "Other": df}, rows=1)
    raw = spark.read.format("binaryFile").load(str(tmp_path / "w.xlsx"))
    got = {(r.project, r.file_path, r.line, r.symbol, r.args) for r in reports.spreadsheet_calls(raw).collect()}
    assert {g[:4] for g in got} == {("w", "f.c", 3, "SSL_new"), ("w", "g.c", 4, "EVP_x")} and len(got) == 2


def test_diagnostics_and_recovery(spark):
    text = "int a;\nvoid f(void) {\n  SSL_new(ctx;\n  EVP_x(1);\n}\nint b = 0;\n"
    src = spark.createDataFrame([("a.c", text), ("ok.c", "void g(void) { h(1); }\n"), ("n.c", None), ("e.c", "")], "file string, text string")
    found = diagnostics.diagnostics(src)
    assert [(r.file, r.line, r["class"]) for r in found.collect()] == [("a.c", 3, "unclosed-call-or-parameter-list")]
    names = spark.createDataFrame([("SSL_new",), ("EVP_x",), ("SSL_ne",)], "symbol string")
    seen = spark.createDataFrame([("a.c", "EVP_x", 4)], "file string, symbol string, line int")
    assert [(r.symbol, r.line, r.confidence) for r in diagnostics.recovered(found, names, seen).collect()] == [("SSL_new", 3, "fallback")]


def test_dlopen_levels(spark):
    frame = lambda rows: spark.createDataFrame(rows, "file string, symbol string")
    raw = frame([(f, s) for f in "abc" for s in ("x", "y")] + [("d", str(i)) for i in range(5)])
    got = lambda strict: {tuple(r) for r in banners.dlopen_symbols(raw, frame([("a", "x")]), frame([("a", "y"), ("b", "y"), ("d", "1")]), strict=strict).collect()}
    sure = {("a", "x", "high"), ("a", "y", "high"), ("d", "1", "high")}
    assert got(True) == sure
    assert got(False) == sure | {(f, s, "inferred") for f in "bc" for s in "xy"}


def test_banner_signals(spark):
    s = spark.createDataFrame([("a", "OpenSSL 1.1.1k  25 Mar 2021"), ("a", "ENGINESDIR: x"), ("b", "OpenSSL 3.0.2"), ("c", "OpenSSL 3.0.2"), ("c", "OPENSSLDIR: /x"), ("c", "SSL_connect"), ("d", "hello")], "file string, text string")
    probes = spark.createDataFrame([(x,) for x in banners.SENTINELS], "symbol string")
    got = {r.file: (r.library, r.version, r.signals) for r in banners.banners(s, probes).collect()}
    assert got == {"a": ("OpenSSL", "1.1.1k", ["enginesdir", "version_banner_strict"]), "b": (None, None, None), "c": ("OpenSSL", "3.0.2", ["corroborating_symbols_1", "openssldir", "version_banner_loose"])}


def test_target_lists_and_discovery(spark):
    lines = spark.createDataFrame(list(enumerate(["# c", " a ", "b", "", "a"])), "position int, line string")
    assert {tuple(r) for r in resolve.target_list(lines).collect()} == {("a", 1), ("b", 2)}
    files = spark.createDataFrame([("/l/libssl.so.3", 2), ("/k/libssl.so", 1), ("/l/libcrypto.so.3", 3), ("/l/libcrypto.a", 0)], "path string, ord int")
    assert {tuple(r) for r in resolve.discovered(files).collect()} == {("ssl", "/k/libssl.so"), ("crypto", "/l/libcrypto.so.3")}


def test_descendants_of_cycles(spark):
    e = spark.createDataFrame([("r", "a"), ("a", "b"), ("b", "r"), ("r", "b")], "src string, dst string")
    got = {(r.node, r.depth) for r in summary.descendants(e, spark.createDataFrame([("r",)], "node string")).collect()}
    assert got == {("r", 0), ("a", 1), ("b", 1)}


def test_command_line(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.c").write_text("int f(int x) { return SSL_new(x); }\n")
    (tmp_path / "names.txt").write_text("# names\nSSL_new\n")
    run = lambda *w: command.main([*map(str, w), "-o", str(tmp_path / "out")], spark)
    assert run("source", tmp_path / "src", "--symbols", tmp_path / "names.txt", "--recover-parser-diagnostics") == 0
    assert [r.symbol for r in spark.read.parquet(str(tmp_path / "out" / "call_sites")).collect()] == ["SSL_new"]
    assert run("source-probe", tmp_path / "src", "--symbols", tmp_path / "names.txt") == 0
    assert spark.read.parquet(str(tmp_path / "out" / "folders")).first().n_files == 1
    old = '{"meta": {"report_type": "source_scan"}, "call_sites": [{"file_path": "a.c", "caller_function": "f", "ossl_symbol": "SSL_new", "line_number": 1, "call_args": "x", "category": "ssl_core"}]}'
    (tmp_path / "old.json").write_text(old)
    (tmp_path / "new.json").write_text(old.replace("SSL_new", "SSL_free"))
    assert run("source-diff", tmp_path / "old.json", tmp_path / "old.json") == 0
    assert run("source-diff", tmp_path / "old.json", tmp_path / "new.json") == 1
    assert command.main([str(tmp_path / "src"), "--symbols", str(tmp_path / "names.txt"), "-o", str(tmp_path / "s.xlsx"), "-f", "xlsx"], spark) == 0
    assert zipfile.is_zipfile(tmp_path / "s.xlsx")
