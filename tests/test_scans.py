"""Whole scans: files, packages, releases, trees and command line."""

import zipfile

import pytest

from linkscope import __main__ as command
from linkscope.operators import classify, scan, trees
from linkscope.sources import calls, files, packages, reports
from tests.test_operators import small_elf

FILES = "package string, path string, symbols array<string>, dlsym array<string>, is_static boolean, confidence string, uses_dlopen boolean, dlopen_libs array<string>, libs array<string>, deps array<string>"


def row(package, path="x.so", symbols=(), dlsym=(), is_static=False, confidence="", uses_dlopen=False, dlopen_libs=(), libs=(), deps=()):
    return package, path, list(symbols), list(dlsym), is_static, confidence, uses_dlopen, list(dlopen_libs), list(libs), list(deps)


def kinds(spark, rows, bundled=(), releases=None):
    f = spark.createDataFrame(rows, FILES)
    b = spark.createDataFrame(list(bundled), "package string, library string")
    if releases is None:
        out = classify.package_methods(f, b)
    else:
        out = classify.in_release(f, b, spark.createDataFrame(releases, "package string, release string"))
    return {r.package: (r.method, r.kind) for r in out.collect()}


def test_methods_of_packages(spark):
    got = kinds(spark, [
        row("none"),
        row("dynamic", symbols=["a"]),
        row("static", symbols=["a"], is_static=True),
        row("loading", symbols=["a"], dlsym=["a"], uses_dlopen=True),
        row("mixed", symbols=["a"], is_static=True), row("mixed", symbols=["b"]),
        row("both", symbols=["a", "b"], dlsym=["a"], is_static=True, uses_dlopen=True),
        row("part", symbols=["a", "b"], dlsym=["a"], uses_dlopen=True),
        row("idle", uses_dlopen=True),
        row("library", uses_dlopen=True, dlopen_libs=["libssl.so"]),
        row("whole", symbols=["a"], libs=["libssl.so.1.1"]), row("lacking", symbols=["a"], libs=["libssl.so", "libcrypto.so"]),
        row("own", "libcrypto.so", is_static=True, confidence="high"), row("own", symbols=["a"], uses_dlopen=True, dlopen_libs=["/x/libcrypto.so.3"]),
    ], [("whole", "libssl.so"), ("lacking", "libssl.so")])
    assert got == {
        "none": ("None", "No-OpenSSL"), "dynamic": ("Dynamic", "System-Link"), "static": ("Static", "Self-Contained"), "loading": ("dlopen", "System-Link"),
        "mixed": ("Mixed", "System-Link"), "both": ("Mixed", "System-Link"), "part": ("Mixed", "System-Link"), "idle": ("None", "No-OpenSSL"), "library": ("dlopen", "System-Link"),
        "whole": ("Dynamic", "Self-Contained"), "lacking": ("Dynamic", "System-Link"), "own": ("Mixed", "Self-Contained"),
    }


def test_packages_of_a_release(spark):
    rows = [row("a", symbols=["s"], libs=["libssl.so"]), row("b"), row("c", symbols=["s"], libs=["libssl.so"]), row("d", symbols=["s"], deps=["libown.so"]), row("e", "l/libown.so", symbols=["s"], is_static=True, confidence="medium"), row("f", symbols=["s"], libs=["libcrypto.so"]), row("g")]
    releases = [("a", "1"), ("b", "1"), ("c", "2"), ("d", "3"), ("e", "3"), ("f", "1"), ("g", "2")]
    got = kinds(spark, rows, [("b", "libssl.so.3")], releases)
    # f needs a library that no sibling has; c and g bring none
    assert {k: v[1] for k, v in got.items()} == {"a": "In-APP-Link", "b": "No-OpenSSL", "c": "System-Link", "d": "In-APP-Link", "e": "Self-Contained", "f": "System-Link", "g": "No-OpenSSL"}


def plain_tree(root, follow, known, most):
    out, met = [], set()

    def visit(name, parent, depth, chain):
        error = trees.CIRCULAR if name in met else trees.TOO_DEEP if depth > most else trees.MISSING if name not in known else None
        out.append((len(out), name, parent, depth, chain, error))
        if error is None:
            met.add(name)
            for child in follow.get(name, []):
                visit(child, name, depth + 1, f"{chain} -> {child}")

    visit(root, None, 0, root)
    return out


def test_trees_are_those_of_a_plain_walk(spark):
    follow = {"r": ["a", "b", "lost"], "a": ["x", "r"], "b": ["x", "c"], "c": ["d"], "d": ["e"], "s": ["b"], "e": []}
    known = {"r", "a", "b", "c", "d", "e", "x", "s"}
    edges = spark.createDataFrame([(a, b, i) for a, bs in follow.items() for i, b in enumerate(bs)], "src string, dst string, position int")
    found = trees.trees(edges, spark.createDataFrame([("r",), ("s",), ("gone",)], "node string"), spark.createDataFrame([(k,) for k in known], "path string"), 3)
    rows = found.orderBy("root", "position").collect()
    for root in ("r", "s", "gone"):
        assert [tuple(r)[1:] for r in rows if r.root == root] == plain_tree(root, follow, known, 3)
    assert {(r.root, r.name, r.depth) for r in trees.first_places(found).collect() if r.root == "s"} == {("s", "s", 0), ("s", "b", 1), ("s", "x", 2), ("s", "c", 2), ("s", "d", 3), ("s", "e", 4)}
    names = spark.createDataFrame([("x", "S1"), ("d", "S2"), ("r", "S1")], "name string, symbol string")
    assert {tuple(r) for r in trees.symbols_by_depth(found, names).collect() if r[0] == "r"} == {("r", 0, 1), ("r", 2, 1), ("r", 3, 1)}
    assert {tuple(r) for r in trees.import_chains(found, names).collect() if r[0] == "r"} == {("r", "S1", "r"), ("r", "S1", "r -> a -> x"), ("r", "S2", "r -> b -> c -> d")}
    assert {tuple(r) for r in trees.has_library_below(found, spark.createDataFrame([("d",)], "name string")).collect()} == {("r", "r"), ("r", "b"), ("r", "c"), ("s", "s"), ("s", "b"), ("s", "c")}
    assert {r.path for r in trees.collected(found).collect()} == {"r", "a", "b", "x", "c", "d", "s"}


def test_any_bytes_are_read(spark, tmp_path):
    (tmp_path / "bad.c").write_bytes(b"int f(void) { return SSL_new(\xff\xfe); } // \x80\n")
    (tmp_path / "zero.c").write_bytes(b"int SSL_new(\0);")
    (tmp_path / "controls.c").write_bytes(b"\x01\x02\x03 SSL_new(1);")
    (tmp_path / "few.c").write_bytes(b"\x01 void g() { SSL_new(2); }")
    (tmp_path / "empty.c").write_bytes(b"")
    (tmp_path / "x.txt").write_bytes(b"SSL_new(3);")
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git" / "h.c").write_bytes(b"void g() { SSL_new(4); }")
    got = {r.file.rsplit("/", 1)[-1]: r.text for r in files.texts(spark, str(tmp_path)).collect()}
    assert set(got) - {"empty.c"} == {"bad.c", "few.c", "x.txt"} and "�" in got["bad.c"]
    sites = calls.extract(files.texts(spark, str(tmp_path)), ["SSL_new"]).collect()
    assert sorted(r.file.rsplit("/", 1)[-1] for r in sites) == ["bad.c", "few.c"]
    assert {r.file.rsplit("/", 1)[-1]: r.error.split(":")[0] for r in files.rejected(spark, str(tmp_path), list(calls.LANGUAGES)).collect()} == {"zero.c": "Not a text file", "controls.c": "Not a text file", "x.txt": "Unsupported extension"}


def test_arrays_of_figures_are_no_sources(spark):
    figures = "0x11, " * 10000
    rows = [("a.c", figures + "SSL_new(1);"), ("b.c", "0x1 static " + figures + "\nvoid g() { SSL_new(1); }"), ("c.c", "0x1, void g() { SSL_new(1); }")]
    found = calls.extract(spark.createDataFrame(rows, "file string, text string"), ["SSL_new"]).collect()
    assert sorted(r.file for r in found) == ["b.c", "c.c"]


def test_interfaces_and_names_of_libraries(spark):
    arm, intel = small_elf([], [], b""), small_elf([], [], b"").replace(b"\xb7\x00", b"\x3e\x00", 1)
    rows = [("p", "libs/x86_64/a.so", intel), ("p", "libs/arm64-v8a/a.so", arm), ("p", "libs/odd/a.so", arm), ("p", "libs/x86_64/b.so", arm), ("p", "libs/x86/c.txt", b"text")]
    found = packages.native_libraries(spark.createDataFrame(rows, "package string, entry string, content binary"))
    assert {(r.abi, r.library): r.fits for r in found.collect()} == {("x86_64", "a.so"): True, ("arm64-v8a", "a.so"): True, ("odd", "a.so"): True, ("x86_64", "b.so"): False}
    assert [(r.abi, r.place) for r in packages.interfaces(found).orderBy("place").collect()] == [("arm64-v8a", 1), ("x86_64", 2), ("odd", 3)]
    assert {r["name"] for r in packages.distinct_names(found).collect()} == {"a.so", "a_2.so", "a_3.so", "b.so"}
    assert packages.of_interface(found, "odd").count() == 1
    with pytest.raises(ValueError):
        packages.of_interface(found, "mips")


def test_marks_that_are_parts_of_strings(spark):
    strings = spark.createDataFrame([("f", "x one y"), ("f", "one"), ("f", "two"), ("g", "twofold")], "file string, string string")
    marks = spark.createDataFrame([("c", "one", 20.0, 100.0, "substring"), ("d", "two", 30.0, 100.0, "exact")], "category string, string string, per_point double, max_points double, mode string")
    assert {(r.file, r.matched, r.confidence) for r in classify.fingerprint_scores(strings, marks).collect()} == {("f", 2, "medium")}


def test_scan_of_files(spark, tmp_path):
    folder = tmp_path / "lib"
    folder.mkdir()
    (folder / "app").write_bytes(small_elf(["libmid.so"], [("main", False)], b""))
    (folder / "libmid.so").write_bytes(small_elf(["libssl.so.3"], [("SSL_new", False)], b""))
    (folder / "libown.so").write_bytes(small_elf([], [(n, True) for n in ("SSL_new", "SSL_free", "EVP_a", "BIO_b", "PEM_c", "X509_d")], b"OpenSSL 1.1.1k  25 Mar 2021\0"))
    (folder / "loads").write_bytes(small_elf([], [("dlopen", False), ("dlsym", False)], b"\0SSL_new\0SSL_free\0EVP_a\0libcrypto.so.3\0"))
    (folder / "libssl.so.3").write_bytes(small_elf([], [("SSL_new", True)], b""))
    (tmp_path / "names.txt").write_text("SSL_new\nSSL_free\nEVP_a\nBIO_b\nPEM_c\nX509_d\n")
    (tmp_path / "own.txt").write_text("main\n")
    out = str(tmp_path / "out")
    assert command.main(["scan", str(folder), "--symbols", str(tmp_path / "names.txt"), "--add", str(tmp_path / "own.txt"), "-o", out], spark) == 0
    got = {r.path.rsplit("/", 1)[-1]: r for r in spark.read.parquet(f"{out}/files").collect()}
    assert (got["libmid.so"].is_direct, got["libmid.so"].symbols, got["libmid.so"].is_static) == (True, ["SSL_new"], False)
    assert (got["libown.so"].is_static, got["libown.so"].confidence, got["libown.so"].static_version) == (True, "high", "1.1.1k")
    assert got["libown.so"].reason == "version_banner: 1.1.1k (6 exported)"
    assert (got["loads"].uses_dlopen, sorted(got["loads"].dlsym), got["loads"].dlopen_libs) == (True, ["EVP_a", "SSL_free", "SSL_new"], ["libcrypto.so.3"])
    assert got["app"].is_transitive and not got["app"].is_direct and got["app"].symbols == ["main"]
    totals = spark.read.parquet(f"{out}/totals").first()
    assert (totals.n_files, totals.arch) == (5, "aarch64")
    assert {(r.symbol, r.depth) for r in spark.read.parquet(f"{out}/chains").collect() if r.src.endswith("app")} == {("main", 2)}
    report = {r.path.rsplit("/", 1)[-1]: r for r in spark.read.parquet(f"{out}/report").collect()}
    assert report["loads"].dlopen_detection.dlopen_libs == ["libcrypto.so.3"] and report["app"].openssl_deps.transitive and report["app"].dlopen_detection is None
    # the exports of a library as the dimension, and a list of targets
    (tmp_path / "targets.txt").write_text(f"# one\n{folder}/libmid.so\n")
    assert command.main(["scan", str(folder), "--openssl-lib", str(folder / "libssl.so.3"), "--from-file", str(tmp_path / "targets.txt"), "-o", out], spark) == 0
    assert [(r.path.rsplit("/", 1)[-1], r.symbols) for r in spark.read.parquet(f"{out}/files").collect()] == [("libmid.so", ["SSL_new"])]


def test_packages_on_the_command_line(spark, tmp_path):
    (tmp_path / "names.txt").write_text("SSL_new\n")
    uses = small_elf(["libssl.so.3"], [("SSL_new", False)], b"")
    for name, libraries in (("a", {"arm64-v8a/libx.so": uses}), ("b", {"arm64-v8a/libssl.so": small_elf([], [], b""), "x86/libx.so": uses})):
        with zipfile.ZipFile(tmp_path / f"{name}.hap", "w") as z:
            z.writestr("module.json", '{"app": {"bundleName": "same", "versionCode": 1}, "module": {}}')
            for entry, data in libraries.items():
                z.writestr(f"libs/{entry}", data)
    out = str(tmp_path / "out")
    assert command.main(["hap", str(tmp_path), "--symbols", str(tmp_path / "names.txt"), "-o", out], spark) == 0
    got = {r.package.rsplit("/", 1)[-1]: (r.method, r.kind, r.bundled, r.usage) for r in spark.read.parquet(f"{out}/packages").collect()}
    assert got == {"a.hap": ("Dynamic", "In-APP-Link", "false", "In-APP-Link"), "b.hap": ("Dynamic", "Self-Contained", "true", "Bundled")}
    report = '{"meta": {"report_type": "package", "package": {"package_path": "P", "bundle_name": "b", "version_code": 1, "bundled_openssl": "Yes (static)", "bundled_openssl_files": []}}, "files_detail": [{"path": "l.so", "openssl_symbols_used": ["SSL_new", "EVP_x"], "static_openssl": true, "static_openssl_confidence": "high", "dlopen_detection": {"uses_dlopen": true, "dlopen_symbols": ["EVP_x"]}}]}'
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "p.json").write_text(report)
    (tmp_path / "j" / "other.json").write_text('{"meta": {"report_type": "single"}}')
    (tmp_path / "j" / "broken.json").write_text("{")
    assert command.main(["hap-summary", str(tmp_path / "j"), "-o", out], spark) == 0
    r = spark.read.parquet(f"{out}/packages").first()
    assert (r.package, r.method, r.kind, r.n_static, r.n_dlopen, r.usage, r.top_category) == ("P", "Mixed", "System-Link", 1, 1, "Bundled (static)", "ssl_core")
    assert reports.package_files(spark, str(tmp_path / "j")).count() == 1


def test_projects_on_the_command_line(spark, tmp_path):
    root = tmp_path / "root"
    for path, text in (("curl/src/a.c", "int f() { return SSL_new(1); }"), ("curl/lib/b.c", "int g() { return mine(1) + SSL_new(2); }"), ("zlib/z.c", "int h() { return 0; }"), ("old/x/y.c", "int k() { return SSL_new(3); }")):
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    (tmp_path / "names.txt").write_text("SSL_new\n")
    (tmp_path / "own.txt").write_text("mine\n")
    out = str(tmp_path / "out")
    assert command.main(["combo-scan", str(root), "--symbols", str(tmp_path / "names.txt"), "--add", str(tmp_path / "own.txt"), "--exclude", "old", "-o", out], spark) == 0
    assert {(r.project, r.n_calls) for r in spark.read.parquet(f"{out}/projects").collect()} == {("curl", 3), ("TOTAL", 3)}
    assert {r.category for r in spark.read.parquet(f"{out}/call_sites").collect()} == {"ssl_core", "COSTOM"}
    site = '{"file_path": "%s/a.c", "caller_function": "f", "ossl_symbol": "SSL_new", "line_number": 1, "call_args": "x", "category": "ssl_core"}'
    for name in ("one", "two"):
        (tmp_path / f"{name}.json").write_text('{"meta": {"report_type": "source_scan"}, "call_sites": [' + site % f"/{name}" + "]}")
    both = ["source-diff", str(tmp_path / "one.json"), str(tmp_path / "two.json"), "-o", out]
    assert command.main(both, spark) == 1
    assert command.main([*both, "--old-prefix", "/one", "--new-prefix", "/two"], spark) == 0


def test_rules_of_small_functions(spark):
    mapped = spark.createDataFrame([(1, "/a"), (1, "/b"), (2, "/a")], "pid int, path string")
    assert {tuple(r) for r in scan.runtime_only(mapped, spark.createDataFrame([(1, "/a")], "pid int, path string")).collect()} == {(1, "/a", False), (1, "/b", True), (2, "/a", True)}
    kept, left = scan.without_bundled(spark.createDataFrame([("p", "l/libssl.so"), ("p", "l/LIBCRYPTO.so.3"), ("p", "l/libcrypto.a")], "package string, path string"))
    assert [r.path for r in kept.collect()] == ["l/libcrypto.a"] and left.count() == 2


def test_documents_and_columns(spark, tmp_path):
    import json

    from linkscope.plans import sinks

    rows = spark.createDataFrame([(1, ["a"], None), (2, [], "é")], "n int, l array<string>, t string")
    sinks.document(str(tmp_path / "d.json"), {"meta": {"k": 1}, "rows": rows, "none": rows.limit(0)})
    assert json.loads((tmp_path / "d.json").read_text()) == {"meta": {"k": 1}, "rows": [{"n": 1, "l": ["a"]}, {"n": 2, "l": [], "t": "é"}], "none": []}
    assert [sinks.column_letter(n) for n in (1, 26, 27, 702, 703)] == ["A", "Z", "AA", "ZZ", "AAA"]


def test_new_files_are_scanned_once(spark, tmp_path):
    from linkscope.streaming import rescan

    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for name in ("a.c", "b.c"):
        (source / name).write_text("x")
        rescan.watch(spark, str(source), out, str(tmp_path / "seen"), lambda batch: batch.select("path", "length")).awaitTermination()
    assert sorted(r.path.rsplit("/", 1)[-1] for r in spark.read.parquet(out).collect()) == ["a.c", "b.c"]
