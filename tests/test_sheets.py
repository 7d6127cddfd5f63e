"""Fixed sheets of the scan's and the difference's workbooks, and trees on the command line."""

import json

from linkscope import __main__ as command
from linkscope.operators import classify, resolve
from linkscope.plans import sheets, workbook
from linkscope.sources import text_tables
from tests.test_operators import small_elf
from tests.test_workbook import read


def test_scan_workbook_and_trees(spark, tmp_path):
    (tmp_path / "bin").mkdir()
    (tmp_path / "sys" / "usr" / "lib").mkdir(parents=True)
    (tmp_path / "bin" / "app").write_bytes(small_elf(["libmid.so", "libc.so"], [], b""))
    (tmp_path / "bin" / "broken").write_bytes(b"\x7fELF\x02\x01")
    (tmp_path / "bin" / "libmid.so").write_bytes(small_elf(["libssl.so.3"], [("SSL_new", False), ("EVP_x", False)], b""))
    (tmp_path / "sys" / "usr" / "lib" / "libssl.so.3").write_bytes(small_elf([], [("SSL_new", True)], b""))
    (tmp_path / "names.txt").write_text("SSL_new\nEVP_x\n")
    words = ["scan", str(tmp_path / "bin"), "--symbols", str(tmp_path / "names.txt"), "--sysroot", str(tmp_path / "sys"), "--tree"]
    assert command.main([*words, "-f", "xlsx", "-o", str(tmp_path / "w.xlsx")], spark) == 0
    found = read(tmp_path / "w.xlsx")
    assert list(found) == ["Overview", "Files", "File-Symbol", "Import Chains", "By Category", "By Depth", "Dep Tree", "Errors"]
    over = {r[0]: r[1] for r in found["Overview"] if r[0]}
    assert found["Overview"][0][0] == "REPORT METADATA" and over["Report Type"] == "single" and over["Total ELF Files"] == "2" and over["Total OpenSSL Symbols (refs)"] == over["Unique OpenSSL Symbols"] == "2"
    files = {r[1]: dict(zip(found["Files"][0], r, strict=True)) for r in found["Files"][1:]}
    assert list(files) == ["app", "broken", "libmid.so"] and files["libmid.so"]["Symbol Count"] == "2" and files["libmid.so"]["Link Type"] == "dynamic-link" and files["app"]["Direct Dependencies"] == "libmid.so, libc.so"
    assert [r[1:] for r in found["File-Symbol"][1:]] == [["libmid.so", "EVP_x", "crypto_evp", "dynamic-link"], ["libmid.so", "SSL_new", "ssl_core", "dynamic-link"]]
    assert {(r[1], r[2], r[5]) for r in found["Import Chains"][1:]} == {("libmid.so", "EVP_x", "1"), ("libmid.so", "SSL_new", "1")}
    assert [r[:4] for r in found["By Category"][1:]] == [["crypto_evp", "1", "50.0%", "EVP_x"], ["ssl_core", "1", "50.0%", "SSL_new"], ["TOTAL", "2", "100%", None]]
    assert found["By Depth"][1:] == [["1", "Direct OpenSSL dependency (depth 1)", "2", "1", "EVP_x, SSL_new"]]
    # all files here are shared objects, so each is a root
    app = [r for r in found["Dep Tree"][1:]][:4]
    assert [r[:5] for r in app] == [["(root)", "app", "0", "No", "0"], ["app", "libmid.so", "1", "No", "2"], ["libmid.so", "libssl.so.3", "2", "Yes", "0"], ["app", "libc.so", "1", "No", "0"]]
    assert app[2][5] == str(tmp_path / "sys" / "usr" / "lib" / "libssl.so.3") and app[3][5] == "libc.so"
    assert [r[0] for r in found["Errors"][1:]] == ["WARNING"] and found["Errors"][1][1].endswith("broken")
    assert command.main([*words, "-o", str(tmp_path / "out")], spark) == 0
    assert {(r.depth, r.n_symbols) for r in spark.read.parquet(str(tmp_path / "out" / "tree_depths")).collect()} == {(0, 2), (1, 2)}
    assert spark.read.parquet(str(tmp_path / "out" / "tree_chains")).where("symbol = 'EVP_x'").count() == 2


def test_empty_scan_says_so(spark, tmp_path):
    (tmp_path / "bin").mkdir()
    (tmp_path / "bin" / "text").write_text("no program")
    (tmp_path / "names.txt").write_text("SSL_new\n")
    assert command.main(["scan", str(tmp_path / "bin"), "--symbols", str(tmp_path / "names.txt"), "-f", "xlsx", "-o", str(tmp_path / "w.xlsx")], spark) == 0
    found = read(tmp_path / "w.xlsx")
    assert {t: found[t][1][0] for t in ("Files", "File-Symbol", "Import Chains", "By Depth", "Errors")} == {"Files": sheets.NO_FILES, "File-Symbol": sheets.NO_SYMBOLS, "Import Chains": sheets.NO_CHAINS, "By Depth": sheets.NO_DEPTHS, "Errors": sheets.NO_ERRORS}
    assert [r[0] for r in found["Dep Tree"][1:]] == [sheets.NO_TREE, sheets.NEEDS_TREE] and found["By Category"][1][:2] == ["TOTAL", "1"]


def test_fingerprint_sheet(spark, tmp_path):
    strings = spark.createDataFrame([("/a.so", "s1"), ("/a.so", "s2"), ("/b.so", "s3"), ("/b.so", "other")], "path string, string string")
    marks = spark.createDataFrame([("x", "s1", 10, 15), ("x", "s2", 10, 15), ("y", "s3", 5, 50), ("y", "s4", 5, 50)], "category string, string string, per_point int, max_points int")
    parts = classify.fingerprint_parts(strings, marks, "path")
    assert {tuple(r) for r in parts.collect()} == {("/a.so", "x", 2, 2, 20, 15), ("/b.so", "y", 1, 2, 5, 5)}
    scores = classify.fingerprint_scores(strings, marks, "path")
    workbook.spreadsheet(str(tmp_path / "w.xlsx"), {"Fingerprint": sheets.fingerprints(scores, parts, marks.selectExpr("count(*) as total"))})
    rows = read(tmp_path / "w.xlsx")["Fingerprint"]
    assert rows[1] == ["a.so", "14.2", "low", "2", "4", "x", "2", "2", "20", "15"] and rows[2][0] == "b.so" and rows[4][:3] == ["HAP Max Score", "14.2", "a.so"]


def test_requests_that_repeat_keep_their_paths(spark):
    asked = spark.createDataFrame([("a", "/r", None, "/o", 1), ("a", "/r", None, "/o", 2), ("a", None, "$ORIGIN/l", "/o", 3), (None, None, None, None, 4)], "library string, rpath string, runpath string, origin string, n int")
    files = spark.createDataFrame([("/o/l/a",), ("/s/a",), ("/r/a",)], "path string")
    assert sorted((r.n, r.path) for r in resolve.resolve(asked, files, ["/s/"]).collect()) == [(1, "/r/a"), (2, "/r/a"), (3, "/o/l/a"), (4, None)]


def site(file, caller, symbol, line, args, category="ssl_core"):
    return {"file_path": file, "caller_function": caller, "ossl_symbol": symbol, "line_number": line, "call_args": args, "category": category}


def report(path, sites, **more):
    path.write_text(json.dumps({"meta": {"report_type": "source_scan"}, "call_sites": sites} | more))


def test_diff_workbook(spark, tmp_path):
    report(tmp_path / "old.json", [site("a.c", "f", "SSL_new", 3, "x"), site("a.c", "f", "SSL_new", 9, "y"), site("b.c", "g", "EVP_x", 1, "", "crypto_evp"), site("c.c", "k", "SSL_free", 1, "s")], summary={"total_files_scanned": 12})
    report(tmp_path / "new.json", [site("a.c", "f", "SSL_new", 4, "x"), site("a.c", "f", "SSL_new", 9, "z"), site("a.c", "h", "BIO_x", 2, "=1", "crypto_bio"), site("c.c", "k", "SSL_free", 1, "s")])
    words = ["source-diff", str(tmp_path / "old.json"), str(tmp_path / "new.json"), "-f", "xlsx", "-o", str(tmp_path / "w.xlsx")]
    assert command.main(words, spark) == 1
    found = read(tmp_path / "w.xlsx")
    assert list(found) == ["Summary Delta", "Symbol Delta", "File Delta", "Call Site Delta"]
    assert found["Summary Delta"][1:] == [["Files Scanned", "12", "0", "-12"], ["Files with Calls", "3", "2", "-1"], ["Call Sites", "4", "4", "0"], ["Unique Symbols", "3", "3", "0"], [None] * 4, ["[crypto_bio]", "0", "1", "1"], ["[crypto_evp]", "1", "0", "-1"], ["[ssl_core]", "2", "2", "0"]]
    assert found["Symbol Delta"][1:] == [["BIO_x", "crypto_bio", "added", "0", "1", "1"], ["EVP_x", "crypto_evp", "removed", "1", "0", "-1"]]
    assert found["File Delta"][1:] == [["b.c", "removed", "1", "0", "-1", "1", "0", "", "EVP_x"], ["a.c", "changed", "2", "3", "1", "1", "2", "BIO_x", ""]]
    assert [r[:4] + r[5:7] for r in found["Call Site Delta"][1:]] == [["added", "a.c", "h", "BIO_x", None, "2"], ["removed", "b.c", "g", "EVP_x", "1", None], ["moved", "a.c", "f", "SSL_new", "3", "4"], ["changed", "a.c", "f", "SSL_new", "9", "9"]]
    assert found["Call Site Delta"][1][8] == "'=1"
    assert command.main([*words[:2], str(tmp_path / "old.json"), "-f", "xlsx", "-o", str(tmp_path / "same.xlsx")], spark) == 0
    assert [len(s) for s in read(tmp_path / "same.xlsx").values()][1:] == [1, 1, 1]
    assert command.main([*words, "--include-unchanged"], spark) == 1
    assert len(read(tmp_path / "w.xlsx")["Symbol Delta"]) == 5


def test_diff_workbook_of_projects(spark):
    form = "project string, file string, line int, caller string, symbol string, category string, args string"
    old = spark.createDataFrame([("p", "a.c", 1, "f", "A", "c", ""), ("q", "a.c", 1, "f", "B", "c", ""), ("s", "a.c", 1, "f", "B", "c", "")], form)
    new = spark.createDataFrame([("p", "a.c", 1, "f", "A", "c", ""), ("r", "a.c", 1, "f", "B", "c", ""), ("s", "a.c", 1, "f", "B", "c", ""), ("s", "b.c", 1, "f", "A", "c", "")], form)
    found = {t: [tuple(r) for r in s.rows.collect()] for t, s in sheets.diff_sheets(old, new, True).items()}
    assert found["Summary Delta"][:3] == [("Files with Calls", 3, 4, 1), ("Call Sites", 3, 4, 1), ("Unique Symbols", 2, 2, 0)]
    assert [r[:5] for r in found["Project Delta"]] == [("q", "removed", 1, 0, -1), ("r", "added", 0, 1, 1), ("s", "changed", 1, 2, 1)] and found["Project Delta"][2][7:] == ("A", "")
    assert [r[0] for r in found["File Delta"]] == ["r/a.c", "s/b.c", "q/a.c"] and [r[:3] for r in found["Call Site Delta"]] == [("r", "added", "a.c"), ("s", "added", "b.c"), ("q", "removed", "a.c")]


def test_files_scanned_of_merged_reports(spark, tmp_path):
    report(tmp_path / "one.json", [], meta={"report_type": "combo_scan"}, projects=[{"project": "p", "total_files_scanned": 4}, {"project": "q"}, {"project": "r", "total_files_scanned": 5}])
    (tmp_path / "other.json").write_text('{"meta": {"report_type": "other"}, "summary": {"total_files_scanned": 99}}')
    (tmp_path / "broken.json").write_text("{")
    assert [text_tables.files_scanned(spark, str(tmp_path / f"{n}.json")).first().n_scanned for n in ("one", "other", "broken")] == [9, 0, 0]
