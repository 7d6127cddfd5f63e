"""Inputs of commands: saved maps in several files, names in JSON, and projects inside projects."""

import json

from linkscope import __main__ as command


def test_lines_of_maps_are_numbered_in_their_file(spark, tmp_path):
    line = "7f00-7f01 r-xp 00000000 08:01 12 {}\n"
    (tmp_path / "maps").mkdir()
    (tmp_path / "maps" / "a.txt").write_text("".join(line.format(x) for x in ("/l/z.so", "[heap]", "/l/a.so (deleted)", "/l/a.so")))
    (tmp_path / "maps" / "b.txt").write_text("".join(line.format(x).replace("\n", "\r\n") for x in ("/l/c.so.1", "/l/z.so")))
    assert command.main(["proc", str(tmp_path / "maps"), "--pid", "7", "--include-deleted", "-o", str(tmp_path / "out")], spark) == 0
    rows = spark.read.parquet(str(tmp_path / "out" / "libraries")).collect()
    assert {(r.pid, r.path, r.deleted, r.position) for r in rows} == {(7, "/l/z.so", False, 0), (7, "/l/a.so", True, 2), (7, "/l/c.so.1", False, 0)}


def test_names_of_json_and_nested_projects(spark, tmp_path):
    (tmp_path / "names.json").write_text(json.dumps({"symbols": ["SSL_new", "EVP_x", "SSL_new"]}))
    for path in ("p/a.c", "p/q/r/b.c", "pq/c.c", "top.c"):
        (tmp_path / "src" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "src" / path).write_text("int f(int x) { return SSL_new(x); }\n")
    words = ["combo-scan", str(tmp_path / "src"), "--symbols", str(tmp_path / "names.json"), "-o", str(tmp_path / "out")]
    assert command.main(words, spark) == 0
    rows = spark.read.parquet(str(tmp_path / "out" / "call_sites")).collect()
    found = sorted((r.project, r.file.split("/src/")[-1]) for r in rows)
    projects = {r.project for r in rows}
    # as many rows as a plain loop over projects and files has
    assert found == sorted((p, f) for p in projects for f in ("p/a.c", "p/q/r/b.c", "pq/c.c", "top.c") if f.startswith(p + "/")) and {"p", "pq"} <= projects
