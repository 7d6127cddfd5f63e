"""Packages read member by member."""

import io
import zipfile

import pytest

from linkscope.sources import archives, packages

ELF = b"\x7fELF" + b"x" * 60


def packed(entries, kind=zipfile.ZIP_DEFLATED) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", kind) as z:
        for name, data in entries:
            z.writestr(name, data)
    return out.getvalue()


@pytest.fixture
def folder(spark, tmp_path):
    limit = "spark.sql.sources.binaryFile.maxLength"
    # no package can be a cell here
    spark.conf.set(limit, "1")
    (tmp_path / "p").mkdir()
    yield tmp_path / "p"
    spark.conf.unset(limit)


def rows(spark, folder):
    return {(r.package.split("/p/")[-1], r.entry): (r.content and bytes(r.content), r.error) for r in archives.members(spark, str(folder)).collect()}


def test_rules_of_endings(spark, folder):
    hap = packed([("libs/arm64-v8a/a.so", ELF), ("libs/x86/a.so", ELF + b"2"), ("libs/x86/t.txt", b"text"), ("module.json", b"{}"), ("in.hap", b"not followed"), ("libs/../b.so", ELF)])
    for name, data in (("one.hap", hap), ("one.har", hap), ("two.HSP", hap), ("other.txt", hap)):
        (folder / name).write_bytes(data)
    (folder / "x y%20#.app").write_bytes(packed([("libs/x86/own.so", ELF), ("module.json", b"{1}"), ("e/n.hap", hap), ("n.har", hap), ("bad.hsp", b"?")], zipfile.ZIP_STORED))
    deep = packed([("libs/x86/d.so", ELF)])
    (folder / "z.zip").write_bytes(packed([("libs/x86/z.so", ELF), ("q/m.zip", packed([("n.har", deep), ("a.app", deep)])), ("__MACOSX/n.hap", deep)]))
    own = {("libs/arm64-v8a/a.so", ELF), ("libs/x86/a.so", ELF + b"2"), ("libs/x86/t.txt", None), ("module.json", b"{}")}
    expected = {(p, e): (c, None) for p in ("one.hap", "one.har", "two.HSP", "x y%20#.app!e/n.hap") for e, c in own}
    expected |= {("x y%20#.app", "module.json"): (b"{1}", None), ("x y%20#.app!bad.hsp", None): (None, "BadZipFile: File is not a zip file"), ("z.zip", "libs/x86/z.so"): (ELF, None), ("z.zip!q/m.zip!n.har", "libs/x86/d.so"): (ELF, None)}
    assert rows(spark, folder) == expected
    assert archives.errors(archives.members(spark, str(folder))).count() == 1
    with pytest.raises(ValueError):
        archives.members(spark, str(folder / "other.txt"))


def test_same_as_in_memory(spark, folder):
    hap = packed([(f"libs/x86/{i}.so", ELF + bytes([i])) for i in range(50)] + [("module.json", b"{}")])
    data = packed([("a.hap", hap), ("b.hsp", hap), ("libs/x86/a.so", ELF)])
    (folder / "w.zip").write_bytes(data)
    path = f"file:{folder / 'w.zip'}"
    old = packages.expand(spark.createDataFrame([(path, data)], "path string, content binary"))
    key = ["package", "container", "depth", "entry", "size", "content"]
    new = archives.members(spark, str(folder))
    assert sorted(map(str, new.select(key).collect())) == sorted(map(str, old.select(key).collect())) and new.count() == 103
    assert new.rdd.getNumPartitions() > 1


def test_damaged_members_and_empty_folders(spark, folder):
    data = bytearray(packed([("libs/x86/a.so", ELF), ("libs/x86/b.so", ELF * 9)], zipfile.ZIP_STORED))
    data[data.index(ELF) + 20] ^= 1
    (folder / "c.hap").write_bytes(bytes(data))
    (folder / "no.hap").write_bytes(b"x")
    (folder / "empty.hap").write_bytes(b"")
    got = rows(spark, folder)
    assert got[("c.hap", "libs/x86/b.so")] == (ELF * 9, None) and got[("c.hap", "libs/x86/a.so")][0] is None and "CRC" in got[("c.hap", "libs/x86/a.so")][1] and "zip" in got[("no.hap", None)][1]
    (folder / "e").mkdir()
    (folder / "e" / "t.txt").write_text("")
    assert archives.members(spark, str(folder / "e")).count() == 0


def test_limits(spark, folder, monkeypatch):
    (folder / "c.hap").write_bytes(packed([("libs/x86/a.so", ELF * 4), ("module.json", b"{}")]))
    entry = archives.listed(archives.found(spark, str(folder)))
    assert {r.size for r in entry.collect()} == {256, 2}
    found = list(archives.directory(archives.Archives(), str(folder / "c.hap"), "c.hap"))
    assert [r[6] for r in found] == ["libs/x86/a.so", "module.json"]
    monkeypatch.setattr(archives, "LARGEST", 200)
    with pytest.raises(ValueError):
        list(archives.directory(archives.Archives(), str(folder / "c.hap"), "c.hap"))


def test_first_libraries(spark, folder):
    inner = packed([("libs/x86/libcrypto.so.9", ELF), ("libs/x86/libssl.so.9", ELF)])
    (folder / "a.zip").write_bytes(packed([("b.hap", packed([("libs/armeabi/libssl.so.1", ELF), ("libs/arm64-v8a/libssl.so.2", ELF)])), ("c.hap", inner), ("libs/odd/libcrypto.so.3", ELF), ("libs/x86/libcrypto.so.4", b"no")]))
    (folder / "none.hap").write_bytes(packed([("libs/x86/z.so", ELF)]))
    got = [(r.crypto.split("/p/")[-1], r.ssl.split("/p/")[-1]) for r in archives.first_libraries(archives.members(spark, str(folder))).collect()]
    assert got == [("a.zip!libcrypto.so.3", "a.zip!b.hap!libssl.so.2")]
