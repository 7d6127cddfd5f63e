"""Running processes: this machine's, and a folder laid out like one."""

import os
import socket

import pytest

from linkscope import __main__ as command
from linkscope.sources import processes

MAPS = """7f00-7f01 r--p 00000000 08:01 11 /usr/lib/libssl.so.3
7f01-7f02 r-xp 00001000 08:01 11 /usr/lib/libssl.so.3
7f02-7f03 r-xp 00000000 08:01 12 /opt/my lib/libold.so (deleted)
7f03-7f04 rw-p 00000000 00:00 0
7f04-7f05 r-xp 00000000 08:01 13 /usr/bin/tool
7f05-7f06 rw-p 00000000 00:00 0 [heap]
"""


@pytest.fixture
def root(tmp_path):
    for pid, name in (("17", "tool"), ("18", "Tool"), ("20", "kernel thread")):
        at = tmp_path / "proc" / pid
        at.mkdir(parents=True)
        (at / "status").write_text(f"Name:\t{name}\nUid:\t{pid}\t0\t0\t0\nVmRSS:\t   42 kB\nThreads:\t3\n")
    (tmp_path / "proc" / "17" / "maps").write_text(MAPS)
    (tmp_path / "proc" / "17" / "cmdline").write_bytes(b"tool\0-v\0\xff\0")
    (tmp_path / "proc" / "17" / "exe").symlink_to("/usr/bin/tool")
    (tmp_path / "proc" / "19").mkdir()  # ended meanwhile
    (tmp_path / "proc" / "self").mkdir()
    return str(tmp_path / "proc")


def test_fields_and_libraries(spark, root):
    found = processes.running(spark, tasks=3, root=root)
    rows = {r.pid: r for r in found.collect()}
    assert sorted(rows) == [17, 18, 20] and found.count() == 3
    one = rows[17]
    assert (one.host, one.name, one.exe, one.cmdline, one.uid, one.threads, one.rss_kb) == (socket.gethostname(), "tool", "/usr/bin/tool", "tool -v �", 17, 3, 42)
    assert (rows[20].name, rows[20].exe, rows[20].cmdline, rows[20].maps) == ("kernel thread", None, "", None)
    assert sorted((r.pid, r.path, r.deleted) for r in processes.libraries_of(found).collect()) == [(17, "/opt/my lib/libold.so", True), (17, "/usr/lib/libssl.so.3", False)]
    assert [r.pid for r in processes.running(spark, name="tool", tasks=2, root=root).collect()] == [17]
    assert processes.running(spark, pid=19, tasks=2, root=root).count() == 0


def test_this_machine(spark):
    me = processes.running(spark, pid=os.getpid(), tasks=4)
    row = me.first()
    assert me.count() == 1 and row.uid == os.getuid() and "python" in row.exe and row.rss_kb > 0
    loaded = {r.path for r in processes.libraries_of(me).collect()}
    with open("/proc/self/maps") as f:
        mapped = {line.split(maxsplit=5)[5].strip() for line in f if len(line.split(maxsplit=5)) == 6}
    assert loaded and loaded <= {m.removesuffix(" (deleted)") for m in mapped}


def test_command(spark, tmp_path):
    out = str(tmp_path / "out")
    assert command.main(["proc", "--pid", str(os.getpid()), "-o", out], spark) == 0
    assert spark.read.parquet(out + "/processes").first().pid == os.getpid()
    assert spark.read.parquet(out + "/libraries").count() > 0
    assert command.main(["proc", "--name", "no such process", "-o", out], spark) == 2
