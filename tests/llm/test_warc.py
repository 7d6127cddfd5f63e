"""WARC writer and reader: round trip, determinism, rolling, revisits and damage."""

import glob
import gzip
import hashlib
import os
import random

import pytest

from linkscope.llm import warc_shards as ws
from tests.llm.helpers import prose

SCHEMA = "page_id long, url string, html string"


def pages_of(n, seed=3):
    r = random.Random(seed)
    shared = [f"<html>{prose(i, 40)}</html>" for i in range(4)]
    rows = [(i, f"http://h{i % 7}.org/{i} é\r\nX: 1", r.choice([None, "", "tiny", "tiny", f"<p>{prose(i, r.randrange(60))}</p>", *shared])) for i in range(n)]
    return rows + [(None, "http://a", shared[0]), (None, None, shared[1]), (None, None, None), (None, "u", "lone " * 30), (None, "v", "lone " * 30), rows[5], (77, "http://a", shared[2]), (77, "http://b", shared[2]), (77, "http://b", shared[2]), (5000, "big", "z漢" * 400000)]


def expected(rows):
    low = {}
    for i, _, t in rows:
        k = (i is None, i or 0)
        if t and len(t.encode()) >= 100:
            low[t] = min(k, low.get(t, k))
    out, taken = [], set()
    for i, u, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (t or "").encode()
        first = t not in low or (low[t] == (i is None, i or 0) and t not in taken)
        if first:
            taken.add(t)
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "response" if first else "revisit", None if first or low[t][0] else low[t][1]))
    return sorted(map(str, out))


def plain(df):
    return sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in df.collect())


def content(folder):
    return {os.path.relpath(p, folder): open(p, "rb").read() for p in glob.glob(f"{folder}/*/*") + glob.glob(f"{folder}/*.json")}


@pytest.mark.parametrize("unit,file_bytes", [(64, 1), (1 << 12, 3000), (1 << 30, 1 << 30)])
def test_round_trip(spark, tmp_path, unit, file_bytes):
    rows = pages_of(300)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], f"{SCHEMA}, body string, shard int")
    files = ws.write(df, f"{tmp_path}/a", file_bytes=file_bytes, unit=unit).collect()
    assert plain(ws.read(spark, f"{tmp_path}/a")) == expected(rows)
    got = ws.read(spark, f"{tmp_path}/a", payloads=True).where("record_type = 'response'").collect()
    assert {bytes(r.payload) for r in got} == {(t or "").encode() for _, _, t in rows}
    assert sum(f.records for f in files) == len(rows) and all(os.path.getsize(f"{tmp_path}/a/{f.name}") == f.bytes for f in files)
    if file_bytes == 1:
        assert len(files) == len(rows)
    # ids ascend from file to file, nulls last
    ids = []
    for p in sorted(glob.glob(f"{tmp_path}/a/data/*")):
        with open(p, "rb") as f:
            ids += [ws.page_of(*x)[0] for x in ws.records(f) if x[0]["warc-type"] != "warcinfo"]
    assert ids == sorted(ids, key=lambda i: (i is None, i or 0)) and os.listdir(f"{tmp_path}/a/_temporary") == []


def test_files_do_not_depend_on_partitions(spark, tmp_path):
    rows = pages_of(200)
    for name, parts in (("a", 1), ("b", 7)):
        random.Random(parts).shuffle(rows)
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        try:
            ws.write(spark.createDataFrame(rows, SCHEMA).repartition(parts), f"{tmp_path}/{name}", file_bytes=2000, unit=1 << 10)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
    a = content(f"{tmp_path}/a")
    assert a == content(f"{tmp_path}/b") and len(a) > 20
    # writing a shard again, as a second attempt does, changes nothing
    ws.write(spark.createDataFrame(rows, SCHEMA), f"{tmp_path}/a", file_bytes=2000, unit=1 << 10)
    assert a == content(f"{tmp_path}/a")


def test_records_are_plain_warc(spark, tmp_path):
    ws.write(spark.createDataFrame([(1, "http://x/ y", "p" * 120), (2, "http://x/\r\nEvil: 1", "p" * 120)], SCHEMA), f"{tmp_path}/a")
    (path,) = glob.glob(f"{tmp_path}/a/data/*")
    text = gzip.open(path).read().decode()
    assert text.count("WARC/1.1\r\n") == 3 and "Evil" not in [line.split(":")[0] for line in text.split("\r\n")]
    with open(path, "rb") as f:
        _, (first, _), (second, block) = ws.records(f)
    assert second["warc-refers-to"] == first["warc-record-id"] and second["warc-payload-digest"] == first["warc-payload-digest"] and block.endswith(b"\r\n\r\n")
    assert first["warc-target-uri"] == "http://x/%20y"


def test_damage_is_found(spark, tmp_path):
    ws.write(spark.createDataFrame(pages_of(20), SCHEMA), f"{tmp_path}/a", unit=1 << 30)
    (path,) = glob.glob(f"{tmp_path}/a/data/*")
    data = bytearray(open(path, "rb").read())
    data[len(data) // 2] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(Exception, match="damaged|manifest|rror"):
        ws.read(spark, f"{tmp_path}/a").collect()
    os.remove(f"{tmp_path}/a/manifest.json")
    with pytest.raises(FileNotFoundError):
        ws.read(spark, f"{tmp_path}/a")


def test_empty_table(spark, tmp_path):
    assert ws.write(spark.createDataFrame([], SCHEMA), f"{tmp_path}/a").collect() == []
    assert ws.read(spark, f"{tmp_path}/a").collect() == []
