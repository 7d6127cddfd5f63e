"""Sharded WARC writer whose files depend on the rows alone, and the reader of such a folder.

Pages are sorted by id over shards.  The borders of the shards come from a sample that a hash of the rows draws, weighted
by bytes, so neither partitions, executors nor retries move them.  A shard's task writes one gzip member a record
and rolls to a new file when the file has FILE_BYTES compressed.  Headers, record ids, digests and lengths are made anew
from the payload.  Of equal payloads of LEAST bytes and more one is a response, that of the smallest id; the
others are revisits that hold its id and no payload.  Payloads are exchanged once, by shard; what tells revisits from
responses is found on digests and meets the pages as small rows in the order of the shard.

A file is written under a temporary name and moved when it is closed, and a shard counts when its manifest
(files, sizes, digests, records), written the same way, is there.  A task that runs twice writes the same bytes under the same
names.  write() ends with a manifest of the whole, without which read() refuses the folder.

Defined cases: a null payload is empty; null ids come last, and a revisit of a page without id has no refers_to; of rows
of one id and payload the one whose url hashes lowest counts as the smaller, of rows equal in all three the first is the
response; a null or empty url is about:blank; other columns stay out; an empty table makes one shard with no file; a
record larger than FILE_BYTES has a file of its own; payloads are held whole, one at a time.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkscope.llm.common import cut, hash_share, joined, small_batches

#: Smallest payload that can be revisited, and compressed bytes from which a file is closed.
LEAST, FILE_BYTES = 100, 1 << 30
#: Bytes of a shard grow with the square root of all bytes: UNIT * number of shards.
UNIT = 1 << 16
#: Sampled rows for each shard, about, to find the borders.
SAMPLES = 16
LEVEL, DATE = 6, "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "manifest.json"


def record_id(page: int | None, url_hash: int, digest: str, again: int) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{page} {url_hash} {digest} {again}'.encode()).digest()[:16], version=5)}>"


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record: version, named fields, the block's digest and length, the block."""
    fields = [*fields, ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(page: int | None, url: str | None, url_hash: int, payload: bytes, again: int, target: tuple | None, date: str) -> bytes:
    """Response, or revisit of the target (page, url_hash, again)."""
    digest = hashlib.sha256(payload).hexdigest()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    uri = quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else "about:blank"
    fields = [("WARC-Type", "response" if target is None else "revisit"), ("WARC-Record-ID", record_id(page, url_hash, digest, again)), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if target is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(target[0], target[1], digest, 0))]
        fields += [("Page-Refers-To", str(target[0]))] if target[0] is not None else []
    fields += [("Page-ID", str(page))] if page is not None else []
    fields.append(("Content-Type", "application/http;msgtype=response"))
    return record(fields, head if target is not None else head + payload)


def member(data: bytes, level: int) -> bytes:
    made = zlib.compressobj(level, zlib.DEFLATED, 31)
    return made.compress(data) + made.flush()


class Folder:
    """A folder that all machines share, by its address; files appear in it whole or not at all."""

    def __init__(self, folder: str) -> None:
        self.files, self.root = pyarrow.fs.FileSystem.from_uri(folder)

    def begin(self) -> tuple[str, pa.NativeFile]:
        self.files.create_dir(f"{self.root}/_temporary", recursive=True)
        name = f"{self.root}/_temporary/{uuid.uuid4().hex}"
        return name, self.files.open_output_stream(name)

    def settle(self, temporary: str, name: str) -> None:
        """Give a closed file its name; what another attempt has left there is the same."""
        whole = f"{self.root}/{name}"
        self.files.create_dir(whole.rsplit("/", 1)[0], recursive=True)
        if self.files.get_file_info(whole).type != pyarrow.fs.FileType.NotFound:
            self.files.delete_file(whole)
        self.files.move(temporary, whole)

    def drop(self, temporary: str) -> None:
        if self.files.get_file_info(temporary).type != pyarrow.fs.FileType.NotFound:
            self.files.delete_file(temporary)

    def put(self, name: str, data: bytes) -> None:
        temporary, out = self.begin()
        with out:
            out.write(data)
        self.settle(temporary, name)


class Roll:
    """The files of one shard, one after another."""

    def __init__(self, folder: Folder, shard: int, file_bytes: int, level: int, date: str) -> None:
        self.folder, self.shard, self.file_bytes, self.level, self.date = folder, shard, file_bytes, level, date
        self.done, self.out = [], None

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.name = f"data/shard-{self.shard:05d}-{len(self.done):05d}.warc.gz"
            self.temporary, self.out = self.folder.begin()
            self.size, self.records, self.digest = 0, 0, hashlib.sha256()
            about = f"software: linkscope\r\nformat: WARC File Format 1.1\r\npart: {self.name.rsplit('/', 1)[1]}\r\n".encode()
            self._write(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, 0, self.name, 0)), ("WARC-Date", self.date), ("WARC-Filename", self.name.rsplit("/", 1)[1]), ("Content-Type", "application/warc-fields")], about))
        self._write(data)
        self.records += 1
        if self.size >= self.file_bytes:
            self.close()

    def _write(self, data: bytes) -> None:
        packed = member(data, self.level)
        self.out.write(packed)
        self.digest.update(packed)
        self.size += len(packed)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.folder.settle(self.temporary, self.name)
            self.done.append({"name": self.name, "bytes": self.size, "records": self.records, "sha256": self.digest.hexdigest()})
            self.out = None

    def commit(self) -> list[dict]:
        self.close()
        self.folder.put(f"shards/{self.shard:05d}.json", json.dumps({"shard": self.shard, "files": self.done}).encode())
        return self.done

    def abandon(self) -> None:
        if self.out is not None:
            self.out.close()
            self.folder.drop(self.temporary)


FILES = "shard int, name string, bytes long, records long, sha256 string"
KEY = ["away", "id", "u"]


def borders(light: DataFrame, shards: int, n: int) -> list[tuple]:
    """Keys at which the shards after the first begin, by a sample that depends on the rows alone; about SAMPLES rows a shard reach the driver."""
    sampled = light.where(hash_share("id", "u", "th") < min(1.0, SAMPLES * shards / max(n, 1))).select(*KEY, "size").orderBy(*KEY, "size").collect()
    each = sum(r["size"] + 512 for r in sampled) / shards
    found, seen = [], 0.0
    for r in sampled:
        if seen >= each * (len(found) + 1) and len(found) < shards - 1:
            found.append((r.away, r.id or 0, r.u))
        seen += r["size"] + 512
    return found


def write(pages: DataFrame, folder: str, id: str = "page_id", url: str = "url", payload: str = "html", file_bytes: int = FILE_BYTES, level: int = LEVEL, date: str = DATE, unit: int = UNIT) -> DataFrame:
    """Writes the archive into a new folder, which all machines must share, and returns its files (shard, name, bytes, records, sha256).

    folder: a path or an address that pyarrow.fs knows (file, hdfs, s3, gs).  id: a whole number.
    """
    spark = pages.sparkSession
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    key = pages.select(F.col(id).isNull().alias("away"), F.col(id).cast("long").alias("id"), F.xxhash64(url).alias("u"), F.xxhash64(body).alias("th"), F.col(url).cast("string").alias("url"), body.alias("body"))
    light = cut(key.select(*KEY, "th", F.unhex(F.sha2("body", 256)).alias("digest"), F.length("body").cast("long").alias("size")))
    n, total = light.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    shards = max(1, min(n, int(((total + 512 * n) / unit) ** 0.5)))
    bounds = spark.sparkContext.broadcast(borders(light, shards, n))

    @F.pandas_udf("int")
    def shard_of(away: pd.Series, number: pd.Series, hashed: pd.Series) -> pd.Series:
        return pd.Series([bisect.bisect_right(bounds.value, x) for x in zip(away, number, hashed, strict=True)], dtype="int32")

    placed = lambda df: df.withColumn("shard", shard_of("away", F.coalesce("id", F.lit(0)), "u"))
    first = F.min(F.struct(*KEY)).alias("first")
    copies = cut(light.where(F.col("size") >= LEAST).groupBy("digest").agg(first, F.count("*").alias("times")).where("times > 1"))
    told = joined(light.where(F.col("size") >= LEAST).select(*KEY, "th", "digest"), copies, ["digest"], "times", ["id", "u"]).where(~F.struct(*KEY).eqNullSafe(F.col("first")))
    told = told.select(*KEY, "th", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("body"), F.col("first.id").alias("to_id"), F.col("first.u").alias("to_u"), F.lit(0).alias("kind")).dropDuplicates([*KEY, "th"])
    rows = key.select("*", F.lit(None).cast("long").alias("to_id"), F.lit(None).cast("long").alias("to_u"), F.lit(1).alias("kind"))
    rows = placed(told).unionByName(placed(rows)).repartitionById(shards, "shard").sortWithinPartitions("shard", *KEY, "th", "kind")

    def run(batches):
        roll, last, again, target = None, None, 0, None
        try:
            for batch in batches:
                columns = [batch.column(batch.schema.get_field_index(c)) for c in ("shard", *KEY, "th", "kind", "to_id", "to_u", "url")]
                bodies = batch.column(batch.schema.get_field_index("body"))
                for i, (shard, away, page, u, th, kind, to_id, to_u, address) in enumerate(zip(*(c.to_pylist() for c in columns), strict=True)):
                    if kind == 0:
                        target, told_of = (to_id, to_u), (page, u, th)
                        continue
                    roll = roll or Roll(Folder(folder), shard, file_bytes, level, date)
                    data = bodies[i].as_py()
                    here = (page, u, th)
                    again = again + 1 if here == last else 0
                    to = target if target is not None and told_of == here else (page, u) if again and len(data) >= LEAST else None
                    roll.add(page_record(page, address, u, data, again, to, date))
                    last = here
            if roll is not None:
                rows = [(roll.shard, f["name"], f["bytes"], f["records"], f["sha256"]) for f in roll.commit()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=[f.split()[0] for f in FILES.split(", ")])
        except BaseException:
            if roll is not None:
                roll.abandon()
            raise

    small_batches(spark)
    files = cut(rows.mapInArrow(run, FILES))
    sums = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("records"), F.lit(0)).alias("records"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.countDistinct("shard").alias("shards")).first()
    if sums.records != n:
        raise RuntimeError(f"{sums.records} records were written of {n} pages")
    Folder(folder).put(MANIFEST, json.dumps(sums.asDict()).encode())
    return files


class Counted:
    """A stream that digests what is read from it."""

    def __init__(self, stream) -> None:
        self.stream, self.digest, self.size = stream, hashlib.sha256(), 0

    def read(self, n: int = -1) -> bytes:
        data = self.stream.read(n if n >= 0 else None)
        self.digest.update(data)
        self.size += len(data)
        return data


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields, by lower-case name, and block of each record of a gzip file."""
    with gzip.GzipFile(fileobj=stream) as f:
        while line := f.readline():
            if not line.startswith(b"WARC/"):
                raise ValueError("not a WARC record")
            fields = {}
            while (line := f.readline()) not in (b"\r\n", b""):
                name, _, value = line.decode().partition(":")
                fields[name.strip().lower()] = value.strip()
            block = f.read(int(fields["content-length"]))
            if f.read(4) != b"\r\n\r\n" or fields["warc-block-digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
                raise ValueError(f"damaged record {fields.get('warc-record-id')}")
            yield fields, block


def page_of(fields: dict[str, str], block: bytes) -> tuple:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest and payload (none for a revisit)."""
    head, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(line.split(b":")[1]) for line in head.split(b"\r\n") if line.lower().startswith(b"content-length:"))
    digest, kind = fields["warc-payload-digest"].removeprefix("sha256:"), fields["warc-type"]
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged payload {fields.get('warc-record-id')}")
    number = lambda name: int(fields[name]) if name in fields else None
    return number("page-id"), fields["warc-target-uri"], kind, number("page-refers-to"), size, digest, payload if kind == "response" else None


PAGE = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def read(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """The pages of an archive that write() has finished; digests and lengths of files, blocks and payloads are checked on the way."""
    held = Folder(folder)
    with held.files.open_input_stream(f"{held.root}/{MANIFEST}") as f:
        sums = json.loads(f.read())
    if not sums["files"]:
        return spark.createDataFrame([], PAGE + ", payload binary" * payloads)
    one = F.from_json("value", "shard int, files array<struct<name:string,bytes:long,records:long,sha256:string>>")
    shards = spark.read.text(f"{folder}/shards", wholetext=True).select(one.alias("m")).select("m.*")
    listed = shards.select("shard", F.explode("files").alias("f")).select("shard", "f.*")
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = [f.split()[0] for f in (PAGE + ", payload binary").split(", ")]

    def run(batches):
        held = Folder(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with held.files.open_input_stream(f"{held.root}/{row['name']}", compression=None) as raw:
                    counted, found, size, n = Counted(raw), [], 0, 0
                    for fields, block in records(counted):
                        if fields["warc-type"] == "warcinfo":
                            continue
                        page = page_of(fields, block)
                        found.append(page if payloads else page[:-1])
                        size, n = size + len(block) * payloads, n + 1
                        if len(found) == 1024 or size > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=False)], names=names[: len(found[0])])
                            found, size = [], 0
                    counted.read()
                    if (counted.size, counted.digest.hexdigest(), n) != (row["bytes"], row["sha256"], row["records"]):
                        raise ValueError(f"{row['name']} is not what its manifest says")
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=False)], names=names[: len(found[0])])

    return listed.repartitionById(max(1, min(sums["shards"], 1 << 16)), "shard").mapInArrow(run, PAGE + ", payload binary" * payloads)
