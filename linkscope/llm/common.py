"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkscope.operators.lineage import CLEANUP, releasing  # noqa: F401

#: Columns of the documents table, in its order.
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a folder of its own only where that is unset and all runs on this machine."""
    context = spark.sparkContext
    if named := context.getConf().get("spark.checkpoint.dir"):
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="checkpoint-")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder; the shuffle files that led to it are deleted."""
    spark, context = df.sparkSession, df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(spark))
    with releasing(spark):
        return df.select("*").checkpoint()


#: Most keys that count as hot, and the parts that a hot key's rows are dealt over.
HOT, SALTS = 4096, 64


def joined(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, by: list[str]) -> DataFrame:
    """rows joined with a table that has one row for each key and the number of that key's rows in weight.

    No key's rows meet in one task: keys of more than one in HOT of all rows are HOT at most, so they can be broadcast
    as a flag; their rows are dealt over SALTS parts by a hash of the columns by, and their table rows are repeated
    for each part.  table is read several times and should be cut.  Neither keys nor weight may be null.
    """
    total = table.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    is_hot = F.col(weight) * HOT > total
    salt, parts = fresh("salt", rows.columns + table.columns), fresh("parts", rows.columns + table.columns)
    hot = table.where(is_hot).select(*keys, F.lit(SALTS).alias(parts))
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn(salt, F.pmod(F.hash(*by), F.coalesce(parts, F.lit(1)))).drop(parts)
    each = table.withColumn(salt, F.explode(F.sequence(F.lit(0), F.when(is_hot, F.lit(SALTS - 1)).otherwise(F.lit(0)))))
    return dealt.join(each, [*keys, salt]).drop(salt)


#: Most words, of 64 bits each, of a sieve, and its bits for each key while there are no more.
SIEVE_WORDS, SIEVE_BITS = 1 << 19, 16


def sieve(rows: DataFrame, keys: DataFrame, by: list[str], into: str) -> DataFrame:
    """rows with one more column: false only where no row of keys has the same in the columns by, nulls taken as equal.

    A broadcast bitmap of bounded size says so, thus no row is exchanged; true may be wrong, the more often the more keys
    there are.  keys are read twice and should be cut; the columns by need the same types in both.
    """
    words = min(SIEVE_WORDS, keys.count() * SIEVE_BITS // 64 + 1)
    at, word, bits = (fresh(n, [*rows.columns, *keys.columns, into]) for n in ("at", "word", "bits"))
    placed = lambda df: df.withColumn(at, F.pmod(F.xxhash64(*by), F.lit(64 * words))).withColumn(word, F.shiftright(at, 6))
    bitmap = placed(keys).groupBy(word).agg(F.expr(f"bit_or(shiftleft(1L, cast({at} & 63 as int)))").alias(bits))
    found = F.expr(f"shiftrightunsigned({bits}, cast({at} & 63 as int)) & 1") == 1
    return placed(rows).join(F.broadcast(bitmap), word, "left").withColumn(into, F.coalesce(found, F.lit(False))).drop(at, word, bits)


def fresh(name: str, taken: list[str]) -> str:
    """A column name like the given one that no column has yet, upper and lower case alike."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


#: Most rows and bytes of an Arrow batch; a text longer than that is a batch by itself.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1024, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's limits of Arrow batches to those of BATCH, so that a task holds a few MB of texts at once."""
    for key, most in BATCH.items():
        now = re.match(r"\d+", spark.conf.get(key))
        if now is None or not 0 < int(now[0]) <= most:
            spark.conf.set(key, str(most))


def annotate(df: DataFrame, text: str, fn: Callable[[pa.Array], list], fields: list[T.StructField], into: str, after: Callable[[], None] | None = None) -> DataFrame:
    """df with one more struct column, computed by fn from whole batches of the text column.

    fn gets the batch's texts as an Arrow array and returns, for each field, an Arrow array
    of as many values.  Runs map-side only; the other columns pass through untouched.
    """
    small_batches(df.sparkSession)
    position = df.columns.index(text)
    schema = T.StructType([*df.schema.fields, T.StructField(into, T.StructType(fields), False)])
    names = [f.name for f in fields]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                made = pa.StructArray.from_arrays(fn(batch.column(position)), names=names)
                yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, into])
        if after is not None:
            after()
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def hash_share(*columns) -> F.Column:
    """A number from 0 up to 1 that depends on the columns alone; for samples of bounded expected size."""
    return (F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))).cast("double")
