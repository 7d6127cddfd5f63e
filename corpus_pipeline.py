"""The corpus pipeline: documents through toxicity, near duplicates, decontamination, secrets and packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before has kept; between stages the
rows are written as Parquet and read again, so a stage's lineage starts at files.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from linkscope.llm import group_packing, jaccard_join, secret_scan, string_kernel_svm, winnowing
from linkscope.llm.common import shared_folder, table
from linkscope.llm.queries import RANKS, TOKENIZER


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the string-kernel machine rejects."""
    return string_kernel_svm.reject(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of linked shingle sets."""
    return jaccard_join.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold benchmark passages."""
    return winnowing.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts by a mark; every document stays."""
    return secret_scan.redact(docs, length="n_chars" if "n_chars" in docs.columns else None)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: one row per piece of a document."""
    return group_packing.pack(docs, RANKS, TOKENIZER)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("packing", packing)]

#: Training, set joins and packing have no SQL form; the stages are held against brute force in tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, with a Parquet folder between each two.

    The folders lie in the shared folder, below one of the run; when a stage's output is written its input is deleted,
    and the last one stays, as the rows that are returned are read from it.  A null text passes all stages as an
    empty one, repeated rows become one in near_duplicates unless they have no words, an empty table gives no rows,
    and columns of any other name go through to the packing, which returns its own.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    files = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if i:
            files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{i - 1}-{STAGES[i - 1][0]}"), True)
    return STAGES[-1][1](spark, docs, sf_dir)
