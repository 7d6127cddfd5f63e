"""The SQL of this subpackage's queries against the queries, also on rows that the given tables do not have."""

import glob
import os
import random

import duckdb
import pytest

from linkscope.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.helpers import DOC_SCHEMA, docs_of, odd_docs, prose
from tests.test_queries import plain


def compared(spark, name, folder):
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    df, expected = QUERIES[name](spark, folder), con.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(expected.columns)
    rows = df.collect()
    assert plain(df.columns, rows) == plain(expected.columns, expected.fetchall())
    return rows


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    assert compared(spark, name, sf_dir)


def test_quotes_of_several_levels_equal_sql(spark, tmp_path):
    r, rows = random.Random(7), []
    for c in range(30):
        said = []
        for t in range(r.randrange(2, 9)):
            lines = []
            for _ in range(r.randrange(0, 3)):
                if said:
                    passage, deep = r.choice(said), r.randrange(1, 5)
                    lines += [r.choice([">" * deep, "> " * deep, " >" * deep]) + " " + x.upper() if r.random() < 0.3 else ">" * deep + x for x in passage.split("\n")]
                    lines.append(r.choice(["", ">", "> > "]))
            own = "\n".join(prose(r.randrange(10**6), r.randrange(1, 5)) for _ in range(r.randrange(1, 3)))
            said.append(own)
            lines += own.split("\n") + r.choice([[], ["", "shared closing words"]])
            rows.append((c, t, "user", "\n".join(lines)))
    rows += [(99, 0, "user", "first"), (99, 1, "user", ">" * 100000 + " first\nx"), (99, 2, "user", ">" * 70 + "first\n> x"), (99, 3, None, None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    out = compared(spark, "op2_quote_links", str(tmp_path))
    assert max(x.depth for x in out) >= 3 and sum(x.n_linked for x in out) > 40
    assert {(x.turn, x.parent_turn) for x in out if x.conv_id == 99} == {(0, None), (1, 0), (2, 1), (3, None)}


def test_odd_documents_equal_sql(spark, tmp_path):
    odd_docs(spark).where("doc_id is not null").dropDuplicates(["doc_id"]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "same text here now"), (2, ""), (3, None), (4, prose(99, 30))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name in ("op3_winnowing", "op4_jaccard_join", "op11_mountain_manifest"):
        compared(spark, name, str(tmp_path))


def test_pipeline_of_odd_rows(spark, tmp_path):
    import corpus_pipeline

    for name, docs in (("odd", odd_docs(spark)), ("empty", spark.createDataFrame([], DOC_SCHEMA)), ("copies", spark.createDataFrame(docs_of([prose(1, 60)] * 3 + [None]) + docs_of([prose(1, 60)]), DOC_SCHEMA))):
        folder = tmp_path / name
        docs.write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
        spark.createDataFrame([(1, prose(3, 30))], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
        out = corpus_pipeline.run(spark, str(folder)).collect()
        assert {r.doc_id for r in out} == {"odd": {r.doc_id for r in docs.collect()} - {8, 9, 13, 14}, "empty": set(), "copies": {1, 4}}[name]
