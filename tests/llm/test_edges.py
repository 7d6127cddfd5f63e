"""Odd rows, empty tables and clashing columns through every operator."""

import zlib

import pytest

from linkscope.llm import gear_chunks, group_packing, jaccard_join, multi_index, ppm_language, quote_links, secret_scan, string_kernel_svm, token_counts, winnowing
from linkscope.llm.queries import PIECES, RANKS, TOKENIZER
from tests.llm.helpers import DOC_SCHEMA, component_ids, odd_docs

LABELS = "doc_id long, quality int, toxic int"


def labels(spark):
    return spark.createDataFrame([(1, None, None), (None, 1, 1), (4, 1, 1), (4, 0, 0), (6, 0, 0), (7, 1, 0), (9, 1, 0)], LABELS)


def benchmark(spark):
    return spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "same text here now again", "x"), (4, "same text here", "x"), (5, "same text here", "x")], "item_id long, text string, n_words string")


OPERATORS = {
    "winnowing": lambda s, d: winnowing.digest(winnowing.find(d, benchmark(s), into="found"), "found"),
    "jaccard": lambda s, d: jaccard_join.classes(d).select("doc_id", "n_shingles", "component_id"),
    "language": lambda s, d: ppm_language.query(d),
    "toxicity": lambda s, d: string_kernel_svm.query(d, labels(s)),
    "packing": lambda s, d: group_packing.pack(d, RANKS, TOKENIZER).where("piece = 0"),
    "secrets": lambda s, d: secret_scan.digest(secret_scan.scan(d, into="found"), "found"),
    "tokens": lambda s, d: token_counts.query(d, PIECES),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_give_a_row_each(spark, name):
    docs = odd_docs(spark)
    assert OPERATORS[name](spark, docs).count() == docs.count()


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    out = OPERATORS[name](spark, spark.createDataFrame([], DOC_SCHEMA))
    assert out.collect() == [] and "doc_id" in out.columns


def test_filters_keep_columns_and_clean_rows(spark):
    docs = odd_docs(spark)
    for out in (winnowing.decontaminate(docs, benchmark(spark)), string_kernel_svm.reject(docs, spark.createDataFrame([], LABELS)), secret_scan.redact(docs, length="n_chars"), jaccard_join.deduplicate(docs)):
        assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    assert string_kernel_svm.reject(docs, spark.createDataFrame([], LABELS)).count() == docs.count()
    assert secret_scan.redact(docs).exceptAll(docs).count() == 0
    kept = winnowing.decontaminate(docs, benchmark(spark)).select("text").collect()
    assert len(kept) == docs.count() - 3 and not any("same text" in (r[0] or "").lower() for r in kept)


@pytest.mark.parametrize("upper", [False, True])
def test_columns_of_any_name(spark, upper):
    """Names that the operators give their own columns, in both cases of letters."""
    clash = ["id_", "th_", "rest_", "met", "gone", "th", "rest", "root", "key", "size", "made", "wide", "secrets", "component", "times", "salt", "parts", "at", "word", "bits"]
    docs = odd_docs(spark, clash=[c.upper() for c in clash] if upper else clash)
    out = jaccard_join.deduplicate(docs)
    assert out.columns == docs.columns and out.count() == jaccard_join.deduplicate(odd_docs(spark, clash=("x",))).count()
    redacted = secret_scan.redact(docs, length="n_chars")
    assert redacted.columns == docs.columns and redacted.exceptAll(docs).count() == 0
    assert winnowing.decontaminate(docs, benchmark(spark)).columns == docs.columns


def test_many_secrets_in_a_long_text(spark):
    """Places and pieces of a text of many spans; a text's cost is in proportion to its length."""
    parts = ["password=abcdef12", " plain 漢 ", "AKIA" + "Z9" * 9, "\n", "0123456789abcdef" * 2, " x ", "token: 'deadbeefdeadbeefdeadbeef'", "."]
    text = "".join(parts) * 20000 + "end"
    docs = spark.createDataFrame([(1, text, len(text))], "doc_id long, text string, n_chars int")
    found = secret_scan.digest(secret_scan.scan(docs)).first()
    assert (found.n_assign, found.n_access, found.n_hex) == (40000, 20000, 40000)
    spans = [s.split(":") for s in found.spans.split(",")]
    assert all(len(text[int(a) : int(b)]) in (17, 22, 32, 24, 31) for _, a, b in spans)
    out = secret_scan.redact(docs, length="n_chars").first()
    one = "[SECRET] plain 漢 [SECRET]\n[SECRET] x [SECRET]'."
    assert out.text in (one * 20000 + "end", one.replace("]'.", "].") * 20000 + "end") and out.n_chars == len(out.text)


def test_jaccard_of_odd_rows(spark):
    docs = odd_docs(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    expected, sizes = component_ids(rows)
    got = sorted(map(str, ((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.classes(docs).collect())))
    assert got == sorted(map(str, ((d, n, c) for (d, _), n, c in zip(rows, sizes, expected, strict=True))))
    # one row of each class, wordless ones all
    kept = jaccard_join.deduplicate(docs).count()
    wordless = sum(n == 0 for n in sizes)
    assert kept == wordless + len({c if c is not None else ("none", t) for (_, t), c, n in zip(rows, expected, sizes, strict=True) if n})


def test_values_of_empty_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " .1!")], "doc_id long, text string").selectExpr("*", "'en' as lang")
    assert {r.lang_pred for r in ppm_language.query(docs).collect()} == {"und"}
    assert {r.score for r in string_kernel_svm.query(docs, labels(spark)).collect()} == {0.0}
    assert [(r.n_bytes, r.n_tokens) for r in token_counts.query(docs, PIECES).orderBy("doc_id").collect()][:2] == [(0, 0), (0, 0)]
    packed = {(r.doc_id, r.length, r.ids_crc32) for r in group_packing.pack(docs, RANKS, TOKENIZER).collect() if r.doc_id < 3}
    assert packed == {(i, 1, zlib.crc32((2).to_bytes(4, "little"))) for i in (1, 2)}


def test_chunks_of_odd_rows(spark):
    docs = odd_docs(spark)
    out = gear_chunks.repeated_spans(docs).collect()
    assert {r.doc_id for r in out} == {7, 8, 9} and {r.first_doc_id for r in out} == {7}
    assert gear_chunks.repeated_spans(spark.createDataFrame([], DOC_SCHEMA)).collect() == []


def test_vectors_of_all_kinds(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, None]), (7, [1.0]), (8, [0.0, 1.0]), (9, [1.0, 0.0]), (None, [1.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'x' as score", "1 as id")
    got = [(r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in multi_index.search(vectors, "id % 100 = 0").orderBy("rank").collect()]
    assert got == [(0, 1, 1, 0.0), (0, 2, 9, 0.0), (0, 3, 8, 1.414214)]
    assert multi_index.search(vectors.limit(0), "id = 0").collect() == []


def test_messages_of_all_kinds(spark):
    rows = [(1, 0, "user", None), (1, 1, None, ""), (None, 0, "user", "> x"), (1, None, "user", "> x"), (1, 2, "user", "> only quote"), (1, 2, "user", "> only quote")]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' as body", "2 as depth")
    out = quote_links.linked(m).collect()
    assert len(out) == 6 and all(r.parent_turn is None and r.depth == 0 for r in out)
    assert [r.body for r in out if r.n_quoted] == [""] * 4
    assert quote_links.linked(m.limit(0)).collect() == []
