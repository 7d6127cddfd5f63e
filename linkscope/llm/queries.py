"""The queries of this subpackage, each over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkscope.llm import gear_chunks, group_packing, jaccard_join, mountain_manifest, multi_index, ppm_language, prefix_trie, quote_links, secret_scan, string_kernel_svm, token_counts, warc_shards, winnowing
from linkscope.llm.common import shared_folder, table

#: Tokenizer files; every executor has them at the same place.
RANKS, TOKENIZER, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"))


def op1_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op2_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quote_links.linked(table(spark, sf_dir, "conversations"))


def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return winnowing.digest(winnowing.find(docs, table(spark, sf_dir, "benchmark")))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op5_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm_language.query(table(spark, sf_dir, "documents"))


def op6_string_kernel_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return string_kernel_svm.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_group_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_packing.pack(table(spark, sf_dir, "documents"), RANKS, TOKENIZER)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.query(table(spark, sf_dir, "documents"), PIECES)


def op10_gear_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gear_chunks.repeated_spans(table(spark, sf_dir, "documents"))


def op11_mountain_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mountain_manifest.proofs(table(spark, sf_dir, "documents"))


def op12_warc_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc_shards.write(table(spark, sf_dir, "pages"), folder)
    return warc_shards.read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.query(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_multi_index, op2_quote_links, op3_winnowing, op4_jaccard_join, op5_ppm_language, op6_string_kernel_svm, op7_group_packing, op8_secret_scan, op9_token_counts, op10_gear_chunks, op11_mountain_manifest, op12_warc_shards, op13_prefix_trie)}

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOW.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
bw AS (SELECT item_id, least(13, len(w)) AS n, unnest(list_transform(range(1, greatest(1, len(w) - 12) + 1), lambda i: array_to_string(w[i : i + least(13, len(w)) - 1], ' '))) AS win FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, sizes WHERE len(w) >= n),
hit AS (SELECT DISTINCT r, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND array_to_string(w[i : i + dw.n - 1], ' ') = bw.win),
places AS (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM hit),
hits AS (SELECT r, count(*) AS n_hit FROM places GROUP BY r),
items AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN items USING (r)
"""

OP4_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: hash(array_to_string(w[i : i + 4], ' '))) WHEN len(w) > 0 THEN [hash(array_to_string(w, ' '))] ELSE [] END) AS s FROM d),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n + b.n AS n, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs WHERE 100 * k >= 80 * (n - k)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, x.b FROM reach r JOIN edges x ON x.a = r.b),
low AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM s JOIN low USING (doc_id)
"""



def _crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text, one bit a step."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {bits}), lambda a, e: xor(xor(a, e) >> 1, (xor(a, e) & 1) * 3988292384)), 4294967295)"


def _tree(levels: int, leaves: str, ways: str, name: str) -> str:
    """CTEs that fold leaves(grp, i, h) to {name}l{levels}, one row a group, and ways(r, grp, i, up, proof) along to {name}f{levels}; a level of one node stays."""
    out = [f"{name}l0 AS MATERIALIZED ({leaves}), {name}f0 AS MATERIALIZED ({ways})"]
    for k in range(levels):
        out.append(f"""{name}r{k} AS MATERIALIZED (SELECT grp, i // 8 AS g, n, list(h ORDER BY i) AS hs FROM (SELECT *, count(*) OVER (PARTITION BY grp) AS n FROM {name}l{k}) GROUP BY ALL),
{name}l{k + 1} AS MATERIALIZED (SELECT grp, g AS i, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h FROM {name}r{k}),
{name}f{k + 1} AS MATERIALIZED (SELECT f.r, f.grp, f.i // 8 AS i, CASE WHEN n = 1 THEN up ELSE sha256(array_to_string(hs[: (f.i % 8)::INT], '') || up || array_to_string(hs[(f.i % 8)::INT + 2 :], '')) END AS up,
  CASE WHEN n = 1 THEN proof ELSE proof || array_to_string(hs[: (f.i % 8)::INT], '') || array_to_string(hs[(f.i % 8)::INT + 2 :], '') END AS proof FROM {name}f{k} f JOIN {name}r{k} x ON f.grp IS NOT DISTINCT FROM x.grp AND f.i // 8 = x.g)""")
    return ",\n".join(out)


_WRITTEN = " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END" for c in ("doc_id", "source", "lang", "n_chars", "text"))
OP11_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, lang AS grp, sha256({_WRITTEN}) AS leaf, {_LOW.format("text")} AS low, source, lang, n_chars FROM documents),
t AS MATERIALIZED (SELECT r, doc_id, grp, leaf, CASE WHEN coalesce({_crc32("doc_id::VARCHAR")} % 3, 1) = 0 THEN sha256({_WRITTEN.replace("text", "low")}) ELSE leaf END AS other, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
{_tree(10, "SELECT grp, i, leaf AS h FROM t", "SELECT r, grp, i, other AS up, '' AS proof FROM t", "a")},
s AS MATERIALIZED (SELECT grp, h, row_number() OVER (ORDER BY grp NULLS FIRST) - 1 AS i FROM al10),
{_tree(10, "SELECT 0 AS grp, i, h FROM s", "SELECT f.r, 0 AS grp, s.i, f.up, f.proof FROM af10 f JOIN s ON f.grp IS NOT DISTINCT FROM s.grp", "b")}
SELECT doc_id, leaf, s.h AS subroot, bl10.h AS root, sha256(proof) AS proof_sha256, up AS folded_root, up = bl10.h AS verified FROM t JOIN bf10 USING (r) JOIN s ON t.grp IS NOT DISTINCT FROM s.grp, bl10
"""

OP12_SQL = """
WITH p AS (SELECT page_id, url, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
o AS (SELECT *, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST) AS k, min(page_id) OVER (PARTITION BY payload_digest) AS low FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND k > 1 THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= 100 AND k > 1 THEN low END AS refers_to FROM o
"""

OP13_SQL = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT conv_id, turn, sha256(strlen(role) || ':' || role || text) AS d, len(regexp_extract_all(text, '[^ 	-]+')) AS w FROM t),
o AS MATERIALIZED (SELECT conv_id, list({{'d': d, 'w': w}} ORDER BY turn NULLS FIRST, d) AS turns, ({_crc32("conv_id::VARCHAR")} % 4)::INT AS h FROM k GROUP BY conv_id),
r AS (SELECT o.conv_id, list_concat(coalesce(b.turns, [])[: o.h], o.turns[o.h + 1 :]) AS turns FROM o LEFT JOIN o b ON b.conv_id = o.conv_id - o.conv_id % 20),
u AS (SELECT conv_id, turns, unnest(range(0, len(turns) + 1))::BIGINT AS depth FROM r),
p AS MATERIALIZED (SELECT conv_id, depth, sha256(array_to_string(list_transform(turns[: depth], lambda x: x.d), ',')) AS node, CASE WHEN depth > 0 THEN sha256(array_to_string(list_transform(turns[: depth - 1], lambda x: x.d), ',')) END AS up,
  CASE WHEN depth > 0 THEN turns[depth].w ELSE 0 END AS w, depth = len(turns) AS ends FROM u),
n AS MATERIALIZED (SELECT node, depth, min(conv_id) AS conv_id, any_value(up) AS up, count(*) AS n_convs, any_value(w) AS w, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY ALL),
c AS (SELECT up AS node, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY 1),
x AS MATERIALIZED (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c USING (node)),
s AS (SELECT p.node, count(*) FILTER (x.n_children = 0) AS n_leaves, sum((x.n_convs - 1) * x.w)::BIGINT AS saved_tokens FROM x JOIN p ON p.conv_id = x.conv_id AND p.depth <= x.depth GROUP BY 1)
SELECT x.conv_id, x.depth, y.conv_id AS parent_conv_id, x.n_convs, x.n_children, s.n_leaves, s.saved_tokens, x.ends_sha256 FROM x JOIN s USING (node) LEFT JOIN n y ON y.node = x.up
"""

ORACLE_SQL = {"op2_quote_links": quote_links.ORACLE_SQL, "op3_winnowing": OP3_SQL, "op4_jaccard_join": OP4_SQL, "op11_mountain_manifest": OP11_SQL, "op12_warc_shards": OP12_SQL, "op13_prefix_trie": OP13_SQL}
