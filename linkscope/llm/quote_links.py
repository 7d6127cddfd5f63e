"""Quotation linking: conversations ordered by reply, without the quotes.

All of it is DataFrame functions.  A line that starts with marks `>` (blanks between allowed) is
quoted, as deep as it has marks.  Lines of one level next to each other form passages, which lines of
another level and blank lines end.  A passage is normalised (lower case, runs of blanks as one)
and hashed.  Unquoted passages of a message are its own; a quoted passage is joined to the
earliest message of its conversation that has it as its own, if that came before.  The latest message
that a message quotes at level one is its parent (of any level, if none at level one), and following
parents gives its thread's root and its depth.  Chains are followed by doubling: each round
joins every link to the link of its end, so a thread of n replies takes log2(n) rounds.

Ordering by conv_id, root_turn, depth, turn puts every reply after what it answers.

A passage that very many messages hold is reduced to its first holder by a map-side minimum before the
join, and no conversation is gathered in a task.

Defined cases: a null text is empty; a text of quotes alone has an empty body; a quote of nothing known is
unlinked, and so is a part of a passage; any number of marks is a level; a null conv_id or turn links with nothing and is its own root; rows of equal conv_id and turn share their
links; repeated rows stay; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkscope.llm.common import cut

MARKS = r"^[ \t>]*>[ \t]*"
QUOTED = r"(^|\n)[ \t]*>"


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, body, and arrays of passage hashes: own, and quoted with their levels."""
    m = messages.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    lines = F.transform(F.split("text", "\n"), lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 0), "[^>]", "")).alias("level"), F.regexp_replace(x, MARKS, "").alias("words"), x.alias("line")))
    m = m.withColumn("lines", F.when(F.col("text").rlike(QUOTED), lines))
    plain = lambda level: F.array_join(F.transform("lines", lambda x: F.when(x["level"] == level, x["words"]).otherwise("")), "\n")
    body = F.when(F.col("lines").isNull(), F.col("text")).otherwise(F.trim(F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["line"]), "\n"), F.lit(" \t\r\n")))
    deepest = F.coalesce(F.array_max(F.transform("lines", lambda x: x["level"])), F.lit(0))
    # the levels that occur, so a line of very many marks is one pass over the lines
    levels = F.filter(F.array_distinct(F.transform("lines", lambda x: x["level"])), lambda i: i > 0)
    quoted = F.flatten(F.transform(levels, lambda i: F.transform(passages(plain(i)), lambda h: F.struct(i.alias("level"), h.alias("hash")))))
    m = m.withColumn("deepest", deepest).withColumn("own", passages(F.when(F.col("lines").isNull(), F.col("text")).otherwise(plain(0)))).withColumn("body", body)
    none = F.expr("cast(array() as array<struct<level:int,hash:string>>)")
    return m.withColumn("quoted", F.when(F.col("deepest") > 0, quoted).otherwise(none)).select("conv_id", "turn", "role", "body", "own", "quoted")


def passages(text):
    """Hashes of the normalised passages of a text whose blank lines separate them."""
    parts = F.transform(F.split(text, r"\n[ \t\r\n]*\n"), lambda p: F.trim(F.regexp_replace(F.lower(p), r"[ \t\r\n\f]+", " ")))
    return F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.md5(p))


def linked(messages: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, body, n_quoted, n_linked, parent_turn, root_turn, depth."""
    every = parsed(messages)
    quotes = every.where(F.size("quoted") > 0).select("conv_id", "turn", F.explode("quoted").alias("q")).select("conv_id", "turn", "q.level", "q.hash").distinct()
    first = every.select("conv_id", "turn", F.explode("own").alias("hash")).groupBy("conv_id", "hash").agg(F.min("turn").alias("source"))
    found = quotes.join(first, ["conv_id", "hash"]).where("source < turn")
    parents = cut(found.groupBy("conv_id", "turn").agg(F.count("*").alias("n_linked"), F.coalesce(F.max(F.when(F.col("level") == 1, F.col("source"))), F.max("source")).alias("parent_turn")))
    # by doubling: the end of each link, and how far it is
    ends = parents.select("conv_id", "turn", F.col("parent_turn").alias("end"), F.lit(1).cast("long").alias("depth"))
    while not (step := ends.select("conv_id", F.col("turn").alias("end"), F.col("end").alias("next"), F.col("depth").alias("further"))).join(ends.select("conv_id", "end"), ["conv_id", "end"], "left_semi").isEmpty():
        ends = cut(ends.join(step, ["conv_id", "end"], "left").select("conv_id", "turn", F.coalesce("next", "end").alias("end"), (F.col("depth") + F.coalesce("further", F.lit(0))).alias("depth")))
    out = every.join(parents.join(ends, ["conv_id", "turn"]), ["conv_id", "turn"], "left")
    return out.select("conv_id", "turn", "role", "body", F.size("quoted").cast("long").alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "parent_turn", F.coalesce("end", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).alias("depth"))


ORACLE_SQL = r"""
WITH RECURSIVE m AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text, regexp_matches(coalesce(text, ''), '(^|\n)[ \t]*>') AS q FROM conversations),
l AS (
  SELECT *, CASE WHEN q THEN list_transform(string_split(text, chr(10)), lambda x: {
    'level': length(regexp_replace(regexp_extract(x, '^[ \t>]*>[ \t]*', 0), '[^>]', '', 'g')),
    'words': regexp_replace(x, '^[ \t>]*>[ \t]*', ''), 'line': x}) END AS lines FROM m),
p AS (
  SELECT *, CASE WHEN q THEN trim(array_to_string(list_transform(list_filter(lines, lambda x: x.level = 0), lambda x: x.line), chr(10)), ' ' || chr(9) || chr(13) || chr(10)) ELSE text END AS body,
    CASE WHEN q THEN array_to_string(list_transform(lines, lambda x: CASE WHEN x.level = 0 THEN x.words ELSE '' END), chr(10)) ELSE text END AS own_text FROM l),
levels AS (
  SELECT DISTINCT conv_id, turn, text, lines, level FROM (SELECT *, unnest(list_distinct(list_transform(lines, lambda x: x.level))) AS level FROM p WHERE q) WHERE level > 0),
qp AS (
  SELECT conv_id, turn, text, level, unnest(regexp_split_to_array(array_to_string(list_transform(lines, lambda x: CASE WHEN x.level = level THEN x.words ELSE '' END), chr(10)), '\n[ \t\r\n]*\n')) AS passage FROM levels),
qh AS (
  SELECT conv_id, turn, text, level, md5(trim(regexp_replace(lower(passage), '[ \t\r\n\f]+', ' ', 'g'))) AS hash FROM qp WHERE trim(regexp_replace(passage, '[ \t\r\n\f]+', ' ', 'g')) <> ''),
own AS (SELECT conv_id, turn, unnest(regexp_split_to_array(own_text, '\n[ \t\r\n]*\n')) AS passage FROM p),
first AS (
  SELECT conv_id, md5(trim(regexp_replace(lower(passage), '[ \t\r\n\f]+', ' ', 'g'))) AS hash, min(turn) AS source FROM own
  WHERE trim(regexp_replace(passage, '[ \t\r\n\f]+', ' ', 'g')) <> '' GROUP BY ALL),
found AS (SELECT DISTINCT qh.conv_id, qh.turn, qh.level, qh.hash, source FROM qh JOIN first USING (conv_id, hash) WHERE source < qh.turn),
parents AS (SELECT conv_id, turn, count(*) AS n_linked, coalesce(max(source) FILTER (level = 1), max(source)) AS parent_turn FROM found GROUP BY ALL),
chain AS (
  SELECT conv_id, turn, parent_turn AS anc, 1 AS depth FROM parents
  UNION ALL SELECT c.conv_id, c.turn, p.parent_turn, c.depth + 1 FROM chain c JOIN parents p ON p.conv_id = c.conv_id AND p.turn = c.anc),
ends AS (SELECT conv_id, turn, min(anc) AS root, max(depth) AS depth FROM chain GROUP BY ALL),
n AS (SELECT conv_id, turn, text, count(*) AS n_quoted FROM qh GROUP BY ALL)
SELECT p.conv_id, p.turn, p.role, p.body, coalesce(n.n_quoted, 0)::BIGINT AS n_quoted, coalesce(parents.n_linked, 0)::BIGINT AS n_linked, parents.parent_turn,
  coalesce(ends.root, p.turn) AS root_turn, coalesce(ends.depth, 0)::BIGINT AS depth
FROM p LEFT JOIN n ON n.conv_id = p.conv_id AND n.turn = p.turn AND n.text = p.text
  LEFT JOIN parents ON parents.conv_id = p.conv_id AND parents.turn = p.turn LEFT JOIN ends ON ends.conv_id = p.conv_id AND ends.turn = p.turn
"""
