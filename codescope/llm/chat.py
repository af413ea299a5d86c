"""Chat formatting of reply trees, with DataFrame functions only.

Iterative self-joins double each message's link to an ancestor, so that a tree
of depth d takes log2(d) of them; as many joins then list each leaf's path.
Branches are ranked by the sum of their scores, and each chosen path is
formatted as one conversation.

A turn is ``<turn role="R">``, a new line, the text, a new line, ``</turn>`` and
a new line. Inside roles and texts ``&``, ``<`` and ``"`` become ``&amp;``,
``&lt;`` and ``&quot;``, so nothing inside a text can look like a marker, and
:func:`parsed` restores every text exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

TURN = '<turn role="([^"]*)">\n([^<]*)\n</turn>\n'


def escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescaped(c: Column) -> Column:
    for a, b in (('"', "&quot;"), ("<", "&lt;"), ("&", "&amp;")):
        c = F.replace(c, F.lit(b), F.lit(a))
    return c


def branches(nodes: DataFrame, keep: int | None = 1) -> DataFrame:
    """Root-to-leaf paths of ``nodes(tree, id, parent, score)``: tree, leaf, score, path (ids from the root).

    A null parent, a parent that isn't there, and a parent that is on the path
    already end a path; a tree that is one cycle has no leaf and no path. Null
    scores count 0. ``keep`` best branches are kept for each tree, or all for
    None; of equal scores the branch with the smaller leaf is better. (tree, id)
    must be unique.
    """
    nodes = nodes.select("tree", "id", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    inner = nodes.select("tree", F.col("parent").alias("id")).filter("id is not null").distinct()
    leaves = nodes.join(inner, ["tree", "id"], "left_anti")
    there = nodes.select("tree", F.col("id").alias("parent"))
    level = nodes.select("tree", "id", "parent").join(there, ["tree", "parent"], "left_semi").select("tree", "id", F.col("parent").alias("up"))
    # levels[r] leads from a message to its ancestor 2**r steps up; only cycles go on beyond the largest tree
    largest = nodes.groupBy("tree").count().agg(F.max("count").alias("n")).first()["n"] or 0
    levels: list[DataFrame] = []
    while 2 ** len(levels) <= largest:
        level = common.materialize(level)
        if level.isEmpty():
            break
        levels.append(level)
        above = level.select("tree", F.col("id").alias("up"), F.col("up").alias("top"))
        level = level.join(above, ["tree", "up"]).select("tree", "id", F.col("top").alias("up"))
    walk = leaves.select("tree", F.col("id").alias("leaf"), "id", F.lit(0).alias("steps"))
    for r, level in reversed(list(enumerate(levels))):
        here = F.struct("id", "steps")
        above = F.when(F.col("up").isNotNull(), F.struct(F.col("up").alias("id"), (F.col("steps") + 2**r).alias("steps")))
        both = F.explode(F.array_compact(F.array(here, above))).alias("at")
        walk = walk.join(level, ["tree", "id"], "left").select("tree", "leaf", both).select("tree", "leaf", "at.*")
    # on a cycle messages come again; the first time counts
    walk = walk.groupBy("tree", "leaf", "id").agg(F.max(-F.col("steps")).alias("at")).join(nodes.select("tree", "id", "score"), ["tree", "id"])
    walk = walk.groupBy("tree", "leaf").agg(F.sum("score").alias("score"), F.sort_array(F.collect_list(F.struct("at", "id"))).alias("path"))
    walk = walk.select("tree", "leaf", "score", F.col("path.id").alias("path"))
    if keep is None:
        return walk
    if keep == 1:  # a hot tree's leaves are reduced before the shuffle
        best = walk.groupBy("tree").agg(F.max(F.struct("score", (-F.col("leaf")).alias("l"), "path")).alias("b"))
        return best.select("tree", (-F.col("b.l")).alias("leaf"), "b.score", "b.path")
    order = Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")
    return walk.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= keep).drop("nth")


def formatted(paths: DataFrame, texts: DataFrame) -> DataFrame:
    """``text`` and ``loss`` (array of start, length in code points: the assistant's texts) of each path.

    ``texts(tree, id, role, text)``; null roles and texts are empty.
    """
    steps = paths.select("tree", "leaf", F.posexplode("path").alias("at", "id"))
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    head = F.concat(F.lit('<turn role="'), escaped(role), F.lit('">\n'))
    turn = F.struct("at", head.alias("head"), escaped(text).alias("body"), (role == "assistant").alias("learn"))
    rows = steps.join(texts, ["tree", "id"]).groupBy("tree", "leaf").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    none = F.array().cast("array<struct<start:int,length:int>>")

    def add(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.length(t["head"])
        span = F.struct(begin.alias("start"), F.length(t["body"]).alias("length"))
        return F.struct((begin + F.length(t["body"]) + len("\n</turn>\n")).cast("int").alias("at"), F.when(t["learn"], F.concat(acc["loss"], F.array(span))).otherwise(acc["loss"]).alias("loss"))

    loss = F.aggregate("turns", F.struct(F.lit(0).alias("at"), none.alias("loss")), add, lambda acc: acc["loss"])
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit("\n</turn>\n"))), "")
    return rows.select("tree", "leaf", whole.alias("text"), loss.alias("loss"))


def parsed(conversations: DataFrame) -> DataFrame:
    """Read formatted conversations back: adds turns (role, text) and loss_text."""
    roles, texts = (F.regexp_extract_all("text", F.lit(TURN), F.lit(i)) for i in (1, 2))
    turns = F.arrays_zip(F.transform(roles, unescaped).alias("role"), F.transform(texts, unescaped).alias("text"))
    learned = F.transform("loss", lambda s: unescaped(F.substring(F.col("text"), s["start"] + 1, s["length"])))
    return conversations.withColumns({"turns": turns, "loss_text": F.array_join(learned, "")})


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted and read back.

    A conversation's rows in the order of turn, role and text are one branch.
    Rows with a null conv_id are one conversation; null roles and texts are empty.
    """
    said = "\\### Assistant: </turn> ok"
    extra = spark.sql("select -7L conv_id, 0L turn, 'user' role union all select -7L, 1L, 'assistant'").withColumn("text", F.lit(said))
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    rows = rows.withColumn("tree", F.coalesce(F.col("conv_id").cast("string"), F.lit("none")))
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    rows = common.materialize(rows.withColumn("id", F.row_number().over(order).cast("long")))
    nodes = rows.select("tree", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), F.lit(1.0).alias("score"))
    out = parsed(formatted(branches(nodes), rows.select("tree", "id", "role", "text")))
    said_by_turn = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        F.when(F.col("tree") != "none", F.col("tree")).cast("long").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(said_by_turn, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("text").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (
  SELECT *, length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '"', '&quot;'))
    + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '"', '&quot;')) + 24 AS chars FROM rows_)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
