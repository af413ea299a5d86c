"""Spelling variants: one-edit pairs of words by merging light subtrees of a trie.

The trie of all words is a table: a node is a prefix, its children are the next
characters with the number of words below, and the child with most words is its
heavy one. Every edge that isn't heavy is light; a path has at most log2(words)
of them. Two words that are one edit apart part at one node, and one of them
leaves it by a light edge or ends there, so merging light subtrees only, with
one character replaced or skipped, lets every such pair meet exactly once:

* the light character replaced by the heavy one meets a word of the heavy child,
* replaced by a sign of no word it meets words of other light children,
* skipped, it meets the shorter word of a pair,
* with the heavy character put before it (or after a word that ends at the node)
  it meets the longer word, which is below the heavy child.

No list of all variants is kept: a word has as many as it has light edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: In no word: stands for any light character.
ANY = "*"
#: Nodes of up to SHORT characters have most words below them; their rows are dealt over SALT parts.
SHORT, SALT = 2, 64
MIN_LENGTH, MIN_COUNT = 5, 3
NOISE = 97


def count_words(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, noise: int = 0) -> DataFrame:
    """``word`` and ``n``: runs of letters of ``docs(doc_id, text)``, A-Z lower-cased.

    With ``noise``, a run loses the code point h % length (from 0) where noise
    divides h, the crc32 of ``doc_id:run``; that happens before lengths and
    occurrences are looked at. Null and empty texts have no runs; a null doc_id
    counts as an empty one; rows with one doc_id are read one by one.
    """
    run = F.explode(F.split(common.text_or_empty(docs), f"[^{LETTERS}]+")).alias("run")
    runs = docs.select(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).alias("d"), run).filter("run <> ''")
    # lower() knows more letters than A-Z, so only runs of one byte a character go through it
    low = F.when(F.length("run") == F.octet_length("run"), F.lower("run")).otherwise(F.translate("run", UPPER, LOWER))
    words = runs.select("d", low.alias("word"))
    if noise:
        h = F.crc32(F.concat("d", F.lit(":"), "word"))
        words = words.select("word", h.alias("h")).select(F.when(F.col("h") % noise == 0, F.expr("concat(substring(word, 1, int(h % length(word))), substring(word, int(h % length(word)) + 2))")).otherwise(F.col("word")).alias("word"))
    return words.filter(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def light_edges(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``word, n, i, h`` for each light edge: position and the node's heavy character; and ``node, h`` of all inner nodes."""
    at = words.filter("word <> ''").select("word", "n", F.explode(F.expr("sequence(0, length(word) - 1)")).alias("i"))
    steps = at.select("word", "n", "i", F.expr("substring(word, 1, i)").alias("node"), F.expr("substring(word, i + 1, 1)").alias("ch"))
    children = steps.groupBy("node", "ch").agg(F.count("*").alias("size"))
    heavy = common.materialize(children.groupBy("node").agg(F.max_by("ch", F.struct("size", "ch")).alias("h"), F.count("*").alias("ways")))
    short = F.length("node") <= SHORT
    salts = F.when(short, F.expr(f"sequence(0, {SALT - 1})")).otherwise(F.array(F.lit(0)))
    forks = heavy.filter("ways > 1").select("node", "h", F.explode(salts).alias("salt"))
    dealt = steps.withColumn("salt", F.when(short, F.pmod(F.hash("word"), F.lit(SALT))).otherwise(F.lit(0)))
    light = dealt.join(forks, ["node", "salt"]).filter("ch <> h").select("word", "n", "i", "h")
    return common.materialize(light), heavy.select("node", "h")


def near_words(words: DataFrame) -> DataFrame:
    """``word``, ``n_near`` and ``best`` (struct of minus its count, its text) for words that have near ones.

    ``words(word, n)`` holds each word once.
    """
    light, heavy = light_edges(words)
    replaced = F.expr("concat(substring(word, 1, i), h, substring(word, i + 2))")
    # in a run of one character the last one is skipped, where the two words part
    skipped = F.when(F.expr("substring(word, i + 1, 1) <> substring(word, i + 2, 1)"), F.expr("concat(substring(word, 1, i), substring(word, i + 2))"))
    longer = F.expr("concat(substring(word, 1, i), h, substring(word, i + 1))")
    merged = light.select("word", "n", F.explode(F.array(replaced, skipped, longer)).alias("key")).filter("key <> ''")
    ended = words.join(heavy, words["word"] == heavy["node"]).select("word", "n", F.concat("word", "h").alias("key"))
    terminals = words.select(F.col("word").alias("key"), F.col("n").alias("other_n"))
    pairs = merged.union(ended).join(terminals, "key")
    both = F.explode(F.array(F.struct(F.col("word"), F.struct((-F.col("other_n")).alias("n"), F.col("key").alias("word")).alias("best")), F.struct(F.col("key").alias("word"), F.struct((-F.col("n")).alias("n"), F.col("word").alias("word")).alias("best")))).alias("p")
    met = pairs.select(both).select("p.word", F.lit(1).cast("long").alias("c"), "p.best")
    # light beside light: as many members as the alphabet has letters; the best of the others is the first, or the second for the first
    among = Window.partitionBy("key")
    first = among.orderBy(F.desc("n"), "word")
    who = F.struct((-F.col("n")).alias("n"), F.col("word").alias("word"))
    wild = light.select("word", "n", F.concat(F.expr("substring(word, 1, i)"), F.lit(ANY), F.expr("substring(word, i + 2)")).alias("key"))
    wild = wild.select("word", (F.count("*").over(among) - 1).alias("c"), F.when(F.row_number().over(first) == 1, F.lead(who).over(first)).otherwise(F.first(who).over(first)).alias("best"))
    return met.union(wild.filter("c > 0")).groupBy("word").agg(F.sum("c").alias("n_near"), F.min("best").alias("best"))


def group(words: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of each row of ``words(word, n)``.

    A word's form is its near word (one code point inserted, deleted or
    replaced) of largest n, of several the first in code-point order, if that n
    is at least twice its own; else null, and form_n is null too. ``root`` is
    where the forms lead: as n doubles at every step, they never turn back and
    are few. An empty table gives no rows; null words and the empty word are left out.
    """
    words = common.materialize(words.filter("word <> ''").groupBy("word").agg(F.sum("n").alias("n")))
    near = near_words(words)
    formed = F.expr("-best.n >= 2 * n")
    out = common.materialize(words.join(near, "word", "left").select("word", F.when(formed, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(formed, -F.col("best.n")).alias("form_n")))
    links = out.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = common.materialize(links.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        links = step.select("word", "root")
        if step.filter("moved").isEmpty():
            break
    return out.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group(count_words(common.table(spark, sf_dir, "documents"), noise=NOISE))
