"""Source trees and commit logs as DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codescope.functions import glob_regex
from codescope.sources import tree

#: Languages by file extension.
EXTENSIONS = {
    "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "rs": "rust", "java": "java",
    "cs": "c_sharp", "jl": "julia", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hxx": "cpp", "rb": "ruby",
}


def places(spark: SparkSession, root: str, globs: list[str] | None = None, excludes: list[str] | None = None, depth: int | None = None, ignores: bool = True, hidden: bool = False) -> DataFrame:
    """``path`` (below ``root``), ``size`` and ``lang`` of the files of a tree; nothing is read. See :func:`codescope.sources.tree.listing`.

    Globs and excludes cross ``/``; a file that several globs name comes once.
    ``depth`` is the most parts a path may have. For the first rows of many, and
    how many there are, see ``tables.capped``.
    """
    rows = tree.listing(spark, root, ignores, hidden, depth)
    for g in excludes or []:
        rows = rows.filter(~F.col("path").rlike(glob_regex(g)))
    if globs:
        rows = rows.filter(F.col("path").rlike("|".join(glob_regex(g) for g in globs)))
    kinds = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    return rows.withColumn("lang", kinds[F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))])


def files(spark: SparkSession, root: str, globs: list[str] | None = None, excludes: list[str] | None = None, depth: int | None = None, ignores: bool = True, hidden: bool = False) -> DataFrame:
    """The :func:`places` of a tree and the ``content`` of each file, with replacement characters for undecodable bytes."""
    return tree.contents(places(spark, root, globs, excludes, depth, ignores, hidden), root)


#: Texts that mean no bound.
UNBOUNDED = frozenset(["", "all", "unbounded"])


def since(text: str, now: str | None = None) -> Column | None:
    """The time that "14 days ago" (or an ISO date) means, seen from ``now``; None for no bound."""
    text = text.strip().lower()
    if text in UNBOUNDED:
        return None
    m = re.fullmatch(r"(\d+)\s+(day|week|month|year)s?\s+ago", text)
    if not m:
        return F.to_timestamp(F.lit(text))
    here = F.to_timestamp(F.lit(now)) if now else F.current_timestamp()
    return here - F.expr(f"interval {int(m[1])} {m[2]}")


def commits(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Commits and churn of an exported log.

    The log is ``git log --numstat --no-merges --format=%x1e%H%x1f%aI%x1f%P``;
    records start with 0x1e and their header's fields are parted by 0x1f. Binary
    files (``-``) count no lines.
    """
    text = spark.read.option("lineSep", "\x1e").text(path).filter("trim(value) <> ''")
    parts = F.split("value", "\n")
    head = F.split(F.get(parts, F.lit(0)), "\x1f")
    rows = text.select(F.get(head, F.lit(0)).alias("commit"), F.get(head, F.lit(1)).alias("author_date"), F.size(F.filter(F.split(F.get(head, F.lit(2)), " "), lambda p: p != "")).alias("parent_count"), F.slice(parts, 2, F.size(parts)).alias("lines"))
    stat = F.split("line", "\t")
    churn = rows.select("commit", "author_date", F.explode("lines").alias("line")).filter(F.size(stat) == 3)
    count = lambda i: F.coalesce(F.get(stat, F.lit(i)).try_cast("long"), F.lit(0))
    return rows.drop("lines"), churn.select("commit", F.to_timestamp("author_date").alias("at"), F.get(stat, F.lit(2)).alias("file"), count(0).alias("insertions"), count(1).alias("deletions"))


def history(spark: SparkSession, path: str, start: str = "", end: str = "", merges: bool = False, prefixes: list[str] | None = None, now: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Commits and churn of an exported log between two times, without merges, of files under the prefixes; commits left without a file go."""
    rows, churn = commits(spark, path)
    at = F.to_timestamp("author_date")
    if not merges:
        rows = rows.filter("parent_count <= 1")
    if (low := since(start, now)) is not None:
        rows = rows.filter(at >= low)
    if (high := since(end, now)) is not None:
        rows = rows.filter(at <= high)
    if prefixes:
        keep = F.lit(False)
        for p in prefixes:
            keep = keep | (F.col("file") == p) | F.col("file").startswith(p.rstrip("/") + "/")
        churn = churn.filter(keep)
        rows = rows.join(churn.select("commit").distinct(), "commit", "left_semi")
    return rows, churn.join(rows.select("commit"), "commit", "left_semi")


def names(spark: SparkSession, path: str) -> DataFrame:
    """``commit``, ``at`` and ``file`` of a log exported with ``--name-only``."""
    parts = F.split("value", "\n")
    head = F.split(F.get(parts, F.lit(0)), "\x1f")
    rows = spark.read.option("lineSep", "\x1e").text(path).filter("trim(value) <> ''").select(F.get(head, F.lit(0)).alias("commit"), F.to_timestamp(F.get(head, F.lit(1))).alias("at"), F.explode(F.slice(parts, 2, F.size(parts))).alias("file"))
    return rows.filter(F.trim("file") != "")


def log_command(mode: str = "--numstat", start: str = "", end: str = "", merges: bool = False, paths: list[str] | None = None) -> list[str]:
    """Arguments that export a log for :func:`commits` (``--numstat``) or :func:`names` (``--name-only``); ValueError for a value that would be read as an option."""
    for value in (start, end, *(paths or [])):
        if value.startswith("-"):
            raise ValueError(f"a value may not begin with '-': {value}")
    out = ["git", "log", mode, "--format=%x1e%H%x1f%aI%x1f%P"] + ([] if merges else ["--no-merges"])
    out += [f"--since={start}"] * (start.strip().lower() not in UNBOUNDED) + [f"--until={end}"] * (end.strip().lower() not in UNBOUNDED)
    return out + (["--", *paths] if paths else [])


def log_status(spark: SparkSession, path: str, shallow: bool = False) -> DataFrame:
    """One row for an exported log: ``ok``, ``state`` (missing, empty, shallow, complete) and ``message``.

    A log without commits is no error; one that isn't there is. History that
    was cut off (``shallow``, which the exporter knows) is used, with a warning.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = bool(place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place))
    empty = there and commits(spark, path)[0].isEmpty()
    state = "missing" if not there else "empty" if empty else "shallow" if shallow else "complete"
    message = {"missing": f"no log at {path}", "shallow": "the history is cut off; older commits don't count"}.get(state)
    return spark.createDataFrame([(there, state, message)], "ok boolean, state string, message string")
