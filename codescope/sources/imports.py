"""Imports of eleven languages, and the files they mean.

Python's come from its parser and most other languages' from their tokens
(:mod:`codescope.sources.token_imports`). What is here reads whole lines, and
Go's also as lines of an import block: for Rust, and for files that couldn't be
read otherwise. There, lines inside comments or texts that look like an import
count as one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codescope.operators import tables

#: A line's import by language; the first pattern that fits a line wins.
PATTERNS: dict[str, list[tuple[str, str]]] = {
    "javascript": [("esm", r"""^\s*import\b[^'"(]*['"]([^'"]+)['"]"""), ("esm", r"""^\s*\}\s*from\s+['"]([^'"]+)['"]""")],
    "typescript": [("esm", r"""^\s*import\b[^'"(]*['"]([^'"]+)['"]"""), ("esm", r"""^\s*\}\s*from\s+['"]([^'"]+)['"]""")],
    "java": [("java_import", r"^\s*import\s+(?:static\s+)?([\w.]+?)(?:\.\*)?\s*;")],
    "c_sharp": [("csharp_using", r"^\s*(?:global\s+)?using\s+(?:static\s+)?([\w.]+)\s*;")],
    "rust": [("use", r"^use\s+([\w:]+)")],
    "c": [("include_local", r'^\s*#\s*include\s+"([^"]+)"'), ("include_system", r"^\s*#\s*include\s+<([^>]+)>")],
    "cpp": [("include_local", r'^\s*#\s*include\s+"([^"]+)"'), ("include_system", r"^\s*#\s*include\s+<([^>]+)>")],
    "ruby": [("ruby_require", r"""^\s*(?:require|require_relative|load)\b[\s(]*['"]([^'"]+)['"]""")],
    "julia": [("julia_using", r"^\s*using\s+([\w.]+(?:\s*,\s*[\w.]+)*)"), ("julia_import", r"^\s*import\s+([\w.]+(?:\s*,\s*[\w.]+)*)")],
}
IN_BLOCK = r'"([^"]+)"'


def lines(files: DataFrame) -> DataFrame:
    return files.select(F.col("path").alias("file"), "lang", F.posexplode(F.split("content", "\r?\n")).alias("i", "text")).withColumn("line", F.col("i") + 1).drop("i")


def text_imports(files: DataFrame) -> DataFrame:
    """``file``, ``line``, ``module`` and ``kind`` of the imports that lines hold; a line with several modules gives several rows."""
    rows = lines(files.filter(F.col("lang").isin(*PATTERNS)))
    hit = F.lit(None).cast("struct<kind:string,module:string>")
    for lang, patterns in PATTERNS.items():
        for kind, pattern in reversed(patterns):
            fits = (F.col("lang") == lang) & F.col("text").rlike(pattern)
            hit = F.when(fits, F.struct(F.lit(kind).alias("kind"), F.regexp_extract("text", pattern, 1).alias("module"))).otherwise(hit)
    found = rows.withColumn("hit", hit).filter("hit is not null").select("file", "line", F.explode(F.split("hit.module", r"\s*,\s*")).alias("module"), F.col("hit.kind").alias("kind"))
    return found.unionByName(_go(files))


def _go(files: DataFrame) -> DataFrame:
    # only the lines that matter to the state of a block are ordered
    rows = lines(files.filter("lang = 'go'")).withColumn("text", F.trim("text"))
    opens, closes = F.col("text").startswith("import ("), F.col("text") == ")"
    rows = rows.filter(opens | closes | F.col("text").contains('"') | F.col("text").startswith("import "))
    # a closing line counts once, for the block that is open
    state = tables.last_mark(rows, "file", ["line"], F.when(opens, True).when(closes, False))
    found = state.filter(~opens & (F.col("inside") | F.col("text").startswith("import ")) & F.col("text").rlike(IN_BLOCK))
    return found.select("file", "line", F.regexp_extract("text", IN_BLOCK, 1).alias("module"), F.lit("go_import").alias("kind"))


def normalised(module: Column) -> Column:
    """An import's text without quotes and leading dots and slashes, with ``/`` for a backslash."""
    bare = F.regexp_replace(F.trim(module), "^[\"']+|[\"']+$", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"\\", "/"), "/+$", ""), r"^\.*/*", "")


def names_of(path: Column) -> Column:
    """Names by which a file is imported in full: dotted, by slashes, with its ending; a package's own."""
    bare = F.regexp_replace(path, r"(?<=[^/])\.[^./]+$", "")
    package = F.when(path.rlike(r"/__init__\.py$"), F.regexp_replace(bare, "/[^/]+$", ""))
    dotted = lambda c: F.replace(c, F.lit("/"), F.lit("."))
    return F.filter(F.array_distinct(F.array(dotted(bare), bare, path, dotted(package), package)), lambda n: n.isNotNull() & (n != ""))


def resolved(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct ``src`` and ``dst`` of ``imports(src, module)``.

    A whole name comes first, as written or with slashes for its dots; then the
    last part of the path as a file's name with or without ending; then what
    stands behind the last dot of it. Of files with one name the smallest path
    counts. A file doesn't import itself.
    """
    path = F.col("path")
    name = F.regexp_extract(path, "([^/]+)$", 1)
    whole = files.select(path, F.explode(names_of(path)).alias("key")).groupBy("key").agg(F.min("path").alias("hit"))
    stems = files.select(path, F.explode(F.array_distinct(F.array(F.regexp_replace(name, r"(?<=.)\.[^.]+$", ""), name))).alias("key")).groupBy("key").agg(F.min("path").alias("hit"))
    rows = imports.select("src", normalised(F.col("module")).alias("k1")).filter("k1 <> ''").distinct()
    rows = rows.withColumn("k2", F.replace("k1", F.lit("."), F.lit("/"))).withColumn("k3", F.regexp_extract("k1", "([^/]*)$", 1)).withColumn("k4", F.regexp_extract("k3", r"([^.]*)$", 1))
    for n, table in ((1, whole), (2, whole), (3, stems), (4, stems)):
        rows = rows.join(table.select(F.col("key").alias(f"k{n}"), F.col("hit").alias(f"hit{n}")), f"k{n}", "left")
    return rows.select("src", F.coalesce("hit1", "hit2", "hit3", "hit4").alias("dst")).filter("dst is not null and dst <> src").distinct()
