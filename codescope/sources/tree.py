"""A tree of files as a source: folders are listed, and files read, by executors.

Listing goes in rounds. A task takes folders and walks below them until it has
seen ``LISTED`` entries; what it hasn't opened by then is dealt over all tasks of
the next round. So a small tree takes one round, a large one spreads after its
first few folders, and the driver sees neither names nor contents. The folders
above that hold an ignore file go down with each folder; a task reads each such
file once. Left-out folders are never opened.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codescope import shared

#: Entries that a task lists before it hands on the folders it hasn't opened.
LISTED = 4000
#: Bytes and rows of one batch of contents; a larger file is a batch of its own. Bytes of one task.
BYTES, ROWS = 16 << 20, 512
TASK_BYTES = 64 << 20
IGNORE = ".gitignore"


def store(root: str):
    """The file system of a root and the path in it; local without a scheme, else what pyarrow knows (file, hdfs, s3, gs, abfs)."""
    from pyarrow import fs

    if root.startswith("file:"):
        root = "/" + root[5:].lstrip("/")
    if "://" in root:
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), os.path.abspath(root)


def ignore_rules(content: str, folder: str = "") -> list[tuple[str, bool, bool]]:
    """Each line of an ignore file as a regular expression on whole paths, whether it leaves out, and whether it is for folders only."""
    out = []
    for line in content.splitlines():
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if not line or line.startswith("#"):
            continue
        out_ = not line.startswith("!")
        line = line if out_ else line[1:]
        only_folders = line.endswith("/")
        line = line.rstrip("/")
        here = "/" in line
        body, i, line = "", 0, line.lstrip("/")
        while i < len(line):
            c = line[i]
            if line.startswith("**/", i):
                body, i = body + "(?:.*/)?", i + 3
                continue
            if line.startswith("/**", i) and i + 3 == len(line):
                body, i = body + "/.+", i + 3
                continue
            if c == "[" and (j := line.find("]", i + 2)) > 0:
                inside = line[i + 1 : j].replace("\\", "\\\\")
                body, i = body + "[" + ("^" + inside[1:] if inside[0] in "!^" else inside) + "]", j + 1
                continue
            if c == "\\" and i + 1 < len(line):
                i += 1
                body += re.escape(line[i])
            else:
                body += {"*": "[^/]*", "?": "[^/]"}.get(c) or re.escape(c)
            i += 1
        out.append(("(?s)^" + (re.escape(folder) + "/" if folder else "") + ("" if here else "(?:.*/)?") + body + "$", out_, only_folders))
    return out


class Walker:
    """Lists folders of one root."""

    def __init__(self, root: str, ignores: bool, hidden: bool, depth: int | None) -> None:
        self.fs, self.base = store(root)
        self.ignores, self.hidden, self.depth = ignores, hidden, depth
        self.local = type(self.fs).__name__ == "LocalFileSystem"
        self.rules = lru_cache(maxsize=256)(self._rules)

    def _rules(self, folder: str) -> list[tuple[re.Pattern, bool, bool]]:
        with self.fs.open_input_stream("/".join(filter(None, [self.base, folder, IGNORE]))) as f:
            text = f.read().decode("utf-8", "replace")
        out = []
        for pattern, leaves_out, only_folders in ignore_rules(text, folder):
            try:
                out.append((re.compile(pattern), leaves_out, only_folders))
            except re.error:
                continue  # a line that is no pattern leaves nothing out
        return out

    def left_out(self, path: str, is_folder: bool, chain: list[str]) -> bool:
        """The last rule that fits decides, deeper files last."""
        for folder in reversed(chain):
            for pattern, leaves_out, only_folders in reversed(self.rules(folder)):
                if (is_folder or not only_folders) and pattern.match(path):
                    return leaves_out
        return False

    def open(self, folder: str, chain: list[str]) -> tuple[list[tuple[str, int]], list[str], list[str], int]:
        """Files (path, size) and folders of a folder, the ignore files that count below it, and how many entries it has."""
        from pyarrow import fs

        found = self.fs.get_file_info(fs.FileSelector(f"{self.base}/{folder}" if folder else self.base, allow_not_found=bool(folder)))
        if self.ignores and any(i.base_name == IGNORE and i.is_file for i in found):
            chain = [*chain, folder]
        files, folders = [], []
        for i in sorted(found, key=lambda i: i.base_name):
            path = f"{folder}/{i.base_name}" if folder else i.base_name
            is_folder = i.type == fs.FileType.Directory
            if (i.base_name.startswith(".") and not self.hidden) or self.left_out(path, is_folder, chain):
                continue
            if is_folder:
                # a link to a folder would be walked twice, or for ever
                if not (self.local and os.path.islink(i.path)) and (self.depth is None or path.count("/") + 2 <= self.depth):
                    folders.append(path)
            elif i.type == fs.FileType.File and (self.depth is None or path.count("/") + 1 <= self.depth):
                files.append((path, i.size))
        return files, folders, chain, len(found)


STEP = "path string, size long, chain array<string>"


def listing(spark: SparkSession, root: str, ignores: bool = True, hidden: bool = False, depth: int | None = None) -> DataFrame:
    """``path`` (below ``root``) and ``size`` of all files of a tree, each once.

    Hidden files and folders are left out unless ``hidden``, what the tree's
    ignore files leave out if ``ignores``; ``depth`` is the most parts a path may
    have. A link to a folder isn't followed. Names that begin with an underscore
    and empty files are like all others. A root that isn't there is an error.
    """
    shared.checkpoints(spark)
    limit = LISTED

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walker = Walker(root, ignores, hidden, depth)
        spent = 0
        for batch in batches:
            stack = [(f, c or []) for f, c in zip(batch.column("path").to_pylist(), batch.column("chain").to_pylist(), strict=True)]
            while stack:
                paths, sizes, chains = [], [], []
                while stack and len(paths) < 10_000:
                    folder, chain = stack.pop()
                    if spent >= limit:
                        paths.append(folder), sizes.append(None), chains.append(chain)
                        continue
                    files, folders, chain, seen = walker.open(folder, chain)
                    spent += seen + 1
                    stack += [(f, chain) for f in reversed(folders)]
                    paths += [p for p, _ in files]
                    sizes += [s for _, s in files]
                    chains += [None] * len(files)
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64()), pa.array(chains, pa.list_(pa.string()))], ["path", "size", "chain"])

    todo, done = spark.createDataFrame([("", None, [])], STEP), None
    while True:
        step = todo.mapInArrow(walk, STEP).checkpoint()
        files = step.filter("size is not null").select("path", "size")
        done = files if done is None else done.union(files)
        todo = step.filter("size is null")
        if todo.isEmpty():
            return done
        todo = todo.repartition(int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def contents(places: DataFrame, root: str) -> DataFrame:
    """``places`` and ``content``, the text of each file; undecodable bytes become replacement characters, an unreadable file null."""
    total = places.agg(F.coalesce(F.sum(F.col("size") + 4096), F.lit(0))).first()[0]
    names = [c for c in places.columns if c != "content"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = store(root)

        def text(path: str) -> str | None:
            try:
                with fs.open_input_stream(f"{base}/{path}") as f:
                    return f.read().decode("utf-8", "replace")
            except OSError:
                return None

        for batch in batches:
            paths, sizes = batch.column("path").to_pylist(), batch.column("size").to_pylist()
            begin = held = 0
            for i, size in enumerate([*sizes, 0]):
                if i == len(paths) or i - begin >= ROWS or (i > begin and held + size > BYTES):
                    if i > begin:
                        part = batch.slice(begin, i - begin)
                        yield pa.RecordBatch.from_arrays([*part.columns, pa.array([text(p) for p in paths[begin:i]], pa.string())], [*names, "content"])
                    begin, held = i, 0
                held += size

    from pyspark.sql.types import StringType, StructType

    parts = max(1, min(-(-total // TASK_BYTES), 100_000), min(places.sparkSession.sparkContext.defaultParallelism, total // (1 << 20)))
    return places.select(*names).repartition(int(parts)).mapInArrow(read, StructType(places.select(*names).schema.fields).add("content", StringType()))
