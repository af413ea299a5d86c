"""Syntax nodes of sources as rows, for patterns over them.

Python's are those of its ``ast``; the other languages' are the nested statements
of :mod:`codescope.sources.nested`. Names are leaves of kind ``identifier``, with
the field they stand in.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from codescope.sources import token_facts
from codescope.sources.nested import Node
from codescope.sources.python_facts import guarded

#: ``id`` counts from 0 in depth-first order; ``start`` and ``stop`` are code points of the file, null where they aren't known;
#: ``pos`` is the place among the siblings from 0, ``kids`` the number of children.
SCHEMA = "file string, lang string, id long, parent long, field string, kind string, line int, end_line int, start long, stop long, text string, pos long, kids long"


def placed(rows: list[dict]) -> list[dict]:
    """Rows of one file, in depth-first order, with ``pos`` and ``kids``."""
    kids: dict[int | None, int] = {}
    for row in sorted(rows, key=lambda r: r.get("id", 0)):
        row["pos"] = kids.get(row.get("parent"), 0)
        kids[row.get("parent")] = row["pos"] + 1
    for row in rows:
        row["kids"] = kids.get(row.get("id", 0), 0)
    return rows


def python_nodes(text: str) -> list[dict]:
    starts = [0]
    lines = text.split("\n")
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)
    at = lambda line, byte: starts[line - 1] + len(lines[line - 1].encode()[:byte].decode("utf-8", "replace"))
    rows: list[dict] = []
    stack: list[tuple[ast.AST | str, int | None, str | None, int]] = [(ast.parse(text), None, None, 1)]
    while stack:
        node, parent, field, line = stack.pop()
        mine = len(rows)
        if isinstance(node, str):
            rows.append({"id": mine, "parent": parent, "field": field, "kind": "identifier", "line": line, "end_line": line, "text": node})
            continue
        placed = hasattr(node, "lineno")
        line = node.lineno if placed else line
        row = {"id": mine, "parent": parent, "field": field, "kind": type(node).__name__, "line": line, "end_line": node.end_lineno if placed else line}
        if placed:
            row |= {"start": at(node.lineno, node.col_offset), "stop": at(node.end_lineno, node.end_col_offset)}
        if isinstance(node, ast.Constant):
            row["text"] = str(node.value)
        rows.append(row)
        below = []
        for name, value in ast.iter_fields(node):
            if isinstance(node, ast.Constant):
                continue
            below += [(v, mine, name, line) for v in (value if isinstance(value, list) else [value]) if isinstance(v, (ast.AST, str))]
        stack += reversed(below)
    return rows


def nested_nodes(text: str, lang: str) -> list[dict]:
    reader = token_facts.Reader("", text, lang)
    reader.read()
    rows: list[dict] = []
    stack: list[tuple[Node, int | None, str | None]] = [(reader.root, None, None)]
    while stack:
        node, parent, field = stack.pop()
        mine = len(rows)
        line, end = reader.span(node) if reader.toks and node.first < len(reader.toks) else (1, 1)
        rows.append({"id": mine, "parent": parent, "field": field, "kind": node.kind, "line": line, "end_line": end})
        if node.name and node.kind in ("fn", "class", "type"):
            rows.append({"id": mine + 1, "parent": mine, "field": "name", "kind": "identifier", "line": line, "end_line": line, "text": node.name})
        parts = [(k, mine, None) for k in node.kids] + [(k, mine, name) for k, name in ((node.body, "body"), (node.rest, "rest")) if k is not None]
        stack += reversed(parts)
    return rows


def nodes(files: DataFrame) -> DataFrame:
    """The nodes of ``files(path, lang, content)``; a file that can't be read gives one row of kind ``error``, an unknown language none."""
    schema = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text, lang in zip(*(batch.column(c).to_pylist() for c in ("path", "content", "lang")), strict=True):
                rows = placed(guarded(path, lambda: python_nodes(text) if lang == "python" else nested_nodes(text, lang)))  # noqa: B023
                yield pa.RecordBatch.from_pylist([{"id": 0, **{k: v for k, v in r.items() if k != "name"}, "file": path, "lang": lang} for r in rows], schema)

    return files.filter(F.col("lang").isin("python", *token_facts.LANGUAGES)).select("path", "content", "lang").mapInArrow(read, SCHEMA)
