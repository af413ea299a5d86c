"""One pass over Python sources: a row of facts for each function, class, import and module.

Everything that needs the tree is computed here, inside the row of its file;
all counting, joining and comparing is left to DataFrame operators.
"""

from __future__ import annotations

import ast
import bisect
import io
import keyword
import re
import sys
import tokenize
from collections.abc import Callable, Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

SCHEMA = """file string, lang string, kind string, name string, line int, end_line int, top boolean, owner string, ccx int, cog int, npath decimal(38,0),
operators array<string>, operands array<string>, literals array<string>, identifiers array<string>, callees array<string>,
mutations array<struct<param:string,method:string,line:int>>, sentinels array<struct<param:string,annotated:boolean>>, shape array<string>, bases array<string>, used array<string>, scopes array<string>, definitions int, loc int, abstract boolean"""
MOST_PATHS = 10**37
#: Python frames of a walk down a tree; deeper trees are errors.
DEEPEST = 100_000

#: Operator words and signs, collection methods that change their object, their type names, names of string switches.
OPERATOR_WORDS = frozenset("def if else elif for while return class import from try except finally raise with as yield lambda del assert break continue pass and or not in is".split())
OPERATOR_SIGNS = frozenset("= + - * / ** // % == != < > <= >= | & ^ ~ << >> += -= *= /= //= %= **= -> @".split())
MUTATORS = frozenset("append extend insert remove pop clear sort reverse update setdefault popitem add discard intersection_update difference_update symmetric_difference_update".split())
COLLECTIONS = frozenset("list List dict Dict set Set MutableSequence MutableMapping MutableSet Sequence Mapping deque Deque defaultdict Counter".split())
SENTINELS = frozenset("status mode kind level format role action category severity phase stage style direction state type method strategy algorithm protocol encoding codec backend driver engine".split())

ABSTRACT = re.compile(r"\b(ABC|Protocol|ABCMeta)\b")
#: Leaves of their own.
CONSTANTS = {"True": "true", "False": "false", "None": "none", "...": "ellipsis"}

PARTS_OF_TEXTS = {getattr(tokenize, f"FSTRING_{k}"): f"string_{v}" for k, v in (("START", "start"), ("MIDDLE", "content"), ("END", "end")) if hasattr(tokenize, f"FSTRING_{k}")}
FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda)
LOOPS = (ast.For, ast.AsyncFor, ast.While)


class Reader:
    def __init__(self, file: str, text: str) -> None:
        self.file, self.text, self.lines = file, text, text.split("\n")
        self.rows: list[dict] = []
        try:
            self.tree = ast.parse(text)
            self.tokens = list(tokenize.generate_tokens(io.StringIO(text).readline))
        except (SyntaxError, ValueError, tokenize.TokenError, RecursionError):
            self.tree, self.tokens = None, []
        self.starts = [t.start for t in self.tokens]

    def read(self) -> list[dict]:
        if self.tree is None:
            self.add("error", self.file, 1, 1)
            return self.rows
        loc = self.text.count("\n") + (0 if not self.text or self.text.endswith("\n") else 1)
        kinds = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
        self.add("module", self.file, 1, len(self.lines), definitions=sum(isinstance(n, kinds) for n in self.tree.body), loc=loc)
        stem = self.file.rsplit("/", 1)[-1].removesuffix(".py")
        self.visit(self.tree, None, True, [stem])
        return self.rows

    def add(self, kind: str, name: str, line: int, end: int, **facts) -> None:
        self.rows.append({"file": self.file, "kind": kind, "name": name, "line": line, "end_line": end, **facts})

    def visit(self, node: ast.AST, owner: str | None, top: bool, scopes: list[str]) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, FUNCTIONS):
                name = "<lambda>" if isinstance(child, ast.Lambda) else child.name
                self.function(child, top, [*scopes, name])
                self.visit(child, name, False, [*scopes, name])
            elif isinstance(child, ast.ClassDef):
                used = sorted({n.id for n in ast.walk(child) if isinstance(n, ast.Name) and n.id[:1].isupper()})
                methods = sum(isinstance(n, FUNCTIONS[:2]) for n in child.body)
                self.add("class", child.name, child.lineno, child.end_lineno, bases=[b.id if isinstance(b, ast.Name) else b.attr for b in child.bases if isinstance(b, (ast.Name, ast.Attribute))], used=used, definitions=methods)
                above = " ".join(ast.unparse(b) for b in [*child.bases, *(k.value for k in child.keywords)])
                self.add("type", child.name, child.lineno, child.lineno, abstract=bool(ABSTRACT.search(above)))
                self.visit(child, owner, False, [*scopes, child.name])
            else:
                if isinstance(child, ast.Import):
                    for a in child.names:
                        self.add("import", a.name, child.lineno, child.end_lineno, owner=owner)
                elif isinstance(child, ast.ImportFrom) and child.module and not child.level:
                    self.add("import", child.module, child.lineno, child.end_lineno, owner=owner)
                elif isinstance(child, ast.ImportFrom) and owner:
                    self.add("import", "." * child.level + (child.module or ""), child.lineno, child.end_lineno, owner=owner)
                self.visit(child, owner, False, scopes)

    def function(self, f, top: bool, scopes: list[str]) -> None:
        body = [f.body] if isinstance(f, ast.Lambda) else f.body
        self.ccx, self.cog = 1, 0
        for n in body:
            self.decide(n, 0, None)
        inner = list(walk_inside(body))
        every = [n for b in body for n in ast.walk(b)]
        operators, operands = self.words(f, body)
        args = [] if isinstance(f, ast.Lambda) else [*f.args.posonlyargs, *f.args.args, *f.args.kwonlyargs]
        typed = {a.arg for a in args if a.annotation is not None and {n.id if isinstance(n, ast.Name) else n.attr for n in ast.walk(a.annotation) if isinstance(n, (ast.Name, ast.Attribute))} & COLLECTIONS}
        calls = [n for n in inner if isinstance(n, ast.Call)]
        changed = [{"param": c.func.value.id, "method": c.func.attr, "line": c.lineno} for c in calls if isinstance(c.func, ast.Attribute) and isinstance(c.func.value, ast.Name) and c.func.value.id in typed and c.func.attr in MUTATORS]
        names = [n.id for n in inner if isinstance(n, ast.Name)] + [a.arg for a in args]
        texts = [ast.get_source_segment(self.text, n) or repr(n.value) for n in every if isinstance(n, ast.Constant) and isinstance(n.value, (int, float)) and not isinstance(n.value, bool)]
        switches = [{"param": a.arg, "annotated": a.annotation is not None and any(isinstance(n, ast.Name) and n.id == "str" for n in ast.walk(a.annotation))} for a in args if a.arg.lower().rstrip("_") in SENTINELS]
        self.add(
            "function", "<lambda>" if isinstance(f, ast.Lambda) else f.name, f.lineno, f.end_lineno, top=top, ccx=self.ccx, cog=self.cog, npath=min(paths(body), MOST_PATHS), operators=operators, operands=operands,
            literals=texts, identifiers=names, callees=sorted({c.func.id if isinstance(c.func, ast.Name) else c.func.attr for c in calls if isinstance(c.func, (ast.Name, ast.Attribute))}),
            mutations=changed, sentinels=switches, scopes=scopes, shape=self.leaves(body),
        )

    def decide(self, n: ast.AST, depth: int, parent: ast.AST | None) -> None:
        """Cyclomatic and cognitive counts of one node and what it holds, nested functions left out."""
        if isinstance(n, FUNCTIONS):
            return
        below = depth
        if isinstance(n, ast.If):
            self.ccx += 1
            self.cog += 1 + depth
            self.chain(n, depth + 1)
            return
        if isinstance(n, (*LOOPS, ast.ExceptHandler, ast.IfExp)):
            self.ccx += 1
            self.cog += 1 + depth
            below += 1
        elif isinstance(n, ast.Match):
            below += 1
        elif isinstance(n, ast.match_case):
            self.ccx += 1
            self.cog += 1 + max(0, depth - 1)
        elif isinstance(n, ast.BoolOp):
            self.ccx += len(n.values) - 1
            self.cog += 1
        for c in ast.iter_child_nodes(n):
            self.decide(c, below, n)

    def chain(self, n: ast.If, depth: int) -> None:
        """An if with its elifs, which count on the level of the if."""
        for c in (n.test, *n.body):
            self.decide(c, depth, n)
        if len(n.orelse) == 1 and isinstance(n.orelse[0], ast.If) and self.lines[n.orelse[0].lineno - 1][n.orelse[0].col_offset :].startswith("elif"):
            self.ccx += 1
            self.cog += depth
            self.chain(n.orelse[0], depth)
        else:
            for c in n.orelse:
                self.decide(c, depth, n)

    def words(self, f: ast.AST, body: list[ast.AST]) -> tuple[list[str], list[str]]:
        """Operator and operand tokens of a body, nested functions left out."""
        start, end = (body[0].lineno, self.column(body[0].lineno, body[0].col_offset)), (body[-1].end_lineno, self.column(body[-1].end_lineno, body[-1].end_col_offset))
        holes = [((n.lineno, self.column(n.lineno, n.col_offset)), (n.end_lineno, self.column(n.end_lineno, n.end_col_offset))) for b in body for n in ast.walk(b) if isinstance(n, FUNCTIONS)]
        operators, operands = [], []
        for t in self.tokens:
            if t.start < start or t.end > end or any(a <= t.start and t.end <= b for a, b in holes):
                continue
            if t.type == tokenize.NAME and t.string in OPERATOR_WORDS or t.type == tokenize.OP and t.string in OPERATOR_SIGNS:
                operators.append(t.string)
            elif t.type in (tokenize.NAME, tokenize.NUMBER, tokenize.STRING):
                operands.append(t.string)
        return operators, operands

    def leaves(self, body: list[ast.AST]) -> list[str]:
        """The kinds of a body's leaves in their order: signs and keywords as they are, names, numbers and the parts of texts by their kind."""
        first, last = self.position(body[0], False), self.position(body[-1], True)
        a, b = bisect.bisect_left(self.starts, first), bisect.bisect_left(self.starts, last)
        out: list[str] = []
        for t in self.tokens[a:b]:
            if t.type == tokenize.NAME or t.type == tokenize.OP:
                out.append(CONSTANTS.get(t.string) or (t.string if t.type == tokenize.OP or keyword.iskeyword(t.string) else "identifier"))
            elif t.type == tokenize.NUMBER:
                out.append("integer" if re.fullmatch(r"0[xXbBoO][\w]+|[\d_]+", t.string) else "float")
            elif t.type == tokenize.STRING:
                out += ["string_start", *(["string_content"] if t.string.strip("rRbBuUfF").strip("\"'") else []), "string_end"]
            elif t.type == tokenize.COMMENT:
                out.append("comment")
            elif t.type in PARTS_OF_TEXTS:
                out.append(PARTS_OF_TEXTS[t.type])
        return out

    def position(self, n: ast.AST, end: bool) -> tuple[int, int]:
        return (n.end_lineno, self.column(n.end_lineno, n.end_col_offset)) if end else (n.lineno, self.column(n.lineno, n.col_offset))

    def column(self, line: int, byte: int) -> int:
        return len(self.lines[line - 1].encode()[:byte].decode("utf-8", "replace"))


def walk_inside(body: list[ast.AST]) -> Iterator[ast.AST]:
    stack = list(body)
    while stack:
        n = stack.pop()
        if not isinstance(n, FUNCTIONS):
            yield n
            stack.extend(ast.iter_child_nodes(n))


def paths(block: list[ast.AST]) -> int:
    """Acyclic paths through a sequence: the product of its statements'."""
    total = 1
    for n in block:
        total *= paths_of(n)
    return total


def paths_of(n: ast.AST) -> int:
    if isinstance(n, ast.If):
        total, last = paths(n.body), n.orelse
        while len(last) == 1 and isinstance(last[0], ast.If) and last[0].col_offset == n.col_offset:
            total += paths(last[0].body)
            last = last[0].orelse
        return total + (paths(last) if last else 1)
    if isinstance(n, LOOPS):
        return paths(n.body) + 1
    if isinstance(n, ast.Match):
        return max(1, sum(paths(c.body) for c in n.cases))
    if isinstance(n, (ast.Try, ast.TryStar)):
        return paths(n.body) + sum(paths(h.body) for h in n.handlers)
    if isinstance(n, (*FUNCTIONS, ast.ClassDef)):
        return 1 if isinstance(n, FUNCTIONS) else paths(n.body)
    total = 1
    for c in ast.iter_child_nodes(n):
        total *= paths_of(c)
    return total


def guarded(path: str, read: Callable[[], list[dict]]) -> list[dict]:
    """The rows of one file; whatever goes wrong in it is one row of kind error."""
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, DEEPEST))
    try:
        return read()
    except Exception as e:  # one file must not fail the scan of a tree
        return [{"file": path, "kind": "error", "name": f"{path}: {type(e).__name__}", "line": 1, "end_line": 1}]
    finally:
        sys.setrecursionlimit(limit)


def read_file(path: str, text: str) -> list[dict]:
    return guarded(path, lambda: Reader(path, text).read())


def facts(files: DataFrame) -> DataFrame:
    """Facts of the files of ``files(path, lang, content)`` in the languages that are read; a file that can't be read gives one row of kind error."""
    from codescope.sources import token_facts

    schema = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for p, t, lang in zip(*(batch.column(c).to_pylist() for c in ("path", "content", "lang")), strict=True) for r in token_facts.read_file(p, t, lang)]
            langs = dict(zip(batch.column("path").to_pylist(), batch.column("lang").to_pylist(), strict=True))
            for r in rows:
                r["lang"] = langs[r["file"]]
                if "npath" in r:
                    r["npath"] = Decimal(r["npath"])
            yield pa.RecordBatch.from_pylist(rows, schema)

    return files.filter(F.col("lang").isin("python", *token_facts.LANGUAGES)).select("path", "lang", "content").mapInArrow(parse, SCHEMA)
