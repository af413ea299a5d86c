"""Facts of sources in ten languages, from tokens and nested statements; the rows are those of :mod:`python_facts`.

A branch without braces counts as one with them. Named functions, methods and
anonymous ones have a row each; a method's ``owner`` is its class where it stands
outside of it (Go receivers, Rust impls, C++ qualified names).
"""

from __future__ import annotations

import re

from codescope.sources import nested, python_facts, token_imports
from codescope.sources.ended import Ended
from codescope.sources.inventory import Inventory
from codescope.sources.nested import Curly, Node
from codescope.sources.tokens import CURLY, ENDED, MARKS, OPERATORS, Token, tokens

LANGUAGES = (*CURLY, *ENDED)
#: Types of texts.
TEXT_TYPE = re.compile(r"\b([sS]tring|str|String|AbstractString|string_view|QString)\b|\bchar\s*\*")
#: Languages that have classes.
HAVE_CLASSES = frozenset(["javascript", "typescript", "go", "rust", "java", "c_sharp", "cpp", "ruby"])
#: Languages whose clones are compared with their heads.
WHOLE = frozenset(["c", "cpp", "ruby"])
JS_MUTATORS = frozenset("push pop splice shift unshift delete set clear add".split())
NAME_OF_TYPE_FIRST = frozenset(["java", "c_sharp", "c", "cpp"])


class Reader:
    def __init__(self, file: str, text: str, lang: str) -> None:
        self.file, self.text, self.lang = file, text, lang
        self.rows: list[dict] = []

    def read(self) -> list[dict]:
        self.toks = tokens(self.text, self.lang)
        self.root = (Curly if self.lang in CURLY else Ended)(self.toks, self.lang).file()
        loc = self.text.count("\n") + (0 if not self.text or self.text.endswith("\n") else 1)
        valued = self.lang in ("javascript", "typescript")  # const f = () => ... counts
        top = sum(k.kind in ("class", "type") or k.kind == "fn" and (valued or k.name != nested.ANONYMOUS) or k.kind == "plain" and k.body is not None and bool(k.name) for k in self.root.kids)
        self.add("module", self.file, 1, self.text.count("\n") + 1, definitions=top, loc=loc)
        stem = self.file.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        self.visit(self.root, True, [stem])
        self.adopt()
        spans = [(r["end_line"] - r["line"], r["line"], r["end_line"], r["name"]) for r in self.rows if r["kind"] == "function"]
        for module, line in token_imports.found(self.toks, self.text, self.lang):
            around = min((x for x in spans if x[1] < line <= x[2]), default=None)
            self.add("import", module, line, line, owner=around[3] if around else None)
        for name, line, abstract in Inventory(self.toks, self.lang).found():
            self.add("type", name, line, line, abstract=abstract)
        return self.rows

    def add(self, kind: str, name: str, line: int, end: int, **facts) -> None:
        self.rows.append({"file": self.file, "kind": kind, "name": name, "line": line, "end_line": end, **facts})

    def span(self, node: Node) -> tuple[int, int]:
        last = max(node.first, min(node.last, len(self.toks)) - 1)
        return self.toks[node.first].line, self.toks[last].end

    def visit(self, node: Node, top: bool, scopes: list[str]) -> None:
        for k in node.all_kids():
            if k.kind == "fn":
                self.function(k, top, [*scopes, k.name])
                self.visit(k, False, [*scopes, k.name])
            elif k.kind == "class" and k.name and self.lang in HAVE_CLASSES:
                held = self.toks[k.first : k.last]
                used = sorted({t.text for t in held if t.kind == "name" and t.text[:1].isupper()})
                methods = sum(m.kind == "fn" for b in (k.body,) if b for m in b.kids)
                self.add("class", k.name, *self.span(k), bases=k.bases, used=used, definitions=methods)
                self.visit(k, top, [*scopes, k.name])
            else:
                self.visit(k, top and node is self.root and k.kind in ("plain", "type"), scopes)

    def adopt(self) -> None:
        """What methods outside of a class's body use is used by the class."""
        for c in (r for r in self.rows if r["kind"] == "class"):
            mine = [r for r in self.rows if r["kind"] == "function" and r["owner"] == c["name"] and not c["line"] <= r["line"] <= c["end_line"]]
            c["used"] = sorted({*c["used"], *(u for r in mine for u in r["used"])})
            c["definitions"] += len(mine)

    def function(self, f: Node, top: bool, scopes: list[str]) -> None:
        body = f.body or f
        held = self.toks[body.first : body.last]
        holes = [(k.first, k.last) for k in inner(body)]
        own = [t for at, t in enumerate(held, body.first) if not any(a <= at < b for a, b in holes)]
        words, marks = OPERATORS[self.lang], MARKS[self.lang]
        params = self.params(f)
        called = {t.text for t, after in zip(own, [*own[1:], Token("sign", "", 0, 0)], strict=True) if t.kind == "name" and after.text == "(" and t.text not in words and t.text not in nested.NOT_DEFINED}
        ccx, cog = nested.complexity(f)
        self.add(
            "function", f.name, *self.span(f), top=top, owner=f.owner, ccx=ccx, cog=cog, npath=min(nested.paths(body), python_facts.MOST_PATHS),
            operators=[t.text for t in own if t.kind == "name" and t.text in words or t.kind == "sign" and t.text not in marks],
            operands=[t.text for t in own if t.kind in ("number", "string") or t.kind == "name" and t.text not in words],
            literals=[t.text for t in held if t.kind == "number"], identifiers=[t.text for t in own if t.kind == "name" and t.text not in words] + [name for name, _ in params], callees=sorted(called),
            mutations=self.mutations(own, params), sentinels=[{"param": name, "annotated": bool(TEXT_TYPE.search(kind))} for name, kind in params if name.lower().rstrip("_") in python_facts.SENTINELS],
            shape=[t.text if t.kind == "sign" or t.text in words else t.kind for t in (self.toks[f.first : f.last] if self.lang in WHOLE else held)], used=sorted({t.text for t in self.toks[f.first : f.last] if t.kind == "name" and t.text[:1].isupper()}), scopes=scopes,
        )

    def params(self, f: Node) -> list[tuple[str, str]]:
        """Names of parameters with the text of their types."""
        if f.params is None:
            return []
        first, last = f.params
        pieces, depth = [[]], 0
        for t in self.toks[first:last]:
            if t.text in ("(", ")", "|") and depth <= (t.text == ")"):
                depth += (t.text == "(") - (t.text == ")")
                continue
            depth += (t.text in ("(", "[", "{", "<")) - (t.text in (")", "]", "}", ">"))
            if t.text == "," and depth <= 1:
                pieces.append([])
            else:
                pieces[-1].append(t)
        out = []
        for piece in pieces:
            cut = next((n for n, t in enumerate(piece) if t.text == "="), len(piece))
            piece = piece[:cut]
            names = [t.text for t in piece if t.kind == "name"]
            if not names:
                continue
            name = names[-1] if self.lang in NAME_OF_TYPE_FIRST else next((n for n in names if n not in ("mut", "ref", "public", "private", "readonly")), names[0])
            out.append((name, " ".join(t.text for t in piece)))
        return out

    def mutations(self, own: list[Token], params: list[tuple[str, str]]) -> list[dict]:
        """Changes of what a parameter holds."""
        out, names = [], {n for n, _ in params}
        pointers = {n for n, kind in params if "*" in kind and "const" not in kind.split()} | ({n for n, kind in params if "&" in kind and "const" not in kind.split()} if self.lang == "cpp" else set())
        for n, t in enumerate(own):
            after = [x.text for x in own[n + 1 : n + 4]]
            if self.lang in ("javascript", "typescript") and t.text in names and after[:1] == ["."] and len(after) > 2 and after[1] in JS_MUTATORS and after[2] == "(":
                out.append({"param": t.text, "method": after[1], "line": t.line})
            elif self.lang == "go" and t.text == "append" and after[:1] == ["("] and len(after) > 1 and after[1] in names:
                out.append({"param": after[1], "method": "append", "line": t.line})
            elif self.lang in ("c", "cpp") and t.text in pointers and (n == 0 or own[n - 1].text not in (".", "->")):
                end = n + 1
                stars = n > 0 and own[n - 1].text == "*" and (n == 1 or own[n - 2].text in (";", "{", "}", ")", "("))
                while end < len(own) and own[end].text in ("->", ".", "["):
                    depth = own[end].text == "["
                    end += 1
                    while depth and end < len(own):
                        depth += (own[end].text == "[") - (own[end].text == "]")
                        end += 1
                    if own[end - 1].text in ("->", "."):
                        end += 1
                while stars and end < len(own) and own[end].text == ")":
                    end += 1
                sign = own[end].text if end < len(own) else ""
                if (stars or end > n + 1) and (sign in ("=", "++", "--") or sign[-1:] == "=" and sign not in ("==", "!=", "<=", ">=")):
                    out.append({"param": t.text, "method": "*" if stars else own[n + 1].text, "line": t.line})
        return out


def inner(node: Node) -> list[Node]:
    """The outermost functions inside a node."""
    out, stack = [], list(node.all_kids())
    while stack:
        k = stack.pop()
        if k.kind == "fn":
            out.append(k)
        else:
            stack += k.all_kids()
    return out


def read_file(path: str, text: str, lang: str) -> list[dict]:
    """The rows of one file; whatever goes wrong in it is one row of kind error."""
    if lang == "python":
        return python_facts.read_file(path, text)
    return python_facts.guarded(path, lambda: Reader(path, text, lang).read())
