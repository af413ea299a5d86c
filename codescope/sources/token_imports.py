"""Imports of a file's tokens: what comments and texts hold isn't one, and a statement may take several lines."""

from __future__ import annotations

import re

from codescope.sources.tokens import QUOTED, SINGLE, SLASHED, Token

#: Languages whose imports are read from tokens.
LANGUAGES = ("javascript", "typescript", "go", "java", "c_sharp", "julia", "c", "cpp", "ruby")
#: An include outside of comments and texts.
INCLUDE = re.compile(rf'(?:{SLASHED})|(?m:^[ \t]*\#[ \t]*include[ \t]*(?:"(?P<local>[^"\n]+)"|<(?P<system>[^>\n]+)>))|{QUOTED}|{SINGLE}', re.S)
REQUIRE = frozenset(["require", "require_relative", "load"])


def includes(text: str) -> list[tuple[str, int]]:
    out, line, at = [], 1, 0
    for m in INCLUDE.finditer(text):
        if module := m["local"] or m["system"]:
            line += text.count("\n", at, m.start())
            at = m.start()
            out.append((module, line))
    return out


class Statements:
    def __init__(self, toks: list[Token]) -> None:
        self.toks = toks

    def text(self, at: int) -> str:
        return self.toks[at].text if 0 <= at < len(self.toks) else ""

    def kind(self, at: int) -> str:
        return self.toks[at].kind if 0 <= at < len(self.toks) else ""

    def begins(self, at: int) -> bool:
        """Whether a statement begins here."""
        return at == 0 or self.text(at - 1) in (";", "{", "}") or self.toks[at].line > self.toks[at - 1].end

    def dotted(self, at: int) -> tuple[str, int]:
        """A name with its parts after dots, and where it ends."""
        parts = []
        while self.kind(at) == "name":
            parts.append(self.text(at))
            at += 1
            if self.text(at) != "." or self.kind(at + 1) != "name":
                break
            at += 1
        return ".".join(parts), at

    def script(self, i: int) -> list[str]:
        if self.text(i + 1) in ("(", "."):
            return []
        for at in range(i + 1, len(self.toks)):
            if self.kind(at) == "string":
                return [self.text(at)[1:-1]]
            if self.text(at) in (";", "(", "="):
                break
        return []

    def go(self, i: int) -> list[tuple[str, int]]:
        found, at, block = [], i + 1, self.text(i + 1) == "("
        while at < len(self.toks) and self.text(at) != ")" and (block or not found) and at < i + (10**9 if block else 3):
            if self.kind(at) == "string" and self.text(at).startswith('"'):
                found.append((self.text(at)[1:-1], self.toks[at].line))
            at += 1
        return found

    def java(self, i: int) -> list[str]:
        name, at = self.dotted(i + 1 + (self.text(i + 1) == "static"))
        if self.text(at) == "." and self.text(at + 1) == "*":
            at += 2
        return [name] if "." in name and self.text(at) == ";" else []

    def c_sharp(self, i: int) -> list[str]:
        at = i + 1 + (self.text(i + 1) == "static")
        if self.kind(at) == "name" and self.text(at + 1) == "=":
            at += 2
        name, at = self.dotted(at)
        return [name] if name and self.text(at) == ";" else []

    def julia(self, i: int) -> list[str]:
        out, at = [], i + 1
        while True:
            name, end = self.dotted(at)
            if not name or (end > at and self.toks[at].line > self.toks[at - 1].end and self.text(at - 1) != ","):
                return out
            out.append(name)
            if self.text(end) != ",":
                return out
            at = end + 1

    def ruby(self, i: int) -> list[str]:
        at = i + 1 + (self.text(i + 1) == "(")
        text = self.text(at)
        return [text[1:-1]] if self.kind(at) == "string" and text[:1] in ("'", '"') and "#{" not in text and self.text(i - 1) not in (".", "def", "::") else []


def found(toks: list[Token], text: str, lang: str) -> list[tuple[str, int]]:
    """Module and line of each import, in order."""
    if lang in ("c", "cpp"):
        return includes(text)
    s, out = Statements(toks), []
    for i, t in enumerate(toks):
        if t.kind != "name":
            continue
        if lang == "ruby":
            if t.text in REQUIRE:
                out += [(m, t.line) for m in s.ruby(i)]
        elif lang == "c_sharp":
            if t.text == "using" and (s.begins(i) or s.text(i - 1) == "global"):
                out += [(m, t.line) for m in s.c_sharp(i)]
        elif t.text == "import" or (t.text == "using" and lang == "julia"):
            if not s.begins(i):
                continue
            if lang == "go":
                out += s.go(i)
            else:
                out += [(m, t.line) for m in (s.java(i) if lang == "java" else s.julia(i) if lang == "julia" else s.script(i))]
    return [(m, line) for m, line in out if m]
