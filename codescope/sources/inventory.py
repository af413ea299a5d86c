"""Declared types of a file's tokens, and which of them are abstract, by language.

A declaration is what says so, not what looks like it: type arguments
(``<class T>``), constraints (``where T : class``), forward declarations, class
values (``= class A {}``) and ``X.class`` are none.
"""

from __future__ import annotations

from codescope.sources.tokens import Token

#: By language, words that declare an abstract type, a concrete one, and one whose modifiers decide.
DECLARE = {
    "java": (("interface",), ("record",), ("class",)),
    "c_sharp": (("interface",), ("struct", "record"), ("class",)),
    "typescript": (("interface",), (), ("class",)),
    "javascript": ((), ("class",), ()),
    "rust": (("trait",), ("struct", "enum"), ()),
    "ruby": (("module",), ("class",), ()),
    "c": ((), ("struct", "union", "enum"), ()),
    "cpp": ((), ("struct", "union", "enum"), ("class",)),
}
#: What stands before a class that is a value.
VALUE = frozenset("= ( , return ? : && || => [".split())


class Inventory:
    def __init__(self, toks: list[Token], lang: str) -> None:
        self.toks, self.lang = toks, lang

    def text(self, at: int) -> str:
        return self.toks[at].text if 0 <= at < len(self.toks) else ""

    def is_name(self, at: int) -> bool:
        return 0 <= at < len(self.toks) and self.toks[at].kind == "name"

    def found(self) -> list[tuple[str, int, bool]]:
        """Name, line and whether it is abstract of each declared type, in order."""
        if self.lang == "go":
            return self.go()
        if self.lang not in DECLARE:
            return []
        abstract, concrete, decided = DECLARE[self.lang]
        out = []
        for i, t in enumerate(self.toks):
            if t.kind != "name":
                continue
            if t.text == "typedef" and self.lang in ("c", "cpp"):
                out += self.typedefs(i)
            elif t.text in abstract + concrete + decided and (name := self.name(i)) is not None:
                out.append((self.text(name), t.line, t.text in abstract or (t.text in decided and self.is_abstract(i, name))))
        return out

    def name(self, i: int) -> int | None:
        """Where the name of what the word at ``i`` declares stands, if it declares something."""
        word, before, at = self.text(i), self.text(i - 1), i + 1
        if before in (".", "@", "::"):
            return None
        if self.lang == "c_sharp":
            if before in (":", ",", "record"):
                return None
            at += word == "record" and self.text(at) in ("class", "struct")
        if self.lang == "cpp" and word == "enum":
            at += self.text(at) in ("class", "struct")
        if (word == "class" and before == "enum") or not self.is_name(at):
            return None
        after = self.text(at + 1)
        if self.lang in ("c", "cpp"):
            at_body = at + 1 + (after == "final")
            return at if before not in ("<", ",") and self.text(at_body) in ("{", ":") and (self.lang == "cpp" or after == "{") else None
        if self.lang in ("javascript", "typescript"):
            return at if before not in VALUE and after in ("{", "<", "extends", "implements") else None
        if word == "record":
            return at if after in ("(", "<", ":", "{", ";") else None
        if self.lang == "c_sharp" and self.text(at) == "where":
            return None
        if self.lang == "ruby":
            return at if self.text(at)[:1].isupper() and after != "::" else None
        return at

    def is_abstract(self, i: int, name: int) -> bool:
        if self.lang == "cpp":
            return self.pure(name)
        at = i - 1
        while at >= 0 and self.text(at) not in (";", "{", "}"):
            if self.text(at) == "abstract":
                return True
            at -= 1
        return False

    def pure(self, name: int) -> bool:
        """Whether a class has a method ``= 0`` of its own and isn't final."""
        if self.text(name + 1) == "final":
            return False
        at, depth = name, 0
        while at < len(self.toks):
            t = self.text(at)
            depth += (t == "{") - (t == "}")
            if depth == 0 and t == "}":
                return False
            if depth == 1 and t == "=" and self.text(at + 1) == "0" and self.text(at + 2) == ";" and (self.text(at - 1) == ")" or self.text(at - 1) in ("const", "noexcept", "override", "volatile", "&", "&&")):
                return True
            at += 1
        return False

    def typedefs(self, i: int) -> list[tuple[str, int, bool]]:
        """The plain names that a typedef declares: no pointers, functions or arrays."""
        out, at, depth = [], i + 1, 0
        while at < len(self.toks):
            t = self.text(at)
            if depth == 0 and t in (",", ";") and self.is_name(at - 1) and self.text(at - 2) not in ("*", "&"):
                out.append((self.text(at - 1), self.toks[i].line, False))
            if depth == 0 and t == ";":
                break
            depth += (t in ("{", "(", "[")) - (t in ("}", ")", "]"))
            at += 1
        return out

    def go(self) -> list[tuple[str, int, bool]]:
        """``type A struct``, with type parameters and in a group."""
        out, i, group, depth = [], 0, False, 0
        while i < len(self.toks):
            t = self.text(i)
            if t == "type" and depth == 0 and self.text(i + 1) == "(":
                group, i = True, i + 2
                continue
            if group and depth == 0 and t == ")":
                group = False
            elif self.is_name(i) and depth == 0 and (self.text(i - 1) == "type" or (group and (self.text(i - 1) in ("(", ";", "}") or self.toks[i].line > self.toks[i - 1].end))):
                at = i + 1
                if self.text(at) == "[":
                    inside = 1
                    while inside and at + 1 < len(self.toks):
                        at += 1
                        inside += (self.text(at) == "[") - (self.text(at) == "]")
                    at += 1
                if self.text(at) in ("struct", "interface"):
                    out.append((t, self.toks[i].line, self.text(at) == "interface"))
            if group or t in ("{", "}"):
                depth += (t == "{") - (t == "}")
            i += 1
        return out
