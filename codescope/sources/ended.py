"""Statements of languages whose blocks run to an ``end``."""

from __future__ import annotations

from codescope.sources.nested import ANONYMOUS, JOINS, Node, Stream, bools

#: Words that open a block, and words that part one.
OPENS = {
    "ruby": frozenset("def class module if unless while until for case begin do".split()),
    "julia": frozenset("function macro if for while try begin let quote struct module baremodule do".split()),
}
PARTS = frozenset("end else elsif elseif when in rescue ensure catch finally".split())
#: Words after which an expression begins.
BEGINS = frozenset("then do else begin return and or not = ( [ , ; && || ! -> { | += -= *= ||= &&= << => ? :".split())


class Ended(Stream):
    def file(self) -> Node:
        root = Node("block", 0)
        while not self.done():
            root.kids += self.run(frozenset())
            self.i += 1  # a stray end
        root.last = len(self.toks)
        return root

    def is_word(self) -> bool:
        """Whether the token is a keyword here, not a method or a key."""
        return self.kind() == "name" and self.text(-1) not in (".", "&.", "def", "::") and not (self.lang == "ruby" and self.text(1) == ":" and self.text() not in ("else", "then", "do", "begin") and self.text(-1) != "?")

    def starts(self) -> bool:
        """Whether an expression starts here."""
        return self.i == 0 or self.new_line() or self.text(-1) in BEGINS

    def run(self, until: frozenset[str], line: bool = False, group: bool = False, stop: tuple[str, ...] = ()) -> list[Node]:
        """What there is up to a word of ``until``, with ``line`` the end of the line, in a group its closing bracket."""
        kids: list[Node] = []
        ops: list[str] = []
        first = self.i

        def settle() -> None:
            if ops:
                kids.append(bools(list(ops), self.i))
                ops.clear()

        while not self.done():
            t = self.text()
            if not group and self.new_line() and self.text(-1) not in (",", "&&", "||", "and", "or", "\\", "=", "+", "-", ".", "?") and not (t == "." and self.kind(1) == "name"):
                settle()
                if line and self.i > first:
                    break
            if t in stop or line and t == ";" and not group:
                break
            if t in (")", "]", "}"):
                break
            word = self.is_word()
            if word and not group and (t in until or t == "end"):
                break
            if word and t in OPENS[self.lang] and (kid := self.opened(t, group)) is not None:
                kids.append(kid)
                continue
            if word and self.lang == "ruby" and t in ("if", "unless", "while", "until", "rescue") and not self.starts():
                node = Node("mod", self.i)
                node.nests = t == "unless"
                self.i += 1
                kids.append(node)
                continue
            if self.lang == "julia" and not group and self.starts() and (short := self.short()) is not None:
                kids.append(short)
                continue
            if t == "->":
                settle()
                kids.append(self.lambda_(group))
            elif t in ("(", "["):
                self.i += 1
                kids += self.run(frozenset(), group=True)
                self.i += 1
            elif t == "{":
                kids.append(self.braces())
            elif t in JOINS and (self.kind() == "sign" or self.lang == "ruby"):
                ops.append(t)
                self.i += 1
            elif t == "?" and self.value_before() and self.kind() == "sign":
                settle()
                self.i += 1
                node = Node("ternary", self.i)
                node.kids = self.run(until, line=True, group=group, stop=(",", *stop))
                node.last = self.i
                kids.append(node)
            else:
                if t in (",", ";", "=", "=>", ":", "return"):
                    settle()
                self.i += 1
        settle()
        return kids

    def body(self, node: Node, until: frozenset[str] = frozenset()) -> None:
        """Statements up to ``end`` or a part of ``until``."""
        block = Node("block", self.i)
        block.kids = self.run(until)
        block.last = self.i
        node.body = block

    def close(self, node: Node) -> Node:
        if self.text() == "end":
            self.i += 1
        node.last = min(self.i, len(self.toks))
        return node

    def opened(self, t: str, group: bool) -> Node | None:
        if self.lang == "julia" and group and t in ("for", "if"):
            return None
        if self.lang == "ruby" and t in ("if", "unless", "while", "until") and not self.starts():
            return None
        start = self.i
        if t in ("def", "function", "macro"):
            return self.method(start)
        if t == "do":
            return self.block(start)
        self.i += 1
        if t in ("class", "module", "baremodule", "struct"):
            return self.klass(start, t)
        if t in ("if", "unless"):
            return self.branches(start, t)
        if t in ("while", "until", "for"):
            node = Node("loop", start)
            node.kids = self.run(frozenset(["do"]), line=True, stop=("do",))
            if self.text() == "do":
                self.i += 1
            self.body(node)
            return self.close(node)
        if t == "case":
            return self.cases(start)
        if t in ("try", "begin") and not (self.lang == "julia" and t == "begin"):
            node = Node("try", start)
            self.guarded(node)
            return self.close(node)
        node = Node("plain", start)  # begin, let, quote
        if t == "let":
            node.kids = self.run(frozenset(), line=True)
        self.body(node)
        return self.close(node)

    def guarded(self, node: Node) -> None:
        """A body with the handlers that follow it."""
        parts = frozenset(["rescue", "ensure", "else", "catch", "finally"])
        self.body(node, parts)
        while self.text() in parts and not self.done():
            kid = Node("catch" if self.text() in ("rescue", "catch") else "block", self.i)
            kid.nests = self.lang == "julia"
            self.i += 1
            if kid.kind == "catch" and not self.new_line():
                kid.kids = self.run(frozenset(["then"]), line=True, stop=("then",))
            self.body(kid, parts)
            kid.last = self.i
            node.kids.append(kid)

    def branches(self, start: int, t: str) -> Node:
        node = Node("if" if t == "if" else "plain", start)
        node.kids = self.run(frozenset(["then"]), line=True, stop=("then",))
        parts = frozenset(["elsif", "elseif", "else"])
        self.body(node, parts)
        while self.text() in parts:
            word = self.text()
            kid = Node("elif" if word != "else" else "block", self.i)
            self.i += 1
            if word != "else":
                kid.kids = self.run(frozenset(["then"]), line=True, stop=("then",))
            self.body(kid, parts)
            kid.last = self.i
            if word == "else":
                node.rest = kid
            else:
                node.kids.append(kid)
        return self.close(node)

    def cases(self, start: int) -> Node:
        node = Node("switch", start)
        parts = frozenset(["when", "in", "else"])
        if not self.new_line():
            node.kids = self.run(frozenset(), line=True)
        while not self.done() and self.text() in parts:
            kid = Node("case" if self.text() == "when" else "block", self.i)
            self.i += 1
            if self.text(-1) != "else":
                kid.kids = self.run(frozenset(["then"]), line=True, stop=("then",))
            self.body(kid, parts)
            kid.last = self.i
            node.kids.append(kid)
        return self.close(node)

    def klass(self, start: int, t: str) -> Node:
        node = Node("class" if t in ("class", "struct") or self.lang == "ruby" else "plain", start, self.text())
        while self.text(1) == "::":
            self.i += 2
            node.name = self.text()
        if self.lang == "julia":
            node.kind = "type" if t == "struct" else "plain"
        elif node.name == "<<":
            node.kind = "plain"
        self.i += 1
        if self.text() == "<" and self.kind(1) == "name":
            self.i += 2
            while self.text() == "::":
                self.i += 2
            node.bases = [self.text(-1)]
        while not self.done() and not self.new_line() and self.text() not in (";", "end"):
            self.i += 1
        self.body(node)
        return self.close(node)

    def method(self, start: int) -> Node:
        self.i += 1
        name = ""
        while not self.done() and not (name and self.new_line()):
            t = self.text()
            if t == "(" and name or t == ";":
                break
            if self.kind() == "name" and name and self.text(-1) not in (".", "::"):
                break  # parameters without brackets
            if t == "(":
                break
            name = "" if t in (".", "::") else name + t if self.kind() == "sign" and self.lang == "ruby" or t == "=" else t
            self.i += 1
        node = Node("fn", start, name if name not in ("self", "") else name or ANONYMOUS)
        if self.text() == "(":
            node.params = (self.i, self.after(self.i))
            self.i = node.params[1]
        elif not self.new_line():
            node.params = (self.i, self.i)
        if self.lang == "ruby" and self.text() == "=" and not self.new_line():  # def f(x) = ...
            self.i += 1
            node.body = Node("block", self.i)
            node.body.kids = self.run(frozenset(), line=True)
            node.last = node.body.last = self.i
            return node
        while not self.done() and not self.new_line() and self.text() not in (";", "end") and not (self.lang == "julia" and self.text() in ("return",)):
            self.i = self.after(self.i) if self.text() in ("(", "[", "{") else self.i + 1
        if node.params and node.params[0] == node.params[1]:
            node.params = (node.params[0], self.i)
        if self.lang == "ruby":
            held = Node("plain", self.i)
            self.guarded(held)
            node.body = held
            held.last = self.i
        else:
            self.body(node)
        return self.close(node)

    def block(self, start: int) -> Node:
        """A function without a name from ``do`` to ``end``."""
        node = Node("fn", start, ANONYMOUS)
        self.i += 1
        self.piped()
        if self.lang == "julia":
            while not self.done() and not self.new_line() and self.text() != ";":
                self.i += 1
        held = Node("plain", self.i)
        self.guarded(held)
        held.last = self.i
        node.body = held
        return self.close(node)

    def piped(self) -> None:
        if self.text() == "|":
            self.i += 1
            while not self.done() and self.text() != "|":
                self.i = self.after(self.i) if self.text() in ("(", "[") else self.i + 1
            self.i += 1

    def braces(self) -> Node:
        """A Ruby block after a call; else a table or a set."""
        start = self.i
        called = self.lang == "ruby" and not self.new_line() and self.i > 0 and (self.kind(-1) == "name" and self.text(-1) not in ("return", "and", "or", "not", "puts") or self.text(-1) == ")")
        self.i += 1
        if called:
            self.piped()
        node = Node("fn" if called else "plain", start, ANONYMOUS if called else "")
        node.body = Node("block", self.i)
        while not self.done() and self.text() != "}":
            before = self.i
            node.body.kids += self.run(frozenset(), group=not called)
            if self.i == before:
                self.i += 1
        node.body.last = self.i
        self.i += 1
        node.last = min(self.i, len(self.toks))
        return node

    def lambda_(self, group: bool) -> Node:
        start = self.i
        self.i += 1
        node = Node("fn", start, ANONYMOUS)
        if self.lang == "ruby":
            if self.text() == "(":
                node.params = (self.i, self.after(self.i))
                self.i = node.params[1]
            while self.kind() == "name" and self.text() != "do":
                self.i += 1
            if self.text() == "do":
                inner = self.block(self.i)
                node.body = inner.body
            elif self.text() == "{":
                self.i += 1
                node.body = Node("block", self.i)
                node.body.kids = self.run(frozenset())
                self.i += 1
        else:
            node.body = Node("block", self.i)
            node.body.kids = self.run(frozenset(), line=not group, group=group, stop=(",",))
        node.last = min(self.i, len(self.toks))
        if node.body is not None:
            node.body.last = node.last
        return node

    def short(self) -> Node | None:
        """``f(x) = ...``, a function in one expression."""
        at = self.i
        name = self.text()
        while at + 2 < len(self.toks) and self.toks[at + 1].text == "." and self.toks[at + 2].kind == "name":
            at += 2
            name = self.toks[at].text
        if self.toks[at].kind not in ("name", "sign") or name in ("(", "[", "{", "@", ";", ",") or at + 1 >= len(self.toks) or self.toks[at + 1].text != "(" or name in PARTS or name in OPENS["julia"]:
            return None
        args = (at + 1, self.after(at + 1))
        end, line = args[1], self.toks[at].line
        while end < len(self.toks) and self.toks[end].line == line and (self.toks[end].kind == "name" or self.toks[end].text in ("::", "{", "}", "<", ":", ",")) and self.toks[end].text != "=":
            end += 1
        if end >= len(self.toks) or self.toks[end].text != "=" or self.toks[end].line != self.toks[args[1] - 1].end:
            return None
        node = Node("fn", self.i, name)
        node.params = args
        self.i = end + 1
        node.body = Node("block", self.i)
        node.body.kids = self.run(frozenset(), line=True)
        node.last = node.body.last = self.i
        return node
