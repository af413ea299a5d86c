"""Nested statements of token streams, and what is counted on them.

The kinds of :class:`Node`: fn, class, if, elif, loop, switch, case, try, catch,
ternary, bools (joined conditions), mod (a condition after its statement), block
and plain. Branches count in NPath by its definition: each branch of an if, one
more without an else, a loop's body and one more, the sum of a switch's cases.
"""

from __future__ import annotations

from codescope.sources.tokens import Token, ends_value

#: Conditions that short-circuit.
JOINS = frozenset(["&&", "||", "??", "and", "or"])
COUNTS_DEFAULT = frozenset(["java", "c_sharp", "c", "cpp", "rust"])
TRY_NESTS = frozenset(["cpp", "julia", "ruby"])
ANONYMOUS = "<lambda>"


class Node:
    __slots__ = ("kind", "name", "first", "last", "kids", "body", "rest", "owner", "bases", "params", "n", "nests")

    def __init__(self, kind: str, first: int, name: str = "") -> None:
        self.kind, self.first, self.last, self.name = kind, first, first, name
        self.kids: list[Node] = []
        self.body: Node | None = None
        self.rest: Node | None = None
        self.owner: str | None = None
        self.bases: list[str] = []
        self.params: tuple[int, int] | None = None
        self.n, self.nests = 1, True

    def all_kids(self) -> list[Node]:
        return [*self.kids, *([self.body] if self.body else []), *([self.rest] if self.rest else [])]


def bools(ops: list[str], at: int) -> Node:
    """Joined conditions of one expression: as many decisions as operators, as many steps as runs of one operator."""
    node = Node("bools", at)
    low = [o for o in ops if o in ("||", "or")]
    runs, inside = 0, False
    for o in ops:
        if o in ("&&", "and"):
            runs += not inside
            inside = True
        elif o in ("||", "or"):
            inside = False
    node.n, node.name = len(ops), str(bool(low) + runs + ("??" in ops))
    return node


def complexity(fn: Node) -> tuple[int, int]:
    """Cyclomatic and cognitive complexity of a function, nested functions left out."""
    ccx = 1
    cog = 0

    def walk(node: Node, depth: int) -> None:
        nonlocal ccx, cog
        kind, below = node.kind, depth
        if kind == "fn":
            return
        if kind == "bools":
            ccx += node.n
            cog += int(node.name)
        elif kind in ("if", "loop", "catch", "ternary", "mod"):
            ccx += 1
            cog += 1 + depth
            below += node.nests
        elif kind in ("case", "elif"):
            ccx += node.n
            cog += node.n * (1 + max(0, depth - 1))
        elif kind in ("switch", "try"):
            below += node.nests
        for k in node.all_kids():
            walk(k, below)

    for k in fn.all_kids():
        walk(k, 0)
    return ccx, cog


def paths(node: Node | None) -> int:
    """Acyclic paths through a node."""
    if node is None or node.kind == "fn":
        return 1
    if node.kind == "if":
        total, has_else = paths(node.body), node.rest is not None
        for k in node.kids:
            if k.kind == "elif":
                total += paths(k.body)
        return total + (paths(node.rest) if has_else else 1)
    if node.kind in ("loop", "repeat"):
        return paths(node.body) + 1
    if node.kind == "switch":
        # a case counts by the block that is its body
        return max(1, sum(paths(k.body) for k in node.kids if k.kind == "case" and k.n)) if any(k.kind == "case" for k in node.kids) else 1
    if node.kind == "try":
        return paths(node.body) + sum(paths(k.body) for k in node.kids if k.kind == "catch")
    total = 1
    for k in node.all_kids():
        total *= paths(k)
    return total


class Stream:
    """A position in the tokens of one file."""

    def __init__(self, toks: list[Token], lang: str) -> None:
        self.toks, self.lang, self.i = toks, lang, 0

    def text(self, ahead: int = 0) -> str:
        at = self.i + ahead
        return self.toks[at].text if 0 <= at < len(self.toks) else ""

    def kind(self, ahead: int = 0) -> str:
        at = self.i + ahead
        return self.toks[at].kind if 0 <= at < len(self.toks) else ""

    def done(self) -> bool:
        return self.i >= len(self.toks)

    def new_line(self) -> bool:
        """Whether the token is the first of its line."""
        return self.i == 0 or self.i < len(self.toks) and self.toks[self.i - 1].end < self.toks[self.i].line

    def after(self, at: int) -> int:
        """The place behind the bracket that closes the one at ``at``."""
        pairs, depth = {"(": ")", "[": "]", "{": "}"}, 0
        while at < len(self.toks):
            t = self.toks[at]
            if t.kind == "sign":
                depth += (t.text in pairs) - (t.text in ")]}")
                if depth <= 0:
                    return at + 1
            at += 1
        return at

    def value_before(self) -> bool:
        return self.i > 0 and ends_value(self.toks[self.i - 1])


#: Words that begin a statement, classes, and calls that open a block but define nothing.
STARTS = {
    "javascript": "if for while do switch try", "typescript": "if for while do switch try", "go": "if for switch select", "java": "if for while do switch try",
    "c_sharp": "if for foreach while do switch try", "c": "if for while do switch", "cpp": "if for while do switch try", "rust": "if for while loop match",
}
STARTS = {k: frozenset(v.split()) for k, v in STARTS.items()}
CLASSES = {
    "javascript": "class", "typescript": "class interface", "java": "class interface enum record", "c_sharp": "class struct interface record enum", "c": "struct union enum", "cpp": "class struct union enum",
}
CLASSES = {k: frozenset(v.split()) for k, v in CLASSES.items()}
NOT_DEFINED = frozenset("using lock synchronized fixed checked unchecked catch when if for foreach while switch with return new function sizeof constructor_call".split())
CONTINUES = frozenset(". , ? : ) ] } + - * / % = == === != !== < > <= >= && || ?? ?. => & | ^ ** += -= in of instanceof as { else catch finally while".split())
RESULT = frozenset("public private protected".split())


class Curly(Stream):
    """Statements of languages with braces."""

    def file(self) -> Node:
        root = Node("block", 0)
        while not self.done():
            before = self.i
            root.kids += self.item("top")
            if self.i == before:
                self.i += 1
        root.last = self.i
        return root

    def breaks(self) -> bool:
        """Whether a statement ends before this token for the line does."""
        if not self.new_line() or not self.i:
            return False
        if self.lang == "go":
            last = self.toks[self.i - 1]
            return ends_value(last) or last.text in ("return", "break", "continue", "fallthrough")
        if self.lang in ("javascript", "typescript"):
            return (self.value_before() or self.text(-1) == "return") and self.text() not in CONTINUES
        return False

    def item(self, ctx: str) -> list[Node]:
        """Statements of code; declarations elsewhere."""
        if ctx == "code" or self.lang in ("go", "rust") or self.lang in ("javascript", "typescript") and ctx == "top":
            return self.statement()
        return self.declaration(ctx)

    def block(self, ctx: str) -> Node:
        node = Node("block", self.i)
        self.i += 1
        while not self.done() and self.text() != "}":
            before = self.i
            node.kids += self.item(ctx)
            if self.i == before:
                self.i += 1
        self.i += 1
        node.last = min(self.i, len(self.toks))
        return node

    # declarations

    def declaration(self, ctx: str) -> list[Node]:
        start, group, named = self.i, None, ""
        js = self.lang in ("javascript", "typescript")
        while not self.done():
            t = self.text()
            if js and self.i > start and group is None and self.breaks():
                return []
            if t == ";":
                self.i += 1
                return []
            if t == "}":
                return []
            if t == "@" and self.lang == "java" and self.text(2) == "(":
                self.i = self.after(self.i + 2)
            elif t == "operator" and self.lang in ("cpp", "c_sharp") and group is None:
                end = self.i + (3 if self.text(1) in ("(", "[") else 1)
                while end < len(self.toks) and self.toks[end].text != "(":
                    end += 1
                named = "".join(x.text for x in self.toks[self.i + 1 : end])
                self.i, group = self.after(end), (end, self.after(end))
            elif t == "(" or t == "[":
                if t == "(" and group is None and self.kind(-1) in ("name", "string") or t == "(" and group is None and self.text(-1) in (">", "]"):
                    at = self.i - 1
                    if self.text(-1) == ">":  # type parameters
                        depth = 0
                        while at > start:
                            depth += {">": 1, ">>": 2, "<": -1}.get(self.toks[at].text, 0)
                            at -= 1
                            if depth <= 0:
                                break
                    named, group = self.toks[at].text, (self.i, self.after(self.i))
                    if at and self.toks[at - 1].text == "~":
                        named = "~" + named
                self.i = self.after(self.i)
            elif t == "=" and not (self.lang in ("java", "c_sharp") and group is None and self.text(-1) == "default"):
                if any(x.text in CLASSES.get(self.lang, ()) for x in self.toks[start : self.i]) and self.lang == "cpp" and "<" in [x.text for x in self.toks[start : self.i]]:
                    self.i += 1  # a default in a template's head
                    continue
                self.i += 1
                return self.expr()
            elif t == "=>" and self.lang == "c_sharp":
                self.i += 1
                if group is None:
                    return self.expr()
                return [self.function(start, named, group, arrow=True)]
            elif t == ":" and group is None and (self.text(-1) in RESULT or self.text(-1) == "slots"):
                self.i += 1
                return []
            elif t == ":" and group is not None and self.lang == "cpp" and not self.class_word(start, group):
                self.i += 1
                while not self.done() and self.kind() == "name":  # members set before the body
                    while self.text() not in ("(", "{", "") and self.text() != ";":
                        self.i += 1
                    self.i = self.after(self.i)
                    if self.text() == ",":
                        self.i += 1
            elif t == "{":
                return self.opened(start, named, group, ctx)
            else:
                self.i += 1
        return []

    def class_word(self, start: int, group: tuple[int, int] | None) -> int | None:
        """Where the word is that makes a header a class's."""
        if group is not None and self.lang in ("c", "cpp", "javascript", "typescript"):
            return None
        depth = 0
        for at in range(start, self.i):
            t = self.toks[at]
            depth += (t.text == "<") - (t.text == ">")
            if depth <= 0 and t.kind == "name" and t.text in CLASSES.get(self.lang, ()) and self.toks[at - 1].text != ".":
                if t.text != "record" or self.toks[at + 1].kind == "name":
                    return at
        return None

    def opened(self, start: int, named: str, group: tuple[int, int] | None, ctx: str) -> list[Node]:
        word = self.class_word(start, group)
        if word is not None:
            return [self.klass(start, word)]
        words = {t.text for t in self.toks[start : self.i]}
        if group is not None and named not in NOT_DEFINED:
            return [self.function(start, named, group)]
        if words & {"namespace", "extern", "package", "module"}:
            return self.block("top").kids
        return [self.block("code" if ctx == "top" or group else "accessors")]

    def klass(self, start: int, word: int) -> Node:
        """A class from its header's word to the end of its body."""
        at = word + 1
        while at < self.i and (self.toks[at].text in ("class", "struct", "alignas", "(") or self.toks[at].text.startswith("__")):
            at += 1
        node = Node("class", start, self.toks[at].text if at < self.i else "")
        node.bases = bases(self.toks[at + 1 : self.i], self.lang)
        if self.toks[word].text == "enum" and self.lang != "java":
            self.i = self.after(self.i)
        else:
            node.body = self.block("class")
        node.last = min(self.i, len(self.toks))
        if self.toks[word].text == "union" or self.toks[word].text == "enum" or self.lang == "c":
            node.kind = "type"
        return node

    def function(self, start: int, name: str, group: tuple[int, int] | None, arrow: bool = False) -> Node:
        node = Node("fn", start, name or ANONYMOUS)
        node.params = group
        if self.lang == "cpp" and group is not None and group[0] >= 3 and self.toks[group[0] - 2].text == "::":
            node.owner = self.toks[group[0] - 3].text
        if arrow and self.text() != "{":
            node.body = Node("block", self.i)
            node.body.kids = self.expr(comma=True, keep=True)
            node.body.last = self.i
        else:
            node.body = self.block("code")
        node.last = min(self.i, len(self.toks))
        return node

    # statements

    def statement(self) -> list[Node]:
        t = self.text()
        if t == "{":
            return [self.block("code")]
        if t == ";":
            self.i += 1
            return []
        if t in STARTS[self.lang] and self.kind() == "name" and self.text(1) != ":" and self.text(-1) not in (".", "?.", "::"):
            return [self.control(t)]
        return self.expr()

    def braced_header(self) -> bool:
        return self.lang in ("go", "rust")

    def header(self) -> list[Node]:
        if self.braced_header():
            return self.expr(header=True)
        while not self.done() and self.text() not in ("(", "{", ";"):  # await, constexpr
            self.i += 1
        if self.text() != "(":
            return []
        self.i += 1
        kids = self.expr(group=True)
        self.i += 1
        return kids

    def one(self) -> Node:
        """The body of a statement."""
        if self.text() == "{":
            return self.block("code")
        node = Node("plain", self.i)
        node.kids = self.statement()
        node.last = self.i
        return node

    def control(self, word: str) -> Node:
        node = Node({"if": "if", "switch": "switch", "match": "switch", "select": "switch", "try": "try", "loop": "repeat"}.get(word, "loop"), self.i)
        self.i += 1
        if word == "do":
            node.body = self.one()
            if self.text() == "while":
                self.i += 1
                node.kids = self.header()
        elif word == "try":
            node.nests = self.lang in TRY_NESTS
            if self.text() == "(":
                node.kids = self.header()
            node.body = self.one()
            while self.text() in ("catch", "finally"):
                kid = Node("catch" if self.text() == "catch" else "block", self.i)
                self.i += 1
                if self.text() == "(":
                    kid.kids = self.header()
                if self.text() == "when":
                    self.i = self.after(self.i + 1)
                kid.body = self.one()
                kid.last = self.i
                node.kids.append(kid)
        else:
            node.kids = [] if word == "loop" else self.header()
            if node.kind == "switch":
                self.cases(node)
            else:
                node.body = self.one()
                if word == "if" and self.text() == "else":
                    self.i += 1
                    node.rest = self.statement_node()
        node.last = min(self.i, len(self.toks))
        return node

    def statement_node(self) -> Node:
        if self.text() == "if":
            return self.control("if")
        return self.one()

    def cases(self, node: Node) -> None:
        if self.text() != "{":
            return
        self.i += 1
        while not self.done() and self.text() != "}":
            before = self.i
            if self.lang == "rust":
                node.kids.append(self.arm())
            elif self.text() in ("case", "default"):
                last = node.kids[-1] if node.kids else None
                case = self.case()
                # labels in a row are one section
                if self.lang == "c_sharp" and last is not None and last.kind == "case" and not last.name:
                    node.kids.pop()
                node.kids.append(case)
            else:
                node.kids += self.statement()
            if self.i == before:
                self.i += 1
        self.i += 1

    def case(self) -> Node:
        node = Node("case", self.i)
        arrow = {"java": "->", "c_sharp": "=>"}.get(self.lang, "")
        if self.text() == "default" and self.lang not in COUNTS_DEFAULT:
            node.n = 0
        self.i += 1
        while not self.done() and self.text() not in (":", arrow, "}"):
            self.i = self.after(self.i) if self.text() in ("(", "[", "{") else self.i + 1
        arrowed = self.text() == arrow
        if arrowed and self.lang == "java":
            node.n = 2  # the rule and its label
        self.i += 1
        while not self.done() and self.text() not in ("case", "default", "}"):
            before, node.name = self.i, "filled"
            if self.text() == "{":
                node.body = self.block("code")
            else:
                node.kids += self.statement()
            if self.i == before:
                self.i += 1
            if arrowed:
                break
        node.last = self.i
        return node

    def arm(self) -> Node:
        node = Node("case", self.i)
        while not self.done() and self.text() not in ("=>", "}"):
            self.i = self.after(self.i) if self.text() in ("(", "[", "{") else self.i + 1
        self.i += 1
        if self.text() == "{":
            node.body = self.block("code")
        else:
            node.kids = self.expr(comma=True, keep=True)
        if self.text() == ",":
            self.i += 1
        node.last = self.i
        return node

    # expressions

    def expr(self, group: bool = False, comma: bool = False, header: bool = False, keep: bool = False) -> list[Node]:
        """What an expression holds, up to its end: a semicolon, a closing bracket, the line's end, with ``comma`` a comma, with ``header`` a brace."""
        kids: list[Node] = []
        ops: list[str] = []
        lang, first = self.lang, self.i

        def settle() -> None:
            if ops:
                kids.append(bools(list(ops), self.i))
                ops.clear()

        while not self.done():
            t, kind = self.text(), self.kind()
            if not group and not header and self.i > first and self.breaks():
                break
            if kind == "name":
                member = self.text(-1) in (".", "?.", "::")
                if t in STARTS[lang] and not member and self.text(1) not in (":", "=", ")"):
                    if self.i == first and not group and not header:
                        kids += self.statement()
                        break
                    kids.append(self.control(t))
                    continue
                if (made := None if member else self.definition(t)) is not None:
                    kids.append(made)
                    continue
                if t in ("return", "throw", "yield"):
                    settle()
                self.i += 1
                continue
            if kind != "sign":
                self.i += 1
                continue
            if t in (")", "]", "}"):
                break
            if t == ";":
                if not (group or header):
                    if not keep:
                        self.i += 1
                    break
                settle()
                self.i += 1
            elif t == ",":
                settle()
                if comma:
                    break
                self.i += 1
            elif t == "{":
                if header:
                    break
                kids.append(self.block("code"))
            elif t in ("(", "["):
                kids += self.bracket(group)
            elif t == "=>" or t == "->" and lang == "java":
                settle()
                kids.append(self.arrow(group))
            elif t in ("|", "||") and lang == "rust" and (not self.value_before() or self.text(-1) == "move"):
                settle()
                kids.append(self.closure(group))
            elif t in JOINS and not (t == "&&" and (not self.value_before() or lang == "cpp" and self.text(-1) in ("auto", "const"))):
                ops.append(t)
                self.i += 1
            elif t == "?" and self.ternary():
                settle()
                self.i += 1
                node = Node("ternary", self.i)
                node.kids = self.expr(group=group, comma=True, keep=True, header=header)
                node.last = self.i
                kids.append(node)
            else:
                if t in (":", "=", ":=", "+=", "-=", "<-") or t.endswith("=") and t not in ("==", "!=", "<=", ">=", "===", "!=="):
                    settle()
                self.i += 1
        settle()
        return kids

    def ternary(self) -> bool:
        if self.lang in ("go", "rust") or self.text(1) in (":", ")", ",", ">", ";", "=", "]", "[", "."):
            return False
        if self.lang == "java" and self.text(-1) in ("<", ","):
            return False
        return not (self.lang == "c_sharp" and self.kind(1) == "name" and self.text(2) in ("=", ";", ",", ")", "{"))

    def bracket(self, group: bool) -> list[Node]:
        opened = self.i
        lambda_ = self.lang == "cpp" and self.text() == "[" and not self.value_before()
        self.i += 1
        kids = self.expr(group=True)
        self.i += 1
        if lambda_:
            args = (self.i, self.after(self.i)) if self.text() == "(" else None
            at = args[1] if args else self.i
            while at < len(self.toks) and (self.toks[at].kind == "name" or self.toks[at].text in ("->", "::", "*", "&", "<", ">")):
                at += 1
            if at < len(self.toks) and self.toks[at].text == "{":
                self.i = at
                return [*kids, self.function(opened, "", args)]
            return kids
        before = self.toks[opened - 1] if opened else None
        if self.toks[opened].text != "(" or before is None or before.kind != "name" or before.text in NOT_DEFINED:
            return kids
        # a name, parameters and a body: a method of an object or a function inside a function
        body = self.i
        if self.lang == "java" and self.text() == "throws":
            while body < len(self.toks) and (self.toks[body].kind == "name" or self.toks[body].text in (",", ".")):
                body += 1
        if self.lang not in ("javascript", "typescript", "java", "c_sharp") or body >= len(self.toks) or self.toks[body].text != "{" or self.toks[body - 1].end < self.toks[body].line and self.lang in ("javascript", "typescript"):
            return kids
        if opened >= 2 and self.toks[opened - 2].text in ("new", "."):
            return kids
        if self.lang in ("java", "c_sharp") and not (opened >= 2 and (self.toks[opened - 2].kind == "name" or self.toks[opened - 2].text in (">", "]"))):
            return kids
        self.i = body
        return [self.function(opened - 1, before.text, (opened, self.after(opened)))]

    def arrow(self, group: bool) -> Node:
        start = self.i - 1
        if self.text(-1) == ")":
            depth = 0
            while start > 0:
                depth += (self.toks[start].text == ")") - (self.toks[start].text == "(")
                if depth == 0:
                    break
                start -= 1
        args = (start, self.i)
        self.i += 1
        if self.text() == "{":
            node = self.function(start, "", args)
        else:
            node = Node("fn", start, ANONYMOUS)
            node.params, node.body = args, Node("block", self.i)
            node.body.kids = self.expr(group=group, comma=True, keep=True)
            node.body.last = node.last = self.i
        return node

    def closure(self, group: bool) -> Node:
        start = self.i
        if self.text() == "|":
            self.i += 1
            while not self.done() and self.text() != "|":
                self.i = self.after(self.i) if self.text() in ("(", "[") else self.i + 1
        self.i += 1
        if self.text() == "->":
            while not self.done() and self.text() != "{":
                self.i += 1
        node = Node("fn", start, ANONYMOUS)
        node.params, node.body = (start, self.i), Node("block", self.i)
        node.body.kids = [self.block("code")] if self.text() == "{" else self.expr(group=group, comma=True, keep=True)
        node.last = node.body.last = self.i
        return node

    def definition(self, t: str) -> Node | None:
        """A function or class that a word begins, if it does."""
        start, lang = self.i, self.lang
        if t == "function" and lang in ("javascript", "typescript") or t == "func" and lang == "go" or t == "fn" and lang == "rust" and self.kind(1) == "name":
            return self.worded(start)
        if t in CLASSES.get(lang, ()) and lang in ("javascript", "typescript") and (self.kind(1) == "name" or self.text(1) == "{") and self.text(-1) != ".":
            if t == "interface" and self.kind(1) != "name":
                return None
            while not self.done() and self.text() != "{":
                self.i += 1
            return self.klass(start, start)
        if lang == "go" and t in ("struct", "interface") and self.text(1) == "{" and self.kind(-1) == "name" and self.text(-1) not in ("type", "map", "chan"):
            node = Node("class" if t == "struct" else "type", start - 1, self.text(-1))
            self.i += 1
            inside = self.after(self.i)
            lines: dict[int, list[Token]] = {}
            for x in self.toks[self.i + 1 : inside - 1]:
                lines.setdefault(x.line, []).append(x)
            # a field without a name is a type that is taken in
            node.bases = [row[-1].text for row in lines.values() if all(x.kind == "name" or x.text in ("*", ".") for x in row) and sum(x.kind == "name" for x in row) == 1 + sum(x.text == "." for x in row)]
            self.i = node.last = inside
            return node
        if lang == "rust" and t in ("struct", "enum", "union", "trait") and self.kind(1) == "name":
            node = Node("class" if t in ("struct", "enum") else "type", start, self.text(1))
            while not self.done() and self.text() not in ("{", ";"):
                self.i = self.after(self.i) if self.text() == "(" else self.i + 1
            if t == "trait" and self.text() == "{":
                node.body = self.block("code")
            elif self.text() == "{":
                self.i = self.after(self.i)
            else:
                self.i += 1
            node.last = self.i
            return node
        if lang == "rust" and t == "impl" and (self.text(-1) in ("", "}", ";", "]", "{") or self.text(-1) == "unsafe"):
            return self.impl(start)
        return None

    def impl(self, start: int) -> Node:
        self.i += 1
        name, depth = "", 0
        while not self.done() and self.text() != "{":
            t = self.text()
            depth += (t == "<") - (t == ">") - 2 * (t == ">>")
            if t == "where":
                break
            if t == "for":
                name = ""
            elif depth == 0 and self.kind() == "name":
                name = t
            self.i += 1
        while not self.done() and self.text() != "{":
            self.i += 1
        node = Node("plain", start, name)
        node.body = self.block("code")
        node.last = self.i
        for k in _functions(node.body):
            k.owner = name
        return node

    def worded(self, start: int) -> Node:
        """A function that its keyword begins."""
        self.i += 1
        owner, name = None, ""
        if self.text() == "*":
            self.i += 1
        if self.lang == "go" and self.text() == "(" and self.kind(self.after(self.i) - self.i) == "name" and self.toks[min(self.after(self.i) + 1, len(self.toks) - 1)].text in ("(", "["):
            end = self.after(self.i)
            names = [x.text for x in self.toks[self.i : end] if x.kind == "name"]
            generic = next((at for at in range(self.i, end) if self.toks[at].text == "["), None)
            owner = self.toks[generic - 1].text if generic else names[-1] if names else None
            self.i = end
        if self.kind() == "name":
            name = self.text()
            self.i += 1
        if self.text() in ("<", "["):
            depth = 0
            while not self.done():
                t = self.text()
                depth += (t in ("<", "[")) - (t in (">", "]")) - 2 * (t == ">>")
                self.i += 1
                if depth <= 0:
                    break
        args = (self.i, self.after(self.i)) if self.text() == "(" else None
        if args:
            self.i = args[1]
        if self.lang == "go" and self.text() == "(":
            self.i = self.after(self.i)  # results
        while not self.done() and self.text() not in ("{", ";", ")", ",", "}"):
            if self.lang == "go" and self.text() in ("interface", "struct") and self.text(1) == "{":
                self.i = self.after(self.i + 1)
                continue
            if self.breaks() or self.text() == "=" and self.lang != "rust":
                break
            self.i = self.after(self.i) if self.text() in ("(", "[") else self.i + 1
        node = Node("fn" if self.text() == "{" else "plain", start, name or ANONYMOUS)
        node.owner, node.params = owner, args
        if self.text() == "{":
            node.body = self.block("code")
        node.last = min(self.i, len(self.toks))
        return node


def _functions(block: Node) -> list[Node]:
    return [k for k in block.kids if k.kind == "fn"]


def bases(head: list[Token], lang: str) -> list[str]:
    """Names of base classes in a class's header."""
    out, depth, on = [], 0, False
    marks = {"c_sharp": (":",), "cpp": (":",)}.get(lang, ("extends", "implements"))
    for at, t in enumerate(head):
        depth += (t.text in ("<", "(", "[")) - (t.text in (">", ")", "]")) - 2 * (t.text == ">>")
        if depth == 0 and t.text == "where":
            break
        if depth == 0 and t.text in marks:
            on = True
        elif on and depth == 0 and t.kind == "name" and t.text not in ("public", "private", "protected", "virtual", "implements", "extends"):
            if at + 1 == len(head) or head[at + 1].text not in (".", "::"):
                out.append(t.text)
    return out
