"""Patterns over syntax nodes, as joins of parents and children by place.

``(Call func: (Name id: (identifier) @callee) args: [(Constant) (Name)]* @all .)``

* A node has its kind, ``_`` for any; ``"text"`` is a leaf with that text.
* Children stand in their order, and others may stand between them; ``.`` says
  that none does: before the first child, between two, or after the last.
* ``field:`` before a child names its field; ``!field`` says that there is none.
* ``[a b]`` is one of several patterns; every one that fits gives a match.
* ``?`` takes a child if there is one, ``+`` a run of neighbours that all fit,
  ``*`` such a run or nothing. A run is as long as it can be and gives nothing
  back to what stands after it; a ``?`` or ``*`` is left out only where nothing fits.
* ``(a . b)`` without a kind is a group: siblings of any parent. A single pattern
  with ``+`` or ``*`` at the top gives one match for each run.
* ``@name`` captures a node (several names may follow), and a list of nodes after
  ``+`` or ``*``; null where it isn't there.
* Tests, anywhere in brackets or after all: ``#eq?`` and ``#match?`` (a capture and
  a text; ``#eq?`` also two captures), ``#any-of?`` (a capture and texts), each
  with ``not-`` before it. Of a list every node must pass; with ``any-`` before
  ``eq``, ``match``, ``not-eq`` and ``not-match`` one is enough. A test of what
  isn't there passes.

Nodes need ``file``, ``id`` (rising in depth-first order), ``parent`` and ``kind``.
Runs are found by windows over the places of siblings, everything else by joins
on the parent; no tree is put together anywhere.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WORDS = re.compile(r'\s*(?:([()\[\].!*+?])|"((?:\\.|[^"\\])*)"|([\w-]+:)|@([\w-]+)|#([\w-]+[?!]?)|([\w-]+)|(;[^\n]*))')
SIGN, TEXT, FIELD, CAPTURE, TEST, NAME, COMMENT = range(1, 8)
#: What a capture holds, as far as the nodes have it.
HELD = ("id", "kind", "line", "end_line", "start", "stop", "text")
TESTS = ("eq", "match", "any-of")


@dataclass
class Part:
    """A node (``kind``), a choice (``options``) or a group (neither)."""

    kind: str | None = None
    text: str | None = None
    options: list[Part] = field(default_factory=list)
    items: list[tuple[bool, Part]] = field(default_factory=list)
    ends: bool = False
    without: list[str] = field(default_factory=list)
    inside: str | None = None
    many: str = ""
    captures: list[str] = field(default_factory=list)


class Parser:
    def __init__(self, text: str) -> None:
        self.words, self.at, self.tests, at = [], 0, [], 0
        while at < len(text.rstrip()):
            m = WORDS.match(text, at)
            if not m:
                raise ValueError(f"no pattern at {at}: {text[at:]}")
            if m.lastindex != COMMENT:
                self.words.append((m.lastindex, re.sub(r"\\(.)", lambda e: {"n": "\n", "t": "\t"}.get(e[1], e[1]), m[TEXT]) if m.lastindex == TEXT else m[m.lastindex]))
            at = m.end()

    def see(self, kind: int, word: str | None = None, ahead: int = 0) -> bool:
        return self.at + ahead < len(self.words) and self.words[self.at + ahead][0] == kind and word in (None, self.words[self.at + ahead][1])

    def take(self, kind: int, word: str | None = None) -> str:
        if not self.see(kind, word):
            raise ValueError(f"{word or 'something else'} is needed at word {self.at}")
        self.at += 1
        return self.words[self.at - 1][1]

    def whole(self) -> Part:
        part = self.part()
        while self.see(SIGN, "("):
            self.test()
        if self.at < len(self.words):
            raise ValueError(f"not expected: {self.words[self.at][1]}")
        return part

    def test(self) -> None:
        self.take(SIGN, "(")
        name = self.take(TEST).rstrip("?!")
        bare = name.removeprefix("any-") if name != "any-of" else name
        if bare.removeprefix("not-") not in TESTS or (name.startswith("any-") and bare.endswith("any-of") and name != "any-of"):
            raise ValueError(f"no such test: {name}")
        capture, values = self.take(CAPTURE), []
        while not self.see(SIGN, ")"):
            values.append((self.words[self.at][0], self.take(CAPTURE) if self.see(CAPTURE) else self.take(TEXT)))
        self.take(SIGN, ")")
        if (len(values) != 1 and not bare.endswith("any-of")) or not values or (values[0][0] == CAPTURE and not bare.endswith("eq")):
            raise ValueError(f"#{name} doesn't go with what stands after it")
        self.tests.append((name, capture, values))

    def part(self) -> Part:
        inside = self.take(FIELD)[:-1] if self.see(FIELD) else None
        if self.see(TEXT):
            part = Part("_", self.take(TEXT))
        elif self.see(NAME, "_"):
            self.at += 1
            part = Part("_")
        elif self.see(SIGN, "["):
            self.at += 1
            part = Part()
            while not self.see(SIGN, "]"):
                part.options.append(self.part())
            self.take(SIGN, "]")
            if not part.options or any(o.many or not (o.kind or o.options) for o in part.options):
                raise ValueError("a choice is between single nodes")
        else:
            self.take(SIGN, "(")
            part = Part(self.take(NAME) if self.see(NAME) else None)
            self.body(part)
        part.inside = inside
        for sign in "?*+":
            if self.see(SIGN, sign):
                part.many = self.take(SIGN)
                break
        while self.see(CAPTURE):
            part.captures.append(self.take(CAPTURE))
        if part.kind is None and not part.options and (part.many or part.captures or inside):
            raise ValueError("a group has no name, field or number of its own")
        return part

    def body(self, part: Part) -> None:
        close = False
        while not self.see(SIGN, ")"):
            if self.see(SIGN, "."):
                self.at += 1
                close = True
            elif self.see(SIGN, "!"):
                self.at += 1
                part.without.append(self.take(NAME))
            elif self.see(SIGN, "(") and self.see(TEST, ahead=1):
                self.test()
            else:
                item = self.part()
                if item.kind is None and not item.options:  # a group inside is its members
                    part.items += [(first or (close and not n), i) for n, (first, i) in enumerate(item.items)]
                    close = item.ends
                    continue
                part.items.append((close, item))
                close = False
        self.take(SIGN, ")")
        part.ends = close
        if part.kind is None and (not part.items or part.without):
            raise ValueError("a group needs members")
        if part.ends and not part.items:
            raise ValueError("a '.' stands beside a child")


def parsed(text: str) -> tuple[Part, list[tuple[str, str, list[tuple[int, str]]]]]:
    """The pattern and its tests; ValueError if it isn't one."""
    p = Parser(text)
    return p.whole(), p.tests


def with_places(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``pos``, each one's place among its siblings from 0, and ``kids``, how many children it has."""
    if "pos" in nodes.columns and "kids" in nodes.columns:
        return nodes
    among = Window.partitionBy("file", F.coalesce("parent", F.lit(-1))).orderBy("id")
    kids = nodes.filter("parent is not null").groupBy("file", F.col("parent").alias("id")).agg(F.count("*").alias("kids"))
    return nodes.drop("pos", "kids").withColumn("pos", (F.row_number().over(among) - 1).cast("long")).join(kids, ["file", "id"], "left").withColumn("kids", F.coalesce("kids", F.lit(0)).cast("long"))


class _Matcher:
    """Tables of matches: ``file, up`` (parent, -1 for none), ``p, q`` (first and last place), ``id`` (of the first node) and the captures."""

    def __init__(self, nodes: DataFrame) -> None:
        self.nodes, self.lists = nodes.withColumn("up", F.coalesce("parent", F.lit(-1))), set()
        self.held = F.struct(*[c for c in HELD if c in nodes.columns])

    def single(self, part: Part) -> DataFrame:
        """Matches of one node or choice, whatever number it may have."""
        if part.options:
            tables = [self.single(o) for o in part.options]
            df = tables[0]
            for t in tables[1:]:
                df = df.unionByName(t, allowMissingColumns=True)
            if part.inside:
                df = df.join(self.nodes.filter(F.col("field") == part.inside).select("file", "id"), ["file", "id"], "left_semi")
            if part.captures:
                df = df.join(self.nodes.select("file", "id", self.held.alias("_held")), ["file", "id"])
                df = df.select("*", *[F.col("_held").alias(c) for c in part.captures]).drop("_held")
            return df
        df = self.nodes if part.kind == "_" else self.nodes.filter(F.col("kind") == part.kind)
        if part.text is not None:
            df = df.filter((F.col("text") == part.text) & (F.col("kids") == 0))
        if part.inside:
            df = df.filter(F.col("field") == part.inside)
        for name in part.without:
            df = df.join(self.nodes.filter((F.col("field") == name) & F.col("parent").isNotNull()).select("file", F.col("parent").alias("id")), ["file", "id"], "left_anti")
        df = df.select("file", "up", F.col("pos").alias("p"), F.col("pos").alias("q"), "id", "kids", *[self.held.alias(c) for c in part.captures])
        if part.items:
            df = self.within(df.withColumn("_node", F.col("id")), part)
        return df.drop("kids", "_node")

    def within(self, df: DataFrame, part: Part) -> DataFrame:
        """Rows of ``df(file, _node, kids, ...)`` whose children fit the items one after the other."""
        df = df.withColumn("_at", F.lit(-1).cast("long"))
        for close, item in part.items:
            df = self.after(df, close, item)
        if part.ends:
            df = df.filter(F.col("_at") == F.col("kids") - 1)
        return df.drop("_at")

    def after(self, df: DataFrame, close: bool, item: Part) -> DataFrame:
        """The next item at a place behind ``_at``, which moves on."""
        found = self.runs(item) if item.many in ("*", "+") else self.single(item)
        captures = [c for c in found.columns if c not in ("file", "up", "p", "q", "id", "_members")]
        right = found.select(F.col("file").alias("_file"), F.col("up").alias("_up"), F.col("p").alias("_p"), F.col("q").alias("_q"), *captures, *(["_members"] if "_members" in found.columns else []))
        # a run that began before goes on from the next place
        begin = F.greatest("_p", F.col("_at") + 1) if item.many in ("*", "+") else F.col("_p")
        fits = (F.col("file") == F.col("_file")) & (F.col("_node") == F.col("_up")) & (F.col("_q") > F.col("_at")) & (begin > F.col("_at"))
        if close:
            fits &= begin == F.col("_at") + 1
        clash = set(captures) & set(df.columns)
        if clash:
            raise ValueError(f"captured twice: {sorted(clash)}")
        out = df.join(right, fits, "left" if item.many in ("?", "*") else "inner")
        if "_members" in found.columns:
            mine = F.filter("_members", lambda m: m["p"] > F.col("_at"))
            out = out.withColumns({c: F.transform(mine, _of(c)) for c in found.schema["_members"].dataType.elementType.names if c != "p"})
        return out.withColumn("_at", F.coalesce("_q", "_at")).drop("_file", "_up", "_p", "_q", "_members")

    def runs(self, part: Part) -> DataFrame:
        """Longest runs of neighbours that fit, with their members (place and captures)."""
        one = self.single(part)
        captures = [c for c in one.columns if c not in ("file", "up", "p", "q", "id")]
        self.lists |= set(captures)
        # of several matches of one node the first one counts
        one = one.groupBy("file", "up", "p").agg(F.min(F.struct("id", *captures)).alias("m")).select("file", "up", "p", "m.*")
        among = Window.partitionBy("file", "up").orderBy("p")
        one = one.withColumn("_run", F.col("p") - F.row_number().over(among))
        out = one.groupBy("file", "up", "_run").agg(F.min("p").alias("p"), F.max("p").alias("q"), F.min("id").alias("id"), F.sort_array(F.collect_list(F.struct("p", *captures))).alias("_members"))
        return out.drop("_run")

    def whole(self, part: Part) -> DataFrame:
        if part.kind is None and not part.options:  # a group: the children of any node
            parents = self.nodes.groupBy("file", F.col("up").alias("_node")).agg(F.count("*").alias("kids"))
            df = self.within(parents, Part("_", items=[(c, self.first(i, n)) for n, (c, i) in enumerate(part.items)], ends=part.ends))
            firsts = [F.col(f"_first{n}")[0]["id"] if i.many in ("*", "+") else F.col(f"_first{n}.id") for n, (_, i) in enumerate(part.items)]
            return df.withColumn("id", F.coalesce(*firsts)).drop("_node", "kids", *[f"_first{n}" for n in range(len(part.items))]).filter("id is not null")
        if part.many in ("*", "+"):
            runs = self.runs(part)
            names = [c for c in runs.schema["_members"].dataType.elementType.names if c != "p"]
            return runs.withColumns({c: F.transform("_members", _of(c)) for c in names}).drop("_members", "up", "p", "q")
        return self.single(part).drop("up", "p", "q")

    @staticmethod
    def first(item: Part, n: int) -> Part:
        return Part(item.kind, item.text, item.options, item.items, item.ends, item.without, item.inside, item.many, [*item.captures, f"_first{n}"])

    def passes(self, df: DataFrame, name: str, capture: str, values: list[tuple[int, str]]) -> Column:
        for c in [capture, *[v for kind, v in values if kind == CAPTURE]]:
            if c not in df.columns:
                raise ValueError(f"no such capture: {c}")
        some = name.startswith("any-") and name != "any-of"
        bare = name.removeprefix("any-") if some else name
        negated = bare.startswith("not-")
        bare = bare.removeprefix("not-")

        def one(node: Column) -> Column:
            text = F.coalesce(node["text"], F.lit(""))
            if bare == "eq":
                kind, value = values[0]
                fits = text == (F.coalesce(F.col(f"{value}.text"), F.lit("")) if kind == CAPTURE else F.lit(value))
            else:
                fits = text.rlike(values[0][1]) if bare == "match" else text.isin([v for _, v in values])
            return ~fits if negated else fits

        if capture in self.lists:
            return F.coalesce((F.exists if some else F.forall)(F.col(capture), one), F.lit(True))
        return F.col(capture).isNull() | one(F.col(capture))


def _of(name: str):
    return lambda member: member[name]


def match(nodes: DataFrame, pattern: str, lang: str | None = None, most: int | None = None) -> DataFrame:
    """One row for each match: ``file``, ``id`` of the outermost (or first) node, and a struct for each capture, or an array of them.

    With ``most`` the first so many, and columns ``total`` and ``truncated``.
    A language that no node has gives no rows, and neither does an empty table.
    """
    root, tests = parsed(pattern)
    matcher = _Matcher(with_places(nodes if lang is None else nodes.filter(F.col("lang") == lang)))
    found = matcher.whole(root)
    for test in tests:
        found = found.filter(matcher.passes(found, *test))
    names = [c for c in found.columns if c not in ("file", "id")]
    found = found.select("file", "id", *names)
    if most is None:
        return found
    from codescope.operators import tables

    return tables.capped(found, [F.col("file"), F.col("id"), *map(F.col, names)], most)
