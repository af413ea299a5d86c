"""The pattern language against a matcher that walks the tree, construct by construct."""

import collections
import random

import pytest

from codescope.operators import pattern

SCHEMA = "file string, id long, parent long, field string, kind string, text string"


class Tree:
    def __init__(self, rows):
        self.rows = {r[1]: r for r in rows}
        self.below = collections.defaultdict(list)
        for r in sorted(rows, key=lambda r: r[1]):
            self.below[r[2]].append(r[1])

    def held(self, i):
        return (i, self.rows[i][4], self.rows[i][5])

    def names(self, part):
        return [*part.captures, *[n for o in part.options for n in self.names(o)], *[n for _, i in part.items for n in self.names(i)]]

    def single(self, part, i):
        """All matches of one node: dicts of captures."""
        _, _, _, field, kind, text = self.rows[i]
        if part.inside and field != part.inside:
            return []
        blank = dict.fromkeys(self.names(part))
        if part.options:
            return [blank | m | {c: self.held(i) for c in part.captures} for o in part.options for m in self.single(o, i)]
        if part.kind not in ("_", kind) or (part.text is not None and (text != part.text or self.below[i])):
            return []
        if any(self.rows[k][3] in part.without for k in self.below[i]):
            return []
        return [blank | m | {c: self.held(i) for c in part.captures} for m in self.within(part, self.below[i])]

    def within(self, part, kids):
        states = [(-1, {})]
        for close, item in part.items:
            fits = [self.single(item, k) for k in kids]
            more = []
            for at, caps in states:
                found = []
                if item.many in ("*", "+"):
                    p = at + 1
                    while p < len(kids):
                        if fits[p]:
                            q = p
                            while q + 1 < len(kids) and fits[q + 1]:
                                q += 1
                            found.append((p, q, {c: [fits[x][0][c] for x in range(p, q + 1)] for c in self.names(item)}))
                            p = q
                        p += 1
                else:
                    found = [(p, p, m) for p in range(at + 1, len(kids)) for m in fits[p]]
                found = [f for f in found if not close or f[0] == at + 1]
                more += [(q, caps | m) for _, q, m in found]
                if not found and item.many in ("?", "*"):
                    more.append((at, caps | dict.fromkeys(self.names(item))))
            states = more
        return [c for at, c in states if not part.ends or at == len(kids) - 1]


def expected(rows, text):
    part, tests = pattern.parsed(text)
    assert not tests
    out = []
    for file in {r[0] for r in rows}:
        t = Tree([r for r in rows if r[0] == file])
        if part.kind is None and not part.options:
            for kids in list(t.below.values()):
                out += [(file, tuple(sorted((k, tuple(v) if isinstance(v, list) else v) for k, v in m.items()))) for m in t.within(part, kids)]
        elif part.many in ("*", "+"):
            alone = pattern.Part("_", items=[(False, part)])
            for kids in list(t.below.values()):
                at = 0
                while at < len(kids):
                    runs = [m for m in t.within(alone, kids[at:])] if t.single(part, kids[at]) and (at == 0 or not t.single(part, kids[at - 1])) else []
                    out += [(file, tuple(sorted((k, tuple(v)) for k, v in m.items()))) for m in runs[:1]]
                    at += 1
        else:
            out += [(file, tuple(sorted((k, tuple(v) if isinstance(v, list) else v) for k, v in m.items()))) for i in t.rows for m in t.single(part, i)]
    return sorted(out, key=str)


def found(df):
    value = lambda v: tuple(x and tuple(x) for x in v) if isinstance(v, list) else v if v is None else tuple(v)
    return sorted(((r["file"], tuple(sorted((c, value(r[c])) for c in df.columns if c not in ("file", "id")))) for r in df.collect()), key=str)


def trees():
    r = random.Random(3)
    rows = []
    for file in "pqrstuvwz":
        for i in range(70 if file != "z" else 1):
            rows.append((file, i, None if i == 0 else r.randint(max(0, i - 9), i - 1), r.choice(["x", "y", None]), r.choice("abc"), r.choice(["t", "u", None])))
    return rows


PATTERNS = [
    "(a) @m", "(_) @m", "_ @m", '"t" @m', "(a (b) @m)", "(a (b) @m (c) @n)", "(a (b (c) @n) @m)", "(_ x: (b) @m)", "(a !x) @m", "(a !x !y (b) @n) @m", "[(a) (b)] @m", "(a [(b) @m (c) @n])", "(a x: [(b) (c)] @m)",
    "(a . (b) @m)", "(a (b) @m .)", "(a . (b) @m .)", "(a (b) @m . (c) @n)", "(a . (b) @m . (c) @n .)", "(a . _ @m)", "(a (b)? @m (c) @n)", "(a (b)+ @m)", "(a (b)* @m . (c) @n)", "(a . (b)* @m .)", "(a (c) @l . (b)+ @m . (a)? @n .)",
    "(a [(b) (c)]+ @m)", "(a (b (c)? @n)+ @m)", "((a) @m (b) @n)", "((a) @m . (b) @n)", "((a) @m . (b)* @n . (c) @o)", "(b)+ @m", "(a ((b) @m . (c) @n))", '(a "t"* @m (b) @n)', "(a (b) @m @n)", "(_ (_ (_ (a) @m)))", "(a ; a comment\n (b) @m)",
]


@pytest.fixture(scope="module")
def nodes(spark):
    df = spark.createDataFrame(trees(), SCHEMA).repartition(3).cache()
    placed = pattern.with_places(df).cache()
    yield placed
    df.unpersist(), placed.unpersist()


@pytest.mark.parametrize("text", PATTERNS)
def test_construct_against_a_walk(nodes, text):
    got = pattern.match(nodes, text)
    want = expected(trees(), text)
    assert found(got) == want and want, text


def test_tests(nodes):
    def ids(text, c="m"):
        return sorted((r["file"], r[c]["id"]) for r in pattern.match(nodes, text).collect())

    rows = trees()
    assert ids('(a) @m (#eq? @m "t")') == sorted((f, i) for f, i, _, _, k, t in rows if k == "a" and t == "t") == ids('((a) @m (#eq? @m "t"))')
    assert ids('(a) @m (#not-match? @m "^[t]$")') == sorted((f, i) for f, i, _, _, k, t in rows if k == "a" and t != "t")
    assert ids('(_) @m (#any-of? @m "t" "u")') == sorted((f, i) for f, i, _, _, k, t in rows if t)
    pairs = {(f, i): (k, t) for f, i, _, _, k, t in rows}
    same = pattern.match(nodes, "(a (b) @n) @m (#eq? @m @n)")
    assert all(pairs[r["file"], r["m"]["id"]][1] == pairs[r["file"], r["n"]["id"]][1] for r in same.collect())
    lists = pattern.match(nodes, "(a (b)+ @m)").collect()
    every, some = (pattern.match(nodes, f'(a (b)+ @m) (#{n}eq? @m "t")').count() for n in ("", "any-"))
    assert every == sum(all(x["text"] == "t" for x in r["m"]) for r in lists) and some == sum(any(x["text"] == "t" for x in r["m"]) for r in lists)


def test_odd_patterns_and_tables(nodes):
    for bad in ("", "(a", "a)", "(a))", "(a) (b)", "(a @b", "()", "[]", "(.)", "(a . )", "x: ", "((a) (b))+", "(a ((b) (c))* )", "[(a)* (b)]", "(a) @m (#is? @m \"x\")", '(a) @m (#eq? @n "x")', "(a) @m (#eq? @m)", '(a) @m (#match? @m @m)', "(a (b) @m (c) @m)", "(a !)"):
        with pytest.raises(ValueError):
            pattern.match(nodes, bad)
    assert pattern.match(nodes.limit(0), "(a (b)* @m) @n").isEmpty() and pattern.match(nodes, "(nothing)").isEmpty()
    top = pattern.match(nodes, "(a) @m", most=3).collect()
    assert len(top) == 3 and top[0]["truncated"] and top[0]["total"] == sum(r[4] == "a" for r in trees())


def test_plan_has_no_cross_join(nodes):
    plan = pattern.match(nodes, "(a . (b)* @m . [(c) (a)]? @n .)")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan
