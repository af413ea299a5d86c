"""Every query with an oracle agrees with it on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from codescope.plans import catalogue

SF = "/root/testdata/sf0.001"


def normal(frame):
    def cell(v):
        if pd.isna(v):
            return None
        return round(float(v), 6) if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)

    return sorted((tuple(cell(v) for v in row) for row in frame.itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_oracle(spark, duck, name):
    ours = catalogue.queries()[name](spark, SF)
    columns = sorted(ours.columns)
    theirs = duck.sql(catalogue.oracle_sql()[name]).df()
    assert sorted(theirs.columns) == columns
    assert normal(ours.select(*columns).toPandas()) == normal(theirs[columns])


def test_waivers_and_config():
    from codescope.functions import glob_regex
    from codescope.operators.rules import effective

    import re

    assert re.match(glob_regex("src/*.py"), "src/a/b.py") and not re.match(glob_regex("a?c"), "abbc")
    base = {"a.b.c": {"enabled": True, "severity": "error", "threshold": 1}}
    assert effective(base, {"a": {"enabled": False, "threshold": 5}, "a.b": {"enabled": True}})["a.b.c"] == {"enabled": True, "severity": "error", "threshold": 1}


def test_layers_of_many_rules_are_those_of_few(spark):
    from codescope.operators import rules

    base = {r: {"enabled": True, "severity": "error"} for r in ("a", "a.b", "a.b.c", "a.bc", "x.y", "")}
    tables = {"a": {"enabled": False, "severity": "warning"}, "a.b": {"enabled": True}, "a.b.c": {"severity": "off"}, "x": {"enabled": False}, "x.y": {"enabled": True}, "nothing": {"enabled": False}}
    rows = spark.createDataFrame([(r, c["enabled"], c["severity"]) for r, c in base.items()], "rule string, enabled boolean, severity string")
    over = spark.createDataFrame([(n, t.get("enabled"), t.get("severity")) for n, t in tables.items()], "name string, enabled boolean, severity string")
    got = {r["rule"]: {"enabled": r["enabled"], "severity": r["severity"]} for r in rules.layered(rows, over).collect()}
    assert got == rules.effective(base, tables)


def test_cycles_are_whole_or_an_error(spark):
    from codescope.operators import tables

    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    # three components of three nodes in a line: nothing to trim, no chain
    names = [f"{k}{side}" for k in range(3) for side in "abc"]
    edges = spark.createDataFrame([(x, y) for x in names for y in names if x != y and (x[0] == y[0] or (x[1] == y[1] == "a" and int(y[0]) == int(x[0]) + 1))], "src string, dst string")
    assert sorted((r["node"], r["component"]) for r in tables.cycles(edges).collect()) == [(n, n[0] + "a") for n in names]
    with pytest.raises(RuntimeError):
        tables.cycles(edges, most=0)
    assert tables.cycles(edges.limit(0)).isEmpty()


def components_of(edges):
    """Strongly connected components of two nodes and more, by walks there and back."""
    below, above = {}, {}
    for a, b in edges:
        below.setdefault(a, set()).add(b)
        above.setdefault(b, set()).add(a)

    def reach(n, of):
        seen, todo = {n}, [n]
        while todo:
            for x in of.get(todo.pop(), ()):
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return seen

    out, done = [], set()
    for n in sorted({x for e in edges for x in e}):
        if n not in done:
            same = reach(n, below) & reach(n, above)
            done |= same
            out += [(x, min(same)) for x in same if len(same) > 1]
    return sorted(out)


def test_cycles_of_many_shapes(spark):
    import random

    from codescope.operators import tables

    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    r = random.Random(9)
    edges = []
    for g in range(40):  # many small graphs at once, each of its own names
        n = r.randint(2, 12)
        kind = g % 4
        some = [(r.randrange(n), r.randrange(n)) for _ in range(r.randint(1, 2 * n))]
        if kind == 1:
            some = [(i, (i + 1) % n) for i in range(n)] + [(0, n), (n, n + 1), (n + 1, 0)]
        elif kind == 2:
            some = [(i, i + 1) for i in range(n)] + [(n, n // 2)]
        elif kind == 3:
            some = [(i, i + 1) for i in range(n)] + [(i + 1, i) for i in range(0, n, 3)] + [(n, n + 1), (n + 1, n)]
        edges += [(g * 100 + a, g * 100 + b) for a, b in some]
    df = spark.createDataFrame(edges * 2, "src long, dst long")
    assert sorted(tuple(x) for x in tables.cycles(df).collect()) == components_of(edges)


@pytest.mark.parametrize("shape", ["chain", "ring", "both"])
def test_long_chains_and_rings_take_few_rounds(spark, monkeypatch, shape):
    from codescope import shared
    from codescope.operators import tables

    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    n, rounds = 5000, []
    edges = [(i, i + 1) for i in range(n)] + ([(n, 0)] if shape == "ring" else [])
    if shape == "both":  # two rings that share a node, with a tail
        edges += [(n, 0), (100, n + 5), (n + 5, n + 6), (n + 6, 100), (n + 6, n + 7), (n + 7, n + 8)]
    plain = shared.written
    monkeypatch.setattr(shared, "written", lambda df: rounds.append(1) or plain(df))
    got = sorted(tuple(x) for x in tables.cycles(spark.createDataFrame(edges, "src long, dst long").repartition(4)).collect())
    assert len(rounds) < 30
    assert got == ([] if shape == "chain" else [(i, 0) for i in range(n + 1)] + ([(n + 5, 0), (n + 6, 0)] if shape == "both" else []))


def test_magic_literals_of_zero_led_numbers_and_repeated_keys(spark, tmp_path):
    rows = [
        (1, "0100 11 22 33"),  # 0100 is a whole number: only 100.0 is trivial
        (2, "00100 0100 100 100.0 11 12"),
        (3, "100 100.0 00 01 002 0.50 11 22 33"),
        (4, f"{'0' * 60}100 {'9' * 40} {'1' * 19}.5 7 1.{'0' * 30}1"),
        (5, "11 22"), (5, "22 33"), (5, None), (5, "44.0"),  # one key in many rows
        (None, "5 6"), (None, "7 8"), (6, None), (7, ""), (8, "11 22 33 33"),
    ]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["distinct_count"], r["literals"]) for r in catalogue.queries()["magic_literals"](spark, str(tmp_path)).collect()}
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == {k: (n, found) for k, n, found in c.sql(f"SELECT doc_id, distinct_count, literals FROM ({catalogue.oracle_sql()['magic_literals']})").fetchall()}
    assert got[1] == (4, "0100|11|22|33") and got[5] == (4, "11|22|33|44.0") and got[None] == (4, "5|6|7|8")
    assert got[2] == (5, "00100|0100|100|11|12") and got[3] == (4, "100|11|22|33") and set(got) == {1, 2, 3, 4, 5, None}
