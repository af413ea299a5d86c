"""Plans that must not broadcast exploded tables, and pairs that prefixes must not lose."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codescope.operators import search, tables
from codescope.plans import catalogue

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["word_references", "sibling_overlap"])
def test_exploded_tables_are_not_broadcast(spark, name):
    plan = plan_of(catalogue.queries()[name](spark, SF))
    assert "Broadcast" not in plan and "Nested" not in plan


@pytest.mark.parametrize(("least", "score"), [(1, 0.0), (2, 0.5), (3, 0.5), (2, 0.9), (4, 0.25)])
def test_prefixes_lose_no_pair(spark, least, score):
    r = random.Random(least)
    sets = {(g, u): {min(r.randint(0, 9), r.randint(0, 30)) for _ in range(r.randint(1, 9))} for g in "xyz" for u in range(25)}
    rows = [(g, u, i) for (g, u), items in sets.items() for i in items for _ in range(r.randint(1, 2))]
    got = tables.sibling_overlap(spark.createDataFrame(rows, "g string, u int, i int"), "g", "u", "i", least, score)
    want = []
    for (g, a), x in sets.items():
        for (h, b), y in sets.items():
            share = round(len(x & y) / max(len(x), len(y)) + 1e-12, 3)
            if g == h and a < b and len(x & y) >= least and share >= score:
                want.append((g, a, b, len(x & y), share))
    assert sorted(tuple(q) for q in got.collect()) == sorted(want) and want


def test_words_and_odd_stems(spark):
    lines = [("a", "one two one"), ("a", "x-y z"), ("b", "two x-y"), ("b", "two"), ("c", "ax-y one"), ("c", None), ("d", "x-y2 x-y x-y")]
    held = spark.createDataFrame(lines, "f string, t string")
    stems = spark.createDataFrame([("a", "one", 1), ("b", "two", 2), ("c", "x-y", 3), ("d", "x-y", 4), ("z", "none", 5), ("z", "x-y", 6), ("z", "x-y", 6)], "o string, s string, n int")
    got = search.word_references(stems, held, "o", "s", "f", "t")
    assert sorted(tuple(r) for r in got.collect()) == [("a", "one", 1, 1), ("b", "two", 2, 1), ("c", "x-y", 3, 3), ("d", "x-y", 4, 2), ("z", "none", 5, 0), ("z", "x-y", 6, 3), ("z", "x-y", 6, 3)]
    assert sorted(r["refs"] for r in search.word_references(stems.filter("s <> 'x-y'"), held, "o", "s", "f", "t").collect()) == [0, 1, 1]


def test_words_are_summed_where_the_lines_are(spark):
    held = spark.createDataFrame([("a", "one two one"), ("b", "one")], "f string, t string")
    stems = spark.createDataFrame([("a", "one")], "o string, s string")
    assert "explode" not in plan_of(search.word_references(stems, held, "o", "s", "f", "t"))
    batch = pa.RecordBatch.from_pylist([{"_f": "a", "_t": "one ünï_1 one", "_own": ["one", "two"]}, {"_f": "b", "_t": "two,one", "_own": None}, {"_f": "a", "_t": None, "_own": ["one"]}])
    (got,) = search._words(iter([batch]))
    assert sorted((tuple(x.values()) for x in got.to_pylist()), key=str) == sorted([("one", None, 2, 0), ("ünï_1", None, 1, 0), ("two", None, 1, 0), ("one", "a", 0, 1)], key=str)


def test_odd_stems_without_a_word(spark):
    held = spark.createDataFrame([("a", "x -- y"), ("b", "--"), ("b", "c--"), ("c", "---")], "f string, t string")
    stems = spark.createDataFrame([("b", "--"), ("b", "x-"), (None, None), ("b", "")], "o string, s string")
    assert [r["refs"] for r in search.word_references(stems, held, "o", "s", "f", "t").orderBy(F.desc("s")).collect()] == [0, 2, 0, 0]


def test_cycles_take_no_part_of_the_graph_through_the_driver(spark, monkeypatch):
    plans, write = [], tables.shared.written

    def written(df):
        df.collect()  # the final plan of adaptive execution
        plans.append(plan_of(df))
        return write(df)

    monkeypatch.setattr(tables.shared, "written", written)
    # a ring, a chain into two linked rings that need colours
    edges = [(i, (i + 1) % 6) for i in range(6)] + [(10, 11), (11, 12), (12, 10), (12, 11), (11, 10), (10, 12), (20, 10), (12, 30)]
    got = tables.cycles(spark.createDataFrame(edges, "src long, dst long"))
    assert sorted(tuple(r) for r in got.collect()) == [(i, 0) for i in range(6)] + [(i, 10) for i in (10, 11, 12)]
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in [*plans, plan_of(got)])
