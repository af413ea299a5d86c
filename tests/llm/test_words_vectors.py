"""Spelling variants, the range join and hard negatives against brute force: nulls, ties, repeats, odd vectors, clashing names."""

import collections
import os
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("codescope.llm")
from codescope.llm import hard_negatives, metric_join, spelling  # noqa: E402

SF = "/root/testdata/sf0.001"
RUNS = re.compile("[A-Za-zÀ-ÿ]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def counted(rows, noise=97):
    n = collections.Counter()
    for i, text in rows:
        for run in RUNS.findall(text or ""):
            w = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if noise and h % noise == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    return any(a[:i] + b[i : i + 1] + a[i + (len(a) == len(b)) :] == b for i in range(len(b)))


def grouped(n):
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w, x in near.items():
        best = min(x, key=lambda y: (-n[y], y), default=None)
        if best and n[best] >= 2 * n[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return {w: (form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


def rows_of(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_word_groups_against_all_pairs(spark):
    r = random.Random(4)
    words = {"".join(r.choice("abÀz") for _ in range(r.randint(1, 7))): r.randint(1, 60) for _ in range(900)}
    words |= {"aaaa": 9, "aaa": 40, "aaaaa": 2, "a": 5, "b": 5, "é": 1, "caaaa": 4, "x" * 60: 3, "x" * 61: 8, "x" * 59 + "y": 3}
    df = spark.createDataFrame([(w, c, "h") for w, c in words.items()], "word string, n long, node string").repartition(3)
    assert rows_of(spelling.group(df)) == grouped(words)


def test_forms_lead_to_the_last_one(spark):
    chain = {"a" * 5 + "b" * i: 3 * 2**i for i in range(14)}
    got = rows_of(spelling.group(spark.createDataFrame(list(chain.items()), "word string, n long")))
    assert {v[1] for v in got.values()} == {"a" * 5 + "b" * 13} and got == grouped(chain)


def test_words_of_texts(spark):
    texts = ["Naïve WORDS words wordS wörds ÀÉ×÷ x1Words_wordz", None, "", "words, word's Words-words \n wordz wordz", "STRASSE straße Straße straße strasse strasse", "ÉTUDE Étude étude étude étude", "longlong" * 900 + " " + "tail. " * 4000]
    rows = [(i, t, "x", i) for i, t in enumerate(texts)] + [(1, "words wordz", "x", 1), (None, "words étude", "x", 2), (3, texts[3], "x", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, n long").repartition(3)
    for noise in (0, 2, 97):
        want = counted([r[:2] for r in rows], noise)
        assert {r["word"]: r["n"] for r in spelling.count_words(docs, noise=noise).collect()} == want
        assert rows_of(spelling.group(spelling.count_words(docs, noise=noise))) == grouped(want)
    assert spelling.group(spelling.count_words(docs.limit(0))).isEmpty()


def test_spelling_query(spark):
    import pyarrow.dataset as ds

    docs = ds.dataset(f"{SF}/documents.parquet").to_table(columns=["doc_id", "text"]).to_pylist()
    want = counted([(d["doc_id"], d["text"]) for d in docs])
    got = rows_of(spelling.op11_spelling_variants(spark, SF))
    assert {w: (v[2]) for w, v in got.items()} == want
    some = set(random.Random(1).sample(sorted(want), 400))
    near = {w: [x for x in want if one_edit(w, x)] for w in some}
    assert {w: got[w][3] for w in some} == {w: len(x) for w, x in near.items()}


# -- the range join

def linked(ids, vectors, least=0.9):
    """By all pairs; the smallest id that links reach."""
    n = len(ids)
    sizes = collections.Counter(len(v) for v in vectors if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v))
    size = min(sizes, key=lambda d: (-sizes[d], d), default=0)
    good = [i for i, v in enumerate(vectors) if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    near = collections.defaultdict(list)
    unit = {i: np.array(vectors[i], dtype=float) / np.abs(vectors[i]).max() for i in good}
    unit = {i: u / np.linalg.norm(u) for i, u in unit.items()}
    for i in good:
        near[i] = [j for j in good if i != j and unit[i] @ unit[j] >= least - 1e-12]
    comp = list(range(n))
    for i in range(n):
        if comp[i] == i:
            todo = [i]
            while todo:
                for j in near[todo.pop()]:
                    if comp[j] > i:
                        comp[j] = i
                        todo.append(j)
    least_id = {c: min((ids[i] for i in range(n) if comp[i] == c and ids[i] is not None), default=None) for c in set(comp)}
    return sorted(((ids[i], len(near[i]), least_id[comp[i]], ids[i] is not None and ids[i] == least_id[comp[i]]) for i in range(n)), key=str)


def joined_rows(df):
    return sorted((tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


@pytest.fixture
def small_slices(monkeypatch):
    monkeypatch.setattr(metric_join, "SLICE", 40)
    monkeypatch.setattr(metric_join, "VISITORS", 60)


def clouds(seed, dim, sizes, spread):
    r = np.random.default_rng(seed)
    rows = [c + r.normal(size=dim) * s for n, s in zip(sizes, spread, strict=True) for c in [r.normal(size=dim)] for _ in range(n)]
    return [rows[i].tolist() for i in r.permutation(len(rows))]


@pytest.mark.parametrize(("dim", "kind"), [(3, "double"), (16, "float"), (64, "double")])
def test_links_against_all_pairs(spark, small_slices, dim, kind):
    vectors = clouds(dim, dim, (200, 60, 60, 40, 30, 1, 1, 1), (0.02, 0.1, 0.2, 0.35, 0.6, 1, 1, 1))
    vectors += vectors[:30]  # equal vectors
    vectors = [np.array(v, dtype="f4" if kind == "float" else "f8").tolist() for v in vectors]
    ids = random.Random(dim).sample(range(-500, 5000), len(vectors))
    df = spark.createDataFrame(list(zip(ids, vectors, ids, strict=True)), f"vec_id long, embedding array<{kind}>, k long").repartition(5)
    assert joined_rows(metric_join.near_duplicates(df)) == linked(ids, vectors)


def test_odd_vectors(spark, small_slices):
    nan, inf = float("nan"), float("inf")
    vectors = [[1.0, 0, 0, 0], [9.0, 3, 3, 1], [8.99, 3, 3, 1], None, [], [0.0, 0, 0, 0], [1.0, None, 0, 0], [nan, 1, 0, 0], [inf, 0, 0, 0], [1e300, 1e300, 0, 0], [1e-300, 1e-300, 0, 0], [-0.0, 1, 0, 0], [0.0, 1, 0, 0], [1.0, 0, 0], [1.0, 0, 0], [2.0, 0, 0, 0], [2.0, 0, 0, 0]]
    vectors += [[1.0, 0.1, 0, 0]] * 90  # a third of the rows and more
    vectors = [v and [x if x is None else float(x) for x in v] for v in vectors]
    for ids in (list(range(len(vectors))), [i // 2 for i in range(len(vectors))], [None, *range(1, len(vectors))]):
        df = spark.createDataFrame(list(zip(ids, vectors, strict=True)), "vec_id long, embedding array<double>")
        assert joined_rows(metric_join.near_duplicates(df)) == linked(ids, vectors)
    assert metric_join.near_duplicates(df.limit(0)).isEmpty()
    assert joined_rows(metric_join.near_duplicates(df.filter("embedding is null"))) == [(3, 0, 3, True)]


def test_hot_cell_is_not_compared():
    """Vectors within half the reach of a pivot don't visit their own cell, and no pair of cells is met twice."""
    r = np.random.default_rng(2)
    hot = metric_join.units(np.eye(16)[0] + r.normal(size=(300, 16)) * 0.02)
    rest = metric_join.units(r.normal(size=(300, 16)))
    unit = np.concatenate([hot, rest])
    cells = metric_join.Cells(metric_join.choose_pivots(unit, 12, np.arccos(0.9) / 2), 0.9)
    home, angle = cells.home(unit)
    for h in set(home.tolist()):
        cells.rows[h], cells.low[h], cells.high[h] = (home == h).sum(), angle[home == h].min(), angle[home == h].max()
    assert len(set(home[:300].tolist())) == 1 and home[0] % 2 == 0
    goes = cells.visits(unit, home)
    assert not goes[np.arange(600), home].any()
    near = unit @ unit.T >= 0.9
    for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True):
        if home[i] != home[j]:
            assert goes[i, home[j]] + goes[j, home[i]] == 1
    assert goes[:300].sum() == 0  # the hot cell is visited and sends nobody


def run_sql(sql):
    import duckdb

    at = f"{SF}/embeddings.parquet"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{at}{'/*.parquet' if os.path.isdir(at) else ''}')")
    return con.sql(sql).df()


def test_queries_equal_sql(spark):
    for query, sql in ((metric_join.op12_embedding_near_dedup, metric_join.ORACLE), (hard_negatives.op13_hard_negatives, hard_negatives.ORACLE)):
        ours, theirs = query(spark, SF).toPandas(), run_sql(sql)
        names = sorted(theirs.columns)
        assert sorted(ours.columns) == names and len(theirs)
        assert sorted(ours[names].itertuples(index=False, name=None)) == sorted(theirs[names].itertuples(index=False, name=None))


# -- hard negatives

def mined(rows, every=50):
    whole = [(i, y, v) for i, y, v in rows if i is not None and y is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    sizes = collections.Counter(len(v) for _, _, v in whole)
    size = min(sizes, key=lambda d: (-sizes[d], d), default=0)
    whole = [(i, y, [int(np.floor(256 * x)) for x in v]) for i, y, v in whole if len(v) == size and max(map(abs, v)) < 1e5]
    out = []
    for a, (i, y, v) in enumerate(whole):
        if i % every:
            continue
        scored = [(-sum(p * q for p, q in zip(v, w, strict=True)), j, z) for b, (j, z, w) in enumerate(whole) if a != b]
        for s, j, _ in sorted(x for x in scored if x[2] == y)[:5]:
            fits = sorted(x for x in scored if x[2] != y and 50 * -s <= 100 * -x[0] <= 95 * -s)[:3]
            out += [(i, j, r, k, -s, -t) for r, (t, k, _) in enumerate(fits, 1)]
    return sorted(out)


@pytest.mark.parametrize("dim", [1, 2, 24])
def test_negatives_against_all_rows(spark, monkeypatch, dim):
    monkeypatch.setattr(hard_negatives, "GROUP", 7)
    monkeypatch.setattr(hard_negatives, "SMALL_SLAB", 60)
    r = np.random.default_rng(dim)
    vectors = (r.normal(size=(400, dim)) * np.geomspace(1, 0.05, dim)).round(1 if dim < 9 else 6).tolist()  # few dimensions: many ties
    rows = [(i * 5, int(r.integers(0, 4)) if i % 3 else 0, v) for i, v in enumerate(vectors)]
    rows += [(5001, None, vectors[0]), (None, 1, vectors[0]), (5050, 1, None), (5100, 2, []), (5150, 1, [0.0] * dim), (5200, 9, vectors[3]), (5250, 1, [float("nan")] + [0.0] * (dim - 1)), (5300, 1, [1e300] * dim), (5350, 1, [None] * dim), (5400, 1, [1.0] * (dim + 1))]
    rows += [(0, rows[0][1], vectors[0]), (10, rows[2][1], vectors[2])]  # repeated rows
    df = spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, label int, embedding array<double>, k int").repartition(4)
    got = sorted(tuple(x) for x in hard_negatives.mine(df).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())
    assert got == mined(rows)
    assert hard_negatives.mine(df.limit(0)).isEmpty()
    assert hard_negatives.mine(df.filter("vec_id = 5300")).isEmpty()


def test_early_discard_is_safe_and_works():
    r = np.random.default_rng(8)
    a, x = (np.floor(r.normal(size=(n, 32)) * np.geomspace(1, 0.01, 32) * 256).astype("<i4") for n in (50, 2000))
    turn = hard_negatives.Rotation(x)
    assert np.abs(turn.axes @ turn.axes.T - np.eye(32)).max() < 1e-12 and turn.cuts[0] < 16
    scores = a.astype(np.int64) @ x.T.astype(np.int64)
    least = np.sort(scores, axis=1)[:, -20].astype(float)
    i, j = turn.survivors(*turn.turned(a), *turn.turned(x), least)
    alive = set(zip(i.tolist(), j.tolist(), strict=True))
    assert set(map(tuple, np.argwhere(scores >= least[:, None]).tolist())) <= alive and len(alive) < 0.05 * scores.size
    assert (hard_negatives.exact(a, x, i, j) == scores[i, j]).all()
