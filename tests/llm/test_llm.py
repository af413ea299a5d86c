"""The training-data operators against brute force on small tables: nulls, ties, repeats, empty and long texts."""

import collections
import hashlib
import os
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("codescope.llm")
from codescope.llm import chat, common, components, decontaminate, fingerprint, html_text, jaccard_join, packing, quality, suffix_dedup, token_output, tokens, url_filter  # noqa: E402

VOCABULARIES = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
WORD, BYTE = f"{VOCABULARIES}/word_bpe_49k.json", f"{VOCABULARIES}/byte_bpe_50k.json"
R = random.Random(5)
SYLLABLES = "the er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()


def prose(n, r=R):
    return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 3))) + r.choice(["", "", "", ".", ",", ".\n"]) for _ in range(n))


def corpus():
    R.seed(5)  # the same rows whatever ran before
    base = [prose(R.randint(1, 300)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, t) for i, t in enumerate(base[:6])]  # copies
    rows += [(200 + i, t + " " + prose(4)) for i, t in enumerate(base[:20])]  # near copies
    passage = prose(120)
    rows += [(300 + i, prose(20) + " " + passage + " " + prose(20)) for i in range(9)]
    rows += [(400, None), (401, ""), (402, "one"), (403, "one"), (404, "ab" * 3000), (405, "É ü " * 400), (406, " \n\t "), (None, "without an id"), (407, prose(9000)), (408, "a b c d"), (408, "a b c e f g")]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    # extra columns clash with names that the operators use inside
    return spark.createDataFrame([(i, t, "x", 1.0) for i, t in rows], "doc_id long, text string, k string, score double").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


# -- token output

def test_simple8b_round_trip():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 127, 128, 129, 1000):
        for shift in (0, 3, 20, 44, 56, 63):
            x = r.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2) >> np.uint64(shift)
            words, blocks, escapes = token_output.encode(x)
            assert (token_output.decode(words, blocks, escapes, n) == x).all()
            assert blocks.sum() == len(words)


ODD = ["", " ", "a  b", "it's don't", "x\ny", "x\n\ny ", "<|endoftext|> hi", "É naïve—test", "a\tb", "12 345", "foo.bar! (x)", "ΣΑΣ. ΑΣ", "word.\nNext's", " x", "A'S.", "x.'s", "a\x1cb c", "a\xa0b", "é é.", "İx."]


@pytest.mark.parametrize(("path", "kind"), [(WORD, "word"), (BYTE, "byte")])
def test_cached_tokenizer_equals_library(path, kind, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 200)
    tok = tokens.WordTokenizer(path, kind)
    for _ in range(4):  # the cache fills, freezes and forgets
        texts = [*ODD, *[prose(80) for _ in range(20)]]
        flat, counts = tok.ids(texts)
        ends = np.cumsum(counts)
        assert [flat[e - c : e].tolist() for e, c in zip(ends, counts, strict=True)] == tok.whole(texts)


def test_token_files(spark, docs, rows, empty):
    path = common.shared_dir(spark)
    token_output.write(docs, path, WORD, 1, shards=3)
    tok = tokens.WordTokenizer(WORD, "word")
    want, start = [], 0
    for i, t in sorted(((-(2**63) if i is None else i), t or "") for i, t in rows):
        ids = [*tok.whole([t])[0], 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = token_output.summaries(spark, path)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == want
    assert token_output.read(spark, path).count() == len(want)
    path = common.shared_dir(spark)
    token_output.write(empty, path, WORD, 1)
    assert token_output.summaries(spark, path).count() == 0


# -- packing

def best_fit(sizes, capacity):
    """Bins of best-fit decreasing, piece by piece."""
    rooms: list[int] = []
    for size in sorted(sizes, reverse=True):
        fits = [r for r in rooms if r >= size]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else capacity) - size)
    return len(rooms)


def least_bins(sizes, capacity):
    """No packing has fewer bins (the bound of Martello and Toth)."""
    out = 0
    for k in range(capacity // 2 + 1):
        large, middle = [s for s in sizes if s > capacity - k], [s for s in sizes if capacity / 2 < s <= capacity - k]
        small = sum(s for s in sizes if k <= s <= capacity / 2)
        out = max(out, len(large) + len(middle) + max(0, -(-(small - (len(middle) * capacity - sum(middle))) // capacity)))
    return out


def test_plan_is_valid_and_tight():
    r = random.Random(2)
    for _ in range(30):
        counts = {r.randint(1, 64): r.randint(1, 50) for _ in range(r.randint(1, 30))}
        groups = packing.plan(counts, 64)
        used = collections.Counter()
        for pattern, many in groups:
            assert sum(s * c for s, c in pattern) <= 64
            for s, c in pattern:
                used[s] += c * many
        assert used == counts
        assert sum(m for _, m in groups) == best_fit([s for s, c in counts.items() for _ in range(c)], 64)


def test_pack(docs, rows, empty):
    got = packing.pack(docs, BYTE, 2, 256).toPandas()
    tok = tokens.WordTokenizer(BYTE, "byte")
    for i, t in rows:
        if i is None or sum(j == i for j, _ in rows) > 1:
            continue
        ids = [*tok.whole([t or ""])[0], 2]
        mine = got[got.doc_id == i].sort_values("piece")
        assert mine.length.sum() == len(ids) and (mine.length.iloc[1:] == 256).all()
        assert mine.start.tolist() == (mine.length.cumsum() - mine.length).tolist()
        assert mine.ids_crc32.tolist() == [zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()) for s, n in zip(mine.start, mine.length, strict=True)]
    got = got.sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id").length.cumsum() - got.length == got.offset).all()
    assert got.groupby("sequence_id").length.sum().max() <= 256
    assert least_bins(got.length.tolist(), 256) <= got.sequence_id.nunique() <= best_fit(got.length.tolist(), 256)
    assert got.sequence_id.nunique() <= least_bins(got.length.tolist(), 256) + 1
    assert packing.pack(empty, BYTE, 2).count() == 0


# -- quality

def test_quality(spark):
    r = random.Random(3)
    good = [(i, prose(60, r), 1) for i in range(300)]
    bad = [(1000 + i, " ".join(w + "$$$" for w in prose(60, r).split()), 0) for i in range(60)]
    both = spark.createDataFrame([(i, t, 9.0) for i, t, _ in good + bad] + [(-1, None, 9.0), (-2, "", 9.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in good + bad if i % 5] + [(None, 1), (3, None)], "doc_id long, quality int")
    w = quality.fit(both, labels)
    scored = {r["doc_id"]: r["score"] for r in quality.score(both, w).collect()}
    assert all(scored[i] > 0.5 for i, _, _ in good) and all(scored[i] < 0.3 for i, _, _ in bad)
    assert scored[-1] == scored[-2] and 0 <= scored[-1] <= 1
    kept = quality.filter_quality(both, labels)
    assert kept.columns == both.columns and kept.count() >= 300
    none = quality.fit(both, labels.limit(0))
    assert {r["score"] for r in quality.score(both, none).collect()} == {0.5}


def naive_features(text):
    """Counts of hashed words and pairs, word by word."""
    words = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\0\t-\r ]+", text)
    out = collections.Counter(int(quality.features([w])[0][0]) for w in words)
    out.update(int(quality.features([a + b" " + b])[0][2]) for a, b in zip(words, words[1:]))
    return out


def test_quality_against_plain_updates():
    r = random.Random(8)
    rows = [(prose(r.randint(0, 40), r).encode() + (b" A--b \xc3\xa9" if i % 3 else b""), i % 2) for i in range(25)]
    rows += [(b"", 1), (rows[0][0], 1), (rows[0][0], 0), (prose(4000, r).encode(), 1)]  # no words, conflicting labels, a long one
    size, alpha, beta, l1, l2 = 2**quality.BITS, 0.3, 1.0, 0.05, 0.1
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(k):
        return 0.0 if abs(z[k]) <= l1 else ((l1 if z[k] > 0 else -l1) - z[k]) / ((beta + n[k] ** 0.5) / alpha + l2)

    def vector(t):
        c = naive_features(t)
        return {k: v / max(sum(c.values()), 1) ** 0.5 for k, v in c.items()} | {size: 1.0}

    for _ in range(3):
        for t, y in rows:
            x = vector(t)
            w = {k: weight(k) for k in x}
            p = 1 / (1 + np.exp(-sum(w[k] * v for k, v in x.items())))
            for k, v in x.items():
                g = (p - y) * v
                z[k] += g - ((n[k] + g * g) ** 0.5 - n[k] ** 0.5) / alpha * w[k]
                n[k] += g * g
    got = quality.train(iter(rows))
    assert np.flatnonzero(got).tolist() == sorted(k for k in z if weight(k) != 0) and all(abs(got[k] - weight(k)) < 1e-5 for k in z)
    want = [1 / (1 + np.exp(-sum(weight(k) * v for k, v in vector(t).items()))) for t, _ in rows]
    assert np.allclose(quality.score_texts(got, [t for t, _ in rows]), want, atol=1e-5)


def test_quality_takes_one_label_for_each_document(spark):
    docs = spark.createDataFrame([(1, "good words here"), (1, "good words here"), (2, "bad $$$")], "doc_id long, text string")
    both = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "doc_id long, quality int")
    one = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert (quality.fit(docs, both) == quality.fit(docs, one)).all()


# -- suffix dedup

def removed(rows, n):
    texts = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(b[j : j + n] for b in texts for j in range(len(b) - n + 1))
    out = []
    for (i, _), b in zip(rows, texts, strict=True):
        gone = bytearray(len(b))
        for j in range(len(b) - n + 1):
            if seen[b[j : j + n]] > 1:
                gone[j : j + n] = b"\1" * n
        spans = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("group", [1024, 2])
def test_suffix_dedup(docs, rows, group, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    monkeypatch.setattr(suffix_dedup, "MOST_RUNS", 5)
    out = suffix_dedup.removal(docs, 100)
    assert sorted(map(tuple, out.drop("kept_text").collect()), key=str) == sorted(removed(rows, 100), key=str)
    if group == 2:
        text = {i: t or "" for i, t in rows}
        assert all(r["kept_text"] == text[r["doc_id"]] for r in out.collect() if not r["n_removed"] and r["doc_id"] not in (None, 408))


def test_suffix_dedup_on_the_given_documents(spark):
    given = common.table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r["doc_id"], r["text"]) for r in given.collect()]
    assert sorted(map(tuple, suffix_dedup.removal(given).drop("kept_text").collect())) == sorted(removed(rows, 400))


def test_suffix_sort_orders_suffixes():
    data = np.frombuffer(b"banana\0bananab\0ananas\0" * 3 + b"\0" * 40, dtype=np.uint8)
    s = suffix_dedup.SuffixSort(data, 8)
    at = np.arange(60)
    got = s.sort(at, np.zeros(60, dtype=np.int64))
    keys = [data[i : i + 8].tobytes() for i in got]
    assert keys == sorted(keys)


def test_strip_keeps_rows_and_characters(docs, empty):
    out = suffix_dedup.strip_repeats(docs, 100)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert out.filter("doc_id = 405").first()["text"].strip("É ü") == ""
    assert suffix_dedup.removal(empty).count() == 0
    few = suffix_dedup.strip_repeats(docs, 100, 10**6)
    assert few.exceptAll(docs).isEmpty() and docs.exceptAll(few).isEmpty()


#: Names that operators use inside.
CLASHING = ["_k", "_text", "_spans", "_span_k", "k", "n", "comp", "score", "leaks", "c0", "label", "one"]


def test_filters_keep_columns_of_any_name(spark, docs):
    base = docs.select("doc_id", "text")
    wide = base
    for i, c in enumerate(CLASHING):
        wide = wide.withColumn(c, F.coalesce("doc_id", F.lit(-1)) * 100 + i)
    labels = base.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    benchmark = spark.createDataFrame([(1, "ten words that are in no text of this corpus at all ever")], "item_id long, text string")
    for use in (
        lambda d: jaccard_join.keep_one(d), lambda d: suffix_dedup.strip_repeats(d, 100), lambda d: decontaminate.remove_leaks(d, benchmark), lambda d: quality.filter_quality(d, labels, 0.0),
    ):
        out = use(wide)
        assert out.columns == wide.columns
        got = sorted([r for r in out.collect()], key=str)
        assert len(got) == use(base).count() > 0
        assert all(r[c] == (-1 if r["doc_id"] is None else r["doc_id"]) * 100 + i for r in got for i, c in enumerate(CLASHING))


# -- Jaccard join

def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[j : j + 5]) for j in range(len(w) - 4)])


def joined(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * n >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    least = collections.defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)].append(i)
    return [(i, len(s), i if not s else min(least[top(k)], default=None)) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))]


def test_jaccard_join(docs, rows, empty, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FREQUENT_AT", 3)
    monkeypatch.setattr(jaccard_join, "STAR", 3)
    assert sorted(map(tuple, jaccard_join.join(docs).collect()), key=str) == sorted(joined(rows), key=str)
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    want = {i for i, n, c in joined(rows) if n and i is not None and i == c}
    got = [r["doc_id"] for r in kept.collect() if (r["text"] or "").strip() and r["doc_id"] is not None]
    assert set(got) == want
    assert kept.filter("text is null or text = ''").count() == 2
    assert jaccard_join.join(empty).count() == 0


def test_jaccard_join_where_pivots_are_not_near(spark):
    """Groups of near copies about the limit, and texts that share a passage but aren't near: many pivots, rounds and the rest."""
    r = random.Random(3)
    words = [f"w{i}" for i in range(500)]
    rows, base, passage = [], [r.choice(words) for _ in range(80)], [r.choice(words) for _ in range(40)]
    for _ in range(60):
        t = list(base)
        for _ in range(r.randint(0, 5)):
            t[r.randrange(len(t))] = r.choice(words)
        rows.append((len(rows), " ".join(t)))
    rows += [(100 + i, " ".join(passage + [r.choice(words) for _ in range(r.randint(3, 25))])) for i in range(60)]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard_join.join(made).collect())) == sorted(joined(rows))


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (100, 102), (7, 7)]
    got = {r["v"]: r["comp"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100, 102: 100}


# -- decontamination

def test_leaks_recall_and_precision(spark):
    r = random.Random(4)
    items = [(i, prose(r.randint(12, 60), r)) for i in range(40)] + [(90, "too short"), (91, None)]
    found = wanted = 0
    texts, truth = [], []
    for i, t in items[:40]:
        for rate in (0, 0.05, 0.1):
            words = [w for w in t.split() if r.random() > rate / 2]
            words = [w[::-1] + "x" if r.random() < rate / 2 else w for w in words]
            texts.append(prose(60, r) + " " + " ".join(words).upper() + " " + prose(60, r))
            truth.append(i)
    clean = [prose(200, r) for _ in range(60)]
    held = decontaminate.Items(items)
    for t, i in zip(texts, truth, strict=True):
        s, e, _, low = decontaminate.words_of([t.encode()])
        k = [n for n, _ in held.rows].index(i)
        near, _ = decontaminate.infix_distance(held.texts[k], decontaminate.plain(low, s, e))
        if near <= int(0.25 * len(held.texts[k])):
            wanted += 1
            found += any(x["item_id"] == i for x in decontaminate.leaks([t.encode()], held)[0])
    assert wanted > 100 and found >= 0.95 * wanted
    assert not any(decontaminate.leaks([c.encode() for c in clean], held))
    docs = spark.createDataFrame([(0, texts[0], 1), (1, clean[0], 1), (2, None, 1), (3, "", 1)], "doc_id long, text string, leaks int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert [x["doc_id"] for x in decontaminate.remove_leaks(docs.drop("leaks"), bench).collect()] == [1, 2, 3]
    assert decontaminate.find(docs, bench.limit(0)).selectExpr("sum(size(leaks)) n").first()["n"] == 0


def edited(t, rate, r, kinds="rdi"):
    """Letters replaced, dropped or followed by another at a rate."""
    out = []
    for c in t:
        k = r.choice(kinds) if r.random() < rate else " "
        out.append({" ": c, "r": r.choice("abcdefghij"), "d": "", "i": c + r.choice("abcdefghij")}[k])
    return "".join(out)


def invented(n, r):
    return " ".join("".join(r.choice("abcdefghijklmnoprstu") for _ in range(r.randint(2, 9))) for _ in range(n))


@pytest.mark.parametrize("rate,kinds", [(0, "r"), (0.05, "rdi"), (0.1, "rdi"), (0.15, "rdi"), (0.2, "rdi"), (0.25, "rdi"), (0.2, "r"), (0.25, "d"), (0.22, "i")])
def test_leaks_recall_under_character_edits(rate, kinds):
    r = random.Random(11)
    items = [(i, invented(r.randint(10, 59), r)) for i in range(120)]
    held = decontaminate.Items(items)
    texts, truth = [], []
    for i, t in items:
        e = edited(t, rate, r, kinds)
        if decontaminate.infix_distance(t, " ".join(e.split()))[0] <= int(0.25 * len(t)):
            texts.append(f"{invented(40, r)} {e} {invented(40, r)}".encode())
            truth.append(i)
    found = sum(any(x["item_id"] == i for x in got) for i, got in zip(truth, decontaminate.leaks(texts, held), strict=True))
    assert len(truth) > 40 and found >= (1 if rate == 0 else 0.95) * len(truth)


def exactly(t, n, kinds, r):
    """``t`` with just ``n`` edits at different places."""
    out = list(t)
    for k in r.sample(range(len(t)), n):
        out[k] = {"r": r.choice("abcdefghij"), "d": "", "i": t[k] + r.choice("abcdefghij")}[r.choice(kinds)]
    return "".join(out)


@pytest.mark.parametrize("kinds", ["rdi", "r", "d", "i"])
@pytest.mark.parametrize("words,longest,least", [((30, 59), 9, 0.9), ((16, 20), 9, 0.9), ((10, 10), 9, 1), ((12, 14), 3, 1), ((7, 7), 9, 1), ((5, 5), 9, 1)])
def test_leaks_recall_at_the_limit(words, longest, least, kinds):
    """A quarter of the characters edited, by the length of items; items under LONG characters are all found."""
    r = random.Random(21)
    items = []
    while len(items) < 80:
        t = " ".join("".join(r.choice("abcdefghijklmnoprstu") for _ in range(r.randint(2, longest))) for _ in range(r.randint(*words)))
        if (len(t) >= decontaminate.LONG) == (least < 1) and len(t) >= decontaminate.MIN_CHARS:
            items.append((len(items), t))
    held = decontaminate.Items(items)
    texts, truth = [], []
    for i, t in items:
        e = exactly(t, len(t) // 4, kinds, r)
        if decontaminate.infix_distance(t, " ".join(e.split()))[0] <= len(t) // 4:
            texts.append(f"{invented(40, r)} {e} {invented(40, r)}".encode())
            truth.append(i)
    got = decontaminate.leaks(texts, held)
    assert len(truth) > 40 and sum(any(x["item_id"] == i for x in g) for i, g in zip(truth, got, strict=True)) >= least * len(truth)
    assert not any(x["item_id"] != i for i, g in zip(truth, got, strict=True) for x in g)


def test_leaks_of_short_items_are_all_pairs_within_the_limit():
    """Against the exact distance of every item and text, wherever the edits are."""
    r = random.Random(22)
    items = [(i, "".join(r.choice("abcd ") for _ in range(r.randint(20, 79))).strip().strip("abcd") + invented(3, r)) for i in range(60)]
    held = decontaminate.Items(items)
    texts = [invented(5, r) + " " + exactly(t, r.randint(0, len(t) // 3), "rdi", r) + " " + invented(r.randint(0, 5), r) for t in (r.choice(items)[1] for _ in range(150))]
    want = []
    for t in texts:
        s, e, _, low = decontaminate.words_of([t.encode()])
        whole = decontaminate.plain(low, s, e)
        near = [(held.rows[n][0], decontaminate.infix_distance(p, whole)[0], len(p)) for n, p in enumerate(held.texts)]
        want.append([(i, d) for i, d, m in near if d <= m // 4 and decontaminate.MIN_CHARS <= m < decontaminate.LONG])
    got = decontaminate.leaks([t.encode() for t in texts], held)
    short = {held.rows[n][0] for n, _ in held.exact}
    assert [[(x["item_id"], x["distance"]) for x in g if x["item_id"] in short] for g in got] == want
    assert sum(map(len, want)) > 50


def test_pieces_rule_out_most_windows_and_no_likeness(monkeypatch):
    """Every item against every text: what is near is what it was without pieces, and few windows get as far as their distance."""
    r = random.Random(23)
    items = [(i, invented(n, r)) for i, n in enumerate([*range(4, 60, 2), 200])]
    held = decontaminate.Items(items)
    texts = []
    for _, t in items:
        k = len(t) // 4
        some = "".join(r.choice("abcdefghij") for _ in range(k))
        texts += [t, t[k:], t[: len(t) - k], some + t, t[:9] + some + t[9:], t[:9] + t[9 + k :], t[:-9] + some + t[-9:], t[: -9 - k] + t[-9:], *(exactly(t, k, kinds, r) for kinds in ("rdi", "r", "d", "i"))]
    texts = [x for t in texts for x in (t, f"{invented(3, r)} {t} {invented(30, r)}")]
    parts = [decontaminate.characters(decontaminate.words_of([t.encode()])[3]) for t in texts]
    chars, end = np.concatenate(parts), np.cumsum([len(x) for x in parts])
    item, text = (x.ravel() for x in np.meshgrid(np.arange(len(items)), np.arange(len(parts))))
    a, b, most = (end - [len(x) for x in parts])[text], end[text], held.length[item] // 4
    fits = b - a >= held.length[item] - most
    item, a, b, most = (x[fits] for x in (item, a, b, most))
    plain = decontaminate.Items._distances
    want = np.zeros(len(item), dtype=bool)
    words = -(-held.length[item] // 64)
    for w in np.unique(words):
        at = np.flatnonzero(words == w)
        want[at] = plain(held, np.append(chars % decontaminate.FOLD, 0).astype(np.int64), item[at], a[at], b[at]) <= most[at]
    seen = []
    monkeypatch.setattr(decontaminate, "FEW", 1, raising=False)
    monkeypatch.setattr(decontaminate.Items, "_distances", lambda self, fold, item, a, b: seen.extend(item) or plain(self, fold, item, a, b))
    assert (held.near(chars, item, a, b, most) == want).all()
    assert want.sum() > 15 * len(items) and len([i for i in seen if held.length[i] >= 64]) < 1.5 * want.sum()


def test_leaks_one_typo_in_each_word():
    r = random.Random(12)
    items = [(i, " ".join(invented(1, r) + "xyz" for _ in range(r.randint(15, 59)))) for i in range(60)]
    texts = [" ".join(w[:k] + "q" + w[k + 1 :] for w in t.split() for k in [r.randrange(len(w))]).encode() for _, t in items]
    got = decontaminate.leaks(texts, decontaminate.Items(items))
    assert sum([x["item_id"] for x in g] == [i] for (i, _), g in zip(items, got, strict=True)) >= 0.95 * len(items)


def test_short_items_and_all_exact_copies():
    r = random.Random(13)
    items = [(i, invented(n, r)) for n in range(1, 16) for i in range(n * 100, n * 100 + 20)]
    items += [(1, "今日は天気が良い"), (2, "这是一个没有空格的句子" * 5), (3, "to shore"), (4, "?!")]
    texts = [f"{invented(30, r)} {t.upper()}, {invented(30, r)}".encode() for _, t in items[:-4]]
    texts += [("昔々" + t + "ね").encode() for _, t in items[-4:-2]] + [b"Go (TO\nshore)", b"onto shore, to shores?!"]
    got = [[(x["item_id"], x["distance"]) for x in g] for g in decontaminate.leaks(texts, decontaminate.Items(items))]
    assert all((i, 0) in g for (i, _), g in zip(items[:-1], got, strict=False))
    assert got[-1] == []
    at = decontaminate.leaks([b"Go (TO\nshore)"], decontaminate.Items(items))[0]
    assert at == [{"item_id": 3, "distance": 0, "start": 1, "end": 3}]


def test_blocks_of_items_find_the_same(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 3)
    r = random.Random(6)
    items = [(i, prose(20, r)) for i in range(10)]
    docs = spark.createDataFrame([(i, prose(30, r) + " " + t) for i, t in items], "doc_id long, text string")
    got = decontaminate.find(docs, spark.createDataFrame(items, "item_id long, text string")).selectExpr("doc_id", "leaks.item_id i").collect()
    assert all(list(x["i"]) == [x["doc_id"]] for x in got)


def test_infix_distance():
    def slow(p, t):
        row = [0] * (len(t) + 1)
        for i, a in enumerate(p, 1):
            new = [i]
            for j, b in enumerate(t, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
            row = new
        return min(row)

    r = random.Random(7)
    for _ in range(200):
        p, t = ("".join(r.choice("abc") for _ in range(r.randint(1, n))) for n in (12, 30))
        assert decontaminate.infix_distance(p, t)[0] == slow(p, t)


# -- fingerprints

def test_fingerprints(docs, rows, empty):
    order = sorted(((-(2**63) if i is None else i), t or "") for i, t in rows)
    pattern = re.compile(fingerprint.PARAGRAPH)
    want = []
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        q = len(t) // 4
        edited = t[: len(t) - q] + nxt[:q]
        a, b, c = (set(pattern.findall(x)) for x in (t, edited, nxt))
        like = lambda x, y: round(len(x & y) / len(x | y), 9) if x | y else 1.0
        want.append((None if i == -(2**63) else i, len(t), hashlib.sha256(edited.encode()).hexdigest(), like(a, b), like(a, c)))
    got = fingerprint.compare(docs).collect()
    ours = [(r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got]
    assert sorted(ours, key=str) == sorted(want, key=str)
    prints = collections.defaultdict(set)
    text_of = dict(rows)
    for r in got:
        if r["doc_id"] not in (None, 408):
            prints[text_of[r["doc_id"]] or ""].add(r["fingerprint"])
    assert all(len(p) == 1 for p in prints.values())
    assert fingerprint.compare(empty).count() == 0


# -- chat

def test_branches_and_round_trip(spark):
    nasty = ["", None, "a\nb", "</turn>", '<turn role="user">', "&lt; &amp;lt; \\ < >", "é\n"]
    nodes = [(1, 1, None, 1.0), (1, 2, 1, 5.0), (1, 3, 1, 2.0), (1, 4, 3, 9.0), (2, 1, 99, None), (2, 2, 1, 0.0), (3, 1, 2, 1.0), (3, 2, 1, 1.0)]
    nodes += [(4, i, i - 1 if i else None, 1.0) for i in range(20)] + [(5, 1, 2, 1.0), (5, 2, 3, 1.0), (5, 3, 4, 1.0), (5, 4, 2, 1.0)]
    df = spark.createDataFrame(nodes, "tree long, id long, parent long, score double")
    got = {(r["tree"], r["leaf"]): (r["score"], list(r["path"])) for r in chat.branches(df, None).collect()}
    assert got == {(1, 2): (6.0, [1, 2]), (1, 4): (12.0, [1, 3, 4]), (2, 2): (0.0, [1, 2]), (4, 19): (20.0, list(range(20))), (5, 1): (4.0, [4, 3, 2, 1])}
    assert {(r["tree"], r["leaf"]) for r in chat.branches(df).collect()} == {(1, 4), (2, 2), (4, 19), (5, 1)}
    texts = spark.createDataFrame([(t, i, ["user", "assistant", None, 'o"<'][i % 4], nasty[i % 7]) for t, i, *_ in nodes], "tree long, id long, role string, text string")
    for r in chat.parsed(chat.formatted(chat.branches(df), texts)).collect():
        path = got[r["tree"], r["leaf"]][1]
        want = [(["user", "assistant", "", 'o"<'][i % 4], nasty[i % 7] or "") for i in path]
        assert [tuple(t) for t in r["turns"]] == want
        assert r["loss_text"] == "".join(t for role, t in want if role == "assistant")
    assert chat.branches(df.limit(0)).count() == 0


# -- urls

def test_urls(spark):
    urls = [None, "", "nothing", "http://A.Example.ORG/es/1?x#y", "https://example.org", "https://example.org/en/12", "http://x.com/de/3#a", "http://x.com?q=/de/", "http://m.com/fr/9/", "http://notexample.net/en/1", "ftp://É.com/fr/"]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(3, urls[3])], "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, url_filter.RULES).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, got[0][3])
    assert got[3] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[4][:3] == ("example.org", "", None)
    assert got[5] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[6] == ("x.com", "/de/3", "com/de/", "block") and got[7][:3] == ("x.com", "", None)
    assert got[8] == ("m.com", "/fr/9/", "com/fr/", "allow") and got[9][2] is None and got[10][0] == "É.com"
    assert url_filter.judge(pages, url_filter.RULES).count() == len(urls) + 1
    many = spark.createDataFrame([(i, f"http://h.net/{'bad' if i % 2 else 'good'}/p{'abcdefghij'[i % 10]}x{'klmnopqrst'[i // 10 % 10]}") for i in range(400)], "page_id long, url string")
    rules = (("block", "h.net", "/bad/pa"), ("block", "h.net", "/bad/pb"), ("allow", "h.net", "/good/pc"), ("block", "h.net", "/bad/pd"), ("allow", "h.net", "/good/pe"))
    for r in url_filter.judge(many, rules).collect():
        assert r["verdict"] == ("block" if r["path"].startswith("/bad") else "allow") and r["template"] in ("bad/*", "good/*")


def judged(rows, rules):
    """Verdict and template of each (host, path), by a walk over plain dictionaries."""
    def rule(host, path):
        fits = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        return max(fits, key=lambda r: (len(r[1] + r[2]), r[1] + r[2]), default=None)

    def segments(path):
        return tuple("{h}" if re.fullmatch("[0-9a-fA-F-]{8,}", x) else re.sub("[0-9]+", "{n}", x) for x in path.split("/") if x)

    made = [[h, segments(p), list(segments(p)), rule(h, p)] for h, p in rows]
    for d in range(max(len(m[1]) for m in made)):
        values = collections.defaultdict(set)
        for h, _, t, _ in made:
            if len(t) > d:
                values[h, tuple(t[:d])].add(t[d])
        for m in made:
            if len(m[2]) > d and len(values[m[0], tuple(m[2][:d])]) > url_filter.BRANCHES:
                m[2] = m[2][:d] + ["*"] + m[2][d + 1 :]
    known, bad, children = collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for h, _, t, r in made:
        for d in range(len(t) + 1):
            node = (h, tuple(t[:d]))
            known[node] += r is not None
            bad[node] += r is not None and r[0] == "block"
            children[h, d, tuple(t[: max(d - 1, 0)])].add(node)
    pooled = {}
    for nodes in children.values():
        groups, last = [], None
        for rate, node in sorted(((bad[x] + 0.5) / (known[x] + 1), x) for x in nodes):
            if last:
                mid = (rate + last[0]) / 2
                if rate - last[0] > url_filter.Z * (mid * (1 - mid) * (1 / (known[node] + 1) + 1 / (known[last[1]] + 1))) ** 0.5:
                    groups.append([])
            else:
                groups.append([])
            groups[-1].append(node)
            last = (rate, node)
        for g in groups:
            for x in g:
                pooled[x] = (sum(known[y] for y in g), sum(bad[y] for y in g))
    labelled = [r for *_, r in made if r]
    out = []
    for h, _, t, r in made:
        p = (sum(x[0] == "block" for x in labelled) + 0.5) / (len(labelled) + 1)
        for d in range(len(t) + 1):
            k, b = pooled[h, tuple(t[:d])]
            p = (b + url_filter.SMOOTH * p) / (k + url_filter.SMOOTH)
        out.append((r[0] if r else "block" if p > url_filter.REJECT else "allow", "/".join(t), round(p, 9)))
    return out


def test_urls_against_plain_walk(spark):
    given = [(r["page_id"], r["url"]) for r in common.table(spark, "/root/testdata/sf0.01", "pages").collect()]
    r = random.Random(9)
    deep = [f"http://d{r.randint(0, 2)}.example.com/" + "/".join(r.choice(["a", "b", "xy", "fr", "de", f"v{r.randint(1, 9)}", "q" + chr(97 + r.randint(0, 25))]) for _ in range(r.randint(0, 11))) for _ in range(300)]
    every = given + [(10**6 + i, u) for i, u in enumerate(deep)]
    pages = spark.createDataFrame(every, "page_id long, url string").withColumn("host", F.lit("clash"))
    rules = (*url_filter.RULES, ("block", "d1.example.com", "/a/b/"), ("allow", "d2.example.com", "/a/"))
    got = {x["page_id"]: x for x in url_filter.judge(pages, rules).collect()}
    rows = [(got[i]["host"], got[i]["path"]) for i, _ in every]
    assert [(got[i]["verdict"], got[i]["template"], round(got[i]["purity"], 9)) for i, _ in every] == judged(rows, rules)
    assert url_filter.judge(pages.limit(0), rules).count() == 0


def test_urls_rounds_follow_crowded_forks(spark, monkeypatch):
    """Long paths, alone or shared by many, take no round for each segment."""
    shared = "/".join("abcdefgh"[i % 8] for i in range(400))
    names = [a + b for a in "abcdef" for b in "uvwxyz"]
    rows = [("h.net", f"/{shared}/{n}/{'yn'[i % 2]}") for i, n in enumerate(names)] + [("h.net", f"/{n}") for n in names] + [("h.net", "/" + "/".join("xyz"[i % 3] for i in range(1500)))]
    rules = (("block", "h.net", f"/{shared}/a"), ("allow", "h.net", "/b"))
    made = []
    monkeypatch.setattr(url_filter.common, "materialize", lambda df, once=common.materialize: made.append(1) or once(df))
    pages = spark.createDataFrame([(i, f"http://{h}{p}") for i, (h, p) in enumerate(rows)], "page_id long, url string")
    got = {r["page_id"]: (r["verdict"], r["template"], round(r["purity"], 9)) for r in url_filter.judge(pages, rules).collect()}
    assert [got[i] for i in range(len(rows))] == judged(rows, rules)
    assert len(made) <= 8


# -- html

def test_html_without_article_keeps_short_sections():
    long = "A sentence of some length, with a comma in it, that goes on for a while and then ends. " * 3
    many = "".join(f"<p>{i} {long}</p>" for i in range(9))
    menu = "<div><ul><li><a href=a>one</a></li><li><a href=b>two</a></li></ul></div><div class=comments><p>Nice.</p></div>"
    page = f"<body>{menu}<section><h2>First</h2>{many}</section><section><h2>Closing</h2><p>Short end.</p></section></body>"
    text = html_text.main_text(page)
    assert text.startswith("First\n\n0 A") and text.endswith("Closing\n\nShort end.") and text.count("\n\n") == 11
    page = f"<body><div><h1>Top</h1>{many}</div><div><ul class=x><li>flour</li><li>two eggs</li><li>salt</li></ul></div></body>"
    assert html_text.main_text(page).endswith("ends.\n\nflour\n\ntwo eggs\n\nsalt")


#: Pages whose boilerplate no name or element tells, and what is left of them.
UNNAMED = [
    ("<body><div><span>Home</span><div>About us</div></div><div>Log in</div><div><h1>Head</h1><p>Some text, of a few words, that says something. And more.</p></div></body>", "Head\n\nSome text, of a few words, that says something. And more."),
    ("<article><h2>Head</h2><p>Some text, of a few words, that says something.</p><div><a href=a>Another page about it</a> <a href=b>and another</a></div><p>Yes.</p></article>", "Head\n\nSome text, of a few words, that says something.\n\nYes."),
    ("<body><p>x</p><p>Top</p><section><p>Some text, of a few words, that says something.</p><ul><li>one</li></ul></section></body>", "Some text, of a few words, that says something.\n\none"),
]


def test_html_ratios_decide(monkeypatch):
    for page, text in UNNAMED[:2]:
        assert html_text.main_text(page) == text
    monkeypatch.setattr(html_text, "ratios", lambda every: {b["path"]: html_text.STRONG for b in every})
    assert all(html_text.main_text(page) != text for page, text in UNNAMED[:2])


def test_html_ratios_by_hand():
    every = html_text.blocks("<div><p>ab, cd.</p><p>abcdefghi</p></div><ul><li><a>x</a>y</li></ul>")
    p, li = (next(b["path"] for b in every if b["text"].startswith(t)) for t in ("ab", "x"))
    got = html_text.ratios(every)
    assert got[p] == pytest.approx(8.0**0.5 * 2) and got[li] == pytest.approx(2.0**0.5 * 0.25)


@pytest.mark.parametrize("part", ['<p a="', "<div>", "<b>", "<li><div>", "<p title='x>", "<", "<ul><li>x", "<div>Some text, of a few words, that says something. ", "<b><div></b>"])
def test_html_takes_linear_time(part):
    began = time.process_time()
    html_text.main_text(part * 30000 + "</i>" * 30000)
    assert time.process_time() - began < 5


def test_html(spark):
    page = """<html><head><title>T</title><style>p{}</style></head><body><header>Top</header><nav><ul><li><a href=a>one</a></ul></nav><div class="ad">Buy</div>
    <article><h1>Head &amp; line</h1><p>First <b>bold</b>, text.<script>var x="<p>no";</script> More.<p>Second   para<br>line<ul><li>x<li>y</ul><form>f</form>
    <div class="comments"><p>Nice, I liked it a lot.</p></div></article><aside>Side</aside><footer>&copy; foot</footer></body></html>"""
    assert html_text.main_text(page) == "Head & line\n\nFirst bold, text. More.\n\nSecond para line\n\nx\n\ny"
    plain = """<body><div class=cookie-notice>We use cookies, ok.</div><div id=menu><a href=x>A</a></div><div><p>Long enough text, with commas. And so on, and so on.</p><p>More text here, too.</p></div><div class=sidebar><p>Side text, as long as the others are.</p></div></body>"""
    assert html_text.main_text(plain) == "Long enough text, with commas. And so on, and so on.\n\nMore text here, too."
    df = spark.createDataFrame([(1, page, "u", 3), (2, None, "u", 3), (3, "", "u", 3), (4, "<p", "u", 3), (5, "<p>" * 3000 + "x", "u", 3)], "page_id long, html string, url string, text int")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.extract(df).collect()}
    assert got[2] == got[3] == ("", 0) and got[5][0] == "x" and got[1][1] == len(html_text.main_text(page))
    assert html_text.extract(df.limit(0)).count() == 0


def test_words_with_blanks_are_cut_without_a_loop_over_words():
    """Texts are cut with string methods, and the same texts as before go to the library whole."""
    import itertools
    import re

    tok = tokens.WordTokenizer(BYTE, "byte")
    assert not hasattr(tokens, "_EDGE")
    edge = re.compile(r"\A\s|\s\Z|\s | \s")
    for text in map("".join, itertools.product("a \t\n\v\f\r\u3000\u2003\0", repeat=4)):
        if tokens._ODD.search(text) or edge.search(text):
            assert tok._words(text) is None
        else:
            first, *more = text.split(" ")
            assert tok._words(text) == [first, *[" " + w for w in more]]
    assert all(tokens._ODD.search(chr(c)) for c in range(0x80, 0x110000) if chr(c).isspace() and not 0xD800 <= c < 0xE000)
    texts = ["one, two. don't", "x,y\nz!", "Zwölf \U0001f600? ok...", "a"]
    ids, counts = tok.ids(texts)
    assert ids.tolist() == [i for r in tok.whole(texts) for i in r] and counts.sum() == len(ids)
