"""The pipeline's stages on the smallest tables."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages(spark):
    from codescope.llm import common, decontaminate, jaccard_join

    docs = common.table(spark, SF, "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.materialize(stage(spark, docs, SF))
        assert out.columns == columns, name
        if name == "near_duplicates":
            joined = jaccard_join.join(docs)
            assert out.count() == joined.select("component_id").distinct().count()
        if name == "repeated_passages":
            assert out.count() == docs.count()
        docs = out
    assert 0 < docs.count() < before
    leaks = decontaminate.find(docs, common.table(spark, SF, "benchmark"))
    assert leaks.filter("size(leaks) > 0").isEmpty()
    name, last = corpus_pipeline.STAGES[-1]
    packed = last(spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.count()
    assert packed.groupBy("sequence_id").agg({"length": "sum"}).toDF("s", "n").filter("n > 1024").isEmpty()


def test_stages_against_brute_force(spark, tmp_path):
    """Stages 2 to 4 on planted near copies, passages and edited items, beside all pairs, all strings and all windows."""
    import collections
    import random

    from codescope.llm import decontaminate

    from test_llm import edited, invented, joined

    r = random.Random(21)
    rows = [(i, invented(r.randint(0, 150), r)) for i in range(40)]
    rows += [(100 + i, t + " more " * (i % 3)) for i, (_, t) in enumerate(rows[:12])]
    passage = invented(55, r)
    rows += [(200 + i, f"{invented(60, r)} {passage} {invented(60, r)}") for i in range(3)]
    items = [(i, invented(25, r)) for i in range(8)]
    rows += [(300 + i, f"{invented(70, r)} {edited(t, 0.02 * i, r)} {invented(70, r)}") for i, t in items]
    rows += [(400, None), (401, ""), (None, "no id"), (402, "tie"), (402, "tie"), (403, "x " * 30000)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)

    near = stages["near_duplicates"](spark, docs, str(tmp_path)).collect()
    want = collections.Counter(i for i, n, c in set(joined(rows)) if i == c or not n)
    assert collections.Counter(x["doc_id"] for x in near) == want

    out = {x["doc_id"]: x for x in stages["repeated_passages"](spark, docs, str(tmp_path)).collect() if x["doc_id"] not in (None, 402)}
    seen = collections.Counter()
    raw = {i: (t or "").encode() for i, t in rows if i not in (None, 402)}
    for b in raw.values():
        seen.update(b[j : j + 200] for j in range(len(b) - 199))
    for i, b in raw.items():
        gone = bytearray(len(b))
        for j in range(len(b) - 199):
            if seen[b[j : j + 200]] > 1:
                gone[j : j + 200] = b"\1" * 200
        kept, j = b"", 0
        while j < len(b):
            k = j
            while k < len(b) and gone[k] == gone[j]:
                k += 1
            if not gone[j] or len(b[j:k].split()) < 50:
                kept += b[j:k]
            j = k
        assert (out[i]["text"] or "") == kept.decode() and out[i]["n_chars"] == len(kept.decode()) or raw[i] == b""

    stay = {x["doc_id"] for x in stages["benchmark_leaks"](spark, docs, str(tmp_path)).collect()}
    for i, t in rows:
        holds = any(decontaminate.infix_distance(x, " ".join((t or "").split()))[0] <= int(0.25 * len(x)) for _, x in items)
        assert (i in stay) != holds


def test_stages_on_empty_tables(spark):
    from codescope.llm import common

    docs = common.table(spark, SF, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0, name
