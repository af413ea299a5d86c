"""N-gram Jaccard join by grouped prefixes.

A text's set holds its distinct five-word shingles as 64-bit hashes. Two sets
with 100 * shared >= 75 * union share one of the first ``n - ceil(0.75 n) + 1``
shingles of each in any common order. The order puts frequent shingles last, so
that what many texts share is seldom in a prefix.

Texts with equal sets are one class; classes with equal size and prefix are one
group. Group pairs that share a prefix shingle are candidates. Links are wanted
for components, so each group is first compared with one pivot, then with the
pivots of its other shingles where components still differ. Members of groups
whose shingle spans several components then meet one partner of another
component a round. What is still open after ROUNDS rounds is compared in full
(but for pairs that bitmaps of the sets rule out, which is exact), so no link between texts of different components is lost.

A candidate is verified by counting the shingles that two texts share. Shingles
are 64-bit hashes of their words: two unequal shingles of a pair with m and n
shingles are taken for equal with a chance of m * n / 2**64. Classes and groups
are known by 128-bit digests.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

WORDS = 5
#: The order of shingles knows at most so many frequent ones; it changes the work, not the result.
FREQUENT = 1 << 20
FREQUENT_AT = 6
#: Pairs of one text that one task verifies; rows of a shingle under one key; rounds of one partner each.
STAR = 256
SHARE = 256
ROUNDS = 3
#: Columns of a set's parity bits.
BITS = [f"b{i}" for i in range(8)]
_OTHER = np.uint64(0x5851F42D4C957F2D)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FACTORS = [np.uint64(int(x) | 1) for x in common.byte_table(77)[:WORDS]]


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer than five words are one shingle."""
    data, _, ends = common.joined(texts)
    space = _SPACE[data]
    space[ends] = True
    edge = np.diff(space.astype(np.int8), prepend=np.int8(1))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    word = common.mix64(common.PrefixHash(_LOWER[data], 3).spans(start, end) + (end - start).astype(np.uint64))
    doc = np.searchsorted(ends, start, side="right")
    cut = np.searchsorted(doc, np.arange(len(texts) + 1))
    m = max(len(word) - WORDS + 1, 0)
    five = np.zeros(m, dtype=np.uint64)
    for i, f in enumerate(_FACTORS):
        five += word[i : i + m] * f
    five = common.mix64(five)
    out = []
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if b - a >= WORDS:
            out.append(np.unique(five[a : b - WORDS + 1]))
        elif b > a:
            h = sum(int(w) * int(f) for w, f in zip(word[a:b], _FACTORS, strict=False)) + (b - a)
            out.append(common.mix64(np.array([h % 2**64], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    common.lean()
    for batch in batches:
        sets: list[np.ndarray] = []
        for _, part in common.chunks_of(batch.column("_text").cast(pa.binary()).to_pylist(), 1 << 20):
            sets += shingle_sets(part)
        yield batch, sets


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """Frequent shingle hashes, rarest first: at most FREQUENT, whatever the input.

    Counted over all texts. Each task counts its own and passes on what it met
    more than once, so a shingle's count is a lower bound.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate(held), return_counts=True)
            h, c = h[c > 1], c[c > 1]
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], ["h", "c"])

        for _, sets in _sets(batches):
            held += sets
            size += sum(map(len, sets))
            if size > 1 << 21:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    counts = docs.select("_text").mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).filter(F.col("c") >= FREQUENT_AT)
    top = counts.orderBy(F.desc("c"), "h").limit(FREQUENT).toArrow()
    return top.column("h").to_numpy().view(np.uint64)[::-1].copy()


def prefix_length(n: int) -> int:
    return n - (3 * n + 3) // 4 + 1 if n else 0


def digests(values: np.ndarray) -> list[int]:
    """Two 64-bit digests of a set of hashes, whatever its order."""
    other = common.mix64(values ^ _OTHER)
    both = np.array([values.sum(), common.mix64(other).sum()], dtype=np.uint64) + np.uint64(len(values))
    return common.mix64(both).view(np.int64).tolist()


def signatures(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """Per row: its key, set size, class (128-bit digest of the set), group (of the prefix) and prefix."""
    schema = "k long, n int, c long, c2 long, g long, g2 long, prefix array<long>, " + ", ".join(f"{b} long" for b in BITS)
    order = np.argsort(frequent)
    known = frequent[order]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _sets(batches):
            whole, some, prefixes, bits = [], [], [], []
            for s in sets:
                rank = s >> np.uint64(1)
                if len(known) and len(s):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    often = known[at] == s
                    rank[often] = np.uint64(1 << 63) + order[at[often]].astype(np.uint64)
                first = s[np.argsort(rank, kind="stable")[: prefix_length(len(s))]]
                whole.append(digests(s))
                some.append(digests(first))
                prefixes.append(first.view(np.int64))
                bits.append(np.packbits(np.bincount((s >> np.uint64(7)).astype(np.int64) & 64 * len(BITS) - 1, minlength=64 * len(BITS)).astype(np.uint8) & 1).view(np.int64))
            odd = [pa.array(x) for x in np.array(bits, dtype=np.int64).reshape(-1, len(BITS)).T]
            ids = [pa.array(x, pa.int64()) for x in np.array([[*a, *b] for a, b in zip(whole, some, strict=True)], dtype=np.int64).reshape(-1, 4).T]
            sizes = [len(s) for s in sets]
            cuts = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
            flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("_k"), pa.array(sizes, pa.int32()), *ids, pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat)), *odd], ["k", "n", "c", "c2", "g", "g2", "prefix", *BITS])

    return docs.select("_k", "_text").mapInArrow(sign, schema)


def linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of ``pairs(a, b)``, keys of ``texts(k, _text)``, those whose sets are near, from the texts' own shingles.

    The pairs of one ``a`` are one task's, STAR at most; an ``a`` with more goes to several.
    """
    many = common.materialize(pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).alias("parts")))
    pairs = pairs.join(many, "a").select("a", "b", F.pmod(F.hash("b"), F.col("parts")).alias("salt"))
    need = pairs.select(F.col("b").alias("k"), "a", "salt", F.lit(1).alias("role")).union(pairs.select("a", "a", "salt", F.lit(0)).distinct())
    # texts are shuffled at any size: pairs have no size bound to broadcast behind
    rows = need.hint("merge").join(texts, "k").select("a", "salt", "role", "k", "_text")
    rows = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "role")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, mine = None, np.zeros(0, np.uint64)
        for batch, sets in _sets(batches):
            a, b = [], []
            for p, k, role, s in zip(batch.column("a").to_pylist(), batch.column("k").to_pylist(), batch.column("role").to_pylist(), sets, strict=True):
                if role == 0:
                    pivot, mine = p, s
                    continue
                if pivot != p:
                    raise RuntimeError("a pair without its first text")
                if not len(s) or 4 * min(len(s), len(mine)) < 3 * max(len(s), len(mine)):
                    continue
                at = np.minimum(np.searchsorted(mine, s), len(mine) - 1)
                shared = int((mine[at] == s).sum())
                if 100 * shared >= 75 * (len(s) + len(mine) - shared):
                    a.append(p)
                    b.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.mapInArrow(verify, "a long, b long")


def reachable(m: str, i: str, n: str, j: str):
    """Whether sets of sizes m and n whose first common shingle, in the common order, is at i and j can be near.

    A near pair passes in the row of its first common shingle, so no near pair is lost.
    """
    most = 1 + F.least(F.col(m) - F.col(i), F.col(n) - F.col(j)) - 1
    return (4 * F.least(m, n) >= 3 * F.greatest(m, n)) & (7 * most >= 3 * (F.col(m) + F.col(n)))


def differ(x: str, y: str) -> Column:
    """How many bits differ: at most as many as shingles that only one set has, for each bit is the parity of some shingles."""
    return reduce(add, [F.bit_count(F.col(f"{x}.{b}").bitwiseXOR(F.col(f"{y}.{b}"))) for b in BITS])


class Links:
    """Links found so far: component labels, and the pairs that were verified, linked or not."""

    def __init__(self, texts: DataFrame) -> None:
        self.texts, self.labels, self.tried = texts, None, None

    def named(self, rows: DataFrame, key: str, name: str = "comp") -> DataFrame:
        """``rows`` with the component of ``key``: itself where nothing is linked."""
        if self.labels is None:
            return rows.withColumn(name, F.col(key))
        own = self.labels.select(F.col("v").alias("_v"), F.col("comp").alias("_comp"))
        return rows.join(own, rows[key] == own["_v"], "left").withColumn(name, F.coalesce("_comp", key)).drop("_v", "_comp")

    def verify(self, pairs: DataFrame) -> None:
        """Verify ``pairs(a, b)`` that aren't tried yet and bring the labels up to date."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if self.tried is not None:
            pairs = pairs.join(self.tried, ["a", "b"], "left_anti")
        pairs = common.materialize(pairs)
        if pairs.isEmpty():
            return
        edges = common.materialize(linked(pairs, self.texts))
        self.tried = pairs if self.tried is None else self.tried.union(pairs)
        if edges.isEmpty():
            return
        # only components are joined further, not their members
        joined = self.named(self.named(edges, "a", "x"), "b", "y").select(F.col("x").alias("a"), F.col("y").alias("b"))
        roots = components(joined)
        if self.labels is None:
            self.labels = roots
            return
        old = self.labels.join(roots.select(F.col("v").alias("comp"), F.col("comp").alias("root")), "comp", "left").select("v", F.coalesce("root", "comp").alias("comp"))
        self.labels = common.materialize(old.union(roots.join(self.labels, "v", "left_anti").select("v", "comp")))


def _mixed(links: Links, rows: DataFrame) -> DataFrame:
    """Of ``rows(h, k, n, i)`` those whose shingle still spans several components, with ``comp``."""
    named = common.materialize(links.named(rows, "k"))
    mixed = common.materialize(named.groupBy("h").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("h"))
    return common.materialize(named.join(mixed, "h", "left_semi"))


def _partners(open_rows: DataFrame, nth: int) -> DataFrame:
    """One pair for each key: with one row of another component under one of its shingles, another one for each ``nth``."""
    rows = open_rows.withColumn("o", F.xxhash64("k", F.lit(nth)))
    row = F.struct("o", "k", "n", "i", "comp")
    first = common.materialize(rows.groupBy("h").agg(F.min(row).alias("f")))
    with_first = rows.join(first, "h")
    second = common.materialize(with_first.filter(F.col("comp") != F.col("f.comp")).groupBy("h").agg(F.min(row).alias("s")))
    p = F.when(F.col("comp") != F.col("f.comp"), F.col("f")).otherwise(F.col("s"))
    pairs = with_first.join(second, "h").select("k", "n", "i", p.alias("p")).select("k", "n", "i", "p.o", F.col("p.k").alias("p"), F.col("p.n").alias("pn"), F.col("p.i").alias("pi"))
    best = pairs.filter(reachable("n", "i", "pn", "pi")).groupBy("k").agg(F.min(F.struct("o", "p")).alias("b"))
    return best.select(F.col("k").alias("a"), F.col("b.p").alias("b"))


def _rest(open_rows: DataFrame) -> DataFrame:
    """All pairs of rows of one shingle and different components that can be near.

    All but a shingle's largest component meet the shingle's rows; these are dealt
    over several keys if they are many.
    """
    sizes = common.materialize(open_rows.groupBy("h", "comp").count())
    major = common.materialize(sizes.groupBy("h").agg(F.max(F.struct("count", "comp")).alias("m"), F.ceil(F.sum("count") / SHARE).cast("int").alias("parts")).select("h", F.col("m.comp").alias("major"), "parts"))
    rows = open_rows.join(major, "h")
    y = rows.withColumn("salt", F.pmod(F.hash("k"), F.col("parts"))).alias("y")
    x = rows.filter("comp <> major").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("x")
    once = (F.col("y.comp") == F.col("y.major")) | (F.col("x.k") < F.col("y.k"))
    near = (F.col("x.h") == F.col("y.h")) & (F.col("x.salt") == F.col("y.salt")) & (F.col("x.comp") != F.col("y.comp")) & once & reachable("x.n", "x.i", "y.n", "y.i")
    near &= 7 * differ("x", "y") <= F.col("x.n") + F.col("y.n")
    return x.join(y, near).select(F.col("x.k").alias("a"), F.col("y.k").alias("b"))


def components_of(keyed: DataFrame) -> DataFrame:
    """Per row of ``keyed(_k, doc_id, _text)``: doc_id, _k, n (set size) and comp, null for empty sets."""
    common.bounded_batches(keyed.sparkSession)
    wide = common.materialize(signatures(keyed, frequent_shingles(keyed)))
    signed = common.materialize(wide.drop("prefix"))
    # classes of equal sets, each known by the smallest key of its rows; groups of equal size and prefix likewise
    classes = common.materialize(signed.filter("n > 0").groupBy("n", "c", "c2", "g", "g2").agg(F.min("k").alias("k")))
    groups = common.materialize(classes.groupBy("n", "g", "g2").agg(F.min("k").alias("gk"), F.count("*").alias("members")))
    posted = wide.join(groups.select(F.col("gk").alias("k"), "members"), "k").select(F.col("k").alias("gk"), "n", "members", F.posexplode("prefix").alias("i", "h"))
    # shingles of one group of one class are left out first; a written table lets the join split a hot shingle
    often = common.materialize(posted.groupBy("h").agg(F.sum("members").alias("many")).filter("many > 1").select("h"))
    lists = common.materialize(posted.select("h", "gk", "n", "i").join(often, "h", "left_semi"))
    del posted
    common.discard(wide)
    common.release(keyed.sparkSession, now=True)
    pivots = common.materialize(lists.groupBy("h").agg(F.min(F.struct("gk", "n", "i")).alias("p")))
    heads = groups.filter("members > 1").select("n", "g", "g2", F.col("gk").alias("a"))
    inside = classes.join(heads, ["n", "g", "g2"]).filter("k <> a").select("a", F.col("k").alias("b"))
    star = lists.join(pivots.select("h", F.col("p.gk").alias("a"), F.col("p.n").alias("pn"), F.col("p.i").alias("pi")), "h")
    star = common.materialize(star.filter((F.col("gk") != F.col("a")) & reachable("n", "i", "pn", "pi")).select("a", F.col("gk").alias("b")).distinct())
    links = Links(keyed.select(F.col("_k").alias("k"), "_text"))
    # each group with one pivot, each class with the head of its group; then the other pivots where components still differ
    links.verify(star.groupBy("b").agg(F.min("a").alias("a")).select("a", "b").union(inside))
    links.verify(links.named(links.named(star, "a", "x"), "b", "y").filter("x <> y").select("a", "b"))
    used = lists.select("gk").union(heads.select("a")).distinct()
    members = common.materialize(classes.join(groups.select("n", "g", "g2", "gk"), ["n", "g", "g2"]).join(used, "gk", "left_semi").select("k", "gk", "n"))
    rows = lists.select("h", "gk", "i").union(heads.select(F.col("a").alias("h"), F.col("a").alias("gk"), F.lit(0)))
    open_rows = _mixed(links, rows.join(members, "gk").select("h", "k", "n", "i"))
    for nth in range(ROUNDS):
        if open_rows.isEmpty():
            break
        links.verify(_partners(open_rows, nth))
        open_rows = _mixed(links, open_rows.drop("comp"))
    if not open_rows.isEmpty():
        links.verify(_rest(open_rows.join(signed.select("k", *BITS), "k")))
    # back to the rows: key -> class -> component
    of_class = common.materialize(links.named(classes, "k").select("n", "c", "c2", "comp"))
    of_row = signed.join(of_class, ["n", "c", "c2"], "left").select("k", "n", "comp")
    return common.materialize(keyed.select("doc_id", "_k").join(of_row, F.col("_k") == F.col("k")).select("doc_id", "_k", "n", "comp"))


def join(docs: DataFrame) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, n_shingles, component_id.

    Null and empty texts have no shingles and are components of their own, named
    by their doc_id. Rows with one doc_id are rows of their own. A null doc_id
    names a component only if it has no other. Extra columns are left out; an
    empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty(docs).alias("_text"))
    whole = components_of(common.keyed(rows, "doc_id"))
    least = common.materialize(whole.filter("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("least")))
    return whole.join(least, "comp", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row with the smallest doc_id stays.

    Of rows with one doc_id one stays; a null doc_id stays only where the
    component has no other. Rows without words all stay. Columns are as they
    were, whatever their names.
    """
    rows, name = common.plainly_named(docs)
    rows = common.keyed(rows, name["doc_id"])
    text = F.coalesce(F.col(name["text"]), F.lit(""))
    whole = components_of(rows.select("_k", F.col(name["doc_id"]).cast("long").alias("doc_id"), text.alias("_text")))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_k")
    best = whole.filter("comp is not null").groupBy("comp").agg(F.min(order).alias("b")).select("b._k")
    stay = common.materialize(best.union(whole.filter("comp is null").select("_k")))
    return rows.join(stay.hint("merge"), "_k", "left_semi").drop("_k").toDF(*docs.columns)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(common.table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS sh FROM w, unnest(range(1, greatest(len(w) - 3, 2))) t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(v, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.c FROM r JOIN e ON r.v = e.x)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.c) AS component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN r ON r.v = d.doc_id GROUP BY d.doc_id
"""
