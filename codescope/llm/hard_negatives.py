"""Hard negatives by partial inner products after an orthogonal PCA rotation.

An orthogonal rotation keeps inner products, and the one whose axes are the
principal components (of a bounded sample) puts most of a vector's length into
the leading ones. For each anchor and row the products of the leading components
are summed first; by Cauchy and Schwarz the remainder is at most the product of
both residual norms, to which a slack for rounding is added. Pairs that can't
come into the anchor's list any more are left, the others go on to more
components, and what outlives all of them is scored with integers.

Rows are dealt over slabs and anchors over groups; one part of the work is one
slab beside one group, with the anchors in memory and the rows streaming by.
Each part returns its own best, so what the last step sorts is a short list for
each anchor and slab. The first pass finds positives, the second one negatives
within the bounds that the positives' scores set.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: A negative's score is from LOW to HIGH hundredths of the positive's.
LOW, HIGH = 50, 95
ANCHORS = 50
SAMPLE = 4096
#: Anchors of one group, rows of one slab at least and at most, rows of one matrix product.
GROUP, SMALL_SLAB, SLAB, ROWS = 4096, 1024, 65536, 512
#: Pairs that are scored at once.
PAIRS = 1 << 16
#: Residual norms are enlarged by this share of the norms, so bounds hold in spite of rounding.
SLACK = 1e-5
#: The sums of components go on where this share of the squared length is left.
LEFT = (1 / 4, 1 / 16, 1 / 64)


class Rotation:
    """Principal axes of ``sample`` by falling variance about the origin, and where the sums pause."""

    def __init__(self, sample: np.ndarray) -> None:
        wide = sample.astype(np.float64)
        values, axes = np.linalg.eigh(wide.T @ wide)
        self.axes = axes[:, ::-1].copy()
        left = 1 - np.cumsum(values[::-1]) / max(values.sum(), 1e-300)
        d = len(values)
        self.cuts = sorted({int(np.argmax(left <= share)) + 1 for share in LEFT if (left <= share).any()} & set(range(1, d)))

    def turned(self, rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Rotated rows and, for each cut, the enlarged norm of what comes after it."""
        out = rows.astype(np.float64) @ self.axes
        squares = np.cumsum((out * out)[:, ::-1], axis=1)[:, ::-1]
        slack = SLACK * np.sqrt(squares[:, 0])
        return out, [np.sqrt(squares[:, c]) + slack for c in self.cuts]

    def survivors(self, a, a_left, x, x_left, least, most=None, allowed=None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (anchor, row) whose product may be in ``least..most`` of the anchor."""
        at = self.cuts[0] if self.cuts else a.shape[1]
        part = a[:, :at] @ x[:, :at].T
        bound = np.multiply.outer(a_left[0], x_left[0]) if self.cuts else SLACK * SLACK * np.multiply.outer(np.sqrt((a * a).sum(1)), np.sqrt((x * x).sum(1)))
        alive = part + bound >= least[:, None]
        if most is not None:
            alive &= part - bound <= most[:, None]
        if allowed is not None:
            alive &= allowed
        i, j = np.nonzero(alive)
        p = part[i, j]
        for c, end in enumerate([*self.cuts[1:], None][: len(self.cuts) - 1], 1):
            begin = self.cuts[c - 1]
            keep = []
            for b in range(0, len(i), PAIRS):
                s = slice(b, b + PAIRS)
                p[s] += np.einsum("ij,ij->i", a[i[s], begin:end], x[j[s], begin:end])
                room = a_left[c][i[s]] * x_left[c][j[s]]
                ok = p[s] + room >= least[i[s]]
                if most is not None:
                    ok &= p[s] - room <= most[i[s]]
                keep.append(ok)
            keep = np.concatenate(keep) if keep else np.zeros(0, dtype=bool)
            i, j, p = i[keep], j[keep], p[keep]
        return i, j


def exact(a: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Integer inner products of the pairs i, j."""
    parts = [np.einsum("ij,ij->i", a[i[b : b + PAIRS]].astype(np.int64), x[j[b : b + PAIRS]].astype(np.int64)) for b in range(0, len(i), PAIRS)]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)


class Best:
    """The first ``most`` of each list by falling score, then rising id; ``least`` is what a newcomer needs."""

    def __init__(self, lists: int, most: int, least: np.ndarray) -> None:
        self.most, self.least = most, least
        self.of, self.score, self.id = (np.zeros(0, dtype=np.int64) for _ in range(3))

    def add(self, of: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(of):
            return
        of, score, ids = np.concatenate([self.of, of]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score, of))
        of, score, ids = of[order], score[order], ids[order]
        begins = np.flatnonzero(np.diff(of, prepend=-1))
        rank = np.arange(len(of)) - np.repeat(begins, np.diff(np.append(begins, len(of))))
        keep = rank < self.most
        full = rank == self.most - 1
        self.least[of[full]] = np.maximum(self.least[of[full]], score[full])
        self.of, self.score, self.id = of[keep], score[keep], ids[keep]


class Part:
    """Anchors of one group; rows of one slab come by."""

    def __init__(self, turn: Rotation, dim: int, positives: bool) -> None:
        self.turn, self.dim, self.positives, self.pieces, self.best = turn, dim, positives, [], None

    def add(self, k, ids, label, vec, scores) -> None:
        self.pieces.append((k, ids, label, vec, scores))

    def ready(self) -> None:
        self.k, self.ids, self.label, self.vec = (np.concatenate([p[i] for p in self.pieces]) for i in range(4))
        given, n = [s for p in self.pieces for s in p[4]], len(self.k)
        self.pieces = []
        self.turned, self.left = self.turn.turned(self.vec)
        if self.positives:
            self.best = Best(n, POSITIVES, np.full(n, -np.inf))
            return
        # bounds of the negatives' scores for each place in the anchor's list of positives; empty where they cross
        self.low, self.high = np.full((n, POSITIVES), 1, dtype=np.int64), np.zeros((n, POSITIVES), dtype=np.int64)
        for r, scores in enumerate(given):
            for slot, p in enumerate(scores):
                self.low[r, slot], self.high[r, slot] = -(-LOW * p // 100), HIGH * p // 100
        none = self.low > self.high
        self.best = Best(n * POSITIVES, NEGATIVES, np.where(none, np.inf, self.low).ravel())
        self.top = np.where(none, -np.inf, self.high).max(axis=1)

    def meet(self, k, ids, label, vec) -> None:
        x, left = self.turn.turned(vec)
        if self.positives:
            for one in np.unique(label):
                a, b = np.flatnonzero(self.label == one), np.flatnonzero(label == one)
                if not len(a):
                    continue
                i, j = self.turn.survivors(self.turned[a], [c[a] for c in self.left], x[b], [c[b] for c in left], self.best.least[a])
                i, j = a[i], b[j]
                other = self.k[i] != k[j]
                i, j = i[other], j[other]
                score = exact(self.vec, vec, i, j)
                good = score >= self.best.least[i]
                self.best.add(i[good], score[good], ids[j[good]])
            return
        least = self.best.least.reshape(-1, POSITIVES)
        i, j = self.turn.survivors(self.turned, self.left, x, left, least.min(axis=1), self.top, self.label[:, None] != label[None, :])
        score = exact(self.vec, vec, i, j)
        of, scores, names = [], [], []
        for slot in range(POSITIVES):
            good = (score >= least[i, slot]) & (score <= self.high[i, slot]) & (score >= self.low[i, slot])
            of.append(i[good] * POSITIVES + slot)
            scores.append(score[good])
            names.append(ids[j[good]])
        self.best.add(np.concatenate(of), np.concatenate(scores), np.concatenate(names))

    def found(self) -> pa.RecordBatch:
        slots = 1 if self.positives else POSITIVES
        anchor = self.best.of // slots
        return pa.RecordBatch.from_arrays([pa.array(self.k[anchor]), pa.array(self.ids[anchor]), pa.array((self.best.of % slots).astype(np.int32)), pa.array(self.best.id), pa.array(self.best.score)], ["k", "anchor_id", "slot", "other", "score"])


FOUND = "k long, anchor_id long, slot int, other long, score long"


def _scan(rows: DataFrame, anchors: DataFrame, slabs: int, groups: int, turn: Rotation, dim: int, positives: bool) -> DataFrame:
    """The best of each part: every anchor beside every row."""
    slab, group = F.pmod(F.xxhash64("k"), F.lit(slabs)).cast("int"), F.pmod(F.xxhash64("k", F.lit(1)), F.lit(groups)).cast("int")
    own = F.lit(None).cast("array<long>") if positives else F.col("scores")
    held = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(slabs - 1))).alias("slab"), group.alias("group"), F.lit(0).alias("role"), "k", "id", "label", "vec", own.alias("scores"))
    passing = rows.select(slab.alias("slab"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(1).alias("role"), "k", "id", "label", "vec", F.lit(None).cast("array<long>").alias("scores"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.lean()
        key, part = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            slab, group, role, k, ids, label = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("slab", "group", "role", "k", "id", "label"))
            edges = np.flatnonzero((np.diff(slab) != 0) | (np.diff(group) != 0) | (np.diff(role) != 0)) + 1
            for a, b in zip(np.append(0, edges), np.append(edges, len(k)), strict=True):
                if key != (slab[a], group[a]):
                    if part is not None and part.best is not None:
                        yield part.found()
                    key, part = (slab[a], group[a]), Part(turn, dim, positives)
                if role[a] == 1 and part.best is None:
                    if not part.pieces:
                        continue  # a group that the hash left empty
                    part.ready()
                for at in range(a, b, ROWS):
                    s = slice(at, min(at + ROWS, b))
                    vec = np.frombuffer(b"".join(batch.column("vec").slice(at, s.stop - at).to_pylist()), dtype="<i4").reshape(-1, dim)
                    if role[a] == 0:
                        part.add(k[s], ids[s], label[s], vec, [x or [] for x in batch.column("scores").slice(at, s.stop - at).to_pylist()])
                    else:
                        part.meet(k[s], ids[s], label[s], vec)
        if part is not None and part.best is not None:
            yield part.found()

    dealt = held.union(passing).repartition(min(slabs * groups, 20_000), "slab", "group").sortWithinPartitions("slab", "group", "role")
    return dealt.mapInArrow(run, FOUND)


def mine(vectors: DataFrame, every: int = ANCHORS) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` from ``vectors(vec_id, label, embedding)``.

    Anchors are the rows whose vec_id ``every`` divides. Components become
    floor(256 * x) and scores are integer inner products. An anchor's positives
    are the first five other rows of its label, its negatives for each of them
    the first three rows of other labels that score from 50 to 95 hundredths of
    the positive; first means larger scores, then smaller vec_id. Without
    positives or negatives there are no rows.

    Rows with a null vec_id, label, vector or component, or a component that isn't
    finite, take no part; nor do vectors of another length than most, and those
    with components so large that twenty times a score might not fit a long.
    Repeated rows are rows of their own. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    spans = F.transform("e", lambda x: F.floor(x * SCALE))
    plain = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("e"))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    plain = plain.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("e").isNotNull() & (F.size("e") > 0) & F.coalesce(finite, F.lit(False)))
    usual = plain.groupBy(F.size("e").alias("d")).count().orderBy(F.desc("count"), "d").first()
    none = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if usual is None:
        return spark.createDataFrame([], none)
    dim = usual["d"]
    largest = math.isqrt(2**62 // (20 * dim))
    plain = plain.filter((F.size("e") == dim) & F.forall("e", lambda x: F.abs(x * SCALE) < float(min(largest, 2**31 - 2))))
    numbered = common.keyed(plain.select("id", "label", spans.alias("e")), "id").withColumnRenamed("_k", "k")
    common.bounded_batches(spark, 2000)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.lean()
        for batch in batches:
            vec = batch.column("e").flatten().to_numpy(zero_copy_only=False).astype("<i4").reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("id"), batch.column("label"), pa.array([r.tobytes() for r in vec], pa.binary())], ["k", "id", "label", "vec"])

    rows = common.materialize(numbered.select("k", "id", "label", "e").mapInArrow(packed, "k long, id long, label long, vec binary"))
    drawn = rows.select(F.xxhash64("k").alias("o"), "k", "vec").orderBy("o", "k").limit(SAMPLE).collect()
    if not drawn:
        return spark.createDataFrame([], none)
    turn = Rotation(np.frombuffer(b"".join(r["vec"] for r in drawn), dtype="<i4").reshape(-1, dim))
    anchors = rows.filter(F.col("id") % every == 0)
    sizes = rows.agg(F.count("*").alias("n"), F.count_if(F.col("id") % every == 0).alias("a")).first()
    groups = max(1, -(-sizes["a"] // GROUP))
    slabs = max(-(-sizes["n"] // SLAB), min(2 * common.shuffle_parts(spark), -(-sizes["n"] // SMALL_SLAB)))
    first = Window.partitionBy("k").orderBy(F.desc("score"), "other")
    positives = _scan(rows, anchors, slabs, groups, turn, dim, True).withColumn("slot", (F.row_number().over(first) - 1).cast("int")).filter(F.col("slot") < POSITIVES)
    positives = common.materialize(positives.select("k", "slot", F.col("other").alias("positive_id"), F.col("score").alias("positive_score")))
    # at most five for each anchor
    known = positives.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("slot", "positive_score"))).alias("p")).select("k", F.col("p.positive_score").alias("scores"))
    judged = _scan(rows, anchors.join(known, "k"), slabs, groups, turn, dim, False)
    ranked = judged.withColumn("rank", F.row_number().over(Window.partitionBy("k", "slot").orderBy(F.desc("score"), "other"))).filter(F.col("rank") <= NEGATIVES)
    return ranked.join(positives, ["k", "slot"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


ORACLE = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE same) WHERE r <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
    FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the embeddings, after every seventh label was moved to the next one."""
    vectors = common.table(spark, sf_dir, "embeddings")
    return mine(vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))
