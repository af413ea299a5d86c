"""Near duplicates among embeddings: an exact metric range join by angles.

A cosine of ``least`` or more is an angle of ``reach`` or less, and angles obey
the triangle inequality. Pivots are drawn from a bounded sample, those in dense
places first and no two close together; every vector goes to the cell of its
nearest pivot. Vectors within half the reach of their pivot are the cell's core:
any two of them are linked, so they are counted and never compared. The others
are its rest. A vector visits another cell only where

* its angle to that cell's pivot is within the reach of an angle that the cell's
  members have, and
* the plane between both pivots is within the reach.

Cells are cut into slices of about ``SLICE`` rows, and visitors of a slice are
dealt over as many parts as they need. Each part is joined on its own: it holds
one slice and streams its visitors past it, in double precision. What it returns
is a number of links for each vector and a spanning forest, not pairs.

The sample decides only which pivots there are, so it changes the work and not
the result. Vectors spread evenly in many dimensions have pivots at similar
angles and visit most cells; then the join compares nearly all slices, once each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from . import common
from .components import components

LEAST = 0.9
SAMPLE, PIVOTS = 4096, 512
SLICE, VISITORS = 4096, 32768
#: Rows of one matrix product.
ROWS = 512
#: Radians by which bounds give way to rounding; cosines this close to the limit are computed again.
SLACK, CLOSE = 1e-6, 1e-9


def usable(vec: Column) -> Column:
    """Whether a vector has a direction: no null, no component that is null or not finite, not all zero."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def units(rows: np.ndarray) -> np.ndarray:
    wide = rows.astype(np.float64)
    wide /= np.abs(wide).max(axis=1, keepdims=True)
    return wide / np.sqrt((wide * wide).sum(axis=1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    a, b = (x / np.abs(x).max(axis=1, keepdims=True) if np.abs(x).max(initial=0) > 1e70 or np.abs(x).max(axis=1).min(initial=1) < 1e-70 else x for x in (a.astype(np.float64), b.astype(np.float64)))
    return (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))


def angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


def choose_pivots(sample: np.ndarray, most: int, near: float) -> np.ndarray:
    """At most ``most`` rows of ``sample`` (unit vectors), no two within the angle ``near``, those with most neighbours first."""
    close = sample @ sample.T >= np.cos(near)
    order = np.argsort(-close.sum(axis=1), kind="stable")
    taken, covered = [], np.zeros(len(sample), dtype=bool)
    for i in order:
        if not covered[i]:
            taken.append(i)
            covered |= close[i]
            if len(taken) == most:
                break
    return sample[taken]


def forest(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """The smallest number that each of 0..n-1 reaches over the pairs x, y."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


class Cells:
    """The pivots and what is known of each cell: cell 2p is the core of pivot p, 2p + 1 its rest."""

    def __init__(self, pivots: np.ndarray, least: float) -> None:
        self.pivots, self.reach = pivots, float(np.arccos(least))
        n = 2 * len(pivots)
        self.rows, self.low, self.high = np.zeros(n, dtype=np.int64), np.full(n, 9.0), np.full(n, -9.0)
        gap = np.sqrt(np.maximum(0.0, 2 - 2 * pivots @ pivots.T))
        np.fill_diagonal(gap, 1.0)
        # how far a product with the own pivot may exceed that with another
        self.lead = gap * np.sin(min(self.reach, np.pi / 2)) + SLACK if self.reach < np.pi / 2 else np.full_like(gap, 9.0)
        self.slices = self.parts = self.first = np.ones(n, dtype=np.int64)

    def home(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cos = unit @ self.pivots.T
        nearest = cos.argmax(axis=1)
        angle = angles(cos[np.arange(len(cos)), nearest])
        return 2 * nearest + (angle > self.reach / 2 - SLACK), angle

    def cut(self) -> None:
        self.slices = -(-self.rows // SLICE)
        self.first = np.cumsum(self.slices) - self.slices

    def visits(self, unit: np.ndarray, home: np.ndarray) -> np.ndarray:
        """For each row and each other cell: whether it goes there. Of two cells one visits the other."""
        cos = unit @ self.pivots.T
        own, b = home // 2, np.arange(len(unit))
        angle = np.repeat(angles(cos), 2, axis=1)
        may = (angle >= self.low - self.reach - SLACK) & (angle <= self.high + self.reach + SLACK)
        may &= np.repeat(cos[b, own][:, None] - cos <= self.lead[own], 2, axis=1)
        cells = np.arange(len(self.rows))
        # the rest visits cores, else every second cell, counted from the own one
        core, to_core = home[:, None] % 2 == 0, cells % 2 == 0
        odd = (home[:, None] // 2 + cells // 2) % 2 == 1
        turn = np.where(core == to_core, (home[:, None] < cells) == odd, ~core)
        return may & turn & (cells != home[:, None])


def _matrix(column: pa.Array, dim: int, kind: str) -> np.ndarray:
    """Vectors stored as bytes."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(whole.to_pylist()), dtype=kind).reshape(-1, dim)


def _long(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _spread(k: np.ndarray, parts: np.ndarray) -> np.ndarray:
    return (common.mix64(k.astype(np.uint64)) % parts.astype(np.uint64)).astype(np.int64)


class Slice:
    """One slice of a cell, and the links found so far."""

    def __init__(self, least: float) -> None:
        self.least, self.pieces, self.own, self.vec = least, [], False, None

    def add(self, k, v, n, own: bool, vec: np.ndarray) -> None:
        self.pieces.append((k, v, n, vec))
        self.own |= own

    def ready(self) -> None:
        self.k, self.v, self.n = (np.concatenate([p[i] for p in self.pieces]) for i in range(3))
        self.vec = np.concatenate([p[3] for p in self.pieces])
        self.unit, self.links = units(self.vec), np.zeros(len(self.k), dtype=np.int64)
        self.pieces = []

    def meet(self, k, v, n, vec, above: int = -1):
        """Links between the slice and other rows; with ``above``, the others are its own rows from there on, and each pair counts once."""
        cos = (self.unit if above < 0 else self.unit[: above + len(k)]) @ units(vec).T
        i, j = np.nonzero(cos >= self.least - CLOSE)
        if above >= 0:
            once = i < j + above
            i, j = i[once], j[once]
        doubt = np.flatnonzero(cos[i, j] < self.least + CLOSE)
        if len(doubt):
            keep = np.ones(len(i), dtype=bool)
            keep[doubt] = cosine(self.vec[i[doubt]], vec[j[doubt]]) >= self.least
            i, j = i[keep], j[keep]
        if not len(i):
            return
        self.links += np.bincount(i, n[j], len(self.k)).astype(np.int64)
        theirs = np.bincount(j, self.n[i], len(k)).astype(np.int64)
        some = theirs > 0
        yield k[some], None, theirs[some]
        names, place = np.unique(np.concatenate([self.v, v]), return_inverse=True)
        label = forest(place[: len(self.v)][i], place[len(self.v) :][j], len(names))
        moved = np.flatnonzero(label != np.arange(len(names)))
        yield names[moved], names[label[moved]], None

    def inside(self):
        if self.own:
            for at in range(0, len(self.k), ROWS):
                part = slice(at, at + ROWS)
                yield from self.meet(self.k[part], self.v[part], self.n[part], self.vec[part], at)

    def ended(self):
        some = self.links > 0
        if some.any():
            yield self.k[some], None, self.links[some]


FOUND = "k long, other long, links long"


def _found(k: np.ndarray, other: np.ndarray | None, links: np.ndarray | None) -> pa.RecordBatch:
    none = pa.nulls(len(k), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), none if other is None else pa.array(other, pa.int64()), none if links is None else pa.array(links, pa.int64())], ["k", "other", "links"])


def _joined(dim: int, kind: str, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.lean()
        key, held = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            block, part, role, k, v, n = (_long(batch, c) for c in ("block", "part", "role", "k", "v", "n"))
            own = batch.column("own").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((np.diff(block) != 0) | (np.diff(part) != 0) | (np.diff(role) != 0)) + 1
            for a, b in zip(np.append(0, edges), np.append(edges, len(block)), strict=True):
                vec = _matrix(batch.column("vec").slice(a, b - a), dim, kind)
                if key != (block[a], part[a]):
                    if held is not None and held.vec is None:
                        held.ready()
                        yield from (_found(*x) for x in held.inside())
                    if held is not None:
                        yield from (_found(*x) for x in held.ended())
                    key, held = (block[a], part[a]), Slice(least)
                if role[a] == 0:
                    held.add(k[a:b], v[a:b], n[a:b], bool(own[a]), vec)
                    continue
                if held.vec is None:
                    if not held.pieces:
                        continue  # visitors of a slice that the hash left empty
                    held.ready()
                    yield from (_found(*x) for x in held.inside())
                for at in range(0, b - a, ROWS):
                    s = slice(a + at, min(a + at + ROWS, b))
                    yield from (_found(*x) for x in held.meet(k[s], v[s], n[s], vec[at : at + ROWS]))
        if held is not None and held.vec is None and held.pieces:
            held.ready()
            yield from (_found(*x) for x in held.inside())
        if held is not None and held.vec is not None:
            yield from (_found(*x) for x in held.ended())

    return run


def linked(reps: DataFrame, least: float, dim: int, kind: str) -> tuple[DataFrame, DataFrame]:
    """``k, v, links`` of each row of ``reps(k, n, vec)`` and the edges ``a, b`` between the v.

    v stands for a row and all that are linked with it without being compared;
    links counts the rows, each n times, that are linked with it.
    """
    spark = reps.sparkSession
    most = reps.count()
    drawn = reps.select(F.xxhash64("vec").alias("o"), "k", "vec").orderBy("o", "k").limit(SAMPLE).collect()
    reach = float(np.arccos(least))
    pivots = choose_pivots(units(np.array([r["vec"] for r in drawn], dtype=kind)), int(np.clip(2 * most // SLICE, 32, PIVOTS)), reach / 2)
    cells = Cells(pivots, least)

    def to_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.lean()
        for batch in batches:
            vec = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            home, angle = cells.home(units(vec)) if len(vec) else (np.zeros(0, dtype=np.int64), np.zeros(0))
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("n"), pa.array([r.tobytes() for r in vec], pa.binary()), pa.array(home, pa.int64()), pa.array(angle)], ["k", "n", "vec", "home", "angle"])

    homes = common.materialize(reps.mapInArrow(to_home, "k long, n long, vec binary, home long, angle double"))
    hubs = np.full(len(cells.rows), -1, dtype=np.int64)
    weight = np.zeros(len(cells.rows), dtype=np.int64)
    for r in homes.groupBy("home").agg(F.count("*").alias("rows"), F.sum("n").alias("n"), F.min("k").alias("hub"), F.min("angle").alias("low"), F.max("angle").alias("high")).collect():  # two for each pivot
        h = r["home"]
        cells.rows[h], cells.low[h], cells.high[h], hubs[h], weight[h] = r["rows"], r["low"], r["high"], r["hub"], r["n"]
    cells.cut()

    def count_visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.lean()
        total = np.zeros(len(cells.rows), dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                total += cells.visits(units(_matrix(batch.column("vec"), dim, kind)), _long(batch, "home")).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["cell", "n"])

    visitors = cells.rows.copy()
    for r in homes.select("vec", "home").mapInArrow(count_visits, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        visitors[r["cell"]] += r["n"]
    cells.parts = np.maximum(1, -(-visitors // VISITORS))
    step_rows = int(np.clip(1_000_000 // max(1, cells.slices.sum()), 1, 256))  # rows that are sent on at once

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.lean()
        for batch in batches:
            if not batch.num_rows:
                continue
            k, n, home = (_long(batch, c) for c in ("k", "n", "home"))
            raw = batch.column("vec")
            core = home % 2 == 0
            v = np.where(core, hubs[home], k)
            at = _spread(k, cells.slices[home])
            for a in range(0, len(k), step_rows):
                s = slice(a, a + step_rows)
                # each part of the own slice has a copy; only the first one compares it with itself
                row, part = _ranges(cells.parts[home[s]])
                yield from sent(raw, row + a, cells.first[home[s]][row] + at[s][row], part, 0, k, v, n, (part == 0) & ~core[s][row])
                row, cell = np.nonzero(cells.visits(units(_matrix(raw.slice(a, step_rows), dim, kind)), home[s]))
                again, step = _ranges(cells.slices[cell])
                row, block, parts = row[again] + a, cells.first[cell][again] + step, cells.parts[cell][again]
                yield from sent(raw, row, block, _spread(k[row] ^ 0x55555, parts), 1, k, v, n)
                later = np.where(core[s], 0, cells.slices[home[s]] - at[s] - 1)
                row, step = _ranges(later)
                block = cells.first[home[s]][row] + at[s][row] + 1 + step
                row += a
                yield from sent(raw, row, block, _spread(k[row] ^ 0x55555, cells.parts[home[row]]), 1, k, v, n)

    def sent(raw, row, block, part, role, k, v, n, own=None):
        for a in range(0, len(row), 8192):
            r = row[a : a + 8192]
            flags = np.zeros(len(r), dtype=bool) if own is None else own[a : a + 8192]
            yield pa.RecordBatch.from_arrays([pa.array(block[a : a + 8192], pa.int64()), pa.array(part[a : a + 8192], pa.int64()), pa.array(np.full(len(r), role, dtype=np.int32)), pa.array(k[r]), pa.array(v[r]), pa.array(n[r]), pa.array(flags), raw.take(pa.array(r))], ["block", "part", "role", "k", "v", "n", "own", "vec"])

    shipped = homes.select("k", "n", "vec", "home").mapInArrow(send, "block long, part long, role int, k long, v long, n long, own boolean, vec binary")
    many = max(common.shuffle_parts(spark), int((cells.slices * cells.parts).sum()) // 2)
    dealt = shipped.repartition(min(many, 20_000), "block", "part").sortWithinPartitions("block", "part", "role")
    found = common.materialize(dealt.mapInArrow(_joined(dim, kind, least), FOUND))
    counted = found.filter("links is not null").groupBy("k").agg(F.sum("links").alias("met"))
    table = spark.createDataFrame([(int(h), int(hubs[h]), int(weight[h])) for h in range(0, len(hubs), 2) if cells.rows[h]] or [(-1, -1, 0)], "home long, hub long, weight long")  # a row for each pivot
    known = homes.select("k", "n", "home").join(F.broadcast(table), "home", "left")
    out = known.join(counted, "k", "left").select("k", F.coalesce("hub", "k").alias("v"), (F.coalesce("met", F.lit(0)) + F.coalesce("weight", "n") - 1).alias("links"))
    return out, found.filter("other is not null").select(F.col("k").alias("a"), F.col("other").alias("b"))


def _ranges(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row i as often as ``counts[i]`` says, and 0, 1, ... beside each."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vec: str = "embedding", least: float = LEAST) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors``.

    Two rows are linked when the cosine of their vectors is ``least`` or more.
    Vectors without a direction (see :func:`usable`), and those of another
    length than most, are linked with nothing; so is nothing with itself. Equal
    vectors are compared once. Rows that share a vec_id, or have none, are rows
    of their own; component_id is the smallest vec_id that links reach, null
    where none of them has one. An empty table gives no rows. Other columns of
    ``vectors`` are not carried.
    """
    held = vectors.schema[vec].dataType
    kind = "<f4" if isinstance(held, ArrayType) and isinstance(held.elementType, FloatType) else "<f8"
    plain = common.keyed(vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vec).cast("array<float>" if kind == "<f4" else "array<double>").alias("vec")), "vec_id")
    numbered = hasattr(plain, "written")  # by keys of their own, not by vec_id
    good = plain.filter(usable(F.col("vec")))
    common_size = good.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common_size is None:
        return plain.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    dim = common_size["d"]
    good = good.filter(F.size("vec") == dim)
    common.bounded_batches(plain.sparkSession, 2000)
    reps = common.materialize(good.groupBy("vec").agg(F.min("_k").alias("k"), F.count("*").alias("n")).select("k", "n", "vec"))
    rows, edges = linked(reps, least, dim, kind)
    labels = components(edges)
    placed = rows.join(labels, "v", "left").select("k", "links", F.coalesce("comp", "v").alias("comp"))
    by_vec = common.materialize(reps.join(placed, "k").select(F.col("vec").alias("same"), "links", "comp"))
    out = plain.select("_k", "vec_id", F.when(usable(F.col("vec")), F.col("vec")).alias("vec"))
    out = out.join(by_vec, F.col("vec") == F.col("same"), "left").select("_k", "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("comp", "_k").alias("comp"))
    if numbered:  # a component is named by its smallest vec_id
        out = common.materialize(out)
        names = out.groupBy("comp").agg(F.min("vec_id").alias("component_id"))
        out = out.join(names, "comp")
    else:
        out = out.withColumn("component_id", F.col("comp"))
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links, min(r.b) AS component_id, e.vec_id = min(r.b) AS kept
FROM embeddings e JOIN reach r ON r.a = e.vec_id GROUP BY e.vec_id
"""


def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "embeddings"))
