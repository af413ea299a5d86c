"""Repeated byte strings by hash-compared suffix sorting.

A byte goes when a string of ``min_len`` bytes that covers it also starts
anywhere else. Sorting all suffixes of a corpus is out of reach, so the work is
cut down first, without loss:

1. Anchors. Of the ``GRAM``-byte substrings in each window of ``min_len`` bytes,
   the one with the smallest hash is the window's anchor. It depends on the
   window's bytes alone, so equal windows have equal anchors at equal places.
   Consecutive windows share anchors; a run of windows with one anchor is known
   by the anchor's hash and the digest of all bytes of the run. A stretch is a
   few runs in a row; it starts where the anchor's hash says so.
2. Stretches with equal bytes repeat each other throughout; only one of them goes
   on. Of the others, runs whose anchor occurs once repeat nothing, and runs with
   equal bytes repeat each other throughout. Equal means equal BLAKE2 digests of
   128 bits, for the bytes themselves would have to be moved.
3. What is left are runs that share an anchor but differ somewhere, one for each
   distinct content. Their windows are the suffixes to sort: within one anchor
   and one distance to it, a mergesort compares suffixes by binary search on
   prefix polynomial hashes, and neighbours with a common prefix of ``min_len``
   bytes are repeats, once their bytes have been compared.
4. An anchor with very many distinct runs is dealt over several tasks. What stays
   single in its task is passed on in blocks of BLOCK windows, each known by the
   bytes that all its windows hold. Blocks that meet an equal one are then taken
   apart, and their windows counted over all tasks, both by 128-bit digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_LEN = 400
#: Bytes and words of a passage that repeats (strip_repeats).
PASSAGE_BYTES = 200
PASSAGE_WORDS = 50
#: Runs of a stretch: one in so many starts one, and so many are one at most.
STRETCH, MOST_RUNS = 8, 64
GROUP = 1024
BLOCK = 16
RUNS = [("lo", pa.int32()), ("n", pa.int32()), ("a", pa.int32()), ("g", pa.int64()), ("s", pa.int64()), ("s2", pa.int64())]
STRETCHES = "k long, lo int, hi int, u long, u2 long, runs array<struct<lo:int,n:int,a:int,g:long,s:long,s2:long>>"


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Two longs for each span of bytes: its BLAKE2 digest."""
    raw = memoryview(np.ascontiguousarray(data))
    out = b"".join([hashlib.blake2b(raw[i:j], digest_size=16).digest() for i, j in zip(start.tolist(), end.tolist(), strict=True)])
    return np.frombuffer(out, dtype=np.int64).reshape(-1, 2)


def anchors(texts: list[bytes], min_len: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: text, first window, windows - 1, the anchor's distance and hash, the run's digest."""
    gram = min_len // 2
    width = min_len - gram + 1
    data, begin, end = common.joined(texts)
    size = len(data)
    empty = np.zeros(0, np.int64)
    if not (end - begin >= min_len).any():
        return empty, empty, empty, empty, empty, np.zeros((0, 2), np.int64), data, begin
    bits = np.uint64(int(size).bit_length())
    first = common.PrefixHash(data, 1)
    at = np.arange(size - gram + 1)
    whole = common.mix64(first.spans(at, at + gram))
    key = whole >> bits << bits | at.astype(np.uint64)
    low, span = key, 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    owner = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)  # of the window that starts here
    starts = np.arange(len(owner))
    doc = np.searchsorted(end, starts, side="right")
    good = starts + min_len <= end[np.minimum(doc, len(end) - 1)]
    good &= starts >= begin[np.minimum(doc, len(end) - 1)]
    starts, doc, owner = starts[good], doc[good], owner[good]
    new = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
    lo, p, d = starts[new], owner[new], doc[new]
    hi = starts[np.append(new[1:], len(starts)) - 1]
    return d, lo - begin[d], hi - lo, p - lo, whole[p].view(np.int64), digests(data, lo, hi + min_len), data, begin


class SuffixSort:
    """Sort suffixes of ``data`` group by group, comparing at most ``depth`` bytes."""

    def __init__(self, data: np.ndarray, depth: int) -> None:
        self.data, self.depth = data, depth
        self.hash = common.PrefixHash(data, 1)

    def common_prefix(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common prefix, up to ``depth``, by binary search on prefix hashes."""
        low, high = np.zeros(len(x), np.int64), np.full(len(x), self.depth, np.int64)
        while True:
            open_ = low < high
            if not open_.any():
                return low
            mid = (low + high + 1) // 2
            same = self.hash.spans(x, x + mid) == self.hash.spans(y, y + mid)
            low = np.where(open_ & same, mid, low)
            high = np.where(open_ & ~same, mid - 1, high)

    def less(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where suffix x comes before y, and where both are equal."""
        n = self.common_prefix(x, y)
        equal = n >= self.depth
        n = np.minimum(n, self.depth - 1)
        return ~equal & (self.data[x + n] < self.data[y + n]), equal

    def sort(self, suffix: np.ndarray, group: np.ndarray) -> np.ndarray:
        """``suffix`` with each group of neighbours sorted by a bottom-up mergesort."""
        suffix = suffix.copy()
        first = np.flatnonzero(np.diff(group, prepend=group[:1] - 1))
        size = np.diff(np.append(first, len(group)))
        begin, total = np.repeat(first, size), np.repeat(size, size)
        local = np.arange(len(suffix)) - begin
        live, width = np.flatnonzero(total > 1), 1
        while len(live):
            run = local[live] // width
            other = begin[live] + (run ^ 1) * width
            stop = np.minimum(other + width, begin[live] + total[live])
            x, left = suffix[live], run % 2 == 0
            low, high = np.minimum(other, stop), stop.copy()
            busy = np.flatnonzero(low < high)
            while len(busy):  # how many of the sibling run come first: equal ones do if they stand left
                mid = (low[busy] + high[busy]) // 2
                less, equal = self.less(suffix[mid], x[busy])
                before = less | equal & ~left[busy]
                low[busy] = np.where(before, mid + 1, low[busy])
                high[busy] = np.where(before, high[busy], mid)
                busy = busy[low[busy] < high[busy]]
            to = begin[live] + run // 2 * 2 * width + local[live] % width + (low - np.minimum(other, stop))
            out = suffix.copy()
            out[to] = x
            suffix, width = out, width * 2
            live = live[total[live] > width]
        return suffix

    def equal_bytes(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Verify that the first ``depth`` bytes are equal."""
        out = np.ones(len(x), dtype=bool)
        span = np.arange(self.depth)
        for i in range(0, len(x), 4096):
            a, b = x[i : i + 4096, None] + span, y[i : i + 4096, None] + span
            out[i : i + 4096] = (self.data[a] == self.data[b]).all(axis=1)
        return out


def repeated(contexts: list[bytes], gram: np.ndarray, n: np.ndarray, a: np.ndarray, min_len: int) -> tuple[np.ndarray, ...]:
    """Windows of runs that occur in another run: run, window, whether it is repeated, and its place in ``data``.

    ``gram`` numbers the runs' anchors; windows are compared only within one
    anchor and distance, for equal windows agree in both.
    """
    data, begin, _ = common.joined(contexts)
    owner = np.repeat(np.arange(len(n)), n + 1)
    window = np.arange(len(owner)) - np.repeat(np.cumsum(n + 1) - (n + 1), n + 1)
    where = begin[owner] + window
    key = gram[owner] * 65536 + (a[owner] - window + 32768)
    order = np.argsort(key, kind="stable")
    key = key[order]
    alone = np.diff(key, prepend=key[:1] - 1) != 0
    alone &= np.append(alone[1:], True)
    keep = order[~alone]
    found = np.zeros(len(owner), dtype=bool)
    if len(keep):
        work = SuffixSort(data, min_len)
        group = key[~alone]
        ranked = work.sort(where[keep], group)
        same = group[1:] == group[:-1]
        x, y = ranked[:-1][same], ranked[1:][same]
        equal = work.common_prefix(x, y) >= min_len
        x, y = x[equal], y[equal]
        good = work.equal_bytes(x, y)
        back = np.full(len(data), -1, dtype=np.int64)
        back[where] = np.arange(len(where))
        found[back[x[good]]] = found[back[y[good]]] = True
        if not good.all():  # a collision of hashes: compare this group's bytes themselves
            for w in np.unique(key[np.isin(order, back[np.concatenate([x[~good], y[~good]])])]):
                texts: dict[bytes, list[int]] = {}
                for i in order[key == w]:
                    texts.setdefault(data[where[i] : where[i] + min_len].tobytes(), []).append(i)
                for same_ in texts.values():
                    found[same_] = len(same_) > 1
    return owner, window, found, data, where


def _batch(columns: dict, schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    names = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[c], kinds[t]) for c, t in names], [c for c, _ in names])


def _stretches(docs: DataFrame, min_len: int) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.lean()
        for batch in batches:
            ids = batch.column("_k").to_numpy()
            for at, part in common.chunks_of(batch.column("_text").cast(pa.binary()).to_pylist(), 1 << 20):
                d, lo, n, a, g, s, data, begin = anchors(part, min_len)
                new = (np.diff(d, prepend=-1) != 0) | (g % STRETCH == 0)
                first = np.flatnonzero(new)
                new[(np.arange(len(d)) - np.repeat(first, np.diff(np.append(first, len(d))))) % MOST_RUNS == 0] = True
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(d)) - 1 if len(first) else first
                hi = lo[last] + n[last]
                base = begin[d[first]] if len(first) else first
                u = digests(data, base + lo[first], base + hi + min_len)
                runs = pa.StructArray.from_arrays([pa.array(x).cast(t) for x, (_, t) in zip((lo, n, a, g, s[:, 0], s[:, 1]), RUNS, strict=True)], [c for c, _ in RUNS])
                cuts = pa.array(np.append(first, len(d)).astype(np.int32))
                cols = [pa.array(ids[at + d[first]]), pa.array(lo[first]).cast(pa.int32()), pa.array(hi).cast(pa.int32()), pa.array(u[:, 0]), pa.array(u[:, 1]), pa.ListArray.from_arrays(cuts, runs)]
                yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in STRETCHES.split(", ")])

    return docs.select("_k", "_text").mapInArrow(scan, STRETCHES)


def _contexts(docs: DataFrame, wanted: DataFrame, min_len: int) -> DataFrame:
    """The bytes of each wanted run."""
    schema = "g long, salt int, hot boolean, single boolean, k long, lo int, n int, a int, ctx binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c.split()[0]: [] for c in schema.split(", ")}
            for k, text, runs in zip(batch.column("_k").to_pylist(), batch.column("_text").cast(pa.binary()).to_pylist(), batch.column("runs").to_pylist(), strict=True):
                for r in runs:
                    for c in ("g", "salt", "hot", "single", "lo", "n", "a"):
                        out[c].append(r[c])
                    out["k"].append(k)
                    out["ctx"].append(text[r["lo"] : r["lo"] + r["n"] + min_len])
            yield _batch(out, schema)

    lists = wanted.groupBy("k").agg(F.collect_list(F.struct("g", "salt", "hot", "single", "lo", "n", "a")).alias("runs"))
    once = docs.select("_k", "_text").join(lists, F.col("_k") == F.col("k")).select("_k", "_text", "runs")
    return once.mapInArrow(cut, schema)


def _compare(contexts: DataFrame, min_len: int) -> DataFrame:
    """Sort the windows of each (anchor, salt): repeated stretches, and single windows of anchors dealt over tasks."""
    schema = "k long, start int, end int, x long, y long, mask int, ctx binary"

    def flush(rows: dict[str, list]) -> Iterator[pa.RecordBatch]:
        n, a = np.array(rows["n"], np.int64), np.array(rows["a"], np.int64)
        _, gram = np.unique(np.array(rows["g"], np.int64) * 1_000_003 + np.array(rows["salt"], np.int64), return_inverse=True)
        owner, window, found, data, where = repeated(rows["ctx"], gram, n, a, min_len)
        k, lo = np.array(rows["k"], np.int64), np.array(rows["lo"], np.int64)
        single, hot = np.array(rows["single"]), np.array(rows["hot"])
        # runs of neighbouring repeated windows, for runs that aren't whole repeats anyway
        use = found & single[owner]
        edge = np.diff(np.concatenate([[False], use, [False]]).astype(np.int8)) != 0
        edge[:-1] |= np.diff(owner, prepend=-1) != 0
        cuts = np.flatnonzero(edge)
        first = cuts[:-1][use[cuts[:-1]]] if len(cuts) > 1 else np.zeros(0, np.int64)
        last = cuts[1:][use[cuts[:-1]]] - 1 if len(cuts) > 1 else first
        o = owner[first]
        zero = np.zeros(len(first), np.int64)
        yield _batch({"k": k[o], "start": lo[o] + window[first], "end": lo[o] + window[last] + min_len, "x": zero, "y": zero, "mask": zero, "ctx": [None] * len(o)}, schema)
        if hot.any():
            i = np.flatnonzero(hot[owner])
            single_here = ~found[i] & single[owner[i]]
            away = a[owner[i]] - window[i]
            block = owner[i] * 65536 + away // BLOCK
            f = np.flatnonzero(np.diff(block, prepend=-1))
            e = np.append(f[1:], len(i)) - 1
            bit = np.where(single_here, 1 << (np.arange(len(i)) - np.repeat(f, e - f + 1)), 0)
            mask = np.add.reduceat(bit, f)
            begin, end = where[i[f]], where[i[e]] + min_len
            core = begin + away[f] % BLOCK  # to where the block's last window could start
            x, y = digests(data, core, core - (BLOCK - 1) + min_len).T
            # of blocks that need no answer, one for each content tells the other tasks
            keep = mask > 0
            _, one = np.unique(digests(data, begin[~keep], end[~keep]), axis=0, return_index=True)
            keep[np.flatnonzero(~keep)[one]] = True
            o, start = owner[i[f]][keep], window[i[f]][keep]
            ctx = [data[s:t].tobytes() for s, t in zip(begin[keep].tolist(), end[keep].tolist(), strict=True)]
            yield _batch({"k": k[o], "start": lo[o] + start, "end": lo[o] + start + (end - begin)[keep], "x": x[keep], "y": y[keep], "mask": mask[keep], "ctx": ctx}, schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["g", "salt", "hot", "single", "k", "lo", "n", "a", "ctx"]
        held: dict[str, list] = {c: [] for c in names}
        size, last = 0, None
        for batch in batches:
            cols = {c: batch.column(c).to_pylist() for c in names}
            for i in range(batch.num_rows):
                this = (cols["g"][i], cols["salt"][i])
                if this != last and size > 1 << 19:
                    yield from flush(held)
                    held, size = {c: [] for c in names}, 0
                for c in names:
                    held[c].append(cols[c][i])
                size += len(cols["ctx"][i])
                last = this
        if held["k"]:
            yield from flush(held)

    return contexts.repartition("g", "salt").sortWithinPartitions("g", "salt").mapInArrow(work, schema)


def _windows(blocks: DataFrame, min_len: int) -> DataFrame:
    """The windows of blocks: their digests, and where they are if they need an answer (else end is 0)."""
    schema = "k long, start int, end int, x long, y long"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, begin, end = common.joined(batch.column("ctx").to_pylist())
            n = end - begin - min_len + 1
            o = np.repeat(np.arange(len(n)), n)
            w = np.arange(len(o)) - np.repeat(np.cumsum(n) - n, n)
            at = begin[o] + w
            x, y = digests(data, at, at + min_len).T
            start = batch.column("start").to_numpy()[o] + w
            asks = batch.column("mask").to_numpy()[o] >> w & 1
            yield _batch({"k": batch.column("k").to_numpy()[o], "start": start, "end": np.where(asks, start + min_len, 0), "x": x, "y": y}, schema)

    return blocks.select("k", "start", "mask", "ctx").mapInArrow(work, schema)


def repeated_spans(keyed: DataFrame, min_len: int) -> DataFrame:
    """``k`` and ``spans`` (array of start, end in bytes; they may overlap) of the keyed rows that have any."""
    found = common.materialize(_stretches(keyed, min_len))
    # tables are written before a join: with an aggregate, Spark couldn't split a hot key's rows
    same = common.materialize(found.groupBy("u", "u2").agg(F.count("*").alias("c"), F.min(F.struct("k", "lo")).alias("one")).filter("c > 1").select("u", "u2", "one"))
    again, one = F.col("one").isNotNull(), (F.col("one.k") == F.col("k")) & (F.col("one.lo") == F.col("lo"))
    marked = found.join(same, ["u", "u2"], "left").select("k", "lo", "hi", again.alias("again"), F.when(~again | one, F.col("runs")).alias("runs"))
    marked = common.materialize(marked)
    common.discard(found)
    common.release(keyed.sparkSession, now=True)
    alike = marked.filter("again").select("k", F.col("lo").alias("start"), (F.col("hi") + min_len).alias("end"))
    rows = marked.filter("runs is not null").select("k", "again", F.explode("runs").alias("r")).select("k", "again", "r.*")
    twice = common.materialize(rows.groupBy("g").count().filter("count > 1").select("g"))
    rows = common.materialize(rows.join(twice, "g", "left_semi"))
    runs = rows.groupBy("g", "s", "s2").agg(F.count("*").alias("c"), F.max("again").alias("again"), F.min(F.struct("k", "lo", "n", "a")).alias("r"))
    runs = common.materialize(runs.select("g", "s", "s2", "c", "again", "r.*"))
    # likewise no aggregate stands above this join
    whole = rows.filter("not again").join(runs.filter("c > 1").select("g", "s", "s2"), ["g", "s", "s2"], "left_semi").select("k", F.col("lo").alias("start"), (F.col("lo") + F.col("n") + min_len).alias("end"))
    mixed = common.materialize(runs.groupBy("g").agg(F.count("*").alias("many")).filter("many > 1"))
    parts = F.ceil(F.col("many") / GROUP).cast("int")
    wanted = runs.join(mixed, "g").select("g", F.pmod(F.hash("k", "lo"), parts).alias("salt"), (parts > 1).alias("hot"), ((F.col("c") == 1) & ~F.col("again")).alias("single"), "k", "lo", "n", "a")
    found = common.materialize(_compare(_contexts(keyed, wanted, min_len), min_len))
    local = found.filter("ctx is null").select("k", "start", "end")
    blocks = found.filter("ctx is not null")
    met = blocks.groupBy("x", "y").count().filter("count > 1").select("x", "y")
    opened = common.materialize(_windows(blocks.join(met, ["x", "y"], "left_semi"), min_len))
    again = opened.groupBy("x", "y").count().filter("count > 1").select("x", "y")
    wide = opened.filter("end > 0").join(again, ["x", "y"], "left_semi").select("k", "start", "end")
    spans = alike.unionByName(whole).unionByName(local).unionByName(wide)
    return spans.groupBy("k").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def _merged(spans: list[dict]) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted((x["start"], x["end"]) for x in spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def _without(text: bytes, spans: list[list[int]]) -> bytes:
    at, kept = 0, []
    for s, e in spans:
        kept.append(text[at:s])
        at = e
    return b"".join([*kept, text[at:]])


def _whole_characters(text: bytes, spans: list[list[int]]) -> list[list[int]]:
    """Spans shrunk to code points, so that what is left is UTF-8."""
    out = []
    for s, e in spans:
        while s < e and text[s] & 0xC0 == 0x80:
            s += 1
        while e > s and e < len(text) and text[e] & 0xC0 == 0x80:
            e -= 1
        if s < e:
            out.append([s, e])
    return out


def removal(docs: DataFrame, min_len: int = MIN_LEN) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text.

    Null texts are empty. Null doc_ids are kept. Rows with one doc_id are rows of
    their own; equal rows repeat each other. Extra columns are left out. Texts under ``min_len`` bytes lose
    nothing. ``kept_text`` is cut at code points, the other columns at bytes.
    """
    common.bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty(docs).alias("_text"))
    keyed = common.keyed(rows, "doc_id")
    spans = repeated_spans(keyed, min_len)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i, text, found in zip(batch.column("doc_id").to_pylist(), batch.column("_text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True):
                gone = _merged(found or [])
                kept = _without(text, gone)
                shown = _without(text, _whole_characters(text, gone)).decode()
                out.append((i, len(text), sum(e - s for s, e in gone), len(gone), hashlib.sha256(kept).hexdigest(), shown))
            cols = zip(*out, strict=True) if out else [[]] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], [c.split()[0] for c in schema.split(", ")])

    joined = keyed.join(spans, F.col("_k") == F.col("k"), "left").select("doc_id", "_text", "spans")
    return joined.mapInArrow(cut, schema)


def strip_repeats(docs: DataFrame, min_len: int = PASSAGE_BYTES, min_words: int = PASSAGE_WORDS) -> DataFrame:
    """``docs`` with repeated passages taken out of text, and n_chars (if it is a column) of what is left.

    A passage is a maximal run of bytes covered by strings of ``min_len`` bytes
    that also start elsewhere, if it has ``min_words`` words. Each copy goes. No
    row goes, not even one whose text is all repeats. Spans are cut at code
    points. Other columns are as they were, whatever their names.
    """
    from pyspark.sql.types import StructType

    common.bounded_batches(docs.sparkSession)
    plain, name = common.plainly_named(docs)
    text_at, chars_at = name["text"], name.get("n_chars")
    names = plain.columns
    keyed = common.keyed(plain.withColumn("_text", F.coalesce(F.col(text_at), F.lit(""))), name["doc_id"])
    spans = repeated_spans(keyed, min_len)
    schema = StructType([plain.schema[c] for c in names])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[str | None] = []
            for text, found in zip(batch.column(text_at).to_pylist(), batch.column("_spans").to_pylist(), strict=True):
                if found and text:
                    raw = text.encode()
                    gone = [[s, e] for s, e in _merged(found) if len(raw[s:e].split()) >= min_words]
                    text = _without(raw, _whole_characters(raw, gone)).decode()
                out.append(text)
            new = {text_at: pa.array(out, batch.schema.field(text_at).type)}
            if chars_at:
                new[chars_at] = pa.array([None if t is None else len(t) for t in out], pa.int64()).cast(batch.schema.field(chars_at).type)
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in names], names)

    spans = spans.select(F.col("k").alias("_span_k"), F.col("spans").alias("_spans"))
    joined = keyed.join(spans, F.col("_k") == F.col("_span_k"), "left").select(*names, "_spans")
    return joined.mapInArrow(cut, schema).toDF(*docs.columns)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal(common.table(spark, sf_dir, "documents"))
