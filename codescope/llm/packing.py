"""Best-fit packing planned on a histogram of lengths.

The plan never sees documents: best-fit decreasing runs over counts per length,
so that groups of equal sequences are planned at once. Documents then take the
planned slots by their rank within their length. Ranks are local ranks plus the
counts of the partitions before, so no length is gathered in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common, tokens

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def plan(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best-fit decreasing over ``{length: count}``.

    Gives groups of equal sequences: [(length, copies), ...] and how many there
    are. Every piece goes to the fullest sequence that has room for it. A step
    splits one group at most, so groups are a small multiple of the capacity.
    """
    free: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}
    for size in sorted(counts, reverse=True):
        left = counts[size]
        if not 0 < size <= capacity:
            raise ValueError(f"a piece of {size} tokens doesn't fit {capacity}")
        for room in range(size, capacity):
            groups, kept = free.pop(room, []), []
            for pattern, many in groups:
                each = room // size
                full = min(many, left // each)
                if full:
                    free.setdefault(room - each * size, []).append(([*pattern, (size, each)], full))
                    many, left = many - full, left - full * each
                if many and 0 < left < each:
                    free.setdefault(room - left * size, []).append(([*pattern, (size, left)], 1))
                    many, left = many - 1, 0
                if many:
                    kept.append((pattern, many))
            if kept:
                free.setdefault(room, []).extend(kept)
            if not left:
                break
        each = capacity // size
        if left >= each:
            free.setdefault(capacity - each * size, []).append(([(size, each)], left // each))
        if left % each:
            free.setdefault(capacity - left % each * size, []).append(([(size, left % each)], 1))
    return [g for room in sorted(free) for g in free[room]]


def slots(groups: list[tuple[list[tuple[int, int]], int]]) -> dict[str, np.ndarray]:
    """Runs of slots by (length, first rank): the sequence of the first rank and the offset."""
    rank: dict[int, int] = {}
    rows, seq = [], 0
    for pattern, many in groups:
        offset = 0
        for size, copies in pattern:
            for _ in range(copies):
                rows.append((size, rank.get(size, 0), seq, offset))
                rank[size] = rank.get(size, 0) + many
                offset += size
        seq += many
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 4)
    return {"key": (table[:, 0] << 44) + table[:, 1], "rank": table[:, 1], "seq": table[:, 2], "offset": table[:, 3]}


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int) -> DataFrame:
    """Token pieces of every whole text, with the rank of each among the equally long of its partition."""
    common.bounded_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tok, part = tokens.tokenizer(tokenizer_path, "byte"), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            ids, counts = tok.ids(batch.column("text").to_pylist())
            flat = np.insert(ids, np.cumsum(counts), np.uint32(end_id)).astype("<u4")
            sizes = counts + 1
            begin = np.cumsum(sizes) - sizes
            many = (sizes + capacity - 1) // capacity
            doc = np.repeat(np.arange(len(sizes)), many)
            nth_piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
            head = sizes - (many - 1) * capacity  # the first piece is the short one
            length = np.where(nth_piece == 0, head[doc], capacity)
            start = np.where(nth_piece == 0, 0, head[doc] + (nth_piece - 1) * capacity)
            order = np.argsort(length, kind="stable")
            runs, inverse, size = np.unique(length, return_inverse=True, return_counts=True)
            nth = np.empty(len(length), dtype=np.int64)
            nth[order] = np.arange(len(length)) - np.repeat(np.cumsum(size) - size, size)
            nth += seen[runs][inverse]
            seen[runs] += size
            raw, a = memoryview(flat.tobytes()), begin[doc] + start
            crc = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(a.tolist(), (a + length).tolist(), strict=True)]
            ids_ = batch.column("doc_id").take(pa.array(doc))
            yield pa.RecordBatch.from_arrays([ids_, pa.array(nth_piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), part), pa.int32()), pa.array(nth)], [c.split()[0] for c in PIECES.split(", ")])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), common.text_or_empty(docs).alias("text")).mapInArrow(cut, PIECES)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 1024) -> DataFrame:
    """Pack ``docs(doc_id, text)`` into sequences of at most ``capacity`` tokens.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    Null texts are empty and give one piece, the end id. Null and repeated
    doc_ids are rows like others. Extra columns are left out; an empty table
    gives no rows.
    """
    rows = common.materialize(pieces(docs, tokenizer_path, end_id, capacity))
    counts = rows.groupBy("part", "length").count()
    base = counts.withColumn("base", F.sum("count").over(Window.partitionBy("length").orderBy("part")) - F.col("count")).drop("count")
    # at most one row per length: bounded by the capacity, whatever the input
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = slots(plan(histogram, capacity))
    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column("nth").to_numpy() + batch.column("base").to_numpy()
            k = np.searchsorted(table["key"], (batch.column("length").to_numpy() << 44) + rank, side="right") - 1
            cols = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(table["seq"][k] + rank - table["rank"][k]), pa.array(table["offset"][k])], [c.split()[0] for c in out.split(", ")])

    return rows.join(base, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", "nth", "base").mapInArrow(place, out)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2)
