"""Token-ID output: Simple-8b word-aligned coding in files that Spark writes and reads.

A 64-bit word holds a 4-bit selector and as many ids as fit side by side in the
other 60 bits. Each block of ``BLOCK`` ids is packed on its own, and the file
keeps each block's first word, so that blocks are decoded independently and with
array operations only. An id of more than 60 bits is an escape: its word holds a
place in the segment's list of raw 64-bit values.

Files are Parquet rows, one per segment of a shard; a shard is one range of
doc_id, and the documents inside it are in ascending order. Spark's writer
commits them, so a lost executor leaves no half-written shard.
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

#: Ids per word for selectors 0..13 and the bits of each; 15 is the escape.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], dtype=np.int64)
WIDTHS = 60 // COUNTS
ESCAPE = 15
BLOCK = 128
SEGMENT_IDS = 1 << 18
SCHEMA = "shard int, shard_start long, doc_ids binary, doc_sizes binary, n_ids long, block_words binary, words binary, escapes binary"


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, each block's word count and the escaped values of a uint64 id array."""
    n = len(ids)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.uint64)
    blocks, reach = (n + BLOCK - 1) // BLOCK, int(COUNTS[0])
    # zeros behind each block: a word may be part empty only at its block's end
    padded = np.zeros((blocks, BLOCK + reach), dtype=np.uint64)
    filled = np.zeros(blocks * BLOCK, dtype=np.uint64)
    filled[:n] = ids
    padded[:, :BLOCK] = filled.reshape(blocks, BLOCK)
    need = np.zeros(padded.shape, dtype=np.uint8)  # 13 - s: the narrowest width, of selector s, that holds the id
    for s in range(len(COUNTS)):
        need += padded >> np.uint64(WIDTHS[s]) > 0
    best = np.full((blocks, BLOCK), len(COUNTS), dtype=np.uint8)
    widest = need[:, :BLOCK].copy()
    for c in range(1, reach + 1):  # widest: of the c ids from here
        if c > 1:
            np.maximum(widest, need[:, c - 1 : c - 1 + BLOCK], out=widest)
        if len(s := np.flatnonzero(COUNTS == c)):
            fits = widest <= s[0]
            if not fits.any():
                break
            best[fits] = s[0]
    step = np.append(COUNTS, 1)[best].ravel()
    at = np.arange(blocks, dtype=np.int64) * BLOCK
    end, starts = np.minimum(at + BLOCK, n), []
    while len(at):  # all blocks take one step together
        starts.append(at)
        at = at + step[at]
        at, end = at[at < end], end[at < end]
    first = np.sort(np.concatenate(starts))
    block = first // BLOCK
    sel, place, flat = best.ravel()[first], first + block * reach, padded.ravel()
    words = np.zeros(len(first), dtype=np.uint64)
    for s in np.unique(sel):
        k = np.flatnonzero(sel == s)
        if s == len(COUNTS):
            words[k] = np.uint64(ESCAPE) << np.uint64(60) | np.arange(len(k), dtype=np.uint64)
            continue
        word = np.full(len(k), np.uint64(s) << np.uint64(60))
        for j in range(int(COUNTS[s])):
            word |= flat[place[k] + j] << np.uint64(j * WIDTHS[s])
        words[k] = word
    return words, np.bincount(block, minlength=blocks).astype(np.int32), filled[first[sel == len(COUNTS)]]


def decode(words: np.ndarray, block_words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The ids of :func:`encode`, block by block side by side."""
    out = np.zeros(n, dtype=np.uint64)
    if n == 0:
        return out
    sel = (words >> np.uint64(60)).astype(np.int64)
    size = np.where(sel == ESCAPE, 1, COUNTS[np.minimum(sel, len(COUNTS) - 1)])
    block = np.repeat(np.arange(len(block_words)), block_words)
    cum = np.cumsum(size) - size
    first_word = np.cumsum(block_words) - block_words
    first = block * BLOCK + cum - cum[first_word][block]
    end = np.minimum((block + 1) * BLOCK, n)
    for s in np.unique(sel):
        k = np.flatnonzero(sel == s)
        if s == ESCAPE:
            out[first[k]] = escapes[(words[k] & np.uint64((1 << 60) - 1)).astype(np.int64)]
            continue
        w = int(WIDTHS[s])
        mask = np.uint64((1 << w) - 1)
        for j in range(int(COUNTS[s])):
            to = first[k] + j
            live = to < end[k]
            out[to[live]] = words[k][live] >> np.uint64(j * w) & mask
    return out


def _segment(shard: int, start: int, docs: list[int], sizes: list[int], ids: np.ndarray) -> dict:
    words, block_words, escapes = encode(ids)
    return {
        "shard": shard, "shard_start": start, "doc_ids": np.array(docs, dtype="<i8").tobytes(), "doc_sizes": np.array(sizes, dtype="<i8").tobytes(), "n_ids": len(ids),
        "block_words": block_words.astype("<i4").tobytes(), "words": words.astype("<u8").tobytes(), "escapes": escapes.astype("<u8").tobytes(),
    }


def _arrow_schema() -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in SCHEMA.split(", ")])


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, shards: int | None = None) -> None:
    """Tokenise ``docs(doc_id, text)`` and write the ids, each document followed by ``end_id``.

    Null texts are empty: they have the end id alone. Null doc_ids come first,
    written as the smallest long. Rows with one doc_id stay next to each other,
    in order of their texts. Other columns are left out. An empty table gives
    no segments.
    """
    spark = docs.sparkSession
    common.bounded_batches(spark)
    shards = shards or common.shuffle_parts(spark)
    key = F.coalesce(docs["doc_id"].cast("long"), F.lit(-(2**63)))
    ordered = docs.select(key.alias("doc_id"), common.text_or_empty(docs).alias("text")).repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tok, shard, schema = tokens.tokenizer(tokenizer_path, "word"), TaskContext.get().partitionId(), _arrow_schema()
        start, docs_, sizes, parts, held = 0, [], [], [], 0
        for batch in batches:
            texts = batch.column("text").to_pylist()
            ids, counts = tok.ids(texts)
            cuts = np.concatenate([[0], np.cumsum(counts)])
            flat = np.insert(ids, cuts[1:], np.uint32(end_id))
            docs_ += batch.column("doc_id").to_pylist()
            sizes += (counts + 1).tolist()
            parts.append(flat)
            held += len(flat)
            if held >= SEGMENT_IDS:
                yield pa.RecordBatch.from_pylist([_segment(shard, start, docs_, sizes, np.concatenate(parts))], schema)
                start, docs_, sizes, parts, held = start + held, [], [], [], 0
        if docs_:
            yield pa.RecordBatch.from_pylist([_segment(shard, start, docs_, sizes, np.concatenate(parts))], schema)

    ordered.mapInArrow(pack, SCHEMA).write.option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Decode files of :func:`write`: doc_id, shard, shard_start, n_tokens, ids (array)."""
    return _decoded(spark, path, "doc_id long, shard int, start long, n_tokens long, ids array<long>", True)


def summaries(spark: SparkSession, path: str) -> DataFrame:
    """Per document read back from the files: doc_id, start, n_tokens, ids_crc32."""
    docs = _decoded(spark, path, "doc_id long, shard int, start long, n_tokens long, ids_crc32 long", False)
    # one row per shard: as many as there are files, not documents
    totals = spark.read.schema(SCHEMA).parquet(path).groupBy("shard").agg(F.sum("n_ids").alias("n"))
    base = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    return docs.join(base, "shard").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def _decoded(spark: SparkSession, path: str, schema: str, with_ids: bool) -> DataFrame:
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode(np.frombuffer(row["words"], "<u8"), np.frombuffer(row["block_words"], "<i4"), np.frombuffer(row["escapes"], "<u8"), row["n_ids"])
                docs, sizes = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["doc_sizes"], "<i8")
                ends = np.cumsum(sizes)
                cols = [pa.array(docs), pa.array(np.full(len(docs), row["shard"], dtype=np.int32)), pa.array(row["shard_start"] + ends - sizes), pa.array(sizes)]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int64))))
                else:
                    raw = memoryview(ids.astype("<u4").tobytes())
                    cols.append(pa.array([zlib.crc32(raw[4 * (e - s) : 4 * e]) for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)], pa.int64()))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "shard", "start", "n_tokens", "ids" if with_ids else "ids_crc32"])

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    return spark.read.schema(SCHEMA).parquet(path).mapInArrow(unpack, schema)


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = common.shared_dir(spark)
    write(common.table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), 1)
    return summaries(spark, path)
