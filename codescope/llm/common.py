"""Shared helpers of the training-data operators: tables, checkpoints, byte kernels."""

from __future__ import annotations

import gc
import re
import sys
import time
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_released = 0.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below the checkpoint folder that all executors share.

    The folder comes from ``spark.checkpoint.dir``. Where that is unset, only a
    session on one machine gets a default; on a cluster nothing would be shared.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "/tmp/checkpoints"
    return f"{base.rstrip('/')}/codescope-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage with files that survive the loss of any executor.
    Shuffles that nothing refers to any longer are let go first.
    """
    spark = df.sparkSession
    release(spark)
    path = shared_dir(spark)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written = path
    return out


def release(spark: SparkSession, now: bool = False) -> None:
    """Have Spark's cleaner remove the shuffle files of finished, unreachable queries, every few seconds at most."""
    global _released
    if not now and time.monotonic() - _released < 4:
        return
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    _released = time.monotonic()


def discard(df: DataFrame) -> None:
    """Delete the files of a table of :func:`materialize` that nothing reads any more."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(df.written)
    path.getFileSystem(conf).delete(path, True)


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keep Arrow batches small, since one text may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def text_or_empty(df: DataFrame) -> Column:
    return F.coalesce(df["text"], F.lit(""))


def plainly_named(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns c0, c1, ... and the new name of each: no name can clash with an operator's own."""
    names = df.columns
    return df.toDF(*[f"c{i}" for i in range(len(names))]), {c: f"c{i}" for i, c in enumerate(names)}


def guarded(df: DataFrame, needs: tuple[str, ...]) -> DataFrame:
    """``df`` with plain names for all columns but ``needs``; ``toDF(*df.columns)`` takes it back."""
    return df.toDF(*[c if c in needs else f"_c{i}" for i, c in enumerate(df.columns)])


def keyed(docs: DataFrame, doc_id: str) -> DataFrame:
    """``docs`` and ``_k``, a long that no two rows share.

    That is doc_id itself where no doc_id is null or repeated; else rows are
    numbered and written, so that every later read sees the same numbers.
    """
    own = F.col(doc_id).cast("long")
    odd = docs.select(own.alias("i")).groupBy("i").count().filter("count > 1 or i is null")
    if odd.isEmpty():
        return docs.withColumn("_k", own)
    return materialize(docs.withColumn("_k", F.monotonically_increasing_id()))


def lean() -> None:
    """Drop what earlier work left in this Python worker: Spark reuses workers from stage to stage."""
    tokens = sys.modules.get("codescope.llm.tokens")
    if tokens is not None:
        tokens.loaded.clear()


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser that spreads entropy over all 64 bits."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def byte_table(seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 2**63, 256, dtype=np.uint64) | U64(1)


class PrefixHash:
    """Prefix polynomial hash modulo 2**64 over one byte array.

    ``P[i] = sum(T[b_j] * B**j for j < i)``; the hash of ``[s, e)`` is
    ``(P[e] - P[s]) * B**-s``, so that equal bytes give equal hashes wherever
    they start. Bytes are mapped through a random odd table first.
    """

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, seed: int = 1) -> None:
        n = len(data)
        up, self.down = self.powers(n + 1, seed)
        self.prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(byte_table(seed)[data] * up[:n], out=self.prefix[1:])

    @classmethod
    def powers(cls, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
        have = cls._powers.get(seed)
        if have is None or len(have[0]) < n:
            base = int(byte_table(seed + 1000)[0]) | 5
            size = 1 << max(16, (n - 1).bit_length())
            up, down = (np.full(size, b, dtype=np.uint64) for b in (base, pow(base, -1, 2**64)))
            up[0] = down[0] = 1
            have = cls._powers[seed] = (np.cumprod(up), np.cumprod(down))
        return have

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.prefix[end] - self.prefix[start]) * self.down[start]


def joined(texts: list[bytes], gap: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One byte array of all texts, each followed by ``gap`` zero bytes; their starts and ends."""
    sizes = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    ends = np.cumsum(sizes + gap) - gap
    blob = np.frombuffer((b"\0" * gap).join(texts) + b"\0" * gap, dtype=np.uint8)
    return blob, ends - sizes, ends


def chunks_of(values: list[bytes], most: int):
    """Slices of a list whose bytes stay near ``most``; one long text is a slice of its own."""
    part, size, at = [], 0, 0
    for i, v in enumerate(values):
        if part and size + len(v) > most:
            yield at, part
            part, size, at = [], 0, i
        part.append(v)
        size += len(v)
    if part:
        yield at, part
