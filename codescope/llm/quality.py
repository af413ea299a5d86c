"""Quality classifier: hashed word n-gram logistic regression, trained by FTRL.

Words are runs of letters and digits or runs of other signs, lower-cased in
A-Z; single words and pairs of neighbours are hashed to ``2**BITS`` features. A
feature's value is its count over the root of the text's feature count. The
weights are learned by follow-the-regularised-leader updates, one labelled text
at a time, and a score is the logistic function of a sparse dot product.

Only the training sample is bounded (``max_train`` labelled rows, by the hash
of doc_id); scoring covers every whole text, in parallel and without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BITS = 18
MAX_TRAIN = 12_000
THRESHOLD = 0.3
#: What a pair of equal words hashes to, whatever the word.
REPEATED = np.uint64(0x5BD1E9955BD1E995)

_CLASS = np.full(256, 2, dtype=np.uint8)  # 0: white space, 1: letters, digits and all beyond ASCII, 2: signs
_CLASS[[0, 9, 10, 11, 12, 13, 32]] = 0
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _CLASS[_a:_b] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all texts in a row, and each one's text."""
    data, _, ends = common.joined(texts)
    kind = _CLASS[data]
    edge = np.flatnonzero(np.diff(kind, prepend=np.uint8(0)))
    start = edge[kind[edge] > 0]
    edges = np.append(edge, len(data))
    end = edges[np.searchsorted(edges, start, side="right")]
    word = common.mix64(common.PrefixHash(_LOWER[data]).spans(start, end) + (end - start).astype(np.uint64))
    doc = np.searchsorted(ends, start, side="right")
    pair = common.mix64(word[:-1] * np.uint64(0x9E3779B97F4A7C15) + word[1:])
    pair[word[:-1] == word[1:]] = REPEATED
    same = doc[:-1] == doc[1:]
    shift = np.uint64(64 - BITS)
    index = np.concatenate([word >> shift, pair[same] >> shift]).astype(np.int64)
    owner = np.concatenate([doc, doc[:-1][same]])
    return index, owner


def train(rows: Iterator[tuple[bytes, int]], epochs: int = 3, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.05, l2: float = 0.1) -> np.ndarray:
    """FTRL-proximal over (text, label); the last weight is the bias."""
    size = 2**BITS + 1
    z, n = np.zeros(size), np.zeros(size)
    examples = []
    for text, label in rows:
        index, _ = features([text])
        k, c = np.unique(index, return_counts=True)
        x = np.append(c / np.sqrt(max(len(index), 1)), 1.0)
        examples.append((np.append(k, size - 1), x, label))

    def weights(k: np.ndarray | slice) -> np.ndarray:
        zk = z[k]
        return np.where(np.abs(zk) > l1, (np.sign(zk) * l1 - zk) / ((beta + np.sqrt(n[k])) / alpha + l2), 0.0)

    for _ in range(epochs):
        for k, x, label in examples:
            w = weights(k)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - label) * x
            old = n[k]
            new = old + g * g
            z[k] += g - (np.sqrt(new) - np.sqrt(old)) / alpha * w
            n[k] = new
    return weights(slice(None)).astype(np.float32)


def score_texts(weights: np.ndarray, texts: list[bytes]) -> np.ndarray:
    out = np.empty(len(texts))
    for at, part in common.chunks_of(texts, 1 << 21):
        index, owner = features(part)
        total = np.bincount(owner, weights[index], minlength=len(part))
        many = np.bincount(owner, minlength=len(part))
        dot = total / np.sqrt(np.maximum(many, 1)) + float(weights[-1])
        out[at : at + len(part)] = 1 / (1 + np.exp(-np.clip(dot, -35, 35)))
    return out


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> np.ndarray:
    """Weights from at most about ``max_train`` rows of ``labels(doc_id, quality)``.

    Of more labelled rows, those with the smallest hashes of doc_id are taken.
    Rows with a null label or doc_id teach nothing; with no labelled rows all
    weights are 0 and every score is 0.5.
    """
    use = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).filter("doc_id is not null and label is not null")
    use = use.groupBy("doc_id").agg(F.max("label").alias("label"))
    share = min(1.0, max_train / max(use.count(), 1))
    order = F.xxhash64("doc_id")
    if share < 1:
        use = use.filter(F.pmod(order, F.lit(1 << 30)) < int(share * (1 << 30)))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty(docs).alias("text"))
    # the broadcast side is bounded by max_train rows of two numbers
    sample = texts.join(F.broadcast(use), "doc_id").select(order.alias("o"), "label", F.encode("text", "UTF-8").alias("b"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.lean()
        rows = ((t, y) for batch in batches for t, y in zip(batch.column("b").to_pylist(), batch.column("label").to_pylist(), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([train(rows).tobytes()], pa.binary())], ["weights"])

    common.bounded_batches(docs.sparkSession)
    found = sample.repartition(1).sortWithinPartitions("o", "b").mapInArrow(learn, "weights binary").collect()
    return np.frombuffer(found[0]["weights"], dtype=np.float32) if found else np.zeros(2**BITS + 1, dtype=np.float32)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """All columns of ``docs`` and ``score`` (0 to 1), from the text alone.

    Null and empty texts get the score of the bias. A column that is already
    called score is replaced.
    """
    common.bounded_batches(docs.sparkSession)
    docs = docs.drop("score")
    raw = weights.tobytes()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.lean()
        w = np.frombuffer(raw, dtype=np.float32)
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score_texts(w, texts))], [*batch.schema.names, "score"])

    from pyspark.sql.types import DoubleType, StructType

    return docs.mapInArrow(add, StructType([*docs.schema.fields]).add("score", DoubleType()))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def filter_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with the columns they had, whatever their names."""
    weights = fit(docs, labels)
    plain = common.guarded(docs, ("doc_id", "text"))
    return score(plain, weights).filter(F.col("score") >= threshold).select(*plain.columns).toDF(*docs.columns)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    labels = common.table(spark, sf_dir, "labels").filter(~held_out())
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
