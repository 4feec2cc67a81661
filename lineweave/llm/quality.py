"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

A text's tokens are its runs of word characters and its runs of other characters. Tokens and pairs of
neighbouring tokens are hashed to 2**BUCKET_BITS features whose counts are scaled to length 1. Training is the
per-coordinate FTRL-proximal update (McMahan et al., 2013), one row after another, over a bounded sample of
labelled rows; scoring is one sparse dot product per text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.llm.common import added, saved, table
from lineweave.llm.tokens import hashed, mixed, parts

BUCKET_BITS = 18
#: The bounds of the sample that the driver holds: labelled rows, in order of a hash, and features of them all together.
MAX_TRAIN, MAX_FEATURES = 8000, 16_000_000
EPOCHS, ALPHA, BETA, L1, L2 = 6, 2.0, 1.0, 0.001, 0.001
KEEP_AT = 0.3


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, value, offsets): the sparse rows of all texts, one after another."""
    tokens, at = hashed(texts, by_kind=True)
    doc = np.repeat(np.arange(len(texts)), np.diff(at))
    inner = np.flatnonzero(doc[1:] == doc[:-1])
    pairs = mixed(tokens[inner] * np.uint64(3) + tokens[inner + 1])
    shift = np.uint64(64 - BUCKET_BITS)
    keys = np.concatenate([doc << BUCKET_BITS | (tokens >> shift).astype(np.int64), doc[inner] << BUCKET_BITS | (pairs >> shift).astype(np.int64)])
    keys, counts = np.unique(keys, return_counts=True)
    offsets = np.searchsorted(keys, np.arange(len(texts) + 1) << BUCKET_BITS)
    values = counts.astype(float)
    squares = np.concatenate([[0.0], np.cumsum(values * values)])
    norm = np.sqrt(np.maximum(squares[offsets[1:]] - squares[offsets[:-1]], 1e-12))
    return keys & ((1 << BUCKET_BITS) - 1), values / np.repeat(norm, np.diff(offsets)), offsets


class Ftrl:
    """FTRL-proximal logistic regression; the last coordinate is the bias."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, i=slice(None)) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, i: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(i)
        g = (1 / (1 + np.exp(-float(w @ x))) - y) * x
        grown = self.n[i] + g * g
        self.z[i] += g - (np.sqrt(grown) - np.sqrt(self.n[i])) / ALPHA * w
        self.n[i] = grown


def train(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    model = Ftrl(1 << BUCKET_BITS)
    for _ in range(EPOCHS):
        for buckets, values, label in rows:
            model.learn(np.append(buckets, 1 << BUCKET_BITS), np.append(values, 1.0), label)
    return model.weights()


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = MAX_TRAIN, max_features: int = MAX_FEATURES) -> np.ndarray:
    """Weights learned from at most max_train rows of labels (id, 0 or 1), taken in order of the id's hash until their
    texts (and one more) have max_features features: a text has two at most for each of its tokens.

    Rows without an id or label, or without a document, are passed over; of repeated labels the largest counts, of
    documents that share an id the one of most features. No row at all gives zero weights, so every text scores one
    half.
    """
    key = labels.select(F.col(id_col).cast("long").alias("i"), F.col(label_col).cast("int").alias("y")).dropna()
    key = key.groupBy("i").agg(F.max("y").alias("y")).orderBy(F.xxhash64("i"), "i").limit(max_train)
    texts = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("text"))
    texts = texts.join(F.broadcast(key), "i")  # max_train rows

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw in parts(batch, 1):
                b, v, at = features(raw)
                buckets, values = pa.array(b.astype(np.int32)), pa.array(v.astype(np.float32))
                lists = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), x) for x in (buckets, values)]
                yield pa.record_batch([part.column(0), part.column(2), *lists], ["i", "y", "b", "v"])

    told = texts.mapInArrow(sparse, "i long, y int, b array<int>, v array<float>")
    once = told.groupBy("i").agg(F.max(F.struct(F.size("b").alias("n"), "b", "v", "y")).alias("r"))  # one row an id, however often it comes
    found = saved(once.select("i", "r.n", "r.b", "r.v", "r.y"), "labelled")
    ids, n = (c.to_numpy() for c in found.select("i", "n").toArrow().columns)  # max_train rows
    by = np.argsort(mixed(ids.view(np.uint64)), kind="stable")
    ids = ids[by][: int(np.searchsorted(np.cumsum(n[by]), max_features, "right")) + 1].tolist()
    chosen = docs.sparkSession.createDataFrame([(i,) for i in ids], "i long")
    rows = found.join(F.broadcast(chosen), "i", "left_semi").toArrow()  # max_train rows, max_features features (and one more row)
    of = {i: k for k, i in enumerate(rows.column("i").to_pylist())}
    lists = [rows.column(c) for c in "bv"]
    row = lambda k: [np.asarray(x[k].values) for x in lists]  # noqa: E731  views of the table
    labels_ = rows.column("y")
    weights = train([(*row(of[i]), labels_[of[i]].as_py()) for i in ids])
    del rows, lists, labels_
    pa.default_memory_pool().release_unused()
    return weights


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text") -> DataFrame:
    """docs and __score: the probability of label 1 of each whole text. Null and empty texts score the bias, repeated rows
    score alike. A column of docs named __score is replaced."""
    docs, schema = added(docs, "__score", "double")
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))  # 2**BUCKET_BITS + 1 floats
    at_text = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value.astype(float)
        for batch in batches:
            for part, raw in parts(batch, at_text):
                b, v, offsets = features(raw)
                sums = np.add.reduceat(np.append(w[b] * v, 0.0), offsets[:-1])
                out = np.where(np.diff(offsets) > 0, sums, 0.0) + w[-1]
                yield pa.record_batch([*part.columns, pa.array(1 / (1 + np.exp(-out)))], [*part.schema.names, "__score"])

    return docs.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def quality_model(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Weights from the labelled rows that are not held out."""
    return fit(docs, labels.filter(~held_out()))


def op2_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = quality_model(docs, table(spark, sf_dir, "labels"))
    scored = score(docs, weights).select("doc_id", held_out().alias("held_out"), F.col("__score").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= KEEP_AT).cast("int"))
