"""Supervised quality classifier over hashed word and character n-grams.

A text is the average of learned vectors: one per word, per pair of neighbouring words and per run of
3 to 5 bytes inside a word (its ends marked by the space beside it), all hashed into one table. A
softmax over the average gives the class. Vectors and output weights are trained by stochastic
gradient descent in numpy. As the output is linear in the average, scoring needs one number per table
slot, so a model is a few megabytes whatever the corpus.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .tokens import SPACE, mix, slabs

SAMPLE_ROWS = 4_096  # labelled rows that training sees at most
SLOT_BITS = 18
DIMENSIONS = 8
EPOCHS = 8
RATE = 0.5
GRAMS = (3, 4, 5)


def _slot(codes: np.ndarray) -> np.ndarray:
    return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int32)


def features(texts):
    """Pieces (slots, text numbers), one after the other, so that no more than one is in memory."""
    words = texts.words()
    of = words.text_of()
    yield _slot(words.hash), of
    if len(of) > 1:
        same = of[1:] == of[:-1]
        pair = mix(words.hash[:-1] * np.uint64(3) + words.hash[1:])
        # a word said twice in a row is one feature, whatever the word
        pair[words.hash[:-1] == words.hash[1:]] = np.uint64(0xC2B2AE3D27D4EB4F)
        yield _slot(pair)[same], of[1:][same]
    data, n = texts.data, len(texts.data)
    gap = SPACE[data]
    wide = np.where(gap, np.uint8(32), data).astype(np.uint64)
    owner = np.repeat(np.arange(texts.n, dtype=np.int32), np.diff(texts.at))
    for k in GRAMS:
        if n < k:
            continue
        m = n - k + 1
        ok = owner[:m] == owner[k - 1 :]
        for j in range(1, k - 1):
            ok &= ~gap[j : j + m]
        code = np.full(m, np.uint64(k))
        for j in range(k):
            code = (code << np.uint64(8)) | wide[j : j + m]
        yield _slot(code[ok]), owner[:m][ok]


@dataclass
class Model:
    """`weight`: log-odds of class 1 that a slot adds; `bias`: of an empty text."""

    weight: np.ndarray
    bias: float

    def scores(self, texts) -> np.ndarray:
        total, count = np.zeros(texts.n), np.zeros(texts.n)
        for slots, of in features(texts):
            total += np.bincount(of, weights=self.weight[slots], minlength=texts.n)
            count += np.bincount(of, minlength=texts.n)
        return 1 / (1 + np.exp(-(self.bias + total / np.maximum(count, 1))))


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> Model:
    """Bags are (slots, share of each) per text."""
    rng = np.random.default_rng(seed)
    table = ((rng.random((1 << SLOT_BITS, DIMENSIONS), dtype=np.float32) - 0.5) / DIMENSIONS).astype(np.float32)
    out, bias = np.zeros((DIMENSIONS, 2), np.float32), np.zeros(2, np.float32)
    steps, done = max(1, epochs * len(bags)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            slots, share = bags[i]
            rate = np.float32(RATE * (1 - done / steps))
            done += 1
            rows = table[slots]
            mean = share @ rows
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = out @ p
            out -= rate * np.outer(mean, p)
            bias -= rate * p
            # each slot moves by its share, scaled up as the shares of a long text are minute
            table[slots] = rows - rate * np.outer(share / np.sqrt((share * share).sum() + 1e-12), back)
    return Model((table @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def _bags(texts) -> list[tuple[np.ndarray, np.ndarray]]:
    pieces = list(features(texts))
    slots, of = (np.concatenate([p[i] for p in pieces]) for i in (0, 1))
    key, n = np.unique(of.astype(np.int64) << SLOT_BITS | slots, return_counts=True)
    own = key >> SLOT_BITS
    at = np.searchsorted(own, np.arange(texts.n + 1))
    total = np.maximum(np.bincount(own, weights=n, minlength=texts.n), 1)
    return [
        ((key[a:b] & ((1 << SLOT_BITS) - 1)).astype(np.int32), (n[a:b] / total[i]).astype(np.float32))
        for i, (a, b) in enumerate(zip(at[:-1], at[1:]))
    ]


def _train(batches):
    got = []
    for batch in batches:
        ids, labels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lo, hi, texts in slabs(batch, fold=False):
            got += zip(ids[lo:hi], labels[lo:hi], _bags(texts))
    got.sort(key=lambda x: x[0])
    model = fit([x[2] for x in got], np.array([x[1] for x in got], int))
    yield pa.RecordBatch.from_arrays([pa.array([model.weight.tobytes()], pa.binary()), pa.array([model.bias])], names=["weight", "bias"])


def in_training(doc_id="doc_id"):
    """Rows whose labels may be learned from."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) != 1


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most `rows` labelled documents, taken by hash of the id. Without labels all scores are 0.5."""
    known = (
        labels.where("quality in (0, 1) and doc_id is not null")
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where(in_training())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id")
        .limit(rows)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    sample = texts.join(F.broadcast(known), "doc_id").select("doc_id", "quality", "text").limit(rows)
    row = sample.mapInArrow(_train, "weight binary, bias double").head()
    if row is None:
        return Model(np.zeros(1 << SLOT_BITS, np.float32), 0.0)
    return Model(np.frombuffer(bytes(row["weight"]), np.float32), row["bias"])


def score(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """`docs` with a score column; a null text scores as an empty one."""
    def run(batches):
        for batch in batches:
            for lo, hi, texts in slabs(batch, fold=False):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.scores(texts))], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(out, DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score, predicted."""
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train(docs, labels))
    return scored.select(
        "doc_id", F.coalesce(~in_training(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
