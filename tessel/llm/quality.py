"""Quality classifier: logistic regression on hashed word n-grams, trained with FTRL-proximal updates, scored as sparse dot products.

A word counts under two views: its bytes, and its shape (letter case, digits, kind of trailing signs, equal to the word before or not).
Of words the n-grams of one and two, of shapes those of one to three are hashed to one table of weights. A document's value at a feature is its count over the
number of the document's n-grams of that kind, so length alone says nothing. Labels train the weights and nothing else reads them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import blocks as B
from .store import materialize

BITS = 18
#: The classifier is fitted on at most so many labelled rows, those of least hash.
FIT_ROWS = 8192
BLOCK = 1 << 20
EPOCHS, ALPHA, BETA, L1, L2 = 4, 1.0, 1.0, 1e-4, 1e-3

_KIND = np.full(256, 5, np.uint8)  # 0 lower, 1 upper, 2 digit, 3 a byte over 127, 4 full stop or comma, 5 other
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:], _KIND[[46, 44]] = 0, 1, 2, 3, 4


def _shapes(w: B.Words, h: np.ndarray) -> np.ndarray:
    """A small number for each word: which kinds of bytes it has at its start (two bytes, of a word of one byte that one twice), its end, anywhere,
    and whether it repeats the word before. Nothing outside the word and the one before it in its text counts."""
    k = _KIND[w.data]
    at = lambda i: k[np.minimum(i, len(k) - 1)]
    n = w.ends - w.starts
    any_of = np.bitwise_or.reduceat(np.left_shift(1, k, dtype=np.uint8), np.stack([w.starts, np.minimum(w.ends, len(k) - 1)], 1).ravel())[::2] if len(w) else np.zeros(0, np.uint8)
    if len(w) and w.ends[-1] == len(k) and n[-1] >= 1:  # the last span has no end marker of its own
        any_of[-1] = np.bitwise_or.reduce(np.left_shift(1, k[w.starts[-1] :], dtype=np.uint8))
    again = np.zeros(len(w), np.int64)
    if len(w) > 1:
        again[1:] = h[1:] == h[:-1]
        again[w.first[:-1][w.first[:-1] < len(w)]] = 0
    first, second, last = at(w.starts).astype(np.int64), at(np.where(n > 1, w.starts + 1, w.starts)).astype(np.int64), at(w.ends - 1).astype(np.int64)
    caps = (any_of & 1 == 0) & (any_of & 2 != 0)
    longer = (n > 1).astype(np.int64)
    noise = any_of >> 5
    return ((((first * 6 + second) * 6 + last) * 2 + caps) * 2 + noise) * 4 + longer * 2 + again


def features(w: B.Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind of n-gram: the table index of every n-gram of the block, and the first one of each document (len+1)."""
    h = w.hashes()
    shape = B.mix(_shapes(w, h).astype(B.U) + B.U(0xA5A5A5A5))
    count = np.diff(w.first)
    for view, seq, sizes in ((1, h, (1, 2)), (2, shape, (1, 2, 3))):
        for size in sizes:
            n = np.maximum(count - size + 1, 0)
            begin = np.concatenate([[0], np.cumsum(n)])
            at = np.repeat(w.first[:-1] - begin[:-1], n) + np.arange(begin[-1])
            s = np.full(len(at), B.U(view * 16 + size))
            for i in range(size):
                s = s * B.U(0xD6E8FEB86659FD93) + seq[at + i]
            yield (B.mix(s) >> B.U(64 - BITS)).astype(np.int64), begin


def score_block(texts: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    """Probability of label 1 for each text."""
    z = np.full(len(texts), bias)
    for idx, begin in features(B.Words(texts, lower=False)):
        n = np.diff(begin)
        # A sum for each text by itself, so that what stands before it in the block leaves no trace in the last digits.
        z += np.bincount(np.repeat(np.arange(len(n)), n), weights[idx].astype(float), len(n)) / np.maximum(n, 1)
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def sparse(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted feature indices and values of each text."""
    kinds = list(features(B.Words(texts, lower=False)))
    out = []
    for i in range(len(texts)):
        idx = [k[b[i] : b[i + 1]] for k, b in kinds]
        val = [np.full(len(x), 1 / len(x)) if len(x) else np.zeros(0) for x in idx]
        u, where = np.unique(np.concatenate(idx), return_inverse=True)
        out.append((u, np.bincount(where, np.concatenate(val), len(u)) if len(u) else np.zeros(0)))
    return out


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias after FTRL-proximal updates, one row at a time in the given order; both labels weigh the same in sum."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    share = labels.mean() if len(labels) else 0.5
    cost = np.where(labels == 1, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9)) if 0 < share < 1 else np.ones(len(labels))

    def weight(i):
        return np.where(np.abs(z[i]) <= L1, 0.0, -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for epoch in range(epochs):
        for r in np.random.default_rng(epoch).permutation(len(rows)):
            i, x = rows[r]
            i, x = np.append(i, 1 << BITS), np.append(x, 1.0)
            w = weight(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -40, 40)))
            g = (p - labels[r]) * cost[r] * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    w = weight(np.arange((1 << BITS) + 1))
    return w[:-1], float(w[-1])


@B.trimmed
def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, labels, keys = [], [], []
    for batch in batches:
        for part in B.cut(batch, "text", BLOCK):
            rows += sparse(part.column("text"))
            labels += part.column("label").to_pylist()
            keys += part.column("key").to_pylist()
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    w, bias = ftrl([rows[i] for i in order], np.array(labels, float)[order])
    yield pa.RecordBatch.from_arrays([pa.array([w.astype(np.float32).tobytes()]), pa.array([bias])], ["weights", "bias"])


def fold(column: str = "doc_id", parts: int = 3):
    """crc32 of doc_id as text, modulo parts; null ids fall in no fold."""
    return F.crc32(F.col(column).cast("string")) % parts


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, held_out: int = 1) -> tuple[np.ndarray, float]:
    """Weights and bias learned from the labelled rows outside the held-out fold.

    Of these the fit_rows ids of least hash are used (all, if there are fewer); their texts, whole, go to one task. A doc_id with labels that
    differ takes their rounded mean, and rows that share a doc_id give its least text; labels that are null, or without a document, are left out; without any label all weights are 0."""
    chosen = (
        labels.filter(F.col("quality").isNotNull() & (fold() != held_out))
        .groupBy("doc_id").agg(F.round(F.avg("quality")).cast("double").alias("label"))
        .select("doc_id", "label", F.xxhash64("doc_id").alias("key"))
        .orderBy("key", "doc_id").limit(fit_rows)
    )
    chosen = materialize(chosen, "labels")
    # At most fit_rows ids are broadcast.
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label", "key").agg(F.min("text").alias("text"))
    got = sample.select("text", "label", "key").coalesce(1).mapInArrow(_fit, "weights binary, bias double").collect()
    if not got:
        return np.zeros(1 << BITS, np.float32), 0.0
    return np.frombuffer(got[0]["weights"], np.float32), got[0]["bias"]


def score(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text", into: str = "score") -> DataFrame:
    """docs with the probability of label 1 added; null and empty texts get the bias's. A column of that name is replaced.

    The model is one table of 2**BITS numbers, whatever the input."""
    docs = docs.drop(into)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*docs.schema.fields, StructField(into, DoubleType())])
    fields = [f.name for f in schema.fields]

    @B.trimmed
    def run(batches):
        weights, bias = shared.value
        for batch in batches:
            for part in B.cut(batch, text, BLOCK):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score_block(part.column(text), weights, bias))], fields)

    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """docs with held_out, score and predicted (1 where score >= 0.5).

    held_out: crc32(doc_id as text) mod 3 is 1; such labels are never learned from. Defined cases: a null doc_id is not held out; null and empty
    texts get the bias's score; equal texts get equal scores wherever they stand; an empty table gives no rows; columns of docs with the names added
    here are replaced, all others stay."""
    scored = score(docs.drop("held_out", "predicted"), train(docs, labels, fit_rows))
    return scored.withColumn("held_out", F.coalesce(fold() == 1, F.lit(False))).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
