"""Quality classifier: random-indexing word vectors, pooled per document, under a two-layer network.

Every unit of a text (a word, its last letters, the shape of its ending) owns a bucket of a fixed
table and a sparse random index vector. The context vector of a bucket is the sum of the index
vectors of the neighbours of all its words over the whole corpus, so it depends on no label. A
document is the mean of its units' normalised context vectors and index vectors. A network with one
hidden layer is fitted to a bounded sample of labelled rows, and a temperature found on rows set
aside calibrates its probabilities.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import crc_mod, materialize, table

#: Size of the context table: rows (buckets) and columns.
BUCKETS, DIM = 1 << 13, 24
#: Rows of the table that travel together when partial tables are summed.
CHUNK = 512
NEIGHBOURS = (1, 2)
#: At most so many labelled rows are used to fit the network (documented bound of the sample).
TRAIN_ROWS = 12_000
THRESHOLD = 0.3

#: Letters, digits and white space become one sign of their class each; other signs stay.
_SHAPE = bytearray(range(256))
for _c in range(256):
    if 97 <= _c <= 122 or _c >= 128:
        _SHAPE[_c] = ord("a")
    elif 65 <= _c <= 90:
        _SHAPE[_c] = ord("A")
    elif 48 <= _c <= 57:
        _SHAPE[_c] = ord("0")
SHAPE = bytes(_SHAPE)


def _bucket_units(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the words, of their endings and of the shapes of their endings, in text order."""
    crc, mask = zlib.crc32, BUCKETS - 1
    found = data.lower().split()
    word = np.array([crc(w) & mask for w in found], np.int64)
    ending = np.array([crc(w[-3:], 1) & mask for w in found], np.int64)
    shape = np.array([crc(w[-3:], 2) & mask for w in data.translate(SHAPE).split()], np.int64)
    return word, ending, shape


def _index_vectors() -> np.ndarray:
    """Sparse ternary index vector of every bucket (two +1 and two -1), fixed by a seed."""
    rng, out = np.random.default_rng(20240229), np.zeros((BUCKETS, DIM), np.float32)
    places = rng.random((BUCKETS, DIM)).argsort(axis=1)[:, :4]
    np.put_along_axis(out, places, np.array([1, 1, -1, -1], np.float32), axis=1)
    return out


def _context_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial context tables: for each batch of texts, sums of neighbours' index vectors by bucket."""
    index = _index_vectors()
    places = [np.flatnonzero(row) for row in index]
    where = np.array(places, np.int64)
    signs = np.take_along_axis(index, where, axis=1).astype(np.float64)
    total = np.zeros(BUCKETS * DIM)

    def add(units: np.ndarray, words: np.ndarray, far: int) -> None:
        for a, b in ((units[:-far], words[far:]), (units[far:], words[:-far])):
            for k in range(4):
                np.add(total, np.bincount(a * DIM + where[b, k], signs[b, k], BUCKETS * DIM), out=total)

    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def flush() -> None:
        pad = np.full(max(NEIGHBOURS), 0, np.int64)
        if not held:
            return
        word = np.concatenate([x for u in held for x in (u[0], pad)])
        for far in NEIGHBOURS:
            add(word, word, far)
        ending = np.concatenate([x for u in held for x in (u[1], pad)])
        shape = np.concatenate([x for u in held for x in (u[2], pad)])
        add(ending, word, 1)
        add(shape, word, 1)
        held.clear()

    for batch in batches:
        for text in batch["text"]:
            units = _bucket_units((text or "").encode("utf-8", "surrogatepass"))
            held.append(units)
            size += len(units[0])
            if size >= 1 << 19:
                flush()
                size = 0
    flush()
    rows = total.reshape(BUCKETS, DIM)
    yield pd.DataFrame(
        {"chunk": range(BUCKETS // CHUNK), "sums": [rows[at : at + CHUNK].tobytes() for at in range(0, BUCKETS, CHUNK)]}
    )


def _sum_chunks(key: tuple[Any, ...], parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sum of one chunk's partial tables; they arrive in batches, so memory holds a few at a time."""
    total = np.zeros(CHUNK * DIM)
    for part in parts:
        for blob in part["sums"]:
            total += np.frombuffer(blob, np.float64)
    yield pd.DataFrame({"chunk": [key[0]], "sums": [total.tobytes()]})


def context_table(docs: DataFrame) -> np.ndarray:
    """Word vectors (BUCKETS x 2*DIM float32): own index vector beside the normalised context vector.

    Every text of ``docs`` counts. Its size is fixed by BUCKETS and DIM whatever the corpus, so it
    may be sent to the driver and to every task.
    """
    parts = docs.select("text").mapInPandas(_context_batches, "chunk int, sums binary")
    # a first round over salted groups keeps the second one's input small for any number of tasks
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("sums"), F.lit(16)))
    once = salted.groupBy("chunk", "salt").applyInPandas(_sum_chunks, "chunk int, sums binary")
    rows = once.groupBy("chunk").applyInPandas(_sum_chunks, "chunk int, sums binary").collect()
    context = np.zeros((BUCKETS, DIM))
    for row in rows:
        context[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = np.frombuffer(row["sums"], np.float64).reshape(CHUNK, DIM)
    scale = np.linalg.norm(context, axis=1, keepdims=True)
    return np.hstack([_index_vectors() / 2, context / np.maximum(scale, 1e-9)]).astype(np.float32)


def pooled(text: str | None, vectors: np.ndarray) -> np.ndarray:
    """Mean word vector of a text for each kind of unit, and the logarithm of its number of words."""
    units = _bucket_units((text or "").encode("utf-8", "surrogatepass"))
    n = len(units[0])
    if not n:
        return np.zeros(3 * vectors.shape[1] + 2, np.float32)
    means = []
    for u in units:
        counts = np.bincount(u)
        held = np.flatnonzero(counts)
        means.append(counts[held].astype(np.float32) @ vectors[held] / n)
    distinct = len(np.unique(units[0])) / n
    return np.concatenate([*means, [np.log1p(n) / 8, distinct]]).astype(np.float32)


@dataclass
class Network:
    """Standardised inputs -> tanh hidden layer -> one logit, divided by a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 60, seed: int = 7) -> Network:
    """Adam on the cross-entropy; every fifth row is set aside for the temperature."""
    if not len(x):
        width = x.shape[1] if x.ndim == 2 else 0
        return Network(np.zeros(width), np.ones(width), np.zeros((width, hidden)), np.zeros(hidden), np.zeros(hidden), 0.0)
    rng = np.random.default_rng(seed)
    aside = np.arange(len(x)) % 5 == 4
    fit_x, fit_y = (x[~aside], y[~aside]) if len(x) >= 50 else (x, y)
    mean, scale = fit_x.mean(0), fit_x.std(0) + 1e-3
    net = Network(mean, scale, rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), 0.0)
    z = (fit_x - mean) / scale
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(z)), max(1, len(z) // 256)):
            a = np.tanh(z[rows] @ params[0] + params[1])
            p = 1 / (1 + np.exp(-np.clip(a @ params[2] + params[3], -40, 40)))
            d = (p - fit_y[rows]) / len(rows)
            back = np.outer(d, params[2]) * (1 - a * a)
            grads = [z[rows].T @ back + 1e-4 * params[0], back.sum(0), a.T @ d + 1e-4 * params[2], d.sum(keepdims=True)]
            step += 1
            for k, g in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                params[k] -= 0.005 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    if len(x) >= 50:
        logits, truth = net.logits(x[aside]), y[aside]
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
        net.temperature = float(min(grid, key=lambda t: np.mean(np.logaddexp(0, logits / t) - truth * logits / t)))
    return net


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Network:
    """Fit the classifier. Labels count only where crc32(doc_id) mod 5 is not 0; of these the
    ``train_rows`` first by a hash of the id are used. Null labels and ids are passed over. An id with several
    labels has the greatest, and one with several texts is learned from the text whose vector comes first, so
    at most ``train_rows`` vectors of fixed size reach the driver."""
    vectors = context_table(docs)
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), 5) != 0))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most train_rows ids

    def vector(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "quality": b["quality"], "x": [pooled(t, vectors).tobytes() for t in b["text"]]})

    rows = chosen.mapInPandas(vector, "doc_id long, quality int, x binary").groupBy("doc_id", "quality").agg(F.min("x").alias("x"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    x = np.array([np.frombuffer(r["x"], np.float32) for r in rows]).astype(np.float64)
    net = fit_network(x if len(rows) else np.zeros((0, 0)), np.array([float(r["quality"] == 1) for r in rows]))
    net.vectors = vectors
    return net


def score_udf(net: Network):
    """Scalar UDF text -> probability of label 1; the model's size is fixed by its parameters."""
    if not net.w1.size:
        return lambda text: F.lit(0.5)

    @pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            x = np.array([pooled(t, net.vectors) for t in batch], np.float64)
            yield pd.Series(net.probability(x) if len(x) else np.empty(0))

    return score


RESULTS = ("held_out", "score", "predicted")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """documents, labels -> the documents with ``held_out``, ``score`` and ``predicted``.

    A document's own columns of these names are kept as ``own_held_out`` and so on. Null and empty texts have no
    units and get the score of the zero vector. Without usable labels every score is 0.5. Repeated ids are scored
    row by row; ``score`` depends on the text alone, and very long texts are read whole. A null id counts
    as the empty text for ``held_out``. An empty table gives no rows.
    """
    net = fit(docs, labels)
    own = [F.col(f"`{c}`").alias(f"own_{c}" if c in RESULTS else c) for c in docs.columns]
    score = score_udf(net)("text")
    out = docs.select(*own, (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier accepts, with their own columns.

    Every row is judged by its text alone, so rows that repeat an id or a text fare alike. Null and empty texts
    have the score of the zero vector. Without usable labels all rows stay; an empty table stays empty.
    """
    net = fit(docs, labels)
    return docs.where(score_udf(net)("text") >= THRESHOLD)


def op10(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
