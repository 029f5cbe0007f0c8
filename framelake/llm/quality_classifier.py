"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

*Random indexing.*  Every word has a fixed sparse vector of a few +1 and -1, drawn from its hash.  Its
context vector is the sum, over the whole corpus, of the sparse vectors of its neighbours, those on
the left and on the right with different positions.  Words share ``buckets`` rows by hash, so the table
has a fixed size and no word is left out.  Sums are integers: the order of tasks does not matter.

*Pooling.*  A document is the mean of its words' vectors, frequent words weighing less.

*Network.*  One hidden layer, trained by numpy on a bounded sample of labelled documents; a
temperature fitted on rows that training did not see calibrates the probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.llm.common import held_out, labelled_sample
from framelake.scratch import checkpointed

BUCKETS, DIMENSIONS, NONZERO = 1 << 14, 64, 4
SIGNS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
WORDS_AT_ONCE = 1 << 19


def word_buckets(text: str | None, buckets: int = BUCKETS) -> list[int]:
    """Buckets of the words of a text; signs at the end of a word are a word of their own."""
    out = []
    for word in (text or "").encode().split():
        bare = word.rstrip(SIGNS)
        if bare:
            out.append(crc32(bare) % buckets)
        if len(bare) != len(word):
            out.append(crc32(word[len(bare):]) % buckets)
    return out


def index_vectors(buckets: int = BUCKETS, dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero entries of every bucket's sparse vector."""
    rng = np.random.default_rng(20240)
    places = rng.integers(0, dimensions, (buckets, NONZERO))
    signs = rng.integers(0, 2, (buckets, NONZERO)) * 2 - 1
    return places, signs


def _joined(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All buckets in one array, and for each the number of its document."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.fromiter((b for one in lists for b in one), np.int64, int(sizes.sum()))
    return flat, np.repeat(np.arange(len(lists)), sizes)


def context_sums(docs: DataFrame, buckets: int = BUCKETS, dimensions: int = DIMENSIONS) -> DataFrame:
    """``bucket``, ``n`` (words) and ``sums`` (context vector): partial sums per task, then one row per bucket."""
    width = dimensions + 1
    schema = pa.schema([("bucket", pa.int32()), ("part", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors(buckets, dimensions)
        total = np.zeros((buckets, width), np.int64)
        flat_total = total.reshape(-1)

        def add(lists: list[list[int]]) -> None:
            words, owner = _joined(lists)
            np.add(flat_total, np.bincount(words * width + dimensions, minlength=buckets * width), out=flat_total)
            near = np.flatnonzero(owner[1:] == owner[:-1])
            for word, other, shift in ((words[near], words[near + 1], 0), (words[near + 1], words[near], 1)):
                for k in range(NONZERO):
                    at = word * width + (places[other, k] + shift) % dimensions
                    np.add(flat_total, np.bincount(at, signs[other, k], buckets * width).astype(np.int64), out=flat_total)

        waiting, size = [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = word_buckets(text, buckets)
                waiting.append(found)
                size += len(found)
                if size >= WORDS_AT_ONCE:
                    add(waiting)
                    waiting, size = [], 0
        if waiting:
            add(waiting)
        used = np.flatnonzero(total[:, dimensions])
        for begin in range(0, len(used), 4096):
            rows = used[begin:begin + 4096]
            values = pa.array(total[rows].reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * width), values)
            yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), lists], schema=schema)

    parts = docs.select("text").mapInArrow(run, "bucket int, part array<bigint>")
    summed = parts.groupBy("bucket").agg(*[F.sum(F.col("part")[k]).alias(f"s{k}") for k in range(width)])
    return summed.select("bucket", F.col(f"s{dimensions}").alias("n"), F.array(*[f"s{k}" for k in range(dimensions)]).alias("sums"))


def word_vectors(sums: DataFrame, buckets: int = BUCKETS, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Weighted unit vectors, one row per bucket; the last column is the weight.  At most ``buckets`` rows reach the driver."""
    rows = sums.toArrow()
    places, signs = index_vectors(buckets, dimensions)
    context = np.zeros((buckets, dimensions))
    count = np.zeros(buckets)
    at = rows.column("bucket").to_numpy()
    if len(at):
        context[at] = np.array(rows.column("sums").to_pylist(), dtype=np.float64)
        count[at] = rows.column("n").to_numpy()
    own = np.zeros((buckets, dimensions))
    np.add.at(own, (np.arange(buckets)[:, None], places), signs)
    vectors = context / np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-12)
    vectors += own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-12)
    weight = 1e-2 / (1e-2 + count / max(1.0, count.sum()))
    return np.hstack([vectors * weight[:, None], weight[:, None]]).astype(np.float32)


def pooled(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """``doc_id`` and ``features``: the weighted mean vector, its length and the log of the word count (no words: zeros)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vectors)  # buckets x (dimensions + 1) floats
    width = vectors.shape[1] + 1
    schema = pa.schema([("doc_id", pa.int64()), ("features", pa.list_(pa.float32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            out = np.zeros((batch.num_rows, width), np.float32)
            for k, text in enumerate(batch.column(1).to_pylist()):
                found = word_buckets(text, len(table))
                if found:
                    mean = np.zeros(table.shape[1], np.float64)
                    for begin in range(0, len(found), 1 << 16):
                        mean += table[found[begin:begin + (1 << 16)]].sum(0, dtype=np.float64)
                    mean /= mean[-1]
                    out[k, :-2], out[k, -2], out[k, -1] = mean[:-1], np.linalg.norm(mean[:-1]), np.log1p(len(found)) / 10
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * width), pa.array(out.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, features array<float>")


@dataclass
class Network:
    """tanh hidden layer, one output, divided by a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, batch: int = 256, rate: float = 3e-3) -> Network:
    """Adam on four fifths of the rows, the temperature on the rest.  No rows: a network that says one half."""
    n, d = x.shape
    rng = np.random.default_rng(7)
    net = Network(np.zeros(d), np.ones(d), rng.normal(0, 1 / np.sqrt(d), (d, hidden)), np.zeros(hidden), np.zeros(hidden), 0.0)
    if not n:
        return net
    net.mean, net.scale = x.mean(0), x.std(0) + 1e-6
    net.w2 = rng.normal(0, 1 / np.sqrt(hidden), hidden)
    calibration = np.arange(n) % 5 == 4
    xs, ys = (x[~calibration] - net.mean) / net.scale, y[~calibration].astype(float)
    values = [net.w1, net.b1, net.w2, np.zeros(1)]
    moments = [[np.zeros_like(v), np.zeros_like(v)] for v in values]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(xs))
        for begin in range(0, len(xs), batch):
            pick = order[begin:begin + batch]
            a = np.tanh(xs[pick] @ values[0] + values[1])
            error = (1 / (1 + np.exp(-(a @ values[2] + values[3]))) - ys[pick]) / len(pick)
            back = np.outer(error, values[2]) * (1 - a * a)
            slopes = [xs[pick].T @ back + 1e-4 * values[0], back.sum(0), a.T @ error + 1e-4 * values[2], np.array([error.sum()])]
            step += 1
            for value, (m, v), slope in zip(values, moments, slopes, strict=True):
                m += 0.1 * (slope - m)
                v += 0.001 * (slope * slope - v)
                value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = values[0], values[1], values[2], float(values[3][0])
    net.temperature = fit_temperature(net.logits(x[calibration]), y[calibration])
    return net


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """Temperature with the least log loss, by golden-section search on its logarithm (no rows: 1)."""
    if not len(y):
        return 1.0

    def loss(log_t: float) -> float:
        z = logits / np.exp(log_t)
        return float(np.mean(np.logaddexp(0, z) - y * z))

    low, high, g = np.log(0.2), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def quality_scores(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` for every document.

    Word statistics cover all documents.  The network learns ``quality`` from at most ``max_rows``
    labelled documents that are not held out; labels, lang, source and doc_id are no inputs.  One row
    per row, repeated rows included; null and empty texts are scored like a text without words.
    """
    features = checkpointed(pooled(docs, word_vectors(context_sums(docs))))
    sample = labelled_sample(features, labels, "quality", max_rows).select("doc_id", "features", "_label").toArrow().sort_by("doc_id")
    x = np.array(sample.column("features").to_pylist(), np.float64).reshape(len(sample), DIMENSIONS + 2)
    net = train(x, sample.column("_label").to_numpy())
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                flat = batch.column(1).flatten().to_numpy().astype(np.float64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(net.score(flat.reshape(batch.num_rows, -1)))], schema=schema)

    scored = features.mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
