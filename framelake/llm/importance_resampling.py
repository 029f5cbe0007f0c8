"""Importance resampling of documents towards a target text collection.

* **Weights.**  Words and word runs are hashed features in a fixed number of buckets.  One pass counts the buckets
  of the documents and of the target texts (sums per task, then per bucket); the gain of a bucket is the
  logarithm of the ratio of its smoothed shares.  The gains are one array of ``BUCKETS`` numbers at any corpus
  size; a second pass adds them up per document.
* **Draw.**  The largest scores (weight plus Gumbel noise that depends on the id alone) are drawn, which is a
  draw without replacement in proportion to ``exp(weight / SCALE)``.
* **Cutoff.**  A mergeable quantile sketch brackets the cutoff.  Exact counts above and inside the bracket
  prove that the cutoff lies in it, or the bracket is widened.  Only the rows of the bracket are sorted to find
  the last row drawn; the rows above it are drawn as they are and get their ranks by key ranges.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.keyed import global_index
from framelake.llm.common import arrow_rows, rows_in
from framelake.scratch import checkpointed

BUCKETS, NGRAMS, SCALE, SEED = 10_000, 1, 1000, 2024
LEAST_WORDS, PERCENT = 20, 10
ACCURACY = 2_000  # the sketch is wrong by at most one in so many rows
KEPT_WORDS = 1 << 18  # words whose bucket a task remembers at a time

# letters in lower case, digits and all bytes beyond ASCII stay; everything else separates words
_PLAIN = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()


def word_list(text: str | None) -> list[bytes]:
    """Words of a whole text in order (null: none), A-Z in lower case."""
    return (text or "").encode().translate(_PLAIN).split()


class _Known(dict):
    """Bucket of a word, remembered."""

    def __init__(self, buckets: int):
        super().__init__()
        self._buckets = buckets

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        found = self[word] = crc32(word) % self._buckets
        return found


def feature_buckets(ngrams: int = NGRAMS, buckets: int = BUCKETS) -> Callable[[list[bytes]], np.ndarray]:
    """A function from words to the buckets of all their features, repeats included."""
    known = _Known(buckets)

    def found(words: list[bytes]) -> np.ndarray:
        single = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        if ngrams == 1:
            return single
        longer = [
            np.fromiter((crc32(b" ".join(words[i:i + n])) % buckets for i in range(len(words) - n + 1)), np.int64, max(0, len(words) - n + 1))
            for n in range(2, ngrams + 1)
        ]
        return np.concatenate([single, *longer])

    return found


def bucket_counts(texts: DataFrame, ngrams: int = NGRAMS, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket; every task sends at most one row per bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, total = feature_buckets(ngrams, buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for (text,) in rows_in(batch):
                total += np.bincount(features(word_list(text)), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    counted = texts.select("text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in counted.collect():  # at most ``buckets`` rows
        out[bucket] = n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * ln(share in the target / share in the source)) of every bucket, one added to each count."""
    n, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([
        math.floor(scale * math.log(float((t + 1) * (s_all + n)) / float((s + 1) * (t_all + n))))
        for s, t in zip(source.tolist(), target.tolist(), strict=True)
    ], np.int64)


def noise(doc_id: int | None, seed: int = SEED, scale: int = SCALE) -> int:
    """Gumbel noise of an id (no id: of the empty text), the same in every run."""
    h = int(sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-scale * math.log(-math.log((h + 0.5) / 4294967296)))


def scored_documents(docs: DataFrame, gains: np.ndarray, ngrams: int = NGRAMS, seed: int = SEED, scale: int = SCALE) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of every row."""
    buckets = len(gains)
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "n_words", "n_features", "weight", "score")])

    def row() -> Callable[..., tuple]:
        features = feature_buckets(ngrams, buckets)

        def one(doc_id: int | None, text: str | None) -> tuple:
            words = word_list(text)
            found = features(words)
            weight = int(gains[found].sum())
            return doc_id, len(words), len(found), weight, weight + noise(doc_id, seed, scale)

        return one

    return arrow_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), row, ["doc_id", "text"], schema)


def cutoff_bracket(scores: DataFrame, n: int, wanted: int, accuracy: int = ACCURACY) -> tuple[int | None, int | None, int]:
    """(low, high, rows above high): the ``wanted``-th largest ``score`` is proven to be in low..high; None is open.

    ``n``: rows of ``scores``; 0 < wanted <= n.  A bracket that the exact counts refute is made eight times wider.
    """
    width = 2.0 / accuracy
    while True:
        at = 1.0 - wanted / n
        ends = [at - width, at + width]
        asked = [min(1.0, max(0.0, p)) for p in ends]
        found = scores.agg(F.percentile_approx("score", asked, accuracy)).first()[0]
        low = found[0] if ends[0] > 0 else None
        high = found[1] if ends[1] < 1 else None
        above = F.col("score") > high if high is not None else F.lit(False)
        inside = ~above & (F.col("score") >= low if low is not None else F.lit(True))
        n_above, n_inside = scores.agg(F.count_if(above), F.count_if(inside)).first()
        if n_above < wanted <= n_above + n_inside:
            return low, high, n_above
        width *= 8


def _ranked(rows: DataFrame, n: int, after: int) -> DataFrame:
    """``rows`` with ``rank``: ``after`` + 1, ``after`` + 2, ... by falling score, then id; ``n``: how many rows they are."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # rows that are equal in all columns are told apart by their place in the computed table, so that ranges stay even
    keyed = rows.withColumns({"_down": -F.col("score"), "_nameless": F.col("doc_id").isNull(), "_row": F.monotonically_increasing_id()})
    order = ["_down", "_nameless", "doc_id", "weight", "n_features", "_row"]
    return global_index(keyed, order, "rank", after + 1, min(1_000_000, max(1, -(-n // parts)))).drop("_down", "_nameless", "_row")


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, ngrams: int = NGRAMS,
              buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row of ``docs``; rows that are not drawn have a null rank.

    Of the documents with at least ``least_words`` words, ``percent`` per cent (rounded down) with the largest scores
    are drawn; ties go to the smaller id, no id last, then to the smaller weight and the fewer features.  A null or empty text has no
    features and weight 0.  A repeated row is a row of its own (equal rows share noise and score).  Empty tables
    of documents give an empty result, an empty target gives every document the same kind of small gains.  Only doc_id and
    text are read, so other columns cannot clash.
    """
    gains = bucket_gains(bucket_counts(docs, ngrams, buckets), bucket_counts(target, ngrams, buckets))
    scored = checkpointed(scored_documents(docs, gains, ngrams, seed))
    may = F.col("n_words") >= least_words
    n = scored.where(may).count()
    wanted = percent * n // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if not wanted:
        return scored.select(*columns, none)
    low, high, above = cutoff_bracket(scored.where(may).select("score"), n, wanted)
    over = may & (F.col("score") > high if high is not None else F.lit(False))
    inside = may & ~over & (F.col("score") >= low if low is not None else F.lit(True))
    in_bracket = scored.where(inside).select(*columns)
    sorted_bracket = _ranked(in_bracket, in_bracket.count(), above)
    drawn = [sorted_bracket.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))]
    if above:
        drawn.append(_ranked(scored.where(over).select(*columns), above, 0))
    out = scored.where(~over & ~inside).select(*columns, none)
    for part in drawn:
        out = out.unionByName(part)
    return out
