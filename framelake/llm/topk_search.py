"""Exact top-k search over quantised vectors with an impact-ordered, score-at-a-time index.

Components become integers ``floor(scale * x)``.  The index is cut into shards by a hash of the vector id.
In a shard every dimension has its postings ordered by value, so all vectors with the same value in a
dimension are one *segment* with one impact.  For a query, segments are processed by descending size of
their contribution ``|q_d * v|``; one addition per posting keeps both the partial score and, in its lowest bits, the
number of dimensions seen.  With ``c`` the next contribution, what a vector may still gain or lose is at most ``c`` times
its unseen dimensions, so lower and upper bounds follow.  The scan stops only when the vectors whose
upper bound reaches the k-th best lower bound are few; they are the only possible members, and all of
them are scored exactly.  Nothing is dropped without that proof, and when it never comes the scan ends
with all postings processed.

Blocks of queries meet shards in groups of bounded size; each group returns at most k rows per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCALE = 64.0
SHARD_ROWS, QUERY_ROWS = 16_384, 1_024
PROOFS = (0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 1.0)  # shares of the postings after which a proof is tried
POSTINGS_AT_ONCE = 1 << 17
FEW = 0.2  # possible members, as a share of the shard, that are cheaper to score than to wait for


def quantised(vectors: DataFrame, scale: float = SCALE) -> DataFrame:
    """``vec_id`` and ``v`` (array of long); vectors that are null or hold null or non-finite components are left out."""
    x = F.col("embedding").cast("array<double>")
    finite = F.col("embedding").isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(finite & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v")
    )


class Shard:
    """Postings of some vectors, ordered by value in every dimension."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray):
        self.ids, self.matrix = ids, matrix
        n, d = matrix.shape
        order = np.argsort(matrix, axis=0, kind="stable")
        self.postings = np.ascontiguousarray(order.T.astype(np.int32)).reshape(-1)  # dimension after dimension
        self.largest = np.abs(matrix).max(axis=0) if n else np.zeros(d, np.int64)
        begins, dims, values = [], [], []
        for k in range(d):
            column = matrix[order[:, k], k]
            at = np.flatnonzero(np.concatenate([[True], column[1:] != column[:-1]]))
            begins.append(at + k * n)
            dims.append(np.full(len(at), k))
            values.append(column[at])
        self.begins = np.concatenate(begins) if d else np.zeros(0, np.int64)
        self.ends = np.concatenate([self.begins[1:], [n * d]]) if d else np.zeros(0, np.int64)
        self.dims = np.concatenate(dims) if d else np.zeros(0, np.int64)
        self.values = np.concatenate(values) if d else np.zeros(0, np.int64)

    def best(self, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best vectors but the query's own, ties to the smaller id."""
        n, d = self.matrix.shape
        own = int(np.count_nonzero(self.ids == query_id))  # rows with the query's id are no candidates but take places
        possible = self._possible(q, k + own) if d and n > 4 * (k + own) else np.arange(n)
        scores = self.matrix[possible] @ q
        other = self.ids[possible] != query_id
        ids, scores = self.ids[possible][other], scores[other]
        order = np.lexsort((ids, -scores))[:k]
        return ids[order], scores[order]

    def _possible(self, q: np.ndarray, k: int) -> np.ndarray:
        """Vectors that may be among the k best; every other one is proven not to be."""
        n, d = self.matrix.shape
        gain = q[self.dims] * self.values
        size = np.abs(gain)
        order = np.argsort(-size, kind="stable")
        lengths = (self.ends - self.begins)[order]
        done = np.cumsum(lengths)
        bits = int(d).bit_length()
        most = int(np.abs(q) @ self.largest) + 1  # no partial score is larger
        exact = most << bits < 1 << 53  # a sum of both in one double
        weight = ((gain << bits) + 1 if exact else gain).astype(np.float64)
        total, partial, seen = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
        at = 0
        for share in PROOFS:
            stop = len(order) if share == 1.0 else int(np.searchsorted(done, done[-1] * share, "right"))
            if stop == at:
                continue
            while at < stop:  # postings of some segments at a time, so that they stay in the processor's cache
                before = int(done[at - 1]) if at else 0
                to = min(stop, max(at + 1, int(np.searchsorted(done, before + POSTINGS_AT_ONCE, "right"))))
                part, runs = order[at:to], lengths[at:to]
                # all postings of these segments: their places are the runs begin, begin + 1, ...
                first = done[at:to] - runs - before
                places = np.arange(int(done[to - 1]) - before, dtype=np.int32) + np.repeat((self.begins[part] - first).astype(np.int32), runs)
                members = self.postings[places]
                added = np.bincount(members, np.repeat(weight[part], runs), n)
                if exact:
                    total += added
                else:
                    partial += added.astype(np.int64)
                    seen += np.bincount(members, minlength=n)
                at = to
            if exact:
                both = total.astype(np.int64)
                partial, seen = both >> bits, both & ((1 << bits) - 1)
            slack = (int(size[order[at]]) if at < len(order) else 0) * (d - seen)
            low = np.partition(partial - slack, n - k)[n - k]
            possible = np.flatnonzero(partial + slack >= low)
            if len(possible) <= max(4 * k, FEW * n):
                break
        return possible


def _matrix(arrays: pd.Series, width: int) -> np.ndarray:
    """Vectors as rows; missing last components are zero."""
    out = np.zeros((len(arrays), width), np.int64)
    for n, a in enumerate(arrays):
        out[n, :len(a)] = a
    return out


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best candidates of every query by integer inner product.

    Both inputs are ``vec_id, v`` as ``quantised`` gives them.  The query's own id is no candidate; ties go
    to the smaller ``vec_id``; fewer candidates than k give fewer rows; shorter vectors count as padded with
    zeros.  Queries and candidates may be empty.  A repeated candidate row is a candidate of its own, a
    repeated query row is one query.  Scores are exact as long as partial sums stay below 2**53.
    """
    shards = -(-candidates.count() // SHARD_ROWS) or 1
    asked = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    blocks = -(-asked.count() // QUERY_ROWS) or 1
    left = asked.select(
        F.col("vec_id").alias("query_id"), "v", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
    )
    right = candidates.select(
        "vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
    )

    def search(key: tuple, q: pd.DataFrame, c: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if not len(q) or not len(c):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        width = max(max(map(len, q["v"])), max(map(len, c["v"])))
        shard = Shard(c["vec_id"].to_numpy(), _matrix(c["v"], width))
        found = []
        for query_id, vector in zip(q["query_id"], _matrix(q["v"], width), strict=True):
            ids, scores = shard.best(query_id, vector, k)
            found.append((np.full(len(ids), query_id), ids, scores))
        columns = [np.concatenate(x) for x in zip(*found, strict=True)]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))

    near = left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInPandas(
        search, "query_id bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
